"""JSON columns: canonical text, hashes and the node walk of a document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from evimap.functions.jsonwalk import number_printer


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once and stands once in the plan."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _digits(printed: Column, power: Column) -> Column:
    """(digits, point) of a plain decimal times ten to ``power``: its value is 0.digits times ten to the power of ``point``."""
    def placed(parts: Column) -> Column:
        whole = F.get(parts, F.lit(0))
        bare = lambda all_: F.struct(F.rtrim(F.ltrim(all_, F.lit("0")), F.lit("0")).alias("digits"), (F.length(whole) + power - F.length(all_) + F.length(F.ltrim(all_, F.lit("0")))).alias("point"))
        return _let(F.concat(whole, F.get(parts, F.lit(1))), bare)

    return _let(F.split(printed, "\\."), placed)


def _shortest(number: Column) -> Column:
    """(digits, point) of a positive double, the fewest digits that read back as it.

    The JVM's own text can have two digits too many, the last of them wrong by a little;
    they are rounded away, to either side, if the rest reads back.
    """
    start = _let(F.split(number.cast("string"), "E"), lambda p: _digits(F.get(p, F.lit(0)), F.coalesce(F.get(p, F.lit(1)).cast("int"), F.lit(0))))

    def shorter(found: Column, _: Column) -> Column:
        def candidate(tenth: Column) -> Column:
            return F.struct(F.rtrim(tenth, F.lit("0")).alias("digits"), (found["point"] + F.length(tenth) - F.length(found["digits"]) + 1).alias("point"))

        tenths = F.transform(F.array(F.lit(5), F.lit(0), F.lit(10)), lambda added: F.floor((found["digits"].cast("decimal(20,0)") + added) / 10).cast("decimal(20,0)").cast("string"))
        reads = lambda c: (c["digits"] != "") & (F.concat(F.lit("0."), c["digits"], F.lit("E"), c["point"].cast("string")).cast("double") == number)
        return F.coalesce(F.get(F.filter(F.transform(tenths, candidate), reads), F.lit(0)), found)

    return F.aggregate(F.array(F.lit(1), F.lit(2)), start, shorter)


def canonical_number(text: Column, python: bool = False) -> Column:
    """A JSON number as the two writers of the contract print it.

    Both print the fewest digits that read back. The first writes 1e21 and more, and
    less than 1e-6, with an exponent; ``python``: less than 1e-4, the exponent with two digits, and
    whole numbers below 1e21 with all their digits. What a double can't hold is null.
    """
    def printed(found: Column) -> Column:
        digits, point, count = found["digits"], found["point"], F.length(found["digits"])
        power = F.abs(point - 1).cast("string")
        short = F.lpad(power, F.greatest(F.lit(2), F.length(power)), F.lit("0")) if python else power
        fraction = F.when(count > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), count))).otherwise(F.lit(""))
        return (
            F.when((point > 0) & (point <= 21) & (count <= point), F.rpad(digits, point, F.lit("0")))
            .when((point > 0) & (point <= 21), F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, count)))
            .when((point <= 0) & (point > (-4 if python else -6)), F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
            .otherwise(F.concat(F.substring(digits, 1, 1), fraction, F.when(point > 0, F.concat(F.lit("e+"), power)).otherwise(F.concat(F.lit("e-"), short))))
        )

    number = text.cast("double")
    whole = text.rlike("^-?[0-9]{1,21}$") if python else text.rlike("^-?[0-9]{1,15}$")
    value = F.concat(F.when(number < 0, F.lit("-")).otherwise(F.lit("")), _let(_shortest(F.abs(number)), printed))
    return F.when(number == 0, F.lit("0")).when(whole, text).when(F.abs(number) == float("inf"), F.lit("null")).otherwise(value)


def canonical_json(raw: Column, python: bool = False) -> Column:
    """Sorted keys, no blanks, numbers by the rule of :func:`canonical_number`; NULL when the text is not one JSON value.

    The numbers are printed by Arrow batches; :func:`nested_canonical_json` is for use inside a lambda.
    """
    return number_printer(python)(F.to_json(F.try_parse_json(raw)), raw.contains('Infinity"'))


def nested_canonical_json(raw: Column, python: bool = False) -> Column:
    """:func:`canonical_json` as one expression of the JVM."""
    text = F.to_json(F.try_parse_json(raw))
    parts = F.regexp_extract_all(text, F.lit(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[-0-9][-+.0-9eE]*|[^-0-9"]++'), F.lit(0))
    # a number beyond a double comes as this text
    beyond = lambda p: p.isin('"Infinity"', '"-Infinity"') & ~raw.contains('Infinity"')
    numbers = F.transform(parts, lambda p: F.when(p.rlike("^-?[0-9]"), canonical_number(p, python)).when(beyond(p), F.lit("null")).otherwise(p))
    # most texts hold no number but short whole ones, which print as they are
    return F.when(text.rlike('[0-9]{16}|[0-9][.eE]|-0|Infinity"'), F.array_join(numbers, "")).otherwise(text)


def sha256_json(raw: Column, python: bool = False) -> Column:
    return F.sha2(canonical_json(raw, python), 256)


def json_string(text: Column) -> Column:
    """A text as JSON string literal."""
    wrapped = F.to_json(F.struct(text.alias("v")))
    plain = F.concat(F.lit('"'), text, F.lit('"'))  # most texts hold nothing to escape
    return F.when(text.rlike(r"^[ !#-\[\]-~]*\z"), plain).otherwise(F.substring(wrapped, F.lit(6), F.length(wrapped) - 6))


def json_literal(vtype: Column, text: Column) -> Column:
    return (
        F.when(vtype == "string", json_string(text))
        .when(vtype == "null", F.lit("null"))
        .otherwise(text)
    )


def identity_text(vtype: Column, text: Column) -> Column:
    """``["type",value]``: two leaves hold the same value when this is equal."""
    return F.concat(F.lit('["'), vtype, F.lit('",'), json_literal(vtype, text), F.lit("]"))


def variant_kind(value: Column) -> Column:
    """null, boolean, number or string for a scalar; object or array else."""
    schema = F.schema_of_variant(value)
    return (
        F.when(schema == "STRING", F.lit("string"))
        .when(schema == "BOOLEAN", F.lit("boolean"))
        .when(schema.isNull() | (schema == "VOID"), F.lit("null"))
        .when(F.startswith(schema, F.lit("OBJECT")), F.lit("object"))
        .when(F.startswith(schema, F.lit("ARRAY")), F.lit("array"))
        .otherwise(F.lit("number"))
    )


def json_type(value: Column) -> Column:
    """Like :func:`variant_kind`, but whole numbers are ``integer``."""
    schema = F.schema_of_variant(value)
    return F.when(schema == "BIGINT", F.lit("integer")).otherwise(variant_kind(value))


def matches_json_type(actual: Column, expected: Column) -> Column:
    return (actual == expected) | ((expected == "number") & (actual == "integer"))


def number_text(number: Column, text: Column) -> Column:
    """``1.0`` and ``1`` are one value: whole numbers print without a fraction."""
    whole = (F.floor(number) == number) & (F.abs(number) < 9007199254740992.0) & text.rlike("[.eE]")
    return F.when(whole, number.cast("bigint").cast("string")).otherwise(text)


def leaf_id(pointer: Column) -> Column:
    return F.concat(F.lit("f"), F.substring(F.sha2(pointer, 256), 1, 20))


def pointer_part(key: str) -> str:
    return f"replace(replace({key}, '~', '~0'), '/', '~1')"


def _node(pointer: str, ancestry: str, key: str, position: str, role: str, shown: str, order: str, value: str, text: str, kinds: str) -> str:
    return (
        f"named_struct('pointer', {pointer}, 'ancestry', {ancestry}, 'key', {key}, 'position', {position}, 'role', {role}, "
        f"'shown', {shown}, 'ordinal', {order}, 'value', {value}, 'text', {text}, 'kinds', {kinds}, "
        f"'fields', try_variant_get({value}, '$', 'map<string,variant>'), "
        f"'items', try_variant_get({value}, '$', 'array<variant>'))"
    )


def walk(raw: str, value: str, index: str, **limits) -> Column:
    """:func:`walk_text` as a Column."""
    return F.expr(walk_text(raw, value, index, **limits))


def depth_text(raw: str) -> str:
    """The greatest number of open brackets of a JSON text, without those in strings."""
    plain = rf"regexp_replace(replace(replace({raw}, r'\\', ''), r'\"', ''), '\"[^\"]*\"', '')"
    brackets = rf"split(regexp_replace({plain}, r'[^\[\]{{}}]', ''), '')"
    return (
        f"aggregate({brackets}, named_struct('now', 0, 'most', 0), (a, c) -> named_struct("
        "'now', a.now + case when c in ('{', '[') then 1 when c in ('}', ']') then -1 else 0 end, "
        "'most', greatest(a.most, a.now + if(c in ('{', '['), 1, 0))), a -> a.most)"
    )


def walk_text(
    raw: str, value: str, index: str, paths: bool = False,
    max_depth: int | None = None, max_items: int | None = None, max_keys: int | None = None,
) -> str:
    """All nodes of one document as an array of structs, level by level.

    One expression evaluated inside the row: each step replaces the open
    containers by their children. There is no shuffle, no driver loop and no
    Python; the steps are as many as the text has levels. The three limits are off
    unless given. ``paths`` also carries the brackets that are open around a node, the dotted path without list steps
    and an ordinal that sorts the nodes depth first, the keys of an object in the order
    of the text, those that are array indexes before others and by number.
    """
    escaped = r"replace(replace(c.key, '\\', '\\\\'), '.', '\\.')"
    shown_field = f"if(n.shown = '', {escaped}, concat(n.shown, '.', {escaped}))" if paths else "''"
    shown_item = "n.shown" if paths else "''"
    # a variant sorts its keys; the text of a container keeps their order
    index_key = "c.key rlike '^(0|[1-9][0-9]{0,9})$' and cast(c.key as bigint) < 4294967295"
    order_field = f"concat(n.ordinal, if({index_key}, concat('0', lpad(c.key, 10, '0')), concat('1', lpad(cast(i as string), 10, '0'))))" if paths else "''"
    order_item = "concat(n.ordinal, lpad(cast(i as string), 11, '0'))" if paths else "''"
    entries = "map_entries(from_json(n.text, 'map<string,string>'))" if paths else "map_entries(n.fields)"
    fields = entries if max_keys is None else f"slice({entries}, 1, {max_keys})"
    listed = "zip_with(n.items, from_json(n.text, 'array<string>'), (x, t) -> named_struct('x', x, 't', t))" if paths else "n.items"
    items = listed if max_items is None else f"slice({listed}, 1, {max_items})"
    field_value, field_text = ("try_element_at(n.fields, c.key)", "c.value") if paths else ("c.value", "''")
    item_value, item_text = ("x.x", "x.t") if paths else ("x", "''")
    is_open = "n.fields is not null or n.items is not null"
    # the text of the sibling ``key`` names a ``value``
    no_role = "cast(null as string)"
    role = (
        "if(c.key = 'value' and schema_of_variant(try_element_at(n.fields, 'key')) = 'STRING', "
        f"try_variant_get(try_element_at(n.fields, 'key'), '$', 'string'), {no_role})"
    )
    root = _node(f"concat('/documents/', {index})", "array('documents')", f"cast({index} as string)", "-1", no_role, "''", "''", value, raw if paths else "''", "''")
    below = "concat(n.ancestry, array(n.key))"
    field = _node(f"concat(n.pointer, '/', {pointer_part('c.key')})", below, "c.key", "-1", role, shown_field, order_field, field_value, field_text, "concat(n.kinds, '{')" if paths else "''")
    item = _node("concat(n.pointer, '/', i)", below, "cast(i as string)", "i", no_role, shown_item, order_item, item_value, item_text, "concat(n.kinds, '[')" if paths else "''")
    slim = (
        "named_struct('pointer', n.pointer, 'ancestry', n.ancestry, 'key', n.key, 'position', n.position, "
        "'role', n.role, 'shown', n.shown, 'ordinal', n.ordinal, 'kinds', n.kinds, 'children', coalesce(cardinality(n.fields), cardinality(n.items)), "
        "'container', case when n.fields is not null then 'object' when n.items is not null then 'array' end, "
        "'value', if(n.fields is null and n.items is null, n.value, null))"
    )
    kind = (
        "array<struct<pointer:string,ancestry:array<string>,key:string,position:int,role:string,shown:string,ordinal:string,kinds:string,"
        "children:int,container:string,value:variant>>"
    )
    levels = depth_text(raw)
    steps = f"sequence(0, {levels if max_depth is None else f'least({max_depth}, {levels})'})"
    return (
        f"if({value} is null, null, aggregate({steps}, named_struct('open', array({root}), 'done', cast(array() as array<{kind}>)), "
        f"(acc, step) -> if(size(acc.open) = 0, acc, named_struct("
        f"'open', flatten(transform(filter(acc.open, n -> {is_open}), n -> coalesce("
        f"transform({fields}, (c, i) -> {field}), transform({items}, (x, i) -> {item})))), "
        f"'done', concat(acc.done, array(transform(acc.open, n -> {slim}))))), "
        f"acc -> flatten(acc.done)))"
    )


def rebuilt(nodes: Column) -> Column:
    """JSON text of a walk's nodes (with ``paths``, in order, any subtrees left out), in one pass over them.

    A node that its parent stands before is a first child; what it leaves open and the
    next node doesn't need is closed after it.
    """
    def text(all_: Column) -> Column:
        def one(n: Column, i: Column) -> Column:
            before, after = F.get(all_, i - 1), F.get(all_, i + 1)
            first = (i == 0) | (F.size(before["ancestry"]) < F.size(n["ancestry"]))
            name = F.when(F.endswith(n["kinds"], F.lit("{")), F.concat(json_string(n["key"]), F.lit(":"))).otherwise(F.lit(""))
            scalar = F.to_json(n["value"])
            number = variant_kind(n["value"]) == "number"
            body = F.when(n["container"] == "object", F.lit("{")).when(n["container"] == "array", F.lit("[")).when(number, canonical_number(F.replace(scalar, F.lit('"'), F.lit("")))).otherwise(F.coalesce(scalar, F.lit("null")))
            mine = F.concat(n["kinds"], F.when(n["container"] == "object", F.lit("{")).when(n["container"] == "array", F.lit("[")).otherwise(F.lit("")))
            left = F.substring(mine, F.coalesce(F.length(after["kinds"]), F.lit(0)) + 1, F.length(mine))
            return F.concat(F.when(first, F.lit("")).otherwise(F.lit(",")), name, body, F.translate(F.reverse(left), "{[", "}]"))

        return F.array_join(F.transform(all_, one), "")

    return _let(nodes, text)
