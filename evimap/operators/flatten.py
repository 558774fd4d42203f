"""From JSON documents to typed leaf rows, and the structural checks on them.

``docs`` always has (incident_id, doc_index, raw).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evimap import constants as K
from evimap.functions import jsoncols as J
from evimap.functions.jsonwalk import Extra, Paths, document_shapes, redacted_documents, walk_documents
from evimap.functions.text import available_clean, clean_text, is_sensitive_key, normalize_json_path, trim_all
from evimap.session import dealt, spread


def unparseable(docs: DataFrame) -> DataFrame:
    """Documents that are not one JSON value (a repeated object key counts too)."""
    return docs.where(F.try_parse_json("raw").isNull()).select(
        "incident_id", "doc_index", F.lit("unparseable_document").alias("violation")
    )


def _parsed(docs: DataFrame) -> DataFrame:
    """Documents with their parsed value; broken ones stay, with NULL.

    They are not filtered here: the filter would sink below the projection and
    parse every text a second time. The walk of NULL has no rows.
    """
    return spread(docs).select("incident_id", "doc_index", "raw", F.try_parse_json("raw").alias("doc"))


def _unfolded(docs: DataFrame, fields: Sequence[str] | None = None, containers: bool = False, ordered: bool = False, extra: Extra | None = None) -> DataFrame:
    """Nodes of the documents that are one JSON value, with those of the walk's ``fields``."""
    valid = spread(docs).select("incident_id", "doc_index", F.when(F.try_parse_json("raw").isNotNull(), F.col("raw")).alias("raw"))
    return valid.select("incident_id", "doc_index", F.inline(walk_documents(F.col("raw"), F.col("doc_index"), containers, ordered, fields, extra)))


def _walked(docs: DataFrame, containers: bool = False, ordered: bool = False, extra: Extra | None = None) -> DataFrame:
    """Nodes with the names above each and its depth."""
    names = F.split(F.substring("pointer", 2, 1 << 30), "/")
    plain = F.transform(names, lambda n: F.replace(F.replace(n, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
    return (
        _unfolded(docs, None, containers, ordered, extra)
        .withColumn("ancestry", F.slice(F.when(F.contains("pointer", F.lit("~")), plain).otherwise(names), F.lit(1), F.size(names) - 1))
        .withColumn("depth", F.size(names) - 2)
    )


def nodes(docs: DataFrame) -> DataFrame:
    """Every container and scalar of every document, with the ``value`` of a scalar; narrow, no shuffle."""
    scalar = (
        F.when(F.col("vtype") == "string", F.col("text").cast("variant")).when(F.col("vtype") == "boolean", F.col("text").cast("boolean").cast("variant"))
        .when(F.col("vtype").isNotNull(), F.try_parse_json(F.coalesce("text", F.lit("null"))))
    )
    return _walked(docs, containers=True).withColumn("value", scalar).drop("vtype", "text")


def leaves(docs: DataFrame, together: bool = False, named: Sequence[str] | None = None, extra: Extra | None = None) -> DataFrame:
    """One row per scalar, JSON null included.

    ``role`` is the text of the sibling ``key`` of a ``value`` leaf. Who needs no more than the values of leaves, and those of (pointer, key,
    position, role) that are ``named``, is given these alone, which spares most of what the walk hands over. ``together`` deals the leaves by
    incident, so that grouping the many pairs or scores made of them by incident shuffles nothing more. ``extra`` adds columns that the walk makes.
    """
    added = T.StructType.fromDDL(extra.ddl).fieldNames() if extra else []
    if named is None:
        columns = (J.leaf_id(F.col("pointer")).alias("leaf_id"), "pointer", "ancestry", "key", "position", "depth", "role")
        rows = _texts(_walked(docs, extra=extra))
    else:
        columns, rows = tuple(named), _texts(_unfolded(docs, [*named, "vtype", "text"], extra=extra))
    rows = rows.select("incident_id", "doc_index", *columns, "vtype", "value_text", "value_num", *added)
    return dealt(rows, "incident_id") if together else rows


def _texts(scalar: DataFrame) -> DataFrame:
    """Adds ``value_text`` and ``value_num`` to walked scalars."""
    is_number = F.col("vtype") == "number"
    return (
        scalar.withColumn("_number", F.when(is_number, F.try_parse_json("text")))
        .withColumn("value_num", F.try_variant_get("_number", "$", "double"))
        .withColumn("value_text", F.when(is_number, J.number_text(F.col("value_num"), F.try_variant_get("_number", "$", "string"))).otherwise(F.col("text")))
        .drop("_number", "text")
    )


def _typed(scalar: DataFrame) -> DataFrame:
    text = F.try_variant_get("value", "$", "string")
    number = F.when(F.col("vtype") == "number", F.try_variant_get("value", "$", "double"))
    return (
        scalar.withColumn("vtype", J.variant_kind(F.col("value")))
        .withColumn("value_num", number)
        .withColumn("value_text", F.when(F.col("vtype") == "number", J.number_text(number, text)).otherwise(text))
        .drop("value")
    )


def resolve_pointers(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """Value and kind at each requested pointer; ``found`` is FALSE when missing.

    ``requests`` has (incident_id, pointer). Containers resolve too.
    """
    known = _texts(_walked(docs, containers=True)).select("incident_id", "pointer", F.coalesce("vtype", "container").alias("kind"), "value_text")
    return requests.join(known, ["incident_id", "pointer"], "left").select(
        "incident_id", "pointer", F.col("kind").isNotNull().alias("found"), "kind", "value_text"
    )


def document_sizes(docs: DataFrame) -> DataFrame:
    """Per document: bytes of the compact text, node count, greatest depth."""
    shaped = _parsed(docs).withColumn("valid", F.when(F.col("doc").isNotNull(), F.col("raw")))
    return shaped.select(
        "incident_id", "doc_index", F.col("doc").isNull().alias("broken"),
        F.coalesce(F.octet_length(F.to_json("doc")), F.lit(0)).alias("bytes"), document_shapes(F.col("valid")).alias("shape"),
    ).select(
        "incident_id", "doc_index", "broken", "bytes",
        F.coalesce("shape.nodes", F.lit(0)).alias("nodes"), F.coalesce("shape.depth", F.lit(0)).alias("depth"),
    )


def complexity(docs: DataFrame) -> DataFrame:
    """One row per incident with its sizes and '' or the first violated limit."""
    totals = document_sizes(docs).groupBy("incident_id").agg(
        F.count(F.lit(1)).alias("documents"),
        (F.sum("bytes") + F.count(F.lit(1)) + 1).alias("bytes"),
        F.sum("nodes").alias("nodes"),
        F.max("depth").alias("depth"),
        F.bool_or("broken").alias("broken"),
    )
    violation = (
        F.when(F.col("broken"), F.lit("unparseable_document"))
        .when(F.col("documents") > K.MAX_DOCUMENTS, F.lit("too_many_documents"))
        .when(F.col("bytes") > K.MAX_DOCUMENT_BYTES, F.lit("too_large"))
        .when((F.col("depth") > K.MAX_DEPTH) | (F.col("nodes") > K.MAX_NODES), F.lit("too_complex"))
        .otherwise(F.lit(""))
    )
    return totals.withColumn("violation", violation).drop("broken")


def within_limits(docs: DataFrame) -> DataFrame:
    """Documents of incidents that pass every limit; an incident is kept whole or not at all."""
    good = complexity(docs).where("violation = ''").select("incident_id")
    return docs.join(good, "incident_id", "left_semi")


def sibling_context(leaf_rows: DataFrame, siblings: int | None = None, characters: int | None = None) -> DataFrame:
    """Adds the first eight scalars of the same parent and what was left out.

    A ``value`` leaf sees the sibling named ``key`` first. With a number of ``siblings``
    no more than one more of a group (plus ``key``) are collected.
    """
    parent = Window.partitionBy("incident_id", "parent")
    ordered = parent.orderBy("position", "key")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    entry = F.struct(
        "key", "vtype", F.col("value_text").alias("full"), F.col("leaf_id").alias("id"),
    )
    ranked = (
        leaf_rows.withColumn("parent", F.expr("substring_index(pointer, '/', size(ancestry) + 1)"))
        .withColumn("rank", F.row_number().over(ordered))
        .withColumn("members", F.count(F.lit(1)).over(parent))
        .withColumn("near", F.collect_list(entry if siblings is None else F.when((F.col("rank") <= siblings + 1) | (F.col("key") == "key"), entry)).over(whole))
    )
    others = F.filter("near", lambda s: s["id"] != F.col("leaf_id"))
    keyed = F.concat(F.filter(others, lambda s: s["key"] == "key"), F.filter(others, lambda s: s["key"] != "key"))
    first = F.when(F.col("key") == "value", keyed).otherwise(others)
    first = first if siblings is None else F.slice(first, 1, siblings)
    over = lambda s: F.lit(False) if characters is None else (s["vtype"] == "string") & (F.length(s["full"]) > characters)
    long = F.filter("shown", over)
    shown = F.transform("shown", lambda s: F.struct(
        s["key"].alias("key"), s["vtype"].alias("vtype"),
        F.when(over(s), F.substring(s["full"], 1, characters or 0)).otherwise(s["full"]).alias("value"),
    ))
    return (
        ranked.withColumn("shown", first)
        .withColumn("context", shown)
        .withColumn("omitted_siblings", F.lit(0).cast("bigint") if siblings is None else F.greatest(F.lit(0), F.col("members") - (siblings + 1)))
        .withColumn("shortened_siblings", F.size(long))
        .drop("parent", "rank", "members", "near", "shown")
    )


def sanitize_json(docs: DataFrame, replacement: str = K.REDACTED) -> DataFrame:
    """Dotted paths of a document with every value replaced; one row per path."""
    parsed = _parsed(docs)
    ends = F.filter(J.walk("raw", "doc", "doc_index", paths=True), lambda n: F.coalesce(n["children"], F.lit(0)) == 0)
    kept = F.filter(ends, lambda n: n["container"].isNull() | (n["shown"] != ""))
    paths = F.array_distinct(F.transform(kept, lambda n: F.when(n["shown"] == "", F.lit("$")).otherwise(n["shown"])))
    return parsed.select("incident_id", "doc_index", F.explode(paths).alias("path")).withColumn("value", F.lit(replacement))


def sensitive_ancestry(ancestry: Column, key: Column) -> Column:
    return F.exists(F.concat(F.slice(ancestry, 3, F.size(ancestry)), F.array(key)), is_sensitive_key)


def drop_sensitive_leaves(leaf_rows: DataFrame) -> DataFrame:
    """Leaves below no key that may name a credential."""
    return leaf_rows.where(~sensitive_ancestry(F.col("ancestry"), F.col("key")))


def without_sensitive(docs: DataFrame) -> DataFrame:
    """Documents rebuilt without keys that may name a credential, at any depth; key order and values stay, NULL if unparseable.

    Numbers are written by ``canonical_number``; one beyond a double is null.
    """
    valid = F.when(F.try_parse_json("raw").isNotNull(), F.col("raw"))
    return spread(docs).select("incident_id", "doc_index", valid.alias("raw")).withColumn("raw", redacted_documents(F.col("raw")))


def json_pairs(docs: DataFrame, max_depth: int | None = None, max_nodes: int | None = None, max_items: int | None = None, max_keys: int | None = None) -> DataFrame:
    """(incident_id, doc_index, ordinal, path, value, pointer) for label lookups; the ordinal follows the text.

    Every pair of a document is given; the four limits are off unless a caller
    sets them, and then apply inside the row of one document.
    """
    if max_depth is None and max_nodes is None and max_items is None and max_keys is None:
        pathed = _texts(_unfolded(docs, ["pointer", "vtype", "text", "ordinal"], ordered=True, extra=Paths()))
    else:
        walked = J.walk("raw", "doc", "doc_index", paths=True, max_depth=max_depth, max_items=max_items, max_keys=max_keys)
        if max_nodes is not None:
            in_order = F.array_sort(walked, lambda a, b: F.when(a["ordinal"] < b["ordinal"], -1).when(a["ordinal"] > b["ordinal"], 1).otherwise(0))
            walked = F.slice(in_order, 1, max_nodes)
        near = _parsed(docs).select("incident_id", "doc_index", F.inline(walked))  # unfolded at once: a named array would be walked again by each later step
        path = normalize_json_path(F.array_join(F.concat(F.slice("ancestry", 3, F.size("ancestry")), F.array("key")), "."))
        pathed = _typed(near.where("container is null")).withColumn("path", F.when(F.size("ancestry") > 1, path).otherwise(F.lit("")))
    return (
        pathed.withColumn("value", clean_text(F.coalesce("value_text", F.lit("null"))))
        .where((F.col("path") != "") & available_clean(F.col("value")))
        .select("incident_id", "doc_index", "ordinal", "path", "value", "pointer")
    )


def trimmed_text(vtype: Column, text: Column) -> Column:
    """The text a structural test looks at; JSON null reads as ''."""
    return F.when(vtype == "null", F.lit("")).otherwise(trim_all(F.coalesce(text, F.lit(""))))
