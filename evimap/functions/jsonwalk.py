"""JSON texts by Arrow batches: the node walk, redaction and the printing of numbers.

A document is walked by one loop over its open containers, so the work grows
with its nodes alone, whatever their depth.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from functools import lru_cache
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evimap import constants as K

COLUMNS = "pointer string, key string, position int, role string, vtype string, text string"


class _Number(str):
    """The text of a JSON number."""

    __slots__ = ()


_READ = json.JSONDecoder(parse_float=_Number, parse_int=_Number).raw_decode
_INDEX = re.compile("(?:0|[1-9][0-9]{0,9})", re.ASCII).fullmatch


def _scalar(node: object) -> tuple[str, str | None]:
    """Type and text of a scalar."""
    if type(node) is str:
        return "string", node
    if type(node) is _Number:
        return "number", node
    return ("null", None) if node is None else ("boolean", "true" if node else "false")


def _place(field: str, i: int) -> str:
    """Ordinal of a key, the i-th of its object: array indexes by number, then the others."""
    return f"0{field:0>10}" if _INDEX(field) and int(field) < 4294967295 else f"1{i:010}"


def _nodes(raw: str, index: str, containers: bool, ordered: bool) -> list[tuple]:
    """Rows of COLUMNS and what the flags add; ordinals sort depth first in the order of the text, keys that are array indexes before others.

    A scalar becomes a row where its parent is gone through; only containers are put aside.
    """
    doc, _ = _READ(raw.lstrip(" \t\r\n"))
    plain, rest = not containers and not ordered, (None, None)
    found, level = [], [("/documents/" + index, index, -1, None, "", doc)]
    if type(doc) is not dict and type(doc) is not list:
        row = ("/documents/" + index, index, -1, None, *_scalar(doc))
        return [row if plain else row + (("",) if ordered else rest)]
    while level:
        below = []
        for pointer, key, position, role, order, node in level:
            if containers:
                found.append((pointer, key, position, role, None, None, "object" if type(node) is dict else "array", len(node)))
            base = pointer + "/"
            if type(node) is dict:
                name = node.get("key")
                name = name if type(name) is str else None
                for i, (field, child) in enumerate(node.items()):
                    part = base + (field.replace("~", "~0").replace("/", "~1") if "~" in field or "/" in field else field)
                    named = name if field == "value" else None
                    place = order + _place(field, i) if ordered else ""
                    kind = type(child)
                    if kind is dict or kind is list:
                        below.append((part, field, -1, named, place, child))
                        continue
                    row = (part, field, -1, named, "string", child) if kind is str else (part, field, -1, named, *_scalar(child))
                    found.append(row if plain else row + ((place,) if ordered else rest))
            else:
                for i, child in enumerate(node):
                    field, place = str(i), f"{order}{i:011}" if ordered else ""
                    if type(child) is dict or type(child) is list:
                        below.append((base + field, field, i, None, place, child))
                    else:
                        row = (base + field, field, i, None, *_scalar(child))
                        found.append(row if plain else row + ((place,) if ordered else rest))
        level = below
    return found


def _column(values: tuple, kind: pa.DataType) -> pa.Array:
    try:
        return pa.array(values, kind)
    except UnicodeEncodeError:  # half of a surrogate pair, which UTF-8 can't hold
        return pa.array([v if v is None else v.encode("utf-8", "replace").decode() for v in values], kind)


class Extra(Protocol):
    """Makes columns, those of ``ddl``, of the columns of walked rows."""

    ddl: str

    def __call__(self, columns: Sequence[Sequence]) -> list[pa.Array]: ...


def walk_documents(raw: Column, index: Column, containers: bool = False, ordered: bool = False, fields: Sequence[str] | None = None, extra: Extra | None = None) -> Column:
    """The scalars of each document as an array of structs of COLUMNS, to be unfolded by ``inline``; ``raw`` is a valid text or NULL.

    ``text`` is a scalar's own, that of a number as it is written. Either ``ordered`` adds the ``ordinal``, or
    ``containers`` adds the containers, with (container, children). ``fields`` names the columns to hand over, all if not given.
    ``extra`` adds columns that it makes of a batch's rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    if containers and ordered:
        raise ValueError("containers have no ordinal")
    added = T.StructType.fromDDL(COLUMNS + (", ordinal string" if ordered else ", container string, children int" if containers else ""))
    every = added.fieldNames()
    shown = every if fields is None else list(fields)
    places = [every.index(name) for name in shown]
    added = T.StructType([*(added[name] for name in shown), *(T.StructType.fromDDL(extra.ddl) if extra else ())])
    kind = to_arrow_type(T.ArrayType(added))
    typed = list(kind.value_type)

    def walk(raws: pa.Array, indexes: pa.Array) -> pa.Array:
        found, ends = [], [0]
        for text, at in zip(raws.to_pylist(), indexes.to_pylist(), strict=True):
            if text is not None:
                found.extend(_nodes(text, str(at), containers, ordered))
            ends.append(len(found))
        columns = list(zip(*found, strict=True)) if found else [()] * len(every)
        made = [column.cast(f.type) for column, f in zip(extra(columns), typed[len(places) :], strict=True)] if extra else []
        rows = pa.StructArray.from_arrays([*(_column(columns[i], f.type) for i, f in zip(places, typed, strict=False)), *made], fields=typed)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows, type=kind)

    return F.arrow_udf(walk, T.ArrayType(added))(raw, index)


def _shape(raw: str) -> tuple[int, int]:
    """Number of nodes of a valid text and depth of the deepest."""
    doc, _ = _READ(raw.lstrip(" \t\r\n"))
    nodes, depth, level = 1, 0, [doc]
    while level := [child for node in level if type(node) in (dict, list) for child in (node.values() if type(node) is dict else node)]:
        nodes, depth = nodes + len(level), depth + 1
    return nodes, depth


def document_shapes(raw: Column) -> Column:
    """STRUCT<nodes, depth> of each document, NULL for NULL; ``raw`` is a valid text or NULL."""
    from pyspark.sql.pandas.types import to_arrow_type

    added = T.StructType.fromDDL("nodes int, depth int")
    kind = to_arrow_type(added)

    def shapes(raws: pa.Array) -> pa.Array:
        found = [None if text is None else dict(zip(("nodes", "depth"), _shape(text), strict=True)) for text in raws.to_pylist()]
        return pa.array(found, kind)

    return F.arrow_udf(shapes, added)(raw)


_PATH_BREAKS = re.compile("[^a-z0-9]+")


@lru_cache(maxsize=1 << 14)
def _path(pointer: str) -> str:
    """``text.normalize_json_path`` of the names above and of a leaf, with dots between; index brackets hold digits alone, which are left out anyway."""
    parts = pointer.split("/")[3:]
    if "~" in pointer:
        parts = [part.replace("~1", "/").replace("~0", "~") for part in parts]
    return ".".join(word for word in _PATH_BREAKS.split(".".join(parts).lower()) if word and not word.isdigit())


class Paths:
    """Adds the normalised ``path`` of each walked scalar, worked out once for a pointer that comes again."""

    ddl = "path string"

    def __call__(self, columns: Sequence[Sequence]) -> list[pa.Array]:
        return [pa.array(map(_path, columns[0]), pa.string())]


_PARTS = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[-0-9][-+.0-9eE]*')


def _number(text: str, python: bool) -> str:
    """``jsoncols.canonical_number`` of one text: the fewest digits that read back, with an exponent where the writer gives one."""
    number = float(text)
    if number == 0:
        return "0"
    if text.removeprefix("-").isdigit() and len(text.removeprefix("-")) <= (21 if python else 15):
        return text
    if number in (float("inf"), -float("inf")):
        return "null"
    plain, _, power = repr(abs(number)).partition("e")
    whole, _, fraction = plain.partition(".")
    bare = (whole + fraction).lstrip("0")
    point, digits = len(bare) - len(fraction) + int(power or 0), bare.rstrip("0")
    if 0 < point <= 21:
        shown = digits.ljust(point, "0") if len(digits) <= point else f"{digits[:point]}.{digits[point:]}"
    elif (-4 if python else -6) < point <= 0:
        shown = "0." + "0" * -point + digits
    else:
        size = str(abs(point - 1))
        shown = digits[0] + ("." + digits[1:] if len(digits) > 1 else "") + ("e+" + size if point > 0 else "e-" + (size.rjust(2, "0") if python else size))
    return "-" + shown if number < 0 else shown


# other texts hold no number but short whole ones, which print as they are
_NUMBERED = re.compile(r'[0-9]{16}|[0-9][.eE]|-0|Infinity"').search


def number_printer(python: bool) -> Callable[[Column, Column], Column]:
    """Compact JSON texts with their numbers in canonical form; the second column tells whether the text itself may hold the string ``Infinity``."""
    def one(text: str, real: bool) -> str:
        def part(found: re.Match) -> str:
            piece = found[0]
            if piece[0] == '"':
                return "null" if not real and piece in ('"Infinity"', '"-Infinity"') else piece
            return _number(piece, python)

        return _PARTS.sub(part, text)

    def printed(texts: pa.Array, infinite: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), infinite.to_pylist(), strict=True)
        return pa.array([one(text, real) if text is not None and _NUMBERED(text) else text for text, real in rows], pa.string())

    return F.arrow_udf(printed, T.StringType())


_CONTROLS = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r", '"': '\\"', "\\": "\\\\"}
_ESCAPES = {c: _CONTROLS.get(c, f"\\u{ord(c):04X}") for c in map(chr, (*range(32), 34, 92))}
_ESCAPED = re.compile(r'[\x00-\x1f"\\]')


class _Text(str):
    """JSON text of a value that is written already."""

    __slots__ = ()


def _quoted(text: str) -> str:
    return '"' + (_ESCAPED.sub(lambda m: _ESCAPES[m[0]], text) if _ESCAPED.search(text) else text) + '"'


def _written(value: object) -> str:
    """JSON text of a scalar, of an object that is written already, or of a list of such at any depth."""
    if type(value) is _Text:
        return value
    if type(value) is str:
        return _quoted(value)
    if type(value) is not list:
        return "null" if value is None else "true" if value else "false"
    done, open_ = [], [(iter(value), [])]
    while open_:
        rest, parts = open_[-1]
        for child in rest:
            if type(child) is list:
                open_.append((iter(child), []))
                break
            parts.append(_written(child))
        else:
            open_.pop()
            (open_[-1][1] if open_ else done).append("[" + ",".join(parts) + "]")
    return done[0]


@lru_cache(maxsize=4096)
def _is_sensitive(key: str) -> bool:
    plain = re.sub("[^a-z0-9]", "", key.lower())
    return plain in K.SENSITIVE_KEYS or re.search(K.SENSITIVE_PATTERN, plain) is not None


def _kept_object(pairs: list[tuple]) -> _Text:
    """An object without its sensitive keys; keys that are array indexes come first, by number, the others as in the text."""
    kept = [(key, value) for key, value in pairs if not _is_sensitive(key)]
    if any(key[:1].isdigit() for key, _ in kept):
        places = sorted((_place(key, i), i) for i, (key, _) in enumerate(kept))
        kept = [kept[i] for _, i in places]
    return _Text("{" + ",".join(_quoted(key) + ":" + _written(value) for key, value in kept) + "}")


def _printed(text: str) -> _Text:
    return _Text(_number(text, False))


# objects are written as they close, so a subtree below a sensitive key goes with its text
_REDACT = json.JSONDecoder(parse_float=_printed, parse_int=_printed, object_pairs_hook=_kept_object).raw_decode


def _redacted(raw: str) -> str:
    return _written(_REDACT(raw.lstrip(" \t\r\n"))[0])


def redacted_documents(raw: Column) -> Column:
    """Documents without keys that may name a credential, at any depth; ``raw`` is a valid text or NULL."""
    def redacted(raws: pa.Array) -> pa.Array:
        return _column([None if text is None else _redacted(text) for text in raws.to_pylist()], pa.string())

    return F.arrow_udf(redacted, T.StringType())(raw)
