"""Text normalisation. Every function is Column -> Column and stays in the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from evimap import constants as K

_TRIM = f"^[{K.SPACES}]+|[{K.SPACES}]+$"
# the class K.SPACES, character by character
_SPACES = "".join(c for c in map(chr, range(0x10000)) if re.fullmatch(f"[{K.SPACES}]", c))


def trim_all(col: Column) -> Column:
    """Trim Unicode white space, not only the blank, also before a last U+0085, which ends a line for a pattern.

    Other texts take one call and no pattern, so that many of them still make a method the JVM compiles.
    """
    return F.when(F.endswith(col, F.lit("\u0085")), F.regexp_replace(col, _TRIM, "")).otherwise(F.trim(col, F.lit(_SPACES)))


def clean_text(col: Column) -> Column:
    """One blank between words, no blanks around line ends, trimmed; NULL -> ''. Most texts need no more than the trim."""
    given = F.coalesce(col, F.lit(""))
    text = F.replace(given, F.lit("\u00a0"), F.lit(" "))
    text = F.regexp_replace(text, "[ \t]+", " ")
    text = F.regexp_replace(text, f"[{K.SPACES}]*\n[{K.SPACES}]*", "\n")
    return F.when(given.rlike("[\t\n\u00a0]|  "), F.regexp_replace(text, _TRIM, "")).otherwise(trim_all(given))


def available_clean(clean: Column) -> Column:
    """As :func:`is_available`, for a value that is clean already."""
    # one call instead of a comparison each; a text with a comma is found in no set
    return F.find_in_set(F.lower(clean), F.lit(",".join(("", *K.PLACEHOLDERS)))) == 0


def is_available(col: Column) -> Column:
    return available_clean(clean_text(col))


def first_available(*cols: Column) -> Column:
    """The first value that says something, cleaned, else ''."""
    return F.coalesce(*(F.when(is_available(c), clean_text(c)) for c in cols), F.lit(""))


def normalize_label(col: Column) -> Column:
    return F.regexp_replace(F.lower(clean_text(col)), f"[{K.SPACES}]+", " ")


def normalize_key(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(clean_text(col)), "[^a-z0-9]+", " "))


def normalize_json_path(col: Column) -> Column:
    text = F.regexp_replace(F.lower(clean_text(col)), r"\[(?:[0-9]+|\*)\]", ".")
    parts = F.filter(F.split(text, "[^a-z0-9]+"), lambda p: (p != "") & ~p.rlike("^[0-9]+$"))
    return F.array_join(parts, ".")


def escape_query_value(col: Column) -> Column:
    return F.replace(F.replace(clean_text(col), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def render_query(name: Column, tenant: Column, template: str = K.QUERY_TEMPLATE) -> tuple[Column, Column]:
    """(query, error) of the history search; exactly one of the two is not NULL.

    The template is cut at its placeholders first, so text that comes out of a
    value is never taken for a placeholder.
    """
    quoted = {
        "incidentName": F.concat(F.lit('"'), escape_query_value(name), F.lit('"')),
        "tenantName": F.concat(F.lit('"'), escape_query_value(tenant), F.lit('"')),
    }
    pieces: list[Column] = []
    for outer in template.split("{incidentName}"):
        if pieces:
            pieces.append(quoted["incidentName"])
        for index, inner in enumerate(outer.split("{tenantName}")):
            if index:
                pieces.append(quoted["tenantName"])
            pieces.append(F.lit(inner))
    return checked_query(F.concat(*pieces), is_available(name) & is_available(tenant))


def checked_query(query: Column, identified: Column) -> tuple[Column, Column]:
    """The checks every history query must pass, however it was built."""
    bad = (
        query.isNull() | (trim_all(query) == "") | (F.length(query) > K.MAX_QUERY_LENGTH)
        | query.rlike("[\\x00-\\x1f]")
    )
    error = (
        F.when(~identified, F.lit("missing_identity"))
        .when(bad, F.lit("invalid_query"))
    )
    return F.when(error.isNull(), trim_all(query)), error


def user_query(expression: str, name: Column, tenant: Column) -> tuple[Column, Column]:
    """A history query written by the user as one SQL expression over columns of the row."""
    return checked_query(F.expr(expression), is_available(name) & is_available(tenant))


def bounded_text(col: Column, limit: int | None = None) -> Column:
    text = trim_all(F.replace(F.coalesce(col, F.lit("")), F.lit("\x00"), F.lit("")))
    return text if limit is None else F.substring(text, 1, limit)


def alphanumeric_key(col: Column) -> Column:
    return F.regexp_replace(F.lower(col), "[^a-z0-9]", "")


def is_sensitive_key(col: Column) -> Column:
    key = alphanumeric_key(col)
    return key.isin(*K.SENSITIVE_KEYS) | key.rlike(K.SENSITIVE_PATTERN)


def name_tokens(col: Column) -> Column:
    """Lower-case word parts of a field name: ``userName`` and ``user_name`` alike."""
    split_camel = F.regexp_replace(col, "([a-z0-9])([A-Z])", "$1 $2")
    words = F.split(F.lower(split_camel), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def value_tokens(col: Column) -> Column:
    """Words of a value, the default tokenizer of the window operators."""
    return F.filter(F.split(col, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def joined(*cols: Column, sep: str = " ") -> Column:
    """Join the non-empty parts in order."""
    parts = F.array_compact(F.array(*(F.when(c != "", c) for c in cols)))
    return F.array_join(parts, sep)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
