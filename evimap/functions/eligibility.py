"""Structural tests of a leaf value against the five value types.

``text`` is the trimmed value text, ``vtype`` one of null, boolean, number and
string. Each test is evaluated once per leaf, whatever the number of targets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from evimap import constants as K
from evimap.functions.times import event_micros, event_number, in_event_range


def eligible_ip(text: Column, strict: bool = False) -> Column:
    del strict  # both rules agree
    # an address starts with a digit or a hexadecimal group: most text ends here, and much of it at its first character
    first = F.ascii(text)
    return (first.between(48, 58) | first.between(65, 70) | first.between(97, 102)) & text.rlike("^[0-9A-Fa-f:]{1,4}[.:]") & text.rlike(K.IP_ANY)


def eligible_url(text: Column, strict: bool = False) -> Column:
    return F.ascii(text).isin(72, 104) & text.rlike(K.WEB_URL_STRICT if strict else K.WEB_URL)


def eligible_timestamp(vtype: Column, text: Column, number: Column, strict: bool = False) -> Column:
    return in_event_range(event_micros(vtype, text, event_number(vtype, text, number, strict)))


def eligible_text(vtype: Column) -> Column:
    return vtype == "string"


def eligible_identifier(vtype: Column) -> Column:
    return vtype.isin("string", "number")


REASONS = {"ip": "invalid_ip", "url": "invalid_url", "timestamp": "invalid_event_time", "text": "requires_text", "identifier": "requires_text_or_number"}
EMPTY = 1 << len(REASONS)  # an empty value fits no type


def _tests(vtype: Column, text: Column, micros: Column, strict: bool) -> tuple[Column, ...]:
    """In the order of REASONS; ``micros`` is the leaf's event time or NULL, see ``event_micros``."""
    return eligible_ip(text, strict), eligible_url(text, strict), in_event_range(micros), eligible_text(vtype), eligible_identifier(vtype)


def reasons(vtype: Column, text: Column, micros: Column, strict: bool = False) -> Column:
    """Struct of one reason per value type, '' where the leaf is eligible."""
    tests = _tests(vtype, text, micros, strict)
    return F.struct(*(
        F.when(text == "", F.lit("empty_value")).when(test, F.lit("")).otherwise(F.lit(reason)).alias(kind)
        for test, (kind, reason) in zip(tests, REASONS.items(), strict=True)
    ))


def fits(vtype: Column, text: Column, micros: Column, strict: bool = False) -> Column:
    """:func:`reasons` as one number: a bit for each type that the leaf satisfies, or EMPTY."""
    bits = (F.when(test, F.lit(1 << i)).otherwise(F.lit(0)) for i, test in enumerate(_tests(vtype, text, micros, strict)))
    return F.when(text == "", F.lit(EMPTY)).otherwise(reduce(lambda a, b: a.bitwiseOR(b), bits))


def fits_kind(number: Column, kind: str) -> Column:
    return F.getbit(number, F.lit(list(REASONS).index(kind))) == 1


def reasons_of(number: Column) -> Column:
    """:func:`reasons` of the number given by :func:`fits`."""
    return F.struct(*(
        F.when(number == EMPTY, F.lit("empty_value")).when(fits_kind(number, kind), F.lit("")).otherwise(F.lit(reason)).alias(kind)
        for kind, reason in REASONS.items()
    ))


def reason_of(struct: Column, value_type: Column) -> Column:
    """Pick the reason that belongs to a target's value type."""
    chosen = F.lit(None).cast("string")
    for name in REASONS:
        chosen = F.when(value_type == name, struct[name]).otherwise(chosen)
    return chosen
