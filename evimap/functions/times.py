"""Event times as microseconds since 1970, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evimap import constants as K


def epoch_micros(number: Column) -> Column:
    """Unit from magnitude: ns, us, ms, else seconds. Saturates far outside the calendar."""
    size = F.abs(number)
    factor = F.when(size >= 1e14, F.lit(1.0)).when(size >= 1e11, F.lit(1e3)).otherwise(F.lit(1e6))
    return F.when(size >= 1e17, F.floor(number / 1e3)).otherwise(F.floor(number * factor))


def iso_micros(text: Column) -> Column:
    """Microseconds of a strict ISO text, NULL for anything else.

    No zone means UTC; hour 24, second 60 and days outside the calendar are
    refused; digits beyond microseconds are cut.
    """
    rest = F.substring(text, 20, 40)
    offset = F.substring(text, -6, 6)
    day = F.unix_date(F.substring(text, 1, 10).try_cast("date"))
    hour, minute, second = (F.substring(text, at, 2).try_cast("int") for at in (12, 15, 18))
    fraction = F.rpad(F.substring(F.regexp_extract(rest, r"^\.(\d+)", 1), 1, 6), 6, "0").try_cast("int")
    zone_hour, zone_minute = F.substring(offset, 2, 2).try_cast("int"), F.substring(offset, 5, 2).try_cast("int")
    zoned = offset.rlike("^[+-]") & (F.length(rest) > 0)
    shift = (
        F.when(~zoned, F.lit(0))
        .when((zone_hour < 24) & (zone_minute < 60),
              (zone_hour * 60 + zone_minute) * F.when(F.startswith(offset, F.lit("-")), F.lit(-1)).otherwise(F.lit(1)))
    )
    seconds = day.cast("bigint") * 86400 + hour * 3600 + minute * 60 + second - shift * 60
    # what starts with no digit, or has no dash after a year, needs no pattern
    valid = F.ascii(text).between(48, 57) & (F.substring(text, 5, 1) == "-") & text.rlike(K.ISO_TIMESTAMP) & (hour < 24) & (minute < 60) & (second < 60)
    return F.when(valid, seconds * 1000000 + fraction)


def event_number(vtype: Column, text: Column, number: Column, strict: bool = False) -> Column:
    """The number an epoch time may be read from.

    The mapper also takes numeric strings; ``strict`` is the curation rule,
    which does not.
    """
    numeric = F.when(vtype == "number", number)
    if strict:
        return numeric
    return F.coalesce(numeric, F.when((vtype == "string") & F.ascii(text).between(48, 57) & text.rlike(K.NUMERIC_TEXT), text.try_cast("double")))


def event_micros(vtype: Column, text: Column, numeric: Column) -> Column:
    """Time of a typed leaf value, from ``event_number`` or its ISO text."""
    return F.when(numeric.isNotNull(), epoch_micros(numeric)).when(vtype == "string", iso_micros(text))


def in_event_range(micros: Column) -> Column:
    return F.coalesce(micros.between(K.EARLIEST_MICROS, K.LATEST_MICROS - 1), F.lit(False))
