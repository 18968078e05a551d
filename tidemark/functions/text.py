"""Column functions for keys, flags and instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of text keys: fixed values.
BLANK = "[\t-\r\x1c-\x20\x85\xa0  -     　]"
#: Date, time and zone of an instant, each in the extended or the basic form; a time may end with its hours or minutes.
INSTANT = r"^(\d{4}-\d{2}-\d{2}|\d{8})[T ](\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?|\d{2}(?:\d{2}(?:\d{2}(?:[.,]\d+)?)?)?)([Zz]|[+-]\d{2}(?::?\d{2})?)$"


def stripped(column) -> Column:
    return F.regexp_replace(column, f"^{BLANK}+|{BLANK}+$", "")


def no_key(column) -> Column:
    """True for null and empty keys."""
    c = F.col(column) if isinstance(column, str) else column
    return c.isNull() | (c.cast("string") == "")


def _extended(column) -> tuple[Column, Column, Column]:
    """The parts of ISO-8601 text in one form: date and time to the second, six digits of its fraction, offset."""
    c = F.col(column) if isinstance(column, str) else column
    part = lambda n: F.regexp_extract(c, INSTANT, n)
    digits = lambda x: F.regexp_replace(x, "[^0-9]", "")
    date, time = digits(part(1)), F.rpad(digits(F.regexp_extract(part(2), r"^[\d:]+", 0)), 6, "0")
    at = lambda x, *ends: [F.substring(x, a, b) for a, b in ends]
    second = F.concat(F.concat_ws("-", *at(date, (1, 4), (5, 2), (7, 2))), F.lit("T"), F.concat_ws(":", *at(time, (1, 2), (3, 2), (5, 2))))
    fraction = F.rpad(F.substring(F.regexp_extract(part(2), r"[.,](\d+)$", 1), 1, 6), 6, "0")
    shift = F.rpad(digits(part(3)), 4, "0")
    zone = F.when(F.lower(part(3)) == "z", "+00:00").otherwise(F.concat(F.substring(part(3), 1, 1), F.substring(shift, 1, 2), F.lit(":"), F.substring(shift, 3, 2)))
    return second, fraction, zone


def instant(column) -> Column:
    """A timestamp from ISO-8601 text that names its zone, else null; digits beyond microseconds are cut off."""
    c = F.col(column) if isinstance(column, str) else column
    second, fraction, zone = _extended(c)
    return F.when(c.rlike(INSTANT), F.concat(second, F.lit("."), fraction, zone).try_cast("timestamp"))


def isoformat(column) -> Column:
    """The extended form of ISO-8601 text with the offset it names; null where it isn't an instant."""
    second, fraction, zone = _extended(column)
    return F.when(instant(column).isNotNull(), F.concat(second, F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)), zone))


def digest(*columns: str) -> Column:
    """SHA-256 of a row's columns as a JSON object in order of their names; nulls are left out."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def flag(column) -> Column:
    """true for true/1, false for false/0, else null; case and outer blanks don't count."""
    c = F.lower(stripped(column))
    return F.when(c.isin("true", "1"), True).when(c.isin("false", "0"), False)


def count_for(total, rate: float) -> Column:
    """How many of `total` a rate selects: half-even rounding, one at least if the rate is positive."""
    total = F.col(total) if isinstance(total, str) else total
    return F.lit(0).cast("long") if rate <= 0 else F.least(total, F.greatest(F.lit(1), F.bround(total * F.lit(rate)))).cast("long")
