"""Scalar functions on amounts, times, codes and text (all JVM side)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def signed_log1p(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def _clock(c: Column) -> tuple[Column, Column]:
    """Day number and the clock part split at ``:`` of ``"d HH:MM:SS"``."""
    parts = F.split(c, " ", 2)
    day = F.try_element_at(parts, F.lit(1)).try_cast("int")
    return day, F.split(F.try_element_at(parts, F.lit(2)), ":")


def parse_day_time(c: Column) -> Column:
    """``"d HH:MM:SS"`` to days; without a clock part the whole day number."""
    day, clock = _clock(c)
    hours, minutes, seconds = (F.try_element_at(clock, F.lit(i)).try_cast("int") for i in (1, 2, 3))
    fraction = (hours * 3600 + minutes * 60 + seconds) / F.lit(86400.0)
    return day + F.when(clock.isNull(), F.lit(0.0)).otherwise(fraction)


def parse_day_hour(c: Column) -> Column:
    """``STRUCT<day, hour>``; a missing clock part counts as noon."""
    day, clock = _clock(c)
    hour = F.coalesce(F.try_element_at(clock, F.lit(1)).try_cast("int"), F.lit(12))
    return F.struct(day.alias("day"), hour.alias("hour"))


def parse_bank_ts(c: Column) -> Column:
    """``21OCT17:00:00:00`` to a timestamp without time zone, null on junk."""
    return F.try_to_timestamp(c, F.lit("ddMMMyy:HH:mm:ss")).cast("timestamp_ntz")


def extract_hour(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r" (\d+):", 1), F.lit("")).try_cast("int")


def fill_category(c: Column, fill: str | int = "UNK") -> Column:
    kind = "string" if isinstance(fill, str) else "int"
    return F.coalesce(c.cast(kind), F.lit(fill))


def to_amount(c: Column) -> Column:
    """Number or 0 for anything that is not one."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def amount_direction(c: Column) -> Column:
    return F.when(c < 0, "spent").otherwise("received")


def pct_floor(part: Column, whole: Column) -> Column:
    """Whole percent, rounded down; an empty whole counts as 1."""
    return F.floor(part * 100 / F.greatest(whole, F.lit(1)))


def div_floor(a: Column, b: Column) -> Column:
    return F.floor(a / b)


def _fixed(c: Column, pattern: str) -> Column:
    # Sums of doubles depend on the order partial results arrive in; rounding
    # the last bits away first keeps a value on .5 from flipping between runs.
    return F.call_function("format_number", F.round(c.cast("double"), 6), F.lit(pattern))


def fmt0(c: Column) -> Column:
    """No decimals, half to even, no thousands separator."""
    return _fixed(c, "0")


def fmt2(c: Column) -> Column:
    return _fixed(c, "0.00")


def fmt3(c: Column) -> Column:
    return _fixed(c, "0.000")


def fmt_pct(c: Column) -> Column:
    return F.concat(fmt0(c * 100), F.lit("%"))


def fmt_signed_pct(c: Column) -> Column:
    return F.concat(F.when(c >= 0, "+").otherwise(""), fmt_pct(c))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def threshold_label(c: Column, t: float = 0.5, strict: bool = False) -> Column:
    """``>= t`` for predicted labels, ``> t`` (strict) for evidence text."""
    return ((c > t) if strict else (c >= t)).cast("int")


def case_label(c: Column, mapping: Mapping[int, str]) -> Column:
    branches = None
    for key, text in mapping.items():
        branches = F.when(c == key, text) if branches is None else branches.when(c == key, text)
    return branches
