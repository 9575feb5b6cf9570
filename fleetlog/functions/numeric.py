"""Rounding, scaling and epoch expressions. All stay inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400


def round_half_even(x: Column) -> Column:
    return F.rint(x.cast("double"))


def round_to(x: Column, base: float) -> Column:
    """Nearest multiple of base (half to even), as double."""
    return F.rint(x.cast("double") / F.lit(float(base))) * F.lit(float(base))


def round_base(x: Column, base: int = 5) -> Column:
    """Nearest multiple of base (half to even), as long."""
    return round_to(x, base).cast("long")


def round_tens(x: Column) -> Column:
    return round_to(x, 10)


def round_tens_nonzero(x: Column) -> Column:
    """Nearest ten, but what rounds to 0 becomes 10."""
    tens = round_tens(x)
    return F.when(tens == 0, F.lit(10.0)).otherwise(tens)


def round_day(ts: Column) -> Column:
    """Epoch seconds moved to the nearest midnight (half to even day)."""
    return round_base(ts, DAY)


def to_int(x: Column) -> Column:
    """Nearest integer (half to even) as long."""
    return round_half_even(x).cast("long")


def round_piecewise(x: Column, steps: Sequence[tuple[float, float]]) -> Column:
    """Different rounding base per interval of x.

    steps holds (end, base): the first interval starts at 0, each next one at the
    previous end. Both ends belong to the interval, so a value on an inner edge
    is rounded by both bases in turn. Intervals look at x itself, rounding works
    on the running result.
    """
    out, start = x.cast("double"), 0.0
    for end, base in steps:
        out = F.when(x.between(start, end), round_to(out, base)).otherwise(out)
        start = end
    return out.cast("long")


def round_pow2(x: Column) -> Column:
    """Nearest of 2^k, 3/4 of 2^k and 3/2 of 2^k with k = round(log2 x); ties keep 2^k."""
    power = F.pow(F.lit(2.0), F.rint(F.log2(x.cast("double"))))
    low, high = power * 0.75, power * 1.5
    off = F.abs(x - power)
    return (
        F.when(off > F.abs(x - high), high)
        .when(off > F.abs(x - low), low)
        .otherwise(power)
        .cast("long")
    )


def simple_pow2(x: Column) -> Column:
    """2^round(log2 x)."""
    return F.pow(F.lit(2.0), F.rint(F.log2(x.cast("double")))).cast("long")


def epoch_seconds(ts: Column) -> Column:
    """Timestamp column to whole epoch seconds (session time zone must be UTC)."""
    return F.unix_seconds(ts.cast("timestamp"))


def epoch_to_date(ts: Column) -> Column:
    return F.to_date(F.timestamp_seconds(ts))


def day_number(ts: Column) -> Column:
    """Whole days since the epoch."""
    return F.floor(ts / F.lit(DAY)).cast("long")


def whole_days(seconds: Column) -> Column:
    """Day part of a duration in seconds."""
    return F.floor(seconds / F.lit(DAY)).cast("long")


def period_end(ts: Column, period: int) -> Column:
    """End of the period (k*P, (k+1)*P] that holds ts: open left, closed right."""
    return (F.ceil(ts / F.lit(period)) * F.lit(period)).cast("long")
