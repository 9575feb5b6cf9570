"""Mean and deviation per key and period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlog.functions.numeric import day_number, period_end


def _avg_std(cols: Sequence[str]) -> list:
    out = []
    for c in cols:
        out.append(F.round(F.avg(c)).cast("long").alias(f"{c}_avg"))
        out.append(F.round(F.stddev_pop(c), 2).alias(f"{c}_std"))
    return out


def period_avg_std(
    df: DataFrame,
    key: str,
    cols: Sequence[str],
    ts: str = "timestamp",
    period: int = 86_400,
    include_open: bool = False,
) -> DataFrame:
    """Rounded mean and population deviation per key over periods (k*P, (k+1)*P].

    Rows are stamped with the period's end. The last period has no later row that
    would close it and is left out unless asked for. Values are whole numbers.
    """
    ends = df.select(key, *cols, period_end(F.col(ts), period).alias(ts))
    if not include_open:
        # max over the rows themselves: combined map-side into one number
        last = df.agg(period_end(F.max(ts), period)).scalar()
        ends = ends.filter(F.col(ts) < last)
    return ends.groupBy(key, ts).agg(*_avg_std(cols)).select(
        key, *[f"{c}_{m}" for c in cols for m in ("avg", "std")], ts
    )


def moments(df: DataFrame, key: str, cols: Sequence[str], ts: str = "timestamp", period: int = 86_400) -> DataFrame:
    """Count, sum and sum of squares per key, period and column; whole numbers, exact.

    They can be added up: moments of parts of a period make those of the period, so a
    buffer of them holds one row per key and part in place of the raw rows.
    """
    wide, whole = "decimal(38,0)", "decimal(19,0)"
    aggs = []
    for c in cols:
        v = F.col(c).cast(whole)
        aggs += [F.count(c).alias(f"{c}_n"), F.sum(v.cast(wide)).cast(wide).alias(f"{c}_sum"), F.sum((v * v).cast(wide)).cast(wide).alias(f"{c}_sq")]
    return df.groupBy(key, period_end(F.col(ts), period).alias(ts)).agg(*aggs)


def merge_moments(parts: DataFrame, key: str, cols: Sequence[str], ts: str = "timestamp") -> DataFrame:
    """Moments of whole periods from those of parts."""
    wide = "decimal(38,0)"
    aggs = [F.sum(f"{c}_n").alias(f"{c}_n") for c in cols]
    aggs += [F.sum(f"{c}_{m}").cast(wide).alias(f"{c}_{m}") for c in cols for m in ("sum", "sq")]
    return parts.groupBy(key, ts).agg(*aggs)


def moments_avg_std(merged: DataFrame, key: str, cols: Sequence[str], ts: str = "timestamp") -> DataFrame:
    """Rounded mean and population deviation from moments."""
    out = []
    for c in cols:
        n, total, squares = F.col(f"{c}_n"), F.col(f"{c}_sum"), F.col(f"{c}_sq")
        out.append(F.round(F.try_divide(total.cast("double"), n)).cast("long").alias(f"{c}_avg"))
        # n * squares - total^2 in whole numbers: no cancellation
        spread = (n.cast("decimal(19,0)") * squares).cast("decimal(38,0)") - (total * total).cast("decimal(38,0)")
        out.append(F.round(F.try_divide(F.sqrt(spread.cast("double")), n), 2).alias(f"{c}_std"))
    return merged.select(key, *out, ts)


def daily_resample(df: DataFrame, key: str, cols: Sequence[str], ts: str = "timestamp") -> DataFrame:
    """Mean and sample deviation per key and calendar day [00:00, 24:00)."""
    aggs = []
    for c in cols:
        aggs.append(F.rint(F.avg(c)).cast("long").alias(f"{c}_avg"))
        aggs.append(F.floor(F.coalesce(F.stddev_samp(c), F.lit(0.0))).cast("long").alias(f"{c}_std"))
    return df.groupBy(key, day_number(F.col(ts)).alias("day")).agg(*aggs)
