"""Exact quantiles by counting leading bits.

The built-in exact percentile keeps a map of all distinct values of a group in one
aggregation buffer. Here every double gets an integer key that is ordered as the values
are. A round counts the rows of a group by the next bits of their keys (at most
2 ** BITS counters per group and wanted rank, combined map-side), picks the counter that
holds each wanted rank, and the next round looks at the rows of that counter only. With
16 bits a round, four rounds lead to a single value. Counters are the only thing that is
ever ordered, so no task's work grows with the number of values of a group, whatever
their distribution. Nothing runs while the plan is built, and which side of a join is
small is left to Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlog.operators.sequence import null_safe_on

BITS = 16
# Of a double: bits of the fraction, least normal number, least number, lowest and highest power of two.
FRACTION, NORMAL, LEAST, LOWEST, HIGHEST = 52, 2.0**-1022, 2.0**-1074, -1022, 1023


def with_key(df: DataFrame, value: str, name: str = "_key") -> DataFrame:
    """A long that orders doubles: equal for equal numbers, infinities outside, NaN above all.

    The steps are projections of their own, so that each is computed once per row.
    """
    size, near, share, x = F.col("_size"), F.col("_near"), F.col("_share"), F.col(value)
    steps = df.withColumn("_size", F.abs(x))
    # the power of two at or below, one off at most; subnormal numbers and infinity go their own way
    steps = steps.withColumn("_near", F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), F.floor(F.log2(size)))))
    steps = steps.withColumn("_share", size / F.pow(F.lit(2.0), near))
    above = F.when(share < 1, 2 * share - 2).when(share >= 2, share / 2).otherwise(share - 1) * float(1 << FRACTION)
    infinite = F.lit(HIGHEST + 1024 << FRACTION)
    key = (
        F.when(size == 0, F.lit(0))
        .when(size < NORMAL, (size / LEAST).cast("long"))
        .when(size == float("inf"), infinite)
        .otherwise((near - LOWEST + 1) * F.lit(1 << FRACTION) + above.cast("long"))
    )
    signed = F.when(F.isnan(x), infinite + 1).when(x < 0, -key).otherwise(key)
    return steps.withColumn(name, signed).drop("_size", "_near", "_share")


def bit_widths(bits: int) -> list[int]:
    """Bits of the 64 that each round looks at."""
    if not 0 < bits <= BITS:
        raise ValueError(f"bits must be between 1 and {BITS}")
    return [min(bits, 64 - start) for start in range(0, 64, bits)]


def count_cells(rows: DataFrame, chosen: DataFrame | None, by: Sequence[str], seen: int, width: int) -> DataFrame:
    """Rows per group, cell of the rounds before and next bits: the counters of one round.

    rows has the group, `_v` and `_key`; chosen the cells (`_cell`) that hold wanted
    ranks (`_ranks`). `_v` of a counter is its least value.
    """
    counts = F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_v")
    if chosen is None:  # the leading bits keep their sign, so they are ordered as the keys are
        first = rows.withColumn("_cell", F.lit(0).cast("long"))
        return first.groupBy(*by, "_cell", F.shiftright("_key", 64 - width).alias("_next")).agg(*counts)
    next_bits = F.shiftright("_key", 64 - seen - width).bitwiseAND((1 << width) - 1)
    placed = rows.withColumn("_in", F.shiftright("_key", 64 - seen))
    side = chosen.select(*[F.col(c).alias(f"_by_{c}") for c in by], "_cell", "_n", "_ranks")
    on = (placed["_in"] == side["_cell"]) & null_safe_on([placed[c] for c in by], [side[f"_by_{c}"] for c in by])
    return placed.join(side, on).groupBy(*by, "_cell", "_n", "_ranks", next_bits.alias("_next")).agg(*counts)


def pick_cells(cells: DataFrame, by: Sequence[str], width: int, probs: Sequence[float] | None = None) -> DataFrame:
    """The counters that hold wanted ranks; ranks count within the counter from then on, null for those elsewhere.

    With probs, the first round, ranks come from the number of rows of the group: for
    each probability the one at or below its place and the next one.
    """
    group = Window.partitionBy(*by, "_cell")
    upto = F.sum("_c").over(group.orderBy("_next").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cells = cells.withColumn("_upto", upto)
    if probs is not None:
        cells = cells.withColumn("_n", F.sum("_c").over(group))
        low = [F.floor(F.lit(float(q)) * (F.col("_n") - 1)) for q in probs]
        cells = cells.withColumn("_ranks", F.array(*[r for x in low for r in (x, F.least(x + 1, F.col("_n") - 1))]))
    below = F.col("_upto") - F.col("_c")
    cell = F.col("_next") if probs is not None else F.shiftleft("_cell", width).bitwiseOR(F.col("_next"))
    kept = F.transform("_ranks", lambda r: F.when((r >= below) & (r < F.col("_upto")), r - below))
    picked = cells.select(*by, cell.alias("_cell"), "_v", "_n", kept.alias("_ranks"))
    return picked.filter(F.exists("_ranks", lambda r: r.isNotNull()))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), bits: int = BITS) -> DataFrame:
    """One row per group with columns q0, q1, ... : linearly interpolated quantiles.

    Null values do not count; NaN is above all numbers; null is a group. Without by, an
    empty table gives one row of nulls. bits is the number of key bits a round counts by.
    """
    by = list(by)
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    rows = with_key(rows, "_v")
    chosen, seen = None, 0
    for width in bit_widths(bits):
        cells = count_cells(rows, chosen, by, seen, width)
        chosen = pick_cells(cells, by, width, probs if chosen is None else None)
        seen += width

    found = [F.max(F.when(F.col("_ranks")[j].isNotNull(), F.col("_v"))).alias(f"_v{j}") for j in range(2 * len(probs))]
    ends = chosen.groupBy(*by).agg(F.max("_n").alias("_n"), *found)
    points = []
    for i, q in enumerate(probs):
        place, low, high = F.lit(float(q)) * (F.col("_n") - 1), F.col(f"_v{2 * i}"), F.col(f"_v{2 * i + 1}")
        share = place - F.floor(place)
        points.append(F.when((low == high) | (share == 0), low).otherwise(low + (high - low) * share).alias(f"q{i}"))
    return ends.select(*by, *points)
