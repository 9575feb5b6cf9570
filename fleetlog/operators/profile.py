"""Profiles, value counts and differences between tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Of a comparison by digests: some 10 MB of bucket numbers.
MAX_BUCKETS = 1 << 20


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    """Rows per value, nulls included, most frequent first."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *cols)


def missing_profile(df: DataFrame, cols: Sequence[str] | None = None, empty_above: float = 0.99) -> DataFrame:
    """Missing values and their share per column, and whether the column is all but empty."""
    cols = list(cols or df.columns)
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(c).alias("n_missing"),
            F.try_divide(F.col(c), F.col("_n")).alias("share"),
        )
        for c in cols
    ]
    return counts.select(F.inline(F.array(*entries))).withColumn(
        "is_empty", F.coalesce(F.col("share") > empty_above, F.lit(False))
    )


def duplicate_keys(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def mismatch(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Rows in which two derivations differ, null-safely."""
    return df.filter(~a.eqNullSafe(b))


def differing_buckets(left: DataFrame, right: DataFrame, key: str, cols: Sequence[str], buckets: int) -> DataFrame:
    """_bucket: the buckets of keys whose rows are not the same on both sides, whatever their order.

    A bucket's digest is its number of rows and, of two 64-bit hashes of each row, the
    exclusive or and the sums of the halves. At most `buckets` rows; only one row per
    task and bucket is shuffled.
    """
    sums = []
    for df, side in ((left, "l"), (right, "r")):
        cells = [x for c in (key, *cols) for x in (F.col(c), F.col(c).isNull())]
        rows = df.select(
            bucket_of(key, buckets).alias("_bucket"), *[F.xxhash64(F.lit(seed), *cells).alias(f"_h{seed}") for seed in (0, 1)]
        )
        halves = lambda h: (F.col(h).bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32))
        parts = [F.count(F.lit(1))]
        parts += [x for h in ("_h0", "_h1") for x in (F.bit_xor(h), *[F.sum(half.cast("decimal(10,0)")) for half in halves(h)])]
        digest = rows.groupBy("_bucket").agg(*[x.alias(f"_p{i}") for i, x in enumerate(parts)])
        sums.append(digest.select(F.col("_bucket").alias(f"_{side}"), F.struct(*[f"_p{i}" for i in range(len(parts))]).alias(f"_{side}d")))
    both = sums[0].join(sums[1], F.col("_l") == F.col("_r"), "full_outer")
    return both.filter(~F.col("_ld").eqNullSafe(F.col("_rd"))).select(F.coalesce("_l", "_r").alias("_bucket"))


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def snapshot_diff(
    left: DataFrame, right: DataFrame, key: str, cols: Sequence[str] | None = None, buckets: int = 0
) -> DataFrame:
    """Unequal cells of rows present on both sides: (key, column_name, left, right).

    With buckets (at most MAX_BUCKETS), digests of key buckets are compared first and
    only rows of buckets that differ are shuffled for the join. Worth it for stored
    tables of which few rows changed; each side is read twice. Two different buckets
    would have to agree in two 64-bit hashes to be missed.
    """
    cols = list(cols or [c for c in left.columns if c in right.columns and c != key])
    if buckets:
        if not 0 < buckets <= MAX_BUCKETS:
            raise ValueError(f"buckets must be between 1 and {MAX_BUCKETS}")
        changed = F.broadcast(differing_buckets(left, right, key, cols, buckets))  # at most MAX_BUCKETS longs
        left, right = (
            x.select(key, *cols).withColumn("_bucket", bucket_of(key, buckets)).join(changed, "_bucket", "left_semi").drop("_bucket")
            for x in (left, right)
        )
    other = right.select(key, F.struct(*cols).alias("_r"))
    cells = [
        F.when(
            ~F.col(c).eqNullSafe(F.col(f"_r.{c}")),
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(c).cast("string").alias("left_value"),
                F.col(f"_r.{c}").cast("string").alias("right_value"),
            ),
        )
        for c in cols
    ]
    both = left.select(key, *cols).join(other, key)
    return both.select(key, F.explode(F.array_compact(F.array(*cells))).alias("_c")).select(key, "_c.*")


def keys_only_left(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def columns_only_left(left: DataFrame, right: DataFrame) -> list[str]:
    return sorted(set(left.columns) - set(right.columns))


def frequent_groups(df: DataFrame, group: str, more_than: int) -> DataFrame:
    """Groups with more rows than a limit, largest first."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") > more_than).orderBy(F.desc("n"), group)


def group_means(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """Means per group, rounded half-even to whole numbers, in order of the first one."""
    means = df.groupBy(group).agg(*[F.rint(F.avg(c)).cast("long").alias(f"{c}_mean") for c in cols])
    return means.orderBy(F.desc(f"{cols[0]}_mean"), group)
