"""From overlapping offers to machines.

One machine is listed as several offers of growing size. Offers are first counted
per (machine, size), map-side combined, so a machine with very many offers is small
before anything is ordered within it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlog.operators.sequence import HOT_ROWS, HotKeys, with_neighbours


def size_counts(
    offers: DataFrame, key: str = "machine_id", size: str = "num_gpus", rented: str | None = None
) -> DataFrame:
    """Offers, and rented offers, per machine and size."""
    taken = F.lit(0) if rented is None else F.coalesce(F.col(rented).cast("long"), F.lit(0))
    return offers.groupBy(key, size).agg(
        F.count(F.lit(1)).alias("n_offers"), F.sum(taken).cast("long").alias("n_rented")
    )


def _with_min_chunk(counts: DataFrame, key: str, size: str) -> DataFrame:
    whole = (
        Window.partitionBy(key).orderBy(size)
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    smallest = F.first(size).over(whole)
    lone_remainder = (F.first("n_offers").over(whole) == 1) & (F.sum("n_offers").over(whole) >= 3)
    return counts.select(
        "*",
        F.when(lone_remainder, F.nth_value(size, 2).over(whole)).otherwise(smallest)
        .alias("min_chunk"),
    )


def machine_chunks(
    offers: DataFrame, key: str = "machine_id", size: str = "num_gpus", rented: str | None = None
) -> DataFrame:
    """Per machine: smallest rentable chunk, units rented, units listed, whole size.

    The chunk is the smallest offer. If that size occurs once among three or more
    offers it is what was left over by the division and the next size is taken.
    """
    counts = _with_min_chunk(size_counts(offers, key, size, rented), key, size)
    undivided = F.col(size) <= F.col("min_chunk")
    return counts.groupBy(key).agg(
        F.max("min_chunk").alias("min_chunk"),
        F.sum(F.when(undivided, F.col(size) * F.col("n_rented")).otherwise(0))
        .cast("long").alias("num_gpus_rented"),
        F.sum(F.when(undivided, F.col(size) * F.col("n_offers")).otherwise(0))
        .cast("long").alias("listed"),
        F.max(size).alias("whole"),
    )


def min_chunk_offers(
    offers: DataFrame, key: str = "machine_id", size: str = "num_gpus"
) -> DataFrame:
    """Offers that are not unions of smaller ones."""
    chunks = machine_chunks(offers, key, size).select(F.col(key).alias("_key"), F.col("min_chunk").alias("_chunk"))
    return (
        offers.join(chunks, offers[key] == chunks["_key"])
        .filter(F.col(size) <= F.col("_chunk"))
        .drop("_key", "_chunk")
    )


def complete_machines(
    offers: DataFrame, key: str = "machine_id", size: str = "num_gpus", rented: str | None = None
) -> DataFrame:
    """Machines whose undivided offers add up to the whole machine."""
    return machine_chunks(offers, key, size, rented).filter("listed = whole")


def group_argmax(
    df: DataFrame, key: Sequence[str], order: Sequence[str], cols: Sequence[str]
) -> DataFrame:
    """Row with the greatest order columns per key."""
    top = df.groupBy(*key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_row"))
    return top.select(*key, *[F.col("_row")[c].alias(c) for c in cols])


def split_offers(
    offers: DataFrame,
    key: str = "machine_id",
    size: str = "num_gpus",
    rented: str = "rented",
    offer_id: str = "id",
) -> tuple[DataFrame, DataFrame]:
    """(machines, offers) of the complete machines.

    A machine is its largest offer without the offer's own columns, plus the chunk
    size and the rented units unless the listing already has them.
    """
    chunks = complete_machines(offers, key, size, rented)
    added = [c for c in ("min_chunk", "num_gpus_rented") if c not in offers.columns]
    values = [c for c in offers.columns if c not in (key, offer_id, rented)]
    order = [size, offer_id] if offer_id in offers.columns else [size]
    whole = group_argmax(offers, [key], order, values)
    machines = whole.join(chunks.select(key, *added), key)
    kept = chunks.select(F.col(key).alias("_key"), F.col("min_chunk").alias("_chunk"))
    undivided = (
        offers.join(kept, offers[key] == kept["_key"])
        .filter(F.col(size) <= F.col("_chunk"))
        .drop("_key", "_chunk")
    )
    return machines, undivided


def group_reduce(df: DataFrame, key: str, aggregates: dict[str, Column]) -> DataFrame:
    """Reduce columns per key by any aggregate expressions."""
    return df.groupBy(key).agg(*[expr.alias(name) for name, expr in aggregates.items()])


def is_sorted_by_key(
    df: DataFrame, key: str, value: str, order: Sequence[str], hot_rows: int = HOT_ROWS,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Per key: does value never fall along order?"""
    seq = with_neighbours(
        df.select(*dict.fromkeys([key, value, *order])), [key], order, prev=[value], hot_rows=hot_rows, hot=hot
    )
    rises = F.coalesce(F.col(value) >= F.col(f"_prev.{value}"), F.lit(True))
    return seq.groupBy(key).agg(F.bool_and(rises).alias("is_sorted"))
