"""Poll index and registry of keys as live state of a stream.

The state lies in the stream's own state store (RocksDB: on local disk with changes
saved to the checkpoint, so it may be larger than memory and survives lost executors).
A restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> SparkSession:
    """State of the streams started from now on is kept in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def live_index(stream: DataFrame, col: str) -> DataFrame:
    """Every value of a column when it is first seen (append mode)."""
    return stream.select(col).dropDuplicates([col])


def live_first_wins(stream: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """key, value, order: the first value per key so far, for keys that a batch has changed (update mode).

    First is smallest in `order`, whatever the order in which files arrive.
    """
    first = stream.groupBy(key).agg(F.min_by(F.struct(value, *order), F.struct(*order)).alias("_first"))
    return first.select(key, "_first.*")


def latest_update(updates: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The registry that a folder of updates stands for: per key the update with the smallest order."""
    others = [c for c in updates.columns if c != key]
    best = updates.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_best"))
    return best.select(key, "_best.*")
