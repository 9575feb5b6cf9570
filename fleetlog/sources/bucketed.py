"""Tables laid out by key, for joins that move no rows.

A table that is joined on one key again and again is written once, hashed into a fixed
number of buckets and sorted within each. Tables with the same number of buckets join
and aggregate on the key without a shuffle. Spark keeps the layout in its catalogue, so
the tables have names; their files lie below the given folder or the warehouse. A key
with very many rows makes its bucket large, and the buckets of a join are not split: lay
out by such a key only if its rows fit a task, else leave the join to a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def write_bucketed(df: DataFrame, name: str, key: Sequence[str], buckets: int, path: str | None = None) -> DataFrame:
    """Write df as a table hashed by key and return it.

    Rows are brought together by bucket first, so that a bucket is one file and not one
    per task. Buckets should hold what a task can: rows / buckets of some 100 MB.
    """
    writer = df.repartition(buckets, *key).write.mode("overwrite").bucketBy(buckets, *key).sortBy(*key)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return read_bucketed(df.sparkSession, name)


def read_bucketed(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def join_co_located(tables: Sequence[DataFrame], key: Sequence[str], how: str = "inner") -> DataFrame:
    """Join tables that are laid out alike, one after the other, on the key.

    The merge hint keeps Spark from sending a small table to all tasks, which would be as
    good at small sizes but is bounded by memory.
    """
    return reduce(lambda left, right: left.join(right.hint("merge"), list(key), how), tables)
