"""Plain table reading, writing and reporting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlog.functions.numeric import epoch_to_date

MB = 1024 * 1024


def append_log(df: DataFrame, path: str, ts: str = "timestamp") -> None:
    """Append rows to a table partitioned by the date of ts."""
    df.withColumn("event_date", epoch_to_date(F.col(ts))).write.mode("append").partitionBy(
        "event_date"
    ).parquet(path)


def read_table(spark: SparkSession, path: str, cols: dict[str, str] | Sequence[str] | None = None) -> DataFrame:
    """A table, or some of its columns, optionally cast: {column: type}."""
    df = spark.read.parquet(path)
    if cols is None:
        return df
    if isinstance(cols, dict):
        return df.select(*[F.col(c).cast(t).alias(c) for c, t in cols.items()])
    return df.select(*cols)


def first_last(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """First and last time (0 for an empty table) and the seconds between."""
    ends = df.agg(
        F.coalesce(F.min(ts), F.lit(0)).alias("first_ts"), F.coalesce(F.max(ts), F.lit(0)).alias("last_ts")
    )
    return ends.withColumn("timespan", F.col("last_ts") - F.col("first_ts"))


def storage_report(spark: SparkSession, paths: str | Sequence[str], table_pattern: str) -> DataFrame:
    """Files, size in MB and share per table plus a total row, largest first.

    Looks at file lengths only. table_pattern's first group is the table's name
    within a file path.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
        .select(F.regexp_extract("path", table_pattern, 1).alias("name"), "length")
    )
    sizes = files.rollup("name").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.grouping("name").alias("is_total")
    )
    total = files.agg(F.sum("length")).scalar()
    return sizes.select(
        F.when(F.col("is_total") == 1, "total").otherwise(F.col("name")).alias("name"),
        "files",
        F.round(F.col("bytes") / MB, 2).alias("size_mb"),
        F.round(F.col("bytes") * 100.0 / total, 2).alias("percentage"),
    ).orderBy(F.desc("percentage"), "name")


def growth(report: DataFrame, span: DataFrame) -> DataFrame:
    """MB per day and per year: total size over the time span of a table."""
    days = span.select(F.col("timespan") / 86_400).scalar()
    total = report.filter("name = 'total'")
    per_day = F.try_divide(F.col("size_mb"), days)
    return total.select(
        "size_mb", F.round(per_day, 2).alias("mb_per_day"), F.round(per_day * 365, 0).alias("mb_per_year")
    )
