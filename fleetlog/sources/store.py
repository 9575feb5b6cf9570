"""What a batch of polls adds to all tables, one write and one commit row per batch.

The rows of all tables go to ``rows/batch=N`` together, divided by table, and a small
commit row follows last. Readers look at the newest commit and ignore folders beyond it,
so a batch is visible in all tables or in none; a replayed batch replaces its own folder.
After a period has been rolled up its batches are merged into few files (``closed``) with
the state at that time beside them, so later reads of the state start from there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLE = "_table"
_COMMIT = "batch long, last_ts long, closed_upto long"
# Commits that are looked at before all of them are.
_RECENT = 64


@dataclass(frozen=True)
class Commit:
    batch: int = -1
    last_ts: int = 0
    closed_upto: int = -1


class PollStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def create(self) -> "PollStore":
        """Lay out empty folders; leaves those that exist alone."""
        nothing = self.spark.range(0).select(F.lit("").alias(TABLE), F.lit(0).alias("x"))
        for folder in ("rows/batch=-1", "closed/upto=-1", "state/upto=-1"):
            nothing.write.mode("ignore").partitionBy(TABLE).parquet(f"{self.root}/{folder}")
        self.commit(Commit(), "ignore")
        return self

    # -- commits
    def last_commit(self, before: int | None = None) -> Commit:
        """Newest commit, or the newest before a batch that is being replayed."""
        folder = f"{self.root}/commits"
        reader = self.spark.read.schema(_COMMIT).option("basePath", folder)
        newest = F.max_by(F.struct("*"), "batch").alias("c")
        row = None
        if before is not None:  # a stream knows its number: its latest commits do, however many there are
            recent = ",".join(map(str, [-1, *range(max(0, before - _RECENT), before)]))
            row = reader.parquet(f"{folder}/batch={{{recent}}}").agg(newest).first()["c"]
        if row is None or (before or 0) > _RECENT and row["batch"] < 0:
            commits = reader.parquet(folder)
            row = (commits if before is None else commits.filter(F.col("batch") < before)).agg(newest).first()["c"]
        return Commit(**row.asDict())

    def commit(self, entry: Commit, mode: str = "overwrite") -> None:
        row = self.spark.range(1, numPartitions=1).select(
            F.lit(entry.last_ts).cast("long").alias("last_ts"), F.lit(entry.closed_upto).cast("long").alias("closed_upto")
        )
        row.write.mode(mode).parquet(f"{self.root}/commits/batch={entry.batch}")

    # -- rows; every frame has a column that names the table
    def write(self, folder: str, rows: DataFrame) -> None:
        # rebalance lets adaptive execution pick the number of files of a table from its size
        rows.hint("rebalance", F.col(TABLE)).write.mode("overwrite").partitionBy(TABLE).parquet(f"{self.root}/{folder}")

    def _part(self, kind: str, number: str, schema: T.StructType, paths: str) -> DataFrame:
        typed = T.StructType([*schema.fields, T.StructField(number, T.LongType()), T.StructField(TABLE, T.StringType())])
        folder = f"{self.root}/{kind}"
        return self.spark.read.schema(typed).option("basePath", folder).parquet(f"{folder}/{paths}")

    def open_rows(self, schema: T.StructType, at: Commit) -> DataFrame:
        """Rows of all tables since the last compaction. Only those batches are looked at, however many there are."""
        # the empty folder -1 is always there; a batch without anything new has none
        batches = ",".join(map(str, [-1, *range(at.closed_upto + 1, at.batch + 1)]))
        return self._part("rows", "batch", schema, f"batch={{{batches}}}").drop("batch")

    def read(self, table: str, schema: T.StructType, at: Commit | None = None) -> DataFrame:
        """All committed rows of a table."""
        at = at or self.last_commit()
        closed = self._part("closed", "upto", schema, "").filter(F.col("upto") <= at.closed_upto).drop("upto")
        return closed.unionByName(self.open_rows(schema, at)).filter(F.col(TABLE) == table).drop(TABLE)

    def state(self, table: str, schema: T.StructType, at: Commit) -> DataFrame:
        """Rows of a state table: as the last compaction left it and what came since."""
        kept = self._part("state", "upto", schema, f"upto={at.closed_upto}").drop("upto")
        return kept.unionByName(self.open_rows(schema, at)).filter(F.col(TABLE) == table).drop(TABLE)
