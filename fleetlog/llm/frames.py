"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlog.session import configure, new_run_dir

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
# Rows of an Arrow batch. Documents are of very different lengths, so batches are kept short.
BATCH_ROWS = 512
# Shuffle files of a write are removed when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Bytes of text that one step inside a task works on.
STEP_BYTES = 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that the corpus operators count on."""
    configure(spark)
    # Python workers import the package from where the driver has it, unless it is installed
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long) and the text, under fixed names; a null text is empty."""
    return df.select(
        df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text")
    )


def document_key(id_col: Column, text_col: Column) -> list[Column]:
    """Key of a document: its id and a hash of its text.

    Rows that agree in both are one document that was written twice. The id may
    be null; the hash of a null text differs from that of an empty one.
    """
    return [
        F.coalesce(id_col.cast("long"), F.lit(-(2**63))).alias("k1"),
        F.xxhash64(text_col, F.isnull(text_col), F.isnull(id_col)).alias("k2"),
    ]


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `limit` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(size)
        yield batch.slice(start)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts the lineage, survives lost executors.

    What was shuffled for it goes from the disks at once, not when the driver happens to
    collect its garbage.
    """
    path = new_run_dir(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
