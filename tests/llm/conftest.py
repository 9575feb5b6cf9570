import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import plain  # noqa: E402

from fleetlog.llm.frames import prepare  # noqa: E402

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
CLASHING = ["row", "n_lines", "n_tokens", "quality", "kept", "k1", "spans", "body", "N_CHARS", "lang"]


@pytest.fixture(scope="module")
def rows():
    return plain.corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """The rows, over a few partitions, with extra columns of names that operators use themselves."""
    prepare(spark)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return frame.selectExpr("*", *[f"'x' AS {c}" for c in CLASHING])


@pytest.fixture(scope="module")
def no_docs(spark):
    return prepare(spark).createDataFrame([], SCHEMA)
