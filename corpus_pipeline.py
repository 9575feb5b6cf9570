"""The corpus pipeline: quality rules, line dedup, near duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs, however they are
named besides doc_id and text. Stages that change a text keep every other column, but
n_chars, where there is one, follows the text. A document that loses its last word to
a stage goes.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlog.llm import line_dedup, packing, part_enum, quality, suffix_dedup
from fleetlog.llm.frames import document_key, load, prepare, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row, out of reach of the operators' own columns."""
    return docs.select(docs["doc_id"], docs["text"], F.struct(*[docs[c] for c in docs.columns]).alias("row"))


def _unpacked(found: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of docs from `row`, with another text if one is given."""

    def value(name: str) -> Column:
        if text is not None and name == "text":
            return text
        if text is not None and name == "n_chars":
            return F.char_length(text).cast(docs.schema[name].dataType)
        return F.col("row")[name]

    return found.select(*[value(c).alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    prepare(spark)
    return _unpacked(quality.assess(_packed(docs)).filter("quality.kept"), docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without chunks of lines that an earlier place has."""
    prepare(spark)
    found = line_dedup.dedup_lines(_packed(docs)).filter(r"n_removed_chunks = 0 OR text RLIKE '\\S'")
    return _unpacked(found, docs, F.col("text"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 80 %) the document with the smallest id.

    Of rows equal in id and text one stays. Rows without an id are in no group and stay.
    """
    prepare(spark)
    named = docs.filter("doc_id IS NOT NULL")
    groups = part_enum.similar_documents(named, width=5, percent=80)
    first = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("first")).distinct()
    one = _packed(named).withColumns(dict(zip(("k1", "k2"), document_key(F.col("doc_id"), F.col("text"))))).dropDuplicates(["k1", "k2"])
    kept = one.join(first.hint("merge"), F.col("doc_id") == F.col("first"), "left_semi")
    return _unpacked(kept, docs).union(docs.filter("doc_id IS NULL"))


def repeated_passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without strings of 200 bytes that occur twice, cut at whole characters."""
    prepare(spark)
    found = suffix_dedup.dedup_substrings(_packed(docs), whole_characters=True)
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept").cast("string"))
    return _unpacked(found.withColumn("left", text).filter(r"n_removed = 0 OR left RLIKE '\\S'"), docs, F.col("left"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 ids."""
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 4096, 2)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("suffix-array dedup", repeated_passages_stage),
    ("packing", packing_stage),
]

# Tokenisation has no SQL form; tests hold run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written and read again by the next."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
