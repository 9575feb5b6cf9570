"""The registered queries of the corpus operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlog.llm import cross_polytope, divergence, id_shards, lang_id, line_dedup, mtree, packing, part_enum, piece_bpe, quality, ranked_search, suffix_dedup, token_fst
from fleetlog.llm.frames import load
from fleetlog.session import new_run_dir

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.tiktoken"
# Appended to every document, as the contracts of the queries ask.
END_ID = 2
SEQUENCE = 4096


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without multi-line chunks that an earlier place already has."""
    cleaned = line_dedup.dedup_lines(load(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "text", "n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines")


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every twentieth vector with all others."""
    vectors = load(spark, sf_dir, "embeddings")
    return mtree.top_k(vectors, vectors.filter("vec_id % 20 = 0"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_fst.count_tokens(load(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op4_id_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written to shards and read back through their index."""
    docs = load(spark, sf_dir, "documents")
    folder = new_run_dir(spark, "id-shards")
    id_shards.write_shards(docs, folder, public_tokenizers.path(WORD_BPE), END_ID)
    return id_shards.read_shards(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and verdicts of all documents."""
    found = quality.assess(load(spark, sf_dir, "documents").select("doc_id", "text"))
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept probability"
    return found.select("doc_id", *[F.col("quality")[n].alias(n) for n in names.split()])


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with 85 % of their four-word shingles in common."""
    return part_enum.similar_documents(load(spark, sf_dir, "documents"), width=4, percent=85)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without 200-byte strings that occur twice."""
    left = suffix_dedup.dedup_substrings(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 ids."""
    return packing.pack(load(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), SEQUENCE, END_ID)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and round trip of all documents."""
    coded = piece_bpe.encode_decode(
        load(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN
    )
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from two thirds of them."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = lang_id.train(docs.filter(fold != 1))
    found = lang_id.identify(docs, model)
    return found.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth vector."""
    vectors = load(spark, sf_dir, "embeddings")
    return cross_polytope.nearest(vectors, vectors.filter("vec_id % 20 = 0"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all sources of a language and the terms they stand out by."""
    return divergence.audit(load(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    index = ranked_search.build(load(spark, sf_dir, "documents"))
    return ranked_search.search(index, load(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_line_dedup, op2_top_k, op3_token_counts, op4_id_shards, op5_quality_rules, op6_ngram_jaccard, op7_suffix_dedup,
        op8_packing, op9_byte_bpe, op10_language_id, op11_neighbours, op12_source_divergence, op13_ranked_search,
    )
}

ORACLES: dict[str, str] = {"op1_line_dedup": line_dedup.ORACLE, "op2_top_k": mtree.ORACLE, "op12_source_divergence": divergence.ORACLE, "op13_ranked_search": ranked_search.ORACLE}
