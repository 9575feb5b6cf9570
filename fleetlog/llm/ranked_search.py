"""Ranked lexical search in a length-stratified index.

Documents whose normaliser m (a step function of their length) is equal form a stratum.
A page holds documents of one stratum and, for each of their terms, the postings by
number of occurrences tf, most first. What a posting adds to a score depends on the
term, m and tf only, so the impact is computed once per term and tf of a page, and the
first tf gives the most that a page's documents can get for a term.

The sum of these over a query's terms bounds the scores of a page. Queries visit pages
in order of the bounds and leave off once a bound is below what is needed for the k
best. To know early what is needed, a query first visits the few pages with the highest
bounds of all; then every task visits its pages, best first. All arithmetic on scores
is in whole numbers; the result is exact.

Pages are cut from documents in order of (m, number of the row), so a stratum, even one
that holds a third of all documents, spreads over many tasks. Queries are searched in
blocks: the terms and weights of a block have about `BLOCK_TERMS` rows and travel with
the tasks. A page is bounded by `PAGE_DOCS` documents and `PAGE_POSTINGS` postings (a
single document beyond that is a page of its own).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlog.llm.frames import written
from fleetlog.llm.terms import WORDS_AND_NUMBERS

# At most 65,535, as places in a page have two bytes.
PAGE_DOCS = 4096
PAGE_POSTINGS = 1 << 17
# Rows (query, term) of a block of queries.
BLOCK_TERMS = 200_000
# Pages that a query visits first.
SEED_PAGES = 4
# Terms whose document counts a task holds before it hands them on.
HELD_TERMS = 1 << 17
# Pages, or documents that become pages, in a batch: a few MB.
BATCH_PAGES = 4
# Fixed values of the score.
BASE, SPREAD, SHARE, TF_FACTOR, M_FACTOR, WEIGHT = 50, 50, 1_000_000_000, 1000, 20, 1000

_DOCS = "row long, doc_id long, n long, terms binary, tfs binary"
_PAGE = (
    "page long, m long, docs int, ids binary, named binary, terms binary, dfs binary, top binary, "
    "runs binary, run_tf binary, run_docs binary, postings binary"
)
_NAMES = [x.split()[0] for x in _PAGE.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 9]


# Workers give memory back once a page is done, in place of keeping it for the next.
_LEAN = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": "131072"}


@contextmanager
def lean_workers(spark: SparkSession) -> Iterator[None]:
    """One kind of workers for all steps, with little kept; each kind of environment has workers of its own."""
    environment = spark.sparkContext.environment
    own = {k: environment.get(k) for k in _LEAN}
    environment.update(_LEAN)
    try:
        yield
    finally:
        for k, value in own.items():
            if value is None:
                environment.pop(k, None)
            else:
                environment[k] = value


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of `BATCH_PAGES` rows: a page is much larger than a text."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_PAGES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def count_terms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document with terms: a number of its own, id, length, terms and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = WORDS_AND_NUMBERS.count(text)
                if found:
                    tfs = np.fromiter(found.values(), "<i4", len(found))
                    out.append((number, doc_id, int(tfs.sum()), b" ".join(found), tfs.tobytes()))
                    number += 1
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["row", "doc_id", "n", "terms", "tfs"])

    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(run, _DOCS)


def make_page(number: int, m: int, docs: list[dict]) -> dict:
    """A page of documents of one stratum."""
    words: dict[bytes, int] = {}
    term, tf, doc = [], [], []
    for i, row in enumerate(docs):
        own = [words.setdefault(t, len(words)) for t in row["terms"].split(b" ")]
        term.append(np.array(own, np.int64))
        tf.append(np.frombuffer(row["tfs"], "<i4"))
        doc.append(np.full(len(own), i, np.int32))
    term, tf, doc = np.concatenate(term), np.concatenate(tf).astype(np.int64), np.concatenate(doc)
    order = np.lexsort((doc, -tf, term))
    term, tf, doc = term[order], tf[order], doc[order]
    begins = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])]))
    runs = np.searchsorted(term[begins], np.arange(len(words) + 1))
    ids = [row["doc_id"] for row in docs]
    return {
        "page": number, "m": m, "docs": len(docs),
        "ids": np.array([i or 0 for i in ids], "<i8").tobytes(), "named": np.array([i is not None for i in ids], bool).tobytes(),
        "terms": b" ".join(words), "dfs": np.bincount(term, minlength=len(words)).astype("<u2").tobytes(),
        "top": tf[begins[runs[:-1]]].astype("<i4").tobytes(), "runs": runs.astype("<i4").tobytes(),
        "run_tf": tf[begins].astype("<i4").tobytes(), "run_docs": np.append(begins, len(doc)).astype("<i4").tobytes(),
        "postings": doc.astype("<u2").tobytes(),
    }


def make_pages(placed: DataFrame, page_docs: int, page_postings: int) -> DataFrame:
    """Pages of documents (m, doc_id, terms, tfs) that come in order of m."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                added = len(row["tfs"]) // 4
                if held and (row["m"] != held[0]["m"] or len(held) == page_docs or size + added > page_postings):
                    done.append(make_page(number, held[0]["m"], held))
                    number, held, size = number + 1, [], 0
                held.append(row)
                size += added
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema(list(zip(_NAMES, _KINDS))))
        if held:
            yield pa.RecordBatch.from_pylist([make_page(number, held[0]["m"], held)], schema=pa.schema(list(zip(_NAMES, _KINDS))))

    return placed.mapInArrow(run, _PAGE)


def _document_counts(pages: DataFrame) -> DataFrame:
    """term (bytes), df over all pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def table() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["term", "df"])
            held.clear()
            return out

        for batch in batches:
            for terms, dfs in zip(batch.column("terms").to_pylist(), batch.column("dfs").to_pylist()):
                for term, df in zip(terms.split(b" "), np.frombuffer(dfs, "<u2").tolist()):
                    held[term] = held.get(term, 0) + df
                if len(held) > HELD_TERMS:
                    yield table()
        yield table()

    return pages.select("terms", "dfs").mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))


@dataclass
class Index:
    """pages, document counts of all terms, number of documents with terms, number of all terms."""

    pages: DataFrame
    counts: DataFrame
    documents: int
    length: int


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", page_docs: int = PAGE_DOCS, page_postings: int = PAGE_POSTINGS) -> Index:
    """Index of all rows of docs.

    Every row with at least one term is a document, repeated rows each. Null texts have
    no terms. Other columns are not looked at.
    """
    if not 0 < page_docs < 1 << 16:
        raise ValueError("page_docs must be between 1 and 65535")
    spark = docs.sparkSession
    with lean_workers(spark):
        return _build(docs, id_col, text_col, page_docs, page_postings)


def _build(docs: DataFrame, id_col: str, text_col: str, page_docs: int, page_postings: int) -> Index:
    spark = docs.sparkSession
    counted = written(count_terms(docs, id_col, text_col), "search-documents")
    documents, length = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    whole = "decimal(38,0)"
    m = F.expr(f"{2 * BASE - SPREAD} + CAST((CAST({SPREAD} * CAST({documents} AS {whole}) AS {whole}) * n) DIV {max(length, 1)} AS LONG)")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = counted.select(m.alias("m"), "row", "doc_id", "terms", "tfs")
    placed = placed.repartitionByRange(parts, "m", "row").sortWithinPartitions("m", "row")
    with short_batches(spark):
        pages = written(make_pages(placed.drop("row"), page_docs, page_postings), "search-pages")
        counts = written(_document_counts(pages), "search-counts")
    return Index(pages, counts, documents, length)


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item, term: the terms of all rows of an item, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(WORDS_AND_NUMBERS.count(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(found, pa.list_(pa.binary()))], names=["item", "terms"])

    texts = queries.select(queries[id_col].cast("long").alias("item"), queries[text_col].cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(run, "item long, terms array<binary>").select("item", F.explode("terms").alias("term")).distinct()


class Block:
    """Queries of a block: their terms, weights, and the score that each needs."""

    def __init__(self, items: list[int | None], terms: list[bytes], weights: list[int], need: dict[int, int] | None = None):
        names = {x: i for i, x in enumerate(dict.fromkeys(items))}
        self.items = list(names)
        self.term_no = {t: i for i, t in enumerate(dict.fromkeys(terms))}
        self.weight = np.zeros(len(self.term_no), np.int64)
        item, term = np.array([names[x] for x in items], np.int64), np.array([self.term_no[t] for t in terms], np.int64)
        self.weight[term] = weights
        order = np.argsort(term, kind="stable")
        self.users = item[order]  # by term
        self.user_at = np.searchsorted(term[order], np.arange(len(self.term_no) + 1))
        self.terms_of = np.split(term[np.argsort(item, kind="stable")], np.cumsum(np.bincount(item, minlength=len(names)))[:-1])
        self.need = np.ones(len(names), np.int64)
        for i, score in (need or {}).items():
            self.need[i] = max(score, 1)

    def present(self, terms: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Wanted terms of a page: numbers here and places there."""
        found = [(self.term_no[t], at) for at, t in enumerate(terms.split(b" ")) if t in self.term_no]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]

    def bounds(self, m: int, terms: bytes, top: bytes) -> np.ndarray:
        """The most that a document of the page can score, for each query."""
        number, place = self.present(terms)
        most = self.weight[number] * impact(np.frombuffer(top, "<i4")[place].astype(np.int64), m)
        out = np.zeros(len(self.items), np.int64)
        sizes = self.user_at[number + 1] - self.user_at[number]
        at = np.repeat(self.user_at[number] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        np.add.at(out, self.users[at], np.repeat(most, sizes))
        return out


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    return (SHARE * tf) // (TF_FACTOR * tf + M_FACTOR * m)


class Page:
    """A page that is being visited: the impacts of the wanted terms, once per tf."""

    def __init__(self, row: dict, block: Block):
        self.row, self.size = row, row["docs"]
        number, place = block.present(row["terms"])
        runs, self.run_docs = np.frombuffer(row["runs"], "<i4"), np.frombuffer(row["run_docs"], "<i4")
        tf, self.postings = np.frombuffer(row["run_tf"], "<i4").astype(np.int64), np.frombuffer(row["postings"], "<u2")
        self.parts = {}
        for no, at in zip(number.tolist(), place.tolist()):
            first, last = runs[at], runs[at + 1]
            adds = block.weight[no] * impact(tf[first:last], row["m"])
            docs = self.run_docs[first : last + 1]
            self.parts[no] = (self.postings[docs[0] : docs[-1]], np.repeat(adds, np.diff(docs)))

    def scores(self, terms: np.ndarray) -> np.ndarray:
        out = np.zeros(self.size, np.int64)
        for no in terms.tolist():
            if no in self.parts:
                docs, adds = self.parts[no]
                out[docs] += adds
        return out

    def ids(self, docs: np.ndarray) -> list[int | None]:
        ids, named = np.frombuffer(self.row["ids"], "<i8")[docs], np.frombuffer(self.row["named"], bool)[docs]
        return [i if known else None for i, known in zip(ids.tolist(), named.tolist())]


class Best:
    """The k best documents of each query so far, as (-score, id is null, id)."""

    def __init__(self, block: Block, k: int):
        self.block, self.k = block, k
        self.need = block.need.copy()
        self.found: list[list[tuple[int, bool, int]]] = [[] for _ in block.items]

    def visit(self, item: int, page: Page) -> None:
        scores = page.scores(self.block.terms_of[item])
        docs = np.flatnonzero(scores >= self.need[item])
        if not len(docs):
            return
        if len(docs) > self.k:  # of equal scores all stay until ids are compared
            docs = docs[scores[docs] >= np.partition(scores[docs], -self.k)[-self.k]]
        both = self.found[item] + [(-s, i is None, i or 0) for s, i in zip(scores[docs].tolist(), page.ids(docs))]
        self.found[item] = sorted(both)[: self.k]
        if len(self.found[item]) == self.k:
            self.need[item] = max(self.need[item], -self.found[item][-1][0])

    def table(self) -> pa.RecordBatch:
        rows = [(i, None if null else doc, -s) for i, best in enumerate(self.found) for s, null, doc in best]
        columns = list(zip(*rows)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int32(), pa.int64(), pa.int64()])], names=["item", "doc_id", "score"])


_FOUND = "item int, doc_id long, score long"


def _search_block(pages: DataFrame, block: Block, k: int) -> DataFrame:
    """item (its place in the block), doc_id, score: the k best of each task, and so all of the k best."""
    context = pages.sparkSession.sparkContext
    shared = context.broadcast(block)

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, best = shared.value, None
        for batch in batches:
            for row in batch.to_pylist():
                bound = own.bounds(row["m"], row["terms"], row["top"])
                more = np.stack([bound, np.full_like(bound, row["page"])], axis=1)[:, None]
                best = more if best is None else np.concatenate([best, more], axis=1)
                if best.shape[1] > SEED_PAGES:
                    keep = np.argsort(-best[:, :, 0], axis=1, kind="stable")[:, :SEED_PAGES]
                    best = np.take_along_axis(best, keep[:, :, None], axis=1)
        if best is not None:
            item, at = np.nonzero(best[:, :, 0])
            columns = [pa.array(item.astype(np.int32)), pa.array(best[item, at, 1]), pa.array(best[item, at, 0])]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "page", "bound"])

    def first_visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                page, best = Page(row, shared.value), Best(shared.value, k)
                for item in row["items"]:
                    best.visit(item, page)
                yield best.table()

    order = W.partitionBy("item").orderBy(F.desc("bound"), "page")
    seeds = pages.select("page", "m", "terms", "top").mapInArrow(highest, "item int, page long, bound long")
    seeds = seeds.withColumn("no", F.row_number().over(order)).filter(F.col("no") <= SEED_PAGES)
    seeds = written(seeds.groupBy(F.col("page").alias("seed")).agg(F.collect_list("item").alias("items")), "search-seeds")
    scored = pages.join(seeds, F.col("page") == F.col("seed")).drop("seed").mapInArrow(first_visits, _FOUND)
    kth = W.partitionBy("item").orderBy(F.desc("score"))
    need = scored.withColumn("no", F.row_number().over(kth)).filter(F.col("no") == k).select("item", "score").collect()
    block.need[[r["item"] for r in need]] = [r["score"] for r in need]
    ready = context.broadcast(block)

    def all_visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ready.value
        best = Best(own, k)
        for batch in batches:
            rows = batch.to_pylist()
            if not rows:
                continue
            bound = np.stack([own.bounds(r["m"], r["terms"], r["top"]) for r in rows])
            open_ = {}
            for item in np.flatnonzero((bound >= best.need).any(axis=0)).tolist():
                for at in np.argsort(-bound[:, item], kind="stable").tolist():
                    if bound[at, item] < best.need[item]:
                        break
                    if at not in open_:
                        open_[at] = Page(rows[at], own)
                    best.visit(item, open_[at])
        yield best.table()

    return pages.mapInArrow(all_visits, _FOUND)


def search(index: Index, queries: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest scores above 0 for each item.

    Ranks are unique; equal scores go to the smaller document id, null ids last. Rows
    with one item id (null is one, too) are one item with the terms of all of them. An
    item without a term that occurs has no rows; nor has an empty table. Other columns
    are not looked at.
    """
    spark = queries.sparkSession
    with lean_workers(spark):
        return _search(spark, index, queries, k, id_col, text_col, block_terms)


def _search(spark: SparkSession, index: Index, queries: DataFrame, k: int, id_col: str, text_col: str, block_terms: int) -> DataFrame:
    asked = query_terms(queries, id_col, text_col).join(index.counts, "term")
    weight = F.floor(WEIGHT * F.log(F.lit(2.0 * index.documents + 2) / (2 * F.col("df") + 1))).cast("long")
    asked = written(asked.select("item", "term", weight.alias("weight")), "search-queries")
    blocks = -(-asked.count() // block_terms)
    found = None
    with short_batches(spark):
        for no in range(blocks):
            own = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == no).orderBy("item", "term").toArrow()
            block = Block(*[own.column(c).to_pylist() for c in ("item", "term", "weight")])
            names = spark.createDataFrame(list(enumerate(block.items)), "item int, item_id long")
            part = _search_block(index.pages, block, k)
            order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            part = part.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            part = written(part.join(names, "item").select("item_id", "rank", "doc_id", "score"), "search-found")
            found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return found


ORACLE = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), counts AS (SELECT r, doc_id, term, count(*) AS tf FROM texts GROUP BY ALL),
lengths AS (SELECT r, sum(tf)::BIGINT AS n FROM counts GROUP BY r),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM lengths),
norms AS (SELECT r, 50 + (50 * n * docs) // len AS m FROM lengths, total),
asked AS (
  SELECT DISTINCT item_id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), weights AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM counts, total WHERE term IN (SELECT term FROM asked) GROUP BY term, docs
), scores AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN norms USING (r) GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""
