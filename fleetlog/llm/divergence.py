"""Divergence of sources by their terms, in quadtrees over the matrix of groups and terms.

A group is a source within a language. The counts of a language's groups (rows) and
kept terms (columns) form a sparse matrix. Its columns are dealt to pages by a hash of
the term, about `PAGE_CELLS` cells each; a page is a K-squared quadtree: a square that
is cut in four again and again, in which only quadrants with something in them have
children. Two rows of a page are traversed together, all pairs of rows at once: where
both have an all-zero quadrant, its columns are only counted, and priced with what two
zero counts give; where one has something, the quadrants are cut further, down to
single cells, which are priced one by one.

Languages with more sources than `BLOCK_ROWS` have their pages cut into blocks of rows,
one task per pair of blocks, so a task holds `PAGE_CELLS` cells and `BLOCK_ROWS`^2 sums
at most. Sums of pages are added up, and the best terms of each page compete. Whole
numbers throughout.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlog.llm.frames import written
from fleetlog.llm.terms import WORDS

# Cells of a page, zeros included; a language with S sources has pages of S^2 cells at least.
PAGE_CELLS = 1 << 16
BLOCK_ROWS = 256
# Side of a leaf as a power of two.
LEAF_LEVEL = 3
LEAF = 1 << LEAF_LEVEL
# Pairs of quadrants that are worked on at a time (a pair of leaves has LEAF^3 pairs of cells).
STEP = 4096
# Counts that a task holds before it hands them on.
HELD_COUNTS = 1 << 20
# Scale of the shares, documents that a kept term is in, terms reported.
SCALE, LEAST_DOCUMENTS, TERM_RANKS = 1_000_000_000, 3, 200


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n occurrences, docs documents, over the rows (lang, source, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def table() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, docs) in held.items():
                terms = list(times)
                columns = [
                    pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()),
                    pa.array([times[t] for t in terms], pa.int64()), pa.array([docs[t] for t in terms], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("lang", "source", "text")]
            for lang, source, text in zip(*columns):
                times, docs = held.setdefault((lang, source), (Counter(), Counter()))
                found, before = WORDS.count(text), len(times)
                times.update(found)
                docs.update(found.keys())
                size += len(times) - before
                if size > HELD_COUNTS:
                    yield from table()
                    size = 0
        yield from table()

    found = docs.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total) without leaving 64 bits; total, the sum and the number of terms, is above 0."""
    rest, out = counts + 1, np.zeros_like(counts)
    for step in (1, 1000, 1000, 1000):  # digits to the base of 1000; SCALE is its third power
        rest = rest * step
        out = out * step + rest // total
        rest = rest % total
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q) of shares; their squares stay within 64 bits."""
    gap = (p - q).astype(np.int64)
    return ((gap * gap).astype(np.uint64) // q.astype(np.uint64)).astype(np.int64)


class Quadtree:
    """Which quadrants of a matrix hold anything, from leaves (LEAF x LEAF cells) to the whole; by level a map of row and column."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, n_rows: int, n_columns: int):
        self.n_rows, self.n_columns = n_rows, n_columns
        self.height = max((max(n_rows, n_columns, 1) - 1).bit_length(), LEAF_LEVEL)
        self.levels = {}
        for level in range(LEAF_LEVEL, self.height + 1):
            found = np.zeros((-(-n_rows >> level) or 1, -(-n_columns >> level) or 1), bool)
            if level == LEAF_LEVEL:
                found[rows >> level, columns >> level] = True
            else:
                below = self.levels[level - 1]
                low = np.zeros((2 * found.shape[0], 2 * found.shape[1]), bool)
                low[: below.shape[0], : below.shape[1]] = below
                found = low.reshape(found.shape[0], 2, found.shape[1], 2).any(axis=(1, 3))
            self.levels[level] = found

    def walk(self, first: np.ndarray, second: np.ndarray, zeros: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of leaves (row range, row range, column range) of which one at least holds something.

        All rows of `first` and `second` (booleans by row) are walked together, smaller
        row first. Columns that are found zero for both rows of a pair in whole quadrants
        are added to `zeros` (its upper triangle counts).
        """
        side = {
            level: [np.logical_or.reduceat(x, np.arange(0, self.n_rows, 1 << level)) for x in (first, second)]
            for level in range(LEAF_LEVEL, self.height + 1)
        }
        top = np.zeros(1, np.int64)
        stack = [(self.height, top, top, top)]
        bits = np.arange(8)
        while stack:
            level, a, b, column = stack.pop()
            if len(a) > STEP:
                stack += [(level, a[at : at + STEP], b[at : at + STEP], column[at : at + STEP]) for at in range(0, len(a), STEP)]
                continue
            found = self.levels[level]
            full = found[a, column] | found[b, column]
            if not full.all():
                empty = ~full
                width = np.minimum((column[empty] + 1) << level, self.n_columns) - (column[empty] << level)
                part = np.zeros((found.shape[0], found.shape[0]), np.int64)
                np.add.at(part, (a[empty], b[empty]), width)
                zeros += np.repeat(np.repeat(part, 1 << level, axis=0), 1 << level, axis=1)[: self.n_rows, : self.n_rows]
                a, b, column = a[full], b[full], column[full]
            if not len(a):
                continue
            if level == LEAF_LEVEL:
                yield a, b, column
                continue
            a, b = (2 * a[:, None] + (bits & 1)).ravel(), (2 * b[:, None] + (bits >> 1 & 1)).ravel()
            column = (2 * column[:, None] + (bits >> 2)).ravel()
            low = self.levels[level - 1]
            inside = (a <= b) & (b < low.shape[0]) & (column < low.shape[1])
            a, b, column = a[inside], b[inside], column[inside]
            wanted = side[level - 1][0][a] & side[level - 1][1][b]
            stack.append((level - 1, a[wanted], b[wanted], column[wanted]))


def pair_sums(
    rows: np.ndarray, columns: np.ndarray, counts: np.ndarray, totals: np.ndarray, n_columns: int, first: np.ndarray, second: np.ndarray
) -> np.ndarray:
    """[a, b]: the distances of row a from row b over all columns, for a in `first` and b in `second` and the other way round.

    totals: by row, its count of all kept terms of the language plus the number of them.
    Rows of `first` that are not in `second` come before those.
    """
    n = len(totals)
    sums = np.zeros((n, n), np.int64)
    if not n_columns:
        return sums
    none = shares(np.zeros(n, np.int64), totals)
    tall, wide = -(-n // LEAF), -(-n_columns // LEAF)
    # shares of all cells; beyond the matrix they are equal, so that they add nothing
    dense = np.ones((tall * LEAF, wide * LEAF), np.int64)
    dense[:n, :n_columns] = none[:, None]
    dense[rows, columns] = shares(counts, totals[rows])
    leaves = dense.reshape(tall, LEAF, wide, LEAF)
    blocks = np.zeros((tall, tall, 2, LEAF, LEAF), np.int64)
    zeros = np.zeros((n, n), np.int64)
    for a, b, column in Quadtree(rows, columns, n, n_columns).walk(first, second, zeros):
        order = np.argsort(a * tall + b, kind="stable")
        a, b, column = a[order], b[order], column[order]
        p, q = leaves[a, :, column][:, :, None, :], leaves[b, :, column][:, None, :, :]
        starts = np.flatnonzero(np.concatenate([[True], np.diff(a * tall + b) != 0]))
        for way, value in enumerate((distance(p, q), distance(q, p))):
            blocks[a[starts], b[starts], way] += np.add.reduceat(value.sum(axis=-1), starts)
    ahead, back = (blocks[:, :, way].transpose(0, 2, 1, 3).reshape(tall * LEAF, -1)[:n, :n] for way in (0, 1))
    sums = np.triu(ahead, 1) + np.triu(back, 1).T
    zeros = np.triu(zeros, 1)
    return sums + distance(none[:, None], none[None, :]) * (zeros + zeros.T)


_FOUND = "lang string, source string, part string, item string, value long, zero long, terms long, columns long"


def _page(groups: pa.Table, cells: pa.Table) -> pa.Table:
    """Sums of all pairs of groups over a page's columns, and each group's best terms there.

    With several blocks of rows a page has only the columns in which its two blocks have
    something; `zero`, `terms` and `columns` let the others be priced afterwards.
    """
    groups = groups.sort_by("source")
    names = np.array(groups.column("source").to_pylist(), object)
    totals, block = np.maximum(groups.column("total").to_numpy(), 1), groups.column("block").to_numpy()
    (i, j, kept, lang_total) = (int(groups.column(c)[0].as_py()) for c in ("i", "j", "terms", "lang_total"))
    place = {s: at for at, s in enumerate(names)}
    words: dict[bytes, int] = {}
    rows = np.array([place[s] for s in cells.column("source").to_pylist()], np.int64)
    columns = np.array([words.setdefault(t, len(words)) for t in cells.column("term").to_pylist()], np.int64)
    counts, in_lang = cells.column("n").to_numpy(), cells.column("lang_n").to_numpy()
    first, second = block == i, block == j
    sums = pair_sums(rows, columns, counts, totals, len(words), first, second)
    none = shares(np.zeros(len(names), np.int64), totals)
    a, b = np.nonzero((np.outer(first, second) | np.outer(second, first)) & ~np.eye(len(names), dtype=bool))
    found = [(names[a], "pair", names[b], sums[a, b], distance(none[a], none[b]))]
    if i == j and len(rows):
        p, q = shares(counts, totals[rows]), shares(in_lang, np.full(len(rows), lang_total))
        more = np.flatnonzero(p > q)
        value = distance(p[more], q[more])
        order = np.lexsort((-value, rows[more]))
        more, value = more[order], value[order]
        terms = list(words)
        for at in np.split(np.arange(len(more)), np.flatnonzero(np.diff(rows[more])) + 1):
            if len(at) > TERM_RANKS:  # equal values all stay until names are compared
                at = at[value[at] >= value[at[TERM_RANKS - 1]]]
            best = sorted((-v, terms[c]) for v, c in zip(value[at].tolist(), columns[more[at]].tolist()))[:TERM_RANKS]
            if best:
                items = [t.decode("utf-8", "replace") for _, t in best]
                found.append((names[rows[more[at[:1]]].repeat(len(best))], "term", items, [-v for v, _ in best], np.zeros(len(best), np.int64)))
    lang = groups.column("lang")[0].as_py()
    out = [
        pa.table({
            "lang": pa.array([lang] * len(value), pa.string()), "source": pa.array(list(source), pa.string()),
            "part": pa.array([part] * len(value), pa.string()), "item": pa.array(list(item), pa.string()),
            "value": pa.array(value, pa.int64()), "zero": pa.array(zero, pa.int64()),
            "terms": pa.array([kept] * len(value), pa.int64()), "columns": pa.array([len(words)] * len(value), pa.int64()),
        })
        for source, part, item, value, zero in found
    ]
    return pa.concat_tables(out)


def audit(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", page_cells: int = PAGE_CELLS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from the others of its language.

    Part `pair` has each other source with the sum of distances over all kept terms, part
    `term` the terms that the source has more of than its language, up to rank 200. Null
    text, language or source are empty ones. Every row is a document, repeated rows each.
    A source without terms has pairs, and distance 0 if its language keeps no term. Ties
    go by the item's bytes. An empty table gives no rows; other columns are not looked at.
    """
    empty = F.lit("")
    rows = docs.select(
        F.coalesce(docs[lang_col].cast("string"), empty).alias("lang"), F.coalesce(docs[source_col].cast("string"), empty).alias("source"),
        docs[text_col].cast("string").cast("binary").alias("text"),
    )
    of_term = W.partitionBy("lang", "term")
    cells = count_terms(rows).withColumns({
        "in_docs": F.sum("docs").over(of_term), "lang_n": F.sum("n").over(of_term), "no": F.row_number().over(of_term.orderBy("source"))
    })
    cells = written(cells.filter(F.col("in_docs") >= LEAST_DOCUMENTS).drop("in_docs", "docs"), "divergence-cells")
    kept = cells.groupBy("lang").agg(F.count_if(F.col("no") == 1).alias("terms"), F.sum("n").alias("lang_n"))
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    in_lang = W.partitionBy("lang")
    groups = rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0)
    groups = groups.withColumns({"sources": F.count(F.lit(1)).over(in_lang), "no": F.row_number().over(in_lang.orderBy("source"))})
    size = F.greatest(F.lit(page_cells), F.col("sources") * F.col("sources"))
    groups = written(groups.select(
        "lang", "source", "terms", (F.col("n") + F.col("terms")).alias("total"), (F.col("lang_n") + F.col("terms")).alias("lang_total"),
        F.greatest(F.ceil(F.col("terms") * F.col("sources") / size), F.lit(1)).alias("pages"),
        F.floor((F.col("no") - 1) / block_rows).alias("block"), F.ceil(F.col("sources") / block_rows).alias("blocks"),
    ), "divergence-groups")

    def to_blocks(frame: DataFrame) -> DataFrame:
        """A row for each pair of blocks that it belongs to."""
        other = frame.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        return other.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")

    key = ["lang", "page", "i", "j"]
    left = to_blocks(groups).withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pages") - 1))).drop("pages")
    right = cells.drop("no").join(groups.select("lang", "source", "pages", "block", "blocks"), ["lang", "source"])
    right = to_blocks(right.withColumn("page", F.pmod(F.xxhash64("term"), "pages")).drop("pages")).drop("block")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_page, _FOUND)
    found = written(found, "divergence-pages")
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(
        (F.sum("value") + F.max("zero") * (F.max("terms") - F.sum("columns"))).alias("value")
    )
    terms = found.filter("part = 'term'").select("lang", "source", "part", "item", "value")
    order = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TERM_RANKS)
    return pairs.union(terms)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents
), g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
cells AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM kept GROUP BY lang),
sizes AS (SELECT lang, source, sum(n) AS total FROM cells GROUP BY ALL),
grid AS (
  SELECT g.lang, g.source, kept.term, coalesce(cells.n, 0) AS n,
         1 + (1000000000 * (coalesce(cells.n, 0) + 1)::HUGEINT) // (coalesce(sizes.total, 0) + langs.v) AS p,
         1 + (1000000000 * (lang_n + 1)::HUGEINT) // (langs.total + langs.v) AS q
  FROM g JOIN kept ON kept.lang = g.lang JOIN langs ON langs.lang = g.lang
  LEFT JOIN sizes ON sizes.lang = g.lang AND sizes.source = g.source
  LEFT JOIN cells ON cells.lang = g.lang AND cells.source = g.source AND cells.term = kept.term
), sums AS (
  SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
  FROM grid x JOIN grid y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sums.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM grid WHERE n > 0 AND p > q
)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM found QUALIFY part = 'pair' OR rank <= 200
"""
