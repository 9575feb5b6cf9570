"""Exact search for the largest inner products in a paged M-tree.

Inner products become distances: with M the longest vector, x gets one more coordinate
that makes its length M, a query gets a zero there, and the squared distance of q and x
is |q|^2 + M^2 - 2 q.x. So the highest scores are the nearest neighbours, and the
triangle inequality holds between all of them.

The tree has a root page of routing objects (a bounded sample of rows), under each of
them pages in order of the distance to it, a run of pages being a branch. A leaf page
has a routing object of its own, its covering radius, its distance to the parent, and
for each entry the distance to the routing object. Pages are rows of a table; runs of
pages are formed by range partitioning, so equal vectors, however many, spread.

A query first searches the branch that it falls into, which gives a bound, then all
other branches that the bound does not exclude. In a branch it goes best first: always
on to the page with the smallest lower bound. A page whose bound by the stored parent
distance is too high is left out without computing its distance, and so is an entry by
its distance to the routing object. Queries are searched in blocks, each at its own
place in its own order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlog.llm.frames import written

# Routing objects of the root, taken from the rows with the smallest hashes of their ids: a bounded sample.
ROOT_ENTRIES = 64
PAGE_ROWS = 256
BRANCH_PAGES = 32
# Queries searched together.
BLOCK_QUERIES = 4096
# Scaled components from here on cannot be long integers with room to add them; they are an error.
COMPONENT_LIMIT = 1 << 62
# Slack of distance bounds, relative to the longest vector; rounding errors are smaller.
SLACK = 1e-7


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, vec (little-endian 64-bit integers), norm2; rows without a usable id or vector are left out."""
    too_large = F.raise_error(F.lit(f"a component times {scale} is beyond a long integer"))
    whole = lambda x: F.when(F.abs(x * scale) >= float(COMPONENT_LIMIT), too_large).otherwise(F.floor(x * scale))
    rows = df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].cast("array<double>").alias("raw"))
    finite = ~F.exists("raw", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter("vec_id IS NOT NULL AND raw IS NOT NULL").filter(finite).select("vec_id", F.transform("raw", whole).alias("parts"))
    return rows.withColumn("norm2", F.aggregate("parts", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _matrix(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), "<i8").reshape(len(vectors), -1) if vectors else np.zeros((0, 1), np.int64)


class Space:
    """Distances of vectors that have been given the same length."""

    def __init__(self, longest2: float):
        self.longest2 = float(longest2)
        self.exact = self.longest2 < 1 << 52
        self.slack = SLACK * (np.sqrt(self.longest2) + 1)

    def rough(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Inner products in floating point, for distances."""
        return a.astype(float) @ b.astype(float).T

    def products(self, a: np.ndarray, b: np.ndarray, unused: np.ndarray) -> np.ndarray:
        """Integer inner products but for those that are not used; in floating point where that is exact.

        Otherwise sums wrap around, which leaves every product right that is a long. One
        that is too low for a long counts as the lowest, one that is too high is an error.
        """
        rough = self.rough(a, b)
        if self.exact:
            return np.rint(rough).astype(np.int64)
        whole = a @ b.T
        beyond = np.abs(rough - whole.astype(float)) > 2.0**62  # wrapped: off by a multiple of 2^64
        if (beyond & (rough > 0) & ~unused).any():
            raise OverflowError("a score is beyond a long integer")
        return np.where(beyond, np.iinfo(np.int64).min + 1, whole)

    def norm2(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(float) ** 2).sum(axis=1)

    def extra(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.longest2 - self.norm2(x), 0))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances between rows of the index."""
        gap = (self.extra(a)[:, None] - self.extra(b)[None, :]) ** 2
        squares = self.norm2(a)[:, None] + self.norm2(b)[None, :] - 2 * self.rough(a, b)
        return np.sqrt(np.maximum(squares + gap, 0))

    def from_scores(self, norm2: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance of a query to a row with this score."""
        return np.sqrt(np.maximum(norm2 + self.longest2 - 2.0 * score, 0))


_PAGE = "branch string, page long, routing binary, radius double, parent double, low double, high double, rows int, ids binary, vecs binary, dists binary"


def build(rows: DataFrame, pivots: np.ndarray, space: Space) -> DataFrame:
    """Leaf pages of the rows (vec_id, vec), each under its nearest routing object of the root."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = space.between(_matrix(batch.column("vec").to_pylist()), pivots)
                cell = d.argmin(axis=1)
                columns = [batch.column("vec_id"), batch.column("vec"), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "vec", "cell", "dist"])

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, held = TaskContext.get().partitionId(), 0, []

        def page(rows: list[dict]) -> dict:
            nonlocal number
            vecs = _matrix([r["vec"] for r in rows])
            to_center = ((vecs - vecs.astype(float).mean(axis=0)) ** 2).sum(axis=1)
            center = vecs[[int(to_center.argmin())]]
            dists = space.between(vecs, center)[:, 0]
            order = np.argsort(dists, kind="stable")
            cell = rows[0]["cell"]
            out = {
                "branch": f"{cell}-{task}-{number // BRANCH_PAGES}", "page": task << 32 | number, "routing": center.tobytes(),
                "radius": float(dists.max()), "parent": float(space.between(center, pivots[[cell]])[0, 0]),
                "low": rows[0]["dist"], "high": rows[-1]["dist"], "rows": len(rows),
                "ids": np.array([r["vec_id"] for r in rows], "<i8")[order].tobytes(), "vecs": vecs[order].tobytes(),
                "dists": dists[order].tobytes(),
            }
            number += 1
            return out

        def table(found: list[dict]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.binary(), *[pa.float64()] * 4, pa.int32(), *[pa.binary()] * 3]
            names = [x.split()[0] for x in _PAGE.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([p[n] for p in found], k) for n, k in zip(names, kinds)], names=names)

        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if held and (len(held) == PAGE_ROWS or row["cell"] != held[-1]["cell"]):
                    found.append(page(held))
                    held = []
                held.append(row)
            yield table(found)
        if held:
            yield table([page(held)])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.select("vec_id", "vec").mapInArrow(assign, "vec_id long, vec binary, cell int, dist double")
    ordered = placed.repartitionByRange(parts, "cell", "dist", "vec_id").sortWithinPartitions("cell", "dist", "vec_id")
    return ordered.mapInArrow(pages, _PAGE)


class Search:
    """Best-first search of a block of queries in a branch."""

    def __init__(self, space: Space, ids: np.ndarray, vecs: np.ndarray, bound: np.ndarray, k: int):
        self.space, self.ids, self.vecs, self.k = space, ids, vecs, k
        self.norm2 = space.norm2(vecs)
        self.worst = bound.copy()  # score that a candidate must reach
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, id), sorted

    def reach(self, q: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Distance that a candidate may have at most."""
        d = self.space.from_scores(self.norm2[q], self.worst[q])
        return np.where(self.worst[q] == np.iinfo(np.int64).min, np.inf, d + self.space.slack)

    def _visit(self, page: dict, q: np.ndarray, to_routing: np.ndarray) -> None:
        """Score the entries of a page that the triangle inequality does not exclude."""
        near = self.reach(q)
        wanted = np.flatnonzero((np.abs(to_routing[:, None] - page["dists"][None, :]) <= near[:, None]).any(axis=0))
        if not len(wanted):
            return
        ids = page["ids"][wanted]
        own = ids[None, :] == self.ids[q][:, None]
        scores = self.space.products(self.vecs[q], page["vecs"][wanted], own)
        good = (scores >= self.worst[q][:, None]) & ~own
        for row in np.flatnonzero(good.any(axis=1)):
            i, at = int(q[row]), good[row]
            both = sorted([*self.found[i], *zip((-scores[row, at]).tolist(), ids[at].tolist())])[: self.k]
            self.found[i] = both
            if len(both) == self.k:
                self.worst[i] = max(int(self.worst[i]), -both[-1][0])

    def run(self, pages: list[dict], parents: np.ndarray) -> None:
        """pages of one branch; parents: distance of each query to their parent."""
        n = len(self.ids)
        near = self.reach()[:, None]
        stored = np.array([[p["parent"], p["radius"], p["low"], p["high"]] for p in pages]).T
        bound = np.abs(parents[:, None] - stored[0]) - stored[1]
        bound = np.maximum(bound, np.maximum(stored[2] - parents[:, None], parents[:, None] - stored[3]))
        distance = np.full((n, len(pages)), np.inf)
        for j, page in enumerate(pages):
            q = np.flatnonzero(bound[:, j] <= near[:, 0])
            if len(q):
                scores = self.space.rough(self.vecs[q], page["routing"])[:, 0]
                distance[q, j] = self.space.from_scores(self.norm2[q], scores)
        bound = np.maximum(bound, distance - stored[1])
        bound[np.isinf(distance)] = np.inf
        while True:
            next_page = bound.argmin(axis=1)
            going = np.flatnonzero(bound[np.arange(n), next_page] <= np.minimum(self.reach(), np.finfo(float).max))
            if not len(going):
                return
            for j in np.unique(next_page[going]):
                q = going[next_page[going] == j]
                self._visit(pages[j], q, distance[q, j])
            bound[going, next_page[going]] = np.inf


_FOUND = "query_id long, vec_id long, score long"


def _search(pages: DataFrame, asked: DataFrame, space: Space, k: int) -> DataFrame:
    """The k best of each branch for the queries sent to it (branch, query_id, vec, parent, worst)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        book = [
            {
                **{c: p[c] for c in ("radius", "parent", "low", "high")}, "routing": _matrix([p["routing"]]),
                "ids": np.frombuffer(p["ids"], "<i8"), "dists": np.frombuffer(p["dists"], "<f8"),
                "vecs": np.frombuffer(p["vecs"], "<i8").reshape(p["rows"], -1),
            }
            for p in left.to_pylist()
        ]
        ids = right.column("query_id").to_numpy()
        search = Search(space, ids, _matrix(right.column("vec").to_pylist()), right.column("worst").to_numpy(), k)
        if book and len(ids):
            search.run(book, right.column("parent").to_numpy())
        rows = [(int(i), vec, -score) for i, best in zip(ids, search.found) for score, vec in best]
        columns = list(zip(*rows)) or [()] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    # pages go once to each block of queries that their branch has
    blocks = asked.groupBy("branch").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("blocks"))
    dealt = asked.join(blocks, "branch").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int")).drop("blocks")
    blocks = blocks.select(F.col("branch").alias("of"), "blocks")
    copies = pages.join(blocks, F.col("branch") == F.col("of")).drop("of").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return copies.groupBy("branch", "block").cogroup(dealt.groupBy("branch", "block")).applyInArrow(run, _FOUND)


def top_k(
    df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64
) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query with the rows of df.

    Both frames have the id and the vector; components are floor(scale * x). A row with
    the query's own id is no candidate; ties go to the smaller id. Rows with a null
    id, a null vector, or a component that is null or not finite take no part. A scaled
    component of 2^62 or more, and a score that no long integer holds, is an error. Vectors of unequal lengths are filled up with zeros; empty ones score 0.
    Repeated rows are candidates each, and one query.
    """
    spark = df.sparkSession
    rows = integer_vectors(df, id_col, vector_col, scale)
    asked = integer_vectors(queries, id_col, vector_col, scale).distinct()
    low = F.lit(int(np.iinfo(np.int64).min))
    shape = rows.select("norm2", F.size("parts").alias("n")).union(asked.select("norm2", F.size("parts"))).agg(F.max("norm2"), F.max("n")).first()
    if shape[0] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    space, width = Space(shape[0]), max(1, shape[1])

    def packed(frame: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vecs = [np.pad(np.array(v, "<i8"), (0, width - len(v))).tobytes() for v in batch.column("parts").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(vecs, pa.binary())], names=["vec_id", "vec"])

        return frame.select("vec_id", "parts").mapInArrow(run, "vec_id long, vec binary")

    base = packed(rows)
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(ROOT_ENTRIES).collect()
    pivots = np.unique(_matrix([r["vec"] for r in sample]), axis=0) if sample else np.zeros((1, width), np.int64)
    pages = written(build(base, pivots, space), "mtree")
    branches = pages.groupBy("branch").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("rows").alias("rows"))
    branches = written(branches.withColumn("cell", F.split("branch", "-")[0].cast("int")), "mtree-branches")

    def to_root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vecs = _matrix(batch.column("vec").to_pylist())
                norm2 = space.norm2(vecs)
                d = space.from_scores(norm2[:, None], space.rough(vecs, pivots))
                columns = [batch.column("vec_id"), batch.column("vec"), pa.array(norm2), pa.array(d.tolist(), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec", "norm2", "parents"])

    placed = packed(asked).mapInArrow(to_root, "query_id long, vec binary, norm2 double, parents array<double>")
    # a query and a branch: at most ROOT_ENTRIES cells for each query, joined to the cells' branches
    cells = placed.select("query_id", "vec", "norm2", F.posexplode("parents").alias("cell", "parent"))
    pairs = cells.join(branches, "cell").withColumn("gap", F.greatest(F.col("low") - F.col("parent"), F.col("parent") - F.col("high"), F.lit(0.0)))
    enough = F.when(F.col("rows") > k, 0).otherwise(1)
    home = pairs.groupBy("query_id", "vec").agg(F.min_by(F.struct("branch", "parent"), F.struct(enough, "gap", "parent", "branch")).alias("home"))
    home = written(home.select("query_id", "vec", "home.branch", "home.parent", low.alias("worst")), "mtree-home")
    first = written(_search(pages, home, space, k), "mtree-first")
    worst = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score"))
    bound = home.select("query_id", F.col("branch").alias("home")).join(worst, "query_id", "left").select(
        "query_id", "home", F.when(F.col("n") >= k, F.col("score")).otherwise(low).alias("worst")
    )
    reach = F.sqrt(F.greatest(F.col("norm2") + space.longest2 - 2.0 * F.col("worst"), F.lit(0.0))) + float(space.slack)
    rest = (
        pairs.join(bound, "query_id").filter("branch != home")
        .filter((F.col("worst") == low) | (F.col("gap") <= reach)).select("branch", "query_id", "vec", "parent", "worst")
    )
    found = first.union(_search(pages, rest, space, k))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
