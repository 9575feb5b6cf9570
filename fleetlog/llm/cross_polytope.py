"""Approximate nearest neighbours by cross-polytope hashing.

The largest inner products of a query are its nearest neighbours once all rows have
one length: with M the longest vector, x / M gets one more coordinate that makes it a
unit vector, and a query, brought to length 1, gets a zero there. A pseudo-rotation
(three rounds of random signs and the fast Hadamard transform) turns the unit vectors,
and each falls to the signed axis nearest to it: the axis of its largest absolute
coordinate. `hashes` rotations in a row make one cell.

There are `tables` such tables. In each of them a query visits `probes` cells: of all
cells those whose axes are nearest to it (for several rotations: with the least sum of
what they fall short of the best axis, squared). All rows of a visited cell are scored
exactly with the vectors as they came; nothing is capped.

A vector that many rows share is indexed with its k + 1 smallest ids: no others can be
among the k nearest of anything. A cell with more rows than `CHUNK_ROWS` is cut into
chunks, a chunk that many queries visit is copied for each block of them, so neither a
hot cell nor a hot query meets in one task.

Costs: a row is shuffled once per table, a query once per visited chunk, and of each
visited chunk at most k rows a query come back. With one rotation a table has twice as
many cells as the next power of two of the dimension; for tables of many millions of
rows take two rotations and more probes (both are parameters).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlog.llm.frames import written

TABLES = 16
PROBES = 14
# Rows of a cell, and queries, that meet in one call.
CHUNK_ROWS = 16_384
BLOCK_QUERIES = 4096
# Queries scored at a time: with a whole chunk, 64 MB of scores.
STEP_QUERIES = 512
SEED = 20_011


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform along the last axis, whose length is a power of two."""
    n = x.shape[-1]
    step = 1
    while step < n:
        pairs = x.reshape(*x.shape[:-1], n // (2 * step), 2, step)
        x = np.stack([pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]], axis=-2).reshape(x.shape)
        step *= 2
    return x / np.sqrt(n)


class Hashing:
    """The cells of unit vectors in all tables."""

    def __init__(self, width: int, longest: float, tables: int = TABLES, hashes: int = 1, seed: int = SEED):
        self.width, self.longest, self.tables, self.hashes = width, longest, tables, hashes
        self.axes = 1 << width.bit_length()  # at least one more than the width
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, hashes, 3, 1, self.axes))

    def _placed(self, vecs: np.ndarray, last: np.ndarray) -> np.ndarray:
        out = np.zeros((len(vecs), self.axes))
        out[:, : self.width] = vecs
        out[:, self.width] = last
        return out

    def _turned(self, unit: np.ndarray) -> np.ndarray:
        """[table, hash, row, axis]"""
        x = unit[None, None]
        for round_ in range(3):
            x = hadamard(x * self.signs[:, :, round_])
        return x

    def cells(self, vecs: np.ndarray) -> np.ndarray:
        """[row, table]: the cell of each indexed vector."""
        x = vecs / self.longest
        turned = self._turned(self._placed(x, np.sqrt(np.maximum(1 - (x * x).sum(axis=1), 0))))
        axis = np.abs(turned).argmax(axis=-1)
        below = np.take_along_axis(turned, axis[..., None], axis=-1)[..., 0] < 0
        code = axis + self.axes * below
        cell = np.zeros(code.shape[:1] + code.shape[2:], np.int64)
        for h in range(self.hashes):
            cell = cell * (2 * self.axes) + code[:, h]
        return cell.T

    def probes(self, vecs: np.ndarray, count: int) -> np.ndarray:
        """[row, table, probe]: the cells that each query visits, best first."""
        lengths = np.sqrt((vecs * vecs).sum(axis=1, keepdims=True))
        turned = self._turned(self._placed(vecs / np.where(lengths > 0, lengths, 1), np.zeros(len(vecs))))
        near = np.concatenate([turned, -turned], axis=-1)  # how near each signed axis is
        count = min(count, (2 * self.axes) ** self.hashes)
        single = min(count, 2 * self.axes)
        order = np.argsort(-near, axis=-1, kind="stable")[..., :single]
        if self.hashes == 1:
            return order[:, 0].transpose(1, 0, 2)
        short = near.max(axis=-1, keepdims=True) - np.take_along_axis(near, order, axis=-1)
        # the best `count` sums need no choice whose ranks' product exceeds `count`
        choices = np.array([c for c in product(range(single), repeat=self.hashes) if np.prod(np.array(c) + 1) <= count])
        loss, cell = 0.0, 0
        for h in range(self.hashes):
            loss = loss + short[:, h][..., choices[:, h]] ** 2
            cell = cell * (2 * self.axes) + order[:, h][..., choices[:, h]].astype(np.int64)
        best = np.argsort(loss, axis=-1, kind="stable")[..., :count]
        return np.take_along_axis(cell, best, axis=-1).transpose(1, 0, 2)


def exact_scores(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added up in one order: equal rows score equally."""
    return np.ascontiguousarray(rows * query).sum(axis=1)


def best_rows(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, id, score) of the k best rows of each query, its own id left out."""
    out = []
    size = np.sqrt((rows * rows).sum(axis=1).max(initial=0.0))
    for start in range(0, len(queries), STEP_QUERIES):
        part = queries[start : start + STEP_QUERIES]
        rough = part @ rows.T
        for i, query in enumerate(part):
            own = int(query_ids[start + i])
            score = rough[i]
            score[ids == own] = -np.inf
            # rough scores differ from exact ones by far less than this
            slack = 1e-12 * size * np.sqrt((query * query).sum())
            floor = np.partition(score, -k)[-k] - slack if len(score) > k else -np.inf
            near = np.flatnonzero((score >= floor) & (score > -np.inf))
            exact = exact_scores(query, rows[near])
            order = np.lexsort((ids[near], -exact))[:k]
            out += [(own, int(ids[near[j]]), float(exact[j])) for j in order]
    return out


def _matrix(vectors: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors.to_pylist()), "<f8").reshape(-1, width)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, raw: rows with an id and a vector that is finite and not zero."""
    rows = df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].cast("array<double>").alias("raw"))
    odd = F.exists("raw", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter("vec_id IS NOT NULL AND raw IS NOT NULL").filter(~odd).filter(F.exists("raw", lambda x: x != 0))


def _packed(rows: DataFrame, width: int) -> DataFrame:
    """vec_id and vec, the components as bytes, filled up with zeros; each pair once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # adding zero makes negative zeros equal to the others
            vecs = [(np.pad(np.array(v, "<f8"), (0, width - len(v))) + 0.0).tobytes() for v in batch.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(vecs, pa.binary())], names=["vec_id", "vec"])

    return rows.mapInArrow(run, "vec_id long, vec binary").distinct()


def nearest(
    df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    tables: int = TABLES, probes: int = PROBES, hashes: int = 1, chunk_rows: int = CHUNK_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of df that were found for each query.

    Nearest is the largest inner product in double precision; ties go to the smaller id.
    A row with the query's own id is no candidate. Rows with a null id, a null, empty or
    zero vector, or a component that is null or not finite take no part. Vectors of
    unequal lengths are filled up with zeros. An id counts once: of several rows with
    one id the best counts, and as queries their best. An empty table gives no rows;
    other columns are not looked at.
    """
    spark = df.sparkSession
    rows, asked = usable(df, id_col, vector_col), usable(queries, id_col, vector_col)
    length = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda a, x: a + x * x))
    width = max(rows.union(asked).agg(F.max(F.size("raw"))).first()[0] or 0, 1)
    longest = rows.agg(F.max(length)).first()[0]
    if longest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    hashing = Hashing(width, longest or 1.0, tables, hashes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = hashing.cells(_matrix(batch.column("vec"), width))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("vec"), pa.array(list(cells), pa.list_(pa.int64()))], names=["vec_id", "vec", "cells"]
                )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = hashing.probes(_matrix(batch.column("vec"), width), probes)
                visits = pa.array([list(x) for x in cells], pa.list_(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vec"), visits], names=["query_id", "vec", "cells"])

    smallest = W.partitionBy("vec").orderBy("vec_id")
    indexed = _packed(rows, width).withColumn("copy", F.row_number().over(smallest)).filter(F.col("copy") <= k + 1).select("vec_id", "vec")
    index = written(indexed.mapInArrow(place, "vec_id long, vec binary, cells array<long>"), "polytope-index")
    entries = index.select("vec_id", "vec", F.posexplode("cells").alias("table", "cell"))
    cells = index.select(F.posexplode("cells").alias("table", "cell")).groupBy("table", "cell").agg(
        F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("chunks")
    )
    visits = _packed(asked, width).mapInArrow(ask, "query_id long, vec binary, cells array<array<long>>")
    visits = visits.select("query_id", "vec", F.posexplode("cells").alias("table", "visited"))
    visits = written(visits.select("query_id", "vec", "table", F.explode("visited").alias("cell")), "polytope-visits")
    blocks = visits.groupBy("table", "cell").agg(F.ceil(F.count(F.lit(1)) / block_queries).cast("int").alias("blocks"))
    plan = written(cells.join(blocks, ["table", "cell"]), "polytope-cells")

    place_in = ["table", "cell", "chunk", "block"]
    left = entries.join(plan, ["table", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), "chunks").cast("int"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*place_in, "vec_id", "vec")
    right = visits.join(plan, ["table", "cell"]).withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int"))
    right = right.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(*place_in, "query_id", "vec")

    def score(held: pa.Table, come: pa.Table) -> pa.Table:
        found = []
        if held.num_rows and come.num_rows:
            found = best_rows(
                _matrix(come.column("vec"), width), come.column("query_id").to_numpy(),
                _matrix(held.column("vec"), width), held.column("vec_id").to_numpy(), k,
            )
        query, vec, value = zip(*found) if found else ((), (), ())
        return pa.table([pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(value, pa.float64())], names=["query_id", "vec_id", "score"])

    found = left.groupBy(*place_in).cogroup(right.groupBy(*place_in)).applyInArrow(score, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
