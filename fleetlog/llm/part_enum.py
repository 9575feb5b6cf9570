"""Set-similarity join of documents by PartEnum signatures.

A document is its set of distinct word shingles. Sets are put into bands of nearly
equal size, so that linked sets lie in one band or in neighbouring ones. Two linked
sets of a pair of bands differ in at most k shingles, k from the bands' sizes. The
domain of shingles is dealt into groups of three parts; with more than k / 2 groups
there is one in which the sets differ in one part at most, and leaving out that part
their contents are the same. So the signatures of a set, one for each group and each
choice of two of its three parts, have a member in common with those of every set
linked to it. (A few shingles: one group of k + 2 parts, each choice of two of them.)
There are some groups more than needed; a set with that many groups or fewer in which
a signature is empty leaves those out, as another one must do.

Equal sets are one class. Classes that share signatures form families, found as
connected components; all links lie within families. Sets that quote each other without
being similar make families that grow with the corpus, so families of more than two
sets are taken apart by a prefix filter: the shingles of a family are ordered by the
number of its sets that have them, and linked sets share one of the first of their own.
What is left is compared in one task up to `FAMILY_SHINGLES`, a larger family in blocks,
each pair of blocks in a task of its own: the same filter again, then the exact
intersection.

Within a task equal signatures are merged before they are shuffled, so a signature
that a third of all documents have costs a row per batch of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlog.llm.components import components
from fleetlog.llm.frames import steps, texts_of, written
from fleetlog.llm.hashing import mix, runs, word_hashes

# Shingles that are compared in one task; above, a family is cut into blocks of about this many.
FAMILY_SHINGLES = 300_000
# Text of the documents whose signatures are merged in memory.
MERGE_BYTES = 16 << 20


def shingles(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text as 64-bit hashes.

    Fewer words than `width` are one shingle, none are none. A-Z are lower-cased, words
    are runs of anything but ASCII white space.
    """
    found = word_hashes([t.encode().lower() for t in texts])
    return [np.unique(runs(w, min(width, len(w)))) if len(w) else w for w in found]


@cache
def _limits(percent: int) -> list[int]:
    """Largest size of each band; grown on demand."""
    return [1]


def band(size: int, percent: int) -> int:
    """Number of the band of a size. Sizes from l to l * 100 // percent are one band."""
    limits = _limits(percent)
    while limits[-1] < size:
        limits.append((limits[-1] + 1) * 100 // percent)
    return int(np.searchsorted(limits, size))


def most_differences(upper: int, percent: int) -> int:
    """Most shingles in which linked sets of the bands upper - 1 and upper, or both of upper - 1, can differ."""
    limits = _limits(percent)
    high = limits[upper]
    low = limits[upper - 1] if upper else 0
    return (low + high) * (100 - percent) // (100 + percent)


def band_signatures(sets: list[np.ndarray], upper: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets for the pair of bands that ends with `upper`, and the set that each belongs to."""
    k = most_differences(upper, percent)
    seed = np.uint64((upper + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    if k == 0:
        return mix(np.array([x.sum(dtype=np.uint64) for x in sets]) + seed), np.arange(len(sets))
    if k <= 5:
        groups, parts, spare = 1, k + 2, 0
    else:
        spare = 2 + k // 25
        groups, parts = k // 2 + 1 + spare, 3
    cells = groups * parts
    spread = mix(np.concatenate(sets) + seed)
    at = (spread % np.uint64(cells)).astype(np.int64) + np.repeat(np.arange(len(sets)) * cells, [len(x) for x in sets])
    value, total = mix(spread + np.uint64(1)), cells * len(sets)
    low = np.bincount(at, (value & np.uint64(0xFFFFFFFF)).astype(float), total).astype(np.uint64)
    high = np.bincount(at, (value >> np.uint64(32)).astype(float), total).astype(np.uint64)
    shape = len(sets), groups, parts
    sums = (low + (high << np.uint64(32))).reshape(shape)
    counts = np.bincount(at, minlength=total).reshape(shape)
    one, two = np.triu_indices(parts, 1)
    body, empty = sums[..., one] + sums[..., two], counts[..., one] + counts[..., two] == 0
    place = np.arange(body[0].size, dtype=np.uint64).reshape(body.shape[1:]) * np.uint64(0xD1342543DE82EF95)
    out = mix(mix(body + seed) + place)
    # empty signatures count only for sets that have too many of them
    kept = ~empty | (empty.any(axis=2).sum(axis=1) > spare)[:, None, None]
    owner = np.broadcast_to(np.arange(len(sets))[:, None, None], out.shape)
    return out[kept], owner[kept]


def signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of non-empty sets, as the upper and as the lower of two neighbouring bands, and their owners."""
    band(max(len(x) for x in sets) * 100 // percent + 1, percent)
    own = np.searchsorted(_limits(percent), [len(x) for x in sets])
    found, owners = [], []
    for upper in np.unique(np.concatenate([own, own + 1])):
        members = np.flatnonzero((own == upper) | (own + 1 == upper))
        sig, of = band_signatures([sets[i] for i in members], int(upper), percent)
        found.append(sig)
        owners.append(members[of])
    return np.concatenate(found), np.concatenate(owners)


def _set_ids(found: np.ndarray) -> tuple[int, int]:
    """128-bit hash of a set as two signed integers."""
    one = mix(found).sum(dtype=np.uint64) + np.uint64(len(found))
    two = mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    pair = np.array([one, two], np.uint64)
    return tuple(mix(pair).view(np.int64).tolist())


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found = shingles(batch.column("text").to_pylist(), width)
            ids = [_set_ids(x) if len(x) else (0, 0) for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([len(x) for x in found], pa.int64()),
                    pa.array([x for x, _ in ids], pa.int64()), pa.array([x for _, x in ids], pa.int64()),
                ],
                names=["doc_id", "n_shingles", "s1", "s2"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long")


def _gathered(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[dict[tuple[int, int], np.ndarray]]:
    """Distinct sets of some texts at a time, by their whole ids."""
    sets: dict[tuple[int, int], np.ndarray] = {}
    room = MERGE_BYTES
    for batch in steps(batches):
        texts = batch.column("text").to_pylist()
        sets.update((_set_ids(x), x) for x in shingles(texts, width) if len(x))
        room -= sum(map(len, texts))
        if room <= 0 and sets:
            yield sets
            sets, room = {}, MERGE_BYTES
    if sets:
        yield sets


def _signature_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """sig, s1. Sets of a batch that share a signature give one row for it and a two-member group of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in _gathered(batches, width):
            sig, owner = signatures(list(sets.values()), percent)
            # sets with one s1 are one node of the families, with the signatures of all of them
            owner = np.array([s1 for s1, _ in sets], np.int64)[owner]
            order = np.argsort(sig, kind="stable")
            sig, owner = sig[order], owner[order]
            first = np.concatenate([[True], sig[1:] != sig[:-1]])
            head = owner[np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))]
            pairs = np.unique(np.stack([owner[~first], head[~first]], axis=1), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            own = mix(mix(pairs[:, 0].view(np.uint64).copy()) + pairs[:, 1].copy().view(np.uint64)) if len(pairs) else sig[:0]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([sig[first], own, own]).view(np.int64)),
                    pa.array(np.concatenate([owner[first], pairs[:, 0], pairs[:, 1]])),
                ],
                names=["sig", "s1"],
            )

    return docs.select("text").mapInArrow(run, "sig long, s1 long")


def _neighbours(rows: DataFrame) -> DataFrame:
    """Edges (a, b) between neighbours among the rows of a signature, as they stream by in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = batch.column("sig").to_numpy()
            own = batch.column("s1").to_numpy()
            if last is not None:
                sig, own = np.concatenate([[last[0]], sig]), np.concatenate([[last[1]], own])
            last = sig[-1], own[-1]
            same = (sig[1:] == sig[:-1]) & (own[1:] != own[:-1])
            pairs = np.unique(np.stack([own[1:][same], own[:-1][same]], axis=1), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "sig").sortWithinPartitions("sig").mapInArrow(run, "a long, b long")


def _shingle_rows(near: DataFrame, width: int) -> DataFrame:
    """sig, s1, need: a row for each shingle of each set; sig stands for the shingle within the family."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            sets = shingles(batch.column("text").to_pylist(), width)
            sizes = [len(x) for x in sets]
            family = mix(batch.column("family").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(mix(np.concatenate(sets) + np.repeat(family, sizes)).view(np.int64)),
                    pa.array(np.repeat(batch.column("s1").to_numpy(), sizes)),
                    pa.array(np.repeat(batch.column("need").to_numpy(), sizes)),
                ],
                names=["sig", "s1", "need"],
            )

    return near.select("text", "family", "s1", "need").mapInArrow(run, "sig long, s1 long, need long")


def _taken_apart(near: DataFrame, width: int, percent: int) -> DataFrame:
    """s1, family: smaller families that still hold all links; sets that cannot have any are in none.

    The shingles of a family are ordered by the number of its sets that have them. A set
    has at least `need` shingles in common with one it is linked to, so all but the last
    need - 1 of its own hold one that both have. Those that no other set has lead the
    order and are of no use.
    """
    shared = (
        _shingle_rows(near, width)
        .withColumn("n_sets", F.count(F.lit(1)).over(Window.partitionBy("sig")))
        .filter("n_sets > 1")
        .withColumn("from_last", F.row_number().over(Window.partitionBy("s1").orderBy(F.desc("n_sets"), F.desc("sig"))))
    )
    edges = _neighbours(shared.filter("from_last >= need").select("sig", "s1"))
    return components(edges).select(F.col("node").alias("s1"), F.col("component").alias("family"))


def links(sets: list[np.ndarray], sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect what is linked: pairs (i, j) of sets, a spanning forest of their graph.

    sides: 0 everywhere for all pairs; else only pairs of different sides are looked at.
    """
    n = len(sets)
    out: list[tuple[int, int]] = []
    if n < 2:
        return out
    sizes = np.array([len(x) for x in sets])
    order = np.argsort(sizes, kind="stable")
    joined = np.concatenate([sets[i] for i in order])
    owner = np.repeat(np.arange(n), sizes[order])
    values, ids, counts = np.unique(joined, return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(values))
    ids = rank[ids]
    by_owner = np.lexsort((ids, owner))
    ids = ids[by_owner]
    size = sizes[order]
    side = np.asarray(sides)[order]
    start = np.concatenate([[0], np.cumsum(size)])
    prefix = size - -(-size * percent // 100) + 1
    in_prefix = np.arange(len(ids)) - np.repeat(start[:-1], size) < np.repeat(prefix, size)
    lists = np.flatnonzero(in_prefix)
    lists = lists[np.lexsort((owner[lists], ids[lists]))]
    list_owner, list_ids = owner[lists], ids[lists]
    begin = np.searchsorted(list_ids, np.arange(len(values)))
    end = np.searchsorted(list_ids, np.arange(len(values)), side="right")
    label = np.arange(n)
    whole: dict[int, frozenset] = {}

    def members(i: int) -> frozenset:
        if i not in whole:
            whole[i] = frozenset(ids[start[i] : start[i + 1]].tolist())
        return whole[i]

    mixed = bool(side.any())
    for i in range(n):
        own = ids[start[i] : start[i] + prefix[i]]
        near = np.concatenate([list_owner[b:e] for b, e in zip(begin[own], end[own])])
        # smaller ones have met this one already
        near = near[(near > i) & (size[near] * percent <= size[i] * 100) & (label[near] != label[i])]
        if mixed:
            near = near[side[near] != side[i]]
        near = np.unique(near)
        while len(near):
            j, near = int(near[0]), near[1:]
            common = len(members(i) & members(j))
            if 100 * common >= percent * (size[i] + size[j] - common):
                out.append((int(order[i]), int(order[j])))
                label[label == label[j]] = label[i]
                near = near[label[near] != label[i]]
    return out


def _verified(families: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between classes within (family, pair of blocks)."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("rep").to_pylist()
        sets = shingles(table.column("text").to_pylist(), width)
        found = links(sets, table.column("side").to_numpy(), percent)
        return pa.table({"a": pa.array([ids[i] for i, _ in found], pa.string()), "b": pa.array([ids[j] for _, j in found], pa.string())})

    return families.groupBy("family", "pair").applyInArrow(run, "a string, b string")


def similar_documents(
    df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
    family_shingles: int = FAMILY_SHINGLES,
) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; 100 * intersection >= percent * union links two documents.

    component_id is the smallest id reachable by links, itself included. Null and empty
    texts have no shingles and no links. Rows with a null id link others but are not
    a smallest id (their component_id is null if they have no other company). An id that
    comes with several texts is one document per text.
    """
    docs = texts_of(df, id_col, text_col)
    member = written(_sets(docs, width), "sets")
    full = member.filter("n_shingles > 0")
    # one class per set; hidden ids of documents without one lie below all others
    classes = full.groupBy("s1", "s2").agg(
        F.min("doc_id").alias("low_id"), F.min("n_shingles").alias("n_shingles"),
        F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("text_id"),
    )
    edges = _neighbours(_signature_rows(docs, width, percent))
    family = components(edges).select(F.col("node").alias("s1"), F.col("component").alias("family"))
    # sets with one s1 are one node: whatever one of them has in common with others counts
    alike = F.count(F.lit(1)).over(Window.partitionBy("s1"))
    need = F.when(alike > 1, F.lit(0)).otherwise(F.expr(f"(n_shingles * {percent} + 99) div 100")).cast("long")
    in_family = written(classes.join(family, "s1").withColumn("need", need), "families")
    members = in_family.groupBy("family").agg(F.count(F.lit(1)).alias("members"))

    # the text of one document of each class, by its id; its set tells it from others of that id
    texts = docs.withColumn("text_id", F.coalesce("doc_id", F.lit(-(2**63)))).select("text_id", "text")
    wanted = in_family.select("text_id").distinct().hint("merge")  # grows with the corpus: never broadcast
    found = _with_set(texts.join(wanted, "text_id"), width)
    near = written(found.join(in_family.join(members, "family").drop("text_id", "low_id"), ["s1", "s2"]), "near")
    apart = _taken_apart(near.filter("members > 2"), width, percent)
    pairs = near.filter("members <= 2").select("s1", "family").distinct()
    smaller = written(near.select("s1", "s2", "n_shingles").join(apart.union(pairs), "s1"), "families")

    weight = smaller.groupBy("family").agg(F.ceil(F.sum("n_shingles") / family_shingles).cast("int").alias("blocks"))
    placed = (
        smaller.join(weight, "family")
        .withColumn("block", F.pmod("s2", "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "s1", "s2", "family",
            F.concat_ws("-", F.least("block", "other"), F.greatest("block", "other")).alias("pair"),
            (F.col("block") > F.col("other")).cast("int").alias("side"),
        )
    )
    sides = placed.join(near.select("s1", "s2", "text"), ["s1", "s2"]).select(
        "family", "pair", "side", _class_name().alias("rep"), "text"
    )
    joined = components(_verified(sides, width, percent)).select(F.col("node").alias("rep"), "component")

    keyed = classes.withColumn("rep", _class_name())
    known = keyed.join(joined, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    smallest = known.groupBy("component").agg(F.min("low_id").alias("component_id"))
    of_class = written(known.join(smallest, "component").select("s1", "s2", "component_id"), "set-components")
    alone = member.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.join(of_class, ["s1", "s2"]).select("doc_id", "n_shingles", "component_id").union(alone)


def _class_name() -> Column:
    return F.concat(F.hex("s1"), F.lit("-"), F.hex("s2"))


def _with_set(texts: DataFrame, width: int) -> DataFrame:
    """s1, s2, text: one text for each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            ids = [_set_ids(x) for x in shingles(batch.column("text").to_pylist(), width)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in ids], pa.int64()), pa.array([x for _, x in ids], pa.int64()), batch.column("text")],
                names=["s1", "s2", "text"],
            )

    return texts.select("text").mapInArrow(run, "s1 long, s2 long, text string").dropDuplicates(["s1", "s2"])
