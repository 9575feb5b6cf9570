"""Exact removal of byte strings that occur twice, found with suffix arrays.

A byte goes if a string of `length` bytes that covers it starts anywhere else in the
corpus too, in another document or in the same one. Strings are judged on the input.

Every window of `length` bytes has an anchor: the leftmost of its `GRAM`-byte strings
with the smallest hash. Equal windows have equal anchors at equal places, so only
occurrences of one anchor need to be compared, each with its context: the bytes of the
windows that it is the anchor of. Documents are cut into anchors where they lie, and
only hashes cross the network. Of an anchor's occurrences

* those with equal contexts are all repeated, found by counting;
* an occurrence with a context of its own, beside others, is taken apart into classes
  of `CLASS` neighbouring windows. All windows of a class contain one core around the
  anchor. Classes that are equal in full are repeated; a class whose core nobody shares
  is not. Of the others the core becomes one symbol, and a suffix array over what is
  left of one copy of each decides: a window is repeated if a neighbour in suffix order
  begins with the same bytes. Small buckets share an array;
* anchors with more than `BUCKET_CONTEXTS` different contexts (the edges of a passage
  that very many documents quote) go the same way with Spark's groups in place of a
  task's: classes, then windows of the few undecided ones, are counted by 128-bit hashes.

Within a task, equal contexts are merged before they are shuffled; the occurrences
then need no partner and travel under keys of their own, so an anchor that a third of
all documents have does not gather in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlog.llm.frames import document_key, steps, written
from fleetlog.llm.hashing import Strings, mix
from fleetlog.llm.suffix_sort import suffix_array

LENGTH = 200
# Bytes of an anchor; shorter ones occur by chance more often, longer ones are more.
GRAM = 80
# Contexts of an anchor that are settled in one task, and bytes of contexts that share a suffix array.
BUCKET_CONTEXTS, ARRAY_BYTES = 400, 2_000_000
# Windows of a class.
CLASS = 11
# Bytes worked on at a time; longer documents are cut with the overlap that windows need.
PIECE = 1 << 20


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor occurrences of texts laid end to end: hash, context hash, first window, number of windows,
    bytes of the first window before the anchor."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    n = len(data)
    if n < length:
        return none
    strings = Strings(data)
    at = np.arange(n - gram + 1)
    grams = strings.hash(at, at + gram)
    # hash and place in one number: the smallest hash wins, then the leftmost place
    bits = np.uint64(int(n).bit_length())
    key = (grams >> bits << bits) | at.astype(np.uint64)
    span, wanted = 1, length - gram + 1
    low = key
    while span < wanted:  # minimum over `wanted` neighbours by doubling
        step = min(span, wanted - span)
        low = np.minimum(low[: len(low) - step], low[step:])
        span += step
    place = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    starts = np.arange(len(place))
    own_end = ends[np.searchsorted(ends, starts, side="right")]
    inside = starts + length <= own_end
    starts, place = starts[inside], place[inside]
    if not len(starts):
        return none
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(starts)]]))
    begin = starts[first]
    return grams[place[first]], strings.hash(begin, begin + count - 1 + length), begin, count, place[first] - begin


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text number, offset, bytes) of about PIECE bytes; windows are in one piece each."""
    group, room = [], PIECE
    for k, text in enumerate(texts):
        for offset in range(0, max(1, len(text) - length + 1), PIECE):
            piece = text[offset : offset + PIECE + length - 1]
            group.append((k, offset, piece))
            room -= len(piece)
            if room <= 0:
                yield group
                group, room = [], PIECE
    if group:
        yield group


_OCCURRENCE = "anchor long, context long, k1 long, k2 long, first long, windows int, lead int, weight int"


def _occurrences(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Weight 1: an occurrence; 2: stands for several with this context; 0: known to be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            for group in _pieces([t.encode() for t in batch.column("text").to_pylist()], length):
                sizes = np.array([len(p) for _, _, p in group])
                ends = np.cumsum(sizes)
                gram_hash, context, begin, count, lead = anchors(np.frombuffer(b"".join(p for _, _, p in group), np.uint8), ends, length, gram)
                if not len(begin):
                    continue
                piece = np.searchsorted(ends, begin, side="right")
                owner = np.array([k for k, _, _ in group])[piece]
                first = begin - (ends - sizes)[piece] + np.array([o for _, o, _ in group])[piece]
                order = np.lexsort((context, gram_hash))
                a, c = gram_hash[order], context[order]
                same = np.concatenate([[False], (a[1:] == a[:-1]) & (c[1:] == c[:-1])])
                several = same | np.concatenate([same[1:], [False]])
                weight = np.empty(len(order), np.int32)
                weight[order] = np.where(several, 0, 1)
                stands = order[several & ~same]
                # known ones travel under a key of their own
                key = np.where(weight == 0, mix(gram_hash + owner.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + first.astype(np.uint64)), gram_hash)
                columns = [
                    np.concatenate([key, gram_hash[stands]]).view(np.int64),
                    np.concatenate([context, context[stands]]).view(np.int64),
                    *(np.concatenate([x, x[stands]]) for x in (k1[owner], k2[owner], first, count.astype(np.int32), lead.astype(np.int32))),
                    np.concatenate([weight, np.full(len(stands), 2, np.int32)]),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[x.split()[0] for x in _OCCURRENCE.split(", ")])

    return docs.mapInArrow(run, _OCCURRENCE)


_WINDOW_ROWS = "k1 long, k2 long, first long, count int"


def classes(body: bytes, windows: int, lead: int, length: int, gram: int) -> Iterator[tuple[int, int, int, bytes, bytes, bytes]]:
    """Classes of the windows of a context: number, first window, windows, core, bytes before and after the core.

    A window with a bytes before the anchor is of class a // CLASS.
    """
    most, least = lead, lead - windows + 1
    for number in range(least // CLASS, most // CLASS + 1):
        low, high = max(least, number * CLASS), min(most, number * CLASS + CLASS - 1)
        core_from = lead - number * CLASS
        core_to = lead + length - number * CLASS - CLASS + 1
        core_to = max(core_to, core_from)
        begin, end = lead - high, lead - low + length
        yield number, begin, high - low + 1, body[core_from:core_to], body[begin:core_from], body[core_to:end]


def repeated_windows(texts: list[tuple[int, bytes, bytes]], width: int) -> list[np.ndarray]:
    """For texts (core symbol, bytes before, bytes after) the windows of `width` symbols that are there twice.

    A window starts before or at the core and contains it.
    """
    text: list[int] = []
    start, room = [], []
    for core, before, after in texts:
        start.append(len(text))
        text.extend(b + 2 for b in before)
        text.append(core + 258)
        text.extend(b + 2 for b in after)
        room.extend(range(len(before) + 1 + len(after), -1, -1))
        text.append(1)
    order = np.array(suffix_array(text), np.int64)
    order = order[np.array(room, np.int64)[order] >= width]  # equal windows stay next to each other
    near = [tuple(text[i : i + width]) for i in order.tolist()]
    same = np.array([x == y for x, y in zip(near, near[1:])], bool)
    found = np.zeros(len(text) + 1, bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    return [np.flatnonzero(found[at : at + len(before) + 1]) for at, (_, before, _) in zip(start, texts)]


def settle(bucket: list[dict], length: int, gram: int) -> Iterator[tuple[int, int, int, int]]:
    """k1, k2, first, count of the repeated windows of the lone contexts among some whole buckets."""
    spans: dict[tuple, list[tuple]] = {}
    cores: dict[tuple, list[tuple]] = {}
    for row in bucket:
        for number, begin, count, core, before, after in classes(row["body"], row["windows"], row["lead"], length, gram):
            key = row["anchor"], number, core, before, after
            if key not in spans:
                spans[key] = []
                cores.setdefault(key[:3], []).append(key)
            spans[key].append((row, begin, count))
    open_: list[tuple] = []
    for keys in cores.values():
        for key in keys:
            if len(spans[key]) > 1:
                for row, begin, count in spans[key]:
                    if row["lone"]:
                        yield row["k1"], row["k2"], row["first"] + begin, count
        if len(keys) > 1 and any(len(spans[k]) == 1 and spans[k][0][0]["lone"] for k in keys):
            open_ += keys
    if not open_:
        return
    symbols = {core: n for n, core in enumerate(dict.fromkeys(k[:3] for k in open_))}
    texts = [(symbols[k[:3]], k[3], k[4]) for k in open_]
    # a window is its core and CLASS - 1 bytes around it
    for key, places in zip(open_, repeated_windows(texts, CLASS)):
        if len(spans[key]) == 1 and spans[key][0][0]["lone"]:
            row, begin, _ = spans[key][0]
            for place in places.tolist():
                yield row["k1"], row["k2"], row["first"] + begin + place, 1


def _by_suffix_array(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Repeated windows of lone contexts; the contexts of an anchor are settled together, small buckets in one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket: list[dict] = []
        room = ARRAY_BYTES

        def solved() -> pa.RecordBatch:
            found = list(zip(*settle(bucket, length, gram))) or [()] * 4
            kinds = [pa.int64()] * 3 + [pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(found, kinds)], names=["k1", "k2", "first", "count"])

        for batch in batches:
            for row in batch.to_pylist():
                if room <= 0 and row["anchor"] != bucket[-1]["anchor"]:
                    yield solved()
                    bucket, room = [], ARRAY_BYTES
                bucket.append(row)
                room -= len(row["body"])
        if bucket:
            yield solved()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "anchor").sortWithinPartitions("anchor", "k1", "k2", "first")
    return dealt.mapInArrow(run, _WINDOW_ROWS)


def _hash128(*parts: bytes | int) -> tuple[int, int]:
    text = b"|".join(p if isinstance(p, bytes) else str(p).encode() for p in parts)
    digest = hashlib.blake2b(text, digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _by_counting(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """The same for anchors with very many contexts."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                for number, begin, count, core, before, after in classes(row["body"], row["windows"], row["lead"], length, gram):
                    h1, h2 = _hash128(row["anchor"], number, core)
                    out.append((h1, h2, before, after, row["lone"], row["k1"], row["k2"], row["first"] + begin, count))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            names = ["h1", "h2", "before", "after", "lone", "k1", "k2", "first", "count"]
            columns = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    found = rows.repartition(parts).mapInArrow(
        cut, "h1 long, h2 long, before binary, after binary, lone boolean, k1 long, k2 long, first long, count int"
    )
    owner = F.min(F.struct("lone", "k1", "k2", "first")).alias("owner")
    spans = written(found.groupBy("h1", "h2", "before", "after").agg(F.count(F.lit(1)).alias("n"), owner), "spans")
    whole = found.filter("lone").join(spans.filter("n > 1").drop("n", "owner"), ["h1", "h2", "before", "after"])
    several = spans.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("spans")).filter("spans > 1")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                before, after, own = row["before"], row["after"], row["owner"]
                lone = row["n"] == 1 and own["lone"]
                for place in range(len(before) + 1):
                    left = before[place:]
                    right = after[: CLASS - 1 - len(left)]
                    if len(left) + len(right) == CLASS - 1:
                        out.append((*_hash128(row["h1"], row["h2"], left, b"/", right), lone, own["k1"], own["k2"], own["first"] + place))
            kinds = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 3]
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["w1", "w2", "lone", "k1", "k2", "first"])

    undecided = spans.join(several, ["h1", "h2"]).drop("spans").repartition(parts)
    windows = written(undecided.mapInArrow(each, "w1 long, w2 long, lone boolean, k1 long, k2 long, first long"), "windows")
    twice = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("w1", "w2")
    single = windows.filter("lone").join(twice, ["w1", "w2"]).select("k1", "k2", "first", F.lit(1).alias("count"))
    return whole.select("k1", "k2", "first", "count").union(single)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_contexts: int = BUCKET_CONTEXTS) -> DataFrame:
    """Runs of repeated windows of the documents (k1, k2, text): k1, k2, first, count."""
    at_anchor, at_context = W.partitionBy("anchor"), W.partitionBy("anchor", "context")
    counted = _occurrences(docs, length, gram).select(
        "*", F.sum("weight").over(at_context).alias("here"), F.sum("weight").over(at_anchor).alias("total"),
        F.row_number().over(at_context.orderBy("k1", "k2", "first")).alias("number"),
    )
    # repeated as a whole, or lone among others; of a repeated context one copy stays a partner for the lone ones
    settled = (F.col("weight") == 0) | ((F.col("here") > 1) & (F.col("weight") == 1))
    mixed = (F.col("weight") > 0) & (F.col("total") > F.col("here")) & (F.col("number") == 1)
    state = counted.filter(settled | mixed).select(
        "anchor", "k1", "k2", "first", "windows", "lead", settled.alias("settled"), mixed.alias("mixed"), (F.col("here") == 1).alias("lone"),
    )
    state = written(state, "anchors")
    spans = state.filter("settled").select("k1", "k2", "first", F.col("windows").alias("count"))

    open_ = state.filter("mixed")
    bucket = open_.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts"), F.max("lone").alias("any_lone"))
    asked = open_.join(bucket, "anchor").filter("any_lone")
    by_doc = asked.groupBy("k1", "k2").agg(
        F.collect_list(F.struct("anchor", "lone", "first", "windows", "lead", (F.col("contexts") > bucket_contexts).alias("hot"))).alias("asked")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            rows: list[tuple] = []
            for k1, k2, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text", "asked"))):
                data = text.encode()
                for x in wanted:
                    body = data[x["first"] : x["first"] + x["windows"] - 1 + length]
                    rows.append((x["anchor"], x["lone"], x["hot"], k1, k2, x["first"], x["windows"], x["lead"], body))
            kinds = [pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            names = ["anchor", "lone", "hot", "k1", "k2", "first", "windows", "lead", "body"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    contexts = docs.dropDuplicates(["k1", "k2"]).join(by_doc, ["k1", "k2"]).mapInArrow(
        cut, "anchor long, lone boolean, hot boolean, k1 long, k2 long, first long, windows int, lead int, body binary"
    )
    contexts = written(contexts, "contexts")
    return spans.union(_by_suffix_array(contexts.filter("not hot"), length, gram)).union(
        _by_counting(contexts.filter("hot"), length, gram)
    )


def dedup_substrings(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
    bucket_contexts: int = BUCKET_CONTEXTS, whole_characters: bool = False,
) -> DataFrame:
    """All columns of df plus n_bytes, n_removed, n_spans, kept (the bytes left).

    With whole_characters, a character goes only if all its bytes do.

    A null text is empty. Every row is a document: of a row that is there twice all
    strings of `length` bytes are repeated. Null ids are as good as others. Columns of
    df named like the new ones are replaced.
    """
    new = ["n_bytes", "n_removed", "n_spans", "kept"]
    others = [c for c in df.columns if c.lower() not in new]
    key1, key2 = document_key(df[id_col], df[text_col])
    text = F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text")
    spans = repeated_spans(df.select(key1, key2, text), length, gram, bucket_contexts)
    of_doc = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "count")).alias("spans"))
    packed = df.select(F.struct(*[df[c] for c in others]).alias("row"), key1, key2, text)
    joined = packed.join(of_doc, ["k1", "k2"], "left").select("row", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            out: list[tuple] = []
            texts = batch.column("text").to_pylist()
            for text, found in zip(texts, batch.column("spans").to_pylist()):
                data = text.encode()
                if not found:
                    out.append((len(data), 0, 0, data))
                    continue
                marks = np.zeros(len(data) + 1, np.int64)
                first = np.array([x["first"] for x in found])
                np.add.at(marks, first, 1)
                np.add.at(marks, first + np.array([x["count"] for x in found]) - 1 + length, -1)
                gone = np.cumsum(marks[:-1]) > 0
                if whole_characters:
                    lead = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
                    gone = np.repeat(np.minimum.reduceat(gone, lead), np.diff([*lead, len(data)]))
                n_spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
                out.append((len(data), int(gone.sum()), n_spans, np.frombuffer(data, np.uint8)[~gone].tobytes()))
            kinds = [pa.int64()] * 3 + [pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *arrays], names=["row", *new])

    counts = [T.StructField(name, T.LongType()) for name in new[:3]]
    schema = T.StructType([joined.schema["row"], *counts, T.StructField("kept", T.BinaryType())])
    done = joined.mapInArrow(cut, schema)
    return done.select(*[F.col("row")[c].alias(c) for c in others], *new)
