"""Token ids of a corpus in binary shards with a minimal perfect hash index.

A shard is two files. `*.ids` holds the ids of its documents end to end, two or four
bytes each, nothing else. `*.idx` holds a header, the document keys in order, the
places at which their ids start, and a minimal perfect hash: keys are dealt into small
buckets, every bucket has a displacement under which its keys fall into free slots, a
slot names the document's number and the upper bits of its key's hash. A look-up reads
one displacement and one slot, whatever the size, and a foreign key is turned away by
the stored fingerprint.

Documents are dealt out by ranges of ids; each task encodes and writes one range while
it streams through it. Files have unique names and count only once the manifest, the
last thing written, names them: a task that ran twice leaves an unnamed file behind
and nothing else.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlog.llm.frames import steps, texts_of
from fleetlog.llm.word_ids import encoder

MAGIC = b"IDSHARD1"
# Keys per bucket of the hash, and displacements tried in one step.
BUCKET_KEYS, TRIES = 3, 256
_NULL_KEY = np.int64(-(2**63))
_HEADER = np.dtype([("magic", "S8"), ("docs", "<u8"), ("tokens", "<u8"), ("width", "<u4"), ("buckets", "<u4")])


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _key_hash(keys: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Hash of a document key: its id and, for ids met again, the number of the copy."""
    return _mix(_mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) + copies.astype(np.uint64))


def _slots(hashes: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    return (_mix(hashes + shift.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit hashes onto 0..n-1."""

    def __init__(self, n: int, shifts: np.ndarray):
        self.n, self.shifts = n, shifts

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        n = len(hashes)
        buckets = max(1, -(-n // BUCKET_KEYS))
        shifts = np.zeros(buckets, np.int64)
        if n:
            where = (hashes % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            counts = np.bincount(where, minlength=buckets)
            starts = np.concatenate([[0], np.cumsum(counts)])
            free = np.ones(n, bool)
            for b in np.argsort(-counts, kind="stable"):
                size = counts[b]
                if size < 2:
                    break
                own, base = hashes[order[starts[b] : starts[b + 1]]], 0
                while True:
                    tried = np.arange(base, base + TRIES)
                    at = _slots(own[None, :], tried[:, None], n)
                    good = free[at].all(axis=1)
                    for t in np.flatnonzero(good):
                        if len(set(at[t].tolist())) == size:
                            break
                    else:
                        base += TRIES
                        continue
                    free[at[t]] = False
                    shifts[b] = tried[t]
                    break
            # a key alone in its bucket takes any slot that is left: kept as -(slot + 1)
            shifts[counts == 1] = -(np.flatnonzero(free) + 1)
        return cls(n, shifts)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        shift = self.shifts[(hashes % np.uint64(len(self.shifts))).astype(np.int64)]
        return np.where(shift < 0, -shift - 1, _slots(hashes, np.maximum(shift, 0), max(1, self.n)))


def pack_index(keys: np.ndarray, copies: np.ndarray, starts: np.ndarray, width: int) -> bytes:
    """Bytes of an index file; starts has one entry more than keys."""
    hashes = _key_hash(keys, copies)
    table = PerfectHash.build(hashes)
    number = np.zeros(len(keys), "<u4")
    prints = np.zeros(len(keys), "<u4")
    at = table.slots(hashes)
    number[at] = np.arange(len(keys))
    prints[at] = (hashes >> np.uint64(32)).astype(np.uint32)
    head = np.array([(MAGIC, len(keys), starts[-1], width, len(table.shifts))], _HEADER)
    parts = [head, keys.astype("<i8"), copies.astype("<u4"), starts.astype("<u8"), table.shifts.astype("<i8"), number, prints]
    return b"".join(x.tobytes() for x in parts)


class ShardIndex:
    """An index file in memory."""

    def __init__(self, data: bytes):
        head = np.frombuffer(data, _HEADER, 1)[0]
        if head["magic"] != MAGIC:
            raise ValueError("not an index of token shards")
        self.docs, self.tokens, self.width = int(head["docs"]), int(head["tokens"]), int(head["width"])
        place = _HEADER.itemsize

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal place
            out = np.frombuffer(data, kind, count, place)
            place += out.nbytes
            return out

        self.keys, self.copies = take("<i8", self.docs), take("<u4", self.docs)
        self.starts = take("<u8", self.docs + 1).astype(np.int64)
        self.table = PerfectHash(self.docs, take("<i8", int(head["buckets"])))
        self.number, self.prints = take("<u4", self.docs), take("<u4", self.docs)

    def find(self, keys: np.ndarray, copies: np.ndarray | None = None) -> np.ndarray:
        """Number of each document in the shard, -1 where the fingerprint says that it is not here."""
        keys = np.asarray(keys, np.int64)
        if not self.docs:
            return np.full(len(keys), -1)
        hashes = _key_hash(keys, np.zeros(len(keys), np.uint32) if copies is None else copies)
        at = self.table.slots(hashes)
        same = self.prints[at] == (hashes >> np.uint64(32)).astype(np.uint32)
        return np.where(same, self.number[at].astype(np.int64), -1)


def _filesystem(folder: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    return system, path


MANIFEST = "first_id long, ids_file string, idx_file string, docs long, tokens long"


def write_shards(
    df: DataFrame, folder: str, tokenizer: str, end_id: int | None = None,
    id_col: str = "doc_id", text_col: str = "text", shards: int | None = None,
) -> DataFrame:
    """Encode every text, write the shards below folder and return the manifest (also written there).

    Null texts are empty, null ids come first. An id that is met again keeps all its
    documents, told apart by the number of the copy, in the order of their texts' hashes.
    """
    spark = df.sparkSession
    count = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = texts_of(df, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    dealt = docs.repartitionByRange(count, "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        system, path = _filesystem(folder)
        system.create_dir(path, recursive=True)
        name = f"shard-{uuid.uuid4().hex}"
        end = b"" if end_id is None else np.array([end_id], encode.dtype).tobytes()
        keys, lengths = [], []
        with system.open_output_stream(f"{path}/{name}.ids") as out:
            for batch in steps(batches):
                found = encode.encode(batch.column("text").to_pylist())
                out.write(b"".join(x + end for x in found))
                keys.append(batch.column("doc_id").fill_null(int(_NULL_KEY)).to_numpy(zero_copy_only=False))
                lengths.append(np.array([len(x) + len(end) for x in found], np.int64) // encode.dtype.itemsize)
        if not keys:
            system.delete_file(f"{path}/{name}.ids")
            return
        key = np.concatenate(keys)
        starts = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        number = np.arange(len(key))
        copies = number - np.maximum.accumulate(np.where(fresh, number, 0))
        with system.open_output_stream(f"{path}/{name}.idx") as out:
            out.write(pack_index(key, copies, starts, encode.dtype.itemsize))
        yield pa.RecordBatch.from_pydict(
            {"first_id": [int(key[0])], "ids_file": [f"{name}.ids"], "idx_file": [f"{name}.idx"], "docs": [len(key)], "tokens": [int(starts[-1])]}
        )

    dealt.select("doc_id", "text").mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Every document from the files: doc_id, copy, start, n_tokens, ids (as stored), ids_crc32.

    Start counts the ids of all documents before. Each document is fetched by its key
    through the index. The running sum is over one row per shard.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = F.sum("tokens").over(W.orderBy("first_id").rowsBetween(W.unboundedPreceding, -1))
    placed = manifest.withColumn("before", F.coalesce(before, F.lit(0))).repartition(
        int(spark.conf.get("spark.sql.shuffle.partitions")), "ids_file"
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_stream(f"{path}/{row['idx_file']}") as f:
                    index = ShardIndex(f.read())
                number = index.find(index.keys, index.copies)
                kind = np.dtype("<u2" if index.width == 2 else "<u4")
                with system.open_input_file(f"{path}/{row['ids_file']}") as f:
                    for some in np.array_split(number, max(1, -(-index.docs // 1000))):
                        ids = []
                        for k in some:
                            f.seek(int(index.starts[k]) * index.width)
                            ids.append(f.read(int(index.starts[k + 1] - index.starts[k]) * index.width))
                        keys = index.keys[some]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(keys, pa.int64(), mask=keys == _NULL_KEY),
                                pa.array(index.copies[some].astype(np.int64)),
                                pa.array(index.starts[some] + row["before"]),
                                pa.array(index.starts[some + 1] - index.starts[some]),
                                pa.array(ids, pa.binary()),
                                pa.array([zlib.crc32(np.frombuffer(x, kind).astype("<u4").tobytes()) for x in ids], pa.int64()),
                            ],
                            names=["doc_id", "copy", "start", "n_tokens", "ids", "ids_crc32"],
                        )

    return placed.mapInArrow(read, "doc_id long, copy long, start long, n_tokens long, ids binary, ids_crc32 long")


def lookup(spark: SparkSession, folder: str, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """First copy of the documents with the wanted ids: doc_id, n_tokens, ids. Unknown ids give no row.

    Each wanted id is sent to the one shard whose range of ids it falls into.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    ranged = manifest.withColumn("next_id", F.lead("first_id").over(W.orderBy("first_id")))
    keys = wanted.select(F.col(id_col).cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    hits = keys.join(
        ranged, (keys.doc_id >= ranged.first_id) & (ranged.next_id.isNull() | (keys.doc_id < ranged.next_id))
    ).select("doc_id", "ids_file", "idx_file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _filesystem(folder)
        open_name, index = "", None
        for batch in batches:
            for row in batch.to_pylist():
                if row["idx_file"] != open_name:
                    with system.open_input_stream(f"{path}/{row['idx_file']}") as f:
                        open_name, index = row["idx_file"], ShardIndex(f.read())
                k = int(index.find(np.array([row["doc_id"]]))[0])
                if k < 0 or index.keys[k] != row["doc_id"]:
                    continue
                with system.open_input_file(f"{path}/{row['ids_file']}") as f:
                    f.seek(int(index.starts[k]) * index.width)
                    n = int(index.starts[k + 1] - index.starts[k])
                    yield pa.RecordBatch.from_pydict({"doc_id": [row["doc_id"]], "n_tokens": [n], "ids": [f.read(n * index.width)]})

    return hits.sortWithinPartitions("idx_file").mapInArrow(read, "doc_id long, n_tokens long, ids binary")
