"""Sum-of-squares packing of token sequences into windows of fixed length.

N(h) is the number of open windows filled up to h. A document of n ids goes where the
sum of N(h)^2 over all partly filled levels ends up smallest: into a new window, or
into one of a level h with n ids of room. Moving a window from h to h + n changes the
sum by 2 (N(h + n) - N(h)) + 2 (just the first part for a new window, just the second
for one that fills up), so one look along the level array decides. What is longer than
a window is first cut into full windows.

Documents may be cut: open windows that are left, at the end of a task or when there
are too many, are emptied end to end into full ones. The rest of a task, under one
window, is cut at powers of two, which need no padding. Each task packs the rows it
reads, so packing needs no shuffle, and its work and memory do not depend on the
number of tasks.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fleetlog.llm.frames import steps, texts_of
from fleetlog.llm.word_ids import encoder

# Open windows of a task beyond which they are emptied into full ones: their ids are then
# cut end to end, so documents are cut more often and nothing else changes. It bounds a
# task's memory to 32 MB of ids; with the documents of the test tables a task has some 130.
OPEN_WINDOWS = 2048
# Sequences are numbered within a task, below this many.
TASK_SEQUENCES = 1 << 36

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Packs (doc, start, ids) pieces; `closed` gathers rows of finished windows."""

    def __init__(self, capacity: int = 4096, first_sequence: int = 0, open_windows: int = OPEN_WINDOWS):
        self.capacity, self.sequence, self.most = capacity, first_sequence, open_windows
        self.level = np.zeros(capacity + 1, np.int64)  # N(h); 0 and capacity stay 0
        self.open: dict[int, list[list[tuple]]] = defaultdict(list)
        self.windows = 0
        self.closed: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, total, start, ids in pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            self.closed.append((doc, start, len(ids), crc, total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def choose(self, n: int) -> int:
        """Level of the window to put n ids into; 0 is a new one. Fuller windows win ties."""
        full = self.capacity
        near = self.level[: full - n + 1]
        change = 2 * (self.level[n:] - near) + 2
        change[0] = 2 * self.level[n] + 1 if n < full else 0  # a new window
        if n < full:
            change[full - n] = 1 - 2 * near[full - n]  # one that fills up
        usable = near > 0
        usable[0] = True
        change[~usable] = np.iinfo(np.int64).max
        return full - n - int(np.argmin(change[::-1]))

    def add(self, doc, ids: np.ndarray) -> None:
        full, start, total = self.capacity, 0, len(ids)
        while total - start >= full:
            self._close([(doc, total, start, ids[start : start + full])])
            start += full
        n = total - start
        if not n:
            return
        h = self.choose(n)
        window = self.open[h].pop() if h else []
        if h:
            self.level[h] -= 1
        else:
            self.windows += 1
        window.append((doc, total, start, ids[start:].copy()))
        if h + n == full:
            self._close(window)
            self.windows -= 1
        else:
            self.level[h + n] += 1
            self.open[h + n].append(window)
        if self.windows > self.most:
            self.empty(final=False)

    def empty(self, final: bool = True) -> None:
        """Refill open windows end to end; at the end the rest is cut at powers of two."""
        pieces = [p for h in sorted(self.open, reverse=True) for window in self.open[h] for p in window]
        self.open.clear()
        self.level[:] = 0
        self.windows = 0
        left = sum(len(p[3]) for p in pieces)
        room = self.capacity
        window: list[tuple] = []

        def size(rest: int) -> int:
            return self.capacity if rest >= self.capacity or not final else 1 << (rest.bit_length() - 1)

        room = size(left) if left else 0
        for doc, total, start, ids in pieces:
            while len(ids):
                part = ids[:room]
                window.append((doc, total, start, part))
                ids, start = ids[len(part) :], start + len(part)
                room -= len(part)
                left -= len(part)
                if not room:
                    self._close(window)
                    window, room = [], size(left) if left else 0
        if window:  # not final: what does not fill a window stays open
            h = self.capacity - room
            self.level[h] += 1
            self.open[h].append(window)
            self.windows = 1

    def take(self) -> list[tuple]:
        out, self.closed = self.closed, []
        return out


def pack(
    df: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null texts are empty; with an end id they still make a piece of one id. Each row
    is packed as a document of its own, whatever its id (null included). Sequence
    numbers tell the task that packed them from the others; the rows should come
    straight from files, so that a task that is run again sees the same rows.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64()] * len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        packer = Packer(capacity, TaskContext.get().partitionId() * TASK_SEQUENCES)
        end = b"" if end_id is None else np.array([end_id], encode.dtype).tobytes()

        def rows() -> pa.RecordBatch:
            columns = list(zip(*packer.take())) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in steps(batches):
            ids = batch.column("doc_id").to_pylist()
            for doc, found in zip(ids, encode.encode(batch.column("text").to_pylist())):
                packer.add(doc, np.frombuffer(found + end, encode.dtype))
            yield rows()
        packer.empty()
        yield rows()

    return texts_of(df, id_col, text_col).mapInArrow(run, SCHEMA)
