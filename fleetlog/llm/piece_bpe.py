"""Byte-level BPE through a sentencepiece model made from the vocabulary alone.

Every byte is written as one printable character, a vocabulary entry as the piece of
its bytes' characters with minus its rank as score. sentencepiece then merges, again
and again, the adjacent pair whose joint piece has the highest score, leftmost first:
the lowest rank, as byte-level BPE asks. The model file is written here field by
field: identity normalisation, no dummy prefix, white space untouched. Pieces map back
to ranks, ids back to bytes.

A text is cut before each run of white space; the pre-token pattern never matches
across such a cut. Parts repeat, so each task keeps a bounded table of them.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetlog.llm.frames import steps, texts_of

CACHE_PARTS = 400_000
# The characters with the Unicode property White_Space; fixed values.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PARTS = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is one, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: bytes | int) -> bytes:
    """A protobuf field: bytes with their length, or an integer."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model with an unknown piece and one piece per vocabulary entry, by rank."""
    chars = byte_characters()
    normal, unknown = 1, 2

    def piece(text: str, score: float, kind: int) -> bytes:
        return _field(1, _field(1, text.encode()) + b"\x15" + struct.pack("<f", score) + _field(3, kind))

    parts = [piece("<unk>", 0.0, unknown)]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts.append(piece("".join(chars[b] for b in token), -float(rank), normal))
    trainer = _field(3, 2) + _field(4, len(parts)) + _field(40, 0) + _field(41, 2**64 - 1) + _field(42, 2**64 - 1) + _field(43, 2**64 - 1)
    identity = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(parts) + _field(2, trainer) + _field(3, identity)


class PieceBpe:
    """Encoder and decoder of one rank file and pre-token pattern."""

    def __init__(self, path: str, pattern: str, cache_parts: int = CACHE_PARTS):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        self.ranks, self.limit = ranks, cache_parts
        self.pattern = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.table = str.maketrans(dict(enumerate(byte_characters())))
        by_rank = sorted((rank, token) for token, rank in ranks.items())
        self.rank = np.array([0] + [rank for rank, _ in by_rank], "<u4")  # piece number to rank
        self.bytes = dict(by_rank)
        self.known: dict[str, bytes] = {}

    def _pretoken(self, text: str) -> list[int]:
        data = text.encode()
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        pieces = self.model.encode(data.decode("latin-1").translate(self.table))
        return self.rank[pieces].tolist()

    def _part(self, part: str) -> bytes:
        return np.array([i for x in self.pattern.findall(part) for i in self._pretoken(x)], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers."""
        known, parts = self.known, _PARTS.findall(text)
        if len(known) > self.limit:
            known.clear()
        for part in set(parts).difference(known):
            known[part] = self._part(part)
        return b"".join(map(known.__getitem__, parts))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def codec(path: str, pattern: str) -> PieceBpe:
    return PieceBpe(path, pattern)


def encode_decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and round trip of every text: doc_id, n_tokens, ids, decoded, ids_sha256, decoded_sha256.

    A null text counts as empty (no ids); null and repeated ids keep their rows.
    """
    schema = "doc_id long, n_tokens long, ids binary, decoded binary, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in steps(batches):
            ids = [bpe.encode(t) for t in batch.column("text").to_pylist()]
            decoded = [bpe.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array(decoded, pa.binary()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"],
            )

    return texts_of(df, id_col, text_col).mapInArrow(run, schema)
