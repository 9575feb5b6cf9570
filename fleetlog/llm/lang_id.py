"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts (language, bucket) pairs over all labelled rows: each task adds up its
rows in a matrix, Spark sums the matrices' cells. The log-probability matrix is cut into
blocks of `BLOCK_LANGUAGES` x `BUCKETS` cells at most (32 MB), each of which may travel with
the tasks. Scoring gathers the columns of a batch's n-grams and sums them between the
texts' ends; with several blocks the rows pass from one to the next with their best so far.

Letters are lower-cased; everything else counts as a gap between words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlog.llm.frames import steps, written

BUCKETS = 1 << 15
# Languages of a block; all labelled languages are learned.
BLOCK_LANGUAGES = 256
ORDERS = (1, 2, 3)
UNDETERMINED = "und"
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


@cache
def _letters() -> np.ndarray:
    """Each code point, or a space if it is no letter."""
    table = np.full(0x110000, 0x20, np.uint32)
    letters = [c for c in range(0x110000) if chr(c).isalpha()]
    table[letters] = letters
    return table


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, where each text's begin, and the texts' numbers of letters."""
    lower = [t.lower() for t in texts]
    joined = "  " + "".join(t + "  " for t in lower)
    points = _letters()[np.frombuffer(joined.encode("utf-32-le"), "<u4")]
    ends = 2 + np.cumsum([len(t) + 2 for t in lower])
    letter = points != 0x20
    # gaps of any width are one gap; between texts there are two, so that no n-gram spans two texts
    keep = letter | np.concatenate([[True], letter[:-1]])
    keep[0:2] = keep[ends - 1] = keep[ends - 2] = True
    points, letter = points[keep].astype(np.uint64), letter[keep]
    ends = np.cumsum(keep)[ends - 1]
    starts = np.concatenate([[2], ends[:-1]])
    letters = np.add.reduceat(letter, starts, dtype=np.int64)
    out, code = [], np.zeros(len(points), np.uint64)
    for back, order in enumerate(ORDERS):
        shifted = np.concatenate([np.full(back, 0x20, np.uint64), points[: len(points) - back]])
        code = code + shifted * _FACTORS[back]
        mixed = (code ^ (code >> np.uint64(29))) * (_FACTORS[2] + np.uint64(2 * order))
        out.append((mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32))
    return np.stack(out, axis=1)[2:].ravel(), (starts - 2) * len(ORDERS), letters


def count_ngrams(docs: DataFrame) -> DataFrame:
    """lang, bucket, n over the rows (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in steps(batches):
            buckets, starts, _ = ngrams(batch.column("text").to_pylist())
            langs = np.array(batch.column("lang").to_pylist(), object)
            owner = np.repeat(np.arange(len(starts)), np.diff([*starts, len(buckets)]))
            for lang in set(langs.tolist()):
                found = np.bincount(buckets[(langs == lang)[owner]], minlength=BUCKETS)
                sums[lang] = sums.get(lang, 0) + found
        for lang, cells in sums.items():
            met = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(met), pa.string()), pa.array(met.astype(np.int32)), pa.array(cells[met], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    return docs.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Block:
    """Some languages in order of their names, their log priors, and log probabilities by bucket."""

    def __init__(self, langs: list[str], priors: np.ndarray, matrix: np.ndarray):
        self.langs, self.priors, self.matrix = langs, priors, matrix

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best language of each text, its score, the sum of all shares against it, and the number of letters."""
        buckets, starts, letters = ngrams(texts)
        scores = np.stack([np.add.reduceat(row[buckets], starts, dtype=np.float64) for row in self.matrix])
        scores += self.priors[:, None]
        best = scores.argmax(axis=0)
        top = scores.max(axis=0)
        return np.array(self.langs, object)[best], top, np.exp(scores - top).sum(axis=0), letters


@dataclass
class Model:
    """All learned languages, in blocks that follow each other by name."""

    langs: list[str]
    blocks: list[Block]


def train(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5, block_languages: int = BLOCK_LANGUAGES
) -> Model:
    """Fit on every row that has a text and a language."""
    docs = labelled.select(labelled[text_col].alias("text"), labelled[lang_col].cast("string").alias("lang")).dropna()
    sizes = sorted((r["lang"], r["count"]) for r in docs.groupBy("lang").count().collect())
    langs = [lang for lang, _ in sizes]
    total = sum(n for _, n in sizes)
    parts = [sizes[at : at + block_languages] for at in range(0, len(sizes), block_languages)]
    cells = count_ngrams(docs)
    if len(parts) > 1:
        cells = written(cells, "language-cells")
    blocks = []
    for part in parts:
        own = [lang for lang, _ in part]
        # at most BLOCK_LANGUAGES x BUCKETS cells
        found = (cells.filter(F.col("lang").between(own[0], own[-1])) if len(parts) > 1 else cells).toArrow()
        counts = np.zeros((len(own), BUCKETS))
        rows = np.searchsorted(np.array(own, object), np.array(found.column("lang").to_pylist(), object))
        counts[rows, found.column("bucket").to_numpy()] = found.column("n").to_numpy()
        matrix = np.log(counts + smoothing) - np.log(counts.sum(axis=1, keepdims=True) + smoothing * BUCKETS)
        blocks.append(Block(own, np.log(np.array([n for _, n in part], float) / total), matrix.astype(np.float32)))
    return Model(langs, blocks)


_SCORED = "doc_id long, text string, lang_pred string, best double, shares double, letters long"


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row; `und` and 0 if the text is null or has no letter.

    The score is the posterior probability; ties go to the first name. Repeated rows give
    a row each, an empty table none, and without learned languages all are `und`. Other
    columns, whatever their names, are not looked at. Texts of any length are scored whole.
    """
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    lowest = F.lit(float("-inf"))
    found = docs.select("doc_id", "text", F.lit(UNDETERMINED).alias("lang_pred"), lowest.alias("best"), F.lit(0.0).alias("shares"), F.lit(0).cast("long").alias("letters"))
    for no, block in enumerate(model.blocks):
        found = found.mapInArrow(_scorer(df.sparkSession.sparkContext.broadcast(block), no == len(model.blocks) - 1), _SCORED)
    known = F.col("letters") > 0
    return found.select(
        "doc_id", F.when(known, F.col("lang_pred")).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(known, 1.0 / F.col("shares")).otherwise(0.0).alias("score"),
    )


def _scorer(shared: Broadcast, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Brings rows with their best language so far past one more block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            langs, top, shares, letters = shared.value.score([t or "" for t in batch.column("text").to_pylist()])
            before, best_before = np.array(batch.column("lang_pred").to_pylist(), object), batch.column("best").to_numpy()
            better = top > best_before
            best = np.where(better, top, best_before)
            with np.errstate(under="ignore"):
                all_shares = batch.column("shares").to_numpy() * np.exp(best_before - best) + shares * np.exp(top - best)
            text = pa.nulls(batch.num_rows, pa.string()) if last else batch.column("text")
            columns = [
                batch.column("doc_id"), text, pa.array(np.where(better, langs, before).tolist(), pa.string()), pa.array(best),
                pa.array(all_shares), pa.array(letters.astype(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _SCORED.split(", ")])

    return run
