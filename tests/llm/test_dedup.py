"""Line dedup, similarity join and repeated substrings against plain versions."""

import hashlib
import random
import time

import numpy as np
import plain
import pyarrow as pa
import pytest

from fleetlog.llm import frames, line_dedup, part_enum, suffix_dedup
from fleetlog.llm.components import components
from fleetlog.llm.suffix_sort import suffix_array


@pytest.mark.parametrize("bits", [64, 3])
def test_line_dedup(docs, rows, bits):
    """Three bits make every group of fingerprints a mixture of texts."""
    want = plain.dedup_lines(rows)
    found = line_dedup.dedup_lines(docs, fingerprint_bits=bits).select("doc_id", "text", "n_removed_lines", "row").collect()
    assert sorted((str(i), str(t)) for i, t, _, _ in found) == sorted((str(i), str(want.get((i, t)))) for i, t in rows)
    assert {x.row for x in found} == {"x"}
    assert any(x.n_removed_lines for x in found)


def test_line_dedup_moves_with_content(spark):
    body = [f"line {i * 37 % 101} of the text" for i in range(60)]
    texts = [(1, "\n".join(body)), (2, "\n".join(["new first line", "and a second", *body]))]
    left = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert left[1].n_removed_lines == 0
    assert left[2].n_removed_lines > 45


def test_empty_tables(no_docs):
    assert line_dedup.dedup_lines(no_docs).count() == 0
    assert part_enum.similar_documents(no_docs).count() == 0
    assert suffix_dedup.dedup_substrings(no_docs).count() == 0


@pytest.mark.parametrize("width, percent, family", [(4, 85, 300_000), (5, 80, 40)])
def test_similar_documents(docs, rows, width, percent, family):
    """The small family size cuts families into blocks."""
    found = part_enum.similar_documents(docs, width, percent, family_shingles=family).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, plain.components(rows, width, percent)))


def test_texts_that_quote_are_taken_apart(spark, monkeypatch):
    """One long passage makes a single family of all texts; only what may be linked is compared, and once."""
    compared = []

    def watched(families, *args, whole=part_enum._verified):
        compared.append(families.count())
        return whole(families, *args)

    monkeypatch.setattr(part_enum, "_verified", watched)
    passage = " ".join(f"said{k}" for k in range(36))
    rows = [(i, f"{passage} " + " ".join(f"own{i}x{k}" for k in range(14))) for i in range(120)]
    rows += [(200 + i, rows[i][1].replace(f"own{i}x0", "changed")) for i in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = part_enum.similar_documents(frame, 5, 80, family_shingles=500).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, plain.components(rows, 5, 80)))
    assert sum(r.doc_id != r.component_id for r in found) == 3
    assert 6 <= compared[0] <= len(rows)


def test_written_leaves_no_shuffle_files(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    frames.prepare(spark)
    before = files()
    left = frames.written(spark.range(1000).repartition(4, "id"), "shuffled")
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before
    assert left.count() == 1000


def test_signatures_meet():
    """Sets that are just similar enough share a signature, whatever their size."""
    rng = np.random.default_rng(5)
    for size in [*range(1, 60), 100, 333, 2000]:
        for percent in (80, 85, 95):
            k = (100 - percent) * size // 100
            one = rng.integers(0, 2**63, size, dtype=np.uint64)
            two = one.copy()
            swap = (100 - percent) * size // (100 + percent)
            two[:swap] = rng.integers(0, 2**63, swap, dtype=np.uint64)
            for other in (two, one[: size - k]):
                if len(other):
                    (sig, owner) = part_enum.signatures([np.unique(one), np.unique(other)], percent)
                    assert set(sig[owner == 0]) & set(sig[owner == 1]), (size, percent)


def test_sets_with_half_an_id_in_common(monkeypatch):
    whole = part_enum._set_ids
    monkeypatch.setattr(part_enum, "_set_ids", lambda x: (7, whole(x)[1]))
    texts = ["a b c d", "e f g h", "a b c d", "", "i j"]
    found = list(part_enum._gathered(iter([pa.RecordBatch.from_pydict({"text": texts})]), 3))
    assert [len(x) for x in found] == [3]
    assert sorted(len(x) for x in found[0].values()) == [1, 2, 2]


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    label = {x: x for p in pairs for x in p if p[0] != p[1]}
    for a, b in pairs:
        if a != b:
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
    found = components(spark.createDataFrame(pairs, "a long, b long"))
    assert sorted(map(tuple, found.collect())) == sorted(label.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(500):
        text = [rng.randint(1, rng.randint(1, 4)) for _ in range(rng.randint(0, 40))] * rng.choice([1, 1, 3])
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("length, gram, contexts", [(200, 80, 400), (40, 12, 400), (40, 12, 1)])
def test_repeated_substrings(docs, rows, length, gram, contexts):
    """One context per array sends every bucket to the counting of windows."""
    found = suffix_dedup.dedup_substrings(docs, length=length, gram=gram, bucket_contexts=contexts).collect()
    want = []
    for (i, t), gone in zip(rows, plain.removed_bytes([t for _, t in rows], length)):
        data = (t or "").encode()
        left = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append((str(i), len(data), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in found) == sorted(want)
    assert any(w[2] for w in want)


def test_long_documents_are_cut_with_overlap(spark, monkeypatch):
    """A passage across the border of two pieces is found."""
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdef") for _ in range(300))
    filler = ["".join(rng.choice("ghijkl") for _ in range(n)) for n in (suffix_dedup.PIECE - 150, 500, 900)]
    texts = [(1, filler[0] + passage + filler[1]), (2, passage + filler[2])]
    found = suffix_dedup.dedup_substrings(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in found} == {1: 300, 2: 300}
