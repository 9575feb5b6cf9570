"""The pipeline against plain versions of its stages, and its guard."""

import subprocess
import sys
from collections import defaultdict

import numpy as np
import plain
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from fleetlog.llm import quality
from fleetlog.llm.frames import prepare, written

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def vote(value, good, bad):
    return -1 if bad(value) else 1 if good(value) else 0


def quality_rows(rows):
    votes = []
    for _, t in rows:
        n, chars, symbols, copies, repeats = plain.quality_features(t)
        lines = sum(bool(plain.spaced(x)) for x in (t or "").split("\n"))
        plain_signs = sum(c.isalnum() for c in t or "")
        words, distinct = max(n, 1), len(set(plain.spaced(t)))
        votes.append((
            vote(symbols / words, lambda x: x <= 0.1, lambda x: x >= 0.3),
            vote(chars / words, lambda x: 3 <= x <= 7, lambda x: x < 2 or x > 20),
            vote(repeats / words, lambda x: x <= 0.05, lambda x: x >= 0.3),
            vote(copies / max(lines, 1), lambda x: x <= 0.1, lambda x: x >= 0.5),
            vote(plain_signs / max(chars, 1), lambda x: x >= 0.9, lambda x: x < 0.7),
            vote(distinct / words, lambda x: x >= 0.5 or words >= 1000, lambda x: x < 0.2 and words < 1000),
        ))
    patterns, counts = np.unique(np.array(votes), axis=0, return_counts=True)
    good = quality.fit(patterns, counts).posterior(np.array(votes)) >= 0.5
    out = []
    for row, ok in zip(rows, good):
        n, _, _, _, repeats = plain.quality_features(row[1])
        if ok and n >= 20 and 100 * repeats <= 30 * n:
            out.append(row)
    return out


def line_rows(rows):
    left = plain.dedup_lines(rows)
    return [(i, left[i, t]) for i, t in rows if left[i, t] == t or left[i, t].strip()]


def near_rows(rows):
    named = [r for r in rows if r[0] is not None]
    first = {i for i, _, c in plain.components(named, 5, 80) if i == c}
    return sorted({r for r in named if r[0] in first}) + [r for r in rows if r[0] is None]


def passage_rows(rows):
    out = []
    for (i, t), gone in zip(rows, plain.removed_bytes([t for _, t in rows], 200)):
        left = plain.left_characters(t, gone)
        if not any(gone) or left.strip():
            out.append((i, left))
    return out


@pytest.fixture(scope="module")
def table(rows):
    rng_rows = [*rows, *[(500 + i, " ".join(w + " " + w[::-1] for w in t.split())) for i, t in rows[:40] if t and i is not None]]
    return rng_rows


def test_stages(spark, table):
    """Every stage on what the one before kept."""
    prepare(spark)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in table], COLUMNS).repartition(4)
    rows = table
    plain_stages = [quality_rows, line_rows, near_rows, passage_rows]
    assert [f for _, f in corpus_pipeline.STAGES][-1] is corpus_pipeline.packing_stage
    for (name, stage), by_hand in zip(corpus_pipeline.STAGES, plain_stages):
        docs = written(stage(spark, docs, ""), "test-stage")
        before, rows = len(rows), by_hand(rows)
        found = docs.collect()
        assert docs.columns == [x.split()[0] for x in COLUMNS.split(", ")], name
        assert sorted(map(str, ((r.doc_id, r.text) for r in found))) == sorted(map(str, rows)), name
        assert all(r.n_chars == len(r.text) for r in found), name
        assert len(rows) < before or name == "suffix-array dedup"
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = defaultdict(int)
    for i, t in rows:
        want[i] += len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
    got = defaultdict(int)
    for p in corpus_pipeline.packing_stage(spark, docs, "").collect():
        got[p.doc_id] += p.length
    assert got == want


def test_clashing_columns_and_empty_tables(spark, docs, no_docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns, name
        assert stage(spark, no_docs, "").count() == 0, name
    assert corpus_pipeline.packing_stage(spark, no_docs, "").count() == 0


def test_run(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert found.count() > 50


def test_entry_without_the_corpus_operators():
    """The entry point imports and keeps the other queries when the corpus modules are gone."""
    code = (
        "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['fleetlog.llm'] = None\n"
        "import __spark_entry__ as e\n"
        "q = e.queries(); assert 'change_log' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q)"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=corpus_pipeline.__file__.rsplit("/", 1)[0], timeout=120)
