"""M-tree search against brute force; quality rules and language identification."""

import math

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from fleetlog.llm import lang_id, mtree, quality
from fleetlog.llm.frames import prepare


def brute(rows, queries, k, scale=64):
    ints = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if i is not None and usable(v)]
    out = []
    for q, v in sorted({(q, tuple(math.floor(scale * float(x)) for x in v)) for q, v in queries if q is not None and usable(v)}):
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ints if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, dim))
    return [(i, [float(x) for x in centers[i % 6] + rng.normal(size=dim) * 0.3]) for i in range(n)]


@pytest.mark.parametrize("k", [1, 20])
def test_top_k(spark, k):
    rows = vectors(700, 8, 1)
    rows += [(1000 + i, rows[3][1]) for i in range(300)]  # one vector many times: ties
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 6), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8)]
    rows += [(2004, [1e7] * 8), (2040, [-2e7] * 8), (2005, []), (2006, [5.0, 5.0]), (None, rows[0][1]), rows[20], rows[20], (2020, [0.0] * 8)]
    schema = "vec_id long, embedding array<double>"
    df = prepare(spark).createDataFrame(rows, schema).withColumn("rank", F.lit("x")).repartition(3)
    asked = [r for r in rows if r[0] is not None and r[0] % 20 == 0]
    found = mtree.top_k(df, df.filter("vec_id % 20 = 0"), k)
    assert dict(found.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    assert sorted(map(tuple, found.collect())) == brute(rows, asked, k)


def test_top_k_of_few_rows(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, schema)
    assert sorted(map(tuple, mtree.top_k(df, df, 20).collect())) == brute(rows, rows, 20)
    none = spark.createDataFrame([], schema)
    assert mtree.top_k(none, none).count() == 0
    assert mtree.top_k(df, none).count() == 0
    assert mtree.top_k(none, df).count() == 0


def test_top_k_of_large_components(spark):
    """No finite component is left out; products beyond 53 bits stay exact."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-(2**24), 2**24, 4)]) for i in range(60)]
    rows += [(100, [5e6, 0.0, 0.0, 0.0]), (101, [1.0, 2.0, 0.0, 0.0]), (120, [1.0, 1.0, 0.0, 0.0]), (140, [2.0**24, 1.0, 0.5, 0.0])]
    df = prepare(spark).createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = [r for r in rows if r[0] >= 100]
    wide = [r for r in brute(rows, asked, 5)]
    found = mtree.top_k(df, df.filter("vec_id >= 100"), 5)
    assert sorted(map(tuple, found.collect())) == wide


def test_scores_beyond_a_long_are_an_error(spark):
    df = prepare(spark).createDataFrame([(0, [1e10, 1.0]), (1, [1e10, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond a long"):
        mtree.top_k(df, df, 2).collect()
    low = df.selectExpr("vec_id", "IF(vec_id = 0, transform(embedding, x -> -x), embedding) AS embedding")
    assert [r.vec_id for r in mtree.top_k(low, low.filter("vec_id = 1"), 1).collect()] == [2]
    with pytest.raises(Exception, match="beyond a long"):
        mtree.top_k(df.selectExpr("vec_id", "array(1e30D) AS embedding"), df, 2).collect()


def test_search_leaves_computations_out():
    """Far pages are never scored."""
    rng = np.random.default_rng(0)
    centers = np.array([[1000, 0], [0, 1000], [-1000, 0], [0, -1000]])
    vecs = [c + rng.integers(-20, 20, (50, 2)) for c in centers]
    space = mtree.Space(int(max((v * v).sum(axis=1).max() for v in vecs)))
    pages = []
    for v in vecs:
        d = space.between(v, v[:1])[:, 0]
        pages.append({
            "routing": v[:1], "radius": d.max(), "parent": 0.0, "low": -np.inf, "high": np.inf,
            "ids": np.arange(50) + 50 * len(pages), "vecs": v, "dists": d,
        })
        pages[-1]["parent"] = float(space.between(v[:1], vecs[0][:1])[0, 0])
    visited = []
    search = mtree.Search(space, np.array([-1]), np.array([[1000, 0]]), np.array([np.iinfo(np.int64).min]), 5)
    visit = search._visit
    search._visit = lambda page, *rest: (visited.append(page["ids"][0]), visit(page, *rest))
    search.run(pages, space.from_scores(np.array([1000**2]), space.rough(np.array([[1000, 0]]), vecs[0][:1])[:, 0]))
    assert visited == [0]
    assert len(search.found[0]) == 5


def test_quality_features(docs, rows):
    found = quality.assess(docs).collect()
    want = {}
    for i, t in rows:
        n, *rest = plain.quality_features(t)
        want[str((i, t))] = (n, *rest, n < 20 or 100 * rest[3] > 30 * n)
    for r in found:
        q = r.quality
        base = (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed)
        assert base == want[str((r.doc_id, r.text))]
        assert 0 <= q.probability <= 1 and not (q.kept and q.base_failed)
    assert len(found) == len(rows)


def test_quality_of_nothing(no_docs):
    assert quality.assess(no_docs).count() == 0


def simulated(n=20_000, seed=0):
    """Votes of rules with known rates on good and bad documents."""
    rng = np.random.default_rng(seed)
    good = rng.random(n) < 0.85
    rates = [((0.7, 0.2, 0.1), (0.02, 0.08, 0.9)), ((0.5, 0.2, 0.3), (0.01, 0.04, 0.95)), ((0.6, 0.1, 0.3), (0.03, 0.17, 0.8)), ((0.4, 0.4, 0.2), (0.05, 0.25, 0.7))]
    votes = np.stack([np.where(good, rng.choice(3, n, p=g), rng.choice(3, n, p=b)) - 1 for b, g in rates], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    return good, votes, patterns, counts, rates


def test_estimated_accuracies():
    good, votes, patterns, counts, rates = simulated()
    model = quality.fit(patterns, counts)
    assert abs(model.prior - good.mean()) < 0.03
    for table, (bad, fine) in zip(model.table, rates):
        assert np.abs(table - np.array([bad, fine])).max() < 0.05
    assert ((model.posterior(votes) >= 0.5) == good).mean() > 0.95
    right = model.accuracies()
    assert right.shape == (4, 2) and (right > 0.5).all()


def test_counts_are_as_good_as_rows():
    _, votes, patterns, counts, _ = simulated(500)
    one = quality.fit(patterns, counts).posterior(patterns)
    each = quality.fit(votes, np.ones(len(votes), np.int64)).posterior(patterns)
    assert np.allclose(one, each, atol=1e-6)


def test_quality_keeps_clean_documents(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = quality.assess(docs).join(labels.withColumnRenamed("quality", "good"), "doc_id").filter("not quality.base_failed")
    kept = {r.good: r.kept for r in found.groupBy("good").agg(F.avg(F.col("quality.kept").cast("int")).alias("kept")).collect()}
    assert kept[1] > 0.95
    assert kept.get(0, 0) < 0.2


def test_ngrams_do_not_depend_on_neighbours():
    texts = ["abc Def", "", "  ", "é1ü", "x" * 50, "", "12"]
    buckets, starts, letters = lang_id.ngrams(texts)
    ends = [*starts[1:], len(buckets)]
    for i, t in enumerate(texts):
        alone, _, n = lang_id.ngrams([t])
        assert buckets[starts[i] : ends[i]].tolist() == alone.tolist()
        assert letters[i] == n[0] == sum(c.isalpha() for c in t)


LANGS = {"aa": "alpha beta gamma delta", "bb": "ein zwei drei vier fünf", "cc": "uno due tre quattro"}


def test_language_id(spark):
    rows = [(i, f"{LANGS[x]} {i}", x) for i, x in enumerate(list(LANGS) * 20)]
    rows += [(100, None, "aa"), (101, "123 !?", "aa"), (102, "", None), (103, "zwei drei", None), (None, "uno due", None), (103, "zwei drei", None)]
    df = prepare(spark).createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = lang_id.train(df)
    assert model.langs == ["aa", "bb", "cc"]
    found = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.identify(df, model).collect()}
    assert all(found[i][0] == x for i, _, x in rows[:60])
    assert found[100] == found[101] == found[102] == ("und", 0.0)
    assert (found[103][0], found[None][0]) == ("bb", "cc")
    assert all(0 <= s <= 1 for _, s in found.values())
    assert lang_id.identify(df, model).count() == len(rows)


def plain_bayes(rows, texts, smoothing=0.5):
    """Multinomial naive Bayes, one text and one n-gram at a time."""
    counts, docs = {}, {}
    for text, lang in rows:
        if text is not None and lang is not None:
            own = counts.setdefault(lang, {})
            docs[lang] = docs.get(lang, 0) + 1
            for b in lang_id.ngrams([text])[0].tolist():
                own[b] = own.get(b, 0) + 1
    out = []
    for text in texts:
        if not any(c.isalpha() for c in text or ""):
            out.append(("und", 0.0))
            continue
        score = {}
        for lang, own in counts.items():
            whole = sum(own.values()) + smoothing * lang_id.BUCKETS
            score[lang] = math.log(docs[lang] / sum(docs.values()))
            score[lang] += sum(math.log((own.get(b, 0) + smoothing) / whole) for b in lang_id.ngrams([text])[0].tolist())
        best = min(score, key=lambda x: (-score[x], x))
        out.append((best, 1 / sum(math.exp(s - score[best]) for s in score.values())))
    return out


@pytest.mark.parametrize("block", [256, 2, 1])
def test_language_id_is_plain_naive_bayes(spark, block):
    rows = [(i, f"{LANGS[x]} {'xyz'[i % 3] * (i % 5)}", x) for i, x in enumerate(list(LANGS) * 5)]
    texts = ["alpha zwei due", "zzz", "gamma", "123", "", None, "fünf uno beta delta", "alpha zwei due", "q " * 300_000]
    prepare(spark)
    model = lang_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), block_languages=block)
    assert len(model.blocks) == -(-3 // block)
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.identify(asked, model).collect()}
    for i, (lang, score) in enumerate(plain_bayes([r[1:] for r in rows], texts)):
        assert found[i][0] == lang and abs(found[i][1] - score) < 1e-4, i


def test_all_languages_are_learned(spark):
    words = ["".join(chr(97 + (i * k) % 26) for k in (1, 3, 7, 11, 17)) + chr(97 + i // 26) for i in range(300)]
    rows = [(i, f"{w} {w}", f"l{i:03d}") for i, w in enumerate(words)]
    df = prepare(spark).createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.train(df)
    assert len(model.langs) == 300 and len(model.blocks) == 2
    found = {r.doc_id: r.lang_pred for r in lang_id.identify(df, model).collect()}
    assert sum(found[i] == lang for i, _, lang in rows) > 290


def test_language_id_without_labels(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in lang_id.identify(df, lang_id.train(df)).collect()] == [(1, "und", 0.0)]
    none = df.filter("false")
    assert lang_id.identify(none, lang_id.train(none)).count() == 0


def test_held_out_accuracy(spark, sf_dir):
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = lang_id.train(docs.filter(fold != 1))
    found = lang_id.identify(docs.filter(fold == 1), model).join(docs.select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
