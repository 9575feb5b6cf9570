"""Neighbour search, source divergence and ranked search against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlog.llm import cross_polytope, divergence, ranked_search
from fleetlog.llm.frames import prepare

VECTORS = "vec_id long, embedding array<double>"


def brute_neighbours(rows, queries, k):
    """{query: [(id, score)]}, an id once with its best score."""
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    index = [(i, v) for i, v in rows if i is not None and usable(v)]
    out = {}
    for q, v in queries:
        if q is None or not usable(v):
            continue
        best = {}
        for i, w in index:
            if i != q:
                score = math.fsum(a * b for a, b in zip(v, w))
                best[i] = max(best.get(i, score), score)
        out[q] = sorted(((i, s) for i, s in best.items()), key=lambda x: (-round(x[1], 9), x[0]))[:k]
    return out


def clustered(n, dim, seed, lengths=False):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(8, dim))
    rows = centers[np.arange(n) % 8] + rng.normal(size=(n, dim)) * 0.4
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    if lengths:
        rows *= rng.uniform(0.5, 2, (n, 1))
    return [(i, [float(x) for x in v]) for i, v in enumerate(rows)]


def found_neighbours(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_all_cells_visited_is_exact(spark):
    """With every cell probed nothing can be missed, whatever the rows look like."""
    rows = clustered(160, 5, 3, lengths=True)
    rows += [(500 + i, rows[3][1]) for i in range(90)]  # one vector many times
    rows += [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [float("nan")] * 5), (903, [float("inf")] * 5), (904, [0.0] * 5), (905, [])]
    rows += [(906, [2.0, 1.0]), (None, rows[0][1]), rows[20], rows[20], (20, rows[21][1]), (907, [-0.0, 1.0, 0.0, 0.0, 0.0]), (908, [0.0, 1.0, 0.0, 0.0, 0.0])]
    df = prepare(spark).createDataFrame(rows, VECTORS).withColumn("rank", F.lit("x")).withColumn("cell", F.lit(1)).repartition(3)
    asked = [r for r in rows if r[0] is not None and r[0] % 20 == 0]
    found = cross_polytope.nearest(df, df.filter("vec_id % 20 = 0"), k=7, tables=2, probes=16, chunk_rows=40, block_queries=3)
    assert dict(found.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    found = found_neighbours(found)
    for q, best in brute_neighbours(rows, asked, 7).items():
        if q != 20:  # two vectors under one id: the best of both
            assert [i for i, _ in found[q]] == [i for i, _ in best], q
            assert np.allclose([s for _, s in found[q]], [s for _, s in best], rtol=1e-12)
    assert len({i for i, _ in found[20]}) == 7
    assert 500 in found  # the last copies are asked, too


def test_few_vectors(spark):
    df = prepare(spark).createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], VECTORS)
    found = found_neighbours(cross_polytope.nearest(df, df, 20, probes=99))
    assert {q: [i for i, _ in best] for q, best in found.items()} == {0: [1, 2], 1: [0, 2], 2: [1, 0]}
    none = df.filter("false")
    assert cross_polytope.nearest(none, df).count() == 0
    assert cross_polytope.nearest(df, none).count() == 0
    assert cross_polytope.nearest(none, none).count() == 0
    only = df.filter("vec_id = 0")
    assert cross_polytope.nearest(only, only).count() == 0


@pytest.mark.parametrize("hashes, probes, lengths", [(1, 14, False), (1, 14, True), (2, 160, False)])
def test_recall(spark, hashes, probes, lengths):
    rows = clustered(1500, 24, 5, lengths)
    df = prepare(spark).createDataFrame(rows, VECTORS).repartition(3)
    found = found_neighbours(cross_polytope.nearest(df, df.filter("vec_id % 20 = 0"), hashes=hashes, probes=probes))
    want = brute_neighbours(rows, rows[::20], 20)
    hit = sum(len({i for i, _ in best} & {i for i, _ in found[q]}) for q, best in want.items())
    assert hit >= 0.9 * 20 * len(want)


def test_recall_on_the_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    found = found_neighbours(cross_polytope.nearest(rows, rows.filter("vec_id % 20 = 0")))
    rows = [(r.vec_id, r.embedding) for r in rows.collect()]
    want = brute_neighbours(rows, [r for r in rows if r[0] % 20 == 0], 20)
    assert sum(len({i for i, _ in best} & {i for i, _ in found[q]}) for q, best in want.items()) >= 0.9 * 20 * len(want)


def test_hadamard_and_probes():
    x = np.random.default_rng(1).normal(size=(4, 8))
    assert np.allclose(cross_polytope.hadamard(cross_polytope.hadamard(x)), x)
    hashing = cross_polytope.Hashing(6, 1.0, tables=3, hashes=2)
    vecs = np.random.default_rng(2).normal(size=(20, 6))
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True) * 1.0000001
    probes, cells = hashing.probes(vecs, 256), hashing.cells(vecs)
    assert probes.shape == (20, 3, 256) and all(len(set(p.tolist())) == 256 for row in probes for p in row)
    assert (probes[:, :, 0] == cells).all()  # a unit vector's own cell is the nearest


def test_scores_do_not_depend_on_the_block():
    rng = np.random.default_rng(3)
    rows, query = rng.normal(size=(50, 64)), rng.normal(size=64)
    alone = [cross_polytope.exact_scores(query, rows[i : i + 1])[0] for i in range(50)]
    assert cross_polytope.exact_scores(query, rows).tolist() == alone


# --- divergence


def brute_audit(rows):
    words = [(i, lang or "", source or "", [t.decode() for t in re.findall(rb"[a-z\x80-\xff]+", (text or "").encode().lower())]) for i, (lang, source, text) in enumerate(rows)]
    out = []
    for lang in {x[1] for x in words}:
        own = [x for x in words if x[1] == lang]
        docs = Counter(t for x in own for t in set(x[3]))
        kept = {t for t, n in docs.items() if n >= 3}
        count = {s: Counter() for s in {x[2] for x in own}}
        for _, _, s, terms in own:
            count[s].update(t for t in terms if t in kept)
        total = sum(count.values(), Counter())

        def share(c, t):
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))

        for a in count:
            pairs = [(-sum((share(count[a], t) - share(count[b], t)) ** 2 // share(count[b], t) for t in kept), b) for b in count if b != a]
            terms = [(-((share(count[a], t) - share(total, t)) ** 2 // share(total, t)), t) for t in kept if count[a][t] and share(count[a], t) > share(total, t)]
            out += [(lang, a, "pair", b, -v, r + 1) for r, (v, b) in enumerate(sorted(pairs))]
            out += [(lang, a, "term", t, -v, r + 1) for r, (v, t) in enumerate(sorted(terms, key=lambda x: (x[0], x[1].encode()))[:200])]
    return sorted(out)


def odd_rows(seed=0, n=120, sources=7, words=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5))) for _ in range(words)]
    rows = []
    for _ in range(n):
        source, lang = f"s{min(rng.randrange(sources), rng.randrange(sources))}", rng.choice(["en", "de", "en", None])
        part = vocabulary[len(source + str(lang)) % 3 :: rng.choice([1, 2])]
        rows.append((lang, source, " ".join(rng.choice(part).upper() if rng.random() < 0.1 else rng.choice(part) for _ in range(rng.randint(0, 30)))))
    rows += [("en", "silent", None), ("en", None, "1 2 3"), ("xx", "a", "once"), ("xx", "b", ""), ("yy", "only", "word word"), (None, None, None)]
    return rows + [rows[0]] * 4


@pytest.mark.parametrize("cells, block", [(1 << 16, 256), (60, 256), (200, 3), (60, 1)])
def test_audit(spark, cells, block):
    """Many small pages, and blocks of rows."""
    rows = odd_rows()
    df = prepare(spark).createDataFrame(rows, "lang string, source string, text string").repartition(3)
    df = df.selectExpr("*", "1 AS n", "'x' AS term", "2 AS page", "3 AS value")
    found = divergence.audit(df, page_cells=cells, block_rows=block)
    assert dict(found.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    assert sorted(map(tuple, found.collect())) == brute_audit(rows)


def test_audit_ranks_are_cut_with_ties(spark):
    rows = [("en", s, " ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300))) for s in "aaab"] + [("en", "b", "other other other")] * 3
    df = prepare(spark).createDataFrame(rows, "lang string, source string, text string")
    found = sorted(map(tuple, divergence.audit(df, page_cells=16).collect()))
    assert found == brute_audit(rows)
    assert max(r[5] for r in found) == 200


def test_audit_of_nothing(spark):
    none = prepare(spark).createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(none).count() == 0


def test_large_counts_stay_exact():
    counts, total = np.array([0, 5, 10**13, 3 * 10**14]), 10**15
    assert divergence.shares(counts, np.full(4, total)).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts]
    p, q = np.array([10**9 + 1, 1]), np.array([1, 10**9 + 1])
    assert divergence.distance(p, q).tolist() == [10**18, 10**18 // (10**9 + 1)]


def test_zero_quadrants_are_only_counted():
    """Two rows far apart in a wide matrix: nearly all columns are found zero in whole quadrants."""
    rows, columns = np.array([0, 40, 3]), np.array([5, 900, 2000])
    tree, zeros = divergence.Quadtree(rows, columns, 50, 4096), np.zeros((50, 50), np.int64)
    all_rows = np.ones(50, bool)
    leaves = sum(len(a) for a, _, _ in tree.walk(all_rows, all_rows, zeros))
    assert leaves <= 3 * 7
    assert zeros[10, 20] == 4096 and zeros[0, 10] == 4096 - 16 and zeros[0, 45] == 4096 - 24


# --- ranked search


def words_of(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def brute_search(docs, items, k):
    counts = [(i, Counter(words_of(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    total, length = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(words_of(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c, n in counts:
            m = 50 + 50 * n * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(map(str, out))


def lexical_rows():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(200)] + ["é", "日本", "a1", "12"]
    docs = [(i, " ".join(vocabulary[min(rng.randrange(204), rng.randrange(204))] for _ in range(rng.choice([3, 8, 8, 40, 90])))) for i in range(300)]
    docs += [(400 + i, docs[5][1]) for i in range(120)]  # a large stratum of copies: ties
    docs += [(600, None), (601, ""), (602, " ..!? "), (None, docs[9][1]), docs[9], docs[9], (603, "w1 " * 60_000), (604, "x" * 100_000), (605, "W3-w3_w3")]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(12))) for k in range(25)]
    items += [(30, docs[5][1]), (31, None), (32, ""), (33, "unknown words"), (34, "w3 W3 é"), (34, "日本"), (None, "w7 a1"), items[0]]
    return docs, items


@pytest.mark.parametrize("k, docs_a_page, block", [(50, 4096, 200_000), (5, 16, 40), (1, 1, 200_000)])
def test_ranked_search(spark, k, docs_a_page, block):
    docs, items = lexical_rows()
    prepare(spark)
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS m", "2 AS page", "'x' AS terms").repartition(4)
    queries = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS item", "2 AS term", "3 AS rank")
    index = ranked_search.build(table, page_docs=docs_a_page)
    found = ranked_search.search(index, queries, k, block_terms=block)
    assert dict(found.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted(map(str, map(tuple, found.collect()))) == brute_search(docs, items, k)


def test_search_of_nothing(spark):
    none = prepare(spark).createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.search(ranked_search.build(none), asked).count() == 0
    assert ranked_search.search(ranked_search.build(some), asked.filter("false")).count() == 0
    assert [tuple(r)[:3] for r in ranked_search.search(ranked_search.build(some), asked).collect()] == [(1, 1, 1)]


def test_visits_are_left_out(spark):
    """Only pages whose bound can reach the best score are opened."""
    docs = [{"doc_id": i, "terms": b"rare common" if i == 0 else b"common", "tfs": np.ones(2 if i == 0 else 1, "<i4").tobytes()} for i in range(20)]
    block = ranked_search.Block([1, 1], [b"rare", b"common"], [900, 10])
    pages = [ranked_search.make_page(n, 100, docs[n * 5 : n * 5 + 5]) for n in range(4)]
    bounds = [int(block.bounds(p["m"], p["terms"], p["top"])[0]) for p in pages]
    best = ranked_search.Best(block, 1)
    best.visit(0, ranked_search.Page(pages[0], block))
    assert best.found[0][0][2] == 0 and all(b < best.need[0] for b in bounds[1:]) and bounds[0] == best.need[0]
