import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from fleetlog.operators import timeline
from fleetlog.operators.polls import poll_neighbours
from fleetlog.operators.recent import recent_distinct
from fleetlog.operators.sequence import cut_segments, hot_keys, with_last_known, with_neighbours

S = "k long, v long, ts long"


def test_drop_consecutives(spark):
    data = [(32, 100, 1), (32, 100, 2), (32, 200, 3), (120, 200, 1), (120, 250, 2), (120, 200, 3)]
    got = rows(timeline.drop_consecutives(spark.createDataFrame(data, S), ["k"], ["v"], ["ts"]))
    assert got == [(32, 100, 1), (32, 200, 3), (120, 200, 1), (120, 200, 3), (120, 250, 2)]


def test_staircase(spark):
    df = spark.createDataFrame([(1, 5, 10), (1, 7, 20)], S)
    assert rows(timeline.staircase(df, "k", "v", ["ts"])) == [(1, 5, 10), (1, 5, 19), (1, 7, 20)]


def test_densify(spark):
    polls = spark.createDataFrame([(t,) for t in (10, 20, 30, 40)], "ts long")
    log = spark.createDataFrame([(1, 5, 20), (1, 6, 40)], S)
    dense = timeline.densify(log, "k", ["v"], polls, "ts")
    assert rows(dense) == [(1, None, 10), (1, 5, 20), (1, 5, 30), (1, 6, 40)]
    wide = timeline.densify_wide(dense, "k", "v", [1], "ts")
    assert rows(wide, "ts", "1") == [(10, None), (20, 5), (30, 5), (40, 6)]


def test_densify_over_days(spark):
    rnd = random.Random(1)
    polls = sorted(rnd.sample(range(0, 6 * 86400), 60))
    log = sorted({(k, t): (k, rnd.randrange(3), t) for k in range(4) for t in rnd.sample(polls, 7)}.values())
    got = rows(timeline.densify(spark.createDataFrame(log, S), "k", ["v"], spark.createDataFrame([(t,) for t in polls], "ts long"), "ts"))
    want = []
    for k in range(4):
        for t in polls:
            past = [r for r in log if r[0] == k and r[2] <= t]
            want.append((k, max(past, key=lambda r: r[2])[1] if past else None, t))
    assert got == sorted(want, key=lambda r: [(x is not None, x) for x in r])


def test_align(spark):
    a = spark.createDataFrame([(1, 5, 10), (1, 6, 30)], "k long, a long, ts long")
    b = spark.createDataFrame([(1, 1, 20), (2, 9, 20)], "k long, b long, ts long")
    polls = spark.createDataFrame([(t,) for t in (10, 20, 30, 40)], "ts long")
    aligned = timeline.asof_align({"a": a, "b": b}, "k", polls, "ts")
    assert set(rows(aligned)) == {
        (1, 5, None, 10), (1, 5, 1, 20), (1, 6, 1, 30), (1, 6, 1, 40),
        (2, None, 9, 20), (2, None, 9, 30), (2, None, 9, 40),
    }
    distinct = timeline.asof_align_distinct({"a": a, "b": b}, "k", "a", "ts")
    assert set(rows(distinct)) == {(1, 5, None, 10), (1, 5, 1, 20), (1, 6, 1, 30)}


def test_intervals(spark):
    polls = spark.createDataFrame([(t,) for t in (0, 60, 120, 200, 90_000)], "ts long")
    assert rows(timeline.interval_mode(polls, "ts")) == [(60, 2)]
    stats = timeline.interval_stats(polls, "ts").first()
    assert (stats["n"], stats["min"], stats["p50"], stats["max"]) == (4, 60, 70.0, 89_800)
    assert rows(timeline.interval_histogram(polls, 100, 10, "ts")) == [(6, 2), (8, 1)]


def test_gaps(spark):
    polls = spark.createDataFrame([(0,), (60,), (1000,)], "ts long")
    assert rows(timeline.gap_intervals(polls, 300, "ts")) == [(61, 999)]
    assert rows(timeline.gap_null_rows(polls, "cost", 300, "ts")) == [(None, 60), (None, 1000)]


def test_poll_neighbours_cross_days(spark):
    ts = [5, 86_399, 86_400, 400_000]
    got = rows(poll_neighbours(spark.createDataFrame([(t,) for t in ts], "ts long"), "ts"))
    assert got == [(5, None, 86_399), (86_399, 5, 86_400), (86_400, 86_399, 400_000), (400_000, 86_400, None)]


def test_transitions(spark):
    day = 86_400
    df = spark.createDataFrame([(1, 0, day), (1, 1, 4 * day + 5), (1, 0, 6 * day), (2, 1, day)], "k long, s long, ts long")
    tr = timeline.transition_rows(df, "k", "s", ["ts"])
    assert rows(tr) == [(1, 0, day), (1, 1, 4 * day + 5)]
    assert rows(timeline.first_per_state(tr, "k", "s", "ts")) == [(1, 0, day), (1, 1, 4 * day + 5)]
    durations = timeline.transition_duration(tr, "k", "ts")
    assert [(r[0], r[1], str(r[2])) for r in durations.collect()] == [(1, 3, "1970-01-05")]
    attrs = spark.createDataFrame([(1, "gpu"), (2, "gpu")], "k long, name string")
    assert rows(timeline.duration_by_attribute(durations, attrs, "k", "name")) == [("gpu", 3.0, 1)]


def test_churn(spark):
    df = spark.createDataFrame([(1, i, i) for i in range(7)] + [(2, i, i) for i in range(5)], S)
    busy = timeline.churn_keys(df, "k", 5)
    assert rows(busy) == [(1, 7)]
    assert timeline.rows_of(df, busy, "k").count() == 7


def test_zero_counts(spark):
    dense = spark.createDataFrame([(1, None, 1), (1, 0, 2), (1, 3, 3), (2, None, 1)], S)
    assert rows(timeline.zero_counts(dense, "k", "v")) == [(1, 3, 1, True, 1), (2, 1, 0, False, 0)]


def fold(values, maxlen):
    queue = []
    for v in values:
        if v not in queue:
            queue.append(v)
            if len(queue) > maxlen:
                queue.pop(0)
    return queue


def test_recent_distinct(spark):
    rnd = random.Random(5)
    seqs = {"x": list("abaca"), **{f"r{i}": [rnd.choice("abcde") for _ in range(40)] for i in range(5)}}
    data = [(k, v, t) for k, s in seqs.items() for t, v in enumerate(s)]
    df = spark.createDataFrame(data, "k string, v string, ts long")
    for hot in (5_000_000, 6):
        got = {r.k: list(r.recent) for r in recent_distinct(df, "k", "v", ["ts"], 2, hot_rows=hot).collect()}
        assert got == {k: fold(s, 2) for k, s in seqs.items()}
    assert fold(seqs["x"], 2) == ["c", "a"]


def test_recent_distinct_of_cut_keys(spark):
    """Null and numeric keys, values that come back, queues that remember their start."""
    rnd = random.Random(11)
    seqs = {
        1: [rnd.randrange(9) for _ in range(300)],
        2: [i // 40 for i in range(200)],
        3: [7] * 50 + [8] * 50,
        4: [i % 4 for i in range(160)],
        None: [rnd.choice([None, 1, 2, 3]) for _ in range(90)],
        2**60: [1, 2, 3],
    }
    data = [(k, v, t) for k, s in seqs.items() for t, v in enumerate(s)]
    df = spark.createDataFrame(data, "k long, v long, ts long")
    for maxlen in (1, 3):
        want = {k: fold(s, maxlen) for k, s in seqs.items()}
        for limit in (5_000_000, 20):
            got = {r.k: list(r.recent) for r in recent_distinct(df, "k", "v", ["ts"], maxlen, hot_rows=limit).collect()}
            assert got == want


def test_recent_distinct_in_pieces(spark):
    """Pieces of a few rows within segments and without; starts that matter for long are followed one by one."""
    rnd = random.Random(12)
    seqs = {
        "random": [rnd.randrange(8) for _ in range(45)],
        "slow": [x for i in range(15) for x in (i // 3, i // 3 + 1, i // 3)],
        "cycle": [i % 5 for i in range(40)],
        None: [rnd.choice([None, 1, 2, 3, 4]) for _ in range(30)],
        "short": [1, 2, 3, 4, 1],
    }
    df = spark.createDataFrame([(k, v, t) for k, s in seqs.items() for t, v in enumerate(s)], "k string, v long, ts long")
    want = {k: fold(s, 3) for k, s in seqs.items()}
    for options in ({"piece_rows": 12, "guesses": 1}, {"piece_rows": 6, "hot_rows": 35}):
        found = recent_distinct(df, "k", "v", ["ts"], 3, **options)
        assert {r.k: list(r.recent) for r in found.collect()} == want


def test_recent_distinct_stays_in_the_engine(spark):
    df = spark.createDataFrame([(1, 2, 3)], "k long, v long, ts long")
    plans = [recent_distinct(df, "k", "v", ["ts"], 2, **o)._jdf.queryExecution().toString() for o in ({}, {"hot_rows": 0})]
    assert all("Arrow" not in p and "Python" not in p for p in plans)
    none = recent_distinct(df.limit(0), "k", "v", ["ts"], 2)
    assert none.count() == 0 and [f.name for f in none.schema] == ["k", "recent"]


# ---- hot keys ---------------------------------------------------------------------------
@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; there is a null key and there are ties in time."""
    rnd = random.Random(7)
    data = []
    for i in range(600):
        k = 1 if rnd.random() < 0.7 else rnd.choice([None, 2, 3, 4])
        data.append((k, rnd.randrange(0, 5000), i, rnd.choice([None, 1, 2, 3])))
    return spark.createDataFrame(data, "k long, ts long, tie long, v long").persist()


def test_hot_keys_are_bounded(skewed):
    found = hot_keys(skewed, ["k"], "ts", hot_rows=50)
    big = skewed.groupBy("k").count().filter("count > 50")
    assert rows(found.levels[0], "_hot_k") == rows(big, "k") and rows(big.filter("k = 1"), "k") == [(1,)]
    assert hot_keys(skewed, ["k"], "ts").levels == ()
    top = hot_keys(skewed, ["k"], "ts", hot_rows=1, max_hot=1)
    assert [r["_hot_k"] for r in top.levels[0].collect()] == [1]


def test_neighbours_of_cut_keys(skewed):
    order = ["ts", "tie"]
    args = dict(key=["k"], order=order, prev=["v", "ts"], next=["v", "tie"])
    plain = with_neighbours(skewed, **args)
    for limit in (200, 40, 3):
        cut = with_neighbours(skewed, hot_rows=limit, **args)
        assert "_segment" in cut._jdf.queryExecution().analyzed().toString()
        assert sorted(map(str, cut.collect())) == sorted(map(str, plain.collect()))


def test_fill_of_cut_keys(skewed):
    order = ["ts", "tie"]
    plain = with_last_known(skewed, ["k"], order, ["v"])
    for limit in (200, 40, 3):
        cut = with_last_known(skewed, ["k"], order, ["v"], hot_rows=limit)
        assert sorted(map(str, cut.collect())) == sorted(map(str, plain.collect()))


def test_cut_windows_are_spread(spark):
    """The largest window group of a hot key stays near the limit."""
    df = spark.range(10_000).select(F.lit(1).alias("k"), F.col("id").alias("ts"))
    hot = hot_keys(df, ["k"], "ts", hot_rows=500).levels[0].first()
    groups = df.groupBy(F.floor((F.col("ts") - hot["_from"]) / hot["_width"])).count()
    assert groups.count() == 20 and groups.agg(F.max("count")).first()[0] == 500


def test_bursts_are_cut_again(spark):
    """Nine tenths of a key's rows fall into a hundredth of its time."""
    ts = F.when(F.col("id") < 9000, 500_000 + F.col("id")).otherwise((F.col("id") - 9000) * 1000)
    df = spark.range(10_000).select(F.lit(1).alias("k"), ts.alias("ts"), (F.col("id") % 3).alias("v"))
    hot = hot_keys(df, ["k"], "ts", hot_rows=500)
    assert len(hot.levels) > 1
    groups = cut_segments(df, hot, ["k"], "ts", "left").groupBy("_segment").count()
    assert groups.agg(F.max("count")).first()[0] <= 1000
    args = dict(key=["k"], order=["ts"], prev=["v"], next=["ts"])
    plain, cut = with_neighbours(df, **args), with_neighbours(df, hot=hot, **args)
    assert sorted(map(str, cut.collect())) == sorted(map(str, plain.collect()))


def test_rows_of_one_second_stay_together(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), (F.floor(F.col("id") / 900) * 5).alias("ts"), F.col("id").alias("tie"))
    plain = with_neighbours(df, ["k"], ["ts", "tie"], prev=["tie"])
    cut = with_neighbours(df, ["k"], ["ts", "tie"], prev=["tie"], hot_rows=50)
    assert sorted(map(str, cut.collect())) == sorted(map(str, plain.collect()))
