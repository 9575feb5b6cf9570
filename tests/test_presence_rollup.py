import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from fleetlog.operators import presence, rollup

S = "k long, ts long"
POLLS = [(1, 10), (2, 10), (1, 20), (1, 30), (1, 40), (2, 40), (3, 40)]


def test_presence(spark):
    log = presence.presence_log(spark.createDataFrame(POLLS, S), "k", "ts")
    assert rows(log) == [(1, 1, 10), (2, 0, 20), (2, 1, 10), (2, 1, 40), (3, 1, 40)]
    assert rows(presence.presence_state(log, "k", "ts")) == [(1, 1, 10), (2, 1, 40), (3, 1, 40)]


def replay(seen):
    """One poll after the other."""
    state, log = {}, []
    for ts in sorted({t for _, t in seen}):
        here = {k for k, t in seen if t == ts}
        for k in here:
            if state.get(k) != 1:
                log.append((k, 1, ts))
                state[k] = 1
        for k in set(state) - here:
            if state[k] != 0:
                log.append((k, 0, ts))
                state[k] = 0
    return sorted(log)


def random_sightings(seed):
    rnd = random.Random(seed)
    return [(k, ts) for ts in range(1, 40) for k in range(6) for _ in range(rnd.randrange(3)) if rnd.random() < 0.6]


@pytest.mark.parametrize("seed", range(3))
def test_presence_equals_replay(spark, seed):
    seen = random_sightings(seed)
    df = spark.createDataFrame(seen, S)
    assert rows(presence.presence_log(df, "k", "ts")) == replay(seen)
    assert rows(presence.presence_log(df, "k", "ts", hot_rows=5)) == replay(seen)


def test_presence_poll_by_poll(spark):
    seen = random_sightings(9)
    state = spark.createDataFrame([], "k long, online long, ts long")
    registry, log = [], []
    for ts in sorted({t for _, t in seen})[:6]:
        poll = spark.createDataFrame([r for r in seen if r[1] == ts], S)
        registry = sorted({*registry, *[k for k, t in seen if t == ts]})
        known = spark.createDataFrame([(k,) for k in registry], "k long")
        new = rows(presence.presence_in_poll(poll, known, state, "k", "ts"))
        log += new
        state = spark.createDataFrame(rows(presence.presence_state(spark.createDataFrame(log, "k long, online long, ts long"), "k", "ts")), "k long, online long, ts long")
    cut = sorted({t for _, t in seen})[5]
    assert sorted(log) == [e for e in replay(seen) if e[2] <= cut]
    # an empty poll leaves everybody as they are
    empty = spark.createDataFrame([], S)
    assert rows(presence.presence_in_poll(empty, known, state, "k", "ts")) == []


def test_period_avg_std(spark):
    df = spark.createDataFrame([(1, 3, 10), (1, 0, 86400), (1, 2, 86401), (1, 4, 172801)], "k long, x long, ts long")
    assert rows(rollup.period_avg_std(df, "k", ["x"], "ts")) == [(1, 2, 0.0, 172800), (1, 2, 1.5, 86400)]
    with_open = rollup.period_avg_std(df, "k", ["x"], "ts", include_open=True)
    assert (1, 4, 0.0, 259200) in rows(with_open)


def test_daily_resample(spark):
    df = spark.createDataFrame([(1, 10, 0), (1, 13, 86399), (1, 7, 86400)], "k long, x long, ts long")
    # mean 11.5 rounds to even 12, sample deviation 2.12 is cut to 2
    assert rows(rollup.daily_resample(df, "k", ["x"], "ts")) == [(1, 0, 12, 2), (1, 1, 7, 0)]


def test_rollup_shuffles_once(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("x"), (F.col("id") * 977).alias("ts"))
    plan = rollup.period_avg_std(df, "k", ["x"], "ts", include_open=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_avg" in plan
