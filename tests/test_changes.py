import random

from helpers import rows

from fleetlog.operators import changes


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_distinct_index(spark):
    s = "id long, ts long"
    known = frame(spark, [], s).select("ts")
    for poll, want in [([(1, 16), (2, 16)], [(16,)]), ([(3, 16)], [(16,)]), ([(1, 32), (2, 32)], [(16,), (32,)])]:
        fresh = changes.distinct_index(frame(spark, poll, s), "ts", known)
        known = known.union(fresh)
        assert rows(known) == want


def test_first_wins(spark):
    s = "id long, machine long, ts long"
    first = changes.first_wins_map(frame(spark, [(1, 1, 1), (2, 1, 1), (1, 2, 2)], s), "id", "machine", ["ts"])
    assert rows(first) == [(1, 1), (2, 1)]
    later = changes.first_wins_map(frame(spark, [(1, 9, 3), (3, 4, 3)], s), "id", "machine", ["ts"], first)
    assert rows(later) == [(3, 4)]


def test_first_seen_rows(spark):
    s = "id long, col1 long, ts long"
    target = frame(spark, [(1, 1, 16), (2, 3, 16)], s)
    step = lambda poll: rows(changes.first_seen_rows(frame(spark, poll, s), "id", ["col1"], "ts", target))
    assert rows(changes.first_seen_rows(target, "id", ["col1"], "ts")) == [(1, 1, 16), (2, 3, 16)]
    assert step([(2, 3, 18)]) == []
    assert step([(1, 1, 22), (3, 4, 22)]) == [(3, 4, 22)]
    assert step([(3, 1, 22), (4, 1, 22)]) == [(3, 1, 22), (4, 1, 22)]
    # no key constraint: two rows of a new key in one poll both stay
    assert step([(5, 1, 22), (5, 2, 22), (5, 3, 30)]) == [(5, 1, 22), (5, 2, 22)]


HISTORY = [(1, "a", 10), (2, "b", 10), (1, "a", 20), (2, "c", 20), (2, "c", 30), (1, "a", 40), (2, "c", 40)]


def test_change_log_and_snapshot(spark):
    df = frame(spark, HISTORY, "k long, v string, ts long")
    assert rows(changes.change_log(df, ["k"], ["v"], ["ts"])) == [(1, "a", 10), (2, "b", 10), (2, "c", 20)]
    assert rows(changes.latest_snapshot(df, ["k"], ["v"], ["ts"])) == [(1, "a"), (2, "c")]


def test_change_log_counts_null_switches(spark):
    df = frame(spark, [(1, None, 10), (1, 7, 20), (1, None, 30), (1, None, 40)], "k long, v long, ts long")
    assert [r[2] for r in sorted(changes.change_log(df, ["k"], ["v"], ["ts"]).collect(), key=lambda r: r[2])] == [10, 20, 30]


def random_history(seed, keys=7, polls=30):
    rnd = random.Random(seed)
    out = []
    for ts in range(10, 10 * polls + 1, 10):
        for k in range(keys):
            if rnd.random() < 0.7:
                out.append((k, rnd.choice(["a", "b", None]), rnd.randrange(2), ts))
    return out


def replay(history):
    """Poll by poll, as the tables are defined."""
    state, log = {}, []
    for ts in sorted({r[3] for r in history}):
        for k, v, w, t in history:
            if t == ts and state.get(k, "new") != (v, w):
                log.append((k, v, w, t))
                state[k] = (v, w)
    return log, state


def test_history_increments_and_replay_agree(spark):
    s = "k long, v string, w long, ts long"
    for seed in range(3):
        history = random_history(seed)
        log, state = replay(history)
        df = frame(spark, history, s)
        order = lambda xs: sorted(xs, key=str)
        got = [tuple(r) for r in changes.change_log(df, ["k"], ["v", "w"], ["ts"]).collect()]
        assert order(got) == order(log)
        # hot keys cut into segments give the same log
        cut = [tuple(r) for r in changes.change_log(df, ["k"], ["v", "w"], ["ts"], hot_rows=4).collect()]
        assert order(cut) == order(log)
        snap = {r.k: (r.v, r.w) for r in changes.latest_snapshot(df, ["k"], ["v", "w"], ["ts"]).collect()}
        assert snap == state
        early, late = df.filter("ts <= 120"), df.filter("ts > 120")
        old = changes.latest_snapshot(early, ["k"], ["v", "w"], ["ts"])
        both = changes.change_log(early, ["k"], ["v", "w"], ["ts"]).union(
            changes.change_log(late, ["k"], ["v", "w"], ["ts"], old)
        )
        assert order(tuple(r) for r in both.collect()) == order(log)


def test_single_poll_step(spark):
    s = "k long, v string"
    state = frame(spark, [(1, "a"), (2, None)], s)
    poll = frame(spark, [(1, "a"), (2, None), (3, "x"), (1, "b")], s)
    changed = changes.changed_in_poll(poll, ["k"], ["v"], state)
    assert rows(changed) == [(1, "b"), (3, "x")]
    assert rows(changes.upsert(state, changed, ["k"])) == [(1, "b"), (2, None), (3, "x")]


def test_child_set_snapshot(spark):
    s = "machine long, id long"
    snap = frame(spark, [(9, 1), (9, 2), (8, 5)], s)
    poll = frame(spark, [(9, 2), (9, 3), (7, 6)], s)
    assert rows(changes.child_set_snapshot(snap, poll, "machine", "id")) == [(7, 6), (8, 5), (9, 2)]
    # no child survives: the poll's children are taken over
    gone = frame(spark, [(9, 3), (9, 4)], s)
    assert rows(changes.child_set_snapshot(snap, gone, "machine", "id")) == [(8, 5), (9, 3), (9, 4)]


def test_child_set_snapshot_with_nulls_and_repeats(spark):
    """Rows may repeat and keys may be null; a null parent or child is one like any other."""
    rng, s = random.Random(5), "machine long, id long"
    for n in (0, 4, 12, 40):
        some = lambda: [(rng.choice([None, *range(6)]), rng.choice([None, *range(9)])) for _ in range(n)]
        snap, poll = some(), some()
        parents, listed = {p for p, _ in poll}, {c for _, c in poll}
        kept = [r for r in snap if r[0] not in parents or r[1] in listed]
        want = kept + [r for r in poll if r[0] not in {p for p, _ in kept}]
        got = rows(changes.child_set_snapshot(frame(spark, snap, s), frame(spark, poll, s), "machine", "id"))
        assert got == sorted(want, key=lambda r: [(x is not None, x) for x in r])


def test_plan_of_a_child_set_snapshot(spark):
    """Every join sees the keys of its other side once, not once per row: that side is what tasks hold and order."""
    s = "machine long, id long"
    snap, poll = frame(spark, [(9, 1), (8, 5)], s), frame(spark, [(9, 2), (7, 6)], s)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = changes.child_set_snapshot(snap, poll, "machine", "id")._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = plan[plan.index("== Physical Plan =="):]
    assert plan.count("SortMergeJoin") == 5
    assert plan.count("HashAggregate") == 2 * 5  # distinct within tasks, then by key


def test_change_counts(spark):
    a = frame(spark, [(1,), (2,)], "x long")
    got = rows(changes.change_counts({"a": a, "b": a.filter("x > 5")}))
    assert got == [("a", 2), ("b", 0), ("total", 2)]


def test_plan_of_an_increment(spark, sf_dir):
    """The state joins the window's one shuffle, and the time filter reaches the files."""
    from fleetlog.plans.catalog import QUERIES

    plan = QUERIES["change_log_incremental"](spark, sf_dir)._jdf.queryExecution().toString()
    plan = plan[plan.index("== Physical Plan =="):]
    assert "Join" not in plan
    assert plan.count("Exchange hashpartitioning") == 2  # the state's own and the window's
    assert "GreaterThanOrEqual(ts," in plan and "LessThan(ts," in plan
