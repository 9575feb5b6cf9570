"""Child sets replaced by parent: a whole history against a poll-by-poll replay."""

import random

import pytest
from helpers import rows

from fleetlog.operators import children

COLUMNS = "p long, c long, v string, t long"


def replay(history):
    """The replace-by-parent rules, one poll at a time, with plain dictionaries."""
    snapshot, log = {}, []
    for t in sorted({r[3] for r in history}):
        poll = [r for r in history if r[3] == t]
        for p, c, v, _ in poll:
            if (c, v) not in snapshot.get(p, {}).items():
                log.append((p, c, v, t))
        for p in {r[0] for r in poll}:
            listed = {c: v for q, c, v, _ in poll if q == p}
            left = {c: v for c, v in snapshot.get(p, {}).items() if c in listed}
            snapshot[p] = left or listed
    state = [(p, c, v) for p, held in snapshot.items() for c, v in held.items()]
    key = lambda r: [(x is not None, x) for x in r]
    return sorted(log, key=key), sorted(state, key=key)


def listing(seed, polls=40, parents=5, kids=6):
    rng = random.Random(seed)
    out = []
    for t in range(100, 100 + polls):
        for p in range(parents):
            if rng.random() < 0.7:
                out += [(p, p * 100 + c, rng.choice(["a", "a", "a", "b", None]), t) for c in range(kids) if rng.random() < 0.75]
    return out


@pytest.mark.parametrize("fold_polls", [2000, 10, 0])
def test_history_is_the_replay(spark, fold_polls):
    """Parents with more polls than fit into a row are followed by doubling."""
    for seed in range(3):
        history = listing(seed)
        log, state = children.child_sets(spark.createDataFrame(history, COLUMNS), "p", "c", ["v"], "t", fold_polls)
        want_log, want_state = replay(history)
        assert rows(log) == want_log
        assert rows(state) == want_state
        assert len(log.columns) == 4 and log.count() < len(history)


def test_partly_kept_parent_gains_nothing(spark):
    history = [(1, 10, "x", 1), (1, 11, "x", 1), (1, 11, "x", 2), (1, 12, "x", 2), (1, 12, "x", 3), (1, 12, "x", 4)]
    log, state = children.child_sets(spark.createDataFrame(history, COLUMNS), "p", "c", ["v"], "t")
    # 12 is logged while the snapshot lacks it: in poll 2 beside 11, and in poll 3, which replaces the snapshot
    assert rows(log) == [(1, 10, "x", 1), (1, 11, "x", 1), (1, 12, "x", 2), (1, 12, "x", 3)]
    assert rows(state) == [(1, 12, "x")]


def test_steps_are_the_history(spark):
    """The incremental form, poll by poll, leaves what the whole history gives."""
    history = listing(7, polls=5, parents=3, kids=4)
    state = spark.createDataFrame([], "p long, c long, v string")
    logged = []
    for t in sorted({r[3] for r in history}):
        poll = spark.createDataFrame([r[:3] for r in history if r[3] == t], "p long, c long, v string")
        new, after = children.child_set_step(state, poll, "p", "c", ["v"])
        logged += [(*r, t) for r in rows(new)]
        state = spark.createDataFrame(rows(after), "p long, c long, v string")
    want_log, want_state = replay(history)
    assert sorted(map(str, logged)) == sorted(map(str, want_log))
    assert rows(state) == want_state


def test_rows_without_a_parent_or_child(spark):
    log, state = children.child_sets(spark.createDataFrame([(None, 1, "a", 1), (1, None, "a", 1), (1, 2, "a", 1)], COLUMNS), "p", "c", ["v"], "t")
    assert rows(log) == [(1, 2, "a", 1)] and rows(state) == [(1, 2, "a")]
    none = spark.createDataFrame([], COLUMNS)
    log, state = children.child_sets(none, "p", "c", ["v"], "t")
    assert log.count() == 0 and state.count() == 0
