"""Operators on change logs seen as step functions of time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlog.functions.numeric import day_number, epoch_to_date
from fleetlog.operators.changes import change_log
from fleetlog.operators.polls import poll_index, poll_neighbours, polls_before
from fleetlog.operators.sequence import HOT_ROWS, HotKeys, hot_keys, with_last_known, with_neighbours


def drop_consecutives(
    df: DataFrame, key: Sequence[str], cols: Sequence[str], order: Sequence[str],
    hot_rows: int = HOT_ROWS, hot: HotKeys | None = None,
) -> DataFrame:
    """Rows where any of cols differs from the key's previous row; all columns stay."""
    return change_log(df, key, cols, order, keep=df.columns, hot_rows=hot_rows, hot=hot).select(*df.columns)


def staircase(
    df: DataFrame, key: str, col: str, order: Sequence[str], hot_rows: int = HOT_ROWS,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Points of the step plot: each row, and the old value one second before it."""
    ts = order[0]
    seq = with_neighbours(
        df.select(*dict.fromkeys([key, col, *order])), [key], order, prev=[col], hot_rows=hot_rows, hot=hot
    )
    here = F.struct(F.col(col).alias(col), F.col(ts).alias(ts))
    before = F.struct(F.col(f"_prev.{col}").alias(col), (F.col(ts) - 1).alias(ts))
    points = F.when(F.col("_prev").isNull(), F.array(here)).otherwise(F.array(before, here))
    return seq.select(key, F.inline(points))


def value_intervals(
    log: DataFrame, key: str, cols: Sequence[str], ts: str, hot_rows: int = HOT_ROWS,
    hot: HotKeys | None = None,
) -> DataFrame:
    """[ts, next_ts) stretches in which a key's values hold; the last one is open (null)."""
    seq = with_neighbours(log.select(key, *cols, ts), [key], [ts], next=[ts], hot_rows=hot_rows, hot=hot)
    return seq.select(key, *cols, ts, F.col(f"_next.{ts}").alias("next_ts"))


def _at_polls(intervals: DataFrame, polls: DataFrame, ts: str) -> DataFrame:
    """One row per interval [_from, _to) and poll inside it.

    Intervals are laid out over the days they touch, so that the range condition
    becomes an equi-join on the day. The poll index is small (at most one row per
    second); the intervals may be many per day, which adaptive execution splits.
    """
    days = F.sequence(day_number(F.col("_from")), day_number(F.col("_to") - 1))
    laid = intervals.filter(F.col("_from") < F.col("_to")).select("*", F.explode(days).alias("_day"))
    by_day = polls.select(F.col(ts).alias("_poll"), day_number(F.col(ts)).alias("_poll_day"))
    inside = (
        (laid["_day"] == by_day["_poll_day"])
        & (by_day["_poll"] >= laid["_from"])
        & (by_day["_poll"] < laid["_to"])
    )
    return laid.join(by_day, inside).drop("_day", "_poll_day", "_from", "_to").withColumnRenamed(
        "_poll", ts
    )


def densify(
    log: DataFrame,
    key: str,
    cols: Sequence[str],
    polls: DataFrame,
    ts: str = "timestamp",
    hot_rows: int = HOT_ROWS, hot: HotKeys | None = None,
) -> DataFrame:
    """Values of every key at every poll; null before the key's first row.

    The log has at most one row per key and time.
    """
    end = (polls.agg(F.max(ts)).scalar() + 1).alias("_to")
    start = polls.agg(F.min(ts)).scalar().alias("_from")
    known = value_intervals(log, key, cols, ts, hot_rows, hot).select(
        key, *cols, F.col(ts).alias("_from"), F.coalesce("next_ts", end).alias("_to")
    )
    unknown = log.groupBy(key).agg(F.min(ts).alias("_to")).select(
        key,
        *[F.lit(None).cast(log.schema[c].dataType).alias(c) for c in cols],
        start,
        "_to",
    )
    return _at_polls(known.unionByName(unknown), polls, ts).select(key, *cols, ts)


def densify_wide(dense: DataFrame, key: str, col: str, keys: Sequence, ts: str = "timestamp") -> DataFrame:
    """Matrix form of densify for a chosen list of keys: one column per key."""
    return dense.groupBy(ts).pivot(key, list(keys)).agg(F.first(col, ignorenulls=True))


def _hot_of(logs: dict[str, DataFrame], key: str, ts: str, hot_rows: int) -> HotKeys:
    rows = reduce(DataFrame.union, [df.select(key, ts) for df in logs.values()])
    return hot_keys(rows, [key], ts, hot_rows)


def align_changes(
    logs: dict[str, DataFrame], key: str, ts: str = "timestamp", hot_rows: int = HOT_ROWS,
    hot: HotKeys | None = None,
) -> DataFrame:
    """State of several logs at every time one of them changes.

    logs maps a value column to a log (key, value, ts) with at most one row per key
    and time.
    """
    types = {c: df.schema[c].dataType for c, df in logs.items()}
    parts = [
        df.select(key, ts, *[(F.col(c) if c == own else F.lit(None).cast(types[c])).alias(c) for c in types])
        for own, df in logs.items()
    ]
    merged = reduce(DataFrame.unionByName, parts).groupBy(key, ts).agg(
        *[F.max(c).alias(c) for c in types]
    )
    hot = hot or _hot_of(logs, key, ts, hot_rows)
    return with_last_known(merged, [key], [ts], list(types), hot_rows=hot_rows, hot=hot)


def asof_align(
    logs: dict[str, DataFrame], key: str, polls: DataFrame, ts: str = "timestamp",
    hot_rows: int = HOT_ROWS, hot: HotKeys | None = None,
) -> DataFrame:
    """Last known value of each log per key and poll, from the key's first change on."""
    hot = hot or _hot_of(logs, key, ts, hot_rows)
    aligned = align_changes(logs, key, ts, hot_rows, hot)
    return densify(aligned, key, list(logs), polls, ts, hot_rows, hot).filter(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in logs]))


def asof_align_distinct(
    logs: dict[str, DataFrame], key: str, required: str, ts: str = "timestamp",
    hot_rows: int = HOT_ROWS, hot: HotKeys | None = None,
) -> DataFrame:
    """First time at which each key shows each combination of values.

    Rows before the first known value of ``required`` are left out. Combinations
    change only where a log changes, so no poll grid is needed.
    """
    aligned = align_changes(logs, key, ts, hot_rows, hot).filter(F.col(required).isNotNull())
    return aligned.groupBy(key, *logs).agg(F.min(ts).alias(ts))


def union_index(frames: Sequence[DataFrame], ts: str = "timestamp") -> DataFrame:
    """Set union of the times of several logs."""
    return reduce(DataFrame.union, [df.select(ts).distinct() for df in frames]).distinct()


def poll_gaps(polls: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Seconds between each poll and the one before it."""
    return poll_neighbours(polls, ts).filter("prev_ts is not null").select(
        ts, "prev_ts", (F.col(ts) - F.col("prev_ts")).alias("gap")
    )


def interval_stats(polls: DataFrame, ts: str = "timestamp") -> DataFrame:
    """count, mean, std, min, quartiles and max of the poll gaps.

    Gaps are whole seconds, so the exact percentile's map of distinct values stays
    small however many polls there are.
    """
    quartiles = F.percentile("gap", [0.25, 0.5, 0.75])
    return poll_gaps(polls, ts).agg(
        F.count("gap").alias("n"),
        F.round(F.avg("gap"), 6).alias("mean"),
        F.round(F.stddev_samp("gap"), 6).alias("std"),
        F.min("gap").alias("min"),
        F.max("gap").alias("max"),
        quartiles.alias("_q"),
    ).select(
        "n", "mean", "std", "min",
        *[F.col("_q")[i].alias(name) for i, name in enumerate(["p25", "p50", "p75"])],
        "max",
    )


def interval_mode(polls: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Most frequent gap; the smallest one on ties."""
    counts = poll_gaps(polls, ts).groupBy("gap").agg(F.count(F.lit(1)).alias("n"))
    best = counts.agg(F.max(F.struct(F.col("n"), (-F.col("gap")).alias("neg"))).alias("_m"))
    return best.select((-F.col("_m.neg")).alias("gap"), F.col("_m.n").alias("n"))


def interval_histogram(
    polls: DataFrame, limit: int, bins: int, ts: str = "timestamp"
) -> DataFrame:
    """Counts of gaps below limit in equal bins over [0, limit)."""
    number = F.floor(F.col("gap") * F.lit(bins) / F.lit(limit)).cast("long")
    return (
        poll_gaps(polls, ts).filter(F.col("gap") < limit)
        .groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    )


def gap_intervals(polls: DataFrame, longer_than: int = 300, ts: str = "timestamp") -> DataFrame:
    """Stretches without polls: [previous + 1, next - 1]."""
    return poll_gaps(polls, ts).filter(F.col("gap") > longer_than).select(
        (F.col("prev_ts") + 1).alias("gap_start"), (F.col(ts) - 1).alias("gap_end")
    )


def gap_null_rows(
    polls: DataFrame, col: str, longer_than: int = 300, ts: str = "timestamp"
) -> DataFrame:
    """A row with a null value at each poll next to a gap; breaks plotted lines."""
    edges = poll_gaps(polls, ts).filter(F.col("gap") > longer_than)
    return edges.select(F.explode(F.array("prev_ts", ts)).alias(ts)).distinct().select(
        F.lit(None).cast("long").alias(col), ts
    )


def transition_rows(
    log: DataFrame, key: str, state: str, order: Sequence[str], before=0, after=1,
    hot_rows: int = HOT_ROWS, hot: HotKeys | None = None,
) -> DataFrame:
    """Rows in state ``before`` followed by ``after``, and the rows that follow them.

    log holds no consecutive duplicates of the state.
    """
    seq = with_neighbours(log, [key], order, prev=[state], next=[state], hot_rows=hot_rows, hot=hot)
    leaves = (F.col(state) == before) & (F.col(f"_next.{state}") == after)
    arrives = (F.col(state) == after) & (F.col(f"_prev.{state}") == before)
    return seq.filter(leaves | arrives).drop("_prev", "_next")


def first_per_state(df: DataFrame, key: str, state: str, ts: str) -> DataFrame:
    """First time of each state per key."""
    return df.groupBy(key, state).agg(F.min(ts).alias(ts))


def transition_duration(transitions: DataFrame, key: str, ts: str) -> DataFrame:
    """Days between the dates of the first and the last transition row, and the last date."""
    span = transitions.groupBy(key).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    return span.select(
        key,
        (day_number(F.col("_b")) - day_number(F.col("_a"))).alias("duration_days"),
        epoch_to_date(F.col("_b")).alias("last_date"),
    )


def duration_by_attribute(
    durations: DataFrame, attributes: DataFrame, key: str, attribute: str
) -> DataFrame:
    """Mean duration per attribute value; attributes has one row per key."""
    return durations.join(attributes.select(key, attribute), key).groupBy(attribute).agg(
        F.round(F.avg("duration_days"), 6).alias("mean_days"), F.count(F.lit(1)).alias("n")
    )


def churn_keys(log: DataFrame, key: str, more_than: int = 5) -> DataFrame:
    """Keys with many changes, busiest first."""
    counts = log.groupBy(key).agg(F.count(F.lit(1)).alias("n_changes"))
    return counts.filter(F.col("n_changes") > more_than).orderBy(F.desc("n_changes"), key)


def rows_of(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_semi")


def first_row_per_key(df: DataFrame, key: str, cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    row = df.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_row"))
    return row.select(key, *[F.col("_row")[c].alias(c) for c in cols])


def last_row_per_key(df: DataFrame, key: str, cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    row = df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_row"))
    return row.select(key, *[F.col("_row")[c].alias(c) for c in cols])


def missing_times(left: DataFrame, right: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Times of one log at which the other has no row."""
    return poll_index(left, ts).join(poll_index(right, ts), ts, "left_anti")


def zero_counts(dense: DataFrame, key: str, col: str) -> DataFrame:
    """Per key: polls, zeros among the known values, and whether there is any."""
    return dense.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_polls"),
        F.count_if(F.col(col) == 0).alias("n_zero"),
        F.coalesce(F.bool_or(F.col(col) == 0), F.lit(False)).alias("any_zero"),
        F.count_if(F.coalesce(F.col(col), F.lit(0)) != 0).alias("n_nonzero"),
    )


def zero_counts_of_log(
    log: DataFrame, key: str, col: str, polls: DataFrame, ts: str = "timestamp",
    hot_rows: int = HOT_ROWS, hot: HotKeys | None = None,
) -> DataFrame:
    """The same from the log itself: a value counts for as many polls as its interval holds.

    No row is made per key and poll. The log has at most one row per key and time.
    """
    times = polls_before(log, polls, ts).withColumnRenamed(ts, "_at")
    total = poll_index(polls, ts).agg(F.count(F.lit(1)).alias("n")).scalar()
    # the count of the earlier polls travels with the row, so the next row's is at hand
    placed = log.select(key, col, ts).join(times, F.col(ts) == F.col("_at")).drop("_at")
    seq = with_neighbours(placed, [key], [ts], next=["polls_before"], hot_rows=hot_rows, hot=hot)
    held = F.coalesce(F.col("_next.polls_before"), F.col("_total")) - F.col("polls_before")
    seq = seq.withColumn("_total", total).withColumn("_polls", held)
    zeros = F.coalesce(F.sum(F.when(F.col(col) == 0, F.col("_polls"))), F.lit(0))
    return seq.groupBy(key).agg(
        F.max("_total").cast("long").alias("n_polls"),
        zeros.alias("n_zero"),
        (zeros > 0).alias("any_zero"),
        F.coalesce(F.sum(F.when(F.col(col) != 0, F.col("_polls"))), F.lit(0)).alias("n_nonzero"),
    )


def changes_per_day(log: DataFrame, ts: str = "timestamp") -> DataFrame:
    return log.groupBy(day_number(F.col(ts)).alias("day")).agg(F.count(F.lit(1)).alias("n_changes"))
