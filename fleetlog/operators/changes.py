"""Change capture: distinct index, first-wins map, change log, snapshot.

Each operator takes a whole history or one increment. Given the state left by
earlier increments, an increment yields exactly the rows a run over the whole
history would yield for that stretch.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlog.operators.sequence import HOT_ROWS, HotKeys, hot_keys, null_safe_on, with_neighbours


def match_keys(df: DataFrame, key: Sequence[str], how: str, other: DataFrame) -> DataFrame:
    """Semi or anti join on the key, null-safely."""
    other = other.select(*[F.col(k).alias(f"_o_{k}") for k in key])
    on = null_safe_on([df[k] for k in key], [other[f"_o_{k}"] for k in key])
    return df.join(other, on, how)


def distinct_index(df: DataFrame, col: str, known: DataFrame | None = None) -> DataFrame:
    """Distinct values of a column, without those already known."""
    values = df.select(col).distinct()
    return values if known is None else match_keys(values, [col], "left_anti", known)


def first_wins_map(
    df: DataFrame, key: str, value: str, order: Sequence[str], known: DataFrame | None = None
) -> DataFrame:
    """First value seen per key; later values never replace it."""
    if known is not None:
        df = match_keys(df, [key], "left_anti", known)
    return df.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))


def first_seen_rows(
    df: DataFrame, key: str, cols: Sequence[str], ts: str, known: DataFrame | None = None
) -> DataFrame:
    """Rows of the poll in which a key first appears (all of them, if several)."""
    if known is not None:
        df = match_keys(df, [key], "left_anti", known)
    first = df.groupBy(key).agg(F.min(ts).alias("_ts")).withColumnRenamed(key, "_key")
    on = df[key].eqNullSafe(first["_key"]) & df[ts].eqNullSafe(first["_ts"])
    return df.join(first, on, "left_semi").select(key, *cols, ts)


def change_log(
    df: DataFrame,
    key: Sequence[str],
    cols: Sequence[str],
    order: Sequence[str],
    state: DataFrame | None = None,
    keep: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Rows whose values differ from the key's values before them.

    The first row of a key counts as changed. Values are compared null-safely.
    order is the time column followed by tie-breakers. With state (key and value
    columns, one row per key) the first row of each key is compared to it.
    """
    src = df.select(*dict.fromkeys([*key, *cols, *order, *keep]))
    changed = ~F.struct(*cols).eqNullSafe(F.col("_prev"))
    hot = hot or hot_keys(src, key, order[0], hot_rows)
    if state is not None and not hot.levels:
        # the state takes part as the row before all others: one window, no join
        others = [c for c in src.columns if c not in (*key, *cols)]
        before = state.select(*key, *cols, *[F.lit(None).cast(src.schema[c].dataType).alias(c) for c in others], F.lit(True).alias("_old"))
        both = src.withColumn("_old", F.lit(False)).unionByName(before)
        window = Window.partitionBy(*key).orderBy(F.desc("_old"), *order)
        seq = both.withColumn("_prev", F.lag(F.struct(*cols)).over(window)).filter("not _old").drop("_old")
        return seq.filter(changed).select(*dict.fromkeys([*key, *cols, order[0], *keep]))
    seq = with_neighbours(src, key, order, prev=cols, hot_rows=hot_rows, hot=hot)
    if state is not None:
        seen = state.select(
            *[F.col(k).alias(f"_s_{k}") for k in key], F.struct(*cols).alias("_state")
        )
        on = null_safe_on([seq[k] for k in key], [seen[f"_s_{k}"] for k in key])
        seq = seq.join(seen, on, "left").withColumn("_prev", F.coalesce("_prev", "_state"))
    return seq.filter(changed).select(*dict.fromkeys([*key, *cols, order[0], *keep]))


def changed_in_poll(
    poll: DataFrame, key: Sequence[str], cols: Sequence[str], state: DataFrame
) -> DataFrame:
    """Rows of a single poll that are not in the snapshot, null-safely."""
    names = [*key, *cols]
    known = state.select(*[F.col(c).alias(f"_s_{c}") for c in names])
    return poll.join(
        known, null_safe_on([poll[c] for c in names], [known[f"_s_{c}"] for c in names]),
        "left_anti",
    )


def latest_snapshot(
    df: DataFrame, key: Sequence[str], cols: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Last values per key. Combined map-side before the shuffle, after a sort by key in each task."""
    last = df.groupBy(*key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_row"))
    return last.select(*key, *[F.col("_row")[c].alias(c) for c in cols])


def upsert(state: DataFrame, changed: DataFrame, key: Sequence[str]) -> DataFrame:
    """State with the rows of changed (one per key) put in place; one aggregation by key."""
    others = [c for c in state.columns if c not in key]
    both = state.select("*", F.lit(0).alias("_new")).unionByName(changed.select(*state.columns, F.lit(1).alias("_new")))
    last = both.groupBy(*key).agg(F.max_by(F.struct(*others), "_new").alias("_row"))
    return last.select(*[F.col("_row")[c].alias(c) if c in others else F.col(c) for c in state.columns])


def child_set_snapshot(
    state: DataFrame, poll: DataFrame, parent: str, child: str
) -> DataFrame:
    """Replace-by-parent snapshot of child rows.

    Children that vanished from a parent present in the poll are removed; children
    are added only to parents that have none left.

    A child the poll lists stays, any other one stays if its parent is not in the poll.
    The rows of a side are matched with the distinct keys of the other, so that no task
    orders keys that repeat.
    """
    children, parents = poll.select(child).distinct(), poll.select(parent).distinct()
    listed = match_keys(state, [child], "left_semi", children)
    missing = match_keys(state, [child], "left_anti", children)
    kept = listed.unionByName(match_keys(missing, [parent], "left_anti", parents))
    # of parents in the poll, those with a listed child are the ones that have some left
    added = match_keys(poll, [parent], "left_anti", listed.select(parent).distinct()).select(*state.columns)
    return kept.unionByName(added)


def change_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table plus a total row."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    both = reduce(DataFrame.unionByName, counted).rollup("table_name").agg(
        F.sum("n_rows").alias("n_rows")
    )
    return both.select(F.coalesce("table_name", F.lit("total")).alias("table_name"), "n_rows")
