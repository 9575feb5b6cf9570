"""Previous, next and last-known values per key, without one task per hot key.

A window over ``partitionBy(key)`` puts all rows of a key into one task. Where a
key may hold a large share of the data that task never ends. ``hot_keys`` therefore
counts the rows per key in one pass over key and time only (map-side combined). If no
key is too large for a task, and only then, the plain window is used. Otherwise the
time-lines of the hot keys are cut into segments, the window runs per (key, segment),
still with a single shuffle of the rows, and the edge rows of the segments are handed
on by a join.

Segments have equal widths in time; those that a burst of rows still makes too large
are counted and cut again, until none is. At most MAX_HOT keys, and per round MAX_HOT
bursts, are cut into at most 2 * MAX_HOT segments; what lies beyond holds under
1/MAX_HOT of the rows each. The side tables thus have a fixed bound and can be broadcast
however large the data is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_ROWS = 5_000_000
MAX_HOT = 100_000

SEGMENT = "_segment"


def null_safe_on(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """left <=> right over all pairs."""
    cond = F.lit(True)
    for a, b in zip(left, right):
        cond = cond & a.eqNullSafe(b)
    return cond


@dataclass(frozen=True)
class HotKeys:
    """How hot keys are cut: start and width per hot key, then per burst, and so on.

    Empty if there is nothing to cut.
    """

    levels: tuple[DataFrame, ...] = ()


def _cuts(groups: DataFrame, names: Sequence[str], per_segment: int, above: int, max_groups: int):
    """Cut the time spans of the largest groups above a row limit into equal widths."""
    found = groups.filter(F.col("_rows") > above).orderBy(F.desc("_rows")).limit(max_groups).collect()
    if not found:
        return None, per_segment
    per_segment = max(per_segment, sum(r["_rows"] for r in found) // max_groups + 1)
    rows = []
    for r in found:
        parts = -(-r["_rows"] // per_segment)
        span = r["_to"] - r["_from"] + 1
        rows.append((*[r[n] for n in names], r["_from"], max(1, -(-span // parts))))
    schema = T.StructType(
        [T.StructField(f"_hot_{n}", groups.schema[n].dataType) for n in names]
        + [T.StructField("_from", T.LongType()), T.StructField("_width", T.LongType())]
    )
    return groups.sparkSession.createDataFrame(rows, schema), per_segment


def _spans(df: DataFrame, names: Sequence[str], ts: str) -> DataFrame:
    return df.groupBy(*names).agg(
        F.count(F.lit(1)).alias("_rows"), F.min(ts).alias("_from"), F.max(ts).alias("_to")
    )


def hot_keys(
    df: DataFrame, key: Sequence[str], ts: str, hot_rows: int = HOT_ROWS, max_hot: int = MAX_HOT
) -> HotKeys:
    """Find the keys with too many rows for one task.

    Runs one aggregation over key and time and takes its largest groups, at most
    max_hot rows; further ones over the hot rows only if there are any.
    """
    df = df.select(*dict.fromkeys([*key, ts]))
    frame, per_segment = _cuts(_spans(df, key, ts), key, hot_rows, hot_rows, max_hot)
    found = HotKeys()
    while frame is not None:
        found = HotKeys((*found.levels, frame))
        segments = _spans(cut_segments(df, found, key, ts, "inner"), [*key, SEGMENT], ts)
        # a single second cannot be cut
        wide = segments.filter(F.col("_to") > F.col("_from"))
        frame, per_segment = _cuts(wide, [*key, SEGMENT], per_segment, 2 * per_segment, max_hot)
    return found


def cut_segments(df: DataFrame, hot: HotKeys, key: Sequence[str], ts: str, how: str) -> DataFrame:
    """Add the segment of each row of a hot key, named by its start.

    With a left join the rows of all other keys stay and get segment 0.
    """
    for level, cuts in enumerate(hot.levels):
        names = [*key, SEGMENT] if level else [*key]
        on = null_safe_on([df[n] for n in names], [cuts[f"_hot_{n}"] for n in names])
        offset = F.floor((F.col(ts) - F.col("_from")) / F.col("_width")) * F.col("_width")
        whole = F.col(SEGMENT) if level else F.lit(0)
        start = F.coalesce(F.col("_from") + offset, whole).cast("long")
        joined = df.join(F.broadcast(cuts), on, "left" if level else how)
        df = joined.withColumn("_start", start).drop(
            SEGMENT, "_from", "_width", *[f"_hot_{n}" for n in names]
        ).withColumnRenamed("_start", SEGMENT)
    return df


def _join_edges(df: DataFrame, edges: DataFrame, key: Sequence[str]) -> DataFrame:
    """Attach what neighbouring segments hand over (bounded by the segment count)."""
    names = [*key, SEGMENT]
    edges = edges.select(*[F.col(n).alias(f"_edge_{n}") for n in names],
                         *[c for c in edges.columns if c not in names])
    on = null_safe_on([df[n] for n in names], [edges[f"_edge_{n}"] for n in names])
    return df.join(F.broadcast(edges), on, "left").drop(*[f"_edge_{n}" for n in names])


def with_neighbours(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    prev: Sequence[str] = (),
    next: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Add ``_prev`` / ``_next``: structs with the named columns of the adjacent rows.

    order starts with a whole-number time column; its further columns break ties.
    The struct is null where there is no such row. hot is what ``hot_keys`` found for
    this or any other table with the same keys; it is looked up if not given.
    """
    ts = order[0]
    hot = hot or hot_keys(df, key, ts, hot_rows)
    if not hot.levels:
        window = Window.partitionBy(*key).orderBy(*order)
        added = [F.lag(F.struct(*prev)).over(window).alias("_prev")] if prev else []
        added += [F.lead(F.struct(*next)).over(window).alias("_next")] if next else []
        return df.select("*", *added)

    window = Window.partitionBy(*key, SEGMENT).orderBy(*order)
    over_segments = Window.partitionBy(*key).orderBy(SEGMENT)
    rows = cut_segments(df, hot, key, ts, "left")
    edge = cut_segments(df, hot, key, ts, "inner").groupBy(*key, SEGMENT)
    inner, tails, handed = [], [], []
    if prev:
        inner.append(F.lag(F.struct(*prev)).over(window).alias("_prev"))
        tails.append(F.max_by(F.struct(*prev), F.struct(*order)).alias("_tail"))
        handed.append(F.lag("_tail").over(over_segments).alias("_prev_edge"))
    if next:
        inner.append(F.lead(F.struct(*next)).over(window).alias("_next"))
        tails.append(F.min_by(F.struct(*next), F.struct(*order)).alias("_head"))
        handed.append(F.lead("_head").over(over_segments).alias("_next_edge"))

    edges = edge.agg(*tails).select(*key, SEGMENT, *handed)
    out = _join_edges(rows.select("*", *inner), edges, key)
    for name, wanted in (("_prev", prev), ("_next", next)):
        if wanted:
            out = out.withColumn(name, F.coalesce(name, f"{name}_edge")).drop(f"{name}_edge")
    return out.drop(SEGMENT)


def with_last_known(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    cols: Sequence[str],
    hot_rows: int = HOT_ROWS,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Forward fill: replace nulls of cols by the last known value of the key."""
    ts = order[0]
    hot = hot or hot_keys(df, key, ts, hot_rows)
    split = [*key] if not hot.levels else [*key, SEGMENT]
    so_far = (
        Window.partitionBy(*split).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    known = {c: F.last(c, ignorenulls=True).over(so_far) for c in cols}
    if not hot.levels:
        return df.select(*[known[c].alias(c) if c in known else F.col(c) for c in df.columns])

    before = Window.partitionBy(*key).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    edges = cut_segments(df, hot, key, ts, "inner").groupBy(*key, SEGMENT).agg(
        *[
            F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_tail_{c}")
            for c in cols
        ]
    )
    edges = edges.select(
        *key, SEGMENT,
        *[F.last(f"_tail_{c}", ignorenulls=True).over(before).alias(f"_edge_{c}") for c in cols],
    )
    rows = cut_segments(df, hot, key, ts, "left").select(
        "*", *[known[c].alias(f"_known_{c}") for c in cols]
    )
    out = _join_edges(rows, edges, key)
    filled = {c: F.coalesce(f"_known_{c}", f"_edge_{c}") for c in cols}
    return out.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])
