"""The index of poll times and its neighbours.

The index has no key, so a plain window would run in one task. It is cut into
days; each day takes the edge polls of the days around it. Only the table of days
(one row per calendar day) is ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlog.functions.numeric import day_number


def poll_index(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Distinct poll times."""
    return df.select(ts).distinct()


def poll_neighbours(polls: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Add prev_ts and next_ts to a table of distinct poll times."""
    by_day = polls.select(ts, day_number(F.col(ts)).alias("_day"))
    in_day = Window.partitionBy("_day").orderBy(ts)
    over_days = Window.orderBy("_day")
    days = by_day.groupBy("_day").agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    days = days.select(
        F.col("_day").alias("_edge_day"),
        F.lag("_last").over(over_days).alias("_before"),
        F.lead("_first").over(over_days).alias("_after"),
    )
    rows = by_day.select(
        ts, "_day",
        F.lag(ts).over(in_day).alias("_prev"),
        F.lead(ts).over(in_day).alias("_next"),
    )
    return rows.join(days, rows["_day"] == days["_edge_day"], "left").select(
        ts,
        F.coalesce("_prev", "_before").alias("prev_ts"),
        F.coalesce("_next", "_after").alias("next_ts"),
    )


def polls_before(times: DataFrame, polls: DataFrame, ts: str = "timestamp") -> DataFrame:
    """ts, polls_before: for each distinct time the number of polls earlier than it.

    With it the polls within [a, b) are a difference and need no row each. A day holds at
    most 86,400 distinct times, so days are ordered on their own; only the table of days
    is ordered as a whole.
    """
    own = poll_index(polls, ts).select(ts, F.lit(1).alias("_poll"))
    both = poll_index(times, ts).select(ts, F.lit(0).alias("_poll")).unionByName(own)
    marked = both.groupBy(ts).agg(F.max("_poll").alias("_poll"), F.min("_poll").alias("_asked"))
    by_day = marked.withColumn("_day", day_number(F.col(ts)))
    earlier = Window.partitionBy("_day").orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    days = by_day.groupBy("_day").agg(F.sum("_poll").alias("_n"))
    days_before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("_day", F.coalesce(F.sum("_n").over(days_before), F.lit(0)).alias("_base"))
    counted = by_day.withColumn("_in_day", F.coalesce(F.sum("_poll").over(earlier), F.lit(0)))
    return counted.filter("_asked = 0").join(days, "_day").select(
        ts, (F.col("_base") + F.col("_in_day")).cast("long").alias("polls_before")
    )
