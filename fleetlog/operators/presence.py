"""Online and offline events of keys that come and go between polls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlog.operators.changes import match_keys
from fleetlog.operators.polls import poll_index, poll_neighbours
from fleetlog.operators.sequence import HOT_ROWS, HotKeys, with_neighbours


def presence_log(
    sightings: DataFrame,
    key: str,
    ts: str = "timestamp",
    polls: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Log of (key, online, ts) from the polls in which each key was listed.

    A key goes offline at the poll after a sighting unless it is listed there too,
    and online at its first sighting and at each sighting after an absence. Works on
    sightings and the list of polls only; keys are never paired with all polls.
    Repeated sightings in one poll do no harm.
    """
    if polls is None:
        polls = poll_index(sightings, ts)
    following = poll_neighbours(polls, ts).select(F.col(ts).alias("_poll"), "next_ts")
    seen = sightings.select(key, ts)
    seq = with_neighbours(seen, [key], [ts], prev=[ts], next=[ts], hot_rows=hot_rows, hot=hot)
    seq = seq.join(following, seq[ts] == following["_poll"])

    here, then, poll_after = F.col(ts), F.col(f"_next.{ts}"), F.col("next_ts")
    leaves = poll_after.isNotNull() & (then.isNull() | (then > poll_after))
    returns = then > poll_after
    events = F.array(
        F.when(F.col("_prev").isNull(), F.struct(F.lit(1).alias("online"), here.alias("at"))),
        F.when(leaves, F.struct(F.lit(0).alias("online"), poll_after.alias("at"))),
        F.when(returns, F.struct(F.lit(1).alias("online"), then.alias("at"))),
    )
    return (
        seq.select(key, F.explode(events).alias("_e"))
        .filter(F.col("_e").isNotNull())
        .select(key, F.col("_e.online").cast("long").alias("online"), F.col("_e.at").alias(ts))
    )


def presence_state(log: DataFrame, key: str, ts: str = "timestamp") -> DataFrame:
    """Last event per key. One key has at most one event per poll."""
    last = log.groupBy(key).agg(F.max(F.struct(ts, "online")).alias("_last"))
    return last.select(key, F.col("_last.online").alias("online"), F.col(f"_last.{ts}").alias(ts))


def presence_in_poll(
    poll: DataFrame, registry: DataFrame, state: DataFrame, key: str, ts: str = "timestamp"
) -> DataFrame:
    """Events caused by a single poll, given the registry of keys and the last state."""
    listed = poll.select(key, ts).distinct()
    now = poll.agg(F.max(ts)).scalar()
    online = state.filter("online = 1")
    offline = state.filter("online = 0")
    came = match_keys(listed, [key], "left_anti", online).select(
        key, F.lit(1).cast("long").alias("online"), ts
    )
    gone = match_keys(registry.select(key), [key], "left_anti", listed)
    gone = match_keys(gone, [key], "left_anti", offline).select(
        key, F.lit(0).cast("long").alias("online"), now.alias(ts)
    )
    # a poll without rows says nothing about who is offline
    return came.unionByName(gone.filter(F.col(ts).isNotNull()))
