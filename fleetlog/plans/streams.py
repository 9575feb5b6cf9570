"""Queries that go through the incremental and streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlog.plans import adapters as a
from fleetlog.plans import listing
from fleetlog.plans.history import _PRESENCE, _avg_std_sql, _period_sql
from fleetlog.plans.registry import query
from fleetlog.session import new_run_dir
from fleetlog.sources.store import PollStore
from fleetlog.sources.tables import first_last
from fleetlog.streaming import registry, update
from fleetlog.streaming.rollup import stream_period_avg_std as stream_rollup

OBS = a.OBS

# Tables kept for the events fleet: one poll every six hours, a user's last event in it.
EVENTS_FLEET = update.FleetTables(
    key="user_id",
    ts="ts",
    map_value="event_type",
    logs={"kind": ["event_type"], "measures": ["band", "k"]},
    averages=("cents",),
    period=5 * 86_400,
)
BATCHES = 3


def poll_rows(spark, sf):
    """One row per user and six-hour poll."""
    obs = a.observations(spark, sf)
    poll = (F.floor(F.col("ts") / a.POLL_SECONDS) * a.POLL_SECONDS).cast("long")
    values = ["event_type", "band", "k", "cents"]
    last = obs.groupBy("user_id", poll.alias("ts")).agg(F.max_by(F.struct(*values), "event_id").alias("_v"))
    return last.select("user_id", "ts", *[F.col(f"_v.{c}").alias(c) for c in values])


POLL_ROWS = f"""{OBS}, poll_rows AS (
  SELECT user_id, CAST(floor(ts / {a.POLL_SECONDS}) * {a.POLL_SECONDS} AS BIGINT) AS ts, arg_max(event_type, event_id) AS event_type,
         arg_max(band, event_id) AS band, arg_max(k, event_id) AS k, arg_max(cents, event_id) AS cents
  FROM obs GROUP BY 1, 2)"""


def _rejects(spark, sf):
    """The payloads that are turned away, as another query finds them."""
    found = listing.payload_rejects(spark, sf).select("arrived", F.col("event_id").cast("string").alias("source"), "reason")
    return _landed(found, "rejects")


def _landed(df, name):
    """Written once and read by every batch."""
    path = new_run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_updates(spark, sf) -> tuple[PollStore, object]:
    """Bring all tables up to date in a few batches of polls, as a backlog would."""
    rows = _landed(poll_rows(spark, sf), "polls")
    store = PollStore(spark, new_run_dir(spark, "tables"))
    update.create_tables(store, rows.schema, EVENTS_FLEET)
    refused = _rejects(spark, sf)
    ends = first_last(rows, "ts").first()
    width = (ends["timespan"] + BATCHES) // BATCHES
    for i in range(BATCHES):
        low = ends["first_ts"] + i * width
        upto = low + width - 1 if i < BATCHES - 1 else None
        part = lambda df, at: df.filter(F.col(at) >= (low if i else 0)).filter(F.col(at) <= upto if upto else F.lit(True))
        update.update_all(store, part(rows, "ts"), i, EVENTS_FLEET, part(refused, "arrived"))
    return store, rows.schema


_ALL_TABLES = (
    _PRESENCE.replace("WITH ", f"WITH {POLL_ROWS}, ", 1)
    + f""", kind AS (
  SELECT * FROM poll_rows QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts)),
measures AS (
  SELECT * FROM poll_rows QUALIFY row_number() OVER w = 1 OR band IS DISTINCT FROM lag(band) OVER w OR k IS DISTINCT FROM lag(k) OVER w
  ),
hosts AS (SELECT user_id, arg_min(event_type, ts) AS event_type, min(ts) AS ts FROM poll_rows GROUP BY user_id),
ends AS (SELECT *, CAST(ceil(ts / {EVENTS_FLEET.period}.0) * {EVENTS_FLEET.period} AS BIGINT) AS e FROM poll_rows),
avgs AS (
  SELECT user_id, concat(CAST(round(avg(cents)) AS BIGINT), '|', CAST(round(stddev_pop(cents) * 100) AS BIGINT)) AS m, e
  FROM ends WHERE e < (SELECT max(e) FROM ends) GROUP BY user_id, e),
refused AS (
  SELECT CAST(event_id AS VARCHAR) AS source, CAST(floor(epoch(ts)) AS BIGINT) + 5 AS arrived,
         CASE event_type WHEN 'error' THEN 'not json' WHEN 'signup' THEN 'no offers' ELSE 'empty offers' END AS reason
  FROM events WHERE event_type IN ('error', 'signup', 'view')),
tables AS (
  SELECT 'kind' AS table_name, user_id, event_type AS value, ts FROM kind
  UNION ALL SELECT 'measures', user_id, concat(band, '|', k), ts FROM measures
  UNION ALL SELECT 'host_map', user_id, event_type, ts FROM hosts
  UNION ALL SELECT 'online', user_id, CAST(online AS VARCHAR), ts FROM log
  UNION ALL SELECT 'avg', user_id, m, e FROM avgs
  UNION ALL SELECT 'ts_idx', NULL, NULL, ts FROM polls)
SELECT * FROM tables
UNION ALL SELECT 'rejects', NULL, concat(source, '|', reason), arrived FROM refused
UNION ALL SELECT 'counts', NULL, concat(table_name, '|', count(*)), NULL FROM tables GROUP BY table_name"""
).replace("k IS DISTINCT FROM lag(k) OVER w\n  )", "k IS DISTINCT FROM lag(k) OVER w)").replace(
    "SELECT * FROM poll_rows QUALIFY row_number() OVER w", "SELECT * FROM poll_rows WINDOW w AS (PARTITION BY user_id ORDER BY ts) QUALIFY row_number() OVER w"
)


@query("update_all_tables", _ALL_TABLES)
def update_all_tables(spark, sf):
    store, rows = run_updates(spark, sf)
    at = store.last_commit()
    values = {
        "kind": F.col("event_type"),
        "measures": F.concat_ws("|", "band", "k"),
        "host_map": F.col("event_type"),
        "online": F.col("online").cast("string"),
        "avg": F.concat_ws("|", "cents_avg", F.round(F.col("cents_std") * 100).cast("long")),
    }
    out = update.read_table(store, "ts_idx", rows, EVENTS_FLEET, at).select(
        F.lit("ts_idx").alias("table_name"), F.lit(None).cast("long").alias("user_id"),
        F.lit(None).cast("string").alias("value"), "ts",
    )
    for name, value in values.items():
        table = update.read_table(store, name, rows, EVENTS_FLEET, at)
        out = out.unionByName(table.select(F.lit(name).alias("table_name"), "user_id", value.alias("value"), "ts"))
    nobody = F.lit(None).cast("long")
    rejects = update.read_table(store, "rejects", rows, EVENTS_FLEET, at)
    out = out.unionByName(rejects.select(
        F.lit("rejects").alias("table_name"), nobody.alias("user_id"), F.concat_ws("|", "source", "reason").alias("value"), F.col("arrived").alias("ts")
    ))
    counts = update.read_table(store, "counts", rows, EVENTS_FLEET, at).groupBy("table_name").agg(F.sum("n_rows").alias("n"))
    return out.unionByName(counts.select(
        F.lit("counts").alias("table_name"), nobody.alias("user_id"), F.concat_ws("|", "table_name", "n").alias("value"), nobody.alias("ts")
    ))


@query("stream_period_avg_std", _period_sql(86_400, _avg_std_sql("cents"), "user_id"))
def stream_period_avg_std(spark, sf):
    schema = a.table(spark, sf, "events").schema
    run = new_run_dir(spark, "rollup")
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    rows = source.select("user_id", a.epoch_seconds(F.col("ts")).alias("ts"), a.to_int(F.col("value") * 100).alias("cents"))
    rolled = stream_rollup(rows, "user_id", ["cents"], "ts")
    done = (
        rolled.writeStream.outputMode("append").format("parquet")
        .option("path", f"{run}/out").option("checkpointLocation", f"{run}/checkpoint")
        .trigger(availableNow=True).start()
    )
    done.awaitTermination()
    return spark.read.schema(rolled.schema).parquet(f"{run}/out")


# ---- live keyed state ----------------------------------------------------------------------
def _followed(stream, run: str, mode: str):
    """Run a stream over what is there into a folder per batch, and read all of it."""
    out = f"{run}/out"

    def on_batch(df, batch: int) -> None:  # a batch that is run again replaces its own folder
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    done = (
        stream.writeStream.outputMode(mode).foreachBatch(on_batch)
        .option("checkpointLocation", f"{run}/checkpoint").trigger(availableNow=True).start()
    )
    done.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).option("basePath", out).parquet(f"{out}/batch=*").select(*stream.columns)


def _table_stream(spark, sf, name):
    schema = a.table(spark, sf, name).schema
    return registry.use_rocksdb(spark).readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@query("stream_ts_index", f"WITH {a.SIGHTINGS} SELECT DISTINCT ts FROM seen")
def stream_ts_index(spark, sf):
    poll = (F.floor(a.epoch_seconds(F.col("ts")) / a.POLL_SECONDS) * a.POLL_SECONDS).cast("long")
    events = _table_stream(spark, sf, "events").select(poll.alias("ts"))
    return _followed(registry.live_index(events, "ts"), new_run_dir(spark, "live-index"), "append")


@query(
    "stream_first_wins_map",
    """SELECT o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS o_orderpriority
       FROM orders GROUP BY o_custkey""",
)
def stream_first_wins_map(spark, sf):
    order = ["o_orderdate", "o_orderkey"]
    orders = _table_stream(spark, sf, "orders").select("o_custkey", "o_orderpriority", *order)
    firsts = registry.live_first_wins(orders, "o_custkey", "o_orderpriority", order)
    updates = _followed(firsts, new_run_dir(spark, "live-map"), "update")
    return registry.latest_update(updates, "o_custkey", order).select("o_custkey", "o_orderpriority")
