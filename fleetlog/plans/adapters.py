"""The driver tables in the roles the operators need.

Each role has a DataFrame form and, for the SQL side, a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlog.functions.numeric import epoch_seconds, to_int

POLL_SECONDS = 21_600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- events as observations of users -------------------------------------------------
def observations(spark: SparkSession, sf_dir: str, since: int | None = None, before: int | None = None) -> DataFrame:
    """key user_id, time ts, tie-break event_id, values event_type, k, band, cents.

    since and before (epoch seconds) are compared to the stored time, which files can skip rows by.
    """
    events = table(spark, sf_dir, "events")
    # a constant of the column's own type, or else the column is cast and nothing is skipped
    at = lambda epoch: F.timestamp_seconds(F.lit(epoch)).cast(events.schema["ts"].dataType)
    if since is not None:
        events = events.filter(F.col("ts") >= at(since))
    if before is not None:
        events = events.filter(F.col("ts") < at(before))
    return events.select(
        "user_id",
        epoch_seconds(F.col("ts")).alias("ts"),
        "event_id",
        "event_type",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.floor(F.col("value") / 50).cast("long").alias("band"),
        to_int(F.col("value") * 100).alias("cents"),
    )


OBS = """obs AS (
  SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id, event_type,
         CAST(props->>'k' AS BIGINT) AS k, CAST(floor(value / 50) AS BIGINT) AS band,
         CAST(round_even(value * 100, 0) AS BIGINT) AS cents
  FROM events)"""


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users seen per six-hour poll; repeats within a poll are left in."""
    ts = epoch_seconds(F.col("ts"))
    poll = (F.floor(ts / POLL_SECONDS) * POLL_SECONDS).cast("long")
    return table(spark, sf_dir, "events").select("user_id", poll.alias("ts"))


SIGHTINGS = f"""seen AS (
  SELECT DISTINCT user_id,
         CAST(floor(floor(epoch(ts)) / {POLL_SECONDS}) * {POLL_SECONDS} AS BIGINT) AS ts
  FROM events)"""


def poll_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sightings(spark, sf_dir).select("ts").distinct()


POLLS = "polls AS (SELECT DISTINCT ts FROM seen)"


def value_log(spark: SparkSession, sf_dir: str, event_type: str, col: str, name: str) -> DataFrame:
    """One value per user and second from events of one type."""
    obs = observations(spark, sf_dir).filter(F.col("event_type") == event_type)
    return obs.groupBy("user_id", "ts").agg(F.max_by(col, "event_id").alias(name))


def value_log_sql(event_type: str, col: str, name: str) -> str:
    return (
        f"SELECT user_id, ts, arg_max({col}, event_id) AS {name} FROM obs "
        f"WHERE event_type = '{event_type}' GROUP BY user_id, ts"
    )


# ---- lineitem as offers ----------------------------------------------------------------
def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("machine_id"),
        (F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("id"),
        F.col("l_linenumber").cast("long").alias("num_gpus"),
        (F.col("l_returnflag") == "R").alias("rented"),
        F.col("l_suppkey").alias("host_id"),
    )


OFFERS = """offers AS (
  SELECT l_orderkey AS machine_id, l_partkey * 100000 + l_suppkey AS id,
         CAST(l_linenumber AS BIGINT) AS num_gpus, l_returnflag = 'R' AS rented,
         l_suppkey AS host_id
  FROM lineitem)"""

# Chunk size per machine, from sorted lists of sizes.
CHUNKS = f"""{OFFERS},
sizes AS (
  SELECT machine_id, list_sort(list(num_gpus)) AS s FROM offers GROUP BY machine_id),
chunks AS (
  SELECT machine_id, s[-1] AS whole,
         CASE WHEN len(s) >= 3 AND s[1] <> s[2] THEN s[2] ELSE s[1] END AS min_chunk
  FROM sizes),
undivided AS (
  SELECT o.*, c.min_chunk, c.whole
  FROM offers o JOIN chunks c ON o.machine_id = c.machine_id AND o.num_gpus <= c.min_chunk),
units AS (
  SELECT machine_id, min_chunk, whole, CAST(sum(num_gpus) AS BIGINT) AS listed,
         CAST(sum(CASE WHEN rented THEN num_gpus ELSE 0 END) AS BIGINT) AS num_gpus_rented
  FROM undivided GROUP BY machine_id, min_chunk, whole)"""

# ---- lineitem as a raw listing -----------------------------------------------------------
# Select list that both engines understand; {epoch} is the epoch second of the ship date.
_LISTING = """
  l_orderkey AS machine_id, l_suppkey AS host_id, l_partkey AS id,
  CAST(l_linenumber AS BIGINT) AS num_gpus,
  l_returnflag <> 'R' AS rentable, l_linestatus = 'F' AS rented,
  0.9e0 + l_discount AS reliability2, 0.5e0 AS reliability,
  CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'verified'
       WHEN l_returnflag = 'A' THEN 'de-verified'
       WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'unverified'
       WHEN l_returnflag = 'N' THEN 'deverified'
       WHEN l_linestatus = 'F' THEN 'other' END AS verification,
  CASE l_linenumber WHEN 1 THEN 'Stockholm, Sweden' WHEN 2 THEN ' x , US ' WHEN 4 THEN 'Berlin,DE'
       WHEN 5 THEN 'NO' WHEN 6 THEN 'a, b, c, FR' END AS geolocation,
  CASE WHEN l_partkey % 3 = 0 THEN 'FR' END AS loc_country,
  CASE WHEN l_partkey % 5 < 3 THEN concat('  isp ', l_suppkey, ' ') END AS loc_isp,
  l_extendedprice * 16 AS cpu_ram,
  CASE WHEN l_quantity <> 7 THEN l_quantity END AS disk_space,
  l_extendedprice / 100 AS bw_nvlink, l_tax * 100 AS pcie_bw,
  {epoch} + l_linenumber * 10007 + 0.25e0 AS end_date,
  l_extendedprice / 100000 AS dph_base, l_discount AS storage_cost, l_tax AS inet_up_cost,
  l_tax * 2 AS inet_down_cost,
  CASE WHEN l_linenumber <> 5 THEN l_extendedprice / 200000 END AS min_bid,
  CASE WHEN l_linenumber <> 3 THEN l_discount * 3 END AS credit_discount_max,
  l_extendedprice / 7 AS disk_bw, l_quantity * 19.5e0 AS gpu_mem_bw, l_extendedprice / 1000 AS dlperf,
  l_quantity * 3.3e0 AS inet_down, l_quantity * 2.5e0 AS inet_up, l_extendedprice / 333 AS score,
  800e0 + l_linenumber AS compute_cap, l_quantity * 1.5e0 AS total_flops, l_linenumber * 8e0 AS cpu_cores,
  concat(' AMD Ryzen ', l_suppkey, ' 16-Core Processor ') AS cpu_name,
  l_returnflag = 'A' AS has_avx, concat('disk ', l_partkey, '   ') AS disk_name,
  CASE WHEN l_linenumber < 6 THEN l_linenumber % 2 + 0e0 END AS hosting_type,
  CASE WHEN l_partkey % 7 > 0 THEN concat('board ', l_partkey % 11) END AS mobo_name,
  concat('gpu ', l_suppkey % 9) AS gpu_name, l_linenumber % 4 + 1e0 AS pci_gen,
  l_linenumber * 2e0 AS gpu_lanes, l_quantity * 1024 AS gpu_ram,
  concat('12.', l_linenumber) AS cuda_max_good, concat('5', l_suppkey, '.1') AS driver_version,
  l_quantity + 0.5e0 AS direct_port_count, l_linenumber + 0e0 AS min_chunk,
  concat('10.0.', l_suppkey, '.', l_linenumber) AS public_ipaddr, l_returnflag = 'N' AS static_ip,
  l_linenumber - 1e0 AS num_gpus_rented, CAST({epoch} AS BIGINT) AS timestamp"""


def raw_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers as they arrive: raw units, nested location, gaps in the data."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("fleetlog_lineitem")
    flat = spark.sql(
        "SELECT" + _LISTING.format(epoch="unix_seconds(CAST(l_shipdate AS TIMESTAMP))")
        + " FROM fleetlog_lineitem"
    )
    known = F.col("loc_country").isNotNull() | F.col("loc_isp").isNotNull()
    location = F.struct(F.col("loc_country").alias("country"), F.col("loc_isp").alias("isp"))
    return flat.withColumn("location", F.when(known, location)).drop("loc_country", "loc_isp")


LISTING = "raw AS (SELECT" + _LISTING.format(epoch="CAST(epoch(l_shipdate) AS BIGINT)") + " FROM lineitem)"
