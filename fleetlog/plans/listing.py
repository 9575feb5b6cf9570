"""Queries on reading, cleaning and splitting listings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlog import schema
from fleetlog.functions import numeric, text
from fleetlog.operators import derive, normalize, split
from fleetlog.operators.recent import recent_distinct as recent_distinct_op
from fleetlog.plans import adapters as a
from fleetlog.plans.registry import query
from fleetlog.session import new_run_dir
from fleetlog.sources import payload, tables

RAW, OFFERS, CHUNKS, OBS = a.LISTING, a.OFFERS, a.CHUNKS, a.OBS


# ---- sources and sinks --------------------------------------------------------------------
# Each event becomes the text of one payload: two offers, or one of the bad forms.
_PAYLOAD_OFFER = T.StructType(
    [T.StructField("machine_id", T.LongType()), T.StructField("num_gpus", T.LongType())]
)


def _payload_texts(spark, sf):
    offer = lambda key, n: F.concat(
        F.lit('{"machine_id":'), key.cast("string"), F.lit(',"num_gpus":'), n.cast("string"), F.lit("}")
    )
    obs = a.observations(spark, sf)
    stamp = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    both = F.concat(offer(F.col("user_id"), F.col("k")), F.lit(","), offer(F.col("event_id"), F.col("band")))
    body = (
        F.when(F.col("event_type") == "error", F.lit("<html>busy</html>"))
        .when(F.col("event_type") == "signup", F.lit('{"x": 1}'))
        .when(F.col("event_type") == "view", F.concat(F.lit('{"timestamp":"'), stamp, F.lit('","offers":[]}')))
        .when(F.col("event_type") == "click", F.concat(F.lit('{"offers":['), both, F.lit("]}")))
        .otherwise(F.concat(F.lit('{"timestamp":"'), stamp, F.lit('","offers":['), both, F.lit("]}")))
    )
    return obs.select("event_id", (F.col("ts") + 5).alias("arrived"), body.alias("body"))


@query(
    "payload_explode",
    f"""WITH {OBS}, good AS (
      SELECT CASE WHEN event_type = 'click' THEN ts + 5 ELSE ts END AS timestamp, ts + 5 AS arrived,
             user_id, event_id, k, band FROM obs WHERE event_type IN ('click', 'purchase'))
    SELECT timestamp, arrived, user_id AS machine_id, k AS num_gpus FROM good
    UNION ALL SELECT timestamp, arrived, event_id, band FROM good""",
)
def payload_explode(spark, sf):
    return payload.explode_offers(payload.parse_payloads(_payload_texts(spark, sf), "body", _PAYLOAD_OFFER))


@query(
    "payload_rejects",
    """SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) + 5 AS arrived,
         CASE event_type WHEN 'error' THEN 'not json' WHEN 'signup' THEN 'no offers' ELSE 'empty offers' END AS reason
       FROM events WHERE event_type IN ('error', 'signup', 'view')""",
)
def payload_rejects(spark, sf):
    return payload.rejected(payload.parse_payloads(_payload_texts(spark, sf), "body", _PAYLOAD_OFFER))


# Polls with the time of an event, arriving up to a few minutes out of order.
@query(
    "admit_new_polls",
    f"""WITH {OBS}, p AS (SELECT DISTINCT ts, ts + (k * 37) % 600 AS arrived FROM obs),
    run AS (SELECT *, max(ts) OVER (ORDER BY arrived, ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM p)
    SELECT ts, arrived FROM run WHERE ts > coalesce(m, 0)""",
)
def admit_new_polls(spark, sf):
    obs = a.observations(spark, sf)
    late = obs.select("ts", (F.col("ts") + F.col("k") * 37 % 600).alias("arrived")).distinct()
    return payload.admitted_polls(late, "ts", "arrived")


@query(
    "sink_roundtrip",
    f"WITH {OBS} SELECT user_id, event_type, cents, ts, CAST(floor(ts / 86400) AS BIGINT) AS day FROM obs",
)
def sink_roundtrip(spark, sf):
    path = new_run_dir(spark, "roundtrip")
    rows = a.observations(spark, sf).select("user_id", "event_type", "cents", "ts")
    tables.append_log(rows, path, "ts")
    stored = tables.read_table(spark, path)
    return stored.select(
        "user_id", "event_type", "cents", "ts", F.unix_date("event_date").cast("long").alias("day")
    )


@query(
    "projected_scan",
    """SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS o_totalprice
       FROM orders""",
)
def projected_scan(spark, sf):
    cols = {"o_orderkey": "int", "o_totalprice": "long"}
    return tables.read_table(spark, f"{sf}/orders.parquet", cols)


_ENDS = f"WITH {OBS} SELECT min(ts) AS first_ts, max(ts) AS last_ts"


@query("first_last_ts", _ENDS + " FROM obs")
def first_last_ts(spark, sf):
    return tables.first_last(a.observations(spark, sf), "ts").select("first_ts", "last_ts")


@query("table_timespan", f"WITH {OBS} SELECT max(ts) - min(ts) AS timespan FROM obs")
def table_timespan(spark, sf):
    return tables.first_last(a.observations(spark, sf), "ts").select("timespan")


# Tables laid out as lines of text, so that the bytes of their files are known.
_LINES = {
    "events": ["event_id", "user_id", "event_type"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
}
_SIZES = "sizes AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS name, sum(strlen(concat_ws('|', {', '.join(cols)})) + 1)::BIGINT AS bytes FROM {t}" for t, cols in _LINES.items()
) + ")"


def _laid_out_report(spark, sf):
    folder = new_run_dir(spark, "storage")
    lines = [a.table(spark, sf, t).select(F.lit(t).alias("name"), F.concat_ws("|", *cols).alias("line")) for t, cols in _LINES.items()]
    whole = lines[0].union(lines[1]).union(lines[2])
    whole.write.partitionBy("name").option("compression", "none").text(folder)
    return tables.storage_report(spark, folder, "name=([^/]+)/")


@query(
    "storage_report",
    f"""WITH {_SIZES}, total AS (SELECT sum(bytes) AS total FROM sizes)
    SELECT name, round(bytes / 1048576.0::DOUBLE, 2) AS size_mb, round(bytes * 100.0::DOUBLE / total, 2) AS percentage
    FROM (SELECT * FROM sizes UNION ALL SELECT 'total', total FROM total), total""",
)
def storage_report(spark, sf):
    return _laid_out_report(spark, sf).select("name", "size_mb", "percentage")


@query(
    "storage_growth",
    f"""WITH {_SIZES}, {OBS}, s AS (SELECT round(sum(bytes) / 1048576.0::DOUBLE, 2) AS size_mb FROM sizes),
    d AS (SELECT (max(ts) - min(ts)) / 86400.0::DOUBLE AS days FROM obs)
    SELECT size_mb, round(size_mb / days, 2) AS mb_per_day, round(size_mb / days * 365, 0) AS mb_per_year FROM s, d""",
)
def storage_growth(spark, sf):
    return tables.growth(_laid_out_report(spark, sf), tables.first_last(a.observations(spark, sf), "ts"))


# ---- normalisation, step by step ----------------------------------------------------------
@query("norm_rename", f"WITH {RAW} SELECT id, NOT rentable AS rented, reliability2 AS reliability FROM raw")
def norm_rename(spark, sf):
    return normalize.rename_flags(a.raw_listing(spark, sf)).select("id", "rented", "reliability")


@query("norm_json_field", f"WITH {RAW} SELECT id, loc_isp AS isp FROM raw")
def norm_json_field(spark, sf):
    return a.raw_listing(spark, sf).select("id", F.col("location.isp").alias("isp"))


@query("json_text_field", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def json_text_field(spark, sf):
    return a.observations(spark, sf).select("event_id", "k")


_PLACE = """CASE WHEN trim(string_split(geolocation, ',')[-1]) = 'Sweden' THEN 'SE'
  ELSE trim(string_split(geolocation, ',')[-1]) END"""


@query("norm_country_fallback", f"WITH {RAW} SELECT id, coalesce(loc_country, {_PLACE}) AS country FROM raw")
def norm_country_fallback(spark, sf):
    return normalize.add_location(a.raw_listing(spark, sf)).select("id", "country")


_CODE = """CASE verification WHEN 'unverified' THEN 0 WHEN 'verified' THEN 1 WHEN 'deverified' THEN 2
  WHEN 'de-verified' THEN 3 END"""


@query("norm_enum", f"WITH {RAW} SELECT id, CAST({_CODE} AS BIGINT) AS verification FROM raw")
def norm_enum(spark, sf):
    return normalize.map_verification(a.raw_listing(spark, sf)).select("id", "verification")


@query(
    "norm_fillna",
    f"""WITH {RAW} SELECT id, coalesce(min_bid, 0) AS min_bid, coalesce(disk_space, 0) AS disk_space,
        coalesce(mobo_name, '') AS mobo_name FROM raw""",
)
def norm_fillna(spark, sf):
    raw = a.raw_listing(spark, sf).select("id", "min_bid", "disk_space", "mobo_name")
    return normalize.fill_missing(raw)


@query(
    "norm_fillna_marked",
    f"""WITH {RAW} SELECT id, coalesce(min_bid, -1) AS min_bid, coalesce(hosting_type, 0) AS hosting_type,
        coalesce(credit_discount_max, 0) AS credit_discount_max, coalesce(mobo_name, '') AS mobo_name FROM raw""",
)
def norm_fillna_marked(spark, sf):
    raw = a.raw_listing(spark, sf).select("id", "min_bid", "hosting_type", "credit_discount_max", "mobo_name")
    return normalize.fill_missing(raw, -1, "", {"credit_discount_max": 0, "hosting_type": 0})


_TENS = "round_even({0} / 10, 0) * 10"
_DISK = f"CASE WHEN {_TENS} = 0 THEN 10 ELSE {_TENS} END"


@query(
    "norm_round_tens",
    f"""WITH {RAW} SELECT id, {_TENS.format('bw_nvlink')} AS bw_nvlink,
        CAST({_DISK.format('disk_space')} AS DOUBLE) AS disk_space FROM raw""",
)
def norm_round_tens(spark, sf):
    return a.raw_listing(spark, sf).select(
        "id",
        numeric.round_tens(F.col("bw_nvlink")).alias("bw_nvlink"),
        numeric.round_tens_nonzero(F.col("disk_space")).alias("disk_space"),
    )


@query(
    "norm_scale",
    f"""WITH {RAW} SELECT id, cpu_ram / 1024 AS cpu_ram, pcie_bw * 10 AS pcie_bw,
        dph_base * 1000 AS dph_base, storage_cost * 1000 AS storage_cost, inet_up_cost * 1000 AS inet_up_cost,
        inet_down_cost * 1000 AS inet_down_cost, min_bid * 1000 AS min_bid,
        credit_discount_max * 1000 AS credit_discount_max FROM raw""",
)
def norm_scale(spark, sf):
    cols = ["cpu_ram", "pcie_bw", *schema.COST_COLS]
    return normalize.apply_units(a.raw_listing(spark, sf).select("id", *cols))


@query(
    "round_day",
    f"""WITH {RAW} SELECT id, CAST(round_even(end_date / 86400, 0) * 86400 AS BIGINT) AS end_date FROM raw""",
)
def round_day(spark, sf):
    return a.raw_listing(spark, sf).select("id", numeric.round_day(F.col("end_date")).alias("end_date"))


@query(
    "norm_int_cast",
    f"""WITH {RAW} SELECT id, CAST(round_even(disk_bw, 0) AS BIGINT) AS disk_bw,
        CAST(round_even(direct_port_count, 0) AS BIGINT) AS direct_port_count,
        CAST(has_avx AS BIGINT) AS has_avx FROM raw""",
)
def norm_int_cast(spark, sf):
    raw = a.raw_listing(spark, sf).select("id", "disk_bw", "direct_port_count", "has_avx")
    return normalize.cast_types(raw)


@query("norm_trim", f"WITH {RAW} SELECT id, trim(cpu_name) AS cpu_name, trim(disk_name) AS disk_name FROM raw")
def norm_trim(spark, sf):
    return normalize.cast_types(a.raw_listing(spark, sf).select("id", "cpu_name", "disk_name"))


@query(
    "norm_project",
    f"WITH {RAW} SELECT {', '.join(c for c in schema.KEEP_COLS if c not in ('country', 'isp'))} FROM raw",
)
def norm_project(spark, sf):
    return normalize.keep_listed(a.raw_listing(spark, sf))


def _normal_sql() -> str:
    """Stored value of every kept column, from the raw one."""
    special = {
        "country": f"trim(coalesce(loc_country, {_PLACE}, ''))",
        "isp": "trim(coalesce(loc_isp, ''))",
        "rented": "CAST(NOT rentable AS BIGINT)",
        "reliability": "CAST(round_even(reliability2 * 10000, 0) AS BIGINT)",
        "verification": f"CAST(coalesce({_CODE}, 0) AS BIGINT)",
        "bw_nvlink": f"CAST({_TENS.format('bw_nvlink')} AS BIGINT)",
        "disk_space": f"CAST({_DISK.format('coalesce(disk_space, 0)')} AS BIGINT)",
        "cpu_ram": "CAST(round_even(cpu_ram / 1024, 0) AS BIGINT)",
        "pcie_bw": "CAST(round_even(pcie_bw * 10, 0) AS BIGINT)",
        "end_date": "CAST(round_even(end_date / 86400, 0) * 86400 AS BIGINT)",
    }
    special |= {c: f"CAST(round_even(coalesce({c}, 0) * 1000, 0) AS BIGINT)" for c in schema.COST_COLS}
    out = []
    for c in schema.KEEP_COLS:
        if c in special:
            sql = special[c]
        elif c in schema.STR_COLS:
            sql = f"trim(coalesce({c}, ''))"
        elif c in ("has_avx", "static_ip"):
            sql = f"CAST({c} AS BIGINT)"
        else:
            sql = f"CAST(round_even(CAST(coalesce({c}, 0) AS DOUBLE), 0) AS BIGINT)"
        out.append(f"{sql} AS {c}")
    return f"WITH {RAW} SELECT {', '.join(out)} FROM raw"


@query("normalize_batch", _normal_sql())
def normalize_batch(spark, sf):
    return normalize.normalize(a.raw_listing(spark, sf))


@query(
    "negative_counts",
    """SELECT 'score' AS column_name, count(*) FILTER (c_acctbal < 0) AS n_negative FROM customer
       UNION ALL SELECT 'host_id', count(*) FILTER (c_nationkey < 0) FROM customer""",
)
def negative_counts(spark, sf):
    rows = a.table(spark, sf, "customer").select(
        F.col("c_acctbal").alias("score"), F.col("c_nationkey").alias("host_id"), "c_name"
    )
    return normalize.negative_counts(rows)


# ---- scalar functions ---------------------------------------------------------------------
@query(
    "round_base",
    """SELECT o_orderkey, CAST(round_even(o_totalprice / 50, 0) * 50 AS BIGINT) AS by_50,
         CAST(round_even(o_orderkey / 5, 0) * 5 AS BIGINT) AS by_5 FROM orders""",
)
def round_base(spark, sf):
    return a.table(spark, sf, "orders").select(
        "o_orderkey",
        numeric.round_base(F.col("o_totalprice"), 50).alias("by_50"),
        numeric.round_base(F.col("o_orderkey")).alias("by_5"),
    )


@query(
    "round_piecewise",
    """WITH x AS (SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) AS x FROM part),
    s1 AS (SELECT *, CASE WHEN x BETWEEN 0 AND 400 THEN round_even(x / 10, 0) * 10 ELSE x END AS a FROM x),
    s2 AS (SELECT *, CASE WHEN x BETWEEN 400 AND 1000 THEN round_even(a / 100, 0) * 100 ELSE a END AS b FROM s1)
    SELECT p_partkey, CAST(CASE WHEN x BETWEEN 1000 AND 1050 THEN round_even(b / 7, 0) * 7 ELSE b END AS BIGINT) AS stepped
    FROM s2""",
)
def round_piecewise(spark, sf):
    steps = [(400, 10), (1000, 100), (1050, 7)]
    return a.table(spark, sf, "part").select(
        "p_partkey", numeric.round_piecewise(F.col("p_retailprice").cast("long"), steps).alias("stepped")
    )


@query(
    "round_pow2",
    """WITH p AS (SELECT o_orderkey, o_totalprice AS x, pow(2, round_even(log2(o_totalprice), 0)) AS p FROM orders)
    SELECT o_orderkey, CAST(trunc(CASE WHEN abs(x - p) > abs(x - p * 1.5e0) THEN p * 1.5e0
      WHEN abs(x - p) > abs(x - p * 0.75e0) THEN p * 0.75e0 ELSE p END) AS BIGINT) AS ram,
      CAST(p AS BIGINT) AS power FROM p""",
)
def round_pow2(spark, sf):
    x = F.col("o_totalprice")
    return a.table(spark, sf, "orders").select(
        "o_orderkey", numeric.round_pow2(x).alias("ram"), numeric.simple_pow2(x).alias("power")
    )


def _clean_sql(x: str) -> str:
    for pattern, new in text.CPU_NAME_RULES:
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return x


_CPU = "concat('AMD ', p_name, ' Threadripper ', p_size, '-Core Processor')"
_CPU2 = "concat('12th Gen ', p_brand, ' with Radeon Graphics')"


@query(
    "clean_names",
    f"SELECT p_partkey, {_clean_sql(_CPU)} AS first_name, {_clean_sql(_CPU2)} AS second_name FROM part",
)
def clean_names(spark, sf):
    first = F.concat(F.lit("AMD "), "p_name", F.lit(" Threadripper "), "p_size", F.lit("-Core Processor"))
    second = F.concat(F.lit("12th Gen "), "p_brand", F.lit(" with Radeon Graphics"))
    return a.table(spark, sf, "part").select(
        "p_partkey", text.clean_cpu_name(first).alias("first_name"), text.clean_cpu_name(second).alias("second_name")
    )


@query(
    "per_unit",
    f"""WITH {OFFERS}, x AS (SELECT l_orderkey AS machine_id, l_quantity AS cpu_cores, l_extendedprice AS cpu_ram,
        CAST(l_linenumber - 1 AS BIGINT) AS num_gpus, CASE WHEN l_returnflag = 'R' THEN CAST(l_linenumber - 1 AS BIGINT) ELSE 0 END AS used
        FROM lineitem)
    SELECT machine_id, num_gpus, used, CAST(trunc(CASE WHEN num_gpus = 0 THEN 0 ELSE cpu_cores / num_gpus END) AS BIGINT) AS cores,
      CAST(round_even(CASE WHEN num_gpus = 0 THEN 0 ELSE cpu_ram / num_gpus END, 0) AS BIGINT) AS ram,
      CASE WHEN num_gpus = 0 THEN 0 ELSE cpu_ram / num_gpus END AS dph,
      concat('[', used, '/', num_gpus, ']') AS rented_fraq, used = num_gpus AS all_rented, used > 0 AS any_rented
    FROM x""",
)
def per_unit(spark, sf):
    n = F.col("l_linenumber").cast("long") - 1
    rows = a.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("machine_id"),
        n.alias("num_gpus"),
        F.when(F.col("l_returnflag") == "R", n).otherwise(F.lit(0)).alias("used"),
        "l_quantity",
        "l_extendedprice",
    )
    return derive.per_unit(
        rows, "num_gpus", {"cores": "l_quantity"}, {"ram": "l_extendedprice"}, {"dph": "l_extendedprice"}, "used"
    ).drop("l_quantity", "l_extendedprice")


@query(
    "epoch_convert",
    f"""WITH {OBS} SELECT event_id, CAST(floor(ts / 86400) AS BIGINT) AS day, strftime(make_timestamp(ts * 1000000), '%Y-%m-%d %H:%M:%S') AS at,
        CAST(floor(cents / 86400) AS BIGINT) AS whole_days, round_even(cents / 7, 1) AS tenth FROM obs""",
)
def epoch_convert(spark, sf):
    return a.observations(spark, sf).select(
        "event_id",
        F.unix_date(numeric.epoch_to_date(F.col("ts"))).cast("long").alias("day"),
        F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd HH:mm:ss").alias("at"),
        numeric.whole_days(F.col("cents")).alias("whole_days"),
        F.bround(F.col("cents") / 7, 1).alias("tenth"),
    )


@query(
    "filter_sort_project",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
       WHERE l_extendedprice >= 50000 AND (l_returnflag = 'R' OR l_discount BETWEEN 0.05e0 AND 0.07e0)
         AND l_linestatus IN ('F') AND l_tax IS NOT NULL
       ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 1000""",
)
def filter_sort_project(spark, sf):
    rows = a.table(spark, sf, "lineitem").filter(
        (F.col("l_extendedprice") >= 50_000)
        & ((F.col("l_returnflag") == "R") | F.col("l_discount").between(0.05, 0.07))
        & F.col("l_linestatus").isin("F")
        & F.col("l_tax").isNotNull()
    )
    top = rows.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(1000)
    return top.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


_NARROW = {
    "l_orderkey": True, "l_linenumber": True, "l_quantity": True, "l_extendedprice": False, "l_discount": False,
}


def _narrow_sql() -> str:
    rows = []
    for c, whole in _NARROW.items():
        integer = f"""CASE WHEN min({c}) > -128 AND max({c}) < 127 THEN 'byte'
          WHEN min({c}) > -32768 AND max({c}) < 32767 THEN 'short'
          WHEN min({c}) > -2147483648 AND max({c}) < 2147483647 THEN 'int' ELSE 'long' END"""
        near = f"bool_and(abs({c} - round({c})) <= 1e-8 + 1e-5 * abs(round({c})))"
        rows.append(
            f"SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value, "
            f"{near} AS is_whole, CASE WHEN {near} THEN {integer} ELSE 'float' END AS narrow_type FROM lineitem"
        )
    return " UNION ALL ".join(rows)


@query("narrow_types", _narrow_sql())
def narrow_types(spark, sf):
    return derive.narrow_profile(a.table(spark, sf, "lineitem").select(*_NARROW))


# ---- offers to machines -------------------------------------------------------------------
@query("min_chunk", f"WITH {CHUNKS} SELECT machine_id, min_chunk FROM chunks")
def min_chunk(spark, sf):
    return split.machine_chunks(a.offers(spark, sf)).select("machine_id", "min_chunk")


@query("min_chunk_offers", f"WITH {CHUNKS} SELECT machine_id, id, num_gpus, rented, host_id FROM undivided")
def min_chunk_offers(spark, sf):
    return split.min_chunk_offers(a.offers(spark, sf))


@query(
    "group_argmax",
    f"""WITH {OFFERS} SELECT machine_id, id, num_gpus, rented FROM offers
        QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY num_gpus DESC, id DESC, rented DESC) = 1""",
)
def group_argmax(spark, sf):
    return split.group_argmax(
        a.offers(spark, sf), ["machine_id"], ["num_gpus", "id", "rented"], ["id", "num_gpus", "rented"]
    )


@query("rented_units", f"WITH {CHUNKS} SELECT machine_id, num_gpus_rented FROM units")
def rented_units(spark, sf):
    return split.machine_chunks(a.offers(spark, sf), rented="rented").select("machine_id", "num_gpus_rented")


@query("complete_groups", f"WITH {CHUNKS} SELECT machine_id, listed FROM units WHERE listed = whole")
def complete_groups(spark, sf):
    return split.complete_machines(a.offers(spark, sf)).select("machine_id", "listed")


@query(
    "split_machines",
    f"""WITH {CHUNKS}, top AS (
      SELECT machine_id, num_gpus, host_id FROM offers
      QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY num_gpus DESC, id DESC) = 1)
    SELECT machine_id, num_gpus, host_id, min_chunk, num_gpus_rented
    FROM top JOIN units USING (machine_id) WHERE listed = whole""",
)
def split_machines(spark, sf):
    return split.split_offers(a.offers(spark, sf))[0]


@query(
    "split_offers",
    f"""WITH {CHUNKS} SELECT machine_id, id, num_gpus, rented, host_id FROM undivided
        WHERE machine_id IN (SELECT machine_id FROM units WHERE listed = whole)""",
)
def split_offers(spark, sf):
    return split.split_offers(a.offers(spark, sf))[1]


@query(
    "group_reduce",
    f"""WITH {OFFERS} SELECT machine_id, CAST(sum(num_gpus) AS BIGINT) AS total, min(num_gpus) AS low,
        max(num_gpus) AS high FROM offers GROUP BY machine_id""",
)
def group_reduce(spark, sf):
    return split.group_reduce(
        a.offers(spark, sf), "machine_id",
        {"total": F.sum("num_gpus"), "low": F.min("num_gpus"), "high": F.max("num_gpus")},
    )


@query(
    "is_sorted_by_key",
    f"""WITH {OBS}, s AS (SELECT user_id, band, lag(band) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM obs)
    SELECT user_id, bool_and(coalesce(band >= p, true)) AS is_sorted FROM s GROUP BY user_id""",
)
def is_sorted_by_key(spark, sf):
    return split.is_sorted_by_key(a.observations(spark, sf), "user_id", "band", ["ts", "event_id"])


@query(
    "recent_distinct",
    f"""WITH {OBS}, seqs AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS s FROM obs GROUP BY user_id)
    SELECT user_id, array_to_string(list_reduce(
      list_concat([CAST([] AS VARCHAR[])], list_transform(s, lambda x: [x])),
      lambda q, x: CASE WHEN list_contains(q, x[1]) THEN q WHEN len(q) >= 3 THEN list_concat(q[2:], x)
                        ELSE list_concat(q, x) END), ',') AS recent
    FROM seqs""",
)
def recent_distinct(spark, sf):
    queue = recent_distinct_op(a.observations(spark, sf), "user_id", "event_type", ["ts", "event_id"], maxlen=3)
    return queue.select("user_id", F.array_join("recent", ",").alias("recent"))
