"""Queries on change capture, presence, roll-ups and time-lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlog.operators import changes, children, polls, presence, rollup, timeline
from fleetlog.operators.sequence import hot_keys
from fleetlog.plans import adapters as a
from fleetlog.plans.registry import query

OBS, SIGHTINGS, POLLS = a.OBS, a.SIGHTINGS, a.POLLS


# ---- index, maps, first rows --------------------------------------------------------------
@query("ts_index", f"WITH {SIGHTINGS} SELECT DISTINCT ts FROM seen")
def ts_index(spark, sf):
    return changes.distinct_index(a.sightings(spark, sf), "ts")


@query(
    "first_wins_map",
    """SELECT o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS o_orderpriority
       FROM orders GROUP BY o_custkey""",
)
def first_wins_map(spark, sf):
    return changes.first_wins_map(
        a.table(spark, sf, "orders"), "o_custkey", "o_orderpriority", ["o_orderdate", "o_orderkey"]
    )


@query(
    "first_seen_rows",
    """SELECT o_custkey, o_orderpriority, CAST(epoch(o_orderdate) AS BIGINT) AS ts FROM orders
       QUALIFY o_orderdate = min(o_orderdate) OVER (PARTITION BY o_custkey)""",
)
def first_seen_rows(spark, sf):
    rows = a.table(spark, sf, "orders").withColumn("ts", a.epoch_seconds(F.col("o_orderdate")))
    return changes.first_seen_rows(rows, "o_custkey", ["o_orderpriority"], "ts")


# ---- change log and snapshot --------------------------------------------------------------
_CHANGED = f"""WITH {OBS}, seq AS (
  SELECT *, row_number() OVER w AS rn, lag(event_type) OVER w AS p1, lag(band) OVER w AS p2,
         lag(k) OVER w AS p3 FROM obs WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query(
    "change_log",
    _CHANGED + " SELECT user_id, event_type, ts, event_id FROM seq WHERE rn = 1 OR event_type <> p1",
)
def change_log(spark, sf):
    obs = a.observations(spark, sf)
    return changes.change_log(obs, ["user_id"], ["event_type"], ["ts", "event_id"], keep=["event_id"])


@query(
    "change_log_multi",
    _CHANGED + """ SELECT user_id, event_type, band, ts FROM seq
    WHERE rn = 1 OR event_type IS DISTINCT FROM p1 OR band IS DISTINCT FROM p2""",
)
def change_log_multi(spark, sf):
    obs = a.observations(spark, sf)
    return changes.change_log(obs, ["user_id"], ["event_type", "band"], ["ts", "event_id"])


# The second half of the history as an increment on the state left by the first.
_CUT = 1_705_276_800


@query(
    "change_log_incremental",
    _CHANGED + f""" SELECT user_id, event_type, ts, event_id FROM seq
    WHERE ts >= {_CUT} AND (rn = 1 OR event_type <> p1)""",
)
def change_log_incremental(spark, sf):
    order = ["ts", "event_id"]
    state = changes.latest_snapshot(a.observations(spark, sf, before=_CUT), ["user_id"], ["event_type"], order)
    return changes.change_log(
        a.observations(spark, sf, since=_CUT), ["user_id"], ["event_type"], order, state, keep=["event_id"]
    )


@query(
    "latest_snapshot",
    f"""WITH {OBS} SELECT user_id, event_type, band, k FROM obs
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def latest_snapshot(spark, sf):
    return changes.latest_snapshot(
        a.observations(spark, sf), ["user_id"], ["event_type", "band", "k"], ["ts", "event_id"]
    )


@query(
    "snapshot_upsert",
    f"""WITH {OBS} SELECT user_id, event_type, k FROM obs
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def snapshot_upsert(spark, sf):
    cols, order = ["event_type", "k"], ["ts", "event_id"]
    old = changes.latest_snapshot(a.observations(spark, sf, before=_CUT), ["user_id"], cols, order)
    new = changes.latest_snapshot(a.observations(spark, sf, since=_CUT), ["user_id"], cols, order)
    return changes.upsert(old, changes.changed_in_poll(new, ["user_id"], cols, old), ["user_id"])


# Children l_suppkey of parent l_partkey: lines shipped before the date are the snapshot, the others the poll.
_SHIP_CUT = "2001-06-01"


@query(
    "child_set_snapshot",
    f"""WITH snap AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_shipdate < TIMESTAMP '{_SHIP_CUT}'),
       poll AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '{_SHIP_CUT}'),
       kept AS (SELECT * FROM snap WHERE NOT (l_partkey IN (SELECT l_partkey FROM poll)
                                             AND l_suppkey NOT IN (SELECT l_suppkey FROM poll)))
       SELECT * FROM kept
       UNION ALL
       SELECT * FROM poll WHERE l_partkey NOT IN (SELECT l_partkey FROM kept)""",
)
def child_set_snapshot(spark, sf):
    cut = F.lit(_SHIP_CUT).cast("timestamp")
    lines = a.table(spark, sf, "lineitem")
    pairs = lambda cond: lines.filter(cond).select("l_partkey", "l_suppkey").distinct()
    snap, poll = pairs(F.col("l_shipdate") < cut), pairs(F.col("l_shipdate") >= cut)
    return changes.child_set_snapshot(snap, poll, "l_partkey", "l_suppkey")


# All ship dates as polls: lines of a supplier, children by line number.
_CHILD_COLS = ["l_returnflag", "l_linestatus"]
_CHILD_SETS = """WITH RECURSIVE listed AS (
  SELECT l_suppkey, CAST(l_linenumber AS BIGINT) AS line, CAST(epoch(l_shipdate) AS BIGINT) AS ts,
         max({'f': l_returnflag, 's': l_linestatus}) AS v FROM lineitem GROUP BY ALL),
polls AS (
  SELECT l_suppkey, ts, row_number() OVER (PARTITION BY l_suppkey ORDER BY ts) AS no, list({'c': line, 'v': v}) AS now
  FROM listed GROUP BY l_suppkey, ts),
folded AS (
  SELECT l_suppkey, ts, no, now, [] :: STRUCT(c BIGINT, v STRUCT(f VARCHAR, s VARCHAR))[] AS held, now AS after FROM polls WHERE no = 1
  UNION ALL
  SELECT p.l_suppkey, p.ts, p.no, p.now, f.after,
         CASE WHEN len(list_filter(f.after, lambda x: list_contains(list_transform(p.now, lambda y: y.c), x.c))) > 0
              THEN list_filter(f.after, lambda x: list_contains(list_transform(p.now, lambda y: y.c), x.c)) ELSE p.now END
  FROM folded f JOIN polls p ON p.l_suppkey = f.l_suppkey AND p.no = f.no + 1)"""


def _child_sets(spark, sf):
    value = F.max(F.struct(*_CHILD_COLS)).alias("_v")
    lines = a.table(spark, sf, "lineitem").groupBy(
        "l_suppkey", F.col("l_linenumber").cast("long").alias("line"), a.epoch_seconds(F.col("l_shipdate")).alias("ts")
    ).agg(value)
    return children.child_sets(lines.select("l_suppkey", "line", "ts", "_v.*"), "l_suppkey", "line", _CHILD_COLS, "ts")


@query(
    "child_set_log",
    _CHILD_SETS + """, new AS (
  SELECT l_suppkey, ts, unnest(list_filter(now, lambda x: NOT list_contains(held, x))) AS x FROM folded)
SELECT l_suppkey, x.c AS line, x.v.f AS l_returnflag, x.v.s AS l_linestatus, ts FROM new""",
)
def child_set_log(spark, sf):
    return _child_sets(spark, sf)[0]


@query(
    "child_set_latest",
    _CHILD_SETS + """, last AS (
  SELECT l_suppkey, unnest(after) AS x FROM folded QUALIFY no = max(no) OVER (PARTITION BY l_suppkey))
SELECT l_suppkey, x.c AS line, x.v.f AS l_returnflag, x.v.s AS l_linestatus FROM last""",
)
def child_set_latest(spark, sf):
    return _child_sets(spark, sf)[1]


_LOG_COLS = ("event_type", "band", "k")


@query(
    "change_counts",
    _CHANGED + """, n AS (
      SELECT count(*) FILTER (rn = 1 OR event_type IS DISTINCT FROM p1) AS c1,
             count(*) FILTER (rn = 1 OR band IS DISTINCT FROM p2) AS c2,
             count(*) FILTER (rn = 1 OR k IS DISTINCT FROM p3) AS c3 FROM seq)
    SELECT 'event_type' AS table_name, c1 AS n_rows FROM n UNION ALL SELECT 'band', c2 FROM n
    UNION ALL SELECT 'k', c3 FROM n UNION ALL SELECT 'total', c1 + c2 + c3 FROM n""",
)
def change_counts(spark, sf):
    obs = a.observations(spark, sf)
    logs = {c: changes.change_log(obs, ["user_id"], [c], ["ts", "event_id"]) for c in _LOG_COLS}
    return changes.change_counts(logs)


# ---- roll-ups -----------------------------------------------------------------------------
def _period_sql(period: int, columns: str, key: str) -> str:
    return f"""WITH {OBS}, p AS (
      SELECT {key}, cents, k, CAST(ceil(ts / {period}.0) * {period} AS BIGINT) AS ts FROM obs)
    SELECT {key}, {columns}, ts FROM p WHERE ts < (SELECT max(ts) FROM p) GROUP BY {key}, ts"""


def _avg_std_sql(c: str) -> str:
    return f"CAST(round(avg({c})) AS BIGINT) AS {c}_avg, round(stddev_pop({c}), 2) AS {c}_std"


@query("period_avg_std", _period_sql(86_400, _avg_std_sql("cents") + ", " + _avg_std_sql("k"), "user_id"))
def period_avg_std(spark, sf):
    return rollup.period_avg_std(a.observations(spark, sf), "user_id", ["cents", "k"], "ts")


@query("period_avg_std_5min", _period_sql(300, _avg_std_sql("cents"), "event_type"))
def period_avg_std_5min(spark, sf):
    return rollup.period_avg_std(a.observations(spark, sf), "event_type", ["cents"], "ts", period=300)


@query(
    "daily_resample",
    f"""WITH {OBS} SELECT user_id, CAST(floor(ts / 86400) AS BIGINT) AS day,
        CAST(round_even(avg(cents), 0) AS BIGINT) AS cents_avg,
        CAST(floor(coalesce(stddev_samp(cents), 0)) AS BIGINT) AS cents_std
        FROM obs GROUP BY 1, 2""",
)
def daily_resample(spark, sf):
    return rollup.daily_resample(a.observations(spark, sf), "user_id", ["cents"], "ts")


# ---- presence -----------------------------------------------------------------------------
_PRESENCE = f"""WITH {SIGHTINGS}, {POLLS}, born AS (
  SELECT user_id, min(ts) AS b FROM seen GROUP BY user_id),
grid AS (
  SELECT born.user_id, polls.ts, CASE WHEN seen.ts IS NULL THEN 0 ELSE 1 END AS online
  FROM born JOIN polls ON polls.ts >= b
  LEFT JOIN seen ON seen.user_id = born.user_id AND seen.ts = polls.ts),
log AS (
  SELECT user_id, CAST(online AS BIGINT) AS online, ts FROM grid
  QUALIFY online IS DISTINCT FROM lag(online) OVER (PARTITION BY user_id ORDER BY ts))"""


@query("presence_log", _PRESENCE + " SELECT * FROM log")
def presence_log(spark, sf):
    return presence.presence_log(a.sightings(spark, sf), "user_id", "ts")


@query(
    "presence_state",
    _PRESENCE + " SELECT user_id, arg_max(online, ts) AS online, max(ts) AS ts FROM log GROUP BY user_id",
)
def presence_state(spark, sf):
    log = presence.presence_log(a.sightings(spark, sf), "user_id", "ts")
    return presence.presence_state(log, "user_id", "ts")


# ---- time-lines ---------------------------------------------------------------------------
@query(
    "drop_consecutives",
    _CHANGED + """ SELECT user_id, ts, event_id, event_type, k, band, cents FROM seq
    WHERE rn = 1 OR event_type <> p1 OR band <> p2""",
)
def drop_consecutives(spark, sf):
    return timeline.drop_consecutives(
        a.observations(spark, sf), ["user_id"], ["event_type", "band"], ["ts", "event_id"]
    )


@query(
    "staircase",
    f"""WITH {OBS}, seq AS (
      SELECT user_id, band, ts, lag(band) OVER w AS p, row_number() OVER w AS rn FROM obs
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, band, ts FROM seq UNION ALL SELECT user_id, p, ts - 1 FROM seq WHERE rn > 1""",
)
def staircase(spark, sf):
    return timeline.staircase(a.observations(spark, sf), "user_id", "band", ["ts", "event_id"])


def _purchase_log(spark, sf):
    return a.value_log(spark, sf, "purchase", "band", "band")


_DENSE = f"""WITH {OBS}, {SIGHTINGS}, {POLLS}, log AS ({a.value_log_sql('purchase', 'band', 'band')}),
dense AS (
  SELECT u.user_id, polls.ts, log.band
  FROM (SELECT DISTINCT user_id FROM log) u CROSS JOIN polls
  ASOF LEFT JOIN log ON log.user_id = u.user_id AND log.ts <= polls.ts)"""


@query("densify", _DENSE + " SELECT user_id, band, ts FROM dense")
def densify(spark, sf):
    return timeline.densify(_purchase_log(spark, sf), "user_id", ["band"], a.poll_times(spark, sf), "ts")


@query(
    "zero_counts",
    _DENSE + """ SELECT user_id, count(*) AS n_polls, count(*) FILTER (band = 0) AS n_zero,
      coalesce(bool_or(band = 0), false) AS any_zero, count(*) FILTER (coalesce(band, 0) <> 0) AS n_nonzero
    FROM dense GROUP BY user_id""",
)
def zero_counts(spark, sf):
    return timeline.zero_counts_of_log(_purchase_log(spark, sf), "user_id", "band", a.poll_times(spark, sf), "ts")


_ALIGN_ROLES = {
    "k": ("click", "k"), "band": ("view", "band"), "cents": ("purchase", "cents"),
    "joined": ("signup", "band"), "fault": ("error", "k"),
}
_ROLES = ", ".join(_ALIGN_ROLES)


def _logs(spark, sf):
    return {n: a.value_log(spark, sf, e, c, n) for n, (e, c) in _ALIGN_ROLES.items()}


_LOGS = ", ".join(f"log_{n} AS ({a.value_log_sql(e, c, n)})" for n, (e, c) in _ALIGN_ROLES.items())
_VALUES = ", ".join(f"log_{n}.{n}" for n in _ALIGN_ROLES)


def _asof(key: str, ts: str) -> str:
    return " ".join(f"ASOF LEFT JOIN log_{n} ON log_{n}.user_id = {key} AND log_{n}.ts <= {ts}" for n in _ALIGN_ROLES)


def _union(cols: str) -> str:
    return " UNION ".join(f"SELECT {cols} FROM log_{n}" for n in _ALIGN_ROLES)


@query(
    "asof_align",
    f"""WITH {OBS}, {SIGHTINGS}, {POLLS}, {_LOGS}, users AS ({_union("user_id")}),
    joined_logs AS (
      SELECT u.user_id, polls.ts, {_VALUES} FROM users u CROSS JOIN polls {_asof("u.user_id", "polls.ts")})
    SELECT user_id, {_ROLES}, ts FROM joined_logs
    WHERE {" OR ".join(f"{n} IS NOT NULL" for n in _ALIGN_ROLES)}""",
)
def asof_align(spark, sf):
    return timeline.asof_align(_logs(spark, sf), "user_id", a.poll_times(spark, sf), "ts")


@query(
    "asof_align_distinct",
    f"""WITH {OBS}, {_LOGS}, times AS ({_union("user_id, ts")}),
    joined_logs AS (SELECT t.user_id, t.ts, {_VALUES} FROM times t {_asof("t.user_id", "t.ts")})
    SELECT user_id, {_ROLES}, min(ts) AS ts FROM joined_logs WHERE k IS NOT NULL GROUP BY user_id, {_ROLES}""",
)
def asof_align_distinct(spark, sf):
    return timeline.asof_align_distinct(_logs(spark, sf), "user_id", "k", "ts")


@query("union_ts_index", f"WITH {OBS} SELECT DISTINCT ts FROM obs")
def union_ts_index(spark, sf):
    return timeline.union_index(list(_logs(spark, sf).values()), "ts")


# Poll index of the interval operators: every second in which an event was seen.
_GAPS = f"""WITH {OBS}, idx AS (SELECT DISTINCT ts FROM obs),
gaps AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS prev_ts, ts - lag(ts) OVER (ORDER BY ts) AS gap FROM idx)"""


def _index(spark, sf):
    return polls.poll_index(
        a.table(spark, sf, "events").select(a.epoch_seconds(F.col("ts")).alias("ts")), "ts"
    )


@query(
    "interval_stats",
    _GAPS + """ SELECT count(gap) AS n, round(avg(gap), 6) AS mean, round(stddev_samp(gap), 6) AS std,
      min(gap) AS min, quantile_cont(gap, 0.25) AS p25, quantile_cont(gap, 0.5) AS p50,
      quantile_cont(gap, 0.75) AS p75, max(gap) AS max FROM gaps""",
)
def interval_stats(spark, sf):
    return timeline.interval_stats(_index(spark, sf), "ts")


@query(
    "interval_mode",
    _GAPS + """ SELECT gap, count(*) AS n FROM gaps WHERE gap IS NOT NULL GROUP BY gap
      ORDER BY n DESC, gap LIMIT 1""",
)
def interval_mode(spark, sf):
    return timeline.interval_mode(_index(spark, sf), "ts")


@query(
    "interval_histogram",
    _GAPS + """ SELECT CAST(floor(gap * 100 / 1000.0) AS BIGINT) AS bin, count(*) AS n FROM gaps
      WHERE gap < 1000 GROUP BY 1""",
)
def interval_histogram(spark, sf):
    return timeline.interval_histogram(_index(spark, sf), limit=1000, bins=100, ts="ts")


@query("gap_intervals", _GAPS + " SELECT prev_ts + 1 AS gap_start, ts - 1 AS gap_end FROM gaps WHERE gap > 300")
def gap_intervals(spark, sf):
    return timeline.gap_intervals(_index(spark, sf), 300, "ts")


@query(
    "gap_null_rows",
    _GAPS + """ SELECT CAST(NULL AS BIGINT) AS cost, ts FROM (SELECT ts FROM gaps WHERE gap > 300
      UNION SELECT prev_ts FROM gaps WHERE gap > 300)""",
)
def gap_null_rows(spark, sf):
    return timeline.gap_null_rows(_index(spark, sf), "cost", 300, "ts")


# ---- transitions: state = is the event a purchase -----------------------------------------
_STATES = f"""WITH {OBS}, st AS (
  SELECT user_id, CAST(event_type = 'purchase' AS BIGINT) AS state, ts, event_id FROM obs),
log AS (
  SELECT * FROM st QUALIFY state IS DISTINCT FROM lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id)),
tr AS (
  SELECT user_id, state, ts, event_id FROM log
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
  QUALIFY (state = 0 AND lead(state) OVER w = 1) OR (state = 1 AND lag(state) OVER w = 0))"""


def _hot_users(spark, sf):
    """Counted once on the plain events for a chain of operators on users."""
    return hot_keys(a.observations(spark, sf), ["user_id"], "ts")


def _state_log(spark, sf, hot):
    st = a.observations(spark, sf).select(
        "user_id", (F.col("event_type") == "purchase").cast("long").alias("state"), "ts", "event_id"
    )
    return timeline.drop_consecutives(st, ["user_id"], ["state"], ["ts", "event_id"], hot=hot)


@query("transition_rows", _STATES + " SELECT * FROM tr")
def transition_rows(spark, sf):
    hot = _hot_users(spark, sf)
    log = _state_log(spark, sf, hot)
    return timeline.transition_rows(log, "user_id", "state", ["ts", "event_id"], hot=hot)


@query("first_per_state", _STATES + " SELECT user_id, state, min(ts) AS ts FROM tr GROUP BY user_id, state")
def first_per_state(spark, sf):
    return timeline.first_per_state(transition_rows(spark, sf), "user_id", "state", "ts")


_DURATIONS = _STATES + """, dur AS (
  SELECT user_id, CAST(floor(max(ts) / 86400) - floor(min(ts) / 86400) AS BIGINT) AS duration_days,
         CAST(floor(max(ts) / 86400) AS BIGINT) AS last_day FROM tr GROUP BY user_id)"""


def _durations(spark, sf):
    return timeline.transition_duration(transition_rows(spark, sf), "user_id", "ts")


@query("transition_duration", _DURATIONS + " SELECT * FROM dur")
def transition_duration(spark, sf):
    return _durations(spark, sf).select(
        "user_id", "duration_days", F.unix_date("last_date").cast("long").alias("last_day")
    )


@query("transition_dates", _DURATIONS + " SELECT last_day, count(*) AS n FROM dur GROUP BY last_day")
def transition_dates(spark, sf):
    days = _durations(spark, sf).select(F.unix_date("last_date").cast("long").alias("last_day"))
    return days.groupBy("last_day").agg(F.count(F.lit(1)).alias("n"))


@query(
    "duration_by_attr",
    _DURATIONS + """ SELECT c_mktsegment, round(avg(duration_days), 6) AS mean_days, count(*) AS n
      FROM dur JOIN customer ON c_custkey = user_id GROUP BY c_mktsegment""",
)
def duration_by_attr(spark, sf):
    segment = a.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return timeline.duration_by_attribute(_durations(spark, sf), segment, "user_id", "c_mktsegment")


_CHURN = _CHANGED + """, log AS (SELECT * FROM seq WHERE rn = 1 OR event_type <> p1),
busy AS (SELECT user_id, count(*) AS n_changes FROM log GROUP BY user_id HAVING count(*) > 50)"""


@query("churn_keys", _CHURN + " SELECT * FROM busy")
def churn_keys(spark, sf):
    return timeline.churn_keys(change_log(spark, sf), "user_id", 50)


@query("churn_rows", _CHURN + " SELECT user_id, event_type, ts, event_id FROM log WHERE user_id IN (SELECT user_id FROM busy)")
def churn_rows(spark, sf):
    log = change_log(spark, sf)
    return timeline.rows_of(log, timeline.churn_keys(log, "user_id", 50), "user_id")


def _edge_row_sql(direction: str) -> str:
    return f"""WITH {OBS} SELECT user_id, event_type, cents, ts FROM obs
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts {direction}, event_id {direction}) = 1"""


@query("first_row_per_key", _edge_row_sql("ASC"))
def first_row_per_key(spark, sf):
    cols, order = ["event_type", "cents", "ts"], ["ts", "event_id"]
    return timeline.first_row_per_key(a.observations(spark, sf), "user_id", cols, order)


@query("last_row_per_key", _edge_row_sql("DESC"))
def last_row_per_key(spark, sf):
    cols, order = ["event_type", "cents", "ts"], ["ts", "event_id"]
    return timeline.last_row_per_key(a.observations(spark, sf), "user_id", cols, order)


@query(
    "missing_ts",
    f"""WITH {OBS} SELECT DISTINCT ts FROM obs WHERE event_type = 'click'
        EXCEPT SELECT ts FROM obs WHERE event_type = 'view'""",
)
def missing_ts(spark, sf):
    obs = a.observations(spark, sf)
    return timeline.missing_times(
        obs.filter("event_type = 'click'"), obs.filter("event_type = 'view'"), "ts"
    )


@query(
    "changes_per_day",
    _CHANGED + """ SELECT CAST(floor(ts / 86400) AS BIGINT) AS day, count(*) AS n_changes FROM seq
      WHERE rn = 1 OR event_type <> p1 GROUP BY 1""",
)
def changes_per_day(spark, sf):
    return timeline.changes_per_day(change_log(spark, sf), "ts")
