"""Queries on joins, profiles and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlog.functions.text import country_from_place
from fleetlog.operators import changes, profile, stats
from fleetlog.plans import adapters as a
from fleetlog.plans.registry import query
from fleetlog.session import new_run_dir
from fleetlog.sources import bucketed

OBS = a.OBS


# ---- joins --------------------------------------------------------------------------------
@query(
    "join_last",
    """WITH j AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, c_acctbal
                 FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT o_custkey, o_orderkey, o_totalprice, c_acctbal FROM j
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def join_last(spark, sf):
    # last row per key first: the join then sees one row per key
    last = changes.latest_snapshot(
        a.table(spark, sf, "orders"), ["o_custkey"], ["o_orderkey", "o_totalprice"], ["o_orderdate", "o_orderkey"]
    )
    cust = a.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return last.join(cust, "o_custkey")


_WIDE = """SELECT l_orderkey, l_linenumber, l_extendedprice, o_totalprice, o_orderpriority, c_mktsegment, c_acctbal,
      n_name, r_name
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def _wide(spark, sf):
    t = lambda name: a.table(spark, sf, name)
    # the fact table last: it is shuffled once, whatever the size of the others
    orders = (
        t("orders")
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


@query("wide_join", _WIDE)
def wide_join(spark, sf):
    return _wide(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "o_totalprice", "o_orderpriority", "c_mktsegment",
        "c_acctbal", "n_name", "r_name",
    )


# ---- the same joins on tables laid out by key ----------------------------------------------
_BUCKETS = 16


def _laid_out(spark, sf, name, key, rename=None):
    """A table bucketed by a key of its own, below the shared folder; the columns keep their names but the key."""
    df = a.table(spark, sf, name)
    if rename:
        df = df.withColumnRenamed(key, rename)
    path = new_run_dir(spark, f"bucketed-{name}")
    return bucketed.write_bucketed(df, f"fleetlog_{path.rsplit('-', 1)[1]}", [rename or key], _BUCKETS, path)


@query(
    "wide_join_bucketed",
    """SELECT l_orderkey, count(*) AS n_lines, round(sum(l_quantity), 2) AS quantity, max(o_totalprice) AS o_totalprice,
         max(o_custkey) AS o_custkey
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey""",
)
def wide_join_bucketed(spark, sf):
    lines = _laid_out(spark, sf, "lineitem", "l_orderkey")
    orders = _laid_out(spark, sf, "orders", "o_orderkey", "l_orderkey").select("l_orderkey", "o_totalprice", "o_custkey")
    joined = bucketed.join_co_located([lines.select("l_orderkey", "l_quantity"), orders], ["l_orderkey"])
    return joined.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"),
        F.max("o_totalprice").alias("o_totalprice"), F.max("o_custkey").alias("o_custkey"),
    )


@query(
    "join_last_bucketed",
    """WITH j AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice, c_acctbal, c_mktsegment
                 FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT o_custkey, o_orderkey, o_totalprice, c_acctbal, c_mktsegment FROM j
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def join_last_bucketed(spark, sf):
    orders = _laid_out(spark, sf, "orders", "o_custkey")
    customers = _laid_out(spark, sf, "customer", "c_custkey", "o_custkey").select("o_custkey", "c_acctbal", "c_mktsegment")
    last = changes.latest_snapshot(orders, ["o_custkey"], ["o_orderkey", "o_totalprice"], ["o_orderdate", "o_orderkey"])
    return bucketed.join_co_located([last, customers], ["o_custkey"])


_FREQUENT = """freq AS (SELECT c_nationkey, count(*) AS n FROM customer
  WHERE c_acctbal > 0 AND c_mktsegment <> 'MACHINERY' GROUP BY c_nationkey HAVING count(*) > 45)"""


def _active(spark, sf):
    return a.table(spark, sf, "customer").filter("c_acctbal > 0 and c_mktsegment <> 'MACHINERY'")


@query("group_count_having", f"WITH {_FREQUENT} SELECT * FROM freq")
def group_count_having(spark, sf):
    return profile.frequent_groups(_active(spark, sf), "c_nationkey", 45)


@query(
    "semi_join_frequent",
    f"WITH {_FREQUENT} SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM freq)",
)
def semi_join_frequent(spark, sf):
    keep = profile.frequent_groups(_active(spark, sf), "c_nationkey", 45)
    return a.table(spark, sf, "customer").join(keep, "c_nationkey", "left_semi").select("c_custkey", "c_nationkey")


@query(
    "group_means",
    """SELECT n_name, CAST(round_even(avg(o_totalprice), 0) AS BIGINT) AS o_totalprice_mean,
         CAST(round_even(avg(l_extendedprice), 0) AS BIGINT) AS l_extendedprice_mean,
         CAST(round_even(avg(c_acctbal), 0) AS BIGINT) AS c_acctbal_mean
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
         JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
)
def group_means(spark, sf):
    return profile.group_means(_wide(spark, sf), "n_name", ["o_totalprice", "l_extendedprice", "c_acctbal"])


# ---- profiles -----------------------------------------------------------------------------
@query(
    "value_counts",
    """SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS priority, count(*) AS n
       FROM orders GROUP BY 1""",
)
def value_counts(spark, sf):
    rows = a.table(spark, sf, "orders").select(
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("priority")
    )
    return profile.value_counts(rows, "priority")


@query("distinct_values", "SELECT DISTINCT p_type, p_brand FROM part")
def distinct_values(spark, sf):
    return a.table(spark, sf, "part").select("p_type", "p_brand").distinct()


@query("distinct_count", "SELECT count(DISTINCT l_orderkey) AS n_keys FROM lineitem")
def distinct_count(spark, sf):
    return a.table(spark, sf, "lineitem").agg(F.countDistinct("l_orderkey").alias("n_keys"))


_GAPPY = {"o_orderkey": "o_orderkey", "price": "CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice END",
          "status": "CASE WHEN o_orderkey % 500 = 0 THEN o_orderstatus END"}


@query(
    "missing_profile",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS column_name, count(*) FILTER (({e}) IS NULL) AS n_missing,
            count(*) FILTER (({e}) IS NULL) / count(*) AS share,
            count(*) FILTER (({e}) IS NULL) / count(*) > 0.99 AS is_empty FROM orders"""
        for n, e in _GAPPY.items()
    ),
)
def missing_profile(spark, sf):
    rows = a.table(spark, sf, "orders").select(*[F.expr(e).alias(n) for n, e in _GAPPY.items()])
    return profile.missing_profile(rows)


@query(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicate_keys(spark, sf):
    return profile.duplicate_keys(a.table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query(
    "derivation_mismatch",
    f"""WITH {a.LISTING}, d AS (SELECT machine_id, id, loc_country AS located,
        CASE WHEN trim(string_split(geolocation, ',')[-1]) = 'Sweden' THEN 'SE'
             ELSE trim(string_split(geolocation, ',')[-1]) END AS placed FROM raw)
    SELECT * FROM d WHERE located IS DISTINCT FROM placed""",
)
def derivation_mismatch(spark, sf):
    rows = a.raw_listing(spark, sf).select(
        "machine_id", "id", F.col("location.country").alias("located"),
        country_from_place(F.col("geolocation")).alias("placed"),
    )
    return profile.mismatch(rows, F.col("located"), F.col("placed"))


# Two snapshots of the orders: last order of each customer before and from a date on.
_CUT_DATE = "1998-07-01"
_SNAPS = f"""o AS (SELECT o_custkey, o_orderstatus AS status, o_orderpriority AS priority, CAST(trunc(o_totalprice / 50000) AS BIGINT) AS band,
    o_orderdate < TIMESTAMP '{_CUT_DATE}' AS old, o_orderdate, o_orderkey FROM orders),
  s AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey, old ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
  l AS (SELECT * FROM s WHERE old), r AS (SELECT * FROM s WHERE NOT old)"""


def _snapshots(spark, sf):
    orders = a.table(spark, sf, "orders").select(
        "o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
        (F.col("o_totalprice") / 50_000).cast("long").alias("band"), "o_orderdate", "o_orderkey",
    )
    cut = F.lit(_CUT_DATE).cast("timestamp")
    early, late = orders.filter(F.col("o_orderdate") < cut), orders.filter(F.col("o_orderdate") >= cut)
    cols, order = ["status", "priority", "band"], ["o_orderdate", "o_orderkey"]
    return tuple(changes.latest_snapshot(x, ["o_custkey"], cols, order) for x in (early, late))


@query(
    "snapshot_diff",
    f"WITH {_SNAPS} " + " UNION ALL ".join(
        f"""SELECT l.o_custkey, '{c}' AS column_name, CAST(l.{c} AS VARCHAR) AS left_value, CAST(r.{c} AS VARCHAR) AS right_value
            FROM l JOIN r USING (o_custkey) WHERE l.{c} IS DISTINCT FROM r.{c}"""
        for c in ("status", "priority", "band")
    ),
)
def snapshot_diff(spark, sf):
    return profile.snapshot_diff(*_snapshots(spark, sf), "o_custkey")


# The same orders with those of the last days priced anew.
@query(
    "snapshot_diff_digests",
    """SELECT o_orderkey, 'band' AS column_name, CAST(CAST(trunc(o_totalprice / 50000) AS BIGINT) AS VARCHAR) AS left_value,
              CAST(CAST(trunc(o_totalprice / 50000) AS BIGINT) + 1 AS VARCHAR) AS right_value
       FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 3 DAY""",
)
def snapshot_diff_digests(spark, sf):
    orders = a.table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", (F.col("o_totalprice") / 50_000).cast("long").alias("band"), "o_orderdate",
    )
    late = F.col("o_orderdate") >= orders.select(F.max("o_orderdate") - F.expr("INTERVAL 3 DAY")).scalar()
    newer = orders.withColumn("band", F.col("band") + F.when(late, 1).otherwise(0))
    return profile.snapshot_diff(orders, newer, "o_orderkey", ["o_orderstatus", "o_orderpriority", "band"], buckets=65_536)


@query("keys_only_left", f"WITH {_SNAPS} SELECT o_custkey FROM l WHERE o_custkey NOT IN (SELECT o_custkey FROM r)")
def keys_only_left(spark, sf):
    return profile.keys_only_left(*_snapshots(spark, sf), "o_custkey")


# ---- statistics: flag = returned line -----------------------------------------------------
_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_CATEGORICAL = ["l_linestatus", "l_linenumber"]
_FLAG = "l_returnflag = 'R'"


def _lines(spark, sf):
    return a.table(spark, sf, "lineitem").withColumn("rented", F.col("l_returnflag") == "R")


_CORR = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(corr(CAST({_FLAG} AS DOUBLE), {c}), 6) AS r, count({c}) AS n FROM lineitem"
    for c in _NUMERIC
)


# p of a correlation: Simpson's rule over the density of t, 4000 steps over 40 units
_CORR_P = f"""WITH c AS ({_CORR.replace("round(corr(", "(corr(").replace(", 6) AS r", ") AS r")}),
  t AS (SELECT *, n - 2 AS d, abs(r) * sqrt((n - 2) / (1 - r * r)) AS t FROM c),
  f AS (SELECT column_name, r, n, i, exp(lgamma((d + 1) / 2) - lgamma(d / 2)) / sqrt(d * pi())
          * power(1 + (t + i * 0.01e0) * (t + i * 0.01e0) / d, -(d + 1) / 2) AS y
        FROM t, range(4001) s(i))
  SELECT column_name, round(r, 6) AS r, n,
    round(2 * sum(y * CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * 0.01e0 / 3, 6) AS p_value
  FROM f GROUP BY column_name, r, n"""


def _point_biserial(spark, sf):
    rows = stats.point_biserial(_lines(spark, sf), "rented", _NUMERIC)
    return rows.select("column_name", F.round("r", 6).alias("r"), "n", F.round("p_value", 6).alias("p_value"))


@query("point_biserial", _CORR_P)
def point_biserial(spark, sf):
    return _point_biserial(spark, sf)


@query("point_biserial_p", f"SELECT column_name, p_value FROM ({_CORR_P})")
def point_biserial_p(spark, sf):
    return _point_biserial(spark, sf).select("column_name", "p_value")


@query(
    "corr_with_flag",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS column_name, round(corr(CAST({_FLAG} AS DOUBLE), CAST({e} AS DOUBLE)), 6) AS r, count({e}) AS n
            FROM lineitem"""
        for n, e in {
            "quantity": "CASE WHEN l_linenumber <> 3 THEN l_quantity END", "linenumber": "l_linenumber",
            "tax": "CASE WHEN l_tax > 0 THEN l_tax END",
        }.items()
    ),
)
def corr_with_flag(spark, sf):
    rows = _lines(spark, sf).select(
        "rented",
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("quantity"),
        F.col("l_linenumber").alias("linenumber"),
        F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("tax"),
        F.lit(1).alias("constant"),
    )
    found = stats.corr_with_flag(rows, "rented", ["quantity", "linenumber", "tax", "constant"])
    return found.select("column_name", F.round("r", 6).alias("r"), "n")


@query("crosstab", f"SELECT {_FLAG} AS rented, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2")
def crosstab(spark, sf):
    return stats.crosstab(_lines(spark, sf), "rented", "l_linenumber")


@query(
    "crosstab_wide",
    f"""SELECT {_FLAG} AS rented, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'O') AS O
        FROM lineitem GROUP BY 1""",
)
def crosstab_wide(spark, sf):
    return stats.crosstab_wide(_lines(spark, sf), "rented", "l_linestatus")


def _chi_sql(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, round(sum(power(abs(o - e) - CASE WHEN dof = 1 THEN least(0.5, abs(o - e)) ELSE 0 END, 2) / e), 6) AS statistic,
        max(dof) AS dof
      FROM (SELECT coalesce(o, 0) AS o, rn * cn / CAST(n AS DOUBLE) AS e,
              (SELECT count(DISTINCT {_FLAG}) - 1 FROM lineitem) * (SELECT count(DISTINCT {c}) - 1 FROM lineitem) AS dof
            FROM (SELECT {_FLAG} AS a, count(*) AS rn FROM lineitem GROUP BY 1) ra
            CROSS JOIN (SELECT {c} AS b, count(*) AS cn FROM lineitem GROUP BY 1) cb
            CROSS JOIN (SELECT count(*) AS n FROM lineitem) t
            LEFT JOIN (SELECT {_FLAG} AS a, {c} AS b, count(*) AS o FROM lineitem GROUP BY 1, 2) cells USING (a, b))"""


# p of the statistic: a closed sum for even degrees of freedom, Simpson's rule over the normal density for one
_CHI_P = f"""WITH c AS ({" UNION ALL ".join(f"({_chi_sql(c).replace(', 6) AS statistic', ', 12) AS statistic')})" for c in _CATEGORICAL)}),
  even AS (SELECT column_name, exp(-statistic / 2) * sum(power(statistic / 2, i) / gamma(i + 1)) AS p
    FROM c, range(1000) s(i) WHERE dof % 2 = 0 AND i < dof / 2 AND i < 100 GROUP BY column_name, statistic),
  one AS (SELECT column_name, 2 * sum(exp(-power(sqrt(statistic) + i * 0.005e0, 2) / 2) / sqrt(2 * pi())
      * CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * 0.005e0 / 3 AS p
    FROM c, range(4001) s(i) WHERE dof = 1 GROUP BY column_name, statistic)
  SELECT column_name, round(statistic, 6) AS statistic, dof, round(coalesce(even.p, one.p), 6) AS p_value
  FROM c LEFT JOIN even USING (column_name) LEFT JOIN one USING (column_name)"""


def _chi_square(spark, sf):
    rows = stats.chi_square(_lines(spark, sf), "rented", _CATEGORICAL)
    return rows.select("column_name", F.round("statistic", 6).alias("statistic"), "dof", F.round("p_value", 6).alias("p_value"))


@query("chi_square", _CHI_P)
def chi_square(spark, sf):
    return _chi_square(spark, sf)


@query("chi_square_p", f"SELECT column_name, p_value FROM ({_CHI_P})")
def chi_square_p(spark, sf):
    return _chi_square(spark, sf).select("column_name", "p_value")


@query(
    "zscore_filter",
    """SELECT o_orderkey, o_totalprice FROM orders
       WHERE (o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders) < 1.5""",
)
def zscore_filter(spark, sf):
    rows = stats.zscore_filter(a.table(spark, sf, "orders"), "o_totalprice", 1.5)
    return rows.select("o_orderkey", "o_totalprice")


@query(
    "quantile_clip",
    """SELECT c_custkey, c_acctbal FROM customer
       WHERE c_acctbal BETWEEN 0 AND (SELECT quantile_cont(c_acctbal, 0.95) FROM customer)""",
)
def quantile_clip(spark, sf):
    return stats.quantile_clip(a.table(spark, sf, "customer"), "c_acctbal").select("c_custkey", "c_acctbal")


@query(
    "box_summary",
    """WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median,
                 quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1),
    j AS (SELECT lineitem.l_returnflag, q1, median, q3, l_extendedprice AS x,
            l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
          FROM lineitem JOIN q USING (l_returnflag))
    SELECT l_returnflag, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, min(x) FILTER (inside) AS low_whisker,
      max(x) FILTER (inside) AS high_whisker, count(*) FILTER (NOT inside) AS n_outliers
    FROM j GROUP BY l_returnflag, q1, median, q3""",
)
def box_summary(spark, sf):
    rows = stats.box_summary(a.table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice")
    return rows.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


def _hist_sql(x: str, bins: int) -> str:
    return f"""WITH m AS (SELECT min({x}) AS lo, max({x}) AS hi FROM lineitem)
      SELECT least(CAST(floor(({x} - lo) * {bins}e0 / (hi - lo)) AS BIGINT), {bins - 1}) AS bin, {_FLAG} AS rented, count(*) AS n
      FROM lineitem, m GROUP BY 1, 2"""


@query("histogram_by_flag", _hist_sql("l_extendedprice", 64))
def histogram_by_flag(spark, sf):
    return stats.histogram_by_flag(_lines(spark, sf), "l_extendedprice", "rented", 64)


@query("histogram_by_flag_8", _hist_sql("l_linenumber", 8))
def histogram_by_flag_8(spark, sf):
    return stats.histogram_by_flag(_lines(spark, sf), "l_linenumber", "rented", 8)


@query("value_histogram", f"SELECT l_linenumber, {_FLAG} AS rented, count(*) AS n FROM lineitem GROUP BY 1, 2")
def value_histogram(spark, sf):
    return stats.value_histogram_by_flag(_lines(spark, sf), "l_linenumber", "rented")
