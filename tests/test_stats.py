import math
import random
import struct

import pytest
from helpers import rows
from pyspark.sql import functions as F

from fleetlog.functions import special
from fleetlog.operators import derive, normalize, profile, quantiles, stats
from fleetlog.operators.quantiles import exact_quantiles


def linear_quantile(xs, q):
    xs = sorted(xs)
    pos = q * (len(xs) - 1)
    i = int(pos)
    return xs[i] + (xs[min(i + 1, len(xs) - 1)] - xs[i]) * (pos - i)


def test_chi_square_2x2(spark):
    cells = {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 20, ("b", "y"): 10}
    data = [k for k, n in cells.items() for _ in range(n)]
    df = spark.createDataFrame(data, "flag string, c string")
    r = stats.chi_square(df, "flag", ["c"]).first()
    assert (r.statistic, r.dof) == (pytest.approx(5.4), 1)
    assert r.p_value == pytest.approx(0.020136751550346385)


def brute_chi(data):
    a, b = sorted({r[0] for r in data}), sorted({r[1] for r in data})
    n, dof, total = len(data), (len(a) - 1) * (len(b) - 1), 0.0
    for x in a:
        for y in b:
            o = sum(r == (x, y) for r in data)
            e = sum(r[0] == x for r in data) * sum(r[1] == y for r in data) / n
            d = abs(o - e)
            total += (d - (min(0.5, d) if dof == 1 else 0)) ** 2 / e
    return total, dof


@pytest.mark.parametrize("flags,cats,drop", [("ab", "xy", ("a", "x")), ("ab", "wxyz", ("b", "w")), ("abc", "xyz", None), ("a", "xy", None)])
def test_chi_square_with_empty_cells(spark, flags, cats, drop):
    rnd = random.Random(len(cats))
    data = [(rnd.choice(flags), rnd.choice(cats)) for _ in range(80)]
    data = [r for r in data if r != drop]
    df = spark.createDataFrame(data + [(None, "x"), ("a", None)], "flag string, c string")
    r = stats.chi_square_statistics(df, "flag", ["c"]).first()
    want, dof = brute_chi(data)
    assert (r.statistic, r.dof) == (pytest.approx(want), dof)


def test_correlation(spark):
    data = [(True, 1.0, 1.0), (True, 2.0, 1.0), (False, 0.0, 1.0), (False, None, 1.0), (False, 1.0, 1.0)]
    df = spark.createDataFrame(data, "f boolean, x double, flat double")
    r = stats.point_biserial(df, "f", ["x", "flat"]).collect()
    assert [(x.column_name, x.n) for x in r] == [("x", 4)]
    assert r[0].r == pytest.approx(1 / math.sqrt(2))
    assert r[0].p_value == pytest.approx(1 - 1 / math.sqrt(2))


@pytest.mark.parametrize("n,bits", [(1, 16), (2, 16), (37, 16), (3000, 13), (3000, 16)])
def test_exact_quantiles(spark, n, bits):
    rnd = random.Random(n)
    xs = [rnd.choice([rnd.gauss(0, 1), 0.5, 0.5]) for _ in range(n)]
    ys = [rnd.random() for _ in range(n)]
    probs = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    df = spark.createDataFrame([("x", v) for v in xs] + [(None, v) for v in ys] + [("x", None)], "g string, v double")
    got = {r.g: r for r in exact_quantiles(df, "v", probs, ["g"], bits).collect()}
    for g, vs in (("x", xs), (None, ys)):
        for i, q in enumerate(probs):
            assert got[g][f"q{i}"] == pytest.approx(linear_quantile(vs, q), abs=1e-12)
    whole = exact_quantiles(df, "v", [0.5], bits=bits).first()
    assert whole.q0 == pytest.approx(linear_quantile(xs + ys, 0.5), abs=1e-12)


def test_quantile_counters_are_bounded(spark):
    """Of a million different values, each round orders at most 65,536 counters per group and rank."""
    df = spark.range(1_000_000).select((F.col("id") * 1e-3 - 300).alias("v"))
    got = exact_quantiles(df, "v", [0.5]).first().q0
    assert got == pytest.approx(df.agg(F.percentile("v", 0.5)).first()[0], abs=1e-12)
    rows_ = quantiles.with_key(df.select(F.col("v").alias("_v")), "_v")
    chosen, seen = None, 0
    for width in quantiles.bit_widths(16):
        cells = quantiles.count_cells(rows_, chosen, [], seen, width).cache()
        assert cells.groupBy("_cell").count().agg(F.max("count")).first()[0] <= 65_536
        assert chosen is None or cells.agg(F.sum("_c")).first()[0] < 1_000_000
        chosen = quantiles.pick_cells(cells, [], width, [0.5] if chosen is None else None).cache()
        assert chosen.count() <= 2
        seen += width


def test_ordered_keys(spark):
    """Keys are the bits of the doubles, mirrored below zero."""
    rnd = random.Random(4)
    xs = [0.0, -0.0, 5e-324, 2.0**-1022, math.nextafter(2.0**-1022, 0), 1.7976931348623157e308, math.inf, 1.0]
    xs += [f(2.0**e) for e in range(-1073, 1023, 7) for f in (float, lambda y: math.nextafter(y, 0), lambda y: math.nextafter(y, math.inf))]
    xs += [struct.unpack("<d", struct.pack("<q", rnd.randrange(2047 << 52)))[0] for _ in range(2000)]
    xs += [-x for x in xs]
    df = quantiles.with_key(spark.createDataFrame([(x,) for x in xs], "x double"), "x", "key")
    for r in df.collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(r.x)))[0]
        assert r.key == (-bits if r.x < 0 else bits)
    assert df.filter("x = 0 AND key = 0").count() == 4
    top = df.agg(F.max("key")).first()[0]
    assert quantiles.with_key(spark.sql("SELECT double('NaN') AS x"), "x").first()[1] > top


def test_quantiles_of_odd_numbers(spark):
    df = spark.createDataFrame([(x,) for x in (-math.inf, -1.0, 0.0, math.inf, math.inf)], "v double")
    got = exact_quantiles(df, "v", [0.0, 0.25, 0.375, 0.9, 1.0]).first()
    assert list(got) == [-math.inf, -1.0, -0.5, math.inf, math.inf]
    assert math.isnan(exact_quantiles(df.union(spark.sql("SELECT double('NaN')")), "v", [1.0]).first().q0)


def test_box_summary(spark):
    xs = [float(x) for x in range(1, 12)] + [100.0]
    r = stats.box_summary(spark.createDataFrame([("g", x) for x in xs], "g string, x double"), "g", "x").first()
    assert (r.q1, r.median, r.q3) == (3.75, 6.5, 9.25)
    assert (r.low_whisker, r.high_whisker, r.n_outliers) == (1.0, 11.0, 1)


def test_zscore_and_clip(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 100, -5]], "x double")
    assert (100.0,) not in rows(stats.zscore_filter(df, "x"))
    assert rows(stats.quantile_clip(df, "x", 0.8)) == [(1.0,), (2.0,), (3.0,), (4.0,)]
    assert stats.zscore_filter(df.filter("x = 1"), "x").count() == 0


def test_histogram(spark):
    df = spark.createDataFrame([(float(x), x > 4) for x in range(9)], "x double, f boolean")
    got = rows(stats.histogram_by_flag(df, "x", "f", 4))
    # the last bin is closed: 8 falls into bin 3
    assert got == [(0, False, 2), (1, False, 2), (2, False, 1), (2, True, 1), (3, True, 3)]
    flat = df.select(F.lit(1.0).alias("x"), "f")
    assert rows(stats.histogram_by_flag(flat, "x", "f", 4)) == [(0, False, 5), (0, True, 4)]
    assert rows(stats.crosstab_wide(df, "f", "x", [1.0, 8.0])) == [(False, 1, 0), (True, 0, 1)]
    rest = stats.crosstab_wide(df, "f", "x", [1.0, 8.0], rest="others").select("f", "others")
    assert rows(rest) == [(False, 4), (True, 3)]
    assert len(stats.crosstab_wide(df, "f", "x").columns) == 1 + df.select("x").distinct().count()


def test_p_values_of_large_samples():
    """Against the normal limit and the expansion around the median of chi-square."""
    for dof in (10**4, 10**6, 10**8, 10**10, 10**12):
        assert abs(special.chi_square_p(dof * (1 - 2 / (9 * dof)) ** 3, dof) - 0.5) < 1e-6
        assert abs(special.chi_square_p(dof + 2 * (2 * dof) ** 0.5, dof) - 0.0227501319) < 0.08 / dof**0.5
        assert special.chi_square_p(0.5 * dof, dof) == pytest.approx(1.0)
        assert special.chi_square_p(2.0 * dof, dof) < 1e-100
        t = 1.0
        assert abs(special.correlation_p(t / (dof + t * t) ** 0.5, dof + 2) - 0.31731050786) < 0.3 / dof + 1e-11
    for s, x in ((2000, 1900), (2000, 2000), (2000, 2150)):
        assert special.gamma_upper_large(s, x) == pytest.approx(special.gamma_upper(s, x), rel=1e-9)
    for dof, t in ((2000, 0.5), (2000, 4.0)):
        exact = special.beta_inc(dof / 2, 0.5, dof / (dof + t * t))
        assert special.student_two_sided_large(t, dof) == pytest.approx(exact, rel=1e-9)


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (2, None), (2, "a")], "k long, s string")
    assert rows(profile.missing_profile(df)) == [("k", 0, 0.0, False), ("s", 2, 2 / 3, False)]
    assert rows(profile.duplicate_keys(df, "k")) == [(2, 2)]
    assert [tuple(r) for r in profile.value_counts(df, "s").collect()] == [(None, 2), ("a", 1)]
    right = spark.createDataFrame([(1, "b"), (3, "c")], "k long, s string")
    left = spark.createDataFrame([(1, None), (2, "c")], "k long, s string")
    assert rows(profile.snapshot_diff(left, right, "k")) == [(1, "s", None, "b")]
    assert rows(profile.keys_only_left(left, right, "k")) == [(2,)]
    assert profile.columns_only_left(left.withColumn("z", F.lit(1)), right) == ["z"]


def test_narrow_types(spark):
    df = spark.createDataFrame(
        [(1, 1.0, 0.5, 40_000, 127.0, None), (100, -3.0, 1e39, 70, 2.0, 1.0)],
        "a long, b double, c double, d long, e double, f double",
    )
    plan = dict(rows(derive.narrow_profile(df), "column_name", "narrow_type"))
    # 127 is the byte bound itself: strict bounds move on to short
    assert plan == {"a": "byte", "b": "byte", "c": "double", "d": "int", "e": "short", "f": "float"}
    narrow = derive.narrow_types(df)
    assert dict(narrow.dtypes)["a"] == "tinyint" and rows(narrow, "a") == [(1,), (100,)]
    assert dict(rows(derive.narrow_profile(df, ["b"], int_cast=False), "column_name", "narrow_type")) == {"b": "float"}


def test_per_unit(spark):
    df = spark.createDataFrame([(4, 10, 7, 4), (0, 5, 5, 0)], "n long, cores long, ram long, used long")
    got = derive.per_unit(df, "n", {"c": "cores"}, {"r": "ram"}, {"x": "cores"}, "used")
    assert rows(got, "c", "r", "x", "rented_fraq", "all_rented", "any_rented") == [
        (0, 0, 0.0, "[0/0]", True, False), (2, 2, 2.5, "[4/4]", True, True),
    ]


def test_normalize(spark):
    from fleetlog import schema as s

    raw = spark.createDataFrame(
        [
            (7, 1, True, None, 0.98765, "verified", "x, Sweden", None, 25.0, 4.0, 2048.0, 1.5, 43201.0, 0.0125, " gpu "),
            (8, 2, False, 3.0, None, None, None, ("US", " isp "), None, 95.0, None, None, None, None, None),
        ],
        "machine_id long, num_gpus long, rentable boolean, reliability double, reliability2 double, verification string, "
        "geolocation string, location struct<country:string,isp:string>, bw_nvlink double, disk_space double, cpu_ram double, "
        "pcie_bw double, end_date double, dph_base double, gpu_name string",
    )
    out = normalize.normalize(raw)
    assert "geolocation" not in out.columns and set(out.columns) <= set(s.KEEP_COLS)
    a, b = out.orderBy("machine_id").collect()
    assert (a.rented, a.reliability, a.verification, a.country, a.isp) == (0, 9876, 1, "SE", "")
    assert (a.bw_nvlink, a.disk_space, a.cpu_ram, a.pcie_bw, a.end_date, a.dph_base, a.gpu_name) == (20, 10, 2, 15, 86400, 12, "gpu")
    assert (b.rented, b.reliability, b.verification, b.country, b.isp) == (1, 0, 0, "US", "isp")
    assert (b.bw_nvlink, b.disk_space, b.cpu_ram, b.end_date, b.gpu_name) == (0, 100, 0, 0, "")


def test_quantiles_with_many_ties(spark):
    """Two values in a third of the rows each, few bits a round."""
    rnd = random.Random(9)
    xs = [rnd.choice([0.0, 1.0, rnd.gauss(0, 50)]) for _ in range(5000)]
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    got = exact_quantiles(df, "v", [0.05, 0.5, 0.93], bits=11).first()
    assert [got.q0, got.q1, got.q2] == pytest.approx([linear_quantile(xs, q) for q in (0.05, 0.5, 0.93)])
    assert exact_quantiles(df.limit(0), "v", [0.5]).first().q0 is None


def test_diff_by_digests(spark, tmp_path):
    """Only rows of buckets that differ reach the join; nulls, swapped cells, repeated and lone rows are told apart."""
    left = spark.range(20_000).select(F.col("id").alias("k"), F.lit("a").alias("s"), F.lit(None).cast("string").alias("t"))
    new = {7: ("b", None), 8: (None, "a"), 19_999: ("a", "x")}
    change = lambda c, i: F.when(F.col("k").isin(*new), F.create_map(*[F.lit(x) for k, v in new.items() for x in (k, v[i])])[F.col("k")]).otherwise(F.col(c))
    right = left.select("k", change("s", 0).alias("s"), change("t", 1).alias("t"))
    for name, df in (("l", left), ("r", right)):
        df.write.parquet(str(tmp_path / name))
    left, right = (spark.read.parquet(str(tmp_path / x)) for x in "lr")
    want = rows(profile.snapshot_diff(left, right, "k"))
    assert len(want) == 4
    assert rows(profile.snapshot_diff(left, right, "k", buckets=4096)) == want
    assert profile.differing_buckets(left, right, "k", ["s", "t"], 4096).count() == 3
    assert profile.differing_buckets(left, left.repartition(3, "k"), "k", ["s", "t"], 16).count() == 0
    twice = left.union(left.filter("k = 5"))
    assert profile.differing_buckets(left, twice, "k", ["s"], 16).count() == 1
    assert profile.differing_buckets(left, left.limit(0), "k", ["s"], 16).count() == 16
    diff = profile.snapshot_diff(left, right, "k", buckets=4096)
    plan = diff._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi, ") == 2 and "rightHint=(strategy=broadcast)" in plan
    with pytest.raises(ValueError):
        profile.snapshot_diff(left, right, "k", buckets=1 << 21)
    assert rows(profile.snapshot_diff(left.limit(0), right, "k", buckets=16)) == []
