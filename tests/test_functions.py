import math

import pytest
from pyspark.sql import functions as F

from fleetlog import schema
from fleetlog.functions import numeric, special, text


def values(spark, xs, expr, typ="double"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {typ}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_round_tens(spark):
    assert values(spark, [15.0, 25.0, 4.0], numeric.round_tens) == [20, 20, 0]
    assert values(spark, [15.0, 25.0, 4.0], numeric.round_tens_nonzero) == [20, 20, 10]


def test_round_day(spark):
    assert values(spark, [43200, 43201, 129600], numeric.round_day, "long") == [0, 86400, 172800]


def test_round_half_even(spark):
    assert values(spark, [0.5, 1.5, 2.5, -0.5, None], numeric.to_int) == [0, 2, 2, 0, None]


def test_round_base(spark):
    assert values(spark, [2.4, 2.5, 7.5, 13.0], numeric.round_base) == [0, 0, 10, 15]


def test_round_piecewise(spark):
    steps = lambda x: numeric.round_piecewise(x, [(400, 10), (1000, 100)])
    assert values(spark, [14, 400, 449, 951, 1200], steps, "long") == [10, 400, 400, 1000, 1200]


def test_inner_edge_is_rounded_by_both_bases(spark):
    steps = lambda x: numeric.round_piecewise(x, [(450, 20), (1000, 100)])
    # 450 -> 440 by 20 (half to even of 22.5), then -> 400 by 100
    assert values(spark, [450], steps, "long") == [400]


def test_round_pow2(spark):
    assert values(spark, [1000.0, 48.0, 95.0, 1.0], numeric.round_pow2) == [1024, 48, 96, 1]
    # 3.5: equally far from 4 and 3, ties keep the power
    assert values(spark, [3.5], numeric.round_pow2) == [4]


def test_period_end(spark):
    ends = lambda x: numeric.period_end(x, 86400)
    assert values(spark, [10, 86400, 86401, 0], ends, "long") == [86400, 86400, 172800, 0]


def test_country(spark):
    df = spark.createDataFrame(
        [("SE", None), (None, "Stockholm, Sweden"), (None, "x, US"), (None, None), (None, "NO")], "c string, g string"
    )
    got = [r[0] for r in df.select(text.country(F.col("c"), F.col("g"))).collect()]
    assert got == ["SE", "SE", "US", None, "NO"]


def test_codes(spark):
    code = lambda x: text.map_codes(x, schema.VERIFICATION_CODES)
    assert values(spark, ["verified", "de-verified", "other", None], code, "string") == [1, 3, None, None]


def test_strip_all_white_space(spark):
    assert values(spark, [" \t a b\n", " x ", None], text.strip, "string") == ["a b", "x", None]


def test_clean_cpu_name(spark):
    names = ["AMD Ryzen Threadripper 3970X 32-Core Processor", "12th Gen Intel Core i9", "AMD Ryzen 7 with Radeon Graphics"]
    assert values(spark, names, text.clean_cpu_name, "string") == [
        " Ryzen TR 3970X 32C ", "Intel Core i9", " Ryzen 7",
    ]


def test_column_types():
    assert schema.column_type("gpu_name").simpleString() == "string"
    assert schema.column_type("dlperf").simpleString() == "bigint"
    with pytest.raises(ValueError):
        schema.column_type("no_such_column")
    assert len(schema.KEEP_COLS) == len(set(schema.KEEP_COLS)) == 46


@pytest.mark.parametrize(
    "statistic,dof,p",
    [(5.4, 1, 0.020136751550346385), (3.0, 2, math.exp(-1.5)), (12.0, 4, 7 * math.exp(-6.0)), (0.0, 3, 1.0)],
)
def test_chi_square_p(statistic, dof, p):
    assert special.chi_square_p(statistic, dof) == pytest.approx(p, rel=1e-9)


def test_correlation_p():
    # two degrees of freedom: p = 1 - |r| exactly
    assert special.correlation_p(0.5, 4) == pytest.approx(0.5, rel=1e-12)
    # four degrees of freedom: p = 1 - 1.5 |r| + 0.5 |r|^3
    assert special.correlation_p(-0.6, 6) == pytest.approx(1 - 1.5 * 0.6 + 0.5 * 0.6**3, rel=1e-10)
    assert special.correlation_p(1.0, 10) == 0.0
    assert special.correlation_p(0.3, 2) is None
    # large sample: close to the normal tail
    n, r = 600_000, 0.004
    z = r * math.sqrt((n - 2) / (1 - r * r))
    assert special.correlation_p(r, n) == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-4)


def test_beta_symmetry():
    for a, b, x in [(0.5, 3.0, 0.2), (20.0, 0.5, 0.97), (5.0, 5.0, 0.5)]:
        assert special.beta_inc(a, b, x) + special.beta_inc(b, a, 1 - x) == pytest.approx(1.0, abs=1e-12)
