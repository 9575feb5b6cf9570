"""Statistics of a rental flag against other columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlog.functions.special import chi_square_p_value, correlation_p_value
from fleetlog.operators.quantiles import exact_quantiles
from fleetlog.operators.sequence import null_safe_on


def corr_with_flag(df: DataFrame, flag: str, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of each column with the flag, over the pairs without nulls.

    One aggregation for all columns. Columns without variance are left out.
    """
    aggs, entries = [], []
    for c in cols:
        x, y = F.col(c).cast("double"), F.col(flag).cast("double")
        x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        # the built-in corr divides by zero on a constant column in ANSI mode
        spread = F.stddev_pop(x) * F.stddev_pop(y)
        aggs += [F.try_divide(F.covar_pop(x, y), spread).alias(f"r_{c}"), F.count(x).alias(f"n_{c}")]
        entries.append(
            F.struct(
                F.lit(c).alias("column_name"), F.col(f"r_{c}").alias("r"), F.col(f"n_{c}").alias("n")
            )
        )
    rows = df.agg(*aggs).select(F.inline(F.array(*entries)))
    return rows.filter(F.col("r").isNotNull() & ~F.isnan("r"))


def point_biserial(df: DataFrame, flag: str, cols: Sequence[str]) -> DataFrame:
    """Correlations with their two-sided p-values, smallest p first."""
    rows = corr_with_flag(df, flag, cols)
    return rows.withColumn("p_value", correlation_p_value("r", "n")).orderBy("p_value", "column_name")


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency table in long form: cells that occur."""
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(
        F.count(F.lit(1)).alias("n")
    )


# Columns that a contingency table may get.
MAX_VALUES = 1_000


def crosstab_wide(df: DataFrame, a: str, b: str, values: Sequence | None = None, rest: str | None = None) -> DataFrame:
    """Contingency table with one column per value of b, zeros filled.

    Without a list the values are looked up first (at most MAX_VALUES). With a list it
    shows the chosen ones; rest names a column that counts all others. Null values of b
    are not counted.
    """
    if values is None:
        found = df.filter(F.col(b).isNotNull()).select(b).distinct().limit(MAX_VALUES + 1).collect()
        if len(found) > MAX_VALUES:
            raise ValueError(f"{b} has more than {MAX_VALUES} values")
        values = sorted(r[0] for r in found)
    counted = [F.count_if(F.col(b) == v).alias(str(v)) for v in values]
    if rest is not None:
        counted.append(F.count_if(~F.col(b).isin(list(values))).alias(rest))
    return df.groupBy(a).agg(*counted) if counted else df.select(a).distinct()


def chi_square_statistics(df: DataFrame, flag: str, cols: Sequence[str]) -> DataFrame:
    """Chi-square statistic of independence of the flag and each categorical column.

    All columns go through one counting pass. With one degree of freedom the
    continuity correction of 1/2 applies. Cells that never occur take part through
    the margins, without laying out all row-column pairs: their expected counts sum
    to what the expected counts of the other cells leave of the total, and in a 2x2
    table all four cells are equally far from expectation.
    """
    long = df.select(
        F.col(flag).cast("string").alias("_a"),
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("_b")) for c in cols])
        ).alias("_s"),
    ).select("_s.column_name", "_a", "_s._b")
    cells = long.filter("_a is not null and _b is not null").groupBy("column_name", "_a", "_b").agg(
        F.count(F.lit(1)).alias("o")
    )

    def margin(side: str, total: str) -> DataFrame:
        return cells.groupBy("column_name", side).agg(F.sum("o").alias(total))

    def size(side: DataFrame, total: str, n: str, inv: str) -> DataFrame:
        return side.groupBy("column_name").agg(
            F.count(F.lit(1)).alias(n), F.sum(1.0 / F.col(total)).alias(inv), F.sum(total).alias(f"n_{n}")
        )

    by_a, by_b = margin("_a", "ra"), margin("_b", "cb")
    sizes = size(by_a, "ra", "rows", "inv_a").join(size(by_b, "cb", "cols", "inv_b"), "column_name")
    e = F.col("ra") * F.col("cb") / F.col("n_rows")
    observed = (
        cells.join(by_a, ["column_name", "_a"])
        .join(by_b, ["column_name", "_b"])
        .join(sizes, "column_name")
        .groupBy("column_name", "rows", "cols", "inv_a", "inv_b", "n_rows")
        .agg(
            F.sum((F.col("o") - e) * (F.col("o") - e) / e).alias("part"),
            F.sum(e).alias("e_seen"),
            F.count(F.lit(1)).alias("cells"),
            F.max(F.abs(F.col("o") - e)).alias("off"),
        )
    )
    dof = (F.col("rows") - 1) * (F.col("cols") - 1)
    unseen = F.when(F.col("cells") < F.col("rows") * F.col("cols"), F.col("n_rows") - F.col("e_seen"))
    corrected = F.greatest(F.col("off") - 0.5, F.lit(0.0))
    two_by_two = corrected * corrected * F.col("n_rows") * F.col("inv_a") * F.col("inv_b")
    # a 2x2 table has E = ra*cb/n, so the sum of 1/E is n * sum(1/ra) * sum(1/cb)
    statistic = F.when(dof == 1, two_by_two).otherwise(F.col("part") + F.coalesce(unseen, F.lit(0.0)))
    return observed.select("column_name", statistic.alias("statistic"), dof.cast("long").alias("dof"))


def chi_square(df: DataFrame, flag: str, cols: Sequence[str]) -> DataFrame:
    stats = chi_square_statistics(df, flag, cols)
    return stats.withColumn("p_value", chi_square_p_value("statistic", "dof")).orderBy(
        "p_value", "column_name"
    )


def zscore_filter(df: DataFrame, col: str, below: float = 2.0) -> DataFrame:
    """Rows whose distance above the mean is under a number of population deviations."""
    moments = df.agg(F.struct(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"))).scalar()
    z = F.try_divide(F.col(col).cast("double") - moments["mean"], moments["std"])
    return df.filter(z < below)


def quantile_clip(df: DataFrame, col: str, upper: float = 0.95) -> DataFrame:
    """Rows with a value from 0 to the exact upper quantile."""
    top = exact_quantiles(df, col, [upper]).select("q0").scalar()
    return df.filter((F.col(col) >= 0) & (F.col(col) <= top))


def box_summary(df: DataFrame, group: str, col: str) -> DataFrame:
    """Quartiles and whiskers (outermost values within 1.5 interquartile ranges)."""
    quartiles = exact_quantiles(df, col, [0.25, 0.5, 0.75], by=[group])
    q = quartiles.select(
        F.col(group).alias("_g"), F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3")
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    x = F.col(col)
    inside = x.between(F.col("q1") - reach, F.col("q3") + reach)
    rows = df.filter(x.isNotNull()).select(group, col)
    return (
        rows.join(q, null_safe_on([rows[group]], [q["_g"]]))
        .groupBy(group, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, x)).alias("low_whisker"),
            F.max(F.when(inside, x)).alias("high_whisker"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )


def bin_number(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal bins over [low, high]; the last one is closed."""
    raw = F.floor((x - low) * F.lit(float(bins)) / (high - low)).cast("long")
    return F.when(high == low, F.lit(0)).otherwise(F.least(raw, F.lit(bins - 1))).cast("long")


def histogram_by_flag(df: DataFrame, col: str, flag: str, bins: int) -> DataFrame:
    """Rows per bin and flag."""
    rows = df.filter(F.col(col).isNotNull()).select(flag, F.col(col).cast("double").alias("_x"))
    span = rows.agg(F.struct(F.min("_x").alias("low"), F.max("_x").alias("high"))).scalar()
    number = bin_number(F.col("_x"), span["low"], span["high"], bins)
    return rows.groupBy(number.alias("bin"), flag).agg(F.count(F.lit(1)).alias("n"))


def value_histogram_by_flag(df: DataFrame, col: str, flag: str) -> DataFrame:
    """One bin per value."""
    return df.groupBy(col, flag).agg(F.count(F.lit(1)).alias("n"))
