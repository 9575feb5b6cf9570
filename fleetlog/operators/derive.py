"""Derived measures of machines and type narrowing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlog.functions.text import share_label


def _per(amount: str, units: str) -> Column:
    return F.coalesce(F.try_divide(F.col(amount).cast("double"), F.col(units)), F.lit(0.0))


def per_unit(
    df: DataFrame,
    units: str,
    truncated: dict[str, str],
    rounded: dict[str, str],
    exact: dict[str, str],
    rented: str | None = None,
) -> DataFrame:
    """Amounts per unit; each dict maps an output name to the amount column.

    No units gives 0. With a rented column also its share as text and whether all,
    or any, units are rented.
    """
    out = {n: _per(c, units).cast("long") for n, c in truncated.items()}
    out |= {n: F.rint(_per(c, units)).cast("long") for n, c in rounded.items()}
    out |= {n: _per(c, units) for n, c in exact.items()}
    if rented is not None:
        out["rented_fraq"] = share_label(F.col(rented), F.col(units))
        out["all_rented"] = F.col(rented) == F.col(units)
        out["any_rented"] = F.col(rented) > 0
    return df.withColumns(out)


# Integer types with the open interval of values they are used for.
_INTEGER_TYPES = [("byte", 8), ("short", 16), ("int", 32)]
_FLOAT_MAX = 3.4028234663852886e38


def narrow_profile(df: DataFrame, cols: Sequence[str] | None = None, int_cast: bool = True) -> DataFrame:
    """Smallest type for each numeric column: one aggregation over all columns.

    Floats that are all close to whole numbers count as integers; a float column
    with nulls does not. Bounds are strict.
    """
    numeric = [
        f for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and (cols is None or f.name in cols)
    ]
    aggs, entries = [], []
    for f in numeric:
        x = F.col(f.name).cast("double")
        near = F.abs(x - F.rint(x)) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(F.rint(x))
        whole = F.lit(True)
        if not isinstance(f.dataType, T.IntegralType):
            whole = F.bool_and(F.coalesce(near, F.lit(False))) if int_cast else F.lit(False)
        aggs += [
            F.min(x).alias(f"min_{f.name}"),
            F.max(x).alias(f"max_{f.name}"),
            F.max(whole).alias(f"whole_{f.name}") if isinstance(f.dataType, T.IntegralType) or not int_cast
            else whole.alias(f"whole_{f.name}"),
        ]
        entries.append(
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.col(f"min_{f.name}").alias("min_value"),
                F.col(f"max_{f.name}").alias("max_value"),
                F.col(f"whole_{f.name}").alias("is_whole"),
            )
        )
    rows = df.agg(*aggs).select(F.inline(F.array(*entries)))
    lo, hi = F.col("min_value"), F.col("max_value")
    integer = F.lit("long")
    for name, bits in reversed(_INTEGER_TYPES):
        fits = (lo > -float(2 ** (bits - 1))) & (hi < float(2 ** (bits - 1) - 1))
        integer = F.when(fits, F.lit(name)).otherwise(integer)
    fraction = F.when((lo > -_FLOAT_MAX) & (hi < _FLOAT_MAX), F.lit("float")).otherwise("double")
    return rows.withColumn("narrow_type", F.when(F.col("is_whole"), integer).otherwise(fraction))


def narrow_types(df: DataFrame, cols: Sequence[str] | None = None, int_cast: bool = True) -> DataFrame:
    """Cast numeric columns to the smallest type that holds them.

    Reads the profile (one row per column) to know the types of the result.
    """
    plan = {r["column_name"]: r["narrow_type"] for r in narrow_profile(df, cols, int_cast).collect()}
    whole = ("byte", "short", "int", "long")
    casts = {}
    for name, target in plan.items():
        source = df.schema[name].dataType
        x = F.col(name)
        if target in whole and not isinstance(source, T.IntegralType):
            x = F.rint(x)
        casts[name] = x.cast(target)
    return df.withColumns(casts) if casts else df
