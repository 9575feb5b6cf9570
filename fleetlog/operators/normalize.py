"""Listing clean-up: raw poll rows to stored columns, as one chain of projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlog import schema
from fleetlog.functions import numeric, text

# Rounding and scaling before the integer cast.
UNIT_RULES = {
    "bw_nvlink": numeric.round_tens,
    "cpu_ram": lambda x: x / 1024,
    "disk_space": numeric.round_tens_nonzero,
    "pcie_bw": lambda x: x * 10,
    "end_date": numeric.round_day,
    "reliability": lambda x: x * 10_000,
    **{c: (lambda x: x * 1000) for c in schema.COST_COLS},
}


def rename_flags(df: DataFrame) -> DataFrame:
    """rented = not rentable; reliability = reliability2. Either only where present."""
    if "rentable" in df.columns:
        df = df.withColumn("rented", ~F.col("rentable")).drop("rentable")
    if "reliability2" in df.columns:
        df = df.drop("reliability").withColumnRenamed("reliability2", "reliability")
    return df


def add_location(df: DataFrame) -> DataFrame:
    """isp and country from the location record, country else from the place text."""
    return df.withColumns(
        {
            "isp": F.col("location.isp"),
            "country": text.country(F.col("location.country"), F.col("geolocation")),
        }
    )


def map_verification(df: DataFrame) -> DataFrame:
    codes = text.map_codes(F.col("verification"), schema.VERIFICATION_CODES)
    return df.withColumn("verification", codes)


def fill_missing(
    df: DataFrame, number: float = 0, string: str = "", exceptions: dict | None = None
) -> DataFrame:
    """Fill nulls and NaNs of numbers and nulls of strings; flags and records stay."""
    fills = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, T.NumericType):
            fills[field.name] = number
        elif isinstance(field.dataType, T.StringType):
            fills[field.name] = string
    fills.update({c: v for c, v in (exceptions or {}).items() if c in fills})
    return df.na.fill(fills)


def apply_units(df: DataFrame) -> DataFrame:
    return df.withColumns({c: rule(F.col(c)) for c, rule in UNIT_RULES.items() if c in df.columns})


def cast_types(df: DataFrame) -> DataFrame:
    """Integers by half-even rounding, strings stripped."""
    out = {}
    for name in df.columns:
        if name in schema.STR_COLS:
            out[name] = text.strip(F.col(name))
        elif name in schema.INT_COLS:
            is_flag = isinstance(df.schema[name].dataType, T.BooleanType)
            out[name] = F.col(name).cast("long") if is_flag else numeric.to_int(F.col(name))
    return df.withColumns(out)


def keep_listed(df: DataFrame) -> DataFrame:
    return df.select([c for c in schema.KEEP_COLS if c in df.columns])


def normalize(df: DataFrame) -> DataFrame:
    """All steps; codes before filling, filling before rounding, scaling before casts."""
    for step in (
        rename_flags, add_location, map_verification, fill_missing, apply_units, cast_types,
        keep_listed,
    ):
        df = step(df)
    return df


def negative_counts(df: DataFrame) -> DataFrame:
    """Per integer column: rows below zero, which an unsigned store could not hold."""
    cols = [c for c in df.columns if c in schema.INT_COLS]
    counts = df.agg(*[F.count_if(F.col(c) < 0).alias(c) for c in cols])
    return counts.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_negative")) for c in cols]))
    )
