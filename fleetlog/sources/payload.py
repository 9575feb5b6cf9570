"""Poll payloads: reading, checking and admitting them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlog import schema
from fleetlog.functions.numeric import day_number

_CORRUPT = "_corrupt_record"
_TRUE, _FALSE = ["true", "1", "1.0"], ["false", "0", "0.0"]


def _as_text(typed: T.StructType) -> T.StructType:
    """The same fields, all as text: what a field holds never spoils the payload."""
    return T.StructType([T.StructField(f.name, T.StringType()) for f in typed.fields])


def _typed(x: Column, kind: T.DataType) -> Column:
    """JSON text as a value of a type; null if it cannot be one."""
    if isinstance(kind, T.StructType):
        inner = F.from_json(x, _as_text(kind))
        return F.when(inner.isNotNull(), F.struct(*[_typed(inner[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.BooleanType):
        text = F.lower(F.trim(x))
        return F.when(text.isin(_TRUE), F.lit(True)).when(text.isin(_FALSE), F.lit(False))
    if isinstance(kind, T.StringType):
        return x
    number = F.when(x == "true", F.lit("1")).when(x == "false", F.lit("0")).otherwise(x)
    if isinstance(kind, T.IntegralType):
        # whole numbers may be written with a fraction or an exponent
        return F.coalesce(number.try_cast(kind), number.try_cast("double").try_cast(kind))
    return number.try_cast(kind)


def _with_types(payloads: DataFrame, offer: T.StructType | None) -> DataFrame:
    """Offers with typed fields. A field that does not fit is null, an entry that is no offer is left out."""
    typed = offer or schema.offer_schema()
    entry = lambda o: F.struct(*[_typed(o[f.name], f.dataType).alias(f.name) for f in typed.fields])
    offers = F.transform(F.filter("offers", lambda o: o.isNotNull()), entry)
    return payloads.withColumn("offers", offers)


def _options(reader, offer: T.StructType | None):
    return (
        reader.schema(schema.payload_schema(_as_text(offer or schema.offer_schema())))
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _CORRUPT)
    )


def _with_arrival(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        F.unix_seconds(F.col("_metadata.file_modification_time")).alias("arrived"),
        F.col("_metadata.file_path").alias("source"),
    )


def read_payloads(spark: SparkSession, path: str, offer: T.StructType | None = None) -> DataFrame:
    """One row per payload file, with arrival time and source."""
    return _with_types(_with_arrival(_options(spark.read, offer).json(path)), offer)


def stream_payloads(
    spark: SparkSession, path: str, files_per_batch: int = 1, offer: T.StructType | None = None
) -> DataFrame:
    """Payload files as a stream, oldest first."""
    reader = _options(spark.readStream, offer).option("maxFilesPerTrigger", files_per_batch)
    return _with_types(_with_arrival(reader.json(path)), offer)


def parse_payloads(df: DataFrame, body: str, offer: T.StructType | None = None) -> DataFrame:
    """Payloads held as text in a column; the other columns stay."""
    parsed = F.from_json(
        F.col(body), schema.payload_schema(_as_text(offer or schema.offer_schema())),
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT},
    )
    others = [c for c in df.columns if c != body]
    return _with_types(df.select(*others, parsed.alias("_p")).select(*others, "_p.*"), offer)


def _own_time() -> Column:
    """Epoch second that the payload gives, null if it gives none or one that cannot be read."""
    return F.unix_seconds(F.try_to_timestamp("timestamp"))


def _reject_reason() -> Column:
    return (
        F.when(F.col(_CORRUPT).isNotNull(), "not json")
        .when(F.col("timestamp").isNotNull() & _own_time().isNull(), "bad timestamp")
        .when(F.col("offers").isNull(), "no offers")
        .when(F.size("offers") == 0, "empty offers")
    )


def rejected(payloads: DataFrame) -> DataFrame:
    """Payloads without usable offers and why."""
    others = [c for c in payloads.columns if c not in ("timestamp", "offers", _CORRUPT)]
    return payloads.select(*others, _reject_reason().alias("reason")).filter("reason is not null")


def explode_offers(payloads: DataFrame) -> DataFrame:
    """One row per offer, stamped with the payload's time (its arrival if it has none)."""
    stamp = F.coalesce(_own_time(), F.col("arrived"))
    good = payloads.filter(_reject_reason().isNull())
    origin = [c for c in ("source",) if c in payloads.columns]
    return good.select(stamp.alias("timestamp"), "arrived", *origin, F.inline("offers"))


def admitted_polls(
    polls: DataFrame, ts: str = "timestamp", arrived: str = "arrived", last_ts: int = 0, source: str | None = None
) -> DataFrame:
    """Polls newer than every poll that arrived before them and than last_ts.

    polls has one row per poll. Of polls with one time the first by arrival, then by
    source, is admitted. The running maximum is taken within each day of arrival and
    carried from day to day, so no task sees all polls.
    """
    named = [ts, arrived, *([source] if source else [])]
    src = polls.select(*named, day_number(F.col(arrived)).alias("_day"))
    earlier = (
        Window.partitionBy("_day").orderBy(arrived, *([source] if source else []), ts)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = src.groupBy("_day").agg(F.max(ts).alias("_max")).select(
        F.col("_day").alias("_d"), F.max("_max").over(before).alias("_carried")
    )
    rows = src.select("*", F.max(ts).over(earlier).alias("_seen"))
    newest = F.greatest("_seen", "_carried", F.lit(last_ts))
    return rows.join(days, rows["_day"] == days["_d"]).filter(F.col(ts) > newest).select(*named)


def admit(rows: DataFrame, ts: str = "timestamp", arrived: str = "arrived", last_ts: int = 0) -> DataFrame:
    """Rows of the admitted polls; a column `source` tells polls of one time and arrival apart."""
    source = "source" if "source" in rows.columns else None
    named = [ts, arrived, *([source] if source else [])]
    return rows.join(admitted_polls(rows.select(*named).distinct(), ts, arrived, last_ts, source), named, "left_semi")
