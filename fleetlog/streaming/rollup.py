"""Period roll-up as a streaming aggregation with a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_period_avg_std(
    stream: DataFrame, key: str, cols: Sequence[str], ts: str = "timestamp", period: int = 86_400
) -> DataFrame:
    """Mean and deviation per key and period (k*P, (k+1)*P], emitted once a period is over.

    Windows are closed on the left, periods on the right: moving whole seconds back
    by one turns one into the other. A period is over when a later row arrives.
    """
    aggs = []
    for c in cols:
        aggs.append(F.round(F.avg(c)).cast("long").alias(f"{c}_avg"))
        aggs.append(F.round(F.stddev_pop(c), 2).alias(f"{c}_std"))
    shifted = stream.withColumn("_at", F.timestamp_seconds(F.col(ts) - 1)).withWatermark("_at", "0 seconds")
    rolled = shifted.groupBy(key, F.window("_at", f"{period} seconds")).agg(*aggs)
    return rolled.select(
        key,
        *[f"{c}_{m}" for c in cols for m in ("avg", "std")],
        F.unix_seconds(F.col("window.end")).alias(ts),
    )
