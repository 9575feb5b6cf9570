"""The live stream: payload files in, tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fleetlog.operators.normalize import normalize
from fleetlog.sources import payload
from fleetlog.sources.store import PollStore
from fleetlog.streaming.update import FleetTables, create_tables, update_all

POLL_SECONDS = 53


def ingest_batch(store: PollStore, payloads: DataFrame, batch: int, spec: FleetTables) -> dict[str, int]:
    """Check, admit and clean a batch of payloads, then update all tables."""
    payloads = payloads.persist()
    try:
        offers = payload.explode_offers(payloads)
        fresh = payload.admit(offers, last_ts=store.last_commit(before=batch).last_ts)
        return update_all(store, normalize(fresh), batch, spec, payload.rejected(payloads))
    finally:
        payloads.unpersist()


def start_ingest(
    spark: SparkSession,
    landing: str,
    root: str,
    checkpoint: str,
    spec: FleetTables | None = None,
    files_per_batch: int = 1,
    available_now: bool = False,
    offer: T.StructType | None = None,
) -> StreamingQuery:
    """Follow a landing folder of payload files.

    A restart resumes from the checkpoint; a batch cut off half-way is run again
    under its old number and replaces what it had written.
    """
    spec = spec or FleetTables()
    store = PollStore(spark, root)
    payloads = payload.stream_payloads(spark, landing, files_per_batch, offer)
    create_tables(store, normalize(payload.explode_offers(payloads)).schema, spec)

    def on_batch(df: DataFrame, batch: int) -> None:
        ingest_batch(store, df, batch, spec)

    writer = (
        payloads.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{POLL_SECONDS} seconds").start()
