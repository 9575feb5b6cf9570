"""The live stream against the history operators and a replay in plain Python."""

import json
import os
import random

import pytest
from helpers import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlog.operators import changes, presence, rollup
from fleetlog.sources.store import PollStore
from fleetlog.streaming import ingest, update
from fleetlog.streaming.rollup import stream_period_avg_std

OFFER = T.StructType(
    [
        T.StructField("machine_id", T.LongType()), T.StructField("host_id", T.LongType()),
        T.StructField("gpu_name", T.StringType()), T.StructField("dph_base", T.DoubleType()),
        T.StructField("dlperf", T.DoubleType()), T.StructField("verification", T.StringType()),
        T.StructField("geolocation", T.StringType()),
        T.StructField("location", T.StructType([T.StructField("country", T.StringType()), T.StructField("isp", T.StringType())])),
    ]
)
SPEC = update.FleetTables(
    logs={"cost": ["dph_base"], "hardware": ["gpu_name", "verification"]}, averages=("dlperf",), period=3600, compact_batches=1
)
START = 1_704_067_200


def polls(seed=1, n=9):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        offers = [
            {"machine_id": m, "host_id": m * 10 + i, "gpu_name": f" g{rnd.randrange(2)} ", "dph_base": rnd.randrange(3) / 1000,
             "dlperf": float(rnd.randrange(100)), "verification": rnd.choice(["verified", None]), "geolocation": "x, US"}
            for m in range(5) if rnd.random() < 0.7
        ]
        out.append((START + i * 900, offers))
    return [p for p in out if p[1]]


def land(folder, items, first=0):
    os.makedirs(folder, exist_ok=True)
    for i, item in enumerate(items, first):
        path = os.path.join(folder, f"p{i:03d}.json")
        if isinstance(item, str):
            text = item
        else:
            stamp = F"{item[0]}"
            from datetime import datetime, timezone
            stamp = datetime.fromtimestamp(item[0], timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
            text = json.dumps({"timestamp": stamp, "offers": item[1]})
        with open(path, "w") as f:
            f.write(text)
        os.utime(path, (1_710_000_000 + i, 1_710_000_000 + i))


def flat(spark, items):
    data = [
        (o["machine_id"], o["host_id"], o["gpu_name"].strip(), round(o["dph_base"] * 1000), round(o["dlperf"]),
         1 if o["verification"] else 0, ts)
        for ts, offers in items for o in offers
    ]
    return spark.createDataFrame(
        data, "machine_id long, host_id long, gpu_name string, dph_base long, dlperf long, verification long, timestamp long"
    )


@pytest.fixture(scope="module")
def streamed(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("stream")
    landing, root, checkpoint = (str(base / d) for d in ("landing", "root", "checkpoint"))
    items = polls()
    # a bad payload, a repeat and an old poll among the good ones
    feed = [*items[:3], "<html>", items[2], items[1], *items[3:5]]
    land(landing, feed)
    args = dict(spec=SPEC, available_now=True, offer=OFFER, files_per_batch=3)
    ingest.start_ingest(spark, landing, root, checkpoint, **args).awaitTermination()
    # restart from the checkpoint with the rest
    land(landing, items[5:], first=len(feed))
    ingest.start_ingest(spark, landing, root, checkpoint, **args).awaitTermination()
    listing = T.StructType(
        [T.StructField(n, T.StringType() if n in ("gpu_name", "country", "isp") else T.LongType())
         for n in ("machine_id", "host_id", "gpu_name", "dph_base", "dlperf", "verification", "timestamp")]
    )
    store = PollStore(spark, root)
    return items, {t: update.read_table(store, t, listing, SPEC) for t in SPEC.schemas(listing)}, store


def test_stream_equals_history(spark, streamed):
    items, tables, store = streamed
    df = flat(spark, items)
    assert rows(tables["ts_idx"]) == [(ts,) for ts, _ in items]
    assert rows(tables["cost"]) == rows(changes.change_log(df, ["machine_id"], ["dph_base"], ["timestamp"]))
    assert rows(tables["hardware"]) == rows(
        changes.change_log(df, ["machine_id"], ["gpu_name", "verification"], ["timestamp"]))
    assert rows(tables["online"]) == rows(presence.presence_log(df, "machine_id"))
    assert rows(tables["host_map"].select("machine_id", "host_id")) == rows(
        changes.first_wins_map(df, "machine_id", "host_id", ["timestamp"]))
    assert rows(tables["avg"]) == rows(rollup.period_avg_std(df, "machine_id", ["dlperf"], period=3600))
    assert tables["avg"].count() > 0 and store.last_commit().closed_upto >= 0


def test_counts(streamed):
    _, tables, _ = streamed
    counted = dict(rows(tables["counts"].groupBy("table_name").sum("n_rows")))
    for t in ("ts_idx", "cost", "hardware", "online", "avg"):
        assert counted[t] == tables[t].count()


def test_rejects(spark, streamed):
    _, _, store = streamed
    assert rows(store.read("rejects", update.REJECTS, store.last_commit()), "reason") == [("not json",)]


def test_replayed_batch_changes_nothing(spark, tmp_path):
    items = polls(4, 4)
    df = flat(spark, items)
    store = PollStore(spark, str(tmp_path / "r"))
    update.create_tables(store, df.schema, SPEC)
    first, second = df.filter(F.col("timestamp") <= items[1][0]), df.filter(F.col("timestamp") > items[1][0])
    update.update_all(store, first, 0, SPEC)
    update.update_all(store, second, 1, SPEC)
    read = lambda: {t: rows(update.read_table(store, t, df.schema, SPEC)) for t in ("cost", "online", "avg", "host_map")}
    before = read()
    update.update_all(store, second, 1, SPEC)
    assert read() == before
    assert update.update_all(store, df.limit(0), 2, SPEC) == {}
    assert before["cost"] == rows(changes.change_log(df, ["machine_id"], ["dph_base"], ["timestamp"]))


def test_streaming_rollup(spark, tmp_path):
    """Right-closed days; a day comes out with the first later row, the open one does not."""
    source = str(tmp_path / "in")
    data = [[(1, 3, 10), (1, 0, 86400)], [(1, 2, 86401)], [(1, 4, 172801)]]
    for part in data:
        spark.createDataFrame(part, "k long, x long, ts long").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("k long, x long, ts long").option("maxFilesPerTrigger", 1).parquet(source)
    out = stream_period_avg_std(stream, "k", ["x"], "ts")
    q = (out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert rows(spark.read.schema(out.schema).parquet(str(tmp_path / "out"))) == [(1, 2, 0.0, 172800), (1, 2, 1.5, 86400)]


def test_several_rows_of_a_key_in_a_poll(spark, tmp_path):
    """The last row by the tie-break counts, whatever the order in which rows arrive."""
    rnd = random.Random(6)
    data = [(m, i, rnd.randrange(3), rnd.randrange(50), START + p * 900) for p in range(6) for m in range(3) for i in range(3)]
    last = {(m, ts): (m, i, g, d, ts) for m, i, g, d, ts in sorted(data)}
    spec = update.FleetTables(map_value="id", logs={"cost": ["gpu"]}, averages=("dlperf",), period=1800, tie=("id",))
    schema = "machine_id long, id long, gpu long, dlperf long, timestamp long"
    want = spark.createDataFrame(list(last.values()), schema)
    rnd.shuffle(data)
    df = spark.createDataFrame(data, schema).repartition(5)
    store = PollStore(spark, str(tmp_path / "t"))
    update.create_tables(store, df.schema, spec)
    cut = START + 2 * 900
    update.update_all(store, df.filter(F.col("timestamp") <= cut), 0, spec)
    update.update_all(store, df.filter(F.col("timestamp") > cut), 1, spec)
    read = lambda t: rows(update.read_table(store, t, df.schema, spec))
    assert read("cost") == rows(changes.change_log(want, ["machine_id"], ["gpu"], ["timestamp"]))
    assert read("avg") == rows(rollup.period_avg_std(want, "machine_id", ["dlperf"], period=1800))
    assert read("online") == rows(presence.presence_log(want, "machine_id"))


def test_one_pass_and_sums_for_the_buffer(spark, tmp_path):
    """The batch is ordered by key once for all logs; the open period has one row per key and batch."""
    df = flat(spark, polls(8, 8))
    spec = update.FleetTables(logs=SPEC.logs, averages=("dlperf",), period=10**6)
    state = df.limit(0)
    parts, held = update.additions(df, state, 0, spec)
    plan = held[0]._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.strip(" +-:").startswith("Window") for line in held[0]._jdf.queryExecution().analyzed().toString().splitlines()) == 1, plan
    for name in spec.logs:
        text = parts[name]._jdf.queryExecution().executedPlan().toString()
        assert "InMemoryTableScan" in text and "Exchange" not in text.split("InMemoryRelation")[0]
    store = PollStore(spark, str(tmp_path / "s"))
    update.create_tables(store, df.schema, spec)
    times = sorted(r[0] for r in df.select("timestamp").distinct().collect())
    for batch, cut in enumerate((times[:4], times[4:])):
        update.update_all(store, df.filter(F.col("timestamp").isin(cut)), batch, spec)
    kept = store.state(update.MOMENTS, spec.schemas(df.schema)[update.MOMENTS], store.last_commit())
    assert kept.groupBy("machine_id", "timestamp").count().agg(F.max("count")).first()[0] <= 2
    merged = rollup.merge_moments(kept, "machine_id", ["dlperf"])
    want = rollup.period_avg_std(df, "machine_id", ["dlperf"], period=10**6, include_open=True)
    assert rows(rollup.moments_avg_std(merged, "machine_id", ["dlperf"])) == rows(want)


def test_rejects_alone_are_kept(spark, tmp_path):
    df = flat(spark, polls(2, 3))
    store = PollStore(spark, str(tmp_path / "s"))
    update.create_tables(store, df.schema, SPEC)
    bad = spark.createDataFrame([(5, "f", "not json")], update.REJECTS)
    assert update.update_all(store, df.limit(0), 0, SPEC, bad) == {}
    update.update_all(store, df, 1, SPEC, bad)
    assert update.read_table(store, "rejects", df.schema, SPEC).count() == 2
    assert store.last_commit(before=200).batch == 1  # beyond the commits that are looked at first
    assert rows(update.read_table(store, "cost", df.schema, SPEC)) == rows(changes.change_log(df, ["machine_id"], ["dph_base"], ["timestamp"]))
