import json

from helpers import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlog.sources import payload, tables
from fleetlog.sources.store import Commit, PollStore

OFFER = T.StructType([T.StructField("machine_id", T.LongType()), T.StructField("num_gpus", T.LongType())])


def test_payload_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(
        {"timestamp": "2024-01-01T00:01:00Z", "offers": [{"machine_id": 1, "num_gpus": 2}, {"machine_id": 2}]}, indent=2))
    (tmp_path / "b.json").write_text("<html>no</html>")
    (tmp_path / "c.json").write_text('{"x": 1}')
    (tmp_path / "d.json").write_text('{"timestamp": "2024-01-01T00:02:00Z", "offers": []}')
    (tmp_path / "e.json").write_text('{"offers": [{"machine_id": 9, "num_gpus": 1}]}')
    read = payload.read_payloads(spark, str(tmp_path), OFFER)
    assert rows(payload.rejected(read), "reason") == [("empty offers",), ("no offers",), ("not json",)]
    got = payload.explode_offers(read)
    assert rows(got.filter("machine_id < 9"), "timestamp", "machine_id", "num_gpus") == [(1704067260, 1, 2), (1704067260, 2, None)]
    # without a time of its own a payload takes that of its arrival
    late = got.filter("machine_id = 9").first()
    assert late.timestamp == late.arrived > 1_700_000_000


def test_admission(spark):
    day = 86_400
    arrivals = [(10, 5), (30, 6), (20, 7), (30, 8), (40, day + 1), (35, day + 2), (41, 3 * day)]
    df = spark.createDataFrame(arrivals, "ts long, arrived long")
    best, want = 0, []
    for ts, at in arrivals:
        if ts > best:
            want.append((ts, at))
            best = ts
    assert rows(payload.admitted_polls(df, "ts", "arrived")) == want
    assert rows(payload.admitted_polls(df, "ts", "arrived", last_ts=30)) == [(40, day + 1), (41, 3 * day)]
    both = df.withColumn("k", F.lit(1))
    assert payload.admit(both, "ts", "arrived").count() == len(want)


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, 5), (2, 86_405)], "k long, timestamp long")
    path = str(tmp_path / "log")
    tables.append_log(df, path)
    tables.append_log(df, path)
    assert tables.read_table(spark, path, ["k"]).count() == 4
    one_day = tables.read_table(spark, path).filter("event_date = date'1970-01-02'")
    assert one_day.count() == 2 and "PartitionFilters: [isnotnull(event_date" in one_day._jdf.queryExecution().executedPlan().toString()
    assert dict(tables.read_table(spark, path, {"k": "int"}).dtypes) == {"k": "int"}
    assert rows(tables.first_last(df)) == [(5, 86_405, 86_400)]
    assert rows(tables.first_last(df.filter("k > 9"))) == [(0, 0, 0)]


def test_storage_report(spark, sf_dir):
    report = tables.storage_report(spark, sf_dir, r"([^/]+)\.parquet")
    first = report.first()
    assert first["name"] == "total" and first["percentage"] == 100.0
    assert report.count() == 15
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_store_shows_only_committed_batches(spark, tmp_path):
    typed = T.StructType([T.StructField("k", T.LongType())])
    store = PollStore(spark, str(tmp_path / "s")).create()
    make = lambda *ks, table="t": spark.createDataFrame([(k, table) for k in ks], "k long, _table string")
    assert store.last_commit() == Commit() and store.read("t", typed).count() == 0
    store.write("rows/batch=0", make(1).union(make(9, table="other")))
    assert store.read("t", typed).count() == 0  # not committed yet
    store.commit(Commit(0, 10))
    store.write("rows/batch=1", make(2, 3))  # cut off here ...
    assert rows(store.read("t", typed)) == [(1,)] and rows(store.read("other", typed)) == [(9,)]
    store.write("rows/batch=1", make(2))  # ... and run again
    store.commit(Commit(1, 20))
    assert rows(store.read("t", typed)) == [(1,), (2,)]
    assert store.last_commit(before=1) == Commit(0, 10)
    at = store.last_commit()
    store.write("closed/upto=1", store.open_rows(typed, at))
    store.write("state/upto=1", make(2))
    assert rows(store.read("t", typed)) == [(1,), (2,)]  # compaction is not visible before its commit
    store.write("rows/batch=2", make(4))
    store.commit(Commit(2, 30, 1))
    at = store.last_commit()
    assert rows(store.read("t", typed)) == [(1,), (2,), (4,)]
    assert rows(store.open_rows(typed, at), "k") == [(4,)]
    assert rows(store.state("t", typed, at)) == [(2,), (4,)]  # as it was kept, and what came since
    # a second create leaves everything in place
    assert PollStore(spark, str(tmp_path / "s")).create().read("t", typed).count() == 3


def test_mistyped_fields_spoil_nothing_else(spark, tmp_path):
    offer = T.StructType([
        T.StructField("machine_id", T.LongType()), T.StructField("num_gpus", T.LongType()), T.StructField("has_avx", T.BooleanType()),
        T.StructField("score", T.DoubleType()), T.StructField("gpu_name", T.StringType()),
        T.StructField("location", T.StructType([T.StructField("country", T.StringType())])),
    ])
    offers = [
        {"machine_id": 1, "num_gpus": 2, "has_avx": True, "score": 1.5, "gpu_name": "g", "location": {"country": "SE"}},
        {"machine_id": 2, "num_gpus": 1.0, "has_avx": 1, "score": "2.5", "gpu_name": 7, "location": "nowhere"},
        {"machine_id": "3", "num_gpus": "many", "has_avx": "yes?", "score": None, "gpu_name": None, "location": None},
        {"machine_id": 9007199254740993, "num_gpus": True, "has_avx": 0},
    ]
    (tmp_path / "a.json").write_text(json.dumps({"timestamp": "2024-01-01T00:01:00Z", "offers": offers}))
    (tmp_path / "b.json").write_text(json.dumps({"timestamp": "garbage", "offers": offers}))
    read = payload.read_payloads(spark, str(tmp_path), offer)
    got = payload.explode_offers(read).select(*[f.name for f in offer.fields[:5]], "location.country")
    assert sorted(map(tuple, got.collect())) == [
        (1, 2, True, 1.5, "g", "SE"), (2, 1, True, 2.5, "7", None), (3, None, None, None, None, None),
        (9007199254740993, 1, False, None, None, None),
    ]
    assert rows(payload.rejected(read), "reason") == [("bad timestamp",)]


def test_one_poll_per_time(spark):
    both = [(10, 5, "b", 1), (10, 5, "a", 2), (10, 5, "a", 3), (20, 5, "c", 4), (15, 6, "d", 5)]
    df = spark.createDataFrame(both, "timestamp long, arrived long, source string, machine_id long")
    assert rows(payload.admit(df), "machine_id") == [(2,), (3,), (4,)]
