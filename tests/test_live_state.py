"""Bucketed tables, live keyed state, poll ordinals."""

import random

from helpers import rows
from pyspark.sql import functions as F

from fleetlog.operators import polls, timeline
from fleetlog.session import new_run_dir
from fleetlog.sources import bucketed
from fleetlog.streaming import registry


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_joins_move_nothing(spark):
    run = new_run_dir(spark, "bucketed")
    name = run.rsplit("-", 1)[1]
    left = spark.range(1000).selectExpr("id % 97 AS k", "id AS a").withColumn("k", F.when(F.col("k") > 3, F.col("k")))
    right = spark.range(97).selectExpr("id AS k", "id * 2 AS b")
    third = spark.range(0, 97, 2).selectExpr("id AS k", "id * 3 AS c")
    tables = [bucketed.write_bucketed(df, f"t{i}_{name}", ["k"], 8, f"{run}/{i}") for i, df in enumerate((left, right, third))]
    joined = bucketed.join_co_located(tables, ["k"])
    counted = joined.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("c").alias("c"))
    assert "Exchange" not in plan_of(counted) and "Broadcast" not in plan_of(counted)
    plain = left.join(right, "k").join(third, "k").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("c").alias("c"))
    assert rows(counted) == rows(plain)
    assert "Exchange" in plan_of(bucketed.join_co_located([left, right], ["k"]))
    files = spark.read.format("binaryFile").load(f"{run}/0/*.parquet").count()
    assert files <= 8  # one for each bucket, not one for each task


def test_live_state_over_shuffled_files_and_a_restart(spark, tmp_path):
    registry.use_rocksdb(spark)
    rng = random.Random(3)
    data = [(rng.randrange(30), f"v{i}", rng.randrange(1000), i) for i in range(400)]
    schema = "k long, v string, t long, no long"
    landing = tmp_path / "landing"

    def land(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(landing))

    def follow(what, mode):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(landing))
        frame = registry.live_index(stream, "t") if what == "index" else registry.live_first_wins(stream, "k", "v", ["t", "no"])

        def on_batch(df, batch):
            df.write.mode("overwrite").parquet(str(tmp_path / what / f"batch={batch}"))

        query = frame.writeStream.outputMode(mode).foreachBatch(on_batch).option("checkpointLocation", str(tmp_path / f"{what}-state"))
        query.trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / what)).drop("batch")

    chunks = [data[i::5] for i in range(5)]
    rng.shuffle(chunks)
    for part in chunks[:3]:
        land(part)
    follow("index", "append"), follow("map", "update")
    for part in chunks[3:]:  # earlier times arrive after a restart
        land(part)
    index, updates = follow("index", "append"), follow("map", "update")
    assert rows(index) == sorted({(t,) for _, _, t, _ in data})
    firsts = {}
    for k, v, t, no in sorted(data, key=lambda r: (r[2], r[3])):
        firsts.setdefault(k, (k, v))
    assert rows(registry.latest_update(updates, "k", ["t", "no"]), "k", "v") == sorted(firsts.values())


def test_polls_before(spark):
    day = 86_400
    own = [10, 20, day - 1, day, 3 * day + 5]
    asked = [0, 10, 15, 20, 21, day, day + 1, 2 * day, 3 * day + 5, 9 * day]
    found = polls.polls_before(spark.createDataFrame([(t,) for t in asked * 2], "t long"), spark.createDataFrame([(t,) for t in own], "t long"), "t")
    assert rows(found) == [(t, sum(p < t for p in own)) for t in asked]


def test_zero_counts_of_a_log(spark):
    rng = random.Random(5)
    times = sorted(rng.sample(range(5 * 86_400), 60))
    poll = spark.createDataFrame([(t,) for t in times], "ts long")
    log = {(rng.randrange(8), rng.randrange(-100, 6 * 86_400)): rng.choice([0, 0, 1, 2, None]) for _ in range(90)}
    log = spark.createDataFrame([(k, v, t) for (k, t), v in log.items()], "k long, v long, ts long")
    want = rows(timeline.zero_counts(timeline.densify(log, "k", ["v"], poll, "ts"), "k", "v"))
    for hot_rows in (5_000_000, 4):
        found = timeline.zero_counts_of_log(log, "k", "v", poll, "ts", hot_rows=hot_rows)
        assert "Generate" not in plan_of(found)
        assert rows(found) == want
