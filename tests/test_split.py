import random

from helpers import rows

from fleetlog.operators import split

S = "machine_id long, id long, num_gpus long, rented boolean"


def offers(spark, sizes_by_machine, rented=()):
    data, n = [], 0
    for m, sizes in sizes_by_machine.items():
        for s in sizes:
            n += 1
            data.append((m, n, s, n in rented))
    return spark.createDataFrame(data, S)


def test_min_chunk_examples(spark):
    df = offers(spark, {1: [1, 2, 2, 2, 3, 4, 7], 2: [3, 4, 7], 3: [5], 4: [2, 4], 5: [1, 1, 2]})
    got = dict(rows(split.machine_chunks(df), "machine_id", "min_chunk"))
    assert got == {1: 2, 2: 4, 3: 5, 4: 2, 5: 1}


def test_split(spark):
    df = offers(spark, {1: [1, 1, 2], 2: [1, 4]}, rented={2})
    machines, kept = split.split_offers(df)
    assert set(machines.columns) == {"machine_id", "num_gpus", "min_chunk", "num_gpus_rented"}
    assert rows(machines, "machine_id", "num_gpus", "min_chunk", "num_gpus_rented") == [(1, 2, 1, 1)]
    assert rows(kept, "id") == [(1,), (2,)]


def test_existing_columns_stay(spark):
    df = offers(spark, {1: [1, 1, 2]}).selectExpr("*", "7L as min_chunk", "5L as num_gpus_rented")
    machines, _ = split.split_offers(df)
    assert rows(machines, "min_chunk", "num_gpus_rented") == [(7, 5)]


def brute(sizes):
    sizes = sorted(sizes)
    m = sizes[0]
    if sizes.count(m) == 1 and len(sizes) >= 3:
        m = sizes[1]
    return m, [s for s in sizes if s <= m]


def test_against_sorted_lists(spark):
    rnd = random.Random(3)
    machines = {m: [rnd.randrange(1, 6) for _ in range(rnd.randrange(1, 9))] for m in range(60)}
    df = offers(spark, machines)
    want = {m: brute(s) for m, s in machines.items()}
    got = {r.machine_id: r for r in split.machine_chunks(df).collect()}
    for m, (chunk, undivided) in want.items():
        assert (got[m].min_chunk, got[m].listed, got[m].whole) == (chunk, sum(undivided), max(machines[m]))
    kept = rows(split.min_chunk_offers(df), "machine_id", "num_gpus")
    assert kept == sorted((m, s) for m, (_, undivided) in want.items() for s in undivided)


def test_hot_machine_is_counted_before_it_is_ordered(spark):
    df = spark.range(20_000).selectExpr("1L as machine_id", "id", "1 + id % 4 as num_gpus", "id % 2 = 0 as rented")
    plan = split.machine_chunks(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan
    assert rows(split.machine_chunks(df), "min_chunk", "listed") == [(1, 5000)]


def test_sortedness(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (1, 3, 6), (2, 1, 3), (2, 2, 1)], "k long, i long, v long")
    assert rows(split.is_sorted_by_key(df, "k", "v", ["i"])) == [(1, True), (2, False)]
    assert rows(split.is_sorted_by_key(df, "k", "v", ["i"], hot_rows=1)) == [(1, True), (2, False)]
