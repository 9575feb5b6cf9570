"""All tables of a fleet, brought up to date by one batch of polls.

A batch may hold one poll (a micro-batch of the live stream) or many (a backlog).
Either way the tables end up as if the polls had been taken one by one.

A batch is shuffled and ordered once, by key and time, over the columns of all logs,
with the last known row of each key in front. That one pass says for every row which
logs it changes, whether its key is new, and when the key went offline or came back.
The averages come from the same rows as sums per key and period. All that a batch adds,
to whatever table, is written by one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlog import schema
from fleetlog.operators import changes, rollup
from fleetlog.operators.polls import poll_neighbours
from fleetlog.sources.store import TABLE, Commit, PollStore

REJECTS = T.StructType(
    [T.StructField("arrived", T.LongType()), T.StructField("source", T.StringType()),
     T.StructField("reason", T.StringType())]
)
# Tables that hold state and are no results: last row of each key, sums of open periods.
SEEN, MOMENTS = "seen", "moments"


@dataclass(frozen=True)
class FleetTables:
    """Which tables to keep for a listing."""

    key: str = schema.KEY
    ts: str = schema.TS
    map_value: str = "host_id"
    logs: dict[str, Sequence[str]] = field(default_factory=lambda: dict(schema.LOG_TABLES))
    averages: Sequence[str] = tuple(schema.AVG_COLS)
    period: int = 86_400
    tie: Sequence[str] = ()
    # batches since the last compaction from which on a roll-up compacts
    compact_batches: int = 16

    def values(self) -> list[str]:
        """All columns that are compared or mapped."""
        return list(dict.fromkeys([self.map_value, *[c for cols in self.logs.values() for c in cols]]))

    def fields(self, rows: T.StructType, *names: str) -> T.StructType:
        return T.StructType([T.StructField(n, rows[n].dataType) for n in names])

    def schemas(self, rows: T.StructType) -> dict[str, T.StructType]:
        """Stored schema of every table, given that of the listing."""
        key, ts, long = self.key, self.ts, T.LongType()
        key_field, ts_field = T.StructField(key, rows[key].dataType), T.StructField(ts, long)
        out = {
            "ts_idx": self.fields(rows, ts),
            "host_map": self.fields(rows, key, self.map_value, ts),
            "online": T.StructType([key_field, T.StructField("online", long), ts_field]),
        }
        out |= {name: self.fields(rows, key, *cols, ts) for name, cols in self.logs.items()}
        avg, sums = [key_field], [key_field]
        for c in self.averages:
            avg += [T.StructField(f"{c}_avg", long), T.StructField(f"{c}_std", T.DoubleType())]
            sums += [T.StructField(f"{c}_n", long), *[T.StructField(f"{c}_{m}", T.DecimalType(38, 0)) for m in ("sum", "sq")]]
        out["avg"] = T.StructType([*avg, ts_field])
        out["counts"] = T.StructType([T.StructField("table_name", T.StringType()), T.StructField("n_rows", long)])
        return {**out, SEEN: self.fields(rows, key, *self.values(), ts), MOMENTS: T.StructType([*sums, ts_field]), "rejects": REJECTS}

    def wide(self, rows: T.StructType) -> T.StructType:
        """The columns of all tables side by side, as they are written."""
        out: dict[str, T.StructField] = {}
        for typed in self.schemas(rows).values():
            for f in typed.fields:
                if out.setdefault(f.name, f).dataType != f.dataType:
                    raise ValueError(f"column {f.name} has two types")
        return T.StructType([T.StructField(f.name, f.dataType) for f in out.values()])


def create_tables(store: PollStore, rows: T.StructType, spec: FleetTables) -> None:
    """Lay out the folders for a listing of the given schema."""
    spec.wide(rows)
    store.create()


def one_row_per_poll(rows: DataFrame, key: str, ts: str, tie: Sequence[str] = ()) -> DataFrame:
    """The last row of each key and poll, by the tie-break columns and then by all others."""
    others = [c for c in rows.columns if c not in (key, ts)]
    order = [*tie, *[c for c in others if c not in tie]]
    last = rows.groupBy(key, ts).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_last"))
    return last.select(*[F.col("_last")[c].alias(c) if c in others else F.col(c) for c in rows.columns])


def last_seen(store: PollStore, typed: T.StructType, at: Commit, spec: FleetTables) -> DataFrame:
    """Last row of each key so far."""
    cols = [f.name for f in typed.fields if f.name != spec.key]
    return changes.latest_snapshot(store.state(SEEN, typed, at), [spec.key], cols, [spec.ts])


def in_sequence(rows: DataFrame, state: DataFrame, spec: FleetTables) -> DataFrame:
    """Rows of a batch after the last known row of their key (`_old`), with `_prev` (all values) and `_next_ts`.

    The only ordering of the batch: one shuffle by key, one sort. A key has one row per
    poll, so no key is larger than the number of polls.
    """
    key, ts, values = spec.key, spec.ts, spec.values()
    others = [c for c in rows.columns if c not in (key, ts, *values)]
    before = state.select(key, *values, ts, *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in others], F.lit(True).alias("_old"))
    window = Window.partitionBy(key).orderBy(F.desc("_old"), ts)
    return rows.withColumn("_old", F.lit(False)).unionByName(before).select(
        "*", F.lag(F.struct(*values)).over(window).alias("_prev"), F.lead(ts).over(window).alias("_next_ts")
    )


def presence_events(spec: FleetTables, last_ts: int, poll_after: Column) -> Column:
    """Array of (online, at) that a row in sequence gives rise to.

    A key that is not in the poll after goes offline then, unless it already was; one that
    was away comes back with its next row.
    """
    here, then = F.col(spec.ts), F.col("_next_ts")
    away_before = F.col("_old") & (here < last_ts)
    leaves = ~away_before & poll_after.isNotNull() & (then.isNull() | (then > poll_after))
    event = lambda online, at: F.struct(F.lit(online).cast("long").alias("online"), at.alias("at"))
    return F.array(
        F.when(F.col("_prev").isNull() & ~F.col("_old"), event(1, here)),
        F.when(leaves, event(0, poll_after)),
        F.when(then.isNotNull() & (away_before | (then > poll_after)), event(1, then)),
    )


def additions(rows: DataFrame, state: DataFrame, last_ts: int, spec: FleetTables) -> tuple[dict[str, DataFrame], list[DataFrame]]:
    """What a batch adds to each table but the averages, all from one ordered pass; and what was persisted for it."""
    key, ts = spec.key, spec.ts
    seq = in_sequence(rows, state, spec).persist()
    new = seq.filter("NOT _old")
    polls = rows.select(ts).distinct()
    known = polls.unionByName(rows.sparkSession.range(last_ts, last_ts + 1).toDF(ts)) if last_ts else polls
    after = poll_neighbours(known, ts).select(F.col(ts).alias("_poll"), F.col("next_ts").alias("_poll_after")).persist()
    events = seq.select(key, ts, "_old", "_next_ts", F.when(F.col("_prev").isNotNull(), 1).alias("_prev")).join(after, F.col(ts) == F.col("_poll"), "left")
    online = events.select(key, F.explode(presence_events(spec, last_ts, F.col("_poll_after"))).alias("_e")).filter("_e IS NOT NULL")
    out = {
        # admitted polls are newer than every known one, so their times are new
        "ts_idx": polls,
        "host_map": new.filter("_prev IS NULL").select(key, spec.map_value, ts),
        "online": online.select(key, "_e.online", F.col("_e.at").alias(ts)),
    }
    for name, cols in spec.logs.items():
        same = F.struct(*cols).eqNullSafe(F.struct(*[F.col("_prev")[c].alias(c) for c in cols]))
        out[name] = new.filter(F.col("_prev").isNull() | ~same).select(key, *cols, ts)
    out[SEEN] = new.filter("_next_ts IS NULL").select(key, *spec.values(), ts)
    out[MOMENTS] = rollup.moments(new, key, list(spec.averages), ts, spec.period)
    return out, [seq, after]


def together(parts: dict[str, DataFrame], wide: T.StructType) -> DataFrame:
    """The rows of several tables in one frame, named by table."""
    frames = [df.withColumn(TABLE, F.lit(name)) for name, df in parts.items()]
    both = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
    return both.selectExpr(TABLE, *[f"CAST(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`" for f in wide.fields if f.name in both.columns])


def update_all(
    store: PollStore, rows: DataFrame, batch: int, spec: FleetTables, rejects: DataFrame | None = None
) -> dict[str, int]:
    """Write what a batch of admitted polls changes in every table; one commit.

    Of several rows of a key in one poll the last one counts, in every table. Returns
    the number of rows added per table (empty when there was nothing new).
    """
    key, ts = spec.key, spec.ts
    at = store.last_commit(before=batch)
    typed, wide = spec.schemas(rows.schema), spec.wide(rows.schema)
    rows = one_row_per_poll(rows, key, ts, spec.tie).select(*dict.fromkeys([key, ts, *spec.values(), *spec.averages])).persist()
    refused = {} if rejects is None else {"rejects": rejects.select(*REJECTS.names)}
    held: list[DataFrame] = []
    try:
        last = rows.agg(F.max(ts)).first()[0]
        if last is None:
            if refused and not rejects.isEmpty():
                store.write(f"rows/batch={batch}", together(refused, wide))
                store.commit(Commit(batch, at.last_ts, at.closed_upto))
            return {}
        parts, held = additions(rows, last_seen(store, typed[SEEN], at, spec), at.last_ts, spec)
        closing = last > _period_end(at.last_ts, spec.period)
        if closing:
            sums = store.state(MOMENTS, typed[MOMENTS], at).unionByName(parts[MOMENTS].select(*typed[MOMENTS].names))
            # periods before the last known poll's have been rolled up
            due = F.col(ts).between(_period_end(at.last_ts, spec.period), _period_end(last, spec.period) - 1)
            merged = rollup.merge_moments(sums.filter(due), key, list(spec.averages), ts)
            parts["avg"] = rollup.moments_avg_std(merged, key, list(spec.averages), ts)
        seen = Observation()
        names = [n for n in parts if n not in (SEEN, MOMENTS)]
        counted = [F.count_if(F.col(TABLE) == n).alias(n) for n in names]
        counts_row = T.StructType([T.StructField("table_name", T.StringType()), T.StructField("n_rows", T.LongType())])
        store.write(f"rows/batch={batch}", together({**parts, **refused}, wide).observe(seen, *counted))
        counts = {n: seen.get[n] for n in names}
        listed = store.spark.createDataFrame(list(counts.items()), counts_row).coalesce(1)
        listed.write.mode("overwrite").parquet(f"{store.root}/rows/batch={batch}/{TABLE}=counts")
        done = Commit(batch, last, at.closed_upto)
        if closing and batch - at.closed_upto >= spec.compact_batches:
            _compact(store, done, typed, wide, spec)
            done = Commit(batch, last, batch)
        store.commit(done)
        return counts
    finally:
        for frame in (*held, rows):
            frame.unpersist()


def _period_end(ts: int, period: int) -> int:
    return -(-ts // period) * period


def _compact(store: PollStore, done: Commit, typed: dict[str, T.StructType], wide: T.StructType, spec: FleetTables) -> None:
    """After a roll-up: merge the period's small files, and keep the state at this time.

    Becomes visible with the next commit whose closed_upto is done.batch.
    """
    results = store.open_rows(wide, done).filter(~F.col(TABLE).isin(SEEN, MOMENTS))
    store.write(f"closed/upto={done.batch}", results)
    still_open = store.state(MOMENTS, typed[MOMENTS], done).filter(F.col(spec.ts) >= _period_end(done.last_ts, spec.period))
    state = {
        SEEN: last_seen(store, typed[SEEN], done, spec),
        MOMENTS: rollup.merge_moments(still_open, spec.key, list(spec.averages), spec.ts),
    }
    store.write(f"state/upto={done.batch}", together(state, wide))


def read_table(store: PollStore, table: str, rows: T.StructType, spec: FleetTables, at: Commit | None = None) -> DataFrame:
    """All committed rows of a table, as of a commit or the newest one."""
    return store.read(table, spec.schemas(rows)[table], at)
