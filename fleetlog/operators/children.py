"""Change log and snapshot of child rows that are replaced by parent, over many polls.

The snapshot of a parent changes only in polls that list the parent. Children that such
a poll does not list go; when none is left, the poll's children become the new snapshot,
and only then. So between two replacements, an epoch, the snapshot is what the epoch's
first poll listed, less whatever was missing since. A row of a poll is logged if the
snapshot before it does not hold the child with the same values.

This needs no row-by-row fold of snapshots. A child's polls in a row form a run; the
epoch that would start at a poll ends where the longest run of its children ends, which
gives every poll of a parent the poll of the next replacement. Following these from the
parent's first poll marks the epochs. A child is in the snapshot if its run reaches back
to the epoch's start, with the values it had there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlog.operators.changes import changed_in_poll, child_set_snapshot, match_keys
from fleetlog.session import new_run_dir

# Polls of a parent that are followed within one row; parents with more are followed by doubling.
FOLD_POLLS = 2000


def child_set_step(
    state: DataFrame, poll: DataFrame, parent: str, child: str, cols: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Rows to log and the snapshot after one poll; state and poll have parent, child and cols."""
    names = [parent, child, *cols]
    state, poll = state.select(*names), poll.select(*names)
    return changed_in_poll(poll, [parent, child], cols, state), child_set_snapshot(state, poll, parent, child)


def _saved(df: DataFrame, name: str) -> DataFrame:
    path = new_run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fold_starts(polls: DataFrame, parent: str) -> DataFrame:
    """Epoch starts of parents whose polls fit into one row."""
    steps = F.array_sort(F.collect_list(F.struct("_no", "_then")))
    empty = F.array().cast("array<long>")

    def follow(acc, step):
        here = step["_no"] == acc["at"]
        return F.struct(
            F.when(here, step["_then"]).otherwise(acc["at"]).alias("at"),
            F.when(here, F.array_append(acc["starts"], step["_no"])).otherwise(acc["starts"]).alias("starts"),
        )

    first = F.struct(F.lit(1).cast("long").alias("at"), empty.alias("starts"))
    found = polls.groupBy(parent).agg(F.aggregate(steps, first, follow)["starts"].alias("starts"))
    return found.select(parent, F.explode("starts").alias("_no"))


def _doubled_starts(polls: DataFrame, parent: str) -> DataFrame:
    """Epoch starts by pointer doubling: round i adds what lies 2^i epochs behind those known.

    Takes as many rounds as the number of epochs of a parent has binary digits; every
    round is written, none holds a parent in one task.
    """
    jump = _saved(polls.select(parent, "_no", "_then"), "children-jump")
    reached = _saved(jump.filter("_no = 1").select(parent, "_no"), "children-starts")
    while not jump.isEmpty():
        further = reached.join(jump, [parent, "_no"]).select(parent, F.col("_then").alias("_no"))
        reached = _saved(reached.unionByName(further), "children-starts")
        onward = jump.select(parent, F.col("_no").alias("_then"), F.col("_then").alias("_after"))
        # pointers beyond the last poll have nothing to follow
        jump = _saved(jump.join(onward, [parent, "_then"]).select(parent, "_no", F.col("_after").alias("_then")), "children-jump")
    return reached.join(polls.select(parent, "_no"), [parent, "_no"], "left_semi")


def child_sets(
    rows: DataFrame, parent: str, child: str, cols: Sequence[str], ts: str = "timestamp", fold_polls: int = FOLD_POLLS
) -> tuple[DataFrame, DataFrame]:
    """Log (parent, child, cols, ts) of all polls and the snapshot after the last one.

    rows is a whole history: one row per parent, child and poll. A child belongs to one
    parent; listed under another it counts as another child. Values are compared
    null-safely. Rows without a parent or child are left out. A parent has at most as
    many polls as there are, its children are spread over tasks.
    """
    src = rows.select(parent, child, *cols, ts).filter(F.col(parent).isNotNull() & F.col(child).isNotNull())
    listed = src.select(parent, ts).distinct().withColumn("_no", F.row_number().over(Window.partitionBy(parent).orderBy(ts)).cast("long"))
    numbered = src.join(listed, [parent, ts])
    own = Window.partitionBy(parent, child).orderBy("_no")
    runs = numbered.withColumn("_run", F.col("_no") - F.row_number().over(own))
    run = Window.partitionBy(parent, child, "_run")
    runs = _saved(runs.withColumn("_end", F.max("_no").over(run) + 1), "children-runs")
    polls = runs.groupBy(parent, "_no").agg(F.max("_end").alias("_then"))
    sizes = polls.groupBy(parent).agg(F.max("_no").alias("_polls"))
    long = sizes.filter(F.col("_polls") > fold_polls)
    starts = _fold_starts(match_keys(polls, [parent], "left_anti", long), parent)
    if not long.isEmpty():
        starts = starts.unionByName(_doubled_starts(match_keys(polls, [parent], "left_semi", long), parent))
    starts = _saved(starts, "children-epochs")

    placed = runs.join(starts.withColumn("_starts", F.lit(True)), [parent, "_no"], "left")
    before = Window.partitionBy(parent, child, "_run").orderBy("_no").rowsBetween(Window.unboundedPreceding, -1)
    held = F.last(F.when(F.col("_starts"), F.struct(*cols)), ignorenulls=True).over(before)
    log = placed.withColumn("_held", held).filter(F.col("_held").isNull() | ~F.col("_held").eqNullSafe(F.struct(*cols)))
    last = starts.groupBy(parent).agg(F.max("_no").alias("_no")).join(sizes, parent)
    kept = runs.join(last, [parent, "_no"]).filter(F.col("_end") > F.col("_polls"))
    return log.select(parent, child, *cols, ts), kept.select(parent, child, *cols)
