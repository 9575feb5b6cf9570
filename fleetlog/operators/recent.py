"""Queue of recent distinct values per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlog.operators.sequence import (
    HOT_ROWS, SEGMENT, HotKeys, cut_segments, hot_keys, null_safe_on,
)
from fleetlog.operators.timeline import drop_consecutives
from fleetlog.session import new_run_dir

# Rows that are put into one array.
PIECE_ROWS = 16_384
# Rounds in which pieces are run from all queues that the pieces before them may end with.
GUESSES = 6


def _after(values: Column, start: Column, maxlen: int) -> Column:
    """The queue after an array of values."""

    def put(queue: Column, x: Column) -> Column:
        grown = F.concat(queue, F.array(x))
        left = F.slice(grown, F.greatest(F.lit(1), F.size(grown) - maxlen + 1), maxlen)
        return F.when(F.exists(queue, lambda y: y.eqNullSafe(x)), queue).otherwise(left)

    return F.aggregate(values, start, put)


def _in_order(order: Sequence[str], value: str) -> Column:
    """Values of a group as one array."""
    return F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_value")))), lambda x: x["_value"])


def _stored(df: DataFrame) -> DataFrame:
    path = new_run_dir(df.sparkSession, "recent")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _joined(left: DataFrame, right: DataFrame, pairs: dict[str, str], how: str = "inner") -> DataFrame:
    """Null-safe join; columns of the right side that are joined on go."""
    side = right.withColumnsRenamed({r: f"_right{r}" for r in pairs.values()})
    names = [f"_right{r}" for r in pairs.values()]
    on = null_safe_on([left[c] for c in pairs], [side[n] for n in names])
    return left.join(side, on, how).drop(*names)


def _pieces(rows: DataFrame, hot: HotKeys, key: str, value: str, order: Sequence[str], piece_rows: int) -> DataFrame:
    """Rows of a key in arrays: key, segment, number of the piece in it, values."""
    segment = F.lit(0).cast("long")
    cut = cut_segments(rows, hot, [key], order[0], "left") if hot.levels else rows.withColumn(SEGMENT, segment)
    number = F.row_number().over(Window.partitionBy(key, SEGMENT).orderBy(*order)) - 1
    piece = F.floor(F.col("_number") / piece_rows)
    return cut.withColumn("_number", number).groupBy(key, SEGMENT, piece.alias("_piece")).agg(
        _in_order(["_number"], value).alias("_values")
    )


def _places(pieces: DataFrame, key: str) -> DataFrame:
    """Place of each piece in the order of its key's, and their number; only segments are ordered."""
    segments = pieces.groupBy(key, SEGMENT).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    offsets = segments.select(
        key, SEGMENT, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(key)).alias("_last"),
    )
    placed = _joined(pieces.select(key, SEGMENT, "_piece"), offsets, {key: key, SEGMENT: SEGMENT})
    return placed.select(key, SEGMENT, "_piece", (F.col("_before") + F.col("_piece")).alias("_at"), "_last")


def _composed(known: DataFrame, key: str, pieces: int) -> DataFrame:
    """Where the first pieces lead (key, place, queue): maps of 1, 2, 4, ... pieces from two of half as many."""
    now = known.select(key, "_at", "_start", (F.col("_at") + 1).alias("_to_at"), F.col("_end").alias("_to"))
    for _ in range((pieces - 1).bit_length()):
        further = now.select(key, "_at", "_start", F.col("_to_at").alias("_far_at"), F.col("_to").alias("_far"))
        both = _joined(now, further, {key: key, "_to_at": "_at", "_to": "_start"}, "left")
        now = _stored(both.select(
            key, "_at", "_start", F.coalesce("_far_at", "_to_at").alias("_to_at"), F.coalesce("_far", "_to").alias("_to")
        ))
    return now.filter("_at = 0 AND size(_start) = 0").select(key, F.col("_to_at").alias("_at"), F.col("_to").alias("_start"))


def _by_pieces(pieces: DataFrame, key: str, empty: Column, maxlen: int, guesses: int) -> DataFrame:
    """Queues of keys in several pieces.

    What a piece does to a queue is known for some starting queues: first the empty one,
    then those that the piece before it may end with, for all pieces at once, until
    nothing is new. A queue that is full of values of one piece no longer depends on its start,
    so two or three rounds are usual. The maps are then composed in log2(pieces) rounds.
    Where a start still has an effect after `guesses` rounds, only queues that do occur
    are followed, a piece a round at least.
    """
    pieces = _stored(pieces)
    places = _stored(_places(pieces, key))
    most = places.agg(F.max("_last")).first()[0]
    if most is None:
        return pieces.select(key, empty.alias("recent"))
    wanted, known, rounds = places.select(key, "_at", empty.alias("_start")), None, 0
    while True:
        named = _joined(wanted, places.drop("_last"), {key: key, "_at": "_at"})
        started = _joined(pieces, named, {key: key, SEGMENT: SEGMENT, "_piece": "_piece"})
        ran = _stored(started.select(key, "_at", "_start", _after(F.col("_values"), F.col("_start"), maxlen).alias("_end")))
        known = known.union(ran) if known else ran
        rounds += 1
        if rounds < guesses and most > 1:
            ahead = ran.select(key, (F.col("_at") + 1).alias("_at"), F.col("_end").alias("_start")).distinct()
            ahead = _joined(ahead, places, {key: key, "_at": "_at"}, "left_semi")
            wanted = _stored(_joined(ahead, known, {key: key, "_at": "_at", "_start": "_start"}, "left_anti"))
            if not wanted.isEmpty():
                continue
        reached = _stored(_composed(known, key, most))
        wanted = _joined(reached, places, {key: key, "_at": "_at"}, "left_semi")
        if most == 1 or wanted.isEmpty():
            return reached.select(key, F.col("_start").alias("recent"))


def recent_distinct(
    df: DataFrame,
    key: str,
    value: str,
    order: Sequence[str],
    maxlen: int,
    hot_rows: int = HOT_ROWS,
    hot: HotKeys | None = None,
    piece_rows: int = PIECE_ROWS,
    guesses: int = GUESSES,
) -> DataFrame:
    """Queue (oldest first) after all values of a key in order.

    A value not in the queue is appended; above maxlen the oldest leaves and may
    come back later. Repeats in a row change nothing and are dropped first. Null is a
    value like others. order ends with a column that tells rows of one time apart.

    Keys of up to piece_rows rows (hot_rows, if fewer) are one array each. If there are larger ones, keys with
    no more values than the queue holds need their first sightings only, and the
    rows of the others are cut into pieces.
    """
    src = df.select(*dict.fromkeys([key, value, *order]))
    kind = f"array<{src.schema[value].dataType.simpleString()}>"
    empty = F.array().cast(kind)
    most = src.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    if most <= min(piece_rows, hot_rows):
        rows = drop_consecutives(src, [key], [value], order, hot_rows, HotKeys())
        return rows.groupBy(key).agg(_in_order(order, value).alias("_values")).select(
            key, _after(F.col("_values"), empty, maxlen).alias("recent")
        )
    firsts = src.groupBy(key, value).agg(F.min(F.struct(*order)).alias("_first"))
    sizes = _stored(firsts.groupBy(key).agg(F.count(F.lit(1)).alias("_n")))
    few = _joined(firsts, sizes.filter(F.col("_n") <= maxlen).select(key), {key: key}, "left_semi")
    few = few.groupBy(key).agg(_in_order(["_first"], value).alias("recent"))
    many = _joined(src, sizes.filter(F.col("_n") > maxlen).select(key), {key: key}, "left_semi")
    hot = hot or hot_keys(src, [key], order[0], hot_rows)
    rows = drop_consecutives(many, [key], [value], order, hot_rows, hot)
    pieces = _pieces(rows, hot, key, value, order, piece_rows)
    return _by_pieces(pieces, key, empty, maxlen, guesses).unionByName(few)
