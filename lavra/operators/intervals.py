"""Joins between events and half-open intervals [start, end), and between instants.

Intervals are laid into buckets of time; events meet them by entity and bucket, never by entity alone, so the pairs of a
hot entity are spread over its buckets. Intervals with a null or unordered end hold nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lavra.functions.time import micros, millis
from lavra.operators.chained import block_of, with_previous

BUCKET_SECONDS = 86_400
BLOCK_ROWS = 500_000


def bucketed(df: DataFrame, start: str, end: str, seconds: int = BUCKET_SECONDS, name: str = "_bkt") -> DataFrame:
    """Each sound interval once for every bucket it touches."""
    us = seconds * 1_000_000
    sound = df.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) > F.col(start)))
    return sound.withColumn(name, F.explode(F.sequence(F.floor(micros(start) / F.lit(us)), F.floor((micros(end) - 1) / F.lit(us)))))


def point_in_interval(events: DataFrame, intervals: DataFrame, entity: str, ts: str, start: str, end: str, take: Sequence[str], how: str = "left", seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Every event with the intervals of its entity that hold its time; overlapping intervals give a row each."""
    right = bucketed(intervals.select(entity, start, end, *take), start, end, seconds).withColumnRenamed(entity, "_ent")
    left = events.withColumn("_b", block_of(ts, seconds))
    on = (F.col(entity) == F.col("_ent")) & (F.col("_b") == F.col("_bkt")) & (F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end))
    return left.join(right, on, how).drop("_ent", "_b", "_bkt")


def overlap_ms(windows: DataFrame, intervals: DataFrame, entity: str, window: tuple[str, str], interval: tuple[str, str], take: Sequence[str], seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Pairs of windows and intervals of an entity that overlap, with ``overlap_ms``, the time they share."""
    ws, we = window
    s, e = interval
    left = bucketed(windows, ws, we, seconds, "_lb")
    right = bucketed(intervals.select(entity, s, e, *take), s, e, seconds, "_rb").withColumnRenamed(entity, "_ent")
    pairs = left.join(right, (F.col(entity) == F.col("_ent")) & (F.col("_lb") == F.col("_rb")) & (F.col(s) < F.col(we)) & (F.col(e) > F.col(ws)))
    # A pair that meets in several buckets counts in the first they share.
    us = F.lit(seconds * 1_000_000)
    first = F.floor(F.greatest(micros(ws), micros(s)) / us)
    pairs = pairs.where(F.col("_lb") == first)
    return pairs.withColumn("overlap_ms", millis(F.least(F.col(we), F.col(e))) - millis(F.greatest(F.col(ws), F.col(s)))).drop("_lb", "_rb", "_ent")


def state_shares(windows: DataFrame, intervals: DataFrame, entity: str, window: tuple[str, str], interval: tuple[str, str], state: str, states: Sequence[str]) -> DataFrame:
    """Per window the share of its time in each state, the covered share, what overlaps twice, and the dominant state.

    States of equal time go by the order of ``states``; a window without any state has shares 0 and no dominant state.
    """
    keys = [entity, *window]
    held = overlap_ms(windows.select(*keys).distinct(), intervals, entity, window, interval, [state])
    sums = held.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col(state) == s, F.col("overlap_ms"))), F.lit(0)).alias(f"_s{i}") for i, s in enumerate(states)])
    out = windows.select(*keys).distinct().join(sums, keys, "left").na.fill(0, [f"_s{i}" for i in range(len(states))])
    length = (millis(window[1]) - millis(window[0])).cast("double")
    total = sum((F.col(f"_s{i}") for i in range(1, len(states))), F.col("_s0"))
    best = F.array_max(F.array(*[F.struct(F.col(f"_s{i}").alias("ms"), F.lit(-i).alias("o"), F.lit(s).alias("s")) for i, s in enumerate(states)]))
    return out.select(
        *keys,
        *[(F.col(f"_s{i}") / length).alias(f"share_{i}") for i in range(len(states))],
        F.least(F.lit(1.0), total / length).alias("covered"),
        F.greatest(F.lit(0.0), total / length - 1).alias("doubled"),
        F.when(total > 0, best["s"]).alias("dominant"),
    )


def asof(
    left: DataFrame, right: DataFrame, entity: str, left_ts: str, right_ts: str, right_id: str, direction: str = "forward", exact: bool = True,
    tolerance_s: float | None = None, seconds: int = BUCKET_SECONDS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``left`` with ``match_id`` and ``match_ts``: the next (or last) right row of the same entity, null if there is none.

    Both sides are put in one order and cut into blocks; within a block a window looks ahead, beyond it one row per block
    says what comes next. Of right rows at the same time the smallest id is taken. ``exact`` lets equal times match.
    Left rows without entity or time match nothing. Where a block holds more than ``block_rows`` left rows, each of its
    instants is matched once and the rows are joined to their instants.
    """
    fullest = left.groupBy(entity, block_of(left_ts, seconds).alias("_b")).count().agg(F.max("count")).first()[0] or 0
    args = (right, entity, left_ts, right_ts, right_id, direction, exact, tolerance_s, seconds)
    if fullest <= block_rows:
        return _asof(left, *args)
    instants = left.select(entity, left_ts).na.drop().distinct()
    return left.join(_asof(instants, *args), [entity, left_ts], "left").select(*left.columns, "match_id", "match_ts")


def _asof(left: DataFrame, right: DataFrame, entity: str, left_ts: str, right_ts: str, right_id: str, direction: str, exact: bool, tolerance_s: float | None, seconds: int) -> DataFrame:
    forward = direction == "forward"
    r = right.select(F.col(entity).alias("_e"), F.col(right_ts).alias("_t"), F.col(right_id).alias("_id")).na.drop(subset=["_e", "_t"])
    r = r.groupBy("_e", "_t").agg(F.min("_id").alias("_id"))
    r = r.select("_e", "_t", F.struct(F.col("_t").alias("ts"), F.col("_id").alias("id")).alias("_m"), F.lit(None).alias("_row"))
    side = 0 if exact == forward else 1  # where left rows stand among right rows of their time
    rows = left.select(F.col(entity).alias("_e"), F.col(left_ts).alias("_t"), F.lit(None).cast(r.schema["_m"].dataType).alias("_m"), F.struct(*left.columns).alias("_row"))
    r = r.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)).withColumn("_side", F.lit(1 - side))
    both = rows.withColumn("_side", F.lit(side)).unionByName(r).withColumn("_b", block_of("_t", seconds))
    # What comes next is what came last in the opposite order: a frame that grows with the row is kept up, not worked out anew.
    order = [F.desc("_t"), F.desc("_side")] if forward else ["_t", "_side"]
    w = Window.partitionBy("_e", "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("_near", F.last("_m", ignorenulls=True).over(w))
    tails = r.withColumn("_b", block_of("_t", seconds)).groupBy("_e", "_b").agg((F.min("_m") if forward else F.max("_m")).alias("_edge"))
    blocks = both.select("_e", "_b").distinct().join(tails, ["_e", "_b"], "left")
    beyond = Window.partitionBy("_e").orderBy(F.desc("_b") if forward else F.col("_b")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_e", "_b", F.last("_edge", ignorenulls=True).over(beyond).alias("_far"))
    out = near.where("_row IS NOT NULL").join(blocks, ["_e", "_b"], "left").withColumn("_hit", F.coalesce("_near", "_far"))
    if tolerance_s is not None:
        off = F.abs(micros(F.col("_hit.ts")) - micros("_t"))
        out = out.withColumn("_hit", F.when(off <= round(tolerance_s * 1_000_000), F.col("_hit")))
    return out.select("_row.*", F.col("_hit.id").alias("match_id"), F.col("_hit.ts").alias("match_ts"))


def overlaps_with_previous(intervals: DataFrame, entity: str, start: str, end: str, id_col: str, state: str) -> DataFrame:
    """Intervals that start before the one before them (by start, end, id) has ended, with that one and the overlap.

    Intervals without a start come last in that order and overlap nothing; a missing end comes after all others.
    """
    rows = intervals.select(entity, id_col, start, end, state).where(F.col(start).isNotNull())
    rows = rows.withColumn("_blk", block_of(start)).withColumn("_end", F.coalesce(micros(end), F.lit(1 << 62)))
    out = with_previous(rows, [entity], "_blk", [start, "_end", id_col], [id_col, end, state]).drop("_blk", "_end")
    return out.where(F.col(start) < F.col(f"prev_{end}")).withColumn("overlap_s", (millis(f"prev_{end}") - millis(start)) / F.lit(1000.0))


def interval_quality(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """How many intervals are null, empty or negative, and the hours the sound ones hold."""
    hours: Column = (millis(end) - millis(start)) / F.lit(3_600_000.0)
    return intervals.agg(
        F.count("*").alias("rows"), F.count_if(F.col(start).isNull()).alias("null_start"), F.count_if(F.col(end).isNull()).alias("null_end"),
        F.count_if(F.col(end) == F.col(start)).alias("empty"), F.count_if(F.col(end) < F.col(start)).alias("negative"),
        F.sum(F.when(F.col(end) > F.col(start), hours)).alias("hours"),
    )
