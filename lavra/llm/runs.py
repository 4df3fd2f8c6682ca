"""Runs of the same event in ordered sequences, collapsed to one row each.

The unit of work is a block: the events of one entity in one stretch of time, so an entity that holds a third of all
rows is spread over as many pieces as it has blocks. The stretch is made as short as the fullest block needs to stay
within ``BLOCK_ROWS``, so blocks keep their size when the data grow in a fixed span of time. Within a block a window finds the events that differ from their
predecessor; maximal stretches without such a boundary become fragments, one row each. What a block can't know, whether
its first event continues the block before, is settled from one row per block (its first and last event and its number
of events), over which the window per entity runs.

Boundary rows are then all that is left: positions come from the blocks' prefix sums, ``lead`` over the starts gives
each run's number of events by position difference and its duration by the end the next start has before it. The
smallest and largest ids, which don't follow the order, are merged from the run's fragments.

Copies of an event (same entity, time and type) count once, under their smallest id. Rows with a null entity, time or
type belong to no sequence and are left out. Ties in time are ordered by id. Empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lavra.functions.time import from_micros, micros
from lavra.session import staged

BLOCK_SECONDS = 6 * 3600
BLOCK_ROWS = 500_000


def _fullest(events: DataFrame) -> int:
    """The events of the fullest block of ``BLOCK_SECONDS``."""
    at = F.floor(F.col("us") / F.lit(BLOCK_SECONDS * 1_000_000))
    return events.groupBy("entity", at.alias("b")).count().agg(F.max("count")).first()[0] or 0


def prepared(df: DataFrame, entity: Column, ts: Column, kind: Column, row_id: Column, rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """Events (entity, us, kind, id) and the seconds of a block, so that the fullest holds about ``rows`` events (one second is the least).

    Copies share entity and time and would all meet in one block. Where a block is overfull, they are first combined,
    before any shuffle by block, and the rest is counted again.
    """
    events = df.select(entity.alias("entity"), micros(ts).alias("us"), kind.cast("long").alias("kind"), row_id.cast("long").alias("id")).na.drop()
    most = _fullest(events)
    if most > rows:
        events = staged(events.groupBy("entity", "us", "kind").agg(F.min("id").alias("id")), "run-events")
        most = _fullest(events)
    return events, max(1, BLOCK_SECONDS * rows // max(rows, most))


def fragments(events: DataFrame, max_gap_s: int, block_s: int) -> DataFrame:
    """Stretches of equal neighbours inside each block: (entity, block, frag, kind, at, first_us, last_us, n, id_min, id_max).

    ``frag`` counts from 0 in the block; ``at`` is the place of its first event in the block.
    """
    events = events.withColumn("block", F.floor(F.col("us") / F.lit(block_s * 1_000_000)))
    # One shuffle: copies share entity and time, so they meet in their block's partition.
    once = events.repartition("entity", "block").groupBy("entity", "block", "us", "kind").agg(F.min("id").alias("id"))
    w = Window.partitionBy("entity", "block").orderBy("us", "id")
    apart = (F.col("kind") != F.lag("kind").over(w)) | (F.col("us") - F.lag("us").over(w) > max_gap_s * 1_000_000)
    marked = once.withColumn("at", F.row_number().over(w) - 1).withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int"))
    numbered = marked.withColumn("frag", F.sum("apart").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("entity", "block", "frag").agg(
        F.first("kind").alias("kind"), F.min("at").alias("at"), F.min("us").alias("first_us"), F.max("us").alias("last_us"),
        F.count("*").alias("n"), F.min("id").alias("id_min"), F.max("id").alias("id_max"),
    )


def collapse_runs(df: DataFrame, entity: Column, ts: Column, kind: Column, row_id: Column, max_gap_s: int = 900, block_s: int | None = None) -> DataFrame:
    """One row per run: (entity, kind, inicio, fim, n, duration_s, id_min, id_max).

    Neighbours of one entity in order of time and id belong to one run if their kind is equal and at most ``max_gap_s``
    seconds (inclusive) lie between them.
    """
    gap = max_gap_s * 1_000_000
    events, fit = prepared(df, entity, ts, kind, row_id)
    frags = staged(fragments(events, max_gap_s, block_s or fit), "fragments")
    # One row per block; the entity's whole sequence is these rows in order.
    ends = F.struct("frag", "kind", "first_us", "last_us", "at")
    blocks = frags.groupBy("entity", "block").agg(
        F.min(ends).alias("head"), F.max(ends).alias("tail"), F.sum("n").alias("n"),
        F.max(F.when(F.col("frag") == 1, F.col("at"))).alias("second_at"), F.max(F.when(F.col("frag") == 0, F.col("last_us"))).alias("first_end"),
    )
    w = Window.partitionBy("entity").orderBy("block")
    before = F.lag("tail").over(w)
    continues = (before["kind"] == F.col("head.kind")) & (F.col("head.first_us") - before["last_us"] <= gap)
    blocks = blocks.select(
        "entity", "block", "head", "tail", "second_at", "first_end",
        F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        F.coalesce(continues, F.lit(False)).alias("continues"),
        before["last_us"].alias("before_us"),
    )
    # The block's first and last own start, for the runs that cross its borders.
    own_first = F.when(~F.col("continues"), F.struct((F.col("offset") + F.col("head.at")).alias("pos"), F.col("before_us").alias("before_us"))).when(
        F.col("second_at").isNotNull(), F.struct((F.col("offset") + F.col("second_at")).alias("pos"), F.col("first_end").alias("before_us"))
    )
    own_last = F.when(~F.col("continues") | (F.col("tail.frag") > 0), F.col("offset") + F.col("tail.at"))
    blocks = blocks.select("entity", "block", "offset", "continues", "before_us", own_first.alias("own_first"), own_last.alias("own_last"))
    later = Window.partitionBy("entity").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "entity", "block", "offset", "continues", "before_us",
        F.last("own_first", ignorenulls=True).over(later).alias("next_first"),
        F.last("own_last", ignorenulls=True).over(earlier).alias("open_run"),
    )
    placed = frags.join(blocks, ["entity", "block"]).withColumn("is_start", (F.col("frag") > 0) | ~F.col("continues"))
    placed = placed.withColumn("run", F.when(F.col("is_start"), F.col("offset") + F.col("at")).otherwise(F.col("open_run")))
    # Boundary rows only: each start knows where the run before it ended.
    inside = Window.partitionBy("entity", "block").orderBy("frag")
    placed = placed.withColumn("end_before", F.coalesce(F.lag("last_us").over(inside), F.col("before_us")))
    starts = placed.where("is_start")
    ahead = F.lead(F.struct(F.col("run").alias("pos"), F.col("end_before").alias("before_us"))).over(inside)
    starts = starts.withColumn("ahead", F.coalesce(ahead, F.col("next_first"))).select(
        "entity", "run", "kind", "first_us", (F.col("ahead.pos") - F.col("run")).alias("n"), F.col("ahead.before_us").alias("last_us")
    )
    merged = placed.groupBy("entity", "run").agg(F.min("id_min").alias("id_min"), F.max("id_max").alias("id_max"), F.sum("n").alias("held"), F.max("last_us").alias("held_us"))
    runs = starts.join(merged, ["entity", "run"])
    # The entity's last run has no start after it; it ends with its own last event.
    end = F.coalesce("last_us", "held_us")
    return runs.select(
        "entity", "kind", from_micros(F.col("first_us")).alias("inicio"), from_micros(end).alias("fim"), F.coalesce("n", "held").alias("n"),
        ((end - F.col("first_us")) / F.lit(1e6)).alias("duration_s"), "id_min", "id_max",
    )
