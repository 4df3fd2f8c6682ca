"""The analytic layer of an event log: purge, exact duplicates, gaps, sessions, transitions.

Nulls: a null in a duplicate's columns equals another null; rows with a null key or time have no gap and no session.
Empty input gives empty results. Extra columns are ignored unless they are among the columns named.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.functions.stats import quantile
from lavra.functions.time import millis
from lavra.operators.chained import BLOCK_SECONDS, block_of, with_previous, with_running_sum


def deduplicated(df: DataFrame, id_col: str, columns: Sequence[str], purge: Column | None = None) -> DataFrame:
    """Rows equal in ``columns`` once, under their smallest id, with ``copies``; rows for which ``purge`` is true go first.

    The copies of all rows add up to the rows that weren't purged.
    """
    if purge is not None:
        df = df.where(~F.coalesce(purge, F.lit(False)))
    return df.groupBy(*columns).agg(F.min(id_col).alias(id_col), F.count("*").alias("copies"))


def duplicate_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Groups of equal rows, the rows in them and the surplus among them."""
    groups = df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


BLOCK_ROWS = 500_000


def gaps(df: DataFrame, keys: Sequence[str], ts: str, id_col: str, carry: Sequence[str] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``keys``, ``ts``, id and ``carry`` with ``gap_ms``, the whole milliseconds since the key's row before (null for its first).

    Ids are unique. Where a block holds more than ``block_rows`` rows, instants are ordered instead of rows: the first id
    of an instant has the gap to the instant before, the others have none between them.
    """
    rows = df.select(*dict.fromkeys([*keys, ts, id_col, *carry])).where(F.col(ts).isNotNull()).na.drop(subset=list(keys)).withColumn("_blk", block_of(ts))
    step = millis(ts) - millis(f"prev_{ts}")
    if (rows.groupBy(*keys, "_blk").count().agg(F.max("count")).first()[0] or 0) <= block_rows:
        return with_previous(rows, keys, "_blk", [ts, id_col], [ts]).withColumn("gap_ms", step).drop("_blk", f"prev_{ts}")
    first = rows.groupBy(*keys, ts, "_blk").agg(F.min(id_col).alias("_first"))
    first = with_previous(first, keys, "_blk", [ts], [ts]).select(*keys, ts, "_first", step.alias("_step"))
    out = rows.drop("_blk").join(first, [*keys, ts])
    return out.withColumn("gap_ms", F.when(F.col(id_col) == F.col("_first"), F.col("_step")).otherwise(0)).drop("_first", "_step")


def _instants(df: DataFrame, keys: Sequence[str], ts: str, aggregates: Sequence[Column] = ()) -> DataFrame:
    """One row per key and instant: rows at one instant have no gap between them, so however many there are, they are
    combined before anything is ordered."""
    rows = df.where(F.col(ts).isNotNull()).na.drop(subset=list(keys))
    return rows.groupBy(*keys, ts).agg(F.count("*").alias("_n"), *aggregates).withColumn("_blk", block_of(ts))


def sessions(df: DataFrame, keys: Sequence[str], ts: str, gap_s: float, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None) -> DataFrame:
    """One row per session of each key: a row starts a new one if it is the key's first or more than ``gap_s`` after the one before.

    ``n`` counts rows; ``sums`` and ``maxima`` name further columns over the session's rows.
    """
    sums, maxima = sums or {}, maxima or {}
    first = [F.sum(c).alias(f"_s_{n}") for n, c in sums.items()] + [F.max(c).alias(f"_m_{n}") for n, c in maxima.items()]
    inst = with_previous(_instants(df, keys, ts, first), keys, "_blk", [ts], [ts])
    gap = millis(ts) - millis(f"prev_{ts}")
    starts = (F.col(f"prev_{ts}").isNull() | (gap > int(gap_s * 1000))).cast("int")
    numbered = with_running_sum(inst.withColumn("_start", starts), keys, "_blk", [ts], "_start", "session")
    return numbered.groupBy(*keys, "session").agg(
        F.min(ts).alias("start"), F.max(ts).alias("end"), (millis(F.max(ts)) - millis(F.min(ts))).alias("duration_ms"), F.sum("_n").alias("n"),
        *[F.sum(f"_s_{n}").alias(n) for n in sums], *[F.max(f"_m_{n}").alias(n) for n in maxima],
    )


def sessions_by_gap(df: DataFrame, keys: Sequence[str], ts: str, gaps_s: Sequence[float]) -> DataFrame:
    """(gap_s, sessions) without making any session: first rows plus gaps beyond each threshold."""
    inst = with_previous(_instants(df, keys, ts), keys, "_blk", [ts], [ts])
    gap = millis(ts) - millis(f"prev_{ts}")
    wide = inst.agg(*[F.count_if(F.col(f"prev_{ts}").isNull() | (gap > int(s * 1000))).alias(f"g{i}") for i, s in enumerate(gaps_s)])
    rows = F.array(*[F.struct(F.lit(s).alias("gap_s"), F.col(f"g{i}").alias("sessions")) for i, s in enumerate(gaps_s)])
    return wide.select(F.inline(rows))


def transitions(df: DataFrame, keys: Sequence[str], ts: str, id_col: str, kind: str, accuracy: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(from, to, n, median_ms, mean_ms): how often a kind follows another in each key's order.

    A block is as short as the fullest day of a key needs for ``block_rows`` rows (one second is the least).
    """
    rows = df.select(*dict.fromkeys([*keys, ts, id_col, kind])).na.drop(subset=[*keys, ts])
    most = rows.groupBy(*keys, block_of(ts).alias("_blk")).count().agg(F.max("count")).first()[0] or 0
    rows = rows.withColumn("_blk", block_of(ts, max(1, BLOCK_SECONDS * block_rows // max(block_rows, most))))
    out = with_previous(rows, keys, "_blk", [ts, id_col], [ts, kind]).where(F.col(f"prev_{ts}").isNotNull())
    step = millis(ts) - millis(f"prev_{ts}")
    return out.groupBy(F.col(f"prev_{kind}").alias("from"), F.col(kind).alias("to")).agg(F.count("*").alias("n"), quantile(step, 0.5, accuracy).alias("median_ms"), F.avg(step).alias("mean_ms"))


def timing_profile(df: DataFrame, entity: str, kind: str, ts: str, id_col: str, least_gaps: int = 100, least_entities: int = 3, accuracy: int | None = None) -> DataFrame:
    """Per kind the quantiles of its gaps, and how far its entities' medians lie apart (for kinds with enough of both)."""
    g = gaps(df, [entity, kind], ts, id_col).where("gap_ms IS NOT NULL")
    q = [quantile("gap_ms", p, accuracy).alias(n) for p, n in ((0.5, "median_ms"), (0.9, "p90_ms"), (0.99, "p99_ms"))]
    overall = g.groupBy(kind).agg(F.count("*").alias("gaps"), *q)
    per = g.groupBy(kind, entity).agg(quantile("gap_ms", 0.5, accuracy).alias("m"))
    spread = per.groupBy(kind).agg(F.count("*").alias("entities"), F.max("m").alias("max_median"), F.min("m").alias("min_median"))
    spread = spread.withColumn("ratio", F.try_divide(F.col("max_median"), F.col("min_median")))
    return overall.join(spread, kind).where((F.col("gaps") >= least_gaps) & (F.col("entities") >= least_entities))
