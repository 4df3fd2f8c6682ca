"""Dense grids of time bins, features over windows that end at a sample's time, and targets that start there.

Bins are epoch-aligned and half-open. A feature never looks at or beyond its sample's time. Rows with a null entity or
time belong to no bin. Entities span from their first to their last bin unless a period is given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lavra.functions.time import bucket_start


def tumbling(df: DataFrame, entity: str, ts: str, seconds: int, aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates of each entity's rows by bin; only bins with rows."""
    return df.where(F.col(ts).isNotNull() & F.col(entity).isNotNull()).groupBy(entity, bucket_start(ts, seconds).alias("bin")).agg(*aggregates)


def dense(bins: DataFrame, entity: str, seconds: int, fill: Sequence[str]) -> DataFrame:
    """All bins of each entity from its first to its last, missing ones filled with 0."""
    span = bins.groupBy(entity).agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    grid = span.select(entity, F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL {seconds} SECONDS"))).alias("bin"))
    return grid.join(bins, [entity, "bin"], "left").na.fill(0, list(fill))


def trailing(bins: DataFrame, entity: str, columns: Sequence[str], widths: Sequence[int], shift: bool = True) -> DataFrame:
    """Sum, mean and largest of each column over the last ``widths`` bins of a dense grid, at least one.

    With ``shift`` a bin sees the bins before it only, and each entity's first bin is dropped. The grid holds bins, not
    events, so an entity's window is as long as its time span.
    """
    w = Window.partitionBy(entity).orderBy("bin")
    end = -1 if shift else 0
    out = {}
    for c in columns:
        for n in widths:
            frame = w.rowsBetween(end - n + 1, end)
            out |= {f"{c}_sum_{n}": F.sum(c).over(frame), f"{c}_mean_{n}": F.avg(c).over(frame), f"{c}_max_{n}": F.max(c).over(frame)}
    out_df = bins.withColumns(out)
    return out_df.withColumn("_rn", F.row_number().over(w)).where("_rn > 1").drop("_rn") if shift else out_df


def sample_grid(df: DataFrame, entity: str, first: str, last: str, stride_s: int, observe_s: int, horizon_s: int) -> DataFrame:
    """Each entity at every ``stride_s`` from ``first`` to ``last`` inclusive: sample_id, feature_start, prediction_time, target_end.

    Sample ids follow prediction time and entity.
    """
    entities = df.where(F.col(entity).isNotNull()).select(entity).distinct()
    times = F.explode(F.sequence(F.expr(f"timestamp_ntz'{first}'"), F.expr(f"timestamp_ntz'{last}'"), F.expr(f"INTERVAL {stride_s} SECONDS")))
    grid = entities.select(entity, times.alias("prediction_time"))
    return grid.select(
        entity,
        (F.col("prediction_time") - F.expr(f"INTERVAL {observe_s} SECONDS")).alias("feature_start"),
        "prediction_time",
        (F.col("prediction_time") + F.expr(f"INTERVAL {horizon_s} SECONDS")).alias("target_end"),
    )


def sample_grid_of_span(df: DataFrame, entity: str, ts: str, stride_s: int, observe_s: int, horizon_s: int) -> DataFrame:
    """``sample_grid`` over all of ``df``: a first observation starts in the first bin of all, a last horizon ends with the last.

    A table shorter than observation and horizon gives no samples.
    """
    lo = bucket_start(F.min(ts), stride_s) + F.expr(f"INTERVAL {observe_s} SECONDS")
    hi = bucket_start(F.max(ts), stride_s) + F.expr(f"INTERVAL {stride_s - horizon_s} SECONDS")
    first, last = df.agg(lo.alias("lo"), hi.alias("hi")).first()
    if first is None or first > last:
        return sample_grid(df.where("false"), entity, "1970-01-01", "1970-01-01", stride_s, observe_s, horizon_s)
    return sample_grid(df, entity, first, last, stride_s, observe_s, horizon_s)


def with_sample_ids(samples: DataFrame, entity: str) -> DataFrame:
    """``sample_id`` 1, 2, ... by prediction time and entity: numbered within each time, times offset by their counts."""
    counts = samples.groupBy("prediction_time").agg(F.count("*").alias("_n"))
    w = Window.orderBy("prediction_time").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("prediction_time", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    own = F.row_number().over(Window.partitionBy("prediction_time").orderBy(entity))
    return samples.withColumn("_k", own).join(offsets, "prediction_time").withColumn("sample_id", F.col("_off") + F.col("_k")).drop("_k", "_off")


def sliding(samples: DataFrame, bins: DataFrame, entity: str, seconds: int, observe_s: int, columns: Sequence[str]) -> DataFrame:
    """Sums of binned columns over each sample's [feature_start, prediction_time), for times on bin borders.

    Every bin is laid to the samples it serves, so this is an equality join, not a range join.
    """
    steps = observe_s // seconds
    lifted = bins.select(entity, *columns, F.explode(F.array(*[F.col("bin") + F.expr(f"INTERVAL {seconds * k} SECONDS") for k in range(1, steps + 1)])).alias("prediction_time"))
    sums = lifted.groupBy(entity, "prediction_time").agg(*[F.sum(c).alias(c) for c in columns])
    return samples.join(sums, [entity, "prediction_time"], "left").na.fill(0, list(columns))


def horizon_target(samples: DataFrame, events: DataFrame, entity: str, ts: str, seconds: int, horizon_s: int) -> DataFrame:
    """``target``: 1 if an event of the entity starts in [prediction_time, target_end)."""
    steps = horizon_s // seconds
    hit = events.where(F.col(ts).isNotNull()).select(entity, bucket_start(ts, seconds).alias("_b")).distinct()
    lifted = hit.select(entity, F.explode(F.array(*[F.col("_b") - F.expr(f"INTERVAL {seconds * k} SECONDS") for k in range(steps)])).alias("prediction_time")).distinct()
    return samples.join(lifted.withColumn("target", F.lit(1)), [entity, "prediction_time"], "left").na.fill(0, ["target"])


def outside(samples: DataFrame, outages: Sequence[tuple[str, str]]) -> DataFrame:
    """``valid``: whether [feature_start, target_end) touches none of the half-open outages."""
    touched = F.lit(False)
    for a, b in outages:
        touched = touched | ((F.col("feature_start") < F.expr(f"timestamp_ntz'{b}'")) & (F.col("target_end") > F.expr(f"timestamp_ntz'{a}'")))
    return samples.withColumn("valid", ~touched)


def recency_buckets(bins: DataFrame, entity: str, columns: Sequence[str], buckets: int = 3) -> DataFrame:
    """For every bin of a dense grid each column in the bins before it (``c_b0`` the last), their change and recent share.

    ``c_delta`` is the last bin minus the oldest, ``c_ratio`` the last over all plus one.
    """
    w = Window.partitionBy(entity).orderBy("bin")
    out = bins
    for c in columns:
        parts = [F.coalesce(F.lag(c, k + 1).over(w), F.lit(0)) for k in range(buckets)]
        total = sum(parts[1:], parts[0])
        out = out.withColumns({**{f"{c}_b{k}": p for k, p in enumerate(parts)}, f"{c}_delta": parts[0] - parts[-1], f"{c}_ratio": parts[0] / (total + 1)})
    return out


def acceleration(bins: DataFrame, entity: str, column: str, width: int) -> DataFrame:
    """``column`` over its mean of the last ``width`` bins, 0 where that mean is 0."""
    w = Window.partitionBy(entity).orderBy("bin").rowsBetween(1 - width, 0)
    return bins.withColumn(f"{column}_accel", F.coalesce(F.try_divide(F.col(column), F.nullif(F.avg(column).over(w), F.lit(0.0))), F.lit(0.0)))


def chronological_split(df: DataFrame, ts: str, bounds: Sequence[tuple[str, str]], rest: str) -> DataFrame:
    """``split``: the name of the first bound (name, end exclusive) that lies after the time, else ``rest``."""
    expr = F.lit(rest)
    for name, end in reversed(bounds):
        expr = F.when(F.col(ts) < F.expr(f"timestamp_ntz'{end}'"), name).otherwise(expr)
    return df.withColumn("split", F.when(F.col(ts).isNotNull(), expr))


def rolling_origins(df: DataFrame, ts: str, origins: Sequence[str], test: str) -> DataFrame:
    """Each row once per origin it belongs to: 'train' before the origin, 'test' within ``test`` (an interval) after it."""
    o = F.explode(F.array(*[F.expr(f"timestamp_ntz'{x}'") for x in origins])).alias("origin")
    out = df.select("*", o)
    end = F.col("origin") + F.expr(f"INTERVAL {test}")
    return out.withColumn("split", F.when(F.col(ts) < F.col("origin"), "train").when(F.col(ts) < end, "test")).where("split IS NOT NULL")
