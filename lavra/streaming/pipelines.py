"""Structured Streaming forms of duplicate removal, windows, sessions and enrichment.

Each takes a streaming DataFrame and gives one; the batch operators state the same results on a closed table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lavra.session import own_folder
from lavra.sources import read_table

LATE = "14 days"


def read_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table as a stream of its files, be it one file or a folder of files."""
    schema = read_table(spark, folder, name).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    single = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if single else reader.parquet(f"{folder}/{name}.parquet")


def _timed(stream: DataFrame, ts: str, late: str) -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def deduplicated(stream: DataFrame, ts: str, keys: Sequence[str], late: str = LATE) -> DataFrame:
    """The first of each key within the time lateness is borne; state is dropped behind the watermark."""
    return _timed(stream, ts, late).dropDuplicatesWithinWatermark(list(keys))


def windowed(stream: DataFrame, ts: str, keys: Sequence[str], size: str, slide: str | None, aggregates: dict[str, Column], late: str = LATE) -> DataFrame:
    """Aggregates (by name) over tumbling or sliding windows."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return _timed(stream, ts, late).groupBy(*keys, w.alias("w")).agg(*[a.alias(n) for n, a in aggregates.items()]).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *aggregates)


def sessions(stream: DataFrame, ts: str, keys: Sequence[str], gap: str, late: str = LATE) -> DataFrame:
    """Runs cut where more than ``gap`` passes; a session window ends ``gap`` after its last row."""
    w = F.session_window(ts, gap)
    out = _timed(stream, ts, late).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    return out.select(*keys, "first", "last", "n")


def enriched(stream: DataFrame, intervals: DataFrame, entity: str, ts: str, start: str, end: str, take: Sequence[str], bucket_s: int = 86_400) -> DataFrame:
    """A stream-static join of events with the intervals that hold them, by entity and day."""
    us = F.lit(bucket_s * 1_000_000)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    sound = intervals.where(F.col(end) > F.col(start)).select(F.col(entity).alias("_e"), F.col(start).alias("_s"), F.col(end).alias("_f"), *take)
    right = sound.withColumn("_b", F.explode(F.sequence(F.floor(micros("_s") / us), F.floor((micros("_f") - 1) / us))))
    left = stream.withColumn("_at", F.floor(micros(ts) / us))
    on = (F.col(entity) == F.col("_e")) & (F.col("_at") == F.col("_b")) & (F.col(ts) >= F.col("_s")) & (F.col(ts) < F.col("_f"))
    return left.join(right, on, "left").drop("_e", "_s", "_f", "_b", "_at")


def _sink(base: str, transform: Callable[[DataFrame], DataFrame] | None) -> Callable[[DataFrame, int], None]:
    """Writes every batch to a folder of its own, named by its number: a batch that is tried again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        out = transform(batch) if transform else batch
        out.withColumn("_lv_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{base}/out/{number:012d}")

    return write


def _run(stream: DataFrame, base: str, mode: str, transform: Callable[[DataFrame], DataFrame] | None) -> None:
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(_sink(base, transform)).start()
    q.awaitTermination()


def _written(stream: DataFrame, base: str) -> DataFrame:
    """All batches, with their numbers."""
    schema = StructType([*stream.schema.fields, StructField("_lv_batch", LongType())])
    at = stream.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{base}/out")
    at.getFileSystem(stream.sparkSession._jsc.hadoopConfiguration()).mkdirs(at)
    return stream.sparkSession.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{base}/out")


def run_available(stream: DataFrame, name: str, mode: str = "append", transform: Callable[[DataFrame], DataFrame] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Process what is there now and give the written result as a table in the shared folder.

    In update mode batches hold the rows that changed, and the last of each of ``keys`` counts; state is dropped behind
    the watermark. In complete mode the last batch counts (all state is kept), else all batches add up. ``transform`` keeps
    the columns.
    """
    base = own_folder(stream.sparkSession, f"stream-{name}")
    _run(stream, base, mode, transform)
    out = _written(stream, base)
    if mode == "update":
        rest = [c for c in stream.columns if c not in keys]
        last = F.max_by(F.struct(*rest), "_lv_batch").alias("_lv_last")
        return out.groupBy(*keys).agg(last).select(*[F.col(c) if c in keys else F.col(f"_lv_last.{c}").alias(c) for c in stream.columns])
    if mode == "complete":
        number = out.agg(F.max("_lv_batch")).first()[0]
        out = out.where(F.col("_lv_batch") == (-1 if number is None else number))
    return out.drop("_lv_batch")


def run_closed(source: DataFrame, ts: str, name: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``build`` of a stream that ends: what is there now in append mode, then one row beyond all time, which moves the
    watermark past every window still open. State is dropped as the watermark passes, also while the stream runs.

    The closing row has nulls in all other columns; its own window stays open and is never written.
    """
    spark = source.sparkSession
    base = own_folder(spark, f"stream-{name}")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/closing")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    schema = StructType([StructField(f.name, f.dataType) for f in source.schema.fields])
    stream = build(source.unionByName(spark.readStream.schema(schema).parquet(f"{base}/closing")))
    _run(stream, base, "append", None)
    end = F.expr("timestamp_ntz'9999-01-01 00:00:00'")
    closing = spark.range(1).select(*[(end if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
    closing.coalesce(1).write.mode("append").parquet(f"{base}/closing")
    _run(stream, base, "append", None)
    return _written(stream, base).drop("_lv_batch")
