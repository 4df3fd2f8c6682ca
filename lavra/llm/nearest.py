"""Pairs of nearest time: each left row with the right row of the same entity nearest to it, within a tolerance.

Both tables are cut into tiles of entity and time; right rows are also laid into the neighbouring tile they can reach
by the tolerance, so a tile answers for its left rows alone. Tiles are hash-partitioned into Arrow groups. Inside each
group DuckDB runs one backward and one forward ASOF join by entity and tile, and the nearer of both candidates within the
tolerance is kept.

A tile that holds more than ``tile_rows`` left rows is dealt out in salts, its right rows repeated to each; such tiles
are at most 1 / tile_rows of the left rows. The tiles are made as short as the fullest tile of right rows needs to stay
within ``tile_rows`` (twice the tolerance is the least), and there are as many groups as it takes for a group to hold
about ``GROUP_ROWS``; both are counted first. Right rows of one entity and time are reduced to the first by ``right_id``
before they are shuffled: no other of them can be an answer.

Exactly the tolerance counts. If two are equally near, the earlier time wins, then the smaller id. Rows with a null
entity, time or id have no partner and are none. Left rows without a partner in reach give no row. Repeated left rows get
their partner each. Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.functions.time import micros

TILE_SECONDS = 24 * 3600
TILE_ROWS = 100_000
GROUP_ROWS = 500_000

_ASOF = """
WITH back AS (SELECT l.id AS left_id, r.id AS right_id, r.us AS us, l.us - r.us AS off
              FROM l ASOF JOIN r ON l.tile = r.tile AND l.us >= r.us),
     ahead AS (SELECT l.id AS left_id, r.id AS right_id, r.us AS us, r.us - l.us AS off
               FROM l ASOF JOIN r ON l.tile = r.tile AND l.us <= r.us),
     near AS (SELECT * FROM back UNION ALL SELECT * FROM ahead)
SELECT left_id, arg_min(right_id, (off, us, right_id)) AS right_id, min(off) AS off_us
FROM near WHERE off <= {tolerance} GROUP BY left_id
"""


def _matcher(tolerance_us: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    schema = pa.schema([("left_id", pa.int64()), ("right_id", pa.int64()), ("off_us", pa.int64())])

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        import duckdb

        # Groups are small by construction, so nothing needs to spill to a folder of the machine.
        with duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""}) as con:
            con.register("l", left)
            con.register("r", right)
            done = con.execute(_ASOF.format(tolerance=tolerance_us))
            out = done.to_arrow_table() if hasattr(done, "to_arrow_table") else done.fetch_arrow_table()
        return out.cast(schema)

    return match


def nearest(
    left: DataFrame, right: DataFrame, *, entity: tuple[Column, Column], ts: tuple[Column, Column], ids: tuple[Column, Column],
    tolerance_s: int = 900, tile_s: int = TILE_SECONDS, tile_rows: int = TILE_ROWS, groups: int | None = None,
) -> DataFrame:
    """(left_id, right_id, off_us): the nearest right row of each left row; left ids are unique. Pairs of columns are (left, right)."""
    spark = left.sparkSession
    tolerance = tolerance_s * 1_000_000
    lt = left.select(entity[0].alias("entity"), micros(ts[0]).alias("us"), ids[0].cast("long").alias("id")).na.drop()
    rt = right.select(entity[1].alias("entity"), micros(ts[1]).alias("us"), ids[1].cast("long").alias("id")).na.drop()
    rt = rt.groupBy("entity", "us").agg(F.min("id").alias("id"))
    per = rt.groupBy("entity", F.floor(F.col("us") / F.lit(tile_s * 1_000_000)).alias("at")).agg(F.count("*").alias("n"))
    most, right_rows = per.agg(F.max("n"), F.sum("n")).first()
    tile_us = max(tile_s * 1_000_000 * tile_rows // max(tile_rows, most or 0), 2 * tolerance)
    groups = groups or max(4, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), (lt.count() + 2 * (right_rows or 0)) // GROUP_ROWS)
    lt = lt.withColumn("at", F.floor(F.col("us") / F.lit(tile_us)))
    reach = F.array_distinct(F.array(*[F.floor((F.col("us") + d) / F.lit(tile_us)) for d in (-tolerance, 0, tolerance)]))
    rt = rt.withColumn("at", F.explode(reach))
    full = lt.groupBy("entity", "at").agg(F.ceil(F.count("*") / F.lit(tile_rows)).cast("int").alias("salts")).where("salts > 1")
    lt = lt.join(full, ["entity", "at"], "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))))
    rt = rt.join(full, ["entity", "at"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), (F.coalesce("salts", F.lit(1)) - 1).cast("long"))))
    tile = F.concat_ws("|", F.col("at").cast("string"), F.col("salt").cast("string"), "entity")
    group = F.pmod(F.xxhash64("tile"), F.lit(groups)).cast("int")
    lt = lt.select("us", "id", tile.alias("tile")).withColumn("g", group)
    rt = rt.select("us", "id", tile.alias("tile")).withColumn("g", group)
    pairs = lt.groupBy("g").cogroup(rt.groupBy("g"))
    return pairs.applyInArrow(_matcher(tolerance), "left_id long, right_id long, off_us long")
