"""Rolling totals over trailing periods, kept as versioned daily state.

A version of the state holds one row per entity and day, from the entity's first to its last event day, days without
rows included: the day's own rows and amount, and for each period the rows and amount of the days it trails. The next
version is made from the last one and a batch of arrivals. An affected day's total is

    yesterday's total + today's amount - the amount of the day that leaves the period

so a batch joins three things: the carried state of the day before an island of affected days, the batch's daily amounts,
and the amounts of the expiring days. Affected are the days whose periods reach back to an arrival, and days the entity
didn't have yet; they are merged to islands, and days between two islands stay as they are, however far a late arrival
(a correction of a past day) reaches back.

:class:`RollingStore` keeps the state in a folder between runs, in parts of a few days. An advance reads the parts
that islands and their expiring days touch, and writes those that hold affected days; a small table has each entity's
first and last day. The list of parts is written last, so a version is there whole or not at all, and one that was broken
off is simply made again.

Nulls: rows without entity or timestamp belong to no day and are left out; a null amount counts as 0. Empty input gives
an empty state. Repeated rows count each. Extra columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lavra.session import own_folder, staged

PERIODS = (7, 30)


def daily_amounts(df: DataFrame, entity: Column, ts: Column, amount: Column, batch: Column | None = None) -> DataFrame:
    """(batch, entity, day, n_rows, amount): the only pass over the events, combined before its shuffle."""
    rows = df.select(
        (F.lit(0) if batch is None else batch).cast("int").alias("batch"),
        entity.alias("entity"),
        F.to_date(ts).alias("day"),
        F.coalesce(amount, F.lit(0)).cast("long").alias("amount"),
    ).where("entity IS NOT NULL AND day IS NOT NULL")
    return rows.groupBy("batch", "entity", "day").agg(F.count("*").alias("n_rows"), F.sum("amount").alias("amount"))


def empty_state(df: DataFrame, periods: Sequence[int] = PERIODS) -> DataFrame:
    """Version 0 with the column types of ``df`` (a result of :func:`daily_amounts`)."""
    cols = [F.col("entity"), F.col("day"), "n_rows", "amount"]
    cols += [F.lit(0).cast("long").alias(f"{what}_{p}") for p in periods for what in ("rows", "total")]
    return df.where("false").select(*cols, F.lit(0).alias("version"))


def _totals(periods: Sequence[int]) -> list[str]:
    return [f"{what}_{p}" for p in periods for what in ("rows", "total")]


def spans_of(state: DataFrame) -> DataFrame:
    """(entity, first, last): the days of every entity."""
    return state.groupBy("entity").agg(F.min("day").alias("first"), F.max("day").alias("last"))


def _in_order(arrivals: DataFrame, spans: DataFrame, *more: DataFrame) -> DataFrame:
    """Arrivals (kind 1) and ``more`` rows, each with the entity's known ``first`` and ``last`` day and, for arrivals, ``gap``:
    the days between them and the next known day or arrival that the entity didn't have. One exchange, by entity."""
    rows = arrivals.withColumn("kind", F.lit(1))
    for m in (*more, spans.withColumn("kind", F.lit(2))):
        rows = rows.unionByName(m, allowMissingColumns=True)
    every = Window.partitionBy("entity")
    rows = rows.repartition("entity").withColumns({"first": F.min("first").over(every), "last": F.max("last").over(every)}).where("kind < 2")
    w = Window.partitionBy("entity", "kind").orderBy("day")
    rows = rows.withColumns({"before": F.lag("day").over(w), "after": F.lead("day").over(w), "top": F.max("day").over(Window.partitionBy("entity", "kind"))})
    known = F.greatest("before", "last")
    late, early = F.col("last").isNull() | (F.col("day") > F.col("last")), F.col("day") < F.col("first")
    lo = F.when(late, F.date_add(known, 1)).when(early, F.date_add("day", 1))
    hi = F.when(late, F.date_sub("day", 1)).when(early, F.date_sub(F.least("after", "first"), 1))
    gap = F.when((F.col("kind") == 1) & (lo <= hi), F.struct(lo.alias("lo"), hi.alias("hi")))
    return rows.withColumn("gap", gap)


def advance(state: DataFrame, arrivals: DataFrame, version: int, periods: Sequence[int] = PERIODS, spans: DataFrame | None = None) -> DataFrame:
    """The next version of ``state`` after ``arrivals`` (entity, day, n_rows, amount; any days, past ones too).

    ``state`` may be a part of the whole, if it has all days from the longest period before an affected day to that day;
    then ``spans`` has each entity's first and last day. Both inputs are at the grain of entity and day, so windows run
    over days, never over events, and all of them in one exchange by entity.
    """
    totals, longest = _totals(periods), max(periods)
    own = state.select("entity", "day", "n_rows", "amount", *totals, "version", F.lit(0).alias("kind"))
    rows = _in_order(arrivals.select("entity", "day", "n_rows", "amount"), spans_of(state) if spans is None else spans, own)
    none = F.array().cast("array<date>")
    rows = rows.withColumn("d", F.explode(F.concat(F.array("day"), F.coalesce(F.sequence("gap.lo", "gap.hi"), none))))
    itself = F.col("d") == F.col("day")
    days = rows.groupBy("entity", F.col("d").alias("day")).agg(
        F.sum(F.when(itself, F.col("n_rows")).otherwise(0)).alias("n_rows"),
        F.sum(F.when(itself, F.col("amount")).otherwise(0)).alias("amount"),
        *[F.max(c).alias(c) for c in totals],
        F.max("version").alias("version"),
        F.max(itself & (F.col("kind") == 1)).alias("arrived"),
        F.max(F.col("kind") == 0).alias("known"),
    )
    days = days.withColumn("x", F.unix_date("day"))
    w = Window.partitionBy("entity").orderBy("x")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    reached = F.col("x") - F.last(F.when(F.col("arrived"), F.col("x")), ignorenulls=True).over(running) < longest
    days = days.withColumn("affected", ~F.col("known") | F.coalesce(reached, F.lit(False)))
    days = days.withColumn("next_to", F.coalesce(F.lag("x").over(w) == F.col("x") - 1, F.lit(False)))
    starts = F.col("affected") & ~(F.col("next_to") & F.coalesce(F.lag("affected").over(w), F.lit(False)))
    zero = F.lit(0).cast("long")
    moves = {}
    for p in periods:
        leaving = w.rangeBetween(-p, -p)
        for what, amount in (("rows", "n_rows"), ("total", "amount")):
            moves[f"{what}_{p}_move"] = F.col(amount) - F.coalesce(F.sum(amount).over(leaving), zero)
    carried = {f"{c}_carried": F.when(F.col("next_to"), F.coalesce(F.lag(c).over(w), zero)).otherwise(zero) for c in totals}
    days = days.withColumns({"starts": starts, **moves, **carried}).withColumn("island", F.sum(F.col("starts").cast("int")).over(running))
    # Yesterday's total stands before the island; from there on what comes in and what leaves add up.
    within = Window.partitionBy("entity", "island").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    fresh = {c: F.sum(F.when(F.col("starts"), F.col(f"{c}_carried")).otherwise(0) + F.col(f"{c}_move")).over(within) for c in totals}
    return days.select(
        "entity", "day", "n_rows", "amount",
        *[F.when(F.col("affected"), f).otherwise(F.col(c)).alias(c) for c, f in fresh.items()],
        F.when(F.col("affected"), F.lit(version)).otherwise(F.col("version")).alias("version"),
    )


class RollingStore:
    """The state in a folder, carried from run to run: load, advance, store.

    ``<path>/data/written=<version>/part=<n>`` holds the part of days ``n * days_per_part`` on, as that version wrote it;
    ``<path>/spans/<version>`` each entity's first and last day; ``<path>/versions/<version>.json`` says which version
    wrote each part. Older versions stay readable until :meth:`forget` deletes what the last one doesn't use.
    """

    def __init__(self, spark: SparkSession, path: str, periods: Sequence[int] = PERIODS, days_per_part: int = 8) -> None:
        self.spark, self.path, self.periods, self.days_per_part = spark, path.rstrip("/"), tuple(periods), days_per_part
        jvm = spark._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils
        folder = self._at(f"{self.path}/versions")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        self.version = max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)
        self.parts: dict[int, int] = {}
        if self.version:
            with_list = self._fs.open(self._at(f"{self.path}/versions/{self.version}.json"))
            said = json.loads(self._io.toString(with_list, "UTF-8"))
            with_list.close()
            self.parts, self.days_per_part = {int(k): v for k, v in said["parts"].items()}, said["days_per_part"]

    def load(self, like: DataFrame, parts: set[int] | None = None) -> DataFrame:
        """The state as it is, or those parts of it; ``like`` has the columns of :func:`daily_amounts`."""
        empty = empty_state(like, self.periods)
        columns = empty.columns
        paths = [f"{self.path}/data/written={v}/part={p}" for p, v in self.parts.items() if parts is None or p in parts]
        if not paths:
            return empty
        reader = self.spark.read.schema(empty.schema.add("written", "integer").add("part", "integer")).option("basePath", f"{self.path}/data")
        return reader.parquet(*paths).select(*columns)

    def advance(self, arrivals: DataFrame) -> int:
        """Store the version after ``arrivals`` (entity, day, n_rows, amount) and give its number.

        What is collected are the numbers of touched parts, at most one for every ``days_per_part`` days of history.
        """
        longest, version = max(self.periods), self.version + 1
        old = arrivals.select("entity", F.col("day").alias("first"), F.col("day").alias("last"))
        spans = self.spark.read.schema(old.schema).parquet(f"{self.path}/spans/{self.version}") if self.version else old.where("false")
        part = lambda d: F.floor(F.unix_date(d) / F.lit(self.days_per_part)).cast("int")
        hit = _in_order(arrivals.select("entity", "day"), spans)
        reach = F.struct(F.col("day").alias("lo"), F.least(F.date_add("day", longest - 1), F.greatest("top", "last")).alias("hi"))
        hit = hit.select(F.explode(F.filter(F.array(reach, "gap"), lambda g: g.isNotNull())).alias("g"))
        first, last = part("g.lo"), part("g.hi")
        parts = hit.select(F.explode(F.sequence(part(F.date_sub("g.lo", longest)), last)).alias("p"), first.alias("first")).groupBy("p").agg(F.max(F.col("p") >= F.col("first")).alias("own"))
        wanted = {r["p"]: r["own"] for r in parts.collect()}
        own = {p for p, touched in wanted.items() if touched}
        rows = advance(self.load(arrivals, set(wanted)), arrivals, version, self.periods, spans).withColumn("part", part("day"))
        if own:
            rows.where(F.col("part").isin(sorted(own))).hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/data/written={version}")
        spans.unionByName(old).groupBy("entity").agg(F.min("first").alias("first"), F.max("last").alias("last")).write.mode("overwrite").parquet(f"{self.path}/spans/{version}")
        self.parts |= dict.fromkeys(own, version)
        said = json.dumps({"days_per_part": self.days_per_part, "parts": self.parts})
        draft, final = self._at(f"{self.path}/versions/.{uuid.uuid4().hex}"), self._at(f"{self.path}/versions/{version}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(said.encode()))
        out.close()
        if not self._fs.rename(draft, final):
            raise RuntimeError(f"version {version} of {self.path} was stored by another run")
        self.version = version
        return version

    def forget(self) -> None:
        """Delete the parts and tables of older versions that the last one doesn't use."""
        for v in range(1, self.version):
            for p in self._fs.listStatus(self._at(f"{self.path}/data/written={v}")) if self._fs.exists(self._at(f"{self.path}/data/written={v}")) else []:
                name = p.getPath().getName()
                if name.startswith("part=") and self.parts.get(int(name[5:])) != v:
                    self._fs.delete(p.getPath(), True)
            self._fs.delete(self._at(f"{self.path}/spans/{v}"), True)
            self._fs.delete(self._at(f"{self.path}/versions/{v}.json"), False)


def rolling_totals(df: DataFrame, entity: Column, ts: Column, amount: Column, arrival: Column | None = None, batches: int = 1, periods: Sequence[int] = PERIODS) -> DataFrame:
    """The state after all of ``df``, in ``batches`` versions by equal ranges of ``arrival`` (a whole number that grows with arrival).

    The versions go through a :class:`RollingStore` in the shared folder, each made from the one before it.
    """
    batch = None
    if arrival is not None and batches > 1:
        lo, hi = df.agg(F.min(arrival), F.max(arrival)).first()
        if lo is not None:
            width = (hi - lo) // batches + 1
            batch = F.coalesce(F.floor((arrival - F.lit(lo)) / F.lit(width)), F.lit(0))
    daily = staged(daily_amounts(df, entity, ts, amount, batch), "rolling-daily")
    store = RollingStore(df.sparkSession, own_folder(df.sparkSession, "rolling-state"), periods)
    for k in range(batches if batch is not None else 1):
        store.advance(daily.where(F.col("batch") == k))
    return store.load(daily)


def averages(state: DataFrame, periods: Sequence[int] = PERIODS) -> DataFrame:
    """The state with the daily average of every period beside its total."""
    return state.withColumns({f"avg_{p}": F.col(f"total_{p}") / F.lit(p) for p in periods})


def silent_after_flag(state: DataFrame, period: int = 7, within: int = 14) -> DataFrame:
    """Days without any row whose trailing ``period`` holds an amount and whose next row comes in ``within`` days."""
    w = Window.partitionBy("entity").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.last(F.when(F.col("n_rows") > 0, F.col("day")), ignorenulls=True).over(w)
    return state.withColumn("next_day", ahead).where((F.col("n_rows") == 0) & (F.col(f"total_{period}") >= 1) & (F.datediff("next_day", "day") <= within)).select("entity", "day")
