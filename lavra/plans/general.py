"""Queries of the general training-data problems 1 to 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.functions.text import folded, plain_key
from lavra.operators import features, rolling, skew
from lavra.sources import read_table

PLAIN = "nullif(upper(regexp_replace(tag, '[^\\p{L}\\p{N}]', '', 'g')), '')"


def _rolling(spark: SparkSession, folder: str) -> DataFrame:
    tel = read_table(spark, folder, "tel")
    flag = F.when(F.col("is_dont_go") == 1, 1).otherwise(0)
    return rolling.rolling_totals(tel, plain_key("tag"), F.col("data_evento"), flag, F.col("id_eventos_telemetria"), batches=3)


def p1_rolling(spark: SparkSession, folder: str) -> DataFrame:
    """Totals and daily averages of is_dont_go = 1 over the trailing 7 and 30 days of every equipment and day."""
    s = rolling.averages(_rolling(spark, folder))
    return s.select(
        F.col("entity").alias("tag"), F.date_format("day", "yyyy-MM-dd").alias("dia"), F.col("n_rows").alias("linhas"), F.col("amount").alias("dont_go"),
        "total_7", "total_30", F.round("avg_7", 6).alias("avg_7"), F.round("avg_30", 6).alias("avg_30"),
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    s = rolling.silent_after_flag(_rolling(spark, folder))
    return s.select(F.col("entity").alias("tag"), F.date_format("day", "yyyy-MM-dd").alias("dia"))


_P1 = f"""
WITH d AS (
  SELECT {PLAIN} AS tag, CAST(data_evento AS DATE) AS day, count(*) AS linhas,
         count(*) FILTER (WHERE is_dont_go = 1) AS dont_go
  FROM tel GROUP BY 1, 2 HAVING tag IS NOT NULL AND day IS NOT NULL),
span AS (SELECT tag, min(day) AS lo, max(day) AS hi FROM d GROUP BY 1),
g AS (SELECT tag, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
f AS (SELECT tag, day, coalesce(linhas, 0) AS linhas, coalesce(dont_go, 0) AS dont_go FROM g LEFT JOIN d USING (tag, day)),
r AS (
  SELECT *, sum(dont_go) OVER (PARTITION BY tag ORDER BY day ROWS 6 PRECEDING) AS total_7,
         sum(dont_go) OVER (PARTITION BY tag ORDER BY day ROWS 29 PRECEDING) AS total_30,
         min(CASE WHEN linhas > 0 THEN day END) OVER (PARTITION BY tag ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt
  FROM f)
"""


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    tel = read_table(spark, folder, "tel")
    counts = skew.chunked_counts(tel.select(plain_key("tag").alias("tag"), "id_alarme"), ["tag", "id_alarme"])
    broken = F.raise_error(F.lit("a row number of a key is missing or occurs twice; the table changed while it was read")).cast("long")
    return counts.withColumn("n", F.when(F.col("whole"), F.col("n")).otherwise(broken))


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The complete count of every (tag, id_alarme), from equal-sized chunks."""
    return _pairs(spark, folder).select("tag", "id_alarme", "n")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs with at least 5 of every 1,000 rows."""
    total = read_table(spark, folder, "tel").count()  # from the files' footers
    enough = F.col("n") * 1000 >= F.lit(total * 5)
    return _pairs(spark, folder).where(enough & F.col("tag").isNotNull() & F.col("id_alarme").isNotNull()).select("tag", "id_alarme")


def p3_features(spark: SparkSession, folder: str) -> DataFrame:
    """One row per equipment: count of the last 30 days, seconds since the last event and total of every alarm and criticality."""
    tel = read_table(spark, folder, "tel")
    events = tel.select(plain_key("tag").alias("entity"), F.col("data_evento").alias("ts"), F.col("id_alarme").alias("alarme"), folded("criticidade").alias("criticidade"))
    return features.entity_features(events, ["alarme", "criticidade"]).withColumnRenamed("entity", "tag")


QUERIES = {"p1_rolling": p1_rolling, "p1_found": p1_found, "p2_counts": p2_counts, "p2_found": p2_found, "p3_features": p3_features}
SQL = {
    "p1_rolling": _P1 + """
SELECT tag, strftime(day, '%Y-%m-%d') AS dia, CAST(linhas AS BIGINT) AS linhas, CAST(dont_go AS BIGINT) AS dont_go,
       CAST(total_7 AS BIGINT) AS total_7, CAST(total_30 AS BIGINT) AS total_30,
       round(total_7 / 7.0::DOUBLE, 6) AS avg_7, round(total_30 / 30.0::DOUBLE, 6) AS avg_30 FROM r""",
    "p1_found": _P1 + "SELECT tag, strftime(day, '%Y-%m-%d') AS dia FROM r WHERE linhas = 0 AND total_7 >= 1 AND date_diff('day', day, nxt) <= 14",
    "p2_counts": f"SELECT {PLAIN} AS tag, id_alarme, count(*) AS n FROM tel GROUP BY 1, 2",
    "p2_found": f"""
SELECT {PLAIN} AS tag, id_alarme FROM tel GROUP BY 1, 2
HAVING count(*) * 1000 >= 5 * (SELECT count(*) FROM tel) AND {PLAIN} IS NOT NULL AND id_alarme IS NOT NULL""",
    "p3_features": f"""
WITH e AS (SELECT {PLAIN} AS tag, data_evento AS ts, id_alarme AS a, lower(strip_accents(trim(criticidade))) AS c FROM tel),
v AS (SELECT * FROM e WHERE tag IS NOT NULL AND ts IS NOT NULL), l AS (SELECT max(ts) AS ts FROM v),
ta AS (SELECT DISTINCT a FROM e WHERE a IS NOT NULL), tc AS (SELECT DISTINCT c FROM e WHERE c IS NOT NULL),
n AS (SELECT DISTINCT tag FROM v),
sa AS (SELECT tag, a, count(*) AS n, count(*) FILTER (WHERE v.ts > l.ts - INTERVAL 30 DAY) AS r, max(v.ts) AS m FROM v, l GROUP BY 1, 2),
sc AS (SELECT tag, c, count(*) AS n, count(*) FILTER (WHERE v.ts > l.ts - INTERVAL 30 DAY) AS r, max(v.ts) AS m FROM v, l GROUP BY 1, 2),
ga AS (SELECT n.tag, list(ta.a ORDER BY ta.a) AS alarme_ids, list(coalesce(sa.r, 0) ORDER BY ta.a) AS alarme_count,
  list(date_diff('microsecond', sa.m, l.ts) / 1e6 ORDER BY ta.a) AS alarme_recency_s, list(coalesce(sa.n, 0) ORDER BY ta.a) AS alarme_total
  FROM n CROSS JOIN ta CROSS JOIN l LEFT JOIN sa ON sa.tag = n.tag AND sa.a = ta.a GROUP BY 1),
gc AS (SELECT n.tag, list(tc.c ORDER BY tc.c) AS criticidade_ids, list(coalesce(sc.r, 0) ORDER BY tc.c) AS criticidade_count,
  list(date_diff('microsecond', sc.m, l.ts) / 1e6 ORDER BY tc.c) AS criticidade_recency_s, list(coalesce(sc.n, 0) ORDER BY tc.c) AS criticidade_total
  FROM n CROSS JOIN tc CROSS JOIN l LEFT JOIN sc ON sc.tag = n.tag AND sc.c = tc.c GROUP BY 1)
SELECT * FROM ga JOIN gc USING (tag)""",
}
