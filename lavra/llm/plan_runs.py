"""Queries of problem 5: repeated consecutive events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.functions.text import plain_key
from lavra.llm.runs import collapse_runs
from lavra.sources import read_table


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    tel = read_table(spark, folder, "tel")
    return collapse_runs(tel, plain_key("tag"), F.col("data_evento"), F.col("id_alarme"), F.col("id_eventos_telemetria"))


def p5_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every run, single events included, with its number of events and duration."""
    return _runs(spark, folder).select(F.col("entity").alias("tag"), F.col("kind").alias("id_alarme"), "inicio", "fim", "n", F.round("duration_s", 6).alias("duracao_s"), F.col("id_min").alias("id_menor"), F.col("id_max").alias("id_maior"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of at least three events."""
    return _runs(spark, folder).where("n >= 3").select(F.col("id_min").alias("id_menor"), F.col("id_max").alias("id_maior"))


QUERIES = {"p5_runs": p5_runs, "p5_found": p5_found}

_RUNS = """
WITH e AS (
  SELECT nullif(upper(regexp_replace(tag, '[^\\p{L}\\p{N}]', '', 'g')), '') AS tag, data_evento AS ts, id_alarme AS a, min(id_eventos_telemetria) AS id
  FROM tel GROUP BY 1, 2, 3 HAVING tag IS NOT NULL AND ts IS NOT NULL AND a IS NOT NULL),
f AS (SELECT *, CASE WHEN a = lag(a) OVER w AND date_diff('microsecond', lag(ts) OVER w, ts) <= 900000000 THEN 0 ELSE 1 END AS s
  FROM e WINDOW w AS (PARTITION BY tag ORDER BY ts, id)),
g AS (SELECT *, sum(s) OVER (PARTITION BY tag ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS run FROM f),
r AS (SELECT tag, run, min(a) AS a, min(ts) AS inicio, max(ts) AS fim, count(*) AS n, min(id) AS id_menor, max(id) AS id_maior FROM g GROUP BY 1, 2)
"""
SQL = {
    "p5_runs": _RUNS + "SELECT tag, a AS id_alarme, inicio, fim, n, round(date_diff('microsecond', inicio, fim) / 1e6, 6) AS duracao_s, id_menor, id_maior FROM r",
    "p5_found": _RUNS + "SELECT id_menor, id_maior FROM r WHERE n >= 3",
}
