"""Queries of problem 7: records paired by nearest time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.functions.text import folded, plain_key
from lavra.llm.nearest import nearest
from lavra.sources import read_table


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The maintenance nearest to each row with is_dont_go = 1, at most 900 seconds away."""
    tel = read_table(spark, folder, "tel").where("is_dont_go = 1")
    ap = read_table(spark, folder, "apontamentos").where(folded("classe") == "manutencao")
    out = nearest(tel, ap, entity=(plain_key("tag"), plain_key("tag")), ts=(F.col("data_evento"), F.col("inicio")), ids=(F.col("id_eventos_telemetria"), F.col("id")))
    return out.select(F.col("left_id").alias("id_eventos_telemetria"), F.col("right_id").alias("id_apontamento"))


QUERIES = {"p7_found": p7_found}
SQL = {
    "p7_found": """
WITH l AS (SELECT id_eventos_telemetria AS lid, upper(regexp_replace(tag, '[^\\p{L}\\p{N}]', '', 'g')) AS tag, data_evento AS ts FROM tel WHERE is_dont_go = 1),
r AS (SELECT id AS rid, upper(regexp_replace(tag, '[^\\p{L}\\p{N}]', '', 'g')) AS tag, inicio AS ts FROM apontamentos
  WHERE inicio IS NOT NULL AND lower(strip_accents(trim(classe))) = 'manutencao')
SELECT lid AS id_eventos_telemetria, arg_min(rid, (abs(date_diff('microsecond', l.ts, r.ts)), r.ts, rid)) AS id_apontamento
FROM l JOIN r ON l.tag = r.tag AND l.tag <> '' AND abs(date_diff('microsecond', l.ts, r.ts)) <= 900000000 GROUP BY 1"""
}
