"""Queries of problem 4: copies hidden by formatting differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.functions.time import micros
from lavra.llm import copies
from lavra.sources import read_table

FIELDS = copies.Fields(("Id_Eventos_Telemetria", "Data_Evento", "TAG", "Id_Alarme", "Valor", "Classe", "Operador"), signed=("Valor",))


def _tel(spark: SparkSession, folder: str) -> DataFrame:
    tel = read_table(spark, folder, "tel")
    prints = copies.keyed_prints(tel, F.col("id_eventos_telemetria"), [micros("data_evento"), F.col("id_alarme")], F.col("tag"))
    return copies.copies(prints, copies.same_folded)


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    return copies.copies(copies.record_prints(read_table(spark, folder, "tel_raw"), "raw_id", "registro", FIELDS), FIELDS.same)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each surplus copy in tel and tel_raw."""
    both = _tel(spark, folder).withColumn("tabela", F.lit("tel")).unionByName(_raw(spark, folder).withColumn("tabela", F.lit("tel_raw")))
    return both.select("tabela", F.col("lead").alias("id_menor"), F.col("id").alias("id_copia"))


def p4_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of tel_raw once, under its smallest raw_id, with its number of copies (a record in itself counts 1).

    Records without all fields stand for themselves.
    """
    found = _raw(spark, folder)
    sizes = found.groupBy("lead").agg((F.count("*") + 1).alias("n"))
    rows = read_table(spark, folder, "tel_raw").select(F.col("raw_id").alias("id"))
    once = rows.join(found.select("id"), "id", "left_anti")
    return once.join(sizes, once["id"] == sizes["lead"], "left").select(F.col("id").alias("raw_id"), F.coalesce("n", F.lit(1)).cast("long").alias("copias"))


QUERIES = {"p4_found": p4_found, "p4_records": p4_records}

_FIELD = "lower(regexp_replace(regexp_extract(registro, '(?i)(^|[^a-z0-9])({label})[\\s\"'']*[:=](.*?)({all})', 3, 's'), '[^\\p{{L}}\\p{{N}}]', '', 'g'))"
_LABELS = ["id[\\W_]*eventos[\\W_]*telemetria", "data[\\W_]*evento", "tag", "id[\\W_]*alarme", "valor", "classe", "operador"]
_ALL = "[^a-zA-Z0-9](" + "|".join(_LABELS) + ")[\\s\"'']*[:=]|$"
_VALUES = ", ".join(_FIELD.format(label=x, all=_ALL) + f" AS f{i}" for i, x in enumerate(_LABELS))
_HAS = " AND ".join(f"regexp_matches(registro, '(?i)(^|[^a-z0-9]){x}[\\s\"'']*[:=]')" for x in _LABELS)
_RAW = f"""
raw AS (SELECT raw_id, {_VALUES},
  regexp_matches(registro, '(?i)valor[\\s\"'']*[:=][^a-zA-Z0-9]*[-−]\\s*[0-9]') AS neg FROM tel_raw WHERE {_HAS}),
rg AS (SELECT raw_id, min(raw_id) OVER (PARTITION BY f0, f1, f2, f3, f4, f5, f6, neg) AS lead FROM raw)"""
SQL = {
    "p4_found": f"""
WITH {_RAW},
t AS (SELECT id_eventos_telemetria AS id, min(id_eventos_telemetria) OVER (PARTITION BY data_evento, id_alarme, lower(regexp_replace(tag, '[^\\p{{L}}\\p{{N}}]', '', 'g'))) AS lead
  FROM tel WHERE data_evento IS NOT NULL AND id_alarme IS NOT NULL AND tag IS NOT NULL)
SELECT 'tel' AS tabela, lead AS id_menor, id AS id_copia FROM t WHERE id <> lead
UNION ALL SELECT 'tel_raw', lead, raw_id FROM rg WHERE raw_id <> lead""",
    "p4_records": f"""
WITH {_RAW}, s AS (SELECT lead, count(*) AS n FROM rg GROUP BY 1)
SELECT raw_id, coalesce(n, 1) AS copias FROM tel_raw LEFT JOIN s ON lead = raw_id
WHERE raw_id NOT IN (SELECT raw_id FROM rg WHERE raw_id <> lead)""",
}
