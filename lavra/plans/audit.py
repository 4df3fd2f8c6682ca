"""Data-quality audits of the event log, the state intervals and the dictionary."""

from __future__ import annotations

from pyspark.sql import functions as F

from lavra.functions.text import text_concept
from lavra.operators import concepts, events, intervals, quality
from lavra.plans.names_sql import BARE, concept
from lavra.plans.registry import Registry
from lavra.sources import read_table

R = Registry()
#: Columns of the event log other than its id; equal in all of them means the same record.
CONTENT = ["data_evento", "inicio_turno", "fim_turno", "dia", "localidade", "tag", "tag_frota", "tipo", "nome_operador_anon", "matricula_operador_hash", "id_alarme", "alarme", "id_criticidade", "criticidade", "valor", "classe", "is_dont_go"]
_CONTENT = ", ".join(CONTENT)


@R.query("SELECT \"column\", nulls FROM (SELECT " + ", ".join(f"count(*) - count({c}) AS {c}" for c in ["id_eventos_telemetria", *CONTENT]) + ' FROM tel) UNPIVOT (nulls FOR "column" IN (COLUMNS(*)))')
def null_profile(spark, d):
    """Nulls of every column."""
    return quality.null_profile(read_table(spark, d, "tel"))


@R.query("""SELECT "check", violations FROM (SELECT count(*) FILTER (WHERE is_dont_go NOT IN (0, 1)) AS dominio, count(*) FILTER (WHERE dia <> day(data_evento)) AS dia,
  count(*) FILTER (WHERE regexp_matches(tag, '^ | $')) AS brancos_tag, count(*) FILTER (WHERE regexp_matches(alarme, '^ | $')) AS brancos_alarme, count(*) FILTER (WHERE NOT regexp_full_match(nome_operador_anon, 'OP_[0-9]+')) AS operador,
  count(*) FILTER (WHERE valor = -9999) AS sentinela FROM tel) UNPIVOT (violations FOR "check" IN (COLUMNS(*)))""")
def domain_checks(spark, d):
    """Rows that break rules of domain, day, blanks and pattern."""
    c = F.col
    return quality.checks(read_table(spark, d, "tel"), {
        "dominio": ~c("is_dont_go").isin(0, 1), "dia": c("dia") != F.dayofmonth("data_evento"), "brancos_tag": c("tag").startswith(" ") | c("tag").endswith(" "), "brancos_alarme": c("alarme").startswith(" ") | c("alarme").endswith(" "),
        "operador": ~c("nome_operador_anon").rlike(r"\AOP_[0-9]+\z"), "sentinela": c("valor") == -9999,
    })


@R.query(f"SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS tuples, CAST(sum(n) - count(*) AS BIGINT) AS surplus FROM (SELECT {_CONTENT}, count(*) AS n FROM tel GROUP BY ALL)")
def tuple_distinct(spark, d):
    """Distinct rows with nulls kept (A5)."""
    return quality.tuple_distinct(read_table(spark, d, "tel"), CONTENT)


@R.query(f"SELECT count(*) AS groups, coalesce(CAST(sum(n) AS BIGINT), 0) AS rows, coalesce(CAST(sum(n - 1) AS BIGINT), 0) AS surplus FROM (SELECT count(*) AS n FROM tel GROUP BY {_CONTENT} HAVING count(*) > 1)")
def duplicate_stats(spark, d):
    """Groups of exact copies."""
    return events.duplicate_statistics(read_table(spark, d, "tel"), CONTENT)


@R.query("SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS surplus FROM (SELECT count(*) AS n FROM tel GROUP BY data_evento, tag, id_alarme, is_dont_go HAVING count(*) > 1)")
def logical_duplicates(spark, d):
    """Groups equal in time, tag, alarm and flag."""
    return events.duplicate_statistics(read_table(spark, d, "tel"), ["data_evento", "tag", "id_alarme", "is_dont_go"])


@R.query("SELECT id_alarme AS key, count(DISTINCT alarme) AS n, list(DISTINCT alarme ORDER BY alarme) AS values FROM tel GROUP BY 1 HAVING n > 1")
def name_conflicts(spark, d):
    """Alarm ids with several names."""
    return quality.conflicts(read_table(spark, d, "tel"), "id_alarme", "alarme")


@R.query("SELECT trim(alarme) AS key, count(DISTINCT id_alarme) AS n, list(DISTINCT id_alarme ORDER BY id_alarme) AS values FROM tel GROUP BY 1 HAVING n > 1")
def id_conflicts(spark, d):
    """Alarm names with several ids (C20)."""
    return quality.conflicts(read_table(spark, d, "tel"), F.trim("alarme"), "id_alarme")


@R.query(f"""WITH {BARE}, t AS (SELECT DISTINCT id_alarme, alarme FROM tel),
f AS (SELECT id_alarme, form, v FROM t LEFT JOIN bare USING (alarme), LATERAL (VALUES ('cru', alarme), ('aparado', aparado), ('sem_acento', lower(solto)), ('conceito', {concept("solto")})) x(form, v)),
g AS (SELECT form, id_alarme, count(DISTINCT v) AS n FROM f GROUP BY 1, 2)
SELECT form, count(*) FILTER (WHERE n > 1) AS keys FROM g GROUP BY 1""")
def normalisation_conflicts(spark, d):
    """How many ids keep several names as the name is normalised further."""
    t = read_table(spark, d, "tel").select("id_alarme", "alarme").distinct()
    a, bare = F.col("alarme"), concepts.stripped("alarme")
    t = t.select("id_alarme", a.alias("cru"), bare.alias("aparado"), concepts.unaccented(bare).alias("solto"))
    return quality.conflicts_by_form(t, "id_alarme", {"cru": F.col("cru"), "aparado": F.col("aparado"), "sem_acento": F.lower("solto"), "conceito": text_concept("solto")})


@R.query("""
WITH p AS (SELECT data_evento AS ts, TRY_CAST(CASE WHEN regexp_full_match(inicio_turno, '\\d{4}-\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d') THEN inicio_turno END AS TIMESTAMP) AS a,
  TRY_CAST(CASE WHEN regexp_full_match(fim_turno, '\\d{4}-\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d') THEN fim_turno END AS TIMESTAMP) AS b FROM tel)
SELECT count(*) AS rows, count(*) FILTER (WHERE a IS NULL OR b IS NULL) AS sem_turno, count(*) FILTER (WHERE b < a) AS invertidos, count(*) FILTER (WHERE a <= b AND (ts < a OR ts >= b)) AS fora FROM p""")
def shift_parsing(spark, d):
    """Shift times that don't parse, are inverted, or don't hold the event (C20)."""

    def parsed(c):
        return F.when(F.col(c).rlike(r"\A\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\z"), F.col(c)).try_cast("timestamp_ntz")

    t = read_table(spark, d, "tel").select(F.col("data_evento").alias("ts"), parsed("inicio_turno").alias("a"), parsed("fim_turno").alias("b"))
    return t.agg(F.count("*").alias("rows"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("sem_turno"), F.count_if(F.col("b") < F.col("a")).alias("invertidos"), F.count_if((F.col("a") <= F.col("b")) & ((F.col("ts") < F.col("a")) | (F.col("ts") >= F.col("b")))).alias("fora"))


@R.query("""
WITH p AS (SELECT CAST(data_evento AS DATE) AS day, count(*) AS n FROM tel WHERE data_evento IS NOT NULL GROUP BY 1), g AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM p)
SELECT g.day, coalesce(n, 0) AS n FROM g LEFT JOIN p USING (day)""")
def daily_coverage(spark, d):
    """The same for the rows of every tag."""
    return quality.daily_coverage(read_table(spark, d, "tel"), "data_evento")


@R.query("""
WITH p AS (SELECT tag, CAST(data_evento AS DATE) AS day, count(*) AS n FROM tel GROUP BY 1, 2), m AS (SELECT tag, median(n) AS median FROM p GROUP BY 1),
v AS (SELECT tag, any_value(m.median) AS median, median(abs(n - m.median)) AS mad FROM p JOIN m USING (tag) GROUP BY 1)
SELECT p.tag, day, n, median, mad FROM p JOIN v USING (tag) WHERE n > median + 10 * greatest(mad, 1)""")
def volume_anomaly_mad(spark, d):
    """Days far above a tag's usual volume."""
    return quality.volume_anomalies(read_table(spark, d, "tel"), "tag", "data_evento")


@R.query("""
WITH d AS (SELECT tag, CAST(data_evento AS DATE) AS day FROM tel GROUP BY 1, 2 HAVING count(*) >= 20),
r AS (SELECT t.*, d.day FROM tel t JOIN d ON t.tag = d.tag AND CAST(t.data_evento AS DATE) = d.day), c AS (SELECT tag, day, id_alarme, count(*) AS n FROM r GROUP BY 1, 2, 3),
s AS (SELECT tag, day, count(DISTINCT data_evento) AS ts FROM r GROUP BY 1, 2),
k AS (SELECT *, sum(n) OVER (PARTITION BY tag, day) AS total, row_number() OVER (PARTITION BY tag, day ORDER BY n DESC, id_alarme) AS rn FROM c)
SELECT tag, day, id_alarme, n, CAST(total AS BIGINT) AS total, n / total::DOUBLE AS kind_share, ts / total::DOUBLE AS time_share FROM k JOIN s USING (tag, day) WHERE rn = 1""")
def dominant_signal(spark, d):
    """The leading alarm of busy days, its share and the share of distinct times."""
    t = read_table(spark, d, "tel")
    days = t.groupBy("tag", F.to_date("data_evento").alias("day")).agg(F.count("*").alias("n")).where("n >= 20")
    return quality.dominant_signal(t, "tag", "data_evento", "id_alarme", days)


_TEL_COLUMNS = ["id_eventos_telemetria", *CONTENT]
_AP_COLUMNS = ["id", "tag", "frota", "tipo", "inicio", "fim", "classe"]


@R.query("""
WITH h AS (SELECT 'tel' AS "table", column_name AS "column" FROM (DESCRIBE tel) UNION ALL SELECT 'apontamentos', column_name FROM (DESCRIBE apontamentos)),
s AS (SELECT DISTINCT lower(trim(tabela)) AS "table", lower(trim(nome_da_feature)) AS "column" FROM dicionario WHERE nome_da_feature IS NOT NULL AND lower(trim(tabela)) IN ('tel', 'apontamentos'))
SELECT "table", "column", 'missing' AS "where" FROM s ANTI JOIN h USING ("table", "column") UNION ALL SELECT "table", "column", 'extra' FROM h ANTI JOIN s USING ("table", "column")""")
def schema_contract(spark, d):
    """Columns the dictionary and the tables don't agree on (U4)."""
    actual = {t: read_table(spark, d, t).columns for t in ("tel", "apontamentos")}
    return quality.contract(read_table(spark, d, "dicionario"), "nome_da_feature", "tabela", actual)


@R.query("""SELECT count(*) AS rows, count(*) FILTER (WHERE inicio IS NULL) AS null_start, count(*) FILTER (WHERE fim IS NULL) AS null_end, count(*) FILTER (WHERE fim = inicio) AS empty,
  count(*) FILTER (WHERE fim < inicio) AS negative, round(sum(CASE WHEN fim > inicio THEN date_diff('millisecond', inicio, fim) / 3600000.0::DOUBLE END), 6) AS hours FROM apontamentos""")
def interval_quality(spark, d):
    """Null, empty and negative intervals (C20)."""
    return intervals.interval_quality(read_table(spark, d, "apontamentos"), "inicio", "fim").withColumn("hours", F.round("hours", 6))


_PREVIOUS = """
p AS (SELECT tag, id, inicio, fim, classe, lag(id) OVER w AS prev_id, lag(fim) OVER w AS prev_fim, lag(classe) OVER w AS prev_classe FROM apontamentos WHERE tag IS NOT NULL
  WINDOW w AS (PARTITION BY tag ORDER BY inicio NULLS LAST, fim NULLS LAST, id)),
o AS (SELECT *, date_diff('millisecond', inicio, prev_fim) / 1000.0::DOUBLE AS overlap_s FROM p WHERE inicio < prev_fim)"""


@R.query(f"WITH {_PREVIOUS} SELECT * FROM o")
def interval_overlap_audit(spark, d):
    """Intervals that begin before the previous one has ended."""
    return intervals.overlaps_with_previous(read_table(spark, d, "apontamentos").where("tag IS NOT NULL"), "tag", "inicio", "fim", "id", "classe")


@R.query(f"WITH {_PREVIOUS} SELECT prev_classe, classe, count(*) AS n, round(median(overlap_s), 6) AS mediana, max(overlap_s) AS maior FROM o GROUP BY 1, 2")
def overlap_pairs(spark, d):
    """Overlaps by pair of states."""
    o = intervals.overlaps_with_previous(read_table(spark, d, "apontamentos").where("tag IS NOT NULL"), "tag", "inicio", "fim", "id", "classe")
    return o.groupBy("prev_classe", "classe").agg(F.count("*").alias("n"), F.round(F.percentile("overlap_s", F.lit(0.5)), 6).alias("mediana"), F.max("overlap_s").alias("maior"))


@R.query("""
WITH p AS (SELECT CAST(data_evento AS DATE) AS d, count(*) AS n FROM tel GROUP BY 1), t AS (SELECT coalesce(max(n), 0) AS n FROM p WHERE d = DATE '2025-06-29'), o AS (SELECT n FROM p WHERE d <> DATE '2025-06-29')
SELECT (SELECT n FROM t) AS n, round((SELECT n FROM t) / median(n), 9) AS over_median, round((SELECT n FROM t) / quantile_cont(n, 0.95), 9) AS over_p95, round((SELECT n FROM t) / max(n)::DOUBLE, 9) AS over_max FROM o""")
def day_vs_history(spark, d):
    """One day's volume against the other days."""
    out = quality.day_against_history(read_table(spark, d, "tel"), "data_evento", "2025-06-29")
    return out.withColumns({c: F.round(c, 9) for c in out.columns[1:]})


@R.query("""
WITH g AS (SELECT data_evento, tag, id_alarme, count(*) AS n, count(DISTINCT (valor, classe, localidade)) AS k FROM tel GROUP BY 1, 2, 3 HAVING k > 1)
SELECT count(*) AS groups, coalesce(CAST(sum(n) AS BIGINT), 0) AS rows, count(*) FILTER (WHERE hour(data_evento) IN (6, 18)) AS in_hours FROM g""")
def context_conflicts(spark, d):
    """Copies whose context differs, and those at the change of shift."""
    return quality.context_conflicts(read_table(spark, d, "tel"), ["data_evento", "tag", "id_alarme"], ["valor", "classe", "localidade"], "data_evento", [6, 18])


@R.query("""
WITH m AS (SELECT max(data_evento) - INTERVAL 7 DAY AS t FROM tel)
SELECT id_alarme, count(*) AS n FROM tel, m WHERE data_evento >= t GROUP BY 1 ORDER BY n DESC, id_alarme LIMIT 10""")
def trailing_period(spark, d):
    """The leading alarms of the last seven days (C45); the limit is the feature."""
    t = read_table(spark, d, "tel")
    last = t.agg(F.max("data_evento")).first()[0]
    recent = t.where(F.col("data_evento") >= F.lit(last).cast("timestamp_ntz") - F.expr("INTERVAL 7 DAYS"))
    return recent.groupBy("id_alarme").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id_alarme").limit(10)


@R.query("""
WITH c AS (SELECT DISTINCT lower(trim(nome_da_feature)) AS nome, descricao IS NULL AS vazio FROM dicionario WHERE tabela = 'tel'), t AS (SELECT column_name AS nome FROM (DESCRIBE tel))
SELECT count(*) AS regras, count(*) FILTER (WHERE t.nome IS NULL) AS sem_coluna, count(*) FILTER (WHERE vazio) AS sem_descricao FROM c LEFT JOIN t USING (nome)""")
def catalogue_coverage(spark, d):
    """How much of a small catalogue meets the table by name."""
    c = read_table(spark, d, "dicionario").where("tabela = 'tel'").select(F.lower(F.trim("nome_da_feature")).alias("nome"), F.col("descricao").isNull().alias("vazio")).distinct()
    t = spark.createDataFrame([(x, True) for x in read_table(spark, d, "tel").columns], "nome string, ha boolean")
    return c.join(t, "nome", "left").agg(F.count("*").alias("regras"), F.count_if(F.col("ha").isNull()).alias("sem_coluna"), F.count_if("vazio").alias("sem_descricao"))
