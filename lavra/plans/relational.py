"""Scans, projections, predicates, joins, aggregates, windows, sorts, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lavra.functions.text import folded, text_concept
from lavra.functions.time import bucket_start, hours_between, micros, millis, seconds_between
from lavra.operators import concepts, quality
from lavra.plans.names_sql import BARE, concept
from lavra.plans.registry import Registry
from lavra.sources import calendar, grid, read_table, scan

R = Registry()


def T(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, folder, name)


# Scans and generated relations


@R.query("SELECT tag, data_evento, id_alarme FROM tel UNION ALL SELECT tag, inicio, NULL FROM apontamentos")
def scan_by_name(spark, d):
    """Files of different schemas as one relation, columns united by name and pruned."""
    tel = scan(spark, f"{d}/tel.parquet", columns=["tag", "data_evento", "id_alarme"])
    ap = scan(spark, f"{d}/apontamentos.parquet", columns=["tag", "inicio"]).withColumnRenamed("inicio", "data_evento")
    return tel.unionByName(ap, allowMissingColumns=True)


@R.query("SELECT CAST(unnest(generate_series(TIMESTAMP '2025-01-01', TIMESTAMP '2025-01-31', INTERVAL 8 HOUR)) AS TIMESTAMP) AS instant")
def calendar_8h(spark, d):
    """Instants 8 hours apart, both ends included."""
    return calendar(spark, "timestamp_ntz'2025-01-01 00:00:00'", "timestamp_ntz'2025-01-31 00:00:00'", "8 hours")


@R.query("""
WITH s AS (SELECT tag, CAST(min(data_evento) AS DATE) AS lo, CAST(max(data_evento) AS DATE) AS hi FROM tel GROUP BY 1)
SELECT tag, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM s""")
def daily_grid(spark, d):
    """Every day of every tag from its first to its last, without a cross join."""
    s = T(spark, d, "tel").groupBy("tag").agg(F.to_date(F.min("data_evento")).alias("lo"), F.to_date(F.max("data_evento")).alias("hi"))
    return grid(s, "lo", "hi", "1 day", "day").select("tag", "day")


@R.query("SELECT v.* FROM (VALUES ('alto', 0.5::DOUBLE, 2), ('base', 0.3::DOUBLE, 1)) v(cenario, limiar, peso)")
def inline_relation(spark, d):
    """A literal relation registered as a table and queried by name."""
    spark.createDataFrame([("alto", 0.5, 2), ("base", 0.3, 1)], "cenario string, limiar double, peso int").createOrReplaceTempView("lavra_inline")
    return spark.sql("SELECT * FROM lavra_inline")


@R.query("SELECT column_name AS col_name FROM (DESCRIBE SELECT * FROM tel)")
def schema_introspection(spark, d):
    """The columns of a query."""
    return spark.createDataFrame([(c,) for c in T(spark, d, "tel").columns], "col_name string")


# Projections and predicates


@R.query("SELECT * EXCLUDE (valor, classe), coalesce(valor, 0.0) / 2 AS metade FROM tel WHERE NOT (tag = 'PE4105' AND CAST(data_evento AS DATE) = DATE '2025-03-10' AND id_alarme IN (14760, 64220))")
def compound_filter(spark, d):
    """All columns but some, a computed ratio, and a negated compound predicate; the day is a range that reaches the scan."""
    day = (F.col("data_evento") >= F.expr("timestamp_ntz'2025-03-10'")) & (F.col("data_evento") < F.expr("timestamp_ntz'2025-03-11'"))
    t = T(spark, d, "tel").where(~((F.col("tag") == "PE4105") & day & F.col("id_alarme").isin(14760, 64220)))
    return t.withColumn("metade", F.coalesce("valor", F.lit(0.0)) / 2).drop("valor", "classe")


@R.query("SELECT id_eventos_telemetria AS id FROM tel WHERE classe IS DISTINCT FROM 'Inactive'")
def null_safe_mask(spark, d):
    """A negated mask that keeps nulls."""
    return T(spark, d, "tel").where(~F.coalesce(F.col("classe") == "Inactive", F.lit(False))).select(F.col("id_eventos_telemetria").alias("id"))


@R.query("SELECT id, date_diff('second', inicio, fim) AS s FROM apontamentos WHERE date_diff('second', inicio, fim) BETWEEN 0 AND 3600")
def between_closed(spark, d):
    """A closed range over whole second borders."""
    s = seconds_between("inicio", "fim")
    return T(spark, d, "apontamentos").where(s.between(0, 3600)).select("id", s.alias("s"))


@R.query("SELECT tag, count(*) AS n FROM tel WHERE NOT regexp_full_match(tag, '[A-Za-z]{2}[0-9]+') GROUP BY 1")
def regex_conformance(spark, d):
    """Values that don't match a pattern."""
    return T(spark, d, "tel").where(~F.col("tag").rlike(r"\A[A-Za-z]{2}[0-9]+\z")).groupBy("tag").agg(F.count("*").alias("n"))


@R.query("SELECT id_alarme, count(*) AS n FROM tel WHERE contains(lower(alarme), 'sensor') OR starts_with(alarme, 'NÍVEL') GROUP BY 1")
def substring_predicates(spark, d):
    """Substring and prefix predicates (P10)."""
    return T(spark, d, "tel").where(F.lower("alarme").contains("sensor") | F.col("alarme").startswith("NÍVEL")).groupBy("id_alarme").agg(F.count("*").alias("n"))


@R.query("""
SELECT CASE WHEN valor IS NULL THEN 'sem' WHEN valor = -9999 THEN 'sentinela' WHEN valor < 0 THEN 'negativo' WHEN valor < 100 THEN 'baixo' ELSE 'alto' END AS faixa,
       count(*) AS n, CAST(sum(CASE WHEN is_dont_go = 1 AND tag LIKE 'PE%' THEN 3.0 ELSE 1.0 END) AS DOUBLE) AS peso FROM tel GROUP BY 1""")
def case_labels(spark, d):
    """First match of several conditions, and a weight by condition (P11-P13, ML5)."""
    v = F.col("valor")
    band = F.when(v.isNull(), "sem").when(v == -9999, "sentinela").when(v < 0, "negativo").when(v < 100, "baixo").otherwise("alto")
    weight = F.when((F.col("is_dont_go") == 1) & F.col("tag").startswith("PE"), 3.0).otherwise(1.0)
    return T(spark, d, "tel").groupBy(band.alias("faixa")).agg(F.count("*").alias("n"), F.sum(weight).alias("peso"))


@R.query("SELECT CASE WHEN contains(upper(tipo), 'ESCAV') THEN 'Escavadeira' WHEN tipo IS NOT NULL THEN 'Caminhao' END AS tipo, coalesce(CASE tag_frota WHEN 'H-72 R' THEN 'H-72' ELSE tag_frota END, 'SEM_FROTA') AS frota, count(*) AS n FROM tel GROUP BY 1, 2")
def value_replacement(spark, d):
    """A map of replaced values, a type normaliser and a filled null."""
    tipo = F.when(F.upper("tipo").contains("ESCAV"), "Escavadeira").when(F.col("tipo").isNotNull(), "Caminhao")
    t = T(spark, d, "tel").select(tipo.alias("tipo"), F.col("tag_frota").alias("frota")).replace({"H-72 R": "H-72"}, subset=["frota"]).na.fill({"frota": "SEM_FROTA"})
    return t.groupBy("tipo", "frota").agg(F.count("*").alias("n"))


@R.query("SELECT count(*) AS rows, count(inicio_turno) AS given, count(TRY_CAST(CASE WHEN regexp_full_match(inicio_turno, '\\d{4}-\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d') THEN inicio_turno END AS TIMESTAMP)) AS parsed FROM tel")
def safe_cast(spark, d):
    """A cast that gives null where it can't."""
    strict = F.when(F.col("inicio_turno").rlike(r"\A\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\z"), F.col("inicio_turno"))
    return T(spark, d, "tel").agg(F.count("*").alias("rows"), F.count("inicio_turno").alias("given"), F.count(strict.try_cast("timestamp")).alias("parsed"))


@R.query("SELECT id FROM apontamentos WHERE inicio IS NOT NULL AND fim IS NOT NULL AND classe IS NOT NULL")
def drop_null_rows(spark, d):
    """Rows without nulls in a subset."""
    return T(spark, d, "apontamentos").na.drop(subset=["inicio", "fim", "classe"]).select("id")


@R.query("SELECT id_alarme, count(*) AS n, count(DISTINCT tag) AS tags FROM tel GROUP BY 1 HAVING n > 500 AND tags >= 3")
def having_filter(spark, d):
    """A filter on aggregates."""
    return T(spark, d, "tel").groupBy("id_alarme").agg(F.count("*").alias("n"), F.count_distinct("tag").alias("tags")).where("n > 500 AND tags >= 3")


@R.query("SELECT t.id_alarme, count(*) AS n FROM tel t WHERE t.id_alarme IN (SELECT id_alarme FROM tel WHERE is_dont_go = 1 GROUP BY 1 HAVING count(*) >= 3) GROUP BY 1")
def keep_groups(spark, d):
    """Rows of the groups that qualify: a semi join on their keys."""
    t = T(spark, d, "tel")
    keys = t.where("is_dont_go = 1").groupBy("id_alarme").count().where("count >= 3").select("id_alarme")
    return t.join(keys, "id_alarme", "left_semi").groupBy("id_alarme").agg(F.count("*").alias("n"))


_IDS = (14760, 64220, 20113, 6030, 63822)


@R.query("SELECT tag, " + ", ".join(f"CAST(sum(CASE WHEN id_alarme = {i} THEN 1 ELSE 0 END) AS BIGINT) AS alarm_{i}" for i in _IDS) + " FROM tel GROUP BY 1")
def generated_columns(spark, d):
    """Columns generated from a list of values."""
    return T(spark, d, "tel").groupBy("tag").agg(*[F.sum(F.when(F.col("id_alarme") == i, 1).otherwise(0)).alias(f"alarm_{i}") for i in _IDS])


# Joins


@R.query("SELECT o_orderpriority AS prioridade, l_returnflag AS flag, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS receita FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2")
def join_inner(spark, d):
    """An inner equality join."""
    j = T(spark, d, "orders").join(T(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy(F.col("o_orderpriority").alias("prioridade"), F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("receita"))


@R.query("""
WITH t AS (SELECT tag, CAST(data_evento AS DATE) AS day, count(*) AS n FROM tel GROUP BY 1, 2),
a AS (SELECT tag, CAST(inicio AS DATE) AS day, count(*) AS trocas FROM apontamentos WHERE inicio IS NOT NULL GROUP BY 1, 2)
SELECT t.tag, t.day, n, coalesce(trocas, 0) AS trocas FROM t LEFT JOIN a USING (tag, day)""")
def join_left_computed_key(spark, d):
    """A left join on a computed day, both sides reduced before it."""
    t = T(spark, d, "tel").groupBy("tag", F.to_date("data_evento").alias("day")).agg(F.count("*").alias("n"))
    a = T(spark, d, "apontamentos").where("inicio IS NOT NULL").groupBy("tag", F.to_date("inicio").alias("day")).agg(F.count("*").alias("trocas"))
    return t.join(a, ["tag", "day"], "left").na.fill(0, ["trocas"])


@R.query("SELECT t.tag, t.n, a.tag IS NULL AS ausente FROM (SELECT tag, count(*) AS n FROM tel GROUP BY 1) t LEFT JOIN (SELECT DISTINCT tag FROM apontamentos) a USING (tag)")
def join_semi_anti(spark, d):
    """Which keys of one table are missing in the other."""
    t = T(spark, d, "tel").groupBy("tag").agg(F.count("*").alias("n"))
    a = T(spark, d, "apontamentos").select("tag").distinct().withColumn("ha", F.lit(True))
    return t.join(a, "tag", "left").select("tag", "n", F.col("ha").isNull().alias("ausente"))


@R.query("SELECT c.c_mktsegment AS segmento, n.n_name AS nacao, r.r_name AS regiao, count(*) AS n, round(avg(c_acctbal), 4) AS saldo FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1, 2, 3")
def join_dimensions(spark, d):
    """Left joins with different key names; the sizes of the small sides are known to the planner, which broadcasts them."""
    j = T(spark, d, "customer").join(T(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(T(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.groupBy(F.col("c_mktsegment").alias("segmento"), F.col("n_name").alias("nacao"), F.col("r_name").alias("regiao")).agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("saldo"))


@R.query("SELECT l_suppkey AS fornecedor, l_orderkey AS pedido, l_linenumber AS linha, round(l_quantity - m, 6) AS desvio FROM lineitem JOIN (SELECT l_suppkey AS k, avg(l_quantity) AS m FROM lineitem GROUP BY 1) ON k = l_suppkey WHERE l_quantity > 1.9 * m")
def join_back(spark, d):
    """Group statistics joined back to the rows: means combined before their shuffle, so no key's rows meet in one task."""
    t = T(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    t = t.join(t.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("m")), "l_suppkey").where(F.col("l_quantity") > 1.9 * F.col("m"))
    return t.select(F.col("l_suppkey").alias("fornecedor"), F.col("l_orderkey").alias("pedido"), F.col("l_linenumber").alias("linha"), F.round(F.col("l_quantity") - F.col("m"), 6).alias("desvio"))


_CASES = [("PE4105", "2025-02-03 06:00:00", "2025-02-03 18:00:00"), ("PE4101", "2025-03-10 00:00:00", "2025-03-12 00:00:00"), ("CA70128", "2025-04-01 12:00:00", "2025-04-02 12:00:00")]


@R.query("SELECT id_eventos_telemetria AS id FROM tel WHERE " + " OR ".join(f"(tag = '{t}' AND data_evento >= TIMESTAMP '{a}' AND data_evento < TIMESTAMP '{b}')" for t, a, b in _CASES))
def or_of_ranges(spark, d):
    """Rows in any of a list of key and time ranges (J17): a predicate that reaches the scan."""
    cond = F.lit(False)
    for tag, a, b in _CASES:
        cond = cond | ((F.col("tag") == tag) & (F.col("data_evento") >= F.expr(f"timestamp_ntz'{a}'")) & (F.col("data_evento") < F.expr(f"timestamp_ntz'{b}'")))
    return T(spark, d, "tel").where(cond).select(F.col("id_eventos_telemetria").alias("id"))


# Aggregates


@R.query("SELECT count(*) AS n, count(valor) AS com_valor, min(valor) AS menor, max(valor) AS maior, round(avg(valor), 6) AS media, CAST(sum(dia) AS BIGINT) AS dias, min(data_evento) AS primeiro, max(data_evento) AS ultimo, count(DISTINCT tag) AS tags FROM tel")
def event_overview(spark, d):
    """A global profile (A1)."""
    return T(spark, d, "tel").agg(
        F.count("*").alias("n"), F.count("valor").alias("com_valor"), F.min("valor").alias("menor"), F.max("valor").alias("maior"), F.round(F.avg("valor"), 6).alias("media"),
        F.sum("dia").alias("dias"), F.min("data_evento").alias("primeiro"), F.max("data_evento").alias("ultimo"), F.count_distinct("tag").alias("tags"),
    )


@R.query("SELECT strftime(data_evento, '%Y-%m') AS mes, count(*) AS n, count(*) FILTER (WHERE is_dont_go = 1) AS dont_go, CAST(max(CASE WHEN id_criticidade = 1 THEN 1 ELSE 0 END) AS INTEGER) AS critico FROM tel GROUP BY ALL")
def monthly_volume(spark, d):
    """Grouping by an expression, filtered aggregates, a flag by max."""
    return T(spark, d, "tel").groupBy(F.date_format("data_evento", "yyyy-MM").alias("mes")).agg(
        F.count("*").alias("n"), F.count_if(F.col("is_dont_go") == 1).alias("dont_go"), F.max(F.when(F.col("id_criticidade") == 1, 1).otherwise(0)).alias("critico")
    )


@R.query("SELECT tag, CAST(sum(is_dont_go = 1) AS BIGINT) AS s, min(localidade) AS local, any_value(tag_frota) IS NOT NULL AS tem_frota FROM tel GROUP BY 1")
def boolean_sums(spark, d):
    """Sums of conditions and a value that isn't null."""
    return T(spark, d, "tel").groupBy("tag").agg(F.sum((F.col("is_dont_go") == 1).cast("int")).alias("s"), F.min("localidade").alias("local"), F.any_value("tag_frota", F.lit(True)).isNotNull().alias("tem_frota"))


@R.query("SELECT id_alarme, count(valor) AS n, median(valor) AS mediana, round(quantile_cont(valor, 0.95), 6) AS p95 FROM tel WHERE valor <> -9999 GROUP BY 1")
def quantiles(spark, d):
    """Exact interpolated quantiles."""
    return T(spark, d, "tel").where("valor <> -9999").groupBy("id_alarme").agg(F.count("valor").alias("n"), F.median("valor").alias("mediana"), F.round(F.percentile("valor", F.lit(0.95)), 6).alias("p95"))


@R.query("SELECT tag, list(DISTINCT localidade ORDER BY localidade) FILTER (WHERE localidade IS NOT NULL) AS locais, string_agg(DISTINCT tag_frota, ', ' ORDER BY tag_frota) AS frotas FROM tel GROUP BY 1")
def ordered_lists(spark, d):
    """Sorted distinct lists and texts (A14, A15, AR1)."""
    locais = F.sort_array(F.collect_set("localidade"))
    return T(spark, d, "tel").groupBy("tag").agg(F.when(F.size(locais) > 0, locais).alias("locais"), F.nullif(F.array_join(F.sort_array(F.collect_set("tag_frota")), ", "), F.lit("")).alias("frotas"))


@R.query("""
WITH a AS (SELECT DISTINCT id_alarme, trim(alarme) AS nome FROM tel), b AS (SELECT *, row_number() OVER (PARTITION BY id_alarme ORDER BY nome) AS k FROM a)
SELECT id_alarme, string_agg(nome, ' | ' ORDER BY nome) AS nomes FROM b WHERE k <= 5 GROUP BY 1""")
def joined_unique_text(spark, d):
    """The first five distinct texts, joined."""
    names = F.slice(F.sort_array(F.collect_set(F.trim("alarme"))), 1, 5)
    return T(spark, d, "tel").groupBy("id_alarme").agg(F.array_join(names, " | ").alias("nomes"))


def _first_seen(spark, d):
    f = T(spark, d, "tel").groupBy("tag", "id_alarme").agg(F.min("id_eventos_telemetria").alias("i"))
    order = F.sort_array(F.collect_list(F.struct("i", "id_alarme")))
    return f.groupBy("tag").agg(F.transform(order, lambda x: x["id_alarme"]).alias("alarmes"))


@R.query("""
WITH f AS (SELECT tag, id_alarme, min(id_eventos_telemetria) AS i FROM tel GROUP BY 1, 2)
SELECT tag, list(id_alarme ORDER BY i) AS alarmes FROM f GROUP BY 1""")
def first_seen_order(spark, d):
    """All distinct values in the order first seen."""
    return _first_seen(spark, d)


@R.query("SELECT classe, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM tel GROUP BY 1")
def share_of_total(spark, d):
    """Value counts with nulls and their share."""
    per = T(spark, d, "tel").groupBy("classe").agg(F.count("*").alias("n"))
    return per.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@R.query("SELECT tag_frota, tipo, count(*) AS n, count(valor) AS valores, round(avg(valor), 6) AS media, count(DISTINCT id_alarme) AS alarmes FROM tel GROUP BY 1, 2")
def named_aggregates(spark, d):
    """Several named aggregates by keys, nulls kept."""
    return T(spark, d, "tel").groupBy("tag_frota", "tipo").agg(F.count("*").alias("n"), F.count("valor").alias("valores"), F.round(F.avg("valor"), 6).alias("media"), F.count_distinct("id_alarme").alias("alarmes"))


@R.query("""
WITH c AS (SELECT tag, id_alarme, count(*) AS n FROM tel GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY n DESC, id_alarme) AS k FROM c)
SELECT tag, id_alarme, n FROM r WHERE k = 1""")
def mode_per_group(spark, d):
    """The most frequent value per group."""
    return quality.mode_per_group(T(spark, d, "tel"), ["tag"], "id_alarme")


@R.query("SELECT tag, coalesce(sum(CASE WHEN classe = 'Activate' THEN 1 END), 0)::BIGINT AS \"Activate\", coalesce(sum(CASE WHEN classe = 'Inactive' THEN 1 END), 0)::BIGINT AS \"Inactive\" FROM tel GROUP BY 1")
def pivot_table(spark, d):
    """Long to wide with a given list of values."""
    return T(spark, d, "tel").groupBy("tag").pivot("classe", ["Activate", "Inactive"]).count().na.fill(0)


@R.query("SELECT sample_id, nome, valor FROM (SELECT sample_id, CAST(target AS DOUBLE) AS alvo, probabilidade AS prob FROM predictions) UNPIVOT INCLUDE NULLS (valor FOR nome IN (alvo, prob))")
def unpivot_scores(spark, d):
    """Wide to long (A25, 1.1)."""
    t = T(spark, d, "predictions").select("sample_id", F.col("target").cast("double").alias("alvo"), F.col("probabilidade").alias("prob"))
    return t.unpivot("sample_id", ["alvo", "prob"], "nome", "valor")


@R.query("""
WITH c AS (SELECT id_alarme, count(*) AS n FROM tel GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, id_alarme) AS k FROM c)
SELECT CAST(t AS INTEGER) AS top, round(sum(n) FILTER (WHERE k <= t) / (SELECT sum(n) FROM c)::DOUBLE, 9) AS share FROM r, (VALUES (5), (10), (20), (50), (200)) v(t) GROUP BY 1""")
def topn_coverage(spark, d):
    """How much the most frequent values hold."""
    counts = T(spark, d, "tel").groupBy("id_alarme").agg(F.count("*").alias("n"))
    return quality.coverage_by_top(counts, "n", "id_alarme", [5, 10, 20, 50, 200]).withColumn("share", F.round("share", 9))


@R.query("""
SELECT CASE WHEN h <= 1 THEN '0-1' WHEN h <= 4 THEN '1-4' WHEN h <= 8 THEN '4-8' WHEN h <= 24 THEN '8-24' ELSE '24+' END AS faixa, count(*) AS n
FROM (SELECT date_diff('microsecond', inicio, fim) / 3.6e9 AS h FROM apontamentos) WHERE h >= 0 GROUP BY 1""")
def histogram_bands(spark, d):
    """Right-closed bands, the lowest end included."""
    h = hours_between("inicio", "fim")
    band = F.when(F.col("h") <= 1, "0-1").when(F.col("h") <= 4, "1-4").when(F.col("h") <= 8, "4-8").when(F.col("h") <= 24, "8-24").otherwise("24+")
    return T(spark, d, "apontamentos").select(h.alias("h")).where("h >= 0").groupBy(band.alias("faixa")).agg(F.count("*").alias("n"))


@R.query("SELECT round(corr(probabilidade, target), 8) AS r, count(*) AS n FROM predictions WHERE probabilidade IS NOT NULL AND target IS NOT NULL")
def correlation(spark, d):
    """Pearson correlation, for a binary column the point-biserial one."""
    t = T(spark, d, "predictions").na.drop(subset=["probabilidade", "target"])
    return t.agg(F.round(F.corr("probabilidade", "target"), 8).alias("r"), F.count("*").alias("n"))


@R.query("SELECT count(valor) AS n, round(avg(valor), 4) AS media, round(stddev_samp(valor), 4) AS desvio, min(valor) AS menor, round(quantile_cont(valor, 0.25), 4) AS q1, round(median(valor), 4) AS q2, round(quantile_cont(valor, 0.75), 4) AS q3, max(valor) AS maior FROM tel WHERE valor <> -9999")
def describe_column(spark, d):
    """Count, mean, deviation and quartiles."""
    v = F.col("valor")
    return T(spark, d, "tel").where("valor <> -9999").agg(
        F.count(v).alias("n"), F.round(F.avg(v), 4).alias("media"), F.round(F.stddev_samp(v), 4).alias("desvio"), F.min(v).alias("menor"),
        *[F.round(F.percentile(v, F.lit(p)), 4).alias(f"q{i}") for i, p in ((1, 0.25), (2, 0.5), (3, 0.75))], F.max(v).alias("maior"),
    )


@R.query("SELECT id_alarme, count(*) AS n, round(sum(is_dont_go = 1) / count(*)::DOUBLE, 9) AS taxa FROM tel GROUP BY 1 HAVING count(*) > 200")
def min_exposure_rate(spark, d):
    """A rate only where there is enough to go by."""
    return T(spark, d, "tel").groupBy("id_alarme").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("is_dont_go") == 1) / F.count("*"), 9).alias("taxa")).where("n > 200")


@R.query("SELECT tag, round(sum(s) / nullif(sum(n), 0), 6) AS media FROM (SELECT tag, id_alarme, sum(valor) AS s, count(valor) AS n FROM tel GROUP BY 1, 2) GROUP BY 1")
def weighted_mean(spark, d):
    """A mean from partial sums and counts."""
    p = T(spark, d, "tel").groupBy("tag", "id_alarme").agg(F.sum("valor").alias("s"), F.count("valor").alias("n"))
    return p.groupBy("tag").agg(F.round(F.try_divide(F.sum("s"), F.sum("n")), 6).alias("media"))


@R.query("""
WITH a AS (SELECT id_alarme, min(is_dont_go) AS lo, max(is_dont_go) AS hi, count(*) AS n FROM tel WHERE is_dont_go IN (0, 1) GROUP BY 1)
SELECT CASE WHEN hi = 0 THEN 'sempre0' WHEN lo = 1 THEN 'sempre1' ELSE 'misto' END AS classe, count(*) AS ids, CAST(sum(n) AS BIGINT) AS linhas FROM a GROUP BY 1""")
def target_behaviour(spark, d):
    """Ids whose flag is always 0, always 1, or mixed."""
    a = T(spark, d, "tel").where(F.col("is_dont_go").isin(0, 1)).groupBy("id_alarme").agg(F.min("is_dont_go").alias("lo"), F.max("is_dont_go").alias("hi"), F.count("*").alias("n"))
    kind = F.when(F.col("hi") == 0, "sempre0").when(F.col("lo") == 1, "sempre1").otherwise("misto")
    return a.groupBy(kind.alias("classe")).agg(F.count("*").alias("ids"), F.sum("n").alias("linhas"))


@R.query("SELECT (SELECT count(*) FROM tel) AS eventos, (SELECT count(*) FROM apontamentos) AS intervalos, (SELECT count(DISTINCT id_alarme) FROM tel) AS alarmes")
def scalar_metrics(spark, d):
    """A row of metrics from scalar subqueries."""
    for t in ("tel", "apontamentos"):
        T(spark, d, t).createOrReplaceTempView(f"lavra_{t}")
    return spark.sql("SELECT (SELECT count(*) FROM lavra_tel) AS eventos, (SELECT count(*) FROM lavra_apontamentos) AS intervalos, (SELECT count(DISTINCT id_alarme) FROM lavra_tel) AS alarmes")


# Windows, sorts, sets


@R.query("""
WITH c AS (SELECT tag, CAST(data_evento AS DATE) AS day, id_alarme, count(*) AS n FROM tel GROUP BY 1, 2, 3)
SELECT tag, day, id_alarme, n, CAST(row_number() OVER (PARTITION BY tag, day ORDER BY n DESC, id_alarme) AS INTEGER) AS rank FROM c
QUALIFY row_number() OVER (PARTITION BY tag, day ORDER BY n DESC, id_alarme) <= 3""")
def topk_per_group(spark, d):
    """The three most frequent alarms of each tag and day: a window over an aggregated query."""
    c = T(spark, d, "tel").groupBy("tag", F.to_date("data_evento").alias("day"), "id_alarme").agg(F.count("*").alias("n"))
    return quality.top_per_group(c, ["tag", "day"], [F.desc("n"), F.col("id_alarme")], 3)


@R.query("SELECT id_alarme, count(*) AS n FROM tel GROUP BY 1 ORDER BY n DESC, id_alarme LIMIT 20")
def global_topk(spark, d):
    """The twenty most frequent alarms, of equals the smaller id (O1-O3); the limit is the feature."""
    return T(spark, d, "tel").groupBy("id_alarme").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("id_alarme")).limit(20)


@R.query("WITH m AS (SELECT avg(valor) AS g FROM tel), t AS (SELECT tag, round(avg(valor) - max(g), 6) AS desvio FROM tel, m GROUP BY 1) SELECT * FROM t WHERE desvio IS NOT NULL ORDER BY abs(desvio) DESC, tag LIMIT 15")
def sort_by_absolute(spark, d):
    """The largest deviations either way."""
    t = T(spark, d, "tel")
    mean = t.agg(F.avg("valor")).first()[0]
    per = t.groupBy("tag").agg(F.round(F.avg("valor") - F.lit(mean), 6).alias("desvio")).where("desvio IS NOT NULL")
    return per.orderBy(F.abs("desvio").desc(), "tag").limit(15)


@R.query("""
SELECT tag, max(valor) AS maior, arg_max(id_eventos_telemetria, (valor, -id_eventos_telemetria)) AS id FROM tel WHERE valor IS NOT NULL GROUP BY 1""")
def argmax_row(spark, d):
    """The row of the largest value, of equals the smaller id."""
    key = F.struct("valor", (-F.col("id_eventos_telemetria")).alias("i"))
    return T(spark, d, "tel").where("valor IS NOT NULL").groupBy("tag").agg(F.max("valor").alias("maior"), (-F.max(key)["i"]).alias("id"))


@R.query("SELECT DISTINCT tag, tag_frota FROM tel")
def distinct_rows(spark, d):
    """Distinct rows."""
    return T(spark, d, "tel").select("tag", "tag_frota").distinct()


# Scalar functions


@R.query(f"""WITH {BARE} SELECT alarme, aparado AS sem_bordas, lower(alarme) AS minusculo, cru_solto AS sem_acento, {concept("solto")} AS conceito,
  substring(alarme, 1, 2) AS prefixo, replace(alarme, ' ', '_') AS rotulo FROM bare""")
def text_normalisation(spark, d):
    """Outer blanks, case, accents, concept text, prefix and replacement of every name."""
    a = T(spark, d, "tel").select("alarme").distinct()
    bare = concepts.stripped("alarme")
    return a.select("alarme", bare.alias("sem_bordas"), F.lower("alarme").alias("minusculo"), concepts.unaccented("alarme").alias("sem_acento"), text_concept(concepts.unaccented(bare)).alias("conceito"), F.substring("alarme", 1, 2).alias("prefixo"), F.replace("alarme", F.lit(" "), F.lit("_")).alias("rotulo"))


@R.query("SELECT tag || '|' || CAST(id_alarme AS VARCHAR) AS chave, left(regexp_replace(tag, '[^a-zA-Z0-9]', '_', 'g'), 35) AS nome, count(*) AS n FROM tel GROUP BY 1, 2")
def composite_keys(spark, d):
    """A composite text key and a sanitised identifier."""
    key = F.concat_ws("|", "tag", F.col("id_alarme").cast("string"))
    return T(spark, d, "tel").groupBy(key.alias("chave"), F.substring(F.regexp_replace("tag", "[^a-zA-Z0-9]", "_"), 1, 35).alias("nome")).agg(F.count("*").alias("n"))


@R.query("""
SELECT id, date_diff('second', inicio, fim) AS s, date_diff('millisecond', inicio, fim) AS ms, time_bucket(INTERVAL '8 hours', inicio) AS caixa, date_trunc('hour', inicio) AS hora,
  CAST(inicio AS DATE) AS data, CAST(day(inicio) AS INTEGER) AS dia, CAST(month(inicio) AS INTEGER) AS mes, CAST(hour(inicio) AS INTEGER) AS h, strftime(inicio, '%Y-%m') AS anomes, CAST(isodow(inicio) - 1 AS INTEGER) AS semana_dia,
  CAST(date_trunc('week', inicio) AS DATE) AS semana, inicio + INTERVAL 90 MINUTE AS depois, round(date_diff('microsecond', inicio, fim) / 3.6e9, 9) AS horas
FROM apontamentos""")
def time_functions(spark, d):
    """Differences by border, buckets, truncation, parts, weeks and interval arithmetic."""
    i = F.col("inicio")
    return T(spark, d, "apontamentos").select(
        "id", seconds_between("inicio", "fim").alias("s"), (millis("fim") - millis("inicio")).alias("ms"), bucket_start("inicio", 8 * 3600).alias("caixa"), F.date_trunc("hour", i).cast("timestamp_ntz").alias("hora"),
        F.to_date(i).alias("data"), F.dayofmonth(i).alias("dia"), F.month(i).alias("mes"), F.hour(i).alias("h"), F.date_format(i, "yyyy-MM").alias("anomes"), F.weekday(i.cast("date")).alias("semana_dia"),
        F.to_date(F.date_trunc("week", i)).alias("semana"), (i + F.expr("INTERVAL 90 MINUTES")).alias("depois"), F.round(hours_between("inicio", "fim"), 9).alias("horas"),
    )


@R.query("""
SELECT sample_id, round(abs(probabilidade - 0.5), 9) AS a, greatest(probabilidade, 0.1) AS g, least(0.9, greatest(0.1, probabilidade)) AS c,
  round(sin(2 * pi() * hour(prediction_time) / 24), 9) AS s, round(cos(2 * pi() * hour(prediction_time) / 24), 9) AS k, round(probabilidade / nullif(target, 0), 9) AS q FROM predictions""")
def numeric_functions(spark, d):
    """Absolute values, bounds, cyclic encoding and guarded division (M1-M5)."""
    p = F.col("probabilidade")
    turn = 2 * F.pi() * F.hour("prediction_time") / 24
    clipped = F.when(p.isNull(), F.lit(0.1)).otherwise(F.least(F.lit(0.9), F.greatest(F.lit(0.1), p)))
    return T(spark, d, "predictions").select("sample_id", F.round(F.abs(p - 0.5), 9).alias("a"), F.greatest(p, F.lit(0.1)).alias("g"), clipped.alias("c"), F.round(F.sin(turn), 9).alias("s"), F.round(F.cos(turn), 9).alias("k"), F.round(F.try_divide(p, F.col("target").cast("double")), 9).alias("q"))


@R.query("SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) % 10 AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_field(spark, d):
    """A field of a JSON text (JS1)."""
    k = F.get_json_object("props", "$.k").cast("int") % 10
    return T(spark, d, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


@R.query("SELECT tag, CASE left(tag, 2) WHEN 'PE' THEN 'pa' WHEN 'CA' THEN 'caminhao' END AS nome, count(*) AS n FROM tel GROUP BY 1, 2")
def map_lookup(spark, d):
    """A lookup in a map literal (MP1, F5)."""
    m = F.create_map(F.lit("PE"), F.lit("pa"), F.lit("CA"), F.lit("caminhao"))
    return T(spark, d, "tel").groupBy("tag", F.element_at(m, F.substring("tag", 1, 2)).alias("nome")).agg(F.count("*").alias("n"))


@R.query("SELECT lower(strip_accents(trim(classe))) AS classe, count(*) AS n, round(sum(date_diff('microsecond', inicio, fim)) / 3.6e9, 6) AS horas FROM apontamentos GROUP BY 1")
def folded_groups(spark, d):
    """Groups by a folded text."""
    return T(spark, d, "apontamentos").groupBy(folded("classe").alias("classe")).agg(F.count("*").alias("n"), F.round(F.sum(micros("fim") - micros("inicio")) / F.lit(3.6e9), 6).alias("horas"))
