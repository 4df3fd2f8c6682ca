"""Event-log pipelines: analytic layer, gaps, sessions, transitions, states, as-of links, text concepts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lavra.functions.text import folded, plain_key, text_concept
from lavra.functions.time import bucket_start, micros
from lavra.operators import concepts, events, intervals, quality
from lavra.operators.evaluation import outcome, scored, with_and_without
from lavra.plans.audit import CONTENT
from lavra.plans.names_sql import BARE, concept
from lavra.plans.registry import Registry
from lavra.sources import read_table

R = Registry()
ID, TS = "id_eventos_telemetria", "data_evento"
_KEEP = [c for c in CONTENT if c not in ("inicio_turno", "fim_turno")]
_PURGE = "tag = 'PE4105' AND data_evento >= TIMESTAMP '2025-06-29' AND data_evento < TIMESTAMP '2025-06-30'"


def _tel(spark, d):
    return read_table(spark, d, "tel")


@R.query(f"SELECT {', '.join(_KEEP)}, min(id_eventos_telemetria) AS id_eventos_telemetria, count(*) AS copies FROM tel WHERE NOT coalesce({_PURGE}, false) GROUP BY ALL")
def exact_dedup(spark, d):
    """The analytic layer: a local purge, then exact copies once with their number."""
    purge = F.expr("tag = 'PE4105' AND data_evento >= timestamp_ntz'2025-06-29' AND data_evento < timestamp_ntz'2025-06-30'")
    return events.deduplicated(_tel(spark, d), ID, _KEEP, purge)


_GAPS = """
g AS (SELECT *, epoch_ms(data_evento) - epoch_ms(lag(data_evento) OVER (PARTITION BY tag, id_alarme ORDER BY data_evento, id_eventos_telemetria)) AS gap_ms FROM tel WHERE tag IS NOT NULL AND id_alarme IS NOT NULL)"""


@R.query(f"WITH {_GAPS} SELECT id_eventos_telemetria AS id, gap_ms FROM g")
def gap_rows(spark, d):
    """Milliseconds since the same alarm of the same tag."""
    return events.gaps(_tel(spark, d), ["tag", "id_alarme"], TS, ID).select(F.col(ID).alias("id"), "gap_ms")


@R.query(f"""WITH {_GAPS} SELECT CASE WHEN gap_ms <= 1000 THEN 'ate 1 s' WHEN gap_ms <= 60000 THEN 'ate 60 s' WHEN gap_ms <= 900000 THEN 'ate 15 min' WHEN gap_ms <= 28800000 THEN 'ate 8 h' ELSE 'mais' END AS faixa,
  count(*) AS n, median(gap_ms) AS mediana FROM g WHERE gap_ms IS NOT NULL GROUP BY 1""")
def gap_bands(spark, d):
    """Gaps by band."""
    g = F.col("gap_ms")
    band = F.when(g <= 1000, "ate 1 s").when(g <= 60_000, "ate 60 s").when(g <= 900_000, "ate 15 min").when(g <= 28_800_000, "ate 8 h").otherwise("mais")
    t = events.gaps(_tel(spark, d), ["tag", "id_alarme"], TS, ID).where("gap_ms IS NOT NULL")
    return t.groupBy(band.alias("faixa")).agg(F.count("*").alias("n"), F.percentile("gap_ms", F.lit(0.5)).alias("mediana"))


def _sessions_sql(gap_ms: int, keys: str = "tag, id_alarme") -> str:
    return f"""
o AS (SELECT *, epoch_ms(data_evento) - epoch_ms(lag(data_evento) OVER (PARTITION BY {keys} ORDER BY data_evento, id_eventos_telemetria)) AS gap_ms FROM tel),
n AS (SELECT *, sum(CASE WHEN gap_ms IS NULL OR gap_ms > {gap_ms} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY data_evento, id_eventos_telemetria ROWS UNBOUNDED PRECEDING) AS session FROM o),
s AS (SELECT {keys}, CAST(session AS BIGINT) AS session, min(data_evento) AS start, max(data_evento) AS "end", epoch_ms(max(data_evento)) - epoch_ms(min(data_evento)) AS duration_ms, count(*) AS n,
  max(CASE WHEN is_dont_go = 1 THEN 1 ELSE 0 END) AS dont_go FROM n GROUP BY ALL)"""


def _sessions(spark, d, gap_s, keys=("tag", "id_alarme")):
    flag = F.when(F.col("is_dont_go") == 1, 1).otherwise(0)
    return events.sessions(_tel(spark, d), list(keys), TS, gap_s, maxima={"dont_go": flag})


@R.query(f"WITH {_sessions_sql(900_000)} SELECT * FROM s")
def sessionize(spark, d):
    """Runs of one alarm of one tag, cut where more than 900 s pass."""
    return _sessions(spark, d, 900)


@R.query(f"WITH {_sessions_sql(3_600_000, 'tag')} SELECT * FROM s")
def sessionize_by_tag(spark, d):
    """Episodes of a tag whatever the alarm (C2 with another grain)."""
    return _sessions(spark, d, 3600, ["tag"])


@R.query(f"""WITH {_GAPS} SELECT CAST(t AS INTEGER) AS gap_s, count(*) FILTER (WHERE gap_ms IS NULL OR gap_ms > t * 1000) AS sessions FROM g, (VALUES (30), (60), (120), (300), (900), (3600), (86400)) v(t) GROUP BY 1""")
def episode_sensitivity(spark, d):
    """The number of sessions at every gap, from one pass over the gaps."""
    return events.sessions_by_gap(_tel(spark, d), ["tag", "id_alarme"], TS, [30, 60, 120, 300, 900, 3600, 86400])


@R.query(f"WITH {_sessions_sql(900_000)} SELECT tag, count(*) AS sessoes, CAST(sum(dont_go) AS BIGINT) AS positivas, max(n) AS maior, round(avg(duration_ms), 4) AS duracao FROM s GROUP BY 1")
def session_profile(spark, d):
    """Sessions by tag."""
    s = _sessions(spark, d, 900)
    return s.groupBy("tag").agg(F.count("*").alias("sessoes"), F.sum("dont_go").alias("positivas"), F.max("n").alias("maior"), F.round(F.avg("duration_ms"), 4).alias("duracao"))


_PLAIN = "FROM (SELECT * REPLACE (nullif(upper(regexp_replace(tag, '[^\\p{L}\\p{N}]', '', 'g')), '') AS tag) FROM tel))"


@R.query(f"""WITH {_sessions_sql(900_000).replace("FROM tel)", _PLAIN)},
p AS (SELECT sample_id, tag, prediction_time, CASE WHEN target = 1 THEN 'FN' ELSE 'FP' END AS resultado FROM predictions WHERE target IS NOT NULL AND probabilidade IS NOT NULL AND (target = 1) <> (probabilidade >= 0.3))
SELECT sample_id, p.tag, prediction_time, resultado, CASE WHEN start < prediction_time THEN 'observacao' ELSE 'horizonte' END AS parte, id_alarme, count(*) AS sessoes, CAST(sum(n) AS BIGINT) AS eventos, CAST(sum(dont_go) AS BIGINT) AS dont_go
FROM p JOIN s ON s.tag = p.tag AND start >= prediction_time - INTERVAL 24 HOUR AND start < prediction_time + INTERVAL 8 HOUR GROUP BY ALL""")
def error_sessions(spark, d):
    """The sessions that start in the 24 hours observed and the 8 of the horizon of false positives and negatives."""
    t = _tel(spark, d).withColumn("tag", plain_key("tag"))
    s = events.sessions(t, ["tag", "id_alarme"], TS, 900, maxima={"dont_go": F.when(F.col("is_dont_go") == 1, 1).otherwise(0)})
    s = s.withColumn("bin", bucket_start("start", 8 * 3600)).select("tag", "bin", "id_alarme", "start", "n", "dont_go")
    p = scored(read_table(spark, d, "predictions"), "target", "probabilidade").withColumn("resultado", outcome("target", F.col("probabilidade") >= 0.3)).where("resultado IN ('FP', 'FN')")
    at = F.col("prediction_time")
    spans = F.explode(F.sequence(bucket_start(at - F.expr("INTERVAL 24 HOURS"), 8 * 3600), bucket_start(at + F.expr("INTERVAL 8 HOURS"), 8 * 3600), F.expr("INTERVAL 8 HOURS")))
    p = p.select("sample_id", "tag", "prediction_time", "resultado", spans.alias("bin"))
    hits = p.join(s, ["tag", "bin"]).where((F.col("start") >= at - F.expr("INTERVAL 24 HOURS")) & (F.col("start") < at + F.expr("INTERVAL 8 HOURS")))
    part = F.when(F.col("start") < at, "observacao").otherwise("horizonte")
    return hits.groupBy("sample_id", "tag", "prediction_time", "resultado", part.alias("parte"), "id_alarme").agg(F.count("*").alias("sessoes"), F.sum("n").alias("eventos"), F.sum("dont_go").alias("dont_go"))


@R.query("""
WITH t AS (SELECT event_type AS "to", lag(event_type) OVER w AS "from", date_diff('millisecond', lag(ts) OVER w, ts) AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT "from", "to", count(*) AS n, median(step) AS median_ms, round(avg(step), 3) AS mean_ms FROM t WHERE step IS NOT NULL GROUP BY 1, 2""")
def transition_matrix(spark, d):
    """Which kind follows which, and after how long."""
    out = events.transitions(read_table(spark, d, "events"), ["user_id"], "ts", "event_id", "event_type")
    return out.withColumn("mean_ms", F.round("mean_ms", 3))


@R.query(f"""
WITH {_GAPS}, v AS (SELECT * FROM g WHERE gap_ms IS NOT NULL),
a AS (SELECT id_alarme, count(*) AS gaps, median(gap_ms) AS median_ms, round(quantile_cont(gap_ms, 0.9), 2) AS p90_ms, round(quantile_cont(gap_ms, 0.99), 2) AS p99_ms FROM v GROUP BY 1),
t AS (SELECT id_alarme, tag, median(gap_ms) AS m FROM v GROUP BY 1, 2), b AS (SELECT id_alarme, count(*) AS entities, max(m) AS max_median, min(m) AS min_median FROM t GROUP BY 1)
SELECT a.*, entities, max_median, min_median, round(max_median / nullif(min_median, 0), 4) AS ratio FROM a JOIN b USING (id_alarme) WHERE gaps >= 100 AND entities >= 3""")
def alarm_timing(spark, d):
    """Quantiles of each alarm's gaps and how far the tags differ."""
    out = events.timing_profile(_tel(spark, d), "tag", "id_alarme", TS, ID)
    return out.withColumns({"p90_ms": F.round("p90_ms", 2), "p99_ms": F.round("p99_ms", 2), "ratio": F.round("ratio", 4)})


# States


_AP = """ap AS (SELECT upper(regexp_replace(tag, '[^\\p{L}\\p{N}]', '', 'g')) AS tag, lower(strip_accents(trim(classe))) AS estado, inicio, fim, id FROM apontamentos)"""
_FLAGGED = """f AS (SELECT id_eventos_telemetria AS id, upper(regexp_replace(tag, '[^\\p{L}\\p{N}]', '', 'g')) AS tag, data_evento AS ts FROM tel WHERE is_dont_go = 1)"""


def _ap(spark, d):
    return read_table(spark, d, "apontamentos").select(plain_key("tag").alias("tag"), folded("classe").alias("estado"), "inicio", "fim", "id")


def _flagged(spark, d):
    return _tel(spark, d).where("is_dont_go = 1").select(F.col(ID).alias("id"), plain_key("tag").alias("tag"), F.col(TS).alias("ts"))


@R.query(f"WITH {_AP}, {_FLAGGED} SELECT f.id, f.tag, f.ts, ap.estado, ap.id AS intervalo FROM f LEFT JOIN ap ON f.tag = ap.tag AND f.ts >= ap.inicio AND f.ts < ap.fim")
def point_in_interval(spark, d):
    """The states in which flagged events fall; overlapping intervals give a row each."""
    ap = _ap(spark, d).withColumnRenamed("id", "intervalo")
    out = intervals.point_in_interval(_flagged(spark, d), ap, "tag", "ts", "inicio", "fim", ["estado", "intervalo"])
    return out.select("id", "tag", "ts", "estado", "intervalo")


@R.query(f"WITH {_AP}, {_FLAGGED} SELECT coalesce(ap.estado, 'sem_apontamento') AS estado, count(DISTINCT f.id) AS n FROM f LEFT JOIN ap ON f.tag = ap.tag AND f.ts >= ap.inicio AND f.ts < ap.fim GROUP BY 1")
def events_by_state(spark, d):
    """Flagged events by state."""
    out = intervals.point_in_interval(_flagged(spark, d), _ap(spark, d), "tag", "ts", "inicio", "fim", ["estado"])
    return out.groupBy(F.coalesce("estado", F.lit("sem_apontamento")).alias("estado")).agg(F.count_distinct("id").alias("n"))


STATES = ["operando", "parado", "hibernando", "manutencao"]
_WINDOWS = """
w AS (SELECT DISTINCT upper(regexp_replace(tag, '[^\\p{L}\\p{N}]', '', 'g')) AS tag, time_bucket(INTERVAL '8 hours', data_evento) AS a FROM tel WHERE is_dont_go = 1),
v AS (SELECT tag, a, a + INTERVAL 8 HOUR AS b FROM w)"""


def _windows(spark, d):
    w = _tel(spark, d).where("is_dont_go = 1").select(plain_key("tag").alias("tag"), bucket_start(TS, 8 * 3600).alias("a")).distinct()
    return w.withColumn("b", F.col("a") + F.expr("INTERVAL 8 HOURS"))


@R.query(f"""WITH {_AP}, {_WINDOWS} SELECT v.tag, v.a, v.b, ap.estado, CAST(sum(epoch_ms(least(v.b, ap.fim)) - epoch_ms(greatest(v.a, ap.inicio))) AS BIGINT) AS ms
FROM v JOIN ap ON v.tag = ap.tag AND ap.inicio < v.b AND ap.fim > v.a AND ap.fim > ap.inicio GROUP BY ALL""")
def interval_overlap(spark, d):
    """Time in each state within windows, clipped."""
    out = intervals.overlap_ms(_windows(spark, d), _ap(spark, d), "tag", ("a", "b"), ("inicio", "fim"), ["estado"])
    return out.groupBy("tag", "a", "b", "estado").agg(F.sum("overlap_ms").alias("ms"))


@R.query(f"""WITH {_AP}, {_WINDOWS}, o AS (SELECT v.tag, v.a, v.b, ap.estado, epoch_ms(least(v.b, ap.fim)) - epoch_ms(greatest(v.a, ap.inicio)) AS ms
  FROM v LEFT JOIN ap ON v.tag = ap.tag AND ap.inicio < v.b AND ap.fim > v.a AND ap.fim > ap.inicio),
s AS (SELECT tag, a, b, """ + ", ".join(f"coalesce(sum(CASE WHEN estado = '{s}' THEN ms END), 0) / 28800000.0::DOUBLE AS share_{i}" for i, s in enumerate(STATES)) + """ FROM o GROUP BY ALL),
t AS (SELECT *, share_0 + share_1 + share_2 + share_3 AS total FROM s)
SELECT tag, a, b, """ + ", ".join(f"round(share_{i}, 9) AS share_{i}" for i in range(4)) + """, round(least(1.0, total), 9) AS covered, round(greatest(0.0, total - 1), 9) AS doubled,
  CASE WHEN total = 0 THEN NULL WHEN share_0 >= greatest(share_1, share_2, share_3) THEN 'operando' WHEN share_1 >= greatest(share_2, share_3) THEN 'parado' WHEN share_2 >= share_3 THEN 'hibernando' ELSE 'manutencao' END AS dominant FROM t""")
def interval_state_share(spark, d):
    """Shares of a window's time by state, coverage and the dominant state."""
    out = intervals.state_shares(_windows(spark, d), _ap(spark, d), "tag", ("a", "b"), ("inicio", "fim"), "estado", STATES)
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c.startswith("share_") or c in ("covered", "doubled")})


_OPERATING = "r AS (SELECT tag, inicio AS ts, min(id) AS id FROM ap WHERE estado = 'operando' AND inicio IS NOT NULL AND tag <> '' GROUP BY 1, 2)"


@R.query(f"WITH {_AP}, {_FLAGGED}, {_OPERATING} SELECT f.id, f.tag, f.ts, r.id AS match_id, r.ts AS match_ts, round(date_diff('microsecond', f.ts, r.ts) / 3.6e9, 9) AS horas FROM f ASOF LEFT JOIN r ON f.tag = r.tag AND f.ts <= r.ts")
def next_state_asof(spark, d):
    """The next operating state after flagged events, and the hours to it."""
    out = intervals.asof(_flagged(spark, d), _ap(spark, d).where("estado = 'operando'"), "tag", "ts", "inicio", "id")
    return out.withColumn("horas", F.round((micros("match_ts") - micros("ts")) / F.lit(3.6e9), 9))


_MAINTENANCE = "r AS (SELECT tag, inicio AS ts, min(id) AS id FROM ap WHERE estado = 'manutencao' AND inicio IS NOT NULL AND tag <> '' GROUP BY 1, 2)"


@R.query(f"WITH {_AP}, {_FLAGGED}, {_MAINTENANCE} SELECT f.id, CASE WHEN r.ts < f.ts + INTERVAL 8 HOUR THEN r.id END AS match_id FROM f ASOF LEFT JOIN r ON f.tag = r.tag AND f.ts <= r.ts")
def first_followup_window(spark, d):
    """The first maintenance within 8 hours after flagged events."""
    out = intervals.asof(_flagged(spark, d), _ap(spark, d).where("estado = 'manutencao'"), "tag", "ts", "inicio", "id", tolerance_s=8 * 3600 - 1e-6)
    return out.select("id", "match_id")


@R.query(f"WITH {_AP}, {_FLAGGED}, {_MAINTENANCE} SELECT f.id, CASE WHEN r.ts >= f.ts - INTERVAL 24 HOUR THEN r.id END AS match_id FROM f ASOF LEFT JOIN r ON f.tag = r.tag AND f.ts > r.ts")
def last_prior_window(spark, d):
    """The last maintenance within 24 hours before flagged events, not at the same time."""
    out = intervals.asof(_flagged(spark, d), _ap(spark, d).where("estado = 'manutencao'"), "tag", "ts", "inicio", "id", direction="backward", exact=False, tolerance_s=24 * 3600)
    return out.select("id", "match_id")


@R.query(f"""WITH {_AP}, {_FLAGGED}, {_MAINTENANCE}, j AS (SELECT f.id, epoch_us(r.ts) - epoch_us(f.ts) AS us FROM f ASOF LEFT JOIN r ON f.tag = r.tag AND f.ts <= r.ts)
SELECT CAST(h AS INTEGER) AS horas, count(*) AS n, count(*) FILTER (WHERE us < h * 3600000000) AS ligados, round(count(*) FILTER (WHERE us < h * 3600000000) / nullif(count(*), 0)::DOUBLE, 9) AS taxa FROM j, (VALUES (1), (4), (8), (24)) v(h) GROUP BY 1""")
def linkage_rates(spark, d):
    """The share of flagged events followed by maintenance within several windows, from one as-of join."""
    out = intervals.asof(_flagged(spark, d), _ap(spark, d).where("estado = 'manutencao'"), "tag", "ts", "inicio", "id")
    us = micros("match_ts") - micros("ts")
    one = out.agg(F.count("*").alias("n"), *[F.count_if(us < h * 3_600_000_000).alias(f"h{h}") for h in (1, 4, 8, 24)])
    rows = F.array(*[F.struct(F.lit(h).alias("horas"), F.col("n"), F.col(f"h{h}").alias("ligados"), F.round(F.try_divide(F.col(f"h{h}"), F.col("n")), 9).alias("taxa")) for h in (1, 4, 8, 24)])
    return one.select(F.inline(rows))


@R.query(f"""WITH {_AP}, {_FLAGGED}, x AS (SELECT id, tag, date_diff('microsecond', inicio, fim) / 6e7 AS min, inicio, fim FROM ap WHERE fim > inicio AND estado = 'operando' AND tag <> ''),
h AS (SELECT x.id, any_value(min) AS min, count(f.id) > 0 AS alerta FROM x LEFT JOIN f ON f.tag = x.tag AND f.ts >= x.inicio AND f.ts < x.fim GROUP BY 1), q AS (SELECT quantile_cont(min, 0.99) AS lim FROM h), k AS (SELECT h.* FROM h, q WHERE min <= lim)
SELECT count(*) FILTER (WHERE alerta) AS n_with, round(quantile_cont(min, 0.5) FILTER (WHERE alerta), 6) AS median_with, round(quantile_cont(min, 0.9) FILTER (WHERE alerta), 6) AS p90_with,
  count(*) FILTER (WHERE NOT alerta) AS n_without, round(quantile_cont(min, 0.5) FILTER (WHERE NOT alerta), 6) AS median_without, round(quantile_cont(min, 0.9) FILTER (WHERE NOT alerta), 6) AS p90_without,
  round(quantile_cont(min, 0.5) FILTER (WHERE alerta) - quantile_cont(min, 0.5) FILTER (WHERE NOT alerta), 6) AS delta FROM k""")
def with_without_alert(spark, d):
    """Durations of operating intervals with and without a flagged event, trimmed at the 99th percentile."""
    ap = _ap(spark, d).where("fim > inicio AND estado = 'operando' AND tag IS NOT NULL")
    hits = intervals.point_in_interval(_flagged(spark, d).withColumnRenamed("id", "ev"), ap, "tag", "ts", "inicio", "fim", ["id"], how="inner").select("id").distinct()
    x = ap.join(hits.withColumn("alerta", F.lit(True)), "id", "left").select("id", ((micros("fim") - micros("inicio")) / F.lit(6e7)).alias("min"), F.coalesce("alerta", F.lit(False)).alias("alerta"))
    out = with_and_without(x, F.col("alerta"), "min", 0.99)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if not c.startswith("n_")})


# Text concepts


@R.query(f"""WITH {BARE}, c AS (SELECT id_alarme, {concept("solto")} AS conceito FROM (SELECT DISTINCT id_alarme, alarme FROM tel) LEFT JOIN bare USING (alarme))
SELECT conceito, count(DISTINCT id_alarme) AS ids, min(id_alarme) AS menor FROM c GROUP BY 1""")
def text_concepts(spark, d):
    """The catalogue of alarm concepts, made from distinct names; ids without a name stand under a null concept (C11)."""
    t = _tel(spark, d).select("id_alarme", "alarme").distinct()
    c = text_concept(concepts.unaccented(concepts.stripped("alarme")))
    return t.select("id_alarme", c.alias("conceito")).groupBy("conceito").agg(F.count_distinct("id_alarme").alias("ids"), F.min("id_alarme").alias("menor"))


def _families(t):
    rules = [("temperatura", ["temperat"]), ("pressao", ["press"]), ("sinal", ["sensor", "comunica", "signal"]), ("vibracao", ["vibra"]), ("nivel", ["nivel", "level"])]
    families = [("freio", ["freio", "brake"]), ("motor", ["motor", "turbo", "fuel"]), ("hidraulica", ["hidraul", "hydraul"])]
    c, f = concepts.by_rules(F.col("x"), rules, "outro"), concepts.by_rules(F.col("x"), families, "outra")
    return t.groupBy(c.alias("conceito"), f.alias("familia")).agg(F.sum("n").alias("n"), F.count_distinct("id_alarme").alias("ids"))


@R.query(f"""WITH {BARE}, t AS (SELECT id_alarme, lower(cru_solto) AS x, count(*) AS n FROM tel LEFT JOIN bare USING (alarme) GROUP BY 1, 2)
SELECT CASE WHEN contains(x, 'temperat') THEN 'temperatura' WHEN contains(x, 'press') THEN 'pressao' WHEN contains(x, 'sensor') OR contains(x, 'comunica') OR contains(x, 'signal') THEN 'sinal'
  WHEN contains(x, 'vibra') THEN 'vibracao' WHEN contains(x, 'nivel') OR contains(x, 'level') THEN 'nivel' ELSE 'outro' END AS conceito,
  CASE WHEN contains(x, 'freio') OR contains(x, 'brake') THEN 'freio' WHEN contains(x, 'motor') OR contains(x, 'turbo') OR contains(x, 'fuel') THEN 'motor' WHEN contains(x, 'hidraul') OR contains(x, 'hydraul') THEN 'hidraulica' ELSE 'outra' END AS familia,
  CAST(sum(n) AS BIGINT) AS n, count(DISTINCT id_alarme) AS ids FROM t GROUP BY 1, 2""")
def concept_family(spark, d):
    """Concept and family of a name by ordered rules, the first that fits wins; rows without a name have the rest's."""
    t = _tel(spark, d).groupBy("id_alarme", "alarme").agg(F.count("*").alias("n"))
    return _families(t.select("id_alarme", F.lower(concepts.unaccented("alarme")).alias("x"), "n"))


@R.query()
def fuzzy_pairs(spark, d):
    """Pairs of similar concept names by matching blocks, found through shared characters, counted and put in one order."""
    t = _tel(spark, d).select(text_concept("alarme").alias("nome")).where("nome <> ''").distinct()
    return concepts.similar_pairs(t, "nome", 0.75)


@R.query("""
WITH c AS (SELECT id_alarme, alarme, count(*) AS n FROM tel GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id_alarme ORDER BY n DESC, alarme) AS k FROM c)
SELECT id_alarme, alarme, n FROM r WHERE k = 1""")
def best_label(spark, d):
    """The most frequent name of each id."""
    return quality.mode_per_group(_tel(spark, d), ["id_alarme"], "alarme")


@R.query("""
WITH l AS (SELECT date_trunc('week', data_evento) AS s, tag, count(*) AS n FROM tel GROUP BY 1, 2)
SELECT CAST(s AS DATE) AS semana, tag, n, CAST(sum(n) OVER (PARTITION BY tag ORDER BY s ROWS 3 PRECEDING) AS BIGINT) AS n4, n - lag(n) OVER (PARTITION BY tag ORDER BY s) AS mudanca FROM l""")
def weekly_trend(spark, d):
    """Weekly counts, their trailing sum and change."""
    l = _tel(spark, d).groupBy(F.to_date(F.date_trunc("week", TS)).alias("semana"), "tag").agg(F.count("*").alias("n"))
    w = Window.partitionBy("tag").orderBy("semana")
    return l.select("semana", "tag", "n", F.sum("n").over(w.rowsBetween(-3, 0)).alias("n4"), (F.col("n") - F.lag("n").over(w)).alias("mudanca"))
