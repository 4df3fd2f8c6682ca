"""Bins, grids, samples, sliding features, targets, splits, vocabularies and encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lavra.functions.text import plain_key
from lavra.functions.time import bucket_start
from lavra.operators import concepts, encoding, grid
from lavra.plans.names_sql import BARE
from lavra.plans.registry import Registry
from lavra.sources import read_table

R = Registry()
BIN = 8 * 3600
OUTAGES = [("2025-02-10 00:00:00", "2025-02-11 00:00:00"), ("2025-02-20 12:00:00", "2025-02-20 13:00:00")]


def _tel(spark, d):
    """Events by plain tag."""
    t = read_table(spark, d, "tel")
    return t.select(plain_key("tag").alias("tag"), "data_evento", "id_alarme", "id_criticidade", "valor", "is_dont_go", "id_eventos_telemetria")


def _bins(spark, d):
    aggs = [F.count("*").alias("n"), F.count_if(F.col("is_dont_go") == 1).alias("dont_go"), F.count_if(F.col("id_criticidade") == 1).alias("criticos")]
    return grid.tumbling(_tel(spark, d), "tag", "data_evento", BIN, aggs)


_T = """t AS (SELECT nullif(upper(regexp_replace(tag, '[^\\p{L}\\p{N}]', '', 'g')), '') AS tag, data_evento, id_alarme, id_criticidade, valor, is_dont_go FROM tel)"""
_B = f"""{_T}, b AS (SELECT tag, time_bucket(INTERVAL '8 hours', data_evento) AS bin, count(*) AS n, count(*) FILTER (WHERE is_dont_go = 1) AS dont_go, count(*) FILTER (WHERE id_criticidade = 1) AS criticos FROM t GROUP BY 1, 2)"""
_D = f"""{_B}, sp AS (SELECT tag, min(bin) AS lo, max(bin) AS hi FROM b GROUP BY 1), gr AS (SELECT tag, CAST(unnest(generate_series(lo, hi, INTERVAL 8 HOUR)) AS TIMESTAMP) AS bin FROM sp),
dn AS (SELECT tag, bin, coalesce(n, 0) AS n, coalesce(dont_go, 0) AS dont_go, coalesce(criticos, 0) AS criticos FROM gr LEFT JOIN b USING (tag, bin))"""


@R.query(f"WITH {_B} SELECT * FROM b")
def tumbling_bins(spark, d):
    """Counts by tag and 8 hours."""
    return _bins(spark, d)


@R.query(f"WITH {_D} SELECT * FROM dn")
def dense_bins(spark, d):
    """The same on a grid without holes."""
    return grid.dense(_bins(spark, d), "tag", BIN, ["n", "dont_go", "criticos"])


@R.query(f"""WITH {_D}, r AS (SELECT tag, bin, n, row_number() OVER w AS rn, CAST(sum(n) OVER (PARTITION BY tag ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS BIGINT) AS n_sum_3,
  round(avg(n) OVER (PARTITION BY tag ORDER BY bin ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING), 9) AS n_mean_9, max(n) OVER (PARTITION BY tag ORDER BY bin ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING) AS n_max_9
  FROM dn WINDOW w AS (PARTITION BY tag ORDER BY bin)) SELECT * EXCLUDE (rn) FROM r WHERE rn > 1""")
def rolling_24h_72h(spark, d):
    """Sums, means and largest of the last 3 and 9 bins, shifted by one against leaks."""
    out = grid.trailing(grid.dense(_bins(spark, d), "tag", BIN, ["n", "dont_go", "criticos"]), "tag", ["n"], [3, 9])
    return out.select("tag", "bin", "n", "n_sum_3", F.round("n_mean_9", 9).alias("n_mean_9"), "n_max_9")


@R.query(f"WITH {_D} SELECT tag, bin, round(coalesce(n / nullif(avg(n) OVER (PARTITION BY tag ORDER BY bin ROWS 8 PRECEDING), 0), 0), 9) AS n_accel FROM dn")
def acceleration(spark, d):
    """A bin against the mean of its last nine."""
    out = grid.acceleration(grid.dense(_bins(spark, d), "tag", BIN, ["n", "dont_go", "criticos"]), "tag", "n", 9)
    return out.select("tag", "bin", F.round("n_accel", 9).alias("n_accel"))


@R.query(f"""WITH {_D}, l AS (SELECT tag, bin, coalesce(lag(n, 1) OVER w, 0) AS n_b0, coalesce(lag(n, 2) OVER w, 0) AS n_b1, coalesce(lag(n, 3) OVER w, 0) AS n_b2 FROM dn WINDOW w AS (PARTITION BY tag ORDER BY bin))
SELECT *, n_b0 - n_b2 AS n_delta, round(n_b0 / (n_b0 + n_b1 + n_b2 + 1)::DOUBLE, 9) AS n_ratio FROM l""")
def multi_window_buckets(spark, d):
    """The last three bins apart, their change and the recent share."""
    out = grid.recency_buckets(grid.dense(_bins(spark, d), "tag", BIN, ["n", "dont_go", "criticos"]), "tag", ["n"])
    return out.select("tag", "bin", "n_b0", "n_b1", "n_b2", "n_delta", F.round("n_ratio", 9).alias("n_ratio"))


_S = f"""{_B}, tg AS (SELECT DISTINCT tag FROM t WHERE tag IS NOT NULL), sp AS (SELECT time_bucket(INTERVAL '8 hours', min(data_evento)) AS lo, time_bucket(INTERVAL '8 hours', max(data_evento)) AS hi FROM tel),
s AS (SELECT tag, CAST(p - INTERVAL 24 HOUR AS TIMESTAMP) AS feature_start, CAST(p AS TIMESTAMP) AS prediction_time, CAST(p + INTERVAL 8 HOUR AS TIMESTAMP) AS target_end FROM tg, (SELECT unnest(generate_series(lo + INTERVAL 24 HOUR, hi, INTERVAL 8 HOUR)) AS p FROM sp))"""


def _samples(spark, d):
    return grid.sample_grid_of_span(_tel(spark, d), "tag", "data_evento", BIN, 24 * 3600, BIN)


@R.query(f"WITH {_S} SELECT *, row_number() OVER (ORDER BY prediction_time, tag) AS sample_id FROM s")
def sample_grid(spark, d):
    """Every tag at every 8 hours of the span of the table, with the span observed and the horizon, numbered in order."""
    return grid.with_sample_ids(_samples(spark, d), "tag")


@R.query(f"""WITH {_S} SELECT s.*, CAST(coalesce(sum(n), 0) AS BIGINT) AS n, CAST(coalesce(sum(criticos), 0) AS BIGINT) AS criticos FROM s LEFT JOIN b ON b.tag = s.tag AND b.bin >= feature_start AND b.bin < prediction_time GROUP BY ALL""")
def sliding_features(spark, d):
    """Counts over the 24 hours before each sample, by an equality join of lifted bins."""
    return grid.sliding(_samples(spark, d), _bins(spark, d), "tag", BIN, 24 * 3600, ["n", "criticos"])


@R.query(f"""WITH {_S} SELECT s.*, CAST(EXISTS (SELECT 1 FROM t WHERE t.tag = s.tag AND is_dont_go = 1 AND data_evento >= prediction_time AND data_evento < target_end) AS INTEGER) AS target FROM s""")
def target_horizon(spark, d):
    """Whether a flagged event starts in the horizon."""
    return grid.horizon_target(_samples(spark, d), _tel(spark, d).where("is_dont_go = 1"), "tag", "data_evento", BIN, BIN)


@R.query(f"WITH {_S} SELECT s.*, NOT (" + " OR ".join(f"(feature_start < TIMESTAMP '{b}' AND target_end > TIMESTAMP '{a}')" for a, b in OUTAGES) + ") AS valid FROM s")
def gap_invalidation(spark, d):
    """Samples whose span touches an outage."""
    return grid.outside(_samples(spark, d), OUTAGES)


@R.query("""SELECT CASE WHEN prediction_time < TIMESTAMP '2025-03-01' THEN 'treino' WHEN prediction_time < TIMESTAMP '2025-05-01' THEN 'validacao' ELSE 'teste' END AS split, count(*) AS n, CAST(sum(target) AS BIGINT) AS positivos, min(prediction_time) AS de, max(prediction_time) AS ate FROM predictions GROUP BY 1""")
def chronological_split(spark, d):
    """Splits in order of time."""
    t = grid.chronological_split(read_table(spark, d, "predictions"), "prediction_time", [("treino", "2025-03-01"), ("validacao", "2025-05-01")], "teste")
    return t.groupBy("split").agg(F.count("*").alias("n"), F.sum("target").alias("positivos"), F.min("prediction_time").alias("de"), F.max("prediction_time").alias("ate"))


@R.query("""SELECT origin, CASE WHEN prediction_time < origin THEN 'train' ELSE 'test' END AS split, count(*) AS n FROM predictions, (VALUES (TIMESTAMP '2025-03-01'), (TIMESTAMP '2025-04-01'), (TIMESTAMP '2025-05-01')) v(origin)
WHERE prediction_time < origin + INTERVAL 30 DAY GROUP BY 1, 2""")
def rolling_origin_splits(spark, d):
    """Each origin trains on what lies before it and tests on the 30 days after (C8, ML7)."""
    t = grid.rolling_origins(read_table(spark, d, "predictions"), "prediction_time", ["2025-03-01", "2025-04-01", "2025-05-01"], "30 DAYS")
    return t.groupBy("origin", "split").agg(F.count("*").alias("n"))


_CUT = "2025-04-01"


@R.query(f"SELECT id_alarme, count(*) AS n FROM tel WHERE data_evento < TIMESTAMP '{_CUT}' GROUP BY 1 ORDER BY n DESC, id_alarme LIMIT 25")
def topk_vocabulary(spark, d):
    """The 25 most frequent alarms before the cut (O6); the limit is the feature."""
    t = _tel(spark, d).where(F.col("data_evento") < F.expr(f"timestamp_ntz'{_CUT}'"))
    return t.groupBy("id_alarme").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id_alarme").limit(25)


VOCABULARY = 200


@R.query(f"""WITH {_T}, v AS (SELECT id_alarme, row_number() OVER (ORDER BY count(*) DESC, id_alarme) - 1 AS k FROM t WHERE data_evento < TIMESTAMP '{_CUT}' AND id_alarme IS NOT NULL GROUP BY 1 QUALIFY k < {VOCABULARY}),
c AS (SELECT tag, time_bucket(INTERVAL '8 hours', data_evento) AS bin, k, count(*) AS n FROM t LEFT JOIN v USING (id_alarme) WHERE tag IS NOT NULL GROUP BY 1, 2, 3)
SELECT tag, bin, """ + ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE k = {i}), 0) AS BIGINT) AS alarm_{i}" for i in range(VOCABULARY)) + " FROM c GROUP BY 1, 2")
def topk_vocab_pivot(spark, d):
    """Counts by bin of the 200 alarms of a training vocabulary (C9, A8); the limit is the feature. Counted long, then turned."""
    t = _tel(spark, d)
    words = encoding.vocabulary(t.where("id_alarme IS NOT NULL"), "id_alarme", VOCABULARY, F.col("data_evento") < F.expr(f"timestamp_ntz'{_CUT}'"))
    place = F.create_map(*[F.lit(x) for i, w in enumerate(words) for x in (w, i)])[F.col("id_alarme")] if words else F.lit(None).cast("int")
    long = t.where("tag IS NOT NULL").groupBy("tag", bucket_start("data_evento", BIN).alias("bin"), place.alias("k")).agg(F.count("*").alias("n"))
    wide = long.groupBy("tag", "bin").pivot("k", list(range(VOCABULARY))).agg(F.sum("n"))
    return wide.select("tag", "bin", *[F.coalesce(F.col(f"`{i}`"), F.lit(0)).alias(f"alarm_{i}") for i in range(VOCABULARY)])


@R.query("SELECT sample_id, CASE WHEN tipo = 'Caminhao' THEN 1 ELSE 0 END AS tipo_0, CASE WHEN tipo = 'Escavadeira' THEN 1 ELSE 0 END AS tipo_1 FROM predictions")
def onehot(spark, d):
    """One column of 0 and 1 per level (M7)."""
    return encoding.one_hot(read_table(spark, d, "predictions"), "tipo", ["Caminhao", "Escavadeira"], "tipo_").select("sample_id", "tipo_0", "tipo_1")


@R.query("""WITH m AS (SELECT tag, avg(target) AS m FROM predictions WHERE periodo = 'treino' GROUP BY 1), g AS (SELECT avg(target) AS g FROM predictions WHERE periodo = 'treino')
SELECT sample_id, round(coalesce(m, g), 9) AS encoded FROM predictions LEFT JOIN m USING (tag), g""")
def target_encoding(spark, d):
    """The training mean of the target by category."""
    t = encoding.target_mean(read_table(spark, d, "predictions"), "tag", "target", F.col("periodo") == "treino")
    return t.select("sample_id", F.round("encoded", 9).alias("encoded"))


@R.query("""SELECT sample_id, round(sin(hour(prediction_time) * 2 * pi() / 24), 9) AS hour_sin, round(cos(hour(prediction_time) * 2 * pi() / 24), 9) AS hour_cos,
  round(sin((isodow(prediction_time) - 1) * 2 * pi() / 7), 9) AS day_sin, round(cos((isodow(prediction_time) - 1) * 2 * pi() / 7), 9) AS day_cos FROM predictions""")
def cyclic_time(spark, d):
    """Cyclic hour and weekday."""
    t = encoding.cyclic(read_table(spark, d, "predictions"), "prediction_time")
    return t.select("sample_id", *[F.round(c, 9).alias(c) for c in ("hour_sin", "hour_cos", "day_sin", "day_cos")])


def _before_positives(t, samples):
    pos = grid.horizon_target(samples, t.where("is_dont_go = 1"), "tag", "data_evento", BIN, BIN).where("target = 1").select("tag", "prediction_time")
    bins = t.where("tag IS NOT NULL AND data_evento IS NOT NULL").groupBy("tag", bucket_start("data_evento", BIN).alias("bin"), "id_alarme").agg(F.count("*").alias("n"))
    lifted = bins.select("tag", "id_alarme", "n", F.explode(F.array(*[F.col("bin") + F.expr(f"INTERVAL {BIN * k} SECONDS") for k in (1, 2, 3)])).alias("prediction_time"))
    return pos.join(lifted, ["tag", "prediction_time"]).groupBy("tag", "prediction_time", "id_alarme").agg(F.sum("n").alias("n"))


@R.query(f"""WITH {_S}, f AS (SELECT s.tag, s.prediction_time FROM s WHERE EXISTS (SELECT 1 FROM t WHERE t.tag = s.tag AND is_dont_go = 1 AND data_evento >= prediction_time AND data_evento < target_end))
SELECT f.tag, f.prediction_time, t.id_alarme, count(*) AS n FROM f JOIN t ON t.tag = f.tag AND t.data_evento >= f.prediction_time - INTERVAL 24 HOUR AND t.data_evento < f.prediction_time GROUP BY ALL""")
def error_context(spark, d):
    """What alarms the spans before positive samples hold: events lifted to the samples they serve (C24 in part; `error_sessions` has the rest)."""
    return _before_positives(_tel(spark, d), _samples(spark, d))


FAMILIES = [("freio", ["freio", "brake"]), ("motor", ["motor", "turbo", "fuel"]), ("hidraulica", ["hidraul", "hydraul"])]
_FAM = "CASE WHEN contains(x, 'freio') OR contains(x, 'brake') THEN 'freio' WHEN contains(x, 'motor') OR contains(x, 'turbo') OR contains(x, 'fuel') THEN 'motor' WHEN contains(x, 'hidraul') OR contains(x, 'hydraul') THEN 'hidraulica' END"


def _active(t):
    names = [n for n, _ in FAMILIES]
    bins = grid.tumbling(t, "tag", "data_evento", BIN, [F.count_if(F.col("f") == n).alias(n) for n in names])
    full = grid.dense(bins, "tag", BIN, names).withColumn("juntas", sum((F.when(F.col(n) > 0, 1).otherwise(0) for n in names), F.lit(0)))
    out = grid.trailing(full, "tag", [*names, "juntas"], [1, 3, 9])
    return out.select("tag", "bin", *[f"{n}_sum_{w}" for n in names for w in (3, 9)], F.col("juntas_sum_1").cast("int").alias("juntas"))


@R.query(f"""WITH {BARE}, t AS (SELECT nullif(upper(regexp_replace(tag, '[^\\p{{L}}\\p{{N}}]', '', 'g')), '') AS tag, data_evento, lower(cru_solto) AS x FROM tel LEFT JOIN bare USING (alarme)),
b AS (SELECT tag, time_bucket(INTERVAL '8 hours', data_evento) AS bin, """ + ", ".join(f"count(*) FILTER (WHERE f = '{n}') AS {n}" for n, _ in FAMILIES) + f""" FROM (SELECT *, {_FAM} AS f FROM t) GROUP BY 1, 2),
sp AS (SELECT tag, min(bin) AS lo, max(bin) AS hi FROM b GROUP BY 1), gr AS (SELECT tag, CAST(unnest(generate_series(lo, hi, INTERVAL 8 HOUR)) AS TIMESTAMP) AS bin FROM sp),
dn AS (SELECT tag, bin, """ + ", ".join(f"coalesce({n}, 0) AS {n}" for n, _ in FAMILIES) + """ FROM gr LEFT JOIN b USING (tag, bin)),
r AS (SELECT tag, bin, row_number() OVER w AS rn, """ + ", ".join(f"CAST(sum({n}) OVER (PARTITION BY tag ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS BIGINT) AS {n}_sum_3, CAST(sum({n}) OVER (PARTITION BY tag ORDER BY bin ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING) AS BIGINT) AS {n}_sum_9" for n, _ in FAMILIES) + ", " + " + ".join(f"lag(CAST({n} > 0 AS INTEGER)) OVER w" for n, _ in FAMILIES) + """ AS juntas
  FROM dn WINDOW w AS (PARTITION BY tag ORDER BY bin)) SELECT * EXCLUDE (rn) FROM r WHERE rn > 1""")
def family_activity(spark, d):
    """Counts by family and 8 hours, their last 24 and 72 hours, and how many families were active at once, seen from before; rows without a name belong to no family."""
    t = read_table(spark, d, "tel").select(plain_key("tag").alias("tag"), "data_evento", "alarme")
    f = concepts.by_rules(F.lower(concepts.unaccented("alarme")), FAMILIES, "")
    named = t.select("alarme").distinct().select("alarme", f.alias("f")).where("f <> ''")
    return _active(t.join(named, "alarme", "left"))


_EXPERIMENTS = [(obs, hor) for obs in (8, 24) for hor in (8, 24)]


def _experiments(spark, d, samples):
    t, bins = _tel(spark, d), _bins(spark, d)
    out = None
    for obs, hor in _EXPERIMENTS:
        s = grid.sliding(samples(t, obs * 3600, hor * 3600), bins, "tag", BIN, obs * 3600, ["n"])
        s = grid.horizon_target(s, t.where("is_dont_go = 1"), "tag", "data_evento", BIN, hor * 3600)
        row = s.agg(F.lit(obs).alias("observa"), F.lit(hor).alias("horizonte"), F.count("*").alias("amostras"), F.count_if(F.col("target") == 1).alias("positivas"), F.count_if(F.col("n") > 0).alias("com_eventos"))
        out = row if out is None else out.unionByName(row)
    return out


@R.query(f"WITH {_B}, tg AS (SELECT DISTINCT tag FROM t WHERE tag IS NOT NULL), fl AS (SELECT DISTINCT tag, data_evento FROM t WHERE is_dont_go = 1), e AS (SELECT * FROM (VALUES " + ", ".join(f"({o}, {h})" for o, h in _EXPERIMENTS) + """) v(observa, horizonte)),
sp AS (SELECT observa, horizonte, time_bucket(INTERVAL '8 hours', min(data_evento)) + INTERVAL 1 HOUR * observa AS lo, time_bucket(INTERVAL '8 hours', max(data_evento)) + INTERVAL 1 HOUR * (8 - horizonte) AS hi FROM tel, e GROUP BY 1, 2),
s AS (SELECT tag, observa, horizonte, CAST(p AS TIMESTAMP) AS prediction_time FROM tg, (SELECT observa, horizonte, unnest(generate_series(lo, hi, INTERVAL 8 HOUR)) AS p FROM sp)),
n AS (SELECT observa, horizonte, count(*) AS amostras FROM s GROUP BY 1, 2), po AS (SELECT observa, horizonte, count(*) AS positivas FROM (SELECT DISTINCT s.* FROM s JOIN fl ON fl.tag = s.tag AND fl.data_evento >= prediction_time AND fl.data_evento < prediction_time + INTERVAL 1 HOUR * horizonte) GROUP BY 1, 2),
co AS (SELECT observa, horizonte, count(*) AS com_eventos FROM (SELECT DISTINCT s.* FROM s JOIN b ON b.tag = s.tag AND b.bin >= prediction_time - INTERVAL 1 HOUR * observa AND b.bin < prediction_time) GROUP BY 1, 2)
SELECT CAST(observa AS INTEGER) AS observa, CAST(horizonte AS INTEGER) AS horizonte, amostras, coalesce(positivas, 0) AS positivas, coalesce(com_eventos, 0) AS com_eventos FROM n LEFT JOIN po USING (observa, horizonte) LEFT JOIN co USING (observa, horizonte)""")
def experiment_grid(spark, d):
    """Samples, positives and observed samples for every observation and horizon over the span of the table, each experiment with the first and last it has room for."""
    return _experiments(spark, d, lambda t, obs, hor: grid.sample_grid_of_span(t, "tag", "data_evento", BIN, obs, hor))
