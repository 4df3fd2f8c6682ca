"""Models on scored samples, and streaming forms of the event pipelines. Models have no SQL; their rows are checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from lavra import streaming
from lavra.operators import encoding, models, quality
from lavra.plans.registry import Registry
from lavra.sources import read_table

R = Registry()
FEATURES = ["probabilidade", "hour_sin", "hour_cos", "day_sin", "day_cos", "tipo_0", "tipo_1"]


def _matrix(spark, d):
    """A small feature matrix from the scored samples, nulls filled."""
    t = encoding.cyclic(read_table(spark, d, "predictions"), "prediction_time")
    t = encoding.one_hot(t, "tipo", ["Caminhao", "Escavadeira"], "tipo_")
    return t.where("target IS NOT NULL").na.fill(0.0, ["probabilidade"]).withColumn("target", F.col("target").cast("double"))


@R.query("SELECT sample_id, round((SELECT avg(target) FROM predictions WHERE periodo = 'treino'), 9) AS score FROM predictions")
def dummy_prior(spark, d):
    """The training base rate as every sample's score (ML1)."""
    t = read_table(spark, d, "predictions")
    return t.select("sample_id", F.round(models.prior(t.where("periodo = 'treino'"), "target"), 9).alias("score"))


@R.query("SELECT tag, count(DISTINCT target) < 2 AS uma_classe FROM predictions WHERE target IS NOT NULL GROUP BY 1")
def single_class_guard(spark, d):
    """Segments in which nothing can be learned (ML12)."""
    return read_table(spark, d, "predictions").where("target IS NOT NULL").groupBy("tag").agg((F.count_distinct("target") < 2).alias("uma_classe"))


@R.query("""WITH t AS (SELECT * FROM predictions WHERE target IS NOT NULL), c AS (SELECT count(*) AS n, sum(target) AS p FROM t)
SELECT target, count(*) AS linhas, round(sum(CASE WHEN target = 1 THEN n / (2.0::DOUBLE * greatest(p, 1)) ELSE n / (2.0::DOUBLE * greatest(n - p, 1)) END), 6) AS peso FROM t, c GROUP BY 1""")
def class_weights(spark, d):
    """Weights that balance the classes (ML5)."""
    t = models.balanced_weight(read_table(spark, d, "predictions").where("target IS NOT NULL"), "target")
    return t.groupBy("target").agg(F.count("*").alias("linhas"), F.round(F.sum("weight"), 6).alias("peso"))


def _split(m):
    """Training, calibration and remaining rows. Models of a single class aren't fitted: their queries give no rows."""
    return m.where("periodo = 'treino'"), m.where("periodo = 'calibracao'"), m.where("periodo IN ('validacao', 'teste')")


@R.query()
def forest_scores(spark, d):
    """A weighted random forest trained on the first period (ML2)."""
    train, _, rest = _split(_matrix(spark, d))
    if models.single_class(train, "target"):
        return spark.createDataFrame([], "sample_id long, periodo string, target double, score double")
    model = models.forest(FEATURES, "target", trees=20, depth=5, weight="weight").fit(models.balanced_weight(train, "target"))
    return models.score(model, rest).select("sample_id", "periodo", "target", "score")


@R.query()
def calibrated_scores(spark, d):
    """Boosted trees with logistic and monotone calibration on the period between (ML3, ML6)."""
    train, cal, rest = _split(_matrix(spark, d))
    if models.single_class(train, "target"):
        return spark.createDataFrame([], "sample_id long, periodo string, target double, score double, score_platt double, score_isotonic double")
    model = models.boosted(FEATURES, "target", rounds=5, depth=3).fit(train)
    cal = models.score(model, cal)
    out = models.isotonic(cal, "target", "score")(models.platt(cal, "target", "score")(models.score(model, rest)))
    return out.select("sample_id", "periodo", "target", "score", "score_platt", "score_isotonic")


@R.query()
def forest_importances(spark, d):
    """Feature importances (ML8)."""
    train, _, _ = _split(_matrix(spark, d))
    if models.single_class(train, "target"):
        return spark.createDataFrame([], "feature string, importance double")
    return spark.createDataFrame(models.importances(models.forest(FEATURES, "target", trees=20, depth=5).fit(train), FEATURES), "feature string, importance double")


@R.query()
def permutation_importances(spark, d):
    """The fall of average precision when a feature is dealt anew (ML9)."""
    train, _, rest = _split(_matrix(spark, d))
    if models.single_class(train, "target"):
        return spark.createDataFrame([], "feature string, fall double")
    model = models.forest(FEATURES, "target", trees=10, depth=4).fit(train)
    return spark.createDataFrame(models.permutation_importances(model, rest, FEATURES, "target"), "feature string, fall double")


@R.query("""WITH m AS (SELECT id_alarme, median(valor) AS med FROM tel WHERE valor IS NOT NULL GROUP BY 1), o AS (SELECT t.*, med FROM tel t LEFT JOIN m USING (id_alarme)),
a AS (SELECT id_alarme, median(abs(valor - med)) AS mad FROM o WHERE valor IS NOT NULL GROUP BY 1)
SELECT id_eventos_telemetria AS id, round((valor - med) / greatest(mad, 1.0), 6) AS z FROM o LEFT JOIN a USING (id_alarme) WHERE abs((valor - med) / greatest(mad, 1.0)) > 50""")
def robust_outliers(spark, d):
    """Values far from their alarm's median (ML4's stand-in)."""
    t = quality.robust_scores(read_table(spark, d, "tel").select("id_eventos_telemetria", "id_alarme", "valor"), ["id_alarme"], "valor")
    return t.where(F.abs("z") > 50).select(F.col("id_eventos_telemetria").alias("id"), F.round("z", 6).alias("z"))


@R.query()
def time_ordered_search(spark, d):
    """Candidates compared over rolling origins (ML7, C34)."""
    c = {"raso": models.forest(FEATURES, "target", trees=10, depth=2), "fundo": models.forest(FEATURES, "target", trees=10, depth=6)}
    return spark.createDataFrame(models.time_ordered_search(_matrix(spark, d), "prediction_time", "target", ["2025-03-15", "2025-05-01"], "30 DAYS", c), "candidate string, average_precision double")


# Streams


@R.query("SELECT tag, CAST(time_bucket(INTERVAL '8 hours', data_evento) AS TIMESTAMP) AS start, count(*) AS n FROM tel GROUP BY 1, 2")
def stream_tumbling(spark, d):
    """Tumbling windows over the event stream (C4 as a stream)."""
    s = streaming.windowed(streaming.read_stream(spark, d, "tel"), "data_evento", ["tag"], "8 hours", None, {"n": F.count("*")})
    out = streaming.run_available(s, "tumbling", "update", keys=["tag", "start", "end"])
    return out.select("tag", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@R.query("""SELECT tag, CAST(b + INTERVAL 8 HOUR * k AS TIMESTAMP) AS "end", count(*) AS n FROM (SELECT tag, time_bucket(INTERVAL '8 hours', data_evento) AS b FROM tel WHERE is_dont_go = 1), (VALUES (1), (2), (3)) v(k) GROUP BY 1, 2""")
def stream_sliding(spark, d):
    """24-hour windows every 8 hours over flagged events (C6 as a stream)."""
    s = streaming.windowed(streaming.read_stream(spark, d, "tel").where("is_dont_go = 1"), "data_evento", ["tag"], "24 hours", "8 hours", {"n": F.count("*")})
    return streaming.run_available(s, "sliding", "update", keys=["tag", "start", "end"]).select("tag", F.col("end").cast("timestamp_ntz").alias("end"), "n")


@R.query("""
WITH o AS (SELECT user_id, ts, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts) AS gap FROM events),
n AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 28800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM n GROUP BY user_id, s""")
def stream_sessions(spark, d):
    """Session windows with a gap of 8 hours (C2 as a stream)."""
    source = streaming.read_stream(spark, d, "events").select("user_id", "ts")
    out = streaming.run_closed(source, "ts", "sessions", lambda s: streaming.sessions(s, "ts", ["user_id"], "8 hours"))
    return out.select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


@R.query("SELECT DISTINCT data_evento, tag, id_alarme FROM tel")
def stream_dedup(spark, d):
    """Copies dropped within the watermark (C1 as a stream)."""
    s = streaming.deduplicated(streaming.read_stream(spark, d, "tel"), "data_evento", ["data_evento", "tag", "id_alarme"])
    out = streaming.run_available(s.select("data_evento", "tag", "id_alarme"), "dedup")
    return out.withColumn("data_evento", F.col("data_evento").cast("timestamp_ntz"))


@R.query("SELECT t.id_eventos_telemetria AS id, a.classe FROM tel t LEFT JOIN apontamentos a ON a.tag = t.tag AND t.data_evento >= a.inicio AND t.data_evento < a.fim WHERE t.is_dont_go = 1")
def stream_enriched(spark, d):
    """A stream of flagged events joined with static states (J5 as a stream)."""
    ap = read_table(spark, d, "apontamentos").select("tag", "inicio", "fim", F.col("classe").alias("estado"))
    s = streaming.enriched(streaming.read_stream(spark, d, "tel").where("is_dont_go = 1"), ap, "tag", "data_evento", "inicio", "fim", ["estado"])
    return streaming.run_available(s.select(F.col("id_eventos_telemetria").alias("id"), F.col("estado").alias("classe")), "enriched")
