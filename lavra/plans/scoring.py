"""Evaluation of scored samples: segments, thresholds, curves, calibration, values given by the caller."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lavra.operators import evaluation as ev
from lavra.operators.quality import top_per_group
from lavra.plans.registry import Registry
from lavra.sources import read_table

R = Registry()
THRESHOLDS = [round(0.01 + 0.005 * i, 3) for i in range(197)]
#: Unit values of a hit and of a false alarm by scenario; examples, not anybody's prices.
SCENARIOS = [("baixo", 3.0, -1.0), ("medio", 6.0, -1.0), ("alto", 12.0, -2.0)]


def _p(spark, d):
    return read_table(spark, d, "predictions")


def _rounded(df, *cols, places=9):
    return df.withColumns({c: F.round(c, places) for c in cols})


_S = "s AS (SELECT *, target = 1 AS y FROM predictions WHERE target IS NOT NULL AND probabilidade IS NOT NULL)"


def _counts(t: str) -> str:
    return f"count(*) FILTER (WHERE y AND probabilidade >= {t}) AS tp, count(*) FILTER (WHERE NOT y AND probabilidade >= {t}) AS fp, count(*) FILTER (WHERE y AND probabilidade < {t}) AS fn, count(*) FILTER (WHERE NOT y AND probabilidade < {t}) AS tn"


_RATES = """round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 9) AS f1,
  round(coalesce(5 * tp / nullif(5 * tp + 4 * fn + fp, 0)::DOUBLE, 0), 9) AS f2, round((coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) + coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0)) / 2, 9) AS balanced_accuracy"""
_RATE_COLS = ("precision", "recall", "f1", "f2", "balanced_accuracy")
_SWEEP = f"""{_S}, th AS (SELECT CAST(round(0.01 + 0.005 * i, 3) AS DOUBLE) AS threshold FROM range(197) r(i)),
c AS (SELECT periodo, threshold, {_counts('threshold')} FROM s, th GROUP BY 1, 2), w AS (SELECT *, {_RATES} FROM c)"""


@R.query(f"WITH {_S}, c AS (SELECT periodo, {_counts('0.3')} FROM s GROUP BY 1) SELECT *, {_RATES} FROM c")
def threshold_metrics(spark, d):
    """Confusion and rates at one threshold by period."""
    return _rounded(ev.at_threshold(_p(spark, d), "target", "probabilidade", 0.3, ["periodo"]), *_RATE_COLS)


@R.query("""SELECT sample_id, CASE WHEN target = 1 AND probabilidade >= 0.3 THEN 'TP' WHEN target <> 1 AND probabilidade >= 0.3 THEN 'FP' WHEN target = 1 THEN 'FN' ELSE 'TN' END AS resultado,
  abs(probabilidade - 0.3) <= 0.05 AS perto FROM predictions WHERE target IS NOT NULL AND probabilidade IS NOT NULL""")
def confusion_labels(spark, d):
    """The outcome of every sample and whether its score lies near the threshold."""
    s = ev.scored(_p(spark, d), "target", "probabilidade")
    return s.select("sample_id", ev.outcome("target", F.col("probabilidade") >= 0.3).alias("resultado"), (F.abs(F.col("probabilidade") - 0.3) <= 0.05).alias("perto"))


@R.query(f"""WITH {_S}, c AS (SELECT tipo, tag_frota, count(*) AS n, {_counts('0.3')}, round(avg(CAST(y AS DOUBLE)), 9) AS prevalence, round(quantile_cont(probabilidade, 0.9), 9) AS p90 FROM s GROUP BY 1, 2)
SELECT *, {_RATES}, round(coalesce(fp / nullif(fp + tn, 0)::DOUBLE, 0), 9) AS fpr FROM c""")
def confusion_segments(spark, d):
    """Rates, prevalence and high scores by segment."""
    return _rounded(ev.segments(_p(spark, d), "target", "probabilidade", 0.3, ["tipo", "tag_frota"]), *_RATE_COLS, "prevalence", "p90", "fpr")


@R.query(f"WITH {_SWEEP} SELECT * FROM w")
def threshold_sweep(spark, d):
    """Confusion and rates at 197 thresholds, from one pass and cumulative sums."""
    return _rounded(ev.sweep(_p(spark, d), "target", "probabilidade", THRESHOLDS, ["periodo"]), *_RATE_COLS)


@R.query(f"WITH {_SWEEP} SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY periodo ORDER BY f2 DESC, precision DESC, threshold DESC) = 1")
def best_threshold(spark, d):
    """The best threshold of each period by F2, precision and height."""
    curve = _rounded(ev.sweep(_p(spark, d), "target", "probabilidade", THRESHOLDS, ["periodo"]), *_RATE_COLS)
    return ev.best(curve, ["periodo"], [F.desc("f2"), F.desc("precision"), F.desc("threshold")])


@R.query(f"WITH {_SWEEP} SELECT periodo, threshold, f1 FROM w QUALIFY row_number() OVER (PARTITION BY periodo ORDER BY f1 DESC, threshold DESC) = 1")
def pr_optimal_threshold(spark, d):
    """The threshold of the best F1 (ML11)."""
    curve = _rounded(ev.sweep(_p(spark, d), "target", "probabilidade", THRESHOLDS, ["periodo"]), *_RATE_COLS)
    return ev.best(curve, ["periodo"], [F.desc("f1"), F.desc("threshold")]).select("periodo", "threshold", "f1")


@R.query(f"""WITH {_S}, g AS (SELECT periodo, probabilidade, count(*) FILTER (WHERE y) AS p, count(*) AS n FROM s GROUP BY 1, 2),
r AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS k FROM g WINDOW w AS (PARTITION BY periodo ORDER BY probabilidade DESC))
SELECT periodo, round(coalesce(sum(p * tp / k::DOUBLE) / nullif(sum(p), 0), 0), 9) AS average_precision, CAST(sum(p) AS BIGINT) AS positives FROM r GROUP BY 1""")
def avg_precision(spark, d):
    """Average precision by steps, tied scores one step."""
    return _rounded(ev.average_precision(_p(spark, d), "target", "probabilidade", ["periodo"]), "average_precision")


@R.query(f"""WITH {_S}, g AS (SELECT periodo, tag, probabilidade, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS q FROM s GROUP BY 1, 2, 3),
r AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY periodo, tag ORDER BY probabilidade DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM g)
SELECT periodo, tag, round(sum(q * (above + p / 2.0::DOUBLE)) / nullif(sum(p) * sum(q), 0), 9) AS roc_auc FROM r GROUP BY 1, 2""")
def roc_auc(spark, d):
    """ROC area by ranks, null where a segment has a single class (C27, ML12)."""
    return _rounded(ev.roc_auc(_p(spark, d), "target", "probabilidade", ["periodo", "tag"]), "roc_auc")


@R.query(f"""WITH {_S} SELECT periodo, round(avg((probabilidade - CAST(y AS INT)) * (probabilidade - CAST(y AS INT))), 9) AS brier,
  round(avg(-(CAST(y AS INT) * ln(greatest(1e-15, least(1 - 1e-15, probabilidade))) + (1 - CAST(y AS INT)) * ln(1 - greatest(1e-15, least(1 - 1e-15, probabilidade))))), 7) AS logloss, count(*) AS n FROM s GROUP BY 1""")
def brier_logloss(spark, d):
    """Brier score and log loss."""
    return ev.brier_logloss(_p(spark, d), "target", "probabilidade", ["periodo"]).withColumns({"brier": F.round("brier", 9), "logloss": F.round("logloss", 7)})


_BIN = "CAST(greatest(0, ceil(round(probabilidade * 10, 9)) - 1) AS INTEGER)"


@R.query(f"WITH {_S} SELECT periodo, {_BIN} AS bin, count(*) AS n, round(avg(probabilidade), 9) AS mean_score, round(avg(CAST(y AS DOUBLE)), 9) AS rate FROM s GROUP BY 1, 2")
def reliability(spark, d):
    """Mean score and observed rate in ten right-closed bins."""
    return _rounded(ev.reliability(_p(spark, d), "target", "probabilidade", ["periodo"]), "mean_score", "rate")


@R.query(f"""WITH {_S}, r AS (SELECT periodo, {_BIN} AS bin, count(*) AS n, avg(probabilidade) AS m, avg(CAST(y AS DOUBLE)) AS t FROM s GROUP BY 1, 2) SELECT periodo, round(sum(n * abs(m - t)) / sum(n), 9) AS ece FROM r GROUP BY 1""")
def ece(spark, d):
    """Expected calibration error."""
    return _rounded(ev.calibration_error(_p(spark, d), "target", "probabilidade", ["periodo"]), "ece")


_VALUES = ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE)" for n, a, b in SCENARIOS)


def _valued(spark, d):
    curve = ev.sweep(_p(spark, d), "target", "probabilidade", THRESHOLDS, ["periodo"])
    # Every curve point with every scenario: the scenarios ride along as an array, a handful of constants.
    all_values = F.array(*[F.struct(F.lit(n).alias("cenario"), F.lit(a).alias("tp_value"), F.lit(b).alias("fp_value")) for n, a, b in SCENARIOS])
    return ev.with_value(curve.select("*", F.inline(all_values)))


@R.query(f"WITH {_SWEEP}, v AS (SELECT w.*, x.cenario, tp * a + fp * b AS value FROM w, (VALUES {_VALUES}) x(cenario, a, b)) SELECT cenario, periodo, threshold, value FROM v")
def sensitivity_grid(spark, d):
    """The value of every threshold under every scenario of unit values."""
    return _valued(spark, d).select("cenario", "periodo", "threshold", "value")


@R.query(f"""WITH {_SWEEP}, v AS (SELECT x.cenario, periodo, threshold, tp * a + fp * b AS value FROM w, (VALUES {_VALUES}) x(cenario, a, b)), m AS (SELECT cenario, threshold, avg(value) AS mean, min(value) AS worst FROM v GROUP BY 1, 2),
k AS (SELECT *, max(mean) OVER (PARTITION BY cenario) AS top FROM m)
SELECT cenario, min(threshold) AS "from", max(threshold) AS "to", count(*) AS thresholds, round(max(top), 6) AS best_mean, min(worst) AS worst FROM k WHERE mean >= 0.95 * top AND worst > 0 GROUP BY 1""")
def robust_band(spark, d):
    """Thresholds near the best on average over the periods and never at a loss."""
    return _rounded(ev.robust_band(_valued(spark, d), ["cenario"], "threshold", "value"), "best_mean", places=6)


@R.query(f"""WITH {_SWEEP}, v AS (SELECT x.cenario, periodo, threshold, tp * a + fp * b AS value FROM w, (VALUES {_VALUES}) x(cenario, a, b)),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY cenario, periodo ORDER BY value DESC, threshold DESC) = 1)
SELECT cenario, periodo, threshold, value, CAST(row_number() OVER (PARTITION BY cenario ORDER BY value DESC, periodo) AS INTEGER) AS posicao FROM b""")
def policy_ranking(spark, d):
    """The best threshold of each period and its rank within the scenario."""
    b = ev.best(_valued(spark, d), ["cenario", "periodo"], [F.desc("value"), F.desc("threshold")])
    return b.select("cenario", "periodo", "threshold", "value", F.row_number().over(Window.partitionBy("cenario").orderBy(F.desc("value"), "periodo")).alias("posicao"))


@R.query(f"""WITH {_SWEEP}, v AS (SELECT x.cenario, periodo, threshold, tp * a + fp * b AS value FROM w, (VALUES {_VALUES}) x(cenario, a, b)),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY cenario, periodo ORDER BY value DESC, threshold DESC) = 1), t AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY cenario ORDER BY value DESC, periodo) = 1)
SELECT periodo, count(*) AS wins FROM t GROUP BY 1""")
def winner_counts(spark, d):
    """How many scenarios each candidate wins."""
    return ev.winner_counts(_valued(spark, d), "cenario", "periodo", "value", "threshold")


@R.query(f"""WITH {_S}, c AS (SELECT periodo, {_counts('0.3')} FROM s GROUP BY 1), w AS (SELECT *, {_RATES} FROM c), r AS (SELECT * FROM w WHERE periodo = 'validacao')
SELECT w.periodo, round(w.precision - r.precision, 9) AS d_precision, round(w.recall - r.recall, 9) AS d_recall, round(w.f2 - r.f2, 9) AS d_f2 FROM w, r""")
def reference_delta(spark, d):
    """Metrics against those of a reference row."""
    m = _rounded(ev.at_threshold(_p(spark, d), "target", "probabilidade", 0.3, ["periodo"]), *_RATE_COLS)
    return _rounded(ev.against_reference(m, "periodo", "validacao", ["precision", "recall", "f2"]), "d_precision", "d_recall", "d_f2")


@R.query("SELECT strftime(prediction_time, '%Y-%m') AS mes, tipo, count(*) AS n, CAST(sum(target) AS BIGINT) AS positivos FROM predictions GROUP BY 1, 2")
def monthly_positives(spark, d):
    """Positives by month and type."""
    return _p(spark, d).groupBy(F.date_format("prediction_time", "yyyy-MM").alias("mes"), "tipo").agg(F.count("*").alias("n"), F.sum("target").alias("positivos"))


@R.query("""WITH l AS (SELECT *, CASE WHEN target = 1 AND probabilidade >= 0.3 THEN 'TP' WHEN target <> 1 AND probabilidade >= 0.3 THEN 'FP' WHEN target = 1 THEN 'FN' ELSE 'TN' END AS o FROM predictions WHERE target IS NOT NULL AND probabilidade IS NOT NULL)
SELECT periodo, o AS resultado, sample_id, probabilidade, CAST(row_number() OVER (PARTITION BY periodo, o ORDER BY abs(probabilidade - 0.3) DESC, sample_id) AS INTEGER) AS rank FROM l QUALIFY row_number() OVER (PARTITION BY periodo, o ORDER BY abs(probabilidade - 0.3) DESC, sample_id) <= 3""")
def picked_cases(spark, d):
    """The clearest cases of each outcome (ML10, W12); the number per group is the feature."""
    s = ev.scored(_p(spark, d), "target", "probabilidade").withColumn("resultado", ev.outcome("target", F.col("probabilidade") >= 0.3))
    return top_per_group(s, ["periodo", "resultado"], [F.abs(F.col("probabilidade") - 0.3).desc(), F.col("sample_id")], 3).select("periodo", "resultado", "sample_id", "probabilidade", "rank")
