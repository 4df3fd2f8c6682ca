"""Evaluation of scored samples as DataFrame algebra: no score ever leaves the cluster.

Scores are grouped before any window runs, so ties are one point of every curve. Rows with a null label or score are
left out. A rate with nothing to divide by is 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lavra.functions.stats import quantile
from lavra.operators.chained import with_running_sum


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def scored(df: DataFrame, label: str, score: str) -> DataFrame:
    return df.where(F.col(label).isNotNull() & F.col(score).isNotNull())


def outcome(label: str, predicted: Column) -> Column:
    """'TP', 'FP', 'FN' or 'TN'."""
    y = F.col(label) == 1
    return F.when(y & predicted, "TP").when(~y & predicted, "FP").when(y & ~predicted, "FN").otherwise("TN")


def counts(label: str, predicted: Column) -> list[Column]:
    o = outcome(label, predicted)
    return [F.count_if(o == k).alias(k.lower()) for k in ("TP", "FP", "FN", "TN")]


def rates(df: DataFrame) -> DataFrame:
    """Precision, recall, F1, F2 and balanced accuracy beside the columns tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, r, s = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    return df.withColumns({"precision": p, "recall": r, "f1": _ratio(2 * tp, 2 * tp + fp + fn), "f2": _ratio(5 * tp, 5 * tp + 4 * fn + fp), "balanced_accuracy": (r + s) / 2})


def at_threshold(df: DataFrame, label: str, score: str, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Counts and rates at one threshold (scores at it are positive), for each group."""
    return rates(scored(df, label, score).groupBy(*by).agg(*counts(label, F.col(score) >= threshold)))


def _thresholds_reached(score: Column, grid: Sequence[float], lo: int, hi: int) -> Column:
    """How many of the sorted thresholds a score reaches, given that it is lo to hi: a binary search as nested cases."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(score >= grid[mid], _thresholds_reached(score, grid, mid + 1, hi)).otherwise(_thresholds_reached(score, grid, lo, mid))


def sweep(df: DataFrame, label: str, score: str, thresholds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Counts and rates at every threshold in one pass: scores fall between thresholds, counts are summed from above.

    The rows are reduced to groups x thresholds before anything is summed.
    """
    by, grid = list(by), sorted(thresholds)
    slot = _thresholds_reached(F.col(score), grid, 0, len(grid))
    per = scored(df, label, score).groupBy(*by, slot.alias("_slot")).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count("*").alias("_n"))
    # Every slot up to a row's own: the row is positive at those thresholds.
    totals = per.groupBy(*by).agg(F.sum("_p").alias("_tp"), F.sum("_n").alias("_tn"))
    lifted = per.where("_slot > 0").select(*by, "_p", "_n", F.explode(F.sequence(F.lit(1), F.col("_slot"))).alias("_k"))
    sums = lifted.groupBy(*by, "_k").agg(F.sum("_p").alias("tp"), F.sum("_n").alias("pos"))
    frame = totals.select(*by, "_tp", "_tn", F.explode(F.sequence(F.lit(1), F.lit(len(grid)))).alias("_k"))
    full = frame.join(sums, [*by, "_k"], "left").na.fill(0, ["tp", "pos"])
    full = full.withColumn("threshold", F.get(F.lit([float(t) for t in grid]), F.col("_k") - 1))
    out = full.select(*by, "threshold", "tp", (F.col("pos") - F.col("tp")).alias("fp"), (F.col("_tp") - F.col("tp")).alias("fn"), (F.col("_tn") - F.col("_tp") - F.col("pos") + F.col("tp")).alias("tn"))
    return rates(out)


def best(curve: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in the given order (for instance F2, precision and threshold, descending)."""
    w = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    return curve.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


SCORE_BLOCKS = 4096


def _points(df: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    """Positives and others of each distinct score, with those at or above it: sums run within blocks of the score's
    range and from block to block, so no task holds all scores of a group. Scores are probabilities."""
    per = scored(df, label, score).groupBy(*by, (-F.col(score)).alias("_o")).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) != 1).alias("_q"))
    per = per.withColumn("_blk", F.floor(F.col("_o") * SCORE_BLOCKS)).withColumn("_n", F.col("_p") + F.col("_q"))
    per = with_running_sum(per, list(by), "_blk", ["_o"], "_p", "_tp")
    return with_running_sum(per, list(by), "_blk", ["_o"], "_n", "_k")


def average_precision(df: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    """Sum over the scores, from the highest, of the recall each adds times the precision reached with it."""
    part = F.sum(F.col("_p") * F.col("_tp") / F.col("_k"))
    return _points(df, label, score, by).groupBy(*by).agg(_ratio(part, F.sum("_p")).alias("average_precision"), F.sum("_p").alias("positives"))


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    """The chance that a positive scores above a negative, ties counting half; null for a single class."""
    u = F.sum(F.col("_q") * (F.col("_tp") - F.col("_p") / 2))
    return _points(df, label, score, by).groupBy(*by).agg(F.try_divide(u, (F.sum("_p") * F.sum("_q")).cast("double")).alias("roc_auc"))


def brier_logloss(df: DataFrame, label: str, score: str, by: Sequence[str], eps: float = 1e-15) -> DataFrame:
    y, p = (F.col(label) == 1).cast("double"), F.col(score)
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return scored(df, label, score).groupBy(*by).agg(F.avg((p - y) * (p - y)).alias("brier"), F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("logloss"), F.count("*").alias("n"))


def probability_bin(score: str, bins: int = 10) -> Column:
    """The right-closed bin of a probability, 0 in the lowest: (0, .1] is 0, (.1, .2] is 1."""
    return F.greatest(F.lit(0), F.ceil(F.round(F.col(score) * bins, 9)) - 1).cast("int")


def reliability(df: DataFrame, label: str, score: str, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Rows, mean score and observed rate of each bin."""
    return scored(df, label, score).groupBy(*by, probability_bin(score, bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg((F.col(label) == 1).cast("double")).alias("rate"))


def calibration_error(df: DataFrame, label: str, score: str, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """The mean distance of score and rate over the bins, weighted by their rows."""
    r = reliability(df, label, score, by, bins)
    return r.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("rate"))) / F.sum("n")).alias("ece"))


def segments(df: DataFrame, label: str, score: str, threshold: float, by: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """Per segment the rates at a threshold, its prevalence, false positive rate and 90th percentile of scores."""
    s = scored(df, label, score)
    extra = [F.avg((F.col(label) == 1).cast("double")).alias("prevalence"), quantile(score, 0.9, accuracy).alias("p90")]
    out = rates(s.groupBy(*by).agg(F.count("*").alias("n"), *counts(label, F.col(score) >= threshold), *extra))
    return out.withColumn("fpr", _ratio(F.col("fp"), F.col("fp") + F.col("tn")))


def robust_band(curve: DataFrame, by: Sequence[str], threshold: str, value: str, share: float = 0.95) -> DataFrame:
    """The thresholds whose mean value over the splits is at least ``share`` of the best mean, and whose worst is positive.

    ``curve`` has a row per split and threshold; the result has, per group, the band's ends and size and the best mean.
    """
    by = list(by)
    per = curve.groupBy(*by, threshold).agg(F.avg(value).alias("mean"), F.min(value).alias("worst"))
    top = F.max("mean").over(Window.partitionBy(*by))
    band = per.withColumn("top", top).where((F.col("mean") >= F.lit(share) * F.col("top")) & (F.col("worst") > 0))
    return band.groupBy(*by).agg(F.min(threshold).alias("from"), F.max(threshold).alias("to"), F.count("*").alias("thresholds"), F.max("top").alias("best_mean"), F.min("worst").alias("worst"))


def with_value(curve: DataFrame) -> DataFrame:
    """``value`` of curve points with the caller's unit values of hits and false alarms (tp_value, fp_value)."""
    return curve.withColumn("value", F.col("tp") * F.col("tp_value") + F.col("fp") * F.col("fp_value"))


def winner_counts(curve: DataFrame, scenario: str, model: str, value: str, threshold: str) -> DataFrame:
    """How many scenarios each model wins by its best threshold; of equals the higher threshold, then the smaller name."""
    tops = best(curve, [scenario, model], [F.desc(value), F.desc(threshold)])
    wins = best(tops, [scenario], [F.desc(value), F.col(model)])
    return wins.groupBy(model).agg(F.count("*").alias("wins"))


def against_reference(metrics: DataFrame, name: str, reference: str, columns: Sequence[str]) -> DataFrame:
    """Each row's metrics minus those of the reference row."""
    ref = metrics.where(F.col(name) == reference).select(*[F.col(c).alias(f"_r_{c}") for c in columns])
    row = ref.first()
    return metrics.select(name, *[(F.col(c) - F.lit(None if row is None else row[f"_r_{c}"])).alias(f"d_{c}") for c in columns])


def with_and_without(df: DataFrame, flag: Column, value: str, trim: float | None = None, accuracy: int | None = None) -> DataFrame:
    """Median, 90th percentile and count of a value with and without a flag, and the difference of the medians.

    ``trim`` leaves out values above that quantile of all.
    """
    rows = df.where(F.col(value).isNotNull())
    if trim is not None:
        rows = rows.where(F.col(value) <= F.lit(rows.agg(quantile(value, trim, accuracy)).first()[0]))
    a, b = F.when(flag, F.col(value)), F.when(~flag, F.col(value))
    out = rows.agg(*[f.alias(n) for c, s in ((a, "with"), (b, "without")) for f, n in ((F.count(c), f"n_{s}"), (quantile(c, 0.5, accuracy), f"median_{s}"), (quantile(c, 0.9, accuracy), f"p90_{s}"))])
    return out.withColumn("delta", F.col("median_with") - F.col("median_without"))
