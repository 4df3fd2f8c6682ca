"""Classifiers, calibration and their selection on pyspark.ml, trained and applied on the cluster."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lavra.operators.evaluation import average_precision
from lavra.session import staged


def single_class(df: DataFrame, label: str) -> bool:
    """Whether the labels are all alike (or missing), so that nothing can be learned."""
    return df.where(F.col(label).isNotNull()).select(label).distinct().count() < 2


def prior(train: DataFrame, label: str) -> Column:
    """The base rate of the training rows as a constant score."""
    return F.lit(train.agg(F.avg(F.col(label).cast("double"))).first()[0])


def balanced_weight(df: DataFrame, label: str, name: str = "weight", boost: Column | None = None) -> DataFrame:
    """A weight that gives both classes the same total; ``boost`` multiplies it."""
    n, pos = df.agg(F.count("*"), F.count_if(F.col(label) == 1)).first()
    w = F.when(F.col(label) == 1, F.lit(n / (2.0 * max(pos, 1)))).otherwise(F.lit(n / (2.0 * max(n - pos, 1))))
    return df.withColumn(name, w if boost is None else w * boost)


def forest(features: Sequence[str], label: str, trees: int = 50, depth: int = 8, weight: str | None = None, seed: int = 42) -> Pipeline:
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", minInstancesPerNode=2, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"), rf if weight is None else rf.setWeightCol(weight)])


def boosted(features: Sequence[str], label: str, rounds: int = 20, depth: int = 4, weight: str | None = None, seed: int = 42) -> Pipeline:
    gbt = GBTClassifier(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"), gbt if weight is None else gbt.setWeightCol(weight)])


def score(model: Model, df: DataFrame, name: str = "score") -> DataFrame:
    """``df`` with the probability of the positive class."""
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.drop("features", "rawPrediction", "probability", "prediction")


def platt(cal: DataFrame, label: str, score_col: str) -> Callable[[DataFrame], DataFrame]:
    """A logistic calibration fitted on held-out scores."""
    stages = [VectorAssembler(inputCols=[score_col], outputCol="features"), LogisticRegression(featuresCol="features", labelCol=label)]
    model = Pipeline(stages=stages).fit(cal)
    return lambda df: score(model, df, f"{score_col}_platt")


def isotonic(cal: DataFrame, label: str, score_col: str) -> Callable[[DataFrame], DataFrame]:
    """A monotone calibration fitted on held-out scores."""
    model = IsotonicRegression(featuresCol=score_col, labelCol=label).fit(cal.withColumn(label, F.col(label).cast("double")))
    return lambda df: model.transform(df).withColumnRenamed("prediction", f"{score_col}_isotonic")


def importances(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    """Feature importances, the largest first."""
    return sorted(zip(features, (float(x) for x in model.stages[-1].featureImportances.toArray())), key=lambda x: (-x[1], x[0]))


def _numbered(df: DataFrame, order: Column, name: str) -> DataFrame:
    """``df`` numbered 1, 2, ... in the order of a hash: ranks within buckets of it, offset by the buckets before."""
    df = df.withColumn("_o", order).withColumn("_b", F.shiftrightunsigned("_o", 54))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy("_b").agg(F.count("*").alias("_c")).select("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_o")))
    return ranked.join(offsets, "_b").withColumn(name, F.col("_r") + F.col("_off")).drop("_o", "_b", "_r", "_off")


def permutation_importances(model: PipelineModel, held: DataFrame, features: Sequence[str], label: str) -> list[tuple[str, float]]:
    """How much average precision falls when a feature's values are dealt anew among the rows, the largest fall first."""
    held = staged(held, "held")
    base = average_precision(score(model, held), label, "score", []).first()["average_precision"]
    key = F.monotonically_increasing_id()
    rows = _numbered(held, F.xxhash64(key, F.lit(3)), "_n")
    out = []
    for i, f in enumerate(features):
        values = _numbered(held.select(F.col(f).alias("_v")), F.xxhash64(key, F.lit(100 + i)), "_n")
        dealt = rows.drop(f).join(values.withColumnRenamed("_v", f), "_n").drop("_n")
        out.append((f, base - average_precision(score(model, dealt), label, "score", []).first()["average_precision"]))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def time_ordered_search(df: DataFrame, ts: str, label: str, origins: Sequence[str], test: str, candidates: dict[str, Pipeline]) -> list[tuple[str, float]]:
    """(candidate, mean average precision over the origins), the best first: train before each origin, test after it.

    Origins whose training rows have a single class are skipped.
    """
    out = []
    for name, pipeline in candidates.items():
        scores = []
        for o in origins:
            at = F.expr(f"timestamp_ntz'{o}'")
            train, held = df.where(F.col(ts) < at), df.where((F.col(ts) >= at) & (F.col(ts) < at + F.expr(f"INTERVAL {test}")))
            if single_class(train, label):
                continue
            ap = average_precision(score(pipeline.fit(train), held), label, "score", []).first()
            if ap is not None and ap["average_precision"] is not None:
                scores.append(ap["average_precision"])
        out.append((name, sum(scores) / len(scores) if scores else 0.0))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def save(model: PipelineModel, path: str, features: Sequence[str], threshold: float) -> None:
    """The model with the features and the threshold it was chosen with."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps({"features": list(features), "threshold": threshold}),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark, path: str) -> tuple[PipelineModel, list[str], float]:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return PipelineModel.load(f"{path}/model"), meta["features"], meta["threshold"]
