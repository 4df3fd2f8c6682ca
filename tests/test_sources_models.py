"""Small tables, reports, staged tables, model sinks."""

import random

import pytest
from pyspark.sql import functions as F

from lavra.operators import models, quality
from lavra.session import clear_staged, staged
from lavra.sources import markdown, scan, small_table, write_report


def test_union_by_name_and_pruning(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "x int, y string").write.parquet(f"{tmp_path}/a.parquet")
    spark.createDataFrame([(2, 0.5)], "x int, z double").write.parquet(f"{tmp_path}/b.parquet")
    df = scan(spark, f"{tmp_path}/a.parquet", f"{tmp_path}/b.parquet")
    assert sorted(r[:] for r in df.select("x", "y", "z").collect()) == [(1, "a", None), (2, None, 0.5)]
    assert scan(spark, f"{tmp_path}/a.parquet", columns=["x"]).columns == ["x"]


def test_small_tables_and_report(spark, tmp_path):
    (tmp_path / "d.csv").write_text('nome,texto\na,"x|y\nz"\nb,\n', encoding="utf-8")
    df = small_table(spark, f"{tmp_path}/d.csv")
    assert df.count() == 2 and "x\\|y z" in markdown(df)
    write_report(f"{tmp_path}/r.md", "Relatório", {"Dicionário": df})
    assert (tmp_path / "r.md").read_text(encoding="utf-8").startswith("# Relatório\n\n## Dicionário\n\n| nome | texto |")
    with pytest.raises(ValueError):
        markdown(spark.range(5), most=4)


def test_staged_tables_are_cleared(spark):
    clear_staged(spark)
    assert staged(spark.range(3), "t").count() == 3 and clear_staged(spark) == 1


def samples(spark):
    rng = random.Random(1)
    rows = [(float(x > 0.5) if rng.random() < 0.9 else 0.0, x, rng.random()) for x in (rng.random() for _ in range(300))]
    return spark.createDataFrame(rows, "y double, a double, b double")


def test_model_round_trip_and_importances(spark, tmp_path):
    df = samples(spark)
    model = models.forest(["a", "b"], "y", trees=5, depth=3).fit(df)
    models.save(model, str(tmp_path), ["a", "b"], 0.4)
    again, features, threshold = models.load(spark, str(tmp_path))
    assert (features, threshold) == (["a", "b"], 0.4)
    assert models.score(again, df).collect() == models.score(model, df).collect()
    assert models.importances(model, ["a", "b"])[0][0] == "a"
    falls = dict(models.permutation_importances(model, df, ["a", "b"], "y"))
    assert falls["a"] > 0.1 > falls["b"]


def test_weights_prior_and_guard(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "y int")
    w = models.balanced_weight(df, "y", boost=F.lit(2.0)).collect()
    assert sorted(r.weight for r in w)[-1] == 4.0 and abs(sum(r.weight for r in w) - 8.0) < 1e-9
    assert df.select(models.prior(df, "y").alias("p")).first().p == 0.25
    assert models.single_class(df.where("y = 0"), "y") and not models.single_class(df, "y")


def test_calibration_is_monotone(spark):
    df = samples(spark)
    for fit, name in ((models.platt, "a_platt"), (models.isotonic, "a_isotonic")):
        rows = fit(df, "y", "a")(df).orderBy("a").collect()
        assert all(x[name] <= y[name] + 1e-9 for x, y in zip(rows, rows[1:]))


def test_robust_scores(spark):
    df = spark.createDataFrame([("k", 1.0), ("k", 2.0), ("k", 3.0), ("k", 100.0), ("k", None), (None, 5.0)], "k string, v double")
    z = {r.v: r.z for r in quality.robust_scores(df, ["k"], "v").collect() if r.k}
    assert z[2.5 if 2.5 in z else 2.0] < 0 < z[100.0] and z[None] is None
