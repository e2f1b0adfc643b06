"""Ridge regression with categorical columns of very many values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from residua import Options
from residua.functions.moments import summed_arrays as models_sums
from residua.operators import models, prep, sparse
from residua.plans.discover import discover


def table(n=1500, levels=40, seed=1):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, levels, n), rng.integers(0, 7, n)
    x = rng.normal(size=n)
    y = 3 * x + np.sin(a) * 5 + b + rng.normal(size=n) * 0.1
    return pd.DataFrame({"k": np.arange(n), "fold": np.arange(n) % 3, "x": x, "a": [f"v{i:06d}" for i in a], "b": [f"w{i}" for i in b], "y": y})


def test_equal_to_the_dense_path(spark):
    df = spark.createDataFrame(table())
    narrow = prep.levels(df, ["a", "b"])
    dense = df.select("k", "fold", "x", "y", *[c.alias(n) for col in ("a", "b") for n, c in prep.one_hot(col, narrow[col]).items()])
    names = [c for c in dense.columns if c not in ("k", "fold", "y")]
    want = models.ridge_oof(dense, names, "y").table.select("k", F.col("prediction").alias("want"))
    got, fitted = sparse.sparse_oof(df, ["x"], ["a", "b"], "y", 3)
    assert got.join(want, "k").agg(F.max(F.abs(F.col("prediction") - F.col("want")))).first()[0] < 1e-6
    assert got.count() == 1500 and [len(v) for v in fitted[0].wide] == [40, 7] and all(v[0] == 0 for m in fitted for v in m.wide)


def test_hundred_thousand_values(spark):
    n = 120_000
    df = spark.range(n).select(
        F.col("id").alias("k"), (F.col("id") % 2).cast("int").alias("fold"), F.concat(F.lit("v"), F.floor(F.col("id") / 6 * 5).cast("string")).alias("a"),
        (F.col("id") % 11).cast("double").alias("y"),
    )
    got, fitted = sparse.sparse_oof(df, [], ["a"], "y", 2, 0.5)
    assert len(fitted[0].wide[0]) >= 90_000 and got.where("prediction IS NULL").count() == 0


def test_unseen_values_missing_folds_and_bounds(spark, monkeypatch):
    pdf = table(200)
    pdf.loc[0, "a"] = "only here"
    pdf.loc[pdf.k > 190, "fold"] = -1
    got, fitted = sparse.sparse_oof(spark.createDataFrame(pdf), ["x"], ["a"], "y", 3)
    row = got.where("k = 0").first()
    assert row["prediction"] == pytest.approx(fitted[0].intercept + fitted[0].dense[0] * pdf.x[0])
    assert got.where("fold = -1 AND prediction IS NOT NULL").count() == 0
    monkeypatch.setattr(sparse, "MOST_BYTES", 100)
    with pytest.raises(ValueError, match="bytes"):
        sparse.sparse_oof(spark.createDataFrame(pdf), ["x"], ["a"], "y", 3)


def test_run_with_a_wide_column(spark, monkeypatch):
    monkeypatch.setattr(prep, "MAX_LEVELS", 10)
    df = spark.createDataFrame(table(1200, 12).drop(columns="fold"))
    found, wide = prep.narrow_levels(df, ["a", "b"])
    assert wide == ["a"] and list(found) == ["b"]
    options = Options(target="y", key="k", cv_folds=3, bootstrap_iterations=10, cluster=False, variance_regimes=False)
    got = discover(df, options)
    assert got.scores.agg(F.avg("r2")).first()[0] > 0.95
    assert prep.with_frequencies(df, ["a"]).agg(F.sum("a_frequency")).first()[0] > 50


def test_one_wide_column_stays_a_table(spark, monkeypatch):
    pdf = table(900)
    df = spark.createDataFrame(pdf)
    want, _ = sparse.sparse_oof(df.withColumn("one", F.lit("same")), ["x"], ["a", "one"], "y", 3)  # the steps of several columns
    sent = []
    monkeypatch.setattr(sparse, "summed_arrays", lambda parts: [sent.append({g: v.size for g, v in got.items()}) or got for got in (models_sums(parts),)][0])
    got, fitted = sparse.sparse_oof(df, ["x"], ["a"], "y", 3)
    both = got.join(want.select("k", F.col("prediction").alias("want")), "k")
    assert both.agg(F.max(F.abs(F.col("prediction") - F.col("want")))).first()[0] < 1e-6
    assert sent == [{0: 3 * 6}] and len(fitted[0].wide[0]) == 40  # sums of two columns, no entry per value
