"""Pairwise interaction moments, unbounded group folds, time-ordered fits, block-wise p-values."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from residua.operators import cv, models, regime, scan


def test_interaction_strengths_use_each_pair_own_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(5, 2, (800, 5))
    e = 0.5 * (x[:, 0] - 5) * (x[:, 1] - 5) + rng.normal(0, 1, 800)
    x[rng.random((800, 5)) < 0.2] = np.nan
    names = [f"f{i}" for i in range(5)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(residual=e)).repartition(5)
    got = {(r["feature_a"], r["feature_b"]): r["strength"] for r in regime.interaction_strengths(df, names, "residual").collect()}
    means = np.nanmean(x, axis=0)
    for i in range(5):
        for j in range(i + 1, 5):
            ok = np.isfinite(x[:, i]) & np.isfinite(x[:, j])
            a, b, r = x[ok, i] - means[i], x[ok, j] - means[j], e[ok]
            z = np.column_stack([np.ones(ok.sum()), a, b])
            p, q = (v - z @ np.linalg.lstsq(z, v, rcond=None)[0] for v in (a * b, r))
            assert np.isclose(got[f"f{i}", f"f{j}"], np.corrcoef(p, q)[0, 1] ** 2, atol=1e-9)
    assert max(got, key=got.get) == ("f0", "f1")


def test_many_small_groups_are_balanced(spark, monkeypatch):
    monkeypatch.setattr(cv, "SHARE", 2)
    df = spark.range(6000).select(F.col("id").alias("k"), F.when(F.col("id") < 2000, 0).otherwise((F.col("id") - 2000) / 7).cast("long").alias("g"))
    folded = cv.group_kfold(df, "g", 5, True)
    assert folded.count() == 6000
    assert folded.groupBy("g").agg(F.count_distinct("fold").alias("n")).agg(F.max("n")).first()[0] == 1
    sizes = sorted(r["count"] for r in folded.groupBy("fold").count().collect())
    assert sizes[-1] <= 2008 and all(abs(s - 1000) <= 8 for s in sizes[:-1])


def test_time_ordered_fits_do_not_see_the_future(spark):
    n = 600
    rng = np.random.default_rng(0)
    flag = np.where(np.arange(n) >= 500, 1.0, 0.0)
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(n), "t": np.arange(n), "x": flag, "y": 50 * flag + rng.normal(0, 0.1, n)}))
    folded = cv.timeseries_folds(df, "t", "k", 5)
    got, _ = models.cross_fit(folded, lambda: models.RidgeModel(), ["x"], "y", 5, n, 10)
    late = got.where("fold = 4").toPandas()
    assert len(late) == 100 and abs(late["prediction"]).max() < 1  # the jump was never seen
    leaky, _ = models.cross_fit(folded, lambda: models.RidgeModel(), ["x"], "y", 5)
    assert leaky.where("fold = 3").count() == 100


def test_adjusted_p_values_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(scan, "BH_BLOCK", 7)
    rng = np.random.default_rng(5)
    p = np.round(rng.random(60) ** 3, 3)
    df = spark.createDataFrame(pd.DataFrame({"column_name": "c", "bin_value": [f"{i:03}" for i in range(60)], "p_value": p}))
    got = scan.bh_adjust(df).orderBy("bin_value").toPandas()["adjusted_p_value"].to_numpy()
    order = np.argsort(p, kind="stable")
    want = np.empty(60)
    want[order] = np.minimum(1, np.minimum.accumulate((p[order] * 60 / np.arange(1, 61))[::-1])[::-1])
    assert np.allclose(got, want)
