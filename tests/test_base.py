"""Quantiles, global order, moments, draws and tail probabilities against brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from residua.functions import dist
from residua.functions.hashing import below, digest, draw, poisson_weight, with_draws, word
from residua.functions.moments import _block_moments, grouped_moments, ridge, total
from residua.functions.quantiles import exact_quantiles, grouped_quantiles
from residua.functions.ranks import array_split_bin, block_window, running_sums, with_blocks, with_position

RNG = np.random.default_rng(5)


def heavy_frame(spark, n=3000):
    """A third of the rows share one value."""
    v = np.where(np.arange(n) % 3 == 0, 7.0, RNG.normal(5, 3, n).round(3))
    return spark.createDataFrame(pd.DataFrame({"k": np.arange(n), "v": v, "g": np.arange(n) % 5 // 2})), v


def test_quantiles_by_selection_equal_numpy(spark):
    df, v = heavy_frame(spark)
    probs = [0.0, 0.01, 0.25, 0.4, 0.5, 0.6, 0.75, 0.99, 1.0]
    want = np.quantile(v, probs)
    for limits in ({}, {"small_rows": 1, "read_limit": 3}):
        got = exact_quantiles(df, {"v": F.col("v")}, probs, **limits)["v"]
        assert np.allclose(got, want)


def test_quantiles_skip_null_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    assert exact_quantiles(df, {"v": F.col("v")}, [0.5])["v"] == [2.0]
    assert exact_quantiles(df.where("v > 9 and not isnan(v)"), {"v": F.col("v")}, [0.5])["v"] == [None]


def test_grouped_quantiles_both_ways(spark):
    df, v = heavy_frame(spark)
    g = np.arange(len(v)) % 5 // 2
    for limit in (None, 1):
        rows = grouped_quantiles(df, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.97}, small_rows=limit).collect()
        assert len(rows) == 3
        for r in rows:
            assert np.allclose([r["a"], r["b"], r["c"]], np.quantile(v[g == r["g"]], [0.1, 0.5, 0.97]))


def test_position_survives_ties_and_repartitioning(spark):
    df, v = heavy_frame(spark)
    order = pd.DataFrame({"v": v, "k": np.arange(len(v))}).sort_values(["v", "k"])["k"].tolist()
    for parts in (1, 7):
        got = with_position(df.repartition(parts), ["v", "k"]).select("k", "pos").toPandas().sort_values("pos")
        assert got["pos"].tolist() == list(range(len(v)))
        assert got["k"].tolist() == order


def test_blocks_give_global_lags(spark):
    df = spark.range(1000).select(F.col("id").alias("pos"), (F.col("id") * F.col("id")).alias("x"))
    w = block_window("pos")
    got = with_blocks(df, "pos", 3, block_rows=10).withColumn("l3", F.lag("x", 3).over(w)).where("own").toPandas().sort_values("pos")
    assert len(got) == 1000
    assert got["l3"].isna().sum() == 3
    assert (got["l3"].to_numpy()[3:] == (np.arange(997) ** 2)).all()


def test_running_sums(spark):
    df = spark.range(500).select((F.col("id") % 50 * 10).alias("a"), F.lit(2).alias("w")).groupBy("a").agg(F.sum("w").alias("w"))
    got = running_sums(df, ["a"], {"upto": F.col("w"), "half": F.col("w") / 2.0}).toPandas().sort_values("a")
    assert got["upto"].tolist() == list(range(20, 1001, 20))
    assert got["half"].tolist() == [x / 2 for x in range(20, 1001, 20)]


@pytest.mark.parametrize("n,k", [(103, 10), (20, 10), (7, 10), (100, 3)])
def test_array_split_bins(spark, n, k):
    got = spark.range(n).select(array_split_bin(F.col("id"), n, k).alias("b")).toPandas()["b"].tolist()
    want = [i for i, part in enumerate(np.array_split(np.arange(n), k)) for _ in part]
    assert got == want


def test_moments_narrow_and_wide_agree(spark):
    x = RNG.normal(1e6, 1, (400, 4))
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(fold=np.arange(400) % 3)
    df = spark.createDataFrame(pdf)
    cols = {c: F.col(c) for c in "abcd"}
    narrow = grouped_moments(df, cols, F.col("fold"))
    rows = df.select(F.col("fold").alias("g"), *[F.col(c).alias(f"x{i}") for i, c in enumerate("abcd")])
    wide = _block_moments(rows, list("abcd"))
    for k in range(3):
        part = x[np.arange(400) % 3 == k]
        want = (part - part.mean(0)).T @ (part - part.mean(0))
        assert np.allclose(narrow[k].scatter, want, atol=1e-4) and np.allclose(wide[k].scatter, want, atol=1e-4)
    whole = total(list(narrow.values()))
    assert np.allclose(whole.mean, x.mean(0)) and np.allclose(whole.scatter, (x - x.mean(0)).T @ (x - x.mean(0)), atol=1e-3)


def test_ridge_leaves_intercept_alone(spark):
    x = RNG.normal(0, 1, (300, 2))
    y = 3 + x @ [2.0, -1.0] + RNG.normal(0, 0.1, 300)
    m = grouped_moments(spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y})), {c: F.col(c) for c in ("a", "b", "y")})[0]
    intercept, beta = ridge(m, ["a", "b"], "y", 1.0)
    xc = x - x.mean(0)
    want = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ (y - y.mean()))
    assert np.allclose(beta, want) and np.isclose(intercept, y.mean() - x.mean(0) @ want)


def test_hex_thresholds_equal_number_comparison(spark):
    df = spark.range(5000).select(digest(F.col("id"), "s").alias("h"))
    row = df.select(draw(F.col("h"), 2).alias("u"), word(F.col("h"), 2).alias("w")).agg(
        F.count_if((F.col("u") < 0.37) != below(F.col("w"), 0.37)).alias("bad"), F.avg("u").alias("m")
    ).first()
    assert row["bad"] == 0 and abs(row["m"] - 0.5) < 0.02


def test_poisson_weights_have_unit_mean_and_variance(spark):
    got = with_draws(spark.range(2000), F.col("id"), "7", 10, "b", "u").select("id", "b", poisson_weight(F.col("u")).alias("w"))
    stats = got.agg(F.count("*").alias("n"), F.avg("w").alias("m"), F.var_pop("w").alias("v")).first()
    assert stats["n"] == 20_000 and abs(stats["m"] - 1) < 0.03 and abs(stats["v"] - 1) < 0.06
    again = with_draws(spark.range(2000).repartition(5), F.col("id"), "7", 10, "b", "u").select("id", "b", poisson_weight(F.col("u")).alias("w"))
    assert got.exceptAll(again).count() == 0


def test_tail_probabilities():
    assert math.isclose(dist.chi2_sf(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(dist.chi2_sf(18.307038053275146, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(dist.t_two_sided(2.2281388519649385, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(dist.f_sf(3.3258345304130112, 5, 10), 0.05, rel_tol=1e-8)
    assert math.isclose(dist.binomial_upper(0, 20), 1 - 0.05 ** (1 / 20), rel_tol=1e-9)
    assert dist.binomial_upper(20, 20) == 1.0
    assert math.isclose(dist.kendall_exact_p(1.0, 5), 2 / 120)
    assert math.isclose(dist.kolmogorov_sf_value(1.3580986393225505), 0.05, rel_tol=1e-6)


def test_kolmogorov_column_equals_value(spark):
    got = spark.createDataFrame([(x,) for x in (0.1, 0.5, 1.0, 2.0)], "x double").select("x", dist.kolmogorov_sf(F.col("x")).alias("p")).collect()
    for r in got:
        assert math.isclose(r["p"], dist.kolmogorov_sf_value(r["x"]), abs_tol=1e-12)
