"""Cross-fitting, stacking, attribution, selection, causal checks against NumPy."""

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from residua.operators import attribution, causal, cv, models, prep, selection
from residua.operators.rules import Rule


def numpy_ridge(x, y, alpha=1.0):
    xc, yc = x - x.mean(0), y - y.mean()
    b = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    return y.mean() - x.mean(0) @ b, b


def regression(n=500, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 2))
    return pd.DataFrame({"k": np.arange(n), "a": x[:, 0], "b": x[:, 1], "y": 5 + x @ [2, -3] + rng.normal(0, 0.5, n)})


def test_oof_predictions_never_see_their_fold(spark):
    df = cv.kfold(spark.createDataFrame(regression()), "k")
    got = models.ridge_oof(df, ["a", "b"], "y").table.toPandas()
    assert got["k"].is_unique and got["prediction"].notna().all()
    for f in range(5):
        train, test = got[got["fold"] != f], got[got["fold"] == f]
        c, b = numpy_ridge(train[["a", "b"]].to_numpy(), train["y"].to_numpy())
        assert np.allclose(test["prediction"], c + test[["a", "b"]].to_numpy() @ b)


def test_folds_do_not_change_under_repartitioning(spark):
    df = spark.createDataFrame(regression())
    for assign in (lambda d: cv.kfold(d, "k"), lambda d: cv.stratified_kfold(d.withColumn("c", F.col("k") % 3), "k", "c")):
        one, many = assign(df.coalesce(1)), assign(df.repartition(9))
        assert one.select("k", "fold").exceptAll(many.select("k", "fold")).count() == 0


def test_stratified_folds_keep_class_shares_with_a_dominant_class(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, "rare").otherwise("common").alias("c"))
    counts = cv.stratified_kfold(df, "k", "c").groupBy("c", "fold").count().collect()
    assert {r["count"] for r in counts} == {20, 180}


def test_timeseries_training_rows_come_before_the_gap(spark):
    pdf = regression(607)
    n, k, gap = 607, 5, 13
    df = cv.timeseries_folds(spark.createDataFrame(pdf.assign(t=pdf["k"] * 2)), "t", "k", k)
    got = models.ridge_timeseries_oof(df, ["a", "b"], "y", n, k, gap).table.toPandas().sort_values("pos")
    size, first = n // 6, n - 5 * (n // 6)
    assert (got["fold"].to_numpy()[:first] == -1).all() and got["prediction"].isna().sum() == first
    for f in range(k):
        start = first + f * size
        train, test = got[got["pos"] < start - gap], got[got["fold"] == f]
        c, b = numpy_ridge(train[["a", "b"]].to_numpy(), train["y"].to_numpy())
        assert len(test) == size and np.allclose(test["prediction"], c + test[["a", "b"]].to_numpy() @ b)


def test_group_folds_keep_groups_whole_and_balanced(spark):
    df = spark.range(900).select(F.col("id").alias("k"), F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 20 + 1).alias("g"))
    for balance in (False, True):
        folded = cv.group_kfold(df, "g", 5, balance)
        assert folded.groupBy("g").agg(F.count_distinct("fold").alias("n")).agg(F.max("n")).first()[0] == 1
    sizes = [r["count"] for r in folded.groupBy("fold").count().collect()]
    assert max(sizes) == 300 and min(sizes) >= 120


def test_auc_with_ties(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 400), rng.integers(0, 8, 400) / 8
    df = spark.createDataFrame(pd.DataFrame({"fold": np.arange(400) % 2, "y": y, "prediction": s}))
    for r in cv.fold_auc(df).collect():
        m = np.arange(400) % 2 == r["fold"]
        p, q = s[m & (y == 1)], s[m & (y == 0)]
        want = np.mean((p[:, None] > q[None, :]) + 0.5 * (p[:, None] == q[None, :]))
        assert np.isclose(r["auc"], want)


def test_non_finite_predictions(spark):
    df = spark.createDataFrame([(0, 1.0), (0, float("nan")), (0, 3.0), (1, 4.0)], "fold int, prediction double")
    assert sorted(r["prediction"] for r in cv.fill_missing_predictions(df).collect()) == [1.0, 2.0, 3.0, 4.0]
    with pytest.raises(ValueError):
        cv.fill_missing_predictions(spark.createDataFrame([(0, float("nan"))], "fold int, prediction double"))


def test_alpha_sweep_equals_direct_scoring(spark):
    df = cv.kfold(spark.createDataFrame(regression()), "k")
    for alpha, mse in models.alpha_sweep(df, ["a", "b"], "y", [0.1, 50.0]):
        direct = models.ridge_oof(df, ["a", "b"], "y", alpha).table.agg(F.avg(F.col("residual") ** 2)).first()[0]
        assert np.isclose(mse, direct)


def test_stack_is_cross_fitted_and_checks_its_bases(spark):
    df = cv.kfold(spark.createDataFrame(regression()), "k")
    bases = {c: models.ridge_oof(df, [c], "y").table for c in ("a", "b")}
    table, stack = models.stack_oof(bases, "k")
    got = table.toPandas()
    for f in range(5):
        train, test = got[got["fold"] != f], got[got["fold"] == f]
        c, b = numpy_ridge(train[["a", "b"]].to_numpy(), train["y"].to_numpy())
        assert np.allclose(test["prediction"], c + test[["a", "b"]].to_numpy() @ b)
    assert np.isclose(sum(stack.weights().values()), 1)
    with pytest.raises(ValueError):
        stack.predict(table.select("a"))


def test_logistic_equals_newton(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.5 + x @ [1.5, -1])))).astype(float)
    m = models.logistic().fit(spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y})), ["a", "b"], "y")
    z = np.column_stack([np.ones(400), x])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        grad = z.T @ (p - y) + np.diag([0, 1, 1]) @ w
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag([0, 1, 1]), grad)
    assert np.allclose([m.fitted.intercept, *m.fitted.coefficients.toArray()], w, atol=2e-3)


def test_model_choice():
    assert isinstance(models.choose_model("linear", "regression"), models.RidgeModel)
    with pytest.raises(ValueError):
        models.choose_model("linear", "multiclass")


def test_tree_values_add_up_and_equal_subset_enumeration(spark):
    pdf = regression(300, 3).assign(c=lambda d: d["a"] * d["b"])
    pdf["y"] = pdf["y"] + 4 * ((pdf["a"] > 0) & (pdf["b"] > 0))
    df = spark.createDataFrame(pdf)
    model = models.boosted_regressor(maxIter=3, maxDepth=3, subsamplingRate=1.0).fit(df, ["a", "b", "c"], "y")
    trees = attribution.tree_paths(model)
    x = pdf[["a", "b", "c"]].to_numpy()[:20]

    def game(row, subset):
        out = 0.0
        for leaves in trees:
            for value, path in leaves:
                for f, lo, hi, share in path:
                    value *= float(lo < row[f] <= hi) if f in subset else share
                out += value
        return out

    got = attribution.shap_matrix(x, trees)
    for i, row in enumerate(x):
        for f in range(3):
            rest = [j for j in range(3) if j != f]
            want = sum(
                factorial(len(s)) * factorial(2 - len(s)) / 6 * (game(row, {*s, f}) - game(row, set(s)))
                for r in range(3) for s in combinations(rest, r)
            )
            assert np.isclose(got[i, f], want)
    scored = model.predict(df).select("k", "prediction")
    parts = attribution.tree_contributions(df, model, "k").join(scored, "k").toPandas()
    assert np.allclose(parts["base_value"] + parts["shap_a"] + parts["shap_b"] + parts["shap_c"], parts["prediction"])
    pair = attribution.interaction_matrix(x[:1], trees)[0, 1]
    want = sum(
        factorial(len(s)) * factorial(1 - len(s)) / 4
        * (game(x[0], {*s, 0, 1}) - game(x[0], {*s, 0}) - game(x[0], {*s, 1}) + game(x[0], set(s)))
        for s in ((), (2,))
    )
    assert np.isclose(pair, abs(want))


def test_confounded_treatment_is_flagged_and_causal_is_not(spark):
    rng = np.random.default_rng(0)
    n = 600
    x = rng.normal(size=n)
    t, y = 2 * x + rng.normal(0, 0.3, n), 3 * x + rng.normal(0, 0.3, n)
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(n), "x": x, "t": t, "y": y}))
    got = causal.orthogonal_effect(df, "k", "t", "y", ["x"])
    assert got["confounded"] and abs(got["theta_dml"]) / abs(got["theta_raw"]) < 0.3
    t2 = rng.normal(size=n)
    df2 = spark.createDataFrame(pd.DataFrame({"k": np.arange(n), "x": x, "t": t2, "y": 1.5 * t2 + rng.normal(0, 0.3, n)}))
    got2 = causal.orthogonal_effect(df2, "k", "t", "y", ["x"])
    assert not got2["confounded"] and abs(got2["theta_dml"] - 1.5) < 0.1
    assert causal.orthogonal_effect(df2.limit(30), "k", "t", "y", ["x"]) is None
    assert causal.orthogonal_effect(df2, "k", "t", "y", []) is None


def test_partial_correlation_equals_residual_correlation(spark):
    from residua.functions.moments import grouped_moments

    rng = np.random.default_rng(1)
    z = rng.normal(size=(300, 2))
    x, y = z @ [1, 2] + rng.normal(size=300), z @ [2, 1] + rng.normal(size=300)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "z0": z[:, 0], "z1": z[:, 1]}))
    m = grouped_moments(df, {c: F.col(c) for c in df.columns})[0]
    d = np.column_stack([np.ones(300), z])
    rx, ry = (v - d @ np.linalg.lstsq(d, v, rcond=None)[0] for v in (x, y))
    assert np.isclose(causal.partial_correlation(m, "x", "y", ["z0", "z1"]), np.corrcoef(rx, ry)[0, 1])


def test_forward_selection_equals_brute_force(spark):
    pdf = regression(800, 4)
    pdf["y"] += 6 * (pdf["a"] > 1) + 3 * (pdf["b"] < -1)
    split = prep.with_holdout(spark.createDataFrame(pdf), "k", 0.3)
    rules = [
        Rule("hi", "numeric_bin", {"column": "a", "lower": 1.0, "upper": 99.0}),
        Rule("lo", "numeric_bin", {"column": "b", "lower": -99.0, "upper": -1.0}),
        Rule("noise", "numeric_bin", {"column": "k", "lower": 0.0, "upper": 400.0}),
    ]
    steps = selection.forward_selection(split.where("not is_holdout"), split.where("is_holdout"), ["a", "b"], rules, "y")
    assert [s["name"] for s in steps][:2] == ["hi", "lo"]
    d = split.toPandas()
    d = d.assign(hi=(d["a"] > 1) * 1.0, lo=(d["b"] <= -1) * 1.0)
    tr, te = d[~d["is_holdout"]], d[d["is_holdout"]]
    c, b = numpy_ridge(tr[["a", "b", "hi"]].to_numpy(), tr["y"].to_numpy())
    e = te["y"] - c - te[["a", "b", "hi"]].to_numpy() @ b
    assert np.isclose(steps[0]["augmented"], 1 - (e**2).sum() / ((te["y"] - te["y"].mean()) ** 2).sum(), atol=1e-6)
