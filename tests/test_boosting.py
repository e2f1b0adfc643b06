"""Boosted trees and logistic models of all folds at once."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from residua.operators import boosting, models
from residua.operators.boosting import Boosting


def planted(n=3000, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = 2 * x[:, 0] + 6 * ((x[:, 0] > 0.5) & (x[:, 1] > 0)) + rng.normal(size=n) * 0.3
    return pd.DataFrame({"k": np.arange(n), "fold": np.arange(n) % 3, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})


def folds(k):
    return [F.col("fold") != f for f in range(k)]


def test_one_tree_is_the_best_split_of_all(spark):
    pdf = planted(400)
    p = Boosting(trees=1, depth=1, rate=1.0, rows=1.0, columns=1.0, min_weight=1.0, bins=256)
    forest = boosting.fit_forests(spark.createDataFrame(pdf), ["a", "b", "c"], "y", [F.lit(True)], params=p)[0]
    t = forest.rounds[0][0]
    g = pdf["y"].mean() - pdf["y"].to_numpy()
    best = (-1.0, None, None)
    for i, c in enumerate("abc"):
        x = pdf[c].to_numpy()
        for cut in forest.edges[i]:
            left = x <= cut
            if 1 <= left.sum() <= len(x) - 1:
                gain = g[left].sum() ** 2 / (left.sum() + 1) + g[~left].sum() ** 2 / ((~left).sum() + 1) - g.sum() ** 2 / (len(x) + 1)
                best = max(best, (gain / 2, i, cut))
    assert (t.feature[0], t.cut[0]) == (best[1], best[2]) and np.isclose(t.gain[0], best[0])
    left = pdf["abc"[best[1]]].to_numpy() <= best[2]
    assert np.isclose(t.value[1], -g[left].sum() / (left.sum() + 1)) and np.isclose(t.value[2], -g[~left].sum() / ((~left).sum() + 1))
    assert t.cover == [400.0, float(left.sum()), float((~left).sum())]


def test_folds_together_equal_single_fits_and_do_not_see_their_rows(spark):
    pdf = planted(900)
    df = spark.createDataFrame(pdf).coalesce(1)
    p = Boosting(trees=13, depth=3, rows=1.0, columns=1.0)  # more than one refresh of the margins
    together = boosting.fit_forests(df, ["a", "b", "c"], "y", folds(3), params=p)
    changed = df.withColumn("y", F.when(F.col("fold") == 1, F.lit(1000.0)).otherwise(F.col("y")))
    again = boosting.fit_forests(changed, ["a", "b", "c"], "y", folds(3), params=p)
    x = pdf[["a", "b", "c"]].to_numpy()
    out = [f.margins(f.binned(x))[0] for f in together]
    assert np.allclose(again[1].margins(again[1].binned(x))[0], out[1]) and not np.allclose(again[0].margins(again[0].binned(x))[0], out[0])
    alone = boosting.fit_forests(df, ["a", "b", "c"], "y", [F.col("fold") != 2], params=p)[0]
    assert np.allclose(alone.margins(alone.binned(x))[0], out[2])


def test_objectives(spark):
    pdf = planted()
    df = spark.createDataFrame(pdf.assign(big=(pdf.y > 2).astype(int), three=np.digitize(pdf.y, [-1.0, 3.0])))
    p = dict(trees=30, depth=4)
    table, importances = models.cross_fit(df, lambda: models.boosted_regressor(**p), ["a", "b", "c"], "y", 3)
    row = table.agg(F.sum(F.col("residual") ** 2).alias("e"), F.var_pop("y").alias("v"), F.count("*").alias("n")).first()
    assert row["n"] == 3000 and 1 - row["e"] / row["n"] / row["v"] > 0.85
    assert {f for f, _, _ in importances} == {0, 1, 2} and sum(v for f, _, v in importances if f == 0) == pytest.approx(1)
    table, _ = models.cross_fit(df, lambda: models.boosted_classifier(**p), ["a", "b", "c"], "big", 3)
    got = table.select("prediction", "big").toPandas()
    assert got["prediction"].between(0, 1).all() and ((got["prediction"] > 0.5) == got["big"]).mean() > 0.9
    table, _ = models.cross_fit(df, lambda: models.choose_model("trees", "multiclass", **p), ["a", "b", "c"], "three", 3)
    got = table.select("prediction", "three", "probabilities").toPandas()
    assert (got["prediction"] == got["three"]).mean() > 0.85
    assert np.allclose(np.stack(got["probabilities"]).sum(1), 1) and np.stack(got["probabilities"]).shape[1] == 3


def test_penalties_missing_values_and_empty_folds(spark):
    pdf = planted(600)
    pdf.loc[::7, "a"] = np.nan
    df = spark.createDataFrame(pdf)
    flat = boosting.fit_forests(df, ["a", "b"], "y", [F.lit(True), F.lit(False)], params=Boosting(trees=2, l1=1e9))
    assert all(set(t.value) == {-0.0} for r in flat[0].rounds for t in r) and flat[1].base[0] == 0
    none = boosting.fit_forests(df, ["a", "b"], "y", [F.lit(True)], params=Boosting(trees=2, min_weight=1e9))[0]
    assert all(t.feature == [-1] for r in none.rounds for t in r)
    one = boosting.fit_forests(df, ["a", "b"], "y", [F.lit(True)], params=Boosting(trees=5))
    scored = boosting.scored(df, one, F.when(F.col("k") < 500, 0), "squared")
    assert scored.where("prediction IS NULL").count() == 100 and scored.count() == 600
    assert scored.columns == [*df.columns, "prediction"]
    with pytest.raises(ValueError):
        Boosting.of(other=1)
    assert Boosting.of(maxIter=3, featureSubsetStrategy="0.8") == Boosting(trees=3)


def test_logistic_folds_equal_single_fits(spark):
    rng = np.random.default_rng(4)
    n = 1200
    x = rng.normal(size=(n, 2)) * [1.0, 50.0] + [0.0, 1000.0]
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] + (x[:, 1] - 1000) / 40)))).astype(int)
    pdf = pd.DataFrame({"k": np.arange(n), "fold": np.arange(n) % 3, "a": x[:, 0], "b": x[:, 1], "y": y})
    df = spark.createDataFrame(pdf)
    together = models.LogisticModel(0.5).fit_all(df, ["a", "b"], "y", folds(3))
    for f, m in enumerate(together):
        alone = models.LogisticModel(0.5).fit(df.where(F.col("fold") != f), ["a", "b"], "y")
        assert np.allclose([m.intercept, *m.beta], [alone.intercept, *alone.beta], atol=1e-6)
        z, t = np.column_stack([np.ones(n), x])[pdf.fold != f], y[pdf.fold != f]
        p = 1 / (1 + np.exp(-(z @ [m.intercept, *m.beta])))
        assert np.abs(z.T @ (p - t) + np.array([0, *m.beta]) / 0.5).max() < 1e-3
    table, _ = models.cross_fit(df, lambda: models.choose_model("linear", "binary"), ["a", "b"], "y", 3)
    assert table.count() == n and table.where("prediction between 0 and 1").count() == n


def test_separable_targets_and_binary_stack(spark):
    pdf = pd.DataFrame({"k": np.arange(300), "fold": np.arange(300) % 3, "a": np.arange(300.0), "b": np.arange(300.0) % 7, "y": (np.arange(300) > 140).astype(int)})
    df = spark.createDataFrame(pdf)
    m = models.LogisticModel(1.0).fit(df, ["a"], "y")
    assert np.isfinite([m.intercept, *m.beta]).all() and m.beta[0] > 0
    tables = {c: models.cross_fit(df, models.LogisticModel, [c], "y", 3)[0] for c in ("a", "b")}
    table, stack = models.stack_oof(tables, "k", problem="binary")
    assert sum(stack.weights().values()) == pytest.approx(1) and stack.weights()["a"] > stack.weights()["b"]
    single = models.LogisticModel(1.0).fit(table.where("fold <> 1"), ["a", "b"], "y")
    got = single.predict(table.where("fold = 1").drop("prediction")).select("k", F.col("prediction").alias("q")).join(table, "k")
    assert got.agg(F.max(F.abs(F.col("q") - F.col("prediction")))).first()[0] < 1e-6


def test_one_file_is_dealt_to_all_cores_and_only_splits_come_back(spark, monkeypatch):
    from residua.operators import attribution

    monkeypatch.setattr(boosting, "TASK_ROWS", 100)
    pdf = planted(900)
    df = spark.createDataFrame(pdf).coalesce(1)
    p = Boosting(trees=2, depth=2, rows=1.0, columns=1.0)
    fit = boosting._Fit(df, ["a", "b", "c"], "y", [F.lit(True)], "squared", 1, p)
    assert fit.tasks == 8
    state = [boosting._Grown([], [boosting.Tree()], [[0]], np.arange(3), fit.bases[0])]
    (g, h, split), = fit.splits(state, 0).values()
    assert len(split) == 7 and h == 900 and abs(g) < 1e-6
    model = models.BoostedModel(params=p, features=["a", "b", "c"], forest=fit.run()[0])
    assert attribution.tree_contributions(df, model, "k").rdd.getNumPartitions() >= 8
    x, paths = pdf[["a", "b", "c"]].to_numpy(), attribution.tree_paths(model)
    assert np.array_equal(attribution.shap_matrix(x, paths)[:2], attribution.shap_matrix(x[:2], paths))  # patterns of passing, or rows
    assert np.isclose(attribution.interaction_matrix(x, paths), sum(attribution.interaction_matrix(x[i : i + 2], paths) for i in range(0, 900, 2))).all()


def coarse(n=1200, seed=3):
    """Few distinct rows, some without values, targets of all three objectives."""
    rng = np.random.default_rng(seed)
    a, b, c = rng.integers(0, 9, n).astype(float), rng.integers(0, 4, n).astype(float), rng.integers(0, 6, n).astype(float)
    y = 2 * a + 7 * ((a > 4) & (b > 1)) + np.sin(c) + rng.normal(size=n)
    a[::17] = np.nan
    return pd.DataFrame({"k": np.arange(n), "fold": np.arange(n) % 3, "a": a, "b": b, "c": c, "y": y, "big": (y > 11).astype(float), "three": np.digitize(y, [6.0, 16.0]).astype(float)})


@pytest.mark.parametrize("objective,target,classes", [("squared", "y", 1), ("logistic", "big", 1), ("softmax", "three", 3)])
def test_trees_over_cells_are_those_of_passes_over_rows(spark, monkeypatch, objective, target, classes):
    monkeypatch.setattr(boosting, "TASK_ROWS", 300)
    monkeypatch.setattr(boosting, "COMMON_ROWS", 4)  # cells in several parts
    monkeypatch.setattr(boosting, "DRAWN_BYTES", 1)  # a job for each tree
    df = spark.createDataFrame(coarse()).coalesce(1)
    p = Boosting(trees=4, depth=3)

    def fit(most):
        monkeypatch.setattr(boosting, "MOST_CELLS", most)
        made = boosting._Fit(df, ["a", "b", "c"], target, [*folds(2), F.lit(False)], objective, classes, p)
        assert made.few_cells() == (most > 0)
        return made.run()

    for passes, cells in zip(fit(0), fit(1 << 20)):
        for x, y in zip(passes.rounds, cells.rounds, strict=True):
            for s, t in zip(x, y, strict=True):
                assert (s.feature, s.bin, s.left, s.right) == (t.feature, t.bin, t.left, t.right)
                assert np.allclose(s.value, t.value, atol=1e-9) and np.allclose(s.cover, t.cover) and np.allclose(s.gain, t.gain, atol=1e-7)
        assert len(cells.rounds) == 4


def test_many_trees_take_few_jobs_and_cells_are_counted(spark, monkeypatch):
    df = spark.createDataFrame(coarse())
    spark.sparkContext.setJobGroup("forests", "")
    try:
        boosting.fit_forests(df, ["a", "b", "c"], "y", folds(3), params=Boosting(trees=12, depth=4))
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("forests")) < 24  # a pass a level: 48 and more
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    made = boosting._Fit(df, ["a", "b", "c"], "y", [F.lit(True)], "squared", 1, Boosting(trees=1))
    bins = made.forests[0].binned(coarse()[["a", "b", "c"]].to_numpy())
    distinct = len(np.unique(bins, axis=1).T)
    assert distinct < min(len(bins.T), np.prod([len(e) + 1 for e in made.edges]))  # so that they have to be counted
    for most in (distinct - 1, distinct):
        monkeypatch.setattr(boosting, "MOST_CELLS", most)
        assert made.few_cells() == (most == distinct)
    assert made._held().agg(F.sum("cells"), F.sum(F.length("cell")) / 4).first() == (distinct, 1200)
    wide = np.random.default_rng(0).integers(0, 3, (12, 500)).astype(np.uint8)  # more bins than a number holds
    assert len(np.unique(boosting._cell_keys(wide, [256] * 12))) == len(np.unique(wide, axis=1).T)


def test_margins_are_the_same_by_row_and_by_place(spark, monkeypatch):
    pdf = coarse()
    forest = boosting.fit_forests(spark.createDataFrame(pdf), ["a", "b", "c"], "three", [F.lit(True)], "softmax", 3, Boosting(trees=3, depth=4, columns=1.0))[0]
    bins = forest.binned(np.tile(pdf[["a", "b", "c"]].to_numpy(), (20, 1)))
    by_row = boosting.add_rounds(np.repeat(forest.base[:, None], bins.shape[1], 1), forest.rounds, bins, forest.depth)
    assert np.array_equal(forest.margins(bins), by_row)
    monkeypatch.setattr(boosting, "MOST_PLACES", 1)
    forest.lookups = None
    assert np.array_equal(forest.margins(bins), by_row) and forest.lookups[0][0] is None


@pytest.mark.parametrize("values", [[0, 255], [0, 256], [70_000, 1], [2**33, 0], [-1, 2], [0.5, 2.0], [float("nan"), 1.0], []])
def test_draws_are_sent_exactly(values):
    got = boosting._values(boosting.pa.py_buffer(boosting._least(np.array(values))))
    assert np.array_equal(got, np.array(values, float), equal_nan=True)


def test_drawn_rows_are_those_below_the_share():
    place = boosting._places(5 << 24, 10_000)
    uniform = (boosting._mixed(place, 77) >> np.uint64(11)).astype(float) / 2**53
    for share in (0.0, 0.3, 0.8, 1.0):
        assert np.array_equal(boosting._drawn(place, 77, share), uniform < share)


def test_attributions_walk_leaves_once_per_place(spark, monkeypatch):
    from residua.operators import attribution

    pdf = coarse()
    model = models.boosted_regressor(trees=4, depth=4, columns=1.0).fit(spark.createDataFrame(pdf), ["a", "b", "c"], "y")
    paths, x = attribution.tree_paths(model), np.tile(pdf[["a", "b", "c"]].fillna(-np.inf).to_numpy(), (5, 1))
    x[::13, 1], x[::11, 2] = np.inf, x[::11, 2] + 0.5  # between and beyond the cuts
    values, pairs = attribution.shap_matrix(x, paths), attribution.interaction_matrix(x, paths)
    walked = []
    passed = attribution._passed
    monkeypatch.setattr(attribution, "_passed", lambda rows, path: walked.append(len(rows)) or passed(rows, path))
    for most in (1 << 14, 1):  # looked up, or by row
        monkeypatch.setattr(attribution, "MOST_PLACES", most)
        walked.clear()
        shap, inter = attribution._Lookup(paths, 3, attribution._tree_shap), attribution._Lookup(paths, 3, attribution._tree_pairs)
        assert np.array_equal(attribution.shap_matrix(x, shap), values) and np.array_equal(attribution.interaction_matrix(x, inter), pairs)
        assert max(walked) < 500 if most > 1 else max(walked) == len(x)
    df = spark.createDataFrame(pdf)
    got = attribution.tree_contributions(df, model, "k").toPandas().sort_values("k")
    assert np.allclose(got[["shap_a", "shap_b", "shap_c"]].to_numpy(), attribution.shap_matrix(pdf[["a", "b", "c"]].fillna(-np.inf).to_numpy(), paths))
    strength = {(r["feature_a"], r["feature_b"]): r["strength"] for r in attribution.tree_interactions(df, model).collect()}
    whole = attribution.interaction_matrix(pdf[["a", "b", "c"]].fillna(-np.inf).to_numpy(), paths) / len(pdf)
    assert all(np.isclose(strength["abc"[i], "abc"[j]], whole[i, j]) for i in range(3) for j in range(i + 1, 3))
