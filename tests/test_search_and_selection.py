"""Sequential search, selection for any model, and the sustained-alert stream on unordered input."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from residua.operators import models, search, selection
from residua.operators.rules import Rule
from residua.operators.search import Search
from residua.streaming import alerts, scoring


def bowl(params, folds):
    return [-((np.log10(params["x"]) - 1) ** 2) - (params["n"] - 7) ** 2 / 50 + (0.3 if params["kind"] == "b" else 0) + 0.001 * f for f in folds]


SPACE = {"x": (1e-3, 1e3, True), "n": (1, 20, False), "kind": ("a", "b")}


def test_search_improves_on_random_draws_and_repeats():
    runs = [Search(SPACE, seed=1) for _ in range(2)]
    for s in runs:
        s.run(bowl, 5, trials=40)
    one, two = runs
    assert [t.params for t in one.trials] == [t.params for t in two.trials]
    best = [t.best for t in one.trials]
    assert best == sorted(best) and one.best().score == best[-1] > -0.2
    late, early = ([t.score_at[1] for t in one.trials[a:b]] for a, b in ((20, 40), (0, 8)))
    assert np.mean(late) > np.mean(early)
    assert {t.folds for t in one.trials} > {5} or min(t.folds for t in one.trials) < 5  # some trials were given up
    assert all(isinstance(t.params["n"], int) and 1 <= t.params["n"] <= 20 and 1e-3 <= t.params["x"] <= 1e3 for t in one.trials)


def test_failed_trials_time_and_pinned_values():
    def broken(params, folds):
        if params["n"] > 10:
            raise RuntimeError("no")
        return bowl(params, folds)

    s = Search(SPACE, seed=2, pinned={"kind": "a"})
    s.run(broken, 3, trials=20)
    assert any(t.score == float("-inf") and t.error.startswith("RuntimeError") for t in s.trials)
    assert all(t.params["kind"] == "a" for t in s.trials) and np.isfinite(s.best().score) and s.best().params["n"] <= 10
    now = iter(range(1000))
    short = Search(SPACE, seed=2)
    short.run(bowl, 3, trials=20, seconds=3, clock=lambda: float(next(now)))
    assert 1 <= len(short.trials) <= 4


def test_tune_ridge_logistic_and_trees(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 2))
    pdf = pd.DataFrame({"fold": np.arange(600) % 3, "a": x[:, 0], "b": x[:, 1], "y": x[:, 0] + rng.normal(size=600) * 0.2, "z": (x[:, 0] + x[:, 1] > 0).astype(int)})
    df = spark.createDataFrame(pdf).coalesce(1)
    for kind, target, problem, least, more in (("linear", "y", "regression", 0.9, {}), ("linear", "z", "binary", 0.95, {}), ("trees", "y", "regression", 0.5, {"trees": 8, "depth": 2, "rate": 0.3})):
        found = search.tune(df, ["a", "b"], target, kind, 3, problem, trials=3, pinned=more)
        assert len(found.trials) == 3 and not any(t.error for t in found.trials) and found.best().score > least
    assert set(models.SPACES["trees"]) >= {"l1", "l2"}


def planted(seed=6, n=1500):
    rng = np.random.default_rng(seed)
    x, g = rng.normal(size=n), rng.choice(["u", "v", "w"], n)
    p = 1 / (1 + np.exp(-(0.5 * x + 3 * (g == "v") - 1)))
    return pd.DataFrame({"k": np.arange(n), "x": x, "g": g, "y": (rng.random(n) < p).astype(int), "t": x + 4 * (g == "v") + rng.normal(size=n)})


RULES = [Rule("is_u", "categorical", {"column": "g", "value": "u"}), Rule("is_v", "categorical", {"column": "g", "value": "v"}), Rule("flat", "categorical", {"column": "g", "value": "none"})]


@pytest.mark.parametrize("make,target,binary", [(models.LogisticModel, "y", True), (models.RidgeModel, "t", False), (lambda: models.boosted_regressor(trees=15, depth=2, rate=0.3), "t", False)])
def test_planted_rule_comes_first(spark, make, target, binary):
    df = spark.createDataFrame(planted())
    train, holdout = df.where("k % 4 <> 0"), df.where("k % 4 = 0")
    steps = selection.model_selection(train, holdout, ["x"], RULES, target, make, binary)
    assert steps[0]["name"] == "is_v" and steps[0]["marginal"] > 0.05
    assert "flat" not in [s["name"] for s in steps]
    assert selection.model_selection(train, holdout.limit(3), ["x"], RULES, target, make, binary) == []


def counted(spark, pdf):
    """A frame and an accumulator of the rows that were taken from it."""
    df, seen = spark.createDataFrame(pdf), spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    return df.mapInPandas(pass_on, df.schema), seen


def test_selection_reads_its_tables_once(spark):
    pdf = planted()
    held = pdf.k % 4 == 0
    (train, train_rows), (holdout, holdout_rows) = counted(spark, pdf[~held]), counted(spark, pdf[held])
    steps = selection.model_selection(train, holdout, ["x"], RULES, "t", models.RidgeModel)
    assert steps[0]["name"] == "is_v"
    assert train_rows.value == (~held).sum() and holdout_rows.value <= 2 * held.sum()  # and a look whether it is large enough


def test_newton_steps_read_their_rows_once(spark):
    pdf = planted()
    df, rows = counted(spark, pdf)
    models.LogisticModel().fit(df, ["x"], "y")
    assert rows.value == len(pdf)


def test_score_gain_is_the_explained_sum_of_squares(spark):
    pdf = planted()
    df = spark.createDataFrame(pdf)
    model = models.RidgeModel(0.0).fit(df, ["x"], "t")
    got = selection.score_gains(model.predict(df), ["x"], RULES, "t", False)
    s, z = (pdf.g == "v").to_numpy(float), np.column_stack([np.ones(len(pdf)), pdf.x])
    err = lambda m: ((pdf.t - m @ np.linalg.lstsq(m, pdf.t, rcond=None)[0]) ** 2).sum()
    assert got["is_v"] == pytest.approx(err(z) - err(np.column_stack([z, s])), rel=1e-6) and got["flat"] == 0.0


def test_sustained_stream_takes_flags_in_any_order(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(k, pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m), bool(rng.random() < 0.7)) for k in "abcd" for m in range(60)]
    flags = spark.createDataFrame(pd.DataFrame(rows, columns=["kind", "window_start", "firing"]))
    order = rng.permutation(len(rows))
    for part in range(6):
        some = [rows[i] for i in order[part::6]]
        spark.createDataFrame(pd.DataFrame(some, columns=["kind", "window_start", "firing"])).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame(pd.DataFrame([("end", pd.Timestamp("2024-02-01"), False)], columns=["kind", "window_start", "firing"])).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = scoring.read_stream(spark, str(tmp_path / "in"), flags.schema, files_per_batch=2)
    out = alerts.sustained_stream(stream, 60, 180, "kind", delay="2 hours")
    scoring.run_to_table(out, str(tmp_path / "runs"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.schema(out.schema).parquet(str(tmp_path / "runs")).collect()
    batch = alerts.sustained(flags, 60, 180, ["kind"]).collect()
    assert len(batch) > 8 and sorted((r["kind"], r["run_start"]) for r in got) == sorted((r["kind"], r["run_start"]) for r in batch)
    assert {r["windows"] for r in got} == {3}
