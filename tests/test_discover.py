"""The whole analysis on planted and empty tables, sinks and streams."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from residua import Options
from residua.operators import rules
from residua.operators.rules import Rule
from residua.plans.discover import discover
from residua.sources import sinks
from residua.streaming import alerts, scoring


def delivery(n=3000, seed=42):
    rng = np.random.default_rng(seed)
    dist, traffic = rng.uniform(1, 30, n), rng.uniform(1, 10, n)
    rating, value = rng.uniform(3, 5, n), rng.uniform(5, 150, n)
    hidden = (dist > 10) & (traffic > 7.5)
    y = 10 + 1.5 * dist + 2 * traffic - 1.5 * rating + 0.02 * value + 25 * hidden + rng.normal(0, 3, n)
    return pd.DataFrame({"row_no": np.arange(n), "distance_miles": dist, "traffic_index": traffic, "driver_rating": rating, "order_value": value, "delivery_time": y})


def test_hidden_condition_is_recovered(spark, tmp_path):
    got = discover(spark.createDataFrame(delivery()), Options(target="delivery_time", key="row_no", cv_folds=3, bootstrap_iterations=20))
    assert got.problem == "regression" and got.oof.count() == got.oof.select("row_no").distinct().count()
    columns = {c for r in got.validated_rules() for c in r.columns()}
    assert any("traffic_index" in c for c in columns)
    assert got.selection and got.selection[0]["improvement_pct"] > 1
    r2 = got.scores.agg(F.avg("r2")).first()[0]
    assert 0.75 < r2 < 0.92
    stored = [rules.Rule.from_json(r.to_json()) for r in got.validated_rules()]
    base = spark.createDataFrame(delivery()).drop("delivery_time")  # no derived columns here
    assert any("derived" in r.params for r in stored)
    scored = rules.apply_rules(base, stored, ["row_no"])
    assert scored.count() == 3000
    root = str(tmp_path / "run")
    got.save(root, "r1")
    read = lambda kind: sinks.read_results(spark, root, kind, "r1")
    assert read("residuals").count() == got.oof.count() and read("fold_metrics").count() == 3
    assert read("patterns").count() == len(got.patterns) and read("latent_variables").count() == len(got.rules)
    assert {r["phase"] for r in read("events").collect()} >= {"profile", "cross_fit", "detect", "construct", "validate"}


def test_noise_gives_no_selected_variable(spark):
    rng = np.random.default_rng(7)
    n = 1500
    a, b = rng.uniform(0, 100, n), rng.uniform(0, 50, n)
    pdf = pd.DataFrame({"row_no": np.arange(n), "feature_a": a, "feature_b": b, "target_value": 5 + 0.3 * a + 1.5 * b + rng.normal(0, 4, n)})
    got = discover(spark.createDataFrame(pdf), Options(target="target_value", key="row_no", cv_folds=3, bootstrap_iterations=20, cluster=False))
    assert not [p for p in got.patterns if p["pattern_type"] == "subgroup"]


def test_time_ordered_run(spark):
    pdf = delivery(1200, 1)
    pdf["when"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(pdf["row_no"], "h")
    pdf["delivery_time"] += np.linspace(0, 30, len(pdf))
    got = discover(
        spark.createDataFrame(pdf),
        Options(target="delivery_time", key="row_no", time_column="when", cv_folds=3, bootstrap_iterations=10, cluster=False),
    )
    assert {p["pattern_type"] for p in got.patterns} & {"trend", "regime_shift"}
    assert got.oof.where("fold = -1 and prediction is not null").count() == 0


def test_binary_target_uses_probabilities(spark):
    rng = np.random.default_rng(3)
    n = 900
    x, z = rng.normal(size=n), rng.choice(["u", "v"], n)
    p = 1 / (1 + np.exp(-(x + 2.5 * (z == "v") * (x > 0))))
    pdf = pd.DataFrame({"row_no": np.arange(n), "x": x, "z": z, "churned": (rng.random(n) < p).astype(int)})
    got = discover(spark.createDataFrame(pdf), Options(target="churned", key="row_no", cv_folds=2, bootstrap_iterations=10, cluster=False))
    assert got.problem == "binary"
    row = got.oof.agg(F.min("prediction").alias("lo"), F.max("prediction").alias("hi")).first()
    assert 0 <= row["lo"] and row["hi"] <= 1
    assert got.scores.count() == 2 and got.scores.where("auc > 0.6 and accuracy > 0.5").count() == 2


def test_options_are_checked():
    for bad in ({"cv_folds": 1}, {"bootstrap_iterations": 5}, {"mode": "other"}):
        with pytest.raises(ValueError):
            Options(**bad)


def test_results_round_trip_and_delete(spark, tmp_path):
    root = str(tmp_path / "out")
    df = spark.createDataFrame([("linear", 1, 0, 2.0), ("linear", 2, -1, None), ("linear", 3, 1, float("nan"))], "model string, k int, fold int, residual double")
    sinks.write_residuals(df, root, "r1"), sinks.write_residuals(df, root, "r2")
    assert sinks.read_results(spark, root, "residuals", "r1").count() == 1
    assert sinks.delete_run(spark, root, "r1") == 1
    assert sinks.read_results(spark, root, "residuals").select("run_id").distinct().count() == 1


def events(spark):
    rng = np.random.default_rng(1)
    n = 2000
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 6 * 3600, n)), "s")
    return spark.createDataFrame(pd.DataFrame({"ts": ts, "kind": rng.choice(["a", "b"], n), "value": rng.gamma(1, 10, n)}))


def run(spark, stream, tmp_path, name):
    scoring.run_to_table(stream, str(tmp_path / name), str(tmp_path / f"{name}_state")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(str(tmp_path / name))


def test_stream_equals_batch(spark, tmp_path):
    df = events(spark)
    df.write.parquet(str(tmp_path / "in"))
    stream = scoring.read_stream(spark, str(tmp_path / "in"), df.schema)
    rule = [Rule("high", "numeric_bin", {"column": "value", "lower": 20.0, "upper": 1e9})]
    got = run(spark, scoring.score_stream(stream, rule, ["ts", "value"]), tmp_path, "scored")
    assert got.exceptAll(rules.apply_rules(df, rule, ["ts", "value"])).count() == 0 and got.count() == 2000
    closed = run(spark, alerts.rate(alerts.watermarked(stream), "10 minutes", 600, 0.05, by=["kind"]), tmp_path, "rates")
    batch = alerts.rate(df, "10 minutes", 600, 0.05, by=["kind"])
    assert closed.count() > 50 and closed.exceptAll(batch).count() == 0


def test_sustained_stream_equals_batch(spark, tmp_path):
    rows = [(k, pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m), on) for k, pattern in (("x", "1110111101"), ("y", "0011000110")) for m, on in enumerate(c == "1" for c in pattern)]
    flags = spark.createDataFrame(pd.DataFrame(rows, columns=["kind", "window_start", "firing"]))
    flags.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = scoring.read_stream(spark, str(tmp_path / "in"), flags.schema)
    got = run(spark, alerts.sustained_stream(stream, 60, 180, "kind"), tmp_path, "runs")
    batch = alerts.sustained(flags, 60, 180, ["kind"])
    assert {(r["kind"], r["run_start"]) for r in got.collect()} == {(r["kind"], r["run_start"]) for r in batch.collect()}
    assert batch.count() == 2


def test_percentiles_of_heavy_groups(spark, monkeypatch):
    from residua.functions import quantiles

    df = events(spark).withColumn("kind", F.when(F.col("value") > 1, "hot").otherwise("cold"))
    exact = {tuple(r) for r in alerts.p95(df, "value", ["kind"]).select("window_start", "kind", F.round("p95", 9)).collect()}
    monkeypatch.setattr(quantiles, "SMALL_ROWS", 10)
    ranged = {tuple(r) for r in alerts.p95(df, "value", ["kind"]).select("window_start", "kind", F.round("p95", 9)).collect()}
    assert exact == ranged


def test_a_run_reads_its_table_once(spark):
    pdf = delivery(600)
    df, seen = spark.createDataFrame(pdf), spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    discover(df.mapInPandas(pass_on, df.schema), Options(target="delivery_time", key="row_no", cv_folds=3, bootstrap_iterations=10, cluster=False))
    assert seen.value == len(pdf)
