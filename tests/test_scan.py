"""Subgroup scan against brute force, planted and null signals."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from residua.operators import audit, cluster, patterns, scan
from residua.operators.scan import BinSpec


def brute(pdf, column, label, mask):
    r = np.sort(pdf["e"].to_numpy())
    b = np.sort(pdf["e"][mask].to_numpy())
    d = np.max(np.abs(np.searchsorted(b, r, side="right") / len(b) - np.searchsorted(r, r, side="right") / len(r)))
    return len(b), (b.mean() - r.mean()) / r.std(), d


def frame(n=2000, ties=True, seed=3):
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 1, n)
    if ties:
        e = np.where(np.arange(n) % 3 == 0, 0.25, e.round(2))
    cat = rng.choice(["a", "b", "c", None], n, p=[0.5, 0.3, 0.1, 0.1])
    e = e + (cat == "c") * 0.8
    return pd.DataFrame({"k": np.arange(n), "e": e, "cat": cat, "x": rng.normal(0, 1, n).round(1), "one": 1.0})


@pytest.mark.parametrize("ranges,sort_rows", [(1, 10**9), (16, 10**9), (None, 10**9), (4, 500), (2, 10)])
def test_ks_is_exact_with_ties_for_any_cutting(spark, monkeypatch, ranges, sort_rows):
    monkeypatch.setattr(scan, "SUB_RANGES", 8)
    pdf = frame()
    df = spark.createDataFrame(pdf)
    specs = scan.quantile_specs(df, ["x", "one"]) + [BinSpec("cat")]
    rows = scan.ks_scan(df, specs, "e", ranges=ranges, sort_rows=sort_rows).collect()
    by = {(r["column_name"], r["bin_value"]): r for r in rows}
    assert ("cat", "c") in by and len([k for k in by if k[0] == "x"]) == 5 and len([k for k in by if k[0] == "one"]) == 1
    edges = next(s for s in specs if s.column == "x").edges
    for (column, label), r in by.items():
        if column == "cat":
            mask = (pdf["cat"] == label).to_numpy()
        elif column == "one":
            mask = np.ones(len(pdf), bool)
        else:
            i = r["bin_index"]
            low = pdf["x"] >= edges[0] if i == 0 else pdf["x"] > edges[i]
            mask = (low & (pdf["x"] <= edges[i + 1])).to_numpy()
        n, effect, d = brute(pdf, column, label, mask)
        assert r["sample_count"] == n
        assert np.isclose(r["effect_size"], effect) and np.isclose(r["ks_stat"], d, atol=1e-12)


def test_planted_category_is_found_and_noise_is_not(spark):
    rng = np.random.default_rng(1)
    n = 200
    cat = np.where(np.arange(n) < 100, "A", "B")
    planted = pd.DataFrame({"cat": cat, "num": rng.normal(size=n), "e": np.where(cat == "B", 5.0, rng.normal(0, 0.5, n))})
    found = scan.subgroup_patterns(spark.createDataFrame(planted), ["cat", "num"], "e").collect()
    assert found[0]["column_name"] == "cat" and {"A", "B"} <= {r["bin_value"] for r in found}
    noise = pd.DataFrame({"cat": rng.choice(list("xyz"), 600), "num": rng.normal(size=600), "e": rng.normal(size=600)})
    assert scan.subgroup_patterns(spark.createDataFrame(noise), ["cat", "num"], "e").count() == 0


def test_small_bins_are_not_tested(spark):
    pdf = pd.DataFrame({"cat": ["rare"] * 5 + ["common"] * 95, "e": np.arange(100.0)})
    rows = scan.ks_scan(spark.createDataFrame(pdf), [BinSpec("cat")], "e", 20).collect()
    assert [r["bin_value"] for r in rows] == ["common"]


def test_bh_matches_definition_and_is_monotone(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.9]
    rows = scan.bh_adjust(spark.createDataFrame([(str(i), v) for i, v in enumerate(p)], "bin_value string, p_value double").withColumn("column_name", F.lit("c"))).collect()
    got = [r["adjusted_p_value"] for r in sorted(rows, key=lambda r: r["p_value"])]
    want = list(np.minimum(1, np.minimum.accumulate((np.array(p) * 10 / np.arange(1, 11))[::-1])[::-1]))
    assert np.allclose(got, want) and got == sorted(got)


def test_beam_search_finds_conjunction(spark):
    rng = np.random.default_rng(2)
    a, b = rng.choice(list("pq"), 1000), rng.choice(list("rs"), 1000)
    e = rng.normal(0, 1, 1000) + 4 * ((a == "p") & (b == "s"))
    rows = scan.beam_search(spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "e": e})), [BinSpec("a"), BinSpec("b")], "e").collect()
    assert rows[0]["rule"] == "a in p and b in s"


def test_mask_overlaps_and_greedy_dedup(spark):
    df = spark.range(1000)
    masks = [F.col("id") < 500, F.col("id") < 490, F.col("id") >= 500]
    both = patterns.mask_overlaps(df, masks)
    assert both[0, 1] == 490 and both[0, 2] == 0 and both[2, 2] == 500
    kept = patterns.dedup_by_mask(df, [{"n": i, "composite_score": 1 - i / 10} for i in range(3)], masks)
    assert [k["n"] for k in kept] == [0, 2]


def test_dense_blobs_are_separated(spark):
    rng = np.random.default_rng(4)
    pts = np.vstack([rng.normal([0, 0], 0.2, (200, 2)), rng.normal([5, 5], 0.2, (150, 2)), rng.uniform(-4, 9, (60, 2))])
    df = cluster.standardise(spark.createDataFrame(pd.DataFrame(pts, columns=["x", "y"])), ["x", "y"])
    got = cluster.density_labels(df, ["z_x", "z_y"], 15)[0].toPandas()
    labels = got["cluster"].to_numpy()
    near0 = labels[(got["x"].abs() < 0.6) & (got["y"].abs() < 0.6)]
    near5 = labels[((got["x"] - 5).abs() < 0.6) & ((got["y"] - 5).abs() < 0.6)]
    assert len(set(near0)) == 1 and len(set(near5)) == 1 and near0[0] != near5[0] and -1 not in (near0[0], near5[0])
    assert (labels == -1).sum() > 20


def test_high_error_cluster_is_accepted_near_its_centre(spark):
    rng = np.random.default_rng(6)
    calm = np.column_stack([rng.uniform(-2, 3, (1600, 2)), rng.uniform(0, 3, 1600)])
    blob = np.column_stack([rng.normal(7, 0.3, (200, 2)), rng.uniform(9, 11, 200)])
    df = spark.createDataFrame(pd.DataFrame(np.vstack([calm, blob]), columns=["x", "y", "e"]))
    _, accepted = cluster.cluster_patterns(df, ["x", "y"], "e")
    rows = accepted.collect()
    assert rows and rows[0]["center_x"] > 4 and rows[0]["center_y"] > 4 and rows[0]["error_lift"] >= 1.1


def test_null_audit_bounds(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(800), "e": rng.normal(size=800)}))
    row = audit.false_positive_audit(df, "k", "e", replicates=10, features=3).first()
    assert row["runs"] == 10 and row["empirical_fpr"] <= 0.3 and row["upper_95"] > row["empirical_fpr"]


def test_votes_count_folds(spark):
    rng = np.random.default_rng(9)
    cat = rng.choice(["a", "b"], 600)
    pdf = pd.DataFrame({"cat": cat, "e": rng.normal(size=600) + 2 * (cat == "b"), "fold": np.arange(600) % 5})
    rows = audit.discovery_votes(spark.createDataFrame(pdf), [BinSpec("cat")], "e").collect()
    assert {(r["bin_value"], r["votes"], r["stable"]) for r in rows} == {("a", 5, True), ("b", 5, True)}


@pytest.mark.parametrize("ranges,hot", [(4, 0.0), (4, 0.5), (64, 0.3), (1024, 0.0)])
def test_flags_against_brute_force(spark, ranges, hot):
    rng = np.random.default_rng(ranges)
    n, n_flags = 3000, 11
    e = np.where(rng.random(n) < hot, -0.0, rng.normal(size=n).round(1 if ranges == 4 else 4)) + 0.0
    e[:2] = -np.inf, np.inf
    low = rng.random((n, n_flags)) < np.linspace(0, 1, n_flags)
    low[:, 5] = e > 0.5
    bits = [bytearray(b.tobytes()) for b in np.packbits(low, axis=1)]
    rows = spark.createDataFrame(list(zip(e.tolist(), bits, strict=True)), "e double, bits binary").repartition(3)
    total, sizes, distances = scan.ks_flags(rows, n_flags, ranges)
    assert total == n and sizes == low.sum(0).tolist() and distances[0] == 0.0
    for f in range(1, n_flags):
        assert distances[f] == pytest.approx(brute(pd.DataFrame({"e": e}), None, None, low[:, f])[2], abs=1e-12)


def test_null_scan_shuffles_a_row_once(spark, monkeypatch):
    """No scan with a row per row and split; rows without key are in the upper halves, those without residual nowhere."""
    monkeypatch.setattr(audit, "ks_scan", None)
    rng = np.random.default_rng(5)
    e = rng.normal(size=500).round(1).tolist()
    keys = [None if i % 50 == 0 else str(i) for i in range(500)]
    df = spark.createDataFrame([*zip(keys, e, strict=True), ("a", None), ("b", float("nan"))], "k string, e double")
    got = {(r["replicate"], r["feature"]): r for r in audit.null_scan(df, "k", "e", replicates=2, features=3).collect()}
    drawn = df.where("e IS NOT NULL AND NOT isnan(e)").select("e", *[F.coalesce(audit.digest(F.col("k"), f"null42:{i // 4}").substr(8 * (i % 4) + 1, 8) < "80000000", F.lit(False)).alias(f"s{i}") for i in range(6)]).toPandas()
    assert len(got) == 6
    for i in range(6):
        a, b = (np.sort(drawn["e"][drawn[f"s{i}"] == side].to_numpy()) for side in (True, False))
        at = np.sort(drawn["e"].to_numpy())
        d = np.abs(np.searchsorted(a, at, side="right") / len(a) - np.searchsorted(b, at, side="right") / len(b)).max()
        row = got[i // 3, i % 3]
        assert row["sample_count"] == len(a) and row["ks_stat"] == pytest.approx(d, abs=1e-9)
    assert audit.null_scan(df.limit(0), "k", "e", replicates=2, features=3).count() == 0


def test_votes_read_the_folds_once(spark):
    rng = np.random.default_rng(9)
    cat = rng.choice(["a", "b"], 600)
    df = spark.createDataFrame(pd.DataFrame({"cat": cat, "e": rng.normal(size=600) + 2 * (cat == "b"), "fold": np.arange(600) % 5}))
    seen = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    assert audit.discovery_votes(df.mapInPandas(pass_on, df.schema), [BinSpec("cat")], "e").count() == 2
    assert seen.value == 600
