"""Readers, profile, validation, lineage, preprocessing."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from residua.operators import lineage, policy, prep, profile, validate
from residua.operators.validate import DatasetError
from residua.sources import files, tables


def put(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.write_bytes(text.encode(encoding))
    return str(folder)


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiters(spark, tmp_path, sep):
    lines = [sep.join(["a", "b", "c"])] + [sep.join([str(i), f"v{i}", "1.5"]) for i in range(20)]
    got = tables.read_csv(spark, put(tmp_path, "x.csv", "\n".join(lines)))
    assert got.columns == ["a", "b", "c"] and got.count() == 20 and dict(got.dtypes)["c"] == "double"


def test_bad_and_blank_and_short_lines(spark, tmp_path):
    text = 'a,b\n1,"x,y"\n\n2,z,surplus\n3\n4,w\n'
    folder = put(tmp_path, "x.csv", text)
    got = {(r["a"], r["b"]) for r in tables.read_csv(spark, folder).collect()}
    assert got == {(1, "x,y"), (3, None), (4, "w")}
    row = tables.bad_line_count(spark, folder, ",", 2).first()
    assert row["bad_lines"] == 1 and row["lines"] == 5


def test_latin1_and_bom(spark, tmp_path):
    (tmp_path / "l").mkdir(), (tmp_path / "b").mkdir()
    latin = put(tmp_path / "l", "x.csv", "name,n\ncafé,1\nübel,2\n", "latin-1")
    assert {r["name"] for r in tables.read_csv(spark, latin).collect()} == {"café", "übel"}
    (tmp_path / "b" / "x.csv").write_bytes(b"\xef\xbb\xbfname,n\nx,1\n")
    got = tables.read_csv(spark, str(tmp_path / "b"))
    assert got.columns == ["name", "n"]


@pytest.mark.parametrize("text", ["", "a,b\n", "a,b\n,\n,\n"])
def test_unusable_files(spark, tmp_path, text):
    with pytest.raises(DatasetError):
        tables.read_csv(spark, put(tmp_path, "x.csv", text))


def test_utf8_check_across_range_borders(spark, tmp_path):
    put(tmp_path, "good.csv", "é漢😀" * 500)
    (tmp_path / "bad.csv").write_bytes("é漢😀".encode() * 300 + b"\xff" + "é".encode() * 300)
    (tmp_path / "cut.csv").write_bytes("é漢😀".encode() * 100 + b"\xf0\x9f")
    for size in (7, 64, 10**6):
        got = {r["path"].split("/")[-1]: r["is_utf8"] for r in files.utf8_files(files.list_files(spark, str(tmp_path)), size).collect()}
        assert got == {"good.csv": True, "bad.csv": False, "cut.csv": False}


def test_mixed_dialects_unite_by_name(spark, tmp_path):
    put(tmp_path, "one.csv", "a,b\n1,x\n2,y\n")
    put(tmp_path, "two.csv", "b;a\nz;3\n")
    assert {(r["a"], r["b"]) for r in tables.read_csv(spark, str(tmp_path)).collect()} == {(1, "x"), (2, "y"), (3, "z")}


def test_copies_are_known_by_content(spark, tmp_path):
    put(tmp_path, "one.csv", "same"), put(tmp_path, "two.csv", "same"), put(tmp_path, "new.csv", "other")
    listing = files.list_files(spark, str(tmp_path))
    assert files.new_files(listing, spark.createDataFrame([], "sha256 string")).count() == 2
    known = files.content_hashes(listing.where(F.contains("path", F.lit("one"))))
    assert [r["path"].split("/")[-1] for r in files.new_files(listing, known).collect()] == ["new.csv"]


def people(spark):
    rng = np.random.default_rng(0)
    n = 300
    pdf = pd.DataFrame({
        "user_id": [f"u{i}" for i in range(n)], "joined": ["2024-01-%02d" % (i % 28 + 1) for i in range(n)],
        "active": rng.choice(["yes", "no"], n), "flag": rng.integers(0, 2, n), "age": rng.integers(20, 80, n),
        "city": rng.choice(list("ABC"), n), "note": [f"free text {i}" for i in range(n)], "score": rng.gamma(1.0, 2.0, n),
    })
    pdf.loc[::4, "score"] = np.nan
    return spark.createDataFrame(pdf), pdf


def test_semantic_types(spark):
    df, _ = people(spark)
    assert profile.column_types(df) == {
        "user_id": "id", "joined": "datetime", "active": "boolean", "flag": "boolean", "age": "numeric", "city": "categorical",
        "note": "text", "score": "numeric",
    }


def test_numeric_stats_equal_pandas(spark):
    df, pdf = people(spark)
    r = profile.numeric_stats(df, ["score", "age"], 9).where("column_name = 'score'").first()
    s = pdf["score"].dropna()
    for name, want in {
        "mean": s.mean(), "std": s.std(), "min": s.min(), "max": s.max(), "q25": s.quantile(0.25), "median": s.median(),
        "q75": s.quantile(0.75), "skewness": s.skew(), "kurtosis": s.kurt(), "count": len(s),
    }.items():
        assert np.isclose(r[name], want), name
    iqr = s.quantile(0.75) - s.quantile(0.25)
    assert r["outlier_count"] == ((s < s.quantile(0.25) - 1.5 * iqr) | (s > s.quantile(0.75) + 1.5 * iqr)).sum()


def test_wide_correlations_are_pairwise_complete(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(100, 1, (200, 14))
    x[rng.random((200, 14)) < 0.1] = np.nan
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(14)])
    got = profile.correlation_matrix(spark.createDataFrame(pdf), list(pdf.columns))
    want = pdf.corr()
    assert len(got) == 91 and all(np.isclose(r, want.loc[a, b]) for (a, b), r in got.items())


def test_vif_equals_uncentred_regression(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(1, 1, (300, 3))
    x[:, 2] = 0.9 * x[:, 0] + rng.normal(0, 0.2, 300)
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")))
    got = {r["feature"]: r["vif"] for r in profile.vif(df, list("abc"), 0.0).collect()}
    for i, c in enumerate("abc"):
        rest = np.delete(x, i, axis=1)
        res = x[:, i] - rest @ np.linalg.lstsq(rest, x[:, i], rcond=None)[0]
        assert np.isclose(got[c], (x[:, i] ** 2).sum() / (res**2).sum(), atol=0.01)
    same = df.withColumn("d", F.col("a"))
    assert max(r["vif"] for r in profile.vif(same, list("abcd")).collect()) == 1000.0


def test_validation_collects_all_errors(spark):
    tiny = spark.createDataFrame([(1, None)], "x int, y string")
    row = validate.ingest_report(tiny, "y", "when").first()
    assert len(row["errors"]) == 4
    with pytest.raises(DatasetError) as e:
        validate.require(validate.run_report(tiny, "z"))
    assert len(e.value.errors) == 3


def test_run_report_counts_copies_and_null_positions(spark):
    df = spark.createDataFrame([(1, None, 5.0)] * 30 + [(None, 1, 5.0)] * 30, "a int, b int, c double")
    row = validate.run_report(df, "a").first()
    assert row["duplicate_rows"] == 58 and row["target_nulls"] == 30 and row["dropped_columns"] == ["a", "b", "c"]


def test_profile_runs_end_to_end(spark):
    df, _ = people(spark)
    p = profile.profile(df, "flag")
    assert p.facts.count() == 8 and p.score.first()["quality_score"] <= 100 and p.target.count() == 2


def snap(spark, rows, schema, version=1):
    return lineage.snapshot(spark.createDataFrame(rows, schema), version)


def test_fingerprint_ignores_order_and_sees_values(spark):
    rows = [(i, f"s{i % 7}", None if i % 5 else 1.5) for i in range(100)]
    a = spark.createDataFrame(rows, "i int, s string, d double")
    one, two = lineage.snapshot(a, 1), lineage.snapshot(a.repartition(7, "s"), 1)
    assert one.exceptAll(two).count() == 0
    changed = a.withColumn("s", F.when(F.col("i") == 3, "s9").otherwise(F.col("s")))
    kinds = {r["column_name"]: r["kind"] for r in lineage.classify(one, lineage.snapshot(changed, 2)).collect()}
    assert kinds == {"i": "ok", "s": "value_change", "d": "ok"}


def test_lineage_events(spark):
    before = snap(spark, [(1, 2, "x", 4)], "keep int, typed int, old string, gone int")
    after = snap(spark, [(1, "2", "x", 9)], "keep int, typed string, fresh string, added int", 2)
    got = {r["column_name"]: (r["kind"], r["prior_column_name"]) for r in lineage.classify(before, after).collect()}
    assert got == {
        "keep": ("ok", None), "typed": ("retype", None), "fresh": ("rename_candidate", "old"), "gone": ("drop", None), "added": ("add", None),
    }
    rules = spark.createDataFrame(
        [("a", ["keep"]), ("b", ["typed", "keep"]), ("c", ["gone"]), ("d", ["never"]), ("e", [])], "name string, columns array<string>"
    )
    levels = {r["name"]: r["compatibility"] for r in lineage.apply_compatibility(rules, lineage.classify(before, after)).collect()}
    assert levels == {"a": "ok", "b": "requires_review", "c": "incompatible", "d": "incompatible", "e": "ok"}


def test_equal_columns_rename_one_to_one(spark):
    before = snap(spark, [("x", "x")], "a string, b string")
    after = snap(spark, [("x", "x")], "c string, d string", 2)
    got = {(r["prior_column_name"], r["column_name"]) for r in lineage.classify(before, after).collect()}
    assert got == {("a", "c"), ("b", "d")}


def test_hamming(spark):
    df = spark.createDataFrame([("abc", "abd"), ("abc", "abc"), ("ab", "abcd")], "a string, b string")
    assert [r[0] for r in df.select(lineage.hamming(F.col("a"), F.col("b"))).collect()] == [1, 0, 4]


def test_sensitivity_is_idempotent(spark):
    columns = spark.createDataFrame([("d", "a"), ("d", "b")], "dataset string, column_name string")
    empty = spark.createDataFrame([], "dataset string, column_name string, sensitivity string")
    once = policy.seed_sensitivity(empty, columns)
    assert policy.seed_sensitivity(once, columns).exceptAll(once).count() == 0
    changed = policy.set_sensitivity(once, columns.limit(1).withColumn("sensitivity", F.lit("public")))
    assert policy.public_columns(changed).count() == 1


def test_preprocessor_fits_on_train_only(spark):
    train = spark.createDataFrame([(1, 1.0, "a", True), (2, None, "b", False), (3, 3.0, None, True), (4, 8.0, "b", True)], "k int, x double, c string, f boolean")
    model = prep.Preprocessor("minmax").fit(train, ["x", "c", "f"])
    new = spark.createDataFrame([(9, float("nan"), "zzz", None)], "k int, x double, c string, f boolean")
    row = model.transform(new, ["k"]).first()
    assert np.isclose(row["x"], (3.0 - 1.0) / 7.0) and row["c_b"] == 0.0 and row["f"] == 1.0
    with pytest.raises(ValueError):
        model.transform(new.drop("c"), ["k"])


def test_interactions_skip_what_they_cannot_use(spark):
    df = spark.createDataFrame([(1.0, 2.0, "s"), (3.0, None, "s"), (5.0, 1.0, "t")], "a double, b double, c string")
    got = prep.add_interactions(df, [("a", "b"), ("a", "c"), ("a", "nope")])
    assert [c for c in got.columns if c.startswith(prep.IX_PREFIX)] == list(prep.interaction_names("a", "b"))
    rows = got.toPandas()
    assert rows["__ix__a__x__b"].tolist() == [2.0, 0.0, 5.0]
    assert rows["__ix__a__hh__b"].tolist() == [0, 0, 0] and rows["__ix__a__xor__b"].tolist() == [1, 0, 1]
