"""Registered queries against DuckDB on the smallest tables, and the entry points."""

import duckdb
import pytest

import __spark_entry__
from check import TABLES, normal

FOLDER = "/root/testdata/sf0.001"
# one or more per module; ``check.py`` runs all of them
CHOSEN = [
    "csv_scan", "pattern_csv", "column_types", "numeric_stats", "top_values", "quality_issues", "lineage_diff", "egress_decision",
    "preprocessor", "temporal_holdout", "stratified_folds", "ridge_oof", "stacked_oof", "fold_auc", "residual_report", "residual_scan",
    "quantile_scan", "levene_test", "rolling_drift", "variance_lr", "model_agreement", "jaccard_pairs", "apply_rules", "bootstrap_presence",
    "permutation_test", "double_ml", "single_rule_gain", "run_summary", "evidence_cards", "number_extract", "text_verdicts",
    "failure_ratio", "p95_window", "sustained_condition", "stream_scores",
]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, db, name):
    got = __spark_entry__.queries()[name](spark, FOLDER).toPandas()
    want = db.execute(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
