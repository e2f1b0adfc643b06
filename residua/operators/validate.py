"""Checks before a run.  All problems are reported together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.functions import expr
from residua.operators.profile import column_facts

# Fixed limits of the two checks.
INGEST_MIN_ROWS, RUN_MIN_ROWS, MIN_FEATURES = 100, 50, 2
MAX_FILE_BYTES = 500 * 1024 * 1024
HIGH_NULL_PCT = 95.0
USABLE = ("numeric", "categorical", "boolean")


class DatasetError(ValueError):
    """Raised with every failed rule of a dataset."""

    def __init__(self, errors: list[str]) -> None:
        self.errors = errors
        super().__init__("dataset check failed: " + "; ".join(errors))


def ingest_report(
    df: DataFrame, target: str, time_column: str | None = None, file_size: int = 0
) -> DataFrame:
    """One row: row count, error texts and warning texts of the ingest rules."""
    facts = column_facts(df)
    duplicated = len({c.lower() for c in df.columns}) < len(df.columns) and len(set(df.columns)) < len(df.columns)
    features = [c for c in df.columns if c != target]
    has_target, has_time = target in df.columns, time_column in df.columns
    is_target = F.col("column_name") == target
    is_time = F.col("column_name") == (time_column or "")
    n = F.max("row_count")
    target_unique = F.max(F.when(is_target, F.col("unique_count")))
    usable = F.count_if(F.col("detected_type").isin(*USABLE) & ~is_target)
    errors = expr.messages(
        (n < INGEST_MIN_ROWS, F.format_string(f"Dataset has %d rows; minimum is {INGEST_MIN_ROWS}.", n)),
        (F.lit(len(features) < MIN_FEATURES), F.lit(f"Dataset needs at least {MIN_FEATURES} feature columns; found {len(features)}.")),
        (F.lit(not has_target), F.lit(f"Target column '{target}' not found.")),
        (F.lit(has_target) & (target_unique == 0), F.lit(f"Target column '{target}' is entirely null.")),
        (F.lit(has_target) & (target_unique == 1), F.lit(f"Target column '{target}' has no variance.")),
        (F.lit(time_column is not None and not has_time), F.lit(f"Time column '{time_column}' not found.")),
        (F.lit(has_time) & (F.max(F.when(is_time, F.col("detected_type"))) != "datetime"), F.lit(f"Time column '{time_column}' could not be parsed.")),
        (F.lit(duplicated), F.lit("Duplicate column names.")),
        (F.lit(file_size > MAX_FILE_BYTES), F.lit(f"File size {file_size} exceeds {MAX_FILE_BYTES} bytes.")),
        (usable == 0, F.lit("No numeric, categorical or boolean feature column.")),
    )
    warnings = F.array_sort(
        F.array_compact(
            F.collect_list(
                F.when(
                    F.col("null_pct") > HIGH_NULL_PCT,
                    F.format_string("Column '%s' is %.1f%% null.", "column_name", "null_pct"),
                )
            )
        )
    )
    return facts.agg(n.alias("row_count"), errors.alias("errors"), warnings.alias("warnings"))


def distinct_rows(df: DataFrame) -> DataFrame:
    """Row count and surplus copies.  Rows are compared by a 128-bit fingerprint (null flags
    included), so 16 bytes per distinct row are shuffled instead of the row itself."""
    cols = [expr.col(c) for c in df.columns]
    flags = F.concat(*[F.when(c.isNull(), F.lit("1")).otherwise(F.lit("0")) for c in cols])
    prints = df.select(
        F.xxhash64(flags, *cols).alias("h1"), F.xxhash64(F.lit(7), *cols, flags).alias("h2")
    )
    return prints.groupBy("h1", "h2").agg(F.count("*").alias("c")).agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("row_count"),
        (F.coalesce(F.sum("c"), F.lit(0)) - F.count("*")).alias("duplicate_rows"),
    )


def run_report(df: DataFrame, target: str) -> DataFrame:
    """One row: errors, warnings, zero-variance columns and duplicate rows before a run."""
    numeric = expr.numeric_columns(df)
    has_target = target in df.columns
    nulls = F.count_if(expr.col(target).isNull()) if has_target else F.lit(0).cast("long")
    flat = F.array_compact(
        F.array(
            *[
                F.when(F.coalesce(F.min(expr.col(c)) == F.max(expr.col(c)), F.lit(True)), F.lit(c))
                for c in numeric
            ]
        )
    ) if numeric else F.array().cast("array<string>")
    copies = distinct_rows(df)
    # both sides are one-row aggregates
    agg = df.agg(nulls.alias("target_nulls"), flat.alias("dropped_columns")).join(F.broadcast(copies))
    n_features = len(df.columns) - 1
    errors = expr.messages(
        (F.lit(not has_target), F.lit(f"Target column '{target}' not found.")),
        (F.col("target_nulls") > 0, F.format_string("Target column has %d null values.", "target_nulls")),
        (F.col("row_count") < RUN_MIN_ROWS, F.format_string(f"Dataset has %d rows; minimum is {RUN_MIN_ROWS}.", "row_count")),
        (F.lit(n_features < MIN_FEATURES), F.lit(f"Dataset has {n_features} features; minimum is {MIN_FEATURES}.")),
    )
    pct = F.round(F.col("duplicate_rows") / F.col("row_count") * 100, 1)
    warnings = F.concat(
        F.transform("dropped_columns", lambda c: F.concat(F.lit("Column '"), c, F.lit("' has zero variance and will be dropped."))),
        expr.messages(
            (F.col("duplicate_rows") > 0, F.format_string("Dataset contains %d duplicate rows (%.1f%%).", F.col("duplicate_rows"), pct)),
        ),
    )
    return agg.select(
        "row_count", "duplicate_rows", pct.alias("duplicate_pct"), "target_nulls",
        "dropped_columns", errors.alias("errors"), warnings.alias("warnings"),
    )


def require(report: DataFrame) -> dict:
    """Raise with all errors, or return the report row."""
    row = report.first().asDict()
    if row["errors"]:
        raise DatasetError(list(row["errors"]))
    return row
