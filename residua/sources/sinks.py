"""Result tables on storage, one folder per kind, partitioned by run."""

from __future__ import annotations

from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.functions import expr

PATTERN_FIELDS = ["pattern_type", "column_name", "effect_size", "p_value", "adjusted_p_value", "sample_count", "mean_residual", "std_residual"]
VARIABLE_FIELDS = ["name", "status", "stability_score", "bootstrap_presence_rate", "importance_score", "description", "explanation_text"]


def _append(df: DataFrame, path: str, run_id: str, *partitions: str) -> None:
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id", *partitions).parquet(path)


def write_residuals(records: DataFrame, root: str, run_id: str) -> None:
    """All scored rows; unassigned folds and non-finite residuals are left out, nothing is
    sampled."""
    kept = records.where((F.col("fold") >= 0) & expr.finite(F.col("residual")).isNotNull())
    _append(kept, f"{root}/residuals", run_id, "model")


def write_patterns(patterns: DataFrame, root: str, run_id: str) -> None:
    _append(patterns, f"{root}/patterns", run_id)


def write_variables(variables: DataFrame, root: str, run_id: str) -> None:
    _append(variables, f"{root}/latent_variables", run_id)


def write_fold_metrics(metrics: DataFrame, root: str, run_id: str) -> None:
    _append(metrics, f"{root}/fold_metrics", run_id)


def write_events(events: DataFrame, root: str, run_id: str) -> None:
    """Append (phase, type, payload struct) rows as JSON lines."""
    events.withColumn("run_id", F.lit(run_id)).withColumn("logged_at", F.current_timestamp()).write.mode(
        "append"
    ).partitionBy("run_id").json(f"{root}/events")


def read_results(spark: SparkSession, root: str, kind: str, run_id: str | None = None) -> DataFrame:
    path = f"{root}/{kind}"
    df = spark.read.json(path) if kind == "events" else spark.read.parquet(path)
    return df.where(F.col("run_id") == run_id) if run_id else df


def delete_run(spark: SparkSession, root: str, run_id: str) -> int:
    """Remove the run's partition from every result folder; returns how many were removed."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    removed = 0
    for status in fs.listStatus(base):
        part = jvm.org.apache.hadoop.fs.Path(status.getPath(), f"run_id={run_id}")
        if fs.exists(part) and fs.delete(part, True):
            removed += 1
    return removed


def pattern_export(patterns: DataFrame) -> DataFrame:
    """The eight exported pattern fields; the column name may sit in a nested definition."""
    column = F.col("column_name")
    if "definition" in patterns.columns:
        column = F.coalesce(F.nullif(column, F.lit("")), F.col("definition.column_name"), F.lit(""))
    return patterns.select(
        *[column.alias(c) if c == "column_name" else F.col(c) if c in patterns.columns else F.lit(None).alias(c) for c in PATTERN_FIELDS]
    )


def variable_export(variables: DataFrame) -> DataFrame:
    return variables.select(
        *[F.col(c) if c in variables.columns else F.lit(None).cast("string").alias(c) for c in VARIABLE_FIELDS]
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def full_report(run: DataFrame, dataset: DataFrame, patterns: DataFrame, variables: DataFrame, summary: DataFrame) -> DataFrame:
    """One JSON document of a run.  Inputs are result tables (top-k patterns and their
    variables), not row data."""

    def packed(df: DataFrame, out: str) -> DataFrame:
        return df.agg(F.sort_array(F.collect_list(F.struct(*[expr.col(c) for c in df.columns]))).alias(out))

    parts = [
        run.select(F.struct("*").alias("run")), dataset.select(F.struct("*").alias("dataset")),
        packed(patterns, "patterns"), packed(variables, "latent_variables"),
        summary.select(F.struct("*").alias("summary")),
    ]
    # five one-row tables
    joined = parts[0]
    for p in parts[1:]:
        joined = joined.join(F.broadcast(p))
    return joined.select(F.to_json(F.struct("*")).alias("value"))


def save_array(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_model(model: MLWritable, path: str) -> None:
    model.write().overwrite().save(path)
