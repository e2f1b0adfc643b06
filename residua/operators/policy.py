"""Column sensitivity and what may leave the platform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PUBLIC, NON_PUBLIC = "public", "non_public"
BLOCK_REASON = "pii_protection_per_column"


def seed_sensitivity(existing: DataFrame, columns: DataFrame) -> DataFrame:
    """Add missing (dataset, column_name) rows as non_public; existing rows stay untouched."""
    fresh = (
        columns.select("dataset", "column_name").distinct()
        .join(existing.select("dataset", "column_name"), ["dataset", "column_name"], "left_anti")
        .withColumn("sensitivity", F.lit(NON_PUBLIC))
    )
    return existing.select("dataset", "column_name", "sensitivity").unionByName(fresh)


def set_sensitivity(existing: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply (dataset, column_name, sensitivity) changes; unknown columns are added."""
    new = changes.select("dataset", "column_name", F.col("sensitivity").alias("__new"))
    return existing.join(new, ["dataset", "column_name"], "full_outer").select(
        "dataset", "column_name", F.coalesce("__new", "sensitivity").alias("sensitivity")
    )


def public_columns(table: DataFrame) -> DataFrame:
    return table.where(F.col("sensitivity") == PUBLIC).select("dataset", "column_name")


def egress(rules: DataFrame, public: DataFrame) -> DataFrame:
    """Per rule (name, columns array): allowed only when every column is public, else the
    blocked columns in order of first mention."""
    refs = rules.select("name", F.posexplode_outer(F.array_distinct("columns")).alias("i", "column_name"))
    marked = refs.join(
        public.select("column_name").distinct().withColumn("__ok", F.lit(True)), "column_name", "left"
    )
    blocked = F.when(
        F.col("column_name").isNotNull() & F.col("__ok").isNull(), F.struct("i", "column_name")
    )
    out = marked.groupBy("name").agg(F.array_sort(F.collect_list(blocked)).alias("b"))
    return out.select(
        "name",
        (F.size("b") == 0).alias("allowed"),
        F.when(F.size("b") > 0, F.lit(BLOCK_REASON)).alias("reason"),
        F.concat_ws(",", F.col("b.column_name")).alias("blocked_columns"),
    )


def keep_public(columns: Column, public: Column) -> Column:
    """Sorted public members of a column-name array."""
    return F.array_sort(F.array_intersect(columns, public))


def egress_summary(rules: DataFrame, public: DataFrame, k: int = 5) -> DataFrame:
    """Eligible and blocked counts and the top findings by importance, one row per finding."""
    decided = rules.join(egress(rules, public).select("name", "allowed"), "name")
    totals = decided.agg(
        F.count_if("allowed").alias("n_findings"), F.count_if(~F.col("allowed")).alias("n_blocked")
    )
    best = Window.orderBy(F.desc("importance"), "name")
    top = (
        decided.where("allowed").orderBy(F.desc("importance"), "name").limit(k)
        .withColumn("rank", F.row_number().over(best))
        .select("rank", "name", F.col("importance").alias("effect_size"), "presence_rate")
    )
    # one-row totals
    return top.join(F.broadcast(totals))
