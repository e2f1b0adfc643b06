"""Queries over stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_PAGE = 1000


def page(df: DataFrame, order: list[Column], skip: int = 0, limit: int = 100, where: Column | None = None) -> DataFrame:
    """One page of a filtered, ordered list."""
    if not 1 <= limit <= MAX_PAGE or skip < 0:
        raise ValueError(f"limit must be 1-{MAX_PAGE} and skip not negative")
    rows = df.where(where) if where is not None else df
    return rows.orderBy(*order).offset(skip).limit(limit)


def total_count(df: DataFrame, where: Column | None = None) -> DataFrame:
    rows = df.where(where) if where is not None else df
    return rows.agg(F.count("*").alias("total"))


def search_name(df: DataFrame, column: str, text: str) -> DataFrame:
    """Case-insensitive substring search."""
    safe = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return df.where(F.col(column).ilike(f"%{safe}%"))


def most_recent(df: DataFrame, time: str, tie: str, n: int, where: Column | None = None) -> DataFrame:
    rows = df.where(where) if where is not None else df
    return rows.orderBy(F.desc(time), F.desc(tie)).limit(n)


def residual_page(residuals: DataFrame, model: str, key: str, skip: int, limit: int) -> DataFrame:
    return page(residuals, [F.col(key)], skip, limit, F.col("model") == model)


def variables_by_status(variables: DataFrame, status: str | None = None) -> DataFrame:
    rows = variables.where(F.col("status") == status) if status else variables
    return rows.orderBy(F.desc("importance"), "name")


def events_in_order(events: DataFrame, time: str, tie: str) -> DataFrame:
    return events.orderBy(time, tie)


def compare_runs(variables: DataFrame) -> DataFrame:
    """Variable counts by status per run."""
    return variables.groupBy("run_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "validated").alias("validated"),
        F.count_if(F.col("status") == "rejected").alias("rejected"),
        F.count_if(F.col("status") == "candidate").alias("candidates"),
    )


def config_diff(first: DataFrame, second: DataFrame) -> DataFrame:
    """Settings (setting, value) that differ between two runs, missing ones included."""
    a = first.select("setting", F.col("value").alias("first_value"))
    b = second.select("setting", F.col("value").alias("second_value"))
    return a.join(b, "setting", "full_outer").where(~F.col("first_value").eqNullSafe(F.col("second_value")))


def overlap(first: DataFrame, second: DataFrame, name: str = "name") -> DataFrame:
    """Names in both, only in the first, only in the second."""
    a = first.select(name).distinct().withColumn("a", F.lit(True))
    b = second.select(name).distinct().withColumn("b", F.lit(True))
    side = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "common").when(F.col("a").isNotNull(), "only_first").otherwise("only_second")
    return a.join(b, name, "full_outer").select(name, side.alias("side"))


def access_counts(log: DataFrame, token: str) -> DataFrame:
    return log.groupBy(token).agg(F.count("*").alias("accesses"))


def recovery_scorecard(patterns: DataFrame, variables: DataFrame) -> DataFrame:
    """Per run: patterns, candidates, validated, rejected, most frequent pattern type, flags for
    runs without patterns and runs where nothing was stable."""
    kinds = patterns.groupBy("run_id", "pattern_type").agg(F.count("*").alias("c"))
    best = kinds.groupBy("run_id").agg(
        F.sum("c").alias("patterns"),
        F.min(F.struct((-F.col("c")).alias("neg"), F.col("pattern_type"))).alias("top"),
    )
    counts = compare_runs(variables).select("run_id", F.col("total").alias("candidates"), "validated", "rejected")
    zero = F.lit(0).cast("long")
    return best.join(counts, "run_id", "full_outer").select(
        "run_id",
        F.coalesce("patterns", zero).alias("patterns"),
        F.coalesce("candidates", zero).alias("candidates"),
        F.coalesce("validated", zero).alias("validated"),
        F.coalesce("rejected", zero).alias("rejected"),
        F.col("top.pattern_type").alias("top_type"),
        (F.coalesce("patterns", zero) == 0).alias("no_patterns"),
        ((F.coalesce("candidates", zero) > 0) & (F.coalesce("validated", zero) == 0)).alias("all_unstable"),
    )


def best_run(scorecard: DataFrame) -> DataFrame:
    return scorecard.orderBy(F.desc("validated"), F.desc("patterns"), "run_id").limit(1)


def timing_summary(timings: DataFrame) -> DataFrame:
    """Fastest and slowest run, mean seconds per stage and totals (run_id, total_s, model_s,
    detect_s)."""
    by_time = F.struct("total_s", "run_id")
    return timings.agg(
        F.count("*").alias("runs"),
        F.min(by_time)["run_id"].alias("fastest"),
        F.max(by_time)["run_id"].alias("slowest"),
        F.avg("total_s").alias("mean_total_s"),
        F.avg("model_s").alias("mean_model_s"),
        F.avg("detect_s").alias("mean_detect_s"),
        F.sum("total_s").alias("sum_total_s"),
    )


def type_breakdown(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("pattern_type").agg(F.count("*").alias("patterns"))


def impact_rank(variables: DataFrame, by: list[str] | None = None, k: int | None = None) -> DataFrame:
    """Rank validated variables by gain, |effect|, stability."""
    order = [F.desc("improvement_pct"), F.desc(F.abs("effect_size")), F.desc("stability_score"), F.col("name")]
    window = Window.partitionBy(*(by or [])).orderBy(*order)
    ranked = variables.where(F.col("status") == "validated").withColumn("rank", F.row_number().over(window))
    return ranked.where(F.col("rank") <= k) if k else ranked


def strongest(patterns: DataFrame, k: int) -> DataFrame:
    """The ``k`` patterns with the largest |effect|."""
    return patterns.orderBy(F.desc(F.abs("effect_size")), "column_name", "sample_count").limit(k)


def by_importance(variables: DataFrame, k: int) -> DataFrame:
    return variables.orderBy(F.desc("importance"), "name").limit(k)
