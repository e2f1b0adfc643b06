"""Labels and sentences on result tables, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.functions import expr

# Why a variable was rejected, in words (fixed texts).
REJECTION_TEXT = {
    "low_presence_rate": "its signal did not hold in enough resamples",
    "low_variance": "its score hardly varied across resamples",
    "low_range": "its score range collapsed in resampling",
    "support_too_sparse": "too few rows showed the pattern",
    "support_too_broad": "nearly all rows showed the pattern",
}


def readable(c: Column) -> Column:
    return F.replace(c, F.lit("_"), F.lit(" "))


def readable_bin(c: Column) -> Column:
    """(10.0, 20.0] reads 10.0-20.0; other labels stay."""
    pattern = r"^[\(\[]\s*([^,]*?)\s*,\s*([^,]*?)\s*[\)\]]$"
    return F.when(
        F.trim(c).rlike(pattern),
        F.concat(F.regexp_extract(F.trim(c), pattern, 1), F.lit("–"), F.regexp_extract(F.trim(c), pattern, 2)),
    ).otherwise(F.trim(c))


def effect_label(effect: Column) -> Column:
    e = F.abs(effect)
    return F.when(e >= 0.8, "large").when(e >= 0.5, "medium").when(e >= 0.2, "small").otherwise("negligible")


def p_label(p: Column) -> Column:
    return (
        F.when(p < 0.001, "highly significant").when(p < 0.01, "significant")
        .when(p < 0.05, "moderately significant").otherwise("not statistically significant")
    )


def stability_label(presence: Column) -> Column:
    return F.when(presence >= 0.8, "Very stable").when(presence >= 0.6, "Stable").otherwise("Unstable")


def confidence_tier(stability: Column, holdout: Column) -> Column:
    return F.when((stability >= 0.8) & F.coalesce(holdout, F.lit(False)), "high").when(stability >= 0.6, "medium").otherwise("low")


def pattern_sentence() -> Column:
    """One sentence per pattern row (pattern_type, column_name, bin_value, effect_size, p_value,
    sample_count, mean_residual)."""
    direction = F.when(F.col("mean_residual") > 0, "higher").otherwise("lower")
    subgroup = F.format_string(
        "Errors differ (%s effect, %.2f) where %s is %s (%d rows); %s; mean error %.3f, %s than average.",
        effect_label(F.col("effect_size")), F.abs("effect_size"), readable(F.col("column_name")),
        readable_bin(F.col("bin_value")), F.col("sample_count"), p_label(F.col("p_value")),
        F.abs("mean_residual"), direction,
    )
    cluster = F.format_string("A dense group of %d high-error rows was found.", F.col("sample_count"))
    return (
        F.when(F.col("pattern_type") == "subgroup", subgroup)
        .when(F.col("pattern_type") == "cluster", cluster)
        .otherwise(F.lit("An unusual pattern was found in the errors."))
    )


def rejection_text(reason: Column) -> Column:
    out = F.lit("its signal did not hold in resampling")
    for code, text in REJECTION_TEXT.items():
        out = F.when(reason == code, F.lit(text)).otherwise(out)
    return out


def recommendation() -> Column:
    """What to do about a variable row (status, pattern_type, column_name, rejection_reason)."""
    return (
        F.when(F.col("status") == "rejected", F.concat(F.lit("No action: "), rejection_text(F.col("rejection_reason")), F.lit(".")))
        .when(F.col("pattern_type") == "subgroup", F.concat(F.lit("Look for an unrecorded condition related to "), readable(F.col("column_name")), F.lit(".")))
        .when(F.col("pattern_type") == "cluster", F.lit("Check whether this combination of values is a hidden condition."))
        .otherwise(F.lit("Review data collection for unmeasured variables."))
    )


def variable_sentence() -> Column:
    """Explanation of a variable row (name, status, presence_rate, stability_score, ...)."""
    pct = F.floor(F.col("presence_rate") * 100).cast("int")
    kept = F.format_string(
        "%s was recovered in %d%% of resamples; reliability is %s.", F.col("name"), pct,
        F.when(F.col("stability_score") >= 0.8, "strong").otherwise("moderate"),
    )
    dropped = F.concat(F.format_string("%s was recovered in %d%% of resamples and rejected: ", F.col("name"), pct), rejection_text(F.col("rejection_reason")), F.lit("."))
    return F.when(F.col("status") == "rejected", dropped).otherwise(kept)


def segment() -> Column:
    return (
        F.when(F.col("pattern_type") == "subgroup", F.concat(readable(F.col("column_name")), F.lit(" in range "), readable_bin(F.col("bin_value"))))
        .when(F.col("pattern_type") == "interaction", F.concat(F.lit("Interaction of "), readable(F.col("column_name"))))
        .otherwise(F.lit("Cluster of high-error rows"))
    )


def evidence_card(variables: DataFrame) -> DataFrame:
    """Confidence tier, key statistics and affected segment of each variable."""
    e, p, rate = F.abs("effect_size"), F.col("p_value"), F.col("presence_rate")
    tier = confidence_tier(F.col("stability_score"), F.col("holdout_validated"))

    def stat(cond: Column, label: str, value: Column, meaning: Column) -> Column:
        return F.when(cond, F.struct(F.lit(label).alias("label"), value.alias("value"), meaning.alias("interpretation")))

    stats = F.array_compact(
        F.array(
            stat(e > 0, "Effect Size", F.format_string("%.2f", e), F.when(e >= 0.8, "Large effect").when(e >= 0.5, "Medium effect").otherwise("Small effect")),
            stat(p < 1, "Significance", F.format_string("p = %.4f", p), F.when(p < 0.001, "Highly significant").when(p < 0.05, "Significant").otherwise("Not significant")),
            stat(F.lit(True), "Bootstrap Stability", F.format_string("%.0f%%", rate * 100), stability_label(rate)),
            stat(F.coalesce(F.col("improvement_pct") != 0, F.lit(False)), "Model Improvement", F.format_string("+%.1f%%", "improvement_pct"), F.when(F.col("improvement_pct") > 1, "Meaningful gain").otherwise("Marginal gain")),
            stat(F.col("holdout_validated").isNotNull(), "Holdout Validation", F.when(F.col("holdout_validated"), "Confirmed").otherwise("Not confirmed"), F.when(F.col("holdout_validated"), "Generalizes to new data").otherwise("May not generalize")),
        )
    )
    headline = F.when(
        F.coalesce(F.col("improvement_pct") != 0, F.lit(False)),
        F.concat(F.col("name"), F.format_string(": improves predictions by +%.1f%%", "improvement_pct")),
    ).otherwise(F.concat(F.col("name"), F.lit(": hidden factor detected with "), tier, F.lit(" confidence")))
    return variables.select(
        "name", headline.alias("headline"), tier.alias("confidence_level"), stats.alias("key_stats"),
        segment().alias("affected_segment"), "sample_count", recommendation().alias("recommendation"),
    )


def summarise(patterns: DataFrame, variables: DataFrame, by: str = "run_id", k: int = 5) -> DataFrame:
    """One summary row per run: headline tier, counts by status and type, best gain, dominant
    type, top findings and next-step codes."""
    kinds = patterns.groupBy(by).agg(
        F.count("*").alias("patterns_found"),
        *[F.count_if(F.col("pattern_type") == t).alias(f"n_{t}") for t in ("subgroup", "cluster", "interaction", "temporal")],
    )
    states = variables.groupBy(by).agg(
        F.count_if(F.col("status") == "validated").alias("validated_variables"),
        F.count_if(F.col("status") == "rejected").alias("rejected_variables"),
        F.max(F.when(F.col("status") == "validated", F.col("improvement_pct"))).alias("best_improvement"),
    )
    order = Window.partitionBy(by).orderBy(F.desc("improvement_pct"), F.desc(F.abs("effect_size")), F.desc("stability_score"), "name")
    top = (
        variables.where(F.col("status") == "validated").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
        .groupBy(by).agg(F.array_sort(F.collect_list(F.struct("r", "name"))).alias("t"))
        .select(by, F.concat_ws(",", F.col("t.name")).alias("top_findings"))
    )
    counts = ["patterns_found", "n_subgroup", "n_cluster", "n_interaction", "n_temporal", "validated_variables", "rejected_variables"]
    out = kinds.join(states, by, "full_outer").join(top, by, "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in counts}
    )
    v, p, gain = F.col("validated_variables"), F.col("patterns_found"), F.col("best_improvement")
    tier = expr.first_match(
        ((v > 0) & F.coalesce(gain > 1, F.lit(False)), "factors_explain_error"),
        (v > 0, "variables_discovered"),
        (p > 0, "patterns_not_stable"),
        default="nothing_detected",
    )
    dominant = expr.first_match(
        ((F.col("n_interaction") > F.col("n_subgroup")) & (F.col("n_interaction") > F.col("n_cluster")), "interaction"),
        (F.col("n_cluster") > F.col("n_subgroup"), "cluster"),
        default="subgroup",
    )
    steps = expr.first_match(
        (v > 0, "add_variables,investigate_cause,monitor_drift"),
        (p > 0, "use_larger_dataset,try_production_mode"),
        default="no_action,expand_features",
    )
    return out.select(
        by, tier.alias("headline_tier"), *counts, "best_improvement", dominant.alias("dominant_type"),
        F.coalesce("top_findings", F.lit("")).alias("top_findings"), steps.alias("next_steps"),
    )


def fallback_summary(patterns: DataFrame, variables: DataFrame, by: str = "run_id") -> DataFrame:
    """Minimal headline and counts per run."""
    p = patterns.groupBy(by).agg(F.count("*").alias("patterns_found"))
    v = variables.groupBy(by).agg(
        F.count_if(F.col("status") == "validated").alias("validated_variables"),
        F.count_if(F.col("status") == "rejected").alias("rejected_variables"),
    )
    zero = F.lit(0).cast("long")
    joined = p.join(v, by, "full_outer").select(
        by, *[F.coalesce(F.col(c), zero).alias(c) for c in ("patterns_found", "validated_variables", "rejected_variables")]
    )
    n = F.col("validated_variables")
    text = (
        F.when(n > 0, F.concat(n.cast("string"), F.when(n == 1, " hidden variable confirmed").otherwise(" hidden variables confirmed")))
        .when(F.col("patterns_found") > 0, F.concat(F.col("patterns_found").cast("string"), F.lit(" patterns found but none passed stability validation")))
        .otherwise(F.lit("No significant patterns detected"))
    )
    return joined.withColumn("headline", text)
