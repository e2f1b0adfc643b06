"""Merging, scoring and de-duplicating detected patterns (result tables)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.functions.moments import packed_arrays, summed_arrays

# Fixed scoring constants.
EFFECT_WEIGHT, COVERAGE_WEIGHT = 0.60, 0.40
MIN_EFFECT, MIN_COVERAGE, MIN_SAMPLES = 0.2, 0.03, 5
JACCARD_LIMIT, TOP_K = 0.9, 20


def model_agreement(patterns: DataFrame, models: list[str]) -> DataFrame:
    """Patterns of several models merged on (column, type, bin).  Found by all: consensus,
    confidence 1.5; only by trees: 1.0; only by the linear model: 0.8.  ``models[0]`` is the
    primary model."""
    n = len(models)
    primary = models[0]
    merged = patterns.groupBy("column_name", "pattern_type", "bin_value").agg(
        F.array_sort(F.collect_set("model")).alias("agreement_models"),
        F.max(F.abs("effect_size")).alias("effect_size"),
    )
    found = F.size("agreement_models")
    lone = F.when(
        F.array_contains("agreement_models", primary), F.lit(primary)
    ).otherwise(F.element_at("agreement_models", 1))
    agreed = found >= n
    return merged.select(
        "column_name", "pattern_type", "bin_value", "effect_size",
        F.concat_ws(",", "agreement_models").alias("agreement_models"),
        (found / n).alias("agreement_ratio"),
        F.when(agreed, "consensus").otherwise(F.concat(lone, F.lit("_only"))).alias("agreement"),
        F.when(agreed, 1.5).when(lone == "linear", 0.8).otherwise(1.0).alias("confidence"),
    )


def composite(effect: Column, coverage: Column) -> Column:
    return F.lit(EFFECT_WEIGHT) * effect + F.lit(COVERAGE_WEIGHT) * coverage


def score(patterns: DataFrame, n_rows: Column | int) -> DataFrame:
    """Composite score of each pattern; weak, rare and tiny patterns are dropped."""
    n = F.lit(n_rows) if isinstance(n_rows, int) else n_rows
    coverage = F.col("sample_count") / n
    effect = F.abs("effect_size")
    return patterns.where(
        (F.col("sample_count") >= MIN_SAMPLES) & (effect >= MIN_EFFECT) & (coverage >= MIN_COVERAGE)
    ).select(
        "*", coverage.alias("coverage"), composite(effect, coverage).alias("composite_score"),
        F.when(F.col("pattern_type") == "subgroup", "subgroup").otherwise("cluster").alias("source"),
    )


def dedup_by_column(scored: DataFrame, k: int = TOP_K, ties: list[str] | None = None) -> DataFrame:
    """Best pattern per (column, source); patterns without a column are all kept."""
    order = [F.desc("composite_score"), *(ties or ["bin_value"])]
    best = Window.partitionBy("column_name", "source").orderBy(*order)
    kept = scored.withColumn("__r", F.row_number().over(best)).where(
        (F.col("__r") == 1) | F.col("column_name").isNull() | (F.col("column_name") == "")
    )
    return kept.drop("__r").orderBy(*order).limit(k)


def mask_overlaps(df: DataFrame, masks: list[Column]) -> np.ndarray:
    """Joint support counts of every two row masks.  Each Arrow batch contributes one matrix
    product, so the work per row does not emit pairs."""
    p = len(masks)
    rows = df.select(*[F.coalesce(m.cast("boolean"), F.lit(False)).cast("float").alias(f"m{i}") for i, m in enumerate(masks)])

    def partial(batches):
        acc = np.zeros((p, p))
        for pdf in batches:
            x = pdf.to_numpy(dtype=np.float64)
            acc += x.T @ x
        yield from packed_arrays({0: acc.ravel()})

    sums = summed_arrays(rows.mapInPandas(partial, "g int, slot int, v binary")) if p else {}
    return sums.get(0, np.zeros(p * p)).reshape(p, p)


def jaccard_table(df: DataFrame, names: list[str], masks: list[Column]) -> DataFrame:
    """Jaccard overlap of each pair of patterns."""
    both = mask_overlaps(df, masks)
    rows = []
    for i in range(len(names)):
        for j in range(i + 1, len(names)):
            union = both[i, i] + both[j, j] - both[i, j]
            rows.append((names[i], names[j], int(both[i, j]), int(union), float(both[i, j] / union) if union else 0.0))
    return df.sparkSession.createDataFrame(
        rows, "pattern_a string, pattern_b string, intersection long, union_rows long, jaccard double"
    )


def dedup_by_mask(df: DataFrame, scored: list[dict], masks: list[Column], k: int = TOP_K) -> list[dict]:
    """Greedy pass in score order: a pattern that overlaps an accepted one by more than 0.9 is
    dropped."""
    both = mask_overlaps(df, masks)
    order = sorted(range(len(scored)), key=lambda i: -scored[i]["composite_score"])
    kept: list[int] = []
    for i in order:
        union = [both[i, i] + both[j, j] - both[i, j] for j in kept]
        if not any(u > 0 and both[i, j] / u > JACCARD_LIMIT for j, u in zip(kept, union)):
            kept.append(i)
    return [scored[i] for i in kept[:k]]


def with_bypass(scored: DataFrame, regimes: DataFrame) -> DataFrame:
    """Variance-regime patterns join the scored list without passing the score gates."""
    return scored.unionByName(regimes, allowMissingColumns=True)


def by_effect(patterns: DataFrame) -> DataFrame:
    return patterns.orderBy(F.desc(F.abs("effect_size")), "column_name", "bin_value")
