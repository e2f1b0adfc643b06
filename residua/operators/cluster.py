"""Dense regions of high-error rows: hierarchical density clusters of the standardised features, all of them
(see ``density``), with their errors, and clusters of the joint residual and feature space."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.functions import expr
from residua.functions.quantiles import exact_quantiles
from residua.operators.density import density_labels
from residua.operators.prep import fit_scales
from residua.session import durable

HIGH_ERROR = 0.80
MIN_ROWS, MIN_SIZE = 30, 15
MIN_LIFT, MIN_DIFF, MIN_DIFF_SHARE = 1.10, 0.01, 0.05


def high_error_rows(df: DataFrame, residual: str, quantile: float = HIGH_ERROR) -> DataFrame:
    """Rows whose |e| reaches the given quantile, with ``abs_error``."""
    e = F.abs(F.col(residual).cast("double"))
    cut = exact_quantiles(df, {"e": e}, [quantile])["e"][0]
    if cut is None:
        return df.withColumn("abs_error", e).limit(0)
    return df.withColumn("abs_error", e).where(F.col("abs_error") >= F.lit(cut))


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Population z-scores as ``z_<column>``; null, NaN and infinities become 0."""
    cols = {c: expr.finite(expr.col(c)) for c in columns}
    scales = fit_scales(df, cols)
    return df.withColumns({f"z_{c}": F.coalesce(scales[c].apply(v), F.lit(0.0)) for c, v in cols.items()})


def kmeans_labels(df: DataFrame, columns: list[str], k: int = 8, seed: int = 42) -> DataFrame:
    """Fast mode: k-means over the standardised columns."""
    data = VectorAssembler(inputCols=columns, outputCol="__v").transform(df)
    model = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(data)
    return model.transform(data).drop("__v")


def cluster_stats(df: DataFrame, columns: list[str], error: str = "abs_error", label: str = "cluster") -> DataFrame:
    """Size, error mean and population std, and centre in original units."""
    return df.where(F.col(label) >= 0).groupBy(F.col(label).alias("cluster")).agg(
        F.count("*").alias("sample_count"),
        F.avg(error).alias("mean_error"),
        F.stddev_pop(error).alias("std_error"),
        *[F.coalesce(F.avg(expr.finite(expr.col(c))), F.lit(0.0)).alias(f"center_{c}") for c in columns],
    )


def accepted_clusters(stats: DataFrame, global_mean: Column | float, min_size: int = MIN_SIZE) -> DataFrame:
    """Clusters that are large enough and clearly worse than the high-error rows overall."""
    g = F.lit(global_mean) if isinstance(global_mean, float) else global_mean
    lift = F.col("mean_error") / F.greatest(g, F.lit(1e-9))
    diff = F.col("mean_error") - g
    return (
        stats.where(
            (F.col("sample_count") >= min_size) & (F.col("mean_error") > g) & (lift >= MIN_LIFT)
            & (diff >= F.greatest(F.lit(MIN_DIFF), F.lit(MIN_DIFF_SHARE) * g))
        )
        .withColumn("error_lift", F.round(lift, 4))
        .withColumn("global_mean_error", F.round(g, 4))
        .orderBy(F.desc("mean_error"), F.desc("sample_count"))
    )


def cluster_patterns(df: DataFrame, features: list[str], residual: str, min_size: int = MIN_SIZE) -> tuple[DataFrame, DataFrame]:
    """(labelled high-error rows, accepted clusters)."""
    high = durable(high_error_rows(df, residual))
    row = high.agg(F.count("*").alias("n"), F.avg("abs_error").alias("m")).first()
    if row["n"] < MIN_ROWS or not features:
        labelled = high.withColumn("cluster", F.lit(-1))
        return labelled, accepted_clusters(cluster_stats(labelled, features), 0.0)
    labelled = durable(density_labels(standardise(high, features), [f"z_{c}" for c in features], min_size)[0])
    return labelled, accepted_clusters(cluster_stats(labelled, features), float(row["m"]), min_size)


def with_effect(accepted: DataFrame, labelled: DataFrame) -> DataFrame:
    """Adds ``effect_size``: Cohen's d of the error inside each cluster against the other high-error rows."""
    from residua.operators.scan import in_out_cohens_d

    totals = labelled.agg(F.count("*").alias("n_total"), F.avg("abs_error").alias("mean_all"), F.stddev_pop("abs_error").alias("std_all"))
    names = {"mean_error": "mean_residual", "std_error": "std_residual"}
    stats = accepted.crossJoin(F.broadcast(totals)).withColumnsRenamed(names)  # one row of totals
    return in_out_cohens_d(stats).withColumnRenamed("cohens_d", "effect_size").withColumnsRenamed({v: k for k, v in names.items()}).drop("n_total", "mean_all", "std_all", "mean_out")


def matching(mine: DataFrame, theirs: DataFrame, key: str, share: float = 0.5) -> list[tuple[int, int]]:
    """Pairs of clusters of two labellings (key, cluster) that share at least ``share`` of the rows of both."""
    both = mine.withColumnRenamed("cluster", "a").join(theirs.withColumnRenamed("cluster", "b"), key).groupBy("a", "b").agg(F.count("*").alias("n"))
    left, right = (df.groupBy(F.col("cluster").alias(c)).agg(F.count("*").alias(f"n_{c}")) for df, c in ((mine, "a"), (theirs, "b")))
    shared = both.join(left, "a").join(right, "b").where(F.col("n") >= F.lit(share) * (F.col("n_a") + F.col("n_b") - F.col("n")))
    return [(r["a"], r["b"]) for r in shared.orderBy("a", F.desc("n"), "b").collect()]  # clusters, not rows


@dataclass
class ResidualClusters:
    """Clusters of the joint residual and feature space."""

    labelled: DataFrame
    stats: DataFrame
    noise_fraction: float
    validity: float


def residual_space_clusters(df: DataFrame, features: list[str], residual: str, weight: float = 2.0, min_size: int = MIN_SIZE) -> ResidualClusters:
    """Cluster residual (weighted) and features together; coverage, noise and density-based validity."""
    scaled = standardise(df.where(F.col(residual).isNotNull()), [residual, *features])
    scaled = scaled.withColumn(f"z_{residual}", F.col(f"z_{residual}") * F.lit(weight))
    columns = [f"z_{c}" for c in [residual, *features]]
    labelled, found = density_labels(scaled, columns, min_size)
    labelled = durable(labelled)
    n = labelled.count()
    stats = labelled.where(F.col("cluster") >= 0).groupBy("cluster").agg(
        F.count("*").alias("size"), F.avg(residual).alias("mean_residual"),
        F.stddev_pop(residual).alias("std_residual"), (F.count("*") / F.lit(n) * 100).alias("coverage_pct"),
    )
    noise = labelled.where(F.col("cluster") < 0).count() / n if n else 0.0
    return ResidualClusters(labelled, stats, noise, found.validity())
