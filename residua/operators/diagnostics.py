"""What the residuals look like as a whole."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.functions import expr
from residua.functions.buckets import add_bucket
from residua.functions.dist import chi2_sf
from residua.functions.moments import grouped_moments
from residua.functions.quantiles import exact_quantiles
from residua.functions.ranks import block_window, with_blocks, with_position

LARGE_SIGMA = 2.0
MULTIMODAL_MIN_ROWS = 30
BIC_STRONG = 10.0
MIXTURE_CELLS = 512


def residual_moments(df: DataFrame, residual: str) -> DataFrame:
    """Mean, population std, skewness, excess kurtosis and largest |e|."""
    e = F.col(residual)
    return df.agg(
        F.count(e).alias("n"), F.avg(e).alias("mean"), F.stddev_pop(e).alias("std"),
        F.skewness(e).alias("skewness"), F.kurtosis(e).alias("kurtosis"),
        F.max(F.abs(e)).alias("max_abs"),
    )


def large_share(df: DataFrame, residual: str, sigmas: float = LARGE_SIGMA) -> DataFrame:
    """Percentage of |e| beyond ``sigmas`` standard deviations (0 when there is no spread)."""
    std = df.agg(F.stddev_pop(residual)).first()[0] or 0.0
    if std <= 0:
        return df.agg(F.lit(0.0).alias("pct_large"))
    hit = F.when(F.abs(F.col(residual)) > F.lit(sigmas * std), 1.0).otherwise(0.0)
    return df.where(F.col(residual).isNotNull()).agg((F.avg(hit) * 100).alias("pct_large"))


def outlier_profile(df: DataFrame, residual: str) -> DataFrame:
    """Share outside the 1st/99th percentiles and std after clipping there."""
    lo, hi = exact_quantiles(df, {"e": F.col(residual)}, [0.01, 0.99])["e"]
    e = F.col(residual)
    out = F.when((e < F.lit(lo)) | (e > F.lit(hi)), 1.0).otherwise(0.0)
    return df.where(e.isNotNull()).agg(
        F.lit(lo).alias("p01"), F.lit(hi).alias("p99"),
        F.avg(out).alias("outlier_fraction"),
        F.stddev_pop(expr.clip(e, lo, hi)).alias("winsorized_std"),
    )


def jarque_bera(df: DataFrame, residual: str) -> DataFrame:
    """Normality on all rows: n/6 (S^2 + K^2/4), p = exp(-JB/2)."""
    m = residual_moments(df, residual)
    jb = F.col("n") / 6.0 * (
        F.col("skewness") * F.col("skewness") + F.col("kurtosis") * F.col("kurtosis") / 4.0
    )
    return m.select("n", jb.alias("jb"), F.exp(-jb / 2.0).alias("p_value"), (F.exp(-jb / 2.0) > 0.05).alias("normal"))


def bimodality(df: DataFrame, residual: str) -> DataFrame:
    """Bimodality coefficient (skew^2 + 1) / (excess kurtosis + 3)."""
    m = residual_moments(df, residual)
    return m.select(
        "n",
        ((F.col("skewness") * F.col("skewness") + 1) / (F.col("kurtosis") + 3)).alias("coefficient"),
    )


def mixture_evidence(df: DataFrame, residual: str) -> DataFrame:
    """BIC of one Gaussian (closed form) against a two-component mixture; an improvement above
    10 is taken as two modes.

    The mixture is fitted on at most ``MIXTURE_CELLS`` value ranges (count, mean, variance), so
    EM costs one scan instead of one per iteration; its likelihood is then taken on all rows.
    """
    data = df.where(F.col(residual).isNotNull()).select(F.col(residual).cast("double").alias("e"))
    marks = [i / MIXTURE_CELLS for i in range(1, MIXTURE_CELLS)]
    row = data.agg(
        F.count("*").alias("n"), F.var_pop("e").alias("v"), F.percentile_approx("e", marks, 10_000).alias("q")
    ).first()
    schema = "n long, bic_one double, bic_two double, improvement double, multimodal boolean"
    n, v = row["n"], row["v"] or 0.0
    if n < MULTIMODAL_MIN_ROWS or v <= 0:
        return df.sparkSession.createDataFrame([(n, None, None, None, False)], schema)
    cells = (
        add_bucket(data, "e", list(row["q"]), "b").groupBy("b")
        .agg(F.count("*").alias("c"), F.avg("e").alias("m"), F.var_pop("e").alias("v")).orderBy("b").collect()
    )
    weight, mean, var = _two_gaussians(*(np.array([r[k] for r in cells], dtype=float) for k in ("c", "m", "v")))
    density = F.lit(0.0)
    for w, m, s2 in zip(weight, mean, var):
        d = F.col("e") - F.lit(float(m))
        density = density + F.lit(float(w / math.sqrt(2 * math.pi * s2))) * F.exp(d * d * F.lit(float(-0.5 / s2)))
    loglik = data.agg(F.sum(F.log(F.greatest(density, F.lit(1e-300))))).first()[0]
    one = n * (math.log(2 * math.pi * v) + 1) + 2 * math.log(n)
    two = -2 * loglik + 5 * math.log(n)
    return df.sparkSession.createDataFrame([(n, one, two, one - two, one - two > BIC_STRONG)], schema)


def _two_gaussians(c: np.ndarray, m: np.ndarray, v: np.ndarray, steps: int = 500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM for two Gaussians on cells with counts, means and variances; starts from the lower and
    the upper half."""
    upper = np.cumsum(c) > c.sum() / 2
    share = np.vstack([~upper, upper]).astype(float)
    floor = 1e-6 * max(float(np.average((m - np.average(m, weights=c)) ** 2 + v, weights=c)), 1e-300)
    for _ in range(steps):
        mass = share * c
        weight = mass.sum(axis=1) / c.sum()
        mean = (mass * m).sum(axis=1) / np.maximum(mass.sum(axis=1), 1e-300)
        spread = (m[None, :] - mean[:, None]) ** 2 + v
        var = np.maximum((mass * spread).sum(axis=1) / np.maximum(mass.sum(axis=1), 1e-300), floor)
        logp = np.log(np.maximum(weight, 1e-300))[:, None] - 0.5 * (np.log(2 * np.pi * var)[:, None] + spread / var[:, None])
        top = logp.max(axis=0)
        new = np.exp(logp - top)
        new /= new.sum(axis=0)
        if np.abs(new - share).max() < 1e-10:
            break
        share = new
    return weight, mean, var


def breusch_pagan(df: DataFrame, residual: str, features: list[str]) -> DataFrame:
    """LM = n R^2 of squared residuals on the features, from one pass of moments."""
    e = F.col(residual)
    cols = {**{c: expr.col(c) for c in features}, "__e2": e * e}
    m = grouped_moments(df, cols)[0]
    x, y = m.index(features), m.index(["__e2"])[0]
    beta = np.linalg.lstsq(m.scatter[np.ix_(x, x)], m.scatter[x, y], rcond=None)[0]
    r2 = float(beta @ m.scatter[x, y] / m.scatter[y, y]) if m.scatter[y, y] > 0 else 0.0
    lm = m.n * r2
    p = chi2_sf(lm, len(features))
    return df.sparkSession.createDataFrame(
        [(int(m.n), lm, p, p < 0.05)], "n long, lm double, p_value double, heteroscedastic boolean"
    )


def durbin_watson(df: DataFrame, residual: str, order: list[str]) -> DataFrame:
    """Sum of squared successive differences over the sum of squares, in global order."""
    placed = with_position(df.where(F.col(residual).isNotNull()).select(*order, residual), order)
    blocks = with_blocks(placed, "pos", 1)
    step = F.col(residual) - F.lag(residual).over(block_window("pos"))
    diffs = blocks.withColumn("d", step).where("own")
    return diffs.agg(
        F.count("*").alias("n"),
        F.try_divide(F.sum(F.col("d") * F.col("d")), F.sum(F.col(residual) * F.col(residual))).alias("durbin_watson"),
    )


def warning_texts(pct_large: Column, bp_p: Column, normal_p: Column, dw: Column) -> Column:
    """Codes of the diagnostics that look wrong."""
    return expr.messages(
        (pct_large > 10, F.lit("large_residuals")),
        (bp_p < 0.05, F.lit("heteroscedastic")),
        (normal_p <= 0.05, F.lit("non_normal")),
        ((dw < 1.5) | (dw > 2.5), F.lit("autocorrelated")),
    )


def residual_report(df: DataFrame, residual: str, features: list[str], order: list[str]) -> DataFrame:
    """All diagnostics of a residual column in one row."""
    one_row = (
        residual_moments(df, residual)
        .join(F.broadcast(large_share(df, residual)))
        .join(F.broadcast(outlier_profile(df, residual).drop("p01", "p99")))
        .join(F.broadcast(jarque_bera(df, residual).select("jb", F.col("p_value").alias("normal_p"))))
        .join(F.broadcast(breusch_pagan(df, residual, features).select("lm", F.col("p_value").alias("bp_p"))))
        .join(F.broadcast(durbin_watson(df, residual, order).select("durbin_watson")))
    )
    codes = warning_texts(F.col("pct_large"), F.col("bp_p"), F.col("normal_p"), F.col("durbin_watson"))
    return one_row.withColumn("warnings", F.concat_ws(",", codes))


def density_histogram(df: DataFrame, residual: str, bins: int = 50) -> DataFrame:
    """Density per equal-width bin with the normal curve of the same mean and std."""
    row = df.agg(
        F.min(residual).alias("lo"), F.max(residual).alias("hi"), F.avg(residual).alias("m"),
        F.stddev_pop(residual).alias("s"), F.count(residual).alias("n"),
    ).first()
    lo, hi, m, s, n = row["lo"], row["hi"], row["m"], row["s"], row["n"]
    width = (hi - lo) / bins or 1.0
    index = F.least(F.floor((F.col(residual) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(residual).isNotNull()).groupBy(index.alias("bin")).agg(F.count("*").alias("count"))
    mid = F.lit(lo) + (F.col("bin") + 0.5) * F.lit(width)
    z = (mid - F.lit(m)) / F.lit(s or 1.0)
    return counts.select(
        "bin", "count",
        (F.col("count") / F.lit(n * width)).alias("density"),
        (F.exp(-z * z / 2) / F.lit((s or 1.0) * math.sqrt(2 * math.pi))).alias("normal_density"),
    )


def top_importances(importances: DataFrame, k: int = 20) -> DataFrame:
    """Mean importance per feature over folds, largest first."""
    mean = importances.groupBy("feature").agg(F.avg("importance").alias("importance"))
    rank = Window.orderBy(F.desc("importance"), "feature")
    return (
        mean.orderBy(F.desc("importance"), "feature").limit(k).withColumn("rank", F.row_number().over(rank))
    )
