"""Features along which the size of the error changes, and interaction signals."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.functions import expr
from residua.functions.dist import CHI2_1_CRITICAL_05, correlation_p
from residua.functions.moments import packed_arrays, summed_arrays
from residua.functions.quantiles import exact_quantiles

MIN_ROWS, MIN_SPREAD, BINS = 4, 2.0, 5


def likelihood_ratios(df: DataFrame, features: list[str], residual: str) -> DataFrame:
    """Gaussian likelihood-ratio of |e| ~ feature against a constant, all features in one
    aggregation: LR = -n ln(1 - r^2) over the rows where both are finite."""
    e = F.abs(expr.finite(F.col(residual)))
    cells = []
    for i, c in enumerate(features):
        x = expr.finite(expr.col(c))
        y = F.when(x.isNotNull(), e)
        x = F.when(y.isNotNull(), x)
        r = expr.safe_corr(x, y)
        n = F.count(x)
        usable = (n >= MIN_ROWS) & (F.var_samp(y) > 0) & (r * r < 1)
        lr = F.when(usable, F.lit(-1.0) * n * F.log(F.lit(1.0) - r * r))
        cells.append(
            F.struct(
                F.lit(c).alias("feature"), n.alias("n"), F.regr_slope(y, x).alias("slope"), lr.alias("lr_stat")
            ).alias(f"c{i}")
        )
    wide = df.agg(*cells)
    return (
        wide.select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(features))])).alias("s"))
        .select("s.*")
        .withColumn("significant", F.coalesce(F.col("lr_stat") > CHI2_1_CRITICAL_05, F.lit(False)))
    )


def spread_ratios(df: DataFrame, features: list[str], residual: str, bins: int = BINS) -> DataFrame:
    """Largest over smallest mean |e| among quantile bins (left-closed) of each feature."""
    e = F.abs(expr.finite(F.col(residual)))
    base = df.where(e.isNotNull())
    edges = exact_quantiles(
        base, {c: expr.finite(expr.col(c)) for c in features}, [i / bins for i in range(bins + 1)]
    )
    entries = []
    for c in features:
        cuts = sorted({q for q in edges[c] if q is not None})
        if len(cuts) < 2:
            continue
        x = expr.finite(expr.col(c))
        index = F.lit(0)
        for cut in cuts[1:-1]:
            index = index + (x >= F.lit(cut)).cast("int")
        entries.append(F.struct(F.lit(c).alias("feature"), F.when(x.isNotNull(), index).alias("bin")))
    long = base.select(e.alias("e"), F.explode(F.filter(F.array(*entries), lambda s: s["bin"].isNotNull())).alias("s"))
    means = (
        long.groupBy("s.feature", "s.bin").agg(F.count("*").alias("n"), F.avg("e").alias("m")).where(F.col("n") >= 2)
    )
    low = F.min("m")
    return means.groupBy("feature").agg(
        F.count("*").alias("bins"),
        F.when(low <= 0, F.lit(float("inf"))).otherwise(F.max("m") / low).alias("spread_ratio"),
    )


def variance_regimes(df: DataFrame, features: list[str], residual: str, min_spread: float = MIN_SPREAD) -> DataFrame:
    """Features that pass both the likelihood-ratio test and the spread gate."""
    found = likelihood_ratios(df, features, residual).where("significant")
    return (
        found.join(spread_ratios(df, features, residual), "feature")
        .where(F.col("spread_ratio") >= min_spread)
        .select(
            F.lit("variance_regime").alias("pattern_type"), F.col("feature").alias("column_name"),
            "lr_stat", "spread_ratio", "n",
        )
        .orderBy(F.desc("lr_stat"))
    )


def _pairs(features: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]


def interaction_correlations(df: DataFrame, features: list[str], residual: str, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """corr(a*b, residual) with its p-value for feature pairs, in one aggregation."""
    pairs = pairs or _pairs(features)
    e = expr.finite(F.col(residual))
    cells = []
    for i, (a, b) in enumerate(pairs):
        x = expr.finite(expr.col(a)) * expr.finite(expr.col(b))
        cells += [expr.safe_corr(x, e).alias(f"r{i}"), F.count_if(x.isNotNull() & e.isNotNull()).alias(f"n{i}")]
    row = df.agg(*cells).first()
    rows = []
    for i, (a, b) in enumerate(pairs):
        r, n = row[f"r{i}"], row[f"n{i}"]
        if r is not None:
            p = correlation_p(r, n)
            rows.append((a, b, r, n, p, abs(r) > 0.1 and p < 0.05))
    return df.sparkSession.createDataFrame(
        rows, "feature_a string, feature_b string, r double, n long, p_value double, significant boolean"
    )


def interaction_strengths(df: DataFrame, features: list[str], residual: str) -> DataFrame:
    """Partial R^2 of the centred product of each pair on the residual given both features.

    One pass: every task adds up ten p x p matrices over all pairs at once, so p features cost O(p^2)
    numbers.  Each pair uses the rows where both its features and the residual are finite; the residual
    is centred so that sums of squares keep their digits."""
    pairs = _pairs(features)
    p = len(features)
    names = [f"x{i}" for i in range(p)]
    wide = df.select(*[expr.finite(expr.col(c)).cast("double").alias(n) for c, n in zip(features, names)], expr.finite(F.col(residual)).cast("double").alias("e"))
    wide = wide.where(F.col("e").isNotNull())
    stats = wide.agg(*[F.avg(n).alias(n) for n in [*names, "e"]], *[F.stddev_pop(n).alias(f"s{n}") for n in [*names, "e"]]).first()
    centre = np.array([stats[n] or 0.0 for n in [*names, "e"]])
    scale = np.array([stats[f"s{n}"] or 1.0 for n in [*names, "e"]])

    def partial(batches):
        total = np.zeros(10 * p * p)
        for pdf in batches:
            z = (pdf.to_numpy(dtype=float) - centre) / scale
            x, e = z[:, :p], z[:, p:]
            m = np.isfinite(x).astype(float)
            x = np.where(m > 0, x, 0.0)
            xx = x * x
            parts = (m.T @ m, x.T @ m, m.T @ (e * m), xx.T @ m, x.T @ x, m.T @ (e * e * m), x.T @ (e * m), xx.T @ x, x.T @ (e * x), xx.T @ xx)
            total += np.concatenate([part.ravel() for part in parts])
        yield from packed_arrays({0: total})

    sums = summed_arrays(wide.mapInPandas(partial, "g int, slot int, v binary")) if p else {}
    n, a, e, aa, ab, ee, ae, aab, abe, aabb = sums.get(0, np.zeros(10 * p * p)).reshape(10, p, p)
    rows = []
    for j, k in ((features.index(x), features.index(y)) for x, y in pairs):
        # a, b, the product and the residual of this pair's rows
        first = np.array([a[j, k], a[k, j], ab[j, k], e[j, k]])
        second = np.array(
            [
                [aa[j, k], ab[j, k], aab[j, k], ae[j, k]], [ab[j, k], aa[k, j], aab[k, j], ae[k, j]],
                [aab[j, k], aab[k, j], aabb[j, k], abe[j, k]], [ae[j, k], ae[k, j], abe[j, k], ee[j, k]],
            ]
        )
        s = second - np.outer(first, first) / n[j, k] if n[j, k] else np.zeros((4, 4))
        rows.append((features[j], features[k], _partial_r2(s)))
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, strength double")


def _partial_r2(s) -> float:
    """Squared partial correlation of entries 2 and 3 given 0 and 1 of a scatter matrix."""
    base = s[:2, :2]
    adjust = s[2:, :2] @ np.linalg.pinv(base) @ s[:2, 2:]
    rest = s[2:, 2:] - adjust
    if rest[0, 0] <= 0 or rest[1, 1] <= 0:
        return 0.0
    r2 = rest[0, 1] ** 2 / (rest[0, 0] * rest[1, 1])
    return 0.0 if math.isnan(r2) else float(r2)


def rank_interactions(strengths: DataFrame, k: int = 10) -> DataFrame:
    """Positive strengths, strongest pair first."""
    return (
        strengths.where(F.col("strength") > 0).orderBy(F.desc("strength"), "feature_a", "feature_b").limit(k)
    )


def bounded_features(importances: DataFrame, k: int = 20) -> DataFrame:
    """The features worth scanning: top ``k`` by mean |attribution|."""
    return importances.orderBy(F.desc("importance"), "feature").limit(k)
