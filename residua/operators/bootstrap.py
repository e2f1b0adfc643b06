"""Resampling checks of rules: every rule and every replicate in one pass."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.config import BOOTSTRAP_GATES
from residua.functions import expr
from residua.functions.dist import normal_cdf, normal_ppf
from residua.functions.hashing import poisson_weight, with_draws
from residua.functions.quantiles import exact_quantiles
from residua.operators.rules import Rule
from residua.session import spread

# Gates in the order that decides ties between rejection reasons.
GATE_REASONS = ["low_variance", "low_range", "support_too_sparse", "support_too_broad"]
BCA_MIN_N = 100
DRAWN_ROWS = 1000  # rows whose draws are held at once

# Fallback stability thresholds by mode; fixed values.
FIXED_THRESHOLDS = {"demo": 0.5, "production": 0.7}


def activity_cuts(df: DataFrame, rules: list[Rule]) -> dict[str, float]:
    """Score above which a rule counts as active: 0 for 0/1 rules, the train median for
    continuous ones (they are positive everywhere, so 0 would say nothing)."""
    graded = [r for r in rules if not r.binary()]
    cuts = {r.name: 0.0 for r in rules}
    if graded:
        got = exact_quantiles(df, {r.name: r.column() for r in graded}, [0.5])
        cuts |= {n: q[0] or 0.0 for n, q in got.items()}
    return cuts


def _weighted(df: DataFrame, seed: int, replicates: int) -> DataFrame:
    """One row per (row, replicate) with a positive Poisson(1) weight ``w``; key column ``k``."""
    drawn = with_draws(df, F.col("k"), str(seed), replicates, "replicate", "u")
    return drawn.withColumn("w", poisson_weight(F.col("u"))).where(F.col("w") > 0)


def replicate_stats(df: DataFrame, key: str, rules: list[Rule], replicates: int = 50, seed: int = 42, cuts: dict[str, float] | None = None) -> DataFrame:
    """Poisson bootstrap: variance, range, support and standardised range of each rule in each
    replicate.  Weights come from the row key; nothing is resampled or shuffled before the
    aggregation, whose output is replicates x rules."""
    cuts = cuts or activity_cuts(df, rules)
    scored = spread(df.select(F.col(key).alias("k"), F.array(*[r.column() for r in rules]).alias("s")))
    rows = _weighted(scored, seed, replicates)
    cells = []
    for i, r in enumerate(rules):
        s, w = F.get("s", F.lit(i)), F.col("w").cast("double")
        cells.append(
            F.struct(
                F.lit(r.name).alias("name"), F.sum(w).alias("n"), F.sum(w * s).alias("s1"),
                F.sum(w * s * s).alias("s2"), F.min(s).alias("lo"), F.max(s).alias("hi"),
                F.sum(F.when(s > F.lit(cuts[r.name]), w).otherwise(0.0)).alias("active"),
            ).alias(f"c{i}")
        )
    wide = rows.groupBy("replicate").agg(*cells)
    long = wide.select("replicate", F.explode(F.array(*[F.col(f"c{i}") for i in range(len(rules))])).alias("c")).select("replicate", "c.*")
    variance = F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - (F.col("s1") / F.col("n")) * (F.col("s1") / F.col("n")))
    std = F.sqrt(F.try_divide(variance * F.col("n"), F.col("n") - 1))
    span = F.col("hi") - F.col("lo")
    return long.select(
        "name", "replicate", variance.alias("variance"), span.alias("score_range"),
        (F.col("active") / F.col("n")).alias("support"),
        F.when((std > 0) & (span > 0), span / std).alias("effect"),
    )


def survival(stats: DataFrame, mode: str = "demo", threshold: float | None = None) -> DataFrame:
    """Gate outcomes per rule: presence rate, status, rejection reason, diagnostics and the
    percentile interval of the standardised range."""
    g = BOOTSTRAP_GATES[mode]
    limit = g["presence"] if threshold is None else threshold
    fails = {
        "fail_variance": ~(F.col("variance") > g["min_variance"]),
        "fail_range": ~(F.col("score_range") > g["min_range"]),
        "fail_support_low": ~(F.col("support") >= g["min_support"]),
        "fail_support_high": ~(F.col("support") <= g["max_support"]),
    }
    any_fail = None
    for cond in fails.values():
        any_fail = cond if any_fail is None else any_fail | cond
    # a rule has at most 500 replicates, so the exact percentile is over a bounded set
    agg = stats.groupBy("name").agg(
        F.count("*").alias("total"),
        F.count_if(~any_fail).alias("survived"),
        *[F.count_if(cond).alias(n) for n, cond in fails.items()],
        F.avg("variance").alias("mean_variance"),
        F.avg("score_range").alias("mean_range"),
        F.avg("support").alias("mean_support"),
        F.avg("effect").alias("effect_mean"),
        F.percentile("effect", F.lit(0.025)).alias("effect_ci_lower"),
        F.percentile("effect", F.lit(0.975)).alias("effect_ci_upper"),
    )
    presence = F.col("survived") / F.col("total")
    status = F.when(presence >= limit, "validated").otherwise("rejected")
    return agg.withColumn("presence_rate", presence).withColumn("status", status).withColumn(
        "rejection_reason", F.when(F.col("status") == "rejected", rejection_reason())
    )


def rejection_reason() -> Column:
    """The gate that failed most often (first in gate order on ties)."""
    counts = [F.col(c) for c in ("fail_variance", "fail_range", "fail_support_low", "fail_support_high")]
    worst = F.greatest(*counts)
    out = F.lit(None).cast("string")
    for c, reason in reversed(list(zip(counts, GATE_REASONS))):
        out = F.when(c == worst, F.lit(reason)).otherwise(out)
    return F.when(worst == 0, F.lit("low_presence_rate")).otherwise(out)


def bootstrap_means(df: DataFrame, key: str, value: Column, replicates: int = 50, seed: int = 42) -> DataFrame:
    """Bootstrap distribution of a mean: one row per replicate."""
    base = df.select(F.col(key).alias("k"), value.cast("double").alias("v")).where(F.col("v").isNotNull())
    rows = _weighted(spread(base), seed, replicates)
    return rows.groupBy("replicate").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("statistic"))


def percentile_interval(stats: DataFrame, column: str = "statistic", confidence: float = 0.95) -> DataFrame:
    """Percentile interval over bootstrap replicates (a bounded set)."""
    a = (1 - confidence) / 2
    return stats.agg(
        F.count(column).alias("n_used"),
        F.percentile(column, F.lit(a)).alias("lower"),
        F.percentile(column, F.lit(1 - a)).alias("upper"),
    )


def mean_acceleration(df: DataFrame, value: Column) -> tuple[int, float, float]:
    """(n, mean, acceleration) of a mean.  The jackknife has the closed form
    sum d^3 / (6 (sum d^2)^1.5) with d the deviations, so no leave-one-out pass is made."""
    v = expr.finite(value)
    row = df.agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("v"), F.skewness(v).alias("g")).first()
    n = row["n"]
    if not n or not row["v"]:
        return n, row["m"] if row["m"] is not None else float("nan"), 0.0
    return n, row["m"], row["g"] / (6.0 * math.sqrt(n))


def _percentile(values: list[float], p: float) -> float:
    h = (len(values) - 1) * p
    low = math.floor(h)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (h - low)


def bca_interval(values: list[float], point: float | None, acceleration: float | None, n_total: int, confidence: float = 0.95) -> tuple[float, float, str, int]:
    """Bias-corrected accelerated interval of bootstrap values: (lower, upper, method, used).
    Falls back to percentiles for small samples and to nan when nothing is finite."""
    finite = sorted(v for v in values if v is not None and math.isfinite(v))
    if not finite:
        return float("nan"), float("nan"), "degenerate", 0
    a = (1 - confidence) / 2
    plain = (_percentile(finite, a), _percentile(finite, 1 - a), "percentile", len(finite))
    if n_total < BCA_MIN_N or acceleration is None:
        return plain
    centre = point if point is not None and math.isfinite(point) else _percentile(finite, 0.5)
    below = min(max(sum(v < centre for v in finite) / len(finite), 1e-6), 1 - 1e-6)
    z0 = normal_ppf(below)

    def adjusted(z: float) -> float:
        denominator = 1 - acceleration * (z0 + z)
        return a if denominator == 0 else normal_cdf(z0 + (z0 + z) / denominator)

    lo, hi = (min(1.0, max(0.0, adjusted(normal_ppf(p)))) for p in (a, 1 - a))
    if lo >= hi:
        return plain
    return _percentile(finite, lo), _percentile(finite, hi), "bca", len(finite)


def bca_mean(df: DataFrame, key: str, value: Column, replicates: int = 200, seed: int = 42) -> tuple[float, float, str, int]:
    n, mean, acceleration = mean_acceleration(df, value)
    stats = [r["statistic"] for r in bootstrap_means(df, key, value, replicates, seed).collect()]
    return bca_interval(stats, mean, acceleration, n)


def cohens_d_column(n1: Column, s1: Column, q1: Column, n2: Column, s2: Column, q2: Column) -> Column:
    """Pooled Cohen's d from counts, sums and sums of squares of two groups (population
    variances in the pool; 0 for a group below 2 rows or no spread)."""
    m1, m2 = F.try_divide(s1, n1), F.try_divide(s2, n2)
    v1 = F.greatest(F.lit(0.0), F.try_divide(q1, n1) - m1 * m1)
    v2 = F.greatest(F.lit(0.0), F.try_divide(q2, n2) - m2 * m2)
    pooled = F.sqrt(F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2))
    return F.when((n1 < 2) | (n2 < 2), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(m1 - m2, pooled), F.lit(0.0)))


def group_d(df: DataFrame, value: Column, in_group: Column) -> DataFrame:
    """Cohen's d between the rows inside and outside a condition, in one aggregation."""
    v, g = value.cast("double"), in_group
    one, two = F.when(g, v), F.when(~g, v)
    return df.agg(
        F.count(one).cast("double").alias("n1"), F.count(two).cast("double").alias("n2"),
        F.sum(one).alias("s1"), F.sum(two).alias("s2"), F.sum(one * one).alias("q1"), F.sum(two * two).alias("q2"),
    ).select(
        F.col("n1").cast("long").alias("n_in"), F.col("n2").cast("long").alias("n_out"),
        cohens_d_column(*[F.col(c) for c in ("n1", "s1", "q1", "n2", "s2", "q2")]).alias("cohens_d"),
    )


def _relabelled(salt: str, n: int, share: float):
    """Counts, sums and sums of squares of both groups of ``n`` relabellings of a task's (k, v): a row per replicate.
    The draws are those of ``hashing.with_draws``, without a row for each."""
    tails = [f":{salt}:{c}".encode() for c in range((n + 3) // 4)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, whole = np.zeros((3, n)), np.zeros((3, 1))
        for b in batches:
            for lo in range(0, b.num_rows, DRAWN_ROWS):
                part = b.slice(lo, DRAWN_ROWS)
                keys, v = [k.encode() for k in part.column(0).to_pylist()], part.column(1).to_numpy()
                hashes = b"".join([md5(k + t).digest() for k in keys for t in tails])
                drawn = np.frombuffer(hashes, ">u4").reshape(len(keys), -1)[:, :n]
                powers = np.stack([np.ones(len(v)), v, v * v])
                one += powers @ (drawn / 4294967296.0 < share).astype(float)
                whole += powers.sum(1, keepdims=True)
        columns = [*one, *(whole - one)]
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), *map(pa.array, columns)], names=["replicate", "n1", "s1", "q1", "n2", "s2", "q2"])

    return add


def permutation_test(df: DataFrame, key: str, value: Column, in_group: Column, permutations: int = 1000, seed: int = 42) -> DataFrame:
    """Two-sided p of Cohen's d under random relabelling.

    Each replicate labels a row by its key's hash with the observed group share, which needs
    no sort or join; replicates are summed map-side.  (Group sizes vary around the observed
    ones; d is computed with the drawn sizes.)
    """
    base = df.select(F.col(key).alias("k"), value.cast("double").alias("v"), in_group.alias("g")).where(
        F.col("v").isNotNull() & F.col("g").isNotNull()
    )
    observed = group_d(base, F.col("v"), F.col("g")).first()
    share = observed["n_in"] / (observed["n_in"] + observed["n_out"])
    rows = spread(base.select("k", "v")).select(F.col("k").cast("string").alias("k"), "v").where("k IS NOT NULL")
    names = ["n1", "s1", "q1", "n2", "s2", "q2"]
    parts = rows.mapInArrow(_relabelled(f"perm{seed}", permutations, share), "replicate int, " + ", ".join(f"{c} double" for c in names))
    d = parts.groupBy("replicate").agg(
        *[F.sum(c).alias(c) for c in names]
    ).select(cohens_d_column(*[F.col(c) for c in ("n1", "s1", "q1", "n2", "s2", "q2")]).alias("d"))
    hit = F.when(F.abs("d") >= F.lit(abs(observed["cohens_d"])), 1.0).otherwise(0.0)
    return d.agg(
        F.lit(observed["cohens_d"]).alias("observed"), F.count("*").alias("permutations"), F.avg(hit).alias("p_value")
    )


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cramer's V of two categorical columns (Yates correction for 2 x 2 tables)."""
    cells = df.where(expr.col(a).isNotNull() & expr.col(b).isNotNull()).groupBy(
        expr.col(a).alias("a"), expr.col(b).alias("b")
    ).agg(F.count("*").alias("o"))
    rows = cells.groupBy("a").agg(F.sum("o").alias("ra"))
    cols = cells.groupBy("b").agg(F.sum("o").alias("cb"))
    totals = rows.agg(
        F.sum("ra").alias("n"), F.count("*").alias("r"), F.sum(F.lit(1.0) / F.col("ra")).alias("inv_r")
    ).join(F.broadcast(cols.agg(F.count("*").alias("k"), F.sum(F.lit(1.0) / F.col("cb")).alias("inv_c"))))
    seen = cells.join(rows, "a").join(cols, "b").join(F.broadcast(totals))
    expected = F.col("ra") * F.col("cb") / F.col("n")
    gap = F.abs(F.col("o") - expected)
    parts = seen.agg(
        F.sum(gap * gap / expected).alias("chi_seen"), F.sum(expected).alias("expected_seen"),
        F.max(gap).alias("gap"), F.max("n").alias("n"), F.max("r").alias("r"), F.max("k").alias("k"),
        F.max("inv_r").alias("inv_r"), F.max("inv_c").alias("inv_c"),
    )
    # cells that never occur contribute their expected count: the total minus the expected
    # counts of the occupied cells.  In a 2 x 2 table all four gaps are equal.
    plain = F.col("chi_seen") + (F.col("n") - F.col("expected_seen"))
    corrected = F.greatest(F.lit(0.0), F.col("gap") - 0.5)
    yates = corrected * corrected * F.col("n") * F.col("inv_r") * F.col("inv_c")
    chi = F.when((F.col("r") == 2) & (F.col("k") == 2), yates).otherwise(plain)
    smaller = F.least("r", "k") - 1
    return parts.select(
        "n", chi.alias("chi2"),
        F.when((F.col("n") == 0) | (smaller == 0), F.lit(0.0)).otherwise(F.sqrt(chi / (F.col("n") * smaller))).alias("cramers_v"),
    )


def presence_threshold(table: DataFrame | None, runs: DataFrame) -> DataFrame:
    """Stability threshold per run (name, n_rows, mode, problem): the calibration entry of the
    largest row bucket not above n_rows, else the fixed value of the mode.  The lowest bucket
    serves smaller runs.  The calibration table has a few dozen rows."""
    fixed = F.when(F.col("mode") == "demo", FIXED_THRESHOLDS["demo"]).otherwise(FIXED_THRESHOLDS["production"])
    if table is None:
        return runs.select("name", fixed.alias("threshold"))
    grid = table.agg(F.array_sort(F.collect_set("bucket")).alias("grid"))
    below = F.filter("grid", lambda b: b <= F.col("n_rows"))
    placed = runs.join(F.broadcast(grid)).withColumn(
        "bucket", F.when(F.size(below) > 0, F.element_at(below, -1)).otherwise(F.element_at("grid", 1))
    )
    return placed.join(table, ["bucket", "mode", "problem"], "left").select(
        "name", F.coalesce(F.col("threshold"), fixed).alias("threshold")
    )


def holdout_check(holdout: DataFrame, rules: list[Rule]) -> DataFrame:
    """Re-apply the stored rules to the holdout: at least 5 rows on and off, some variance and
    some range."""
    cells = []
    for i, r in enumerate(rules):
        s = r.column()
        cells.append(
            F.struct(
                F.lit(r.name).alias("name"), F.count_if(s > 0).alias("n_on"), F.count_if(~(s > 0)).alias("n_off"),
                F.var_pop(s).alias("variance"), (F.max(s) - F.min(s)).alias("score_range"),
            ).alias(f"c{i}")
        )
    wide = holdout.agg(*cells)
    long = wide.select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(rules))])).alias("c")).select("c.*")
    ok = (F.col("n_on") >= 5) & (F.col("n_off") >= 5) & (F.col("variance") > 1e-6) & (F.col("score_range") > 0.01)
    return long.withColumn("holdout_validated", F.coalesce(ok, F.lit(False)))
