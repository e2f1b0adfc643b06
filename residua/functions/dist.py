"""Tail probabilities.

Two forms: plain Python on a handful of summary statistics, and Column expressions
where a whole result table needs p-values.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

CHI2_1_CRITICAL_05 = 3.841458820694124
_NORMAL = NormalDist()


def normal_cdf(x: float) -> float:
    return _NORMAL.cdf(x)


def normal_ppf(p: float) -> float:
    return _NORMAL.inv_cdf(min(max(p, 1e-300), 1 - 1e-16))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi2_sf(x: float, df: float) -> float:
    """P(chi-square(df) > x) by the regularised incomplete gamma function."""
    if x <= 0 or math.isnan(x):
        return 1.0
    a, half = df / 2.0, x / 2.0
    front = math.exp(a * math.log(half) - half - math.lgamma(a))
    if half < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= half / k
            total += term
        return max(0.0, 1.0 - total * front)
    b = half + 1.0 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 2000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        step = d * c
        h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return front * h


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_cdf(1.0 - x, b, a)
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 1000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h / a


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / (df + t * t), df / 2.0, 0.5)


def f_sf(x: float, d1: float, d2: float) -> float:
    if x <= 0:
        return 1.0
    return beta_cdf(d2 / (d2 + d1 * x), d2 / 2.0, d1 / 2.0)


def correlation_p(r: float, n: int) -> float:
    """Two-sided p of a Pearson/Spearman coefficient by the t approximation."""
    if n < 3 or math.isnan(r):
        return 1.0
    if abs(r) >= 1.0:
        return 0.0
    return t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def binomial_upper(successes: int, trials: int, alpha: float = 0.05) -> float:
    """One-sided exact upper bound of a proportion (bisection on the beta CDF)."""
    if trials <= 0 or successes >= trials:
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        if beta_cdf(mid, successes + 1, trials - successes) < 1.0 - alpha:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2.0


def kendall_exact_p(tau: float, n: int) -> float:
    """Two-sided exact p of Kendall's tau without ties (counts of inversions)."""
    counts = [1]
    for m in range(2, n + 1):
        grown = [0] * (len(counts) + m - 1)
        for i, c in enumerate(counts):
            for j in range(m):
                grown[i + j] += c
        counts = grown
    pairs = n * (n - 1) // 2
    discordant = round((1.0 - tau) * pairs / 2.0)
    total = math.factorial(n)
    c = min(discordant, pairs - discordant)
    if 2 * c == pairs:
        return 1.0
    return min(1.0, 2.0 * sum(counts[: c + 1]) / total)


def kolmogorov_sf(x: Column, terms: int = 100) -> Column:
    """Q(x) = 2 * sum (-1)^(k-1) exp(-2 k^2 x^2), as a column; 1 when x is tiny."""
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
        * F.exp(F.lit(-2.0) * k * k * x * x),
    )
    return F.when(x < 0.2, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(2.0) * series))
    )


def kolmogorov_sf_value(x: float, terms: int = 100) -> float:
    if x < 0.2:
        return 1.0
    total = sum((1 if k % 2 else -1) * math.exp(-2.0 * k * k * x * x) for k in range(1, terms + 1))
    return min(1.0, max(0.0, 2.0 * total))
