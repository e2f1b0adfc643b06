"""Plausibility checks of a rule's column: proxy, reverse causality, confounding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.functions import expr
from residua.functions.hashing import bucket_of
from residua.functions.moments import Moments, grouped_moments, ridge, total
from residua.operators.models import train_moments
from residua.operators.profile import correlation_matrix

PROXY, REVERSE, MODERATE, PARTIAL = 0.95, 0.95, 0.8, 0.8
MIN_ROWS, DML_ROWS, DML_FOLDS, DML_RATIO, DML_RAW = 10, 60, 2, 0.3, 0.05
PENALTY = 0.5


def proxies(df: DataFrame, columns: list[str], limit: float = PROXY) -> DataFrame:
    """Columns that (nearly) repeat another feature."""
    pairs = correlation_matrix(df, columns)
    rows = [(c, o, r) for (a, b), r in pairs.items() if abs(r) > limit for c, o in ((a, b), (b, a))]
    return df.sparkSession.createDataFrame(rows, "column_name string, proxy_of string, r double")


def partial_correlation(m: Moments, x: str, y: str, controls: list[str]) -> float:
    """Correlation of x and y after removing linear effects of the controls."""
    i = m.index([x, y])
    s = m.scatter[np.ix_(i, i)]
    if controls:
        j = m.index(controls)
        cross = m.scatter[np.ix_(j, i)]
        s = s - cross.T @ np.linalg.pinv(m.scatter[np.ix_(j, j)]) @ cross
    if s[0, 0] <= 0 or s[1, 1] <= 0:
        return float("nan")
    return float(s[0, 1] / np.sqrt(s[0, 0] * s[1, 1]))


def reverse_causal(df: DataFrame, column: str, target: str, controls: list[str]) -> DataFrame:
    """Flag a column that looks like a consequence of the target: |r| > 0.95, or |r| > 0.8 with a
    partial correlation above 0.8.  Missing controls count as 0."""
    cols = {
        column: expr.as_double(expr.col(column)),
        target: expr.as_double(expr.col(target)),
        **{c: F.coalesce(expr.as_double(expr.col(c)), F.lit(0.0)) for c in controls},
    }
    m = grouped_moments(df, cols).get(0)
    schema = "column_name string, n long, r double, partial_r double, reverse boolean"
    if m is None or m.n < MIN_ROWS:
        return df.sparkSession.createDataFrame([(column, int(m.n) if m else 0, None, None, False)], schema)
    r = partial_correlation(m, column, target, [])
    part = partial_correlation(m, column, target, controls) if controls else None
    enough = m.n > len(controls) + 2
    flag = abs(r) > REVERSE or (
        abs(r) > MODERATE and bool(controls) and enough and part is not None and abs(part) > PARTIAL
    )
    return df.sparkSession.createDataFrame([(column, int(m.n), r, part, bool(flag))], schema)


def orthogonal_effect(df: DataFrame, key: str, treatment: str, target: str, controls: list[str], seed: int = 42) -> dict | None:
    """Double machine learning with ridge nuisances over two hash folds.

    Both nuisance fits and the final residual sums come from per-fold moments: residuals are
    linear in the columns, so their products are quadratic forms and rows are read once.
    """
    if not controls:
        return None
    cols = {c: expr.as_double(expr.col(c)) for c in dict.fromkeys([treatment, target, *controls])}
    folds = grouped_moments(df, cols, bucket_of(F.col(key), f"dml{seed}", DML_FOLDS))
    whole = total(list(folds.values())) if folds else None
    if whole is None or whole.n < DML_ROWS or len(folds) < DML_FOLDS or min(m.n for m in folds.values()) < 5:
        return None
    t, y = whole.index([treatment, target])
    if whole.scatter[t, t] / whole.n < 1e-18 or whole.scatter[y, y] / whole.n < 1e-18:
        return None
    raw = whole.scatter[t, y] / whole.scatter[t, t]
    tt = ty = 0.0
    for k, m in folds.items():
        train = train_moments(folds, k)
        gt = _residual_weights(m, train, treatment, controls)
        gy = _residual_weights(m, train, target, controls)
        tt += _product(m, gt, gt)
        ty += _product(m, gt, gy)
    if tt < 1e-12:
        return None
    theta = ty / tt
    confounded = abs(raw) >= DML_RAW and abs(theta) / max(abs(raw), 1e-9) < DML_RATIO
    return {
        "column_name": treatment, "theta_raw": float(raw), "theta_dml": float(theta),
        "n_used": int(whole.n), "n_controls": len(controls), "confounded": bool(confounded),
    }


def _residual_weights(m: Moments, train: Moments, name: str, controls: list[str]) -> tuple[np.ndarray, float]:
    """Residual of ``name`` as weights over all columns and a constant."""
    intercept, beta = ridge(train, controls, name, 1.0)
    w = np.zeros(len(m.names))
    w[m.index([name])[0]] = 1.0
    w[m.index(controls)] -= beta
    return w, -intercept


def _product(m: Moments, a: tuple[np.ndarray, float], b: tuple[np.ndarray, float]) -> float:
    """Sum over a fold's rows of the product of two linear forms."""
    return float(a[0] @ m.scatter @ b[0] + m.n * (a[0] @ m.mean + a[1]) * (b[0] @ m.mean + b[1]))


DML_SCHEMA = "column_name string, theta_raw double, theta_dml double, n_used long, n_controls int, confounded boolean"


def orthogonal_effects(df: DataFrame, key: str, treatments: list[str], target: str, controls: list[str]) -> DataFrame:
    rows = []
    for t in treatments:
        got = orthogonal_effect(df, key, t, target, [c for c in controls if c != t])
        if got:
            rows.append(tuple(got.values()))
    return df.sparkSession.createDataFrame(rows, DML_SCHEMA)


def penalised(candidates: DataFrame) -> DataFrame:
    """Halve the importance once per failed check (boolean columns proxy, reverse, confounded)
    and list the failed checks."""
    failed = expr.messages(
        (F.col("proxy"), F.lit("proxy_for_feature")),
        (F.col("reverse"), F.lit("possible_reverse_causality")),
        (F.col("confounded"), F.lit("confounded_by_dml")),
    )
    factor = F.pow(F.lit(PENALTY), F.size(failed).cast("double"))
    return candidates.select(
        "*", factor.alias("penalty"), (F.col("importance") * factor).alias("penalised_importance"),
        F.concat_ws(",", failed).alias("causal_warnings"),
    )


def check_columns(df: DataFrame, key: str, columns: list[str], target: str, features: list[str]) -> dict[str, dict]:
    """All three checks for the given columns."""
    flagged = {r["column_name"] for r in proxies(df, features).collect()} if len(features) > 1 else set()
    out = {}
    for c in columns:
        others = [f for f in features if f != c]
        reverse = reverse_causal(df, c, target, others).first()["reverse"]
        dml = orthogonal_effect(df, key, c, target, others)
        out[c] = {"proxy": c in flagged, "reverse": reverse, "confounded": bool(dml and dml["confounded"])}
    return out
