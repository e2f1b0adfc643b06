"""Greedy forward selection of latent variables by holdout gain."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.functions import expr
from residua.functions.moments import Moments, grouped_moments, ridge
from residua.operators.cv import fold_auc, fold_scores
from residua.operators.models import quadratic_error
from residua.operators.rules import Rule
from residua.session import durable

MIN_HOLDOUT = 20


def holdout_r2(train: Moments, holdout: Moments, columns: list[str], target: str, alpha: float) -> float:
    """R-squared on the holdout of a ridge fit on the training moments."""
    a, b = ridge(train, columns, target, alpha)
    y = holdout.index([target])[0]
    sst = holdout.scatter[y, y]
    return float(1.0 - quadratic_error(holdout, columns, target, a, b) / sst) if sst > 0 else 0.0


def forward_selection(train: DataFrame, holdout: DataFrame, features: list[str], rules: list[Rule], target: str, alpha: float = 1.0) -> list[dict]:
    """Add the rule with the best holdout gain until none helps.  The moments of features and
    all rules are read once per table; every trial is a small solve."""
    cols = {**{c: expr.col(c) for c in features}, **{r.name: r.column() for r in rules}, target: expr.col(target)}
    fitted = grouped_moments(train, cols).get(0)
    held = grouped_moments(holdout, cols).get(0)
    if not fitted or not held or held.n < MIN_HOLDOUT:
        return []
    return select_rules(fitted, held, features, [r.name for r in rules], target, alpha)


def select_rules(fitted: Moments, held: Moments, features: list[str], names: list[str], target: str, alpha: float = 1.0) -> list[dict]:
    baseline = current = holdout_r2(fitted, held, features, target, alpha)
    chosen: list[str] = []
    steps = []
    remaining = list(names)
    while remaining:
        trials = [(holdout_r2(fitted, held, [*features, *chosen, n], target, alpha), n) for n in remaining]
        best, name = max(trials, key=lambda t: (t[0], -remaining.index(t[1])))
        if best - current <= 0:
            break
        chosen.append(name)
        remaining.remove(name)
        steps.append(
            {
                "name": name, "selection_order": len(chosen), "baseline": round(current, 6),
                "augmented": round(best, 6), "marginal": round(best - current, 6),
                "improvement_pct": round((best - current) / max(abs(current), 1e-10) * 100, 2),
                "combined_pct": round((best - baseline) / max(abs(baseline), 1e-10) * 100, 2),
            }
        )
        current = best
    return steps


def score_gains(scored: DataFrame, features: list[str], rules: list[Rule], target: str, binary: bool) -> dict[str, float]:
    """Score-test statistic of each rule as one more term of a fitted model, from its residual gradients: the
    squared sum of s * (y - p) over its variance given the features.  All rules in one pass of moments."""
    p = F.col("prediction")
    weight = F.greatest(p * (1 - p), F.lit(1e-12)) if binary else F.lit(1.0)
    root = F.sqrt(weight)
    cols = {"__r": (expr.col(target).cast("double") - p) / root, "__one": root}
    cols |= {f"x:{c}": expr.col(c).cast("double") * root for c in features}
    cols |= {f"s:{r.name}": r.column() * root for r in rules}
    m = grouped_moments(scored, cols).get(0)
    if m is None:
        return {}
    gram = m.raw_gram()
    base = m.index(["__one", *[f"x:{c}" for c in features]])
    inner = np.linalg.pinv(gram[np.ix_(base, base)])
    residual = m.index(["__r"])[0]
    out = {}
    for r in rules:
        s = m.index([f"s:{r.name}"])[0]
        across = gram[s, base]
        variance = gram[s, s] - across @ inner @ across
        gradient = gram[s, residual] - across @ inner @ gram[base, residual]
        out[r.name] = float(gradient * gradient / variance) if variance > 1e-9 * max(gram[s, s], 1e-300) else 0.0
    return out


def holdout_score(model, holdout: DataFrame, target: str, binary: bool) -> float:
    """ROC-AUC (exact, from rank counts) or R-squared of a fitted model on the holdout."""
    scored = model.predict(holdout).withColumn("fold", F.lit(0)).withColumn("__y", expr.col(target).cast("double"))
    row = (fold_auc(scored, "__y") if binary else fold_scores(scored, "__y")).first()
    return float(row["auc" if binary else "r2"]) if row else 0.0


def model_selection(
    train: DataFrame, holdout: DataFrame, features: list[str], rules: list[Rule], target: str, make: Callable[[], object], binary: bool = False, tries: int = 3
) -> list[dict]:
    """Forward selection for any model, binary targets and trees among them: the rules are ranked by the score test
    against the residual gradients of the current model, and the first of the ``tries`` best whose refit scores
    better on the holdout is added.  Ends when none does.  Every fit and score reads the rows several times; the columns
    they use are written once."""
    if holdout.limit(MIN_HOLDOUT).count() < MIN_HOLDOUT:
        return []
    columns = {r.name: r.column() for r in rules}
    used = dict.fromkeys([*features, target, *[c for r in rules for c in r.columns()], *columns])
    train, holdout = (durable((df.withColumns(columns) if columns else df).select(*[expr.col(c).alias(c) for c in used])) for df in (train, holdout))
    chosen: list[str] = []
    left, steps = list(rules), []
    model = make().fit(train, features, target)
    baseline = current = holdout_score(model, holdout, target, binary)
    while left:
        used = [*features, *chosen]
        gains = score_gains(model.predict(train), used, left, target, binary)
        ranked = sorted((r.name for r in left if gains.get(r.name, 0.0) > 0), key=lambda n: -gains[n])[:tries]
        for name in ranked:
            trial = make().fit(train, [*used, name], target)
            score = holdout_score(trial, holdout, target, binary)
            if score > current:
                break
        else:
            break
        chosen.append(name)
        left = [r for r in left if r.name != name]
        steps.append(
            {
                "name": name, "selection_order": len(chosen), "baseline": round(current, 6), "augmented": round(score, 6),
                "marginal": round(score - current, 6), "improvement_pct": round((score - current) / max(abs(current), 1e-10) * 100, 2),
                "combined_pct": round((score - baseline) / max(abs(baseline), 1e-10) * 100, 2),
            }
        )
        model, current = trial, score
    return steps


STEP_SCHEMA = (
    "name string, selection_order int, baseline double, augmented double, marginal double, "
    "improvement_pct double, combined_pct double"
)


def selection_table(spark, steps: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(s.values()) for s in steps], STEP_SCHEMA)
