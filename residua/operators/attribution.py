"""Feature attributions: closed form for linear models, path-dependent Shapley values for
boosted trees."""

from __future__ import annotations

from itertools import combinations
from math import factorial, prod

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.functions import expr
from residua.operators.boosting import MOST_PLACES
from residua.operators.models import BoostedModel, RidgeModel


def linear_contributions(df: DataFrame, model: RidgeModel, keep: list[str]) -> DataFrame:
    """(x - mean) * slope for each feature of a linear model."""
    return df.select(*keep, *[c.alias(f"shap_{n}") for n, c in model.shap_columns().items()])


def mean_abs(contributions: DataFrame, prefix: str = "shap_") -> DataFrame:
    """Mean |contribution| per feature in one aggregation."""
    names = [c for c in contributions.columns if c.startswith(prefix)]
    cells = [
        F.struct(F.lit(c[len(prefix):]).alias("feature"), F.avg(F.abs(expr.col(c))).alias("importance")).alias(f"c{i}")
        for i, c in enumerate(names)
    ]
    wide = contributions.agg(*cells)
    return wide.select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(names))])).alias("s")).select("s.*")


def tree_paths(model: BoostedModel, which: int = 0) -> list[list[tuple[float, list[tuple[int, float, float, float]]]]]:
    """Per tree of a class: (leaf value, [(feature, low, high, share)]).  ``share`` is the part of the training rows
    (by their hessian) that follows the path at the splits on that feature."""
    return model.forest.paths(which)


def _shapley_weights(d: int) -> list[float]:
    return [factorial(s) * factorial(d - s - 1) / factorial(d) for s in range(d)]


def _passed(x: np.ndarray, path: list) -> tuple[np.ndarray, np.ndarray | None]:
    """Which features of a path pass, as (feature, row), and for a number per row the place of its row there.  With fewer
    patterns of passing than rows, the patterns stand for the rows."""
    inside = [((x[:, f] > lo) | (lo == -np.inf)) & (x[:, f] <= hi) for f, lo, hi, _ in path]
    d = len(path)
    if 1 << d >= len(x) or d > 15:
        return np.stack(inside).astype(float), None
    pattern = np.zeros(len(x), np.int16)
    for j, passes in enumerate(inside):
        pattern += passes.astype(np.int16) << j
    return (np.arange(1 << d) >> np.arange(d)[:, None] & 1).astype(float), pattern


def _tree_shap(x: np.ndarray, leaves: list) -> dict[int, np.ndarray]:
    """Shapley values of rows ``x`` by feature, of one tree."""
    out: dict[int, np.ndarray] = {}
    for value, path in leaves:
        d = len(path)
        if d == 0:
            continue
        ones, pattern = _passed(x, path)
        shares = np.array([s for *_, s in path])
        weights = _shapley_weights(d)
        for i, (f, *_rest) in enumerate(path):
            sums = _subset_sums([j for j in range(d) if j != i], ones, shares)
            total = sum(w * s for w, s in zip(weights, sums))
            part = value * (ones[i] - shares[i]) * total
            out.setdefault(f, np.zeros(len(x)))
            out[f] += part if pattern is None else part[pattern]
    return out


def _tree_pairs(x: np.ndarray, leaves: list) -> dict[tuple[int, int], np.ndarray]:
    """Shapley interaction values of rows ``x`` by pair of features, of one tree."""
    out: dict[tuple[int, int], np.ndarray] = {}
    for value, path in leaves:
        d = len(path)
        if d < 2:
            continue
        ones, pattern = _passed(x, path)
        shares = np.array([s for *_, s in path])
        weights = [factorial(s) * factorial(d - s - 2) / (2 * factorial(d - 1)) for s in range(d - 1)]
        for i, j in combinations(range(d), 2):
            sums = _subset_sums([k for k in range(d) if k not in (i, j)], ones, shares)
            total = sum(w * s for w, s in zip(weights, sums))
            a, b = sorted((path[i][0], path[j][0]))
            part = value * (ones[i] - shares[i]) * (ones[j] - shares[j]) * total
            out.setdefault((a, b), np.zeros(len(x)))
            out[a, b] += part if pattern is None else part[pattern]
    return out


class _Lookup:
    """Values of each tree by place between its cuts: a tree cannot tell rows of one place apart, so its leaves are walked
    once per place and not once per row.  A tree with more places than ``MOST_PLACES`` is walked by row."""

    def __init__(self, trees: list, features: int, of) -> None:
        self.of, self.trees = of, []
        bounds = [[{c for _, path in leaves for f, lo, hi, _ in path if f == k for c in (lo, hi) if np.isfinite(c) or c == hi == -np.inf} for k in range(features)] for leaves in trees]
        self.cuts = [np.array(sorted(set().union(*(b[k] for b in bounds)))) for k in range(features)]
        for leaves, own in zip(trees, bounds):
            used = [k for k in range(features) if own[k]]
            sizes = [len(own[k]) + 1 for k in used]
            if prod(sizes) > MOST_PLACES:
                self.trees.append((leaves, None, None))
                continue
            x, steps = np.zeros((prod(sizes), features)), []
            for i, k in enumerate(used):
                cuts, step = np.array(sorted(own[k])), prod(sizes[i + 1:])
                x[:, k] = np.append(cuts, np.inf)[np.arange(len(x)) // step % sizes[i]]
                steps.append((k, np.searchsorted(cuts, np.append(self.cuts[k], np.inf)) * step))
            self.trees.append((leaves, steps, of(x, leaves)))

    def add(self, x: np.ndarray, out: dict) -> None:
        """Adds the values of rows ``x`` to the arrays of ``out``."""
        bins = [np.searchsorted(c, column) for c, column in zip(self.cuts, x.T)]
        for leaves, steps, values in self.trees:
            if steps is None:
                for k, part in self.of(x, leaves).items():
                    out[k] += part
                continue
            place = sum((numbers[bins[k]] for k, numbers in steps), np.zeros(1, np.intp))
            for k, part in values.items():
                out[k] += part[place]


def _added(x: np.ndarray, trees: list, of, out: dict) -> None:
    for leaves in trees:
        for k, part in of(x, leaves).items():
            out[k] += part


def shap_matrix(x: np.ndarray, trees: list | _Lookup) -> np.ndarray:
    """Path-dependent Shapley values of rows ``x``.

    At one leaf the game value of a feature set is leaf * prod(in set: row passes) * prod(out:
    share), so the values follow from elementary symmetric sums over the few features of the
    path, for all rows at once.
    """
    out = {f: np.zeros(len(x)) for f in range(x.shape[1])}
    if isinstance(trees, _Lookup):
        trees.add(x, out)
    else:
        _added(x, trees, _tree_shap, out)
    return np.stack([*out.values()], 1) if out else np.zeros_like(x)


def _subset_sums(members: list[int], ones: np.ndarray, shares: np.ndarray) -> list[np.ndarray]:
    """For each size s: sum over subsets S of ``members`` of prod(S: ones) * prod(rest: share)."""
    poly = [np.ones(ones.shape[1])]
    for j in members:
        grown = [p * shares[j] for p in poly] + [np.zeros(ones.shape[1])]
        for s, p in enumerate(poly):
            grown[s + 1] = grown[s + 1] + p * ones[j]
        poly = grown
    return poly


def interaction_matrix(x: np.ndarray, trees: list | _Lookup) -> np.ndarray:
    """Mean |Shapley interaction value| of each feature pair over rows ``x`` (summed, not
    averaged: shape p x p)."""
    n, p = x.shape
    acc = {pair: np.zeros(n) for pair in combinations(range(p), 2)}
    if isinstance(trees, _Lookup):
        trees.add(x, acc)
    else:
        _added(x, trees, _tree_pairs, acc)
    out = np.zeros((p, p))
    for (a, b), v in acc.items():
        out[a, b] = np.abs(v).sum()
    return out


def base_value(trees: list) -> float:
    """Expected prediction: every feature left out."""
    return float(sum(v * np.prod([s for *_, s in path]) for leaves in trees for v, path in leaves))


def tree_contributions(df: DataFrame, model: BoostedModel, key: str) -> DataFrame:
    """Key, base value and one ``shap_`` column per feature; they add up to the margin (for regression the
    prediction).  Missing values follow the lowest ones.  The paths of the ensemble (a few
    thousand leaves) travel with the tasks; rows stay where they are."""
    trees, names = tree_paths(model), list(model.features)
    base = base_value(trees) + float(model.forest.base[0])
    kind = df.schema[key].dataType.simpleString()
    schema = ", ".join([f"`{key}` {kind}", "base_value double", *[f"`shap_{n}` double" for n in names]])

    def score(batches):
        lookup = _Lookup(trees, len(names), _tree_shap)
        for pdf in batches:
            values = shap_matrix(pdf[names].fillna(-np.inf).to_numpy(dtype=float), lookup)
            out = pd.DataFrame(values, columns=[f"shap_{n}" for n in names])
            out.insert(0, "base_value", base)
            out.insert(0, key, pdf[key].to_numpy())
            yield out

    return _dealt(df.select(key, *[expr.col(c).cast("double").alias(c) for c in names])).mapInPandas(score, schema)


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows for work of many leaves each, on all cores even if they come from one small file."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


def tree_interactions(df: DataFrame, model: BoostedModel) -> DataFrame:
    """Mean |interaction value| of each feature pair (feature_a, feature_b, strength)."""
    trees, names = tree_paths(model), list(model.features)
    p = len(names)

    def score(batches):
        total, n, lookup = np.zeros((p, p)), 0, _Lookup(trees, p, _tree_pairs)
        for pdf in batches:
            total += interaction_matrix(pdf.fillna(-np.inf).to_numpy(dtype=float), lookup)
            n += len(pdf)
        rows = [(names[i], names[j], total[i, j], n) for i in range(p) for j in range(i + 1, p)]
        yield pd.DataFrame(rows, columns=["feature_a", "feature_b", "s", "n"])

    parts = _dealt(df.select(*[expr.col(c).cast("double").alias(c) for c in names])).mapInPandas(
        score, "feature_a string, feature_b string, s double, n long"
    )
    return parts.groupBy("feature_a", "feature_b").agg((F.sum("s") / F.sum("n")).alias("strength"))
