"""L2 logistic regression by Newton steps, the models of all folds from the same passes.

A pass adds up, for every model, the gradient and the Hessian over the rows it is fitted on; K small systems
are then solved.  The same code fits base models and the logistic meta-model of a stack.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.functions import expr
from residua.functions.moments import SLOTS, linear_column, summed_arrays

MAX_STEPS, TOLERANCE = 50, 1e-10


@dataclass
class LogisticModel:
    """P(y = 1) with inverse penalty ``c``: minimises c * log loss + |slopes|^2 / 2; the intercept is free."""

    c: float = 1.0
    features: list[str] = field(default_factory=list)
    intercept: float = 0.0
    beta: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def fit_all(self, df: DataFrame, features: list[str], target: str, seen: list[Column]) -> list["LogisticModel"]:
        """A model for each condition (62 at most).  Rows with a missing value are left out."""
        weights = newton(df, features, target, seen, self.c)
        return [LogisticModel(self.c, list(features), float(w[0]), w[1:]) for w in weights]

    def fit(self, df: DataFrame, features: list[str], target: str) -> "LogisticModel":
        found = self.fit_all(df, features, target, [F.lit(True)])[0]
        self.features, self.intercept, self.beta = found.features, found.intercept, found.beta
        return self

    def column(self) -> Column:
        margin = linear_column(self.intercept, self.beta, [expr.col(c) for c in self.features])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.column())

    def importance(self) -> dict[str, float]:
        weight = np.abs(self.beta)
        share = weight / weight.sum() if weight.sum() > 0 else weight
        return dict(zip(self.features, map(float, share)))


def newton(df: DataFrame, features: list[str], target: str, seen: list[Column], c: float) -> list[np.ndarray]:
    """(intercept, slopes) for each condition."""
    if len(seen) > 62:
        raise ValueError("at most 62 models at once")
    mask = F.lit(0).cast("long")
    for f, s in enumerate(seen):
        mask = mask + F.when(F.coalesce(s, F.lit(False)), F.lit(1 << f)).otherwise(F.lit(0)).cast("long")
    p, k = len(features) + 1, len(seen)
    rows = df.select(mask.alias("seen"), expr.finite(expr.col(target)).alias("y"), *[expr.finite(expr.col(x)).alias(f"x{i}") for i, x in enumerate(features)])
    rows = rows.na.drop().where("seen <> 0").persist()  # read by every step: a join behind it is done once
    centre = np.zeros(p - 1)
    scale = np.ones(p - 1)
    if features:  # steps are solved in standardised units, the penalty holds in the given ones
        row = rows.agg(*[f(f"x{i}").alias(f"{n}{i}") for i in range(p - 1) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        centre = np.array([row[f"m{i}"] or 0.0 for i in range(p - 1)])
        scale = np.array([row[f"s{i}"] or 1.0 for i in range(p - 1)])
    penalty = np.concatenate([[0.0], 1.0 / (c * scale * scale)])
    few = rows.rdd.getNumPartitions() <= SLOTS
    size = 1 + p + p * p

    def sums(weights: np.ndarray) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, size))
            for b in batches:
                own, y = b.column(0).to_numpy(), b.column(1).to_numpy()
                x = np.column_stack([np.ones(len(y)), *[(b.column(i + 2).to_numpy() - centre[i]) / scale[i] for i in range(p - 1)]])
                for f in range(k):
                    at = own >> f & 1 > 0
                    z, t = x[at], y[at]
                    margin = z @ weights[f]
                    q = 1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700)))
                    total[f, 0] += (np.logaddexp(0.0, margin) - t * margin).sum()
                    total[f, 1 : 1 + p] += z.T @ (q - t)
                    total[f, 1 + p :] += (z.T @ (z * (q * (1 - q))[:, None])).ravel()
            slot = TaskContext.get().partitionId() % SLOTS
            yield pa.RecordBatch.from_pydict({"g": pa.array([0], pa.int32()), "slot": pa.array([slot], pa.int32()), "v": [total.tobytes()]})

        parts = rows.mapInArrow(add, "g int, slot int, v binary")
        flat = sum(np.frombuffer(r["v"]) for r in parts.collect()) if few else summed_arrays(parts)[0]
        return flat.reshape(k, size)

    weights, before, lowest = np.zeros((k, p)), np.zeros((k, p)), np.full(k, np.inf)
    for _ in range(MAX_STEPS):
        total = sums(weights)
        loss = total[:, 0] + 0.5 * (penalty * weights * weights).sum(1)
        moved = 0.0
        for f in range(k):
            if loss[f] > lowest[f] * (1 + 1e-14) + 1e-14:  # a step too long: half of it
                weights[f] = (weights[f] + before[f]) / 2
                moved = max(moved, float(np.abs(weights[f] - before[f]).max()))
                continue
            gradient = total[f, 1 : 1 + p] + penalty * weights[f]
            hessian = total[f, 1 + p :].reshape(p, p) + np.diag(penalty)
            step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
            lowest[f], before[f] = loss[f], weights[f].copy()
            weights[f] = weights[f] - step
            moved = max(moved, float(np.abs(step).max()))
        if moved < TOLERANCE:
            break
    rows.unpersist()
    out = []
    for w in weights:
        slopes = w[1:] / scale
        out.append(np.concatenate([[w[0] - slopes @ centre], slopes]))
    return out
