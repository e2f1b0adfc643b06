"""Means and centred cross-products per group: one scan feeds every linear model.

A ridge fit for any fold, any penalty and any column subset, VIF, partial correlations,
Breusch-Pagan and double-ML all follow from these p x p statistics, so none of them reads
the rows again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SQL_WIDTH = 12


@dataclass
class Moments:
    """Count, means and centred scatter (sum of products of deviations) of named columns."""

    names: list[str]
    n: float
    mean: np.ndarray
    scatter: np.ndarray

    def __add__(self, other: "Moments") -> "Moments":
        n = self.n + other.n
        if n == 0:
            return self
        delta = other.mean - self.mean
        return Moments(
            self.names,
            n,
            self.mean + delta * (other.n / n),
            self.scatter + other.scatter + np.outer(delta, delta) * (self.n * other.n / n),
        )

    def index(self, names: list[str]) -> list[int]:
        return [self.names.index(n) for n in names]

    def raw_gram(self) -> np.ndarray:
        """Uncentred sums of products."""
        return self.scatter + self.n * np.outer(self.mean, self.mean)

    def corr(self) -> np.ndarray:
        sd = np.sqrt(np.diag(self.scatter))
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.scatter / np.outer(sd, sd)


def total(parts: list[Moments]) -> Moments:
    out = parts[0]
    for m in parts[1:]:
        out = out + m
    return out


def grouped_moments(
    df: DataFrame, columns: dict[str, Column], by: Column | None = None
) -> dict[object, Moments]:
    """Moments per value of ``by`` (few values, e.g. folds).  Rows with a null or NaN in any
    column are skipped."""
    names = list(columns)
    cols = [c.cast("double").alias(f"x{i}") for i, c in enumerate(columns.values())]
    group = (F.lit(0) if by is None else by).alias("g")
    complete = F.lit(True)
    for i in range(len(names)):
        complete = complete & F.col(f"x{i}").isNotNull() & ~F.isnan(F.col(f"x{i}"))
    rows = df.select(group, *cols).where(complete & F.col("g").isNotNull())
    if len(names) <= SQL_WIDTH:
        return _sql_moments(rows, names)
    return _block_moments(rows, names)


def _sql_moments(rows: DataFrame, names: list[str]) -> dict[object, Moments]:
    p = len(names)
    aggs = [F.count("*").alias("n")]
    aggs += [F.avg(f"x{i}").alias(f"m{i}") for i in range(p)]
    aggs += [
        F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)
    ]
    out = {}
    for r in rows.groupBy("g").agg(*aggs).collect():
        scatter = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                scatter[i, j] = scatter[j, i] = (r[f"c{i}_{j}"] or 0.0) * r["n"]
        out[r["g"]] = Moments(names, float(r["n"]), np.array([r[f"m{i}"] for i in range(p)]), scatter)
    return out


SLOTS = 32


def packed_arrays(sums: dict[object, np.ndarray]):
    """One row per group with a task's partial sums as bytes, for ``summed_arrays``."""
    task = TaskContext.get()
    slot = task.partitionId() % SLOTS if task else 0
    for g, flat in sums.items():
        yield pd.DataFrame({"g": [g], "slot": [slot], "v": [flat.astype(float).tobytes()]})


def summed_arrays(parts: DataFrame) -> dict[object, np.ndarray]:
    """Sum the packed arrays (g, slot, v) of all tasks: first within slots, in parallel, then over slots."""
    schema = parts.schema

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v) for v in pdf["v"])
        return pd.DataFrame({"g": pdf["g"].iloc[:1], "slot": pdf["slot"].iloc[:1], "v": [total.tobytes()]})

    out: dict[object, np.ndarray] = {}
    for r in parts.groupBy("g", "slot").applyInPandas(add, schema).toLocalIterator():
        flat = np.frombuffer(r["v"])
        out[r["g"]] = out[r["g"]] + flat if r["g"] in out else flat
    return out


def _block_moments(rows: DataFrame, names: list[str]) -> dict[object, Moments]:
    """Wide tables: each Arrow batch contributes one matrix product, summed by element."""
    p = len(names)
    centre_row = rows.agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(p)]).first()
    centre = np.array([centre_row[f"m{i}"] or 0.0 for i in range(p)])
    fields = [f"x{i}" for i in range(p)]
    kind = rows.schema["g"].dataType.simpleString()

    def partial(batches):
        sums: dict[object, np.ndarray] = {}
        for pdf in batches:
            for g, part in pdf.groupby("g", sort=False):
                x = part[fields].to_numpy(dtype=float) - centre
                flat = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
                sums[g] = sums[g] + flat if g in sums else flat
        yield from packed_arrays(sums)

    out = {}
    for g, flat in summed_arrays(rows.mapInPandas(partial, f"g {kind}, slot int, v binary")).items():
        n, s, raw = flat[0], flat[1 : p + 1], flat[p + 1 :].reshape(p, p)
        out[g] = Moments(names, n, centre + s / n, raw - np.outer(s, s) / n)
    return out


def ridge(m: Moments, features: list[str], target: str, alpha: float) -> tuple[float, np.ndarray]:
    """Intercept and slopes of ridge regression; the intercept is not penalised."""
    x, y = m.index(features), m.index([target])[0]
    gram = m.scatter[np.ix_(x, x)] + alpha * np.eye(len(x))
    try:
        beta = np.linalg.solve(gram, m.scatter[x, y])
    except np.linalg.LinAlgError:
        beta = np.linalg.pinv(gram) @ m.scatter[x, y]
    return float(m.mean[y] - m.mean[x] @ beta), beta


def linear_column(intercept: float, beta: np.ndarray, columns: list[Column]) -> Column:
    """The prediction as a column expression."""
    out = F.lit(float(intercept))
    for b, c in zip(beta, columns):
        out = out + F.lit(float(b)) * c.cast("double")
    return out
