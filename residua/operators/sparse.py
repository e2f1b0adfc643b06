"""Ridge regression with categorical columns of very many values, for all folds at once.

A wide column does not become one table column per value: a row holds the number of its value, and the design
matrix exists only as products with it.  The normal equations of all folds are solved by conjugate gradients
with a diagonal preconditioner; a step is one pass that adds up x (x . v) for every fold's direction v, so no
p x p matrix is made.  Values are numbered in order of their text from 1, the first value and unknown ones have
number 0 and no coefficient, as in the one-hot encoding.

A single wide column needs no steps: given the intercept and the slopes, the coefficient of a value follows from the
sums of its own rows, so the column is eliminated.  A small system per fold is left, and the coefficients stay a
table (a row per value) that the rows are joined with; nothing of the size of the column reaches the driver.

With several wide columns the coefficients are vectors of (features + values) per fold on the driver and in the tasks:
8 MB per million values and fold.  ``MOST_BYTES`` bounds them; above it the fit is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.functions import expr
from residua.functions.moments import SLOTS, linear_column, summed_arrays
from residua.functions.ranks import with_position
from residua.session import durable

MOST_BYTES = 1 << 30  # of the coefficients of all folds
MAX_STEPS, TOLERANCE = 200, 1e-9
FEW_VALUES = 100_000  # below, numbers are found by a broadcast join


def value_numbers(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """(value, number) of the distinct values in order of their text, from 0, and how many there are."""
    values = df.select(expr.col(column).cast("string").alias("value")).where("value IS NOT NULL").distinct()
    numbered = durable(with_position(values, ["value"], "number"))
    return numbered, numbered.count()


def with_numbers(df: DataFrame, column: str, numbers: DataFrame, n: int, out: str) -> DataFrame:
    """The rows with the number of their value; null and unknown values have 0.  The join key is a struct, so that a
    value that a third of all rows hold can be split by the skew join."""
    right = numbers.select(F.struct("value").alias("__k"), F.col("number").alias(out))
    right = F.broadcast(right) if n <= FEW_VALUES else right
    left = df.withColumn("__k", F.struct(expr.col(column).cast("string").alias("value")))
    return left.join(right, "__k", "left").withColumn(out, F.coalesce(out, F.lit(0))).drop("__k")


@dataclass
class SparseRidge:
    """Coefficients of a fold: intercept, dense slopes, and one vector per wide column (its first value: 0)."""

    intercept: float
    dense: np.ndarray
    wide: list[np.ndarray]


@dataclass
class JoinedRidge:
    """Coefficients of a fold with one wide column, whose part is a table of (number, coefficients by fold)."""

    intercept: float
    dense: np.ndarray
    table: DataFrame = field(repr=False)
    fold: int
    values: int

    @property
    def wide(self) -> list[np.ndarray]:
        """The vector of the wide column, brought to the driver."""
        out = np.zeros(self.values)
        rows = self.table.select("number", F.col("c")[self.fold].alias("c")).toPandas()
        out[rows["number"].to_numpy()] = rows["c"].to_numpy()
        return [out]


def _value_sums(df: DataFrame, dense: list[str], wide: str, target: str, numbers: DataFrame, n: int) -> DataFrame:
    """Per value its number and by fold the rows and the sums of the dense columns and the target."""
    x = [expr.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(dense)]
    rows = df.select(F.col("fold").cast("int").alias("fold"), expr.finite(expr.col(target)).alias("y"), expr.col(wide).cast("string").alias("value"), *x).where("y IS NOT NULL AND fold >= 0")
    ones = F.count(F.lit(1)).cast("double")
    sums = F.array(ones, *[F.sum(f"x{i}") for i in range(len(dense))], F.sum("y"))
    cells = rows.groupBy("value", "fold").agg(sums.alias("s"))
    numbered = cells.join(F.broadcast(numbers) if n <= FEW_VALUES else numbers, "value", "left")
    return numbered.groupBy("value", F.coalesce("number", F.lit(0)).alias("number")).agg(F.collect_list(F.struct("fold", "s")).alias("cells"))  # an entry per fold


def fit_one_wide(df: DataFrame, dense: list[str], wide: str, target: str, k: int, alpha: float, numbers: DataFrame, n: int) -> tuple[list[JoinedRidge], DataFrame]:
    """One model per fold for a single wide column, and the table (value, number, c: coefficient by fold).  With z the
    row (1, x) summed over a value's rows and m their number, its coefficient is (y - z . u) / (m + alpha); put into the
    other equations, u solves (G + penalty - sum of z z' / (m + alpha)) u = g - sum of z y / (m + alpha)."""
    d = len(dense) + 1
    x = [F.lit(1.0), *[expr.col(c).cast("double") for c in dense]]
    sums = durable(_value_sums(df, dense, wide, target, numbers, n))
    size = d * d + d

    def outside(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the values and, per value and fold, the sums over the rows outside the fold."""
        lists = batch.column("cells")
        owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        cells = lists.flatten()
        s = cells.field("s").flatten().to_numpy(zero_copy_only=False).reshape(-1, d + 1)
        fold = cells.field("fold").to_numpy()
        whole, inside = np.zeros((batch.num_rows, d + 1)), np.zeros((batch.num_rows, k, d + 1))
        np.add.at(whole, owner, s)
        own = fold < k
        np.add.at(inside, (owner[own], fold[own]), s[own])
        return batch.column("number").to_numpy(), whole[:, None] - inside

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, size))
        for b in batches:
            number, s = outside(b)
            s = s[number > 0]
            weight = 1.0 / np.where(s[:, :, 0] + alpha > 0, s[:, :, 0] + alpha, 1.0)
            z = s[:, :, :d]
            total[:, : d * d] += np.einsum("vf,vfi,vfj->fij", weight, z, z).reshape(k, d * d)
            total[:, d * d :] += np.einsum("vf,vfi,vf->fi", weight, z, s[:, :, d])
        slot = TaskContext.get().partitionId() % SLOTS
        yield pa.RecordBatch.from_pydict({"g": pa.array([0], pa.int32()), "slot": pa.array([slot], pa.int32()), "v": [total.tobytes()]})

    found = summed_arrays(sums.mapInArrow(reduced, "g int, slot int, v binary"))
    taken = found[0].reshape(k, size) if found else np.zeros((k, size))
    y = expr.finite(expr.col(target))
    products = [F.sum(a * b).alias(f"p{i}_{j}") for i, a in enumerate(x) for j, b in enumerate([*x, y]) if j >= i]
    grams = np.zeros((k + 1, d, d + 1))
    for r in df.where((F.col("fold") >= 0) & y.isNotNull()).groupBy(F.when(F.col("fold") < k, F.col("fold")).otherwise(k).cast("int").alias("f")).agg(*products).collect():
        for i in range(d):
            for j in range(i, d + 1):
                grams[r["f"], i, j] = r[f"p{i}_{j}"]
                if j < d:
                    grams[r["f"], j, i] = grams[r["f"], i, j]
    penalty = np.diag([0.0] + [alpha] * (d - 1))
    u = []
    for f in range(k):
        gram = grams.sum(0) - grams[f]
        u.append(np.linalg.lstsq(gram[:, :d] + penalty - taken[f, : d * d].reshape(d, d), gram[:, d] - taken[f, d * d :], rcond=None)[0])
    solved = np.array(u)

    def coefficients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number, s = outside(b)
            weight = 1.0 / np.where(s[:, :, 0] + alpha > 0, s[:, :, 0] + alpha, 1.0)
            c = (s[:, :, d] - np.einsum("vfi,fi->vf", s[:, :, :d], solved)) * weight * (number > 0)[:, None]
            yield pa.RecordBatch.from_pydict({"value": b.column("value"), "number": number, "c": pa.FixedSizeListArray.from_arrays(c.ravel(), k).cast(pa.list_(pa.float64()))})

    table = durable(sums.mapInArrow(coefficients, "value string, number long, c array<double>"))
    return [JoinedRidge(float(w[0]), w[1:], table.where("number > 0"), f, n) for f, w in enumerate(solved)], table


def _one_wide_oof(df: DataFrame, dense: list[str], wide: str, target: str, k: int, alpha: float) -> tuple[DataFrame, list[JoinedRidge]]:
    numbers, n = value_numbers(df.where("fold >= 0"), wide)
    _bounded(1 + len(dense) + max(n - 1, 0), k)
    fitted, table = fit_one_wide(df, dense, wide, target, k, alpha, numbers, n)
    right = table.where("value IS NOT NULL").select(F.struct("value").alias("__k"), F.col("c").alias("__c"))
    names = [c for c in df.columns if c not in ("prediction", "residual")]
    left = df.select(*[expr.col(c) for c in names], F.struct(expr.col(wide).cast("string").alias("value")).alias("__k"))
    rows = left.join(F.broadcast(right) if n <= FEW_VALUES else right, "__k", "left")
    prediction = F.lit(None).cast("double")
    for f, m in enumerate(fitted):
        there = linear_column(m.intercept, m.dense, [expr.col(c) for c in dense]) + F.coalesce(F.col("__c")[f], F.lit(0.0))
        prediction = F.when(F.col("fold") == f, expr.finite(there)).otherwise(prediction)
    out = rows.withColumn("prediction", prediction).select(*[expr.col(c) for c in names], "prediction")
    return out.withColumn("residual", expr.col(target).cast("double") - F.col("prediction")), fitted


def _bounded(p: int, k: int) -> None:
    if p * (k + 1) * 8 > MOST_BYTES:
        raise ValueError(f"{p} coefficients for {k} folds are more than {MOST_BYTES} bytes")


def _packed(df: DataFrame, dense: list[str], wide: list[str], target: str) -> DataFrame:
    x = [expr.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(dense)]
    w = [expr.col(c).cast("long").alias(f"w{i}") for i, c in enumerate(wide)]
    rows = df.select(F.col("fold").cast("int").alias("fold"), expr.finite(expr.col(target)).alias("y"), *x, *w).where("y IS NOT NULL AND fold >= 0")
    return durable(rows)


def fit_sparse(df: DataFrame, dense: list[str], wide: dict[str, int], target: str, k: int, alpha: float = 1.0) -> list[SparseRidge]:
    """One model per fold, fitted on the rows outside it.  ``wide``: columns of value numbers and how many values each
    has; dense columns hold finite numbers."""
    names, counts = list(wide), np.array(list(wide.values()), np.int64)
    p = 1 + len(dense) + int(np.maximum(counts - 1, 0).sum())
    _bounded(p, k)
    begin = 1 + len(dense) + np.concatenate([[0], np.cumsum(np.maximum(counts - 1, 0))])[:-1]
    rows = _packed(df, dense, names, target)
    d = len(dense)

    def columns(b: pa.RecordBatch):
        x = np.column_stack([np.ones(b.num_rows), *[b.column(2 + i).to_numpy() for i in range(d)]])
        at = [(np.flatnonzero(n > 0), n[n > 0] - 1 + begin[j]) for j in range(len(names)) for n in (b.column(2 + d + j).to_numpy(),)]
        return b.column(0).to_numpy(), b.column(1).to_numpy(), x, at

    def product(x: np.ndarray, at: list, v: np.ndarray) -> np.ndarray:
        out = x @ v[: d + 1]
        for r, c in at:
            out[r] += v[c]
        return out

    def spread(x: np.ndarray, at: list, r: np.ndarray, into: np.ndarray) -> None:
        into[: d + 1] += x.T @ r
        for rows_, c in at:
            into += np.bincount(c, r[rows_], p)

    few = rows.rdd.getNumPartitions() <= SLOTS

    def summed(work) -> np.ndarray:
        """Sums over all rows: fold j's array holds the rows of fold j only; a fit takes the other folds."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, 3 if work is None else 1, p)) if work is None else np.zeros((k, k, p))
            for b in batches:
                fold, y, x, at = columns(b)
                for j in np.unique(fold):
                    mine = fold == j
                    here = [(np.searchsorted(np.flatnonzero(mine), r[mine[r]]), c[mine[r]]) for r, c in at]
                    xm, ym = x[mine], y[mine]
                    if work is None:
                        spread(xm, here, ym, total[j, 0])
                        spread(xm * xm, here, np.ones(len(ym)), total[j, 1])
                        continue
                    for f in range(k):
                        if f != j:
                            spread(xm, here, product(xm, here, work[f]), total[j, f])
            flat = total if work is None else total.sum(0)
            slot = TaskContext.get().partitionId() % SLOTS
            yield pa.RecordBatch.from_pydict({"g": pa.array([0], pa.int32()), "slot": pa.array([slot], pa.int32()), "v": [flat.tobytes()]})

        parts = rows.mapInArrow(add, "g int, slot int, v binary")
        flat = sum(np.frombuffer(r["v"]) for r in parts.collect()) if few else summed_arrays(parts)[0]
        return flat.reshape(k, 3, p) if work is None else flat.reshape(k, p)

    start = summed(None)
    everyone = start.sum(0)
    penalty = np.full(p, alpha)
    penalty[0] = 0.0
    b = np.stack([everyone[0] - start[f, 0] for f in range(k)])
    diagonal = np.stack([everyone[1] - start[f, 1] for f in range(k)]) + penalty
    diagonal[diagonal <= 0] = 1.0
    v, r = np.zeros((k, p)), b.copy()
    z = r / diagonal
    direction, rz = z.copy(), (r * z).sum(1)
    goal = TOLERANCE * np.sqrt((b * b / diagonal).sum(1)) + 1e-300
    for _ in range(MAX_STEPS):
        open_ = np.sqrt(np.maximum(rz, 0)) > goal
        if not open_.any():
            break
        a_d = summed(direction) + penalty * direction
        step = np.where(open_, rz / np.where((direction * a_d).sum(1) == 0, 1.0, (direction * a_d).sum(1)), 0.0)
        v += step[:, None] * direction
        r -= step[:, None] * a_d
        z = r / diagonal
        before, rz = rz, (r * z).sum(1)
        direction = np.where(open_[:, None], z + (rz / np.where(before == 0, 1.0, before))[:, None] * direction, direction)
    ends = np.append(begin, p)
    return [SparseRidge(float(w[0]), w[1 : d + 1], [np.concatenate([[0.0], w[ends[j] : ends[j + 1]]]) for j in range(len(names))]) for w in v]


def sparse_oof(df: DataFrame, dense: list[str], wide: list[str], target: str, k: int, alpha: float = 1.0) -> tuple[DataFrame, list[SparseRidge] | list[JoinedRidge]]:
    """Adds ``prediction`` and ``residual`` of the model that did not see the row's fold.  ``wide``: categorical columns
    by name; missing values must have been filled."""
    if len(wide) == 1:
        return _one_wide_oof(df, dense, wide[0], target, k, alpha)
    work, sizes, hidden = df, {}, []
    for i, c in enumerate(wide):
        numbers, n = value_numbers(df.where("fold >= 0"), c)
        name = f"__value{i}"
        work, sizes[name] = with_numbers(work, c, numbers, n, name), n
        hidden.append(name)
    work = durable(work)
    fitted = fit_sparse(work, dense, sizes, target, k, alpha)
    packed = df.sparkSession.sparkContext.broadcast([(m.intercept, m.dense, m.wide) for m in fitted])  # bounded by MOST_BYTES
    names = [f.name for f in df.schema.fields if f.name not in ("prediction", "residual")]
    schema = ", ".join(f"{expr.name(f.name)} {f.dataType.simpleString()}" for f in df.schema.fields if f.name in names)
    d = len(dense)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold = np.nan_to_num(b.column("__fold").to_numpy(zero_copy_only=False).astype(float), nan=-1).astype(int)
            x = np.column_stack([np.zeros(b.num_rows), *[b.column(f"__x{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(d)]])[:, 1:]
            out = np.full(b.num_rows, np.nan)
            for f, (intercept, slopes, vectors) in enumerate(packed.value):
                at = np.flatnonzero(fold == f)
                out[at] = intercept + x[at] @ slopes
                for h, v in zip(hidden, vectors):
                    out[at] += v[b.column(h).to_numpy()[at]] if len(v) else 0.0
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(out, mask=np.isnan(out))], names=[*names, "prediction"])

    given = work.select(*[expr.col(c) for c in names], F.col("fold").cast("int").alias("__fold"), *[expr.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(dense)], *hidden)
    table = given.mapInArrow(score, schema + ", prediction double")
    return table.withColumn("residual", expr.col(target).cast("double") - F.col("prediction")), fitted
