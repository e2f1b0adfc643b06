"""Baseline models and cross-fitting.

The linear family never reads rows per fold: fold statistics are gathered once and a fold's
training statistics are the total minus the fold.  Tree and logistic models use Spark ML.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product
from typing import Protocol

import numpy as np
from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.functions import expr
from residua.functions.moments import Moments, grouped_moments, linear_column, ridge, total
from residua.operators import boosting
from residua.operators.boosting import Boosting, Forest
from residua.operators.logistic import LogisticModel
from residua.operators.cv import timeseries_bounds, train_before
from residua.session import durable


class ResidualModel(Protocol):
    """What a baseline has to offer: fitted scoring of a table and feature importances."""

    def fit(self, df: DataFrame, features: list[str], target: str) -> "ResidualModel": ...

    def predict(self, df: DataFrame) -> DataFrame: ...

    def importance(self) -> dict[str, float]: ...


@dataclass
class RidgeModel:
    """Closed-form ridge regression from one pass of moments."""

    alpha: float = 1.0
    features: list[str] = field(default_factory=list)
    intercept: float = 0.0
    beta: np.ndarray = field(default_factory=lambda: np.zeros(0))
    means: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def fit(self, df: DataFrame, features: list[str], target: str) -> "RidgeModel":
        cols = {c: expr.col(c) for c in [*features, target]}
        return self.from_moments(grouped_moments(df, cols)[0], features, target)

    def from_moments(self, m: Moments, features: list[str], target: str) -> "RidgeModel":
        self.features = list(features)
        self.intercept, self.beta = ridge(m, features, target, self.alpha)
        self.means = m.mean[m.index(features)]
        return self

    def column(self) -> Column:
        return linear_column(self.intercept, self.beta, [expr.col(c) for c in self.features])

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.column())

    def importance(self) -> dict[str, float]:
        weight = np.abs(self.beta)
        share = weight / weight.sum() if weight.sum() > 0 else weight
        return dict(zip(self.features, map(float, share)))

    def shap_columns(self) -> dict[str, Column]:
        """Contribution of each feature to a prediction: (x - mean) * slope."""
        return {
            c: (expr.col(c).cast("double") - F.lit(float(m))) * F.lit(float(b))
            for c, m, b in zip(self.features, self.means, self.beta)
        }


@dataclass
class OOF:
    """Out-of-fold result: scored table, per-fold models and importances."""

    table: DataFrame
    models: dict[int, RidgeModel]

    def importances(self) -> list[tuple[int, str, float]]:
        return [(k, f, v) for k, m in self.models.items() for f, v in m.importance().items()]


def fold_moments(df: DataFrame, features: list[str], target: str, extra: list[str] | None = None) -> dict[int, Moments]:
    """Statistics per fold of features, target and any extra columns, in one scan."""
    cols = {c: expr.col(c) for c in dict.fromkeys([*features, *(extra or []), target])}
    return grouped_moments(df, cols, F.col("fold"))


def train_moments(folds: dict[int, Moments], k: int) -> Moments:
    """Everything outside fold ``k``."""
    return total([m for f, m in folds.items() if f != k])


def ridge_oof(df: DataFrame, features: list[str], target: str, alpha: float = 1.0, moments: dict[int, Moments] | None = None) -> OOF:
    """Cross-fitted ridge over a table with a ``fold`` column: adds prediction and residual.
    Scoring is a projection with one coefficient set per fold."""
    folds = moments or fold_moments(df, features, target)
    models = {
        k: RidgeModel(alpha).from_moments(train_moments(folds, k), features, target)
        for k in sorted(folds) if k >= 0
    }
    prediction = F.lit(None).cast("double")
    for k, m in models.items():
        prediction = F.when(F.col("fold") == k, m.column()).otherwise(prediction)
    scored = df.withColumn("prediction", prediction).withColumn(
        "residual", expr.col(target).cast("double") - F.col("prediction")
    )
    return OOF(scored, models)


def ridge_timeseries_oof(df: DataFrame, features: list[str], target: str, n: int, k: int, gap: int = 0, alpha: float = 1.0) -> OOF:
    """Time-ordered cross-fitting: fold f trains on positions before its start minus the gap.
    Moments are gathered per (fold, gap zone) segment and added up, again in one scan."""
    size, first = timeseries_bounds(n, k)
    starts = [first + f * size for f in range(k)]
    borders = sorted({b for s in starts for b in (max(0, s - gap), s)})
    segment = F.lit(0)
    for b in borders:
        segment = segment + (F.col("pos") >= F.lit(b)).cast("int")
    cols = {c: expr.col(c) for c in [*features, target]}
    parts = grouped_moments(df, cols, segment)
    models = {}
    for f, start in enumerate(starts):
        limit = max(0, start - gap)
        inside = [m for s, m in parts.items() if s <= sum(1 for b in borders if b < limit)]
        if inside:
            models[f] = RidgeModel(alpha).from_moments(total(inside), features, target)
    prediction = F.lit(None).cast("double")
    for f, m in models.items():
        prediction = F.when(F.col("fold") == f, m.column()).otherwise(prediction)
    scored = df.withColumn("prediction", prediction).withColumn(
        "residual", expr.col(target).cast("double") - F.col("prediction")
    )
    return OOF(scored, models)


def alpha_sweep(df: DataFrame, features: list[str], target: str, alphas: list[float]) -> list[tuple[float, float]]:
    """(alpha, out-of-fold MSE) for many penalties from one set of fold statistics: the
    squared error of a linear rule on a fold is a quadratic form of the fold's moments."""
    folds = fold_moments(df, features, target)
    out = []
    for alpha in alphas:
        sse = n = 0.0
        for k, m in folds.items():
            if k < 0:
                continue
            a, b = ridge(train_moments(folds, k), features, target, alpha)
            sse += quadratic_error(m, features, target, a, b)
            n += m.n
        out.append((alpha, sse / n if n else float("nan")))
    return out


def quadratic_error(m: Moments, features: list[str], target: str, intercept: float, beta: np.ndarray) -> float:
    """Sum of squared errors of a linear rule, from moments alone."""
    x, y = m.index(features), m.index([target])[0]
    sxx, sxy, syy = m.scatter[np.ix_(x, x)], m.scatter[x, y], m.scatter[y, y]
    bias = m.mean[y] - intercept - m.mean[x] @ beta
    return float(syy - 2 * beta @ sxy + beta @ sxx @ beta + m.n * bias * bias)


# --- Spark ML models -------------------------------------------------------------------

@dataclass
class MLModel:
    """A Spark ML estimator behind the ``ResidualModel`` shape."""

    estimator: Estimator
    probability: bool = False
    penalty_c: float | None = None  # inverse penalty of a logistic model, spread over the rows it is fitted on
    features: list[str] = field(default_factory=list)
    fitted: object = None

    def assemble(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.features, outputCol="__features", handleInvalid="keep").transform(df)

    def fit(self, df: DataFrame, features: list[str], target: str) -> "MLModel":
        self.features = list(features)
        data = self.assemble(df).withColumn("__label", expr.col(target).cast("double"))
        params = {self.estimator.featuresCol: "__features", self.estimator.labelCol: "__label"}
        if self.penalty_c is not None:
            params[self.estimator.regParam] = 1.0 / (max(1, df.count()) * self.penalty_c)
        self.fitted = self.estimator.copy(params).fit(data)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        scored = self.fitted.transform(self.assemble(df))
        if self.probability:
            scored = scored.withColumn("prediction", vector_to_array("probability")[1])
        return scored.drop("__features", "rawPrediction", "probability")

    def importance(self) -> dict[str, float]:
        if hasattr(self.fitted, "featureImportances"):
            values = self.fitted.featureImportances.toArray()
        else:
            values = np.abs(self.fitted.coefficients.toArray())
            values = values / values.sum() if values.sum() > 0 else values
        return dict(zip(self.features, map(float, values)))


def logistic(c: float = 1.0) -> MLModel:
    """L2 logistic regression with inverse penalty ``c`` on unscaled features."""
    return MLModel(LogisticRegression(elasticNetParam=0.0, standardization=False, maxIter=1000), probability=True, penalty_c=c)


@dataclass
class BoostedModel:
    """Boosted trees behind the ``ResidualModel`` shape.  Classes of a softmax model are 0, 1, ..."""

    objective: str = "squared"
    params: Boosting = field(default_factory=Boosting)
    classes: int = 1
    features: list[str] = field(default_factory=list)
    forest: Forest | None = None

    def _counted(self, df: DataFrame, target: str) -> int:
        if self.objective != "softmax":
            return 1
        return self.classes if self.classes > 1 else int(df.agg(F.max(expr.col(target))).first()[0] or 0) + 1

    def fit_all(self, df: DataFrame, features: list[str], target: str, seen: list[Column]) -> list["BoostedModel"]:
        """A model for each condition, all grown together."""
        classes = self._counted(df, target)
        forests = boosting.fit_forests(df, features, target, seen, self.objective, classes, self.params)
        return [BoostedModel(self.objective, self.params, classes, list(features), f) for f in forests]

    def fit(self, df: DataFrame, features: list[str], target: str) -> "BoostedModel":
        self.features = list(features)
        self.forest = self.fit_all(df, features, target, [F.lit(True)])[0].forest
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return boosting.scored(df, [self.forest], F.lit(0), self.objective)

    def importance(self) -> dict[str, float]:
        return self.forest.importance()


def boosted_regressor(seed: int = 42, **params) -> BoostedModel:
    return BoostedModel("squared", Boosting.of(seed=seed, **params))


def boosted_classifier(seed: int = 42, classes: int = 2, **params) -> BoostedModel:
    """P(y = 1) of a 0/1 target; a softmax over the classes 0, 1, ... for more than two (0: counted in the data)."""
    return BoostedModel("logistic" if classes == 2 else "softmax", Boosting.of(seed=seed, **params), classes)


def choose_model(kind: str, problem: str, seed: int = 42, **params):
    """Model for (linear | trees, regression | binary | multiclass)."""
    if kind == "linear":
        if problem == "regression":
            return RidgeModel(**params)
        if problem == "binary":
            return LogisticModel(**params)
        raise ValueError("the linear model does not support multiclass targets")
    if kind == "trees":
        if problem == "regression":
            return boosted_regressor(seed, **params)
        if problem == "binary":
            return boosted_classifier(seed, **params)
        return boosted_classifier(seed, classes=0, **params)
    raise ValueError(f"unknown model {kind!r}")


def cross_fit(
    df: DataFrame, make, features: list[str], target: str, k: int, ordered_rows: int | None = None, gap: int = 0
) -> tuple[DataFrame, list[tuple[int, str, float]]]:
    """K fits of any model; each fold is scored by the model that did not see it.  With ``ordered_rows``, the
    row count of time-ordered folds with ``pos``, a fold's model sees only rows that lie more than ``gap``
    rows before it."""
    def training(fold: int) -> Column:
        return (F.col("fold") != fold) & (F.col("fold") >= 0) if ordered_rows is None else train_before(fold, ordered_rows, k, gap)

    if isinstance(plan := make(), BoostedModel):
        fitted = plan.fit_all(df, features, target, [training(f) for f in range(k)])
        table = boosting.scored(df.where("fold >= 0"), [m.forest for m in fitted], F.col("fold"), plan.objective)
        residual = expr.col(target).cast("double") - F.col("prediction")
        return table.withColumn("residual", residual), [(f, c, v) for f, m in enumerate(fitted) for c, v in m.importance().items()]
    if isinstance(plan, LogisticModel):
        fitted = plan.fit_all(df, features, target, [training(f) for f in range(k)])
        prediction = F.lit(None).cast("double")
        for f, m in enumerate(fitted):
            prediction = F.when(F.col("fold") == f, m.column()).otherwise(prediction)
        table = df.where("fold >= 0").withColumn("prediction", prediction)
        residual = expr.col(target).cast("double") - F.col("prediction")
        return table.withColumn("residual", residual), [(f, c, v) for f, m in enumerate(fitted) for c, v in m.importance().items()]
    parts, importances = None, []
    for fold in range(k):
        model = make().fit(df.where(training(fold)), features, target)
        scored = model.predict(df.where(F.col("fold") == fold))
        parts = scored if parts is None else parts.unionByName(scored)
        importances += [(fold, f, v) for f, v in model.importance().items()]
    return parts.withColumn("residual", expr.col(target).cast("double") - F.col("prediction")), importances


@dataclass
class Stack:
    """Meta-learner over base predictions: ridge, or logistic for a binary target."""

    bases: list[str]
    model: RidgeModel | LogisticModel

    def weights(self) -> dict[str, float]:
        """Blend weights |b| / sum |b|, uniform when all are zero."""
        b = np.abs(self.model.beta)
        share = b / b.sum() if b.sum() > 0 else np.full(len(b), 1.0 / len(b))
        return dict(zip(self.bases, map(float, share)))

    def predict(self, df: DataFrame) -> DataFrame:
        missing = [b for b in self.bases if b not in df.columns]
        if missing:
            raise ValueError(f"base predictions missing: {missing}")
        return df.withColumn("prediction", self.model.column())


def stack_oof(tables: dict[str, DataFrame], key: str, target: str = "y", alpha: float = 1.0, problem: str = "regression", c: float = 1.0) -> tuple[DataFrame, Stack]:
    """Cross-fitted ridge (for ``binary`` logistic, inverse penalty ``c``) over the bases' out-of-fold predictions,
    joined on the row key.  Rows with a non-finite base stay without a prediction."""
    names = list(tables)
    joined = None
    for n in names:
        t = tables[n]
        if joined is None:
            joined = t.select(key, "fold", F.col(target).cast("double").alias(target), expr.finite(F.col("prediction")).alias(n))
        else:
            joined = joined.join(t.select(key, expr.finite(F.col("prediction")).alias(n)), key)
    joined = durable(joined)
    if problem == "binary":
        k = int(joined.agg(F.max("fold")).first()[0]) + 1
        conditions = [F.lit(True), *[(F.col("fold") != f) & (F.col("fold") >= 0) for f in range(k)]]
        final, *by_fold = LogisticModel(c).fit_all(joined, names, target, conditions)
        prediction = F.lit(None).cast("double")
        for f, m in enumerate(by_fold):
            prediction = F.when(F.col("fold") == f, m.column()).otherwise(prediction)
        scored = joined.withColumn("prediction", prediction)
        return scored.withColumn("residual", F.col(target) - F.col("prediction")), Stack(names, final)
    folds = fold_moments(joined, names, target)
    result = ridge_oof(joined, names, target, alpha, folds)
    final = RidgeModel(alpha).from_moments(total(list(folds.values())), names, target)
    return result.table, Stack(names, final)


# Search spaces of the sweep: (low, high, log scale); fixed values.
SPACES = {
    "linear": {"alpha": (1e-3, 100.0, True)},
    "logistic": {"c": (1e-3, 100.0, True)},
    "trees": {
        "depth": (3, 10, False), "rate": (0.01, 0.3, True), "rows": (0.6, 1.0, False), "columns": (0.6, 1.0, False),
        "min_weight": (1, 20, False), "min_gain": (0.0, 5.0, False), "l1": (1e-8, 10.0, True), "l2": (1e-8, 10.0, True),
    },
}


def draw_trials(space: dict[str, tuple], trials: int, seed: int = 42, pinned: dict | None = None) -> list[dict]:
    """Seeded random configurations of a search space."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trials):
        config = {}
        for n, (lo, hi, log) in space.items():
            u = rng.random()
            v = float(np.exp(np.log(lo) + u * (np.log(hi) - np.log(lo)))) if log else lo + u * (hi - lo)
            config[n] = int(round(v)) if isinstance(lo, int) and isinstance(hi, int) and not log else v
        out.append({**config, **(pinned or {})})
    return out


def tune_trees(df: DataFrame, features: list[str], target: str, grid: dict[str, list], folds: int):
    """Grid search of the boosted regressor on the table's own folds: rows (values, mean R-squared), names, best."""
    rows = []
    for combo in product(*grid.values()):
        model = boosted_regressor(**dict(zip(grid, combo)))
        table, _ = cross_fit(df, lambda model=model: model, features, target, folds)
        rows.append((*[float(v) for v in combo], mean_r2(table, target)))
    best = max(range(len(rows)), key=lambda i: rows[i][-1])
    return rows, list(grid), best


def mean_r2(table: DataFrame, target: str) -> float:
    """Mean over the folds of R-squared of out-of-fold predictions; minus infinity without any."""
    from residua.operators.cv import fold_scores

    found = fold_scores(table, target).agg(F.avg("r2")).first()[0]
    return float("-inf") if found is None else float(found)
