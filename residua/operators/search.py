"""Seeded sequential search of settings.

After some random trials, each setting is drawn from the density of the good trials so far (a Parzen window) and
the draw that is likeliest under the good against the other trials is tried.  A trial is scored on growing sets
of folds and given up when it is below the median of the earlier trials on the same set.  A trial that raises
counts as minus infinity; no trial begins once the time is up.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.operators import boosting, models

TRIALS, SECONDS = 30, 300.0  # fixed values of the analysis contract
STARTUP, GOOD, DRAWS = 8, 0.25, 24
FEWEST = 4  # earlier trials on a set of folds before one is given up there

Space = dict[str, tuple]  # name -> (low, high, log scale) or (choice, choice, ...) of strings


@dataclass
class Trial:
    number: int
    params: dict
    score: float
    best: float  # so far, over trials scored on all folds
    folds: int
    error: str = ""
    score_at: dict[int, float] = field(default_factory=dict)  # by the number of folds scored


@dataclass
class Search:
    space: Space
    seed: int = 42
    pinned: dict = field(default_factory=dict)
    trials: list[Trial] = field(default_factory=list)

    def _choices(self, name: str) -> bool:
        return isinstance(self.space[name][0], str)

    def _unit(self, name: str, value: float) -> float:
        lo, hi, log = self.space[name]
        return (math.log(value) - math.log(lo)) / (math.log(hi) - math.log(lo)) if log else (value - lo) / (hi - lo)

    def _value(self, name: str, u: float):
        if self._choices(name):
            return self.space[name][min(int(u * len(self.space[name])), len(self.space[name]) - 1)]
        lo, hi, log = self.space[name]
        v = math.exp(math.log(lo) + u * (math.log(hi) - math.log(lo))) if log else lo + u * (hi - lo)
        v = min(max(v, lo), hi)
        return int(round(v)) if isinstance(lo, int) and isinstance(hi, int) and not log else v

    def propose(self) -> dict:
        rng = np.random.default_rng([self.seed, len(self.trials)])
        done = sorted((t for t in self.trials if math.isfinite(t.score)), key=lambda t: (-t.folds, -t.score))
        if len(done) < STARTUP:
            return {**{n: self._value(n, rng.random()) for n in self.space}, **self.pinned}
        cut = max(2, math.ceil(GOOD * len(done)))
        good, rest = done[:cut], done[cut:]
        return {**{n: self._drawn(n, [t.params[n] for t in good], [t.params[n] for t in rest], rng) for n in self.space}, **self.pinned}

    def _drawn(self, name: str, good: list, rest: list, rng: np.random.Generator):
        if name in self.pinned:
            return self.pinned[name]
        if self._choices(name):
            options = self.space[name]
            a = np.array([1 + good.count(o) for o in options]) / (len(options) + len(good))
            b = np.array([1 + rest.count(o) for o in options]) / (len(options) + len(rest))
            drawn = rng.choice(len(options), DRAWS, p=a)
            return options[int(drawn[np.argmax(a[drawn] / b[drawn])])]
        x, y = (np.array([self._unit(name, v) for v in side]) for side in (good, rest))
        width = max(0.05, len(good) ** -0.2 * float(np.std(x)))
        draws = np.clip(x[rng.integers(0, len(x), DRAWS)] + rng.normal(0, width, DRAWS), 0, 1)
        draws[0] = rng.random()  # the whole range stays possible
        density = lambda at, centres: (1.0 + np.exp(-0.5 * ((at[:, None] - centres[None]) / width) ** 2).sum(1) / width) / (1 + len(centres))
        return self._value(name, float(draws[np.argmax(density(draws, x) / density(draws, y))]))

    def run(self, evaluate: Callable[[dict, list[int]], list[float]], folds: int, trials: int = TRIALS, seconds: float = SECONDS, clock: Callable[[], float] = time.monotonic) -> list[Trial]:
        """``evaluate(params, folds)`` gives the score of each of the folds; larger is better."""
        end, rungs = clock() + seconds, sorted({1, max(1, folds // 2), folds})
        while len(self.trials) < trials and (not self.trials or clock() < end):
            params, scores, error, reached = self.propose(), [], "", {}
            try:
                for rung in rungs:
                    scores += list(evaluate(params, list(range(len(scores), rung))))
                    score = float(np.mean(scores))
                    earlier = [t.score_at[rung] for t in self.trials if rung in t.score_at]
                    reached[rung] = score
                    if not math.isfinite(score) or (rung < folds and len(earlier) >= FEWEST and score < float(np.median(earlier))):
                        break
            except Exception as failure:  # a failed trial is a result of the search
                scores, error = [], f"{type(failure).__name__}: {failure}"[:500]
            score = float(np.mean(scores)) if scores and all(map(math.isfinite, scores)) else float("-inf")
            before = self.trials[-1].best if self.trials else float("-inf")
            best = max(before, score) if len(scores) == folds else before
            self.trials.append(Trial(len(self.trials), params, score, best, len(scores), error, reached))
        return self.trials

    def best(self) -> Trial | None:
        whole = [t for t in self.trials if math.isfinite(t.score) and t.folds == max(x.folds for x in self.trials)]
        return max(whole, key=lambda t: (t.score, -t.number), default=None)


def tune(df: DataFrame, features: list[str], target: str, kind: str, folds: int, problem: str = "regression", trials: int = TRIALS, seconds: float = SECONDS, seed: int = 42, pinned: dict | None = None) -> Search:
    """Search the settings of a model (``linear`` or ``trees``) on the table's own folds, by R-squared or AUC."""
    from residua.operators.cv import fold_auc, fold_scores

    name = "logistic" if kind == "linear" and problem == "binary" else kind
    search = Search(models.SPACES[name], seed, pinned or {})
    metric, column = (fold_auc, "auc") if problem == "binary" else (fold_scores, "r2")
    moments = models.fold_moments(df, features, target) if kind == "linear" and problem == "regression" else None

    def training(f: int) -> Column:
        return (F.col("fold") != f) & (F.col("fold") >= 0)

    def evaluate(params: dict, chosen: list[int]) -> list[float]:
        held = df.where(F.col("fold").isin(chosen))
        if moments is not None:
            table = models.ridge_oof(held, features, target, params["alpha"], moments).table
        elif kind == "linear":
            fitted = models.LogisticModel(params["c"]).fit_all(df, features, target, [training(f) for f in chosen])
            prediction = F.lit(None).cast("double")
            for f, m in zip(chosen, fitted):
                prediction = F.when(F.col("fold") == f, m.column()).otherwise(prediction)
            table = held.withColumn("prediction", prediction)
        else:
            objective = "logistic" if problem == "binary" else "squared"
            forests = boosting.fit_forests(df, features, target, [training(f) for f in chosen], objective, 1, boosting.Boosting.of(seed=seed, **params))
            which = F.lit(None).cast("int")
            for i, f in enumerate(chosen):
                which = F.when(F.col("fold") == f, i).otherwise(which)
            table = boosting.scored(held, forests, which, objective)
        got = {r["fold"]: r[column] for r in metric(table, target).collect()}
        return [float(got.get(f, float("-inf"))) for f in chosen]

    search.run(evaluate, folds, trials, seconds)
    return search
