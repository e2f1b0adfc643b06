"""Second-order gradient boosting with histograms, for the models of all folds at once.

Features become at most 256 quantile bins, and rows are packed into blocks of columns.  A pass over the blocks adds
up gradients and hessians per (fold, class, node, feature, bin); the sums of all tasks meet by (fold, class, node),
where the best split is found.  So a level of the trees of all folds and classes costs one pass, and only splits reach
the driver.  The blocks with the margins of a round are cached, made from those of the round before by applying its
trees; from time to time they are written, so that this chain stays short.

Trees see bins only, so rows of equal bins are one cell and share their margin.  Where a task can hold all cells, many
trees are grown in one job instead: tasks that hold cells with their rows draw the rows of every tree and send what is
drawn per cell, and a task per fold grows its trees over the cells.

Squared error, logistic loss (binary) and softmax (a tree per class and round).  Leaf weights are
-T(G) / (H + l2) with T the soft threshold at l1.  Rows are drawn per tree by a hash of their place, columns
by a seeded draw per fold and tree.  Missing values go left.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.functions import expr
from residua.session import durable, release, sweep

BLOCK_ROWS = 1 << 16
TASK_ROWS = 1 << 13
REFRESH = 10  # rounds between two writes of the margins
NODES_A_TASK = 40  # nodes whose splits one task finds
MOST_CELLS = 1 << 21  # cells, times classes, over which one task grows the trees of a fold
PART_ROWS = 1 << 20  # rows whose draws one task makes, in expectation
COMMON_ROWS = 1 << 12  # rows of a cell that go to one part, of those sent on at once
DRAWN_BYTES = 1 << 28  # of what trees draw of the cells, sent in one job
DRAW_ROWS = 1 << 14  # rows drawn or looked up at once
PIECE_ROWS = 1 << 18  # rows sent on at once to the tasks of their cells
LOOKUP_ROWS = 1 << 12  # rows from which on leaves are looked up
MOST_PLACES = 1 << 14  # places between the cuts of a tree for which its leaves are looked up
_OLD = {
    "maxIter": "trees", "maxDepth": "depth", "stepSize": "rate", "subsamplingRate": "rows", "featureSubsetStrategy": "columns",
    "minInstancesPerNode": "min_weight", "minInfoGain": "min_gain",
}


@dataclass(frozen=True)
class Boosting:
    """Settings; the defaults are fixed values of the analysis contract.  ``min_weight``: least hessian of a child."""

    trees: int = 200
    depth: int = 6
    rate: float = 0.1
    rows: float = 0.8
    columns: float = 0.8
    min_weight: float = 3.0
    min_gain: float = 0.0
    l1: float = 0.0
    l2: float = 1.0
    bins: int = 128
    seed: int = 42

    @staticmethod
    def of(**params) -> "Boosting":
        """From keyword settings; the names of Spark's tree parameters are understood too."""
        named = {_OLD.get(k, k): v for k, v in params.items()}
        unknown = set(named) - {f.name for f in fields(Boosting)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        whole = {"trees": int, "depth": int, "bins": int, "seed": int}
        return Boosting(**{k: whole.get(k, float)(v) for k, v in named.items()})


@dataclass
class Tree:
    """Nodes in arrays: feature (-1: leaf), last bin and last value that go left, children, value and cover."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    cut: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    cover: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin_: int, cut: float, gain: float, values: tuple[float, float], covers: tuple[float, float]) -> tuple[int, int]:
        self.feature[node], self.bin[node], self.cut[node], self.gain[node] = feature, bin_, cut, gain
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for v, c in zip(values, covers):
            for column, x in ((self.feature, -1), (self.bin, 0), (self.cut, 0.0), (self.left, 0), (self.right, 0), (self.value, v), (self.cover, c), (self.gain, 0.0)):
                column.append(x)
        return self.left[node], self.right[node]

    def nodes(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The leaf of every column of ``bins`` (features x rows)."""
        feature, last, left, right = (np.array(x) for x in (self.feature, self.bin, self.left, self.right))
        at, rows = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
        for _ in range(depth):
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            goes = bins[np.maximum(f, 0), rows] <= last[at]
            at = np.where(inner, np.where(goes, left[at], right[at]), at)
        return at

    def lookup(self, features: int, depth: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray] | None:
        """The leaves by place between the cuts: (feature, what each of its bins adds to the number of the place), and
        the leaf value of each place.  None where a tree has too many places."""
        cuts = {f: np.unique([b for g, b in zip(self.feature, self.bin) if g == f]) for f in sorted(set(self.feature) - {-1})}
        sizes = [len(c) + 1 for c in cuts.values()]
        if math.prod(sizes) > MOST_PLACES:
            return None
        places = np.zeros((features, math.prod(sizes)), np.uint8)
        steps = []
        for k, (f, c) in enumerate(cuts.items()):
            step = math.prod(sizes[k + 1:])
            places[f] = np.append(c, 255)[np.arange(places.shape[1]) // step % sizes[k]]
            steps.append((f, np.searchsorted(c, np.arange(256)) * step))
        return steps, np.array(self.value)[self.nodes(places, depth)]


@dataclass
class Forest:
    """The trees of one fold: rounds of one tree per class, over binned features."""

    features: list[str]
    edges: list[np.ndarray]
    base: np.ndarray
    depth: int
    rounds: list[list[Tree]] = field(default_factory=list)
    lookups: list[list[tuple | None]] | None = field(default=None, repr=False, compare=False)

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bins (features x rows) of values (rows x features); missing values are in the first."""
        return np.stack([np.searchsorted(e, np.where(np.isnan(c), -np.inf, c), "left") for e, c in zip(self.edges, x.T)]).astype(np.uint8) if x.shape[1] else np.zeros((0, len(x)), np.uint8)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        out = np.repeat(self.base[:, None], bins.shape[1], 1)
        if bins.shape[1] < LOOKUP_ROWS:
            return add_rounds(out, self.rounds, bins, self.depth)
        if self.lookups is None or len(self.lookups) < len(self.rounds):
            self.lookups = [[t.lookup(len(bins), self.depth) for t in trees] for trees in self.rounds]
        for lo in range(0, bins.shape[1], DRAW_ROWS):
            part, margin = bins[:, lo : lo + DRAW_ROWS], out[:, lo : lo + DRAW_ROWS]
            wide = part.astype(np.intp)
            for trees, lookups in zip(self.rounds, self.lookups):
                for c, (t, found) in enumerate(zip(trees, lookups)):
                    if found is None:
                        margin[c] += np.array(t.value)[t.nodes(part, self.depth)]
                    else:
                        steps, values = found
                        margin[c] += values[sum((places[wide[f]] for f, places in steps), np.zeros(1, np.intp))]
        return out

    def importance(self) -> dict[str, float]:
        """Share of the total split gain of each feature."""
        total = np.zeros(len(self.features))
        for trees in self.rounds:
            for t in trees:
                for f, g in zip(t.feature, t.gain):
                    if f >= 0:
                        total[f] += g
        share = total / total.sum() if total.sum() > 0 else total
        return dict(zip(self.features, map(float, share)))

    def paths(self, which: int = 0) -> list[list[tuple[float, list[tuple[int, float, float, float]]]]]:
        """Per tree of a class the leaves as (value, [(feature, low, high, share of rows)]), for attributions."""
        out = []
        for trees in self.rounds:
            t, leaves = trees[which], []
            stack: list[tuple[int, dict]] = [(0, {})]
            while stack:
                node, bounds = stack.pop()
                if t.feature[node] < 0:
                    leaves.append((t.value[node], [(f, *b) for f, b in bounds.items()]))
                    continue
                f, cover = t.feature[node], t.cover[t.left[node]] + t.cover[t.right[node]]
                lo, hi, share = bounds.get(f, (-np.inf, np.inf, 1.0))
                for child, b in ((t.left[node], (lo, min(hi, t.cut[node]))), (t.right[node], (max(lo, t.cut[node]), hi))):
                    stack.append((child, {**bounds, f: (*b, share * t.cover[child] / cover if cover > 0 else share / 2)}))
            out.append(leaves)
        return out


def add_rounds(margin: np.ndarray, rounds: list[list[Tree]], bins: np.ndarray, depth: int) -> np.ndarray:
    for trees in rounds:
        for c, t in enumerate(trees):
            margin[c] += np.array(t.value)[t.nodes(bins, depth)]
    return margin


def gradients(margin: np.ndarray, y: np.ndarray, objective: str) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by class and row."""
    if objective == "squared":
        return margin - y, np.ones_like(margin)
    if objective == "logistic":
        p = 1.0 / (1.0 + np.exp(-margin))
        return p - y, np.maximum(p * (1 - p), 1e-16)
    p = softmax(margin)
    return p - (np.arange(len(margin))[:, None] == y), np.maximum(2 * p * (1 - p), 1e-16)


def softmax(margin: np.ndarray) -> np.ndarray:
    e = np.exp(margin - margin.max(0))
    return e / e.sum(0)


def _mixed(place: np.ndarray, salt: int) -> np.ndarray:
    """Numbers from 0 to 2**64 of rows by their place, the same in every pass."""
    with np.errstate(over="ignore"):
        x = (place ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _places(block: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.arange(n, dtype=np.uint64) + np.uint64((block << 20) & (2**64 - 1))


def _drawn(place: np.ndarray, salt: int, share: float) -> np.ndarray:
    """Which rows are drawn: those whose uniform number of 53 bits lies below the share."""
    least = math.ceil(share * 2**53)
    if least >= 2**53:
        return np.ones(len(place), bool)
    return _mixed(place, salt) < np.uint64(max(least, 0) << 11)


def _salt(p: Boosting, number: int, fold: int) -> int:
    return p.seed * 1_000_003 + number * 101 + fold


def _columns(p: Boosting, fold: int, number: int, features: int) -> np.ndarray:
    """The columns that a tree may split on."""
    return np.sort(np.random.default_rng([p.seed, fold, number]).choice(features, max(1, round(p.columns * features)), replace=False))


@dataclass
class _Grown:
    """What a pass needs to know of one fold."""

    rounds: list[list[Tree]]  # since the margins were stored
    growing: list[Tree]
    open: list[list[int]]  # nodes of each class whose split is wanted
    columns: np.ndarray
    base: np.ndarray


def _unpacked(r: dict, folds: list[_Grown], features: int, classes: int, depth: int):
    """(fold, its state, bins, margins) of a block."""
    n = r["n"]
    bins = np.frombuffer(r["bins"], np.uint8).reshape(features, n)
    stored = np.frombuffer(r["margin"]).reshape(len(folds), classes, n) if r["margin"] else None
    for f, g in enumerate(folds):
        margin = stored[f].copy() if stored is not None else np.repeat(g.base[:, None], n, 1)
        yield f, g, bins, add_rounds(margin, g.rounds, bins, depth)


def _leaf(g: float, h: float, p: Boosting) -> float:
    pulled = np.sign(g) * np.maximum(np.abs(g) - p.l1, 0.0)
    return float(-p.rate * pulled / (h + p.l2))


def _score(g: np.ndarray, h: np.ndarray, p: Boosting) -> np.ndarray:
    pulled = np.maximum(np.abs(g) - p.l1, 0.0)
    return pulled * pulled / (h + p.l2)


def _bests(sums: np.ndarray, p: Boosting) -> list[tuple]:
    """Gradient and hessian of each node and its best split (column, bin, gain, sums left and right), None without gain.
    ``sums``: (gradient or hessian, node, column, bin)."""
    g, h = sums
    total_g, total_h = g[:, 0].sum(-1), h[:, 0].sum(-1)
    left_g, left_h = np.cumsum(g, -1)[..., :-1], np.cumsum(h, -1)[..., :-1]
    right_g, right_h = total_g[:, None, None] - left_g, total_h[:, None, None] - left_h
    gain = _score(left_g, left_h, p) + _score(right_g, right_h, p) - _score(total_g, total_h, p)[:, None, None]
    gain = np.where((left_h >= p.min_weight) & (right_h >= p.min_weight), gain / 2, -np.inf)
    if not gain.size:
        return [(float(a), float(b), None) for a, b in zip(total_g, total_h)]
    best = gain.reshape(len(gain), -1).argmax(1)
    nodes, i, b = np.arange(len(gain)), best // gain.shape[2], best % gain.shape[2]
    values = [v[nodes, i, b].tolist() for v in (gain, left_g, left_h, right_g, right_h)]
    splits = [s if s[2] > p.min_gain + 1e-12 else None for s in zip(i.tolist(), b.tolist(), *values)]
    return list(zip(total_g.tolist(), total_h.tolist(), splits))


def _split(tree: Tree, node: int, found: tuple, columns: np.ndarray, edges: list[np.ndarray], p: Boosting) -> tuple[int, ...]:
    """Split an open node where that gains; returns the nodes to look at next."""
    total_g, total_h, split = found
    if node == 0:
        tree.value[0], tree.cover[0] = _leaf(total_g, total_h, p), total_h
    if split is None:
        return ()
    i, b, gain, left_g, left_h, right_g, right_h = split
    feature = int(columns[i])
    if b >= len(edges[feature]):
        return ()
    values = _leaf(left_g, left_h, p), _leaf(right_g, right_h, p)
    return tree.split(node, feature, b, float(edges[feature][b]), gain, values, (left_h, right_h))


def _cell_keys(bins: np.ndarray, widths: list[int]) -> np.ndarray:
    """Numbers that are equal where all bins are."""
    key, most = np.zeros(bins.shape[1], np.int64), 1
    for own, width in zip(bins, widths):
        if most * width >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            most = int(key.max(initial=0)) + 1
        key, most = key * width + own, most * width
    return key


def _least(values: np.ndarray) -> bytes:
    """Values in the smallest type that holds them, behind its name."""
    for kind in ("u1", "u2", "u4") if len(values) and values.min() >= 0 else ():
        if values.max() <= np.iinfo(kind).max:
            small = values.astype(kind)
            return kind.encode() + small.tobytes() if (small == values).all() else b"f8" + values.astype(float).tobytes()
    return b"f8" + values.astype(float).tobytes()


def _values(packed: memoryview) -> np.ndarray:
    return np.frombuffer(packed, bytes(packed[:2]).decode(), offset=2).astype(float)


def _cell_gradients(margin: np.ndarray, n: np.ndarray, sums: np.ndarray, objective: str) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and hessians of cells, summed over their drawn rows.  ``sums``: of the targets over the start for squared
    error, of the ones for logistic loss, rows of each class for softmax."""
    if objective == "squared":
        return n * margin - sums, np.repeat(n[None], len(margin), 0)
    if objective == "logistic":
        q = 1.0 / (1.0 + np.exp(-margin))
        return n * q - sums, n * np.maximum(q * (1 - q), 1e-16)
    q = softmax(margin)
    return n * q - sums, n * np.maximum(2 * q * (1 - q), 1e-16)


def _grow_on_cells(bins: np.ndarray, g: np.ndarray, h: np.ndarray, columns: np.ndarray, edges: list[np.ndarray], p: Boosting) -> tuple[Tree, np.ndarray]:
    """A tree over cells, and the leaf value of each cell."""
    width = max(len(e) + 1 for e in edges)
    tree, at, wanted = Tree(), np.zeros(len(g), np.intp), [0]
    for _ in range(p.depth):
        if not wanted:
            break
        slot = np.full(len(tree.feature), -1)
        slot[wanted] = np.arange(len(wanted))
        place = slot[at]
        here = np.flatnonzero(place >= 0)
        whole = len(here) == len(place)
        start, own_g, own_h = (place, g, h) if whole else (place[here], g[here], h[here])
        sums, size = np.empty((2, len(wanted), len(columns), width)), len(wanted) * width
        for k, column in enumerate(columns):
            cell = start * width + (bins[column] if whole else bins[column, here])
            for i, own in enumerate((own_g, own_h)):
                sums[i, :, k] = np.bincount(cell, own, size).reshape(-1, width)
        former = wanted
        wanted = [n for node, found in zip(former, _bests(sums, p)) for n in _split(tree, node, found, columns, edges, p)]
        feature, last, left, right = (np.array(x) for x in (tree.feature, tree.bin, tree.left, tree.right))
        moving = np.flatnonzero(feature[at] >= 0)
        if len(moving) == len(at):
            goes = bins[feature[at], np.arange(len(at))] <= last[at]
            at = np.where(goes, left[at], right[at])
        elif len(moving):
            own = at[moving]
            goes = bins[feature[own], moving] <= last[own]
            at[moving] = np.where(goes, left[own], right[own])
    return tree, np.array(tree.value)[at]


class _Fit:
    def __init__(self, df: DataFrame, features: list[str], target: str, seen: list[Column], objective: str, classes: int, p: Boosting) -> None:
        self.p, self.objective, self.classes, self.folds = p, objective, classes, len(seen)
        self.features = list(features)
        x = [expr.as_double(expr.col(c)) for c in features]
        share = [i / p.bins for i in range(1, p.bins)]
        cuts = df.agg(*[F.percentile_approx(c, share, 10_000).alias(f"q{i}") for i, c in enumerate(x)]).first() if features else []
        self.edges = [np.unique(np.array(q if q is not None else [], float)) for q in cuts]
        mask = F.lit(0).cast("long")
        for f, s in enumerate(seen):
            mask = mask + F.when(F.coalesce(s, F.lit(False)), F.lit(1 << f)).otherwise(F.lit(0)).cast("long")
        y = expr.as_double(expr.col(target))
        rows = df.select(mask.alias("seen"), y.alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(x)]).where("y IS NOT NULL AND seen <> 0")
        edges, shape = self.edges, Forest(self.features, self.edges, np.zeros(1), p.depth)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task, number = TaskContext.get().partitionId(), 0
            for b in batches:
                for lo in range(0, b.num_rows, BLOCK_ROWS):
                    part = b.slice(lo, BLOCK_ROWS)
                    values = np.stack([part.column(i + 2).to_numpy(zero_copy_only=False).astype(float) for i in range(len(edges))], 1) if edges else np.zeros((part.num_rows, 0))
                    yield pa.RecordBatch.from_pydict({
                        "block": [(task << 24) + number], "n": [part.num_rows], "seen": [part.column(0).to_numpy().tobytes()], "y": [part.column(1).to_numpy().tobytes()],
                        "bins": [shape.binned(values).tobytes()], "margin": [b""],
                    })
                    number += 1

        self.blocks = durable(rows.mapInArrow(pack, "block long, n long, seen binary, y binary, bins binary, margin binary"))
        start = self.blocks.mapInArrow(self._start(), "fold int, n double, s double").groupBy("fold").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
        self.rows = max((r["n"] for r in start if r["fold"] >= 0), default=0)
        mean = {r["fold"]: r["s"] / r["n"] if r["n"] else 0.0 for r in start}
        self.forests = [Forest(self.features, self.edges, self._base(mean.get(f, 0.0)), p.depth) for f in range(self.folds)]
        self.bases = [f.base for f in self.forests]
        self.total = sum(r["n"] for r in start if r["fold"] < 0)
        self.dealt: RDD | None = None
        self.former: list[RDD | None] = []
        self._deal()

    def _start(self):
        folds = self.folds

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, rows = np.zeros((folds, 2)), 0
            for b in batches:
                for r in b.to_pylist():
                    rows += r["n"]
                    seen, y = np.frombuffer(r["seen"], np.int64), np.frombuffer(r["y"])
                    for f in range(folds):
                        own = seen >> f & 1 > 0
                        total[f] += own.sum(), y[own].sum()
            yield pa.RecordBatch.from_pydict({"fold": pa.array(range(-1, folds), pa.int32()), "n": [float(rows), *total[:, 0]], "s": [0.0, *total[:, 1]]})

        return add

    def _base(self, mean: float) -> np.ndarray:
        if self.objective == "squared":
            return np.array([mean])
        if self.objective == "logistic":
            q = min(max(mean, 1e-6), 1 - 1e-6)
            return np.array([np.log(q / (1 - q))])
        return np.zeros(self.classes)

    def splits(self, state: list[_Grown], number: int) -> dict[tuple[int, int, int], tuple]:
        """Per (fold, class, node) the sums over all rows and the best split, see ``_best``."""
        p, width = self.p, max((len(e) + 1 for e in self.edges), default=1)
        folds, objective = [(g.growing, g.open, g.columns) for g in state], self.objective

        def add(blocks: Iterator[tuple]) -> Iterator[tuple]:
            total = [[np.zeros((2, len(o), len(columns) * width)) for o in open_] for _, open_, columns in folds]
            for block, n, seen, y, bins, margins in blocks:
                for f, (growing, open_, columns) in enumerate(folds):
                    drawn = np.flatnonzero((seen >> f & 1 > 0) & _drawn(_places(block, n), _salt(p, number, f), p.rows))
                    if not len(drawn):
                        continue
                    grad, hess = gradients(margins[f][:, drawn], y[drawn], objective)
                    own = bins[:, drawn]
                    for c, (tree, wanted) in enumerate(zip(growing, open_)):
                        if not wanted:
                            continue
                        slot = np.full(len(tree.feature), -1)
                        slot[wanted] = np.arange(len(wanted))
                        at = slot[tree.nodes(own, p.depth)]
                        here = np.flatnonzero(at >= 0)
                        place, g, h = at[here] * (len(columns) * width), grad[c, here], hess[c, here]
                        sums = total[f][c]
                        for k, col in enumerate(columns):
                            cell = place + k * width + own[col, here]
                            sums[0] += np.bincount(cell, g, sums[0].size).reshape(sums[0].shape)
                            sums[1] += np.bincount(cell, h, sums[1].size).reshape(sums[1].shape)
            task = TaskContext.get().partitionId()
            for f, (_, open_, _columns) in enumerate(folds):
                for c, wanted in enumerate(open_):
                    for k, node in enumerate(wanted):
                        yield (f, c, node), (task, total[f][c][:, k])

        def best(item: tuple) -> tuple:
            key, parts = item
            whole = sum(v for _, v in sorted(parts, key=lambda part: part[0]))  # in one order, whichever came first
            return key, _bests(whole.reshape(2, 1, -1, width), p)[0]

        nodes = sum(len(o) for g in state for o in g.open)
        tasks = max(1, min(self.tasks, -(-nodes // NODES_A_TASK)))
        return dict(self.dealt.mapPartitions(add).groupByKey(tasks).map(best).collect())

    def few_cells(self) -> bool:
        """Whether a task can hold all cells."""
        most = MOST_CELLS // self.classes
        widths, bins = [len(e) + 1 for e in self.edges], len(self.edges)
        if not self.edges or not self.total:
            return False
        if min(math.prod(widths), self.total) <= most:
            return True

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    own = np.frombuffer(r["bins"], np.uint8).reshape(bins, r["n"])
                    own = own[:, np.unique(_cell_keys(own, widths), return_index=True)[1]]
                    yield pa.RecordBatch.from_pydict({"cell": [c.tobytes() for c in own.T]})

        return self.blocks.mapInArrow(cells, "cell binary").distinct().count() <= most

    def _held(self) -> DataFrame:
        """The rows by cell, a row for each part of them.  Rows of a cell lie in one part, of a very common cell in several:
        each part then has a cell of its own with these bins."""
        widths, features = [len(e) + 1 for e in self.edges], len(self.edges)
        cores = self.blocks.sparkSession.sparkContext.defaultParallelism
        parts = max(-(-int(self.total) // PART_ROWS), min(cores, -(-int(self.total) // TASK_ROWS)))

        def joined(rows: list[dict]) -> tuple[np.ndarray, ...]:
            bins = np.concatenate([np.frombuffer(r["bins"], np.uint8).reshape(features, -1) for r in rows], 1)
            return bins, *(np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (("seen", np.int64), ("y", float)))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                blocks, some, n = b.to_pylist(), [], 0
                for k, r in enumerate(blocks):
                    some, n = [*some, r], n + r["n"]
                    if n < PIECE_ROWS and k + 1 < len(blocks):
                        continue
                    bins, seen, y = joined(some)
                    place = np.concatenate([_places(r["block"], r["n"]) for r in some])
                    some, n = [], 0
                    key = _cell_keys(bins, widths)
                    order = np.argsort(key, kind="stable")
                    starts = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
                    rank = np.empty(len(key), np.int64)
                    rank[order] = np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key))))
                    to = np.zeros(len(key), np.uint64)
                    for own in bins:
                        to = _mixed(to ^ own, 1)
                    part = (to % np.uint64(parts)).astype(np.int64) + rank // COMMON_ROWS
                    part %= parts
                    order = np.argsort(part, kind="stable")
                    bounds = np.searchsorted(part[order], np.arange(parts + 1))
                    chosen = [(k, order[lo:hi]) for k, (lo, hi) in enumerate(zip(bounds, bounds[1:])) if hi > lo]
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array([k for k, _ in chosen], pa.int32()), "bins": [bins[:, o].tobytes() for _, o in chosen],
                        **{c: [v[o].tobytes() for _, o in chosen] for c, v in (("seen", seen), ("y", y), ("place", place))},
                    })

        def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces = [r for b in batches for r in b.to_pylist()]
            if not pieces:
                return
            part, place = pieces[0]["part"], np.concatenate([np.frombuffer(r["place"], np.uint64) for r in pieces])
            bins, seen, y = joined(pieces)
            del pieces
            key = _cell_keys(bins, widths)
            order = np.lexsort((place, key))
            first = np.append(True, key[order][1:] != key[order][:-1])
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "cells": [int(first.sum())], "bins": [bins[:, order[first]].tobytes()], "cell": [(np.cumsum(first) - 1).astype(np.int32).tobytes()],
                **{c: [v[order].tobytes()] for c, v in (("seen", seen), ("y", y), ("place", place))},
            })

        pieces = self.blocks.mapInArrow(deal, "part int, bins binary, seen binary, y binary, place binary").repartitionById(parts, F.col("part"))
        return durable(pieces.mapInArrow(hold, "part int, cells long, bins binary, cell binary, seen binary, y binary, place binary"))

    def _on_cells(self) -> list[Forest]:
        """Many trees in one job over cells."""
        p, held = self.p, self._held()
        self.dealt.unpersist()
        release(self.blocks)
        cells = held.agg(F.sum("cells")).first()[0]
        step = max(1, DRAWN_BYTES // (cells * self.folds * (4 * self.classes if self.objective == "softmax" else 10)))
        for first in range(0, p.trees, step):
            if first:
                sweep(held.sparkSession)  # what former trees drew
            numbers = range(first, min(first + step, p.trees))
            draws = held.mapInArrow(self._draws(numbers), "fold int, number int, part int, n binary, sums binary").repartitionById(self.folds, F.col("fold"))
            grown = draws.sortWithinPartitions("number", "part").mapInArrow(self._grown(), "fold int, number int, trees binary").collect()
            for r in sorted(grown, key=lambda r: r["number"]):
                self.forests[r["fold"]].rounds.append(pickle.loads(r["trees"]))
        release(held)
        return self.forests

    def _draws(self, numbers: range):
        """What trees of all folds draw of the cells of each part, behind the bins of these cells."""
        p, objective, classes, folds, bases = self.p, self.objective, self.classes, self.folds, self.bases
        kinds = classes + 1 if objective == "softmax" else 1  # the last: no class

        def row(fold: int, number: int, part: int, n: bytes, sums: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({**{c: pa.array([v], pa.int32()) for c, v in (("fold", fold), ("number", number), ("part", part))}, "n": [n], "sums": [sums]})

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
                cell, seen, y, place = (np.frombuffer(r[c], t) for c, t in (("cell", np.int32), ("seen", np.int64), ("y", float), ("place", np.uint64)))
                for f in range(folds):
                    yield row(f, -1, r["part"], r["bins"], b"")
                    own = np.flatnonzero(seen >> f & 1 > 0)
                    of, target, places = cell[own].astype(np.intp), y[own], place[own]
                    if objective == "squared":
                        target = target - bases[f][0]
                    code = of * kinds
                    if objective == "softmax":
                        code += np.where((target >= 0) & (target < classes) & (target == np.floor(target)), target, classes).astype(np.intp)
                    for number in numbers:
                        n, sums = np.zeros(r["cells"] * kinds, np.int64), np.zeros(r["cells"])
                        for lo in range(0, len(own), DRAW_ROWS):
                            hi = min(lo + DRAW_ROWS, len(own))
                            drawn = np.flatnonzero(_drawn(places[lo:hi], _salt(p, number, f), p.rows)) + lo
                            low, high = int(of[lo]), int(of[hi - 1]) + 1
                            n[low * kinds : high * kinds] += np.bincount(code[drawn] - low * kinds, minlength=(high - low) * kinds)
                            if kinds == 1:
                                sums[low:high] += np.bincount(of[drawn] - low, target[drawn], high - low)
                        yield row(f, number, r["part"], _least(n), _least(sums) if kinds == 1 else b"")

        return draw

    def _grown(self):
        """The trees of a fold, from what they draw."""
        p, objective, edges, features = self.p, self.objective, self.edges, len(self.edges)
        kinds = self.classes + 1 if objective == "softmax" else 1
        bases = [np.zeros(1) if objective == "squared" else b for b in self.bases]  # squared error: targets are drawn over the start
        former = [Forest(self.features, edges, b, p.depth, f.rounds) for b, f in zip(bases, self.forests)]

        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, drawn, bins, margin = [], [], None, None
            for b in batches:
                columns = [b.column(c) for c in ("fold", "number", "n", "sums")]
                for f, number, n, sums in zip(*(c.to_pylist() for c in columns[:2]), *columns[2:]):
                    if number < 0:
                        held.append(np.frombuffer(n.as_py(), np.uint8).reshape(features, -1))
                        continue
                    if margin is None:
                        bins = np.concatenate(held, 1)
                        margin = former[f].margins(bins)
                    drawn.append([_values(v.as_buffer()) for v in ((n, sums) if kinds == 1 else (n,))])
                    if len(drawn) < len(held):
                        continue
                    whole, drawn = [np.concatenate(v) for v in zip(*drawn)], []
                    if kinds > 1:
                        by_kind = whole[0].reshape(-1, kinds).T
                        whole = [by_kind.sum(0), by_kind[:-1]]
                    grad, hess = _cell_gradients(margin, *whole, objective)
                    trees = []
                    for c in range(len(margin)):
                        tree, gained = _grow_on_cells(bins, grad[c], hess[c], _columns(p, f, number, features), edges, p)
                        trees.append(tree)
                        margin[c] += gained
                    yield pa.RecordBatch.from_pydict({"fold": pa.array([f], pa.int32()), "number": pa.array([number], pa.int32()), "trees": [pickle.dumps(trees)]})

        return grow

    def run(self) -> list[Forest]:
        return self._on_cells() if self.few_cells() else self._in_passes()

    def _in_passes(self) -> list[Forest]:
        """A pass over all rows for each level of the trees."""
        p = self.p
        pending: list[list[list[Tree]]] = [[] for _ in range(self.folds)]
        for number in range(p.trees if self.features else 0):
            state = []
            for f in range(self.folds):
                columns = _columns(p, f, number, len(self.features))
                state.append(_Grown(pending[f], [Tree() for _ in range(self.classes)], [[0] for _ in range(self.classes)], columns, self.forests[f].base))
            for _ in range(p.depth):
                if not any(o for g in state for o in g.open):
                    break
                found = self.splits(state, number)
                self._forget()
                for f, g in enumerate(state):
                    g.open = [[n for node in o for n in _split(t, node, found[f, c, node], g.columns, self.edges, p)] for c, (t, o) in enumerate(zip(g.growing, g.open))]
            for f, g in enumerate(state):
                self.forests[f].rounds.append(g.growing)
                pending[f].append(g.growing)
            if number + 1 == p.trees:
                break
            if (number + 1) % REFRESH == 0:
                self._store(pending)
                pending = [[] for _ in range(self.folds)]
            else:
                self._advance([g.growing for g in state])
        self._forget()
        self.dealt.unpersist()
        release(self.blocks)
        return self.forests

    def _store(self, pending: list[list[list[Tree]]]) -> None:
        state = [_Grown(r, [], [], np.zeros(0, int), f.base) for r, f in zip(pending, self.forests)]
        shape = (len(self.features), self.classes, self.p.depth)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    margin = np.stack([m for *_, m in _unpacked(r, state, *shape)])
                    yield pa.RecordBatch.from_pydict({**{k: [v] for k, v in r.items()}, "margin": [margin.tobytes()]})

        former, self.blocks = self.blocks, durable(self.blocks.mapInArrow(add, self.blocks.schema))
        self._deal()
        release(former)

    def _deal(self) -> None:
        """Blocks as arrays, cached.  Small tables go to few tasks: a pass over them costs little more than its start."""
        given = self.blocks.rdd.getNumPartitions()
        self.tasks = max(1, min(max(given, self.blocks.sparkSession.sparkContext.defaultParallelism), -(-int(self.rows) // TASK_ROWS)))
        features, folds, classes, bases = len(self.features), self.folds, self.classes, self.bases

        def arrays(r) -> tuple:
            n = r["n"]
            bins = np.frombuffer(r["bins"], np.uint8).reshape(features, n)
            if r["margin"]:
                margins = np.frombuffer(r["margin"]).reshape(folds, classes, n)
            else:
                margins = np.repeat(np.stack(bases)[:, :, None], n, 2)
            return r["block"], n, np.frombuffer(r["seen"], np.int64), np.frombuffer(r["y"]), bins, margins

        dealt = self.blocks.coalesce(self.tasks) if self.tasks <= given else self.blocks.repartition(self.tasks)
        self._keep(dealt.rdd.map(arrays))

    def _advance(self, grown: list[list[Tree]]) -> None:
        """The blocks of the next round: the trees of this one applied."""
        depth = self.p.depth

        def apply(block: tuple) -> tuple:
            *rest, bins, margins = block
            return *rest, bins, np.stack([add_rounds(m.copy(), [trees], bins, depth) for m, trees in zip(margins, grown)])

        self._keep(self.dealt.map(apply))

    def _keep(self, dealt: RDD) -> None:
        self.former.append(self.dealt)
        self.dealt = dealt.persist(StorageLevel.MEMORY_AND_DISK)

    def _forget(self) -> None:
        """Blocks of former rounds go once a pass has made those of this one."""
        for old in self.former:
            if old is not None:
                old.unpersist()
        self.former = []


def fit_forests(df: DataFrame, features: list[str], target: str, seen: list[Column], objective: str = "squared", classes: int = 1, params: Boosting | None = None) -> list[Forest]:
    """A forest for each condition of ``seen``: the rows it is fitted on (62 conditions at most).  Targets are
    numbers; 0/1 for ``logistic`` and 0 .. classes - 1 for ``softmax``.  Rows without a target are left out."""
    if objective not in ("squared", "logistic", "softmax"):
        raise ValueError(f"unknown objective {objective!r}")
    if len(seen) > 62:
        raise ValueError("at most 62 models at once")
    p = params or Boosting()
    if not 2 <= p.bins <= 256:
        raise ValueError("bins must be between 2 and 256")
    return _Fit(df, features, target, seen, objective, classes if objective == "softmax" else 1, p).run()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together up to the rows of a block or 64 MB."""
    some, rows, size = [], 0, 0
    for b in batches:
        if some and (rows + b.num_rows > BLOCK_ROWS or size + b.nbytes > 1 << 26):
            yield pa.concat_batches(some)
            some, rows, size = [], 0, 0
        some, rows, size = [*some, b], rows + b.num_rows, size + b.nbytes
    if some:
        yield pa.concat_batches(some)


def scored(df: DataFrame, forests: list[Forest], which: Column, objective: str, out: str = "prediction") -> DataFrame:
    """Adds the prediction of the forest numbered ``which`` (null where there is none): a value, the probability of 1,
    or the likeliest class; for softmax also ``probabilities``."""
    features = forests[0].features
    names = [c for c in df.columns if c not in (out, "probabilities")]
    work = df.select(*[expr.col(c) for c in names], which.cast("int").alias("__which"), *[expr.as_double(expr.col(c)).alias(f"__x{i}") for i, c in enumerate(features)])
    extra = f", `{out}` double" + (", probabilities array<double>" if objective == "softmax" else "")
    schema = ", ".join(f"{expr.name(f.name)} {f.dataType.simpleString()}" for f in df.select(*[expr.col(c) for c in names]).schema.fields) + extra

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _joined(batches):
            for lo in range(0, whole.num_rows, BLOCK_ROWS):
                b = whole.slice(lo, BLOCK_ROWS)
                fold = np.nan_to_num(b.column("__which").to_numpy(zero_copy_only=False).astype(float), nan=-1).astype(int)
                x = np.stack([b.column(f"__x{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(features))], 1) if features else np.zeros((b.num_rows, 0))
                value, shares = np.full(b.num_rows, np.nan), [None] * b.num_rows
                for f, forest in enumerate(forests):
                    at = np.flatnonzero(fold == f)
                    if not len(at):
                        continue
                    margin = forest.margins(forest.binned(x[at]))
                    if objective == "squared":
                        value[at] = margin[0]
                    elif objective == "logistic":
                        value[at] = 1.0 / (1.0 + np.exp(-margin[0]))
                    else:
                        q = softmax(margin)
                        value[at] = q.argmax(0)
                        for i, row in zip(at, q.T):
                            shares[i] = row
                cols = [b.column(i) for i in range(len(names))] + [pa.array(value, mask=np.isnan(value))]
                if objective == "softmax":
                    cols.append(pa.array(shares, pa.list_(pa.float64())))
                    yield pa.RecordBatch.from_arrays(cols, names=[*names, out, "probabilities"])
                else:
                    yield pa.RecordBatch.from_arrays(cols, names=[*names, out])

    return work.mapInArrow(score, schema)
