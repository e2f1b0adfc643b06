"""Quality classifier: a factorisation machine over hashed words, word shapes, structure and metadata.

    f(x) = b + w.x + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

The second form of the pairwise term needs one pass over the non-zero entries.  Features come from whole
texts, in Spark tasks.  The machine is fitted on a bounded sample of labelled rows (``max_rows``), drawn by
a hash of the key, with Adam on the logistic loss; scoring is a projection of every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residua.llm import chunks
from residua.llm.words import LOWER, Words, slices, split, text_bytes

MAX_ROWS = 20_000
WORD_DIM, SHAPE_DIM, RANK = 256, 128, 8
STATS = 14


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=float)])
    return total[first[1:]] - total[first[:-1]]


def _histogram(owner: np.ndarray, slot: np.ndarray, rows: int, dim: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner * dim + slot, weights=weight, minlength=rows * dim).reshape(rows, dim).astype(np.float64)


def features(part: pa.RecordBatch, text: str, metadata: list[str]) -> np.ndarray:
    """One row of numbers per text, each about 0 to 1."""
    texts = part.column(text)
    w: Words = split(texts, LOWER)
    rows, counts = part.num_rows, w.counts
    owner = np.repeat(np.arange(rows), counts)
    per = 1.0 / np.maximum(counts, 1)
    words = np.sqrt(_histogram(owner, (w.hashes >> np.uint64(40)).astype(np.int64) % WORD_DIM, rows, WORD_DIM) * per[:, None])
    last = w.data[w.ends - 1] if len(w.ends) else np.empty(0, np.uint8)
    shapes = np.sqrt(_histogram(owner, np.minimum(last, SHAPE_DIM - 1).astype(np.int64), rows, SHAPE_DIM) * per[:, None])
    sizes = (w.ends - w.starts).astype(float)
    raw, at = text_bytes(texts)
    share = lambda flags: (np.diff(np.concatenate([[0], np.cumsum(flags)])[at])) / np.maximum(np.diff(at), 1)
    upper = (raw >= 65) & (raw <= 90)
    symbol = ((raw >= 33) & (raw <= 47)) | ((raw >= 58) & (raw <= 64)) | ((raw >= 91) & (raw <= 96)) | ((raw >= 123) & (raw <= 126))
    again = np.zeros(len(owner))
    again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((w.hashes, owner))
    new = np.ones(len(order), bool)
    new[1:] = (w.hashes[order][1:] != w.hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    kinds = np.bincount(owner[order][new], minlength=rows)
    run = np.diff(np.append(np.flatnonzero(new), len(order)))
    top = np.zeros(rows)
    np.maximum.at(top, owner[order][new], run)
    lines = np.diff(np.concatenate([[0], np.cumsum(raw == 10)])[at])
    stats = np.stack(
        [
            np.minimum(np.log1p(counts) / 10, 2), np.minimum(_sums(sizes, w.first) * per / 10, 3), share(upper), share((raw >= 48) & (raw <= 57)),
            share(symbol), share(raw >= 128), share(raw == 32), kinds * per, top * per, _sums(again, w.first) * per, np.minimum(lines * per * 5, 2),
            np.minimum(_sums((sizes - 6) ** 2, w.first) * per / 50, 3), (counts == 0).astype(float), np.minimum(np.log1p(lines) / 6, 2),
        ],
        1,
    )
    meta = [np.empty((rows, 0))]
    for name in metadata:
        v = pc.cast(part.column(name), pa.float64())
        meta.append(np.stack([np.log1p(np.abs(np.nan_to_num(pc.fill_null(v, 0.0).to_numpy(zero_copy_only=False)))) / 10, pc.is_null(v).to_numpy(zero_copy_only=False).astype(float)], 1))
    return np.hstack([words, shapes, stats, *meta]).astype(np.float32)


@dataclass
class Machine:
    """Weights; ``mean`` and ``scale`` put features on one footing."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return self.bias + z @ self.linear + 0.5 * ((z @ self.factors) ** 2 - (z * z) @ (self.factors**2)).sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def train_machine(x: np.ndarray, y: np.ndarray, rank: int = RANK, epochs: int = 20, rate: float = 0.01, decay: float = 1e-3, seed: int = 1) -> Machine:
    """Adam on minibatches of the logistic loss; the order of rows is fixed by the seed."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    mean, scale = (x.mean(0), x.std(0) + 0.02) if n else (np.zeros(d), np.ones(d))
    m = Machine(float(np.log(share / (1 - share))), np.zeros(d), rng.normal(0, 0.01, (d, rank)), mean, scale)
    state = [np.zeros(1), np.zeros(1), np.zeros(d), np.zeros(d), np.zeros((d, rank)), np.zeros((d, rank))]
    step, size = 0, 256
    for epoch in range(epochs if n else 0):
        order = rng.permutation(n)
        pace = rate * (1 - epoch / epochs) + rate / 50
        for lo in range(0, n, size):
            rows = order[lo : lo + size]
            z = np.clip((x[rows] - mean) / scale, -6, 6)
            e = (1 / (1 + np.exp(-np.clip(m.logits(x[rows]), -40, 40))) - y[rows]) / len(rows)
            inner = z @ m.factors
            grads = [
                np.array([e.sum()]), z.T @ e + decay * m.linear,
                z.T @ (e[:, None] * inner) - m.factors * ((z * z).T @ e)[:, None] + decay * m.factors,
            ]
            step += 1
            moves = []
            for i, g in enumerate(grads):
                state[2 * i] = 0.9 * state[2 * i] + 0.1 * g
                state[2 * i + 1] = 0.999 * state[2 * i + 1] + 0.001 * g * g
                moves.append(pace * (state[2 * i] / (1 - 0.9**step)) / (np.sqrt(state[2 * i + 1] / (1 - 0.999**step)) + 1e-8))
            m.bias -= float(moves[0][0])
            m.linear -= moves[1]
            m.factors -= moves[2]
    return m


def fit(labelled: DataFrame, text: str = "text", label: str = "quality", metadata: list[str] | None = None, key: str = "doc_id", max_rows: int = MAX_ROWS) -> Machine:
    """Fit on at most about ``max_rows`` of the rows whose label is 0 or 1; no rows give a constant score
    of one half.  Null texts count as empty."""
    metadata = metadata or []
    rows = labelled.where(F.col(label).isin(0, 1))
    n = rows.count()
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(5)), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    kind = chunks.shape("y int, x binary")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            x = features(part, text, metadata).astype(np.float16)
            y = part.column(label).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([y, pa.array([r.tobytes() for r in x], pa.binary())], schema=chunks.arrow_schema(kind))

    got = rows.select(text, label, *metadata).mapInArrow(extract, kind).toArrow()
    dim = WORD_DIM + SHAPE_DIM + STATS + 2 * len(metadata)
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(-1, dim).astype(np.float32)
    y = got.column("y").to_numpy().astype(float)
    order = np.lexsort((*x[:, : min(dim, 40)].T, y)) if len(x) else np.empty(0, np.int64)  # rows in an order that does not depend on tasks
    return train_machine(x[order], y[order])


def score(docs: DataFrame, machine: Machine, text: str = "text", metadata: list[str] | None = None) -> DataFrame:
    """Adds ``score``, the probability of label 1, to every row, replacing a column of that name.
    Null, empty and very long texts are scored like all others."""
    metadata = metadata or []
    base = docs.drop("score")
    shape = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = chunks.arrow_schema(shape)
        for part in slices(batches, text):
            p = np.concatenate([shared.value.probability(features(part.slice(lo, 500), text, metadata)) for lo in range(0, part.num_rows, 500)])
            yield pa.RecordBatch.from_arrays([*[part.column(f.name).cast(f.type) for f in schema if f.name != "score"], pa.array(p.astype(float))], schema=schema)

    return base.mapInArrow(judge, shape)
