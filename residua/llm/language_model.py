"""Bigram language model on a log-frequency Bloom filter.

Counts of all bigrams of the training texts are summed exactly, quantised to powers of two, and stored
as membership: a bigram seen c times is inserted once per level 0 .. floor(log2 c).  A score finds the
level by probing upwards until a probe fails, so the filter holds no keys and no numbers.  The quantised
count never exceeds the true one, except for false positives (rate about 0.8 % a probe).

    P(w | v) = lam * min(c~(v, w), c(v)) / c(v) + (1 - lam) * P1(w),   P1(w) = (c(w) + 1) / (N + V + 1)

with P1 alone where v was not seen, and 1 - lam the share of bigram tokens seen once (Good-Turing).

The filter and the word counts are built in shards by hash range, so building has no central step.  They
are broadcast while they hold ``broadcast_bytes`` at most; above that every chunk of documents sends
its distinct keys to the shards and gets levels and counts back, with the same scores.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residua.llm import chunks
from residua.llm.words import LOWER, distinct, mix, slices, split
from residua.session import ensure_checkpoint_dir

BROADCAST_BYTES = 256 << 20
FLUSH = 2_000_000  # distinct keys a counting task holds before it sends them
BITS_PER_ENTRY, PROBES = 10, 7
END = np.uint64(0x5851F42D4C957F2D)
_KIND_WORD, _KIND_PAIR = 0, 1
_SHARD = chunks.shape("kind int, bucket int, packed binary, tokens long, types long, once long")
_ADDED = chunks.shape("n_tokens long, n_known long, base_score double, score double")


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts, each closed by the end token; the token before each; text starts."""
    w = split(texts, LOWER)
    n = len(w.first) - 1
    ends = w.first[1:] + np.arange(n)
    word = np.ones(len(w.hashes) + n, bool)
    word[ends] = False
    tok = np.full(len(word), END)
    tok[word] = w.hashes
    before = np.empty_like(tok)
    before[:1] = END
    before[1:] = tok[:-1]
    return tok, before, w.first[:-1] + np.arange(n)


def pair_keys(before: np.ndarray, tok: np.ndarray) -> np.ndarray:
    return mix(mix(before) + tok * np.uint64(0xC2B2AE3D27D4EB4F))


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return k[start], np.add.reduceat(c, start) if len(k) else c


def _probe_places(keys: np.ndarray, level: int, bits: int) -> Iterator[np.ndarray]:
    a = mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    b = mix(a) | np.uint64(1)
    for i in range(PROBES):
        yield ((a + np.uint64(i) * b) >> np.uint64(11)) % np.uint64(bits)


def build_filter(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """One shard: a bit count and the bits."""
    level = np.frexp(counts.astype(float))[1] - 1
    bits = max(64, -(-int((level + 1).sum()) * BITS_PER_ENTRY // 8) * 8)
    flags = np.zeros(bits, bool)
    for j in range(int(level.max(initial=-1)) + 1):
        for at in _probe_places(keys[level >= j], j, bits):
            flags[at] = True
    return np.packbits(flags).tobytes()


def filter_levels(packed: bytes | np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Levels found by probing, 0 for an unseen key and j + 1 for a count of 2^j."""
    data = np.frombuffer(packed, np.uint8)
    bits = 8 * len(data)
    out = np.zeros(len(keys), np.uint8)
    alive = np.arange(len(keys))
    for j in range(64):
        ok = np.ones(len(alive), bool)
        for at in _probe_places(keys[alive], j, bits):
            rest = np.flatnonzero(ok)
            where = at[rest]
            ok[rest] = (data[where >> np.uint64(3)] >> (np.uint64(7) - (where & np.uint64(7))).astype(np.uint8)) & np.uint8(1) == 1
        alive = alive[ok]
        if not len(alive):
            break
        out[alive] = j + 1
    return out


@dataclass
class Model:
    """Shards as a table, and the totals."""

    shards: DataFrame
    tokens: int
    types: int
    unseen: float  # 1 - lam
    bytes: int
    buckets: int


def _count(train: DataFrame, text: str, kind: int, buckets: int) -> DataFrame:
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []

        def flush():
            k, c = _merge(keys, counts)
            keys.clear(), counts.clear()
            edges = chunks.bucket_edges(k, buckets)
            used = np.flatnonzero(np.diff(edges))
            packed = [k[edges[b] : edges[b + 1]].tobytes() + c[edges[b] : edges[b + 1]].astype(np.uint32).tobytes() for b in used]
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(used)), pa.int32()), pa.array(used, pa.int32()), pa.array(packed, pa.binary())], schema=chunks.arrow_schema(chunks.ASKED))

        for part in slices(batches, text):
            tok, before, _ = tokens(part.column(text))
            k, _, c = distinct(tok if kind == _KIND_WORD else pair_keys(before, tok))
            keys.append(k), counts.append(c)
            if sum(map(len, keys)) > FLUSH:
                yield flush()
        if keys:
            yield flush()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[int, list] = {}
        counts: dict[int, list] = {}
        for b in batches:
            for bucket, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                n = len(p) // 12
                keys.setdefault(bucket, []).append(np.frombuffer(p, np.uint64, n))
                counts.setdefault(bucket, []).append(np.frombuffer(p, np.uint32, n, 8 * n).astype(np.int64))
        for bucket in keys:
            k, c = _merge(keys[bucket], counts[bucket])
            packed = pack_words(k, c) if kind == _KIND_WORD else build_filter(k, c)
            row = [[kind], [bucket], [packed], [int(c.sum())], [len(k)], [int((c == 1).sum())]]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, chunks.arrow_schema(_SHARD), strict=True)], schema=chunks.arrow_schema(_SHARD))

    return train.select(text).mapInArrow(partial, chunks.ASKED).repartitionById(buckets, F.col("__bucket")).mapInArrow(total, _SHARD)


def fit(train: DataFrame, text: str = "text") -> Model:
    """Count all tokens and bigrams of whole texts.  Null texts are empty; without rows the model knows
    nothing and scores by P1 alone."""
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/language-model-{uuid.uuid4().hex}"
    buckets = chunks.parts_for(train, text)
    _count(train, text, _KIND_WORD, buckets).unionByName(_count(train, text, _KIND_PAIR, buckets)).write.parquet(path)
    shards = spark.read.parquet(path)
    sums = {
        r["kind"]: r
        for r in shards.groupBy("kind").agg(F.sum("tokens").alias("n"), F.sum("types").alias("v"), F.sum("once").alias("once"), F.sum(F.length("packed")).alias("size")).collect()
    }
    if not sums:
        return Model(shards, 0, 0, 1.0, 0, buckets)
    return Model(shards, sums[0]["n"], sums[0]["v"], max(sums[1]["once"] / sums[1]["n"], 1e-6), sums[0]["size"] + sums[1]["size"], buckets)


def pack_words(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Keys and counts; the first byte is the width of a count."""
    kind = np.uint32 if counts.max(initial=0) < 1 << 32 else np.uint64
    return bytes([kind().nbytes]) + keys.tobytes() + counts.astype(kind).tobytes()


def _words_of(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    wide = packed[0]
    n = (len(packed) - 1) // (8 + wide)
    return np.frombuffer(packed, np.uint64, n, 1), np.frombuffer(packed, np.uint32 if wide == 4 else np.uint64, n, 1 + 8 * n)


def _counts(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, counts[at], 0).astype(np.int64)


class _Broadcast:
    """All shards at hand."""

    def __init__(self, shards: list[tuple[int, int, Broadcast]], buckets: int) -> None:
        words = [_words_of(p.value) for k, _, p in sorted((r for r in shards if r[0] == _KIND_WORD), key=lambda r: r[1])]
        self.keys = np.concatenate([np.empty(0, np.uint64), *[k for k, _ in words]])
        self.counts = np.concatenate([c for _, c in words]) if words else np.empty(0, np.int64)
        self.filters = {b: np.frombuffer(p.value, np.uint8) for k, b, p in shards if k == _KIND_PAIR}
        self.buckets = buckets

    def count(self, wanted: np.ndarray) -> np.ndarray:
        return _counts(self.keys, self.counts, wanted)

    def level(self, keys: np.ndarray) -> np.ndarray:
        """``keys`` are sorted."""
        out = np.zeros(len(keys), np.uint8)
        edges = chunks.bucket_edges(keys, self.buckets)
        for b in np.flatnonzero(np.diff(edges)):
            if b in self.filters:
                out[edges[b] : edges[b + 1]] = filter_levels(self.filters[b], keys[edges[b] : edges[b + 1]])
        return out


def _score(texts: pa.Array, count: Callable, level: Callable, model: tuple[int, int, float]) -> dict:
    total, types, unseen = model
    tok, before, start = tokens(texts)
    known, place, _ = distinct(tok)
    c = count(known)[place]
    of_before = np.empty_like(c)
    of_before[:1] = count(np.array([END]))
    of_before[1:] = c[:-1]
    keys, place, _ = distinct(pair_keys(before, tok))
    found = level(keys)[place]
    one = (c + 1) / (total + types + 1)
    seen = np.minimum(np.where(found > 0, np.exp2(found.astype(float) - 1), 0.0), of_before)
    p = np.where(of_before > 0, (1 - unseen) * seen / np.maximum(of_before, 1) + unseen * one, one)
    add = lambda x: np.add.reduceat(x, start) if len(start) else np.empty(0)  # noqa: E731  a text has its end token at least
    return {"n_tokens": add(np.ones(len(tok), np.int64)), "n_known": add((c > 0).astype(np.int64)), "base_score": add(np.log10(one)), "score": add(np.log10(p))}


def score(docs: DataFrame, model: Model, text: str = "text", broadcast_bytes: int = BROADCAST_BYTES, key: str = "doc_id") -> DataFrame:
    """Adds ``n_tokens``, ``n_known`` (long), ``base_score`` and ``score`` (log10 probabilities of the text
    with its end token) to every row, replacing columns of these names.  Null text counts as empty: one
    token, the end.  Repeated rows are scored alike; ``key`` only spreads the rows."""
    spark = docs.sparkSession
    base = docs.drop(*_ADDED.names)
    shape = T.StructType([*base.schema.fields, *_ADDED.fields])
    numbers = (model.tokens, model.types, model.unseen)
    buckets = model.buckets

    def filled(part, new: dict):
        schema = chunks.arrow_schema(shape)
        return [pa.array(new[f.name], f.type) if f.name in new else part.column(f.name).cast(f.type) for f in schema], schema

    if model.bytes <= broadcast_bytes:
        # one shard at a time passes through the driver
        shards = [(r["kind"], r["bucket"], spark.sparkContext.broadcast(bytes(r["packed"]))) for r in model.shards.select("kind", "bucket", "packed").toLocalIterator()]

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = _Broadcast(shards, buckets)
            for part in slices(batches, text, 1 << 20):
                cols, schema = filled(part, _score(part.column(text), m.count, m.level, numbers))
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

        return base.mapInArrow(judge, shape)

    x = chunks.chunked(base, key, chunks.parts_for(base, text), text)
    question = chunks.shape("__chunk int, __bucket int, kind int, packed binary")

    def chunk_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        words, pairs = [np.array([END])], [np.empty(0, np.uint64)]
        for part in slices(table.to_batches(), text):
            tok, before, _ = tokens(part.column(text))
            words.append(np.unique(tok)), pairs.append(np.unique(pair_keys(before, tok)))
        return np.unique(np.concatenate(words)), np.unique(np.concatenate(pairs))

    def ask(table: pa.Table) -> pa.Table:
        c, out = table.column(chunks.CHUNK)[0].as_py(), []
        for kind, keys in enumerate(chunk_keys(table)):
            edges = chunks.bucket_edges(keys, buckets)
            out += [(c, int(b), kind, keys[edges[b] : edges[b + 1]].tobytes()) for b in np.flatnonzero(np.diff(edges))]
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), chunks.arrow_schema(question), strict=True)], schema=chunks.arrow_schema(question))

    def answer(asked: pa.Table, shard: pa.Table) -> pa.Table:
        schema = chunks.arrow_schema(question)
        held = {k: p for k, p in zip(shard.column("kind").to_pylist(), shard.column("packed").to_pylist(), strict=True)}
        words = _words_of(held[_KIND_WORD]) if _KIND_WORD in held else (np.empty(0, np.uint64), np.empty(0, np.int64))
        out = []
        for kind, p in zip(asked.column("kind").to_pylist(), asked.column("packed").to_pylist(), strict=True):
            keys = np.frombuffer(p, np.uint64)
            if kind == _KIND_WORD:
                out.append(_counts(*words, keys).tobytes())
            else:
                out.append((filter_levels(held[_KIND_PAIR], keys) if _KIND_PAIR in held else np.zeros(len(keys), np.uint8)).tobytes())
        return pa.Table.from_arrays([*[asked.column(n).cast(schema.field(n).type) for n in ("__chunk", "__bucket", "kind")], pa.array(out, pa.binary())], schema=schema)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = chunks.arrow_schema(shape)
        if not left.num_rows:
            return schema.empty_table()
        got = sorted(zip(*[right.column(n).to_pylist() for n in ("kind", "__bucket", "packed")], strict=True))
        words, pairs = chunk_keys(left)
        counts = np.concatenate([np.frombuffer(p, np.int64) for k, _, p in got if k == _KIND_WORD])
        levels = np.concatenate([np.empty(0, np.uint8), *[np.frombuffer(p, np.uint8) for k, _, p in got if k == _KIND_PAIR]])
        parts = []
        for part in slices(left.to_batches(), text):
            cols, _ = filled(part, _score(part.column(text), lambda k: counts[np.searchsorted(words, k)], lambda k: levels[np.searchsorted(pairs, k)], numbers))
            parts.append(pa.RecordBatch.from_arrays(cols, schema=schema))
        return pa.Table.from_batches(parts, schema=schema)

    grouped = x.groupBy(chunks.CHUNK)
    asked = grouped.applyInArrow(ask, question)
    answers = asked.groupBy("__bucket").cogroup(model.shards.withColumnRenamed("bucket", "__bucket").groupBy("__bucket")).applyInArrow(answer, question)
    return grouped.cogroup(answers.groupBy(chunks.CHUNK)).applyInArrow(finish, shape)
