"""Substring dedup by fixed-block anchors.

Every text is cut into blocks of ``block`` words that do not overlap: the index.  Every rolling run of
``block`` words probes it.  As ``window >= 2 * block - 1``, any window that occurs twice holds a whole
block of its other copy, so its probe hits.  Windows around hits are then extended: they are compared by a
95-bit fingerprint of all their words with all other such windows, and runs of windows found
elsewhere are the maximal exact repeats.  Nothing is paired: both questions are answered per distinct key
of a chunk (see ``chunks``), so a passage in a third of all texts stays cheap.

The probe is only a filter (30 bits and the bucket); a false hit is dropped by the fingerprint.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residua.llm import chunks
from residua.llm.words import PLAIN, distinct, room, slices, split, windows

WINDOW, BLOCK = 35, 18
_LOW = np.uint64((1 << 30) - 1)


def _hashes(batches, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts and the offsets of the texts."""
    hashes, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for part in slices(batches, text):
        w = split(part.column(text), PLAIN)
        hashes.append(w.hashes)
        counts.append(w.counts)
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)


class _Probe:
    """Distinct rolling block hashes of a chunk, in sorted order."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray, window: int, block: int) -> None:
        counts = np.diff(first)
        left = room(first)
        long_enough = np.repeat(counts >= window, counts)
        self.at = np.flatnonzero(long_enough & (left >= block))
        rolled = windows(hashes, block)
        self.keys, self.place, times = distinct(rolled[self.at] if len(rolled) else np.empty(0, np.uint64))
        offset = self.at - np.repeat(first[:-1], counts)[self.at]
        indexed = np.zeros(len(self.keys), bool)
        indexed[self.place[offset % block == 0]] = True
        self.entries = (((self.keys & _LOW) << np.uint64(2)) | ((times > 1).astype(np.uint64) << np.uint64(1)) | indexed.astype(np.uint64)).astype(np.uint32)


class _Extend:
    """Distinct fingerprints of the windows of a chunk that hold a hit."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray, probe: _Probe, hit: np.ndarray, window: int, block: int) -> None:
        marked = np.zeros(len(hashes) + 1, np.int64)
        marked[probe.at[hit[probe.place]] + 1] = 1
        marked = np.cumsum(marked)
        starts = np.flatnonzero(room(first) >= window)
        self.at = starts[marked[starts + window - block + 1] > marked[starts]]
        a = windows(hashes, window)
        self.keys, self.place, times = distinct(a[self.at] if len(a) else np.empty(0, np.uint64))
        second = np.zeros(len(self.keys), np.uint32)
        if len(self.at):
            second[self.place] = (windows(hashes, window, 1)[self.at] >> np.uint64(33)).astype(np.uint32)
        self.entries = (second << np.uint32(1)) | (times > 1).astype(np.uint32)


def _flags(keys: np.ndarray, replies: list[tuple[int, bytes]], buckets: int) -> np.ndarray:
    out = np.zeros(len(keys), bool)
    edges = chunks.bucket_edges(keys, buckets)
    for b, packed in replies:
        lo, hi = edges[b], edges[b + 1]
        out[lo:hi] = chunks.unpack_bits(packed, hi - lo)
    return out


def _questions(chunk: int, keys: np.ndarray, pack, buckets: int) -> pa.Table:
    edges = chunks.bucket_edges(keys, buckets)
    used = np.flatnonzero(np.diff(edges))
    packed = [pack(edges[b], edges[b + 1]) for b in used]
    return pa.Table.from_arrays(
        [pa.array(np.full(len(used), chunk), pa.int32()), pa.array(used, pa.int32()), pa.array(packed, pa.binary())],
        schema=chunks.arrow_schema(chunks.ASKED),
    )


def _runs(values: np.ndarray) -> np.ndarray:
    """Number of the run of equal neighbours that each value belongs to."""
    return np.cumsum(np.concatenate([[False], values[1:] != values[:-1]]))


def _answer_probe(chunk, bucket, packed) -> list[bytes]:
    """Hit: an indexed block with this hash exists, and the hash occurs at least twice."""
    sizes = np.array([len(p) // 4 for p in packed])
    e = np.frombuffer(b"".join(packed), np.uint32)
    key = (np.repeat(bucket.astype(np.uint64), sizes) << np.uint64(30)) | (e >> np.uint32(2)).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    run = _runs(key[order])
    n = run[-1] + 1
    times = np.bincount(run, minlength=n) + np.bincount(run, weights=((e >> np.uint32(1)) & np.uint32(1))[order], minlength=n)
    hit = (times > 1) & (np.bincount(run, weights=(e & np.uint32(1))[order], minlength=n) > 0)
    flags = np.empty(len(e), bool)
    flags[order] = hit[run]
    return [chunks.pack_bits(f) for f in np.split(flags, np.cumsum(sizes)[:-1])]


def _answer_extend(chunk, bucket, packed) -> list[bytes]:
    """Repeated: the fingerprint occurs at least twice."""
    sizes = np.array([len(p) // 12 for p in packed])
    a = np.concatenate([np.frombuffer(p, np.uint64, n) for p, n in zip(packed, sizes, strict=True)])
    b = np.concatenate([np.frombuffer(p, np.uint32, n, 8 * n) for p, n in zip(packed, sizes, strict=True)])
    order = np.lexsort((b >> np.uint32(1), a))
    x, y = a[order], (b >> np.uint32(1))[order]
    run = np.cumsum(np.concatenate([[False], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
    times = np.bincount(run) + np.bincount(run, weights=(b & np.uint32(1))[order])
    flags = np.empty(len(a), bool)
    flags[order] = (times > 1)[run]
    return [chunks.pack_bits(f) for f in np.split(flags, np.cumsum(sizes)[:-1])]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Texts without the words of any ``window``-word sequence that also starts elsewhere.

    Adds ``n_words``, ``n_removed`` (long) and ``kept`` (words left, joined by one space) to the rows,
    replacing columns of these names.  Words are runs of bytes other than space and 0x09-0x0D, unchanged.
    Null text: no words, ``kept`` null; empty text: ``kept`` empty; texts of fewer than ``window`` words
    lose nothing.  Repeated rows are separate texts and so repeat each other; ``key`` may repeat or be
    null.  No rows in, none out.
    """
    if not 2 * block - 1 <= window:
        raise ValueError("a window must hold a whole block at any offset: window >= 2 * block - 1")
    base = docs.drop("n_words", "n_removed", "kept")
    buckets = chunks.parts_for(base, text)
    x = chunks.chunked(base, key, buckets, text)

    def probe(batches):
        mine: dict[int, list] = {}
        for part in slices(batches, text):
            w = split(part.column(text), PLAIN)
            owner = part.column(chunks.CHUNK).to_numpy()
            long_enough = np.where(w.counts >= window, owner, -1)
            for c in np.unique(long_enough[long_enough >= 0]):
                rows = np.flatnonzero(long_enough == c)
                mine.setdefault(int(c), []).append((np.concatenate([w.hashes[w.first[r] : w.first[r + 1]] for r in rows]), w.counts[rows]))
        for c in list(mine):
            held = mine.pop(c)
            first = np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in held]))]).astype(np.int64)
            p = _Probe(np.concatenate([h for h, _ in held]), first, window, block)
            yield from _questions(c, p.keys, lambda lo, hi, e=p.entries: e[lo:hi].tobytes(), buckets).to_batches()

    def replies_of(right: pa.Table, kind: int) -> list[tuple[int, bytes]]:
        rows = zip(right.column("__bucket").to_pylist(), right.column("__kind").to_pylist(), right.column("__packed").to_pylist(), strict=True)
        return [(b, p) for b, k, p in rows if k == kind]

    def extended(left: pa.Table, right: pa.Table):
        hashes, first = _hashes(left.to_batches(), text)
        p = _Probe(hashes, first, window, block)
        return hashes, first, _Extend(hashes, first, p, _flags(p.keys, replies_of(right, 0), buckets), window, block)

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return chunks.arrow_schema(chunks.ASKED).empty_table()
        _, _, e = extended(left, right)
        chunk = left.column(chunks.CHUNK)[0].as_py()
        return _questions(chunk, e.keys, lambda lo, hi: e.keys[lo:hi].tobytes() + e.entries[lo:hi].tobytes(), buckets)

    shape = T.StructType([*base.schema.fields, *chunks.shape("n_words long, n_removed long, kept string").fields])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = chunks.arrow_schema(shape)
        if not left.num_rows:
            return schema.empty_table()
        hashes, first, e = extended(left, right)
        repeated = _flags(e.keys, replies_of(right, 1), buckets)
        at = e.at[repeated[e.place]]
        step = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + window, -1)
        keep = np.cumsum(step)[:-1] == 0
        removed = np.concatenate([[0], np.cumsum(~keep)])
        lost = removed[first[1:]] - removed[first[:-1]]
        kept = []
        for j, t in enumerate(left.column(text)):
            t = t.as_py()
            if t is None:
                kept.append(None)
                continue
            words = t.encode().split()
            kept.append((b" ".join(compress(words, keep[first[j] : first[j + 1]]) if lost[j] else words)).decode())
        new = {"n_words": pa.array(np.diff(first), pa.int64()), "n_removed": pa.array(lost, pa.int64()), "kept": pa.array(kept, pa.string())}
        return pa.Table.from_arrays([(new[f.name] if f.name in new else left.column(f.name)).cast(f.type) for f in schema], schema=schema)

    def replies(asked: DataFrame, answer, kind: int) -> DataFrame:
        return chunks.deal(asked, answer, buckets).withColumn("__kind", F.lit(kind))

    first_replies = replies(x.mapInArrow(probe, chunks.ASKED), _answer_probe, 0)
    grouped = x.groupBy(chunks.CHUNK)
    asked = grouped.cogroup(first_replies.groupBy(chunks.CHUNK)).applyInArrow(extend, chunks.ASKED)
    both = first_replies.unionByName(replies(asked, _answer_extend, 1))
    return grouped.cogroup(both.groupBy(chunks.CHUNK)).applyInArrow(cut, shape)
