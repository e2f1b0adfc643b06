"""Words of a batch of texts as arrays: byte spans and 64-bit hashes, without one object per word.

Hashes are polynomials over mixed bytes (or word hashes) modulo 2^64.  With prefix sums and an odd
base, which has an inverse, the hash of any span costs one subtraction and one product, so rolling
windows of any length are one array expression.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20  # text handled at once inside a task
SEGMENT = 1 << 18  # bytes hashed at once

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            ones = np.ones(size, _U)
            ones[1:] = self.base
            self.up = np.cumprod(ones)
            ones[1:] = self.inverse
            self.down = np.cumprod(ones)
        return self.up[:n], self.down[:n]


_BYTES = _Powers(0x9E3779B97F4A7C15)
_WORDS = (_Powers(0xD6E8FEB86659FD93), _Powers(0xA0761D6478BD642F))
_BYTE_VALUES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    up, down = powers.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def windows(hashes: np.ndarray, size: int, family: int = 0) -> np.ndarray:
    """Hash of every run of ``size`` consecutive word hashes; ``family`` picks one of two hashes."""
    n = max(len(hashes) - size + 1, 0)
    out = np.empty(n, _U)
    for lo in range(0, n, SEGMENT >> 2):
        hi = min(lo + (SEGMENT >> 2), n)
        i = np.arange(hi - lo)
        out[lo:hi] = _spans(mix(hashes[lo : hi + size - 1] ^ _U(family)), i, i + size, _WORDS[family])
    return out


@dataclass(frozen=True)
class Alphabet:
    """Which bytes belong to words, and what each byte counts as."""

    inside: np.ndarray
    fold: np.ndarray


def alphabet(inside: Iterable[int], lower: bool = False) -> Alphabet:
    member = np.zeros(256, bool)
    member[list(inside)] = True
    fold = np.arange(256, dtype=np.uint8)
    if lower:
        fold[65:91] += 32
    return Alphabet(member, fold)


_BLANKS = {0x20, *range(0x09, 0x0E)}
PLAIN = alphabet(set(range(256)) - _BLANKS)
LOWER = alphabet(set(range(256)) - _BLANKS, lower=True)
ALNUM_LOWER = alphabet({*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}, lower=True)


@dataclass
class Words:
    """``first[j]`` to ``first[j+1]`` are the words of text j; bytes are those of the joined texts."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def string(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The joined UTF-8 bytes and the offsets of the texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at.astype(np.int64) - int(at[0])


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans that follow each other."""
    out = np.empty(len(starts), _U)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + SEGMENT)))
        a, b = int(starts[lo]), int(ends[hi - 1])
        out[lo:hi] = _spans(_BYTE_VALUES[data[a:b]], starts[lo:hi] - a, ends[lo:hi] - a, _BYTES)
        lo = hi
    return out


def split(texts: pa.Array, letters: Alphabet) -> Words:
    """All words of whole texts, hashed."""
    data, at = text_bytes(texts)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = letters.inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    folded = letters.fold[data] if letters.fold[65] != 65 else data
    return Words(folded, starts, ends, np.searchsorted(starts, at), hash_spans(folded, starts, ends))


def room(first: np.ndarray) -> np.ndarray:
    """For every word, how many words from it to the end of its text."""
    counts = np.diff(first)
    return np.repeat(first[1:], counts) - np.arange(first[-1])


def give_back() -> None:
    """Return memory that arrays of past batches held to the system: workers live longer than tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches that hold about ``limit`` bytes of text at most, one text at least."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < b.num_rows:
            before = int(size[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(size, before + limit, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi
        give_back()


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, for each input its place among them, and how often each occurs."""
    if not len(values):
        return values, np.empty(0, np.int64), np.empty(0, np.int64)
    return np.unique(values, return_inverse=True, return_counts=True)


def with_columns(batch: pa.RecordBatch | pa.Table, schema: pa.Schema, **new) -> pa.RecordBatch | pa.Table:
    """The columns of ``schema`` from ``new`` or else from the batch."""
    cols = [
        (v if isinstance(v, pa.Array | pa.ChunkedArray) and v.type == f.type else pa.array(v, f.type)) if (v := new.get(f.name)) is not None
        else batch.column(f.name)
        for f in schema
    ]
    kind = pa.Table if isinstance(batch, pa.Table) else pa.RecordBatch
    return kind.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(cols, schema, strict=True)], schema=schema)
