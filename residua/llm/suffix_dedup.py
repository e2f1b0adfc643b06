"""Suffix-array dedup: bytes of passages that also start in a document with a smaller key are removed.

A passage is a string of ``length`` bytes.  Its suffixes cannot all be shuffled: that would be one entry per byte
of the corpus.  Every window of ``length`` bytes is therefore filed under the least hash of its k-byte grams
(its anchor).  Equal windows have the same anchor at the same distance, and neighbouring windows mostly share
theirs; the windows of one anchor form one short string, a fragment.

1. Each chunk of documents sends its distinct anchors.  Those in one document only are done.
2. For the others a chunk sends its distinct fragments, each with the least key that holds it, to the bucket of
   the anchor.  An anchor with many fragments, as at the borders of a passage that a third of all texts
   share, is split: its windows are dealt one by one by their own hash, and repeats collapse in the chunk.
3. A bucket collapses equal fragments.  Where an anchor has unlike ones, the suffixes that begin at the same
   distance from it are put in order by the hash-compared mergesort of ``suffix_sort``; neighbours that
   share ``length`` bytes are one class, and its least key says which windows have an earlier copy.
4. The chunk marks the bytes of those windows.

Fragments are collapsed by hash and then compared byte by byte with the one they collapsed into; hashes decide
nothing but where a string is sent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residua.llm import chunks
from residua.llm.pieces import gather
from residua.llm.suffix_sort import sorted_suffixes
from residua.llm.words import _BYTE_VALUES, _BYTES, _spans, give_back, hash_spans, mix, text_bytes

LENGTH = 50
MOST_WINDOWS = 32  # of one anchor: a reply has one bit for each
HOT = 256  # fragments of an anchor above which its windows are dealt one by one
SEGMENT = 1 << 18  # windows looked at at once
CHUNK_BYTES = 8 << 20
COMPARED = 1 << 13  # strings compared at once
SORTED_BYTES = 1 << 20  # of fragments whose suffixes are sorted at once
_U = np.uint64
_PLACE = 20  # low bits of a gram's rank that hold its place, so that the first of equal grams is taken
_LOW = _U((1 << 30) - 1)


@dataclass
class Anchors:
    """Runs of windows with the same anchor: starts of the first and the last window, place and hash of the anchor,
    and the number of the document."""

    first: np.ndarray
    last: np.ndarray
    place: np.ndarray
    gram: np.ndarray
    doc: np.ndarray


def gram_size(length: int) -> int:
    return max(length // 2, length - MOST_WINDOWS + 1, 1)


def _least(rank: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        rank = np.minimum(rank[:-have], rank[have:])
        have *= 2
    return np.minimum(rank[: len(rank) - (width - have)], rank[width - have :]) if have < width else rank


def anchors(data: np.ndarray, at: np.ndarray, length: int, usable: np.ndarray) -> Anchors:
    """Anchors of all windows of usable texts, which begin at ``at``; windows never cross texts."""
    k = gram_size(length)
    width = length - k + 1
    found = [np.empty((0, 4), np.int64)]
    grams = [np.empty(0, _U)]
    windows = len(data) - length + 1
    for lo in range(0, windows, SEGMENT):
        n = min(SEGMENT, windows - lo)
        starts = lo + np.arange(n)
        doc = np.searchsorted(at, starts, "right") - 1
        ok = (starts + length <= at[doc + 1]) & usable[doc]
        if not ok.any():
            continue
        i = np.arange(n + width - 1)
        h = _spans(_BYTE_VALUES[data[lo : lo + n + length - 1]], i, i + k, _BYTES)
        rank = (h >> _U(_PLACE) << _U(_PLACE)) | i.astype(_U)
        place = (_least(rank, width) & _U((1 << _PLACE) - 1)).astype(np.int64)
        starts, doc, place = starts[ok], doc[ok], place[ok]
        new = np.ones(len(starts), bool)
        new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
        edge = np.flatnonzero(new)
        last = np.append(edge[1:], len(starts)) - 1
        found.append(np.stack([starts[edge], starts[last], place[edge] + lo, doc[edge]], 1))
        grams.append(h[place[edge]])
    rows, gram = np.concatenate(found), np.concatenate(grams)
    if len(rows) > 1:  # a run cut at the border of a segment is one run
        joins = (rows[1:, 2] == rows[:-1, 2]) & (rows[1:, 3] == rows[:-1, 3])
        head = np.flatnonzero(np.concatenate([[True], ~joins]))
        tail = np.append(head[1:], len(rows)) - 1
        rows, gram = np.stack([rows[head, 0], rows[tail, 1], rows[head, 2], rows[head, 3]], 1), gram[head]
    return Anchors(rows[:, 0], rows[:, 1], rows[:, 2], gram, rows[:, 3])


def _same_bytes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, as_starts: np.ndarray) -> np.ndarray:
    """Whether each string equals the one of the same size at ``as_starts``."""
    out = np.ones(len(starts), bool)
    for lo in range(0, len(starts), COMPARED):
        s, n, o = starts[lo : lo + COMPARED], sizes[lo : lo + COMPARED], as_starts[lo : lo + COMPARED]
        wrong = np.concatenate([[0], np.cumsum(data[gather(s, n)] != data[gather(o, n)])])
        edge = np.cumsum(n)
        out[lo : lo + COMPARED] = wrong[edge] == wrong[edge - n]
    return out


def collapsed(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, key: np.ndarray, digest: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Number of the class of equal strings with equal keys of each string, and the first of each class.  Equal
    hashes are checked on the bytes."""
    if digest is None:
        digest = hash_spans(data, starts, starts + sizes)
    digest = mix(digest + mix(key.astype(_U) + sizes.astype(_U)))
    _, first, at = np.unique(digest, return_index=True, return_inverse=True)
    same = (sizes[first][at] == sizes) & (key[first][at] == key)
    if same.all():
        same = _same_bytes(data, starts, sizes, starts[first][at])
    if same.all():
        return at, first
    seen: dict[tuple, int] = {}
    at = np.array([seen.setdefault((int(k), data[s : s + n].tobytes()), len(seen)) for k, s, n in zip(key, starts, sizes, strict=True)], np.int64)
    return at, np.unique(at, return_index=True)[1]


class _Chunk:
    """Bytes and anchors of the documents of a chunk."""

    def __init__(self, table: pa.Table, text: str, key: str, length: int) -> None:
        self.data, self.at = text_bytes(table.column(text))
        keys = table.column(key)
        usable = ~keys.is_null().to_numpy(zero_copy_only=False) if keys.null_count else np.ones(len(keys), bool)
        self.keys = keys.fill_null(0).to_numpy().astype(np.int64)
        self.length = length
        self.anchors = anchors(self.data, self.at, length, usable)
        a = self.anchors
        self.key_of = self.keys[a.doc]
        self.grams, self.gram_at = np.unique(a.gram, return_inverse=True)

    def probes(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors in order; for each whether several documents hold it, and its distinct fragments."""
        a, n = self.anchors, len(self.grams)
        least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(least, self.gram_at, self.key_of)
        np.maximum.at(most, self.gram_at, self.key_of)
        _, first = np.unique(hash_spans(self.data, a.first, a.last + self.length), return_index=True)
        fragments = np.bincount(self.gram_at[first], minlength=n)
        return least != most, np.minimum(fragments, 65535).astype(np.uint16)

    def fragments(self, shared: np.ndarray, hot: np.ndarray):
        """What the chunk sends for its shared anchors: one entry per distinct fragment, or per distinct window of
        a hot anchor; in order of the 64-bit number they are dealt by."""
        a = self.anchors
        cool, warm = np.flatnonzero((shared & ~hot)[self.gram_at]), np.flatnonzero(hot[self.gram_at])
        n = (a.last - a.first + 1)[warm]
        self.windows = gather(a.first[warm], n)  # of hot anchors
        self.window_key = np.repeat(self.key_of[warm], n)
        starts = np.concatenate([a.first[cool], self.windows])
        sizes = np.concatenate([(a.last - a.first)[cool] + self.length, np.full(len(self.windows), self.length)])
        digest = np.concatenate([hash_spans(self.data, starts[: len(cool)], starts[: len(cool)] + sizes[: len(cool)]), hash_spans(self.data, self.windows, self.windows + self.length)])
        deal = np.concatenate([a.gram[cool], mix(digest[len(cool) :] + _U(0x51ED270B))])
        distance = np.concatenate([(a.place - a.first)[cool], np.zeros(len(self.windows), np.int64)])
        owner = np.concatenate([self.key_of[cool], self.window_key])
        cls, first = collapsed(self.data, starts, sizes, deal ^ distance.astype(_U), digest)
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, cls, owner)
        order = np.lexsort((sizes[first], deal[first]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        first = first[order]
        self.cool, self.entry, self.owner = cool, rank[cls], owner
        self.least = least[order]
        self.deal, self.starts, self.sizes, self.distance = deal[first], starts[first], sizes[first], distance[first]

    def packed(self, lo: int, hi: int) -> bytes:
        s, n = self.starts[lo:hi], self.sizes[lo:hi]
        raw = b"".join([self.deal[lo:hi].tobytes(), self.least[lo:hi].tobytes(), n.astype(np.uint16).tobytes(), self.distance[lo:hi].astype(np.uint16).tobytes(), self.data[gather(s, n)].tobytes()])
        return np.array([hi - lo, len(raw)], np.int64).tobytes() + pa.compress(raw, "zstd", asbytes=True)

    def removed(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of bytes to remove (start, end, number of the document), given for each entry the windows that
        an earlier document than its least holds."""
        a = self.anchors
        full = _U((1 << MOST_WINDOWS) - 1)
        bits = np.where(self.owner > self.least[self.entry], full, mask[self.entry].astype(_U))
        cool, rest = bits[: len(self.cool)], bits[len(self.cool) :]
        at = self.cool[cool == full]
        some = np.flatnonzero((cool != full) & (cool > 0))
        n = (a.last - a.first + 1)[self.cool[some]]
        offset = gather(np.zeros(len(n), np.int64), n)
        hit = (np.repeat(cool[some], n) >> offset.astype(_U)) & _U(1) > 0
        single = np.concatenate([(np.repeat(a.first[self.cool[some]], n) + offset)[hit], self.windows[rest & _U(1) > 0]])
        start = np.concatenate([a.first[at], single])
        end = np.concatenate([a.last[at], single]) + self.length
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
        doc = np.searchsorted(self.at, start, "right") - 1
        if not len(start):
            return start, end, doc
        reach = np.maximum.accumulate(end)
        opens = np.concatenate([[True], (start[1:] > reach[:-1]) | (doc[1:] != doc[:-1])])
        head = np.flatnonzero(opens)
        return start[head], reach[np.append(head[1:], len(start)) - 1], doc[head]


def _answer_probe(hot: int):
    def answer(chunk, bucket, packed) -> list[bytes]:
        """Bits for each anchor: whether several documents hold it, and whether it has more than ``hot`` fragments."""
        sizes = np.array([len(p) // 6 for p in packed])
        e = np.concatenate([np.frombuffer(p, np.uint32, n) for p, n in zip(packed, sizes, strict=True)])
        many = np.concatenate([np.frombuffer(p, np.uint16, n, 4 * n) for p, n in zip(packed, sizes, strict=True)])
        key = (np.repeat(bucket.astype(_U), sizes) << _U(30)) | (e >> np.uint32(2)).astype(_U)
        _, at = np.unique(key, return_inverse=True)
        times = np.bincount(at) + np.bincount(at, weights=e & np.uint32(1))
        total = np.bincount(at, weights=many)
        flags = ((times > 1).astype(np.uint8) | ((total > hot).astype(np.uint8) << 1))[at]
        return [f.tobytes() for f in np.split(flags, np.cumsum(sizes)[:-1])]

    return answer


def _windows_held_before(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, distance: np.ndarray, group: np.ndarray, key: np.ndarray, length: int) -> np.ndarray:
    """For unlike fragments of anchors (``group``), the windows (bits) that one with a smaller key holds too: suffixes
    that begin at the same distance from the anchor are sorted, equal neighbours are one class."""
    mask = np.zeros(len(starts), _U)
    n = sizes - length + 1
    offset = gather(np.zeros(len(n), np.int64), n)
    of = np.repeat(np.arange(len(n)), n)
    ahead = distance[of] - offset  # from the window to the anchor
    of_group = np.unique(mix(group.astype(_U))[of] + ahead.astype(_U), return_inverse=True)[1]
    crowd = np.bincount(of_group)[of_group] > 1
    offset, of, of_group = offset[crowd], of[crowd], of_group[crowd]
    if not len(of):
        return mask
    own = data[gather(starts, sizes)]
    begin = np.cumsum(sizes) - sizes
    order, same = sorted_suffixes(own, begin[of] + offset, of_group, length)
    run = np.cumsum(~same) - 1
    low = np.full(run[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, run, key[of[order]])
    hit = order[low[run] < key[of[order]]]
    np.bitwise_or.at(mask, of[hit], _U(1) << offset[hit].astype(_U))
    return mask


def _answer_fragments(length: int):
    def answer(chunk, bucket, packed) -> list[bytes]:
        """For each entry the windows (bits) that some document before its own least key holds."""
        heads = np.array([np.frombuffer(p, np.int64, 2) for p in packed])
        counts = heads[:, 0]
        parts: list[list[np.ndarray]] = [[], [], [], [], []]
        for p, (n, size) in zip(packed, heads.tolist(), strict=True):
            p, offset = pa.decompress(memoryview(p)[16:], size, "zstd", asbytes=True), 0
            for k, kind in enumerate((np.uint64, np.int64, np.uint16, np.uint16)):
                parts[k].append(np.frombuffer(p, kind, n, offset))
                offset += n * np.dtype(kind).itemsize
            parts[4].append(np.frombuffer(p, np.uint8, -1, offset))
        deal, least, sizes, distance, data = (np.concatenate(x) for x in parts)
        parts.clear()
        sizes, distance = sizes.astype(np.int64), distance.astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        key = deal ^ distance.astype(_U)
        cls, first = collapsed(data, starts, sizes, key)
        earliest = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(earliest, cls, least)
        mask = np.zeros(len(first), _U)
        _, group, times = np.unique(deal[first], return_inverse=True, return_counts=True)
        unlike = np.flatnonzero(times[group] > 1)
        unlike = unlike[np.argsort(group[unlike], kind="stable")]
        grown = np.cumsum(sizes[first[unlike]])
        new = np.flatnonzero(np.concatenate([[True], group[unlike][1:] != group[unlike][:-1]])) if len(unlike) else unlike
        edges = [0]
        for e in [*new[1:].tolist(), len(unlike)] if len(unlike) else []:  # whole groups, about SORTED_BYTES at once
            if e == len(unlike) or grown[e - 1] - (grown[edges[-1] - 1] if edges[-1] else 0) > SORTED_BYTES:
                edges.append(e)
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            one = unlike[lo:hi]
            mask[one] = _windows_held_before(data, starts[first[one]], sizes[first[one]], distance[first[one]], group[one], earliest[one], length)
        full = _U((1 << MOST_WINDOWS) - 1)
        reply = np.where(least > earliest[cls], full, mask[cls]).astype(np.uint32)
        give_back()
        return [r.tobytes() for r in np.split(reply, np.cumsum(counts)[:-1])]

    return answer


def remove_earlier_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """Texts without the bytes of any ``length``-byte string that also starts in a document with a smaller key.

    Adds ``n_bytes``, ``n_removed``, ``n_spans`` (maximal runs of removed bytes; long) and ``kept`` (binary: the bytes
    left; a character may be cut) to the rows, replacing columns of these names; others pass.  Windows are judged on
    the input and may overlap, they never cross texts, and repeats inside one text or between rows of equal keys
    remove nothing.  ``key`` is an integer; a row with a null key is before and after no other, so it keeps all
    its bytes and removes none.  A null text has no bytes and ``kept`` null; texts shorter than ``length`` keep all.
    A text is read whole in one task.  No rows in, none out.  ``hot``: fragments of an anchor above which its windows
    are dealt one by one, with the same result.
    """
    if not 1 <= length <= 60_000:
        raise ValueError("length must be from 1 to 60000 bytes")
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise ValueError(f"{key} must be an integer column")
    base = docs.drop("n_bytes", "n_removed", "n_spans", "kept")
    buckets = max(chunks.parts_for(base, text), 1)
    total = base.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    buckets = max(buckets, -(-total // CHUNK_BYTES))
    x = chunks.chunked(base, key, buckets, text)
    name = chunks.CHUNK

    def questions(chunk: int, keys: np.ndarray, pack) -> pa.Table:
        edges = chunks.bucket_edges(keys, buckets)
        used = np.flatnonzero(np.diff(edges))
        rows = [pack(edges[b], edges[b + 1]) for b in used]
        return pa.Table.from_arrays([pa.array(np.full(len(used), chunk), pa.int32()), pa.array(used, pa.int32()), pa.array(rows, pa.binary())], schema=chunks.arrow_schema(chunks.ASKED))

    def probe(table: pa.Table) -> pa.Table:
        c = _Chunk(table, text, key, length)
        several, many = c.probes()
        e = (((c.grams & _LOW) << _U(2)) | several.astype(_U)).astype(np.uint32)
        out = questions(table.column(name)[0].as_py(), c.grams, lambda lo, hi: e[lo:hi].tobytes() + many[lo:hi].tobytes())
        give_back()
        return out

    def replies_of(right: pa.Table, kind: int) -> list[tuple[int, bytes]]:
        rows = zip(right.column("__bucket").to_pylist(), right.column("__kind").to_pylist(), right.column("__packed").to_pylist(), strict=True)
        return [(b, p) for b, k, p in rows if k == kind]

    def with_fragments(left: pa.Table, right: pa.Table) -> _Chunk:
        c = _Chunk(left, text, key, length)
        flags = np.zeros(len(c.grams), np.uint8)
        edges = chunks.bucket_edges(c.grams, buckets)
        for b, p in replies_of(right, 0):
            flags[edges[b] : edges[b + 1]] = np.frombuffer(p, np.uint8)
        c.fragments(flags & 1 > 0, flags == 3)
        return c

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return chunks.arrow_schema(chunks.ASKED).empty_table()
        c = with_fragments(left, right)
        out = questions(left.column(name)[0].as_py(), c.deal, c.packed)
        give_back()
        return out

    shape = T.StructType([*base.schema.fields, *chunks.shape("n_bytes long, n_removed long, n_spans long, kept binary").fields])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = chunks.arrow_schema(shape)
        if not left.num_rows:
            return schema.empty_table()
        c = with_fragments(left, right)
        mask = np.zeros(len(c.deal), np.uint32)
        edges = chunks.bucket_edges(c.deal, buckets)
        for b, p in replies_of(right, 1):
            mask[edges[b] : edges[b + 1]] = np.frombuffer(p, np.uint32)
        start, end, doc = c.removed(mask)
        n = left.num_rows
        lost = np.bincount(doc, weights=end - start, minlength=n).astype(np.int64)
        step = np.zeros(len(c.data) + 1, np.int8)
        np.add.at(step, start, 1)
        np.add.at(step, end, -1)
        left_over = c.data[np.cumsum(step[:-1], dtype=np.int8) == 0].tobytes()
        kept = np.concatenate([[0], np.cumsum(np.diff(c.at) - lost)])
        missing = left.column(text).is_null().to_pylist()
        texts = [None if null else left_over[a:b] for a, b, null in zip(kept[:-1].tolist(), kept[1:].tolist(), missing, strict=True)]
        new = {
            "n_bytes": pa.array(np.diff(c.at)), "n_removed": pa.array(lost), "n_spans": pa.array(np.bincount(doc, minlength=n)), "kept": pa.array(texts, pa.binary()),
        }
        out = pa.Table.from_arrays([(new[f.name] if f.name in new else left.column(f.name)).cast(f.type) for f in schema], schema=schema)
        give_back()
        return out

    grouped = x.groupBy(name)
    first = chunks.deal(grouped.applyInArrow(probe, chunks.ASKED), _answer_probe(hot), buckets).withColumn("__kind", F.lit(0))
    sent = grouped.cogroup(first.groupBy(name)).applyInArrow(send, chunks.ASKED)
    second = chunks.deal(sent, _answer_fragments(length), buckets).withColumn("__kind", F.lit(1))
    return grouped.cogroup(first.unionByName(second).groupBy(name)).applyInArrow(cut, shape)
