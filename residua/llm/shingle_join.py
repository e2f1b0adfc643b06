"""N-gram Jaccard join on group counts, bounded by summed coordinate minima.

The distinct k-word shingles of a text are hashed into groups; the counts per group are its point.  Two
texts share at most ``sum_g min(a_g, b_g)`` shingles, so points bound every overlap, and boxes of points
bound all pairs of two boxes.

One tree over all points would not scale: counts of unrelated long texts concentrate around the same
values, all boxes overlap and every point meets every other.  So the fine groups are cut into slabs, and a
slab is the root of a tree of its own.  Two linked texts differ in at most D shingles (D follows from
their sizes); with D + 1 slabs, at least one slab has the same counts in both.  Texts meet where a slab's
counts agree: an equi-join that loses no pair.  Texts of a size class and the next meet at one level.

1. Equal sets collapse to one class.  Every (slab, class) entry is dealt by slab; a task first links the
   classes that it holds for a slab to one of them and sends only that one, so a slab that a third of
   all classes share brings one entry per task.  These stars are candidate links.
2. Candidates that pass the point bound are verified on the shingle sets; links give components.
3. A slab whose star joins different components is open: all its members are compared, by a packed tree of
   points in tiles of bounded size, leaving out pairs inside a component.  Rows with a pair that passes meet by
   the components of "may be linked" with their sets, are verified in tiles, and each linked row leaves with one
   link.

Any linked pair shares a slab; it is inside a component after step 2 or tested in step 3.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residua.llm import chunks
from residua.llm.components import connected_components
from residua.llm.words import LOWER, mix, slices, split, windows
from residua.session import durable, release, sweep

SHINGLE, PERCENT = 4, 85
GROUPS, MOST_GROUPS = 256, 2048  # coordinates of a point
SIGMAS = 6
SLAB_GROUPS = 1024  # groups of a slab
FLUSH = 1_000_000  # entries a task gathers before it sends them
TILE, LEAF = 2048, 32
TILE_SHINGLES = 2_000_000  # of a tile's sets
BATCH_BYTES = 8 << 20  # of sets in a batch
PARTNERS = 256  # partners that a task gets with one text
MARGIN = 3
SLICE = 1 << 20  # bytes of text handled at once
BROADCAST_ROWS = 1_000_000
_U = np.uint64


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and where each text's begin."""
    w = split(texts, LOWER)
    n, counts = len(w.first) - 1, w.counts
    owner = np.repeat(np.arange(n), counts)
    left = w.first[1:][owner] - np.arange(len(owner))
    whole = left >= size
    hashes = [windows(w.hashes, size)[np.flatnonzero(whole)]] if whole.any() else [np.empty(0, _U)]
    owners = [owner[whole]]
    for k in range(1, size):
        short = w.first[:-1][counts == k]
        if len(short):
            hashes.append(windows(w.hashes, k)[short])
            owners.append(np.flatnonzero(counts == k))
    h, o = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[new], np.searchsorted(o[new], np.arange(n + 1))


def size_classes(percent: int, upto: int) -> np.ndarray:
    """Least sizes of the classes: a linked partner is in the same or a neighbouring class."""
    least = [1]
    while least[-1] <= upto:
        least.append(least[-1] * 100 // percent + 1)
    return np.array(least)


def slabs_at(levels: np.ndarray, least: np.ndarray, percent: int) -> np.ndarray:
    """One more than the most shingles in which linked texts of a level differ."""
    most = np.append(least[1:] - 1, least[-1] * 100 // percent)
    return 2 * most[levels] * (100 - percent) // (100 + percent) + 1


def _sum_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def class_hash(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set, independent of order."""
    return mix(_sum_by(mix(h ^ _U(0x1234567)), first)), mix(_sum_by(mix(h ^ _U(0x89ABCDEF)), first))


def slab_keys(h: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, text number) of every slab of every text, at the level of its class and the next."""
    n = np.diff(first)
    least = size_classes(percent, int(n.max(initial=1)))
    kind = np.searchsorted(least, n, "right") - 1
    texts = np.flatnonzero(n > 0)
    owner = np.repeat(np.arange(len(n)), n)
    keys, of = [], []
    group = h & _U(SLAB_GROUPS - 1)
    for step in (0, 1):
        level = kind[texts] + step
        slabs = slabs_at(level, size_classes(percent, int(n.max(initial=1)) * 4), percent)
        begin = np.zeros(len(n) + 1, np.int64)
        begin[texts + 1] = slabs
        begin = np.cumsum(begin)
        many = np.ones(len(n), np.int64)
        many[texts] = slabs
        slab = (h >> _U(20)) % many[owner].astype(_U)
        sums = np.zeros(begin[-1], _U)
        np.add.at(sums, begin[owner] + slab.astype(np.int64), mix(group + _U(1)))
        text = np.repeat(texts, slabs)
        number = np.arange(begin[-1]) - begin[text]
        at = np.repeat(level, slabs).astype(_U) << _U(32) | number.astype(_U)
        keys.append(mix(mix(at + _U(0x51ED270B)) + sums))
        of.append(text)
    return np.concatenate(keys), np.concatenate(of)


def groups_for(n: np.ndarray) -> np.ndarray:
    """Groups of a text with n shingles, ``GROUPS`` or about n / 16: then unrelated texts of any length differ by more than
    linked ones may.  Always a power of two, so that points fold onto fewer groups."""
    wide = 2 ** np.ceil(np.log2(np.maximum(n, 16) / 16)).astype(np.int64)
    return np.where(n < 16 * GROUPS, GROUPS, np.minimum(wide, MOST_GROUPS))


def points(h: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Counts per group, by the leading bits of the hash; counts above 255 are cut, and ``may_link`` allows
    for what was cut."""
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    few = np.bincount(owner * GROUPS + (h >> _U(64 - GROUPS.bit_length() + 1)).astype(np.int64), minlength=len(n) * GROUPS).reshape(-1, GROUPS)
    out = list(np.minimum(few, 255).astype(np.uint8))
    wide = groups_for(n)
    for i in np.flatnonzero(wide > GROUPS):
        place = (h[first[i] : first[i + 1]] >> _U(64 - int(wide[i]).bit_length() + 1)).astype(np.int64)
        out[i] = np.minimum(np.bincount(place, minlength=wide[i]), 255).astype(np.uint8)
    return out


def sent_groups(n: np.ndarray, percent: int) -> np.ndarray:
    """Groups of the point that travels with a text of n shingles: the fewest at which the summed minima of unrelated texts
    stay ``SIGMAS`` deviations below what a link needs.  Fewer groups only weaken the bound, no pair is lost."""
    need = 2 * percent / (100 + percent)
    out = groups_for(n)
    for groups in (GROUPS // 2, GROUPS // 4):
        per = np.maximum(n, 1) / groups  # two Poisson counts: mean of the least per - 0.564 sqrt(per), deviation 0.43 sqrt(per)
        far = need - 1 + 0.564 / np.sqrt(per) >= SIGMAS * 0.43 / np.sqrt(per * groups)
        out[far & (out == 2 * groups)] = groups
    return out


def narrowed(vectors: list[np.ndarray], n: np.ndarray, percent: int) -> list[np.ndarray]:
    """The points folded onto the groups that travel; ``may_link`` allows for what is cut."""
    wide = sent_groups(n, percent)
    return [v if len(v) <= g else np.minimum(v.reshape(g, -1).sum(1), 255).astype(np.uint8) for v, g in zip(vectors, wide.tolist(), strict=True)]


def folded(packed: list[bytes], groups: int) -> np.ndarray:
    """Points of several sizes as rows over ``groups`` groups."""
    out = np.empty((len(packed), groups), np.int64)
    for i, p in enumerate(packed):
        v = np.frombuffer(p, np.uint8)
        out[i] = v if len(v) == groups else v.reshape(groups, -1).sum(1)
    return out


def may_link(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether the summed minima leave room for a link."""
    cut = np.minimum(na - a.sum(-1, dtype=np.int64), nb - b.sum(-1, dtype=np.int64))
    most = np.minimum(a, b).sum(-1, dtype=np.int64) + cut
    return (100 + percent) * most >= percent * (na + nb)


class _Box:
    """A node of a packed tree: rows lo..hi of the sorted points, their largest counts, their sizes, and
    whether no count was cut."""

    __slots__ = ("lo", "hi", "high", "least", "most", "whole", "children")

    def __init__(self, lo, hi, high, least, most, whole, children):
        self.lo, self.hi, self.high, self.least, self.most, self.whole, self.children = lo, hi, high, least, most, whole, children


def pack_tree(vectors: np.ndarray, sizes: np.ndarray, fanout: int = 8) -> _Box:
    """Tree over points sorted by size and leading coordinates, packed bottom-up."""
    whole = vectors.sum(1) == sizes
    level = [
        _Box(lo, min(lo + LEAF, len(sizes)), vectors[lo : lo + LEAF].max(0), sizes[lo : lo + LEAF].min(), sizes[lo : lo + LEAF].max(), whole[lo : lo + LEAF].all(), [])
        for lo in range(0, len(sizes), LEAF)
    ]
    while len(level) > 1:
        level = [
            _Box(c[0].lo, c[-1].hi, np.max([x.high for x in c], 0), min(x.least for x in c), max(x.most for x in c), all(x.whole for x in c), c)
            for c in (level[i : i + fanout] for i in range(0, len(level), fanout))
        ]
    return level[0]


def tree_pairs(vectors: np.ndarray, sizes: np.ndarray, side: np.ndarray, part: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, row) of different ``part`` that may be linked.  ``side``: 0 and 1 for the points of two
    tiles, of which only pairs across are wanted; all 0: all pairs."""
    order = np.lexsort((vectors[:, 1], vectors[:, 0], sizes))
    v, n, s, p = vectors[order], sizes[order].astype(np.int64), side[order], part[order]
    root, two = pack_tree(v, n), bool(side.any())
    cut = n - v.sum(1, dtype=np.int64)  # shingles beyond the largest count that a point can hold
    if v.max(initial=0) < 1 << 16:
        v = v.astype(np.uint16)
    left, right, todo = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [(root, root)]
    while todo:
        x, y = todo.pop()
        if percent * max(x.least, y.least) > 100 * min(x.most, y.most):  # sizes too far apart
            continue
        least = x.least + y.least
        most = np.minimum(x.high, y.high).sum(dtype=np.int64)
        if x.whole and y.whole and (100 + percent) * most < percent * least:
            continue
        if x.children or y.children:
            cx, cy = x.children or [x], y.children or [y]
            todo += [(a, b) for i, a in enumerate(cx) for j, b in enumerate(cy) if x is not y or i <= j]
            continue
        a, b = slice(x.lo, x.hi), slice(y.lo, y.hi)
        ok = p[a, None] != p[None, b]
        if x is y:
            ok &= np.arange(x.lo, x.hi)[:, None] < np.arange(y.lo, y.hi)
        if two:
            ok &= s[a, None] != s[None, b]
        ok &= (percent * n[a, None] <= 100 * n[None, b]) & (percent * n[None, b] <= 100 * n[a, None])
        if not ok.any():
            continue
        shared = np.minimum(v[a, None], v[None, b]).sum(2, dtype=np.int64) + np.minimum(cut[a, None], cut[None, b])
        i, j = np.nonzero(ok & ((100 + percent) * shared >= percent * (n[a, None] + n[None, b])))
        left.append(order[i + x.lo]), right.append(order[j + y.lo])
    return np.concatenate(left), np.concatenate(right)


_STAR = chunks.shape("slab long, a long, b long")
_ENTRY = chunks.shape("bucket int, entries binary, stars binary")
_LOW = _U(0xFFFFFFFF)


def _stars(key: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From (key, class) pairs: the first class of each key, and rows (key, first, other) for the rest."""
    order = np.lexsort((cls, key))
    key, cls = key[order], cls[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
    key, cls = key[new], cls[new]
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    lead = cls[head][np.cumsum(head) - 1] if len(key) else cls
    rest = ~head
    return key[head], cls[head], np.stack([key[rest], lead[rest], cls[rest]], 1), lead


def _slab_stars(docs: DataFrame, text: str, size: int, percent: int) -> DataFrame:
    """(slab, a, b): classes a and b agree in a slab; the rows of a slab connect all its classes.  Inside a bucket a
    slab is known by 32 bits: two that fall together only bring candidates that are not links."""
    buckets = chunks.parts_for(docs, text)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            key, cls, star, _ = _stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            edges = chunks.bucket_edges(key, buckets)
            rows = []
            for b in np.flatnonzero(np.diff(edges)):
                lo, hi = edges[b], edges[b + 1]
                own = star[np.searchsorted(star[:, 0], key[lo]) : np.searchsorted(star[:, 0], key[hi - 1], "right")]
                rows.append((int(b), (key[lo:hi] & _LOW).astype(np.uint32).tobytes() + cls[lo:hi].tobytes(), (own[:, 0] & _LOW).astype(np.uint32).tobytes() + own[:, 1:].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), chunks.arrow_schema(_ENTRY), strict=True)], schema=chunks.arrow_schema(_ENTRY))

        for part in slices(batches, text, SLICE):
            h, first = shingle_sets(part.column(text), size)
            if not len(h):
                continue
            key, of = slab_keys(h, first, percent)
            held.append((key, class_hash(h, first)[0][of]))
            if sum(len(k) for k, _ in held) > FLUSH:
                yield flush()
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, classes, stars = [np.empty(0, _U)], [np.empty(0, _U)], [np.empty((0, 3), _U)]
        for batch in batches:
            for bucket, e, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                high = _U(bucket) << _U(32)
                n, m = len(e) // 12, len(s) // 20
                keys.append(np.frombuffer(e, np.uint32, n).astype(_U) | high)
                classes.append(np.frombuffer(e, _U, n, 4 * n))
                ends = np.frombuffer(s, _U, 2 * m, 4 * m).reshape(m, 2)
                stars.append(np.column_stack([np.frombuffer(s, np.uint32, m).astype(_U) | high, ends]))
        _, _, star, _ = _stars(np.concatenate(keys), np.concatenate(classes))
        out = np.concatenate([*stars, star]).view(np.int64)
        for lo in range(0, len(out), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in out[lo : lo + 200_000].T], schema=chunks.arrow_schema(_STAR))

    found = docs.select(text).mapInArrow(entries, _ENTRY).repartitionById(buckets, F.col("bucket")).mapInArrow(meet, _STAR)
    return found.select("slab", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _sets(docs: DataFrame, members: DataFrame, sent: DataFrame, key: str, text: str, size: int, width: type) -> DataFrame:
    """For every wanted class (h1, to: array of structs) its packed set, once per entry of ``to``: the fields of the
    struct, ``h1`` and ``set``.  A class is read from a row of its least key; other texts of that key are passed over."""
    wanted = durable(sent.join(members.select("h1", F.col("rep").alias(key)), "h1"))
    few = wanted.agg(F.count(F.lit(1)), F.sum(F.size("to"))).first()
    fields = wanted.schema["to"].dataType.elementType.fields
    kind = T.StructType([*fields, *chunks.shape("h1 long, set binary").fields])
    names = [f.name for f in fields]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = chunks.arrow_schema(kind)

        def sent_rows(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for part in slices(batches, text, SLICE):
            h, first = shingle_sets(part.column(text), size)
            own_class = class_hash(h, first)[0].view(np.int64)
            rows, held = [], 0
            for i, (h1, to) in enumerate(zip(part.column("h1").to_pylist(), part.column("to").to_pylist(), strict=True)):
                if own_class[i] != h1:
                    continue
                own = h[first[i] : first[i + 1]]
                packed = (own if width is np.uint64 else np.sort((own >> _U(32)).astype(np.uint32))).tobytes()
                for x in to:
                    rows.append((*[x[n] for n in names], h1, packed))
                    held += len(packed)
                    if held > BATCH_BYTES:
                        yield sent_rows(rows)
                        rows, held = [], 0
            if rows:
                yield sent_rows(rows)

    return docs.select(key, text).join(F.broadcast(wanted) if (few[1] or 0) <= BROADCAST_ROWS else wanted, key).mapInArrow(pack, kind)


def _verified(docs: DataFrame, members: DataFrame, pairs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of classes that are linked, decided on their whole shingle sets."""
    point = members.select(F.struct("h1").alias("k"), "n", "point")
    near = (
        pairs.select(F.struct(F.col("a").alias("h1")).alias("k"), "a", "b").join(point, "k")
        .select("a", "b", F.col("n").alias("na"), F.col("point").alias("pa"), F.struct(F.col("b").alias("h1")).alias("k")).join(point, "k")
        .select("a", "b", "na", "pa", F.col("n").alias("nb"), F.col("point").alias("pb"))
    )
    two = chunks.shape("a long, b long")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = b.column("pa").to_pylist(), b.column("pb").to_pylist()
            sizes = b.column("na").to_numpy(), b.column("nb").to_numpy()
            groups = np.array([min(len(x), len(y)) for x, y in zip(*packed, strict=True)], np.int64)
            ok = np.zeros(b.num_rows, bool)
            for g in np.unique(groups):
                for at in np.array_split(np.flatnonzero(groups == g), 1 + int((groups == g).sum()) * int(g) // 1_000_000):
                    x, y = (folded([side[i] for i in at], int(g)) for side in packed)
                    ok[at] = may_link(x, sizes[0][at], y, sizes[1][at], percent)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    near = durable(near.mapInArrow(bound, two))
    sweep(docs.sparkSession)  # the points have been compared
    judged = durable(_compared(docs, members, near, key, text, size, percent, np.uint32))
    close = judged.where("close").select("a", "b")
    sure = judged.where("linked AND NOT close").select("a", "b")
    if not close.limit(1).count():
        return sure
    exact = _compared(docs, members, close, key, text, size, percent, np.uint64)
    return durable(sure.unionByName(exact.where("linked").select("a", "b")))


def _compared(docs: DataFrame, members: DataFrame, near: DataFrame, key: str, text: str, size: int, percent: int, width: type) -> DataFrame:
    """(a, b, linked, close) for pairs whose sets meet as 32- or 64-bit hashes.  Each set is sent once to every a
    that it is paired with, and an a with many partners is sent to several tasks.  Short hashes can only count
    too many shared shingles; ``close`` marks pairs that ``MARGIN`` false matches could turn."""
    tiles = near.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("tiles"))
    salted = (
        near.withColumn("k", F.struct("a")).join(tiles.select(F.struct("a").alias("k"), "tiles"), "k")
        .select("a", "b", F.pmod(F.xxhash64("b"), "tiles").cast("int").alias("salt"))
    )
    hubs = tiles.select(F.col("a").alias("h1"), "a", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("salt"), F.lit(0).alias("role"))
    sent = hubs.unionByName(salted.select(F.col("b").alias("h1"), "a", "salt", F.lit(1).alias("role")))
    sent = sent.groupBy("h1").agg(F.collect_list(F.struct("a", "salt", "role")).alias("to"))
    out = chunks.shape("a long, b long, linked boolean, close boolean")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_key = np.empty(0, width), None
        for b in batches:
            rows = []
            for a, salt, role, other, packed in zip(*[b.column(i).to_pylist() for i in range(4)], b.column(4), strict=True):
                own = np.frombuffer(packed.as_buffer(), width)
                if role == 0:
                    hub, hub_key = own, (a, salt)
                    continue
                if hub_key != (a, salt):
                    raise RuntimeError("a pair came without its first text")
                shared, total = _shared(hub, own), len(hub) + len(own)
                linked = (100 + percent) * shared >= percent * total
                doubt = width is np.uint32 and linked and (100 + percent) * (shared - MARGIN) < percent * total
                rows.append((a, other, linked, doubt))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cols, chunks.arrow_schema(out), strict=True)], schema=chunks.arrow_schema(out))

    parts = chunks.width(docs.sparkSession)
    rows = _sets(docs, members, sent, key, text, size, width)
    return rows.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(compare, out).distinct()


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted sets share."""
    if len(a) < len(b):
        a, b = b, a
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum())


def tile_links(h: np.ndarray, first: np.ndarray, side: np.ndarray, part: np.ndarray, percent: int) -> np.ndarray:
    """For the sets of a tile, the least row of each row's component of verified links; pairs of one part, and
    pairs that links have joined already, are passed over."""
    n = np.diff(first)
    packed = [p.tobytes() for p in points(h, first)]
    i, j = tree_pairs(folded(packed, min(map(len, packed))), n, side, part, percent)
    root = list(range(len(n)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y and (100 + percent) * _shared(h[first[a] : first[a + 1]], h[first[b] : first[b + 1]]) >= percent * int(n[a] + n[b]):
            root[max(x, y)] = min(x, y)
    return np.array([find(x) for x in range(len(n))])


def _stars_of(names: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Rows (centre, other) that connect what the pairs (i, j) connect."""
    root = np.arange(len(names))
    while True:
        x, y = root[i], root[j]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    at = np.flatnonzero(root != np.arange(len(root)))
    return np.stack([names[root[at]], names[at]], 1)


_TILE_KEY = ["slab", "t1", "t2"]


def _by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one tile after the other, from batches sorted by tile."""
    kept: list[pa.Table] = []
    for b in batches:
        t = pa.Table.from_batches([b])
        while t.num_rows:
            group = _group(t)
            if kept and _group(kept[0].slice(0, 1))[0] != group[0]:
                yield pa.concat_tables(kept)
                kept = []
            other = np.flatnonzero(group != group[0])
            if not len(other):
                kept.append(t)
                break
            yield pa.concat_tables([*kept, t.slice(0, int(other[0]))])
            kept, t = [], t.slice(int(other[0]))
    if kept:
        yield pa.concat_tables(kept)


def _open_links(docs: DataFrame, stars: DataFrame, pairs: DataFrame, members: DataFrame, component: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """(a, b): links found in open slabs, one for every row that is linked in a tile, to the least of its tile
    component; ``stars`` and ``pairs`` are released.  The points of all members of open slabs say which rows may be linked; a tile lets out one row for
    each of them.  Their sets meet by the components of that relation, in tiles again, and are verified there, so
    pairs never leave a task and a set is sent once unless its component is large."""
    parts = chunks.width(docs.sparkSession)
    of = component.select(F.struct(F.col("node").alias("h1")).alias("k"), "component")
    sides = (
        pairs.withColumn("k", F.struct(F.col("a").alias("h1"))).join(of, "k", "left").select("a", "b", F.coalesce("component", "a").alias("x"), F.struct(F.col("b").alias("h1")).alias("k"))
        .join(of, "k", "left").where(F.col("x") != F.coalesce("component", "b")).select(F.struct("a", "b").alias("p"))
    )
    opened = stars.withColumn("p", F.struct("a", "b")).join(sides, "p", "left_semi").select("slab").distinct()
    ends = stars.join(opened, "slab", "left_semi").select("slab", F.explode(F.array("a", "b")).alias("h1")).distinct()
    placed = durable(
        ends.withColumn("k", F.struct("h1")).join(of, "k", "left").select("slab", "h1", F.coalesce("component", "h1").alias("part"), "k")
        .join(members.select(F.struct("h1").alias("k"), "n"), "k").select("slab", "h1", "part", "n")
    )
    for used in (stars, pairs):
        release(used)
    del opened, ends, sides
    sweep(docs.sparkSession)  # all that led to the placed rows
    tiles = F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("n") / TILE_SHINGLES)).cast("int")
    dealt = durable(placed.groupBy("slab").agg(tiles.alias("tiles")).where("tiles > 1").select(F.struct("slab").alias("s"), "tiles"))
    member = (
        placed.withColumn("s", F.struct("slab")).join(F.broadcast(dealt) if dealt.count() <= BROADCAST_ROWS else dealt, "s", "left")
        .withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        .select("slab", "h1", "part", "n", "tiles", F.pmod(F.xxhash64("h1"), "tiles").cast("int").alias("t"))
        .select("slab", "h1", "part", "n", "t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("u"))
        .select(F.struct("h1").alias("k"), "slab", F.least("t", "u").alias("t1"), F.greatest("t", "u").alias("t2"), (F.col("t") > F.col("u")).cast("int").alias("side"), "h1", "part", "n")
        .join(members.select(F.struct("h1").alias("k"), "point"), "k").drop("k")
    )
    two = chunks.shape("a long, b long")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [np.empty((0, 2), np.int64)]
        for t in _by_tile(batches):
            part, side, h1 = (t.column(c).to_numpy() for c in ("part", "side", "h1"))
            if (part == part[0]).all():
                continue
            packed = t.column("point").to_pylist()
            i, j = tree_pairs(folded(packed, min(map(len, packed))), t.column("n").to_numpy(), side, part, percent)
            if len(i):
                out.append(_stars_of(h1, i, j))
        edges = np.unique(np.concatenate(out), axis=0)  # a pair of many slabs counts once
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in edges.T], schema=chunks.arrow_schema(two))

    near = durable(member.repartition(parts, *_TILE_KEY).sortWithinPartitions(*_TILE_KEY).mapInArrow(search, two).distinct())
    release(placed)
    del member
    sweep(docs.sparkSession)
    # rows that may be linked, by the component of that relation: each goes to its tiles with its set
    maybe = durable(
        connected_components(near).select(F.struct(F.col("node").alias("h1")).alias("k"), "node", F.col("component").alias("slab"))
        .join(members.select(F.struct("h1").alias("k"), "n"), "k").join(of, "k", "left").select("slab", F.col("node").alias("h1"), "n", F.coalesce("component", "node").alias("part"))
    )
    tiles = F.ceil(F.greatest(F.count(F.lit(1)) / (2 * TILE), F.sum("n") / TILE_SHINGLES)).cast("int")
    dealt = maybe.groupBy("slab").agg(tiles.alias("tiles")).select(F.struct("slab").alias("s"), "tiles")
    sent = (
        maybe.withColumn("s", F.struct("slab")).join(dealt, "s").withColumn("t", F.pmod(F.xxhash64("h1"), "tiles").cast("int"))
        .select("h1", F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda u: F.struct("slab", F.least("t", u).alias("t1"), F.greatest("t", u).alias("t2"), (F.col("t") > u).cast("int").alias("side"), "part")).alias("to"))
    )
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_tile(batches):
            order = np.unique(np.stack([t.column("h1").to_numpy(), t.column("side").to_numpy()], 1), axis=0, return_index=True)[1]  # repeated rows once
            t = t.take(pa.array(order))
            h1 = t.column("h1").to_numpy()
            sets = [np.frombuffer(x, _U) for x in t.column("set").to_pylist()]
            first = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
            least = tile_links(np.concatenate(sets), first, t.column("side").to_numpy(), t.column("part").to_numpy(), percent)
            moved = np.flatnonzero(least != np.arange(len(least)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(h1[least[moved]]), pa.array(h1[moved])], schema=chunks.arrow_schema(two))

    rows = _sets(docs, members, sent, key, text, size, np.uint64)
    return durable(rows.repartition(parts, *_TILE_KEY).sortWithinPartitions(*_TILE_KEY).mapInArrow(verify, two).distinct())


def _group(t: pa.Table) -> np.ndarray:
    slab = t.column("slab").to_numpy().view(np.uint64)
    return mix(slab + mix(t.column("t1").to_numpy().astype(_U) << _U(32) | t.column("t2").to_numpy().astype(_U)))


def shingle_join(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row (key, n_shingles, component_id) per document.

    Two texts link when ``100 * |A n B| >= percent * |A u B|`` over distinct ``size``-word shingles of
    lower-cased (A-Z) words.  A text of fewer words has one shingle, all its words; null texts and texts
    without words have none, link with nothing and are their own component.  ``component_id`` is the
    least key reachable.  Rows with equal keys are one node, whatever their texts: links of each of them count
    for all; a null key gives its row a null component and links nothing.  Repeated rows link with each other.
    A long text is one set, in one task.  Columns of other names are ignored; an empty table gives no rows.
    """
    docs = docs.select(key, text)
    kind = T.StructType([docs.schema[key], *chunks.shape("n long, h1 long, h2 long, point binary").fields])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, SLICE):
            h, first = shingle_sets(part.column(text), size)
            h1, h2 = class_hash(h, first)
            vectors = [v.tobytes() for v in narrowed(points(h, first), np.diff(first), percent)]
            yield pa.RecordBatch.from_arrays(
                [part.column(key), pa.array(np.diff(first), pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(vectors, pa.binary())],
                schema=chunks.arrow_schema(kind),
            )

    described = durable(docs.mapInArrow(describe, kind))
    keyed = described.where(f"n > 0 AND `{key}` IS NOT NULL")
    members = durable(keyed.groupBy("h1").agg(F.min(key).alias("rep"), F.min("n").alias("n"), F.min("point").alias("point")))
    stars = durable(_slab_stars(docs.where(F.col(key).isNotNull()), text, size, percent).where("a <> b"))
    sweep(docs.sparkSession)  # the entries of the slabs have been read
    pairs = durable(stars.select("a", "b").distinct())
    links = _verified(docs, members, pairs, key, text, size, percent)
    # texts of one key are one node
    span = keyed.groupBy(key).agg(F.min("h1").alias("a"), F.max("h1").alias("z")).where("a <> z").select(key, "a")
    tied = keyed.select(key, F.col("h1").alias("b")).join(span, key).where("a <> b").select("a", "b").distinct()
    links = durable(links.unionByName(tied))
    component = connected_components(links)
    more = _open_links(docs, stars, pairs, members, component, key, text, size, percent)
    if more.limit(1).count():
        component = connected_components(links.unionByName(more))
    component = durable(component)
    of = component.select(F.struct(F.col("node").alias("h1")).alias("k"), "component")
    named = members.select(F.struct("h1").alias("k"), "h1", "rep").join(of, "k", "left").select("h1", "rep", F.coalesce("component", "h1").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    placed = named.select("h1", F.struct("component").alias("c")).join(least.select(F.struct("component").alias("c"), "least"), "c").select(F.struct("h1").alias("k"), "least")
    texts = described.select(key, "n", F.when((F.col("n") > 0) & F.col(key).isNotNull(), F.struct("h1")).alias("k"))
    joined = texts.join(placed, "k", "left")
    return joined.select(key, F.col("n").alias("n_shingles"), F.coalesce("least", key).alias("component_id"))
