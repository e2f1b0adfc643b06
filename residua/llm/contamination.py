"""Benchmark decontamination by winnowing.

From every ``w`` consecutive ``k``-gram hashes of a text the smallest is kept as a fingerprint, with
``k + w - 1 = span``.  Two texts that share ``span`` words share the window of hashes over them, hence its
minimum: every shared span of that length is found.  Fingerprints of documents are joined with those of
the items; around each hit the ``span``-word windows are compared as a whole, which extends the hit to
all its words.  Items of fewer than ``span`` words have one window, their whole word sequence, looked up
at every place.

The item side is broadcast while its word count is at most ``broadcast_words``; above that the same
fingerprints and windows go through salted joins, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residua.llm import chunks
from residua.llm.words import ALNUM_LOWER, room, slices, split, windows, with_columns
from residua.session import durable

SPAN, GRAM = 10, 4
BROADCAST_WORDS = 2_000_000
SALTS = 16
_ADDED = chunks.shape("n_words long, n_hit long, n_items long")


def _minima(grams: np.ndarray, ok: np.ndarray, w: int) -> np.ndarray:
    """Places that hold the minimum of a window of ``w`` hashes; ``ok``: a whole window starts here."""
    n = len(grams) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least = grams[:n].copy()
    for s in range(1, w):
        np.minimum(least, grams[s : s + n], out=least)
    chosen = np.zeros(len(grams), bool)
    for s in range(w):
        chosen[s : s + n] |= ok[:n] & (grams[s : s + n] == least)
    return np.flatnonzero(chosen)


def fingerprints(hashes: np.ndarray, first: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed k-gram hashes of the texts and their word positions."""
    grams = windows(hashes, gram)
    at = _minima(grams, room(first)[: len(grams)] >= span, span - gram + 1)
    return grams[at], at


def _item_rows(items: DataFrame, key: str, text: str, span: int, gram: int) -> DataFrame:
    """(kind, hash, item): kind 0 a fingerprint (item null), n > 0 a window of n words."""
    kind = T.StructType([*chunks.shape("kind int, hash long").fields, T.StructField("item", items.schema[key].dataType)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = chunks.arrow_schema(kind)
        for part in slices(batches, text):
            w = split(part.column(text), ALNUM_LOWER)
            owner = np.repeat(np.arange(part.num_rows), w.counts)
            left, counts = room(w.first), w.counts
            found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            fp, _ = fingerprints(w.hashes, w.first, span, gram)
            fp = np.unique(fp)
            found.append((np.zeros(len(fp), np.int64), fp, np.full(len(fp), -1)))
            for n in np.unique(np.minimum(counts[counts > 0], span)):
                whole = counts == n if n < span else counts >= span
                rolled = windows(w.hashes, int(n))
                at = np.flatnonzero(np.repeat(whole, counts) & (left >= n))
                found.append((np.full(len(at), n), rolled[at] if len(at) else np.empty(0, np.uint64), owner[at]))
            k, h, o = (np.concatenate(x) for x in zip(*found, strict=True))
            own = part.column(key).take(pa.array(np.where(o < 0, 0, o)))
            own = pa.array(own.to_pylist(), schema.field(2).type, mask=o < 0) if len(o) else pa.array([], schema.field(2).type)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(h.view(np.int64)), own], schema=schema)

    found = items.select(key, text).where(F.col(key).isNotNull()).mapInArrow(rows, kind)
    return found.distinct()


class Index:
    """Fingerprints and windows of the items as sorted arrays; item numbers by window."""

    def __init__(self, kind: np.ndarray, hash_: np.ndarray, item: np.ndarray) -> None:
        self.prints = np.unique(hash_[kind == 0])
        self.lengths = [int(n) for n in np.unique(kind[kind > 0])]
        self.by_length = {}
        for n in self.lengths:
            h, i = hash_[kind == n], item[kind == n]
            order = np.argsort(h, kind="stable")
            keys, start = np.unique(h[order], return_index=True)
            self.by_length[n] = (keys, np.append(start, len(h)), i[order])


def _find(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are among the sorted keys, and where."""
    if not len(keys) or not len(values):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return keys[at] == values, at


def _near(at: np.ndarray, left: np.ndarray, span: int, gram: int) -> np.ndarray:
    """Starts of the ``span``-word windows that hold a whole gram starting at one of the places."""
    step = np.zeros(len(left) + 1, np.int64)
    np.add.at(step, np.maximum(at - (span - gram), 0), 1)
    np.add.at(step, at + 1, -1)
    return np.flatnonzero((np.cumsum(step)[:-1] > 0) & (left >= span))


def _covered(n: int, starts: np.ndarray, length: int, into: np.ndarray) -> None:
    np.add.at(into, starts, 1)
    np.add.at(into, starts + length, -1)


def _shape(base: DataFrame, key_type: T.DataType) -> T.StructType:
    return T.StructType([*base.schema.fields, *_ADDED.fields, T.StructField("items", T.ArrayType(key_type)), T.StructField("covered", T.ArrayType(T.BooleanType()))])


def contamination(
    docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
    span: int = SPAN, gram: int = GRAM, broadcast_words: int = BROADCAST_WORDS, covered: bool = False,
) -> DataFrame:
    """Documents with the words that lie in an occurrence of an item window.

    Adds ``n_words``, ``n_hit``, ``n_items`` (long) and ``items`` (sorted ids of the items with a window in
    the text), and with ``covered=True`` one flag per word, replacing columns of these names.  Words are
    ASCII letters (lower-cased) and digits and all bytes from 0x80.  Null and empty texts have no words and
    no hits; an item without words or id has no window; repeated items count once per id.  Repeated
    documents are judged alike.  Empty tables give no hits or no rows.
    """
    if not 0 < gram <= span:
        raise ValueError("a gram must fit in the span")
    added = [*_ADDED.names, "items", "covered"]
    base = docs.drop(*added)
    rows = _item_rows(items, item_key, item_text, span, gram)
    key_type = items.schema[item_key].dataType
    shape = _shape(base, key_type)
    n_rows = rows.limit(broadcast_words + 1).count()
    out = _by_broadcast(base, rows, shape, text, span, gram) if n_rows <= broadcast_words else _by_join(base, rows, shape, text, span, gram)
    return out if covered else out.drop("covered")


def _by_broadcast(base: DataFrame, rows: DataFrame, shape: T.StructType, text: str, span: int, gram: int) -> DataFrame:
    got = rows.toArrow()
    ids = sorted({i for i in got.column("item").to_pylist() if i is not None})
    number = {v: i for i, v in enumerate(ids)}
    item = np.array([number.get(v, -1) for v in got.column("item").to_pylist()], np.int64)
    index = Index(got.column("kind").to_numpy(), got.column("hash").to_numpy().view(np.uint64), item)
    shared = base.sparkSession.sparkContext.broadcast((index, ids))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ids = shared.value
        schema = chunks.arrow_schema(shape)
        for part in slices(batches, text):
            w = split(part.column(text), ALNUM_LOWER)
            left, owner = room(w.first), np.repeat(np.arange(part.num_rows), w.counts)
            step = np.zeros(len(w.hashes) + 1, np.int64)
            pairs: list[tuple[int, int]] = []
            for n in index.lengths:
                rolled = windows(w.hashes, n)
                if n == span:
                    fp, at = fingerprints(w.hashes, w.first, span, gram)
                    starts = _near(at[_find(index.prints, fp)[0]], left, span, gram)
                else:
                    starts = np.flatnonzero(left >= n)
                keys, edge, of = index.by_length[n]
                hit, place = _find(keys, rolled[starts] if len(starts) else np.empty(0, np.uint64))
                starts, place = starts[hit], place[hit]
                _covered(len(w.hashes), starts, n, step)
                for d, p in np.unique(np.stack([owner[starts], place], 1), axis=0) if len(starts) else []:
                    pairs += [(int(d), int(i)) for i in of[edge[p] : edge[p + 1]]]
            flag = np.cumsum(step)[:-1] > 0
            sums = np.concatenate([[0], np.cumsum(flag)])
            held: dict[int, set] = {}
            for d, i in pairs:
                held.setdefault(d, set()).add(i)
            listed = [[ids[i] for i in sorted(held[j])] if j in held else [] for j in range(part.num_rows)]
            yield with_columns(
                part, schema, n_words=w.counts, n_hit=sums[w.first[1:]] - sums[w.first[:-1]], n_items=[len(x) for x in listed], items=listed,
                covered=pa.ListArray.from_arrays(pa.array(w.first, pa.int32()), pa.array(flag)),
            )

    return base.mapInArrow(judge, shape)


def _by_join(base: DataFrame, rows: DataFrame, shape: T.StructType, text: str, span: int, gram: int) -> DataFrame:
    """The same through shuffles: semi-join of fingerprints, then of windows, both salted on the document side."""
    row = "__row"
    numbered = base.withColumn(row, F.struct(F.xxhash64(*base.columns), F.monotonically_increasing_id()))
    numbered = durable(numbered.withColumn(row, F.concat_ws("-", f"{row}.col1", f"{row}.col2")))
    lengths = sorted(r[0] for r in rows.where("kind > 0").select("kind").distinct().collect())
    kind = chunks.shape(f"{row} string, kind int, hash long, start int, salt int")

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = chunks.arrow_schema(kind)
        for part in slices(batches, text):
            w = split(part.column(text), ALNUM_LOWER)
            left, owner = room(w.first), np.repeat(np.arange(part.num_rows), w.counts)
            found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            if span in lengths:
                fp, at = fingerprints(w.hashes, w.first, span, gram)
                found.append((np.zeros(len(at), np.int64), fp, at))
            for n in lengths:
                if n < span:
                    at = np.flatnonzero(left >= n)
                    found.append((np.full(len(at), n), windows(w.hashes, n)[at] if len(at) else np.zeros(0, np.uint64), at))
            k, h, at = (np.concatenate(x) for x in zip(*found, strict=True))
            own = part.column(row).take(pa.array(owner[at]))
            yield pa.RecordBatch.from_arrays(
                [own.cast(schema.field(0).type), pa.array(k, pa.int32()), pa.array(h.view(np.int64)), pa.array(at - w.first[owner[at]], pa.int32()), pa.array(at % SALTS, pa.int32())],
                schema=schema,
            )

    salted = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    slim = numbered.select(row, text)
    wanted = rows.select("kind", "hash").distinct().withColumn("salt", salted)
    on = ["kind", "hash", "salt"]
    hits = slim.mapInArrow(probes, kind).join(wanted, on, "left_semi")
    short = hits.where("kind > 0").select(row, "kind", "hash", "start")
    places = hits.where("kind = 0").groupBy(row).agg(F.collect_set("start").alias("at"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = chunks.arrow_schema(kind)
        for part in slices(batches, text):
            w = split(part.column(text), ALNUM_LOWER)
            left, owner = room(w.first), np.repeat(np.arange(part.num_rows), w.counts)
            at = np.concatenate([np.empty(0, np.int64), *[w.first[j] + np.array(x, np.int64) for j, x in enumerate(part.column("at").to_pylist())]])
            starts = _near(at, left, span, gram)
            own = part.column(row).take(pa.array(owner[starts]))
            h = windows(w.hashes, span)[starts] if len(starts) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [own.cast(schema.field(0).type), pa.array(np.full(len(starts), span), pa.int32()), pa.array(h.view(np.int64)), pa.array(starts - w.first[owner[starts]], pa.int32()), pa.array(starts % SALTS, pa.int32())],
                schema=schema,
            )

    whole = slim.join(places, row).mapInArrow(extend, kind).join(wanted, on, "left_semi").select(row, "kind", "hash", "start")
    found = whole.unionByName(short)
    spans = found.groupBy(row).agg(F.collect_set(F.struct("start", "kind")).alias("__spans"))
    owners = found.select(row, "kind", "hash").distinct().withColumn("salt", F.pmod(F.xxhash64(row), F.lit(SALTS)).cast("int"))
    named = owners.join(rows.where("kind > 0").withColumn("salt", salted), on).groupBy(row).agg(F.sort_array(F.collect_set("item")).alias("__items"))
    joined = numbered.join(spans, row, "left").join(named, row, "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = chunks.arrow_schema(shape)
        for part in slices(batches, text):
            w = split(part.column(text), ALNUM_LOWER)
            step = np.zeros(len(w.hashes) + 1, np.int64)
            for j, x in enumerate(part.column("__spans").to_pylist()):
                for s in x or []:
                    step[w.first[j] + s["start"]] += 1
                    step[w.first[j] + s["start"] + s["kind"]] -= 1
            flag = np.cumsum(step)[:-1] > 0
            sums = np.concatenate([[0], np.cumsum(flag)])
            listed = [x or [] for x in part.column("__items").to_pylist()]
            yield with_columns(
                part, schema, n_words=w.counts, n_hit=sums[w.first[1:]] - sums[w.first[:-1]], n_items=[len(x) for x in listed], items=listed,
                covered=pa.ListArray.from_arrays(pa.array(w.first, pa.int32()), pa.array(flag)),
            )

    return joined.mapInArrow(finish, shape)
