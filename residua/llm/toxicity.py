"""Toxicity scores from a learned lexicon, its misspellings and the context of each hit.

Terms are words whose contexts (neighbour pairs) are almost all in toxic texts; counting distinct
contexts keeps copied texts from voting many times.  A word one edit away from a term is found by running
the word's Levenshtein automaton along the trie of all terms; words known from clean texts are no
misspellings.  Each hit weighs more near other hits and less inside quotation marks or after a verb
of reporting.  A logistic layer turns the sums of a text into a probability.

Lexicon and layer are learned from a sample of at most about ``max_rows`` labelled rows; texts are scored
whole, in one pass without a shuffle.  The lexicon is bounded by the sample, so it can be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residua.llm import chunks
from residua.llm.words import Alphabet, Words, alphabet, distinct, mix, slices, split

MAX_ROWS = 20_000
MIN_CONTEXTS, MIN_EVIDENCE = 4, 8.5
FUZZY_LENGTH = 5  # shorter terms have no misspellings
WINDOW = 8  # words on each side of a hit
NEAR, QUOTED, REPORTED = 1.3, 0.4, 0.7  # factors of a hit's weight
REPORTING = ["said", "says", "called", "wrote", "writes", "quoted", "quote", "replied", "according", "dit", "sagte", "dijo"]
NO_EVIDENCE = np.array([0, 0, 0, 0, 0, -4.0])  # the layer of an empty lexicon
_ADDED = chunks.shape("score double, n_hits long")


def _letters() -> Alphabet:
    """Letters and digits, lower-cased; digits that stand for letters are read as these."""
    a = alphabet({*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}, lower=True)
    for digit, letter in zip("013457", "oieast", strict=True):
        a.fold[ord(digit)] = ord(letter)
    return a


LETTERS = _letters()


def trie(terms: list[str]) -> dict:
    """Nested dicts by character; the key "" holds the number of the term that ends there."""
    root: dict = {}
    for i, t in enumerate(terms):
        reduce(lambda node, c: node.setdefault(c, {}), t, root)[""] = i
    return root


def within(word: str, root: dict, distance: int = 1) -> list[tuple[int, int]]:
    """(term number, edits) for all terms within ``distance`` edits of the word: the word's automaton, one
    bit vector of reached positions per number of edits, is stepped along the edges of the trie."""
    size = len(word)
    full = (1 << (size + 1)) - 1
    mask: dict[str, int] = {}
    for i, c in enumerate(word):
        mask[c] = mask.get(c, 0) | (1 << i)
    found = []
    todo = [(root, tuple((1 << (d + 1)) - 1 & full for d in range(distance + 1)))]
    while todo:
        node, state = todo.pop()
        for c, below in node.items():
            if c == "":
                edits = next((d for d, r in enumerate(state) if r >> size & 1), None)
                if edits is not None:
                    found.append((below, edits))
                continue
            m = mask.get(c, 0)
            new = [(state[0] & m) << 1]
            for d in range(1, distance + 1):
                new.append((((state[d] & m) << 1) | state[d - 1] | (state[d - 1] << 1) | (new[d - 1] << 1)) & full)
            if any(new):
                todo.append((below, tuple(new)))
    return sorted(found, key=lambda x: (x[1], x[0]))


@dataclass
class Lexicon:
    """Learned terms with weights, the weights of words known from the sample, and the logistic layer."""

    terms: list[str]
    weights: np.ndarray
    known: dict[int, tuple[int, float]]  # word hash -> (term, weight); weight 0: known as no hit
    layer: np.ndarray = field(default_factory=lambda: np.zeros(6))

    def __post_init__(self) -> None:
        self.trie = trie(self.terms)
        long = [t.encode() for t in self.terms if len(t) >= FUZZY_LENGTH]
        pair = lambda b: int.from_bytes(b, "big")
        self.heads = np.unique(np.array([pair(t[:2]) for t in long], np.int64))
        self.tails = np.unique(np.array([pair(t[-2:]) for t in long], np.int64))
        self.cache: dict[int, tuple[int, float]] = {}

    def candidates(self, w: Words) -> np.ndarray:
        """Words that may be within one edit of a term: an edit leaves the first or the last half, and so
        the first or last two bytes, as they are."""
        size = w.ends - w.starts
        at = np.flatnonzero(size >= FUZZY_LENGTH - 1)
        s, e = w.starts[at], w.ends[at]
        head = w.data[s].astype(np.int64) << 8 | w.data[s + 1]
        tail = w.data[e - 2].astype(np.int64) << 8 | w.data[e - 1]
        return at[np.isin(head, self.heads) | np.isin(tail, self.tails)]

    def match(self, word: str) -> tuple[int, float]:
        """Term and weight of a word not seen in the sample."""
        best = (-1, 0.0)
        for t, edits in within(word, self.trie):
            if len(self.terms[t]) >= FUZZY_LENGTH or edits == 0:
                best = max(best, (t, self.weights[t] * (1.0, 0.6)[edits]), key=lambda x: x[1])
        return best

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of hits, their terms and weights."""
        known = np.sort(np.array([h for h, (_, x) in self.known.items() if x > 0], np.uint64))
        exact = np.isin(w.hashes, known)
        maybe = np.zeros(len(w.hashes), bool)
        maybe[self.candidates(w)] = True
        at = np.flatnonzero(exact | maybe)
        keys, place, _ = distinct(w.hashes[at])
        sample = np.empty(len(keys), np.int64)
        sample[place] = at
        term, weight = np.empty(len(keys), np.int64), np.empty(len(keys))
        for i, h in enumerate(keys.tolist()):
            got = self.known.get(h) or self.cache.get(h)
            if got is None:
                got = self.match(w.string(sample[i]))
                if len(self.cache) < 1_000_000:
                    self.cache[h] = got
            term[i], weight[i] = got
        keep = weight[place] > 0 if len(keys) else np.empty(0, bool)
        return at[keep], term[place][keep] if len(keys) else at, weight[place][keep] if len(keys) else np.empty(0)


_REPORTS = {split(pa.array([x]), LETTERS).hashes[0] for x in REPORTING}
_QUOTES = ['"'.encode(), "“".encode(), "”".encode(), "„".encode(), "«".encode(), "»".encode()]


def _context(w: Words, at: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Factor of every hit from the words around it."""
    factor = np.ones(len(at))
    for k, i in enumerate(at):
        lo, hi = max(w.first[owner[k]], i - WINDOW), min(w.first[owner[k] + 1], i + WINDOW + 1)
        before = w.data[w.starts[lo] : w.starts[i]].tobytes()
        after = w.data[w.ends[i] : w.ends[hi - 1]].tobytes() if hi - 1 > i else w.data[w.ends[i] : w.ends[i] + 3].tobytes()
        if any(q in before for q in _QUOTES) and any(q in after for q in _QUOTES):
            factor[k] *= QUOTED
        elif any(h in _REPORTS for h in w.hashes[lo:i]):
            factor[k] *= REPORTED
        if (k and at[k - 1] >= lo and owner[k - 1] == owner[k]) or (k + 1 < len(at) and at[k + 1] < hi and owner[k + 1] == owner[k]):
            factor[k] *= NEAR
    return factor


def features(texts: pa.Array, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Five sums over the hits of each text, and the number of hits."""
    w = split(texts, LETTERS)
    n = len(w.first) - 1
    at, term, weight = lexicon.hits(w)
    owner = np.searchsorted(w.first, at, "right") - 1
    value = weight * _context(w, at, owner)
    total = np.bincount(owner, value, n)
    top = np.zeros(n)
    np.maximum.at(top, owner, value)
    kinds = np.zeros(n)
    if len(at):
        kinds = np.bincount(np.unique(np.stack([owner, term], 1), axis=0)[:, 0], minlength=n)
    hits = np.bincount(owner, minlength=n)
    density = np.minimum(100 * total / np.maximum(w.counts, 20), 50)
    return np.stack([np.log1p(total), top / 4, np.log1p(kinds), np.log1p(density), (hits > 0).astype(float)], 1), hits


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Newton steps of a penalised logistic regression; the last weight is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty * np.eye(len(b))
        move = np.linalg.solve(h, x.T @ (y - p) - penalty * b)
        b += np.clip(move, -5, 5)
    return b


def _contexts(df: DataFrame, text: str, label: str) -> DataFrame:
    """(word, label, contexts): in how many distinct pairs of neighbours a word occurs."""
    kind = chunks.shape("y int, h long, word string, context long")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            w = split(part.column(text), LETTERS)
            y = np.repeat(part.column(label).cast(pa.int32()).to_numpy(), w.counts)
            before, after = np.roll(w.hashes, 1), np.roll(w.hashes, -1)
            filled = w.counts > 0
            before[w.first[:-1][filled]] = 1
            after[w.first[1:][filled] - 1] = 2
            context = mix(mix(before) + after)
            _, first = np.unique(mix(w.hashes + mix(context)) ^ y.astype(np.uint64), return_index=True)
            spoken = [w.string(i) for i in first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(y[first], pa.int32()), pa.array(w.hashes[first].view(np.int64)), pa.array(spoken, pa.string()), pa.array(context[first].view(np.int64))], schema=chunks.arrow_schema(kind)
            )

    return df.select(text, label).mapInArrow(rows, kind)


def fit(labelled: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", max_rows: int = MAX_ROWS) -> Lexicon:
    """Learn from at most about ``max_rows`` of the rows whose label is 0 or 1, drawn by a hash of the key.
    Null texts have no words; without terms, as without toxic rows, every score is low."""
    rows = labelled.where(F.col(label).isin(0, 1)).select(key, text, label)
    n = rows.count()
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    sizes = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad:
        return Lexicon([], np.empty(0), {}, NO_EVIDENCE)
    counts = lambda df: df.groupBy("h").agg(F.min("word").alias("word"), F.count_distinct("context").alias("n"))
    seen = counts(_contexts(rows.where(F.col(label) == 1), text, label)).where(F.col("n") >= MIN_CONTEXTS)
    clean = _contexts(rows.where(F.col(label) == 0), text, label)
    base = max(good, 1) / bad
    both = seen.join(counts(clean).select("h", F.col("n").alias("m")), "h", "left").select("h", "word", "n", F.coalesce("m", F.lit(0)).alias("m"))
    odds = F.log((F.col("n") + 0.5) / (F.col("m") + 0.5) * base)
    share = F.col("n") / (F.col("n") + F.col("m"))
    terms = both.where((share >= 0.8) & (F.col("n") * F.log(share * (1 + base)) >= MIN_EVIDENCE)).select("h", "word", odds.alias("w")).orderBy("word").collect()
    if not terms:
        return Lexicon([], np.empty(0), {}, NO_EVIDENCE)
    found = Lexicon([r["word"] for r in terms], np.array([r["w"] for r in terms]), {r["h"] % (1 << 64): (i, float(r["w"])) for i, r in enumerate(terms)})
    shared = rows.sparkSession.sparkContext.broadcast(found)
    kind = chunks.shape("h long, clean int")

    def lookalikes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words of clean texts that are like a term."""
        for part in slices(batches, text):
            w = split(part.column(text), LETTERS)
            at, _, _ = shared.value.hits(w)
            h = np.unique(w.hashes[at])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.zeros(len(h)), pa.int32())], schema=chunks.arrow_schema(kind))

    for r in rows.where(F.col(label) == 0).select(text).mapInArrow(lookalikes, kind).select("h").distinct().collect():
        found.known.setdefault(r["h"] % (1 << 64), (-1, 0.0))
    shared.unpersist()
    shared = rows.sparkSession.sparkContext.broadcast(Lexicon(found.terms, found.weights, found.known))
    numbers = T.StructType([*chunks.shape("y int").fields, T.StructField("x", T.ArrayType(T.DoubleType()))])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            x, _ = features(part.column(text), shared.value)
            yield pa.RecordBatch.from_arrays([part.column(label).cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], schema=chunks.arrow_schema(numbers))

    got = rows.select(text, label).mapInArrow(extract, numbers).toArrow()
    x = np.array(got.column("x").to_pylist()).reshape(-1, 5)
    return Lexicon(found.terms, found.weights, found.known, _logistic(x, got.column("y").to_numpy().astype(float)))


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1) and ``n_hits`` to every row, replacing columns of these names.  Null and
    empty texts have no hits and get the score of a text without hits; repeated rows score alike."""
    base = docs.drop(*_ADDED.names)
    shape = T.StructType([*base.schema.fields, *_ADDED.fields])
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = chunks.arrow_schema(shape)
        for part in slices(batches, text):
            x, hits = features(part.column(text), shared.value)
            p = 1 / (1 + np.exp(-np.clip(x @ shared.value.layer[:-1] + shared.value.layer[-1], -30, 30)))
            new = {"score": pa.array(p), "n_hits": pa.array(hits, pa.int64())}
            yield pa.RecordBatch.from_arrays([new[f.name] if f.name in new else part.column(f.name).cast(f.type) for f in schema], schema=schema)

    return base.mapInArrow(judge, shape)
