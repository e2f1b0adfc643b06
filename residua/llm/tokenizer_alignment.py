"""Alignment of two tokenizers over whole texts, and how often their tokens meet in the corpus.

Tokenizer A is a byte-level BPE of the ``tokenizers`` library and gives character offsets; tokenizer B is a
SentencePiece model and gives spans of its proto pieces.  Both are coarse cuts: tokens that share one
character (parts of a multibyte character, byte-fallback pieces) have equal or overlapping spans.  Between
two cuts that are sure, token ends are refined with the decoded bytes of the tokens.

Texts are cut into segments at places that neither tokenizer ever crosses: before a space that follows
another visible character, and between an ASCII letter and other visible ASCII.  A task aligns every
distinct segment once and puts texts together from segments, so tokenizers see distinct segments only.
Segments are told apart by their bytes.

Between two neighbouring ends of any token lies exactly one pair of overlapping tokens; ends that both
tokenizers share close a group.  Pairs are counted per document inside the task, the counts of all tasks are
added by pair, and a second pass over the stored pairs of each document looks them up.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residua.llm import chunks
from residua.llm.pieces import SPACE, gather
from residua.llm.words import hash_spans, slices, text_bytes
from residua.session import durable, ensure_checkpoint_dir

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
BROADCAST_BYTES = 128 << 20  # of packed pair counts
SLICE = 1 << 20
CACHE = 400_000  # segments that a task remembers
BLOCK = 1 << 16  # bytes of joined segments encoded at once
ADDED = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def _byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 letters stand for
    themselves, the other bytes follow from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    out.update({chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))})
    return out


@dataclass(frozen=True)
class Pair:
    """Both tokenizers as files' contents, which tasks load, and the bytes of every token by id."""

    a_json: str
    b_proto: bytes
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    lead: str  # text of a space and one ASCII letter, and of a space and one digit: prefixes of segments

    @property
    def n_b(self) -> int:
        return len(self.b_bytes)


def load_pair(a_file: str = A_FILE, b_file: str = B_FILE) -> Pair:
    """Read both files; refuses a B model that could cross a segment border or changes texts."""
    from residua.llm.pieces import load_pieces

    with open(a_file, encoding="utf-8") as file:
        a_json = file.read()
    with open(b_file, "rb") as file:
        b_proto = file.read()
    spec = json.loads(a_json)
    split = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space"):
        raise ValueError("tokenizer A must be a byte-level BPE with its standard word pattern and without normalisation")
    table = load_pieces(b_file)
    if not table.letters_apart:
        raise ValueError("tokenizer B must not join ASCII letters with other ASCII")
    letters = _byte_of_letter()
    vocabulary = dict(spec["model"]["vocab"])
    special = {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
    a_bytes = [b""] * (max([*vocabulary.values(), *special]) + 1)
    for token, i in vocabulary.items():
        a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    return Pair(a_json, b_proto, a_bytes, table.texts, " a 0")


class _Spelling:
    """Lengths and joined bytes of all tokens of a vocabulary."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self.letters[gather(self.begin[ids], self.sizes[ids])]


def refined(begin: np.ndarray, end: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of tokens from coarse spans: an end is sure where the token has a width and the next one begins
    at or after it; ends before a sure cut follow from the decoded sizes since the last sure cut."""
    sure = end > begin
    sure[:-1] &= begin[1:] >= end[:-1]
    grown = np.cumsum(sizes)
    at = np.flatnonzero(sure)
    cut, upto = np.concatenate([[0], end[at]]), np.concatenate([[0], grown[at]])
    block = np.searchsorted(at, np.arange(len(sizes)))  # sure cuts before each token
    out = cut[block] + grown - upto[block]
    out[at] = end[at]
    return out


def segments(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes of all texts, each with a space before it, starts and ends of segments, and the
    number of segments before each text; null and empty texts have none."""
    data, at = text_bytes(texts)
    size = np.diff(at)
    filled = np.flatnonzero(size)
    new = np.zeros(len(at), np.int64)
    new[1:] = np.cumsum(size + (size > 0))
    out = np.full(new[-1], 32, np.uint8)
    body = np.ones(new[-1], bool)
    body[new[filled]] = False
    out[body] = data
    if not len(out):
        return out, np.empty(0, np.int64), np.empty(0, np.int64), new
    letter = ((out | 32) >= 97) & ((out | 32) <= 122) & (out < 128)
    visible = out > 32
    high = np.flatnonzero(out >= 0x80)
    if len(high):  # a space may follow white space beyond ASCII: such characters are not taken for visible
        lead = np.where(out >= 0xC0, np.arange(len(out)), 0)
        lead = np.maximum.accumulate(lead)[high]
        first, second = out[lead], out[np.minimum(lead + 1, len(out) - 1)]
        blank = (first == 0xC2) | (first == 0xE1) | ((first == 0xE2) & ((second == 0x80) | (second == 0x81))) | ((first == 0xE3) & (second == 0x80))
        visible[high[blank]] = False
    ascii_ = out < 128
    before, now = slice(0, -1), slice(1, None)
    cut = visible[before] & (out[now] == 32)
    cut |= letter[before] & ascii_[now] & ~letter[now]
    cut |= letter[now] & ascii_[before] & visible[before] & ~letter[before] & (out[before] != 39)  # 39: 's and the like stay whole
    begin = np.concatenate([[True], cut])
    begin[new[filled]] = True
    starts = np.flatnonzero(begin)
    return out, starts, np.append(starts[1:], len(out)), np.searchsorted(starts, new)


@dataclass
class _Known:
    """What is known of the distinct segments seen so far, by number."""

    number: dict[bytes, int] = field(default_factory=dict)
    counts: list[np.ndarray] = field(default_factory=list)  # rows (tokens of A, tokens of B, groups, whole)
    sizes: list[np.ndarray] = field(default_factory=list)  # links
    links: list[np.ndarray] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.sizes) != 1:
            self.counts, self.sizes, self.links = [np.concatenate(self.counts)], [np.concatenate(self.sizes)], [np.concatenate(self.links)]
        return self.counts[0], self.sizes[0], self.links[0]


class Aligner:
    """Both tokenizers of a task and the segments that it has aligned."""

    def __init__(self, pair: Pair) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(pair.a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pair.b_proto)
        self.n_b, self.lead = pair.n_b, pair.lead
        self.spell_a, self.spell_b = _Spelling(pair.a_bytes), _Spelling(pair.b_bytes)
        self.name_a = np.array([str(i) for i in range(len(pair.a_bytes))], object)
        self.name_b = np.array([str(i) for i in range(len(pair.b_bytes))], object)
        self.known = _Known()

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of every segment; new ones are aligned."""
        hashes = hash_spans(data, starts, ends)
        _, first, at = np.unique(hashes, return_index=True, return_inverse=True)
        size = ends - starts
        same = (size[first][at] == size).all() and (data[gather(starts, size)] == data[gather(starts[first][at], size)]).all()
        if not same:  # equal hashes of unlike segments: by their bytes
            raw = [data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
            place: dict[bytes, int] = {}
            at = np.array([place.setdefault(r, len(place)) for r in raw], np.int64)
            spans = list(place)
        else:
            whole = data.tobytes()
            spans = [whole[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        if len(self.known.number) + len(spans) > CACHE:
            self.known = _Known()
        known = self.known.number
        new = [s for s in spans if s not in known]
        if new:
            for s in new:
                known[s] = len(known)
            self._align(new)
        return np.array([known[s] for s in spans], np.int64)[at]

    def _align(self, new: list[bytes]) -> None:
        """Encode segments in joined blocks.  Each is put so that its borders hold: a segment without a leading space
        follows a letter or a digit of another kind, and one that ends in white space, or holds what B takes for
        a space, ends its block."""
        texts = [s.decode("utf-8", "replace") for s in new]
        lo = 0
        while lo < len(new):
            parts, begin, place, hi = [self.lead[:2]], [], 2, lo
            while hi < len(new) and place < BLOCK:
                t = texts[hi]
                prefix = "" if t[0] == " " else self.lead[2:] if t[0].isascii() and t[0].isalpha() else self.lead[:2]
                parts += [prefix, t]
                begin.append(place + len(prefix))
                place += len(prefix) + len(t.encode())
                hi += 1
                if t[-1].isspace() or not t[-1].isprintable() or SPACE in t:
                    break
            self._block("".join(parts), np.array(begin), [new[i] for i in range(lo, hi)], texts[lo:hi])
            lo = hi

    def _block(self, joined: str, begin: np.ndarray, raw: list[bytes], texts: list[str]) -> None:
        data = np.frombuffer(joined.encode(), np.uint8)
        end = begin + np.array([len(t.encode()) for t in texts])
        coded = self.a.encode(joined, add_special_tokens=False)
        a, spans = np.array(coded.ids, np.int64), np.array(coded.offsets, np.int64).reshape(-1, 2)
        if len(data) != len(joined):  # characters to bytes
            chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
            spans = chars[spans]
        a_end = refined(spans[:, 0], spans[:, 1], self.spell_a.sizes[a])
        # B puts the first space itself, and its spans do not count it
        pieces = self.b.encode(joined[1:], return_type="proto").pieces
        b = np.array([p.id for p in pieces], np.int64)
        spans = np.array([(p.begin, p.end) for p in pieces], np.int64).reshape(-1, 2) + 1
        spans[0, 0] = 0
        b_end = refined(spans[:, 0], spans[:, 1], self.spell_b.sizes[b])
        whole = self._whole(self.spell_a, a, a_end, data, begin, end) & self._whole(self.spell_b, b, b_end, data, begin, end)
        whole &= np.array([t.encode() == r for t, r in zip(texts, raw, strict=True)])

        ends, common = np.union1d(a_end, b_end), np.intersect1d(a_end, b_end)
        inside = np.searchsorted(ends, end, "right") - np.searchsorted(ends, begin, "right")
        which = gather(np.searchsorted(ends, begin, "right"), inside)
        links = a[np.searchsorted(a_end, ends[which])] * self.n_b + b[np.searchsorted(b_end, ends[which])]
        rows = [np.searchsorted(x, end, "right") - np.searchsorted(x, begin, "right") for x in (a_end, b_end, common)]
        counts = np.stack([*rows, whole], 1).astype(np.int64)
        names_a, names_b = self.name_a[a].tolist(), self.name_b[b].tolist()
        closes_a, closes_b = (np.searchsorted(a_end, common) + 1).tolist(), (np.searchsorted(b_end, common) + 1).tolist()
        opens_a, opens_b = [0, *closes_a], [0, *closes_b]
        groups = [",".join(names_a[x:y]) + "|" + ",".join(names_b[u:v]) for x, y, u, v in zip(opens_a, closes_a, opens_b, closes_b, strict=False)]
        from_, upto = np.searchsorted(common, begin, "right").tolist(), np.searchsorted(common, end, "right").tolist()
        k = self.known
        k.counts.append(counts), k.sizes.append(inside), k.links.append(links)
        k.texts += [";".join(groups[x:y]) for x, y in zip(from_, upto, strict=True)]

    def _whole(self, spelling: _Spelling, ids: np.ndarray, ends: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether the tokens that end in each segment are cut at its borders and spell its bytes."""
        sizes = spelling.sizes[ids]
        first, last = np.searchsorted(ends, begin, "right"), np.searchsorted(ends, end, "right")
        held = np.concatenate([[0], np.cumsum(sizes)])
        ok = (held[last] - held[first] == end - begin) & (np.append(ends, -1)[last - 1] == end)
        letters = spelling.spell(ids)
        at = np.flatnonzero(ok)
        n = (end - begin)[at]
        wrong = letters[gather(held[first[at]], n)] != data[gather(begin[at], n)]
        bad = np.concatenate([[0], np.cumsum(wrong)])
        edge = np.cumsum(n)
        ok[at] = bad[edge] == bad[edge - n]
        return ok


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    held = np.concatenate([[0], np.cumsum(values)])
    return held[first[1:]] - held[first[:-1]]


def _aligned(aligner: Aligner, texts: pa.Array) -> dict[str, list | np.ndarray]:
    """Counts, the digest of the groups, and the distinct links of each text with their numbers."""
    data, starts, ends, first = segments(texts)
    n = len(first) - 1
    at = aligner.numbers(data, starts, ends) if len(starts) else np.empty(0, np.int64)
    if not len(at):
        zero = np.zeros(n, np.int64)
        return {"n_a": zero, "n_b": zero, "n_groups": zero, "n_links": zero, "groups_sha256": [""] * n, "pairs": [b""] * n, "times": [b""] * n}
    counts, sizes, links = aligner.known.merged()
    names = aligner.known.texts
    owner = np.repeat(np.arange(n), np.diff(first))
    whole = (np.bincount(owner[counts[at, 3] == 0], minlength=n) == 0) & (np.diff(first) > 0)
    keep = whole[owner]
    out = {name: np.where(whole, _per_text(counts[at, i], first), 0) for i, name in enumerate(("n_a", "n_b", "n_groups"))}
    out["n_links"] = np.where(whole, _per_text(sizes[at], first), 0)
    order = at.tolist()
    out["groups_sha256"] = [
        hashlib.sha256(";".join([names[i] for i in order[lo:hi]]).encode()).hexdigest() if ok else ""
        for lo, hi, ok in zip(first[:-1].tolist(), first[1:].tolist(), whole.tolist(), strict=True)
    ]
    # distinct segments of each text, then their links
    span = len(names)
    both, repeats = np.unique(owner[keep] * span + at[keep], return_counts=True)
    doc, seg = both // span, both % span
    begin = np.cumsum(sizes) - sizes
    pair = links[gather(begin[seg], sizes[seg])]
    doc, repeats = np.repeat(doc, sizes[seg]), np.repeat(repeats, sizes[seg])
    order = np.lexsort((pair, doc))
    pair, doc, held = pair[order], doc[order], np.concatenate([[0], np.cumsum(repeats[order])])
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])
    edge = np.append(np.flatnonzero(new), len(pair))
    pair, doc, times = pair[new], doc[new], (held[edge[1:]] - held[edge[:-1]]).astype(np.uint32)
    where = np.searchsorted(doc, np.arange(n + 1))
    out["pairs"] = [pair[lo:hi].tobytes() for lo, hi in zip(where[:-1], where[1:], strict=True)]
    out["times"] = [times[lo:hi].tobytes() for lo, hi in zip(where[:-1], where[1:], strict=True)]
    return out


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def aligned_texts(docs: DataFrame, pair: Pair, text: str = "text") -> tuple[DataFrame, str, str]:
    """The rows with ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256`` and two packed columns, whose names
    are returned: the distinct links of the text (A id * size of B + B id, 64 bits) and how often each occurs."""
    base = docs.drop(*ADDED, "n_best", "count_sum")
    pairs, times = _free("__pairs", base.columns), _free("__times", base.columns)
    shape = T.StructType([*base.schema.fields, *chunks.shape("n_a long, n_b long, n_groups long, n_links long, groups_sha256 string").fields, T.StructField(pairs, T.BinaryType()), T.StructField(times, T.BinaryType())])
    held = docs.sparkSession.sparkContext.broadcast(pair)  # two vocabularies

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, schema = Aligner(held.value), chunks.arrow_schema(shape)
        for part in slices(batches, text, SLICE):
            new = _aligned(aligner, part.column(text))
            new[pairs], new[times] = new.pop("pairs"), new.pop("times")
            yield pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else part.column(f.name).cast(f.type) for f in schema], schema=schema)

    return base.mapInArrow(align, shape), pairs, times


def pair_counts(aligned: DataFrame, pairs: str, n_b: int) -> DataFrame:
    """(pair, n, best): in how many texts each pair of ids is linked, and whether no pair of its A id has more."""
    kind = chunks.shape("pair long, n long")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting, held = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def settle():
            nonlocal keys, counts, held
            every = np.concatenate([keys, *waiting])
            weight = np.concatenate([counts, np.ones(len(every) - len(keys), np.int64)])
            new, at = np.unique(every, return_inverse=True)
            keys, counts, held = new, np.bincount(at, weights=weight, minlength=len(new)).astype(np.int64), 0
            waiting.clear()

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], schema=chunks.arrow_schema(kind))

        for b in batches:
            for packed in b.column(0).to_pylist():
                waiting.append(np.frombuffer(packed, np.int64))
                held += len(waiting[-1])
                if held > 2_000_000:
                    settle()
            if len(keys) > 2_000_000:
                yield sent()
                keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        settle()
        yield sent()

    counted = durable(aligned.select(pairs).mapInArrow(add, kind).groupBy("pair").agg(F.sum("n").alias("n")))
    of_a = F.expr(f"pair div {n_b}")
    most = counted.groupBy(of_a.alias("a")).agg(F.max("n").alias("most"))
    return durable(counted.withColumn("a", of_a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def _looked_up(part: pa.RecordBatch | pa.Table, pairs: str, times: str, keys: np.ndarray, n: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    packed = part.column(pairs).to_pylist()
    pair = np.frombuffer(b"".join(packed), np.int64)
    often = np.frombuffer(b"".join(part.column(times).to_pylist()), np.uint32).astype(np.int64)
    first = np.concatenate([[0], np.cumsum([len(p) // 8 for p in packed])]).astype(np.int64)
    if not len(pair):
        return np.zeros(len(packed), np.int64), np.zeros(len(packed), np.int64)
    at = np.searchsorted(keys, pair)
    if (keys[np.minimum(at, len(keys) - 1)] != pair).any():
        raise RuntimeError("a pair has no count")
    return _per_text(often * best[at], first), _per_text(often * n[at], first)


def align_tokenizers(docs: DataFrame, pair: Pair, text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Adds to every row, as long: ``n_a``, ``n_b`` (tokens of the text under A, with a space put before it, and
    B), ``n_groups`` (runs between neighbouring byte ends that both share), ``n_links`` (overlapping A-B token
    pairs), ``n_best`` (links whose id pair is linked in no fewer texts than any other pair of its A id),
    ``count_sum`` (over links: in how many texts the id pair is linked); and ``groups_sha256`` (string).

    Columns of these names are replaced, others pass.  Texts that are null or empty, or whose tokens do not
    spell the text (U+2581 is a space to B), have zeros and ''.  Texts of special tokens are plain text.  Every
    row is a text of its own, repeated rows too; no key is needed.  Long texts are handled whole, in one task.
    No rows in, none out.

    The counts of pairs are broadcast while they fit ``broadcast_bytes`` packed; beyond that every task group of
    texts joins the counts of its own distinct pairs.
    """
    spark = docs.sparkSession
    stored, pairs, times = aligned_texts(docs, pair, text)
    stored = durable(stored)
    counts = pair_counts(stored, pairs, pair.n_b)
    shape = T.StructType([*[f for f in stored.schema.fields if f.name not in (pairs, times)], *chunks.shape("n_best long, count_sum long").fields])

    def finished(part: pa.RecordBatch | pa.Table, keys: np.ndarray, n: np.ndarray, best: np.ndarray):
        schema = chunks.arrow_schema(shape)
        n_best, total = _looked_up(part, pairs, times, keys, n, best)
        new = {"n_best": pa.array(n_best), "count_sum": pa.array(total)}
        kind = pa.Table if isinstance(part, pa.Table) else pa.RecordBatch
        return kind.from_arrays([new[f.name] if f.name in new else part.column(f.name).cast(f.type) for f in schema], schema=schema)

    if counts.count() * 17 <= broadcast_bytes:
        table = counts.toArrow().sort_by("pair")
        packed = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield finished(b, *packed.value)

        return stored.mapInArrow(look, shape)

    # every file of the stored texts is read by one task or a few; groups of texts are dealt by their content
    group = _free("__group", stored.columns)
    size = stored.agg(F.sum(F.octet_length(pairs))).first()[0] or 0
    parts = max(chunks.width(spark), -(-size // chunks.CHUNK_BYTES))
    dealt = stored.withColumn(group, F.pmod(F.xxhash64(pairs, "groups_sha256", text, F.monotonically_increasing_id()), F.lit(parts)).cast("int"))
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/aligned-{uuid.uuid4().hex}"
    dealt.write.parquet(path)
    grouped = spark.read.schema(dealt.schema).parquet(path).groupBy(group)
    asked = T.StructType([T.StructField(group, T.IntegerType()), T.StructField("pair", T.LongType())])
    known = T.StructType([*asked.fields, T.StructField("n", T.LongType()), T.StructField("best", T.BooleanType())])

    def ask(table: pa.Table) -> pa.Table:
        every = np.unique(np.frombuffer(b"".join(table.column(pairs).to_pylist()), np.int64))
        return pa.Table.from_arrays([pa.array(np.full(len(every), table.column(group)[0].as_py()), pa.int32()), pa.array(every)], schema=chunks.arrow_schema(asked))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.select(["pair", "n", "best"]).combine_chunks().sort_by("pair")
        return finished(left, *[right.column(c).to_numpy() for c in ("pair", "n", "best")])

    replies = grouped.applyInArrow(ask, asked).withColumn("k", F.struct("pair")).join(counts.withColumn("k", F.struct("pair")).drop("pair"), "k").select(*known.names)
    return grouped.cogroup(replies.groupBy(group)).applyInArrow(finish, shape)
