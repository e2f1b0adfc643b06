"""Piece tables of SentencePiece models, pre-tokens of whole texts, and answers per distinct pre-token.

In a unigram model the best segmentation has the largest sum of scores; in a BPE model adjacent pieces
are merged, best score first.  No piece holds a space (▁) after another character, nor an ASCII letter next to other
ASCII, so no segmentation crosses these borders and texts split there into independent pre-tokens.
Both facts are checked on the piece table; without the second, only the first border is used.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residua.llm import chunks
from residua.llm.words import Words, give_back, hash_spans, slices, text_bytes
from residua.session import ensure_checkpoint_dir

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
BROADCAST_TOKENS = 8_000_000
SLICE = 1 << 17  # bytes of text handled at once: a task needs about 200 times that beside the answers
TRIMMED = 32  # slices after which a task returns the memory that their arrays held
RECENT, SEEN = 150_000, 1_000_000  # hashes a task remembers: merged in steps, forgotten above the second


@dataclass(frozen=True)
class PieceTable:
    """``scores``: piece -> (id, score).  ``byte_ids``: the id of each byte, empty without byte fallback."""

    scores: dict[str, tuple[int, float]]
    texts: list[bytes]  # by id; empty for control pieces
    byte_ids: list[int]
    unknown: int
    longest: int
    unknown_score: float
    letters_apart: bool
    merges: bool  # a BPE model

    def frame(self, spark: SparkSession) -> DataFrame:
        """(piece, id, score): at most the vocabulary's rows."""
        return spark.createDataFrame([(p, i, s) for p, (i, s) in self.scores.items()], "piece string, id int, score double")


def _class(c: str) -> str:
    return "s" if c == SPACE else "n" if not c.isascii() else "a" if c.isalpha() else "p"


def load_pieces(path: str = MODEL) -> PieceTable:
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        spec.ParseFromString(file.read())
    if spec.normalizer_spec.name != "identity" or any(p.type == p.USER_DEFINED for p in spec.pieces):
        raise ValueError("only models without normalisation and user-defined pieces are supported")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores, texts, by_byte = {}, [], {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            by_byte[int(piece[3:5], 16)] = i
            texts.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            texts.append(b"" if model.is_control(i) else " ⁇ ".encode())
        else:
            scores[piece] = (i, model.get_score(i))
            texts.append(piece.replace(SPACE, " ").encode())
    pairs = {(_class(a), _class(b)) for p in scores for a, b in zip(p, p[1:], strict=False)}
    if {("a", "s"), ("n", "s"), ("p", "s")} & pairs:
        raise ValueError("pieces that go over a space are not supported")
    least = min((s for _, s in scores.values()), default=0.0)
    byte_ids = [by_byte[b] for b in range(256)] if len(by_byte) == 256 else []
    return PieceTable(scores, texts, byte_ids, model.unk_id(), max(map(len, scores), default=1), least - UNKNOWN_PENALTY, not {("a", "p"), ("p", "a")} & pairs, spec.trainer_spec.model_type == spec.trainer_spec.BPE)


_KIND = np.full(256, 2, np.uint8)  # 0 space, 1 ASCII letter, 2 other ASCII, 3 beyond ASCII
_KIND[32] = 0
_KIND[65:91] = _KIND[97:123] = 1
_KIND[128:] = 3


def pre_tokens(texts: pa.Array, letters_apart: bool = True) -> Words:
    """The pre-tokens of all texts, each text with a space put before it; empty texts have none."""
    data, at = text_bytes(texts)
    n = len(at) - 1
    size = np.diff(at)
    filled = np.flatnonzero(size)
    new = np.zeros(n + 1, np.int64)
    new[1:] = np.cumsum(size + (size > 0))
    out = np.full(new[-1], 32, np.uint8)
    body = np.ones(new[-1], bool)
    body[new[filled]] = False
    out[body] = data
    kind = _KIND[out]
    begin = np.zeros(new[-1], bool)
    before, now = kind[:-1], kind[1:]
    cut = (before != 0) & (now == 0)
    if letters_apart:
        cut |= (before + now == 3) & (before != 0) & (now != 0)
    begin[1:] = cut
    begin[new[filled]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(out)) if len(starts) else starts
    return Words(out, starts, ends, np.searchsorted(starts, new), hash_spans(out, starts, ends))


def token_slices(batches: Iterable[pa.RecordBatch], text: str, letters_apart: bool) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Small parts of the batches, each with its pre-tokens."""
    for k, part in enumerate(slices(batches, text, SLICE), 1):
        yield part, pre_tokens(part.column(text), letters_apart)
        if k % TRIMMED == 0:
            give_back()


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among sorted known ones."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def spelled(w: Words, at: np.ndarray) -> pa.Array:
    """The pre-tokens numbered ``at`` as strings, spaces as ▁, cut from the bytes without an object for each."""
    sizes = w.ends[at] - w.starts[at]
    letters = w.data[gather(w.starts[at], sizes)]
    wide = np.where(letters == 32, 3, 1)
    out = np.repeat(letters, wide)
    end = np.cumsum(wide)
    for k, byte in enumerate(SPACE.encode()):
        out[(end - 3 + k)[letters == 32]] = byte
    offsets = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes()))


def distinct_tokens(docs: DataFrame, text: str, letters_apart: bool) -> DataFrame:
    """(h, token): every distinct pre-token of all texts, spaces as ▁."""
    kind = chunks.shape("h long, token string")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = recent = np.empty(0, np.uint64)
        for _, w in token_slices(batches, text, letters_apart):
            h, first = np.unique(w.hashes, return_index=True)
            new = ~(_among(h, seen) | _among(h, recent))
            h, first = h[new], first[new]
            recent = np.insert(recent, np.searchsorted(recent, h), h)  # none of them is there yet
            if len(recent) > RECENT:
                seen = recent if len(seen) > SEEN else np.union1d(seen, recent)
                recent = recent[:0]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), spelled(w, first)], schema=chunks.arrow_schema(kind))

    return docs.select(text).mapInArrow(rows, kind).groupBy("h").agg(F.first("token").alias("token"))


@dataclass
class Found:
    """The answers of a slice: the place of each of its pre-tokens among the distinct ones, and their values."""

    at: np.ndarray
    sizes: np.ndarray
    begin: np.ndarray
    values: np.ndarray


class Answers:
    """Values (integer lists) by pre-token hash: parts sorted by hash, used in place without copies.  A part has its
    hashes, the places where their lists begin and the last one ends, and the values of all lists."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.parts = sorted((p for p in parts if len(p[0])), key=lambda p: p[0][0])
        self.first = np.array([k[0] for k, _, _ in self.parts], np.int64)

    def find(self, hashes: np.ndarray) -> Found:
        keys, at = np.unique(hashes.view(np.int64), return_inverse=True)
        edges = np.append(np.searchsorted(keys, self.first), len(keys)) if len(self.first) else np.zeros(1, np.int64)
        if len(keys) and edges[0]:
            raise RuntimeError("a pre-token has no answer")
        sizes, values = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        for (k, begin, v), lo, hi in zip(self.parts, edges[:-1], edges[1:], strict=True):
            if lo == hi:
                continue
            place = np.minimum(np.searchsorted(k, keys[lo:hi]), len(k) - 1)
            if (k[place] != keys[lo:hi]).any():
                raise RuntimeError("a pre-token has no answer")
            starts = begin[place].astype(np.int64)
            sizes.append(begin[place + 1].astype(np.int64) - starts)
            values.append(v[gather(starts, sizes[-1])].astype(np.int32))
        size = np.concatenate(sizes)
        return Found(at, size, np.cumsum(size) - size, np.concatenate(values))


def gather(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places begin[i] .. begin[i] + sizes[i] - 1 for all i, in order."""
    total = np.cumsum(sizes)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(begin - (total - sizes), sizes)


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A part of ``Answers``, in order of the hashes, its numbers as narrow as they fit."""
    table = table.sort_by("h")
    values = table.column("value").combine_chunks()
    flat, sizes = values.flatten().to_numpy(), values.value_lengths().to_numpy()
    begin = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return (
        table.column("h").to_numpy().astype(np.int64),
        begin.astype(np.uint32) if begin[-1] < 1 << 32 else begin,
        flat.astype(np.uint16) if flat.max(initial=0) < 1 << 16 else flat.astype(np.int32),
    )


def answer_texts(
    docs: DataFrame, key: str, text: str, answers: DataFrame, finish: Callable[[pa.RecordBatch, Words, Answers], pa.RecordBatch],
    shape: T.StructType, letters_apart: bool, broadcast_tokens: int = BROADCAST_TOKENS,
) -> DataFrame:
    """``finish`` for slices of the documents, given the answers (h, value array<int>) of their pre-tokens.

    The answers are broadcast in parts while they number ``broadcast_tokens`` at most; above that each chunk
    of documents gets those of its own distinct pre-tokens by a join, at most one row a chunk and key."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/answers-{uuid.uuid4().hex}"
    answers.write.parquet(path)
    answers = spark.read.parquet(path)

    if answers.count() <= broadcast_tokens:
        packed = chunks.shape("h binary, begin binary, value binary, wide_begin boolean, wide_values boolean")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = list(batches)
            if held:
                h, begin, value = _arrays(pa.Table.from_batches(held))
                row = (h.tobytes(), begin.tobytes(), value.tobytes(), begin.dtype == np.int64, value.dtype == np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, chunks.arrow_schema(packed), strict=True)], schema=chunks.arrow_schema(packed))

        dealt = answers.repartitionByRange(chunks.width(spark), "h").mapInArrow(pack, packed)
        parts = [spark.sparkContext.broadcast(tuple(r)) for r in dealt.toLocalIterator()]

        def unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, begin, value, wide_begin, wide_values = row
            return np.frombuffer(h, np.int64), np.frombuffer(begin, np.int64 if wide_begin else np.uint32), np.frombuffer(value, np.int32 if wide_values else np.uint16)

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            give_back()  # what tasks before this one have left
            known = Answers([unpack(p.value) for p in parts])
            for part, w in token_slices(batches, text, letters_apart):
                yield finish(part, w, known)

        return docs.mapInArrow(judge, shape)

    x = chunks.chunked(docs, key, chunks.parts_for(docs, text), text)
    asked = T.StructType([T.StructField(chunks.CHUNK, T.IntegerType()), T.StructField("h", T.LongType())])

    def ask(table: pa.Table) -> pa.Table:
        h = np.unique(np.concatenate([np.empty(0, np.uint64), *[np.unique(w.hashes) for _, w in token_slices(table.to_batches(), text, letters_apart)]]))
        return pa.Table.from_arrays([pa.array(np.full(len(h), table.column(chunks.CHUNK)[0].as_py()), pa.int32()), pa.array(h.view(np.int64))], schema=chunks.arrow_schema(asked))

    def judge_chunk(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = chunks.arrow_schema(shape)
        known = Answers([_arrays(right)])
        return pa.Table.from_batches([finish(p, w, known) for p, w in token_slices(left.to_batches(), text, letters_apart)], schema=schema)

    grouped = x.groupBy(chunks.CHUNK)
    replies = grouped.applyInArrow(ask, asked).withColumn("k", F.struct("h")).join(answers.select(F.struct("h").alias("k"), "value"), "k").select(chunks.CHUNK, "h", "value")
    return grouped.cogroup(replies.groupBy(chunks.CHUNK)).applyInArrow(judge_chunk, shape)


def passed(part: pa.RecordBatch | pa.Table, schema: pa.Schema, new: dict) -> pa.RecordBatch:
    """A batch with the columns of ``schema``, from ``new`` or passed through."""
    cols = [new[f.name] if f.name in new else part.column(f.name).cast(f.type) for f in schema]
    return pa.RecordBatch.from_arrays(cols, schema=schema)


class Forward:
    """Best scores of the prefixes of words; words in sorted order share the columns of their common prefix,
    as if they were paths in a trie."""

    def __init__(self, table: PieceTable) -> None:
        self.table, self.word = table, ""
        self.best, self.count, self.last = [0.0], [0], [(0, 0)]

    def read(self, word: str) -> None:
        """Move to ``word``: drop what goes beyond the shared prefix, compute the rest."""
        shared, most = 0, min(len(word), len(self.word))
        while shared < most and word[shared] == self.word[shared]:
            shared += 1
        del self.best[shared + 1 :], self.count[shared + 1 :], self.last[shared + 1 :]
        best, count, last, get = self.best, self.count, self.last, self.table.scores.get
        for e in range(shared + 1, len(word) + 1):
            top, at, piece = -float("inf"), e - 1, -1
            for s in range(max(0, e - self.table.longest), e):
                p = get(word[s:e])
                if p is not None and best[s] + p[1] > top:
                    top, at, piece = best[s] + p[1], s, p[0]
            units = 1
            if get(word[e - 1]) is None and best[e - 1] + self.table.unknown_score > top:
                top, at, piece = best[e - 1] + self.table.unknown_score, e - 1, -1
                units = len(word[e - 1].encode()) if self.table.byte_ids else 1
            best.append(top)
            last.append((at, piece))
            count.append(count[at] + units)
        self.word = word

    def ids(self) -> list[int]:
        """Ids of the best path of the whole word."""
        out, e = [], len(self.word)
        while e:
            s, piece = self.last[e]
            if piece >= 0:
                out.append(piece)
            elif self.table.byte_ids:
                out += [self.table.byte_ids[b] for b in reversed(self.word[s:e].encode())]
            else:
                out.append(self.table.unknown)
            e = s
        return out[::-1]


def merged_ids(word: str, table: PieceTable) -> list[int]:
    """Ids of a word under BPE: of all adjacent pairs that make a piece the best is merged, the left one first."""
    n, get = len(word), table.scores.get
    nxt, prev, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
    heap: list[tuple[float, int, int, int]] = []

    def offer(s: int) -> None:
        m = nxt[s]
        if m < n and (p := get(word[s : nxt[m]])) is not None:
            heapq.heappush(heap, (-p[1], s, m, nxt[m]))

    for s in range(n):
        offer(s)
    while heap:
        _, s, m, e = heapq.heappop(heap)
        if not (alive[s] and m < n and alive[m] and nxt[s] == m and nxt[m] == e):
            continue
        alive[m] = False
        nxt[s] = e
        if e < n:
            prev[e] = s
        offer(s)
        if prev[s] >= 0:
            offer(prev[s])
    out: list[int] = []
    for s in range(n):
        if alive[s]:
            p = get(word[s : nxt[s]])
            out += [p[0]] if p else [table.byte_ids[b] for b in word[s].encode()] if table.byte_ids else [table.unknown]
    return out
