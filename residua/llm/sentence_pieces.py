"""SentencePiece encoding and decoding over a relational lattice.

The distinct pre-tokens of all texts are exploded into their substrings of bounded length; an equi-join with
the piece table keeps those that are pieces: the edges of the lattice.  Edges are grouped by pre-token and a
higher-order aggregate folds them: for a unigram model from left to right into the best path (Viterbi), for
a BPE model from the best merge to the last, with the borders between pieces as bits of a number.
Viterbi over the scores of a BPE model does not give that model's pieces, so the fold follows the file.

Pre-tokens are hash partitioned when they are made distinct, and neither the explosion nor the
broadcast join changes that, so grouping needs no further shuffle.  Texts are put together from the ids
of their pre-tokens.  Pre-tokens above ``LONG`` characters are folded in a task over a plain loop, with the
same result: one row could not hold their edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residua.llm import chunks
from residua.llm.pieces import BROADCAST_TOKENS, Answers, Forward, PieceTable, answer_texts, distinct_tokens, gather, merged_ids, passed
from residua.llm.words import Words
from residua.session import durable

LONG = 48


def _fold(edges: Column) -> Column:
    """Best (score, start, id) of every position from edges (e, s, id, score) in order of end and start."""

    def step(best: Column, x: Column) -> Column:
        reached = F.struct((F.element_at(best, x["s"] + 1)["score"] + x["score"]).alias("score"), x["s"].alias("s"), x["id"].alias("id"))
        last = F.element_at(best, -1)
        return (
            F.when(F.size(best) == x["e"], F.concat(best, F.array(reached)))
            .when(reached["score"] > last["score"], F.concat(F.slice(best, 1, x["e"]), F.array(reached)))
            .otherwise(best)
        )

    origin = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("s"), F.lit(-1).alias("id")))
    return F.aggregate(edges, origin, step)


def _path(best: Column) -> Column:
    """(s, e, id) of the edges of the best path, from its end back."""
    start = F.struct((F.size(best) - 1).alias("at"), F.array().cast("array<struct<s:int,e:int,id:int>>").alias("path"))

    def back(state: Column, e: Column) -> Column:
        x = F.element_at(best, e + 1)
        taken = F.struct(x["s"].alias("at"), F.concat(F.array(F.struct(x["s"].alias("s"), e.alias("e"), x["id"].alias("id"))), state["path"]).alias("path"))
        return F.when(state["at"] == e, taken).otherwise(state)

    return F.aggregate(F.sequence(F.size(best) - 1, F.lit(1), F.lit(-1)), start, back)["path"]


def _merged(edges: Column, size: Column) -> Column:
    """(s, e, id) of the pieces after all merges.  ``edges`` are in order of falling score and rising start;
    an edge applies when both its ends are borders (``ends``) and one border lies inside (``inner``).  The
    state is the set of borders, negative once nothing applies; the remaining steps are then skipped."""

    def settle(long: Column) -> Column:
        def step(borders: Column, _: Column) -> Column:
            usable = F.filter(long, lambda x: (borders.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(borders.bitwiseAND(x["inner"])) == 1))
            merged = F.coalesce(borders.bitwiseAND(F.bitwise_not(F.get(usable, F.lit(0))["inner"])), -borders)
            return F.when(borders < 0, borders).otherwise(merged)

        return F.abs(F.when(size > 1, F.aggregate(F.sequence(F.lit(1), size - 1), full, step)).otherwise(full))

    full = F.call_function("shiftleft", F.lit(2).cast("long"), size) - 1
    pieces = F.transform(
        F.transform(F.array(F.filter(edges, lambda x: x["inner"] != 0)), settle),
        lambda b: F.filter(edges, lambda x: (b.bitwiseAND(x["ends"]) == x["ends"]) & (b.bitwiseAND(x["inner"]) == 0)),
    )
    return F.array_sort(F.transform(pieces[0], lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["id"].alias("id"))))


def lattice_ids(tokens: DataFrame, table: PieceTable) -> DataFrame:
    """(h, value): piece ids of the best segmentation of each pre-token (h, token)."""
    pieces = F.broadcast(table.frame(tokens.sparkSession))  # bounded by the vocabulary
    size = F.length("token")
    cut = tokens.where(size <= LONG).select("h", "token", F.explode(F.sequence(F.lit(0), size - 1)).alias("s"))
    cut = cut.select("h", "token", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(table.longest), size - F.col("s")))).alias("n"))
    edges = cut.withColumn("piece", F.col("token").substr(F.col("s") + 1, F.col("n"))).join(pieces, "piece", "left").where("id IS NOT NULL OR n = 1")
    end, number, score = F.col("s") + F.col("n"), F.coalesce("id", F.lit(-1)), F.coalesce("score", F.lit(table.unknown_score))
    if table.merges:
        bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
        edge = F.struct((-score).alias("cost"), "s", end.alias("e"), number.alias("id"), (bit(F.col("s")) + bit(end)).alias("ends"), (bit(end) - bit(F.col("s") + 1)).alias("inner"))
        path = _merged(F.col("edges"), F.length("token"))
    else:
        edge = F.struct(end.alias("e"), "s", number.alias("id"), score.alias("score"))
        path = _path(_fold(F.col("edges")))
    paths = edges.groupBy("h").agg(F.first("token").alias("token"), F.sort_array(F.collect_list(edge)).alias("edges"))
    paths = paths.select("h", "token", path.alias("path"))
    if table.byte_ids:
        ids = F.array(*[F.lit(i) for i in table.byte_ids])

        def fallback(p: Column) -> Column:
            digits = F.hex(F.encode(F.col("token").substr(p["s"] + 1, F.lit(1)), "UTF-8"))
            places = F.sequence(F.lit(1), F.length(digits), F.lit(2))
            return F.transform(places, lambda i: F.element_at(ids, F.conv(digits.substr(i, F.lit(2)), 16, 10).cast("int") + 1))
    else:

        def fallback(p: Column) -> Column:
            return F.array(F.lit(table.unknown))
    value = F.when(F.exists("path", lambda p: p["id"] < 0), F.flatten(F.transform("path", lambda p: F.when(p["id"] < 0, fallback(p)).otherwise(F.array(p["id"])))))
    short = paths.select("h", F.coalesce(value, F.transform("path", lambda p: p["id"])).alias("value"))

    kind = T.StructType([T.StructField("h", T.LongType()), T.StructField("value", T.ArrayType(T.IntegerType()))])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for token in b.column("token").to_pylist():
                if table.merges:
                    out.append(merged_ids(token, table))
                    continue
                forward = Forward(table)
                forward.read(token)
                out.append(forward.ids())
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(out, pa.list_(pa.int32()))], schema=chunks.arrow_schema(kind))

    return short.unionByName(tokens.where(size > LONG).mapInArrow(walk, kind))


class _Speller:
    """Bytes of runs of ids."""

    def __init__(self, table: PieceTable) -> None:
        self.sizes = np.array([len(t) for t in table.texts] + [0])
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(table.texts), np.uint8)

    def spell(self, ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and the places where the runs at ``edges`` begin among them."""
        known = np.where((ids < 0) | (ids >= len(self.sizes) - 1), len(self.sizes) - 1, ids)
        sizes = self.sizes[known]
        data = self.letters[gather(self.begin[known], sizes)]
        return data, np.concatenate([[0], np.cumsum(sizes)])[edges]


def _unlike(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray) -> np.ndarray:
    """Which runs of bytes of a, beginning at ``at``, differ from those of b."""
    out = np.diff(at) != np.diff(bt)
    if not out.any():
        wrong = np.concatenate([[0], np.cumsum(a != b)])
        return wrong[at[1:]] != wrong[at[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = not np.array_equal(a[at[i] : at[i + 1]], b[bt[i] : bt[i + 1]])
    return out


def encode(
    docs: DataFrame, table: PieceTable, key: str = "doc_id", text: str = "text", broadcast_tokens: int = BROADCAST_TOKENS, exact: bool = False
) -> DataFrame:
    """Adds ``ids`` (array of int) and ``n_tokens`` (long) to every row, and with ``exact`` whether decoding gives
    the text again, replacing columns of these names.

    A space is put before the text, spaces become ▁, nothing else is changed.  A character without a piece
    becomes its bytes, or the unknown id in a model without byte pieces.  Null texts have null ids and no
    tokens, empty texts empty ids.  Repeated rows are encoded alike; no rows in, none out.
    """
    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), *([T.StructField("exact", T.BooleanType())] if exact else [])]
    base = docs.drop(*[f.name for f in added])
    shape = T.StructType([*base.schema.fields, *added])
    speller = _Speller(table)
    answers = lattice_ids(durable(distinct_tokens(base, text, table.letters_apart)).repartition(chunks.width(docs.sparkSession), "h"), table)

    def finish(part: pa.RecordBatch, w: Words, known: Answers) -> pa.RecordBatch:
        found = known.find(w.hashes)
        sizes = found.sizes[found.at]
        ids = found.values[gather(found.begin[found.at], sizes)]
        edges = np.concatenate([[0], np.cumsum(sizes)])[w.first]
        missing = part.column(text).is_null()
        new = {"ids": pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids), mask=missing), "n_tokens": pa.array(np.diff(edges), pa.int64())}
        if exact:
            starts = np.append(w.starts, len(w.data))[w.first]
            new["exact"] = pa.array(~_unlike(w.data, starts, *speller.spell(ids, edges)))
        return passed(part, chunks.arrow_schema(shape), new)

    return answer_texts(base, key, text, answers, finish, shape, table.letters_apart, broadcast_tokens)


def decode(encoded: DataFrame, table: PieceTable, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the text that the ids stand for, without the space put before it; invalid bytes become U+FFFD.
    Null ids give null, empty ids the empty text, ids outside the vocabulary nothing."""
    base = encoded.drop(into)
    shape = T.StructType([*base.schema.fields, T.StructField(into, T.StringType())])
    speller = _Speller(table)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = chunks.arrow_schema(shape)
        for whole in batches:
            lengths = np.concatenate([[0], np.cumsum(whole.column(ids).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            lo = 0
            while lo < whole.num_rows:
                hi = max(lo + 1, int(np.searchsorted(lengths, lengths[lo] + 1_000_000, "right")) - 1)
                part = whole.slice(lo, hi - lo)
                lists = part.column(ids)
                flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                data, edges = speller.spell(flat, lengths[lo : hi + 1] - lengths[lo])
                raw = data.tobytes()
                out = [None if null else raw[a:b].removeprefix(b" ").decode("utf-8", "replace") for a, b, null in zip(edges[:-1], edges[1:], lists.is_null().to_pylist(), strict=True)]
                yield passed(part, schema, {into: pa.array(out, pa.string())})
                lo = hi

    return base.mapInArrow(texts, shape)
