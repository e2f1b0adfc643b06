"""Token counts by dynamic programming over a trie of all distinct pre-tokens.

Pre-tokens in sorted order are the trie's paths in depth-first order.  A range of them is one task: it keeps the
column of best scores along the current path, goes back to the shared prefix and computes only what is
new, and stores the count of the best segmentation at each terminal.  Texts then add up the counts of
their pre-tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from residua.llm import chunks
from residua.llm.pieces import BROADCAST_TOKENS, Answers, Forward, PieceTable, answer_texts, distinct_tokens, passed
from residua.llm.words import Words


def count_tokens(
    docs: DataFrame, table: PieceTable, key: str = "doc_id", text: str = "text", broadcast_tokens: int = BROADCAST_TOKENS
) -> DataFrame:
    """Adds ``n_tokens`` and ``n_pre_tokens`` (long) to every row, replacing columns of these names.

    Null and empty texts have no tokens; a character without a piece counts its bytes (one unknown without
    byte fallback).  Repeated rows count alike; no rows in, none out.
    """
    base = docs.drop("n_tokens", "n_pre_tokens")
    shape = T.StructType([*base.schema.fields, *chunks.shape("n_tokens long, n_pre_tokens long").fields])
    kind = T.StructType([T.StructField("h", T.LongType()), T.StructField("value", T.ArrayType(T.IntegerType()))])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forward = Forward(table)
        for b in batches:
            counts = []
            for token in b.column("token").to_pylist():
                forward.read(token)
                counts.append([forward.count[-1]])
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(counts, pa.list_(pa.int32()))], schema=chunks.arrow_schema(kind))

    parts = chunks.width(docs.sparkSession)
    words = distinct_tokens(base, text, table.letters_apart).repartitionByRange(parts, "token").sortWithinPartitions("token")
    answers = words.mapInArrow(walk, kind)

    def finish(part: pa.RecordBatch, w: Words, known: Answers) -> pa.RecordBatch:
        found = known.find(w.hashes)
        each = found.values[found.at].astype(np.int64)  # one number for each pre-token
        total = np.concatenate([[0], np.cumsum(each)])
        new = {"n_tokens": pa.array(total[w.first[1:]] - total[w.first[:-1]], pa.int64()), "n_pre_tokens": pa.array(w.counts, pa.int64())}
        return passed(part, chunks.arrow_schema(shape), new)

    return answer_texts(base, key, text, answers, finish, shape, table.letters_apart, broadcast_tokens)
