"""Questions about keys that occur all over the texts, asked once per chunk of documents.

A chunk is a fixed group of documents.  Each chunk sends its *distinct* keys, sorted and packed, to
buckets dealt by hash; a bucket answers every chunk in the order it asked.  A key that a third of all
documents hold costs one entry per chunk, never one per occurrence, and no bucket gets a hot key's
occurrences.  Chunks are functions of the rows, so a lost task computes the same question again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CHUNK = "__chunk"
CHUNK_BYTES = 32 << 20  # text of a chunk, about
_TYPES = {
    "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(),
    "boolean": T.BooleanType(), "longs": T.ArrayType(T.LongType()), "ints": T.ArrayType(T.IntegerType()),
}


def shape(fields: str) -> T.StructType:
    """A row type from text such as ``a long, b string``, also usable inside tasks."""
    return T.StructType([T.StructField(f.split()[0], _TYPES[f.split()[1]]) for f in fields.split(",")])


ASKED = shape("__chunk int, __bucket int, __packed binary")


def width(spark: SparkSession) -> int:
    """Partitions of the wide shuffles: the session's own setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_schema(kind: T.StructType) -> pa.Schema:
    return to_arrow_schema(kind)


def parts_for(df: DataFrame, text: str) -> int:
    """Chunks so that each holds ``CHUNK_BYTES`` of text or less, by the measured size of the column."""
    size = df.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    return max(width(df.sparkSession), -(-size // CHUNK_BYTES))


def _labels(spark: SparkSession, n: int) -> list[int]:
    """For each of n partitions a number that is dealt to it, so that chunks fill the partitions evenly."""
    tries, found = 4 * n, {}
    while len(found) < n:
        tries *= 2
        dealt = spark.range(tries).select(F.col("id").cast("int").alias("label"))
        dealt = dealt.groupBy(F.pmod(F.hash("label"), F.lit(n)).alias("part")).agg(F.min("label").alias("label"))
        found = dict(map(tuple, dealt.collect()))
    return [found[p] for p in range(n)]


def chunked(df: DataFrame, key: str, n: int, text: str | None = None) -> DataFrame:
    """The rows with their chunk, dealt by a hash of the key, and of the text if it is named, to n chunks, one in
    each partition.  Rows without a key or with one common key so spread over the chunks by their texts."""
    labels = F.array(*[F.lit(k) for k in _labels(df.sparkSession, n)])
    by = [F.col(f"`{key}`"), F.lit(71)] + ([F.col(f"`{text}`")] if text else [])
    place = F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    return df.withColumn(CHUNK, F.element_at(labels, place + 1)).repartition(n, CHUNK)


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among sorted 64-bit keys; buckets are equal ranges of the key space."""
    bounds = [(b << 64) // buckets for b in range(1, buckets)]
    inner = np.searchsorted(keys, np.array(bounds, np.uint64)) if bounds else np.empty(0, np.int64)
    return np.concatenate([[0], inner, [len(keys)]]).astype(np.int64)


def deal(asked: DataFrame, answer: Callable[[np.ndarray, np.ndarray, list[bytes]], list[bytes]], buckets: int) -> DataFrame:
    """Bring the questions of each bucket together and answer them.  ``answer`` gets the chunk and bucket
    numbers and the packed keys of all questions in a partition, and returns one packed reply each."""

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches), schema=arrow_schema(ASKED))
        if not got.num_rows:
            return
        chunk, bucket = got.column(0).to_numpy(), got.column(1).to_numpy()
        out = answer(chunk, bucket, got.column(2).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int32()), pa.array(bucket, pa.int32()), pa.array(out, pa.binary())], schema=arrow_schema(ASKED))

    return asked.repartitionById(buckets, F.col("__bucket")).mapInArrow(reply, ASKED)


def pack_bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unpack_bits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)
