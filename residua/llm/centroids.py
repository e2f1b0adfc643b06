"""Centroid clustering in integers, with PCA-rotated filtering.

Vectors become integers floor(scale * x); assignments, distances, sums and centroids are exact.  A rotation
is fitted to the moments of all vectors, and every row stores its leading rotated coordinates and the norm
of the rest.  For a vector v and a centroid c, with p their leading and r their rest,

    |v - c|^2  >=  |p(v) - p(c)|^2 + (|r(v)| - |r(c)|)^2,

as a rotation keeps distances and the triangle inequality bounds the rest.  A row computes this bound for all
centroids in a few coordinates, the exact distance of the centroid with the least bound, and then the
integer distances of those centroids only whose bound does not exceed it.  The bound is rounded down by
more than floating point can err, so no nearest centroid is lost, ties included.

Centroids are a fixed number of short vectors and travel with the tasks.  A task adds up its own
vectors by centroid, so a round sends one row per task and centroid, however many vectors a cluster has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residua.llm import chunks
from residua.session import durable

CLUSTERS, ROUNDS, SCALE, LEADING = 16, 3, 64, 12
LARGEST = 1 << 26  # of a component's size: then distances fit 64 bits up to 256 components
ROWS = 8192  # vectors handled at once
SLACK = 1e-9  # of the squared norms: more than the rounding of the bound


def usable(embedding: str, size: int) -> Column:
    """Whether a vector has ``size`` components, none of them null or non-finite."""
    x = F.col(f"`{embedding}`")
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(x) == size) & finite, F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray, size: int, kind: type) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, size)


def rotation(moments: np.ndarray, sums: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Centre and orthonormal axes (columns, widest spread first) from second moments."""
    centre = sums / max(n, 1)
    spread = moments / max(n, 1) - np.outer(centre, centre)
    _, axes = np.linalg.eigh((spread + spread.T) / 2)
    return centre, axes[:, ::-1]


def described(x: np.ndarray, centre: np.ndarray, axes: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading rotated coordinates of integer vectors, and the norm of all further ones."""
    turned = (x - centre) @ axes
    return turned[:, :leading], np.sqrt((turned[:, leading:] ** 2).sum(1))


def nearest(
    x: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, centre: np.ndarray, axes: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and exact squared distance of the nearest centroid of every row (ties: the smaller number), and
    how many integer distances that took."""
    c_lead, c_rest = described(centroids, centre, axes, lead.shape[1])
    bound = ((lead[:, None, :] - c_lead[None]) ** 2).sum(2) + (rest[:, None] - c_rest[None]) ** 2
    size = (lead**2).sum(1) + rest**2
    c_size = (c_lead**2).sum(1) + c_rest**2
    bound = bound - SLACK * (size[:, None] + c_size[None] + 1.0)
    rows = np.arange(len(x))
    first = bound.argmin(1)
    gap = x - centroids[first]
    best, number = (gap * gap).sum(1), first.copy()
    left = bound <= best[:, None]
    left[rows, first] = False
    computed = len(x)
    for c in np.flatnonzero(left.any(0)):
        at = np.flatnonzero(left[:, c] & (bound[:, c] <= best))
        gap = x[at] - centroids[c]
        d = (gap * gap).sum(1)
        computed += len(at)
        better = (d < best[at]) | ((d == best[at]) & (c < number[at]))
        best[at[better]], number[at[better]] = d[better], c
    return number, best, computed


def _summed(rows: DataFrame, by: str, size: int) -> dict[int, tuple[int, list[int]]]:
    """Counts and component sums by centroid: one row per task and centroid before, one per centroid after."""
    columns = [F.sum(F.element_at("sums", i + 1).cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]
    found = rows.groupBy(by).agg(F.sum("n").alias("n"), *columns).collect()
    return {r[by]: (r["n"], [int(r[f"s{i}"]) for i in range(size)]) for r in found}


def centroid_clusters(
    vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE,
    size: int = 64, leading: int = LEADING, seed: str = "1",
) -> DataFrame:
    """One row (key, cluster, distance, cluster_inertia, inertia, centroid_sha256) per kept vector.

    Kept are vectors of ``size`` components, none null or non-finite; others give no row.  A component x
    counts as the integer floor(scale * x); one beyond +-2^26 raises an error, as distances would not fit 64 bits.
    Centroids start as the ``clusters`` vectors with the least sha256 of ``seed:key``; fewer vectors make
    fewer clusters.  ``rounds`` times all vectors go to the nearest centroid (ties: smaller number) and every
    non-empty centroid becomes the floor of its vectors' mean; a last assignment gives the result.
    Repeated rows count as often as they occur, as first centroids too (equal hashes: smaller vector first).
    Rows with a null key are assigned but are no first centroid unless keys run out.  Columns of other names
    are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    key_type = vectors.schema[key].dataType
    values = F.transform(F.col(f"`{embedding}`"), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    inside = F.forall(F.col(f"`{embedding}`"), lambda x: F.abs(F.lit(scale) * x.cast("double")) <= LARGEST)
    whole = F.when(inside, values).otherwise(F.raise_error(F.lit(f"a component beyond 2^26 / {scale} cannot be clustered in 64-bit integers")))
    kept = vectors.where(usable(embedding, size)).select(F.col(f"`{key}`").alias("id"), whole.alias("x"))

    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = kept.orderBy(mark.asc_nulls_last(), "x").limit(clusters).collect()  # a fixed number of rows
    schema = "id {}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string".format(key_type.simpleString())
    if not first:
        return spark.createDataFrame([], schema).withColumnRenamed("id", key)
    centroids = np.array([r["x"] for r in first], np.int64)

    moment = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("row", T.ArrayType(T.DoubleType()))])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 2, size))
        for b in batches:
            x = _matrix(b.column("x"), size, np.float64)
            total[:size] += x.T @ x
            total[size] += x.sum(0)
            total[size + 1, 0] += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 2), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], schema=chunks.arrow_schema(moment))

    rows = kept.select("x").mapInArrow(moments, moment).groupBy("i").agg(*[F.sum(F.element_at("row", j + 1)).alias(f"v{j}") for j in range(size)]).collect()
    table = np.zeros((size + 2, size))
    for r in rows:
        table[r["i"]] = r[1:]
    centre, axes = rotation(table[:size], table[size], int(table[size + 1, 0]))

    stored = T.StructType([T.StructField("id", key_type), T.StructField("x", T.ArrayType(T.LongType())), T.StructField("lead", T.ArrayType(T.DoubleType())), T.StructField("rest", T.DoubleType())])

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for lo in range(0, whole_batch.num_rows, ROWS):
                b = whole_batch.slice(lo, ROWS)
                lead, rest = described(_matrix(b.column("x"), size, np.float64), centre, axes, leading)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), pa.array(list(lead), pa.list_(pa.float64())), pa.array(rest)], schema=chunks.arrow_schema(stored))

    index = durable(kept.mapInArrow(turn, stored))
    width = min(leading, size)

    def assigned(batches: Iterator[pa.RecordBatch], now: np.ndarray):
        for whole_batch in batches:
            for lo in range(0, whole_batch.num_rows, ROWS):
                b = whole_batch.slice(lo, ROWS)
                x = _matrix(b.column("x"), size, np.int64)
                number, distance, _ = nearest(x, _matrix(b.column("lead"), width, np.float64), b.column("rest").to_numpy(), now, centre, axes)
                yield b, x, number, distance

    partial = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType()))])
    for _ in range(rounds):

        def gather(batches: Iterator[pa.RecordBatch], now: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
            n, sums = np.zeros(len(now), np.int64), np.zeros((len(now), size), np.int64)
            for _, x, number, _ in assigned(batches, now):
                n += np.bincount(number, minlength=len(now))
                np.add.at(sums, number, x)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], schema=chunks.arrow_schema(partial))

        centroids = centroids.copy()
        for c, (n, sums) in _summed(index.select("x", "lead", "rest").mapInArrow(gather, partial), "cluster", size).items():
            centroids[c] = [s // n for s in sums]

    placed = T.StructType([T.StructField("id", key_type), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, number, distance in assigned(batches, centroids):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(number, pa.int32()), pa.array(distance)], schema=chunks.arrow_schema(placed))

    result = durable(index.mapInArrow(place, placed))
    named = spark.createDataFrame(
        [(c, hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest()) for c, v in enumerate(centroids)], "cluster int, centroid_sha256 string"
    )
    sums = result.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    of_cluster = sums.join(named, "cluster").select("cluster", F.col("s").cast("long").alias("cluster_inertia"), "centroid_sha256")
    of_all = sums.agg(F.sum("s").cast("long").alias("inertia"))
    return (
        result.join(F.broadcast(of_cluster), "cluster").crossJoin(F.broadcast(of_all))  # one row a centroid, and one row
        .select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    )
