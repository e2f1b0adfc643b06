"""Embedding near-dedup with a pivot-permutation index.

Reference vectors (pivots) are a bounded sample.  A vector is described by its ``prefix`` nearest pivots,
in order.  Every pivot has an inverted list of the vectors that it describes; two vectors are candidates
when they share at least ``shared`` pivots, counted from the permutation prefixes, and candidates are
verified by the exact cosine in double precision.  A pair is decided in the list of the first pivot that
both share, so it counts once.

Lists are dealt in tiles of bounded size, so a list that holds a third of all vectors is many tasks, and a
tile returns counts and one link per vector, to the least of its component in the tile, never its pairs.  Equal vectors are one entry
with a weight.  The index is approximate: a linked pair that shares too few pivots is missed (recall is
measured in the tests and the README); no pair below the threshold is ever linked.
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
from residua.session import durable

THRESHOLD = 0.9
PREFIX, SHARED = 8, 2
PIVOTS_LEAST, PIVOTS_MOST = 32, 4096
APART = 0.7  # largest cosine of two pivots
TILE = 1024


def pivots_for(n: int) -> int:
    """About four times the square root of the row count, within bounds: lists then grow as the root."""
    return int(min(max(4 * n**0.5, PIVOTS_LEAST), PIVOTS_MOST))


def spread_out(units: np.ndarray, apart: float) -> np.ndarray:
    """The rows, in sorted order, that are not closer than ``apart`` to an earlier one: a large group of copies
    in the sample would else supply many pivots whose order is noise."""
    units = units[np.lexsort(units.T[::-1])]
    taken: list[int] = []
    for i in range(len(units)):
        if not taken or (units[taken] @ units[i]).max() < apart:
            taken.append(i)
    return units[taken]


def _unit(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), -1)


def nearest(units: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of the nearest pivots in order of cosine."""
    k = min(prefix, len(pivots))
    out = np.empty((len(units), k), np.int32)
    for lo in range(0, len(units), 2048):
        s = units[lo : lo + 2048] @ pivots.T
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out[lo : lo + 2048] = np.take_along_axis(top, np.lexsort((top, -np.take_along_axis(s, top, 1)), axis=1), 1)
    return out


def link_tile(
    ids: np.ndarray, weights: np.ndarray, units: np.ndarray, prefixes: np.ndarray, side: np.ndarray, pivot: int, threshold: float, shared: int
) -> tuple[np.ndarray, np.ndarray]:
    """Weighted link counts of the rows, and the row of least id in each row's component of the tile's links.
    Only pairs whose first shared pivot is this list's, and across the two sides if there are two."""
    n = len(ids)
    two = bool(side.any())
    rows, cols = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(n), np.arange(n))
    order = np.unique(prefixes)
    member = np.zeros((n, len(order)), np.float32)
    member[np.repeat(np.arange(n), prefixes.shape[1]), np.searchsorted(order, prefixes.ravel())] = 1
    before = order < pivot
    by_id = np.argsort(ids, kind="stable")
    place = np.empty(n, np.int64)
    place[by_id] = np.arange(n)
    count, root = np.zeros(n, np.int64), np.arange(n)
    for lo in range(0, len(rows), 512):
        r = rows[lo : lo + 512]
        ok = units[r] @ units[cols].T >= threshold
        if not ok.any():
            continue
        ok &= member[r] @ member[cols].T >= min(shared, prefixes.shape[1])
        ok &= member[r][:, before] @ member[cols][:, before].T == 0
        ok &= r[:, None] != cols[None, :]
        i, j = np.nonzero(ok)
        i, j = r[i], cols[j]
        np.add.at(count, i, weights[j])
        if two:
            np.add.at(count, j, weights[i])
        root = _joined(root, place[i], place[j])
    return count, by_id[root[place]]


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least member of each component once links (i, j) are added to components given by ``root``."""
    while True:
        x, y = root[i], root[j]
        apart = x != y
        if not apart.any():
            return root
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        root = root.copy()
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, prefix: int = PREFIX,
    shared: int = SHARED, pivots: int | None = None,
) -> DataFrame:
    """One row (key, n_links, component_id, kept) per vector.

    Vectors that are null, zero, of another length than most of the pivots, or hold null or non-finite
    components link with nothing.  ``n_links`` counts the other rows linked directly, ``component_id`` is the
    least key reachable by links, ``kept`` marks the row with that key.  Repeated rows are links of each
    other.  A null key links with nothing and keeps a null component.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    values = F.transform(F.col(embedding), lambda x: x.cast("double"))
    good = F.coalesce(
        (F.size(embedding) > 0) & F.forall(values, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(values, lambda x: x != 0),
        F.lit(False),
    ) & F.col(key).isNotNull()
    clean = vectors.where(good).select(key, values.alias("x"))
    distinct = durable(clean.groupBy("x").agg(F.min(key).alias("rep"), F.count(F.lit(1)).alias("weight")).select("rep", "weight", "x"))
    sizes = {r["d"]: r["n"] for r in distinct.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    links = None
    for dim, n in sorted(sizes.items()):
        own = _links(distinct.where(F.size("x") == dim), n, pivots or pivots_for(n), threshold, prefix, shared)
        links = own if links is None else links.unionByName(own)
    everything = vectors.select(F.col(key), F.when(good, values).alias("x"))
    if links is None:
        return everything.select(key, F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id"), F.col(key).isNotNull().alias("kept"))
    links = durable(links)
    direct = links.groupBy("rep").agg(F.sum("n").alias("n"))
    placed = connected_components(links.select(F.col("rep").alias("a"), F.col("other").alias("b")).where("a <> b").distinct())
    found = (
        distinct.join(direct, "rep", "left").join(placed.withColumnRenamed("node", "rep"), "rep", "left")
        .select(F.struct("x").alias("k"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    )
    return everything.withColumn("k", F.struct("x")).join(found, "k", "left").select(
        key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", key).alias("component_id"),
        F.coalesce(F.coalesce("c", key) == F.col(key), F.lit(False)).alias("kept"),
    )


def _links(distinct: DataFrame, n: int, n_pivots: int, threshold: float, prefix: int, shared: int) -> DataFrame:
    """(rep, other, n): weighted links found in each tile, and the least vector of the component there."""
    spark = distinct.sparkSession
    share = min(1.0, 2.0 * n_pivots / n)
    drawn = distinct.where(F.pmod(F.xxhash64("x", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("x").orderBy(F.xxhash64("x", F.lit(11)), "x").limit(n_pivots).collect()
    raw = np.array([r["x"] for r in drawn] or [distinct.select("x").first()[0]], float)
    table = spark.sparkContext.broadcast(spread_out(raw / np.linalg.norm(raw, axis=1, keepdims=True), APART))
    rep_type = distinct.schema["rep"].dataType
    kind = T.StructType([T.StructField("rep", rep_type), *chunks.shape("weight long, unit binary, nearest binary, pivots ints").fields])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column("x").to_pylist(), float)
            x /= np.abs(x).max(1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            near = nearest(x, table.value, prefix)
            yield pa.RecordBatch.from_arrays(
                [b.column("rep"), b.column("weight"), pa.array([r.tobytes() for r in x]), pa.array([r.tobytes() for r in near]), pa.array(list(near), pa.list_(pa.int32()))],
                schema=chunks.arrow_schema(kind),
            )

    described = durable(distinct.mapInArrow(describe, kind))
    listed = described.select("rep", F.explode("pivots").alias("pivot"))
    tiles = listed.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    entry = (
        described.select("rep", "weight", "unit", "nearest", F.explode("pivots").alias("pivot")).join(F.broadcast(tiles), "pivot")  # one row a pivot
        .withColumn("t", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
        .withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("rep", "weight", "unit", "nearest", "pivot", F.least("t", "u").alias("t1"), F.greatest("t", "u").alias("t2"), (F.col("t") > F.col("u")).cast("int").alias("side"))
    )
    out = T.StructType([T.StructField("rep", rep_type), T.StructField("other", rep_type), T.StructField("n", T.LongType())])

    def compare(group: pa.Table) -> pa.Table:
        ids = np.array(group.column("rep").to_pylist())
        near = np.frombuffer(b"".join(group.column("nearest").to_pylist()), np.int32).reshape(len(ids), -1)
        count, least = link_tile(
            ids, group.column("weight").to_numpy(), _unit(group.column("unit").to_pylist()), near, group.column("side").to_numpy(), group.column("pivot")[0].as_py(), threshold, shared
        )
        hit = np.flatnonzero(count)
        rep = group.column("rep").combine_chunks()
        return pa.Table.from_arrays([rep.take(pa.array(hit)), rep.take(pa.array(least[hit])), pa.array(count[hit])], schema=chunks.arrow_schema(out))

    return entry.groupBy("pivot", "t1", "t2").applyInArrow(compare, out)
