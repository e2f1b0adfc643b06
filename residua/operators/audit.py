"""How often the scan finds something where there is nothing, and votes across folds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.functions import expr
from residua.functions.dist import binomial_upper, kolmogorov_sf
from residua.functions.hashing import digest
from residua.operators.scan import BinSpec, bh_adjust, ks_flags, ks_scan, value_cuts
from residua.session import durable, release, spread

MAX_FPR, ALPHA, MIN_HALF = 0.07, 0.05, 10


def null_scan(df: DataFrame, key: str, residual: str, replicates: int = 20, features: int = 6, seed: int = 42) -> DataFrame:
    """Residuals split in two random halves, once per replicate and pretend feature.

    A random split is what a median split of an unrelated feature looks like.  All splits are
    scanned together; D between the halves follows from D of one half against all rows.
    """
    n_splits = replicates * features
    # the first hex digit of a word says on which side of 0.5 its draw is
    words = F.concat(*[digest(F.col("k"), f"null{seed}:{c}") for c in range((n_splits + 3) // 4)])
    e = F.col(residual).cast("double")
    keyed = df.where(e.isNotNull() & ~F.isnan(e)).select(e.alias("e"), F.col(key).cast("string").alias("k"))
    hashed = spread(keyed).select("e", words.alias("words"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = np.zeros((b.num_rows, n_splits), bool)
            for at, drawn in enumerate(b.column(1)):
                if drawn.is_valid:  # a row without key is in the upper half of every split
                    low[at] = np.frombuffer(drawn.as_buffer(), np.uint8)[: 8 * n_splits : 8] < ord("8")
            bits = np.packbits(low, axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in bits], pa.binary())], ["e", "bits"])

    flagged = durable(hashed.mapInArrow(pack, "e double, bits binary"))
    n, sizes, distances = ks_flags(flagged, n_splits)
    release(flagged)
    found = [(i, size, n, d) for i, (size, d) in enumerate(zip(sizes, distances, strict=True)) if min(size, n - size) >= MIN_HALF]
    tests = df.sparkSession.createDataFrame(found, "i int, sample_count long, n_total long, ks_stat double")  # a row a split
    w = F.col("sample_count") / F.col("n_total")
    en = F.col("sample_count") * (F.col("n_total") - F.col("sample_count")) / F.col("n_total")
    halves = tests.select(
        F.floor(F.col("i") / features).cast("int").alias("replicate"), (F.col("i") % features).alias("feature"), "sample_count",
        (F.col("ks_stat") / (F.lit(1.0) - w)).alias("stat"), F.sqrt(en).alias("root_en"),
    )
    return halves.select(
        "replicate", "feature", "sample_count", F.col("stat").alias("ks_stat"),
        kolmogorov_sf(F.col("root_en") * F.col("stat")).alias("p_value"),
    )


def false_positive_audit(df: DataFrame, key: str, residual: str, replicates: int = 20, features: int = 6, seed: int = 42, limit: float = MAX_FPR) -> DataFrame:
    """Share of null replicates with any significant split, its exact upper bound, pass/fail."""
    tests = null_scan(df, key, residual, replicates, features, seed)
    hits = (
        tests.groupBy("replicate").agg(F.min("p_value").alias("p")).where(F.col("p") < ALPHA / features).count()
    )
    upper = binomial_upper(hits, replicates)
    return df.sparkSession.createDataFrame(
        [(replicates, hits, hits / replicates, upper, "pass" if upper <= limit else "fail")],
        "runs int, false_positive_runs int, empirical_fpr double, upper_95 double, status string",
    )


def discovery_votes(df: DataFrame, specs: list[BinSpec], residual: str, folds: int = 5, min_votes: int = 3, min_effect: float = 0.15, alpha: float = 0.05, min_bin_rows: int = 20) -> DataFrame:
    """Scan each fold's complement and count in how many a bin is found.  The folds are written once, and all scans
    start from the value ranges of all rows."""
    found = None
    used = dict.fromkeys(["fold", residual, *[s.column for s in specs]])
    df = durable(spread(df.select(*[expr.col(c).alias(c) for c in used])))
    cuts = value_cuts(df, residual)
    for k in range(folds):
        tests = bh_adjust(ks_scan(df.where(F.col("fold") != k), specs, residual, min_bin_rows, cuts=cuts))
        hit = tests.where((F.col("adjusted_p_value") <= alpha) & (F.abs("effect_size") > min_effect)).select(
            "column_name", "bin_value", F.lit(k).alias("k")
        )
        found = hit if found is None else found.unionByName(hit)
    return (
        found.groupBy("column_name", "bin_value").agg(F.count("*").alias("votes"))
        .withColumn("stable", F.col("votes") >= min_votes)
    )
