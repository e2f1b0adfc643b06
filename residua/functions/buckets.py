"""Assign values to many sorted cut points without a join or a Python UDF."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_bucket(df: DataFrame, value: str, cuts: list[float], out: str) -> DataFrame:
    """Add ``out`` = number of cuts <= value (JVM binary search; null stays null)."""
    cuts = sorted(set(cuts))
    if not cuts:
        return df.withColumn(out, F.when(F.col(value).isNotNull(), F.lit(0)))
    splits = [-float("inf"), *[c for c in cuts if abs(c) != float("inf")], float("inf")]
    model = Bucketizer(splits=splits, inputCol=value, outputCol="__bucket_f", handleInvalid="keep")
    return (
        model.transform(df)
        .withColumn(out, F.when(F.col(value).isNotNull(), F.col("__bucket_f").cast("int")))
        .drop("__bucket_f")
    )


def interval_index(c: Column, edges: list[float]) -> Column:
    """0-based index of the right-closed interval (edges[i], edges[i+1]] holding ``c``;
    the lowest edge belongs to the first interval.  Null/NaN/outside -> null."""
    chain = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        lower = c >= F.lit(edges[0]) if i == 0 else c > F.lit(edges[i])
        chain = F.when(lower & (c <= F.lit(edges[i + 1])), F.lit(i)).otherwise(chain)
    return F.when(~F.isnan(c), chain)
