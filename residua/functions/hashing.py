"""Repeatable pseudo-random numbers derived from row keys.

A draw depends only on the key and a salt, so results do not change when rows are
re-partitioned or a task is retried (``rand`` and ``randomSplit`` do change).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# P(X <= k) for X ~ Poisson(1); fixed values, enough terms for a 32-bit draw.
POISSON1_CDF = [
    0.36787944117144233,
    0.7357588823428847,
    0.9196986029286058,
    0.9810118431238462,
    0.9963401531726563,
    0.9994058151824183,
    0.999916758850712,
    0.9999898050815368,
    0.9999988746033529,
    0.9999998885745217,
    0.9999999899516108,
]


def digest(key: Column, salt: str | Column) -> Column:
    """md5 of ``key:salt`` as 32 hex digits: four independent 32-bit draws."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    return F.md5(F.concat(key.cast("string"), F.lit(":"), salt.cast("string")).cast("binary"))


def draw(hex_digest: Column, slot: int = 0) -> Column:
    """The ``slot``-th (0-3) uniform number in [0, 1) held in a digest."""
    word = F.conv(F.substring(hex_digest, 8 * slot + 1, 8), 16, 10)
    return word.cast("double") / F.lit(4294967296.0)


def uniform(key: Column, salt: str | Column) -> Column:
    """Uniform number in [0, 1) for a key."""
    return draw(digest(key, salt))


def bucket_of(key: Column, salt: str, n: int) -> Column:
    """Uniform integer in [0, n) for a key."""
    return F.floor(uniform(key, salt) * F.lit(float(n))).cast("int")


def word(hex_digest: Column, slot: Column | int = 0) -> Column:
    """The 8 hex digits behind a draw.  Equal-length lower-case hex compares like the number,
    so thresholds can be tested without converting it."""
    if isinstance(slot, int):
        return F.substring(hex_digest, 8 * slot + 1, 8)
    return F.substr(hex_digest, slot * 8 + 1, F.lit(8))


def below(hex_word: Column, share: float) -> Column:
    """Whether the draw in a word is smaller than ``share``."""
    limit = math.ceil(share * 4294967296.0)
    if limit >= 1 << 32:
        return F.lit(True)
    return hex_word < F.lit(f"{max(0, limit):08x}")


def poisson_weight(hex_word: Column) -> Column:
    """Poisson(1) resampling weight of a draw (inverse CDF)."""
    expr = F.lit(len(POISSON1_CDF))
    for k in range(len(POISSON1_CDF) - 1, -1, -1):
        expr = F.when(below(hex_word, POISSON1_CDF[k]), F.lit(k)).otherwise(expr)
    return expr.cast("int")


def with_draws(df: DataFrame, key: Column, salt: str, n: int, index: str, out: str) -> DataFrame:
    """``n`` draws per row, one output row each: ``index`` 0..n-1 and the hex word ``out``.  One
    md5 serves four draws, and both expansions stream inside the scan's stage."""
    chunks = df.select("*", key.cast("string").alias("__k"), F.explode(F.sequence(F.lit(0), F.lit((n - 1) // 4))).alias("__chunk"))
    hexed = chunks.withColumn("__h", digest(F.col("__k"), F.concat(F.lit(f"{salt}:"), F.col("__chunk").cast("string"))))
    slots = hexed.select("*", F.explode(F.array(*[F.lit(s) for s in range(4)])).alias("__slot"))
    drawn = slots.withColumn(index, F.col("__chunk") * 4 + F.col("__slot")).withColumn(out, word(F.col("__h"), F.col("__slot")))
    if n % 4:
        drawn = drawn.where(F.col(index) < n)
    return drawn.drop("__k", "__chunk", "__h", "__slot")
