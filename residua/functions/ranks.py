"""Global order without a one-task window.

``with_position`` range-partitions and sorts once; ``monotonically_increasing_id`` then
holds (partition, index inside it), so a global position needs only the partition sizes.
The sorted rows are materialised first because range bounds are sampled per execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.session import durable

BLOCK_ROWS = 1 << 16
_INDEX_BITS = 33


def _ordered(df: DataFrame, order: list[str]) -> DataFrame:
    return durable(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__mid", F.monotonically_increasing_id())
    )


def _part() -> Column:
    return F.shiftright(F.col("__mid"), _INDEX_BITS).cast("int")


def _offsets(rows: list, n_fields: int) -> list[list]:
    """Exclusive running totals of per-partition sums, indexed by partition number."""
    size = max((r["part"] for r in rows), default=-1) + 1
    by_part = {r["part"]: r for r in rows}
    totals = [[0] * size for _ in range(n_fields)]
    running = [0] * n_fields
    for part in range(size):
        for f in range(n_fields):
            totals[f][part] = running[f]
            if part in by_part:
                running[f] += by_part[part][f + 1] or 0
    return totals


def _lookup(values: list, kind: str) -> Column:
    array = F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")
    return F.element_at(array, _part() + 1)


def with_position(df: DataFrame, order: list[str], pos: str = "pos") -> DataFrame:
    """Add the 0-based position of each row in the order of ``order`` (must be unique)."""
    stable = _ordered(df, order)
    sizes = stable.groupBy(_part().alias("part")).agg(F.count("*")).collect()
    if not sizes:
        return stable.withColumn(pos, F.lit(0).cast("long")).drop("__mid")
    (offsets,) = _offsets(sizes, 1)
    index = F.col("__mid").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    return stable.withColumn(pos, index + _lookup(offsets, "long")).drop("__mid")


def running_sums(df: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Inclusive running totals over the global order of (unique) ``order`` columns."""
    stable = _ordered(df, order)
    rows = stable.groupBy(_part().alias("part")).agg(*[F.sum(c) for c in sums.values()]).collect()
    if not rows:
        return stable.select("*", *[F.lit(0.0).alias(n) for n in sums]).drop("__mid")
    offsets = _offsets(rows, len(sums))
    w = Window.partitionBy("__part").orderBy("__mid").rowsBetween(Window.unboundedPreceding, 0)
    out = stable.withColumn("__part", _part())
    for (n, c), values in zip(sums.items(), offsets):
        kind = "double" if any(isinstance(v, float) for v in values) else "long"
        out = out.withColumn(n, F.sum(c).over(w) + _lookup(values, kind))
    return out.drop("__mid", "__part")


def with_blocks(df: DataFrame, pos: str, halo: int, block_rows: int | None = None) -> DataFrame:
    """Cut an ordered table into equal blocks; each block also gets the last ``halo`` rows
    of the block before it (``own`` is false for those), so lags and trailing frames of up
    to ``halo`` rows can be computed per block."""
    block_rows = max(block_rows or BLOCK_ROWS, halo + 1)
    home = F.floor(F.col(pos) / F.lit(block_rows))
    copies = F.when(
        F.col(pos) % F.lit(block_rows) >= F.lit(block_rows - halo), F.array(home, home + 1)
    ).otherwise(F.array(home))
    return df.withColumn("block", F.explode(copies)).withColumn("own", F.col("block") == home)


def block_window(pos: str):
    return Window.partitionBy("block").orderBy(pos)


def array_split_bin(pos: Column, n_rows: int, n_bins: int) -> Column:
    """Bin of a position when n rows are cut into k runs, the first n mod k one row longer."""
    base, extra = divmod(n_rows, n_bins)
    cut = extra * (base + 1)
    if base == 0:
        return pos.cast("int")
    return (
        F.when(pos < F.lit(cut), F.floor(pos / F.lit(base + 1)))
        .otherwise(F.lit(extra) + F.floor((pos - F.lit(cut)) / F.lit(base)))
        .cast("int")
    )
