"""Exact quantiles that never gather a whole column in one task.

Spark's ``percentile`` keeps every distinct value of a group in one reducer, which is
fine for a bounded table and fatal for an unbounded one.  Here it is used only below a
checked row bound.  Above it, quantiles are found by selection: a mergeable sketch gives
a bracket around the wanted rank, exact counts place the rank inside the bracket, and the
bracket shrinks until few enough distinct values are left to read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.functions.buckets import add_bucket

SMALL_ROWS = 2_000_000
READ_LIMIT = 20_000
SKETCH_ACCURACY = 10_000
GROUP_CUTS = 512


@dataclass
class _Target:
    column: str
    rank: int
    lo: float | None = None
    hi: float | None = None
    below: int = 0
    inside: int = 0
    value: float | None = None


def _place(n: int, p: float) -> tuple[int, int, float]:
    h = (n - 1) * p
    low = min(int(math.floor(h + 1e-12)), n - 1)
    return low, min(low + 1, n - 1), max(0.0, h - low)


def exact_quantiles(
    df: DataFrame,
    columns: dict[str, Column],
    probs: list[float],
    small_rows: int | None = None,
    read_limit: int | None = None,
) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles of several columns (nulls and NaN ignored)."""
    small_rows = SMALL_ROWS if small_rows is None else small_rows
    read_limit = READ_LIMIT if read_limit is None else read_limit
    names = list(columns)
    work = df.select(
        *[F.when(~F.isnan(c.cast("double")), c.cast("double")).alias(n) for n, c in columns.items()]
    )
    counts = work.agg(*[F.count(F.col(n)).alias(n) for n in names]).first()
    if max(counts) <= small_rows:
        probe = F.array(*[F.lit(float(p)) for p in probs])
        row = work.agg(*[F.percentile(F.col(n), probe).alias(n) for n in names]).first()
        return {n: list(row[n]) if row[n] is not None else [None] * len(probs) for n in names}
    return _select(work, names, {n: counts[n] for n in names}, probs, read_limit)


def _select(
    work: DataFrame, names: list[str], counts: dict[str, int], probs: list[float], read_limit: int
) -> dict[str, list[float | None]]:
    wanted: dict[tuple[str, int], _Target] = {}
    for n in names:
        for p in probs:
            if counts[n]:
                low, high, _ = _place(counts[n], p)
                for rank in (low, high):
                    wanted[n, rank] = _Target(n, rank, inside=counts[n])
    targets = list(wanted.values())
    while True:
        active = [t for t in targets if t.value is None and t.inside > read_limit]
        if not active:
            break
        _shrink(work, active)
    _read(work, [t for t in targets if t.value is None])
    result: dict[str, list[float | None]] = {}
    for n in names:
        values: list[float | None] = []
        for p in probs:
            if not counts[n]:
                values.append(None)
                continue
            low, high, frac = _place(counts[n], p)
            a, b = wanted[n, low].value, wanted[n, high].value
            values.append(a if frac == 0 or a == b else a + (b - a) * frac)
        result[n] = values
    return result


def _inside(t: _Target) -> Column:
    c = F.col(t.column)
    cond = c.isNotNull()
    if t.lo is not None:
        cond = cond & (c >= F.lit(t.lo))
    if t.hi is not None:
        cond = cond & (c <= F.lit(t.hi))
    return cond


def _shrink(work: DataFrame, active: list[_Target]) -> None:
    """Two scans: sketch a narrower bracket per target, then count it exactly.  Targets that
    still share a bracket share a sketch."""
    slack = 3.0 / SKETCH_ACCURACY
    shared: dict[tuple, list[_Target]] = {}
    for t in active:
        shared.setdefault((t.column, t.lo, t.hi), []).append(t)
    sketches = []
    for i, group in enumerate(shared.values()):
        marks = []
        for t in group:
            share = (t.rank - t.below) / max(1, t.inside - 1)
            marks += [max(0.0, share - slack), min(1.0, share + slack)]
        masked = F.when(_inside(group[0]), F.col(group[0].column))
        sketches.append(F.percentile_approx(masked, marks, SKETCH_ACCURACY).alias(f"q{i}"))
    row = work.agg(*sketches).first()
    seen = {}
    for i, group in enumerate(shared.values()):
        for j, t in enumerate(group):
            seen[id(t)] = (row[f"q{i}"][2 * j], row[f"q{i}"][2 * j + 1])
    checks = []
    for i, t in enumerate(active):
        lo, hi = seen[id(t)]
        c = F.col(t.column)
        checks += [
            F.count_if(c < F.lit(lo)).alias(f"lt{i}"),
            F.count_if(c == F.lit(lo)).alias(f"elo{i}"),
            F.count_if(c < F.lit(hi)).alias(f"lth{i}"),
            F.count_if(c == F.lit(hi)).alias(f"ehi{i}"),
        ]
    exact = work.agg(*checks).first()
    for i, t in enumerate(active):
        lo, hi = seen[id(t)]
        lt, elo, lth, ehi = (exact[f"{k}{i}"] for k in ("lt", "elo", "lth", "ehi"))
        end = t.below + t.inside
        if lt <= t.rank < lt + elo:
            t.value = lo
        elif lth <= t.rank < lth + ehi:
            t.value = hi
        elif t.rank < lt:
            t.hi, t.inside = math.nextafter(lo, -math.inf), lt - t.below
        elif t.rank >= lth + ehi:
            t.lo, t.below = math.nextafter(hi, math.inf), lth + ehi
            t.inside = end - t.below
        else:
            t.lo, t.hi = math.nextafter(lo, math.inf), math.nextafter(hi, -math.inf)
            t.below, t.inside = lt + elo, lth - lt - elo


def _read(work: DataFrame, targets: list[_Target]) -> None:
    """Read the few distinct values left in each bracket (bounded by the read limit)."""
    if not targets:
        return
    entries = [
        F.struct(F.lit(i).alias("t"), F.when(_inside(t), F.col(t.column)).alias("v"))
        for i, t in enumerate(targets)
    ]
    rows = (
        work.select(F.explode(F.filter(F.array(*entries), lambda s: s["v"].isNotNull())).alias("s"))
        .groupBy("s.t", "s.v").count().collect()
    )
    by_target: dict[int, list[tuple[float, int]]] = {}
    for r in rows:
        by_target.setdefault(r["t"], []).append((r["v"], r["count"]))
    for i, t in enumerate(targets):
        position = t.below
        for value, count in sorted(by_target[i]):
            position += count
            if position > t.rank:
                t.value = value
                break


def grouped_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    small_rows: int | None = None,
) -> DataFrame:
    """Exact quantiles per group: ``keys`` plus one column per entry of ``probs``.

    Above the row bound a group is cut into value ranges, so no task holds a whole group:
    range counts locate the wanted ranks, and only the ranges that hold them are sorted.
    """
    small_rows = SMALL_ROWS if small_rows is None else small_rows
    data = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(
        *keys, F.col(value).cast("double").alias("__v")
    )
    if data.count() <= small_rows:
        return data.groupBy(*keys).agg(
            *[F.percentile("__v", F.lit(float(p))).alias(n) for n, p in probs.items()]
        )
    marks = [i / GROUP_CUTS for i in range(1, GROUP_CUTS)]
    cuts = data.agg(F.percentile_approx("__v", marks, SKETCH_ACCURACY)).first()[0]
    counted = add_bucket(data.groupBy(*keys, "__v").agg(F.count("*").alias("__c")), "__v", cuts, "__b")
    per_range = counted.groupBy(*keys, "__b").agg(F.sum("__c").alias("__rc"))
    ahead = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    placed = per_range.withColumn("__before", F.coalesce(F.sum("__rc").over(ahead), F.lit(0))).withColumn(
        "__n", F.sum("__rc").over(Window.partitionBy(*keys))
    )
    wants = []
    for n, p in probs.items():
        h = (F.col("__n") - 1) * F.lit(float(p))
        low = F.floor(h + 1e-12)
        wants += [
            F.struct(F.lit(n).alias("q"), F.lit(side).alias("side"), rank.alias("rank"), (h - low).alias("frac"))
            for side, rank in ((0, low), (1, F.least(low + 1, F.col("__n") - 1)))
        ]
    targets = placed.select("*", F.explode(F.array(*wants)).alias("w")).where(
        (F.col("w.rank") >= F.col("__before")) & (F.col("w.rank") < F.col("__before") + F.col("__rc"))
    )
    inside = counted.join(targets.select(*keys, "__b").distinct(), [*keys, "__b"], "left_semi")
    upto = Window.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    located = inside.withColumn("__upto", F.sum("__c").over(upto)).join(
        targets.select(*keys, "__b", "__before", "w"), [*keys, "__b"]
    )
    offset = F.col("w.rank") - F.col("__before")
    hits = located.where((F.col("__upto") > offset) & (F.col("__upto") - F.col("__c") <= offset))
    sums = []
    for n in probs:
        low = F.max(F.when((F.col("w.q") == n) & (F.col("w.side") == 0), F.col("__v")))
        high = F.max(F.when((F.col("w.q") == n) & (F.col("w.side") == 1), F.col("__v")))
        frac = F.greatest(F.lit(0.0), F.max(F.when(F.col("w.q") == n, F.col("w.frac"))))
        sums.append((low + (high - low) * frac).alias(n))
    return hits.groupBy(*keys).agg(*sums)
