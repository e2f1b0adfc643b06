"""Subgroup scan: bin every feature, compare each bin's residuals with all residuals."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.functions import expr
from residua.functions.buckets import add_bucket, interval_index
from residua.functions.dist import kolmogorov_sf
from residua.functions.moments import SLOTS, summed_arrays
from residua.functions.quantiles import SKETCH_ACCURACY, exact_quantiles
from residua.functions.ranks import with_position
from residua.session import durable, spread

MIN_RANGES, MAX_RANGES, SUB_RANGES = 512, 8192, 1024
SORT_ROWS = 200_000_000
FLAG_RANGES = 1024  # value ranges of ``ks_flags``
BROADCAST_ROWS = 200_000
BH_BLOCK = 1 << 16  # rows of one block of the p-value order


@dataclass(frozen=True)
class BinSpec:
    """How one feature is cut.  ``edges`` set: right-closed intervals; else one bin per value."""

    column: str
    edges: tuple[float, ...] | None = None

    def index(self) -> Column:
        """Interval number; -1 for a per-value bin; null where the row has no bin."""
        c = expr.col(self.column)
        if self.edges is None:
            return F.when(c.isNotNull(), F.lit(-1))
        if len(self.edges) == 1:
            return F.when(c.cast("double") == F.lit(self.edges[0]), F.lit(0))
        return interval_index(c.cast("double"), list(self.edges))

    def value(self) -> Column:
        """The bin's value for per-value bins, empty text for intervals."""
        return expr.col(self.column).cast("string") if self.edges is None else F.lit("")

    def label(self) -> Column:
        """Readable bin name of a row."""
        if self.edges is None:
            return expr.col(self.column).cast("string")
        return F.get(F.array(*[F.lit(t) for t in self.labels()]), self.index())

    def labels(self) -> list[str]:
        if self.edges is None:
            return []
        if len(self.edges) == 1:
            return [repr(self.edges[0])]
        return [interval_label(self.edges, i) for i in range(len(self.edges) - 1)]


def interval_label(edges: tuple[float, ...], i: int) -> str:
    opening = "[" if i == 0 else "("
    return f"{opening}{edges[i]!r}, {edges[i + 1]!r}]"


def quantile_specs(df: DataFrame, columns: list[str], n_bins: int = 5) -> list[BinSpec]:
    """Quantile edges for numeric features (duplicate edges dropped, a constant column is one
    bin); the other features keep one bin per value."""
    numeric = [c for c in columns if expr.is_numeric(df.schema[c])]
    edges = {}
    if numeric:
        probs = [i / n_bins for i in range(n_bins + 1)]
        edges = exact_quantiles(df, {c: expr.col(c) for c in numeric}, probs)
    specs = []
    for c in columns:
        if c not in edges:
            specs.append(BinSpec(c))
        elif edges[c][0] is not None:
            specs.append(BinSpec(c, tuple(sorted(set(edges[c])))))
    return specs


def equal_width_specs(df: DataFrame, columns: list[str], n_bins: int = 5) -> list[BinSpec]:
    """Equal-width cuts between the minimum and the maximum."""
    aggs = []
    for i, c in enumerate(columns):
        v = expr.as_double(expr.col(c))
        aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    specs = []
    for i, c in enumerate(columns):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        if lo is None:
            continue
        step = (hi - lo) / n_bins
        edges = [lo + step * k for k in range(n_bins)] + [hi]
        specs.append(BinSpec(c, tuple(sorted(set(edges)))))
    return specs


BIN = ["spec", "part", "value"]


def _long(df: DataFrame, specs: list[BinSpec], keep: list[str], with_all: bool) -> DataFrame:
    """One row per (row, feature) with a compact bin key; rows without a bin are dropped."""
    entries = [
        F.struct(F.lit(n).alias("spec"), s.index().alias("part"), s.value().alias("value"))
        for n, s in enumerate(specs)
    ]
    if with_all:
        entries.append(F.struct(F.lit(-1).alias("spec"), F.lit(-1).alias("part"), F.lit("").alias("value")))
    bins = F.filter(F.array(*entries), lambda s: s["part"].isNotNull())
    return df.select(*keep, F.explode(bins).alias("m")).select(*keep, "m.*")


def _named(df: DataFrame, specs: list[BinSpec]) -> DataFrame:
    """Replace the compact key by column_name, bin_index and bin_value."""
    names = F.array(*[F.lit(s.column) for s in specs])
    labels = F.array(*[F.array(*[F.lit(t) for t in s.labels()]).cast("array<string>") for s in specs])
    per_value = F.col("part") < 0
    return df.select(
        F.get(names, F.col("spec")).alias("column_name"),
        F.when(~per_value, F.col("part")).alias("bin_index"),
        F.when(per_value, F.col("value")).otherwise(F.get(F.get(labels, F.col("spec")), F.col("part"))).alias("bin_value"),
        *[c for c in df.columns if c not in BIN],
    )


def memberships(df: DataFrame, specs: list[BinSpec], keep: list[str]) -> DataFrame:
    """Long form of all (feature, bin) memberships."""
    return _named(_long(df, specs, keep, False), specs)


def bin_stats(df: DataFrame, specs: list[BinSpec], residual: str) -> DataFrame:
    """Size, mean and spread of each bin and its effect against all rows.  Aggregated before
    the shuffle, so the unpivoted rows never travel."""
    long = _long(df.where(F.col(residual).isNotNull()), specs, [residual], with_all=True)
    stats = long.groupBy(*BIN).agg(
        F.count("*").alias("sample_count"),
        F.avg(residual).alias("mean_residual"),
        F.stddev_pop(residual).alias("std_residual"),
    )
    return _named(_with_effect(stats), specs)


def _with_effect(stats: DataFrame) -> DataFrame:
    whole = stats.where(F.col("spec") < 0).select(
        F.col("sample_count").alias("n_total"),
        F.col("mean_residual").alias("mean_all"),
        F.col("std_residual").alias("std_all"),
    )
    effect = F.when(
        F.col("std_all") > 0, (F.col("mean_residual") - F.col("mean_all")) / F.col("std_all")
    ).otherwise(F.lit(0.0))
    # `whole` is a one-row aggregate, so its broadcast has a fixed size.
    return stats.where(F.col("spec") >= 0).join(F.broadcast(whole)).withColumn("effect_size", effect)


def ks_scan(
    df: DataFrame,
    specs: list[BinSpec],
    residual: str,
    min_bin_rows: int = 20,
    ranges: int | None = None,
    sort_rows: int = SORT_ROWS,
    cuts: list[float] | None = None,
) -> DataFrame:
    """Exact two-sample KS statistic of every bin against the whole sample (bin included),
    with effect size and asymptotic p-value.

    Residuals are cut into value ranges.  Counts per (bin, range) give both ECDFs exactly at
    the range borders and bound their distance inside each range; only ranges whose bound
    beats the best border distance stay open.  While the open ranges hold too many rows they
    are cut again; the rest is sorted.  The result is exact, while almost all rows are reduced
    to counts before any shuffle.  Scans of parts of one table can share their ``cuts``.
    """
    columns = list(dict.fromkeys([s.column for s in specs]))
    base = _scanned(df, residual, columns)
    if cuts is None:
        cuts = value_cuts(df, residual, ranges)
    ranged = add_bucket(spread(base), "e", cuts, "r").withColumn("r", F.col("r").cast("long")).withColumn("up", F.lit(0).cast("long"))
    long = _long(ranged, specs, ["e", "up", "r"], with_all=True)
    counts = durable(
        _range_counts(long, F.avg("e").alias("m"), F.var_pop("e").alias("v"))
    )
    tested = _with_effect(_pooled(counts)).where(F.col("sample_count") >= F.lit(min_bin_rows))
    counts = counts.join(tested.select(*BIN), BIN, "left_semi").unionByName(counts.where(F.col("spec") < 0))

    bounds = durable(_bounds(counts, None))
    borders = bounds.groupBy(*BIN).agg(F.max("border").alias("border"))
    while True:
        open_ranges = durable(_open(bounds, borders))
        size = open_ranges.groupBy("up", "r").agg(F.sum("n").alias("n"), F.max("n_all").alias("a")).agg(
            F.count("*").alias("ranges"), F.coalesce(F.sum(F.col("n") + F.col("a")), F.lit(0)).alias("rows")
        ).first()
        if size["rows"] <= sort_rows:
            break
        long = _recut(long, open_ranges)
        bounds = durable(_bounds(_range_counts(long), open_ranges))
        borders = durable(
            borders.unionByName(bounds.select(*BIN, "border")).groupBy(*BIN).agg(F.max("border").alias("border"))
        )
    result = tested.join(borders, BIN)
    stat = F.col("border")
    if size["ranges"]:
        result = result.join(_refine(long, open_ranges), BIN, "left")
        stat = F.greatest(stat, F.coalesce(F.col("refined"), F.lit(0.0)))
    out = result.withColumn("ks_stat", stat)
    en = F.col("sample_count") * F.col("n_total") / (F.col("sample_count") + F.col("n_total"))
    out = out.withColumn("p_value", kolmogorov_sf(F.sqrt(en) * F.col("ks_stat")))
    return _named(out, specs).select(
        "column_name", "bin_index", "bin_value", "sample_count", "n_total", "mean_residual",
        "std_residual", "mean_all", "std_all", "effect_size", "ks_stat", "p_value",
    )


def _scanned(df: DataFrame, residual: str, columns: list[str]) -> DataFrame:
    """The rows that have a residual, as ``e``, with the given columns."""
    base = df.where(F.col(residual).isNotNull() & ~F.isnan(F.col(residual)))
    return base.select(F.col(residual).cast("double").alias("e"), *[expr.col(c) for c in columns])


def value_cuts(df: DataFrame, residual: str, ranges: int | None = None) -> list[float]:
    """Cuts of the residual into ``ranges`` value ranges; as many as the rows ask for if not given."""
    base = _scanned(df, residual, [])
    cuts, n_rows = _cuts(base, ranges or MIN_RANGES)
    wanted = min(MAX_RANGES, int(4 * math.sqrt(n_rows)))
    if ranges is None and wanted > 2 * MIN_RANGES:
        cuts, _ = _cuts(base, wanted)
    return cuts


def ks_flags(rows: DataFrame, n_flags: int, ranges: int = FLAG_RANGES) -> tuple[int, list[int], list[float]]:
    """(rows, rows of each flag, exact KS distance of the flagged rows against all) for rows (e, bits): a number and
    ``n_flags`` flags packed into bytes.  A flag without rows has distance 0.

    One pass counts the flags of every value range, the next walks the rows of a range in order of e for all flags at
    once, starting from the counts before it.  A row is shuffled once, whatever the number of flags.  A value that fills
    a range has one of its own, which needs no walk.
    """
    found, n = _cuts(rows, ranges)
    often = {a for a, b in zip(found, found[1:]) if a == b}
    cuts = np.array(sorted({*found, *[math.nextafter(v, math.inf) for v in often]}))
    size = len(cuts) + 1
    if not n:
        return 0, [0] * n_flags, [0.0] * n_flags

    def unpacked(b: pa.RecordBatch) -> np.ndarray:
        return np.unpackbits(np.frombuffer(b"".join(b.column("bits").to_pylist()), np.uint8).reshape(b.num_rows, -1), axis=1, count=n_flags)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, 1 + n_flags))
        for b in batches:
            if b.num_rows:
                r = np.searchsorted(cuts, b.column("e").to_numpy(), "right")
                order = np.argsort(r, kind="stable")
                held, first = np.unique(r[order], return_index=True)
                total[held, 0] += np.diff([*first, len(r)])
                total[held, 1:] += np.add.reduceat(unpacked(b)[order], first, axis=0, dtype=np.int64)
        slot = TaskContext.get().partitionId() % SLOTS
        yield pa.RecordBatch.from_pydict({"g": pa.array([0], pa.int32()), "slot": pa.array([slot], pa.int32()), "v": [total.tobytes()]})

    counts = summed_arrays(rows.mapInArrow(count, "g int, slot int, v binary"))[0].reshape(size, 1 + n_flags)
    upto = np.cumsum(counts, axis=0)
    before = upto - counts
    sizes = upto[-1, 1:]
    share = np.maximum(sizes, 1.0)
    whole, part = upto[:, :1] / n, upto[:, 1:] / share
    whole_before, part_before = before[:, :1] / n, before[:, 1:] / share
    best = np.abs(whole - part).max(axis=0)
    inside = np.maximum(whole - part_before, part - whole_before)
    single = np.isin(cuts[:-1], list(often)) if often else np.zeros(size - 2, bool)
    walked = ((inside > best) & (sizes > 0)).any(axis=1) & (counts[:, 0] > 1)
    walked[1:-1] &= ~single

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = np.searchsorted(cuts, b.column("e").to_numpy(), "right")
            kept = pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), b.column("e"), b.column("bits")], ["r", "e", "bits"])
            yield kept.filter(pa.array(walked[r]))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, state, last, waiting = np.zeros(n_flags), None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            r, e, flags = b.column("r").to_numpy(), b.column("e").to_numpy(), unpacked(b)
            first = [0, *(np.flatnonzero(np.diff(r)) + 1)]
            for lo, hi in zip(first, [*first[1:], len(r)], strict=True):
                if waiting is not None and last != (r[lo], e[lo]):
                    top = np.maximum(top, waiting)
                if last is None or last[0] != r[lo]:
                    state = before[r[lo]].copy()
                sums = np.cumsum(flags[lo:hi], axis=0, dtype=np.int32)
                ends = np.append(np.flatnonzero(e[lo + 1 : hi] != e[lo : hi - 1]), hi - lo - 1)  # the last of equal values
                gap = np.abs((state[0] + ends + 1)[:, None] / n - (state[1:] + sums[ends]) / share)
                top = np.maximum(top, gap[:-1].max(axis=0, initial=0.0))
                waiting, last = gap[-1], (r[hi - 1], e[hi - 1])  # the next batch may go on with its value
                state[0] += hi - lo
                state[1:] += sums[-1]
        if waiting is not None:
            top = np.maximum(top, waiting)
        yield pa.RecordBatch.from_pydict({"v": [top.tobytes()]})

    if walked.any():
        by_range = rows.mapInArrow(placed, "r int, e double, bits binary").repartition("r").sortWithinPartitions("r", "e")
        for r in by_range.mapInArrow(walk, "v binary").collect():  # a number a flag and task
            best = np.maximum(best, np.frombuffer(r["v"]))
    return n, [int(s) for s in sizes], [float(d) if s else 0.0 for d, s in zip(best, sizes, strict=True)]


def _cuts(base: DataFrame, ranges: int) -> tuple[list[float], int]:
    """Approximate quantiles of ``e`` that cut it into ``ranges`` parts, and the row count."""
    marks = ", ".join(f"{i / ranges}D" for i in range(1, ranges))
    sketch = F.expr(f"percentile_approx(e, array({marks}), {SKETCH_ACCURACY})") if marks else F.lit(None)
    row = base.agg(sketch.alias("q"), F.count("*").alias("n")).first()
    return list(row["q"] or []), row["n"]


def _range_counts(long: DataFrame, *more: Column) -> DataFrame:
    """Rows per (bin, range) with the range's extremes; ``up`` is the range one level above."""
    return long.groupBy(*BIN, "up", "r").agg(
        F.count("*").alias("n"), F.min("e").alias("lo"), F.max("e").alias("hi"), *more
    )


def _pooled(counts: DataFrame) -> DataFrame:
    """Size, mean and spread of each bin from its ranges."""
    parts = counts.groupBy(*BIN).agg(
        F.sum("n").alias("sample_count"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean_residual"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
        F.collect_list(F.struct("n", "m")).alias("parts"),
    )
    # at most MAX_RANGES entries per bin
    between = F.aggregate(
        "parts",
        F.lit(0.0),
        lambda acc, s: acc
        + s["n"] * (s["m"] - F.col("mean_residual")) * (s["m"] - F.col("mean_residual")),
    )
    std = F.sqrt((F.col("within") + between) / F.col("sample_count"))
    return parts.withColumn("std_residual", std).drop("within", "parts")


def _bounds(counts: DataFrame, parents: DataFrame | None) -> DataFrame:
    """Per (bin, range): rows of bin and whole before it, the ECDF distance at its borders and
    the largest distance possible inside.  Windows run over the ranges of one parent."""
    whole_up = Window.partitionBy("up").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    bin_up = Window.partitionBy(*BIN, "up").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    whole = counts.where(F.col("spec") < 0).select(
        "up", "r", F.col("n").alias("n_all"), F.col("lo").alias("lo_all"), F.col("hi").alias("hi_all"),
        F.sum("n").over(whole_up).alias("upto_all"),
    )
    bins = counts.where(F.col("spec") >= 0).select(*BIN, "up", "r", "n", F.sum("n").over(bin_up).alias("upto"))
    if parents is None:
        total = Window.partitionBy(*BIN)
        bins = bins.withColumn("total", F.sum("n").over(total)).withColumn("base", F.lit(0).cast("long"))
        whole = whole.withColumn("total_all", F.sum("n_all").over(Window.partitionBy("up"))).withColumn("base_all", F.lit(0).cast("long"))
    else:
        known = parents.select(*BIN, F.col("r").alias("up"), "total", F.col("before").alias("base"))
        known_all = parents.select(F.col("r").alias("up"), "total_all", F.col("before_all").alias("base_all")).distinct()
        bins, whole = bins.join(known, [*BIN, "up"]), whole.join(known_all, "up")
    both = bins.join(whole, ["up", "r"])
    before = F.col("base") + F.col("upto") - F.col("n")
    before_all = F.col("base_all") + F.col("upto_all") - F.col("n_all")
    a0, a1 = before_all / F.col("total_all"), (before_all + F.col("n_all")) / F.col("total_all")
    b0, b1 = before / F.col("total"), (before + F.col("n")) / F.col("total")
    return both.select(
        *BIN, "up", "r", "n", "n_all", "total", "total_all", "lo_all", "hi_all",
        before.alias("before"), before_all.alias("before_all"),
        F.greatest(F.abs(a0 - b0), F.abs(a1 - b1)).alias("border"),
        F.greatest(a1 - b0, b1 - a0).alias("inside"),
    )


def _open(bounds: DataFrame, borders: DataFrame) -> DataFrame:
    """Ranges that may still hide a larger distance (a single repeated value cannot)."""
    best = borders.withColumnRenamed("border", "best")
    return bounds.join(best, BIN).where(
        (F.col("inside") > F.col("best")) & (F.col("lo_all") < F.col("hi_all"))
    ).drop("border", "inside", "best")


def _inside(long: DataFrame, open_ranges: DataFrame, columns: list[str]) -> DataFrame:
    """The long rows of the open (bin, range) pairs, and all rows of their ranges."""
    bins = open_ranges.select(*BIN, "up", "r", *columns)
    whole = open_ranges.select(
        F.lit(-1).alias("spec"), F.lit(-1).alias("part"), F.lit("").alias("value"), "up", "r", *columns
    ).distinct()
    wanted = bins.unionByName(whole)
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    return long.join(wanted, [*BIN, "up", "r"])


def _recut(long: DataFrame, open_ranges: DataFrame) -> DataFrame:
    """Cut the open ranges into SUB_RANGES equal steps between their extremes."""
    step = (F.col("e") - F.col("lo_all")) / (F.col("hi_all") - F.col("lo_all")) * F.lit(float(SUB_RANGES))
    rows = _inside(long, open_ranges, ["lo_all", "hi_all"])
    return rows.select(
        *BIN, "e", F.col("r").alias("up"),
        (F.col("r") * F.lit(SUB_RANGES) + F.least(F.floor(step), F.lit(SUB_RANGES - 1))).alias("r"),
    )


def _refine(long: DataFrame, open_ranges: DataFrame) -> DataFrame:
    """Exact distance inside the open ranges; equal residuals are counted before the shuffle."""
    rows = _inside(long, open_ranges, []).groupBy("r", *BIN, "e").agg(F.count("*").alias("c"))
    is_all = F.col("spec") < 0
    upto_all = Window.partitionBy("r").orderBy("e").rangeBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy("r", "e")
    upto = Window.partitionBy("r", *BIN).orderBy("e").rowsBetween(Window.unboundedPreceding, 0)
    walked = (
        rows.withColumn("ca", F.when(is_all, F.col("c")).otherwise(F.lit(0)))
        .withColumn("in_all", F.sum("ca").over(upto_all))
        .withColumn("tie_all", F.sum("ca").over(same))
        .withColumn("in_bin", F.sum("c").over(upto))
        .where(~is_all)
    )
    located = walked.join(open_ranges.select(*BIN, "r", "before", "before_all", "total", "total_all"), [*BIN, "r"])
    fa = (F.col("before_all") + F.col("in_all")) / F.col("total_all")
    fb = (F.col("before") + F.col("in_bin")) / F.col("total")
    fa_left = (F.col("before_all") + F.col("in_all") - F.col("tie_all")) / F.col("total_all")
    fb_left = (F.col("before") + F.col("in_bin") - F.col("c")) / F.col("total")
    distance = F.greatest(F.abs(fa - fb), F.abs(fa_left - fb_left))
    return located.groupBy(*BIN).agg(F.max(distance).alias("refined"))


def bh_adjust(tests: DataFrame, p: str = "p_value", out: str = "adjusted_p_value") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values over a result table (one row per test), in blocks of the global
    order of p: a running minimum from the top inside a block, bounded by the minima of the blocks above."""
    ties = ["column_name", "bin_value"] if "bin_value" in tests.columns else []
    placed = durable(with_position(tests, [p, *ties], "__pos"))
    m = placed.count()
    scaled = F.when(F.col(p).isNotNull(), F.col(p) * F.lit(m) / (F.col("__pos") + 1))
    block = F.floor(F.col("__pos") / F.lit(BH_BLOCK)).cast("long")
    ranked = placed.withColumn("__s", scaled).withColumn("__b", block)
    lows = sorted((r["__b"], r["low"]) for r in ranked.groupBy("__b").agg(F.min("__s").alias("low")).collect())
    above, carried = [], 1.0
    for b, low in reversed(lows):
        above.append((b, carried))
        carried = carried if low is None else min(carried, low)
    limits = F.broadcast(tests.sparkSession.createDataFrame(above or [(0, 1.0)], "__b long, __above double"))  # one row a block
    from_top = Window.partitionBy("__b").orderBy(F.desc("__pos")).rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(F.col(p).isNotNull(), F.least(F.col("__above"), F.min("__s").over(from_top)))
    return ranked.join(limits, "__b").withColumn(out, value).drop("__pos", "__s", "__b", "__above")


def subgroup_patterns(
    df: DataFrame,
    features: list[str],
    residual: str,
    n_bins: int = 5,
    min_bin_rows: int = 20,
    min_effect: float = 0.15,
    alpha: float = 0.05,
) -> DataFrame:
    """Bins whose residuals differ significantly and by more than ``min_effect``."""
    tests = bh_adjust(ks_scan(df, quantile_specs(df, features, n_bins), residual, min_bin_rows))
    kept = tests.where(
        (F.col("adjusted_p_value") <= alpha) & (F.abs("effect_size") > min_effect)
    ).withColumn("pattern_type", F.lit("subgroup"))
    return kept.orderBy(F.desc(F.abs("effect_size")), "column_name", "bin_value")


def top_subgroups(tests: DataFrame, k: int = 20) -> DataFrame:
    """Ranked subgroup rules with coverage and weighted relative accuracy."""
    coverage = F.col("sample_count") / F.col("n_total")
    return (
        tests.select(
            F.concat_ws(" in ", "column_name", "bin_value").alias("rule"),
            "column_name",
            "bin_value",
            coverage.alias("coverage"),
            (coverage * (F.col("mean_residual") - F.col("mean_all"))).alias("wracc"),
            "mean_residual",
            F.col("mean_all").alias("mean_outside"),
            "effect_size",
        )
        .orderBy(F.desc(F.abs("effect_size")), "column_name", "bin_value")
        .limit(k)
    )


def in_out_cohens_d(stats: DataFrame) -> DataFrame:
    """Pooled Cohen's d of each bin against its complement; the complement's moments come
    from totals minus the bin's sums, so rows are not read again."""
    n1, n = F.col("sample_count").cast("double"), F.col("n_total").cast("double")
    n2 = n - n1
    s1 = n1 * F.col("mean_residual")
    m2 = F.try_divide(n * F.col("mean_all") - s1, n2)
    q1 = n1 * (F.col("std_residual") * F.col("std_residual") + F.col("mean_residual") * F.col("mean_residual"))
    q = n * (F.col("std_all") * F.col("std_all") + F.col("mean_all") * F.col("mean_all"))
    v2 = F.greatest(F.lit(0.0), F.try_divide(q - q1, n2) - m2 * m2)
    v1 = F.col("std_residual") * F.col("std_residual")
    pooled = F.sqrt(F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, n - 2))
    d = F.when((n1 < 2) | (n2 < 2), F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("mean_residual") - m2, pooled), F.lit(0.0))
    )
    return stats.withColumn("mean_out", m2).withColumn("cohens_d", d)


def beam_search(
    df: DataFrame,
    specs: list[BinSpec],
    residual: str,
    width: int = 10,
    depth: int = 2,
    min_coverage: float = 0.05,
) -> DataFrame:
    """Conjunctive rules by beam search on WRAcc: each level scores the beam's rules extended
    by every single bin in one aggregation (``width`` flags x features entries per row)."""
    base = df.where(F.col(residual).isNotNull())
    whole = base.agg(F.count("*").alias("n"), F.avg(residual).alias("m")).first()
    beam: list[tuple[tuple[str, str], ...]] = [()]
    by_column = {s.column: s for s in specs}
    found: dict[tuple, tuple] = {}
    for _ in range(depth):
        entries = []
        for b, rule in enumerate(beam):
            holds = F.lit(True)
            for column, label in rule:
                holds = holds & F.coalesce(by_column[column].label() == F.lit(label), F.lit(False))
            used = {c for c, _ in rule}
            for s in specs:
                if s.column not in used:
                    entries.append(
                        F.struct(
                            F.lit(b).alias("b"),
                            F.lit(s.column).alias("c"),
                            F.when(holds, s.label()).alias("v"),
                        )
                    )
        if not entries:
            break
        scored = (
            base.select(
                F.col(residual).alias("e"),
                F.explode(F.filter(F.array(*entries), lambda x: x["v"].isNotNull())).alias("x"),
            )
            .groupBy("x.b", "x.c", "x.v")
            .agg(F.count("*").alias("n"), F.avg("e").alias("m"))
            .where(F.col("n") >= F.lit(min_coverage * whole["n"]))
            .withColumn("wracc", F.col("n") / F.lit(whole["n"]) * (F.col("m") - F.lit(whole["m"])))
            .orderBy(F.desc("wracc"), "c", "v", "b")
            .collect()  # at most width * features / min_coverage rows: coverages of a column's bins add up to one
        )
        fresh: list[tuple] = []
        for r in scored:
            rule = tuple(sorted([*beam[r["b"]], (r["c"], r["v"])]))
            if rule not in found:
                found[rule] = (len(rule), r["n"], r["m"], r["wracc"])
                fresh.append(rule)
        beam = fresh[:width]
        if not beam:
            break
    rows = [
        (" and ".join(f"{c} in {v}" for c, v in rule), *vals)
        for rule, vals in sorted(found.items(), key=lambda kv: -kv[1][3])
    ]
    return df.sparkSession.createDataFrame(
        rows, "rule string, n_conditions int, sample_count long, mean_residual double, wracc double"
    )
