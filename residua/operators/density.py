"""Hierarchical density clustering in all dimensions.

1. Equal points collapse to one with a weight.  Several random-projection trees cut the points into buckets: a
   bucket that is too large is cut at the quartiles of its own random projection, level by level.
2. Nearest neighbours are searched inside the buckets.  The core distance of a point is the radius that holds
   ``min_size`` rows; the mutual-reachability distance of two neighbours is the largest of their distance
   and their core distances.
3. The minimum spanning forest of the neighbour graph is built by distributed Boruvka rounds.
4. The forest is cut at ``LEVELS`` quantiles of its edges.  Trees of an early Boruvka round are taken apart in tasks,
   at all levels; one run over (level, part) joins the parts along the edges between such trees.  Components of ``min_size`` rows form the condensed tree: a cluster lives while its
   component has one large child, and its stability sums its rows times the density steps it lives for.
5. Clusters are selected from the densest level up: a cluster that is more stable than its selected
   descendants replaces them.  The root is never selected.

Neighbours are approximate (points that share no bucket are not compared), densities are cut at the levels, all
else is exact.  No step holds a cluster, a component or all pairs of a large bucket in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.functions.graph import connected_components, forest_with_homes, roots
from residua.session import durable, release

TREES, LEAF, WAYS = 4, 256, 4
DEEPEST = 24  # levels of a projection tree
LEVELS = 24  # density levels
HOME = 20_000  # points of a tree that is taken apart in a task
HELD = 100_000  # edges a task gathers before it takes their trees apart
_SPAN = 64  # more than LEVELS: (level, point) as one number


def projection(x: Column, bucket: Column) -> Column:
    """A random linear combination of the coordinates that is the same for all points of a bucket."""
    weight = lambda i: (F.pmod(F.xxhash64(bucket, i), F.lit(2001)) - 1000) / F.lit(1000.0)
    return F.aggregate(F.transform(x, lambda v, i: v * weight(i)), F.lit(0.0), lambda s, v: s + v)


def buckets(points: DataFrame, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """(bucket, id, x, n): every point once per tree, buckets of about ``leaf`` points."""
    cuts = [i / WAYS for i in range(1, WAYS)]
    placed = durable(points.withColumn("bucket", F.explode(F.array(*[F.lit(t).cast("long") for t in range(trees)]))))
    before = None
    for _ in range(DEEPEST):
        p = projection(F.col("x"), F.col("bucket"))
        large = durable(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.percentile_approx(p, cuts, 200).alias("cuts")).where(F.col("rows") > leaf))
        most = large.agg(F.max("rows")).first()[0]
        if most is None or most == before:
            break
        before = most
        side = F.size(F.filter("cuts", lambda c: p > c))
        moved = placed.join(large, "bucket", "left").withColumn("bucket", F.when(F.col("rows").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", side)))
        former, placed = placed, durable(moved.select("bucket", "id", "x", "n"))
        release(former)
    # equal projections cannot be cut: such a bucket is dealt in parts
    large = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 4 * leaf)
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("rows") / leaf))
    return placed.join(large, "bucket", "left").withColumn("bucket", F.when(F.col("rows").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", part))).select("bucket", "id", "x", "n")


def neighbours(placed: DataFrame, k: int) -> DataFrame:
    """(a, b, d, n): for every point up to k others nearest to it in each of its buckets, n the weight of b."""

    def search(group: pa.Table) -> pa.Table:
        ids, n = group.column("id").to_numpy(), group.column("n").to_numpy()
        x = np.array(group.column("x").to_pylist(), float)
        m, take = len(ids), min(k, len(ids) - 1)
        a, b, d = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for lo in range(0, m if take else 0, 256):
            gap = np.sqrt(np.maximum(((x[lo : lo + 256, None, :] - x[None]) ** 2).sum(2), 0.0))
            rows = np.arange(len(gap))
            gap[rows, lo + rows] = np.inf
            near = np.argpartition(gap, take - 1, axis=1)[:, :take]
            a.append(np.repeat(ids[lo : lo + 256], take)), b.append(near.ravel()), d.append(gap[rows[:, None], near].ravel())
        at = np.concatenate(b)
        return pa.table({"a": np.concatenate(a), "b": ids[at], "d": np.concatenate(d), "n": n[at]})

    return placed.groupBy("bucket").applyInArrow(search, "a long, b long, d double, n long")


def reachability(points: DataFrame, k: int, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """Edges (a < b, w) of the neighbour graph with their mutual-reachability distance."""
    found = neighbours(buckets(points, trees, leaf), k)
    # at most k neighbours from each tree
    listed = found.groupBy("a").agg(F.slice(F.array_sort(F.collect_set(F.struct("d", "b", "n"))), 1, k).alias("near"))
    start = F.struct(F.col("n").alias("rows"), F.lit(0.0).alias("core"))
    walk = F.aggregate("near", start, lambda s, e: F.when(s["rows"] >= k, s).otherwise(F.struct((s["rows"] + e["n"]).alias("rows"), e["d"].alias("core"))))
    with_core = durable(listed.join(points.select(F.col("id").alias("a"), "n"), "a").select("a", walk["core"].alias("core"), F.transform("near", lambda e: F.struct(e["b"].alias("b"), e["d"].alias("d"))).alias("near")))
    edge = with_core.select("a", "core", F.explode("near").alias("e")).select("a", "core", "e.b", "e.d")
    other = with_core.select(F.col("a").alias("b"), F.col("core").alias("other"))
    weighed = edge.join(other, "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.greatest("core", "other", "d").alias("w"))
    return weighed.groupBy("a", "b").agg(F.min("w").alias("w"))


@dataclass
class Density:
    """Points (id, x, n, label: null for noise), the spanning forest (a, b, w) over them, its cuts and the
    components (level, id, component) at them."""

    points: DataFrame
    forest: DataFrame
    cuts: list[float]
    members: DataFrame

    def validity(self) -> float:
        """Rows-weighted mean over clusters of (separation - sparseness) / the larger one; noise counts as 0.

        Sparseness is the heaviest forest edge between inner points of a cluster (points with two edges or more
        inside it), so that its fringe does not count.  Separation is the first cut at which the cluster's
        component holds another cluster; a cluster that never meets another has 1."""
        label = self.points.where("label IS NOT NULL").select("id", "label")
        inside = (
            self.forest.join(label.withColumnsRenamed({"id": "a", "label": "l"}), "a")
            .join(label.withColumnsRenamed({"id": "b", "label": "m"}), "b").where("l = m").select("a", "b", "w", F.col("l").alias("label"))
        )
        degree = inside.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree")).where("degree > 1").select("id")
        inner = inside.join(degree.withColumnRenamed("id", "a"), "a", "left_semi").join(degree.withColumnRenamed("id", "b"), "b", "left_semi")
        sparse = inner.groupBy("label").agg(F.max("w").alias("sparse"))
        held = self.members.join(label, "id").select("level", "component", "label").distinct()
        several = held.groupBy("level", "component").agg(F.count(F.lit(1)).alias("labels")).where("labels > 1")
        met = held.join(several, ["level", "component"]).groupBy("label").agg(F.min("level").alias("level"))
        cut = F.element_at(F.array(*[F.lit(c) for c in self.cuts]), F.col("level") + 1)
        sizes = self.points.groupBy("label").agg(F.sum("n").alias("rows"))
        inner_w, apart = F.coalesce("sparse", F.lit(0.0)), F.col("apart")
        value = F.when(apart.isNull(), F.lit(1.0)).otherwise(F.coalesce(F.try_divide(apart - inner_w, F.greatest(apart, inner_w)), F.lit(0.0)))
        by = sizes.join(sparse, "label", "left").join(met.select("label", cut.alias("apart")), "label", "left")
        row = by.agg(F.sum(F.when(F.col("label").isNotNull(), value * F.col("rows"))).alias("v"), F.sum("rows").alias("n")).first()
        return float((row["v"] or 0.0) / row["n"]) if row["n"] else 0.0


def _thresholds(forest: DataFrame) -> list[float]:
    """Ascending cuts: 0, then quantiles of the positive edges up to the heaviest."""
    row = forest.where("w > 0").agg(F.percentile_approx("w", [i / LEVELS for i in range(1, LEVELS)], 10_000).alias("q"), F.max("w").alias("top")).first()
    if row["top"] is None:
        return [0.0]
    return [0.0, *sorted({*row["q"], row["top"]})]


def tree_parts(a: np.ndarray, b: np.ndarray, first: np.ndarray, levels: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per level (level, ids, components) of the nodes that have an edge there; edge i exists from level ``first[i]`` on, and
    a component is known by its least id."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    born = np.full(len(ids), levels)
    np.minimum.at(born, at, np.concatenate([first, first]))
    root = np.arange(len(ids))
    for level in range(levels):
        x, y = i[first == level], j[first == level]
        while (root[x] != root[y]).any():
            np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
            while (root[root] != root).any():
                root = root[root]
        there = np.flatnonzero(born <= level)
        if len(there):
            yield level, ids[there], ids[root[there]]


def _inside_homes(edges: DataFrame, levels: int) -> DataFrame:
    """(level, id, component) from the edges (home, a, b, first) of trees that each lie in one task."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def parts(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a, b, first = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("a", "b", "first"))
            for level, ids, component in tree_parts(a, b, first, levels):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), level, np.int32)), pa.array(ids), pa.array(component)], ["level", "id", "component"])

        for batch in batches:
            home = batch.column("home").to_numpy()
            if sum(x.num_rows for x in kept) >= HELD:
                last = kept[-1].column("home")[-1].as_py()
                others = np.flatnonzero(home != last)
                cut = int(others[0]) if len(others) else batch.num_rows
                kept.append(batch.slice(0, cut))
                batch = batch.slice(cut)
                if len(others):
                    yield from parts(kept)
                    kept = []
            if batch.num_rows:
                kept.append(batch)
        if kept:
            yield from parts(kept)

    return edges.repartition("home").sortWithinPartitions("home").select("home", "a", "b", "first").mapInArrow(solve, "level int, id long, component long")


def _components(forest: DataFrame, homes: DataFrame | None, levels: int) -> DataFrame:
    """(level, id, component) for the nodes that an edge (a, b, first) of the forest has at a level from ``first`` on."""
    if homes is None:
        inside, across = None, forest
    else:
        home = lambda c: homes.select(F.col("id").alias(c), F.col("home").alias(f"h{c}"))
        placed = durable(forest.join(home("a"), "a").join(home("b"), "b"))
        inside = durable(_inside_homes(placed.where("ha = hb").withColumnRenamed("ha", "home"), levels))
        across = placed.where("ha <> hb").select("a", "b", "first")
        if not across.limit(1).count():
            release(placed)
            return inside
    crossing = across.select("a", "b", F.explode(F.sequence("first", F.lit(levels - 1))).alias("level"))
    if inside is not None:
        of = lambda c: inside.select("level", F.col("id").alias(c), F.col("component").alias(f"c{c}"))
        crossing = crossing.join(of("a"), ["level", "a"], "left").join(of("b"), ["level", "b"], "left").select("level", F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    code = lambda c: F.col(c) * _SPAN + F.col("level")
    found = connected_components(crossing.select(code("a").alias("a"), code("b").alias("b")))
    split = lambda c: F.expr(f"{c} div {_SPAN}")
    joined = found.select(F.pmod("node", F.lit(_SPAN)).cast("int").alias("level"), split("node").alias("id"), split("component").alias("component"))
    if inside is None:
        return durable(joined)
    joined = durable(joined)
    # a part is known by a node of it, and a node without an edge inside its home is a part
    moved = inside.join(joined.select("level", F.col("id").alias("component"), F.col("component").alias("least")), ["level", "component"], "left").select("level", "id", F.coalesce("least", "component").alias("component"))
    lone = joined.join(inside.select("level", "id"), ["level", "id"], "left_anti").select("level", "id", "component")
    held = durable(moved.unionByName(lone))
    for used in (placed, inside, joined):
        release(used)
    return held


def _members(points: DataFrame, forest: DataFrame, homes: DataFrame | None, cuts: list[float], min_size: int) -> DataFrame:
    """(level, id, component) for points that have an edge at a level, or are a component of enough rows alone."""
    at = F.array(*[F.lit(c) for c in cuts])
    first = F.size(F.filter(at, lambda c: c < F.col("w")))
    held = _components(forest.select("a", "b", first.alias("first")), homes, len(cuts))
    heavy = points.where(F.col("n") >= min_size).select("id", F.explode(F.sequence(F.lit(0), F.lit(len(cuts) - 1))).alias("level"))
    alone = heavy.join(held.select("level", "id"), ["level", "id"], "left_anti").select("level", "id", F.col("id").alias("component"))
    return durable(held.unionByName(alone))


def _chains(nodes: DataFrame, members: DataFrame, cuts: list[float]) -> DataFrame:
    """Condensed tree (top level, component, parent chain as level and component, stability, rows) from the large
    components (level, component, rows) of all levels."""
    top = len(cuts) - 1
    density = [1.0 / c if c > 0 else (2.0 / cuts[1] if top else 1.0) for c in cuts] + [0.0]
    above = members.select((F.col("level") - 1).alias("level"), F.col("id").alias("component"), F.col("component").alias("up"))
    linked = nodes.join(above, ["level", "component"], "left")
    children = linked.where("up IS NOT NULL").groupBy((F.col("level") + 1).alias("next"), "up").agg(F.count(F.lit(1)).alias("children"))
    code = lambda level, c: F.col(c) * _SPAN + level
    joined = linked.withColumn("next", F.col("level") + 1).join(children, ["next", "up"], "left")
    steps = F.array(*[F.lit(a - b) for a, b in zip(density[:-1], density[1:])])
    node = durable(
        joined.select(
            code(F.col("level"), "component").alias("u"), F.when(F.col("up").isNotNull(), code(F.col("level") + 1, "up")).alias("parent"),
            (F.coalesce("children", F.lit(0)) == 1).alias("goes_on"), (F.col("rows") * F.element_at(steps, F.col("level") + 1)).alias("gain"), "rows",
        )
    )
    ends = roots(durable(node.select("u", F.when(F.col("goes_on"), F.col("parent")).otherwise(F.col("u")).alias("p"))))
    own = node.join(ends, "u").groupBy("p").agg(F.sum("gain").alias("stability"))
    parent = node.select(F.col("u").alias("p"), "parent", "rows").join(ends.select(F.col("u").alias("parent"), F.col("p").alias("parent_chain")), "parent", "left")
    return durable(own.join(parent, "p").select(F.col("p").alias("chain"), "parent_chain", "stability", "rows"))


def _selected(chains: DataFrame, top: int) -> DataFrame:
    """Chains (chain) chosen by stability: from the densest birth level up, then without descendants of chosen ones."""
    level = F.pmod("chain", F.lit(_SPAN)).cast("int")
    births = sorted(r[0] for r in chains.select(level).distinct().collect())  # LEVELS at most
    single = chains.where(level == top).limit(2).count() == 1  # one component of all: the root
    state = None
    for birth in births:
        now = chains.where(level == birth).select("chain", "parent_chain", "stability")
        if state is None:
            judged = now.withColumn("below", F.lit(0.0))
        else:
            below = state.groupBy(F.col("parent_chain").alias("chain")).agg(F.sum("best").alias("below"))
            judged = now.join(below, "chain", "left").withColumn("below", F.coalesce("below", F.lit(0.0)))
        wins = F.lit(False) if single and birth == top else F.col("stability") >= F.col("below")
        judged = judged.select("chain", "parent_chain", wins.alias("wins"), F.when(wins, F.col("stability")).otherwise(F.col("below")).alias("best"))
        former, state = state, durable(judged if state is None else state.unionByName(judged))
        if former is not None:
            release(former)
    if state is None:
        return chains.select("chain").limit(0)
    covered = state.select("chain", "wins", F.lit(False).alias("under"), "parent_chain")
    for birth in reversed(births[:-1]):
        heads = covered.select(F.col("chain").alias("parent_chain"), (F.col("wins") | F.col("under")).alias("held"))
        here = F.pmod("chain", F.lit(_SPAN)).cast("int") == birth
        covered = durable(
            covered.join(heads, "parent_chain", "left").select("chain", "wins", F.when(here, F.coalesce("held", F.lit(False))).otherwise(F.col("under")).alias("under"), "parent_chain")
        )
    return covered.where("wins AND NOT under").select("chain")


def density(df: DataFrame, columns: list[str], min_size: int, trees: int = TREES, leaf: int = LEAF) -> Density:
    """Cluster the rows by the given (standardised) columns."""
    x = F.array(*[F.col(c).cast("double") for c in columns])
    distinct = df.groupBy(x.alias("x")).agg(F.count(F.lit(1)).alias("n"))
    points = durable(distinct.withColumn("id", F.monotonically_increasing_id()).select("id", "x", "n"))
    forest, homes = forest_with_homes(reachability(points, min_size, trees, max(leaf, 2 * min_size)), HOME)
    cuts = _thresholds(forest)
    members = _members(points, forest, homes, cuts, min_size)
    nodes = durable(members.join(points.select("id", "n"), "id").groupBy("level", "component").agg(F.sum("n").alias("rows")).where(F.col("rows") >= min_size))
    chains = _chains(nodes, members, cuts)
    chosen = _selected(chains, len(cuts) - 1)
    picked = chosen.select(F.pmod("chain", F.lit(_SPAN)).cast("int").alias("level"), F.expr(f"chain div {_SPAN}").alias("component"), F.col("chain").alias("label"))
    labels = members.join(picked, ["level", "component"]).select("id", "label")
    return Density(durable(points.join(labels, "id", "left")), forest, cuts, members)


def density_labels(df: DataFrame, columns: list[str], min_size: int) -> tuple[DataFrame, Density]:
    """Add ``cluster`` (0.. by falling size, -1 for noise) to the rows, and what it was derived from."""
    found = density(df, columns, min_size)
    sizes = found.points.where("label IS NOT NULL").groupBy("label").agg(F.sum("n").alias("rows"))
    ranked = sizes.withColumn("cluster", (F.row_number().over(Window.orderBy(F.desc("rows"), "label")) - 1).cast("int"))  # a row a cluster
    lookup = found.points.join(ranked.select("label", "cluster"), "label").select(F.struct("x").alias("__k"), "cluster")
    keyed = df.withColumn("__k", F.struct(F.array(*[F.col(c).cast("double") for c in columns]).alias("x")))
    return keyed.join(lookup, "__k", "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1))).drop("__k"), found
