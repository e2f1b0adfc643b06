"""Graph steps over distributed edges: connected components and minimum spanning forests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.session import durable, release

MAX_ROUNDS = 100


def _with_least(edges: DataFrame) -> DataFrame:
    """Rows (u, v, m) with m the least of u and all v of u.  The join key is a struct, so that the
    minima are dealt anew and a node with very many neighbours can be split by the skew join."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.struct("u").alias("k"), F.least("u", "m").alias("m"))
    return edges.select(F.struct("u").alias("k"), "u", "v").join(least, "k").select("u", "v", "m")


def _settled(edges: DataFrame) -> bool:
    """Whether every node has at most one edge to a lesser node and such nodes have no edge of their own."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e"))
    sums = ends.groupBy("e.x").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("least"))
    return not sums.where("ups > 1 OR (ups = 1 AND least = 0)").limit(1).count()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge, component the least node reachable.

    Edges with null ends are ignored, loops and repeats do no harm; no edges give no rows.  Alternating large
    and small stars; each round is written to the checkpoint folder and the one before removed; the loop
    ends when all trees are stars around their least node.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("u")).distinct()
    current = durable(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(MAX_ROUNDS):
        if _settled(current):
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(large).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        former, current = current, durable(small)
        release(former)
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(current, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))


def roots(pointers: DataFrame) -> DataFrame:
    """(u, p) with p the root that following p from u ends at; a root points at itself."""
    while True:
        once = pointers.join(pointers.select(F.col("u").alias("p"), F.col("p").alias("q")), "p").select("u", "q")
        twice = once.join(pointers.select(F.col("u").alias("q"), F.col("p").alias("r")), "q").select("u", F.col("r").alias("p"), (F.col("q") == F.col("r")).alias("done"))
        former, walked = pointers, durable(twice)
        release(former)
        pointers = walked.select("u", "p")
        pointers._durable_path = walked._durable_path
        if not walked.where("NOT done").limit(1).count():
            return pointers


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Minimum spanning forest (a, b, w) of edges (a < b, w), ties by the ends: Boruvka's rounds.

    In each round every tree takes its lightest edge to another tree; the edges taken join trees, the edges left
    are renamed by tree and those inside one tree go.  Trees at least halve in number every round.
    """
    return forest_with_homes(edges, 0)[0]


def forest_with_homes(edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The minimum spanning forest, and (id, home) for every node of an edge: its tree after the last round whose trees
    all have ``most`` nodes at most.  None if no round has such trees."""
    homes, growing = None, most > 0
    left = durable(edges.select(F.col("a").alias("x"), F.col("b").alias("y"), "w", "a", "b"))
    taken: list[DataFrame] = []
    while True:
        one = left.select(F.col("x").alias("u"), F.struct("w", "a", "b", F.col("y").alias("to")).alias("e"))
        both = one.unionByName(left.select(F.col("y").alias("u"), F.struct("w", "a", "b", F.col("x").alias("to")).alias("e")))
        chosen = durable(both.groupBy("u").agg(F.min("e").alias("e")).select("u", F.col("e.to").alias("p"), F.col("e.w").alias("w"), F.col("e.a").alias("a"), F.col("e.b").alias("b")))
        if not chosen.limit(1).count():
            break
        taken.append(chosen.select("a", "b", "w"))
        # two trees that take the same edge: the lesser is the root
        back = chosen.select(F.col("u").alias("p"), F.col("p").alias("u"), F.lit(True).alias("mutual"))
        pointers = chosen.select("u", "p").join(back, ["u", "p"], "left").select("u", F.when(F.coalesce("mutual", F.lit(False)) & (F.col("u") < F.col("p")), F.col("u")).otherwise(F.col("p")).alias("p"))
        ends = roots(durable(pointers))
        if growing:
            moved = ends.select(F.col("u").alias("id"), F.col("p").alias("home"))
            if homes is not None:  # a tree without an edge to another one stays
                moved = homes.join(ends.select(F.col("u").alias("home"), "p"), "home", "left").select("id", F.coalesce("p", "home").alias("home"))
            moved = durable(moved)
            growing = moved.groupBy("home").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] <= most
            former, homes = (homes, moved) if growing else (moved, homes)
            if former is not None:
                release(former)
        renamed = (
            left.join(ends.select(F.col("u").alias("x"), F.col("p").alias("nx")), "x").join(ends.select(F.col("u").alias("y"), F.col("p").alias("ny")), "y")
            .where("nx <> ny").select(F.col("nx").alias("x"), F.col("ny").alias("y"), "w", "a", "b")
        )
        former, left = left, durable(renamed)
        release(former)
    out = left.select("a", "b", "w")
    for t in taken:
        out = out.unionByName(t)
    return durable(out.distinct()), homes
