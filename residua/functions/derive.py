"""Derived columns as small expression trees over base columns.

A tree is plain data (JSON), so that a rule on a derived column carries everything it needs, the medians
fitted in training included, and applies to any table that has the base columns.

    {"op": "column", "name": ...}                  a base column
    {"op": "product", "of": [tree, tree]}          x * y, 0 where one is missing
    {"op": "above", "of": [tree], "value": m}      x > m, false where x is missing
    {"op": "all", "of": [condition, ...]}          1 where all hold, else 0
    {"op": "one", "of": [condition, condition]}    1 where exactly one holds, else 0
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from residua.functions import expr

Tree = dict


def base(name: str) -> Tree:
    return {"op": "column", "name": name}


def above(name: str, value: float) -> Tree:
    return {"op": "above", "of": [base(name)], "value": float(value)}


def pair_trees(a: str, b: str, median_a: float, median_b: float) -> dict[str, Tree]:
    """Product, both-above-median and exactly-one-above-median of two columns."""
    sides = [above(a, median_a), above(b, median_b)]
    return {"product": {"op": "product", "of": [base(a), base(b)]}, "both": {"op": "all", "of": sides}, "either": {"op": "one", "of": sides}}


def columns(tree: Tree) -> list[str]:
    """Base columns of a tree, each once, in order of their first use."""
    if tree["op"] == "column":
        return [tree["name"]]
    return list(dict.fromkeys(c for t in tree["of"] for c in columns(t)))


def compiled(tree: Tree) -> Column:
    """The tree as one column."""
    op = tree["op"]
    if op == "column":
        return expr.as_double(expr.col(tree["name"]))
    parts = [compiled(t) for t in tree["of"]]
    if op == "product":
        out = parts[0]
        for p in parts[1:]:
            out = out * p
        return F.coalesce(out, F.lit(0.0))
    if op == "above":
        return F.coalesce(parts[0] > F.lit(float(tree["value"])), F.lit(False))
    if op == "all":
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out.cast("int")
    if op == "one":
        first, second = parts
        return (first != second).cast("int")
    raise ValueError(f"unknown operation {op!r}")
