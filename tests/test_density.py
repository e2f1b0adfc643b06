"""Spanning forests, hierarchical density clusters and rules on derived columns."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from residua.functions import derive
from residua.functions.graph import connected_components, forest_with_homes, spanning_forest
from residua.operators import cluster, density, prep, rules
from residua.operators.rules import Rule


def kruskal(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = set()
    for w, a, b in sorted((w, a, b) for a, b, w in edges):
        if find(a) != find(b):
            root[find(a)] = find(b)
            out.add((a, b, w))
    return out


def test_spanning_forest_equals_kruskal(spark):
    rng = np.random.default_rng(1)
    pairs = {(min(a, b), max(a, b)) for a, b in rng.integers(0, 120, (500, 2)) if a != b} | {(200 + i, 201 + i) for i in range(40)}
    edges = [(int(a), int(b), float(rng.integers(0, 20))) for a, b in sorted(pairs)]  # many ties
    got = {tuple(r) for r in spanning_forest(spark.createDataFrame(edges, "a long, b long, w double")).collect()}
    assert got == kruskal(edges)
    assert spanning_forest(spark.createDataFrame([], "a long, b long, w double")).count() == 0
    parts = connected_components(spark.createDataFrame(edges, "a long, b long, w double"))
    assert parts.count() == len({x for e in edges for x in e[:2]})


def labelled(spark, x, min_size=15):
    names = [f"c{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame(pd.DataFrame(np.column_stack([np.arange(len(x)), x]), columns=["row", *names]))
    out, found = density.density_labels(df, names, min_size)
    return out.select("row", "cluster").toPandas().sort_values("row")["cluster"].to_numpy(), found


def test_groups_that_differ_along_a_later_axis_only(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 5)) * [3.0, 3.0, 3.0, 0.2, 1.0]
    x[:300, 3] += 4
    x = (x - x.mean(0)) / x.std(0)
    labels, found = labelled(spark, x)
    a, b = labels[:300], labels[300:]
    main_a, main_b = np.bincount(a[a >= 0]).argmax(), np.bincount(b[b >= 0]).argmax()
    assert main_a != main_b
    assert not set(a[a >= 0]) & set(b[b >= 0])
    assert (a == main_a).mean() > 0.6 and (b == main_b).mean() > 0.6


def test_validity_ranks_shapes(spark):
    rng = np.random.default_rng(3)
    scores = []
    for apart, noise in ((12.0, 0), (5.0, 60)):
        x = np.vstack([rng.normal([0, 0], 0.5, (150, 2)), rng.normal([apart, 0], 0.5, (150, 2)), rng.uniform(-3, apart + 3, (noise, 2))])
        labels, found = labelled(spark, x)
        assert len(set(labels[:150]) & set(labels[150:300]) - {-1}) == 0
        scores.append(found.validity())
    assert 0.5 < scores[0] <= 1 and scores[0] > scores[1]


def test_small_and_repeated_points(spark):
    x = np.repeat(np.arange(4.0), [40, 3, 30, 20])[:, None]
    labels, found = labelled(spark, x)
    assert sorted(np.bincount(labels[labels >= 0]).tolist(), reverse=True) == [40, 30, 20] and (labels == -1).sum() == 3
    none, _ = labelled(spark, np.array([[0.0, 1.0]] * 3))
    assert set(none) == {-1}


def test_buckets_hold_every_point_once_per_tree(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=3).tolist(), 1) for i in range(900)] + [(1000 + i, [float(i % 2), 0.0, 0.0], 1) for i in range(300)]
    placed = density.buckets(spark.createDataFrame(rows, "id long, x array<double>, n long"), trees=3, leaf=50)
    assert placed.count() == 3600
    assert placed.groupBy("id").count().where("count <> 3").count() == 0
    assert placed.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 200


def test_derived_rules_survive_json_and_need_base_columns_only(spark):
    rows = [(1.0, 2.0), (3.0, 5.0), (None, 4.0), (float("nan"), 1.0), (2.0, None), (5.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    trees = prep.interaction_trees([("a", "b")], {"a": 2.0, "b": 2.0})
    product, both, either = prep.interaction_names("a", "b")
    found = [
        {"pattern_type": "subgroup", "column_name": product, "bin_value": "(5.0, 20.0]", "derived": trees[product]},
        {"pattern_type": "subgroup", "column_name": both, "bin_value": "1", "derived": trees[both]},
        {"pattern_type": "subgroup", "column_name": either, "bin_value": "1", "derived": trees[either]},
        {"pattern_type": "cluster", "cluster": 0, "cluster_center": {"gone": 1.0}},
        {"pattern_type": "subgroup", "column_name": "b", "bin_value": "[4.0, 9.0]"},
    ]
    compiled = rules.compiled_patterns(df, found)
    assert [p["column_name"] for _, p in compiled] == [product, both, either, "b"]  # no rule for a centre of other columns
    stored = [Rule.from_json(r.to_json()) for r, _ in compiled]
    assert stored[0].columns() == ["a", "b"] and stored[3].columns() == ["b"]
    got = [tuple(r) for r in rules.apply_rules(df, stored, []).collect()]
    assert got == [(0.0, 0.0, 0.0, 0.0), (1.0, 1.0, 0.0, 1.0), (0.0, 0.0, 1.0, 1.0), (0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0)]
    assert derive.columns(trees[either]) == ["a", "b"]
    with pytest.raises(ValueError, match="missing"):
        rules.apply_rules(df.drop("a"), stored)
    with pytest.raises(ValueError, match="unknown"):
        derive.compiled({"op": "other", "of": []})


def test_clusters_of_two_models_match_by_rows(spark):
    one = spark.createDataFrame([(i, i // 10) for i in range(40)], "k long, cluster int")
    two = spark.createDataFrame([(i, 3 - i // 10) for i in range(40) if i % 10 < 8], "k long, cluster int")
    assert cluster.matching(one, two, "k") == [(0, 3), (1, 2), (2, 1), (3, 0)]
    assert cluster.matching(one, two, "k", share=0.9) == []


def test_homes_are_bounded_trees_of_the_forest(spark):
    rng = np.random.default_rng(6)
    pairs = {(min(a, b), max(a, b)) for a, b in rng.integers(0, 400, (1500, 2)) if a != b} | {(500 + i, 501 + i) for i in range(30)}
    edges = spark.createDataFrame([(int(a), int(b), float(rng.integers(0, 50))) for a, b in sorted(pairs)], "a long, b long, w double")
    forest, homes = forest_with_homes(edges, 100)
    home = dict(map(tuple, homes.collect()))
    assert set(home) == {x for p in pairs for x in p} and 1 < max(np.unique(list(home.values()), return_counts=True)[1]) <= 100
    inside = [(a, b) for a, b, _ in map(tuple, forest.collect()) if home[a] == home[b]]
    assert len(inside) == len(home) - len(set(home.values()))  # each home is one tree
    assert forest_with_homes(edges, 1)[1] is None and {tuple(r) for r in forest.collect()} == kruskal([tuple(r) for r in edges.collect()])


def test_levels_from_homes_equal_components_of_all_levels(spark):
    rng = np.random.default_rng(7)
    tree = [(int(rng.integers(max(0, i - 40), i)), i, int(rng.integers(0, 5))) for i in range(1, 900) if i % 300]
    forest = spark.createDataFrame(tree, "a long, b long, first int")
    want = {}
    for level in range(5):
        root = {}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b, first in tree:
            if first <= level:
                root.setdefault(a, a), root.setdefault(b, b)
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
        want |= {(level, x): find(x) for x in root}
    for homes in (None, [(i, 0) for i in range(900)], [(i, i // 50) for i in range(900)], [(i, i % 7) for i in range(900)]):
        got = density._components(forest, homes and spark.createDataFrame(homes, "id long, home long"), 5).collect()
        assert len(got) == len(want) and {(r["level"], r["id"]): r["component"] for r in got} == want


def test_level_components_of_points_in_one_home_shuffle_each_edge_once(spark, monkeypatch):
    def refused(edges):
        raise AssertionError("all levels of all points went through the rounds")

    monkeypatch.setattr(density, "connected_components", refused)
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal([0, 0], 0.4, (120, 2)), rng.normal([6, 0], 0.4, (120, 2))])
    labels, _ = labelled(spark, x)
    assert not set(labels[:120]) & set(labels[120:]) - {-1}
