"""Partitions by cuts: balance, fewer cut edges than along a curve, and small cases."""

import numpy as np
from pyspark.sql import functions as F

from entitygraph.operators import cuts, tiling


def test_cuts_fewer_edges_than_the_curve_at_equal_balance(spark):
    rng = np.random.default_rng(3)
    n, parts, slack = 900, 4, 0.05
    at = rng.random((n, 2)) * [30, 20]
    far = ((at[:, None] - at[None]) ** 2).sum(2)
    near = [(int(i), int(j)) for i in range(n) for j in np.argsort(far[i])[1:6]]
    centres = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "entity long, x double, y double").cache()
    # Both directions, loops and unknown ends are allowed.
    edges = spark.createDataFrame(near + [(5, 5), (7, n + 3)], "src long, dst long").cache()
    got = cuts.min_cut_partition(centres, edges, parts, slack, levels=3, turns=4).cache()
    assert got.columns == ["entity", "x", "y", "part"] and got.count() == n == got.select("entity").distinct().count()
    loads = [r["count"] for r in got.groupBy("part").count().collect()]
    assert len(loads) == parts and min(loads) >= (1 - slack) * n / parts - 1 and max(loads) <= (1 + slack) * n / parts + 1
    cut = lambda parted: tiling.edge_cuts(edges, parted).first().edge_cuts
    assert cut(got) < 0.9 * cut(tiling.balanced_partition(centres, parts))


def test_matching_is_one_to_one_and_contraction_keeps_weights(spark):
    nodes = spark.createDataFrame([(i, 1.0, float(i), 0.0) for i in range(6)], "node long, size double, x double, y double")
    edges = spark.createDataFrame([(0, 1, 3.0), (1, 2, 5.0), (2, 3, 3.0), (3, 4, 1.0), (0, 4, 2.0)], "a long, b long, w double")
    names = cuts.matching(nodes, edges, 2.0)
    assert {(r.node, r.to) for r in names.collect()} == {(2, 1)}
    assert cuts.matching(nodes, edges, 1.0).count() == 0
    fewer, thin = cuts.contract(nodes, edges, names)
    assert {r.node: (r.size, r.x) for r in fewer.collect()} == {0: (1.0, 0.0), 1: (2.0, 1.5), 3: (1.0, 3.0), 4: (1.0, 4.0), 5: (1.0, 5.0)}
    assert {(r.a, r.b): r.w for r in thin.collect()} == {(0, 1): 3.0, (1, 3): 3.0, (3, 4): 1.0, (0, 4): 2.0}


def test_two_cliques_and_empty_tables(spark):
    centres = spark.createDataFrame([(f"n{i}", float(i % 4), float(i // 4)) for i in range(8)], "entity string, x double, y double")
    odd = [(i, j) for i in range(8) for j in range(i) if i % 2 == j % 2]
    edges = spark.createDataFrame([(f"n{i}", f"n{j}", 2.0) for i, j in odd] + [("n0", "n1", 1.0)], "src string, dst string, w double")
    got = cuts.min_cut_partition(centres, edges, 2, 0.5, levels=2, turns=2)
    loads = sorted(r["count"] for r in got.groupBy("part").count().collect())
    assert sum(loads) == 8 and loads[0] >= 2
    assert cuts.min_cut_partition(centres.limit(0), edges, 2).count() == 0
    lone = cuts.min_cut_partition(centres, edges.limit(0), 4)
    assert sorted(r["count"] for r in lone.groupBy("part").count().collect()) == [2, 2, 2, 2]
    assert lone.where(F.col("part").isNull()).count() == 0
