"""Variants of stages: whole cells left uncut, rescue by known features and kinds, thresholds within ranges, scored summaries, components in one task."""

import random

from entitygraph.operators import assoc, graph, stages
from entitygraph.operators.components import components

ROW = "id long, entity string, etype string, feature string, x double, y double, z double"


def test_split_leaves_whole_cells_and_the_largest_part(spark):
    rows = spark.createDataFrame([(i, e, "partial", "A", 0.0, 0.0, 0.0) for i, e in enumerate(["7", "7", "7", "7-1", "7-1", "7-1", "UNASSIGNED_1", "UNASSIGNED_1"])], ROW)
    edges = spark.createDataFrame([(0, 1), (3, 4)], "src long, dst long")
    labels = lambda df: [r.entity for r in df.orderBy("id").collect()]
    assert labels(stages.spatial_split(rows, edges)) == ["7", "7", "7-2", "7-1", "7-1", "7-1-2", "UNASSIGNED_1", "UNASSIGNED_1-2"]
    assert labels(stages.spatial_split(rows, edges, skip_clean=True)) == ["7", "7", "7", "7-1", "7-1", "7-1-2", "UNASSIGNED_1", "UNASSIGNED_1-2"]
    assert labels(stages.spatial_split(rows, edges, least=3)) == ["7", "7", "-1", "7-1", "7-1", "-1", "UNASSIGNED_1", "-1"]


def test_nearest_rescue_by_known_features_and_kinds(spark):
    panel = spark.createDataFrame([("A", "B", 0.5), ("A", "C", -0.5)], "gi string, gj string, w double")
    at = [(1, "-1", "unknown", "A", 0.0), (2, "-1", "unknown", "X", 0.0), (3, "off", "cell", "Y", 0.1), (4, "bad", "partial", "C", 0.2), (5, "cell", "cell", "B", 0.3), (6, "part", "partial", "B", 0.4)]
    rows = spark.createDataFrame([(i, e, k, f, x, 0.0, 0.0) for i, e, k, f, x in at], ROW)
    got = lambda **more: {r.id: r.entity for r in stages.rescue_nearest(rows, panel, 1.0, -0.1, **more).collect()}
    assert got() == {1: "off", 2: "off"}
    assert got(known=True) == {1: "cell"}
    assert got(known=True, kinds=("partial", "component")) == {1: "part"}


def test_thresholds_within_ranges(spark):
    t = spark.createDataFrame([("A", 0.0, 0.5), ("A", 0.0, 0.5), ("B", 0.1, 0.1), ("C", None, 0.0)], "gi string, npmi_thresh double, cond_thresh double")
    assert {r.gi: (r.npmi_thresh, r.cond_thresh) for r in assoc.reclip(t).collect()} == {"A": (0.01, 0.2), "B": (0.1, 0.1), "C": (None, 0.001)}


def test_summary_is_scored_and_sorted(spark):
    panel = spark.createDataFrame([("A", "B", 0.5), ("A", "C", -0.5)], "gi string, gj string, w double")
    points = spark.createDataFrame([(i, f, "7", 0.0, 0.0, 0.0) for i, f in enumerate("ACABABCAA")], "id long, feature string, cell string, x double, y double, z double")
    member = spark.createDataFrame([(i, c) for i, c in enumerate([1, 1, 2, 2, 3, 3, 3, 4, 4])], "id long, component long")
    got = [(r.component, r.n_nodes, r.purity, r.conflict) for r in graph.component_summary(points, member, 2, panel).collect()]
    assert got == [(3, 3, 1 / 3, 0.5 / 3), (2, 2, 1.0, 0.0), (1, 2, 0.0, 0.5), (4, 2, None, None)]


def test_components_in_one_task_are_equal(spark):
    r = random.Random(2)
    pairs = [(f"é{r.randrange(60)}", f"{r.randrange(60)}:") for _ in range(60)]
    edges = spark.createDataFrame(pairs + [(None, "a"), ("b", "b")], "a string, b string")
    got = [{(x.node, x.component) for x in components(edges, at_once=n).collect()} for n in (0, 1000, 10)]
    assert got[0] == got[1] == got[2] and got[0]
    assert components(edges.limit(0), at_once=10).count() == 0
