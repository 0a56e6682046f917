"""Many small cells, and many seeds in few places: no call for each."""

import numpy as np

from entitygraph.operators import graph, kernels, spatial_join, stages
from pyspark.sql import functions as F


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_hulls_of_many_small_keys_share_a_call(spark):
    r = np.random.default_rng(3)
    data = [(f"k{k}", float(x), float(y)) for k in range(40) for x, y in r.integers(0, 6, (k % 9 + 1, 2))]
    got = graph.hulls(spark.createDataFrame(data, "k string, x double, y double"), "k")
    assert "FlatMapGroupsInPandas" not in plan_of(got)
    found = {q.polygon: [tuple(v) for v in q.ring] for q in got.collect()}
    want = {k: [tuple(v) for v in graph.hull(np.array([d[1:] for d in data if d[0] == k]))] for k in {d[0] for d in data if sum(e[0] == d[0] for e in data) >= 3}}
    assert found == {k: v for k, v in want.items() if len(v) >= 3}


def test_cells_are_pruned_and_reassigned_without_a_call_for_each(spark):
    r = np.random.default_rng(4)
    kinds = [f"f{k}" for k in range(8)]
    pairs = [(a, b, float(np.round(r.normal(), 2))) for i, a in enumerate(kinds) for b in kinds[i + 1 :]]
    panel = stages.Panel(spark.createDataFrame(pairs, "gi string, gj string, w double"))
    data = [(i, f"c{i % 17}", [*kinds, "other", None][r.integers(0, 10)], 0.0, 0.0, 0.0, [True, False, None][r.integers(0, 3)]) for i in r.permutation(300).tolist()]
    rows = spark.createDataFrame(data, "id long, cell string, feature string, x double, y double, z double, nuclear boolean")
    number, w = {g: k for k, g in enumerate(kinds)}, panel.block(np.arange(8))
    for nuclear in (True, False):
        got = stages.prune(rows, panel, nuclear, -0.2, 0.0)
        again = stages.reassign(got, panel, 0.01)
        assert "FlatMapGroupsInPandas" not in plan_of(again)
        label = {q.id: q.entity for q in got.collect()}
        for c in {d[1] for d in data}:
            mine = sorted(d for d in data if d[1] == c)
            genes = np.array([number.get(d[2], -1) for d in mine])
            code = kernels.nuclear_seed(genes, np.array([bool(d[6]) for d in mine]), w, -0.2, 0.0) if nuclear else kernels.whole_cell_prune(genes, w, -0.2)
            assert [label[d[0]] for d in mine] == [(c, f"{c}-1", "-1")[k] for k in code]
            main, part = ({int(g) for g, k in zip(genes, code, strict=True) if k == v and g >= 0} for v in (0, 1))
            to = kernels.reassign_rows(genes, np.array([bool(d[6]) for d in mine]) & (code == 0), np.array(sorted(main), int), [np.array(sorted(part), int)] if (code == 1).any() and (code == 0).any() else [], w, 0.01)
            moved = {q.id for q in again.where(F.col("cell") == c).collect() if q.entity != label[q.id]} if c in ("c0", "c5") else None
            assert moved is None or moved == {d[0] for d, t in zip(mine, to, strict=True) if t > 0}


def test_seeds_beyond_the_limit_in_few_places(spark):
    seeds = spark.range(200_500).select("id", (F.col("id") * 7 % 50 + 0.25).alias("x"), (F.col("id") * 11 % 52 + 0.125).alias("y"))
    r = np.random.default_rng(5)
    p = np.vstack([np.column_stack([r.integers(1, 51, 400), r.random(400) * 52]), [[-900.0, 4.0], [25.25, 1e6], [0.75, 0.125]]])
    points = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "id long, x double, y double")
    k = np.arange(1300)
    d = (p[:, :1] - (k * 7 % 50 + 0.25)) ** 2 + (p[:, 1:] - (k * 11 % 52 + 0.125)) ** 2
    got = {q.id: (q.seed, q.d2) for q in spatial_join.nearest_seed(points, seeds).collect()}
    assert got == {i: (int(j), float(d[i, j])) for i, j in enumerate(d.argmin(1))}


def test_seed_boxes_equal_brute_force():
    r = np.random.default_rng(6)
    for at in (r.random((3000, 3)), np.repeat(r.integers(0, 5, (40, 2)), 1, 0).astype(float), np.array([[1.0, 2.0]]), np.column_stack([r.random(500), np.zeros(500)])):
        p = r.normal(0.5, 1.0, (700, at.shape[1]))
        d = sum((p[:, k, None] - at[None, :, k]) ** 2 for k in range(at.shape[1]))
        which, best = spatial_join.SeedBoxes(at).nearest(p)
        assert (which == d.argmin(1)).all() and (best == d.min(1)).all()
