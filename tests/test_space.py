"""Grid, distance joins and graphs against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from entitygraph.operators import graph, grid, spatial_join, tiling
from entitygraph.operators.components import components
from entitygraph.sources import synthetic


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(7)
    xyz = np.round(rng.uniform(-5, 5, (250, 3)), 3)
    xyz[10] = xyz[11]
    df = spark.createDataFrame([(k, f"e{k % 6}", *map(float, p)) for k, p in enumerate(xyz)], "id long, entity string, x double, y double, z double")
    return xyz, df.cache()


@pytest.mark.parametrize("cell", [None, 0.5, 2.0])
def test_radius_join(cloud, cell):
    xyz, df = cloud
    d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
    want = {(i, j) for i, j in zip(*np.nonzero(d2 <= 1.0))}
    assert {(r.src, r.dst) for r in spatial_join.radius_join(df, df, 1.0, cell).collect()} == want


def test_knn(cloud):
    xyz, df = cloud
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2))
    want = set()
    for i in range(len(xyz)):
        near = sorted((round(d[i, j], 6), j) for j in range(len(xyz)) if j != i and d[i, j] <= 2.0)[:3]
        want |= {(i, j) for _, j in near}
    assert {(r.src, r.dst) for r in spatial_join.knn_capped(df, 3, 2.0).collect()} == want


def test_knn_per_label(cloud):
    xyz, df = cloud
    got = {(r.src, r.dst) for r in spatial_join.knn_per_label(df, 2, "entity").collect()}
    for i in range(0, 250, 17):
        same = [j for j in range(250) if j % 6 == i % 6 and j != i]
        d = [(round(float(np.linalg.norm(xyz[i] - xyz[j])), 6), j) for j in same]
        assert {j for s, j in got if s == i} == {j for _, j in sorted(d)[:2]}


@pytest.mark.parametrize("k", [1, 4])
def test_knn_per_label_by_growing_cubes_equals_one_worker(spark, k):
    rng = np.random.default_rng(k)
    # A dense clump, a plane, points of one place, a label of one place alone, far outliers and a pair.
    xyz = [("a", *p) for p in rng.normal(0, 0.01, (60, 3))] + [("a", *p) for p in rng.uniform(-20, 20, (60, 3))]
    xyz += [("flat", *p, 1.0) for p in np.round(rng.uniform(0, 5, (50, 2)), 1)] + [("a", 1.0, 1.0, 1.0)] * 15 + [("same", 2.0, 2.0, 2.0)] * 12
    xyz += [("a", 900.0, 0.0, 0.0), ("two", 0.0, 0.0, 0.0), ("two", 7.0, 0.0, 0.0), ("a", None, 0.0, 0.0), (None, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame([(e, i, *(None if v is None else float(v) for v in p)) for i, (e, *p) in enumerate(xyz)], "label string, id long, x double, y double, z double")
    found = lambda rows: sorted((r.label, r.src, r.dst, round(r.length, 9)) for r in spatial_join.knn_per_label(df, k, label_rows=rows).collect())
    want = found(1000)
    assert len({w[1] for w in want}) == len(xyz) - 2
    assert found(1) == want and found(40) == want


def test_knn_per_label_ends_on_infinite_places_and_repeated_ids(spark):
    rows = [("a", 1, 0.0), ("a", 2, 1.0), ("a", 3, float("inf")), ("a", 4, float("nan")), ("b", 5, 0.0), ("b", 5, 0.0), ("b", 6, 3.0)]
    df = spark.createDataFrame([(e, i, x, 0.0, 0.0) for e, i, x in rows], "label string, id long, x double, y double, z double")
    got = {(r.label, r.src, r.dst, r.length) for r in spatial_join.knn_per_label(df, 2, label_rows=1).collect()}
    assert got == {("a", 1, 2, 1.0), ("a", 2, 1, 1.0), ("b", 5, 6, 3.0), ("b", 6, 5, 3.0)}


def test_nearest_seed_and_polygons(spark, cloud):
    xyz, df = cloud
    seeds = spark.createDataFrame([(k, float(p[0]), float(p[1])) for k, p in enumerate(xyz[:20])], "id long, x double, y double")
    got = {r.id: r.seed for r in spatial_join.nearest_seed(df, seeds).collect()}
    d2 = ((xyz[:, None, :2] - xyz[None, :20, :2]) ** 2).sum(2)
    assert all(d2[i, s] == pytest.approx(d2[i].min()) for i, s in got.items())
    squares = spark.createDataFrame([("a", [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]), ("b", [(-4.0, -4.0), (0.0, -4.0), (0.0, 0.0), (-4.0, 0.0)]), ("c", [(0.0, 0.0)])], "polygon string, ring array<struct<x:double,y:double>>")
    for r in spatial_join.point_in_polygon(df, squares).collect():
        x, y, _ = xyz[r.id]
        assert r.polygon == ("a" if 0 < x < 4 and 0 < y < 4 else "b" if -4 < x < 0 and -4 < y < 0 else None)


@pytest.mark.parametrize("hood,depth", [("0", 0), ("8", 0), ("4", 1), ("R2", 1)])
def test_witness_pairs(spark, cloud, hood, depth):
    from entitygraph.functions.scalars import xy_offsets

    xyz, df = cloud
    b = np.floor(xyz / 2.0).astype(int)
    cells: dict = {}
    for k, t in enumerate(map(tuple, b)):
        cells[t, f"e{k % 6}"] = cells.get((t, f"e{k % 6}"), 0) + 1
    offsets = set(xy_offsets(hood))
    want = {}
    for ((s, e), n), ((t, f), m) in itertools.product(cells.items(), repeat=2):
        if e < f and (t[0] - s[0], t[1] - s[1]) in offsets and abs(t[2] - s[2]) <= depth:
            w = want.setdefault((e, f), [{}, {}, 0])
            w[0][s], w[1][t] = n, m
            w[2] += n * m
    got = {(r.lo, r.hi): (r.n_lo, r.n_hi, r.n_records) for r in grid.witness_pairs(grid.build_index(df, 2.0, 2.0), hood, depth).collect()}
    assert got == {k: (sum(a.values()), sum(c.values()), n) for k, (a, c, n) in want.items()}


def test_supported_pairs(spark, cloud):
    index = grid.build_index(cloud[1], 2.0, 2.0)
    met = grid.witness_pairs(index, "8", 1)
    size = {r.entity: r.n for r in index.groupBy("entity").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    all_ = {(r.lo, r.hi): r.n_records for r in met.collect()}
    for least, want in ((150, {p for p, n in all_.items() if n >= 150}), ("min", {p for p, n in all_.items() if n >= min(size[p[0]], size[p[1]])})):
        assert {(r.lo, r.hi) for r in grid.supported(met, least, index).collect()} == want
    with pytest.raises(ValueError):
        grid.supported(met, "min")


@pytest.mark.parametrize("seed", [0, 1])
def test_close_in_z_equals_all_pairs_of_points(spark, seed):
    rng = np.random.default_rng(seed)
    # Levels a half apart make distances that meet the bounds, and even numbers of pairs with two middles.
    z = {f"e{k}": rng.integers(0, 9, rng.integers(1, 7)) / 2 + k / 2 for k in range(9)}
    rows = [(e, 0.0, 0.0, float(v)) for e, vs in z.items() for v in vs] + [("e0", 0.0, 0.0, None), ("e9", 0.0, 0.0, None), ("-1", 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "entity string, x double, y double, z double")
    names = sorted(z)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    asked = spark.createDataFrame([*pairs, ("e0", "e9"), ("e0", "none")], "a string, b string")
    dz = {(a, b): np.abs(z[a][:, None] - z[b][None, :]).ravel() for a, b in pairs}
    got = lambda **gate: sorted((r.a, r.b) for r in grid.close_in_z(asked, df, **gate).collect())
    for bound in (0.0, 0.5, 1.25, 1.5):
        assert got(most_median=bound) == [p for p in pairs if np.median(dz[p]) <= bound]
    for near, n in ((0.5, 2), (1.0, 3)):
        assert got(close=near, least_close=n) == [p for p in pairs if (dz[p] < near).sum() >= n]
    assert got(most_median=1.5, close=1.0, least_close=3) == [p for p in pairs if np.median(dz[p]) <= 1.5 and (dz[p] < 1.0).sum() >= 3]
    assert len(got()) == len(pairs) + 2
    for bad in ({"most_median": -1.0}, {"close": 0.0, "least_close": 1}):
        with pytest.raises(ValueError):
            grid.close_in_z(asked, df, **bad)


def test_grid_edges(cloud):
    xyz, df = cloud
    b = np.floor(xyz / 2.0).astype(int)
    d = np.linalg.norm(xyz[:, None] - xyz[None], axis=2)
    near = (np.abs(b[:, None] - b[None]) <= 1).all(2)
    got = [(r.src, r.dst) for r in graph.grid_edges(df, 2.0, "8", 2.0, 1, 1.5).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, j in zip(*np.nonzero(near & (d <= 1.5))) if i < j}


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(0, k) for k in range(500, 700)] + [(k, k + 1) for k in range(1000, 1060)] + [(None, 3), (5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in parent}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_hulls_of_a_dense_disc_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    turn, far = rng.uniform(0, 2 * np.pi, 3000), np.sqrt(rng.random(3000))
    disc = np.vstack([np.c_[far * np.cos(turn), far * np.sin(turn)], np.c_[np.cos(turn[:400]), np.sin(turn[:400])]])

    def vertices(p):
        """Points from which all others lie on one side of the line to some other point."""
        near = p[np.hypot(*p.T) > 0.97]
        return {tuple(a) for a in near for d in [near - a] if any((e[0] * d[:, 1] - e[1] * d[:, 0] >= 0).all() for e in d if e.any())}

    sets = {"disc": disc, "three": np.array([[0, 0], [1, 0], [0, 1.0]]), "two": np.array([[0, 0], [1, 1.0]])}
    points = spark.createDataFrame([(k, float(x), float(y)) for k, p in sets.items() for x, y in p], "k string, x double, y double")
    want = vertices(disc)
    assert len(want) >= 400
    for part_rows in (100, 10**6):
        got = {r.polygon: [tuple(v) for v in r.ring] for r in graph.hulls(points, "k", part_rows=part_rows).collect()}
        assert set(got) == {"disc", "three"} and len(got["three"]) == 3
        assert len(got["disc"]) == len(want) and set(got["disc"]) == want


def test_hull_holds_its_middle():
    p = np.random.default_rng(0).random((40, 2))
    ring = graph.hull(p)
    assert spatial_join.inside(p.mean(0)[:1], p.mean(0)[1:], ring)[0]


def test_component_delaunay_query_loses_no_edge(spark, sf_dir):
    from entitygraph.plans import queries as Q

    centres = tiling.centroids(Q._points(spark, sf_dir)).select("x", "y").distinct().toPandas().to_numpy(float)
    assert Q.QUERIES["component_delaunay"](spark, sf_dir).count() == 3 * len(centres) - 3 - len(graph.hull(centres))


@pytest.mark.parametrize("size", [None, 0.7, 50.0])
def test_points_in_polygons_equal_rays_against_all(spark, size):
    """Stars, a sliver, a polygon with level and upright sides, one across everything, and points on vertices and bin borders."""
    rng = np.random.default_rng(1)
    rings = {f"star{k}": [(cx + r * np.cos(t), cy + r * np.sin(t)) for t, r in zip(np.linspace(0, 6, 9), rng.uniform(0.2, 3, 9), strict=True)] for k, (cx, cy) in enumerate(rng.uniform(-5, 10, (15, 2)))}
    rings |= {"box": [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0)], "sliver": [(-6.0, -6.0), (12.0, 12.0), (12.0, 12.01)], "zall": [(-90.0, -90.0), (90.0, -90.0), (0.0, 120.0)], "two": [(0.0, 0.0), (1.0, 1.0)]}
    at = np.concatenate([rng.uniform(-7, 13, (400, 2)), rng.integers(-5, 9, (150, 2)) * 0.5, [v for r in rings.values() for v in r]])
    want = []
    for x, y in at:
        held = [n for n, r in rings.items() if len(r) > 2 and spatial_join.inside(np.array([x]), np.array([y]), np.array(r))[0]]
        want.append(min(held, default=None))
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)] + [(-1, None, 1.0)], "id long, x double, y double")
    polygons = spark.createDataFrame([(n, [{"x": float(x), "y": float(y)} for x, y in r]) for n, r in rings.items()] + [("none", None)], "polygon string, ring array<struct<x:double,y:double>>")
    got = {r.id: r.polygon for r in spatial_join.point_in_polygon(points, polygons, size).collect()}
    assert got.pop(-1) is None and [got[i] for i in range(len(at))] == want and len(set(want)) > 10


def test_translation_and_partitions(cloud):
    _, df = cloud
    base = {(r.lo, r.hi): r.n_records for r in grid.witness_pairs(grid.build_index(df, 2.0), "8").collect()}
    moved = df.withColumns({"x": F.col("x") + 200.0, "y": F.col("y") - 400.0}).repartition(7)
    assert {(r.lo, r.hi): r.n_records for r in grid.witness_pairs(grid.build_index(moved, 2.0), "8").collect()} == base


def test_tiles_and_chunks(spark):
    points = synthetic.planted_cells(spark, cells=16, per_cell=20, noise=0.2)
    centres = tiling.centroids(points.where("cell <> '-1'"))
    parted = tiling.balanced_partition(centres, 4)
    assert sorted(r["count"] for r in parted.groupBy("part").count().collect()) == [4, 4, 4, 4]
    chunked = tiling.chunk_points(points.select("id", "cell", "x", "y"), parted)
    assert chunked.count() == points.count() == chunked.select("id").distinct().count() and chunked.where("part is null").count() == 0
    assert tiling.chunk_summary(chunked).agg(F.sum("n_points")).first()[0] == 320


def test_segmentations(spark):
    points = synthetic.planted_cells(spark)
    same = synthetic.voronoi_segmentation(points).agg(F.avg((F.col("cell") == F.col("truth")).cast("int"))).first()[0]
    assert same > 0.95
    grown = synthetic.nuclear_segmentation(points, 2.5, 6.0)
    assert grown.count() == 200 and 1 < grown.where("cell <> '-1'").select("cell").distinct().count() <= 16


def test_nearest_neighbours_make_no_pair_beyond_those_kept(spark, monkeypatch):
    """Dense places, places that many share, and cubes that are halved and cut into parts; the search joins nothing by distance."""
    rng = np.random.default_rng(5)
    at = np.round(np.concatenate([rng.normal(0, 0.3, (150, 3)), rng.uniform(-4, 4, (60, 3)), np.tile([[0.5, 0.5, 0.5]], (25, 1))]), 2)
    df = spark.createDataFrame([(int(i), *map(float, p)) for i, p in enumerate(at)] + [(900, None, 0.0, 0.0), (901, float("nan"), 0.0, 0.0)], "id long, x double, y double, z double")
    d = np.round(np.sqrt(((at[:, None] - at[None]) ** 2).sum(2)), 6)
    want = {(i, j) for i in range(len(at)) for _, j in sorted((d[i, j], j) for j in range(len(at)) if j != i and d[i, j] <= 1.5)[:4]}
    monkeypatch.setattr(spatial_join, "radius_join", None)
    for rows in (100_000, 60, 3):
        got = [(r.src, r.dst) for r in spatial_join.knn_capped(df, 4, 1.5, tile_rows=rows).collect()]
        assert len(got) == len(want) and set(got) == want


def test_dense_cubes_take_less_than_the_radius_around_them(spark, monkeypatch):
    """Where cubes are narrowed to the radius by the number of their points, rows are dealt a few times, not to all cubes around."""
    rng = np.random.default_rng(8)
    at = np.round(rng.uniform(0, 4, (40_000, 3)), 4)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "id long, x double, y double, z double").repartition(2)
    dealt, of_cubes = [], spatial_join._knn_of_cubes

    def seen(own, others, fit, *k):
        dealt.append(others.join(fit, ["_b0", "_b1", "_b2"]).agg(F.coalesce(F.sum("_parts"), F.lit(0))).first()[0])
        return of_cubes(own, others, fit, *k)

    monkeypatch.setattr(spatial_join, "_knn_of_cubes", seen)
    got = {(r.src, r.dst) for r in spatial_join.knn_capped(df, 2, 1.0, tile_rows=12_000).collect()}
    src, dst, _ = spatial_join.nearest_k(at, np.arange(len(at)), at, np.arange(len(at)), 2, 1.0)
    assert got == set(zip(src.tolist(), dst.tolist(), strict=True))
    assert sum(dealt) < 6 * len(at), dealt


def test_nearest_k_of_one_label_is_bounded_in_memory():
    import tracemalloc

    at = np.round(np.random.default_rng(6).normal(0, 1, (20_000, 3)), 4)
    tracemalloc.start()
    src, dst, length = spatial_join.nearest_k(at, np.arange(len(at)), at, np.arange(len(at)), 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400e6 and len(src) == 3 * len(at)
    for i in (0, 77, 19_999):
        d = np.round(np.sqrt(((at - at[i]) ** 2).sum(1)), 6)
        assert sorted(zip(np.round(length[src == i], 6), dst[src == i])) == sorted((d[j], j) for j in range(len(at)) if j != i)[:3]


def test_pairs_across_tiles_shuffle_no_pairs(spark, capsys):
    c = spark.createDataFrame([(f"e{i}", i % 2, float(i % 7) / 10, 0.0, 0.0) for i in range(40)], "entity string, tile int, x double, y double, z double")
    found = spatial_join.cross_tile_pairs(c, 0.15)
    found.explain()
    assert capsys.readouterr().out.count("Join") == 1
    rows = c.collect()
    want = {(a.entity, b.entity) for a in rows for b in rows if a.entity < b.entity and a.tile != b.tile and abs(a.x - b.x) <= 0.15}
    assert {(r.a, r.b) for r in found.collect()} == want
