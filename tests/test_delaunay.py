"""Delaunay neighbours against all empty spheres, Euler's formula, and themselves at other tile sizes."""

from itertools import combinations

import numpy as np
import pytest

from entitygraph.operators import delaunay
from entitygraph.operators.graph import hull


def brute(points):
    """Edges of all simplices whose sphere holds no other point."""
    n, dims = points.shape
    out = set()
    for s in combinations(range(n), dims + 1):
        a = points[list(s)]
        m = 2 * (a[1:] - a[0])
        if abs(np.linalg.det(m)) < 1e-12:
            continue
        centre = np.linalg.solve(m, (a[1:] ** 2).sum(1) - (a[0] ** 2).sum())
        r2 = ((a[0] - centre) ** 2).sum()
        if (((points - centre) ** 2).sum(1) >= r2 * (1 - 1e-9)).all():
            out |= set(combinations(s, 2))
    return out


def edges(spark, points, **k):
    axes = ("x", "y", "z")[: points.shape[1]]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], f"id long, {', '.join(f'{c} double' for c in axes)}")
    rows = delaunay.neighbours(df, axes, **k).collect()
    assert all(abs(r.length - np.linalg.norm(points[r.a] - points[r.b])) < 1e-9 and r.a < r.b for r in rows) and len({(r.a, r.b) for r in rows}) == len(rows)
    return {(r.a, r.b) for r in rows}


@pytest.mark.parametrize(("dims", "n"), [(2, 60), (3, 26)])
def test_equal_all_empty_spheres(spark, dims, n):
    points = np.random.default_rng(dims).uniform(0, 10, (n, dims))
    want = brute(points)
    assert edges(spark, points) == want
    assert edges(spark, points, tile_points=2, open_points=3, part_points=9) == want


def test_cells_of_one_worker():
    """Every cell by itself, over clustered points."""
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(0, 0.1, (15, 3)), rng.normal(5, 3, (15, 3))])
    got = {tuple(sorted((k, int(j)))) for k in range(30) for j in delaunay.cell_of(points[k], points, 1e6)[0]}
    assert got == brute(points)


def test_no_edge_is_lost_at_borders(spark):
    """A planar triangulation of n points with h on the hull has 3 n - 3 - h edges."""
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.uniform(0, 100, (900, 2)), rng.normal(50, 0.5, (500, 2))])
    got = edges(spark, points, open_points=50)
    assert len(got) == 3 * len(points) - 3 - len(hull(points))
    ring = [tuple(p) for p in hull(points)]
    at = {tuple(p): i for i, p in enumerate(points)}
    assert all(tuple(sorted((at[p], at[q]))) in got for p, q in zip(ring, ring[1:] + ring[:1], strict=True))


def test_space_does_not_depend_on_tiles(spark):
    points = np.random.default_rng(2).uniform(0, 10, (400, 3))
    assert edges(spark, points, tile_points=20, open_points=10, part_points=300) == {tuple(sorted((k, int(j)))) for k in range(400) for j in delaunay.cell_of(points[k], points, 1e5)[0]}


def test_awkward_points(spark):
    assert edges(spark, np.zeros((0, 2))) == set() == edges(spark, np.zeros((1, 2)))
    assert edges(spark, np.array([[0.0, 0.0], [1.0, 1.0]])) == {(0, 1)}
    assert edges(spark, np.array([[0.0, 0.0], [1.0, 0.0], [2.0, 0.0], [3.0, 0.0]])) == {(0, 1), (1, 2), (2, 3)}
    assert edges(spark, np.array([[0.0, 0.0], [0.0, 0.0], [1.0, 0.0]])) == {(0, 2)}  # one of those in one place
    square = edges(spark, np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [1.0, 1.0]]))
    assert square == {(0, 1), (0, 2), (1, 3), (2, 3)}  # no diagonal has an extent
    df = spark.createDataFrame([(1, 0.0, None), (2, 1.0, 1.0), (3, 0.0, 1.0)], "id long, x double, y double")
    assert [(r.a, r.b) for r in delaunay.neighbours(df).collect()] == [(2, 3)]
    with pytest.raises(ValueError, match="axes"):
        delaunay.neighbours(df, ("x",))


@pytest.mark.parametrize("dims", [2, 3])
def test_cells_cut_together_equal_cells_cut_alone(monkeypatch, dims):
    """Many cells in step, from the nearest and from what lies nearest to their corners; a lattice keeps no diagonal."""
    rng = np.random.default_rng(dims)
    lattice = np.stack(np.meshgrid(*[np.arange(5.0)] * dims), -1).reshape(-1, dims)
    for points in (np.concatenate([rng.normal(0, 0.01, (80, dims)), rng.normal(3, 2, (60, dims))]), lattice):
        want = {(k, int(j)) for k in range(len(points)) for j in delaunay.cell_of(points[k], points, 1e5)[0]}
        with monkeypatch.context() as m:
            m.setattr(delaunay, "cell_of", None)  # no cell is cut by itself
            cells, others, _ = delaunay.cells_of(points, points, 1e5)
        assert set(zip(cells.tolist(), others.tolist(), strict=True)) == want and len(cells) == len(want)


def test_open_cells_meet_open_cells_only(spark, monkeypatch):
    """Clusters with voids between: later turns get the points that stayed open, not all, and lose no edge."""
    rng = np.random.default_rng(7)
    points = np.concatenate([rng.normal(c, 0.3, (250, 2)) for c in ((0, 0), (30, 4), (11, 25), (40, 40))])
    dealt, tiles = [], delaunay._settle_tiles

    def seen(open_, *k):
        dealt.append(open_.count())
        return tiles(open_, *k)

    monkeypatch.setattr(delaunay, "_settle_tiles", seen)
    got = edges(spark, points, tile_points=20, open_points=5, part_points=40)
    assert got == {tuple(sorted((k, int(j)))) for k in range(len(points)) for j in delaunay.cell_of(points[k], points, 1e6)[0]}
    assert len(dealt) > 1 and dealt[0] == len(points) and all(n < len(points) / 2 for n in dealt[1:])
