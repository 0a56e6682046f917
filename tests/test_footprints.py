"""Footprints against brute force over small sets of bins."""

import random

import numpy as np
from pyspark.sql import functions as F

from entitygraph.operators import footprints

SIDES = ((1, 0), (-1, 0), (0, 1), (0, -1))


def table(spark, sets):
    rows = [(e, x + 0.5, y + 0.5) for e, bins in sets.items() for x, y in bins]
    return spark.createDataFrame(rows, "entity string, x double, y double")


def pieces(bins):
    left, out = set(bins), []
    while left:
        todo, one = [left.pop()], set()
        while todo:
            x, y = todo.pop()
            one.add((x, y))
            for dx, dy in SIDES:
                if (x + dx, y + dy) in left:
                    left.remove((x + dx, y + dy))
                    todo.append((x + dx, y + dy))
        out.append(one)
    return out


def brute_links(bins):
    """Kruskal over all pairs of bins: the links longer than one step."""
    root = {b: b for b in bins}

    def find(b):
        while root[b] != b:
            b = root[b]
        return b

    out = set()
    for d, lo, hi in sorted((abs(a[0] - b[0]) + abs(a[1] - b[1]), a, b) for a in bins for b in bins if a < b):
        if find(lo) != find(hi):
            root[find(lo)] = find(hi)
            if d > 1:
                out.add((d, lo, hi))
    return out


def brute_holes(bins):
    xs, ys = [b[0] for b in bins], [b[1] for b in bins]
    box = {(x, y) for x in range(min(xs) - 1, max(xs) + 2) for y in range(min(ys) - 1, max(ys) + 2)}
    wet = [p for p in pieces(box - bins) if (min(xs) - 1, min(ys) - 1) in p][0]
    return box - bins - wet


def sets_of(seed):
    r = random.Random(seed)
    out = {f"e{k}": {(r.randrange(w), r.randrange(w)) for _ in range(n)} for k, (w, n) in enumerate([(6, 20), (9, 45), (40, 25), (150, 12), (3, 1), (12, 100)])}
    out["a:1"], out["a"] = {(3, 2)}, {(2, 1), (3, 2)}
    out["below zero"] = {(x - 70, y - 200) for x, y in out["e2"]}
    out["ring in a ring"] = {(x, y) for x in range(9) for y in range(9) if max(abs(x - 4), abs(y - 4)) in (2, 4)}
    out["two lines"] = {(x, y) for x in range(30) for y in (0, 7)}
    out["wide"] = {(0, 0), (0, 1), (0, 2), (200, 0), (200, 1), (200, 2), (1, 0), (1, 2)} | {(x, y) for x in range(2, 200) for y in (0, 2)}
    return out


def test_holes_links_and_bridges_equal_brute_force(spark):
    sets = sets_of(5)
    rows = table(spark, sets)
    bins = footprints.bins_of(rows, 1.0).cache()

    got = {e: set() for e in sets}
    for r in footprints.holes(bins).collect():
        assert (r.bx, r.by) not in got[r.entity]
        got[r.entity].add((r.bx, r.by))
    assert got == {e: brute_holes(b) for e, b in sets.items()}

    groups = {}
    for r in footprints.parts(bins).collect():
        groups.setdefault((r.entity, r.part), set()).add((r.bx, r.by))
    assert sorted((e, sorted(v)) for (e, _), v in groups.items()) == sorted((e, sorted(p)) for e, b in sets.items() for p in pieces(b))

    corner = {e: (min(x for x, _ in b), min(y for _, y in b)) for e, b in sets.items()}
    links = {e: set() for e in sets}
    moved = bins.join(bins.groupBy("entity").agg(F.min("bx").alias("x0"), F.min("by").alias("y0")), "entity").selectExpr("entity", "bx - x0 AS bx", "by - y0 AS by")
    for r in footprints.spanning_links(moved).collect():
        x0, y0 = corner[r.entity]
        links[r.entity].add((r.d, (r.lo.bx + x0, r.lo.by + y0), (r.hi.bx + x0, r.hi.by + y0)))
    assert links == {e: brute_links(b) for e, b in sets.items()}

    kinds = {e: {} for e in sets}
    for r in footprints.kinds(rows, 1.0).collect():
        assert (r.bx, r.by) not in kinds[r.entity]
        kinds[r.entity][r.bx, r.by] = r.kind
    for e, b in sets.items():
        full = {p for p, k in kinds[e].items() if k != "hole"}
        assert {p for p, k in kinds[e].items() if k == "raw"} == b
        assert {p for p, k in kinds[e].items() if k == "hole"} == brute_holes(full)
        # Lines take diagonal steps, so what is one part is so over sides and corners.
        assert len(pieces({(2 * x + i, 2 * y + j) for x, y in full for i in (-1, 0, 1) for j in (-1, 0, 1)})) == 1


def test_line_counts_and_rounding(spark):
    ends = spark.sql("SELECT 'a' AS entity, struct(0 AS bx, 0 AS by) AS lo, struct(4 AS bx, -2 AS by) AS hi")
    assert sorted((r.bx, r.by) for r in footprints.line(ends).collect()) == [(0, 0), (1, 0), (2, -1), (3, -1), (4, -2)]
    same = spark.sql("SELECT 'a' AS entity, struct(3 AS bx, 1 AS by) AS lo, struct(3 AS bx, 1 AS by) AS hi")
    assert [(r.bx, r.by) for r in footprints.line(same).collect()] == [(3, 1)]


def test_density_counts_and_empty_tables(spark):
    rows = table(spark, {"ring": {(x, y) for x in range(3) for y in range(3)} - {(1, 1)}, "pair": {(0, 0), (5, 0)}})
    rows = rows.unionByName(spark.createDataFrame([("ring", 0.1, 0.1), ("pair", None, 1.0), (None, 1.0, 1.0)], rows.schema))
    got = {r.entity: (r.n_points, r.n_raw, r.n_bridge, r.n_hole, r.n_filled, r.density) for r in footprints.footprint_density(rows, 1.0).collect()}
    assert got == {"ring": (9, 8, 0, 1, 9, 1.0), "pair": (2, 2, 4, 0, 6, 2 / 6)}
    assert footprints.footprint_density(rows.limit(0), 1.0).count() == 0
    assert footprints.footprint(rows.limit(0), 1.0).count() == 0


def test_small_entities_travel_whole_and_agree_with_large_ones(spark, monkeypatch):
    rows = table(spark, {f"{e}/{seed}": b for seed in (1, 2) for e, b in sets_of(seed).items()})
    split = sorted(footprints.kinds(rows, 1.0, small_bins=0).collect())

    def never(*a, **k):
        raise AssertionError("no rounds for small entities")

    monkeypatch.setattr(footprints, "components", never)
    monkeypatch.setattr(footprints, "SMALL_BOX", 10**6)
    assert sorted(footprints.kinds(rows, 1.0).collect()) == split
    counts = sorted((r.entity, r.n_raw, r.n_bridge, r.n_hole) for r in footprints.footprint_density(rows, 1.0).collect())
    number = lambda e, k: sum(r.entity == e and r.kind == k for r in split)
    assert counts == [(e, number(e, "raw"), number(e, "bridge"), number(e, "hole")) for e in sorted({r.entity for r in split})]


def test_many_small_entities_at_a_time(monkeypatch):
    bins = [(e, *b) for seed in range(30) for e, b in enumerate(sets_of(seed).values(), 20 * seed) for b in sorted(b)]
    owner, x, y = np.array(bins).T
    both = list(zip(*(c.tolist() for c in footprints.fill(owner, x, y)), strict=True))
    apart = [r for e in np.unique(owner) for r in zip(*(c.tolist() for c in footprints.fill(owner[owner == e], x[owner == e], y[owner == e])), strict=True)]
    assert sorted(both) == sorted(apart)
    filled = list(zip(*(c.tolist() for c in footprints.fill(owner, x, y, bridged=False)), strict=True))
    for e in np.unique(owner).tolist():
        assert {(a, b) for o, a, b, k in filled if o == e and k == 2} == brute_holes({(a, b) for o, a, b in bins if o == e})
