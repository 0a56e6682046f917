"""Stitching in blocks against one walk over all pairs; segments of coherence and gates on centres against recomputation."""

import itertools

import numpy as np
import pytest

from entitygraph.operators import kernels, stages

GENES = [f"g{k:02d}" for k in range(14)]


def weights(seed, absent=0.2):
    rng = np.random.default_rng(seed)
    w = np.triu(rng.normal(0, 0.4, (len(GENES), len(GENES))), 1)
    w[rng.random(w.shape) < absent] = np.nan
    return np.triu(w, 1) + np.triu(w, 1).T


def panel_of(spark, w):
    rows = [(GENES[i], GENES[j], float(w[i, j])) for i, j in itertools.combinations(range(len(GENES)), 2) if not np.isnan(w[i, j])]
    return stages.Panel(spark.createDataFrame(rows, "gi string, gj string, w double"))


def world(seed, n, spread=20.0):
    """Rows of n entities scattered in a square, every fifth a cell, and pairs of those that lie near each other."""
    rng = np.random.default_rng(seed)
    centres = rng.uniform(0, spread, (n, 2))
    rows, parts = [], []
    for k in range(n):
        size = int(rng.integers(3, 9))
        genes = rng.integers(0, len(GENES), size)
        at = np.c_[rng.normal(centres[k], 0.6, (size, 2)), rng.normal(0, 0.3, size)].round(4)
        kind = "cell" if k % 5 == 0 else "partial"
        rows += [(len(rows) + i, f"e{k:05d}", kind, GENES[g], *map(float, p)) for i, (g, p) in enumerate(zip(genes, at, strict=True))]
        parts.append(kernels.Part(np.unique(genes), size, kind == "cell", at))
    d = np.abs(centres[:, None] - centres[None]).max(2)
    pairs = [(a, b) for a, b in itertools.combinations(range(n), 2) if d[a, b] < 2.0]
    return rows, parts, pairs


RULES = {
    "plain": kernels.StitchRule(tau=0.1),
    "deep": kernels.StitchRule(tau=0.1, depth=50, least_gain=-0.5, absent_counts=False),
    "first": kernels.StitchRule(tau=0.1, centre_gate="first", rescue_distance=None),
    "last flipped": kernels.StitchRule(tau=0.1, centre_gate="last", centre_k=2, flipped=True, rescue_distance=None),
    "reach": kernels.StitchRule(tau=0.1, reach=1.5, most_members=3, penalized=False),
}


@pytest.mark.parametrize(("rule", "block"), [("plain", 1000), *((rule, 20) for rule in sorted(RULES))])
def test_blocks_and_turns_equal_one_walk(spark, rule, block):
    w = weights(3)
    rows, parts, pairs = world(11, 70)
    want = kernels.stitch(parts, pairs, w, RULES[rule])
    assert 1 < len(set(want.tolist())) < len(parts) - 3
    df = spark.createDataFrame(rows, "id long, entity string, etype string, feature string, x double, y double, z double")
    asked = spark.createDataFrame([(f"e{b:05d}", f"e{a:05d}") for a, b in pairs], "a string, b string")
    got = stages.stitch(df, panel_of(spark, w), asked, RULES[rule], block=block).collect()
    linked = {k for p in pairs for k in p}
    groups = {}
    for r in got:
        groups.setdefault(r.stitched, set()).add(int(r.entity[1:]))
    assert sorted(map(sorted, groups.values())) == sorted(sorted(k for k in linked if want[k] == root) for root in {want[k] for k in linked})


def test_a_pair_that_no_block_holds_is_worked_off(spark):
    """A block of one entity: no pair is ever inside one, so pairs that come first for both ends get their own."""
    w = weights(3)
    rows, parts, pairs = world(5, 12, 6.0)
    rule = RULES["deep"]
    want = kernels.stitch(parts, pairs, w, rule)
    df = spark.createDataFrame(rows, "id long, entity string, etype string, feature string, x double, y double, z double")
    asked = spark.createDataFrame([(f"e{a:05d}", f"e{b:05d}") for a, b in pairs], "a string, b string")
    got = {r.entity: r.stitched for r in stages.stitch(df, panel_of(spark, w), asked, rule, block=1).collect()}
    assert len(set(got.values())) == len({want[k] for p in pairs for k in p})


def test_features_by_lookup_equal_a_dense_block(spark, monkeypatch):
    w = weights(4)
    rows, _, pairs = world(6, 20, 6.0)
    df = spark.createDataFrame(rows, "id long, entity string, etype string, feature string, x double, y double, z double")
    asked = spark.createDataFrame([(f"e{a:05d}", f"e{b:05d}") for a, b in pairs], "a string, b string")
    run = lambda: sorted(map(tuple, stages.stitch(df, panel_of(spark, w), asked, RULES["plain"]).collect()))
    dense = run()
    monkeypatch.setattr(stages, "DENSE_FEATURES", 0)
    assert run() == dense


@pytest.mark.parametrize("absent_counts", [True, False])
def test_counts_of_a_union_equal_recomputation_after_every_merge(absent_counts):
    rng = np.random.default_rng(8)
    w = weights(8, 0.4)
    for _ in range(50):
        a, total = np.zeros(0, int), kernels.Counts()
        for _ in range(6):
            b = np.unique(rng.integers(0, len(GENES), rng.integers(0, 7)))
            total = kernels.union_counts(a, total, b, kernels.within(b, w, 0.1, absent_counts), w, 0.1, absent_counts)
            a = np.union1d(a, b).astype(int)
            assert total == kernels.within(a, w, 0.1, absent_counts)
            assert total.coherence == pytest.approx(kernels.coherence(a, w, 0.1, absent_counts))


def beyond(points, centre, k):
    if k <= 1:
        return bool(len(points)) and all(points[:, d].min() <= c <= points[:, d].max() for d, c in enumerate(centre))
    return all((points[:, d] > c).sum() >= k and (points[:, d] < c).sum() >= k for d, c in enumerate(centre))


def test_rims_count_points_beyond_a_centre_before_and_after_mergers():
    rng = np.random.default_rng(2)
    seen = []
    for _ in range(200):
        clouds = [rng.integers(0, 12, (int(rng.integers(0, 15)), 3)).astype(float) for _ in range(4)]
        most = int(rng.integers(1, 5)) if rng.random() < 0.7 else None
        rim, points = kernels.Rim.of(clouds[0], most), clouds[0]
        for c in clouds[1:]:
            rim, points = rim.merged(kernels.Rim.of(c, most)), np.concatenate([points, c])
            centre, k = rng.integers(0, 12, 3) * 1.0, int(rng.integers(1, (most or 6) + 1))
            seen.append(rim.surrounds(centre, k))
            assert seen[-1] == (beyond(points, centre, k) and (k <= 1 or len(points) >= 2 * k))
    assert 50 < sum(seen) < len(seen) - 50


def test_gate_on_centres_literally():
    """A small entity in the middle of a large one merges though the gain is bad, and not beside it; flipped, a cell amid a ring does."""
    w = np.array([[np.nan, 1, -1, -1], [1, np.nan, -1, -1], [-1, -1, np.nan, 1], [-1, -1, 1, np.nan]], float)
    ring = np.array([[np.cos(t) * 3, np.sin(t) * 3, 0.1 * (-1) ** k] for k, t in enumerate(np.linspace(0, 2 * np.pi, 12, endpoint=False))])
    speck = np.array([[0.1, 0.1, 0.0], [-0.1, -0.1, 0.01]])
    part = lambda genes, at: kernels.Part(np.array(genes), len(at), False, at)
    root = lambda a, b, **k: kernels.stitch([a, b], [(0, 1)], w, kernels.StitchRule(rescue_distance=None, **k)).tolist()
    assert root(part([0, 1], ring), part([2, 3], speck)) == [0, 1]
    assert root(part([0, 1], ring), part([2, 3], speck), centre_gate="first") == [0, 0]
    assert root(part([0, 1], ring), part([2, 3], speck), centre_gate="last") == [0, 0]
    assert root(part([0, 1], ring), part([2, 3], speck + 9), centre_gate="first") == [0, 1]
    assert root(part([0, 1], ring), part([2, 3], speck), centre_gate="first", centre_k=7) == [0, 1]  # six of twelve at most lie on a side
    dense = np.random.default_rng(0).normal(0, 0.2, (40, 3))
    assert root(part([0, 1], dense), part([2, 3], ring), centre_gate="last", flipped=True, centre_k=3) == [0, 0]
    assert root(part([0, 1], dense), part([2, 3], ring + [9, 0, 0]), centre_gate="last", flipped=True, centre_k=3) == [0, 1]


def test_the_penalty_counts_features():
    w = np.full((4, 4), 0.5)
    a, b = kernels.Part(np.array([0, 1]), 1000, False, np.zeros((0, 3))), kernels.Part(np.array([1, 2]), 1000, False, np.zeros((0, 3)))
    assert kernels.Mergers([a, b], w, kernels.StitchRule()).gain(0, 1)[0] == pytest.approx(1 - 1 / 4 - (1 - 1 / 2))


def test_candidates_from_delaunay_neighbours(spark):
    from entitygraph.operators import delaunay
    from entitygraph.plans import config, pipeline

    rows, parts, _ = world(9, 40, 12.0)
    df = spark.createDataFrame([*rows, (-1, "-1", "unknown", "g00", 1.0, 1.0, 0.0)], "id long, entity string, etype string, feature string, x double, y double, z double")
    centres = np.array([p.cloud.mean for p in parts])
    near = {tuple(sorted((k, int(j)))) for k in range(40) for j in delaunay.cell_of(centres[k], centres, 1e5)[0]}
    want = {(a, b) for a, b in near if np.linalg.norm(centres[a] - centres[b]) <= 2.5}
    got = pipeline.stitch_candidates(df, config.StitchConfig(source="delaunay", reach_um=2.5), 1.0).collect()
    assert {(int(r.a[1:]), int(r.b[1:])) for r in got} == want and 20 < len(want) < len(near)


def test_settings_of_gates():
    from entitygraph.plans import config

    assert config.StitchConfig().source == "grid" and config.StitchConfig().centre_gate is None
    for bad in ({"source": "x"}, {"centre_gate": "x"}, {"centre_k": 0}, {"reach_um": 0}, {"most_members": 1}):
        with pytest.raises(ValueError):
            config.StitchConfig(**bad)


def test_stitch_query_equals_one_walk(spark, sf_dir):
    """Entities, candidates and mergers of the registered query restated on the driver."""
    from collections import defaultdict

    from entitygraph.plans import queries as Q

    held = defaultdict(list)
    for r in sorted(Q._points(spark, sf_dir).collect(), key=lambda r: r.id):
        held[f"{int(r.x // 2)}_{int(r.y // 2)}-{int(r.z // 3) + 1}"].append(r)
    names = sorted(held)
    at = {n: k for k, n in enumerate(names)}
    panel = Q._panel(spark, sf_dir).collect()
    code = {g: k for k, g in enumerate(sorted({g for r in panel for g in (r.gi, r.gj)}))}
    w = np.full((len(code), len(code)), np.nan)
    for r in panel:
        w[code[r.gi], code[r.gj]] = w[code[r.gj], code[r.gi]] = r.w
    parts = [kernels.Part(np.unique([code[r.feature] for r in held[n] if r.feature in code]).astype(int), len(held[n]), False, np.array([(r.x, r.y, r.z) for r in held[n]], float)) for n in names]
    place = {tuple(map(int, n.replace("-", "_").split("_"))): n for n in names}
    pairs = [(at[n], at[place[q]]) for p, n in place.items() for dx, dy, dz in itertools.product((-1, 0, 1), repeat=3) if (q := (p[0] + dx, p[1] + dy, p[2] + dz)) in place and place[q] > n and min(len(held[n]), len(held[place[q]])) >= 2]
    root = kernels.stitch(parts, pairs, w, kernels.StitchRule())
    want = defaultdict(set)
    for k in {k for p in pairs for k in p}:
        want[root[k]].add(names[k])
    got = defaultdict(set)
    for r in Q.QUERIES["stitch"](spark, sf_dir).collect():
        got[r.stitched].add(r.entity)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert sum(len(g) > 1 for g in got.values()) > 50
