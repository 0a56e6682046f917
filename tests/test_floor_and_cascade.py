"""The automatic floor by its rule, and the cascade and the guard on rows of the panel only."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from entitygraph.operators import kernels, stages
from entitygraph.plans import queries as Q


def floor_of(counts, coverage=0.65, hard_min=2, radius=1, ceiling=None):
    """By the rule: the first threshold from above whose bins and those around them hold enough rows."""
    total = sum(counts.values())
    for t in range(ceiling or max(counts.values(), default=0), hard_min - 1, -1):
        near = {(x + dx, y + dy) for (x, y), n in counts.items() if n >= t for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1)}
        if sum(n for b, n in counts.items() if b in near) / total >= coverage:
            return t
    return hard_min


def both(spark, counts, **k):
    grid = np.zeros([1 + max((b[d] for b in counts), default=0) for d in (0, 1)], int)
    for b, n in counts.items():
        grid[b] = n
    df = spark.createDataFrame([(*b, n) for b, n in counts.items()], "bx int, by int, n long")
    got = stages.auto_floor(df, **k).first()[0]
    assert got == kernels.density_floor(grid, **k) == (floor_of(counts, **k) if counts else k.get("hard_min", 2))
    return got


def test_the_floor_by_its_rule(spark):
    assert both(spark, {}) == 2
    assert both(spark, {(5, 5): 5}) == 5
    assert both(spark, {(i, i): 1 for i in range(0, 100, 10)}) == 2
    assert both(spark, {(i, j): 10 for i in range(8) for j in range(8)}) == 10
    assert both(spark, {(0, 0): 100, **{(i, 9): 1 for i in range(0, 20, 2)}}) == 100  # by rows, not by bins
    assert both(spark, {(0, 0): 100, (9, 9): 7}, ceiling=20) == 20


def test_random_floors(spark):
    rng = np.random.default_rng(5)
    for k in range(3):
        counts = {(i, j): int(n) for (i, j), n in np.ndenumerate(rng.poisson(1 + k, (12, 9))) if n}
        for more in ({}, {"coverage": 0.9, "radius": 2}, {"hard_min": 3, "coverage": 0.99}):
            both(spark, counts, **more)


def panel(spark):
    pairs = [("a", "b"), ("a", "c"), ("b", "c")]
    return spark.createDataFrame([(*p, 1.0) for p in pairs], "gi string, gj string, w double")


def test_features_outside_the_panel_move_nothing(spark):
    clump = [(10 * b + i, "abc"[i], 2.0 * b * 3 + 0.1 * i, 0.5) for b in range(10) for i in range(3)]
    off = [(1000 + i, "control", 500.0 + 0.001 * i, 80.0) for i in range(360)]
    cascade = lambda rows: {r.id: r.entity for r in stages.density_cascade(spark.createDataFrame([(i, f, x, y, 0.0, "-1", "unknown") for i, f, x, y in rows], "id long, feature string, x double, y double, z double, entity string, etype string"), stages.Panel(panel(spark)), 2.0).collect()}
    alone = cascade(clump)
    assert len(alone) == 30 and cascade(clump + off) == alone


def test_guard_and_gate_on_rows_of_the_panel(spark):
    rows = [(i, "a", 0.1 * i, 0.1, 0.0) for i in range(4)] + [(10 + i, "control", 0.1 * i, 0.1, 0.0) for i in range(9)] + [(20 + i, "b", 0.1 * i, 0.1, None if i else 0.0) for i in range(5)]
    df = spark.createDataFrame([(*r, "-1", "unknown") for r in rows], "id long, feature string, x double, y double, z double, entity string, etype string")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(stages.guarded(df, 2.0, 3, stages.vocabulary(panel(spark)))) == [0, 1, 2, 3]
    assert ids(stages.guarded(df, 2.0, 3)) == [0, 1, 2, 3, *range(10, 19)]
    sets = spark.createDataFrame([("e", "control"), ("f", "a"), ("f", "control")], "entity string, feature string")
    pairs = spark.createDataFrame([("a", "e"), ("b", "f"), ("control", "f")], "feature string, entity string")
    rule = kernels.Admission(mode="mean", real_signal=0, mean_threshold=0.5)
    assert sorted((r.feature, r.entity) for r in stages.gate(pairs, sets, panel(spark), rule).collect()) == [("a", "e"), ("b", "f")]


def prune(genes, w, threshold):
    genes = sorted(genes)
    while len(genes) > 1:
        score = {g: sum((g, h) in w and w[g, h] < threshold for h in genes if h != g) for g in genes}
        if not max(score.values()):
            break
        genes.remove(min(genes, key=lambda g: (-score[g], g)))
    return genes


@pytest.fixture(scope="module")
def grouped(spark, sf_dir):
    """The cascade of the query restated row by row: groups as sets of ids, with the threshold of each."""
    w = {}
    for r in Q._panel(spark, sf_dir).collect():
        if not r.gi.endswith("5") and not r.gj.endswith("5"):
            w[r.gi, r.gj] = w[r.gj, r.gi] = r.w
    known = {g for g, _ in w}
    rows = [r for r in Q._rows(spark, sf_dir).where("label = '-1'").collect() if r.feature in known]
    x0, y0 = min(r.x for r in rows), min(r.y for r in rows)
    counts = Counter((int((r.x - x0) // 1), int((r.y - y0) // 1)) for r in rows)
    high, low = max(counts.values()), floor_of(counts)
    bins = {}
    for r in sorted(rows, key=lambda r: r.id):
        bins.setdefault((int(r.x // 1), int(r.y // 1)), []).append(r)
    groups = []
    for t in range(high, low - 1, -1):
        for n, b in sorted(((len(v), b) for b, v in bins.items() if len(v) >= t), key=lambda p: (-p[0], p[1])):
            around = [b2 for b2 in ((b[0] + dx, b[1] + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)) if b2 in bins]
            near = [r for b2 in around for r in bins[b2]]
            if len(bins[b]) < t or len(near) < 3:
                continue
            seed = prune({r.feature for r in near}, w, Q.NEGATIVE)
            taken = {r.id for r in near if r.feature in seed}
            if len(seed) < 2 or len(taken) < 3:
                continue
            groups.append(taken)
            for b2 in around:
                bins[b2] = [r for r in bins[b2] if r.id not in taken]
    return groups


@pytest.mark.parametrize("island_rows", [None, 40])
def test_cascade_query_equals_its_rule(spark, sf_dir, grouped, monkeypatch, island_rows):
    if island_rows:
        plain = stages.density_cascade
        monkeypatch.setattr(stages, "density_cascade", lambda *a, **k: plain(*a, **k, island_rows=island_rows))
    got = Q.QUERIES["cascade"](spark, sf_dir).groupBy("entity").agg(F.collect_set("id").alias("ids")).collect()
    assert len(grouped) > 20
    assert sorted(sorted(r.ids) for r in got) == sorted(sorted(g) for g in grouped)


def test_the_cascade_by_counts_takes_what_it_takes_row_by_row():
    rng = np.random.default_rng(8)
    for _ in range(4):
        rows = rng.integers(0, 4, (90, 2))
        genes = rng.integers(0, 6, 90)
        w = np.round(rng.normal(0, 1, (6, 6)), 2)
        w = w + w.T
        groups, n = np.unique(np.column_stack([rows, genes]), axis=0, return_counts=True)
        by_row = [(t, d, x, y, len(r)) for t, d, x, y, r in kernels.cascade(*rows.T, genes, w, 1000, 1, threshold=-1.0)]
        taken = kernels.cascade(*groups.T, w, 1000, 1, threshold=-1.0, n=n)
        assert [(t, d, x, y, n[r].sum()) for t, d, x, y, r in taken] == by_row
        # The plain rule: every threshold, every centre.
        free, plain = Counter({tuple(g): c for g, c in zip(groups.tolist(), n.tolist(), strict=True)}), []
        for t in range(n.sum(), 0, -1):
            size = lambda b: sum(c for (x, y, _), c in free.items() if (x, y) == b)
            for d, b in sorted(((size(b), b) for b in {g[:2] for g in free} if size(b) >= t), key=lambda p: (-p[0], p[1])):
                near = {g: c for g, c in free.items() if max(abs(g[0] - b[0]), abs(g[1] - b[1])) <= 1 and c}
                seed = kernels.greedy_prune(np.unique([g[2] for g in near]), w, -1.0) if size(b) >= t and sum(near.values()) >= 3 else ()
                mine = {g: c for g, c in near.items() if g[2] in seed}
                if len(seed) >= 2 and sum(mine.values()) >= 3:
                    plain.append((t, d, *b, sum(mine.values())))
                    free -= Counter(mine)
        assert plain == by_row
