"""Kernels on literal sets, label stages on small tables, pipelines on planted cells."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from entitygraph.functions import labels as L
from entitygraph.operators import compare, entity, kernels, stages
from entitygraph.plans import config, pipeline
from entitygraph.sources import io, synthetic

NAN = np.nan


def matrix(n, seed, missing=0.3):
    rng = np.random.default_rng(seed)
    w = np.triu(rng.uniform(-1, 1, (n, n)), 1)
    w = w + w.T
    gone = np.triu(rng.random((n, n)) < missing, 1)
    w[gone | gone.T] = NAN
    return w


def spread_points(spark, sizes, seed=0):
    """Rows (id, entity, z) and the distances of all pairs of each entity of five rows or more."""
    rng = np.random.default_rng(seed)
    z = {e: np.round(rng.gamma(2, 3, n), 1) for e, n in sizes.items()}
    rows = [(i, e, float(v)) for i, (e, v) in enumerate((e, v) for e, vs in z.items() for v in vs)]
    pairs = {e: np.abs(np.subtract.outer(v, v))[np.triu_indices(len(v), 1)] for e, v in z.items() if len(v) >= 5}
    return spark.createDataFrame(rows, "id long, entity string, z double"), pairs


def test_z_scale_takes_all_pairs_of_its_entities(spark):
    rows, pairs = spread_points(spark, {"hot": 1500, "b": 40, "c": 5, **{f"s{k}": 4 for k in range(60)}})
    assert stages.z_scale(rows) == pytest.approx(kernels.z_threshold(np.concatenate(list(pairs.values()))), abs=1e-9)
    assert np.isnan(stages.z_scale(rows.where("id < 0"))) and np.isnan(stages.z_scale(rows.where("entity = 's1'")))


def test_z_threshold_of_counts():
    rng = np.random.default_rng(2)
    for v in (rng.gamma(2, 1, 300), np.concatenate([rng.normal(1, 0.1, 300), rng.normal(9, 0.2, 100)])):
        v = np.abs(np.round(v, 1))
        assert kernels.z_threshold(*np.unique(v, return_counts=True)[:1], counts=np.unique(v, return_counts=True)[1]) == pytest.approx(kernels.z_threshold(v))
        assert [kernels.weighted_percentile(*np.unique(v, return_counts=True), q) for q in (0, 33, 90, 100)] == pytest.approx(list(np.percentile(v, [0, 33, 90, 100])))


def test_pooled_dz_takes_all_entities(spark):
    rows, pairs = spread_points(spark, {**{str(k): 3 + k % 30 for k in range(120)}, "7-1": 50, "-1": 70})
    pool = np.concatenate([v for e, v in pairs.items() if "-" not in e])
    got = entity.pooled_dz(rows).first()
    assert (got.n, got.n_entities) == (len(pool), sum("-" not in e for e in pairs))
    assert [*got.p, got.mean, got.median, got.max] == pytest.approx([*np.percentile(pool, [50, 75, 90, 95, 99]), pool.mean(), np.median(pool), pool.max()])
    assert entity.pooled_dz(rows, kinds=None).first().n == len(pool) + 50 * 49 // 2
    assert entity.pooled_dz(rows.where("id < 0")).first().n == 0


@pytest.mark.parametrize("seed", range(5))
def test_greedy_prune_leaves_no_conflict(seed):
    w = matrix(12, seed)
    kept = kernels.greedy_prune(np.arange(12), w, -0.2)
    sub = w[np.ix_(kept, kept)]
    assert not (sub[~np.isnan(sub) & ~np.eye(len(kept), dtype=bool)] < -0.2).any() and len(kept) >= 1


def test_greedy_prune_ties_and_absent():
    w = np.full((3, 3), NAN)
    assert kernels.greedy_prune(np.arange(3), w, -0.1).tolist() == [0, 1, 2]
    w[0, 1] = w[1, 0] = -1
    assert kernels.greedy_prune(np.arange(3), w, -0.1).tolist() == [1, 2]
    zero = np.where(np.isnan(w), 0, w)
    assert len(kernels.greedy_prune(np.arange(3), zero, 0.2)) == 1  # absent as zero is a conflict below 0.2


def test_weighted_prune_protects():
    w = np.full((2, 2), NAN)
    w[0, 1] = w[1, 0] = -1
    assert kernels.greedy_prune_weighted(np.array([0, 1]), np.array([9, 2]), w, -0.1).tolist() == [0]
    assert kernels.greedy_prune_weighted(np.array([0, 1]), np.array([2, 9]), w, -0.1).tolist() == [1]


def test_admission():
    w = np.array([[0, 0.5, -0.3, NAN], [0.5, 0, 0.1, 0.01], [-0.3, 0.1, 0, NAN], [NAN, 0.01, NAN, 0]])
    a = lambda g, s, **k: kernels.admit(g, np.array(s, int), w, kernels.Admission(**k))
    assert not a(0, [])
    assert a(0, [1], mode="min") and not a(0, [1, 2], mode="min")
    assert a(3, [1], mode="mean", real_signal=0.05)  # no signal is no objection
    assert not a(3, [2], mode="mean", real_signal=0)  # nothing observed
    assert a(0, [1, 2], mode="mean", real_signal=0, mean_threshold=0.1, inclusive=True)
    assert not a(0, [1, 2], mode="mean", real_signal=0, mean_threshold=0.1)
    assert a(0, [1], mode="hybrid") and not a(0, [1, 2], mode="hybrid", mean_threshold=0.2)


def brute_stitch(parts, pairs, w, rule):
    parts, alive = list(parts), list(range(len(parts)))
    root = list(alive)
    gain = lambda a, b: kernels.coherence(np.union1d(a.genes, b.genes), w) - 1 / (len(a.genes) + len(b.genes)) - max(kernels.coherence(a.genes, w) - 1 / len(a.genes), kernels.coherence(b.genes, w) - 1 / len(b.genes))
    queue = sorted((-gain(parts[a], parts[b]), a, b) for a, b in pairs)
    queue = [q for q in queue if -q[0] >= rule.least_gain]
    for _, a, b in queue:
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        if a == b or (parts[a].is_cell and parts[b].is_cell) or max(parts[a].depth, parts[b].depth) >= rule.depth or gain(parts[a], parts[b]) < rule.least_gain:
            continue
        k, g = min(a, b), max(a, b)
        root[g] = k
        parts[k] = kernels.Part(np.union1d(parts[a].genes, parts[b].genes), parts[a].n + parts[b].n, parts[a].is_cell or parts[b].is_cell, parts[k].cloud, max(parts[a].depth, parts[b].depth) + 1)
    out = []
    for k in range(len(parts)):
        while root[k] != k:
            k = root[k]
        out.append(k)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_stitch_equals_plain_greedy(seed):
    rng = np.random.default_rng(seed)
    w = matrix(10, seed, 0.1)
    parts = [kernels.Part(np.unique(rng.integers(0, 10, 4)), int(rng.integers(2, 20)), bool(k % 4 == 0), rng.normal(size=(3, 3))) for k in range(12)]
    rule = kernels.StitchRule(bypass=9.0, rescue_distance=None)
    pairs = [p for p in itertools.combinations(range(12), 2) if rng.random() < 0.5]
    assert kernels.stitch(parts, pairs, w, rule).tolist() == brute_stitch(parts, pairs, w, rule)


def test_z_threshold():
    rng = np.random.default_rng(0)
    far = np.concatenate([np.abs(rng.normal(1, 0.1, 300)), np.abs(rng.normal(8, 0.1, 300))])
    assert 1.0 < kernels.z_threshold(far) < 1.4
    assert kernels.z_threshold(np.full(10, 2.0)) == 2.0


def rows_of(spark, data):
    return spark.createDataFrame(data, "id long, cell string, feature string, x double, y double, z double, nuclear boolean, entity string, etype string")


def labels_after(df):
    return {r.id: (r.entity, r.etype) for r in df.collect()}


def test_z_gap_split(spark):
    z = [0, 1, 2, 10, 11, 30]
    data = [(k, "c-x", "g", 0.0, 0.0, float(v), False, "c-x", "cell") for k, v in enumerate(z)] + [(50, "c-x", "g", 0.0, 0.0, 0.0, False, "c-x-4", "partial"), (51, "d", "g", 0.0, 0.0, None, False, "d", "cell")]
    got = labels_after(stages.z_gap_split(rows_of(spark, data), 2.0, 2))
    assert [got[k] for k in range(6)] == [("c-x", "cell")] * 3 + [("c-x-5", "partial")] * 2 + [("-1", "unknown")]
    # Entities without a jump stay, however small they are.
    assert got[50] == ("c-x-4", "partial") and got[51] == ("d", "cell")


def test_z_gap_split_of_components(spark):
    data = [(k, "-1", "g", 0.0, 0.0, float(z), False, e, "component") for k, (e, z) in enumerate([("UNASSIGNED_3", z) for z in (0, 1, 9)] + [("UNASSIGNED_4-1", z) for z in (0, 9)])]
    got = labels_after(stages.z_gap_split(rows_of(spark, data), 2.0, 1, ("component",)))
    assert [got[k] for k in range(5)] == [("UNASSIGNED_3", "component")] * 2 + [("UNASSIGNED_3-1", "component")] + [("UNASSIGNED_4-1", "component")] * 2
    pair = [(k, "c", "g", 0.0, 0.0, z, False, "c", "cell") for k, z in enumerate((0.0, 9.0))]
    assert {e for e, _ in labels_after(stages.z_gap_split(rows_of(spark, pair), 2.0, 1, least_entity=3)).values()} == {"c"}


def test_rerank(spark):
    label = lambda e, k, n, at: [(at + i, "p", "g", 0.0, 0.0, 0.0, i < n, e, k) for i in range(max(n, 1))]
    data = label("p", "cell", 1, 0) + label("p-1", "partial", 4, 10) + label("p-1-1", "partial", 0, 20) + label("p-2", "partial", 0, 30) + label("q-1", "partial", 5, 40)
    got = labels_after(stages.rerank(rows_of(spark, data)))
    assert got[10] == ("p", "cell") and got[20] == ("p-1", "partial") and got[0] == ("p-2", "partial") and got[30] == ("p-3", "partial") and got[40] == ("q-1", "partial")
    still = rows_of(spark, label("p", "cell", 3, 0) + label("p-1", "partial", 3, 10))
    assert labels_after(stages.rerank(still)) == labels_after(still)


def family(spark, sizes, margin=1):
    """Nuclear rows by label before and after."""
    data, k = [], 0
    for label, n in sizes.items():
        data += [(k + i, "42", "g", 0.0, 0.0, 0.0, True, label, "cell" if label == "42" else "partial") for i in range(n)]
        k += n
    got = labels_after(stages.rerank(rows_of(spark, data), margin))
    return {e: sum(x[0] == e for x in got.values()) for e, _ in got.values()}


def test_rerank_of_families(spark):
    assert family(spark, {"42": 2, "42-1": 4, "42-2": 7}) == {"42": 7, "42-1": 4, "42-2": 2}
    assert family(spark, {"42": 2, "42-1": 4, "42-1-1": 2}) == {"42": 4, "42-1": 2, "42-2": 2}
    assert family(spark, {"42": 1, "42-1": 5, "42-2": 5}) == {"42": 1, "42-1": 5, "42-2": 5}  # the two first are equal
    assert family(spark, {"42": 4, "42-1": 3, "42-1-1": 4}) == {"42": 3, "42-1": 4, "42-2": 4}  # a family counts whole
    assert family(spark, {"42": 3, "42-1": 4}, 3) == {"42": 3, "42-1": 4}
    assert family(spark, {"42": 4, "42-1": 4}) == {"42": 4, "42-1": 4}
    assert family(spark, {"42-1": 2, "42-2": 4, "42-2-7": 1}) == {"42": 4, "42-1": 1, "42-2": 2}  # a parent without a main label
    assert family(spark, {"42": 1, "42-1": 5, "42-2": 2, "42-2-4": 1, "42-2-9": 1}) == {"42": 5, "42-1": 2, "42-1-1": 1, "42-1-2": 1, "42-2": 1}


def test_admission_at_the_prune():
    w = np.full((11, 11), 0.6)
    np.fill_diagonal(w, NAN)
    w[10, :10] = w[:10, 10] = [0.5] * 7 + [-0.7] * 3
    genes, nuclear = np.arange(11), np.arange(11) < 10
    code = lambda rule: kernels.nuclear_seed(genes, nuclear, w, 0.0, 0.1, rule)[10]
    assert code(kernels.Admission(mode="mean", mean_threshold=0.1, inclusive=True)) == 0
    assert code(kernels.Admission(mode="hybrid", mean_threshold=0.2)) == 2
    w[10, :10] = w[:10, 10] = [-0.1, 0.9] * 5  # the mean is 0.4, the lower quartile -0.1
    assert code(kernels.Admission(mode="mean", mean_threshold=0.2, inclusive=True)) == 0
    w[10, :10] = w[:10, 10] = 0.01  # weak pairs count in a mean
    assert code(kernels.Admission(mode="mean", mean_threshold=0.2, inclusive=True)) == 2


def test_labels_of_mergers(spark):
    def named(rows, partials=None):
        m = spark.createDataFrame(rows, "entity string, root string, etype string, n long")
        p = spark.createDataFrame([(x,) for x in partials], "entity string") if partials else None
        return {r.entity: (r.stitched, r.etype) for r in stages.stitch_labels(m, p).collect()}

    part = lambda e, root, n=5: (e, root, "partial", n)
    assert named([part("7-1", "r"), part("7-2", "r")]) == {e: ("7-2-1", "partial") for e in ("7-1", "7-2")}
    assert named([part("7-1", "r"), part("8-1", "r", 9)], ["7-1", "8-1", "8-1-4"]) == {e: ("8-1-5", "partial") for e in ("7-1", "8-1")}
    assert named([part("7-1", "r"), part("7-1-3", "r"), part("7-1-2", "s")])["7-1"] == ("7-1-4", "partial")
    assert named([part("7-1", "r")]) == {"7-1": ("7-1", "partial")}
    assert named([("9", "r", "cell", 1), ("10", "r", "cell", 1), part("7-1", "r")])["7-1"] == ("10", "cell")
    assert named([("UNASSIGNED_7", "r", "component", 90), ("UNASSIGNED_3", "r", "component", 1)])["UNASSIGNED_7"] == ("UNASSIGNED_3", "component")
    two = named([part("7-1", "r"), part("7-1-1", "r"), part("7-1-2", "s"), part("6-1", "s")])
    assert two["6-1"] == ("7-1-3", "partial") and two["7-1"] == ("7-1-4", "partial")  # in the order of first names


def test_shielded_rows_compete(spark):
    data = [(k, "-1", "a", 0.1 * k, 0.0, 0.0, False, "-1", "unknown") for k in range(5)] + [(9, "-1", "b", 0.2, 0.0, 0.0, False, "-1", "unknown")]
    data += [(20 + k, "c", "b", 1.5, 0.1 * k, 0.0, False, "c", "cell") for k in range(3)]
    panel = spark.createDataFrame([("a", "b", 0.9)], "gi string, gj string, w double")
    take = lambda shield: {r.id: r.entity for r in stages.rescue(rows_of(spark, data), panel, 2.0, rank="distance", peers=3, shield=shield).collect()}
    assert take("exclude") == {9: "c"} and take("entity") == {}


def test_bin_edges_hang_together_as_all_edges(spark):
    from entitygraph.operators import graph

    rng = np.random.default_rng(5)
    data = [(k, "c", "g", *map(float, rng.uniform(0, 14, 2)), float(rng.uniform(0, 6)), False, f"e{k % 3}", "cell") for k in range(150)]
    rows = rows_of(spark, data)
    few, all_ = graph.bin_edges(rows, 2.0, 1.0), graph.grid_edges(rows, 2.0, "8", 1.0, 1)
    assert few.count() < all_.count()
    assert labels_after(stages.spatial_split(rows, few)) == labels_after(stages.spatial_split(rows, all_))


def test_sizes_and_finalize(spark):
    data = [(k, "c", "g", 0.0, 0.0, 0.0, False, e, t) for k, (e, t) in enumerate([("a", "cell")] * 2 + [("b-1", "partial")] * 2 + [("u", "cell")] * 4 + [(None, "unknown")])]
    rows = rows_of(spark, data)
    assert {e for e, _ in labels_after(stages.size_qc(rows, 3)).values()} == {"-1", "u", None}
    assert {e for e, _ in labels_after(stages.demote_small(rows, 3)).values()} == {"a", "demote_rejected", "u", None}
    done = L.finalize(rows, "entity", "cell")
    assert done.where("entity = 'UNASSIGNED' and cell <> '-1'").count() == 0
    assert L.stage_counts(rows, kind="etype").first().asDict() == {"n_cells": 2, "n_partials": 1, "n_components": 0, "n_unassigned": 1}


def test_labels(spark):
    names = ["a", "a-1", "a-1-2", "UNASSIGNED", "UNASSIGNED_3", "UNASSIGNED_3-1", "prune_rejected", None, "nan", "x-y"]
    got = [(r[0], r[1], r[2]["cell"], r[2]["depth1"], r[2]["depth2"]) for r in spark.createDataFrame([(n,) for n in names], "e string").select(L.etype_of_label("e"), L.is_unassigned("e"), L.label_parts("e")).collect()]
    assert [g[0] for g in got] == ["cell", "partial", "partial", "unknown", "component", "component", "unknown", "unknown", "unknown", "partial"]
    assert got[2][2:] == ("a", 1, 2) and got[1][2:] == ("a", 1, None) and got[9][2:] == ("x-y", None, None)
    assert [g[1] for g in got] == [False] * 3 + [True] + [False] * 2 + [True] * 3 + [False]


def test_absent_policies(spark):
    sets = spark.createDataFrame([("e", g) for g in "abc"] + [("s", "a")], "entity string, feature string")
    panel = spark.createDataFrame([("a", "b", 0.5), ("b", "c", -0.5)], "gi string, gj string, w double")
    value = lambda **k: {r.entity: (round(r.purity, 6), round(r.conflict, 6)) for r in entity.coherence(sets, panel, **k).collect()}
    assert value(absent="skip") == {"e": (0.5, 0.5), "s": (0.0, 0.0)}
    assert value(absent="zero") == {"e": (0.333333, 0.333333), "s": (0.0, 0.0)}
    assert value(absent="zero", real_signal=0.1) == {"e": (0.5, 0.5), "s": (0.0, 0.0)}


@pytest.mark.parametrize(("n", "island_rows"), [(120, stages.ISLAND_ROWS), (400, 40), (400, 1)])
def test_cascade_does_not_depend_on_islands(spark, n, island_rows):
    rng = np.random.default_rng(2)
    bx, by, genes = rng.integers(0, 14, n), rng.integers(0, 14, n), rng.integers(0, 6, n)
    w = matrix(6, 1, 0.0)
    whole = kernels.cascade(bx, by, genes, w, 9, 1, threshold=-0.5)
    data = [(k, "-1", f"g{genes[k]}", float(bx[k]) + 0.5, float(by[k]) + 0.5, 0.0, False, "-1", "unknown") for k in range(n)]
    panel = spark.createDataFrame([(f"g{i}", f"g{j}", float(w[i, j])) for i in range(6) for j in range(i + 1, 6)], "gi string, gj string, w double")
    got = {r.id: r.entity for r in stages.density_cascade(rows_of(spark, data), stages.Panel(panel), 1.0, 9, 1, threshold=-0.5, island_rows=island_rows).collect()}
    want = {}
    for k, (_, _, _, _, rows) in enumerate(sorted(whole, key=lambda a: (-a[0], -a[1], a[2], a[3]))):
        want |= {int(r): f"cascade_{k}-1" for r in rows}
    assert got == want


def test_remerge_and_split(spark):
    rng = np.random.default_rng(1)
    data = []
    for k in range(40):
        p = rng.normal(0, 1, 3)
        data.append((k, "c", "abcd"[k % 4], *map(float, p), False, "a" if k % 2 else "b", "cell"))
    data += [(100 + k, "c", "abcd"[k % 4], *map(float, rng.normal(3, 0.2, 3)), False, "far", "cell") for k in range(20)]
    panel = spark.createDataFrame([("a", "c", 0.5), ("b", "d", 0.5), ("a", "b", 0.1), ("c", "d", 0.1), ("a", "d", 0.1)], "gi string, gj string, w double")
    got = labels_after(stages.maha_remerge(rows_of(spark, data), panel, 5.0, 5.0))
    assert {e for e, _ in got.values()} == {"a", "far"}


def test_segmented_pipeline_recovers_cells(spark):
    points = synthetic.planted_cells(spark, noise=0.2)
    run = pipeline.segmented(points, synthetic.planted_panel(spark))
    assert [p["stage"].split()[0] for p in run.progression][:5] == ["Prune", "Reassign", "Split", "Rerank", "QC"] and run.progression[-1]["stage"] == "Finalize"
    table = compare.contingency(run.rows.where("entity <> 'UNASSIGNED'"), "entity", "truth")
    assert compare.rand_indices(table).first()["adjusted_rand_index"] > 0.8
    assert run.rows.count() == 200 and run.rows.where("entity = 'UNASSIGNED'").count() < 60


def test_pipelines_without_nuclei_and_cells(spark):
    points = synthetic.planted_cells(spark, noise=0.1)
    run = pipeline.segmented(points, synthetic.planted_panel(spark), nuclear=False)
    assert compare.rand_indices(compare.contingency(run.rows.where("entity <> 'UNASSIGNED'"), "entity", "truth")).first()["adjusted_rand_index"] > 0.8
    free = pipeline.unsegmented(points, synthetic.planted_panel(spark))
    assert free.rows.count() == 200 and free.rows.where("entity like 'cascade%'").count() > 50


def brute_ari(a, b):
    n = len(a)
    same = lambda x: {(i, j) for i, j in itertools.combinations(range(n), 2) if x[i] == x[j]}
    sa, sb = same(a), same(b)
    total = n * (n - 1) / 2
    e = len(sa) * len(sb) / total
    return (len(sa & sb) - e) / ((len(sa) + len(sb)) / 2 - e)


def test_agreement(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 4, 60), rng.integers(0, 3, 60)
    b[:30] = a[:30] % 3
    t = compare.contingency(spark.createDataFrame([(str(x), str(y)) for x, y in zip(a, b)], "a string, b string"), "a", "b")
    assert compare.rand_indices(t).first()["adjusted_rand_index"] == pytest.approx(brute_ari(a, b))
    own = compare.contingency(spark.createDataFrame([(str(x), str(x)) for x in a], "a string, b string"), "a", "b")
    assert compare.adjusted_information(own) == pytest.approx(1.0) and compare.information(own).first()["v_measure"] == pytest.approx(1.0)
    rng_mean = np.mean([compare.expected_information({20: 3}, {30: 2}, 60)])
    sim = []
    for _ in range(2000):
        y = rng.permutation(np.repeat([0, 1], 30))
        c = np.histogram2d(np.repeat([0, 1, 2], 20), y, bins=(3, 2))[0] / 60
        p = c[c > 0]
        sim.append((p * np.log(p / np.outer(c.sum(1), c.sum(0))[c > 0])).sum())
    assert rng_mean == pytest.approx(np.mean(sim), rel=0.1)


def test_config(tmp_path):
    cfg = config.load_config()
    assert cfg == config.PipelineConfig() == config.build(config.to_dict(cfg))
    path = tmp_path / "c.toml"
    path.write_text('[rescue]\nbin_um = 3.0\n[other]\nx = 1\n[group]\ninherit = "shared"\nradius = 2\n[shared]\nbin_um = 7.0\n')
    got = config.load_config(path, "noseg")
    assert (got.rescue.bin_um, got.rescue.post_group_passes, got.group.bin_um, got.group.radius) == (3.0, 5, 7.0, 2)
    path.write_text("[rescue]\nbinn = 3.0\n")
    with pytest.raises(ValueError, match="unknown keys"):
        config.load_config(path)
    path.write_text("[rescue]\nbin_um = 3.0\n[final_rescue]\npasses = 7\n[bootstrap]\nbands = [0.1, 0.9]\n")
    got = config.load_config(path)
    assert (got.final_rescue.bin_um, got.final_rescue.passes, got.rescue.passes, got.bootstrap.bands) == (3.0, 7, 3, (0.1, 0.9))
    for bad in ({"rescue": {"bin_um": 0}}, {"rescue": {"rank": "x"}}, {"stitch": {"depth": 0}}, {"bootstrap": {"ci": 1.0}}, {"prune": {"mode": "x"}}, {"group": {"hard_min": 1}}):
        with pytest.raises(ValueError):
            config.build(bad)
    with pytest.raises(ValueError):
        config.load_config(platform="none")


def test_default_settings():
    """The published defaults of the surveyed pipeline."""
    c = config.PipelineConfig()
    assert (c.prune.threshold, c.prune.floor, c.prune.mode, c.prune.nuclear_only, c.prune.mean_threshold, c.prune.percentile) == (0.2, 0.1, "hybrid", True, 0.2, 25.0)
    assert (c.split.gap, c.split.min_size, c.split.min_entity_size, c.qc.min_size, c.qc.coherence_floor, c.demote.min_size) == (2.0, 1, 2, 3, 0.05, 5)
    assert (c.rescue.mode, c.rescue.mean_threshold, c.rescue.negative, c.rescue.bin_um, c.rescue.rank, c.rescue.witness_tie) == ("hybrid", 0.5, -0.2, 2.0, "witness", "gene_fit")
    assert (c.rescue.witness_min, c.rescue.witness_cap, c.rescue.witness_divisor, c.rescue.guard_peers, c.rescue.guard_shield) == (3, 3, 2, 3, "entity")
    assert (c.group.bin_um, c.group.coverage, c.group.hard_min, c.group.threshold, c.group.min_size) == (2.0, 0.65, 2, 0.2, 3)
    assert (c.stitch.bin_um, c.stitch.z_bin_um, c.stitch.tau, c.stitch.least_gain, c.stitch.bypass, c.stitch.bypass_size, c.stitch.depth) == (2.0, 1.0, 0.2, 0.03, 0.9, 50, 3)
    assert (c.bootstrap.metric, c.bootstrap.tau_low, c.bootstrap.tau_high, c.bootstrap.alpha, c.bootstrap.max_bootstraps, c.bootstrap.refine, c.bootstrap.subsample) == ("pmi", 0.05, 0.2, 0.1, 10_000, 500, 25_000)
    assert c.bootstrap.bands == (0.05, 0.95) and config.load_config(platform="noseg").final_rescue.passes == 5


def test_labels_with_the_delimiter(spark):
    df = spark.createDataFrame([("42",)], "c string")
    one, two, parts = df.select(L.partial_label("c", 3), L.subpartial_label(L.partial_label("c"), 2), L.split_label(F.lit("ado-1-tr-1-tr-4"))).first()
    assert (one, two, parts["cell"], parts["indices"]) == ("42-tr-3", "42-tr-1-tr-2", "ado-1", [1, 4])
    assert df.select(L.split_label("c")).first()[0]["indices"] == []
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(L.split_label(F.lit("a-tr-x"))).collect()


def test_readers(spark, tmp_path):
    project = tmp_path / "lung"
    (project / "data").mkdir(parents=True)
    df = spark.createDataFrame([(1, "g", "c-1", 1.0, float("nan"), "True", 9)], "transcript_id int, feature_name string, cell_id string, x_location double, y_location double, overlaps_nucleus string, other int")
    df.toPandas().to_parquet(project / "data" / "lung.parquet")
    points = io.normalize(io.load_points(spark, project=project))
    assert points.columns == ["id", "feature", "cell", "x", "y", "nuclear", "z"] and tuple(points.first()) == (1, "g", "c-1", 1.0, None, True, 0.0)
    assert io.normalize(points).first() == points.first()
    df.toPandas().to_parquet(project / "data" / "b.parquet")
    assert io.discover(project)[0].name == "lung.parquet"
    for kw in ({}, {"project": project, "parquet": "x"}):
        with pytest.raises(ValueError):
            io.load_points(spark, **kw)
    vertices = spark.createDataFrame([("c", k, float(k % 2), float(k // 2)) for k in range(4)] + [("d", 0, 0.0, 0.0)], "cell string, order int, x double, y double")
    assert [(r.polygon, len(r.ring)) for r in io.polygons_of(vertices).collect()] == [("c", 4)]
    assert io.markdown_table(vertices.where("cell = 'd'")).count("\n") == 2


def brute_choice(free, f, held, e, size, pairs, fits, n_e, rule):
    out = []
    for x, kind in zip(free, f, strict=True):
        near = {}
        for y, name in zip(held, e, strict=True):
            if abs(x[2] - y[2]) <= rule.z_bound and kind * n_e + name in pairs:
                near.setdefault(name, []).append(round(float(((x - y) ** 2).sum()), 9))
        if rule.rank == "distance":
            out.append(min(((min(d), name) for name, d in near.items()), default=(0, -1))[1])
            continue
        eff = {name: min(len(d), rule.cap, -(-size[name] // rule.divisor)) for name, d in near.items()}
        tie = {name: -round(fits[list(pairs).index(kind * n_e + name)], 9) if rule.tie == "gene_fit" else min(near[name]) for name in near}
        out.append(min(((-eff[name], tie[name], name) for name in near if eff[name] >= rule.least), default=(0, 0, -1))[2])
    return out


@pytest.mark.parametrize("rank", ["distance", "witness"])
@pytest.mark.parametrize("tie", ["distance", "gene_fit"])
def test_choice_equals_brute_force(rank, tie, monkeypatch):
    rng = np.random.default_rng(7)
    for least, most in ((1, 2_000_000), (2, 40), (3, 1)):
        monkeypatch.setattr(kernels, "MOST_NEAR", most)
        free, held = np.round(rng.uniform(0, 4, (30, 3))), np.round(rng.uniform(0, 4, (80, 3)))
        f, e, n_e = rng.integers(0, 4, 30), rng.integers(0, 9, 80), 9
        size = np.bincount(e, minlength=n_e)
        pairs = np.sort(rng.choice(4 * n_e, 20, replace=False))
        fits = np.round(rng.uniform(-1, 1, 20), 1)
        rule = kernels.NearRule(1.0, rank, tie, 3, 2, least)
        got = kernels.choose_near(free, f, held, e, size[e], pairs, fits, n_e, rule).tolist()
        assert got == brute_choice(free, f, held, e, size, pairs.tolist(), fits, n_e, rule)


def test_counted_choice_equals_brute_force_and_makes_no_pairs_of_points(monkeypatch):
    rng = np.random.default_rng(8)
    for least, most, digits in ((1, 2_000_000, 0), (2, 40, 1), (3, 1, 0), (1, 1, 3)):
        monkeypatch.setattr(kernels, "MOST_NEAR", most)
        free, held = np.round(rng.uniform(0, 4, (30, 3)), digits), np.round(rng.uniform(0, 4, (80, 3)), digits)
        f, e, n_e = rng.integers(0, 4, 30), rng.integers(0, 9, 80), 9
        size = np.bincount(e, minlength=n_e)
        pairs = np.sort(rng.choice(4 * n_e, 20, replace=False))
        fits = np.round(rng.uniform(-1, 1, 20), 1)
        rule = kernels.NearRule(1.0, "witness", "gene_fit", 3, 2, least)
        keys, n = np.unique(np.column_stack([e, held[:, 2]]), axis=0, return_counts=True)
        of, z = keys[:, 0].astype(int), keys[:, 1]
        got = kernels.choose_counted(free[:, 2], f, z, of, size[of], n, pairs, fits, n_e, rule).tolist()
        assert got == brute_choice(free, f, held, e, size, pairs.tolist(), fits, n_e, rule)
        # Ten million times as many points cost the same.
        full = kernels.NearRule(1.0, "witness", "gene_fit", 3 * 10**7, 2, least * 10**7)
        assert kernels.choose_counted(free[:, 2], f, z, of, size[of] * 10**7, n * 10**7, pairs, fits, n_e, full).tolist() == [-1 if k < 0 else k for k in brute_counted(free[:, 2], f, z, of, size * 10**7, n * 10**7, pairs.tolist(), fits, n_e, full)]


def brute_counted(free_z, f, z, e, size, n, pairs, fits, n_e, rule):
    out = []
    for x, kind in zip(free_z, f, strict=True):
        count = {}
        for level, name, c in zip(z, e, n, strict=True):
            if abs(x - level) <= rule.z_bound and kind * n_e + name in pairs:
                count[name] = count.get(name, 0) + c
        eff = {k: min(c, rule.cap, -(-size[k] // rule.divisor)) for k, c in count.items()}
        out.append(min(((-eff[k], -round(fits[pairs.index(kind * n_e + k)], 9), k) for k in eff if eff[k] >= rule.least), default=(0, 0, -1))[2])
    return out


@pytest.mark.parametrize("rank", ["distance", "witness"])
def test_rescue_of_many_bins_and_pairs(spark, rank, monkeypatch):
    """The same rows are taken by the kernel, by its cut bins, and by joins where the gate is too large to share."""
    rng = np.random.default_rng(3)
    at = np.round(rng.uniform(0, 9, (400, 3)), 1)
    data = [(k, "c", f"g{rng.integers(4)}", *map(float, at[k]), False, "-1" if k % 3 else f"e{rng.integers(12)}", "unknown" if k % 3 else "cell") for k in range(400)]
    panel = spark.createDataFrame([(f"g{i}", f"g{j}", float(w)) for (i, j), w in zip(itertools.combinations(range(4), 2), (0.8, -0.5, 0.3, 0.1, -0.1, 0.6), strict=True)], "gi string, gj string, w double")
    take = lambda: {r.id: (r.entity, r.etype) for r in stages.rescue(rows_of(spark, data), panel, 1.5, kernels.Admission(mean_threshold=0.1), rank, least=1, tie="gene_fit").collect()}
    first = take()
    monkeypatch.setattr(stages, "BIN_ROWS", 2)
    assert first and take() == first
    monkeypatch.setattr(stages, "GATE_ROWS", 5)
    assert take() == first


def test_rescue_by_gene_fit_in_parts_of_a_bin(spark, monkeypatch):
    rng = np.random.default_rng(4)
    at = np.round(rng.uniform(0, 9, (300, 3)), 1)
    data = [(k, "c", f"g{rng.integers(4)}", *map(float, at[k]), False, "-1" if k % 3 else f"e{rng.integers(12)}", "unknown" if k % 3 else "cell") for k in range(300)]
    panel = spark.createDataFrame([(f"g{i}", f"g{j}", float(w)) for (i, j), w in zip(itertools.combinations(range(4), 2), (0.8, -0.5, 0.3, 0.1, -0.1, 0.6), strict=True)], "gi string, gj string, w double")
    take = lambda: {r.id: (r.entity, r.etype) for r in stages.rescue(rows_of(spark, data), panel, 1.5, kernels.Admission(mean_threshold=0.1), "witness", least=1, tie="gene_fit").collect()}
    first = take()
    # Some bins are cut into parts, others not.
    monkeypatch.setattr(stages, "ASKED_ROWS", 6)
    assert first and take() == first
    monkeypatch.setattr(stages, "GATE_ROWS", 5)
    assert take() == first
