"""Association operators on planted and literal tables."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from entitygraph.functions import scalars as S
from entitygraph.operators import assoc
from entitygraph.sources import synthetic


@pytest.fixture(scope="module")
def planted(spark):
    obs = synthetic.planted_observations(spark)
    panel, full, kinds = assoc.pmi_bootstrap(obs, least_expected=10, seed=0)
    return {(r.gi, r.gj): r.w for r in panel.collect()}, {(r.gi, r.gj): r for r in full.collect()}, {r.kind: r.n_pairs for r in kinds.collect()}


def test_planted_structures(planted):
    panel, full, kinds = planted
    assert panel["g00", "g01"] > 0.1
    assert panel.get(("g02", "g03"), -1) < 0
    assert ("g04", "g05") not in panel or abs(panel["g04", "g05"]) < 0.2
    assert ("g06", "g07") not in panel
    assert panel["g08", "g09"] == -1.0
    assert sum(kinds.values()) == 20 * 19 // 2


def test_point_estimates(planted):
    r = planted[1]["g00", "g01"]
    assert r.pmi == pytest.approx(math.log(r.k_ij * r.n / (r.k_i * r.k_j)))
    assert r.npmi == pytest.approx(r.pmi / -math.log(r.k_ij / r.n))
    assert r.ci_lo <= r.median <= r.ci_hi


def test_bootstrap_does_not_depend_on_partitions(spark):
    t = assoc.pairs(assoc.presence(synthetic.planted_observations(spark, contexts=200)))
    runs = [sorted(map(tuple, assoc.bootstrap(t.repartition(n), budget=300).collect())) for n in (1, 7)]
    assert runs[0] == runs[1]


def test_unsettled_pairs_draw_the_whole_budget(spark, sf_dir):
    from entitygraph.plans import config, queries

    # Of 2,000 contexts each holds both features as often as chance has it, or nearly so: neither strong nor null.
    near, strong = (10, 100, 200, 2000), (90, 100, 100, 2000)
    t = spark.createDataFrame([("a", "b", *near), ("a", "c", *strong)], "gi string, gj string, k_ij long, k_i long, k_j long, n long")
    got = {r.gj: r for r in assoc.bootstrap(t, 0.05).collect()}
    assert got["b"].n_draws == 10_000 and got["c"].n_draws == 200 and got["c"].kind == "pos_strong"
    c = config.BootstrapConfig()
    assert (c.max_bootstraps, c.coarse, c.refine) == (10_000, 200, 500)
    for r in queries.QUERIES["bootstrap_ci"](spark, sf_dir).select("kind", "n_draws").distinct().collect():
        assert r.n_draws == 10_000 if r.kind not in assoc.EARLY else (r.n_draws - 200) % 500 in (0, 300)


@pytest.mark.parametrize("lo,hi,kind", [(0.3, 0.4, "pos_strong"), (0.15, 0.4, "pos_weak"), (-0.5, -0.3, "neg_strong"), (-0.5, -0.15, "neg_weak"), (-0.05, 0.05, "tight_null"), (-0.15, 0.05, "dead_zone"), (-0.5, 0.5, "unsettled")])
def test_kinds(lo, hi, kind):
    assert assoc.final_kind(lo, hi, 0.1, 0.2) == kind


def test_zero_and_full_pairs(spark):
    t = spark.createDataFrame([(0, 1, 1, 2), (2, 2, 2, 2), (1, 1, 2, 4)], "k_ij long, k_i long, k_j long, n long")
    rows = [(r.pmi, r.npmi) for r in assoc.association(t).collect()]
    assert rows[0] == (None, None) and rows[1] == (0.0, None) and rows[2][0] == pytest.approx(math.log(2))


def test_filters(spark):
    obs = spark.createDataFrame([("a", "g", 40.0, "True"), ("-1", "g", 30.0, "1"), (None, "h", 10.0, "0"), ("b", "h", 30.0, None)], "cell string, feature string, qv double, nuclear string")
    assert assoc.quality_filter(obs).count() == 3 and assoc.quality_filter(obs, strict=True).count() == 1
    assert assoc.exclude_contexts(obs).count() == 2 and assoc.exclude_contexts(obs, ()).count() == 4
    assert assoc.nuclear_only(obs).count() == 2
    assert assoc.vocabulary_filter(obs, obs.where("feature = 'h'")).count() == 2


def test_size_band_equals_numpy(spark):
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 60, 40)
    obs = spark.createDataFrame([(f"c{k}", "g") for k, n in enumerate(sizes) for _ in range(n)], "cell string, feature string")
    lo, hi = np.percentile(sizes, [20, 80])
    got = {r["cell"] for r in assoc.size_band_filter(obs).select("cell").distinct().collect()}
    assert got == {f"c{k}" for k, n in enumerate(sizes) if lo <= n <= hi}


def test_panel_rules(spark):
    raw = spark.createDataFrame([("b", "a", 0.5), ("a", "c", 0.0), ("c", "c", 1.0), ("b", "c", float("nan")), ("c", "d", None)], "gene_i string, gene_j string, NPMI double")
    assert sorted(map(tuple, assoc.normalize_panel(raw).collect())) == [("a", "b", 0.5), ("a", "c", 0.0)]
    assert assoc.symmetric(assoc.normalize_panel(raw)).count() == 4
    twice = raw.unionByName(spark.createDataFrame([("a", "b", 0.1)], raw.schema))
    with pytest.raises(PySparkException, match="pair given twice"):
        assoc.normalize_panel(twice).collect()


def test_scalar_expressions(spark):
    df = spark.createDataFrame([(0.5,), (-0.5,), (0.05,)], "x double")
    assert [round(r[0], 9) for r in df.select(S.relu_symmetric("x", 0.1)).collect()] == [0.4, -0.4, 0.0]
    assert len(S.xy_offsets("R2")) == 25 and len(S.xy_half_offsets("R2")) == 13
    for t in ("4", "8", "R3"):
        half = {o for o in S.xy_half_offsets(t) if o != (0, 0)}
        assert half | {(-a, -b) for a, b in half} | {(0, 0)} == set(S.xy_offsets(t)) and not half & {(-a, -b) for a, b in half}
    with pytest.raises(ValueError):
        S.xy_offsets("Q")
    assert spark.createDataFrame([(-0.5,)], "x double").select(S.bin_of("x", 1.0)).first()[0] == -1


def test_thresholds(spark):
    t = spark.createDataFrame([("a", "b", 9, 0.4, 0.5, 0.6), ("a", "c", 9, 0.2, 0.3, 0.1), ("a", "d", 1, 0.9, 0.9, 0.9), ("b", "c", 9, None, 0.3, 0.1)], "gi string, gj string, k_ij long, npmi double, p_i_given_j double, p_j_given_i double")
    ranked = assoc.rankings(t)
    got = {(r.gi, r.gj): (r.dropped, round(r.score, 6)) for r in ranked.collect()}
    assert got["a", "b"] == (False, round(0.4**3 * 0.25, 6)) and got["a", "d"] == (True, 0.0) and got["b", "c"] == (True, 0.0)
    r = assoc.gene_thresholds(ranked, top=5).first()
    assert (r.gi, r.npmi_thresh, r.cond_thresh) == ("a", 0.2, 0.1)


def test_stream_counts(spark, tmp_path):
    from entitygraph.sources.io import write_parquet
    from entitygraph.streaming import cooccurrence

    events = spark.createDataFrame([(k, 1_700_000_000 + 600 * k, k % 3, "ab"[k % 2]) for k in range(60)], "event_id long, s long, user_id long, event_type string").withColumn("ts", F.timestamp_seconds("s"))
    write_parquet(events.drop("s"), str(tmp_path / "in"))
    stream = spark.readStream.schema(events.drop("s").schema).parquet(str(tmp_path / "in"))
    cooccurrence.run_counts(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    done = spark.read.parquet(str(tmp_path / "out"))
    batch = cooccurrence.feature_counts(events)
    assert done.count() > 0 and done.exceptAll(batch).count() == 0
    assert cooccurrence.window_pairs(done).count() > 0


def test_diagnostics_of_a_bootstrap(spark):
    """Kinds, buckets and drops literally; the steps of the filter against the filter itself."""
    full = [("a", "b", "pos_strong", 200), ("a", "c", "neg_weak", 1000), ("b", "c", "dead_zone", 1000), ("b", "d", "tight_null", 700), ("c", "d", "unsettled", 1000), ("a", "d", "legacy_only", None)]
    full = spark.createDataFrame(full, "gi string, gj string, kind string, n_draws int")
    kinds = full.groupBy("kind").count().withColumnRenamed("count", "n_pairs").unionByName(spark.createDataFrame([("neg_one", 4), ("indeterminate", 9)], "kind string, n_pairs long"))
    rows = [(f"c{c}", "g", bool(i % 2)) for c in range(8) for i in range(c + 1)] + [("-1", "g", True)] * 3 + [(None, "g", True)]
    obs = spark.createDataFrame(rows, "cell string, feature string, nuclear boolean")
    drops = assoc.filter_drops(obs, nuclear=True, sizes=(0.2, 0.8))
    r = assoc.bootstrap_diagnostics(full, kinds, drops, tau=(0.05, 0.2), subsample=None).first()
    assert (r.n_pos, r.n_pos_strong, r.n_pos_weak, r.n_neg, r.n_neg_weak, r.n_dead_zone, r.n_dead_zone_only, r.n_tight_null, r.n_unsettled) == (1, 1, 0, 1, 1, 2, 1, 1, 1)
    assert (r.n_neg_one, r.n_indeterminate, r.n_legacy_only, r.n_low_evidence) == (4, 9, 1, 0)
    assert r.settled_at_hist == {"<=500": 1, "<=1000": 3} and r.total_bootstraps_run == 1000
    assert (r.metric, r.tau_low, r.tau_high, r.is_dual_tau, r.subsample_size, r.min_expected_cooccur_for_evidence) == ("npmi", 0.05, 0.2, True, None, 10.0)
    kept = assoc.usable_contexts(obs, nuclear=True, sizes=(0.2, 0.8)).count()
    assert (r.n_input_rows, r.n_dropped_excluded, r.n_dropped_nuclear, r.n_kept_rows) == (40, 4, sum(not n for c, _, n in rows if c and c != "-1"), kept)
    assert r.n_dropped_percentile == 40 - 4 - r.n_dropped_nuclear - kept and len(r.asDict()) >= 25
    none = assoc.bootstrap_diagnostics(full.limit(0), kinds.limit(0), assoc.filter_drops(obs.limit(0))).first()
    assert (none.n_pos, none.total_bootstraps_run, none.settled_at_hist, none.n_input_rows) == (0, 0, {}, 0)
