"""Gains of merging: one row an entity, whatever the size that a table of candidates seems to have."""

import numpy as np
import pytest

from entitygraph.operators import entity, stages


@pytest.mark.parametrize("absent", ["zero", "skip"])
def test_gains_by_number(spark, monkeypatch, absent):
    r = np.random.default_rng(8)
    names = [f"g{k}" for k in range(12)]  # g9 to g11 lie outside the panel
    panel = spark.createDataFrame([(*sorted((names[i], names[j])), float(np.round(r.normal(0, 0.2), 3))) for i in range(9) for j in range(i + 1, 9) if r.random() < 0.7], "gi string, gj string, w double")
    held = {f"e{k}": sorted(r.choice(names, r.integers(1, 9), replace=False).tolist()) for k in range(30)}
    sets = spark.createDataFrame([(e, g) for e, gs in held.items() for g in gs], "entity string, feature string")
    sizes = spark.createDataFrame([(e, int(r.integers(1, 40))) for e in held], "entity string, n long")
    pairs = spark.createDataFrame([(f"e{a}", f"e{b}") for a in range(32) for b in range(a + 1, 32) if r.random() < 0.3] * 2, "a string, b string")
    take = lambda **k: {(x.a, x.b): tuple(round(v, 12) for v in x[2:]) for x in entity.delta_c(sets, sizes, pairs, panel, 0.05, absent, **k).collect()}
    got, plain = take(), take(penalized=False)
    weight = {frozenset((x.gi, x.gj)): x.w for x in panel.collect()}

    def coherence(genes):
        w = [weight.get(frozenset((a, b))) for i, a in enumerate(genes) for b in genes[i + 1 :]]
        n = len(w) if absent == "zero" else sum(v is not None for v in w)
        return (sum(v > 0.05 for v in w if v is not None) / n - sum(v < -0.05 for v in w if v is not None) / n) if n else 0.0

    assert len(got) > 100 and {a for p in got for a in p} <= set(held)
    for (a, b), (union, c_a, c_b, _) in got.items():
        assert (union, c_a, c_b) == pytest.approx((coherence(sorted({*held[a], *held[b]})), coherence(held[a]), coherence(held[b])), abs=1e-12)
    monkeypatch.setattr(entity, "PAIRS_AT_ONCE", 8)
    assert take() == got
    monkeypatch.setattr(stages.Panel, "MOST_PAIRS", 3)  # pairs of features are rows
    assert take() == got and take(penalized=False) == plain != got


def test_candidates_that_look_small_are_not_sent_to_all(spark, tmp_path):
    """A file of a few bytes a row may hold millions of rows; the driver would have to hold them all."""
    keys = spark.range(20_000).selectExpr("cast(id as string) as a", "cast(id + 1 as string) as b")
    keys.coalesce(1).write.parquet(f"{tmp_path}/candidates")
    sets = spark.range(20_000).selectExpr("cast(id as string) as entity", "concat('g', id % 3) as feature")
    sizes = sets.selectExpr("entity", "1L as n")
    panel = spark.createDataFrame([("g0", "g1", 0.5), ("g1", "g2", -0.5)], "gi string, gj string, w double")
    gains = entity.delta_c(sets, sizes, spark.read.parquet(f"{tmp_path}/candidates"), panel)
    assert "Broadcast" not in gains._jdf.queryExecution().executedPlan().toString()
    assert gains.count() == 19_999
