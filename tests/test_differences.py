"""Percentiles of differences in z without pairs, against all pairs."""

import numpy as np
import pytest

from entitygraph.operators import entity, kernels


@pytest.mark.parametrize("digits", [0, 1, 12])
def test_counts_sums_and_ranks_equal_all_pairs(monkeypatch, digits):
    rng = np.random.default_rng(digits)
    v = np.sort(np.round(rng.gamma(2, 3, 300), digits))
    z, c = np.unique(v, return_counts=True)
    d = np.sort(np.abs(np.subtract.outer(v, v))[np.triu_indices(len(v), 1)])
    bounds = np.array([-1.0, 0.0, 0.37, 2.51, 7.0 + 1e-9, 100.0])
    n, s = kernels.differences_up_to(z, c, bounds)
    assert n.tolist() == [(d <= b + 1e-12).sum() for b in bounds] and s == pytest.approx([d[d <= b + 1e-12].sum() for b in bounds])
    ranks = [0, 1, 7, len(d) // 2, len(d) - 2, len(d) - 1]
    assert kernels.kth_differences(z, c, ranks) == pytest.approx(d[ranks], abs=1e-9)
    monkeypatch.setattr(kernels, "FEW_VALUES", 0)
    assert kernels.kth_differences(z, c, ranks) == pytest.approx(d[ranks], abs=1e-9)


def test_one_entity_of_200000_values():
    """Differences of 0, 1, ..., n - 1: k occurs n - k times."""
    n = 200_000
    z, c = np.arange(n) + 0.25, np.ones(n, np.int64)
    before = lambda k: k * n - k * (k + 1) // 2  # differences below or at k
    ranks = [0, before(1000) - 1, before(1000), before(n - 1) - 1]
    assert kernels.kth_differences(z, c, ranks) == pytest.approx([1, 1000, 1001, n - 1])


def test_percentiles_per_entity_and_pooled(spark):
    rng = np.random.default_rng(3)
    z = {f"{k}": rng.normal(k, 1 + k % 3, 4 + 13 * k) for k in range(9)}
    rows = spark.createDataFrame([(i, e, "cell", float(v)) for i, (e, v) in enumerate((e, v) for e, vs in z.items() for v in vs)] + [(-1, "x", "cell", 1.0), (-2, None, "cell", 1.0), (-3, "x", "cell", None)], "id long, entity string, etype string, z double")
    pairs = {e: np.abs(np.subtract.outer(v, v))[np.triu_indices(len(v), 1)] for e, v in z.items()}
    got = {r.entity: r for r in entity.dz_stats(rows).collect()}
    assert got.keys() == z.keys()
    for e, d in pairs.items():
        assert (got[e].n_pairs, got[e].dz_mean, got[e].dz_max) == (len(d), pytest.approx(d.mean()), pytest.approx(d.max()))
        assert got[e].dz_p == pytest.approx(np.percentile(d, [50, 90]), abs=1e-9)
    pool = np.concatenate([d for e, d in pairs.items() if len(z[e]) >= 5])
    found = entity.pooled_dz(rows).first()
    assert [*found.p, found.mean, found.median, found.max] == pytest.approx([*np.percentile(pool, [50, 75, 90, 95, 99]), pool.mean(), np.median(pool), pool.max()], abs=1e-9)
