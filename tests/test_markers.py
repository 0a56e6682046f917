"""Rank sums of groups over sparse values against dense ranks."""

import math

import numpy as np
import pytest

from entitygraph.operators import compare


def mean_ranks(v):
    order = np.sort(v)
    return np.array([(np.searchsorted(order, x, "left") + np.searchsorted(order, x, "right") + 1) / 2 for x in v])


def brute(x, group, tie_correct):
    out, n = {}, len(group)
    for g in sorted(set(group)):
        mine = group == g
        n1, n2 = mine.sum(), n - mine.sum()
        p = []
        for f in range(x.shape[1]):
            if not x[:, f].any():
                continue
            t = np.unique(x[:, f], return_counts=True)[1].astype(float)
            ties = ((t**3 - t).sum() / (n * (n - 1))) if tie_correct else 0.0
            sd = math.sqrt(n1 * n2 / 12 * (n + 1 - ties))
            z = (mean_ranks(x[:, f])[mine].sum() - n1 * (n + 1) / 2) / sd if sd > 0 else None
            p.append((math.erfc(abs(z) / math.sqrt(2)) if z is not None else None, f, z))
        known = sorted(q for q in p if q[0] is not None)
        least = 1.0
        for k in range(len(known), 0, -1):
            least = min(least, known[k - 1][0] * len(known) / k)
            f = known[k - 1][1]
            fold = math.log2((math.expm1(x[mine, f].mean()) + 1e-9) / (math.expm1(x[~mine, f].mean()) + 1e-9))
            out[g, f] = (known[k - 1][2], known[k - 1][0], least, fold, (x[mine, f] > 0).mean(), (x[~mine, f] > 0).mean())
    return out


@pytest.mark.parametrize("tie_correct", [False, True])
def test_equal_dense_ranks(spark, tie_correct):
    rng = np.random.default_rng(1)
    x = np.round(rng.gamma(1, 1, (60, 9)), 1) * (rng.random((60, 9)) < 0.4)
    x[:, 7], x[:, 8] = 0, rng.normal(5, 1, 60)
    group = np.array(["a", "b", "c"])[rng.integers(0, 3, 60)]
    x[group == "b", 3] += 2
    values = [(f"c{i}", f"f{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)] + [("stranger", "f1", 5.0), ("c0", "f7", 0.0)]
    groups = [(f"c{i}", str(g)) for i, g in enumerate(group)] + [("nobody", None)]
    got = compare.rank_markers(spark.createDataFrame(values, "cell string, feature string, value double"), spark.createDataFrame(groups, "cell string, grp string"), tie_correct).collect()
    want = brute(x, group, tie_correct)
    assert {(r.grp, int(r.feature[1:])) for r in got} == want.keys()
    for r in got:
        assert [r.score, r.p_value, r.p_adjusted, r.log_fold, r.share_in, r.share_out] == pytest.approx(want[r.grp, int(r.feature[1:])], abs=1e-9)
    assert min(r.p_adjusted for r in got if (r.grp, r.feature) == ("b", "f3")) < 1e-3


def test_a_group_of_all_cells_has_no_scores(spark):
    values = spark.createDataFrame([("c1", "f", 1.0), ("c2", "f", 2.0)], "cell string, feature string, value double")
    groups = spark.createDataFrame([("c1", "a"), ("c2", "a"), ("c3", "a")], "cell string, grp string")
    (r,) = compare.rank_markers(values, groups).collect()
    assert (r.score, r.p_value, r.p_adjusted, r.share_out) == (None, None, None, None) and r.share_in == pytest.approx(2 / 3)


def test_expected_information():
    small = compare.expected_information({2: 1, 4: 1}, {3: 2}, 6)
    brute = 0.0
    for x in (2, 4):
        for y in (3, 3):
            for k in range(max(1, x + y - 6), min(x, y) + 1):
                brute += k / 6 * math.log(6 * k / (x * y)) * math.comb(y, k) * math.comb(6 - y, x - k) / math.comb(6, x)
    assert small == pytest.approx(brute)
    # More rows than a table of factorials could hold: classes of two and three among 10^12.
    assert 0 < compare.expected_information({2: 1}, {3: 1}, 10**12) < 1e-9
