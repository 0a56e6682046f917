"""Permutation tests of feature pairs against dense tables of permuted labels."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from entitygraph.operators import permutation as P


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_every_draw_is_a_permutation(n):
    x = P.shuffled(np.arange(n), n, 5, np.arange(20))
    assert (np.sort(x, 1) == np.arange(n)).all()
    assert (x == np.concatenate([P.shuffled(np.arange(a, n, 3), n, 5, np.arange(20)) for a in range(min(3, n))], 1)[:, np.argsort(np.concatenate([np.arange(a, n, 3) for a in range(min(3, n))]))]).all()
    if n == 1000:
        assert len({tuple(r) for r in x}) == 20
        # Places are uniform and draws independent, roughly.
        y = P.shuffled(np.arange(n), n, 6, np.arange(400))
        assert abs(y.mean() / (n - 1) - 0.5) < 0.01 and abs(np.corrcoef(y[:-1].ravel(), y[1:].ravel())[0, 1]) < 0.01 and y[:, 0].std() > 250


def test_equal_dense_tables(spark):
    rng = np.random.default_rng(2)
    n, k = 60, 150
    x = rng.poisson(0.7, (n, 4)).astype(float)
    group = np.array(["u", "v", "w"])[rng.integers(0, 3, n)]
    x[group == "u", 0] += 3
    x[group == "v", 1] += 3
    x[5:, 3] = 0
    cells = [f"c{i:03d}" for i in range(n)]
    values = [(cells[i], f"f{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)] + [("other", "f0", 9.0), ("c000", "untested", 1.0)]
    groups = [(c, str(g)) for c, g in zip(cells, group, strict=True)] + [("none", None)]
    pairs = [("f0", "f1"), ("f1", "f0"), ("f2", "f2"), ("f0", "f3"), ("f0", "f1")]
    df = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    got = P.permutation_test(df(values, "cell string, feature string, value double"), df(groups, "cell string, grp string"), df(pairs, "a string, b string"), k, 7).collect()
    names, size = np.unique(group, return_counts=True)
    ends = np.cumsum(size)
    mean = lambda label, g, f: x[label == g, f].mean()
    draws = [names[np.searchsorted(ends, P.shuffled(np.arange(n), n, 7, np.array([d]))[0], "right")] for d in range(k)]
    assert all((np.unique(d, return_counts=True)[1] == size).all() for d in draws)
    assert len(got) == 4 * 9
    for r in got:
        a, b = int(r.a[1]), int(r.b[1])
        observed = (mean(group, r.grp_a, a) + mean(group, r.grp_b, b)) / 2
        assert r.mean == pytest.approx(observed)
        if min((x[group == r.grp_a, a] > 0).mean(), (x[group == r.grp_b, b] > 0).mean()) < 0.1:
            assert r.p_value is None
        else:
            assert r.p_value == pytest.approx(np.mean([(mean(d, r.grp_a, a) + mean(d, r.grp_b, b)) / 2 >= observed - 1e-12 for d in draws]))
    by = {(r.a, r.b, r.grp_a, r.grp_b): r.p_value for r in got}
    assert by["f0", "f1", "u", "v"] < 0.02 < 0.5 < by["f0", "f1", "w", "w"] and any(v is None for v in by.values())


def test_nothing_to_test(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    assert P.permutation_test(empty("cell string, feature string, value double"), empty("cell string, grp string"), empty("a string, b string")).collect() == []
    groups = spark.createDataFrame([(f"c{i}", g) for i in range(101) for g in ["g"]], "cell string, grp string")
    pairs = spark.createDataFrame([p for p in itertools.combinations("abc", 2)], "a string, b string")
    got = P.permutation_test(empty("cell string, feature string, value double"), groups, pairs, 10).collect()
    assert [(r.mean, r.p_value) for r in got] == [(0.0, None)] * 3


def test_draws_are_made_once_a_cell_and_sums_are_those_row_by_row(spark, monkeypatch):
    rng = np.random.default_rng(4)
    values = spark.createDataFrame([(f"c{c}", f"f{f}", float(rng.integers(1, 5))) for c in range(60) for f in range(5) if rng.random() < 0.7], "cell string, feature string, value double").repartition(3)
    groups = spark.createDataFrame([(f"c{c}", f"g{c % 3}") for c in range(60)], "cell string, grp string")
    pairs = spark.createDataFrame([("f0", "f1"), ("f2", "f4")], "a string, b string")
    kept = []
    settle = P.settle
    monkeypatch.setattr(P, "settle", lambda df, name, *a, **k: kept.append(df) or settle(df, name, *a, **k))
    take = lambda: sorted(map(tuple, P.permutation_test(values, groups, pairs, 200).collect()), key=str)
    first = take()
    assert len(first) == 18
    for number in (r.numbers for r in kept[-1].groupBy(F.spark_partition_id()).agg(F.collect_list("number").alias("numbers")).collect()):
        assert number == sorted(number)
    assert kept[-1].withColumn("p", F.spark_partition_id()).groupBy("number").agg(F.countDistinct("p").alias("k")).where("k > 1").count() == 0
    monkeypatch.setattr(P, "DENSE_SHARE", 0)
    assert take() == first
