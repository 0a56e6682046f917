"""Storage helpers and panels for the kernels."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from entitygraph.functions import storage
from entitygraph.operators import stages


def test_settle_cuts_lineage_and_keeps_rows(spark):
    df = spark.range(100).withColumn("x", F.col("id") % 7).repartition(32)
    for compact in (False, True):
        out = storage.settle(df, "t", compact)
        assert sorted(out.collect()) == sorted(df.collect())
        assert "Repartition" not in out._jdf.queryExecution().toString()
    assert len(storage.settle(df, "t", True).inputFiles()) <= 2 * spark.sparkContext.defaultParallelism
    gone = storage.settle(df, "t")
    storage.discard(gone)
    with pytest.raises(Exception):  # noqa: B017
        gone.collect()


@pytest.mark.parametrize("parts", [1, 5])
def test_numbers_follow_the_order(spark, parts):
    rng = np.random.default_rng(0)
    keys = [(int(a), int(b)) for a, b in rng.integers(0, 50, (400, 2))]
    df = spark.createDataFrame(sorted(set(keys)), "a int, b int").repartition(parts)
    got = {(r.a, r.b): r.number for r in storage.numbered(df, ["a", "b"]).collect()}
    assert got == {k: i for i, k in enumerate(sorted(set(keys)))}
    assert storage.numbered(df.where("false"), ["a", "b"]).collect() == []


def test_broadcast_only_below_the_limit(spark):
    big, small = spark.range(10), spark.range(3)
    hint = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hint(storage.broadcast_if_small(small, limit=5)) and not hint(storage.broadcast_if_small(big, limit=5))
    assert not hint(storage.broadcast_if_small(small, rows=9, limit=5))


def test_panel_blocks(spark):
    panel = spark.createDataFrame([("a", "b", 0.5), ("b", "d", 0.0), ("a", "d", -1.0)], "gi string, gj string, w double")
    codes, w = stages.Panel(panel).local(pd.Series(["d", "x", "a", None, "d"]))
    assert codes.tolist() == [1, -1, 0, -1, 1]
    assert w[0, 1] == w[1, 0] == -1.0 and np.isnan(w[0, 0])
    zero = stages.Panel(panel, "zero")
    assert zero.block(np.array([0, 1, 2])).tolist() == [[0, 0.5, -1.0], [0.5, 0, 0], [-1.0, 0, 0]]
    none = stages.Panel(panel.where("false"))
    assert none.local(pd.Series(["a"]))[0].tolist() == [-1]
