"""Permutation tests of pairs of features between groups of contexts.

Does feature a in group g go with feature b in group h more than chance?  Group labels are dealt
out anew, and the mean of the two group means is compared.  A permutation is a keyed
shuffle of the contexts' numbers that any task can evaluate for its own contexts, so no
table of labels is made: every permutation is a sum over rows, added up where the rows are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitygraph.functions.storage import broadcast_if_small, numbered, settle

#: Permutations that a task evaluates at a time.
BLOCK = 50
#: Cells of a group's sums for every row of a cell up to which all of them are added up at once.
DENSE_SHARE = 40
#: Tested combinations of pairs and groups up to which they are sent to the tasks.
MOST_TESTS = 5_000_000
ROUNDS = 4


def _mixed(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shuffled(numbers: np.ndarray, n: int, seed: int, draws: np.ndarray) -> np.ndarray:
    """(draw, number): where each number below ``n`` goes in each draw, a permutation of 0 .. n - 1 per draw.

    A Feistel network permutes the numbers of an even number of bits; those that land at n or beyond are
    shuffled again until they do not.
    """
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, half_ = np.uint64((1 << half) - 1), np.uint64(half)
    keys = np.random.default_rng(seed).integers(0, 1 << 63, ROUNDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        draw = _mixed(draws.astype(np.uint64), np.uint64(seed))[:, None]
        v = np.broadcast_to(numbers.astype(np.uint64), (len(draws), len(numbers))).ravel()
        draw = np.broadcast_to(draw, (len(draws), len(numbers))).ravel()
        x, todo = np.empty(len(v), np.uint64), None
        while len(v):
            left, right = v >> half_, v & mask
            for key in keys:
                left, right = right, left ^ (_mixed(right, draw ^ key) & mask)
            v = (left << half_) | right
            if todo is None:
                x[:] = v
            else:
                x[todo] = v
            # Only those that landed beyond go on.
            beyond = np.flatnonzero(v >= n)
            todo = beyond if todo is None else todo[beyond]
            v, draw = v[beyond], draw[beyond]
        x = x.reshape(len(draws), len(numbers))
    return x.astype(np.int64)


def permutation_test(values: DataFrame, groups: DataFrame, pairs: DataFrame, permutations: int = 1000, seed: int = 0, least_share: float = 0.1) -> DataFrame:
    """(a, b, grp_a, grp_b, mean, p_value) of every tested pair (a, b) of features and ordered pair of groups.

    ``values`` is (cell, feature, value), at most one row a cell and feature, absent ones being zero; ``groups`` is
    (cell, grp), one row a cell.  ``mean`` is half the sum of a's mean in the first group and b's in the second; its
    p-value is the share of permutations whose mean is as large.  It is null where fewer than ``least_share`` of a
    group's cells hold its feature.  Cells without a group and their values take no part.
    """
    spark = values.sparkSession
    placed = groups.where("grp is not null").select("cell", F.col("grp").cast("string").alias("grp"))
    tested = pairs.select("a", "b").distinct()
    sizes = placed.groupBy("grp").agg(F.count("*").alias("n")).orderBy("grp").limit(10_001).collect()
    features = [r.f for r in tested.select(F.explode(F.array("a", "b")).alias("f")).distinct().orderBy("f").limit(100_001).collect()]
    asked = [(r.a, r.b) for r in tested.orderBy("a", "b").limit(MOST_TESTS + 1).collect()]
    if len(sizes) > 10_000 or len(asked) * len(sizes) ** 2 > MOST_TESTS:
        raise ValueError("too many pairs of features and groups for one test")
    schema = "a string, b string, grp_a string, grp_b string, mean double, p_value double"
    if not sizes or not asked:
        return spark.createDataFrame([], schema)
    code, count = {f: k for k, f in enumerate(features)}, np.array([r.n for r in sizes])
    ends, n, g, f_ = np.cumsum(count), int(count.sum()), len(count), len(features)
    number = numbered(placed, ["cell"])
    known = broadcast_if_small(spark.createDataFrame([(k, f) for f, k in code.items()], "f int, feature string"), f_)
    group = broadcast_if_small(spark.createDataFrame([(k, r.grp) for k, r in enumerate(sizes)], "g int, grp string"), g)
    rows = values.join(number, "cell").join(known, "feature").join(group, "grp").select("number", "g", "f", F.col("value").cast("double").alias("value"))
    # A cell's rows stand together, so that its draws are made once.
    rows = settle(rows.repartition("number").sortWithinPartitions("number"), "test-rows")
    own = rows.groupBy("g", "f").agg(F.sum("value").alias("s"), F.sum((F.col("value") > 0).cast("int")).alias("k")).collect()
    observed, share = np.zeros((g, f_)), np.zeros((g, f_))
    for r in own:
        observed[r.g, r.f], share[r.g, r.f] = r.s / count[r.g], r.k / count[r.g]
    at, bt = np.array([code[a] for a, _ in asked]), np.array([code[b] for _, b in asked])
    # (pair, first group, second group)
    half = lambda m: (m[..., :, None][..., at, :, :] + m[..., None, :][..., bt, :, :]) / 2
    wanted = half(observed.T)
    margin = 1e-12 * np.abs(wanted)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((permutations, g * f_))
        for frame in frames:
            cells, place = np.unique(frame["number"].to_numpy(np.int64), return_inverse=True)
            f, v = frame["f"].to_numpy(np.int64), frame["value"].to_numpy(float)
            # One product of matrices a group costs less than to add up row by row, unless cells hold few of the features.
            dense = None
            if g * f_ <= DENSE_SHARE * len(frame) / len(cells):
                dense = np.bincount(place * f_ + f, weights=v, minlength=len(cells) * f_).reshape(len(cells), f_)
            for a in range(0, permutations, BLOCK):
                draws = np.arange(a, min(permutations, a + BLOCK))
                label = np.searchsorted(ends, shuffled(cells, n, seed, draws), "right")
                if dense is not None:
                    for k in range(g):
                        total[draws, k * f_ : (k + 1) * f_] += (label == k).astype(float) @ dense
                    continue
                for k, d in enumerate(draws):
                    total[d] += np.bincount(label[k][place] * f_ + f, weights=v, minlength=g * f_)
        for a in range(0, permutations, BLOCK):
            part = total[a : a + BLOCK]
            yield pd.DataFrame({"d": np.repeat(np.arange(a, a + len(part)), g * f_), "k": np.tile(np.arange(g * f_), len(part)), "s": part.ravel()})

    drawn = rows.mapInPandas(sums, "d int, k int, s double").groupBy("d", "k").agg(F.sum("s").alias("s"))
    whole = drawn.groupBy("d").agg(F.sort_array(F.collect_list(F.struct("k", "s"))).alias("m")).select(F.transform("m", lambda m: m.s).alias("m"))

    def above(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        more = np.zeros(wanted.shape, np.int64)
        for frame in frames:
            for m in frame["m"]:
                more += half((np.asarray(m, float).reshape(g, f_) / count[:, None]).T) >= wanted - margin
        yield pd.DataFrame({"t": np.arange(more.size), "c": more.ravel()})

    larger = whole.mapInPandas(above, "t long, c long").groupBy("t").agg(F.sum("c").alias("c"))
    enough = (share[:, at].T[:, :, None] >= least_share) & (share[:, bt].T[:, None, :] >= least_share)
    names = [r.grp for r in sizes]
    told = [(t, asked[t // (g * g)][0], asked[t // (g * g)][1], names[t // g % g], names[t % g], float(m), bool(e)) for t, (m, e) in enumerate(zip(wanted.ravel(), enough.ravel(), strict=True))]
    table = spark.createDataFrame(told, "t long, a string, b string, grp_a string, grp_b string, mean double, enough boolean")
    # Without any value all permutations are alike.
    p = F.when(F.col("enough"), F.coalesce("c", F.lit(permutations)) / permutations)
    return table.join(larger, "t", "left").select("a", "b", "grp_a", "grp_b", "mean", p.alias("p_value"))
