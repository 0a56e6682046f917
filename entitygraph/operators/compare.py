"""Agreement of two partitions of the same rows, from their contingency table; values of contexts and what marks groups of them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitygraph.functions import labels as L
from entitygraph.functions.storage import broadcast_if_small, numbered, running_sum, settle


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n); rows with a null label in either are left out."""
    return rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def encode_unassigned(label: str, key: str, how: str) -> Column:
    """Unassigned rows as one class (``mega``), one class each (``single``), or null (``drop``)."""
    gone = L.is_unassigned(label)
    other = {"mega": F.lit("UNASSIGNED"), "single": F.concat(F.lit("UNASSIGNED#"), F.col(key).cast("string")), "drop": F.lit(None).cast("string")}[how]
    return F.when(gone, other).otherwise(F.col(label))


def _pairs(n: Column) -> Column:
    return (n.cast("decimal(28,0)") * (n - 1).cast("decimal(28,0)") / 2).cast("decimal(38,0)")


def pair_sums(table: DataFrame) -> DataFrame:
    """One row: rows n, and pairs together in both, in a, in b (exact decimals)."""
    both = table.agg(F.sum("n").alias("n"), F.sum(_pairs(F.col("n"))).alias("s_ab"))
    side = lambda c: table.groupBy(c).agg(F.sum("n").alias("m")).agg(F.sum(_pairs(F.col("m"))).alias(f"s_{c}"))
    return both.crossJoin(side("a")).crossJoin(side("b"))


def rand_indices(table: DataFrame) -> DataFrame:
    """One row: the Rand index, its adjusted form and Fowlkes-Mallows."""
    d = {c: F.col(c).cast("double") for c in ("s_ab", "s_a", "s_b")}
    total = F.col("n").cast("double") * (F.col("n") - 1) / 2
    expected = d["s_a"] * d["s_b"] / total
    most = (d["s_a"] + d["s_b"]) / 2
    return pair_sums(table).select(
        ((total + 2 * d["s_ab"] - d["s_a"] - d["s_b"]) / total).alias("rand_index"),
        F.when(most == expected, 1.0).otherwise((d["s_ab"] - expected) / (most - expected)).alias("adjusted_rand_index"),
        F.when((d["s_a"] > 0) & (d["s_b"] > 0), d["s_ab"] / F.sqrt(d["s_a"] * d["s_b"])).otherwise(0.0).alias("fowlkes_mallows"),
    )


def information(table: DataFrame, beta: float = 1.0) -> DataFrame:
    """One row: entropies, mutual information, NMI (arithmetic mean), homogeneity, completeness, V."""
    total = table.agg(F.sum("n").cast("double").alias("t"))
    h = lambda c: table.groupBy(c).agg(F.sum("n").cast("double").alias("m")).crossJoin(F.broadcast(total)).agg(F.sum(-F.col("m") / F.col("t") * F.ln(F.col("m") / F.col("t"))).alias(f"h_{c}"))
    side = lambda c: table.groupBy(c).agg(F.sum("n").cast("double").alias(f"m_{c}"))
    mi = table.join(side("a"), "a").join(side("b"), "b").crossJoin(F.broadcast(total)).agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("m_a") * F.col("m_b")))).alias("mi"))
    one = mi.crossJoin(h("a")).crossJoin(h("b"))
    share = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(1.0)
    out = one.withColumns({"homogeneity": share("mi", "h_a"), "completeness": share("mi", "h_b")})
    v = (1 + beta) * F.col("homogeneity") * F.col("completeness") / (beta * F.col("homogeneity") + F.col("completeness"))
    nmi = F.when(F.col("h_a") + F.col("h_b") > 0, 2 * F.col("mi") / (F.col("h_a") + F.col("h_b"))).otherwise(1.0)
    return out.select("mi", "h_a", "h_b", nmi.alias("nmi"), "homogeneity", "completeness", F.when(F.col("homogeneity") + F.col("completeness") > 0, v).otherwise(0.0).alias("v_measure"))


def expected_information(a: dict[int, int], b: dict[int, int], n: int) -> float:
    """Expected mutual information of random partitions with these class sizes (size -> number of classes).

    The overlap of two classes is hypergeometric; its terms are worked off in blocks.
    """
    log_fact = np.vectorize(lambda k: math.lgamma(k + 1), otypes=[float])
    out = 0.0
    for x, cx in a.items():
        for y, cy in b.items():
            first, last = max(1, x + y - n), min(x, y)
            fixed = sum(math.lgamma(k + 1) for k in (x, y, n - x, n - y)) - math.lgamma(n + 1)
            for k0 in range(first, last + 1, 1 << 16):
                k = np.arange(k0, min(last, k0 + (1 << 16) - 1) + 1)
                log_p = fixed - log_fact(k) - log_fact(x - k) - log_fact(y - k) - log_fact(n - x - y + k)
                out += cx * cy * float((k / n * np.log(n * k / (x * y)) * np.exp(log_p)).sum())
    return out


def adjusted_information(table: DataFrame) -> float:
    """AMI (arithmetic mean). The driver gets one row per distinct class size only."""
    row = information(table).first()
    sizes = lambda c: {r["m"]: r["k"] for r in table.groupBy(c).agg(F.sum("n").alias("m")).groupBy("m").agg(F.count("*").alias("k")).collect()}
    n = table.agg(F.sum("n")).first()[0] or 0
    if n == 0:
        return 1.0
    emi = expected_information(sizes("a"), sizes("b"), int(n))
    mean = (row["h_a"] + row["h_b"]) / 2
    return 1.0 if math.isclose(mean, emi, abs_tol=1e-15) else (row["mi"] - emi) / (mean - emi)


def dominant_purity(table: DataFrame) -> DataFrame:
    """One row: the share of rows that carry the commonest b of their a."""
    return table.groupBy("a").agg(F.max("n").alias("top"), F.sum("n").alias("m")).agg((F.sum("top") / F.sum("m")).alias("purity"))


def pair_classes(rows: DataFrame, a: str, b: str, tile: str) -> DataFrame:
    """One row: pairs together in a, in b and in both, within one tile and across tiles.

    Pairs are counted from group sizes; none is made.
    """

    def together(*keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.count("*").alias("m")).agg(F.coalesce(F.sum(_pairs(F.col("m"))), F.lit(0)).cast("long").alias("s"))

    names = {"a": (a,), "b": (b,), "ab": (a, b)}
    out = None
    for name, keys in names.items():
        one = together(*keys).withColumnRenamed("s", f"{name}_all").crossJoin(together(*keys, tile).withColumnRenamed("s", f"{name}_same_tile"))
        out = one if out is None else out.crossJoin(one)
    return out.select(*(c for n in names for c in (F.col(f"{n}_same_tile"), (F.col(f"{n}_all") - F.col(f"{n}_same_tile")).alias(f"{n}_cross_tile"))))


def coverage(rows: DataFrame, before: str, after: str, kind: str | None = None) -> DataFrame:
    """One row: share of assigned rows, cells kept of those before, and cells lost.

    ``kind`` names a column with the kinds of ``after``; without it labels are parsed, which takes names with a dash for partials.
    """
    was, now = ~L.is_unassigned(before), ~L.is_unassigned(after)
    kept = F.countDistinct(F.when(now & ((F.col(kind) if kind else L.etype_of_label(after)) == "cell"), F.col(after)))
    had = F.countDistinct(F.when(was, F.col(before)))
    return rows.agg((F.avg(now.cast("int")) * 100).alias("coverage_pct"), had.alias("n_cells_before"), kept.alias("n_cells_after")).withColumns(
        {"retention_pct": F.when(F.col("n_cells_before") > 0, 100.0 * F.col("n_cells_after") / F.col("n_cells_before")), "cells_lost": F.col("n_cells_before") - F.col("n_cells_after")}
    )


def summary(scores: DataFrame, values: list[str], dataset: str) -> DataFrame:
    """(dataset, metric, mean, p80, p95) of each column."""
    out = None
    for v in values:
        one = scores.agg(F.lit(dataset).alias("dataset"), F.lit(v).alias("metric"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.8)).alias("p80"), F.percentile(v, F.lit(0.95)).alias("p95")).select("dataset", "metric", "mean", "p80", "p95")
        out = one if out is None else out.unionByName(one)
    return out


def normalized_log(counts: DataFrame, target: float = 1e4) -> DataFrame:
    """Counts (cell, feature, n) scaled to a common total and log(1 + x)."""
    total = counts.groupBy("cell").agg(F.sum("n").alias("t"))
    return counts.join(total, "cell").select("cell", "feature", F.log1p(F.col("n") / F.col("t") * target).alias("value"))


def hellinger(counts: DataFrame) -> DataFrame:
    """Square roots of each context's shares."""
    total = counts.groupBy("cell").agg(F.sum("n").alias("t"))
    return counts.join(total, "cell").select("cell", "feature", F.sqrt(F.col("n") / F.col("t")).alias("value"))


def pearson_residuals(counts: DataFrame, theta: float = 100.0) -> DataFrame:
    """Residuals of observed counts under a negative binomial with the margins' means, clipped at sqrt(contexts)."""
    cells = counts.groupBy("cell").agg(F.sum("n").alias("c"))
    genes = counts.groupBy("feature").agg(F.sum("n").alias("g"))
    all_ = counts.agg(F.sum("n").alias("t"), F.countDistinct("cell").alias("m"))
    mu = F.col("c") * F.col("g") / F.col("t")
    z = (F.col("n") - mu) / F.sqrt(mu + mu * mu / theta)
    most = F.sqrt(F.col("m"))
    return counts.join(cells, "cell").join(genes, "feature").crossJoin(F.broadcast(all_)).select("cell", "feature", F.greatest(F.least(z, most), -most).alias("value"))


def principal_components(counts: DataFrame, k: int = 2) -> DataFrame:
    """(cell, pc array<double>): principal components of a sparse long matrix (cell, feature, value)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    number = settle(numbered(counts.select("feature").distinct(), ["feature"], "i"), "features")
    size = number.count()
    placed = counts.join(broadcast_if_small(number, size), "feature")
    rows = placed.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct(F.col("i").cast("int"), F.col("value").cast("double")))).alias("p"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("p", i), F.lit(0.0)))
    rows = rows.select("cell", array_to_vector(dense).alias("features"))
    return PCA(k=k, inputCol="features", outputCol="pc").fit(rows).transform(rows).select("cell", vector_to_array("pc").alias("pc"))


def rank_markers(values: DataFrame, groups: DataFrame, tie_correct: bool = False) -> DataFrame:
    """Features that mark groups of contexts, by Wilcoxon's rank sums: (grp, feature, score, p_value, p_adjusted, log_fold, share_in, share_out).

    ``values`` is (cell, feature, value) with positive values alone, at most one a cell and feature; ``groups`` is
    (cell, grp), one row a cell.  Zeros are counted and not stored: they share the lowest ranks.  Ties
    take their mean rank.  The score is the normal deviate of a group's rank sum against all other cells, with
    ``tie_correct`` under the variance that ties leave; p-values are two-sided and adjusted within
    a group by Benjamini and Hochberg; ``log_fold`` compares mean values taken as log(1 + x).  Cells without a group and
    values of other cells are left out; a group that holds all cells has null scores.
    """
    placed = groups.where("grp is not null")
    held = values.where("value > 0").join(placed, "cell")
    size = placed.groupBy("grp").agg(F.count("*").alias("n1"))
    n = placed.agg(F.count("*").alias("n"))
    # Ranks of distinct values: what lies ahead within the feature, found over ranges of all values.
    counted = held.groupBy("feature", "value").agg(F.count("*").alias("c"))
    ahead = settle(running_sum(counted, ["feature", "value"], "c", "before"), "ahead")
    total = settle(ahead.groupBy("feature").agg(F.min("before").alias("start"), F.sum("c").alias("stored"), F.sum(F.pow(F.col("c").cast("double"), F.lit(3)) - F.col("c")).alias("ties")), "stored", compact=True)
    rank = ahead.join(broadcast_if_small(total.select("feature", "start")), "feature").select("feature", "value", (F.col("before") - F.col("start") + (F.col("c") + 1) / 2).alias("rank"))
    own = held.groupBy("grp", "feature", "value").agg(F.count("*").alias("c")).join(rank, ["feature", "value"])
    own = own.groupBy("grp", "feature").agg(F.sum(F.col("c") * F.col("rank")).alias("r"), F.sum("c").alias("k"), F.sum(F.col("c") * F.col("value")).alias("s"))
    sums = held.groupBy("feature").agg(F.sum("value").alias("all_s"))
    # Every group has a row for every feature: the result itself.
    every = total.join(sums, "feature").join(F.broadcast(size), F.lit(True)).crossJoin(F.broadcast(n)).join(own, ["grp", "feature"], "left")
    zeros, k = F.col("n") - F.col("stored"), F.coalesce("k", F.lit(0))
    # Stored values rank above all zeros, which share the mean of the lowest ranks.
    ranks = F.coalesce("r", F.lit(0.0)) + k * zeros + (F.col("n1") - k) * (zeros + 1) / 2
    n2 = F.col("n") - F.col("n1")
    spread = F.col("n") + 1.0
    if tie_correct:
        spread = spread - (F.col("ties") + F.pow(zeros.cast("double"), F.lit(3)) - zeros) / (F.col("n").cast("double") * (F.col("n") - 1))
    deviation = F.sqrt(F.col("n1").cast("double") * n2 / 12 * spread)
    s1 = F.coalesce("s", F.lit(0.0))
    mean1, mean2 = s1 / F.col("n1"), (F.col("all_s") - s1) / n2
    fold = F.log2((F.expm1(mean1) + 1e-9) / (F.expm1(mean2) + 1e-9))
    out = every.select("grp", "feature", F.when((n2 > 0) & (deviation > 0), (ranks - F.col("n1") * (F.col("n") + 1) / 2) / deviation).alias("score"), F.when(n2 > 0, fold).alias("log_fold"), (k / F.col("n1")).alias("share_in"), F.when(n2 > 0, (F.col("stored") - k) / n2).alias("share_out"))

    @F.pandas_udf("double")
    def two_sided(score: pd.Series) -> pd.Series:
        return score.map(lambda z: math.erfc(abs(z) / math.sqrt(2)), na_action="ignore").astype(float)

    by = Window.partitionBy("grp").orderBy(F.desc("p_value"), "feature")
    m = F.count("p_value").over(Window.partitionBy("grp"))
    place = F.count("p_value").over(Window.partitionBy("grp").orderBy("p_value").rangeBetween(Window.unboundedPreceding, 0))
    scored = settle(out.withColumn("p_value", two_sided("score")), "scored", compact=True, heavy=True)
    raised = scored.withColumn("_q", F.when(F.col("p_value").isNotNull(), F.col("p_value") * m / place))
    adjusted = F.least(F.min("_q").over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))
    return raised.withColumn("p_adjusted", F.when(F.col("p_value").isNotNull(), adjusted)).select("grp", "feature", "score", "p_value", "p_adjusted", "log_fold", "share_in", "share_out")
