"""Entities as sets of features: tables, purity, conflict, coherence, merge gains, moments.

Rows are (id, entity, feature, x, y, z[, etype]); panels are (gi, gj, w) with gi < gj.
What an unobserved pair means is always said: ``absent="skip"`` leaves it out of the
denominator, ``absent="zero"`` counts it there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from entitygraph.functions import labels as L
from entitygraph.functions.scalars import relu_symmetric
from entitygraph.functions.storage import broadcast_if_small, settle
from entitygraph.operators import kernels

EPS = 1e-8


def entity_table(rows: DataFrame, entity: str = "entity", etype: str | None = None) -> DataFrame:
    """One row an entity: centre, extent, sorted features, kind (that of the smallest id) and size.

    Dropped and nan labels, and kinds other than cell, partial and component, are left out.
    """
    kind = F.col(etype) if etype else L.etype_of_label(entity)
    live = rows.withColumn("_kind", kind).where(F.col(entity).isNotNull() & ~F.col(entity).isin("DROP", "nan") & F.col("_kind").isin("cell", "partial", "component"))
    axes = [f(c).alias(f"{c}{s}") for c in ("x", "y", "z") for s, f in (("", F.avg), ("_min", F.min), ("_max", F.max))]
    return live.groupBy(F.col(entity).alias("entity")).agg(*axes, F.array_sort(F.collect_set("feature")).alias("genes"), F.min_by("_kind", "id").alias("etype"), F.count("*").alias("n"))


def shared_and_own(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two tables of the same columns, without repeats, and their ``side``: both, left or right."""
    mark = lambda df, side: df.withColumn("side", F.lit(side))
    return mark(left.intersect(right), "both").unionByName(mark(left.subtract(right), "left")).unionByName(mark(right.subtract(left), "right"))


def features_of(rows: DataFrame, entity: str = "entity") -> DataFrame:
    """Distinct (entity, feature)."""
    return rows.select(F.col(entity).alias("entity"), "feature").where(F.col("entity").isNotNull() & F.col("feature").isNotNull()).distinct()


def scored_pairs(sets: DataFrame, panel: DataFrame) -> DataFrame:
    """(entity, w) for every pair of features that an entity holds; w is null where the pair is not in the panel."""
    a, b = sets.select("entity", F.col("feature").alias("gi")), sets.select("entity", F.col("feature").alias("gj"))
    return a.join(b, "entity").where("gi < gj").join(broadcast_if_small(panel), ["gi", "gj"], "left").select("entity", "gi", "gj", "w")


def pair_aggregate(sets: DataFrame, panel: DataFrame, threshold: float = 0.0, tau: float = 0.0) -> DataFrame:
    """(entity, k, n_pairs, n_pos, neg_abs, relu_pos, relu_neg, strength) for every entity, single features included."""
    relu = relu_symmetric("w", tau)
    zero = F.lit(0.0)
    sums = scored_pairs(sets, panel).groupBy("entity").agg(
        F.sum(F.when(F.col("w") > threshold, 1).otherwise(0)).alias("n_pos"),
        F.sum(F.when(F.col("w") < 0, -F.col("w")).otherwise(zero)).alias("neg_abs"),
        F.sum(F.when(relu > 0, relu).otherwise(zero)).alias("relu_pos"),
        F.sum(F.when(relu < 0, -relu).otherwise(zero)).alias("relu_neg"),
        F.sum(F.abs(F.coalesce("w", zero))).alias("strength"),
    )
    sizes = sets.groupBy("entity").agg(F.count("*").alias("k"))
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_pos", "neg_abs", "relu_pos", "relu_neg", "strength")]
    return sizes.join(sums, "entity", "left").select("entity", "k", (F.col("k") * (F.col("k") - 1) / 2).alias("n_pairs"), *filled)


def purity_conflict(aggregate: DataFrame, single: float | None = None) -> DataFrame:
    """Purity and conflict over all pairs; ``single`` is their value where an entity has one feature (null: none)."""
    empty = F.lit(single).cast("double")
    share = lambda c: F.when(F.col("n_pairs") > 0, F.col(c) / F.col("n_pairs")).otherwise(empty)
    return aggregate.withColumns({"purity": share("n_pos"), "conflict": share("neg_abs")})


def flag_top(scored: DataFrame, column: str, flag: str, share: float = 0.8, threshold: float | None = None) -> DataFrame:
    """Whether a score reaches a threshold, or the given percentile of all scores."""
    if threshold is not None:
        return scored.withColumn(flag, F.col(column) >= threshold)
    cut = scored.agg(F.percentile(column, F.lit(share)).alias("_cut"))
    return scored.crossJoin(F.broadcast(cut)).withColumn(flag, F.col(column) >= F.col("_cut")).drop("_cut")


def relu_scores(aggregate: DataFrame) -> DataFrame:
    """Purity, conflict, their shares of the total and the signal strength after symmetric thresholding."""
    mean = lambda c: F.when(F.col("n_pairs") > 0, F.col(c) / F.col("n_pairs"))
    out = aggregate.withColumns({"purity_relu": mean("relu_pos"), "conflict_relu": mean("relu_neg")})
    total = F.col("purity_relu") + F.col("conflict_relu")
    return out.withColumns({"signal_strength": total, "relative_purity": F.col("purity_relu") / (total + EPS), "relative_conflict": F.col("conflict_relu") / (total + EPS)})


def coherence(sets: DataFrame, panel: DataFrame, tau: float = 0.0, absent: str = "skip", mode: str = "count", real_signal: float | None = None) -> DataFrame:
    """(entity, purity, conflict, coherence) of every entity.

    ``count``: pairs above tau and below -tau over all counted pairs; ``magnitude``: sums of
    positive and negative weights over the sum of magnitudes.  With ``real_signal``, weaker
    pairs count nowhere.  No counted pair gives (0, 0, 0).
    """
    p = scored_pairs(sets, panel)
    if absent == "zero":
        p = p.withColumn("w", F.coalesce("w", F.lit(0.0)))
    if real_signal is not None:
        p = p.where(F.abs("w") > real_signal)
    up, down = F.col("w") > tau, F.col("w") < -tau
    if mode == "count":
        aggs = [F.sum(F.when(up, 1.0).otherwise(0.0)), F.sum(F.when(down, 1.0).otherwise(0.0)), F.count("w").cast("double")]
    else:
        aggs = [F.sum(F.when(up, F.col("w")).otherwise(0.0)), F.sum(F.when(down, -F.col("w")).otherwise(0.0)), F.sum(F.abs("w"))]
    sums = p.groupBy("entity").agg(*(a.alias(n) for a, n in zip(aggs, ("pos", "neg", "total"), strict=True)))
    share = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total")).otherwise(0.0)
    return sets.select("entity").distinct().join(sums, "entity", "left").select("entity", share("pos").alias("purity"), share("neg").alias("conflict")).withColumn("coherence", F.col("purity") - F.col("conflict"))


#: Pairs of features that a worker looks up at once.
PAIRS_AT_ONCE = 2_000_000


def _coherences(panel, tau: float, absent: str) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """codes (of sets one after the other), their lengths, sizes of the sets with features outside the panel -> coherence of each set, by counts of pairs."""

    def run(codes: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        up, down, seen = (np.zeros(len(lengths), np.int64) for _ in range(3))
        starts = np.cumsum(lengths) - lengths
        for k in np.unique(lengths[lengths > 1]).tolist():
            rows = np.flatnonzero(lengths == k)
            step = max(1, PAIRS_AT_ONCE // (k * k))
            for c in range(0, len(rows), step):
                some = rows[c : c + step]
                own = codes[starts[some][:, None] + np.arange(k)]
                width = max(1, PAIRS_AT_ONCE // (k * len(some)))
                for i in range(0, k - 1, width):
                    ends = np.arange(i, min(k - 1, i + width))
                    w = panel.of(own[:, ends][:, :, None], own[:, None, :])
                    w = np.where(np.arange(k)[None, None, :] > ends[None, :, None], w, np.nan)
                    up[some] += (w > tau).sum((1, 2))
                    down[some] += (w < -tau).sum((1, 2))
                    seen[some] += (~np.isnan(w)).sum((1, 2))
        total = sizes * (sizes - 1) // 2 if absent == "zero" else seen
        return np.where(total > 0, up / np.maximum(total, 1) - down / np.maximum(total, 1), 0.0)

    return run


def _coded(sets: DataFrame, panel, tau: float, absent: str) -> DataFrame:
    """(entity, codes, others, c): of every entity its features' numbers in the panel, the features outside it, and its coherence."""
    kind = dict(sets.dtypes)["entity"]
    held = sets.groupBy("entity").agg(F.collect_set("feature").alias("features"))
    names = panel.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, value = pa.array(names, pa.string()), _coherences(panel, tau, absent)
        for batch in (b for b in batches if b.num_rows):
            lists = batch.column("features")
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            flat, owner = lists.flatten(), np.repeat(np.arange(len(n)), n)
            code = pc.index_in(flat, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.lexsort((code, owner))
            order = order[code[order] >= 0]
            known, out = np.bincount(owner[order], minlength=len(n)), np.flatnonzero(code < 0)
            at = lambda m: pa.array(np.concatenate([[0], np.cumsum(m)]), pa.int32())
            codes = pa.ListArray.from_arrays(at(known), pa.array(code[order], pa.int32()))
            others = pa.ListArray.from_arrays(at(n - known), flat.take(pa.array(out)))
            yield pa.RecordBatch.from_arrays([batch.column("entity"), codes, others, pa.array(value(code[order], known, n))], ["entity", "codes", "others", "c"])

    return held.mapInArrow(run, f"entity {kind}, codes array<int>, others array<string>, c double")


def delta_c(sets: DataFrame, sizes: DataFrame, candidates: DataFrame, panel: DataFrame, tau: float = 0.0, absent: str = "zero", penalized: bool = True) -> DataFrame:
    """The gain in coherence of merging candidate pairs (a, b): (a, b, c_union, c_a, c_b, delta_c).

    ``sizes`` is (entity, n), n the size that the penalty 1/n uses.  An entity is one row, with its features by number; entities and
    candidates meet by shuffles, as files that look small may hold many of them.
    """
    from entitygraph.operators.stages import Panel

    if panel.limit(Panel.MOST_PAIRS + 1).count() > Panel.MOST_PAIRS:
        return _gain(_delta_c_joined(sets, sizes, candidates, panel, tau, absent), penalized)
    table = Panel(panel)
    one = settle(_coded(sets, table, tau, absent).join(sizes.select("entity", "n").hint("merge"), "entity"), "coded")
    end = lambda s: one.select(F.col("entity").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("codes", "others", "c", "n")))
    met = candidates.select("a", "b").distinct().join(end("a").hint("merge"), "a").join(end("b").hint("merge"), "b")
    others = F.size(F.array_union("others_a", "others_b")).alias("others")
    met = met.select("a", "b", F.array_union("codes_a", "codes_b").alias("codes"), others, "c_a", "c_b", "n_a", "n_b")
    kind = dict(met.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = _coherences(table, tau, absent)
        for batch in (b for b in batches if b.num_rows):
            lists = batch.column("codes")
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            c = value(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), n, n + batch.column("others").to_numpy())
            rest = [k for k in batch.schema.names if k not in ("codes", "others")]
            yield pa.RecordBatch.from_arrays([pa.array(c), *(batch.column(k) for k in rest)], ["c_union", *rest])

    joined = met.mapInArrow(run, ", ".join(["c_union double", *(f"{k} {kind[k]}" for k in ("a", "b", "c_a", "c_b", "n_a", "n_b"))]))
    return _gain(joined, penalized)


def _delta_c_joined(sets: DataFrame, sizes: DataFrame, candidates: DataFrame, panel: DataFrame, tau: float, absent: str) -> DataFrame:
    """:func:`delta_c` before the penalty, for panels that are too large to be sent to the workers: pairs of features are rows."""
    c = coherence(sets, panel, tau, absent).select("entity", "coherence").join(sizes.hint("merge"), "entity")
    end = lambda s: c.select(F.col("entity").alias(s), F.col("coherence").alias(f"c_{s}"), F.col("n").alias(f"n_{s}")).hint("merge")
    merged = candidates.select("a", "b").distinct().withColumn("entity", F.concat_ws("|", "a", "b")).hint("merge")
    union = merged.join(sets.withColumnRenamed("entity", "a"), "a").select("entity", "feature").union(merged.join(sets.withColumnRenamed("entity", "b"), "b").select("entity", "feature")).distinct()
    return merged.join(coherence(union, panel, tau, absent).select("entity", F.col("coherence").alias("c_union")), "entity").join(end("a"), "a").join(end("b"), "b")


def _gain(joined: DataFrame, penalized: bool) -> DataFrame:
    cost = lambda n: F.lit(1.0) / F.greatest(n, F.lit(1)) if penalized else F.lit(0.0)
    gain = F.col("c_union") - cost(F.col("n_a") + F.col("n_b")) - F.greatest(F.col("c_a") - cost(F.col("n_a")), F.col("c_b") - cost(F.col("n_b")))
    return joined.select("a", "b", "c_union", "c_a", "c_b", gain.alias("delta_c"))


def component_delta_c(sets: DataFrame, candidates: DataFrame, panel: DataFrame, threshold: float = 0.0) -> DataFrame:
    """The gain of merging components: purity less the mean magnitude of negative pairs; two single features never merge."""
    conflict = lambda: F.coalesce(F.avg(F.when(F.col("w") < 0, -F.col("w"))), F.lit(0.0))

    def value(s: DataFrame) -> DataFrame:
        found = scored_pairs(s, panel).groupBy("entity").agg((F.sum(F.when(F.col("w") > threshold, 1.0).otherwise(0.0)) / F.count("*") - conflict()).alias("c"))
        return s.groupBy("entity").agg(F.count("*").alias("k")).join(found, "entity", "left").select("entity", "k", F.coalesce("c", F.lit(0.0)).alias("c"))

    single = value(sets)
    end = lambda s: single.select(F.col("entity").alias(s), F.col("c").alias(f"c_{s}"), F.col("k").alias(f"k_{s}"))
    merged = candidates.select("a", "b").distinct().withColumn("entity", F.concat_ws("|", "a", "b")).hint("merge")
    union = merged.join(sets.withColumnRenamed("entity", "a"), "a").select("entity", "feature").union(merged.join(sets.withColumnRenamed("entity", "b"), "b").select("entity", "feature")).distinct()
    out = merged.join(value(union).select("entity", F.col("c").alias("c_union")), "entity").join(end("a"), "a").join(end("b"), "b")
    gain = F.when((F.col("k_a") == 1) & (F.col("k_b") == 1), F.lit(float("-inf"))).otherwise(F.col("c_union") - F.greatest("c_a", "c_b"))
    return out.select("a", "b", gain.alias("delta_c"))


def mean_fit(queries: DataFrame, sets: DataFrame, panel: DataFrame) -> DataFrame:
    """(feature, entity, fit): the mean observed weight of a feature to an entity's other features, null if none."""
    both = panel.select(F.col("gi").alias("feature"), F.col("gj").alias("other"), "w").unionByName(panel.select(F.col("gj").alias("feature"), F.col("gi").alias("other"), "w"))
    q = queries.select("feature", "entity").distinct()
    return q.join(sets.withColumnRenamed("feature", "other"), "entity").where(F.col("feature") != F.col("other")).join(broadcast_if_small(both), ["feature", "other"], "left").groupBy("feature", "entity").agg(F.avg("w").alias("fit"))


def pair_stats(sets: DataFrame, panel: DataFrame) -> DataFrame:
    """Sum, minimum and quartiles of an entity's observed pair weights; null without one."""
    quartiles = F.percentile("w", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    s = scored_pairs(sets, panel).groupBy("entity").agg(F.sum("w").alias("w_sum"), F.min("w").alias("w_min"), quartiles.alias("q"), F.count("w").alias("n"))
    return s.select("entity", "w_sum", "w_min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "n")


def z_values(rows: DataFrame, entity: str = "entity", least: int = 5) -> DataFrame:
    """(entity, z, c, n): an entity's distinct z in order, how often each occurs, and its rows; entities of fewer than ``least`` rows are left out."""
    live = rows.where(F.col(entity).isNotNull() & F.col("z").isNotNull()).select(F.col(entity).alias("entity"), F.col("z").cast("double").alias("z"))
    values = live.groupBy("entity", "z").agg(F.count("*").alias("c"))
    row = values.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("z", "c"))).alias("v"), F.sum("c").alias("n")).where(F.col("n") >= max(2, least))
    return row.select("entity", F.transform("v", lambda v: v.z).alias("z"), F.transform("v", lambda v: v.c).alias("c"), "n")


def dz_stats(rows: DataFrame, entity: str = "entity", percentiles: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """Per entity: pairs, mean, largest and percentiles (``dz_p``, in order of ``percentiles``) of differences in z.

    Nothing is paired: percentiles are found by counting how many pairs differ by no more than a bound.
    """
    kind = dict(rows.dtypes)[entity]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for name, z, c in f[["entity", "z", "c"]].itertuples(index=False):
                top = np.array([z[-1] - z[0]])
                n, s = kernels.differences_up_to(z, c, top)
                places = [(int(n[0]) - 1) * q for q in percentiles]
                ranks = sorted({int(r) for p in places for r in (np.floor(p), np.ceil(p))})
                at = dict(zip(ranks, kernels.kth_differences(z, c, ranks), strict=True))
                out.append((name, int(n[0]), s[0] / n[0], top[0], [at[int(p)] + (at[int(np.ceil(p))] - at[int(p)]) * (p - int(p)) for p in places]))
            yield pd.DataFrame(out, columns=["entity", "n_pairs", "dz_mean", "dz_max", "dz_p"])

    return z_values(rows, entity, 2).mapInPandas(run, f"entity {kind}, n_pairs long, dz_mean double, dz_max double, dz_p array<double>")


#: Parts into which a span of differences is cut at a time.
SPAN_PARTS = 64


def difference_counts(values: DataFrame, spans: list[tuple[float, float]], parts: int = SPAN_PARTS) -> tuple[np.ndarray, np.ndarray]:
    """Over all entities of :func:`z_values`, for ``parts`` bounds up the way of each span: how many pairs differ by no more, and the sum of
    their differences.  Executors add up what they hold; some rows a span reach the driver."""
    bounds = np.concatenate([np.linspace(low, high, parts + 1)[1:] for low, high in spans])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s = np.zeros(len(bounds), np.int64), np.zeros(len(bounds))
        for f in frames:
            for z, c in f[["z", "c"]].itertuples(index=False):
                more = kernels.differences_up_to(z, c, bounds)
                n, s = n + more[0], s + more[1]
        yield pd.DataFrame({"k": np.arange(len(bounds)), "n": n, "s": s})

    found = values.select("z", "c").mapInPandas(run, "k int, n long, s double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("k").collect()
    return np.array([r.n for r in found], np.int64).reshape(len(spans), -1), np.array([r.s for r in found], float).reshape(len(spans), -1)


def pooled_differences(values: DataFrame, places: list[float], top: float, rounds: int = 8) -> list[float]:
    """Differences at some places (from 0, between ranks by interpolation) among those of all pairs within entities, the largest being ``top``."""
    ranks = sorted({int(r) for p in places for r in (np.floor(p), np.ceil(p))})
    spans, below, at = [(0.0, top)] * len(ranks), [(0, 0.0)] * len(ranks), [0.0] * len(ranks)
    for _ in range(rounds):
        n, s = difference_counts(values, spans)
        for i, rank in enumerate(ranks):
            bounds = np.linspace(*spans[i], n.shape[1] + 1)
            k = int(np.searchsorted(n[i], rank, "right"))
            if k:
                below[i] = int(n[i, k - 1]), float(s[i, k - 1])
            at[i] = (s[i, k] - below[i][1]) / (n[i, k] - below[i][0])
            spans[i] = float(bounds[k]), float(bounds[k + 1])
    found = dict(zip(ranks, at, strict=True))
    return [found[int(p)] + (found[int(np.ceil(p))] - found[int(p)]) * (p - int(p)) for p in places]


def pooled_dz(rows: DataFrame, entity: str = "entity", at: tuple[float, ...] = (0.5, 0.75, 0.9, 0.95, 0.99), kinds: tuple[str, ...] | None = ("cell",), least: int = 5, etype: str = "etype") -> DataFrame:
    """One row over all pairs within all entities of ``least`` rows or more and of these kinds: percentiles of |dz| in order of ``at``,
    number of pairs and entities, mean, median and maximum.  Without such an entity there are 0 pairs and nulls."""
    live = rows.where(~F.coalesce(F.col(entity) == "-1", F.lit(True)))
    if kinds is not None:
        live = live.where((F.col(etype) if etype in rows.columns else L.etype_of_label(entity)).isin(*kinds))
    values = settle(z_values(live, entity, least), "z-values", compact=True)
    ends = values.agg(F.count("*").alias("e"), F.sum(F.expr("n * (n - 1) div 2")).alias("n"), F.max(F.element_at("z", -1) - F.element_at("z", 1)).alias("top")).first()
    schema = "p array<double>, n long, n_entities long, mean double, median double, max double"
    if not ends.e:
        return rows.sparkSession.createDataFrame([(None, 0, 0, None, None, None)], schema)
    found = pooled_differences(values, [(ends.n - 1) * q for q in (*at, 0.5)], ends.top)
    total = difference_counts(values, [(0.0, ends.top)], 1)[1][0, 0]
    return rows.sparkSession.createDataFrame([([float(v) for v in found[:-1]], ends.n, ends.e, float(total / ends.n), float(found[-1]), float(ends.top))], schema)


def moments(rows: DataFrame, entity: str = "entity") -> DataFrame:
    """n, means and centred covariances (ddof 1) of x, y, z; all from mergeable aggregates."""
    cov = {f"c{a}{b}": F.covar_samp(a, b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")}
    return rows.groupBy(F.col(entity).alias("entity")).agg(F.count("*").alias("n"), *(F.avg(a).alias(f"m{a}") for a in "xyz"), *(v.alias(k) for k, v in cov.items()))


def mahalanobis(cloud: DataFrame, candidates: DataFrame) -> DataFrame:
    """(a, b, d): distance of two clouds' centres under their pooled covariance, closed form in 3-D.

    Null where a cloud has fewer than two points or the pooled matrix is singular.
    """
    names = ["xx", "xy", "xz", "yy", "yz", "zz"]
    end = lambda s: cloud.select(F.col("entity").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ["n", "mx", "my", "mz", *(f"c{k}" for k in names)]))
    j = candidates.select("a", "b").distinct().hint("merge").join(end("a"), "a").join(end("b").hint("merge"), "b")
    w = lambda k: ((F.col("n_a") - 1) * F.col(f"c{k}_a") + (F.col("n_b") - 1) * F.col(f"c{k}_b")) / (F.col("n_a") + F.col("n_b") - 2)
    j = j.withColumns({**{k: w(k) for k in names}, **{f"d{a}": F.col(f"m{a}_a") - F.col(f"m{a}_b") for a in "xyz"}})
    c = F.col
    i11, i12, i13 = c("yy") * c("zz") - c("yz") * c("yz"), c("xz") * c("yz") - c("xy") * c("zz"), c("xy") * c("yz") - c("xz") * c("yy")
    i22, i23, i33 = c("xx") * c("zz") - c("xz") * c("xz"), c("xy") * c("xz") - c("xx") * c("yz"), c("xx") * c("yy") - c("xy") * c("xy")
    det = c("xx") * i11 + c("xy") * i12 + c("xz") * i13
    scale = F.greatest(c("xx"), c("yy"), c("zz"))
    quad = c("dx") * (i11 * c("dx") + i12 * c("dy") + i13 * c("dz")) + c("dy") * (i12 * c("dx") + i22 * c("dy") + i23 * c("dz")) + c("dz") * (i13 * c("dx") + i23 * c("dy") + i33 * c("dz"))
    good = (c("n_a") > 1) & (c("n_b") > 1) & (det > F.lit(1e-12) * scale * scale * scale)
    return j.select("a", "b", F.when(good, F.sqrt(quad / det)).alias("d"))


def attach(dimension: DataFrame, scores: DataFrame, key: str = "entity") -> DataFrame:
    """Scores on the entity dimension; entities without scores keep nulls."""
    return dimension.join(scores, key, "left")


def quantiles_by(scored: DataFrame, value: str, by: str | None = None, at: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    group = scored.groupBy(by) if by else scored.groupBy()
    p = group.agg(F.count(value).alias("n"), F.percentile(value, F.array(*map(F.lit, at))).alias("p"))
    return p.select(*([by] if by else []), "n", *(F.col("p")[k].alias(f"p{int(100 * v)}") for k, v in enumerate(at)))


def top_clique(sets: DataFrame, panel: DataFrame, top: int = 5) -> DataFrame:
    """(entity, feature): the features with the largest sums of positive weights to the rest of their entity."""
    p = scored_pairs(sets, panel).where("w > 0")
    ends = p.select("entity", F.col("gi").alias("feature"), "w").unionByName(p.select("entity", F.col("gj").alias("feature"), "w"))
    s = ends.groupBy("entity", "feature").agg(F.sum("w").alias("s"))
    return s.withColumn("k", F.row_number().over(Window.partitionBy("entity").orderBy(F.round("s", 9).desc(), "feature"))).where(F.col("k") <= top).select("entity", "feature")


def cross_mean(cliques: DataFrame, candidates: DataFrame, panel: DataFrame) -> DataFrame:
    """(a, b, mean): the mean observed weight between two entities' top features."""
    both = panel.select(F.col("gi").alias("f"), F.col("gj").alias("g"), "w").unionByName(panel.select(F.col("gj").alias("f"), F.col("gi").alias("g"), "w"))
    top = lambda s, f: cliques.select(F.col("entity").alias(s), F.col("feature").alias(f)).hint("merge")
    j = candidates.select("a", "b").distinct().join(top("a", "f"), "a").join(top("b", "g"), "b")
    return j.join(broadcast_if_small(both), ["f", "g"], "left").groupBy("a", "b").agg(F.avg("w").alias("mean"))


def prune_report(rows: DataFrame, panel: DataFrame, stages: list[str], cell: str) -> DataFrame:
    """Pair statistics of one cell's label under each stage column."""
    long = rows.where(F.col("cell") == cell).select("feature", F.explode(F.array(*(F.struct(F.lit(s).alias("stage"), F.col(s).alias("label")) for s in stages))).alias("r"))
    sets = long.where(F.col("r.label") == cell).select(F.col("r.stage").alias("entity"), "feature").distinct()
    return pair_stats(sets, panel).withColumnRenamed("entity", "stage")


