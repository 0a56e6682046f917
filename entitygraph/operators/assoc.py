"""Association of features over contexts: presence, co-occurrence, PMI and NPMI, evidence, bootstrap, panels.

Tables: observations (cell, feature[, ...]); presence (cell, feature); pairs
(gi, gj, k_ij, k_i, k_j, n) with gi < gj; panels (gi, gj, w) with gi < gj and each
pair once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitygraph.functions import scalars as S
from entitygraph.functions.storage import broadcast_if_small

#: Labels that are no contexts (fixed values).
NO_CONTEXT = ("UNASSIGNED", "-1", "DROP", "nan", "None", "")


# --- filters ------------------------------------------------------------------------------------


def quality_filter(obs: DataFrame, least: float = 30, column: str = "qv", strict: bool = False) -> DataFrame:
    return obs.where(F.col(column) > least if strict else F.col(column) >= least)


def vocabulary_filter(obs: DataFrame, vocabulary: DataFrame, feature: str = "feature") -> DataFrame:
    return obs.join(broadcast_if_small(vocabulary.select(feature).distinct()), feature, "left_semi")


def exclude_contexts(obs: DataFrame, labels: tuple[str, ...] = NO_CONTEXT, cell: str = "cell") -> DataFrame:
    """Without rows whose context is null or one of ``labels``; no labels: all rows."""
    return obs.where(F.col(cell).isNotNull() & ~F.col(cell).isin(*labels)) if labels else obs


def as_flag(column: str, dtype: str) -> Column:
    """A flag from booleans, numbers, or the strings true and 1."""
    c = F.col(column)
    if dtype == "boolean":
        return F.coalesce(c, F.lit(False))
    if dtype == "string":
        return F.coalesce(F.lower(F.trim(c)).isin("true", "1", "1.0"), F.lit(False))
    return F.coalesce(c != 0, F.lit(False))


def nuclear_only(obs: DataFrame, column: str = "nuclear") -> DataFrame:
    return obs.where(as_flag(column, dict(obs.dtypes)[column]))


def context_sizes(obs: DataFrame, cell: str = "cell") -> DataFrame:
    return obs.groupBy(cell).agg(F.count("*").alias("size"))


def size_band_filter(obs: DataFrame, low: float = 0.2, high: float = 0.8, cell: str = "cell") -> DataFrame:
    """Rows of contexts whose size lies within two percentiles (interpolated, inclusive) of all context sizes."""
    sizes = context_sizes(obs, cell)
    band = sizes.agg(F.percentile("size", F.array(F.lit(low), F.lit(high))).alias("p")).select(F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))
    inside = sizes.join(F.broadcast(band), (F.col("size") >= F.col("lo")) & (F.col("size") <= F.col("hi"))).select(cell)
    return obs.join(inside, cell, "left_semi")


def confident_contexts(obs: DataFrame, low: float = 0.2, high: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """All usable rows, and the nuclear rows of contexts of usual size."""
    usable = exclude_contexts(obs)
    return usable, size_band_filter(nuclear_only(usable), low, high)


def roi_box(points: DataFrame, x: tuple[float, float], y: tuple[float, float]) -> DataFrame:
    return points.where(F.col("x").between(*x) & F.col("y").between(*y))


def roi_centred(points: DataFrame, width: float, height: float) -> DataFrame:
    """The box of a given size around the medians."""
    mid = points.agg(F.percentile("x", F.lit(0.5)).alias("mx"), F.percentile("y", F.lit(0.5)).alias("my"))
    return points.join(F.broadcast(mid), F.col("x").between(F.col("mx") - width / 2, F.col("mx") + width / 2) & F.col("y").between(F.col("my") - height / 2, F.col("my") + height / 2)).drop("mx", "my")


def z_section(points: DataFrame, low: float, high: float) -> DataFrame:
    return points.where((F.col("z") >= low) & (F.col("z") < high))


def least_rows(obs: DataFrame, least: int = 10, cell: str = "cell") -> DataFrame:
    """Rows of contexts with ``least`` rows or more."""
    return obs.join(context_sizes(obs, cell).where(F.col("size") >= least).select(cell), cell, "left_semi")


# --- presence and pairs -------------------------------------------------------------------------


def feature_counts(obs: DataFrame, count: str | None = None) -> DataFrame:
    return obs.groupBy("cell", "feature").agg((F.sum(count) if count else F.count("*")).alias("n"))


def presence(obs: DataFrame, least: int = 2, count: str | None = None) -> DataFrame:
    return feature_counts(obs, count).where(F.col("n") >= least).select("cell", "feature")


def universe(present: DataFrame) -> DataFrame:
    """One row: the number of contexts with a present feature."""
    return present.agg(F.countDistinct("cell").alias("n"))


def marginals(present: DataFrame) -> DataFrame:
    return present.groupBy("feature").agg(F.count("*").alias("k"))


def pair_counts(present: DataFrame) -> DataFrame:
    """(gi, gj, k_ij) of pairs observed together, by a self-join within the context and a partially aggregated count."""
    a, b = present.select("cell", F.col("feature").alias("gi")), present.select("cell", F.col("feature").alias("gj"))
    return a.join(b, "cell").where("gi < gj").groupBy("gi", "gj").agg(F.count("*").alias("k_ij"))


def pairs(present: DataFrame, admitted: DataFrame | None = None) -> DataFrame:
    """Observed pairs with their marginals; ``admitted`` restricts presence but not the universe."""
    use = admitted if admitted is not None else present
    k = marginals(use)
    ki, kj = k.select(F.col("feature").alias("gi"), F.col("k").alias("k_i")), k.select(F.col("feature").alias("gj"), F.col("k").alias("k_j"))
    return pair_counts(use).join(broadcast_if_small(ki), "gi").join(broadcast_if_small(kj), "gj").crossJoin(F.broadcast(universe(present))).select("gi", "gj", "k_ij", "k_i", "k_j", "n")


def association(table: DataFrame, alpha: float | None = None) -> DataFrame:
    """PMI, NPMI and conditional probabilities of counted pairs."""
    out = table.withColumns({"pmi": S.pmi("k_ij", "k_i", "k_j", "n"), "npmi": S.npmi("k_ij", "k_i", "k_j", "n"), "p_i_given_j": S.conditional("k_ij", "k_j"), "p_j_given_i": S.conditional("k_ij", "k_i")})
    return out.withColumn("pmi_smoothed", S.smoothed_pmi("k_ij", "k_i", "k_j", "n", alpha)) if alpha is not None else out


def all_pairs(present: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """Every unordered pair of the vocabulary with its counts, unobserved ones with k_ij = 0.

    The pairs of the vocabulary are the result itself, G (G - 1) / 2 rows.
    """
    k = marginals(present)
    left, right = k.select(F.col("feature").alias("gi"), F.col("k").alias("k_i")), k.select(F.col("feature").alias("gj"), F.col("k").alias("k_j"))
    every = left.join(right, F.col("gi") < F.col("gj"))
    return every.join(pair_counts(present), ["gi", "gj"], "left").crossJoin(F.broadcast(contexts if contexts is not None else universe(present))).select("gi", "gj", F.coalesce("k_ij", F.lit(0).cast("long")).alias("k_ij"), "k_i", "k_j", "n")


def dense_table(present: DataFrame, negative_from: float | None = None) -> DataFrame:
    """All ordered pairs of distinct features with probabilities; with ``negative_from``, NPMI of unobserved pairs
    whose marginal probabilities both exceed it is -1."""
    t = all_pairs(present)
    both = t.unionByName(t.select(F.col("gj").alias("gi"), F.col("gi").alias("gj"), "k_ij", F.col("k_j").alias("k_i"), F.col("k_i").alias("k_j"), "n"))
    p = {"p_i": F.col("k_i") / F.col("n"), "p_j": F.col("k_j") / F.col("n"), "p_ij": F.col("k_ij") / F.col("n")}
    out = association(both).withColumns(p)
    if negative_from is not None:
        out = out.withColumn("npmi", F.when((F.col("k_ij") == 0) & (F.col("p_i") > negative_from) & (F.col("p_j") > negative_from), -1.0).otherwise(F.col("npmi")))
    return out


def size_band_admittance(obs: DataFrame, present: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Presence rows whose context size lies within the feature's own percentile band of context sizes."""
    sized = present.join(context_sizes(obs), "cell")
    bands = sized.groupBy("feature").agg(F.percentile("size", F.array(F.lit(low), F.lit(high))).alias("p")).select("feature", F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))
    return sized.join(broadcast_if_small(bands), "feature").where((F.col("size") >= F.col("lo")) & (F.col("size") <= F.col("hi"))).select("cell", "feature")


def zero_pairs(present: DataFrame, least_expected: float = 10, set_negative: bool = True, contexts: DataFrame | None = None) -> DataFrame:
    """Unobserved pairs with their expected count and kind: ``neg_one`` or ``indeterminate``.

    ``contexts`` is one row, the number of contexts, by default those of ``present``.
    """
    t = all_pairs(present, contexts).where("k_ij = 0").withColumn("expected", F.col("k_i").cast("double") * F.col("k_j") / F.col("n"))
    return t.select("gi", "gj", "expected", F.when((F.col("expected") >= least_expected) & F.lit(set_negative), "neg_one").otherwise("indeterminate").alias("kind"))


def evidence_tiers(table: DataFrame, evidence: float = 10, subsample: float | None = None, evidence_boot: float | None = None) -> DataFrame:
    """The evidence class of observed pairs: ``bootstrap``, ``legacy_only`` or ``low_evidence``.

    ``subsample`` is the number of contexts of a bootstrap draw; null: all of them.
    """
    expected = F.col("k_i").cast("double") * F.col("k_j") / F.col("n")
    most = F.greatest(F.col("k_ij").cast("double"), expected)
    share = F.lit(1.0) if subsample is None else F.lit(float(subsample)) / F.col("n")
    high = most >= evidence
    enough = most * share >= (evidence_boot if evidence_boot is not None else evidence)
    return table.withColumns({"expected": expected, "tier": F.when(high & enough, "bootstrap").when(high, "legacy_only").otherwise("low_evidence")})


# --- bootstrap ----------------------------------------------------------------------------------

#: Kinds that settle early, and kinds whose pairs enter the panel.
EARLY = ("pos_strong", "neg_strong", "tight_null")
SIGNED = ("pos_strong", "pos_weak", "neg_strong", "neg_weak")
LEAST_DRAWS = 30


def final_kind(lo: float, hi: float, low: float, high: float) -> str:
    """The class of an interval after the budget, tried in order."""
    for name, holds in (("pos_strong", lo > high), ("pos_weak", lo > low), ("neg_strong", hi < -high), ("neg_weak", hi < -low), ("tight_null", lo > -low and hi < low), ("dead_zone", lo > -high and hi < high)):
        if holds:
            return name
    return "unsettled"


def bootstrap(table: DataFrame, tau: float | tuple[float, float] = 0.05, ci: float = 0.95, budget: int = 10_000, coarse: int = 200, refine: int = 500, metric: str = "npmi", seed: int = 0, alpha: float = 0.1, subsample: int | None = None, least_draws: int = LEAST_DRAWS) -> DataFrame:
    """Intervals and kinds of observed pairs by drawing their four-cell tables.

    Resampling contexts gives the four counts of a pair (both, only i, only j, neither)
    a multinomial law, so each pair is drawn on its own, seeded by its names: results do
    not depend on partitions, and nothing is shuffled.  A pair stops drawing when its
    interval settles as strong or as a tight null.  A draw takes ``subsample`` contexts (by
    default as many as there are); ``alpha`` is added to the counts and twice to their total, so
    that draws without the pair count too.
    """
    low, high = (tau, tau) if isinstance(tau, (int, float)) else tau
    tail = 100 * (1 - ci) / 2

    def values(counts: np.ndarray, n: int) -> np.ndarray:
        both, i, j = counts[:, 0] + alpha, counts[:, 0] + counts[:, 1] + alpha, counts[:, 0] + counts[:, 2] + alpha
        total = n + 2 * alpha
        with np.errstate(divide="ignore", invalid="ignore"):
            v = np.log(both * total / (i * j))
            if metric == "npmi":
                v = v / -np.log(both / total)
        return v[np.isfinite(v)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for gi, gj, k, ki, kj, n in frame[["gi", "gj", "k_ij", "k_i", "k_j", "n"]].itertuples(index=False):
                names = f"{gi}\x00{gj}".encode()
                rng = np.random.default_rng([seed, *np.frombuffer(names, np.uint8)])
                p = np.array([k, ki - k, kj - k, n - ki - kj + k], float) / n
                seen, drawn, lo, hi, kind = np.zeros(0), 0, np.nan, np.nan, "unsettled"
                while drawn < budget:
                    block = min(coarse if drawn == 0 else refine, budget - drawn)
                    drawn += block
                    size = subsample or n
                    seen = np.concatenate([seen, values(rng.multinomial(size, p, block), size)])
                    if len(seen) < least_draws:
                        continue
                    lo, hi = np.percentile(seen, [tail, 100 - tail])
                    kind = final_kind(lo, hi, low, high)
                    if kind in EARLY:
                        break
                out.append((gi, gj, k, ki, kj, n, float(np.median(seen)) if len(seen) else np.nan, lo, hi, drawn, kind))
            yield pd.DataFrame(out, columns=["gi", "gj", "k_ij", "k_i", "k_j", "n", "median", "ci_lo", "ci_hi", "n_draws", "kind"])

    schema = "gi string, gj string, k_ij bigint, k_i bigint, k_j bigint, n bigint, median double, ci_lo double, ci_hi double, n_draws int, kind string"
    return table.select("gi", "gj", "k_ij", "k_i", "k_j", "n").mapInPandas(run, schema)


def single_tau_kind(kind: Column | str) -> Column:
    """The four classes that a single threshold reports."""
    k = F.col(kind) if isinstance(kind, str) else kind
    return F.when(k.startswith("pos"), "pos").when(k.startswith("neg"), "neg").when(k.isin("tight_null", "dead_zone"), "dead_zone").otherwise("unsettled")


def usable_contexts(obs: DataFrame, excluded: tuple[str, ...] = NO_CONTEXT, nuclear: bool = False, nuclear_column: str = "nuclear", sizes: tuple[float, float] | None = None) -> DataFrame:
    """Observations that association may use: no excluded contexts, nuclear rows only if asked for, contexts of usual size."""
    out = exclude_contexts(obs, excluded)
    out = nuclear_only(out, nuclear_column) if nuclear else out
    return size_band_filter(out, *sizes) if sizes else out


def pmi_bootstrap(obs: DataFrame, metric: str = "npmi", least: int = 2, evidence: float = 10, least_expected: float | None = None, evidence_boot: float | None = None, bands: tuple[float, float] | None = None, subsample: int | None = None, set_negative: bool = True, excluded: tuple[str, ...] = NO_CONTEXT, nuclear: bool = False, sizes: tuple[float, float] | None = None, **draws) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The panel with population values, all pairs with intervals and kinds, and a row of diagnostics.

    Labels that are no contexts are left out first, then rows outside nuclei (``nuclear``),
    then contexts of unusual size (``sizes``); ``bands`` admits each feature in contexts of its usual sizes.
    """
    obs = usable_contexts(obs, excluded, nuclear, sizes=sizes)
    present = presence(obs, least)
    admitted = size_band_admittance(obs, present, *bands) if bands else None
    table = evidence_tiers(pairs(present, admitted), evidence, subsample, evidence_boot)
    drawn = bootstrap(table.where("tier = 'bootstrap'"), metric=metric, subsample=subsample, **draws).select("gi", "gj", "median", "ci_lo", "ci_hi", "n_draws", "kind")
    full = association(table).join(drawn, ["gi", "gj"], "left").withColumn("kind", F.coalesce("kind", "tier"))
    zero = zero_pairs(admitted if admitted is not None else present, evidence if least_expected is None else least_expected, set_negative, universe(present))
    sentinel = F.lit(-1.0) if metric == "npmi" else -F.ln("expected")
    panel = full.where(F.col("kind").isin(*SIGNED, "legacy_only")).select("gi", "gj", F.col(metric).alias("w"))
    panel = panel.unionByName(zero.where("kind = 'neg_one'").select("gi", "gj", sentinel.alias("w")))
    kinds = full.select("kind").unionByName(zero.select("kind"))
    return panel, full, kinds.groupBy("kind").agg(F.count("*").alias("n_pairs"))


def filter_drops(obs: DataFrame, excluded: tuple[str, ...] = NO_CONTEXT, nuclear: bool = False, nuclear_column: str = "nuclear", sizes: tuple[float, float] | None = None, cell: str = "cell") -> DataFrame:
    """One row: how many rows :func:`usable_contexts` reads, drops at each step, and keeps; from one aggregate by context."""
    flag = as_flag(nuclear_column, dict(obs.dtypes)[nuclear_column]) if nuclear else F.lit(True)
    per = obs.groupBy(F.col(cell).alias("cell")).agg(F.count("*").alias("rows"), F.sum(flag.cast("int")).alias("size"))
    named = F.col("cell").isNotNull() & ~F.col("cell").isin(*excluded) if excluded else F.lit(True)
    per = per.withColumn("named", F.coalesce(named, F.lit(False)))
    live = F.when(F.col("named") & (F.col("size") > 0), F.col("size"))
    low, high = sizes or (0.0, 1.0)
    band = per.agg(F.percentile(live, F.array(F.lit(low), F.lit(high))).alias("p"))
    inside = F.lit(True) if sizes is None else F.col("size").between(F.col("p")[0], F.col("p")[1])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    of = lambda c, v: F.when(c, v).otherwise(0)
    return per.crossJoin(F.broadcast(band)).agg(
        total("rows").alias("n_input_rows"),
        total(of(~F.col("named"), F.col("rows"))).alias("n_dropped_excluded"),
        total(of(F.col("named"), F.col("rows") - F.col("size"))).alias("n_dropped_nuclear"),
        total(of(F.col("named") & ~inside, F.col("size"))).alias("n_dropped_percentile"),
        total(of(F.col("named") & inside, F.col("size"))).alias("n_kept_rows"),
    )


def bootstrap_diagnostics(full: DataFrame, kinds: DataFrame, drops: DataFrame, metric: str = "npmi", tau: float | tuple[float, float] = 0.05, evidence: float = 10, refine: int = 500, subsample: int | None = None) -> DataFrame:
    """One row that tells of a bootstrap: pairs of every kind and of kinds together, when pairs settled, its settings, and the rows dropped before.

    ``full`` and ``kinds`` are the pairs and the numbers of kinds of :func:`pmi_bootstrap`, ``drops`` is that of
    :func:`filter_drops`.  ``settled_at_hist`` counts settled pairs by their draws, in buckets of ``refine``.
    """
    low, high = (tau, tau) if isinstance(tau, (int, float)) else tau
    number = lambda *names: F.coalesce(F.sum(F.when(F.col("kind").isin(*names), F.col("n_pairs"))), F.lit(0)).cast("long")
    single = {f"n_{k}": (k,) for k in ("neg_one", "indeterminate", "low_evidence", "legacy_only", "pos_strong", "pos_weak", "neg_strong", "neg_weak", "tight_null", "unsettled")}
    joint = {"n_dead_zone_only": ("dead_zone",), "n_dead_zone": ("tight_null", "dead_zone"), "n_pos": ("pos_strong", "pos_weak"), "n_neg": ("neg_strong", "neg_weak")}
    counted = kinds.agg(*(number(*v).alias(k) for k, v in {**single, **joint}.items()))
    drawn = full.where(F.col("n_draws").isNotNull()).groupBy("n_draws", (F.col("kind") != "unsettled").alias("settled")).agg(F.count("*").alias("c"))
    most = drawn.agg(F.coalesce(F.max("n_draws"), F.lit(0)).cast("long").alias("total_bootstraps_run"))
    # The last bucket holds its upper end too.
    last = F.ceil((F.col("total_bootstraps_run") + refine) / refine) - 2
    bucket = (F.least(F.floor(F.col("n_draws") / refine), last) + 1) * refine
    settled = drawn.where("settled").crossJoin(F.broadcast(most)).groupBy(F.concat(F.lit("<="), bucket.cast("string")).alias("b")).agg(F.sum("c").alias("c"))
    hist = settled.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("b", "c")))).alias("settled_at_hist"))
    size = F.lit(subsample).cast("long").alias("subsample_size")
    settings = [size, F.lit(float(evidence)).alias("min_expected_cooccur_for_evidence"), F.lit(metric).alias("metric"), F.lit(float(low)).alias("tau_low"), F.lit(float(high)).alias("tau_high"), F.lit(low != high).alias("is_dual_tau")]
    return counted.crossJoin(most).crossJoin(hist).crossJoin(drops).select("*", *settings)


# --- panels -------------------------------------------------------------------------------------


def normalize_panel(raw: DataFrame, i: str = "gene_i", j: str = "gene_j", value: str | None = None) -> DataFrame:
    """(gi, gj, w), gi < gj, without nulls, NaN and self pairs; a pair given twice is an error.

    The value column is ``value`` or the first of value, NPMI, PMI, weight, w that there is.
    """
    value = value or next(c for c in ("value", "NPMI", "PMI", "weight", "w") if c in raw.columns)
    v = F.col(value).cast("double")
    out = raw.where(v.isNotNull() & ~F.isnan(v) & (F.col(i) != F.col(j))).select(F.least(i, j).alias("gi"), F.greatest(i, j).alias("gj"), v.alias("w"))
    once = out.groupBy("gi", "gj").agg(F.count("*").alias("c"), F.min("w").alias("w"))
    return once.select("gi", "gj", F.when(F.col("c") > 1, F.raise_error(F.concat(F.lit("pair given twice: "), "gi", F.lit(" "), "gj")).cast("double")).otherwise(F.col("w")).alias("w"))


def symmetric(panel: DataFrame) -> DataFrame:
    """Both directions of every pair as (a, b, w); stored zeros stay."""
    return panel.select(F.col("gi").alias("a"), F.col("gj").alias("b"), "w").unionByName(panel.select(F.col("gj").alias("a"), F.col("gi").alias("b"), "w"))


def centred_panel(associated: DataFrame, value: str = "pmi", digits: int = 6) -> DataFrame:
    """(gi, gj, w): the values of a counted table less their median, so that both signs occur."""
    mid = associated.agg(F.percentile(value, F.lit(0.5)).alias("mid"))
    return associated.crossJoin(F.broadcast(mid)).select("gi", "gj", F.round(F.col(value) - F.col("mid"), digits).alias("w"))


def rankings(table: DataFrame, min_support: int = 5, npmi_above: float = -0.1) -> DataFrame:
    """NPMI (null as -1) and the smaller conditional; score NPMI^3 cond^2, 0 where support or NPMI is too low."""
    out = table.withColumns({"npmi": F.coalesce("npmi", F.lit(-1.0)), "cond_prob": F.least("p_i_given_j", "p_j_given_i")})
    low = (F.col("k_ij") < min_support) | (F.col("npmi") <= npmi_above)
    return out.withColumns({"dropped": low, "score": F.when(low, 0.0).otherwise(F.pow("npmi", F.lit(3)) * F.pow("cond_prob", F.lit(2)))})


def gene_thresholds(ranked: DataFrame, top: int = 10, npmi_range: tuple[float, float] = (0.0, 0.5), cond_range: tuple[float, float] = (0.0, 0.5)) -> DataFrame:
    """(gi, npmi_thresh, cond_thresh): each feature's value at rank ``top`` (from 0, else its last), clipped."""

    def at_rank(value: str, bounds: tuple[float, float]) -> Column:
        values = F.sort_array(F.collect_list(value), asc=False)
        return F.least(F.greatest(F.element_at(values, F.least(F.lit(top + 1), F.size(values))), F.lit(bounds[0])), F.lit(bounds[1]))

    return ranked.where("not dropped").groupBy("gi").agg(at_rank("npmi", npmi_range).alias("npmi_thresh"), at_rank("cond_prob", cond_range).alias("cond_thresh"))


def reclip(thresholds: DataFrame, npmi_range: tuple[float, float] = (0.01, 0.2), cond_range: tuple[float, float] = (0.001, 0.2)) -> DataFrame:
    """(gi, npmi_thresh, cond_thresh) within the ranges that pruning looks them up in; nulls stay, repeated features count once."""
    bound = lambda c, ends: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(ends[0])), F.lit(ends[1]))).alias(c)
    return thresholds.select("gi", bound("npmi_thresh", npmi_range), bound("cond_thresh", cond_range)).dropDuplicates(["gi"])


def housekeeping(panel: DataFrame, tau: float, least: int = 5) -> DataFrame:
    """(feature, n_pos, n_neg, keep): a feature stays with enough neighbours above tau or below -tau."""
    both = symmetric(panel).where("w <> 0")
    counts = both.groupBy(F.col("a").alias("feature")).agg(F.coalesce(F.sum(F.when(F.col("w") > tau, 1)), F.lit(0)).alias("n_pos"), F.coalesce(F.sum(F.when(F.col("w") < -tau, 1)), F.lit(0)).alias("n_neg"))
    return counts.withColumn("keep", (F.col("n_pos") >= least) | (F.col("n_neg") >= least))


def negative_set(panel: DataFrame, tau: float) -> DataFrame:
    """(a, b) of pairs at or below tau, both directions."""
    return symmetric(panel).where(F.col("w") <= tau).select("a", "b")


def count_matrix(obs: DataFrame, cell: str = "cell") -> tuple[DataFrame, DataFrame]:
    """The sparse count matrix in long form, and per context its rows and features."""
    x = obs.groupBy(cell, "feature").agg(F.count("*").alias("n"))
    return x, x.groupBy(cell).agg(F.sum("n").alias("n_points"), F.count("*").alias("n_features"))


def panel_presence(present: DataFrame, panel: DataFrame) -> DataFrame:
    """The binary matrix in long form over the panel's vocabulary only."""
    vocabulary = symmetric(panel).select(F.col("a").alias("feature")).distinct()
    return present.join(broadcast_if_small(vocabulary), "feature", "left_semi").select("cell", "feature").distinct()
