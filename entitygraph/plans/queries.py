"""Registered queries over the driver tables and their DuckDB SQL.

Every entry applies library operators to whole tables; doubles are rounded to six
digits, counts are long and arrays are joined, so that both engines return equal values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entitygraph.functions import labels as L
from entitygraph.functions import scalars as S
from entitygraph.functions.storage import read_table, settle
from entitygraph.operators import assoc, compare, cuts, entity, footprints, graph, grid, kernels, permutation, spatial_join, stages, tiling
from entitygraph.plans import pipeline
from entitygraph.sources import adapters
from entitygraph.streaming import cooccurrence

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TAU, SIGNAL, NEGATIVE = 0.02, 0.005, -0.05


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def rnd(c: Column | str, name: str) -> Column:
    """Rounded to six digits; the small addend keeps exact ties from rounding differently in two engines."""
    return (F.round((F.col(c) if isinstance(c, str) else c) + F.lit(1e-9), 6) + F.lit(0.0)).alias(name)


def lng(c: Column | str, name: str | None = None) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long").alias(name or c)


def r(e: str) -> str:
    return f"(round({e} + 1e-9, 6) + 0.0)"


# --- shared inputs and their SQL ------------------------------------------------------------------

POINTS = """pts AS (SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
    l_extendedprice, l_discount, l_linestatus, l_returnflag) AS id, CAST(o_custkey AS VARCHAR) AS cell, p_brand AS feature, l_quantity AS x,
    l_extendedprice / 2000 AS y, l_discount * 100 + 0.0 AS z, l_linestatus = 'F' AS nuclear,
    CASE WHEN l_returnflag = 'N' THEN '-1' ELSE CAST(o_custkey AS VARCHAR) END AS label
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
NAMES = "obs AS (SELECT CAST(l_orderkey AS VARCHAR) AS cell, p_name AS feature FROM lineitem JOIN part ON l_partkey = p_partkey)"
EMB = """emb AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS label, round(CAST(embedding[1] AS DOUBLE) * 20, 6) AS x,
    round(CAST(embedding[2] AS DOUBLE) * 20, 6) AS y, round(CAST(embedding[3] AS DOUBLE) * 20, 6) AS z FROM embeddings)"""
PRES = "pres AS (SELECT cell, feature FROM pts GROUP BY 1, 2 HAVING count(*) >= 2)"
PAIRS = """m AS (SELECT feature, count(*) AS k FROM pres GROUP BY 1), u AS (SELECT count(DISTINCT cell) AS n FROM pres),
  co AS (SELECT a.feature AS gi, b.feature AS gj, count(*) AS k_ij FROM pres a JOIN pres b ON a.cell = b.cell AND a.feature < b.feature GROUP BY 1, 2),
  prs AS (SELECT gi, gj, k_ij, mi.k AS k_i, mj.k AS k_j, n FROM co JOIN m mi ON gi = mi.feature JOIN m mj ON gj = mj.feature CROSS JOIN u)"""
PMI = "ln((CAST(k_ij AS DOUBLE) / n) / ((CAST(k_i AS DOUBLE) / n) * (CAST(k_j AS DOUBLE) / n)))"
NPMI = f"({PMI} / -ln(CAST(k_ij AS DOUBLE) / n))"
PANEL = f"""asc_ AS (SELECT *, {PMI} AS pmi FROM prs), mid AS (SELECT quantile_cont(pmi, 0.5) AS mid FROM asc_),
  panel AS (SELECT gi, gj, round(pmi - mid, 6) AS w FROM asc_, mid),
  both_ AS (SELECT gi AS a, gj AS b, w FROM panel UNION ALL SELECT gj, gi, w FROM panel)"""
SCORED = f"WITH {POINTS}, {PRES}, {PAIRS}, {PANEL}"
SETS = "sets AS (SELECT DISTINCT cell AS entity, feature FROM pts)"
SP = "sp AS (SELECT a.entity, a.feature AS gi, b.feature AS gj, w FROM sets a JOIN sets b ON a.entity = b.entity AND a.feature < b.feature LEFT JOIN panel p ON p.gi = a.feature AND p.gj = b.feature)"
OFF9 = "off9 AS (SELECT dx, dy FROM (VALUES (-1), (0), (1)) s(dx), (VALUES (-1), (0), (1)) t(dy))"


def _points(spark: SparkSession, d: str) -> DataFrame:
    return adapters.points(spark, d)


def _panel(spark: SparkSession, d: str) -> DataFrame:
    """The panel of all points; what is present is written once, as pairs and marginals are counted from it several times."""
    present = settle(assoc.presence(_points(spark, d)), "presence")
    return settle(assoc.centred_panel(assoc.association(assoc.pairs(present))), "panel")


def _sets(spark: SparkSession, d: str) -> DataFrame:
    return entity.features_of(_points(spark, d), "cell")


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Points whose entity is the prior cell, or -1 where the line was returned as N."""
    return _points(spark, d).withColumns({"entity": F.col("label"), "etype": L.etype_of_label("label")})


# --- association ----------------------------------------------------------------------------------


@register("pair_pmi", f"WITH {POINTS}, {PRES}, {PAIRS} SELECT gi, gj, k_ij, k_i, k_j, {r(PMI)} AS pmi FROM prs")
def pair_pmi(spark, d):
    t = assoc.association(assoc.pairs(assoc.presence(_points(spark, d))))
    return t.select("gi", "gj", "k_ij", "k_i", "k_j", rnd("pmi", "pmi"))


@register("pair_npmi", f"WITH {NAMES}, pres AS (SELECT DISTINCT cell, feature FROM obs), {PAIRS} SELECT gi, gj, k_ij, {r(PMI)} AS pmi, {r(NPMI)} AS npmi FROM prs")
def pair_npmi(spark, d):
    t = assoc.association(assoc.pairs(assoc.presence(adapters.order_names(spark, d), 1)))
    return t.select("gi", "gj", "k_ij", rnd("pmi", "pmi"), rnd("npmi", "npmi"))


@register(
    "pair_cond_prob",
    f"""WITH {POINTS}, {PRES}, {PAIRS}, al AS (SELECT a.feature AS gi, b.feature AS gj, coalesce(k_ij, 0) AS k_ij, a.k AS k_i, b.k AS k_j, u.n FROM m a JOIN m b ON a.feature < b.feature
    CROSS JOIN u LEFT JOIN co ON co.gi = a.feature AND co.gj = b.feature), dir AS (SELECT * FROM al UNION ALL SELECT gj, gi, k_ij, k_j, k_i, n FROM al)
    SELECT gi, gj, {r("k_i / n")} AS p_i, {r("k_j / n")} AS p_j, {r("k_ij / n")} AS p_ij, {r("k_ij / k_j")} AS p_i_given_j, {r("k_ij / k_i")} AS p_j_given_i FROM dir""",
)
def pair_cond_prob(spark, d):
    t = assoc.dense_table(assoc.presence(_points(spark, d)), 0.5)
    return t.select("gi", "gj", *(rnd(c, c) for c in ("p_i", "p_j", "p_ij", "p_i_given_j", "p_j_given_i")))


@register("pmi_smoothed", f"WITH {POINTS}, {PRES}, {PAIRS} SELECT gi, gj, {r('ln(((k_ij + 0.5) / (n + 1.0)) / (((k_i + 0.5) / (n + 1.0)) * ((k_j + 0.5) / (n + 1.0))))')} AS pmi_smoothed FROM prs")
def pmi_smoothed(spark, d):
    return assoc.association(assoc.pairs(assoc.presence(_points(spark, d))), 0.5).select("gi", "gj", rnd("pmi_smoothed", "pmi_smoothed"))


@register("presence_counts", f"WITH {POINTS} SELECT cell, feature, count(*) AS n, count(*) >= 2 AS present FROM pts GROUP BY 1, 2")
def presence_counts(spark, d):
    return assoc.feature_counts(_points(spark, d)).withColumn("present", F.col("n") >= 2)


@register("gene_marginals", f"WITH {POINTS}, {PRES} SELECT feature, count(*) AS k, (SELECT count(DISTINCT cell) FROM pres) AS n FROM pres GROUP BY 1")
def gene_marginals(spark, d):
    p = assoc.presence(_points(spark, d))
    return assoc.marginals(p).crossJoin(F.broadcast(assoc.universe(p)))


@register(
    "neg_one_pairs",
    f"""WITH {NAMES}, pres AS (SELECT cell, feature FROM obs GROUP BY 1, 2 HAVING count(*) >= 2), {PAIRS}
    SELECT a.feature AS gi, b.feature AS gj, {r("CAST(a.k AS DOUBLE) * b.k / n")} AS expected, CASE WHEN CAST(a.k AS DOUBLE) * b.k / n >= 0.4 THEN 'neg_one' ELSE 'indeterminate' END AS kind
    FROM m a JOIN m b ON a.feature < b.feature CROSS JOIN u LEFT JOIN co ON co.gi = a.feature AND co.gj = b.feature WHERE k_ij IS NULL""",
)
def neg_one_pairs(spark, d):
    return assoc.zero_pairs(assoc.presence(adapters.order_names(spark, d), 2), 0.4).select("gi", "gj", rnd("expected", "expected"), "kind")


@register(
    "evidence_tiers",
    f"""WITH {NAMES}, pres AS (SELECT DISTINCT cell, feature FROM obs), {PAIRS}, e AS (SELECT *, CAST(k_i AS DOUBLE) * k_j / n AS e FROM prs)
    SELECT gi, gj, {r("e")} AS expected, CASE WHEN greatest(k_ij, e) >= 50 AND greatest(k_ij, e) * (10000.0 / n) >= 40 THEN 'bootstrap' WHEN greatest(k_ij, e) >= 50 THEN 'legacy_only' ELSE 'low_evidence' END AS tier FROM e""",
)
def evidence_tiers(spark, d):
    t = assoc.evidence_tiers(assoc.pairs(assoc.presence(adapters.order_names(spark, d), 1)), 50, 10000, 40)
    return t.select("gi", "gj", rnd("expected", "expected"), "tier")


@register(
    "size_band_admittance",
    f"""WITH {POINTS}, {PRES}, s AS (SELECT cell, count(*) AS size FROM pts GROUP BY 1), x AS (SELECT * FROM pres JOIN s USING (cell)),
    b AS (SELECT feature, quantile_cont(size, 0.05) AS lo, quantile_cont(size, 0.95) AS hi FROM x GROUP BY 1) SELECT x.cell, x.feature FROM x JOIN b USING (feature) WHERE size BETWEEN lo AND hi""",
)
def size_band_admittance(spark, d):
    p = _points(spark, d)
    return assoc.size_band_admittance(p, assoc.presence(p))


@register(
    "context_percentile_filter",
    f"WITH {POINTS}, s AS (SELECT cell, count(*) AS size FROM pts GROUP BY 1), b AS (SELECT quantile_cont(size, 0.2) AS lo, quantile_cont(size, 0.8) AS hi FROM s) SELECT cell, size FROM s, b WHERE size BETWEEN lo AND hi",
)
def context_percentile_filter(spark, d):
    return assoc.context_sizes(assoc.size_band_filter(_points(spark, d)))


@register(
    "confident_contexts",
    f"""WITH {POINTS}, nu AS (SELECT * FROM pts WHERE nuclear), s AS (SELECT cell, count(*) AS size FROM nu GROUP BY 1), b AS (SELECT quantile_cont(size, 0.2) AS lo, quantile_cont(size, 0.8) AS hi FROM s)
    SELECT cell, feature, count(*) AS n FROM nu JOIN s USING (cell), b WHERE size BETWEEN lo AND hi GROUP BY 1, 2""",
)
def confident_contexts(spark, d):
    return assoc.feature_counts(assoc.confident_contexts(_points(spark, d))[1])


@register("least_rows", f"WITH {POINTS} SELECT cell, count(*) AS size FROM pts GROUP BY 1 HAVING count(*) >= 40")
def least_rows(spark, d):
    return assoc.context_sizes(assoc.least_rows(_points(spark, d), 40))


@register(
    "housekeeping_mask",
    f"""{SCORED}, h AS (SELECT a AS feature, count(*) FILTER (w > {TAU}) AS n_pos, count(*) FILTER (w < -{TAU}) AS n_neg FROM both_ WHERE w <> 0 GROUP BY 1)
    SELECT feature, n_pos, n_neg, n_pos >= 5 OR n_neg >= 5 AS keep FROM h""",
)
def housekeeping_mask(spark, d):
    return assoc.housekeeping(_panel(spark, d), TAU).select("feature", lng("n_pos"), lng("n_neg"), "keep")


RANKED = f"""rk AS (SELECT gi, gj, k_ij, {NPMI} AS npmi, least(k_ij / k_j, k_ij / k_i) AS cond_prob FROM prs),
  ranked AS (SELECT *, k_ij < 5 OR npmi <= -0.1 AS dropped, CASE WHEN k_ij < 5 OR npmi <= -0.1 THEN 0.0 ELSE pow(npmi, 3) * pow(cond_prob, 2) END AS score FROM rk)"""


def _ranked(spark, d):
    return assoc.rankings(assoc.association(assoc.pairs(assoc.presence(_points(spark, d)))))


@register("pair_rankings", f"WITH {POINTS}, {PRES}, {PAIRS}, {RANKED} SELECT gi, gj, {r('npmi')} AS npmi, {r('cond_prob')} AS cond_prob, dropped, {r('score')} AS score FROM ranked")
def pair_rankings(spark, d):
    return _ranked(spark, d).select("gi", "gj", rnd("npmi", "npmi"), rnd("cond_prob", "cond_prob"), "dropped", rnd("score", "score"))


THRESH = """th AS (SELECT gi, least(greatest(list_sort(list(npmi), 'DESC')[least(4, count(*))], 0.0), 0.5) AS npmi_thresh,
    least(greatest(list_sort(list(cond_prob), 'DESC')[least(4, count(*))], 0.0), 0.5) AS cond_thresh FROM ranked WHERE NOT dropped GROUP BY 1)"""


@register("gene_thresholds", f"WITH {POINTS}, {PRES}, {PAIRS}, {RANKED}, {THRESH} SELECT gi, {r('npmi_thresh')} AS npmi_thresh, {r('cond_thresh')} AS cond_thresh FROM th")
def gene_thresholds(spark, d):
    return assoc.gene_thresholds(_ranked(spark, d), 3).select("gi", rnd("npmi_thresh", "npmi_thresh"), rnd("cond_thresh", "cond_thresh"))


@register("count_matrix", f"WITH {POINTS}, x AS (SELECT cell, feature, count(*) AS n FROM pts GROUP BY 1, 2) SELECT cell, feature, n, CAST(sum(n) OVER p AS BIGINT) AS n_points, count(*) OVER p AS n_features FROM x WINDOW p AS (PARTITION BY cell)")
def count_matrix(spark, d):
    x, obs = assoc.count_matrix(_points(spark, d))
    return x.join(obs, "cell").select("cell", "feature", "n", "n_points", "n_features")


@register("negative_set", f"{SCORED} SELECT a, b FROM both_ WHERE w <= {-TAU}")
def negative_set(spark, d):
    return assoc.negative_set(_panel(spark, d), -TAU)


@register("symmetric_panel", f"{SCORED} SELECT a, b, w + 0.0 AS w FROM both_")
def symmetric_panel(spark, d):
    raw = _panel(spark, d).select(F.col("gj").alias("gene_i"), F.col("gi").alias("gene_j"), "w")
    return assoc.symmetric(assoc.normalize_panel(raw)).select("a", "b", rnd("w", "w"))


@register("exclude_contexts", f"WITH {POINTS} SELECT feature, count(*) AS n FROM pts WHERE label NOT IN ('UNASSIGNED', '-1', 'DROP', 'nan', 'None', '') GROUP BY 1")
def exclude_contexts(spark, d):
    return assoc.exclude_contexts(_points(spark, d), cell="label").groupBy("feature").agg(F.count("*").alias("n"))


@register("panel_presence", f"{SCORED}, v AS (SELECT DISTINCT a FROM both_ WHERE w > {TAU}) SELECT cell, feature FROM pres JOIN v ON a = feature")
def panel_presence(spark, d):
    p = _panel(spark, d).where(F.col("w") > TAU)
    return assoc.panel_presence(assoc.presence(_points(spark, d)), p)


@register("bootstrap_ci")
def bootstrap_ci(spark, d):
    t = assoc.pairs(assoc.presence(_points(spark, d)))
    return assoc.bootstrap(t, 0.05)


@register("pmi_panel")
def pmi_panel(spark, d):
    return assoc.pmi_bootstrap(_points(spark, d))[0]


@register(
    "bootstrap_diagnostics",
    f"""WITH {POINTS}, l AS (SELECT label AS cell, feature, nuclear FROM pts), u AS (SELECT cell, feature FROM l WHERE cell <> '-1' AND nuclear), sz AS (SELECT cell, count(*) AS s FROM u GROUP BY 1),
    kp AS (SELECT cell, feature FROM u JOIN sz USING (cell) WHERE s BETWEEN (SELECT quantile_cont(s, 0.2) FROM sz) AND (SELECT quantile_cont(s, 0.8) FROM sz)), pres AS (SELECT cell, feature FROM kp GROUP BY 1, 2 HAVING count(*) >= 2),
    m AS (SELECT feature, count(*) AS k FROM pres GROUP BY 1), n AS (SELECT count(DISTINCT cell) AS n FROM pres), co AS (SELECT a.feature AS gi, b.feature AS gj, count(*) AS c FROM pres a JOIN pres b ON a.cell = b.cell AND a.feature < b.feature GROUP BY 1, 2),
    e AS (SELECT coalesce(c, 0) AS k, CAST(a.k AS DOUBLE) * b.k / n AS x FROM m a JOIN m b ON a.feature < b.feature CROSS JOIN n LEFT JOIN co ON gi = a.feature AND gj = b.feature)
    SELECT count(*) FILTER (k = 0 AND x >= 10) AS n_neg_one, count(*) FILTER (k = 0 AND x < 10) AS n_indeterminate, count(*) FILTER (k > 0 AND greatest(k, x) < 10) AS n_low_evidence, count(*) FILTER (k > 0 AND greatest(k, x) >= 10) AS n_drawn, 0 AS n_legacy_only,
      (SELECT count(*) FROM l) AS n_input_rows, (SELECT count(*) FROM l WHERE cell = '-1') AS n_dropped_excluded, (SELECT count(*) FROM l WHERE cell <> '-1' AND NOT nuclear) AS n_dropped_nuclear,
      (SELECT count(*) FROM u) - (SELECT count(*) FROM kp) AS n_dropped_percentile, (SELECT count(*) FROM kp) AS n_kept_rows FROM e""",
)
def bootstrap_diagnostics(spark, d):
    """What does not hang on draws, over nuclear lines of customers of usual size."""
    obs = _points(spark, d).withColumn("cell", F.col("label"))
    _, full, kinds = assoc.pmi_bootstrap(obs, nuclear=True, sizes=(0.2, 0.8))
    found = assoc.bootstrap_diagnostics(settle(full, "full", compact=True), settle(kinds, "kinds", compact=True), assoc.filter_drops(obs, nuclear=True, sizes=(0.2, 0.8)))
    drawn = F.col("n_pos") + F.col("n_neg") + F.col("n_dead_zone") + F.col("n_unsettled")
    names = ["n_neg_one", "n_indeterminate", "n_low_evidence", "n_legacy_only", "n_input_rows", "n_dropped_excluded", "n_dropped_nuclear", "n_dropped_percentile", "n_kept_rows"]
    return found.select(drawn.cast("long").alias("n_drawn"), *(lng(c) for c in names))


# --- filters, labels, bins -------------------------------------------------------------------------


@register("roi_box", f"WITH {POINTS} SELECT id, x, {r('y')} AS y FROM pts WHERE x BETWEEN 10 AND 20 AND y BETWEEN 5 AND 15")
def roi_box(spark, d):
    return assoc.roi_box(_points(spark, d), (10, 20), (5, 15)).select("id", "x", rnd("y", "y"))


@register("roi_centred", f"WITH {POINTS}, c AS (SELECT quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my FROM pts) SELECT id FROM pts, c WHERE x BETWEEN mx - 5.25 AND mx + 5.25 AND y BETWEEN my - 4.125 AND my + 4.125")
def roi_centred(spark, d):
    return assoc.roi_centred(_points(spark, d), 10.5, 8.25).select("id")


@register("z_section", f"WITH {POINTS} SELECT cell, count(*) AS n FROM pts WHERE z >= 2.5 AND z < 7.5 GROUP BY 1")
def z_section(spark, d):
    return assoc.z_section(_points(spark, d), 2.5, 7.5).groupBy("cell").agg(F.count("*").alias("n"))


@register("degrade_grid", f"WITH {POINTS} SELECT id, 'BIN_' || CAST(floor(x / 4.0) AS INT) || '_' || CAST(floor(y / 4.0) AS INT) AS bin_id, (floor(x / 4.0) + 0.5) * 4.0 AS x, (floor(y / 4.0) + 0.5) * 4.0 AS y, 0.0::DOUBLE AS z, '-1' AS cell FROM pts")
def degrade_grid(spark, d):
    return grid.degrade(_points(spark, d), 4.0).select("id", "bin_id", "x", "y", "z", "cell")


@register("relu_symmetric", f"{SCORED} SELECT gi, gj, {r(f'CASE WHEN w > {TAU} THEN w - {TAU} WHEN w < -{TAU} THEN w + {TAU} ELSE 0.0 END')} AS w FROM panel")
def relu_symmetric(spark, d):
    return _panel(spark, d).select("gi", "gj", rnd(S.relu_symmetric("w", TAU), "w"))


#: A label of every form, from the columns of a line.
LABELS = """lab AS (SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount) AS id,
    CAST(l_suppkey AS VARCHAR) AS cell, CASE l_linenumber WHEN 1 THEN CAST(l_suppkey AS VARCHAR) WHEN 2 THEN l_suppkey || '-1' WHEN 3 THEN l_suppkey || '-2-' || l_partkey % 3
    WHEN 4 THEN 'UNASSIGNED_' || l_partkey % 50 WHEN 5 THEN 'UNASSIGNED' WHEN 6 THEN 'group_rejected' ELSE NULL END AS label FROM lineitem)"""


def _labels(spark, d):
    from pyspark.sql import Window

    li = read_table(spark, d, "lineitem")
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"))
    s = F.col("l_suppkey").cast("string")
    n = F.col("l_linenumber")
    label = F.when(n == 1, s).when(n == 2, F.concat(s, F.lit("-1"))).when(n == 3, F.concat(s, F.lit("-2-"), (F.col("l_partkey") % 3).cast("string"))).when(n == 4, F.concat(F.lit("UNASSIGNED_"), (F.col("l_partkey") % 50).cast("string"))).when(n == 5, "UNASSIGNED").when(n == 6, "group_rejected")
    return li.select((F.col("l_orderkey") * 1000 + rank).alias("id"), s.alias("cell"), label.alias("label"))


ETYPE = "CASE WHEN label IS NULL OR label IN ('-1', 'DROP', 'UNASSIGNED', 'nan') OR label LIKE '%\\_rejected' ESCAPE '\\' THEN 'unknown' WHEN starts_with(label, 'UNASSIGNED_') THEN 'component' WHEN contains(label, '-') THEN 'partial' ELSE 'cell' END"
FREE = "(label IS NULL OR label IN ('-1', 'DROP', 'UNASSIGNED', 'nan', 'prune_rejected', 'group_rejected', 'demote_rejected'))"


@register(
    "etype_from_label",
    f"""WITH {LABELS} SELECT id, {ETYPE} AS etype, {FREE} AS unassigned, CASE WHEN label IS NULL THEN NULL WHEN regexp_matches(label, '^.*-[0-9]+-[0-9]+$') THEN regexp_extract(label, '^(.*)-[0-9]+-[0-9]+$', 1)
    WHEN regexp_matches(label, '^.*-[0-9]+$') THEN regexp_extract(label, '^(.*)-[0-9]+$', 1) ELSE label END AS head FROM lab""",
)
def etype_from_label(spark, d):
    return _labels(spark, d).select("id", L.etype_of_label("label").alias("etype"), L.is_unassigned("label").alias("unassigned"), L.label_parts("label")["cell"].alias("head"))


@register("finalize", f"WITH {LABELS} SELECT id, CASE WHEN {FREE} THEN 'UNASSIGNED' ELSE label END AS label, CASE WHEN {FREE} THEN '-1' ELSE cell END AS cell FROM lab")
def finalize(spark, d):
    return L.finalize(_labels(spark, d), "label", "cell")


@register(
    "stage_counts",
    f"""WITH {LABELS}, k AS (SELECT label, {ETYPE} AS e, {FREE} AS f FROM lab) SELECT count(DISTINCT CASE WHEN NOT f AND e = 'cell' THEN label END) AS n_cells, count(DISTINCT CASE WHEN NOT f AND e = 'partial' THEN label END) AS n_partials,
    count(DISTINCT CASE WHEN NOT f AND e = 'component' THEN label END) AS n_components, count(*) FILTER (f) AS n_unassigned FROM k""",
)
def stage_counts(spark, d):
    return L.stage_counts(_labels(spark, d), "label")


@register(
    "stage_class_counts",
    f"""WITH {LABELS}, s AS (SELECT DISTINCT stage, v FROM (SELECT 'cell' AS stage, cell AS v FROM lab UNION ALL SELECT 'label', label FROM lab))
    SELECT stage, CASE WHEN v IS NULL THEN 'unknown' WHEN v IN ('DROP', 'UNASSIGNED', '-1') THEN 'drop' WHEN starts_with(v, 'UNASSIGNED_') THEN 'pseudocell' WHEN contains(v, '-') THEN 'partial_cell' ELSE 'whole_cell' END AS kind, count(*) AS n_entities FROM s GROUP BY 1, 2""",
)
def stage_class_counts(spark, d):
    return L.stage_class_counts(_labels(spark, d), ["cell", "label"])


# --- entities -------------------------------------------------------------------------------------


@register(
    "entity_table",
    f"""WITH {POINTS} SELECT cell AS entity, {r("avg(x)")} AS x, {r("avg(y)")} AS y, {r("avg(z)")} AS z, {r("min(x)")} AS x_min, {r("max(x)")} AS x_max, {r("min(z)")} AS z_min, {r("max(z)")} AS z_max,
    array_to_string(list_sort(list(DISTINCT feature)), '|') AS genes, 'cell' AS etype, count(*) AS n FROM pts GROUP BY 1""",
)
def entity_table(spark, d):
    t = entity.entity_table(_points(spark, d), "cell")
    return t.select("entity", *(rnd(c, c) for c in ("x", "y", "z", "x_min", "x_max", "z_min", "z_max")), F.array_join("genes", "|").alias("genes"), "etype", "n")


AGG = f"""k AS (SELECT entity, count(*) AS k FROM sets GROUP BY 1), ag AS (SELECT entity, sum(CASE WHEN w > 0 THEN 1 ELSE 0 END) AS n_pos, sum(CASE WHEN w < 0 THEN -w ELSE 0 END) AS neg_abs,
    sum(CASE WHEN w > {TAU} THEN w - {TAU} ELSE 0 END) AS relu_pos, sum(CASE WHEN w < -{TAU} THEN -(w + {TAU}) ELSE 0 END) AS relu_neg, sum(abs(coalesce(w, 0))) AS strength FROM sp GROUP BY 1),
  sc AS (SELECT k.entity, k, k * (k - 1) / 2 AS n_pairs, coalesce(n_pos, 0) AS n_pos, coalesce(neg_abs, 0) AS neg_abs, coalesce(relu_pos, 0) AS relu_pos, coalesce(relu_neg, 0) AS relu_neg, coalesce(strength, 0) AS strength FROM k LEFT JOIN ag USING (entity))"""


def _aggregate(spark, d):
    return entity.pair_aggregate(_sets(spark, d), _panel(spark, d), 0.0, TAU)


@register("cell_purity_conflict", f"{SCORED}, {SETS}, {SP}, {AGG} SELECT entity, k, {r('CASE WHEN n_pairs > 0 THEN n_pos / n_pairs END')} AS purity, {r('CASE WHEN n_pairs > 0 THEN neg_abs / n_pairs END')} AS conflict FROM sc")
def cell_purity_conflict(spark, d):
    return entity.purity_conflict(_aggregate(spark, d)).select("entity", "k", rnd("purity", "purity"), rnd("conflict", "conflict"))


@register(
    "pure_cells",
    f"""{SCORED}, {SETS}, {SP}, {AGG}, p AS (SELECT entity, {r('n_pos / n_pairs')} AS purity FROM sc WHERE n_pairs > 0) SELECT entity, purity, purity >= (SELECT quantile_cont(purity, 0.8) FROM p) - 1e-9 AS is_pure FROM p""",
)
def pure_cells(spark, d):
    p = entity.purity_conflict(_aggregate(spark, d)).where("n_pairs > 0").select("entity", rnd("purity", "purity"))
    return entity.flag_top(p.withColumn("purity", F.col("purity")), "purity", "is_pure")


@register(
    "relu_scores",
    f"""{SCORED}, {SETS}, {SP}, {AGG}, q AS (SELECT entity, CASE WHEN n_pairs > 0 THEN relu_pos / n_pairs END AS p, CASE WHEN n_pairs > 0 THEN relu_neg / n_pairs END AS c FROM sc)
    SELECT entity, {r("p")} AS purity_relu, {r("c")} AS conflict_relu, {r("p + c")} AS signal_strength, {r("p / (p + c + 1e-8)")} AS relative_purity, {r("c / (p + c + 1e-8)")} AS relative_conflict FROM q""",
)
def relu_scores(spark, d):
    return entity.relu_scores(_aggregate(spark, d)).select("entity", *(rnd(c, c) for c in ("purity_relu", "conflict_relu", "signal_strength", "relative_purity", "relative_conflict")))


@register("signal_strength", f"{SCORED}, {SETS}, {SP}, {AGG} SELECT entity, {r('strength')} AS strength FROM sc")
def signal_strength(spark, d):
    return _aggregate(spark, d).select("entity", rnd("strength", "strength"))


def coherence_sql(pairs: str, up: str, down: str, total: str) -> str:
    return f"""{SCORED}, {SETS}, {SP}, c AS (SELECT entity, CAST({up} AS DOUBLE) AS p, CAST({down} AS DOUBLE) AS q, CAST({total} AS DOUBLE) AS t FROM ({pairs}) GROUP BY 1), e AS (SELECT DISTINCT entity FROM sets)
    SELECT entity, {r("CASE WHEN t > 0 THEN p / t ELSE 0 END")} AS purity, {r("CASE WHEN t > 0 THEN q / t ELSE 0 END")} AS conflict, {r("CASE WHEN t > 0 THEN p / t - q / t ELSE 0 END")} AS coherence FROM e LEFT JOIN c USING (entity)"""


UP, DOWN = f"count(*) FILTER (w > {TAU})", f"count(*) FILTER (w < -{TAU})"
COHERENCE = {
    "coherence_skip": ({"absent": "skip"}, coherence_sql("SELECT * FROM sp", UP, DOWN, "count(w)")),
    "coherence_zero": ({"absent": "zero"}, coherence_sql("SELECT entity, coalesce(w, 0) AS w FROM sp", UP, DOWN, "count(w)")),
    "coherence_real_signal": ({"absent": "skip", "real_signal": SIGNAL}, coherence_sql(f"SELECT * FROM sp WHERE abs(w) > {SIGNAL}", UP, DOWN, "count(w)")),
    "coherence_magnitude": ({"mode": "magnitude"}, coherence_sql("SELECT * FROM sp", f"sum(CASE WHEN w > {TAU} THEN w ELSE 0 END)", f"sum(CASE WHEN w < -{TAU} THEN -w ELSE 0 END)", "sum(abs(w))")),
}
for _name, (_options, _sql) in COHERENCE.items():

    @register(_name, _sql)
    def coherence(spark, d, options=_options):
        return entity.coherence(_sets(spark, d), _panel(spark, d), TAU, **options).select("entity", *(rnd(c, c) for c in ("purity", "conflict", "coherence")))


CAND = "cand AS (SELECT CAST(c_custkey AS VARCHAR) AS a, CAST(c_custkey + 1 AS VARCHAR) AS b FROM customer)"


def _candidates(spark, d):
    return read_table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("a"), (F.col("c_custkey") + 1).cast("string").alias("b"))


@register(
    "delta_c_pairs",
    f"""{SCORED}, {SETS}, {CAND}, cs AS (SELECT DISTINCT a, b FROM cand WHERE a IN (SELECT entity FROM sets) AND b IN (SELECT entity FROM sets)),
    un AS (SELECT a || '|' || b AS entity, feature FROM cs JOIN sets ON entity = a UNION SELECT a || '|' || b, feature FROM cs JOIN sets ON entity = b), al AS (SELECT * FROM sets UNION ALL SELECT * FROM un),
    p AS (SELECT x.entity, count(*) AS t, count(*) FILTER (w > {TAU}) AS u, count(*) FILTER (w < -{TAU}) AS v FROM al x JOIN al y ON x.entity = y.entity AND x.feature < y.feature LEFT JOIN panel ON gi = x.feature AND gj = y.feature GROUP BY 1),
    c AS (SELECT e.entity, coalesce(u / t - v / t, 0) AS c FROM (SELECT DISTINCT entity FROM al) e LEFT JOIN p USING (entity)), s AS (SELECT cell AS entity, count(*) AS n FROM pts GROUP BY 1)
    SELECT a, b, {r("cu.c")} AS c_union, {r("ca.c")} AS c_a, {r("cb.c")} AS c_b, {r("cu.c - 1.0 / (sa.n + sb.n) - greatest(ca.c - 1.0 / sa.n, cb.c - 1.0 / sb.n)")} AS delta_c
    FROM cs JOIN c cu ON cu.entity = a || '|' || b JOIN c ca ON ca.entity = a JOIN c cb ON cb.entity = b JOIN s sa ON sa.entity = a JOIN s sb ON sb.entity = b""",
)
def delta_c_pairs(spark, d):
    counts = settle(_points(spark, d).groupBy(F.col("cell").alias("entity"), "feature").agg(F.count("*").alias("n")), "counts")
    sizes = counts.groupBy("entity").agg(F.sum("n").alias("n"))
    return entity.delta_c(entity.features_of(counts), sizes, _candidates(spark, d), _panel(spark, d), TAU).select("a", "b", *(rnd(c, c) for c in ("c_union", "c_a", "c_b", "delta_c")))


@register(
    "component_gain",
    f"""{SCORED}, {SETS}, {CAND}, cs AS (SELECT DISTINCT a, b FROM cand WHERE a IN (SELECT entity FROM sets) AND b IN (SELECT entity FROM sets)),
    un AS (SELECT a || '|' || b AS entity, feature FROM cs JOIN sets ON entity = a UNION SELECT a || '|' || b, feature FROM cs JOIN sets ON entity = b), al AS (SELECT * FROM sets UNION ALL SELECT * FROM un),
    p AS (SELECT x.entity, count(*) FILTER (w > 0) / count(*) - coalesce(avg(CASE WHEN w < 0 THEN -w END), 0) AS v FROM al x JOIN al y ON x.entity = y.entity AND x.feature < y.feature LEFT JOIN panel ON gi = x.feature AND gj = y.feature GROUP BY 1),
    c AS (SELECT entity, count(*) AS k, coalesce(any_value(v), 0) AS v FROM al LEFT JOIN p USING (entity) GROUP BY 1)
    SELECT a, b, CASE WHEN ca.k = 1 AND cb.k = 1 THEN -1e9 ELSE {r("cu.v - greatest(ca.v, cb.v)")} END AS gain FROM cs JOIN c cu ON cu.entity = a || '|' || b JOIN c ca ON ca.entity = a JOIN c cb ON cb.entity = b""",
)
def component_gain(spark, d):
    g = entity.component_delta_c(_sets(spark, d), _candidates(spark, d), _panel(spark, d))
    return g.select("a", "b", F.when(F.col("delta_c") == float("-inf"), -1e9).otherwise(F.round(F.col("delta_c") + 1e-9, 6) + 0.0).alias("gain"))


@register("mean_pmi_fit", f"{SCORED}, {SETS} SELECT q.feature, q.entity, {r('avg(w)')} AS fit FROM sets q JOIN sets o ON q.entity = o.entity AND q.feature <> o.feature LEFT JOIN both_ ON a = q.feature AND b = o.feature GROUP BY 1, 2")
def mean_pmi_fit(spark, d):
    s = _sets(spark, d)
    return entity.mean_fit(s, s, _panel(spark, d)).select("feature", "entity", rnd("fit", "fit"))


@register(
    "dz_stats",
    f"""WITH {POINTS} SELECT a.cell AS entity, count(*) AS n_pairs, {r("avg(abs(a.z - b.z))")} AS dz_mean, {r("max(abs(a.z - b.z))")} AS dz_max, {r("quantile_cont(abs(a.z - b.z), 0.5)")} AS dz_p50, {r("quantile_cont(abs(a.z - b.z), 0.9)")} AS dz_p90 FROM pts a JOIN pts b ON a.cell = b.cell AND a.id < b.id GROUP BY 1""",
)
def dz_stats(spark, d):
    s = entity.dz_stats(_points(spark, d), "cell")
    return s.select("entity", "n_pairs", rnd("dz_mean", "dz_mean"), rnd("dz_max", "dz_max"), rnd(F.col("dz_p")[0], "dz_p50"), rnd(F.col("dz_p")[1], "dz_p90"))


@register(
    "pair_stats",
    f"""{SCORED}, {SETS}, {SP} SELECT entity, {r("sum(w)")} AS w_sum, {r("min(w)")} AS w_min, {r("quantile_cont(w, 0.25)")} AS p25, {r("quantile_cont(w, 0.5)")} AS p50, {r("quantile_cont(w, 0.75)")} AS p75, count(w) AS n FROM sp GROUP BY 1""",
)
def pair_stats(spark, d):
    return entity.pair_stats(_sets(spark, d), _panel(spark, d)).select("entity", *(rnd(c, c) for c in ("w_sum", "w_min", "p25", "p50", "p75")), "n")


CLIQUE = """en AS (SELECT entity, gi AS feature, w FROM sp WHERE w > 0 UNION ALL SELECT entity, gj, w FROM sp WHERE w > 0), sm AS (SELECT entity, feature, sum(w) AS s FROM en GROUP BY 1, 2),
  cl AS (SELECT entity, feature FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY round(s, 9) DESC, feature) AS k FROM sm) WHERE k <= 5)"""


@register("top_clique", f"{SCORED}, {SETS}, {SP}, {CLIQUE} SELECT entity, feature FROM cl")
def top_clique(spark, d):
    return entity.top_clique(_sets(spark, d), _panel(spark, d))


@register(
    "cross_mean",
    f"""{SCORED}, {SETS}, {SP}, {CLIQUE}, {CAND} SELECT c.a, c.b, {r("avg(w)")} AS mean FROM cand c JOIN cl f ON f.entity = c.a JOIN cl g ON g.entity = c.b LEFT JOIN both_ x ON x.a = f.feature AND x.b = g.feature GROUP BY 1, 2""",
)
def cross_mean(spark, d):
    p = _panel(spark, d)
    return entity.cross_mean(entity.top_clique(_sets(spark, d), p), _candidates(spark, d), p).select("a", "b", rnd("mean", "mean"))


@register(
    "coherence_quantiles",
    f"""{SCORED}, {SETS}, {SP}, c AS (SELECT entity, count(*) FILTER (w > {TAU}) / count(w) - count(*) FILTER (w < -{TAU}) / count(w) AS c FROM sp GROUP BY 1)
    SELECT count(c) AS n, {r("quantile_cont(c, 0.1)")} AS p10, {r("quantile_cont(c, 0.25)")} AS p25, {r("quantile_cont(c, 0.5)")} AS p50, {r("quantile_cont(c, 0.75)")} AS p75, {r("quantile_cont(c, 0.9)")} AS p90 FROM c""",
)
def coherence_quantiles(spark, d):
    s = _sets(spark, d)
    big = s.groupBy("entity").count().where("count > 1").select("entity")
    q = entity.quantiles_by(entity.coherence(s.join(big, "entity", "left_semi"), _panel(spark, d), TAU), "coherence")
    return q.select("n", *(rnd(c, c) for c in ("p10", "p25", "p50", "p75", "p90")))


MAHA = """mo AS (SELECT cell AS entity, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_samp(x, x) AS xx, covar_samp(x, y) AS xy, covar_samp(x, z) AS xz, covar_samp(y, y) AS yy,
    covar_samp(y, z) AS yz, covar_samp(z, z) AS zz FROM pts GROUP BY 1),
  j AS (SELECT c.a, c.b, p.n AS na, q.n AS nb, p.mx - q.mx AS dx, p.my - q.my AS dy, p.mz - q.mz AS dz, {} FROM (SELECT DISTINCT a, b FROM cand) c JOIN mo p ON p.entity = c.a JOIN mo q ON q.entity = c.b)""".format(
    ", ".join(f"((p.n - 1) * p.{k} + (q.n - 1) * q.{k}) / (p.n + q.n - 2) AS {k}" for k in ("xx", "xy", "xz", "yy", "yz", "zz"))
)
DET = "(xx * (yy * zz - yz * yz) + xy * (xz * yz - xy * zz) + xz * (xy * yz - xz * yy))"
QUAD = "(dx * ((yy * zz - yz * yz) * dx + (xz * yz - xy * zz) * dy + (xy * yz - xz * yy) * dz) + dy * ((xz * yz - xy * zz) * dx + (xx * zz - xz * xz) * dy + (xy * xz - xx * yz) * dz) + dz * ((xy * yz - xz * yy) * dx + (xy * xz - xx * yz) * dy + (xx * yy - xy * xy) * dz))"


@register("mahalanobis_pairs", f"WITH {POINTS}, {CAND}, {MAHA} SELECT a, b, {r(f'CASE WHEN na > 1 AND nb > 1 AND {DET} > 1e-12 * pow(greatest(xx, yy, zz), 3) THEN sqrt({QUAD} / {DET}) END')} AS d FROM j")
def mahalanobis_pairs(spark, d):
    return entity.mahalanobis(entity.moments(_points(spark, d), "cell"), _candidates(spark, d)).select("a", "b", rnd("d", "d"))


# --- grid and distances -----------------------------------------------------------------------------


def _emb(spark, d):
    return adapters.embedding_points(spark, d).withColumnRenamed("label", "entity")


BINS = "ix AS (SELECT CAST(floor(x / 2.0) AS INT) AS bx, CAST(floor(y / 2.0) AS INT) AS by_, CAST(floor(z / 2.0) AS INT) AS bz, label AS entity, count(*) AS n FROM emb GROUP BY ALL)"


@register("grid_bins", f"WITH {EMB}, {BINS} SELECT bx, by_ AS \"by\", bz, entity, n FROM ix")
def grid_bins(spark, d):
    return grid.build_index(_emb(spark, d), 2.0, 2.0)


@register(
    "grid_witness_pairs",
    f"""WITH {EMB}, {BINS}, p AS (SELECT a.entity AS lo, b.entity AS hi, a.bx AS ax, a.by_ AS ay, a.bz AS az, a.n AS na, b.bx AS cx, b.by_ AS cy, b.bz AS cz, b.n AS nb FROM ix a JOIN ix b
      ON a.entity < b.entity AND abs(a.bx - b.bx) <= 1 AND abs(a.by_ - b.by_) <= 1 AND abs(a.bz - b.bz) <= 1),
    l AS (SELECT lo, hi, sum(na) AS n_lo FROM (SELECT DISTINCT lo, hi, ax, ay, az, na FROM p) GROUP BY 1, 2), h AS (SELECT lo, hi, sum(nb) AS n_hi FROM (SELECT DISTINCT lo, hi, cx, cy, cz, nb FROM p) GROUP BY 1, 2)
    SELECT lo, hi, CAST(n_lo AS BIGINT) AS n_lo, CAST(n_hi AS BIGINT) AS n_hi, (SELECT CAST(sum(na * nb) AS BIGINT) FROM p WHERE p.lo = l.lo AND p.hi = l.hi) AS n_records FROM l JOIN h USING (lo, hi) WHERE n_lo >= 3 AND n_hi >= 3""",
)
def grid_witness_pairs(spark, d):
    return grid.witness_pairs(grid.build_index(_emb(spark, d), 2.0, 2.0), "8", 1, 3)


@register(
    "stitch_candidates",
    f"""WITH {EMB}, {BINS}, c AS (SELECT a.entity AS a, b.entity AS b, sum(a.n * b.n) AS k FROM ix a JOIN ix b
      ON a.entity < b.entity AND abs(a.bx - b.bx) <= 1 AND abs(a.by_ - b.by_) <= 1 AND abs(a.bz - b.bz) <= 1 GROUP BY 1, 2),
    s AS (SELECT a, b FROM c WHERE k >= 480),
    d AS (SELECT s.a, s.b, abs(CAST(round(p.z * 1e9) AS BIGINT) - CAST(round(q.z * 1e9) AS BIGINT)) AS dz FROM s JOIN emb p ON p.label = s.a JOIN emb q ON q.label = s.b)
    SELECT a, b FROM d GROUP BY 1, 2 HAVING median(dz) <= 2.45e9 AND count(CASE WHEN dz < 5e8 THEN 1 END) >= 260""",
)
def stitch_candidates(spark, d):
    rows = _emb(spark, d)
    met = grid.supported(grid.witness_pairs(grid.build_index(rows, 2.0, 2.0), "8", 1, 1), 480)
    return grid.close_in_z(met.select(F.col("lo").alias("a"), F.col("hi").alias("b")), rows, 2.45, 0.5, 260)


@register("neighbor_entities", f"WITH {EMB}, {BINS} SELECT entity, array_to_string(list_sort(list(bx || ',' || by_ || ',' || bz)), ' ') AS bins FROM ix WHERE abs(bx) <= 1 AND abs(by_) <= 1 AND bz = 0 GROUP BY 1")
def neighbor_entities(spark, d):
    n = grid.neighbor_entities(grid.build_index(_emb(spark, d), 2.0, 2.0), 0, 0, 0)
    return n.select("entity", F.array_join(F.array_sort(F.transform("bins", lambda b: F.concat_ws(",", b.bx, b.by, b.bz))), " ").alias("bins"))


@register("center_bin_pairs", f"WITH {EMB}, {BINS} SELECT DISTINCT a.entity AS a, b.entity AS b FROM ix a JOIN ix b ON a.entity < b.entity AND abs(a.bx - b.bx) <= 2 AND abs(a.by_ - b.by_) <= 2 AND abs(a.bz - b.bz) <= 2")
def center_bin_pairs(spark, d):
    return grid.center_bin_pairs(grid.build_index(_emb(spark, d), 2.0, 2.0), 1)


D2 = "(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))"


@register("radius_join", f"WITH {EMB} SELECT a.id AS src, b.id AS dst, {r(D2)} AS d2 FROM emb a JOIN emb b ON {D2} <= 1.0 AND a.id <> b.id")
def radius_join(spark, d):
    e = _emb(spark, d)
    return spatial_join.radius_join(e, e, 1.0).where("src <> dst").select("src", "dst", rnd("d2", "d2"))


KNN = f"kn AS (SELECT src, dst, len FROM (SELECT a.id AS src, b.id AS dst, sqrt({D2}) AS len, row_number() OVER (PARTITION BY a.id ORDER BY round(sqrt({D2}), 6), b.id) AS k FROM emb a JOIN emb b ON {D2} <= 2.25 AND a.id <> b.id) WHERE k <= 4)"


def _knn(spark, d):
    return spatial_join.knn_capped(_emb(spark, d), 4, 1.5)


@register("knn_capped", f"WITH {EMB}, {KNN} SELECT src, dst, {r('len')} AS length FROM kn")
def knn_capped(spark, d):
    return _knn(spark, d).select("src", "dst", rnd("length", "length"))


OWN_KNN = f"""ol AS (SELECT a.label, a.id AS src, b.id AS dst, sqrt({D2}) AS len FROM emb a JOIN emb b ON a.label = b.label AND a.id <> b.id),
  ok_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(len, 6), dst) AS k FROM ol) WHERE k <= 3)"""


@register("knn_per_label", f"WITH {EMB}, {OWN_KNN} SELECT label, src, dst, {r('len')} AS length FROM ok_")
def knn_per_label(spark, d):
    return spatial_join.knn_per_label(adapters.embedding_points(spark, d), 3).select("label", "src", "dst", rnd("length", "length"))


@register("nearest_seed", f"WITH {POINTS}, s AS (SELECT CAST(s_suppkey AS BIGINT) AS id, (s_suppkey * 7 % 50) + 0.25 AS x, (s_suppkey * 11 % 52) + 0.125 AS y FROM supplier) SELECT id, seed, {r('d2')} AS d2 FROM (SELECT p.id, s.id AS seed, pow(p.x - s.x, 2) + pow(p.y - s.y, 2) AS d2, row_number() OVER (PARTITION BY p.id ORDER BY pow(p.x - s.x, 2) + pow(p.y - s.y, 2), s.id) AS k FROM pts p CROSS JOIN s) WHERE k = 1")
def nearest_seed(spark, d):
    k = F.col("s_suppkey")
    seeds = read_table(spark, d, "supplier").select(k.cast("long").alias("id"), ((k * 7 % 50) + F.lit(0.25)).cast("double").alias("x"), ((k * 11 % 52) + F.lit(0.125)).cast("double").alias("y"))
    return spatial_join.nearest_seed(_points(spark, d), seeds).select("id", "seed", rnd("d2", "d2"))


@register("nearest_centroid", f"""WITH {EMB}, c AS (SELECT label AS entity, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM emb GROUP BY 1), k AS (SELECT a.id AS src, b.entity, {D2} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY round({D2}, 9), b.entity) AS k FROM emb a JOIN c b ON {D2} <= 16.0)
    SELECT src, entity, {r("sqrt(d2)")} AS d FROM k WHERE k = 1""")
def nearest_centroid(spark, d):
    e = _emb(spark, d)
    return spatial_join.nearest_centroid(e, tiling.centroids(e, "entity").drop("n"), 4.0).select("src", "entity", rnd("d", "d"))


# Diamonds between the extremes and means of the points of each tile of 8 by 8.
DIAMONDS = """q AS (SELECT concat_ws('_', floor(x / 8)::bigint, floor(y / 8)::bigint) AS polygon, min(x) AS x0, max(x) AS x1, avg(x) AS xm, min(y) AS y0, max(y) AS y1, avg(y) AS ym FROM pts GROUP BY 1),
    e AS (SELECT polygon, x0 AS ax, ym AS ay, xm AS bx, y1 AS by_ FROM q UNION ALL SELECT polygon, xm, y1, x1, ym FROM q UNION ALL SELECT polygon, x1, ym, xm, y0 FROM q UNION ALL SELECT polygon, xm, y0, x0, ym FROM q)"""


@register(
    "points_in_polygons",
    f"""WITH {POINTS}, {DIAMONDS}, h AS (SELECT id, polygon FROM pts JOIN e ON (ay > y) <> (by_ > y) AND x < ax + (y - ay) * (bx - ax) / (by_ - ay) GROUP BY 1, 2 HAVING count(*) % 2 = 1)
    SELECT id, min(polygon) AS polygon FROM pts LEFT JOIN h USING (id) GROUP BY 1""",
)
def points_in_polygons(spark, d):
    p = _points(spark, d).select("id", "x", "y")
    tile = F.concat_ws("_", *(F.floor(F.col(c) / 8).cast("string") for c in "xy"))
    q = p.groupBy(tile.alias("polygon")).agg(*(f(c).alias(f"{c}{n}") for c in "xy" for n, f in (("0", F.min), ("1", F.max), ("m", F.avg))))
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return spatial_join.point_in_polygon(p, q.select("polygon", F.array(corner("x0", "ym"), corner("xm", "y1"), corner("x1", "ym"), corner("xm", "y0")).alias("ring")))


@register("cross_tile_pairs", f"""WITH {POINTS}, c AS (SELECT cell AS entity, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM pts GROUP BY 1), t AS (SELECT *, floor(x) % 2 AS tile FROM c)
    SELECT a.entity AS a, b.entity AS b, {r(f"sqrt({D2})")} AS d FROM t a JOIN t b ON a.entity < b.entity AND a.tile <> b.tile AND {D2} <= 0.0625""")
def cross_tile_pairs(spark, d):
    c = tiling.centroids(_points(spark, d)).withColumn("tile", F.floor("x") % 2)
    return spatial_join.cross_tile_pairs(c, 0.25).select("a", "b", rnd("d", "d"))


@register("grid_edges_xy", f"WITH {EMB}, q AS (SELECT *, floor(x / 1.0) AS bx, floor(y / 1.0) AS by_ FROM emb) SELECT a.id AS src, b.id AS dst FROM q a JOIN q b ON a.id < b.id AND abs(a.bx - b.bx) <= 1 AND abs(a.by_ - b.by_) <= 1 AND {D2} <= 4.0")
def grid_edges_xy(spark, d):
    return graph.grid_edges(_emb(spark, d), 1.0, "8", longest=2.0)


@register("grid_edges_xyz", f"WITH {EMB}, q AS (SELECT *, floor(x / 1.0) AS bx, floor(y / 1.0) AS by_, floor(z / 1.0) AS bz FROM emb) SELECT a.id AS src, b.id AS dst FROM q a JOIN q b ON a.id < b.id AND abs(a.bx - b.bx) + abs(a.by_ - b.by_) <= 1 AND abs(a.bz - b.bz) <= 1")
def grid_edges_xyz(spark, d):
    return graph.grid_edges(_emb(spark, d), 1.0, "4", 1.0, 1)


# --- graphs -----------------------------------------------------------------------------------------

EDGES = "ed AS (SELECT src, dst FROM kn WHERE src < dst), un AS (SELECT src AS a, dst AS b FROM ed UNION SELECT dst, src FROM ed)"


def _edges(spark, d):
    return settle(graph.undirected(_knn(spark, d)).select("src", "dst"), "knn")


@register("components", f"WITH RECURSIVE {EMB}, {KNN}, {EDGES}, rc AS (SELECT id AS a, id AS c FROM emb UNION SELECT un.b, rc.c FROM rc JOIN un ON un.a = rc.a) SELECT a AS id, min(c) AS component FROM rc GROUP BY 1")
def components(spark, d):
    return graph.all_components(_emb(spark, d), _edges(spark, d))


CONSTRAINED = "lu AS (SELECT un.a, un.b FROM un JOIN emb p ON p.id = un.a JOIN emb q ON q.id = un.b WHERE p.label = q.label), rc AS (SELECT id AS a, id AS c FROM emb UNION SELECT lu.b, rc.c FROM rc JOIN lu ON lu.a = rc.a), cc AS (SELECT a AS id, min(c) AS component FROM rc GROUP BY 1)"


@register("constrained_components", f"WITH RECURSIVE {EMB}, {KNN}, {EDGES}, {CONSTRAINED} SELECT id, component FROM cc")
def constrained_components(spark, d):
    return graph.constrained_components(adapters.embedding_points(spark, d), _edges(spark, d))


@register("self_bin_components", f"WITH {EMB} SELECT id, min(id) OVER (PARTITION BY floor(x / 2.0), floor(y / 2.0)) AS component FROM emb")
def self_bin_components(spark, d):
    return graph.self_bin_components(_emb(spark, d), 2.0)


@register(
    "spatial_split",
    f"""WITH RECURSIVE {EMB}, {KNN}, {EDGES}, {CONSTRAINED}, s AS (SELECT label, component, count(*) AS n FROM emb JOIN cc USING (id) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, component) AS k FROM s)
    SELECT id, CASE WHEN k = 1 THEN label ELSE label || '-' || k END AS entity FROM emb JOIN cc USING (id) JOIN k USING (label, component)""",
)
def spatial_split(spark, d):
    rows = _emb(spark, d).withColumn("etype", F.lit("cell"))
    return stages.spatial_split(rows, _edges(spark, d)).select("id", "entity")


FEATURED = "fe AS (SELECT id, 'Brand#' || (id % 25 + 1) AS feature FROM emb)"


def _featured(spark, d):
    return _emb(spark, d).withColumn("feature", F.concat(F.lit("Brand#"), (F.col("id") % 25 + 1).cast("string")))


@register(
    "edge_prune",
    f"""WITH {POINTS}, {PRES}, {PAIRS}, {RANKED}, {THRESH}, {EMB}, {KNN}, {FEATURED}, s AS (SELECT src, dst, len, f.feature AS gi, g.feature AS gj FROM kn JOIN fe f ON f.id = src JOIN fe g ON g.id = dst),
    e AS (SELECT s.*, coalesce(npmi, 0.0) AS npmi, coalesce(cond_prob, 0.0) AS cond_prob FROM s LEFT JOIN ranked t ON t.gi = s.gi AND t.gj = s.gj AND NOT dropped),
    q AS (SELECT e.*, coalesce(npmi > npmi_thresh AND cond_prob > cond_thresh AND len < 1.0, false) AS strong FROM e LEFT JOIN th ON th.gi = e.gi)
    SELECT src, dst, {r("npmi")} AS npmi, CAST(strong AS INT) AS connect FROM q WHERE strong OR NOT (npmi <= 0.0 OR cond_prob <= 0.0 OR len >= 1.25)""",
)
def edge_prune(spark, d):
    ranked = settle(_ranked(spark, d), "ranked")
    stats = graph.edge_stats(_knn(spark, d), _featured(spark, d), ranked)
    return graph.prune_edges(stats, assoc.gene_thresholds(ranked, 3), 1.0, 1.25).select("src", "dst", rnd("npmi", "npmi"), "connect")


@register("degrees", f"WITH {EMB}, {KNN}, {EDGES} SELECT a AS id, count(*) AS degree FROM un GROUP BY 1")
def degrees(spark, d):
    return graph.degrees(_edges(spark, d))


@register(
    "cc_summary",
    f"""WITH RECURSIVE {EMB}, {KNN}, {EDGES}, {FEATURED}, rc AS (SELECT id AS a, id AS c FROM emb UNION SELECT un.b, rc.c FROM rc JOIN un ON un.a = rc.a), cc AS (SELECT a AS id, min(c) AS component FROM rc GROUP BY 1),
    p AS (SELECT * FROM emb JOIN cc USING (id) JOIN fe USING (id)), g AS (SELECT component, label, count(*) AS c, row_number() OVER (PARTITION BY component ORDER BY count(*) DESC, label) AS k FROM p GROUP BY 1, 2)
    SELECT component, count(*) AS n_nodes, count(DISTINCT feature) AS n_features, {r("avg(x)")} AS x, {r("avg(y)")} AS y, any_value(g.label) AS majority_cell, {r("any_value(g.c) / count(*)")} AS majority_share
    FROM p JOIN (SELECT component, label, c FROM g WHERE k = 1) g USING (component) GROUP BY 1 HAVING count(*) >= 2""",
)
def cc_summary(spark, d):
    e = _featured(spark, d).withColumnRenamed("entity", "cell")
    s = graph.component_summary(e, graph.all_components(e, _edges(spark, d)), 2)
    return s.select("component", "n_nodes", "n_features", rnd("x", "x"), rnd("y", "y"), "majority_cell", rnd("majority_share", "majority_share"))


@register(
    "cc_summary_scores",
    f"""{SCORED}, bl AS (SELECT concat_ws('_', CAST(floor(x / 4) AS BIGINT), CAST(floor(y / 4) AS BIGINT), CAST(floor(z / 3) AS BIGINT)) AS component, feature FROM pts),
    g AS (SELECT component, count(*) AS n_nodes, count(DISTINCT feature) AS k FROM bl GROUP BY 1 HAVING count(*) >= 20), s AS (SELECT DISTINCT component, feature FROM bl),
    q AS (SELECT a.component, count(*) FILTER (w > 0) AS up, coalesce(sum(-w) FILTER (w < 0), 0) AS down, coalesce(sum(w - {TAU}) FILTER (w > {TAU}), 0) AS ru, coalesce(sum(-w - {TAU}) FILTER (w < -{TAU}), 0) AS rd, count(*) AS n_pairs
      FROM s a JOIN s b ON a.component = b.component AND a.feature < b.feature LEFT JOIN panel p ON p.gi = a.feature AND p.gj = b.feature GROUP BY 1)
    SELECT component, n_nodes, k AS n_features, {r("up / n_pairs")} AS purity, {r("down / n_pairs")} AS conflict, {r("(ru + rd) / n_pairs")} AS signal_strength,
      {r("(ru / n_pairs) / ((ru + rd) / n_pairs + 1e-8)")} AS relative_purity FROM g LEFT JOIN q USING (component)""",
)
def cc_summary_scores(spark, d):
    """Blocks of space as components, scored against the panel of all points."""
    rows = settle(_blocks(spark, d), "blocks")
    s = graph.component_summary(rows, rows.select("id", F.col("cell").alias("component")), 20, _panel(spark, d), tau=TAU)
    return s.select("component", "n_nodes", "n_features", *(rnd(c, c) for c in ("purity", "conflict", "signal_strength", "relative_purity")))


@register("component_delaunay")
def component_delaunay(spark, d):
    near = graph.component_delaunay(tiling.centroids(_points(spark, d)).withColumnRenamed("entity", "component"))
    return near.select("a", "b", rnd("length", "length"))


@register("component_stitch")
def component_stitch(spark, d):
    e = _featured(spark, d)
    reach = settle(graph.all_components(e, _edges(spark, d)), "reach")
    return stages.stitch_components(e.drop("entity"), reach, _panel(spark, d), ("x", "y", "z"))


# An edge of a hull has all other points on its left, or on the line between its ends; a hull's vertices are its edges' first ends.
@register(
    "hulls",
    f"""WITH {POINTS}, p AS (SELECT DISTINCT cell, x, y FROM pts), k AS (SELECT cell FROM pts GROUP BY 1 HAVING count(*) >= 3),
    e AS (SELECT a.cell, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM p a JOIN k USING (cell) JOIN p b ON a.cell = b.cell AND (a.x <> b.x OR a.y <> b.y)),
    c AS (SELECT e.*, min((bx - ax) * (c.y - ay) - (by_ - ay) * (c.x - ax)) AS least, max(CASE WHEN (bx - ax) * (c.y - ay) - (by_ - ay) * (c.x - ax) = 0 AND (c.x - ax) * (c.x - bx) + (c.y - ay) * (c.y - by_) > 0 THEN 1 ELSE 0 END) AS beyond,
        max(abs((bx - ax) * (c.y - ay) - (by_ - ay) * (c.x - ax))) AS wide FROM e JOIN p c ON c.cell = e.cell GROUP BY 1, 2, 3, 4, 5)
    SELECT cell AS polygon, count(*) AS n_vertices, {r("sum(ax * by_ - bx * ay) / 2")} AS area, {r("sum(sqrt(pow(ax - bx, 2) + pow(ay - by_, 2)))")} AS length FROM c WHERE least >= 0 AND beyond = 0 AND wide > 0 GROUP BY 1""",
)
def hulls(spark, d):
    ends = F.transform("ring", lambda v, i: F.struct(v.alias("a"), F.element_at("ring", F.pmod(i + 1, F.size("ring")) + 1).alias("b")))
    total = lambda f: F.aggregate(ends, F.lit(0.0), lambda s, e: s + f(e.a, e.b))
    area, length = total(lambda a, b: a.x * b.y - b.x * a.y) / 2, total(lambda a, b: F.sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)))
    return graph.hulls(_points(spark, d), "cell").select("polygon", lng(F.size("ring"), "n_vertices"), rnd(area, "area"), rnd(length, "length"))


# --- label stages -----------------------------------------------------------------------------------


@register(
    "z_gap_split",
    f"""WITH {POINTS}, l AS (SELECT * FROM pts), j AS (SELECT id, cell, coalesce(z - lag(z) OVER w > 1.5, false) AS jump, z FROM l WINDOW w AS (PARTITION BY cell ORDER BY z, id)),
    p AS (SELECT id, cell, sum(CAST(jump AS INT)) OVER (PARTITION BY cell ORDER BY z, id ROWS UNBOUNDED PRECEDING) AS part FROM j), s AS (SELECT cell, part, count(*) AS n FROM p GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY n DESC, part) - 1 AS k, count(*) OVER (PARTITION BY cell) > 1 AS cut FROM s)
    SELECT id, CASE WHEN cut AND n < 2 THEN '-1' WHEN k = 0 THEN cell ELSE cell || '-' || k END AS entity, CASE WHEN cut AND n < 2 THEN 'unknown' WHEN k = 0 THEN 'cell' ELSE 'partial' END AS etype FROM p JOIN k USING (cell, part)""",
)
def z_gap_split(spark, d):
    rows = _points(spark, d).withColumns({"entity": F.col("cell"), "etype": F.lit("cell")})
    return stages.z_gap_split(rows, 1.5, 2).select("id", "entity", "etype")


@register("size_qc", f"WITH {POINTS}, s AS (SELECT label, count(*) AS n FROM pts WHERE label <> '-1' GROUP BY 1) SELECT id, CASE WHEN n < 22 THEN '-1' ELSE p.label END AS entity FROM pts p LEFT JOIN s ON s.label = p.label")
def size_qc(spark, d):
    return stages.size_qc(_rows(spark, d), 22).select("id", "entity")


@register("demote_small", f"WITH {POINTS}, s AS (SELECT label, count(*) AS n FROM pts WHERE label <> '-1' GROUP BY 1) SELECT id, CASE WHEN n < 22 THEN 'demote_rejected' ELSE p.label END AS entity FROM pts p LEFT JOIN s ON s.label = p.label")
def demote_small(spark, d):
    return stages.demote_small(_rows(spark, d).withColumn("etype", F.lit("partial")), 22).select("id", "entity")


@register("cluster_guard", f"WITH {POINTS}, f AS (SELECT id, count(*) OVER (PARTITION BY feature, floor(x / 4.0), floor(y / 4.0)) AS c FROM pts WHERE label = '-1') SELECT id FROM f WHERE c - 1 >= 5")
def cluster_guard(spark, d):
    return stages.guarded(_rows(spark, d), 4.0, 5)


@register(
    "coherence_qc",
    f"""{SCORED}, sets AS (SELECT DISTINCT label AS entity, feature FROM pts WHERE label <> '-1'), {SP},
    c AS (SELECT entity, count(*) FILTER (abs(w) > {SIGNAL}) AS t, count(*) FILTER (w > {SIGNAL}) AS u, count(*) FILTER (w < -{SIGNAL}) AS v FROM sp GROUP BY 1), k AS (SELECT entity, count(*) AS k FROM sets GROUP BY 1),
    bad AS (SELECT entity FROM k LEFT JOIN c USING (entity) WHERE k < 2 OR coalesce(CASE WHEN t > 0 THEN u / t - v / t ELSE 0 END, 0) <= 0.05)
    SELECT id, CASE WHEN bad.entity IS NOT NULL THEN '-1' ELSE label END AS entity FROM pts LEFT JOIN bad ON bad.entity = label""",
)
def coherence_qc(spark, d):
    return stages.coherence_qc(_rows(spark, d), _panel(spark, d), 0.05, SIGNAL, kinds=("cell",)).select("id", "entity")


FOUND = f"""{OFF9}, lf AS (SELECT DISTINCT label AS entity, feature FROM pts WHERE label <> '-1'),
  fr AS (SELECT id, feature, x, y, z, floor(x / 1.0) + dx AS bx, floor(y / 1.0) + dy AS by_ FROM pts, off9 WHERE label = '-1'), he AS (SELECT label AS entity, x, y, z, floor(x / 1.0) AS bx, floor(y / 1.0) AS by_ FROM pts WHERE label <> '-1'),
  fo AS (SELECT f.id, f.feature, h.entity, count(*) AS n, min(pow(f.x - h.x, 2) + pow(f.y - h.y, 2) + pow(f.z - h.z, 2)) AS d2 FROM fr f JOIN he h ON f.bx = h.bx AND f.by_ = h.by_ AND abs(f.z - h.z) <= 1.0 * pow(2, 0.5) GROUP BY 1, 2, 3)"""
PAIRED = "pq AS (SELECT q.feature, q.entity, o.feature AS other, w FROM (SELECT DISTINCT feature, entity FROM fo) q JOIN lf o ON o.entity = q.entity LEFT JOIN both_ ON a = q.feature AND b = o.feature)"
GATE_MIN = f"ok AS (SELECT feature, entity FROM pq GROUP BY 1, 2 HAVING coalesce(min(w) > {NEGATIVE}, true))"
GATE_HYBRID = f"""ok AS (SELECT feature, entity FROM pq GROUP BY 1, 2 HAVING max(CAST(other = feature AS INT)) = 1 OR count(*) FILTER (abs(w) > {SIGNAL}) = 0 OR coalesce(min(w) FILTER (abs(w) > {SIGNAL}) > 0.0, false)
    OR coalesce(quantile_cont(w, 0.25) FILTER (abs(w) > {SIGNAL}) > {-TAU}, false))"""


@register("rescue_distance", f"{SCORED}, {FOUND}, {PAIRED}, {GATE_MIN} SELECT id, entity FROM (SELECT id, entity, row_number() OVER (PARTITION BY id ORDER BY round(d2, 9), entity) AS k FROM fo JOIN ok USING (feature, entity)) WHERE k = 1")
def rescue_distance(spark, d):
    rule = kernels.Admission(mode="min", negative=NEGATIVE)
    return stages.rescue(_rows(spark, d), _panel(spark, d), 1.0, rule, "distance").select("id", "entity")


@register(
    "rescue_witness",
    f"""{SCORED}, {FOUND}, {PAIRED}, {GATE_HYBRID}, sz AS (SELECT label AS entity, count(*) AS s FROM pts WHERE label <> '-1' GROUP BY 1), ef AS (SELECT fo.*, least(n, 3, ceil(s / 2)) AS eff FROM fo JOIN ok USING (feature, entity) JOIN sz USING (entity))
    SELECT id, entity FROM (SELECT id, entity, row_number() OVER (PARTITION BY id ORDER BY eff DESC, round(d2, 9), entity) AS k FROM ef WHERE eff >= 1) WHERE k = 1""",
)
def rescue_witness(spark, d):
    rule = kernels.Admission(mode="hybrid", mean_threshold=-TAU, min_threshold=0.0, real_signal=SIGNAL)
    return stages.rescue(_rows(spark, d), _panel(spark, d), 1.0, rule, "witness", least=1).select("id", "entity")


@register(
    "rescue_guarded",
    f"""{SCORED}, {FOUND}, {PAIRED}, {GATE_MIN}, gd AS (SELECT id, count(*) OVER (PARTITION BY feature, floor(x / 1.0), floor(y / 1.0)) AS c FROM pts WHERE label = '-1')
    SELECT id, entity FROM (SELECT fo.id, entity, row_number() OVER (PARTITION BY fo.id ORDER BY round(d2, 9), entity) AS k FROM fo JOIN ok USING (feature, entity) JOIN gd ON gd.id = fo.id WHERE c - 1 < 2) WHERE k = 1""",
)
def rescue_guarded(spark, d):
    rule = kernels.Admission(mode="min", negative=NEGATIVE)
    return stages.rescue(_rows(spark, d), _panel(spark, d), 1.0, rule, "distance", peers=2).select("id", "entity")


LINK = "nr AS (SELECT p.id, p.feature, q.label AS entity, min(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2)) AS d2 FROM pts p JOIN pts q ON p.label = '-1' AND q.label <> '-1' AND q.x = p.x AND abs(p.y - q.y) <= 0.75 AND pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2) <= 0.5625 GROUP BY 1, 2, 3)"


@register(
    "nearest_tx_veto",
    f"""{SCORED}, {LINK}, lf AS (SELECT DISTINCT label AS entity, feature FROM pts WHERE label <> '-1'), bad AS (SELECT DISTINCT n.feature, n.entity FROM (SELECT DISTINCT feature, entity FROM nr) n JOIN lf ON lf.entity = n.entity JOIN both_ ON a = n.feature AND b = lf.feature WHERE w <= {NEGATIVE})
    SELECT id, entity FROM (SELECT nr.id, nr.entity, row_number() OVER (PARTITION BY nr.id ORDER BY round(d2, 9), nr.entity) AS k FROM nr LEFT JOIN bad USING (feature, entity) WHERE bad.feature IS NULL) WHERE k = 1""",
)
def nearest_tx_veto(spark, d):
    return stages.rescue_nearest(_rows(spark, d), _panel(spark, d), 0.75, NEGATIVE)


@register(
    "gene_compat",
    f"""{SCORED}, ce AS (SELECT label AS entity, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM pts WHERE label <> '-1' GROUP BY 1), nc AS (SELECT p.id, p.feature, c.entity, pow(p.x - c.x, 2) + pow(p.y - c.y, 2) + pow(p.z - c.z, 2) AS d2 FROM pts p JOIN ce c
      ON p.label = '-1' AND abs(p.x - c.x) <= 1.0 AND abs(p.y - c.y) <= 1.0 AND pow(p.x - c.x, 2) + pow(p.y - c.y, 2) + pow(p.z - c.z, 2) <= 1.0), lf AS (SELECT DISTINCT label AS entity, feature FROM pts WHERE label <> '-1'),
    good AS (SELECT n.feature, n.entity FROM (SELECT DISTINCT feature, entity FROM nc) n JOIN lf USING (feature, entity) UNION SELECT n.feature, n.entity FROM (SELECT DISTINCT feature, entity FROM nc) n JOIN lf ON lf.entity = n.entity JOIN both_ ON a = n.feature AND b = lf.feature WHERE w >= {TAU})
    SELECT id, entity FROM (SELECT id, entity, row_number() OVER (PARTITION BY id ORDER BY round(d2, 9), entity) AS k FROM nc JOIN good USING (feature, entity)) WHERE k = 1""",
)
def gene_compat(spark, d):
    return stages.rescue_compatible(_rows(spark, d), _panel(spark, d), 1.0, TAU)


@register(
    "auto_floor",
    f"""WITH {POINTS}, q AS (SELECT x, y FROM pts WHERE label = '-1'), o AS (SELECT min(x) AS x0, min(y) AS y0 FROM q), bc AS (SELECT floor((x - x0) / 2.0) AS bx, floor((y - y0) / 2.0) AS by_, count(*) AS n FROM q, o GROUP BY 1, 2),
    t AS (SELECT unnest(range(2, (SELECT max(n) FROM bc) + 1)) AS t), hot AS (SELECT DISTINCT t, a.bx, a.by_, a.n FROM t JOIN bc b ON b.n >= t JOIN bc a ON abs(a.bx - b.bx) <= 1 AND abs(a.by_ - b.by_) <= 1),
    cov AS (SELECT t, sum(n) / (SELECT sum(n) FROM bc) AS share FROM hot GROUP BY t) SELECT CAST(coalesce(max(t), 2) AS BIGINT) AS floor FROM cov WHERE share >= 0.65""",
)
def auto_floor(spark, d):
    return stages.auto_floor(stages.bin_counts(_rows(spark, d).where(L.is_unassigned("entity")), 2.0, from_least=True)).select(lng("floor"))


@register("shared_and_own", f"""WITH {POINTS}, a AS (SELECT cell, feature FROM pts WHERE nuclear), b AS (SELECT cell, feature FROM pts WHERE NOT nuclear)
    SELECT *, 'both' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT *, 'left' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def shared_and_own(spark, d):
    p = _points(spark, d)
    return entity.shared_and_own(p.where("nuclear").select("cell", "feature"), p.where("not nuclear").select("cell", "feature"))


@register("greedy_prune")
def greedy_prune(spark, d):
    return stages.prune(_points(spark, d), stages.Panel(_panel(spark, d)), nuclear=False, threshold=NEGATIVE / 2).select("id", "entity", "etype")


def _pruned(spark, d):
    rule = kernels.Admission(mode="mean", mean_threshold=0.0, inclusive=True)
    return stages.prune(_points(spark, d), stages.Panel(_panel(spark, d)), True, NEGATIVE / 2, 0.0, rule)


@register("nuclear_seed")
def nuclear_seed(spark, d):
    return _pruned(spark, d).select("id", "entity", "etype")


@register("reassign_partial")
def reassign_partial(spark, d):
    return stages.reassign(_pruned(spark, d), stages.Panel(_panel(spark, d)), 0.01).select("id", "entity", "etype")


@register(
    "rerank",
    f"""WITH {POINTS}, l AS (SELECT id, cell, nuclear, CASE id % 8 WHEN 1 THEN '-1' WHEN 2 THEN '-2' WHEN 3 THEN '-2-4' WHEN 4 THEN '-2-9' WHEN 5 THEN '-10' WHEN 6 THEN '-1-3' ELSE '' END AS tail FROM pts),
    n AS (SELECT *, split_part(tail, '-', 2) AS fam, split_part(tail, '-', 3) AS sub FROM l),
    f AS (SELECT cell, fam, count(*) FILTER (nuclear) AS n, count(DISTINCT sub) FILTER (sub <> '') AS subs FROM n GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER w - 1 AS rank, lead(n) OVER w AS next FROM f WINDOW w AS (PARTITION BY cell ORDER BY n DESC, fam <> '', fam)),
    t AS (SELECT cell, subs FROM k WHERE rank = 0 AND fam <> '' AND n - next >= 1),
    u AS (SELECT cell, fam, sub, row_number() OVER (PARTITION BY cell, fam ORDER BY CAST(sub AS INT)) AS turn FROM (SELECT DISTINCT cell, fam, sub FROM n WHERE sub <> ''))
    SELECT id, CASE WHEN t.cell IS NULL THEN n.cell || tail WHEN rank = 0 THEN n.cell || coalesce('-' || turn, '') ELSE n.cell || '-' || (t.subs + rank) || coalesce('-' || turn, '') END AS entity,
      CASE WHEN t.cell IS NULL THEN CASE WHEN tail = '' THEN 'cell' ELSE 'partial' END WHEN rank = 0 AND n.sub = '' THEN 'cell' ELSE 'partial' END AS etype
    FROM n JOIN k ON k.cell = n.cell AND k.fam = n.fam LEFT JOIN t ON t.cell = n.cell LEFT JOIN u ON u.cell = n.cell AND u.fam = n.fam AND u.sub = n.sub""",
)
def rerank(spark, d):
    turn = F.col("id") % 8
    tail = F.when(turn == 1, "-1").when(turn == 2, "-2").when(turn == 3, "-2-4").when(turn == 4, "-2-9").when(turn == 5, "-10").when(turn == 6, "-1-3").otherwise("")
    rows = _points(spark, d).withColumns({"entity": F.concat("cell", tail), "etype": F.when(tail == "", "cell").otherwise("partial")})
    return stages.rerank(rows).select("id", "entity", "etype")


@register("cascade")
def cascade(spark, d):
    """Over the lines returned as N; one brand in five is outside the panel."""
    known = _panel(spark, d).where(~F.col("gi").endswith("5") & ~F.col("gj").endswith("5"))
    return stages.density_cascade(_rows(spark, d), stages.Panel(known), 1.0, threshold=NEGATIVE).select("id", "entity", "etype")


@register("pipeline_seg")
def pipeline_seg(spark, d):
    return pipeline.segmented(_blocks(spark, d), _panel(spark, d), _tuned()).rows.select("id", "cell", "entity", "etype")


@register("pipeline_noseg")
def pipeline_noseg(spark, d):
    return pipeline.unsegmented(_points(spark, d).drop("label"), _panel(spark, d), _tuned(post_group_passes=5)).rows.select("id", "cell", "entity", "etype")


def _cloud(spark, d):
    e = _featured(spark, d).withColumnRenamed("entity", "cell")
    return e.withColumn("nuclear", F.col("id") % 2 == 0)


def _tuned(**rescue):
    """The defaults, with all thresholds on association a tenth of the usual ones, as it is on the driver tables."""
    from entitygraph.plans import config as C

    rules = C.RescueConfig(mean_threshold=0.05, negative=-TAU, real_signal=SIGNAL, **rescue)
    return C.PipelineConfig(
        prune=C.PruneConfig(threshold=TAU, floor=0.01, mean_threshold=TAU, negative=-TAU, real_signal=SIGNAL),
        rescue=rules,
        final_rescue=rules,
        group=C.GroupConfig(threshold=TAU),
        stitch=C.StitchConfig(tau=TAU),
        qc=C.QcConfig(coherence_tau=TAU, real_signal=SIGNAL),
    )


def _blocks(spark, d):
    """All points, with blocks of space as prior cells: customers, the cells elsewhere, are spread over all of it."""
    return _points(spark, d).drop("label").withColumn("cell", F.concat_ws("_", F.floor(F.col("x") / 4), F.floor(F.col("y") / 4), F.floor(F.col("z") / 3)))


@register("maha_remerge")
def maha_remerge(spark, d):
    rows = _cloud(spark, d).withColumns({"entity": F.col("cell"), "etype": F.lit("partial")})
    return stages.maha_remerge(rows, _panel(spark, d), 2.0, 2.0, floor=-0.5).select("id", "entity", "etype")


@register(
    "knn_split",
    f"""WITH RECURSIVE {EMB}, {OWN_KNN}, cu AS (SELECT label, quantile_cont(len, 0.9) AS cut FROM ok_ GROUP BY 1), ke AS (SELECT src, dst FROM ok_ JOIN cu USING (label) WHERE len <= cut),
    lu AS (SELECT src AS a, dst AS b FROM ke UNION SELECT dst, src FROM ke), rc AS (SELECT id AS a, id AS c FROM emb UNION SELECT lu.b, rc.c FROM rc JOIN lu ON lu.a = rc.a), cc AS (SELECT a AS id, min(c) AS component FROM rc GROUP BY 1),
    s AS (SELECT label, component, count(*) AS n FROM emb JOIN cc USING (id) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, component) AS k FROM s)
    SELECT id, CASE WHEN k = 1 THEN label ELSE label || '-' || k END AS entity FROM emb JOIN cc USING (id) JOIN k USING (label, component)""",
)
def knn_split(spark, d):
    rows = _cloud(spark, d).withColumns({"entity": F.col("cell"), "etype": F.lit("cell")})
    return stages.knn_split(rows, 3, 0.1).select("id", "entity")


@register("group_components")
def group_components(spark, d):
    rows = _cloud(spark, d).withColumns({"entity": F.lit("-1"), "etype": F.lit("unknown")})
    return stages.group_components(rows, _edges(spark, d), stages.Panel(_panel(spark, d)), 2, NEGATIVE)


@register("stitch")
def stitch(spark, d):
    """All points, as partials of square blocks cut in z, stitched along bins that meet."""
    cell = F.concat_ws("_", *(F.floor(F.col(c) / 2).cast("string") for c in "xy"))
    rows = _points(spark, d).withColumns({"entity": F.concat(cell, F.lit("-"), (F.floor(F.col("z") / 3) + 1).cast("string")), "etype": F.lit("partial")})
    rows = settle(rows.select("id", "entity", "etype", "feature", "x", "y", "z"), "blocks")
    pairs = grid.witness_pairs(grid.build_index(rows, 2.0, 3.0), "8", 1, 2).select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    return stages.stitch(rows, stages.Panel(_panel(spark, d)), settle(pairs, "pairs"))


@register("z_scale")
def z_scale(spark, d):
    return spark.createDataFrame([(stages.z_scale(_rows(spark, d)),)], "z_scale double")


# --- comparison, tiles, streams -----------------------------------------------------------------------


def _partitions(spark, d):
    return read_table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", (F.col("o_custkey") % 7).cast("string").alias("tile"))


CT = "ct AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2), st AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS s_ab FROM ct), sa AS (SELECT sum(m * (m - 1) / 2) AS s_a FROM (SELECT sum(n) AS m FROM ct GROUP BY a)), sb AS (SELECT sum(m * (m - 1) / 2) AS s_b FROM (SELECT sum(n) AS m FROM ct GROUP BY b))"


@register(
    "rand_indices",
    f"""WITH {CT}, v AS (SELECT CAST(n AS DOUBLE) * (n - 1) / 2 AS t, s_ab, s_a, s_b FROM st, sa, sb) SELECT {r("(t + 2 * s_ab - s_a - s_b) / t")} AS rand_index,
    {r("(s_ab - s_a * s_b / t) / ((s_a + s_b) / 2 - s_a * s_b / t)")} AS adjusted_rand_index, {r("s_ab / sqrt(s_a * s_b)")} AS fowlkes_mallows FROM v""",
)
def rand_indices(spark, d):
    t = compare.rand_indices(compare.contingency(_partitions(spark, d), "o_orderstatus", "o_orderpriority"))
    return t.select(*(rnd(c, c) for c in ("rand_index", "adjusted_rand_index", "fowlkes_mallows")))


@register(
    "nmi_v_measure",
    f"""WITH {CT}, t AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM ct), ma AS (SELECT a, CAST(sum(n) AS DOUBLE) AS m FROM ct GROUP BY 1), mb AS (SELECT b, CAST(sum(n) AS DOUBLE) AS m FROM ct GROUP BY 1),
    v AS (SELECT (SELECT sum(n / t * ln(n * t / (ma.m * mb.m))) FROM ct JOIN ma USING (a) JOIN mb USING (b), t) AS mi, (SELECT sum(-m / t * ln(m / t)) FROM ma, t) AS ha, (SELECT sum(-m / t * ln(m / t)) FROM mb, t) AS hb)
    SELECT {r("mi")} AS mi, {r("2 * mi / (ha + hb)")} AS nmi, {r("mi / ha")} AS homogeneity, {r("mi / hb")} AS completeness, {r("2 * (mi / ha) * (mi / hb) / (mi / ha + mi / hb)")} AS v_measure FROM v""",
)
def nmi_v_measure(spark, d):
    t = compare.information(compare.contingency(_partitions(spark, d), "o_orderstatus", "o_orderpriority"))
    return t.select(*(rnd(c, c) for c in ("mi", "nmi", "homogeneity", "completeness", "v_measure")))


# The expected information of random partitions with the same sizes, by the hypergeometric law of each pair of classes.
@register(
    "adjusted_information",
    f"""WITH {CT}, t AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM ct), ma AS (SELECT a, CAST(sum(n) AS DOUBLE) AS m FROM ct GROUP BY 1), mb AS (SELECT b, CAST(sum(n) AS DOUBLE) AS m FROM ct GROUP BY 1),
    x AS (SELECT ma.m AS x, mb.m AS y, t, CAST(unnest(range(CAST(greatest(1, ma.m + mb.m - t) AS BIGINT), CAST(least(ma.m, mb.m) AS BIGINT) + 1)) AS DOUBLE) AS k FROM ma, mb, t),
    e AS (SELECT sum(k / t * ln(t * k / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(t - x + 1) + lgamma(t - y + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(x - k + 1) - lgamma(y - k + 1) - lgamma(t - x - y + k + 1))) AS emi FROM x),
    v AS (SELECT (SELECT sum(n / t * ln(n * t / (ma.m * mb.m))) FROM ct JOIN ma USING (a) JOIN mb USING (b), t) AS mi, (SELECT sum(-m / t * ln(m / t)) FROM ma, t) AS ha, (SELECT sum(-m / t * ln(m / t)) FROM mb, t) AS hb)
    SELECT round((mi - emi) / ((ha + hb) / 2 - emi), 6) AS ami FROM v, e""",
)
def adjusted_information(spark, d):
    v = compare.adjusted_information(compare.contingency(_partitions(spark, d), "o_orderstatus", "o_orderpriority"))
    return spark.createDataFrame([(round(v, 6),)], "ami double")


@register(
    "unassigned_encodings",
    f"""WITH {POINTS} SELECT count(DISTINCT CASE WHEN label = '-1' THEN 'UNASSIGNED' ELSE label END) AS mega, count(DISTINCT CASE WHEN label = '-1' THEN 'UNASSIGNED#' || id ELSE label END) AS single,
    count(DISTINCT CASE WHEN label <> '-1' THEN label END) AS dropped FROM pts""",
)
def unassigned_encodings(spark, d):
    code = lambda how: F.countDistinct(compare.encode_unassigned("label", "id", how))
    return _points(spark, d).agg(code("mega").alias("mega"), code("single").alias("single"), code("drop").alias("dropped"))


@register("principal_components")
def principal_components(spark, d):
    return compare.principal_components(compare.normalized_log(assoc.feature_counts(_points(spark, d))), 3)


@register("dominant_purity", f"WITH {CT} SELECT {r('(SELECT sum(m) FROM (SELECT max(n) AS m FROM ct GROUP BY a)) / (SELECT sum(n) FROM ct)')} AS purity")
def dominant_purity(spark, d):
    return compare.dominant_purity(compare.contingency(_partitions(spark, d), "o_orderstatus", "o_orderpriority")).select(rnd("purity", "purity"))


def pair_sql(keys: str) -> str:
    return f"(SELECT CAST(sum(m * (m - 1) / 2) AS BIGINT) FROM (SELECT count(*) AS m FROM q GROUP BY {keys}))"


@register(
    "pair_class",
    "WITH q AS (SELECT o_orderstatus AS a, o_orderpriority AS b, o_custkey % 7 AS t FROM orders) SELECT "
    + ", ".join(f"{pair_sql(k + ', t')} AS {n}_same_tile, {pair_sql(k)} - {pair_sql(k + ', t')} AS {n}_cross_tile" for n, k in (("a", "a"), ("b", "b"), ("ab", "a, b"))),
)
def pair_class(spark, d):
    return compare.pair_classes(_partitions(spark, d), "o_orderstatus", "o_orderpriority", "tile")


@register(
    "coverage",
    f"""WITH {POINTS}, c AS (SELECT 100.0 * avg(CASE WHEN label <> '-1' THEN 1 ELSE 0 END) AS p, count(DISTINCT cell) AS b, count(DISTINCT CASE WHEN label <> '-1' THEN label END) AS a FROM pts)
    SELECT {r("p")} AS coverage_pct, b AS n_cells_before, a AS n_cells_after, {r("100.0 * a / b")} AS retention_pct, b - a AS cells_lost FROM c""",
)
def coverage(spark, d):
    return compare.coverage(_points(spark, d), "cell", "label").select(rnd("coverage_pct", "coverage_pct"), "n_cells_before", "n_cells_after", rnd("retention_pct", "retention_pct"), "cells_lost")


@register(
    "metrics_summary",
    f"""{SCORED}, {SETS}, {SP}, {AGG}, q AS (SELECT n_pos / n_pairs AS purity, neg_abs / n_pairs AS conflict FROM sc WHERE n_pairs > 0)
    SELECT 'driver' AS dataset, 'purity' AS metric, {r("avg(purity)")} AS mean, {r("quantile_cont(purity, 0.8)")} AS p80, {r("quantile_cont(purity, 0.95)")} AS p95 FROM q
    UNION ALL SELECT 'driver', 'conflict', {r("avg(conflict)")}, {r("quantile_cont(conflict, 0.8)")}, {r("quantile_cont(conflict, 0.95)")} FROM q""",
)
def metrics_summary(spark, d):
    s = compare.summary(entity.purity_conflict(_aggregate(spark, d)).where("n_pairs > 0"), ["purity", "conflict"], "driver")
    return s.select("dataset", "metric", *(rnd(c, c) for c in ("mean", "p80", "p95")))


COUNTS = "x AS (SELECT cell, feature, count(*) AS n FROM pts GROUP BY 1, 2), t AS (SELECT cell, sum(n) AS t FROM x GROUP BY 1)"


@register(
    "rank_markers",
    f"""WITH {POINTS}, g AS (SELECT CAST(c_custkey AS VARCHAR) AS cell, c_mktsegment AS grp FROM customer WHERE CAST(c_custkey AS VARCHAR) IN (SELECT cell FROM pts)), k AS (SELECT cell, feature, count(*) AS v FROM pts GROUP BY 1, 2),
    d AS (SELECT g.cell, g.grp, f.feature, coalesce(v, 0) AS v FROM g CROSS JOIN (SELECT DISTINCT feature FROM pts) f LEFT JOIN k ON k.cell = g.cell AND k.feature = f.feature),
    r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2 AS r, count(*) OVER (PARTITION BY feature, v) AS t, count(*) OVER (PARTITION BY feature) AS n FROM d),
    q AS (SELECT feature, sum(CAST(t AS DOUBLE) * t - 1) AS ties, sum(v) AS s, sum((v > 0)::INT) AS st FROM r GROUP BY 1),
    o AS (SELECT grp, feature, count(*) AS n1, sum(r) AS r, any_value(n) AS n, sum(v) AS s1, sum((v > 0)::INT) AS k1 FROM r GROUP BY 1, 2)
    SELECT grp, feature, {r("(r - n1 * (n + 1) / 2) / sqrt(CAST(n1 AS DOUBLE) * (n - n1) / 12 * (n + 1 - ties / (CAST(n AS DOUBLE) * (n - 1))))")} AS score,
      {r("log2((exp(s1 / n1) - 1 + 1e-9) / (exp((s - s1) / (n - n1)) - 1 + 1e-9))")} AS log_fold, {r("k1 / n1")} AS share_in, {r("(st - k1) / (n - n1)")} AS share_out FROM o JOIN q USING (feature)""",
)
def rank_markers(spark, d):
    """Brands that mark the customers of a market segment, by their numbers of lines."""
    counts = assoc.feature_counts(_points(spark, d)).withColumnRenamed("n", "value")
    groups = read_table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("cell"), F.col("c_mktsegment").alias("grp"))
    groups = groups.join(counts.select("cell").distinct(), "cell", "left_semi")
    found = compare.rank_markers(counts, groups, tie_correct=True)
    return found.select("grp", "feature", *(rnd(c, c) for c in ("score", "log_fold", "share_in", "share_out")))


@register("pair_permutation")
def pair_permutation(spark, d):
    """Pairs of brands between market segments, by their numbers of lines per customer."""
    counts = assoc.feature_counts(_points(spark, d)).withColumnRenamed("n", "value")
    groups = read_table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("cell"), F.col("c_mktsegment").alias("grp"))
    pairs = _panel(spark, d).select(F.col("gi").alias("a"), F.col("gj").alias("b"))
    return permutation.permutation_test(counts, groups.join(counts.select("cell").distinct(), "cell", "left_semi"), pairs)


@register("normalized_log", f"WITH {POINTS}, {COUNTS} SELECT cell, feature, {r('ln(1 + n / t * 10000.0)')} AS value FROM x JOIN t USING (cell)")
def normalized_log(spark, d):
    return compare.normalized_log(assoc.feature_counts(_points(spark, d))).select("cell", "feature", rnd("value", "value"))


@register("hellinger", f"WITH {POINTS}, {COUNTS} SELECT cell, feature, {r('sqrt(n / t)')} AS value FROM x JOIN t USING (cell)")
def hellinger(spark, d):
    return compare.hellinger(assoc.feature_counts(_points(spark, d))).select("cell", "feature", rnd("value", "value"))


@register(
    "pearson_residuals",
    f"""WITH {POINTS}, {COUNTS}, g AS (SELECT feature, sum(n) AS g FROM x GROUP BY 1), al AS (SELECT sum(n) AS s, count(DISTINCT cell) AS m FROM x), v AS (SELECT cell, feature, n, CAST(t AS DOUBLE) * g / s AS mu, m FROM x JOIN t USING (cell) JOIN g USING (feature), al)
    SELECT cell, feature, {r("greatest(least((n - mu) / sqrt(mu + mu * mu / 100.0), sqrt(m)), -sqrt(m))")} AS value FROM v""",
)
def pearson_residuals(spark, d):
    return compare.pearson_residuals(assoc.feature_counts(_points(spark, d))).select("cell", "feature", rnd("value", "value"))


TILE = """c AS (SELECT cell AS entity, avg(x) AS x, avg(y) AS y FROM pts GROUP BY 1), bx AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM c),
  ti AS (SELECT entity, CAST(least(floor((y - y0) / (y1 - y0) * 2), 1) * 3 + least(floor((x - x0) / (x1 - x0) * 3), 2) AS INT) AS tile FROM c, bx)"""


@register("tile_assign", f"WITH {POINTS}, {TILE} SELECT entity, tile FROM ti")
def tile_assign(spark, d):
    return tiling.tile_assign(tiling.centroids(_points(spark, d)), 3, 2).select("entity", "tile")


@register("chunk_summary", f"WITH {POINTS}, {TILE} SELECT tile AS part, count(*) AS n_points, count(DISTINCT cell) AS n_cells FROM pts JOIN ti ON entity = cell GROUP BY 1")
def chunk_summary(spark, d):
    p = _points(spark, d)
    parted = settle(tiling.tile_assign(tiling.centroids(p), 3, 2).select("entity", "x", "y", F.col("tile").alias("part")), "parted")
    return tiling.chunk_summary(tiling.chunk_points(p.select("id", "cell", "x", "y"), parted))


ZBITS = " + ".join(f"(((sx >> {k}) & 1) << {2 * k}) + (((sy >> {k}) & 1) << {2 * k + 1})" for k in range(10))


@register(
    "balanced_partition",
    f"""WITH {POINTS}, c AS (SELECT cell AS entity, avg(x) AS x, avg(y) AS y FROM pts GROUP BY 1), b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM c),
    s AS (SELECT entity, CAST(least(floor((x - x0) / (x1 - x0) * 1024), 1023) AS BIGINT) AS sx, CAST(least(floor((y - y0) / (y1 - y0) * 1024), 1023) AS BIGINT) AS sy FROM c, b),
    o AS (SELECT entity, row_number() OVER (ORDER BY {ZBITS}, entity) - 1 AS r, count(*) OVER () AS n FROM s) SELECT entity, CAST(r * 8 // n AS INT) AS part FROM o""",
)
def balanced_partition(spark, d):
    return tiling.balanced_partition(tiling.centroids(_points(spark, d)), 8).select("entity", "part")


@register("min_cut_partition")
def min_cut_partition(spark, d):
    """Blocks of space in eight parts that cut little of the weight between them, the points that meet in neighbouring bins."""
    rows = settle(_blocks(spark, d).select("id", F.col("cell").alias("entity"), "x", "y", "z"), "blocks")
    edges = grid.witness_pairs(grid.build_index(rows, 1.0), "8").select(F.col("lo").alias("src"), F.col("hi").alias("dst"), F.col("n_records").alias("w"))
    return cuts.min_cut_partition(tiling.centroids(rows, "entity"), edges, 8).select("entity", "part")


# Empty bins that the rim of an entity's box does not reach are enclosed.
@register("footprint", f"""WITH RECURSIVE {EMB}, b AS (SELECT DISTINCT label AS entity, CAST(floor(x / 1.0) AS INT) AS bx, CAST(floor(y / 1.0) AS INT) AS by_ FROM emb), o AS (SELECT * FROM (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) v(dx, dy)),
    e AS (SELECT entity, min(bx) - 1 AS x0, max(bx) + 1 AS x1, min(by_) - 1 AS y0, max(by_) + 1 AS y1 FROM b GROUP BY 1),
    a AS (SELECT entity, x0, x1, y0, y1, bx, unnest(range(y0, y1 + 1)) AS by_ FROM (SELECT *, unnest(range(x0, x1 + 1)) AS bx FROM e)),
    f AS (SELECT a.* FROM a LEFT JOIN b USING (entity, bx, by_) WHERE b.entity IS NULL),
    t AS (SELECT entity, bx, by_ FROM f WHERE bx IN (x0, x1) OR by_ IN (y0, y1) UNION SELECT f.entity, f.bx, f.by_ FROM t, o, f WHERE f.entity = t.entity AND f.bx = t.bx + dx AND f.by_ = t.by_ + dy)
    SELECT entity, CAST(bx AS INT) AS bx, CAST(by_ AS INT) AS "by" FROM a LEFT JOIN t USING (entity, bx, by_) WHERE t.entity IS NULL""")
def footprint(spark, d):
    return footprints.footprint(_emb(spark, d), 1.0)


# Parts by reach over sides; links join the tree's parts and the rest by the smallest (d, lo, hi), one part a turn;
# lines step along the longer axis; then empty bins that the rim does not reach are holes.
@register("footprint_density", f"""WITH RECURSIVE {POINTS}, b AS (SELECT cell AS entity, CAST(floor(x / 8.0) AS INT) AS bx, CAST(floor(y / 8.0) AS INT) AS by_, count(*) AS n FROM pts GROUP BY ALL),
    o AS (SELECT * FROM (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) v(dx, dy)),
    rc AS (SELECT entity, bx, by_, bx AS px, by_ AS py FROM b UNION SELECT b.entity, b.bx, b.by_, px, py FROM rc, o, b WHERE b.entity = rc.entity AND b.bx = rc.bx + dx AND b.by_ = rc.by_ + dy),
    p AS (SELECT entity, bx, by_, min(px * 1000 + py) AS part FROM rc GROUP BY 1, 2, 3),
    pe AS (SELECT u.entity, u.part AS pa, v.part AS pb, abs(u.bx - v.bx) + abs(u.by_ - v.by_) AS d, u.bx AS lx, u.by_ AS ly, v.bx AS hx, v.by_ AS hy
      FROM p u JOIN p v ON u.entity = v.entity AND u.part <> v.part AND (u.bx, u.by_) < (v.bx, v.by_)),
    tree AS (SELECT entity, [min(part)] AS inside, NULL::STRUCT(d INT, lx INT, ly INT, hx INT, hy INT, pa BIGINT, pb BIGINT) AS e FROM p GROUP BY 1 UNION ALL
      SELECT entity, list_append(inside, CASE WHEN list_contains(inside, e.pa) THEN e.pb ELSE e.pa END), e
      FROM (SELECT t.entity, t.inside, min(struct_pack(d := d, lx := lx, ly := ly, hx := hx, hy := hy, pa := pa, pb := pb)) AS e
        FROM tree t JOIN pe ON pe.entity = t.entity AND list_contains(inside, pa) <> list_contains(inside, pb) GROUP BY 1, 2)),
    l AS (SELECT entity, e.lx AS lx, e.ly AS ly, e.hx - e.lx AS dx, e.hy - e.ly AS dy, greatest(abs(e.hx - e.lx), abs(e.hy - e.ly)) AS n, least(abs(e.hx - e.lx), abs(e.hy - e.ly)) AS m FROM tree WHERE e IS NOT NULL),
    k AS (SELECT *, unnest(range(0, n + 1)) AS k FROM l), ln AS (SELECT *, CAST(ceil((2 * k * m - n) / (2.0 * n)) AS INT) AS s FROM k),
    br AS (SELECT DISTINCT entity, CAST(lx + sign(dx) * CASE WHEN abs(dx) = n THEN k ELSE s END AS INT) AS bx, CAST(ly + sign(dy) * CASE WHEN abs(dy) = n THEN k ELSE s END AS INT) AS by_ FROM ln),
    w AS (SELECT entity, bx, by_, 'raw' AS kind FROM b UNION ALL SELECT br.*, 'bridge' FROM br ANTI JOIN b USING (entity, bx, by_)),
    ex AS (SELECT entity, min(bx) - 1 AS x0, max(bx) + 1 AS x1, min(by_) - 1 AS y0, max(by_) + 1 AS y1 FROM w GROUP BY 1),
    a AS (SELECT entity, x0, x1, y0, y1, bx, unnest(range(y0, y1 + 1)) AS by_ FROM (SELECT *, unnest(range(x0, x1 + 1)) AS bx FROM ex)),
    f AS (SELECT a.* FROM a ANTI JOIN w USING (entity, bx, by_)),
    t AS (SELECT entity, bx, by_ FROM f WHERE bx IN (x0, x1) OR by_ IN (y0, y1) UNION SELECT f.entity, f.bx, f.by_ FROM t, o, f WHERE f.entity = t.entity AND f.bx = t.bx + dx AND f.by_ = t.by_ + dy),
    h AS (SELECT entity, count(*) AS n_hole FROM f ANTI JOIN t USING (entity, bx, by_) GROUP BY 1),
    q AS (SELECT entity, sum(n) AS n_points, count(*) AS n_raw FROM b GROUP BY 1), g AS (SELECT entity, count(*) AS n_bridge FROM w WHERE kind = 'bridge' GROUP BY 1)
    SELECT entity, CAST(n_points AS BIGINT) AS n_points, n_raw, coalesce(n_bridge, 0) AS n_bridge, coalesce(n_hole, 0) AS n_hole, n_raw + coalesce(n_bridge, 0) + coalesce(n_hole, 0) AS n_filled,
      {r("n_points / (n_raw + coalesce(n_bridge, 0) + coalesce(n_hole, 0))")} AS density FROM q LEFT JOIN g USING (entity) LEFT JOIN h USING (entity)""")
def footprint_density(spark, d):
    s = footprints.footprint_density(_points(spark, d), 8.0, "cell")
    return s.select("entity", "n_points", "n_raw", "n_bridge", "n_hole", "n_filled", rnd("density", "density"))


@register("event_pairs", """WITH c AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS w, user_id AS u, event_type AS f FROM events GROUP BY ALL)
    SELECT strftime(a.w, '%Y-%m-%d') AS day, a.f AS gi, b.f AS gj, count(*) AS k_ij FROM c a JOIN c b ON a.w = b.w AND a.u = b.u AND a.f < b.f GROUP BY ALL""")
def event_pairs(spark, d):
    counts = cooccurrence.feature_counts(read_table(spark, d, "events"), window="1 day")
    return cooccurrence.window_pairs(counts).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "gi", "gj", "k_ij")
