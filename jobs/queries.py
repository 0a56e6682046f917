"""The jobs as registered queries: run twice into one new folder, then read back; and their SQL."""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from entitygraph.functions.storage import shared_folder
from entitygraph.plans.queries import AGG, SCORED, SETS, SP, r
from jobs import cell_report, word_panel


def job1_word_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = f"{shared_folder(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        word_panel.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", f"{place}/out", f"{place}/checkpoint")
    return spark.read.parquet(f"{place}/out/panel")


def job2_cell_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = f"{shared_folder(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        cell_report.run(spark, sf_dir, place)
    columns = "entity string, n_points long, n_features long, x double, y double, purity double, conflict double, band string, tile string"
    return spark.read.schema(columns).parquet(f"{place}/cells")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_word_panel": job1_word_panel, "job2_cell_report": job2_cell_report}

W, C = word_panel.DEFAULTS, cell_report.DEFAULTS
_WORDS = f"list_distinct(regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{word_panel.WORDS}'))"
_PMI = "ln((k_ij::double / n) / ((k_i::double / n) * (k_j::double / n)))"

SQL: dict[str, str] = {
    "job1_word_panel": f"""WITH bw AS (SELECT unnest({_WORDS}) AS w FROM benchmark), vocab AS (SELECT w FROM bw WHERE length(w) >= {W["least_chars"]} GROUP BY w ORDER BY count(*) DESC, w LIMIT {W["vocabulary_size"]}),
      d AS (SELECT row_number() OVER () AS r, text FROM documents), dw AS (SELECT r, unnest({_WORDS}) AS w FROM d), p AS (SELECT r, w FROM dw SEMI JOIN vocab USING (w)),
      k AS (SELECT w, count(*) AS k FROM p GROUP BY w), u AS (SELECT count(DISTINCT r) AS n FROM p), co AS (SELECT a.w AS gi, b.w AS gj, count(*) AS c FROM p a JOIN p b ON a.r = b.r AND a.w < b.w GROUP BY 1, 2),
      t AS (SELECT a.w AS gi, b.w AS gj, coalesce(c, 0) AS k_ij, a.k AS k_i, b.k AS k_j, n FROM k a JOIN k b ON a.w < b.w CROSS JOIN u LEFT JOIN co ON co.gi = a.w AND co.gj = b.w),
      e AS (SELECT *, k_i::double * k_j / n AS expected, CASE WHEN k_ij > 0 THEN {_PMI} END AS pmi, CASE WHEN k_ij > 0 THEN {_PMI} / -ln(k_ij::double / n) ELSE -1.0 END AS npmi FROM t)
      SELECT gi, gj, k_ij, k_i, k_j, n, {r("pmi")} AS pmi, {r("npmi")} AS npmi, {r("expected")} AS expected,
        CASE WHEN k_ij = 0 THEN 'neg_one' WHEN greatest(k_ij, expected) >= {W["evidence"]} THEN 'bootstrap' ELSE 'low_evidence' END AS tier
      FROM e WHERE k_ij > 0 OR expected >= {W["evidence"]}""",
    "job2_cell_report": f"""{SCORED}, {SETS}, {SP}, {AGG},
      s AS (SELECT entity, k AS n_features, {r("CASE WHEN n_pairs > 0 THEN n_pos / n_pairs END")} AS purity, {r("CASE WHEN n_pairs > 0 THEN neg_abs / n_pairs END")} AS conflict FROM sc),
      e AS (SELECT cell AS entity, count(*) AS n_points, {r("avg(x)")} AS x, {r("avg(y)")} AS y FROM pts GROUP BY 1)
      SELECT entity, n_points, n_features, x, y, purity, conflict, CASE WHEN n_points < {C["least_points"]} THEN 'small' WHEN conflict >= {C["conflict_from"]} THEN 'conflicted' WHEN purity >= {C["pure_from"]} THEN 'pure' ELSE 'mixed' END AS band,
        concat_ws(':', floor(x / {C["tile"]})::bigint, floor(y / {C["tile"]})::bigint) AS tile FROM s JOIN e USING (entity)""",
}
