"""Quality rules as a ledger of failure bits and measurements.

Every rule is evaluated once per document; the ledger keeps one bit per failed
rule beside the measurements.  A policy is a versioned mask: a document fails a
policy when ``failures & mask`` is not zero.  Ablations come from the counts of
each failure mask by bitwise aggregation, without reading texts again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitygraph.llm.common import small_batches, texts_of
from entitygraph.llm.doc_stats import MEASURES, measure

#: name -> the failing condition over the measurements, in the order of the bits.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "n_lines >= 4 and 100 * n_dup_lines > 40 * n_lines",
    "shouting": "100 * n_shout_words > 50 * n_words",
    "stutter": "100 * n_stutters > 25 * n_words",
    "long_words": "word_chars > 25 * n_words",
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}


def mask_of(*names: str) -> int:
    return sum(BIT[n] for n in names)


BASE = mask_of("few_words", "repeated_windows")
#: Versioned policies.  Version 2 adds to the base; long_words is recorded but no policy rejects by it, as
#: clean text of scripts without spaces has long "words".
POLICIES: dict[str, int] = {
    "base": BASE,
    "2": BASE | mask_of("symbols", "repeated_lines", "shouting", "stutter"),
}
CURRENT = "2"


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, all measurements (long) and ``failures`` (long, one bit a rule).

    A null or empty text has no words, so it fails ``few_words`` alone.  Texts are
    measured whole, each row on its own: ties and repeated rows give repeated
    results and an empty table an empty ledger; other columns are not read.
    """
    small_batches(docs.sparkSession)
    source = docs.select(*keep, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema) + "".join(f", {m} bigint" for m in MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t) for t in texts_of(batch, text)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *(pa.array(c, pa.int64()) for c in columns)], names=[*keep, *MEASURES])

    bits = sum((F.when(F.expr(rule), F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")) for name, rule in RULES.items()), F.lit(0).cast("long"))
    return source.mapInArrow(run, schema).withColumn("failures", bits)


def passes(policy: str = CURRENT, failures: str = "failures") -> Column:
    """Whether a row of the ledger passes a policy."""
    return F.col(failures).bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def ablations(found: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For every rule of a policy: documents that fail it, and those that would pass the policy without it.

    The ledger is first counted by failure mask, at most 2^rules rows.
    """
    mask = POLICIES[policy]
    counts = found.groupBy("failures").agg(F.count("*").alias("n"))
    rules = found.sparkSession.createDataFrame([(name, BIT[name], mask & ~BIT[name]) for name in RULES if BIT[name] & mask], "rule string, bit long, rest long")
    failed = F.col("failures").bitwiseAND(F.col("bit")) != 0
    return (
        counts.join(F.broadcast(rules), F.lit(True))
        .groupBy("rule")
        .agg(F.coalesce(F.sum(F.when(failed, F.col("n"))), F.lit(0)).alias("n_failed"), F.coalesce(F.sum(F.when(failed & (F.col("failures").bitwiseAND(F.col("rest")) == 0), F.col("n"))), F.lit(0)).alias("n_failed_alone"))
    )


#: The ledger's verdicts in DuckDB SQL.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
x AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT r, i, w, lag(w) OVER p AS before,
        CASE WHEN lead(w, 7) OVER p IS NOT NULL THEN concat_ws(' ', w, lead(w, 1) OVER p, lead(w, 2) OVER p, lead(w, 3) OVER p,
          lead(w, 4) OVER p, lead(w, 5) OVER p, lead(w, 6) OVER p, lead(w, 7) OVER p) END AS win
      FROM x WINDOW p AS (PARTITION BY r ORDER BY i)),
o AS (SELECT r, i, w, before, win IS NOT NULL AND count(*) OVER (PARTITION BY r, win) > 1 AS often FROM g),
c AS (SELECT r, i, w, before, max(CASE WHEN often THEN i ELSE -100 END) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS last FROM o),
s AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (i - last <= 7) AS n_repeat_words,
        count(*) FILTER (w = before) AS n_stutters, count(*) FILTER (regexp_full_match(w, '[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*')) AS n_shout
      FROM c GROUP BY r),
l AS (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY i) AS k
      FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
m AS (SELECT r, count(*) AS n_lines, count(*) FILTER (k > 1) AS n_dup_lines FROM l GROUP BY r),
a AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_stutters, 0) AS n_stutters,
        coalesce(n_shout, 0) AS n_shout
      FROM d LEFT JOIN s USING (r) LEFT JOIN m USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words OR (n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines)
    OR 100 * n_shout > 50 * n_words OR 100 * n_stutters > 25 * n_words) AS kept,
  CAST(CAST(n_words < 20 AS INT) + 2 * CAST(100 * n_repeat_words > 30 * n_words AS INT) + 4 * CAST(10 * n_symbols > n_words AS INT)
    + 8 * CAST(n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines AS INT) + 16 * CAST(100 * n_shout > 50 * n_words AS INT)
    + 32 * CAST(100 * n_stutters > 25 * n_words AS INT) + 64 * CAST(word_chars > 25 * n_words AS INT) AS BIGINT) AS failures, '2' AS policy
FROM a
"""
