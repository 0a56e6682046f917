"""Line dedup by content-defined chunks of lines, in DataFrame operations only.

A rolling hash over the hashes of neighbouring lines chooses chunk boundaries, so
that inserted or deleted lines shift no boundary elsewhere.  Chunks of several lines that
occur again anywhere are removed after a comparison of their bytes; the first
occurrence, by document and place, stays.

A chunk hangs on the lines before it, so a repeated passage is found by chunks in part
only.  Passages mend that: every repeated run of lines of ``PASSAGE_WORDS`` words or more is
removed whole, to its ends.  Such a run is covered by the shortest runs of so many words that
begin or end at its lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from entitygraph.llm.common import WORD_PATTERN, broadcast_if_small, fresh, settle

#: A boundary follows one line in so many on average.
SPREAD = 3
#: Words from which a repeated run of lines is a passage.
PASSAGE_WORDS = 50
#: Hexadecimal digits of a line's MD5 that make its hash.
DIGITS = 7
#: Rows (about 40 bytes each) up to which what is to be removed is broadcast to the documents.
BROADCAST_ROWS = 500_000
#: What a span is: a chunk, or a window of a passage.
CHUNK, PASSAGE = 0, 1


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(_id, _th, pos, h, x, w) of every line: two hashes and its words, dealt by document."""
    lines = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_id"), F.xxhash64(text).alias("_th"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    lines = lines.select("_id", "_th", "pos", F.md5(F.col("line").cast("binary")).alias("m"), F.regexp_count("line", F.lit(WORD_PATTERN)).alias("w"))
    lines = lines.select("_id", "_th", "pos", F.conv(F.substring("m", 1, DIGITS), 16, 10).cast("long").alias("h"), F.xxhash64("m").alias("x"), "w")
    # Repeated rows count as one document.
    return lines.repartition("_id", "_th").dropDuplicates(["_id", "_th", "pos"])


def chunks(lines: DataFrame) -> DataFrame:
    """(_id, _th, start, n_lines, hash) of every chunk of several lines; start counts lines from 0. No texts are moved."""
    order = Window.partitionBy("_id", "_th").orderBy("pos")
    roll = F.coalesce(F.lag("h", 2).over(order), F.lit(0)) + 7 * F.lag("h").over(order)
    starts = (F.col("pos") == 0) | (F.pmod(roll, F.lit(SPREAD)) == 0)
    marked = lines.withColumn("first", F.coalesce(starts, F.lit(True)).cast("int"))
    marked = marked.withColumn("chunk", F.sum("first").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.withColumn("k", F.row_number().over(Window.partitionBy("_id", "_th", "chunk").orderBy("pos")))
    found = marked.groupBy("_id", "_th", "chunk").agg(F.min("pos").alias("start"), F.count("*").cast("int").alias("n_lines"), F.sum("w").alias("words"), F.bit_xor(F.xxhash64("x", "k")).alias("hash"))
    return found.where((F.col("words") > 0) & (F.col("n_lines") > 1)).select("_id", "_th", "start", "n_lines", "hash")


def windows(lines: DataFrame, words: int = PASSAGE_WORDS) -> DataFrame:
    """(_id, _th, start, n_lines, hash) of the shortest runs of ``words`` words from each line on and up to each line.

    They begin and end with lines that have words, so at most ``words`` of either kind hold a line.
    """
    lines = lines.withColumns({"full": F.col("w") > 0, "x": F.col("x").bitwiseXOR(F.col("h"))})
    order = Window.partitionBy("_id", "_th").orderBy("pos")
    # Lines without words go with the next line that has some.
    r = lines.withColumn("r", F.coalesce(F.sum(F.col("full").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    r = r.withColumn("k", F.row_number().over(Window.partitionBy("_id", "_th", "r").orderBy("pos")))
    blank = F.coalesce(F.bit_xor(F.when(~F.col("full"), F.xxhash64("x", "k"))), F.lit(0))
    r = r.groupBy("_id", "_th", "r").agg(F.max("pos").alias("pos"), F.sum("w").alias("w"), F.bit_xor(F.when(F.col("full"), F.col("x"))).alias("x"), F.xxhash64(blank, F.count("*")).alias("gap")).where("w > 0")
    r = r.withColumns({"xg": F.xxhash64("x", "gap"), "till": F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))}).withColumn("ahead", F.col("till") - F.col("w"))
    on = Window.partitionBy("_id", "_th").orderBy("ahead").rangeBetween(0, words - 1)
    up = Window.partitionBy("_id", "_th").orderBy("till").rangeBetween(-(words - 1), 0)
    run = lambda f, start, end, x: F.struct(F.sum("w").over(f).alias("words"), start.alias("start"), (end - start + 1).cast("int").alias("n_lines"), x.alias("x"), F.collect_list("xg").over(f).alias("xs"))
    r = r.withColumn("_on", run(on, F.col("pos"), F.last("pos").over(on), F.col("x"))).withColumn("_up", run(up, F.first("pos").over(up), F.col("pos"), F.first("x").over(up)))
    # A run up to a line that is also the shortest one from its first line on is there already.
    both = F.array(F.col("_on"), F.when(F.col("_up.words") - F.col("w") >= words, F.col("_up")))
    found = r.select("_id", "_th", F.explode(both).alias("o")).where(F.col("o.words") >= words)
    return found.select("_id", "_th", "o.start", "o.n_lines", F.xxhash64("o.x", F.slice("o.xs", F.lit(2), F.greatest(F.size("o.xs") - 1, F.lit(0)))).alias("hash"))


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", passage: int | None = PASSAGE_WORDS) -> DataFrame:
    """(kind, _id, _th, start, n_lines) of what to remove: chunks, and passages of ``passage`` words that don't touch their origin.

    Lines without words at the ends of a passage stay.  Aggregates are written before they are
    joined back, so that a chunk in a third of all documents is split by the skew join.
    """
    lines = lines_of(docs, key, text)
    found = chunks(lines).withColumn("kind", F.lit(CHUNK))
    if passage is not None:
        found = found.unionByName(windows(lines, passage).withColumn("kind", F.lit(PASSAGE)))
    found = settle(found, "found", compact=True)
    place, same = F.struct("_id", "_th", "start"), ["kind", "hash", "n_lines"]
    often = settle(found.groupBy(*same).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").drop("last"), "often", compact=True)
    again = found.join(often, same).where(place != F.col("first"))
    again = again.select("kind", "_id", "_th", "start", "n_lines", F.col("first._id").alias("_oid"), F.col("first._th").alias("_oth"), (F.col("start") - F.col("first.start")).alias("shift"))
    apart = (F.col("kind") == CHUNK) | (F.col("_id") != F.col("_oid")) | (F.col("_th") != F.col("_oth")) | (F.col("shift") >= F.col("n_lines"))
    # Windows that repeat the same lines in a row are one run; chunks stay for themselves.
    again = settle(again.where(apart), "again", compact=True)
    runs = joined(again.where(F.col("kind") == PASSAGE), ["_id", "_th", "_oid", "_oth", "shift"]).withColumn("kind", F.lit(PASSAGE))
    runs = settle(runs.unionByName(again.where(F.col("kind") == CHUNK)), "runs", compact=True)
    origin = F.col("kind"), F.col("_oid").alias("_id"), F.col("_oth").alias("_th"), (F.col("start") - F.col("shift")).cast("int").alias("start"), F.col("n_lines")
    wanted = settle(runs.select("kind", "_id", "_th", "start", "n_lines").unionByName(runs.select(*origin)).distinct(), "wanted", compact=True)
    spans = wanted.groupBy("_id", "_th").agg(F.collect_list(F.struct("kind", "start", "n_lines")).alias("spans"))
    spans = broadcast_if_small(spans, wanted.count(), BROADCAST_ROWS)
    # The bytes of these spans alone are cut out: whole for chunks, as SHA-256 for passages, whose windows may be many.
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_id"), F.xxhash64(text).alias("_th"), F.split(text, "\n").alias("lines")).join(spans, ["_id", "_th"])
    body = F.array_join(F.slice("lines", F.col("s.start") + 1, F.col("s.n_lines")), "\n").cast("binary")
    cut = rows.select("_id", "_th", "lines", F.explode("spans").alias("s")).select("_id", "_th", "s.*", F.when(F.col("s.kind") == CHUNK, body).otherwise(F.sha2(body, 256).cast("binary")).alias("body"))
    span = ["kind", "_id", "_th", "start", "n_lines"]
    cut = settle(cut.dropDuplicates(span), "cut", compact=True)
    first = cut.select("kind", F.col("_id").alias("_oid"), F.col("_th").alias("_oth"), F.col("start").alias("_ostart"), "n_lines", F.col("body").alias("original"))
    copies = runs.join(cut, span).withColumn("_ostart", (F.col("start") - F.col("shift")).cast("int"))
    return copies.join(first, ["kind", "_oid", "_oth", "_ostart", "n_lines"]).where("body = original").select("kind", "_id", "_th", "start", "n_lines")


def joined(spans: DataFrame, by: list[str]) -> DataFrame:
    """(*by, start, n_lines): the spans (*by, start, n_lines) of each key, those that overlap or touch made one."""
    order = Window.partitionBy(*by).orderBy("start", "n_lines")
    ended = F.max(F.col("start") + F.col("n_lines")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    s = spans.withColumn("_new", F.coalesce(F.col("start") > ended, F.lit(True)).cast("int"))
    s = s.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.groupBy(*by, "_run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n_lines")).alias("_end"))
    return s.select(*by, "start", (F.col("_end") - F.col("start")).cast("int").alias("n_lines"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", passage: int | None = PASSAGE_WORDS) -> DataFrame:
    """``docs`` with ``text`` cleared of repeated chunks and passages, and ``n_lines`` and ``n_removed`` (lines before, lines removed).

    ``passage`` is the least number of words of a passage; None removes chunks alone.
    All other columns and all rows stay; a document may be left with an empty text.  A
    null text stays null, with 0 lines.  Repeated rows (equal key and text) count as one
    document and are returned alike; different texts under one key are documents of their
    own, ordered by a hash.  Rows with a null key stay as they are.  An empty table gives an empty result.
    ``n_lines`` and ``n_removed`` replace columns of these names.
    """
    kh, th, spans_of = fresh(docs, "_kh"), fresh(docs, "_th"), fresh(docs, "_spans")
    gone = settle(joined(repeats(docs, key, text, passage), ["_id", "_th"]), "gone", compact=True)
    spans = gone.select(F.xxhash64("_id").alias(kh), F.col("_th").alias(th), F.struct("start", "n_lines").alias("s")).groupBy(kh, th).agg(F.collect_list("s").alias(spans_of))
    spans = broadcast_if_small(spans, gone.count(), BROADCAST_ROWS)
    rows = docs.drop("n_lines", "n_removed").withColumns({kh: F.xxhash64(key), th: F.xxhash64(text)}).join(spans, [kh, th], "left").drop(kh, th)
    cleared = F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.exists(spans_of, lambda s: (i >= s.start) & (i < s.start + s.n_lines))), "\n")
    removed = F.aggregate(spans_of, F.lit(0), lambda total, s: total + s.n_lines)
    return rows.withColumns(
        {
            text: F.when(F.col(spans_of).isNull(), F.col(text)).otherwise(cleared),
            "n_lines": F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long"),
            "n_removed": F.coalesce(removed, F.lit(0)).cast("long"),
        }
    ).drop(spans_of)


#: The same in DuckDB SQL, over keys that are unique.
SQL = r"""
WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM a),
h AS (SELECT doc_id, pos, line, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS h, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l),
b AS (SELECT *, coalesce(pos = 0 OR (coalesce(lag(h, 2) OVER p, 0) + 7 * lag(h) OVER p) % 3 = 0, true) AS first, sum(w) OVER (p ROWS UNBOUNDED PRECEDING) AS till
      FROM h WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
c AS (SELECT *, sum(CASE WHEN first THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS chunk FROM b),
g AS (SELECT doc_id, min(pos) AS i, max(pos) AS j, sum(w) AS words, string_agg(line, chr(10) ORDER BY pos) AS body FROM c GROUP BY doc_id, chunk),
r AS (SELECT doc_id, i, j FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS k FROM g WHERE words > 0 AND j > i) WHERE k > 1),
f AS (SELECT doc_id, pos, w, till, till - w AS ahead FROM b WHERE w > 0),
s AS (SELECT doc_id, pos AS i, last_value(pos) OVER q AS j, sum(w) OVER q AS words FROM f WINDOW q AS (PARTITION BY doc_id ORDER BY ahead RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
      UNION SELECT doc_id, first_value(pos) OVER q, pos, sum(w) OVER q FROM f WINDOW q AS (PARTITION BY doc_id ORDER BY till RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
x AS (SELECT doc_id, i, j, array_to_string(ls[i + 1:j + 1], chr(10)) AS body FROM s JOIN a USING (doc_id) WHERE words >= 50),
o AS (SELECT *, first_value(doc_id) OVER q AS od, first_value(i) OVER q AS oi FROM x WINDOW q AS (PARTITION BY body ORDER BY doc_id, i)),
u AS (SELECT doc_id, i, j FROM r UNION SELECT doc_id, i, j FROM o WHERE (doc_id, i) <> (od, oi) AND (doc_id <> od OR i - oi > j - i)),
z AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS pos FROM u),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (z.pos IS NULL) AS body, count(*) AS n_lines, count(z.pos) AS n_removed FROM l LEFT JOIN z USING (doc_id, pos) GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.body, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN k USING (doc_id)
"""
