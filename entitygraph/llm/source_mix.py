"""Mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points on [0, 1) are mapped through the cumulative targets of the
sources: point i gives slot i to a source.  Slots are ranked within their source;
the documents of a source are shuffled, laid end to end and cut into blocks of equal
token counts; the slot of rank r takes block r, beginning again after the last.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from entitygraph.llm.common import WORD_PATTERN, broadcast_if_small, settle

WEIGHTS = (5, 2, 1)
#: Share of all tokens that the mix holds, and passes over a source at most.
SHARE, PASSES = 1.5, 2
#: Tokens of a block: a mix has SLOTS slots or more, and no block is longer than LONGEST.
SLOTS, LONGEST = 65_536, 1024
#: Parts in which the documents of a source are laid out, and slots ranked together.
PARTS, RUN = 512, 4096
#: Cells through which points find their source.
CELLS = 1024
GOLDEN = 0.6180339887498949
BROADCAST_ROWS = 200_000


@dataclass
class Mix:
    """``sources``: per source its size, weight and target; ``schedule``: slot, source, rank, block; ``blocks``:
    source, block, document and its tokens in the block; ``taken``: per document what the mix takes."""

    sources: DataFrame
    schedule: DataFrame
    blocks: DataFrame
    taken: DataFrame
    block_tokens: int


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """(skey, source, source_size, weight, target) from one row a source (skey, source, source_size).

    Sources by code point, null last, take the weights in turn.  Sources whose weighted
    part would exceed ``passes`` times their size stop there; the rest is shared by
    weight again.  Filling by rising ratio of limit to weight gives the same in one pass.
    The windows run over one row a source.
    """
    ranked = sizes.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int")).cast("double")
    ranked = ranked.withColumns({"weight": weight, "limit": (F.col("source_size") * passes).cast("double")})
    rising = Window.orderBy(F.col("limit") / F.col("weight"), "k")
    everything = Window.partitionBy()
    level = ranked.withColumns(
        {
            "total": F.sum("source_size").over(everything) * F.lit(share),
            "full": F.coalesce(F.sum("limit").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "open": F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)),
        }
    ).withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    fits = F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.struct(F.col("limit") / F.col("weight"), "k", "level"))
    final = level.withColumn("fill", F.coalesce(F.min(fits).over(everything)["level"], F.lit(float("inf"))))
    return final.select("skey", "source", "source_size", "weight", F.least("limit", F.col("weight") * F.col("fill")).alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES, seed: int = 11) -> Mix:
    """A repeatable mix of whole tables.

    The size of a document is its number of words (null text: 0).  A null source is a
    source of its own, the last.  Documents without words are taken 0 times.  Repeated
    rows are documents of their own; where their keys are equal, ``taken`` has a row for
    each and they share alike.  An empty table gives empty results.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(key).alias("_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"))
    sized = sized.withColumns({"skey": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), "h": F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10).cast("long")})
    sized = settle(sized.withColumn("part", F.pmod("h", F.lit(PARTS)).cast("int")), "sized")

    parts = settle(sized.groupBy("skey", "source", "part").agg(F.sum("size").alias("size")), "parts", compact=True)
    sources = settle(targets(parts.groupBy("skey", "source").agg(F.sum("size").alias("source_size")), weights, share, passes), "sources", compact=True)
    n_sources, wanted = sources.agg(F.count("*"), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    block = int(min(LONGEST, max(1, wanted // SLOTS)))
    n_slots = int(-(-wanted // block))
    small = lambda df: broadcast_if_small(df, n_sources, BROADCAST_ROWS)  # noqa: E731  one row a source

    # Documents end to end, in shuffled order: parts of a source first, then documents within a part.
    ahead = parts.select("skey", "part", (F.sum("size").over(Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("ahead"))
    within = F.sum("size").over(Window.partitionBy("skey", "part").orderBy("h", "_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    laid = sized.withColumn("within", within).join(ahead, ["skey", "part"]).withColumn("start", F.col("ahead") + F.col("within"))
    laid = settle(laid.select("_id", "source", "skey", "size", "start"), "laid")
    pieces = laid.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    begin, end = F.greatest("start", F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    blocks = pieces.select("skey", "source", "block", "_id", "start", (end - begin).alias("tokens"))

    # Slots: points through the cumulative targets, found by cell.
    edges = sources.withColumns({"hi": F.sum("target").over(Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, 0)) / F.lit(max(wanted, 1.0))})
    edges = edges.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("skey")), F.lit(0.0)))
    edges = edges.withColumn("hi", F.when(F.row_number().over(Window.orderBy(F.col("skey").desc())) == 1, F.lit(2.0)).otherwise(F.col("hi")))
    spans = edges.where("target > 0").select("skey", "lo", "hi", F.ceil(F.col("source_size") / block).alias("n_blocks"), F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.floor(F.least("hi", F.lit(0.9999999)) * CELLS))).alias("cell"))
    spans = settle(spans, "spans", compact=True)
    u = F.col("slot") * F.lit(GOLDEN)
    slots = spark.range(n_slots).withColumnRenamed("id", "slot").withColumn("u", u - F.floor(u)).withColumn("cell", F.floor(F.col("u") * CELLS))
    slots = slots.join(broadcast_if_small(spans, spans.count(), BROADCAST_ROWS), "cell").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    slots = settle(slots.select("slot", "skey", "n_blocks", F.floor(F.col("slot") / RUN).alias("run")), "slots", compact=True)
    runs = slots.groupBy("skey", "run").agg(F.count("*").alias("c"))
    runs = runs.select("skey", "run", (F.sum("c").over(Window.partitionBy("skey").orderBy("run").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("earlier"))
    ranked = slots.withColumn("rank", F.row_number().over(Window.partitionBy("skey", "run").orderBy("slot")) - 1).join(runs, ["skey", "run"]).withColumn("rank", F.col("rank") + F.col("earlier"))
    # After so many passes a source is used up; its further slots stay empty.
    schedule = ranked.where(F.col("rank") < F.col("n_blocks") * passes).select("slot", "skey", "rank", (F.col("rank") % F.col("n_blocks")).alias("block"))

    times = schedule.groupBy("skey", "block").agg(F.count("*").alias("times"))
    drawn = blocks.join(times, ["skey", "block"]).groupBy("skey", "_id", "start").agg(F.sum(F.col("tokens") * F.col("times")).alias("taken"))
    taken = laid.join(drawn, ["skey", "_id", "start"], "left").join(small(sources.select("skey", "source_size", "target")), "skey")
    taken = taken.select(F.col("_id").alias(key), "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("taken"))
    named = small(sources.select("skey", "source"))
    return Mix(sources.drop("skey"), schedule.join(named, "skey").drop("skey"), blocks.select("source", "block", F.col("_id").alias(key), "tokens"), taken, block)


#: What the mix takes, in DuckDB SQL, over keys that are unique.
SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, CAST('0x' || substr(md5('11:' || doc_id), 1, 13) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss FROM d GROUP BY 1),
w AS (SELECT *, 2.0 * ss AS lim, [5.0, 2.0, 1.0][k % 3 + 1] AS wt FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM s)),
l AS (SELECT *, (1.5 * sum(ss) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / wt, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(wt) OVER (ORDER BY lim / wt, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT min_by(level, struct_pack(r := lim / wt, k := k)) AS fill FROM l WHERE level <= lim / wt),
t AS (SELECT source, ss, coalesce('=' || source, '') AS sk, CAST(least(lim, wt * coalesce(fill, 'inf'::DOUBLE)) AS DOUBLE) AS target FROM w, f),
c AS (SELECT CAST(least(1024, greatest(1, floor(sum(target) / 65536))) AS BIGINT) AS b, sum(target) AS wanted FROM t),
e AS (SELECT *, sum(target) OVER (ORDER BY sk ROWS UNBOUNDED PRECEDING) / wanted AS hi, CAST(ceil(ss / b) AS BIGINT) AS nb FROM t, c),
g AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY sk), 0) AS lo, CASE WHEN lead(sk) OVER (ORDER BY sk) IS NULL THEN 2.0 ELSE hi END AS top FROM e),
u AS (SELECT slot, slot * CAST(0.6180339887498949 AS DOUBLE) - floor(slot * CAST(0.6180339887498949 AS DOUBLE)) AS u FROM (SELECT unnest(range(CAST(ceil(wanted / b) AS BIGINT))) AS slot FROM c)),
r AS (SELECT sk, nb, row_number() OVER (PARTITION BY sk ORDER BY slot) - 1 AS rank FROM u JOIN g ON u.u >= g.lo AND u.u < g.top WHERE target > 0),
m AS (SELECT sk, rank % nb AS block, count(*) AS times FROM r WHERE rank < 2 * nb GROUP BY 1, 2),
o AS (SELECT *, coalesce('=' || source, '') AS sk, sum(size) OVER (PARTITION BY source ORDER BY h % 512, h, doc_id ROWS UNBOUNDED PRECEDING) - size AS start FROM d),
p AS (SELECT doc_id, sk, start, size, unnest(range(CAST(start // b AS BIGINT), CAST((start + size - 1) // b + 1 AS BIGINT))) AS block, b FROM o, c WHERE size > 0),
x AS (SELECT doc_id, sum((least(start + size, (block + 1) * b) - greatest(start, block * b)) * times) AS taken FROM p JOIN m USING (sk, block) GROUP BY 1)
SELECT doc_id, CAST(size AS BIGINT) AS size, ss AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM o JOIN t USING (sk) LEFT JOIN x USING (doc_id)
"""
