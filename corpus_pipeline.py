"""From raw documents to token ids: five corpus operators in a row, each on what the one before has kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from entitygraph.llm import bpe, jaccard_join, line_dedup, quality_classifier, source_mix
from entitygraph.llm.common import broadcast_if_small, fresh, read, settle

#: Rows of ids up to which they are broadcast to the documents (about 24 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as class 1; the columns of ``docs``.

    Each row is judged by its own text, null and empty ones as texts without words; repeated rows share a verdict.
    """
    held = F.coalesce(quality_classifier.held_out(), F.lit(False))
    model = quality_classifier.train(docs, read(spark, sf_dir, "labels"), ~held)
    names = fresh(docs, "_score"), fresh(docs, "_predicted")
    return quality_classifier.score(docs, model, keep=tuple(docs.columns), names=names).where(F.col(names[1]) == 1).select(*docs.columns)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the line chunks and passages that occur earlier; ``n_chars`` follows the text.

    Repeated rows count as one document and are cleared alike; null texts and rows without an id stay as they are.
    """
    cleared = line_dedup.dedup(docs)
    if "n_chars" in docs.columns:
        cleared = cleared.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cleared.select(*docs.columns)


def row_key(docs: DataFrame) -> Column:
    """What tells documents apart, in 17 bytes for whole numbers: the id, in its order, and a hash of the text; a null id stands last."""
    digits = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        name = digits(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(2**63))))
    else:
        name = F.col("doc_id").cast("string").cast("binary")
    known, none = F.lit(bytearray(b"\x00")), F.lit(bytearray(b"\x01"))
    return F.concat(F.when(F.col("doc_id").isNull(), none).otherwise(F.concat(known, name)), digits(F.coalesce(F.xxhash64("text"), F.lit(0))))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each component of the Jaccard join.

    Documents are told apart by id and text: of rows that repeat both, one stays; different
    texts under one id, or without an id, are documents of their own.  Texts without words link
    with nothing.  An empty table stays empty.
    """
    key = fresh(docs, "_key")
    keyed = docs.withColumn(key, row_key(docs))
    found = settle(jaccard_join.join(keyed, key), "found")
    gone = settle(found.where(F.col(key) != F.col("component_id")).select(key).distinct(), "gone")
    left = keyed.join(broadcast_if_small(gone, gone.count(), BROADCAST_ROWS), key, "left_anti")
    again = settle(found.groupBy(key).agg(F.count("*").alias("c")).where("c > 1").select(key), "again")
    n = again.count()
    if n:
        # Repeated rows alone are shuffled with their texts.
        again = broadcast_if_small(again, n, BROADCAST_ROWS)
        left = left.join(again, key, "left_anti").unionByName(left.join(again, key, "left_semi").dropDuplicates([key]))
    return left.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes its words, to the nearest whole copy.

    Documents are told apart by id and text, so rows without an id take part; repeated rows share
    alike.  Documents without words are not drawn.  An empty table stays empty.
    """
    key, copies, copy = (fresh(docs, n) for n in ("_key", "_copies", "_copy"))
    keyed = docs.withColumn(key, row_key(docs))
    taken = source_mix.mix(keyed, key).taken.where("taken > 0").groupBy(key).agg(F.max(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int").alias(copies))
    taken = settle(taken.where(F.col(copies) > 0), "taken")
    drawn = keyed.join(broadcast_if_small(taken, taken.count(), BROADCAST_ROWS), key)
    return drawn.withColumn(copy, F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed) of every document and the text that they decode to; null and empty texts have none."""
    return bpe.encode_documents(docs, keep=("doc_id", "source"))


STAGES = [
    ("quality_classifier", reject_low_quality),
    ("line_dedup", remove_repeated_lines),
    ("jaccard_join", keep_one_of_each_group),
    ("source_mix", mix_sources),
    ("bpe", encode),
]

#: The classifier's verdicts and the token ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
