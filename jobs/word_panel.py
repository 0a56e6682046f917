"""An association panel of words over a growing folder of documents.

Association panels are estimated from contexts and the features seen in them; here documents are
contexts and the words of a fixed vocabulary features.  New files are taken by a file stream:
each batch adds its counts of contexts, words and pairs of words under its own number, so that a batch that is
done again replaces itself.  Counts add up, so old documents are never read again.  The panel is
made anew from the counts at the end of each run.

Every row of the documents is a context of its own, whatever its id; texts that are null or hold no
word of the vocabulary are none.  The vocabulary is settled by the first run.
"""

from __future__ import annotations

import string
from collections.abc import Mapping
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entitygraph.operators import assoc
from jobs.common import command, log, with_defaults

DEFAULTS = {"vocabulary_size": 100, "least_chars": 2, "files_per_batch": 64, "evidence": 10.0}
#: Words are runs of ASCII letters and digits and of anything beyond ASCII; A-Z count as small letters.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Counts of a batch: a pair stands once, a word as a pair with itself, the number of contexts without words.
COUNTS = "gi string, gj string, k long"
#: Files are taken whatever their age: the stream's own limit of a week would drop late copies.
ANY_AGE = "36500d"


def folder_or_file(path: str) -> str:
    """A pattern that only ``path`` matches: streams read plain paths as folders only, what a pattern finds may be a file too."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def words(text: str = "text") -> Column:
    """The different words of a text."""
    small = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_distinct(F.regexp_extract_all(small, F.lit(WORDS), F.lit(0)))


def vocabulary_of(table: DataFrame, size: int, least_chars: int) -> DataFrame:
    """(feature): the ``size`` words that most rows hold, ties by the word."""
    held = table.select(F.explode(words()).alias("feature")).where(F.length("feature") >= least_chars)
    return held.groupBy("feature").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "feature").limit(size).select("feature")


def settled_vocabulary(spark: SparkSession, table: str, path: str, size: int, least_chars: int) -> DataFrame:
    """The vocabulary that the first run wrote to ``path``, so that old and new counts mean the same words."""
    kept = None
    try:
        kept = spark.read.schema("feature string").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    if kept is None or kept.isEmpty():
        vocabulary_of(spark.read.parquet(table), size, least_chars).coalesce(1).write.mode("overwrite").parquet(path)
        kept = spark.read.schema("feature string").parquet(path)
    return kept


def counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``COUNTS`` of documents, in one pass and one aggregation that combines before it shuffles."""
    known = vocabulary.agg(F.sort_array(F.collect_list("feature")).alias("known"))  # one row, as long as the vocabulary
    held = docs.select(words().alias("w")).crossJoin(F.broadcast(known)).select(F.array_intersect("known", "w").alias("g")).where(F.size("g") > 0)
    first = held.select("g", F.posexplode_outer(F.concat(F.array(F.lit(None).cast("string")), F.col("g"))).alias("at", "gi"))
    later = F.when(F.col("at") == 0, F.array(F.lit(None).cast("string"))).otherwise(F.slice("g", F.greatest("at", F.lit(1)), F.size("g")))
    return first.select("gi", F.explode(later).alias("gj")).groupBy("gi", "gj").agg(F.count("*").alias("k"))


def panel_of(found: DataFrame, evidence: float) -> DataFrame:
    """(gi, gj, k_ij, k_i, k_j, n, pmi, npmi, expected, tier) of all pairs of words that occur.

    Pairs that are never seen together though expected ``evidence`` times have NPMI -1 and the tier
    neg_one; other unseen pairs are left out.
    """
    total = found.groupBy("gi", "gj").agg(F.sum("k").alias("k"))
    k = total.where("gi = gj").select("gi", "k")
    n = total.where("gi is null").select(F.col("k").alias("n"))
    i, j = k.select("gi", F.col("k").alias("k_i")), k.select(F.col("gi").alias("gj"), F.col("k").alias("k_j"))
    every = i.join(F.broadcast(j), F.col("gi") < F.col("gj")).crossJoin(F.broadcast(n))  # both are as small as the vocabulary
    table = every.join(total.where("gi < gj").withColumnRenamed("k", "k_ij"), ["gi", "gj"], "left").withColumn("k_ij", F.coalesce("k_ij", F.lit(0)))
    seen = assoc.evidence_tiers(assoc.association(table.where("k_ij > 0")), evidence)
    unseen = table.where("k_ij = 0").withColumn("expected", F.col("k_i").cast("double") * F.col("k_j") / F.col("n")).where(F.col("expected") >= evidence)
    unseen = unseen.withColumns({"pmi": F.lit(None).cast("double"), "npmi": F.lit(-1.0), "tier": F.lit("neg_one")})
    value = lambda c: (F.round(F.col(c) + 1e-9, 6) + 0.0).alias(c)
    columns = ["gi", "gj", "k_ij", "k_i", "k_j", "n", "pmi", "npmi", "expected", "tier"]
    both = seen.select(*columns).unionByName(unseen.select(*columns))
    return both.select("gi", "gj", *(F.col(c).cast("long").alias(c) for c in ("k_ij", "k_i", "k_j", "n")), value("pmi"), value("npmi"), value("expected"), "tier")


def run(spark: SparkSession, documents: str, vocabulary: str, out: str, checkpoint: str, config: Mapping[str, Any] | None = None) -> dict[str, int]:
    """Take what is new in ``documents`` and rewrite ``out``/panel, partitioned by tier.

    ``checkpoint`` keeps the stream's progress, the vocabulary and the counts of the batches.  A run that finds nothing new
    writes the same panel again.  Returns the numbers of batches and rows taken and of pairs written.
    """
    c = with_defaults(config, DEFAULTS)
    known = settled_vocabulary(spark, vocabulary, f"{checkpoint}/vocabulary", c["vocabulary_size"], c["least_chars"])
    log.info("word_panel: vocabulary of %s: %d words", vocabulary, known.count())
    took = {"batches": 0, "rows": 0}

    def add(batch: DataFrame, number: int) -> None:
        # A batch that is repeated after a failure has its number again and replaces its counts.
        # The aggregation keeps its partitions; its few rows make one file.
        counts(batch, known).repartition(1).write.mode("overwrite").parquet(f"{checkpoint}/counts/batch={number}")
        took["batches"] += 1

    docs = spark.readStream.schema(spark.read.parquet(documents).schema).option("maxFilesPerTrigger", c["files_per_batch"]).option("maxFileAge", ANY_AGE).parquet(folder_or_file(documents))
    query = docs.select("text").writeStream.foreachBatch(add).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()
    query.awaitTermination()
    took["rows"] = sum(p["numInputRows"] for p in query.recentProgress)
    log.info("word_panel: read %d new rows of %s in %d batches", took["rows"], documents, took["batches"])
    found = spark.read.schema(COUNTS).parquet(f"{checkpoint}/counts")
    panel_of(found, c["evidence"]).repartition("tier").write.mode("overwrite").partitionBy("tier").parquet(f"{out}/panel")
    took["pairs"] = spark.read.parquet(f"{out}/panel").count()
    log.info("word_panel: wrote %d pairs to %s/panel", took["pairs"], out)
    return took


if __name__ == "__main__":
    command("word_panel", "Update a panel of word associations from new documents.", {"documents": "folder of documents (Parquet)", "vocabulary": "table whose texts give the vocabulary", "out": "folder of the panel", "checkpoint": "folder of progress and counts"}, run)
