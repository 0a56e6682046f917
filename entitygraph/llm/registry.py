"""Thin queries over the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entitygraph.llm import bpe, conversation_trie, embedding_links, jaccard_join, language_id, license_scan, line_dedup, pii, quality_classifier, quality_rules, source_mix, token_counts
from entitygraph.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links.link(read(spark, sf_dir, "embeddings"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read(spark, sf_dir, "documents"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(read(spark, sf_dir, "documents"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.ledger(read(spark, sf_dir, "documents"))
    base = ~quality_rules.passes("base")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), quality_rules.passes().alias("kept"), "failures", F.lit(quality_rules.CURRENT).alias("policy"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(language_id.held_out(), F.lit(False))
    model = language_id.train(docs, ~held)
    return language_id.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(read(spark, sf_dir, "documents")).taken.select("doc_id", "size", "source_size", "target", "taken")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(read(spark, sf_dir, "documents"))
    base = "filter(spans, s -> s.kind in ('email', 'ip', 'card', 'phone'))"
    said = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.stop)), ',')"
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.BASE_KINDS]
    added = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.KINDS if k not in pii.BASE_KINDS]
    scores = F.expr("array_join(transform(spans, s -> format_number(s.score, 1)), ',')").alias("scores")
    return found.select("doc_id", *counts, F.sha2(F.expr(f"cast({said.format(base)} as binary)"), 256).alias("base_sha256"), F.expr(said.format("spans")).alias("spans"), *added, scores)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(quality_classifier.held_out(), F.lit(False))
    model = quality_classifier.train(docs, read(spark, sf_dir, "labels"), ~held)
    return quality_classifier.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(read(spark, sf_dir, "conversations"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(read(spark, sf_dir, "documents")))


QUERIES: dict[str, Query] = {
    "op1_embedding_links": op1_embedding_links,
    "op2_token_counts": op2_token_counts,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_quality_rules": op5_quality_rules,
    "op6_language_id": op6_language_id,
    "op7_source_mix": op7_source_mix,
    "op8_personal_data": op8_personal_data,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_license_scan": op12_license_scan,
}

SQL: dict[str, str] = {"op1_embedding_links": embedding_links.SQL, "op3_jaccard_join": jaccard_join.SQL, "op5_quality_rules": quality_rules.SQL, "op7_source_mix": source_mix.SQL, "op9_line_dedup": line_dedup.SQL, "op11_conversation_trie": conversation_trie.SQL, "op12_license_scan": license_scan.SQL}
