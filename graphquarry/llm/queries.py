"""The registered queries of this subpackage, thin over its operators, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphquarry.llm import alignment, byte_bpe, classifier, lexical, line_dedup, media, mixing, ngram_join, packing, rules, substring_dedup, token_counts, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=False, digests=True)


def op2_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.telephony(table(spark, sf_dir, "documents"), F.encode("text", "utf-8")).drop("media", "pcm")


def op3_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = classifier.score(docs, classifier.train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", (~classifier.learnable()).alias("held_out"), "score", "predicted")


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), digests=True)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_telephony": op2_telephony,
    "op3_classifier": op3_classifier,
    "op4_rules": op4_rules,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_ngram_join": op6_ngram_join,
    "op7_token_counts": op7_token_counts,
    "op8_url_filter": op8_url_filter,
    "op9_packing": op9_packing,
    "op10_line_dedup": op10_line_dedup,
    "op11_search": op11_search,
    "op12_alignment": op12_alignment,
    "op13_mixing": op13_mixing,
}

ORACLE: dict[str, str] = {"op4_rules": rules.oracle(), "op5_substring_dedup": substring_dedup.oracle(), "op8_url_filter": url_filter.oracle(), "op10_line_dedup": line_dedup.oracle(), "op11_search": lexical.oracle(), "op13_mixing": mixing.oracle()}
