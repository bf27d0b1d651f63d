"""From raw documents to packed training sequences: five stages, each over all its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next one's docs. All but the last keep the columns of `documents`; n_chars follows the text.

quality_classifier  documents with a score below 0.3 go; labels come from sf_dir's table `labels`
line_dedup          lines of templates that recur in ten documents or more stay in the first one only
ngram_join          of documents connected by a word 5-gram similarity of 0.8 or more one stays
substring_dedup     words in 50-word windows that a document with a smaller doc_id has too go
packing             ids of all documents left, packed into sequences of 4096

Null texts are empty ones and pass the first stage by their score like any other. Rows equal in doc_id and
text are one document from ngram_join on. Empty tables pass through all stages.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphquarry.llm import batches as B
from graphquarry.llm import classifier, line_dedup, ngram_join, packing, substring_dedup
from graphquarry.operators.components import ensure_checkpoint_dir, remove, scratch

#: Neither the classifier nor the packing of tokens can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def bare(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all but the text in one column, so that columns called like an operator's result stay as they are."""
    return docs.select(B.packed(docs, [c for c in docs.columns if c != "text"]), "doc_id", "text")


def with_text(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The columns of `docs` with the text that `out` has, and n_chars of it."""
    size = F.length("text").cast(docs.schema["n_chars"].dataType if "n_chars" in docs.columns else "long")
    return B.unpacked(out.select(B.ROW, "text", size.alias("n_chars")), docs.columns, {"text": "text", "n_chars": "n_chars"})


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = classifier.score(bare(docs), model, keep=[B.ROW, "text"]).where("predicted = 1")
    return B.unpacked(kept, docs.columns, {"text": "text"})


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_text(docs, line_dedup.drop_lines(bare(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_first(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_text(docs, substring_dedup.remove_repeats(bare(docs)))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", drop_lines),
    ("ngram_join", near_duplicates),
    ("substring_dedup", repeats),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), ""
    for name, stage in STAGES:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
