"""The stages of the pipeline, each against what it is to do with its input."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from collections import Counter  # noqa: E402

from tests.llm.test_operators import SCHEMA, join_reference, lines_reference, near_rows, substring_reference  # noqa: E402

STAGES = dict(corpus_pipeline.STAGES)


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_join", "substring_dedup", "packing"]


def test_classifier_stage_keeps_columns_and_clean_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = STAGES["quality_classifier"](spark, docs, data)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{data}/labels.parquet").where("quality = 1").collect()}
    assert len(good & ids) >= 0.95 * len(good)


def test_deduplication_stages(spark, data):
    rows = near_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    lines = STAGES["line_dedup"](spark, docs, data)
    assert Counter((r.doc_id, r.text) for r in lines.collect()) == Counter({(d, t): n for (d, t, _), n in lines_reference(rows).items()})
    near = STAGES["ngram_join"](spark, docs, data)
    assert sorted(r.doc_id for r in near.collect()) == sorted({c for _, c, _ in join_reference(rows)})
    cut = STAGES["substring_dedup"](spark, docs, data).collect()
    assert Counter((r.doc_id, len(r.text.split())) for r in cut if r.doc_id != 14) == Counter((d, n - g) for d, n, g, _ in substring_reference(rows, 50) if d != 14)


def test_run_packs_what_is_left(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    sums = out.groupBy("sequence_id").sum("length").collect()
    assert sums and max(r[1] for r in sums) <= 4096


def test_empty_tables_pass(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, data).count() == 0
