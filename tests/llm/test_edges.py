"""Names that operators use themselves, bytes that are not UTF-8, and rows that repeat, in every operator and stage."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402

from graphquarry.llm import batches, byte_bpe, classifier, line_dedup, media, ngram_join, packing, rules, substring_dedup, token_counts, url_filter  # noqa: E402
from tests.llm.test_operators import BPE, ODD, PIECES, SCHEMA, WORDS  # noqa: E402

#: Every name that an operator gives to a column of its own, and some that it returns.
NAMES = (
    "row", "t", "words", "lines", "weights", "bias", "y", "h", "id", "a", "b", "k", "u", "v", "right", "next", "z", "i", "n_chars",
    "__id", "__text", "__k1", "__k2", "__l1", "__l2", "__pos", "__words", "__head", "__template", "__group", "__gone", "__lines", "__kept", "__slot", "__n", "__first", "__f1",
    "__class", "__size", "__bands", "__band", "__sketch", "__comp", "__copies", "__grams", "__sig", "__tasks", "__rep", "__key", "__run", "__at", "__spans", "__hash", "__joined", "__payload", "__task", "__rank",
    "score", "predicted", "n_words", "n_lines", "n_dropped", "n_removed", "removed", "n_tokens", "ids", "kept", "failed_rules", "base_failed", "length", "a.b", "c`d",
)


@pytest.fixture(scope="module")
def clash(spark):
    """Odd rows whose every further column has a name that some operator uses; its value is that name."""
    docs = spark.createDataFrame(ODD, SCHEMA)
    return docs.select("*", *(F.lit(n).alias(n) for n in NAMES)).repartition(3)


@pytest.fixture(scope="module")
def broken(spark):
    """Texts with bytes that are not UTF-8: in a word, alone, cut off at the end, in a long line."""
    raw = ["61ff62", "ff", "c3", "", "e282", "20ff20ed a080 61".replace(" ", ""), "41" * 300 + "fe"]
    return spark.createDataFrame([(k, x) for k, x in enumerate(raw)], "doc_id long, hexed string").select("doc_id", F.unhex("hexed").cast("string").alias("text"))


def unchanged(rows, but):
    return all(r[n] == n for r in rows for n in NAMES if n not in but)


@pytest.fixture(scope="module")
def model(spark, data):
    return classifier.train(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet"))


def test_names_stay(spark, clash, model):
    makes = {
        "classifier": (lambda d: classifier.score(d, model), {"score", "predicted"}),
        "rules": (rules.judged, {"n_words", "n_lines", "base_failed", "failed_rules", "kept"}),
        "substring": (lambda d: substring_dedup.remove_repeats(d, 3), {"n_words", "n_removed", "removed"}),
        "ngram": (ngram_join.keep_first, set()),
        "line": (lambda d: line_dedup.drop_lines(d, least_docs=2), {"n_lines", "n_dropped"}),
    }
    plain = clash.select("doc_id", "text")
    for name, (make, own) in makes.items():
        out = make(clash)
        rows = out.collect()
        assert unchanged(rows, own), name
        bare = make(plain)
        assert len(out.columns) == len(set(out.columns)) and set(clash.columns) <= set(out.columns), name
        same = lambda f: Counter(map(repr, f.select(*("`" + c + "`" for c in bare.columns)).collect()))  # noqa: E731, B023
        assert same(out) == same(bare), name
    keep = ("doc_id", *NAMES)
    for name, make, own in (
        ("bpe", lambda: byte_bpe.encode_documents(clash, BPE, keep=keep), {"n_tokens", "ids"}),
        ("counts", lambda: token_counts.count_tokens(clash, PIECES, keep=keep), {"n_words", "n_tokens"}),
        ("media", lambda: media.telephony(clash, F.encode("text", "utf-8"), keep=keep, files=False), set()),
        ("urls", lambda: url_filter.filter_urls(clash, url="text", keep=keep), set()),
    ):
        out = make()
        assert len(out.columns) == len(set(out.columns)) and unchanged(out.collect(), own), name
    assert packing.pack_documents(clash, WORDS).count() == packing.pack_documents(plain, WORDS).count()
    assert ngram_join.groups(clash).count() == len(ODD)


def test_stages_take_odd_rows_and_names(spark, clash, data):
    docs = clash.unionByName(clash.limit(5))  # repeated rows too
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns
        changed = {"text", "n_chars"}
        rows = out.collect()
        assert rows and unchanged(rows, changed), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, data).where("length < 1 or length > 4096").count() == 0


def test_pipeline_runs_on_odd_documents(spark, data, tmp_path):
    rows = [*ODD, *((1000 + k, "Seite eins von vielen Seiten\n" + "aber dies ist ein ganz eigener Satz mit vielen Worten " * 3 + f"nummer {chr(97 + k)}") for k in range(12))]
    spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{data}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sums = Counter()
    for r in out:
        sums[r.sequence_id] += r.length
    assert out and max(sums.values()) <= 4096 and {r.doc_id for r in out} <= {d for d, _ in rows}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:  # the same stages by hand
        made = stage(spark, docs, str(tmp_path))
        docs = spark.createDataFrame(made.collect(), made.schema)
    key = lambda rs: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rs)
    assert key(out) == key(docs.collect())


def test_bytes_that_are_not_utf8(spark, broken, model):
    valid = broken.select("doc_id", F.make_valid_utf8("text").alias("text"))
    assert [r.text for r in valid.where("doc_id < 3").orderBy("doc_id").collect()] == ["a�b", "�", "�"]
    same = lambda make: Counter(map(repr, make(broken).collect())) == Counter(map(repr, make(valid).collect()))
    assert same(lambda d: byte_bpe.encode_documents(d, BPE, digests=True))
    assert same(lambda d: classifier.score(d, model, keep=["doc_id"]))
    assert same(lambda d: rules.judged(d.select("doc_id", "text")).drop("text"))
    assert same(lambda d: substring_dedup.remove_repeats(d, 1))
    assert same(lambda d: substring_dedup.remove_repeats(d, 1, digests=True))
    assert same(lambda d: ngram_join.groups(d).select("doc_id", "class_id", "n_links"))
    assert same(lambda d: token_counts.count_tokens(d, PIECES))
    assert same(lambda d: url_filter.filter_urls(d, url="text", keep=("doc_id",)))
    assert same(lambda d: packing.pack_documents(d, WORDS).drop("sequence_id", "offset"))
    assert same(lambda d: line_dedup.drop_lines(d))


def test_repeated_rows_have_the_spans_of_one(spark):
    text = " ".join(f"w{i}" for i in range(90))
    rows = [(1, text)] + [(2, text + " more")] * 30
    spans = substring_dedup.removed(substring_dedup.known(spark.createDataFrame(rows, SCHEMA), "text"), 50).collect()
    once = substring_dedup.removed(substring_dedup.known(spark.createDataFrame(rows[:2], SCHEMA), "text"), 50).collect()
    assert [len(r["__spans"]) for r in spans] == [len(r["__spans"]) for r in once]


def resampled(pcm):
    """Sample by sample."""
    out, at = [], lambda i: int(pcm[min(max(i, 0), len(pcm) - 1)])
    for i in range(len(pcm)):
        between = (5 * (at(i) + at(i + 1)) - at(i - 1) - at(i + 2) + 4) // 8
        out += [int(pcm[i]), max(-32768, min(32767, between))]
    return out


def described(pcm):
    pcm = [int(x) for x in pcm]
    crossings = sum((x < 0) != (y < 0) for x, y in zip(pcm, pcm[1:], strict=False))
    return f"n={len(pcm)} peak={max(map(abs, pcm))} rms={int(math.sqrt(sum(x * x for x in pcm) / len(pcm)))} zc={crossings} mean={math.floor(sum(pcm) / len(pcm))}"


def test_resampled_and_feature(spark):
    rng = np.random.default_rng(11)
    for n in (1, 2, 3, 200):
        pcm = rng.integers(-32768, 32768, n).astype(np.int16)
        assert media.resampled(pcm).tolist() == resampled(pcm)
    text = "Übung macht den Meister, sagte Anna. " * 5
    r = media.telephony(spark.createDataFrame([(1, text)], SCHEMA), F.encode("text", "utf-8")).first()
    payload = text.encode() + b"\0" * (-len(text.encode()) % 64)
    own, law = media.MU_LAW_PCM[list(payload)], media.A_LAW_PCM[list(payload)]
    wide = resampled(own)
    adpcm = media.adpcm_blocks(np.frombuffer(payload, np.uint8)).reshape(-1)
    crc = zlib.crc32(np.array(wide, "<i2").tobytes())
    assert r.feature == f"{described(own)} | 16k crc={crc:08x} peak={max(map(abs, wide))} | law {described(law)} | adpcm {described(adpcm)}"
    assert media.wav_data(bytes(r.pcm)) == (media.PCM, 16000, 2, np.array(wide, "<i2").tobytes())
    assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()


def test_batches_are_bounded_by_bytes(spark, clash):
    batches.ship(clash)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == 4 << 20


def test_windows_of_a_common_passage_are_told_apart_in_its_first_document(spark, monkeypatch):
    passage, rows, kept = [f"p{i}" for i in range(60)], {}, []
    for many in (20, 60):
        rows[many] = [(d, " ".join([*(f"a{d}x{i}" for i in range(40 + d % 7)), *passage, *(f"b{d}x{i}" for i in range(45))])) for d in range(many)]

    def spy(frame, *by):
        out = written(frame, *by)
        kept[-1] += out.count() if {"__hash", "__at"} <= set(out.columns) else 0
        return out

    written = substring_dedup.written
    monkeypatch.setattr(substring_dedup, "written", spy)
    for many, of in rows.items():
        kept.append(0)
        got = substring_dedup.remove_repeats(spark.createDataFrame(of, "doc_id long, text string"), 50, digests=True).collect()
        assert {r.doc_id: r.n_removed for r in got} == {d: 60 if d else 0 for d in range(many)}
    assert kept[0] == kept[1] <= 11  # the passage has eleven windows
