"""The classifier against a plain per-document computation."""

import re

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from graphquarry.llm import batches, classifier  # noqa: E402

WORD = re.compile(r"[^ \t-\r]+")
TEXTS = ["", "one", "spam spam spam eggs", "naïve café 日本語 it's a b", "the cat sat on the mat " * 30, "x y x y x y", "a\tb\nc d"]


def word_hash(word):
    data, off = batches.buffers(pa.array([word]))
    return batches.word_hashes(data, np.array([0]), np.array([len(data)]))[0]


def bucket(x):
    return int(x) % classifier.BUCKETS


def features(text):
    """Every feature of a text, repeats included, one word and one n-gram at a time."""
    out, hashes = [], []
    for word in WORD.findall(text):
        hashes.append(word_hash(word))
        out.append(bucket(hashes[-1]))
        marked = f"\2{word}\3"
        for n in classifier.GRAMS:
            for i in range(len(marked) - n + 1):
                codes = batches.mixed(np.array([ord(c) + 1 for c in marked[i : i + n]], np.uint64))
                out.append(bucket(batches.window_hashes(codes, n)[0]))
    for a, b in zip(hashes, hashes[1:], strict=False):
        out.append(classifier.SAME if a == b else bucket(batches.window_hashes(np.array([a, b]), 2)[0]))
    return out


def test_features():
    data, off = batches.buffers(pa.array(TEXTS))
    for text, (where, share) in zip(TEXTS, classifier.feature_counts(data, off), strict=True):
        own = features(text)
        want = {b: own.count(b) / len(own) for b in own}
        assert dict(zip(where.tolist(), share.tolist(), strict=True)) == pytest.approx(want)


def plain_descent(examples):
    """Vectors, output and bias after the descent, feature by feature."""
    random, d = np.random.default_rng(classifier.SEED), classifier.DIMENSIONS
    vectors = random.uniform(-1 / d, 1 / d, (classifier.BUCKETS, d)).astype(np.float32).astype(float)
    output, share = np.zeros((2, d)), (sum(y for _, y in examples) + 1) / (len(examples) + 2)
    bias, steps, done = np.log([1 - share, share]), classifier.EPOCHS * len(examples), 0
    for _ in range(classifier.EPOCHS):
        for k in random.permutation(len(examples)):
            own, y = examples[k]
            hidden = sum((vectors[b] for b in own), np.zeros(d)) / max(1, len(own))
            p = np.exp(output @ hidden + bias)
            error = np.eye(2)[y] - p / p.sum()
            fall = 1 - done / steps
            back = classifier.RATE * fall * (error @ output)
            output = output + classifier.RATE * fall * np.outer(error, hidden)
            bias = bias + classifier.BIAS_RATE * fall * error
            for b in own:
                vectors[b] += back / len(own)
            done += 1
    return vectors, output, bias


def test_descent_and_folded_scores(spark):
    labelled = [(t, k % 2) for k, t in enumerate(TEXTS)]
    data, off = batches.buffers(pa.array(TEXTS))
    model = classifier.Model.trained([(*x, y) for x, (_, y) in zip(classifier.feature_counts(data, off), labelled, strict=True)])
    vectors, output, bias = plain_descent([(features(t), y) for t, y in labelled])
    seen = [*TEXTS, "words never seen spam spam", "日本語 sat"]
    want = {}
    for t in seen:
        own = features(t)
        hidden = sum((vectors[b] for b in own), np.zeros(classifier.DIMENSIONS)) / max(1, len(own))
        p = np.exp(output @ hidden + bias)
        want[t] = p[1] / p.sum()
    docs = spark.createDataFrame(list(enumerate(seen)), "doc_id long, text string")
    got = {r.text: r.score for r in classifier.score(docs, model).collect()}
    assert got == pytest.approx(want, abs=2e-3)


def test_bound_of_bytes_cuts_the_sample(spark):
    docs = spark.createDataFrame([(k, "word " * 50 if k % 2 else "other text " * 20) for k in range(40)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    every, few = classifier.train(docs, labels), classifier.train(docs, labels, sample_bytes=600)
    assert (every.weights != few.weights).any()
    assert (classifier.train(docs, labels, sample_bytes=0).weights == 0).all()
    again = docs.unionByName(docs.where("doc_id < 20"))  # a doc_id that repeats is learned once
    assert (classifier.train(again, labels).weights == every.weights).all()


def test_rows_without_doc_id_are_held_out(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    assert [r[0] for r in docs.select(classifier.learnable()).collect()][0] is False
    assert docs.where(classifier.learnable().isNull()).count() == 0
