"""Quality classifier on supervised subword embeddings, trained by numpy stochastic gradient descent.

A document's features are its words, its pairs of neighbouring words (one feature for all pairs of a word
with itself, so that repetition is learned of words never seen too) and the 3- to 5-character n-grams of
every word (with marks for its ends), all hashed to `BUCKETS` learned vectors. The vectors are averaged,
and a softmax over two classes gives the score. The descent follows the plain gradient, a document a step,
at a rate that falls to 0; the bias has a rate of its own.

Training takes at most `SAMPLE` labelled documents of at most `SAMPLE_BYTES` of text together (the
bound; those with the least hashes of their doc_id, so the choice does not follow the order of rows), of
whole texts. One task reads them and runs the descent; it returns the folded model to the driver: as the
average and the output layer are linear, one number for each bucket, half a megabyte that is broadcast.
Scoring adds up numbers, and keeps the sum of a word by its bytes in a bounded table, because words recur.

Words are runs of bytes other than 0x20 and 0x09 to 0x0D. Null and empty texts have no features and the
score of the bias alone; long ones are taken whole. Labels: null ones are left out; of several for a
document the majority counts, a tie as 1. Rows without doc_id have no label and count as held out. Where
doc_id repeats, the least text is learned from, once. Without labels every score is 0.5. Repeated rows
have equal scores; an empty table has none. Columns of the input stay, whatever their names, and the
result's replace those of the same name.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphquarry.llm import batches as B

BUCKETS, DIMENSIONS, SAMPLE, SAMPLE_BYTES = 1 << 17, 16, 3000, 1 << 25
GRAMS = (3, 4, 5)
EPOCHS, RATE, BIAS_RATE, SEED = 8, 5.0, 0.1, 7
THRESHOLD = 0.3
MOST_KEPT = 300_000
SAME = int(B.mixed(np.array([0x5A3E], np.uint64))[0] % BUCKETS)


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def word_features(words: list[str], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and its character n-grams, one word after another, and how many each has."""
    marked = np.frombuffer("".join(f"\2{w}\3" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    bounds = np.concatenate([[0], np.cumsum([len(w) + 2 for w in words], dtype=np.int64)])
    values = B.mixed(marked + np.uint64(1))
    owner, found = [np.arange(len(words))], [bucket(hashes)]
    for n in GRAMS:
        doc, at = B.within(bounds, n)
        owner.append(doc)
        found.append(bucket(B.window_hashes(values, n)[bounds[doc] + at] if len(doc) else np.zeros(0, np.uint64)))
    owner, found = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return found[order], np.bincount(owner, minlength=len(words))


def pair_buckets(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of neighbouring words within a text, and how many each text has. All pairs of a word with itself share one."""
    doc, at = B.within(first, 2)
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(len(first) - 1, np.int64)
    left = first[doc] + at
    pairs = bucket(B.window_hashes(hashes, 2)[left])
    pairs[hashes[left] == hashes[left + 1]] = SAME
    return pairs, np.bincount(doc, minlength=len(first) - 1)


def feature_counts(data: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text: its buckets and their shares."""
    starts, ends, first = B.word_bounds(data, off)
    hashes = B.word_hashes(data, starts, ends)
    own, size = word_features([x.decode() for x in B.strings(data, starts, ends)], hashes)
    pairs, many = pair_buckets(hashes, first)
    cut, pair_cut = np.concatenate([[0], np.cumsum(size)])[first], np.concatenate([[0], np.cumsum(many)])
    out = []
    for i in range(len(off) - 1):
        every = np.concatenate([own[cut[i] : cut[i + 1]], pairs[pair_cut[i] : pair_cut[i + 1]]])
        where, count = np.unique(every, return_counts=True)
        out.append((where.astype(np.int32), (count / max(1, len(every))).astype(np.float32)))
    return out


class Model:
    """margin = mean over features of weights[bucket], plus bias; score = 1 / (1 + exp(-margin))."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    @classmethod
    def trained(cls, examples: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
        if not examples:
            return cls(np.zeros(BUCKETS, np.float32), 0.0)
        random = np.random.default_rng(SEED)
        vectors = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
        output = np.zeros((2, DIMENSIONS), np.float32)
        share = (sum(y for *_, y in examples) + 1) / (len(examples) + 2)
        bias = np.log(np.array([1 - share, share], np.float32))
        steps, done = EPOCHS * len(examples), 0
        for _ in range(EPOCHS):
            for k in random.permutation(len(examples)):
                where, part, y = examples[k]
                fall = np.float32(1 - done / steps)
                rate = np.float32(RATE) * fall
                hidden = part @ vectors[where]
                z = output @ hidden + bias
                z = np.exp(z - z.max())
                error = -z / z.sum()
                error[y] += 1
                back = rate * (error @ output)
                output += rate * np.outer(error, hidden)
                bias += np.float32(BIAS_RATE) * fall * error
                vectors[where] += part[:, None] * back
                done += 1
        return cls((vectors @ (output[1] - output[0])).astype(np.float32), float(bias[1] - bias[0]))


def learnable() -> Column:
    """Whether a label may be learned: doc_id is there, and its crc32 no multiple of 5."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, text: str = "text") -> Model:
    """A model of `labels.quality`, from rows whose crc32 of doc_id is not a multiple of 5."""
    marks = labels.where(F.col("quality").isNotNull() & learnable()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    known = marks.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", B.text_or_empty(text).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most `sample` rows
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    one = rows.select(F.xxhash64("doc_id").alias("h"), F.col("doc_id").cast("string").alias("id"), "y", "text").repartition(1).sortWithinPartitions("h", "id").select("y", "text")

    def fit(parts):
        examples, left = [], sample_bytes
        for part in parts:
            y = part.column(0).to_pylist()
            for a, _, data, off in B.chunks(*B.buffers(part.column(1))):
                fits = int(np.searchsorted(off, left, "right")) - 1 if left >= 0 else 0
                examples += [(*x, y[a + i]) for i, x in enumerate(feature_counts(data[: off[fits]], off[: fits + 1]))]
                left = left - int(off[-1]) if fits == len(off) - 1 else -1
        model = Model.trained(examples)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], ["weights", "bias"])

    found = B.ship(one).mapInArrow(fit, "weights binary, bias double").first()
    return Model(np.frombuffer(bytes(found.weights), np.float32), found.bias) if found else Model.trained([])


class Scorer:
    def __init__(self, model: Model):
        self.model, self.kept, self.sums = model, B.Interner(MOST_KEPT), B.Values(np.float64)

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        weights = self.model.weights.astype(np.float64)
        starts, ends, first = B.word_bounds(data, off)
        hashes = B.word_hashes(data, starts, ends)
        index, new = self.kept.index(data, starts, ends)
        if len(new):
            where, size = word_features([x.decode() for x in B.strings(data, starts[new], ends[new])], hashes[new])
            bounds = np.concatenate([[0], np.cumsum(size)])
            self.sums.put(len(self.kept), np.stack([np.add.reduceat(weights[where], bounds[:-1]), size], 1).tolist())
        values = self.sums.get(index)[0].reshape(-1, 2)
        self.kept.commit(new)
        pairs, many = pair_buckets(hashes, first)
        total = B.sums(values[:, 0], first) + B.sums(weights[pairs], np.concatenate([[0], np.cumsum(many)]))
        margin = total / np.maximum(B.sums(values[:, 1], first) + many, 1) + self.model.bias
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The documents (of them the columns `keep`, by default all) with score (0 to 1, higher: quality 1 likelier) and predicted (1 if at least THRESHOLD)."""
    columns = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    source = docs.select(B.packed(docs, columns), B.text_or_empty(text).alias("text"))
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # one number for each bucket
    schema = T.StructType([source.schema[B.ROW], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def go(parts):
        scorer = B.held(("scorer", name), lambda: Scorer(shared.value))
        for part in parts:
            for a, z, data, off in B.chunks(*B.buffers(part.column(1))):
                p = scorer.scores(data, off)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(a, z - a), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], schema.names)

    return B.unpacked(B.ship(source).mapInArrow(go, schema), [*columns, "score", "predicted"], {"score": "score", "predicted": "predicted"})
