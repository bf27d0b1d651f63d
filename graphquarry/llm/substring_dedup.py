"""Substring deduplication: word windows that an earlier document has are removed.

Rabin-Karp hashes of every window of `width` words are made with prefix sums in numpy, and counted in
Spark. To keep the shuffle small, windows travel as runs. Every window has a key, the least hash of
the `GRAM`-word grams in it, which depends on its words alone; consecutive windows with one key form
a run (about 22 windows), and equal windows always have equal keys. So

1. keys that occur in several documents are counted, and set as bits of a sieve of fixed size
   (`SIEVE_BITS`, 4 MB) that is broadcast. Only runs whose key passes are written, a row each: key,
   hash of the whole run, document, start, length. Others that pass by chance change nothing;
2. a run whose (key, run hash) also occurs in a document with a smaller doc_id is removed whole;
3. of each (key, run hash) the first document remains. Where a key has several run hashes, its runs
   (found again by a second sieve of that size) are cut into blocks of about `CUT` windows where the
   windows' own hashes say so, and blocks are compared like runs;
4. of each block the first document remains, and only of these blocks are windows told apart one by
   one: counted by (key, hash), with the least doc_id of each;
5. a third sieve cuts these blocks to the stretches of windows that occur again (what else passes by chance changes
   nothing). Where a passage begins or ends within a block, its stretch is the same in all documents that have it, so
   stretches are compared like runs. Of each the first document remains, whose windows are compared with the least doc_id of each.

As the first document stands for all with the same run, block or stretch, the least doc_id of every window is exact.
Removed windows merge into maximal intervals by a difference array over the document's words.

Every group is aggregated before its shuffle and joined back by an equi-join that adaptive execution
splits, so a passage in a third of all documents is in no single task. Equality is by two 64-bit
hashes (key and run, key and window). Texts are read three times and shuffled once, for the result. Runs and
windows are written to the checkpoint folder.

Null texts have no words. Rows without doc_id are never smaller than any, and keep their words unless
another row removes them. Rows with equal doc_id and text are treated alike, and each further one costs
as much as the first. Texts of fewer than `width` words keep all; long ones are taken whole. An empty table
gives no rows. Columns of the input are passed on by `remove_repeats`, whatever their names; its own
(n_words, n_removed, removed) replace those of the same name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphquarry.llm import batches as B
from graphquarry.operators.components import written

WIDTH, GRAM, CUT = 50, 8, 8
SIEVE_BITS = 25
KEY = ["__id", "__k1"]
LAST = (1 << 63) - 1


def known(docs: DataFrame, text: str, *columns: Column) -> DataFrame:
    """__id, __k1 and __text: rows without doc_id get the last number; __k1 tells rows of one doc_id apart by text."""
    content = B.text_or_empty(text)
    return docs.select(*columns, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("__id"), F.xxhash64(content).alias("__k1"), content.alias("__text"))


class Sieve:
    """A broadcast bit for each slot of 64-bit values."""

    def __init__(self, values: DataFrame, column: str):
        slot = F.pmod(column, F.lit(1 << SIEVE_BITS))
        bits = values.select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
        found, words = bits.toArrow(), np.zeros(1 << (SIEVE_BITS - 6), np.uint64)  # a row for each word at most
        words[np.asarray(found["w"], np.int64)] = np.asarray(found["b"], np.int64).view(np.uint64)
        self.words = values.sparkSession.sparkContext.broadcast(words)

    def release(self) -> None:
        """To be called when all that was read through it has been written."""
        self.words.destroy()

    def __getstate__(self):
        return {"words": self.words}

    def passes(self, values: np.ndarray) -> np.ndarray:
        slot = values & np.uint64((1 << SIEVE_BITS) - 1)
        return ((self.words.value[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)


def least_in(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values, in doubling steps."""
    size, out = 1, values
    while 2 * size <= width:
        out, size = np.minimum(out[:-size], out[size:]), 2 * size
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def windows(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Of all windows in one document each: document, position, key and hash; and the words' bounds."""
    starts, ends, first = B.word_bounds(data, off)
    words = B.word_hashes(data, starts, ends)
    doc, at = B.within(first, width)
    place = first[doc] + at
    hashes = B.window_hashes(words, width)
    gram = min(GRAM, width)
    keys = least_in(B.window_hashes(words, gram), width - gram + 1) if len(hashes) else hashes
    return doc, at, keys[place], hashes[place], starts, ends, first


def runs_of(doc: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of consecutive windows of one document with one key."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])]))
    return start, np.diff(np.append(start, len(doc)))


def long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64, copy=False))


RUNS = "__key long, __run long, __id long, __k1 long, __at int, __n int"
BLOCKS = "__key long, __run long, __id long, __k1 long, __at int, __n int, __windows array<long>"
_names = lambda schema: [x.split()[0] for x in schema.split(", ")]


def run_hashes(hashes: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One hash of each run's windows, in which their order counts."""
    if not len(start):
        return np.zeros(0, np.uint64)
    place = (np.arange(len(hashes)) - np.repeat(start, n)).astype(np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * (np.uint64(2) * place + np.uint64(B.BASE)), dtype=np.uint64)])
    return B.mixed(total[start + n] - total[start] + n.astype(np.uint64))


def key_rows(docs: DataFrame, width: int) -> DataFrame:
    """(__key, __id), once for each run."""

    def go(parts):
        for part in parts:
            ids = np.asarray(part.column(0), np.int64)
            for a, _, data, off in B.chunks(*B.buffers(part.column(1))):
                doc, _, keys, *_ = windows(data, off, width)
                start, _ = runs_of(doc, keys)
                yield pa.RecordBatch.from_arrays([long(keys[start]), long(ids[a + doc[start]])], ["__key", "__id"])

    return B.ship(docs.select("__id", "__text")).mapInArrow(go, "__key long, __id long")


def run_rows(docs: DataFrame, width: int, shared: Sieve) -> DataFrame:
    def go(parts):
        for part in parts:
            meta = [np.asarray(part.column(i), np.int64) for i in range(2)]
            for a, _, data, off in B.chunks(*B.buffers(part.column(2))):
                doc, at, keys, hashes, *_ = windows(data, off, width)
                start, n = runs_of(doc, keys)
                whole = run_hashes(hashes, start, n)
                k = shared.passes(keys[start])
                start, n, whole = start[k], n[k], whole[k]
                yield pa.RecordBatch.from_arrays([long(keys[start]), long(whole), *(long(m[a + doc[start]]) for m in meta), pa.array(at[start].astype(np.int32)), pa.array(n.astype(np.int32))], _names(RUNS))

    return docs.select(*KEY, "__text").mapInArrow(go, RUNS)


def block_rows(docs: DataFrame, width: int, unsure: Sieve) -> DataFrame:
    """Blocks of the runs that pass, by key, run hash and document: a run is cut before windows whose hash is a multiple of CUT."""

    def go(parts):
        for part in parts:
            meta = [np.asarray(part.column(i), np.int64) for i in range(2)]
            for a, _, data, off in B.chunks(*B.buffers(part.column(2))):
                doc, at, keys, hashes, *_ = windows(data, off, width)
                start, n = runs_of(doc, keys)
                k = unsure.passes(keys[start] ^ run_hashes(hashes, start, n) ^ meta[0][a + doc[start]].view(np.uint64))
                rows = B.ragged(start[k], n[k])
                cut = hashes[rows] % np.uint64(CUT) == 0
                cut[np.cumsum(n[k]) - n[k]] = True
                first = np.flatnonzero(cut)
                size = np.diff(np.append(first, len(rows)))
                own = hashes[rows]
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(rows)).astype(np.int32)), long(own))
                rows = rows[first]
                yield pa.RecordBatch.from_arrays([long(keys[rows]), long(run_hashes(own, first, size)), *(long(m[a + doc[rows]]) for m in meta), pa.array(at[rows].astype(np.int32)), pa.array(size.astype(np.int32)), lists], _names(BLOCKS))

    return docs.select(*KEY, "__text").mapInArrow(go, BLOCKS)


def stretch_rows(blocks: DataFrame, repeated: Sieve) -> DataFrame:
    """Blocks cut to the stretches whose windows pass; the others are in no second document."""

    def go(parts):
        for part in parts:
            lists = part.column(4)
            own, bounds = np.asarray(lists.flatten(), np.int64).view(np.uint64), np.asarray(lists.offsets, np.int64)
            keys, *meta = (np.asarray(part.column(i), np.int64) for i in range(4))
            owner = np.repeat(np.arange(len(part)), np.diff(bounds))
            hit = np.concatenate([[False], repeated.passes(keys.view(np.uint64)[owner] ^ own), [False]])
            turn = np.concatenate([[True], owner[1:] != owner[:-1], [True]])[: len(own) + 1]
            start, end = np.flatnonzero(hit[1:] & (turn | ~hit[:-1])), np.flatnonzero(hit[:-1] & (turn | ~hit[1:]))
            n, row = end - start, owner[start]
            first, hashes = np.cumsum(n) - n, own[B.ragged(start, n)]
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(hashes)).astype(np.int32)), long(hashes))
            at = meta[2][row] + start - (bounds[row] - bounds[0])
            yield pa.RecordBatch.from_arrays([long(keys[row]), long(run_hashes(hashes, first, n)), *(long(m[row]) for m in meta[:2]), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), lists], _names(BLOCKS))

    return blocks.select("__key", *KEY, "__at", "__windows").mapInArrow(go, BLOCKS)


def exploded(blocks: DataFrame) -> DataFrame:
    """A row for each window of the blocks."""
    return blocks.select("__key", *KEY, F.posexplode("__windows").alias("i", "__hash"), "__at").select("__key", "__hash", *KEY, (F.col("__at") + F.col("i")).alias("__at"))


def removed(docs: DataFrame, width: int) -> DataFrame:
    """For documents with repeats: __id, __k1 and `__spans`, an array of (first window, number of windows)."""
    several_docs = key_rows(docs, width).groupBy("__key").agg(F.min("__id").alias("a"), F.max("__id").alias("b")).where("a < b")
    sieve = Sieve(several_docs, "__key")
    runs = written(run_rows(docs, width, sieve))
    sieve.release()
    pair = ["__key", "__run"]
    first = written(runs.groupBy(*pair).agg(F.min("__id").alias("__first")))  # written, so that the join deals both sides anew and can split hot keys
    marked = runs.join(first, pair)
    whole = marked.where(F.col("__id") > F.col("__first")).select(*KEY, "__at", "__n")
    several_runs = written(first.groupBy("__key").agg(F.count("*").alias("n")).where("n > 1").select("__key"))  # written for the same reason
    unsure = first.join(several_runs, "__key", "left_semi").select(F.col("__key").bitwiseXOR(F.col("__run")).bitwiseXOR(F.col("__first")).alias("__slot"))
    sieve = Sieve(unsure, "__slot")
    blocks = written(block_rows(docs, width, sieve))
    sieve.release()
    mine = blocks.join(written(blocks.groupBy(*pair).agg(F.min("__id").alias("__first"))), pair)
    again = mine.where(F.col("__id") > F.col("__first")).select(*KEY, "__at", "__n")
    alone = written(mine.where(F.col("__id") == F.col("__first")).select("__key", *KEY, "__at", "__windows"))
    least = written(exploded(alone).groupBy("__key", "__hash").agg(F.min("__id").alias("__first"), F.max("__id").alias("__most")).where(F.col("__first") < F.col("__most")).drop("__most"))
    sieve = Sieve(least.select(F.col("__key").bitwiseXOR(F.col("__hash")).alias("__slot")), "__slot")
    stretches = written(stretch_rows(alone, sieve))
    sieve.release()
    mine = stretches.join(written(stretches.groupBy(*pair).agg(F.min("__id").alias("__first"))), pair)
    passages = mine.where(F.col("__id") > F.col("__first")).select(*KEY, "__at", "__n")
    rest = written(exploded(mine.where(F.col("__id") == F.col("__first"))))  # of each stretch the first document's
    single = rest.join(least, ["__key", "__hash"]).where(F.col("__id") > F.col("__first")).select(*KEY, "__at", F.lit(1).alias("__n")).unionByName(passages)
    spans = whole.unionByName(again).unionByName(single).distinct()  # rows equal in doc_id and text have the same ones
    return spans.groupBy(*KEY).agg(F.collect_list(F.struct("__at", "__n")).alias("__spans"))


def remove_repeats(docs: DataFrame, width: int = WIDTH, text: str = "text", digests: bool = False) -> DataFrame:
    """The documents without repeated passages.

    By default all columns, where the text has lost the removed words (and the white space before each),
    with n_words, n_removed and removed (array of intervals of word positions, end exclusive). With
    digests: doc_id, n_words, n_removed, kept_sha256 of the kept words joined by a space.
    """
    spans = removed(known(docs, text), width)
    keep = [c for c in docs.columns if c not in (text, "n_words", "n_removed", "removed")]
    if digests:
        source = known(docs, text).join(spans.hint("shuffle_hash"), KEY, "left").select(F.when(F.col("__id") != LAST, F.col("__id")).alias("doc_id"), "__text", "__spans")
    else:
        source = known(docs, text, B.packed(docs, keep)).join(spans.hint("shuffle_hash"), KEY, "left").select(B.ROW, "__text", "__spans")
    types = [source.schema[0]]
    tail = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    tail += [T.StructField("kept_sha256", T.StringType())] if digests else [T.StructField("removed", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("__text", T.StringType())]
    schema = T.StructType(types + tail)

    def go(parts):
        for part in parts:
            k = len(types)
            spans = part.column(k + 1)
            bounds = np.asarray(spans.offsets, np.int64)
            inner = spans.flatten() if not spans.null_count else spans.values
            at, n = np.asarray(inner.field(0), np.int64), np.asarray(inner.field(1), np.int64)
            if not spans.null_count:
                bounds = bounds - bounds[0]
            for a, z, data, off in B.chunks(*B.buffers(part.column(k))):
                starts, ends, first = B.word_bounds(data, off)
                owner = np.repeat(np.arange(z - a), np.diff(bounds[a : z + 1]))
                s = slice(bounds[a], bounds[z])
                edge = np.zeros(len(starts) + 1, np.int64)
                np.add.at(edge, first[owner] + at[s], 1)
                np.add.at(edge, first[owner] + at[s] + n[s] + width - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                out = [part.column(i).slice(a, z - a) for i in range(k)]
                out += [pa.array(np.diff(first)), pa.array(B.sums(gone, first))]
                raw, cut = data.tobytes(), off.tolist()
                if digests:
                    out.append(pa.array([hashlib.sha256(b" ".join(raw[i:j] for i, j in zip(starts[f:t][~gone[f:t]].tolist(), ends[f:t][~gone[f:t]].tolist(), strict=True))).hexdigest() for f, t in zip(first, first[1:], strict=False)], pa.string()))
                else:
                    intervals, texts = [], []
                    for i, (f, t) in enumerate(zip(first, first[1:], strict=False)):
                        g = np.concatenate([[False], gone[f:t], [False]])
                        turn = np.flatnonzero(g[1:] != g[:-1]).reshape(-1, 2).tolist()
                        intervals.append(turn)
                        pieces, pos = [], cut[i]
                        for x, y in turn:
                            begin = int(ends[f + x - 1]) if x else cut[i]
                            pieces.append(raw[pos:begin])
                            pos = int(ends[f + y - 1])
                        texts.append((b"".join(pieces) + raw[pos : cut[i + 1]]).decode())
                    out += [pa.array(intervals, pa.list_(pa.list_(pa.int32()))), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(out, schema.names)

    out = B.ship(source).mapInArrow(go, schema)
    if digests:
        return out
    made = {"n_words": "n_words", "n_removed": "n_removed", "removed": "removed", text: "__text"}
    return B.unpacked(out, list(dict.fromkeys([*docs.columns, *made])), made)


def oracle(width: int = WIDTH) -> str:
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS w FROM documents),
i AS (SELECT doc_id, i, array_to_string(w[i:i + {width - 1}], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - {width - 2})) AS i FROM w)),
m AS (SELECT win, min(doc_id) AS first FROM i GROUP BY win HAVING min(doc_id) < max(doc_id)),
g AS (SELECT doc_id, list(DISTINCT p) AS p FROM (SELECT doc_id, unnest(range(i, i + {width})) AS p FROM i JOIN m USING (win) WHERE doc_id > first) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(p), 0)::BIGINT AS n_removed,
  sha256(coalesce(CASE WHEN p IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(p, k)), lambda k: w[k]), ' ') END, '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)"""
