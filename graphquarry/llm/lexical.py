"""Ranked lexical search: an inverted index in shards, merged document at a time.

`build` cuts the documents of each task into shards of about `SHARD_BYTES` of text, without a shuffle. In a
shard documents are numbered by doc_id, and each term has its postings in that order: gaps between numbers
and term frequencies, as variable-length integers. A row of the index is a term of a shard, or (without a
term) the shard itself with the doc_ids and lengths of its documents. Rows of a shard are sorted by term,
so that a reader of a few terms skips row groups.

`search` takes queries in blocks of at most `BLOCK_BYTES` (one query at least), which are broadcast.
Only postings of a block's terms are sent on, all those of a shard to one task. There each query merges
its lists document at a time through a heap of k cursors, and keeps its best in a heap of bounded size, keyed
by score and then doc_id; the heaps of all shards are merged by Spark, which keeps a task's best before it
shuffles. Scores are whole numbers, with terms weighed by the whole corpus, so that they do not depend on shards.

Null and empty texts have no term, are no documents of the statistics and are never found. Rows without
doc_id are found like others and come last among equal scores; so are rows whose doc_id is no whole
number, with a null one. Repeated rows are documents of their own, and each may be found; equal ones are told apart by
rank alone. Long texts are taken whole, and a text over the bound is a shard. Queries without terms have no rows,
and neither has an empty table. Only doc_id and the text are read, whatever other columns are called.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphquarry.llm import batches as B
from graphquarry.operators.components import written

SHARD_BYTES, SHARD_DOCS, BLOCK_BYTES, BATCH_ROWS = 16 << 20, 1 << 22, 8 << 20, 20_000
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes that no term has; every byte from 0x80 on belongs to one.
NO_TERM = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
LOWER = np.array([b | 0x20 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else b for b in range(256)], np.uint8)
INDEX = "shard long, term string, docs long, total long, ids binary, counts binary"
NAMES = [x.split()[0] for x in INDEX.split(", ")]
#: In a merge a posting is one number: document, then its part of the score.
PART_BITS = 40


class Shard:
    """Terms of documents, gathered until they are written."""

    def __init__(self, most: int):
        self.most, self.terms = most, B.Lexicon()
        self.clear(0)

    def clear(self, size: int) -> None:
        self.docs, self.bytes = 0, 0
        self.numbers, self.owners, self.ids, self.known, self.lengths = [], [], [], [], []
        self.terms.clear(size)

    def fits(self, docs: int, size: int) -> bool:
        return self.terms.fits(size) and self.bytes + size <= self.most and self.docs + docs <= SHARD_DOCS

    def add(self, ids: np.ndarray, known: np.ndarray, data: np.ndarray, off: np.ndarray) -> None:
        data = LOWER[data]
        starts, ends, first = B.word_bounds(data, off, NO_TERM)
        length = np.diff(first)
        full = np.flatnonzero(length)
        self.numbers.append(self.terms.numbers(data, starts, ends))
        self.owners.append(np.repeat(np.arange(len(full), dtype=np.int32) + self.docs, length[full]))
        self.ids.append(ids[full])
        self.known.append(known[full])
        self.lengths.append(length[full])
        self.docs += len(full)
        self.bytes += len(data)

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        if not self.docs:
            return
        ids, known, lengths = map(np.concatenate, (self.ids, self.known, self.lengths))
        order = np.lexsort((ids, ~known))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        words = self.terms.words
        alphabet = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        rank = np.empty(len(alphabet), np.int64)
        rank[alphabet] = np.arange(len(alphabet))
        keys = np.sort(rank[np.concatenate(self.numbers)] * len(order) + place[np.concatenate(self.owners)])
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        tf = np.diff(np.append(start, len(keys)))
        term, doc = np.divmod(keys[start], len(order))
        head = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        gap = np.diff(doc, prepend=0)
        gap[head] = doc[head]
        size = np.diff(np.append(head, len(term)))
        gaps, n_gap = B.varints(gap)
        counts, n_count = B.varints(tf)
        cut = lambda n: np.concatenate([[0], np.cumsum(n)])[np.append(head, len(term))]
        own_ids, own_lengths = ids[order][: int(known.sum())].astype("<i8").tobytes(), lengths[order].astype("<i8").tobytes()
        texts = [None, *(words[i].decode() for i in alphabet)]
        column = lambda whole, data, bounds: pa.concat_arrays([pa.array([whole], pa.binary()), B.blobs(data, bounds)])
        total = np.add.reduceat(tf, head)
        made = [pa.array(np.full(len(texts), shard)), pa.array(texts, pa.string()), pa.array(np.concatenate([[len(order)], size])), pa.array(np.concatenate([[lengths.sum()], total])), column(own_ids, gaps, cut(n_gap)), column(own_lengths, counts, cut(n_count))]
        rows = pa.RecordBatch.from_arrays(made, NAMES)
        for at in range(0, len(rows), BATCH_ROWS):
            yield rows.slice(at, BATCH_ROWS)


def build(docs: DataFrame, text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of the documents, written to the checkpoint folder: (shard, term, docs, total, ids, counts)."""
    source = docs.select(F.col("doc_id").cast("string").try_cast("long").alias("doc_id"), B.text_or_empty(text).alias("text"))

    def run(parts):
        shard, number = Shard(shard_bytes), TaskContext.get().partitionId() << 32
        for part in parts:
            known = np.asarray(part.column(0).is_valid())
            ids = np.asarray(part.column(0).fill_null(0), np.int64)
            for a, z, data, off in B.chunks(*B.buffers(part.column(1))):
                if not shard.fits(z - a, len(data)):
                    yield from shard.rows(number)
                    number += 1
                    shard.clear(len(data))
                shard.add(ids[a:z], known[a:z], data, off)
        yield from shard.rows(number)
        B.trim()

    return written(B.ship(source).mapInArrow(run, INDEX))


def terms_of(text: str | None) -> list[str]:
    """The terms of a query, each once."""
    data = LOWER[np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)]
    starts, ends, _ = B.word_bounds(data, np.array([0, len(data)]), NO_TERM)
    return sorted({x.decode() for x in B.strings(data, starts, ends)})


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def merged(lists: list[list[int]], k: int) -> list[tuple[int, int]]:
    """(score, document) of the k best of several lists of postings in the order of documents; of equal scores the first documents."""
    best: list[tuple[int, int]] = []
    at, score, mask = -1, 0, (1 << PART_BITS) - 1

    def offer():
        if score and at >= 0:
            if len(best) < k:
                heapq.heappush(best, (score, -at))
            elif score > best[0][0]:  # documents come in order, so an equal one is behind all that are kept
                heapq.heapreplace(best, (score, -at))

    for x in heapq.merge(*lists):
        doc = x >> PART_BITS
        if doc != at:
            offer()
            at, score = doc, 0
        score += x & mask
    offer()
    return [(s, -d) for s, d in best]


def blocks(queries: DataFrame, item: str, text: str):
    """Lists of (item, terms), each of bounded size, one after another."""
    block, size = [], 0
    for row in queries.select(item, B.text_or_empty(text).alias("t")).toLocalIterator():
        if terms := terms_of(row["t"]):
            own = sum(map(len, terms)) + 64 * len(terms)
            if block and size + own > BLOCK_BYTES:
                yield block
                block, size = [], 0
            block.append((row[item], terms))
            size += own
    if block:
        yield block


def of_block(index: DataFrame, block: list, k: int, n: int, total: int) -> DataFrame:
    """(query, doc_id, score): of each shard the best of each query of the block."""
    spark = index.sparkSession
    asked = spark.createDataFrame([(t,) for t in sorted({t for _, terms in block for t in terms})], "term string")
    hits = index.where("term is not null").join(F.broadcast(asked), "term")  # a block's terms, bounded by BLOCK_BYTES
    weights = {r.term: weight(n, r.df) for r in hits.groupBy("term").agg(F.sum("docs").alias("df")).collect()}  # a row for each of these terms
    wanted = [[t for t in terms if weights.get(t, 0) > 0] for _, terms in block]
    shared = spark.sparkContext.broadcast((weights, wanted))

    def run(rows: pa.Table) -> pa.Table:
        weights, wanted = shared.value
        rows = rows.combine_chunks()
        terms, ids, counts = rows.column("term").to_pylist(), rows.column("ids"), rows.column("counts")
        whole = terms.index(None)
        raw = lambda column, i: np.frombuffer(column[i].as_buffer(), np.uint8)
        doc_ids, lengths = raw(ids, whole).view("<i8"), raw(counts, whole).view("<i8")
        m = 50 + (50 * lengths * n) // total
        kept = {}
        for i, t in enumerate(terms):
            if t is not None and weights[t] > 0:
                doc, tf = np.cumsum(B.from_varints(raw(ids, i))), B.from_varints(raw(counts, i))
                kept[t] = (doc << PART_BITS) + weights[t] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        found = defaultdict(list)
        for q, own in enumerate(wanted):
            for score, doc in merged([kept[t].tolist() for t in own if t in kept], k):
                found["q"].append(q)
                found["doc_id"].append(int(doc_ids[doc]) if doc < len(doc_ids) else None)
                found["score"].append(score)
        B.trim()
        return pa.table({"q": pa.array(found["q"], pa.int32()), "doc_id": pa.array(found["doc_id"], pa.int64()), "score": pa.array(found["score"], pa.int64())})

    rows = hits.select(*NAMES).unionByName(index.where("term is null"))
    return B.ship(rows).groupBy("shard").applyInArrow(run, "q int, doc_id long, score long")


def search(index: DataFrame, queries: DataFrame, k: int = 50, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, rank, doc_id, score) of the k best documents of each query with a score above 0; equal scores by doc_id, null last."""
    spark = index.sparkSession
    sums = index.where("term is null").agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first()
    numbered = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("item", queries.schema[item].dataType)])
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    names = [F.col("item").alias(item), "rank", "doc_id", "score"]
    out = spark.createDataFrame([], numbered).select(F.col("item").alias(item), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    for block in blocks(queries, item, text):
        rows = of_block(index, block, k, sums["n"], sums["total"]).select("*", F.row_number().over(best).alias("rank")).where(F.col("rank") <= k)
        asked = spark.createDataFrame([(q, x) for q, (x, _) in enumerate(block)], numbered)
        out = out.unionByName(rows.join(F.broadcast(asked), "q").select(*names))
    return out


def oracle(k: int = 50) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = lambda t: f"regexp_extract_all(translate(coalesce({t}, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {terms('text')} AS t FROM documents),
w AS (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d),
p AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM w GROUP BY r, term),
c AS (SELECT count(*) AS docs, sum(len(t))::BIGINT AS total FROM d WHERE len(t) > 0),
f AS (SELECT term, floor(1000 * ln((2 * c.docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term, c.docs),
b AS MATERIALIZED (SELECT row_number() OVER () AS q, item_id, {terms('text')} AS t FROM benchmark),
q AS (SELECT q, item_id, unnest(list_distinct(t)) AS term FROM b),
s AS (SELECT q, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id,
    sum(f.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * c.docs) // c.total))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN f USING (term), c GROUP BY q, r)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= {k}"""
