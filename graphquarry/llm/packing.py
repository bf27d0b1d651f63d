"""Best-fit packing of tokenised documents into sequences of bounded length.

Best-two-fit on the histogram of lengths: a sequence begins with the longest unpacked piece and is
filled greedily with the longest piece that fits; then its smallest piece is exchanged for the two
unpacked pieces that fill the gap so widened most tightly, if they fill it better. As pieces of one
length are alike, a filling is repeated at once for as long as its lengths last, so the plan has a
few thousand fillings at most (each uses a length up or leaves less of it than one filling takes),
whatever the number of documents. The plan is worked out on the driver from at most `limit` counts.

Pieces get their place in the plan by their rank among pieces of equal length: a rank in the task
that made the piece, plus the number of such pieces in tasks before. So no length is gathered in
one task, even if a third of all pieces have it. The pieces' numbers (not their ids) are written to
the checkpoint folder, because ranks have to come from one run.

Nulls: a null text is empty, and has the closing id only. A null doc_id is passed on. Repeated rows
are packed each for itself; equal lengths (ties) take places in the order of their ranks. An empty
table gives no rows. Columns of the input other than doc_id and the text are not read, so their names do
not matter. Long texts are taken whole.

Ids are the library's, with its defaults: a literal of an added token in a text (`<|endoftext|>`) is that
token. Texts with one go to the library whole; others in parts, each distinct part once.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphquarry.llm import batches as B
from graphquarry.operators.components import ensure_checkpoint_dir

MOST_KEPT = 700_000
#: 0: white space, 1: a to z, 2: A to Z, 3: ASCII punctuation but the apostrophe, 7: all else.
KIND = np.full(256, 7, np.int8)
KIND[B.SPACE] = 0
KIND[0x61:0x7B], KIND[0x41:0x5B] = 1, 2
KIND[[x for x in range(0x21, 0x7F) if not chr(x).isalnum() and chr(x) != "'"]] = 3


#: One match of the pattern that the normaliser leaves as it is: small Latin letters, or ASCII punctuation.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[!-&(-/:-@\[-`{-~]+")


def byte_characters() -> dict[int, str]:
    """The character by which byte-level vocabularies show each byte: itself if it prints, else the next from 256."""
    out, other = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[b] = chr(b)
        else:
            out[b] = chr(other)
            other += 1
    return out


class WordTokenizer:
    """Ids of whole texts from a `tokenizers` file whose pieces never cross white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.literals = [x.content.encode() for x in self.inner.get_added_tokens_decoder().values()]
        self.model, self.shown = self.inner.model, byte_characters()
        self.kept, self.ids = B.Interner(MOST_KEPT), B.Values(np.int32)

    @staticmethod
    def parts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text with A-Z in lower case, starts and ends of parts that have the ids they have apart, and each text's first.

        Words, cut further between an ASCII letter and ASCII punctuation, where the pattern's matches
        always end; only an apostrophe may belong to a match with letters. A letter before a character
        that is not ASCII keeps its case, because the normaliser may join the two.
        """
        kind = KIND[data]
        ascii_next = np.ones(len(data), bool)
        ascii_next[:-1] = data[1:] < 0x80
        data = np.where((kind == 2) & ascii_next, data | 0x20, data)
        kind[kind == 2] = 1
        begin = kind != 0
        begin[1:] &= (kind[:-1] == 0) | (kind[1:] + kind[:-1] == 4)
        cut = off[:-1][np.diff(off) > 0]
        begin[cut] = kind[cut] != 0
        last = kind != 0
        last[:-1] &= (kind[1:] == 0) | begin[1:]
        starts = np.flatnonzero(begin)
        return data, starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)

    def with_literals(self, data: np.ndarray, off: np.ndarray) -> list[int]:
        """Texts that hold a literal of an added token, which the library finds before it cuts a text up."""
        raw = data.tobytes()
        if not any(x in raw for x in self.literals):
            return []
        return [i for i, (a, z) in enumerate(zip(off.tolist(), off[1:].tolist(), strict=False)) if any(raw.find(x, a, z) >= 0 for x in self.literals)]

    def encode_batch(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text: those of the library with its defaults and no special tokens added."""
        whole = self.with_literals(data, off)
        if not whole:
            return self.by_parts(data, off)
        found = [x.ids for x in self.inner.encode_batch_fast([data[off[i] : off[i + 1]].tobytes().decode() for i in whole], add_special_tokens=False)]
        data = data.copy()
        for i in whole:
            data[off[i] : off[i + 1]] = 0x20
        ids, counts = self.by_parts(data, off)
        sizes = np.array([len(x) for x in found], np.int64)
        place = np.repeat((np.cumsum(counts) - counts)[whole], sizes)
        counts[whole] = sizes
        return np.insert(ids, place, np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))), counts

    def by_parts(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data, starts, ends, first = self.parts(data, off)
        index, new = self.kept.index(data, starts, ends)
        if len(new):
            words = B.strings(data, starts[new], ends[new])
            other = [x.decode() for x in words if not PLAIN.fullmatch(x)]
            whole = iter(self.inner.encode_batch_fast(other, add_special_tokens=False))
            self.ids.put(len(self.kept), [[t.id for t in self.model.tokenize(x.decode("latin-1").translate(self.shown))] if PLAIN.fullmatch(x) else next(whole).ids for x in words])
        ids, sizes = self.ids.get(index)
        self.kept.commit(new)
        return ids, B.sums(sizes, first)


def tokenizer(path: str) -> WordTokenizer:
    return B.held(("words", path), lambda: WordTokenizer(path))


PIECES = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("__task", T.IntegerType()), T.StructField("__rank", T.LongType())])


def pieces(docs: DataFrame, path: str, limit: int, closing: int, text: str) -> DataFrame:
    source = docs.select("doc_id", B.text_or_empty(text).alias("__text"))

    def run(parts):
        words, task, seen = tokenizer(path), TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        for part in parts:
            for a, z, data, off in B.chunks(*B.buffers(part.column(1))):
                ids, counts = words.encode_batch(data, off)
                before = np.cumsum(counts) - counts
                full = np.insert(ids.astype("<u4"), before + counts, closing)
                total = counts + 1
                many = (total + limit - 1) // limit
                doc = np.repeat(np.arange(z - a), many)
                piece = B.ragged(np.zeros(z - a, np.int64), many)
                start = piece * limit
                length = np.minimum(limit, total[doc] - start)
                at = (np.cumsum(total) - total)[doc] + start
                crc = [zlib.crc32(full[x : x + n]) for x, n in zip(at.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                run_of = length[order]
                fresh = np.searchsorted(run_of, run_of)
                rank = np.empty(len(length), np.int64)
                rank[order] = seen[run_of] + np.arange(len(order)) - fresh
                seen += np.bincount(length, minlength=limit + 1)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(a, z - a).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task, np.int32)), pa.array(rank)], ["doc_id", *PIECES.names])

    return B.ship(source).mapInArrow(run, T.StructType([docs.schema["doc_id"], *PIECES]))


def floor_of(count: np.ndarray) -> np.ndarray:
    """For each size the largest length up to it of which there are any; 0 if none."""
    return np.maximum.accumulate(np.where(count > 0, np.arange(len(count)), 0))


def best_two_fit(count: np.ndarray, limit: int) -> list[tuple[int, dict[int, int]]]:
    """Fillings as (how many sequences, {length: pieces of it in each}). count[n]: pieces of length n."""
    count, out = count.copy(), []
    floor = floor_of(count)
    while longest := int(floor[limit]):
        used, gap = {longest: 1}, limit - longest
        size = min(gap, longest)
        while size > 0 and (n := int(floor[size])):
            k = min(gap // n, int(count[n]) - used.get(n, 0))
            if k > 0:
                used[n] = used.get(n, 0) + k
                gap -= k * n
            size = min(gap, n - 1)
        if gap and len(used) + max(used.values()) > 2:
            small = min(used)
            rest = count.copy()
            for n, k in used.items():
                rest[n] -= k
            room, below = gap + small, floor_of(rest)
            first = np.flatnonzero(rest[: room + 1])
            second = below[room - first]
            alone = (second == first) & (rest[first] < 2)
            second = np.where(alone, below[np.maximum(first - 1, 0)], second)
            both = np.where(second > 0, first + second, 0)
            if len(both) and both.max() > small:
                best = int(both.argmax())
                used[small] -= 1
                for n in (int(first[best]), int(second[best])):
                    used[n] = used.get(n, 0) + 1
                used = {n: k for n, k in used.items() if k}
        times = min(int(count[n]) // k for n, k in used.items())
        for n, k in used.items():
            count[n] -= times * k
        out.append((times, used))
        floor = floor_of(count)
    return out


def plan_of(fillings: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """Rows (length, first rank, first sequence, pieces in each sequence, offset), sorted by length and rank."""
    rows, ranks, sequence = [], {}, 0
    for times, used in fillings:
        offset = 0
        for n in sorted(used, reverse=True):
            rows.append((n, ranks.get(n, 0), sequence, used[n], offset))
            ranks[n] = ranks.get(n, 0) + times * used[n]
            offset += n * used[n]
        sequence += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "sequence", "each", "offset"), columns, strict=True))


def pack_documents(docs: DataFrame, path: str, limit: int = 4096, closing: int = 1, text: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids followed by `closing`; one of over `limit` ids is cut into pieces of `limit`.
    Sequences are numbered from 0 and have no gaps between pieces.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    made = pieces(docs, path, limit, closing, text).checkpoint()
    per_task = made.groupBy("length", "__task").agg(F.count("*").alias("n"))
    count = np.zeros(limit + 1, np.int64)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length at most
        count[row.length] = row.n
    plan = plan_of(best_two_fit(count, limit))
    top = int(count.max()) + 1
    base = per_task.select("length", "__task", (F.sum("n").over(Window.partitionBy("length").orderBy("__task")) - F.col("n")).alias("__base"))
    ranked = made.join(base, ["length", "__task"]).select(*(c for c in made.columns if not c.startswith("__")), (F.col("__base") + F.col("__rank")).alias("__rank"))
    plan = ranked.sparkSession.sparkContext.broadcast(plan)

    def run(parts):
        p = plan.value
        key = p["length"] * top + p["rank"]
        for part in parts:
            length, rank = np.asarray(part.column("length"), np.int64), np.asarray(part.column("__rank"), np.int64)
            at = np.searchsorted(key, length * top + rank, "right") - 1
            within = rank - p["rank"][at]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(p["sequence"][at] + within // p["each"][at]), pa.array(p["offset"][at] + within % p["each"][at] * length)], names)

    schema = T.StructType([*ranked.schema.fields[:-1], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = schema.names
    return ranked.mapInArrow(run, schema)
