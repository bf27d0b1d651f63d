"""Byte-level BPE encoding and decoding with numpy.

A text is cut into pieces by the tokeniser's pattern. Pieces of about equal length stand as rows of
one padded matrix of token ids. In each round every row merges its leftmost pair of least rank,
looked up in a hash table of pairs, so that all rows lose one column at once; rows without a
mergeable pair leave the matrix (compaction). A piece is encoded once and then kept by its text in
a bounded table, because pieces recur.

The matrix costs the square of a piece's length. Pieces over `LONG_PIECE` bytes (a run of one
script without a space, say) take the same merges from a heap, in n log n.

Nulls: a null text is an empty one: no ids, no bytes. Repeated rows give equal results. Columns of
the input are passed on if they are named in `keep`, unless they are called like a result, which then wins.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphquarry.llm import batches as B

LONG_PIECE = 256
MOST_KEPT = 700_000
#: First bytes of characters that are not white space.
SOLID = np.zeros(256, bool)
SOLID[0x21:0x7F] = SOLID[0xC3:0xE0] = True
NONE = np.int32(2**31 - 1)


class PairTable:
    """Open addressing from a pair of ids to the merged id, probed for many pairs at once."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        bits = max(4, int(2 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        todo, at = np.arange(len(pairs)), self.home(pairs)
        while len(todo):
            free = self.keys[at] < 0
            self.keys[at[free]], self.values[at[free]] = pairs[todo[free]], merged[todo[free]]
            lost = self.keys[at] != pairs[todo]
            todo, at = todo[lost], (at[lost] + 1) & self.mask

    def home(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(B.BASE)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = self.home(pairs)
        found = self.keys[at]
        out = np.where(found == pairs, self.values[at], NONE)
        open_ = np.flatnonzero((found != pairs) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == pairs[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs.append((a << 32) | b)
                    merged.append(rank)
        self.table = PairTable(np.array(pairs, np.int64), np.array(merged, np.int32))
        size = max(ranks.values()) + 1
        names = [b""] * size
        for token, rank in ranks.items():
            names[rank] = token
        self.token_bytes = np.frombuffer(b"".join(names), np.uint8)
        self.token_length = np.array([len(x) for x in names], np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.forget()

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}, pattern)

    def forget(self) -> None:
        self.kept, self.ids = B.Interner(MOST_KEPT), B.Values(np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece. Buckets have lengths of one power of two, split where padding would exceed half."""
        out: list[list[int]] = [[]] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for i in np.flatnonzero(lengths > LONG_PIECE):
            out[i] = self.by_heap(pieces[i])
        order = np.argsort(lengths, kind="stable")
        order = order[(lengths[order] > 0) & (lengths[order] <= LONG_PIECE)]
        at = 0
        while at < len(order):
            least = lengths[order[at]]
            end = int(np.searchsorted(lengths[order], least + max(2, least // 2), "left"))
            end = min(end, at + max(1, 4_000_000 // int(lengths[order[end - 1]])))
            rows = order[at:end]
            for row, ids in zip(rows, self.merge([pieces[i] for i in rows], lengths[rows]), strict=True):
                out[row] = ids
            at = end
        return out

    def merge(self, pieces: list[bytes], lengths: np.ndarray) -> list[list[int]]:
        n, width = len(pieces), int(lengths.max())
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full((n, width), NONE, np.int32)
        both = ids[:, 1:] >= 0
        rank[:, :-1][both] = self.table.find(ids[:, :-1][both], ids[:, 1:][both])
        row, done = np.arange(n), [[]] * n
        left = lengths.copy()
        while len(row):
            at = rank.argmin(1)
            least = rank[np.arange(len(row)), at]
            stuck = least == NONE
            if stuck.any():
                over = np.flatnonzero(stuck)
                for to, n, ended in zip(row[over].tolist(), left[over].tolist(), ids[over].tolist(), strict=True):
                    done[to] = ended[:n]
                going = ~stuck
                row, ids, rank, left, at, least = row[going], ids[going], rank[going], left[going], at[going], least[going]
                if not len(row):
                    break
                width = int(left.max())
                ids, rank = ids[:, :width], rank[:, :width]
            k = np.arange(len(row))
            keep = np.ones(ids.shape, bool)
            keep[k, at + 1] = False
            ids[k, at] = least
            width = ids.shape[1] - 1
            ids, rank, left = ids[keep].reshape(len(row), width), rank[keep].reshape(len(row), width), left - 1
            for where, ok in ((at - 1, at > 0), (at, at + 1 < left)):
                w, r = where[ok], k[ok]
                rank[r, w] = self.table.find(ids[r, w], ids[r, w + 1])
            end = np.flatnonzero(at + 1 >= left)
            rank[end, at[end]] = NONE
        return done

    def by_heap(self, piece: bytes) -> list[int]:
        ids = [int(x) for x in self.of_byte[np.frombuffer(piece, np.uint8)]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        spans = [(i, i + 1) for i in range(n)]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                r = self.ranks.get(piece[spans[i][0] : spans[j][1]])
                if r is not None:
                    heapq.heappush(heap, (r, i, spans[i][1], spans[j][1]))

        for i in range(n - 1):
            offer(i)
        alive = [True] * n
        while heap:
            r, i, mid, end = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or spans[i][1] != mid or spans[j][1] != end:
                continue
            ids[i], spans[i], alive[j], after[i] = r, (spans[i][0], end), False, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x, a in zip(ids, alive, strict=True) if a]

    def parts(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of parts that can be encoded apart, and the first part of each text.

        A text may be cut before a space if no white space follows: every match of the pattern ends
        there, and the rest is matched as if it stood alone. Such parts recur often.
        """
        cut = np.zeros(len(data), bool)
        cut[:-1] = (data[:-1] == 0x20) & SOLID[data[1:]]
        cut[off[:-1][np.diff(off) > 0]] = True
        starts = np.flatnonzero(cut)
        return starts, np.append(starts[1:], len(data)) if len(starts) else starts, np.searchsorted(starts, off)

    def encode_batch(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        starts, ends, first = self.parts(data, off)
        index, new = self.kept.index(data, starts, ends)
        if len(new):
            cut = [[m.encode() for m in self.pattern.findall(x.decode())] for x in B.strings(data, starts[new], ends[new])]
            pieces = list(dict.fromkeys(p for c in cut for p in c))
            of = dict(zip(pieces, self.encode_pieces(pieces), strict=True))
            self.ids.put(len(self.kept), [of[c[0]] if len(c) == 1 else [x for p in c for x in of[p]] for c in cut])
        ids, sizes = self.ids.get(index)
        self.kept.commit(new)
        return ids, B.sums(sizes, first)

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes one after another, and the number of bytes of each text."""
        sizes = self.token_length[ids]
        data = self.token_bytes[B.ragged(self.token_start[ids], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        return data, np.diff(ends)


def tokenizer(path: str, pattern: str) -> ByteBPE:
    """The vocabulary file has to be on every machine."""
    return B.held((path, pattern), lambda: ByteBPE.load(path, pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True, digests: bool = False) -> DataFrame:
    """One row for each document: the columns `keep`, n_tokens, and ids (array of int) or digests.

    digests: ids_sha256 (ids as little-endian unsigned 32-bit integers) and decoded_sha256 (the bytes
    got back by decoding the ids). Empty and null texts have no ids; an empty table gives no rows.
    """
    keep = tuple(c for c in keep if c not in ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))
    source = docs.select(B.packed(docs, keep), B.text_or_empty(text).alias("text"))

    def run(parts):
        bpe = tokenizer(path, pattern)
        for part in parts:
            column = part.column(part.num_columns - 1)
            for a, z, data, off in B.chunks(*B.buffers(column)):
                ids, counts = bpe.encode_batch(data, off)
                out = [part.column(0).slice(a, z - a), pa.array(counts, pa.int64())]
                ends = np.concatenate([[0], np.cumsum(counts)])
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())))
                if digests:
                    data, sizes = bpe.decode_batch(ids, counts)
                    little = np.ascontiguousarray(ids.astype("<u4"))
                    out += [B.sha256s(little, ends), B.sha256s(data, np.concatenate([[0], np.cumsum(sizes)]))]
                yield pa.RecordBatch.from_arrays(out, names)

    fields = [source.schema[B.ROW], T.StructField("n_tokens", T.LongType())] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids + [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] * digests
    names = [f.name for f in fields]
    return B.unpacked(B.ship(source).mapInArrow(run, T.StructType(fields)), [*keep, *names[1:]], {c: c for c in names[1:]})


def decode_documents(encoded: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The inverse: the columns `keep` and decoded (binary). Null ids give empty bytes."""
    keep = tuple(c for c in keep if c != "decoded")
    source = encoded.select(B.packed(encoded, keep), F.coalesce(F.col(B.quoted(ids)), F.array().cast("array<int>")).alias("ids"))
    fields = [source.schema[B.ROW], T.StructField("decoded", T.BinaryType())]

    def run(parts):
        bpe = tokenizer(path, pattern)
        for part in parts:
            column = part.column(part.num_columns - 1)
            off = np.asarray(column.offsets, np.int64)
            data, sizes = bpe.decode_batch(np.asarray(column.flatten(), np.int32), np.diff(off))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([data[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary())], [f.name for f in fields])

    return B.unpacked(B.ship(source).mapInArrow(run, T.StructType(fields)), [*keep, "decoded"], {"decoded": "decoded"})
