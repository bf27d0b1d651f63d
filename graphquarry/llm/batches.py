"""Whole texts of an Arrow column as UTF-8 bytes, and numpy kernels over many texts at once.

A null text counts as an empty one everywhere, and bytes that are not UTF-8 as U+FFFD. Work is done in chunks of consecutive documents of
about `CHUNK_BYTES`, so that memory follows the longest single document and not the batch.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphquarry.shipping import ship  # noqa: F401  operators take it from here

CHUNK_BYTES = (1 << 20) - 1
#: A word is a maximal run of bytes other than 0x20 and 0x09 to 0x0D, in UTF-8.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


_held: list = [None, None]


def held(key, make):
    """What `make` made for the key, kept for a worker's next task. One thing is kept at a time, so that workers stay small."""
    if _held[0] != key:
        _held[:] = None, None
        _held[:] = key, make()
    return _held[1]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_or_empty(name: str = "text") -> Column:
    """The text as valid UTF-8: null becomes empty, and each maximal invalid sequence of bytes U+FFFD."""
    return F.make_valid_utf8(F.coalesce(F.col(quoted(name)).cast("string"), F.lit("")))


#: The one column in which operators carry a caller's columns, whatever these are called, beside their own.
ROW = "row"


def packed(docs: DataFrame, columns: list[str] | None = None) -> Column:
    return F.struct(*([F.col(quoted(c)) for c in (docs.columns if columns is None else columns)] or [F.lit(0).alias("none")])).alias(ROW)


def unpacked(rows: DataFrame, columns: list[str], made: dict[str, str] | None = None) -> DataFrame:
    """The columns by name: those in `made` from the column of `rows` given there, the others from ROW."""
    made = made or {}
    return rows.select(*((rows[quoted(made[c])] if c in made else rows[ROW].getField(c)).alias(c) for c in columns))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array without nulls; no copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole documents."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK_BYTES, "right")) - 1)
        j = min(j, n)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j
    trim()


_libc = ctypes.CDLL(None)


def trim() -> None:
    """Give freed memory back to the machine: workers stay for other stages, and executors count what they hold."""
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)
    pa.default_memory_pool().release_unused()


def word_bounds(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word (n + 1 values)."""
    word = ~space[data]
    first, last = word.copy(), word.copy()
    if len(data):
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        cut = off[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        first[cut] = word[cut]
        last[cut - 1] = word[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, one to one."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


BASE = 0x9E3779B97F4A7C15
_tables: dict[str, np.ndarray] = {}
BYTE_VALUE = mixed(np.arange(1, 257, dtype=np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64. Tables past the chunk size are not kept."""
    if len(_tables.get("p", ())) < n:
        made = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            out = np.ones(1, np.uint64)
            while len(out) < n:
                out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
            made.append(out)
        if n > 2 * CHUNK_BYTES:
            return made[0][:n], made[1][:n]
        _tables["p"], _tables["q"] = made
    return _tables["p"][:n], _tables["q"][:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rabin-Karp hashes of words, from one prefix sum over all bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, q = powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUE[data] * p[:-1], dtype=np.uint64)])
    return mixed((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of all runs of `width` values, those across documents included."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p, q = powers(len(words))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * p, dtype=np.uint64)])
    return mixed((total[width:] - total[:n]) * q[:n])


def within(first_word: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows of `width` words: the document of each that lies in one document, and its position there."""
    count = np.maximum(np.diff(first_word) - width + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    before = np.concatenate([[0], np.cumsum(count)])[:-1]
    return doc, np.arange(len(doc)) - np.repeat(before, count)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of many runs, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class Interner:
    """Numbers for recurring byte strings: a hash table that is probed for a whole chunk at once.

    Hash matches are confirmed by comparing bytes, so numbers are exact. `index` gives every string a
    number; those from `len(self)` on are new, and stand for `new` (positions of one string each).
    The caller works out what it needs for the new ones, then calls `commit`, which keeps them as long
    as there is room for `most`; without room they are forgotten, and when that happens to many
    strings of a chunk, the table starts anew. It thus speeds up repeats and never changes a result.
    """

    def __init__(self, most: int = 700_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        bits = int(2.5 * self.most).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.slots = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        self.n, self.data, self.start, self.size = 0, np.zeros(1 << 20, np.uint8), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def __len__(self) -> int:
        return self.n

    def index(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes = word_hashes(data, starts, ends)
        home = (hashes >> self.shift).astype(np.int64)
        out = self.slots[home].astype(np.int64)
        todo = np.flatnonzero((out >= 0) & (self.keys[home] != hashes))
        at = home[todo]
        while len(todo):
            at = (at + 1) & self.mask
            slot = self.slots[at].astype(np.int64)
            out[todo] = slot
            on = (slot >= 0) & (self.keys[at] != hashes[todo])
            todo, at = todo[on], at[on]
        size = ends - starts
        hit = np.flatnonzero(out >= 0)
        hit = hit[~self.same(data, starts[hit], size[hit], self.data, self.start[out[hit]], self.size[out[hit]])]
        out[hit] = -1
        missing = np.flatnonzero(out < 0)
        if not len(missing):
            return out, missing
        _, first, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
        odd = ~self.same(data, starts[missing], size[missing], data, starts[missing[first[back]]], size[missing[first[back]]])
        out[missing] = self.n + back
        new = missing[first]
        if odd.any():  # unequal strings with one hash
            out[missing[odd]] = self.n + len(new) + np.arange(odd.sum())
            new = np.concatenate([new, missing[odd]])
        self.pending = (data, starts[new], size[new], hashes[new], len(missing) / max(1, len(starts)))
        return out, new

    @staticmethod
    def same(a, a_start, a_size, b, b_start, b_size) -> np.ndarray:
        equal = a_size == b_size
        k = np.flatnonzero(equal & (a_size > 0))
        if len(k):
            ends = np.cumsum(a_size[k])
            unequal = a[ragged(a_start[k], a_size[k])] != b[ragged(b_start[k], b_size[k])]
            if unequal.any():
                equal[k[np.add.reduceat(unequal, ends - a_size[k]) > 0]] = False
        return equal

    def commit(self, new: np.ndarray) -> None:
        if not len(new):
            return
        data, starts, size, hashes, share = self.pending
        del self.pending
        if self.n + len(new) > self.most:
            if share > 0.25:
                self.clear()
            return
        n, k = self.n, len(new)
        used = int(self.start[n - 1] + self.size[n - 1]) if n else 0
        total = int(size.sum())
        self.data = grown(self.data, used + total)
        self.start, self.size = grown(self.start, n + k), grown(self.size, n + k)
        self.data[used : used + total] = data[ragged(starts, size)]
        self.start[n : n + k], self.size[n : n + k] = used + np.cumsum(size) - size, size
        at, todo = (hashes >> self.shift).astype(np.int64), np.arange(k)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = (n + todo[free]).astype(np.int32)
            won = self.slots[at] == n + todo
            self.keys[at[won]] = hashes[todo[won]]
            todo, at = todo[~won], (at[~won] + 1) & self.mask
        self.n += k


def grown(x: np.ndarray, n: int) -> np.ndarray:
    return x if len(x) >= n else np.concatenate([x, np.zeros(max(n, 3 * len(x) // 2) - len(x), x.dtype)])


class Values:
    """For each number of an `Interner` a run of values, kept in one flat array."""

    def __init__(self, dtype):
        self.flat, self.start, self.size = np.zeros(1 << 16, dtype), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def put(self, n: int, made: list) -> None:
        """Runs for the numbers n, n + 1, ...; runs that stood there before are replaced."""
        size = np.fromiter(map(len, made), np.int64, len(made))
        used, total = int(self.start[n - 1] + self.size[n - 1]) if n else 0, int(size.sum())
        self.flat, self.start, self.size = grown(self.flat, used + total), grown(self.start, n + len(made)), grown(self.size, n + len(made))
        if total:
            self.flat[used : used + total] = np.fromiter(chain.from_iterable(made), self.flat.dtype, total)
        self.start[n : n + len(made)], self.size[n : n + len(made)] = used + np.cumsum(size) - size, size

    def get(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[index]
        return self.flat[ragged(self.start[index], size)], size


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums between consecutive bounds."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[bounds])


def sha256s(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    bounds = bounds.tolist()
    return pa.array([hashlib.sha256(values[a:b]).hexdigest() for a, b in zip(bounds, bounds[1:], strict=False)], pa.string())


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values from 0 on as bytes of 7 bits, low ones first, the last of each below 0x80; and the number of bytes of each."""
    left = values.astype(np.uint64)
    size = np.ones(len(left), np.int64)
    for k in range(1, 10):
        more = left >= np.uint64(1) << np.uint64(7 * k)
        if not more.any():
            break
        size += more
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=1))):
        has = np.flatnonzero(size > k)
        out[start[has] + k] = ((left[has] >> np.uint64(7 * k)) & np.uint64(0x7F)) | ((size[has] > k + 1).astype(np.uint64) << np.uint64(7))
    return out, size


def from_varints(data: np.ndarray) -> np.ndarray:
    """The values of `varints`."""
    last = np.flatnonzero(data < 0x80)
    start = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    size = last - start + 1
    out = np.zeros(len(last), np.int64)
    for k in range(int(size.max(initial=0))):
        has = np.flatnonzero(size > k)
        out[has] |= (data[start[has] + k] & 0x7F).astype(np.int64) << (7 * k)
    return out


def blobs(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary array of the bytes between consecutive bounds, which begin at 0."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


class Lexicon:
    """Numbers from 0 on for the different byte strings of one shard or block, none of them forgotten, and the strings by number."""

    LEAST = 1 << 20

    def __init__(self):
        self.inner = Interner(self.LEAST)
        self.words: list[bytes] = []

    def fits(self, size: int) -> bool:
        """Whether the strings of a chunk of so many bytes surely have room."""
        return len(self.inner) + size // 2 <= self.inner.most

    def clear(self, size: int) -> None:
        """Forget all, and make room for a chunk of so many bytes."""
        self.words = []
        self.inner.most = max(self.LEAST, size // 2 + 1)
        self.inner.clear()

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        index, new = self.inner.index(data, starts, ends)
        self.words += strings(data, starts[new], ends[new])
        self.inner.commit(new)
        return index.astype(np.int32)
