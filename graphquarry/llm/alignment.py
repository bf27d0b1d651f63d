"""Cross-tokenizer alignment: which tokens of two vocabularies meet in the same bytes.

A text with a space before it has tokens of both files. Where both end, the text is cut into groups; in a
group, tokens are linked whose byte ranges overlap. Both files cut texts at certain places whatever stands
around them (`Pair`), so texts are taken apart into units there, and only different units are aligned:

1. each task cuts its documents into blocks of about `BLOCK_BYTES`. A document becomes its units' numbers in the
   block, and each unit of a block a row with its number of occurrences;
2. different units of the corpus get their tokens from the two libraries;
3. alignment is relational: tokens are exploded with their places, windowed sums of their lengths are their ends,
   equal ends of both sides of a unit meet (an equi-join by grouping, as both sides lie together already), a running count
   of cuts numbers the groups, and every different end is one link: of the token that ends there or next on
   either side. So pairs that do not overlap are never made. One shuffle serves all of this;
4. links of an id pair are counted with the units' occurrences. The most frequent pairs (`HOT`, a fixed number) are
   broadcast to the links, the others join by a shuffle;
5. each block gets the rows of its units by a join that adaptive execution can split, and adds up its documents.

Files that do not cut so are aligned as well: every text is then one unit.

Null and empty texts have no tokens, and neither have texts that either file does not give back byte by byte (as
those with U+2581): zeros and an empty groups_sha256. Long texts are taken whole; a unit is never longer than its
text. Repeated rows count each for itself; ids of equal counts are all the best. An empty table gives no
rows. Columns are passed on if asked for, whatever their names; those named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphquarry.llm import batches as B
from graphquarry.operators.components import scratch, written

BLOCK_BYTES, HOT, BATCH_ROWS, SLICE = 32 << 20, 1 << 16, 20_000, 256
BLANK, STOPS = " \n", ".,;:!?"
MARK, MARKS = "▁", ",|;"
SHOWN = str.maketrans("abc", MARKS)
MADE = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
UNIT = "unit string, times long, a array<int>, a_n array<int>, b array<int>, b_n array<int>"


class Pair:
    """A `tokenizers` file (A) and a `sentencepiece` file (B), which adds the space that A's texts get.

    `cuts` says that both treat a text as one after another of its parts, cut before a blank after a character that is none,
    and before a stop after an ASCII letter or digit: A's pattern never matches across these, B's pieces never lie across them.
    """

    def __init__(self, a: str, b: str):
        self.paths = a, b
        with open(a, encoding="utf-8") as f:
            spec = json.load(f)
        shape = spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and shape.get("type") == "ByteLevel" and shape.get("use_regex", True) and not shape.get("add_prefix_space", True)
        entries = spec["model"]["vocab"] | {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
        self.size_a = np.zeros(max(entries.values()) + 1, np.int64)
        for entry, i in entries.items():
            self.size_a[i] = len(entry)  # a character for each byte
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(b, "rb") as f:
            model.ParseFromString(f.read())
        rule, kinds = model.normalizer_spec, proto.ModelProto.SentencePiece
        self.bytes_b = [bytes([int(x.piece[3:5], 16)]) if x.type == kinds.BYTE else x.piece.replace(MARK, " ").encode() for x in model.pieces]
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        same = not rule.precompiled_charsmap and not rule.remove_extra_whitespaces and rule.add_dummy_prefix and rule.escape_whitespaces
        same = same and model.trainer_spec.byte_fallback and model.trainer_spec.model_type == model.trainer_spec.BPE and not any(x.type == kinds.USER_DEFINED for x in model.pieces)
        own = [x.piece for x in model.pieces if x.type not in (kinds.BYTE, kinds.CONTROL, kinds.UNKNOWN)]
        self.cuts = bool(plain and same) and not any(crossed(x[i - 1], x[i]) for x in own for i in range(1, len(x)))

    @cached_property
    def a(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.paths[0])
        made.encode_special_tokens = True
        return made

    @cached_property
    def b(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=self.paths[1])

    def tokens(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides of units of a text that has its space before it."""
        a = [x.ids for x in self.a.encode_batch_fast(units, add_special_tokens=False)]
        if not self.cuts:
            return a, self.b.encode([x[1:] for x in units], num_threads=1)
        first = len(self.b.encode("x"))
        return a, [x[first:] for x in self.b.encode(["x" + x for x in units], num_threads=1)]  # a text is cut behind this letter before any unit

    def faithful(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Which texts both sides give back byte by byte."""
        if self.cuts:
            mark = MARK.encode()
            at = np.flatnonzero((data[:-2] == mark[0]) & (data[1:-1] == mark[1]) & (data[2:] == mark[2])) if len(data) > 2 else np.zeros(0, np.int64)
            good = np.ones(len(off) - 1, bool)
            good[np.searchsorted(off, at, "right") - 1] = False
            return good
        raw = data.tobytes()
        texts = [raw[x:y].decode() for x, y in zip(off.tolist(), off[1:].tolist(), strict=False)]
        a, b = self.tokens(texts)
        return np.array([self.a.decode(x) == t and b"".join(self.bytes_b[i] for i in y) == t.encode() for t, x, y in zip(texts, a, b, strict=True)], bool)

    def units(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of units, and for each text the index of its first one."""
        begin = np.zeros(len(data), bool)
        if self.cuts and len(data) > 1:
            before = data[:-1]
            solid = (before > 0x20) & (before < 0x7F)
            lead = [np.concatenate([np.zeros(k, np.uint8), before])[: len(before)] for k in (1, 2, 3)]  # bytes before the one before
            solid |= (before >= 0x80) & ((lead[0] >= 0xC3) | ((lead[0] < 0xC0) & ((lead[1] >= 0xE4) | ((lead[1] < 0xC0) & (lead[2] >= 0xF0)))))  # white space beyond ASCII begins with C2 and E1 to E3
            begin[1:] = (IS_BLANK[data[1:]] & solid) | (IS_STOP[data[1:]] & IS_ALNUM[before])
        begin[off[:-1][np.diff(off) > 0]] = True
        starts = np.flatnonzero(begin)
        return starts, np.append(starts[1:], len(data)) if len(starts) else starts, np.searchsorted(starts, off)


IS_BLANK, IS_STOP, IS_ALNUM = (np.array([chr(b) in of for b in range(256)]) for of in (BLANK, STOPS, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))


def crossed(before: str, c: str) -> bool:
    """Whether a piece with these neighbours lies across a place where texts are cut."""
    if c in (MARK, "\n"):
        return before != MARK and not before.isspace()
    return c in STOPS and before.isascii() and before.isalnum()


def pair(a: str, b: str) -> Pair:
    return B.held(("pair", a, b), lambda: Pair(a, b))


class Block:
    """Documents as numbers of units, gathered until they are written."""

    def __init__(self, schema: T.StructType, most: int):
        self.names, self.most, self.lexicon = schema.names, most, B.Lexicon()
        self.clear(0)

    def clear(self, size: int) -> None:
        self.bytes, self.rows, self.numbers, self.counts = 0, [], [], []
        self.lexicon.clear(size)

    def fits(self, size: int) -> bool:
        return self.lexicon.fits(size) and self.bytes + size <= self.most

    def add(self, own: Pair, rows: pa.Array, data: np.ndarray, off: np.ndarray) -> None:
        full = np.flatnonzero(np.diff(off))
        data = np.insert(data, off[full], 0x20)
        off = off + np.concatenate([[0], np.cumsum(np.diff(off) > 0)])
        starts, ends, first = own.units(data, off)
        counts = np.diff(first)
        if not (good := own.faithful(data, off)).all():
            kept = np.repeat(good, counts)
            starts, ends, counts = starts[kept], ends[kept], np.where(good, counts, 0)
        self.rows.append(rows)
        self.numbers.append(self.lexicon.numbers(data, starts, ends))
        self.counts.append(counts)
        self.bytes += len(data)

    def batches(self, block: int) -> Iterator[pa.RecordBatch]:
        """Rows of documents, then of units; frequent units have small numbers."""
        if not self.rows:
            return
        times = np.zeros(len(self.lexicon.words), np.int64)
        for numbers in self.numbers:
            times += np.bincount(numbers, minlength=len(times))
        order = np.argsort(-times, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        none = lambda kind, n: pa.nulls(n, kind)
        for rows, numbers, counts in zip(self.rows, self.numbers, self.counts, strict=True):
            data, size = B.varints(place[numbers])
            bounds = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
            n = len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), rows, B.blobs(data, bounds), none(pa.string(), n), none(pa.int32(), n), none(pa.int64(), n)], self.names)
        kind = self.rows[0].type
        words = [self.lexicon.words[i].decode() for i in order]
        for a in range(0, len(words), BATCH_ROWS):
            part = words[a : a + BATCH_ROWS]
            n = len(part)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), none(kind, n), none(pa.binary(), n), pa.array(part, pa.string()), pa.array(np.arange(a, a + n, dtype=np.int32)), pa.array(times[order[a : a + n]])], self.names)


def in_blocks(docs: DataFrame, a: str, b: str, text: str, keep: list[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, row, units, unit, number, times): for each document row and units, for each unit of a block unit, number and times."""
    source = docs.select(B.packed(docs, keep), B.text_or_empty(text).alias("text"))
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField(B.ROW, source.schema[0].dataType), T.StructField("units", T.BinaryType()), T.StructField("unit", T.StringType()), T.StructField("number", T.IntegerType()), T.StructField("times", T.LongType())])

    def run(parts):
        own, block, number = pair(a, b), Block(schema, block_bytes), TaskContext.get().partitionId() << 32
        for part in parts:
            for x, z, data, off in B.chunks(*B.buffers(part.column(1))):
                if not block.fits(len(data) + z - x):
                    yield from block.batches(number)
                    number += 1
                    block.clear(len(data) + z - x)
                block.add(own, part.column(0).slice(x, z - x), data, off)
        yield from block.batches(number)
        B.trim()

    return written(B.ship(source).mapInArrow(run, schema))


def tokenized(units: DataFrame, a: str, b: str) -> DataFrame:
    """(unit, times, a, b): ids and byte lengths of the tokens of both sides."""

    def side(ids: list[list[int]], size: np.ndarray, least: np.ndarray) -> list[pa.Array]:
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(bounds[-1]))
        if not np.array_equal(B.sums(size[flat], bounds), least):
            raise ValueError("tokens that do not cover their text")
        return [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (flat, size[flat])]

    def run(parts):
        own = pair(a, b)
        for part in parts:
            for at in range(0, len(part), BATCH_ROWS):
                rows = part.slice(at, BATCH_ROWS)
                texts = rows.column(0).to_pylist()
                size = np.array([len(x.encode()) for x in texts], np.int64)
                left, right = own.tokens(texts)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *side(left, own.size_a, size), *side(right, own.size_b, size)], ["unit", "times", "a", "a_n", "b", "b_n"])
        B.trim()

    return B.ship(units.select("unit", "times")).mapInArrow(run, UNIT)


def aligned(tokens: DataFrame) -> DataFrame:
    """(unit, times, groups, links): groups packed, links as an array of (a, b)."""
    ids = lambda rows, side: F.array_join(F.transform(F.filter(rows, lambda x: x[side].isNotNull()), lambda x: x[side].cast("string")), ",")
    sides = F.array(*(F.struct(F.lit(x).alias("side"), F.arrays_zip(F.col(x).alias("id"), F.col(f"{x}_n").alias("n")).alias("t")) for x in ("a", "b")))
    dealt = tokens.repartition("unit").select("unit", "times", F.explode(sides).alias("s"))
    placed = dealt.select("unit", "times", "s.side", F.posexplode("s.t").alias("pos", "t"))
    ends = placed.select("unit", "times", "side", F.col("t.id").alias("id"), F.sum("t.n").over(Window.partitionBy("unit", "side").orderBy("pos")).alias("end"))
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("id"))).alias(f"own_{side}")
    met = ends.groupBy("unit", "end").agg(F.max("times").alias("times"), of("a"), of("b"))
    back = Window.partitionBy("unit").orderBy(F.col("end").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (F.col("own_a").isNotNull() & F.col("own_b").isNotNull()).cast("int")
    links = met.select("*", F.last("own_a", ignorenulls=True).over(back).alias("a"), F.last("own_b", ignorenulls=True).over(back).alias("b"), F.sum(cut).over(back).alias("group"))  # cuts from here on: groups are numbered from the last
    groups = links.groupBy("unit", "group").agg(F.max("times").alias("times"), F.sort_array(F.collect_list(F.struct("end", "own_a", "own_b", "a", "b"))).alias("l"))
    whole = F.struct((-F.col("group")).alias("at"), F.concat(ids(F.col("l"), "own_a"), F.lit("|"), ids(F.col("l"), "own_b")).alias("text"), F.transform("l", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))).alias("links"))
    units = groups.groupBy("unit").agg(F.max("times").alias("times"), F.sort_array(F.collect_list(whole)).alias("g"))
    return units.select("unit", "times", packed_groups(F.array_join(F.col("g.text"), ";")).alias("groups"), F.flatten("g.links").alias("links"))


def packed_groups(text: Column) -> Column:
    """Text of digits and three marks as half as many bytes: the marks become the hexadecimal digits a to c, and f fills up."""
    digits = F.translate(text, MARKS, "abc")
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("f"))).otherwise(digits))


def unpacked_groups(data: bytes) -> str:
    return data.hex().rstrip("f").translate(SHOWN)


def pair_counts(units: DataFrame) -> DataFrame:
    """(a, b, count, best) of all linked id pairs: how many links of the corpus, and whether no other a of that b has more."""
    counts = units.select("times", F.inline("links")).groupBy("a", "b").agg(F.sum("times").alias("count"))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def unit_sums(units: DataFrame, pairs: DataFrame) -> DataFrame:
    """(unit, n_best, count_sum) over the links of each unit."""
    hot = F.broadcast(pairs.orderBy(F.col("count").desc(), "a", "b").limit(HOT))  # HOT rows at most
    links = units.select("unit", F.inline("links"))
    found = links.join(hot, ["a", "b"]).select("unit", "count", "best")
    found = found.unionByName(links.join(hot, ["a", "b"], "left_anti").join(pairs, ["a", "b"]).select("unit", "count", "best"))
    return found.groupBy("unit").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum"))


def align(docs: DataFrame, a: str, b: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), groups: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document the columns of `keep`, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked for, groups.

    groups: `a1,a2|b1;a3|b2,b3`, ids of both sides in order. count_sum adds up, over the links, how many links of the corpus
    have that id pair; n_best counts those links whose pair is its b's most frequent.
    """
    passed = [c for c in keep if c not in MADE and c != "groups"]
    blocks = in_blocks(docs, a, b, text, passed, block_bytes)
    found = blocks.where("unit is not null").select("block", "unit", "number", "times")
    with scratch(docs.sparkSession) as kept:
        units = written(aligned(tokenized(found.groupBy("unit").agg(F.sum("times").alias("times")), a, b)))
        pairs = written(pair_counts(units))
        whole = kept(written(units.select("unit", "groups").join(unit_sums(units, pairs), "unit")))
    rows = found.select(F.col("block").alias("of"), "unit", "number").join(whole, "unit").drop("unit")
    texts = blocks.where("unit is null").select("block", B.ROW, "units")
    sums = list(MADE[:-1])
    schema = T.StructType([texts.schema[B.ROW], *(T.StructField(c, T.LongType()) for c in sums), T.StructField(MADE[-1], T.StringType()), *([T.StructField("groups", T.StringType())] if groups else [])])

    def run(docs: pa.Table, rows: pa.Table) -> pa.Table:
        number = np.asarray(rows.column("number"), np.int64)
        by_number = np.empty(len(number), np.int64)
        by_number[number] = np.arange(len(number))
        shown = np.array([unpacked_groups(x) for x in rows.column("groups").to_pylist()] or [""], object)[by_number].tolist()
        n_groups = np.fromiter((x.count(";") + 1 for x in shown), np.int64, len(shown))
        commas = [np.fromiter((sum(y[k].count(",") for y in (g.split("|") for g in x.split(";"))) for x in shown), np.int64, len(shown)) for k in (0, 1)]
        of_unit = [n_groups + commas[0], n_groups + commas[1], n_groups, n_groups + commas[0] + commas[1]]
        of_unit += [np.asarray(rows.column(c), np.int64)[by_number] for c in ("n_best", "count_sum")]
        docs, made = docs.combine_chunks(), []
        for at in range(0, len(docs), SLICE):
            part = docs.slice(at, SLICE)
            data, off = B.buffers(part.column("units"))
            seq = B.from_varints(data)
            first = np.concatenate([[0], np.cumsum(data < 0x80)])[off]
            texts = [";".join([shown[i] for i in seq[x:y].tolist()]) for x, y in zip(first.tolist(), first[1:].tolist(), strict=False)]
            columns = [part.column(B.ROW), *(pa.array(B.sums(x[seq], first)) for x in of_unit)]
            columns.append(pa.array([hashlib.sha256(x.encode()).hexdigest() if x else "" for x in texts], pa.string()))
            made.append(pa.table([*columns, *([pa.array(texts, pa.string())] if groups else [])], names=schema.names))
        B.trim()
        return pa.concat_tables(made)

    out = B.ship(texts).groupBy("block").cogroup(rows.groupBy("of")).applyInArrow(run, schema)
    own = [*MADE, *(["groups"] if groups else [])]
    return B.unpacked(out, [*passed, *own], {n: n for n in own})
