"""Similarity join of documents on word n-grams, by MinHash candidates and Bayesian pruning.

Documents with one set of n-grams are a class, and one of them stands for it. Classes whose MinHash
signatures agree in one of `BANDS` bands of `ROWS` values share a bucket; a pair of similarity 0.8 is
missed with a probability of about 1e-7. Buckets of equal members are one bucket.

1. Within a bucket, pairs are pruned on sketches: `SKETCH` MinHash values of a byte each. A pair goes
   when the posterior probability that its similarity reaches the threshold, for a uniform prior,
   falls below `TOLERANCE` (equal bytes by chance only keep more). A class that a pair is left of is
   tied to the least class that it is so connected with in the bucket. Pairs of a middling similarity,
   which bands let through in numbers, thus tie nothing together.
2. The components of these ties hold every pair that is left. In a component, classes of about equal
   set size (for a Jaccard similarity of 0.8, sizes differ by a factor of 1.25 at most, so only a size
   range and the next) are dealt by hash into blocks of bounded total size, and a task gets two blocks.
   There whole signatures are compared some values at a time and pairs dropped by the same posterior;
   the pairs left are verified exactly on their n-grams.
3. A task returns a row for each linked class: its number of linked documents, and the least class that
   it is connected with. So links are counted without a row for each.

Buckets are dealt into blocks of `SKETCH_BLOCK` classes, so that none is one task, however large.

N-grams are of `width` words (maximal runs other than space and U+0009 to U+000D); a text of fewer
words has one n-gram, all its words. Null and empty texts have none; they are copies of each other and
of nothing else. Rows without doc_id take part and are last in the order; repeated rows are copies, and
`keep_first` keeps one of them. An empty table gives no rows. Long texts are taken whole. Columns other
than doc_id and the text are not read by `groups` and passed on by `keep_first`, whatever their names.
"""

from __future__ import annotations

from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphquarry.llm import batches as B
from graphquarry.operators.components import connected_components, ensure_checkpoint_dir, written

WIDTH, THRESHOLD = 5, Fraction(4, 5)
BANDS, ROWS, TOLERANCE, STEP = 40, 5, 1e-9, 20
#: Most classes of a block, and most n-grams of one.
BLOCK, BLOCK_GRAMS = 512, 1 << 20
#: Values of a sketch, and most classes that stand against each other by their sketches in one task.
SKETCH, SKETCH_BLOCK, TILE = 128, 4096, 256
KEY = ["__k1", "__k2"]
_random = np.random.default_rng(20240229)
SCALE = _random.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
SHIFT = _random.integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def document_key(doc_id, text) -> list[Column]:
    return [F.xxhash64(F.lit(i), doc_id, text).alias(f"__k{i}") for i in (1, 2)]


def gram_sets(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each document in ascending order, one after another, and their bounds."""
    starts, ends, first = B.word_bounds(data, off)
    words = B.word_hashes(data, starts, ends)
    doc, at = B.within(first, width)
    grams = B.window_hashes(words, width)[first[doc] + at] if len(doc) else np.zeros(0, np.uint64)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < width))
    whole = np.array([int(B.window_hashes(words[first[i] : first[i + 1]], int(count[i]))[0]) for i in short], np.uint64)
    doc, grams = np.concatenate([doc, short]), np.concatenate([grams, whole])
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    doc, grams = doc[new], grams[new]
    return grams, np.searchsorted(doc, np.arange(len(off)))


def signatures(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash values, a row for each set; sets without n-grams have the greatest value throughout."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.full((len(bounds) - 1, len(SCALE)), 0xFFFFFFFF, np.uint32)
    if len(full):
        low, at = (grams >> np.uint64(32)).astype(np.uint32), bounds[:-1][full]
        for i, (a, b) in enumerate(zip(SCALE, SHIFT, strict=True)):
            x = low * a
            x += b
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            out[full, i] = np.minimum.reduceat(x, at)
    return out


def set_names(grams: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """16 bytes for each set, equal for equal sets."""
    sums = [np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(B.mixed(grams ^ np.uint64(s)), dtype=np.uint64)])[bounds]) for s in (1, 0x5BD1E995)]
    raw = np.stack(sums, 1).astype(">u8").tobytes()
    return [raw[i : i + 16] for i in range(0, len(raw), 16)]


def band_keys(sig: np.ndarray) -> np.ndarray:
    x = np.zeros((len(sig), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        x = B.mixed(x * np.uint64(B.BASE) + sig[:, r::ROWS].astype(np.uint64))
    return x.view(np.int64)


def listed(values: np.ndarray, size: int, kind: pa.DataType) -> pa.Array:
    n = values.size // size
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(values.reshape(-1), kind))


def class_rows(docs: DataFrame, width: int) -> DataFrame:
    """For each document its class, number of n-grams, band keys and sketch."""
    schema = "__id long, __k1 long, __k2 long, __class binary, __size long, __bands array<long>, __sketch binary"

    def go(parts):
        for part in parts:
            for a, z, data, off in B.chunks(*B.buffers(part.column(3))):
                grams, bounds = gram_sets(data, off, width)
                size, sig = np.diff(bounds), signatures(grams, bounds)
                sketches = pa.array([x.tobytes() for x in sig[:, :SKETCH].astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(i).slice(a, z - a) for i in range(3)), pa.array(set_names(grams, bounds), pa.binary()), pa.array(size), listed(band_keys(sig), BANDS, pa.int64()), sketches], ["__id", *KEY, "__class", "__size", "__bands", "__sketch"])

    return B.ship(docs.select("__id", *KEY, "__text")).mapInArrow(go, schema)


def least_matches(threshold: Fraction, tolerance: float, most: int) -> np.ndarray:
    """For n compared values the least number of equal ones with which a pair is kept.

    With a uniform prior the posterior of the similarity is Beta(m + 1, n - m + 1), and its mass above t
    is the probability of m or fewer successes in n + 1 trials of probability t.
    """
    t, out = float(threshold), np.zeros(most + 1, np.int64)
    for n in range(1, most + 1):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= tolerance:
                out[n] = m
                break
    return out


def candidates(left: np.ndarray, right: np.ndarray, same: bool, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that pruning leaves."""
    hits = np.zeros((len(left), len(right)), np.int16)
    for h in range(STEP):
        hits += left[:, h][:, None] == right[:, h][None, :]
    i, j = np.nonzero(hits >= least[STEP])
    if same:
        i, j = i[i < j], j[i < j]
    n = hits[i, j].astype(np.int64)
    for h in range(STEP, left.shape[1], STEP):
        if not len(i):
            break
        n += (left[i, h : h + STEP] == right[j, h : h + STEP]).sum(1)
        kept = n >= least[h + STEP]
        i, j, n = i[kept], j[kept], n[kept]
    return i, j


def common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (i, j) of sorted sets."""
    rows = np.unique(np.concatenate([i, j]))
    if len(i) <= 4 * len(rows):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    place = np.zeros(len(sets), np.int64)
    place[rows] = np.arange(len(rows))
    owner = np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])
    _, value, count = np.unique(np.concatenate([sets[r] for r in rows]), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[value]
    owner, value = owner[keep], number[value[keep]]
    total, width = np.zeros((len(rows), len(rows)), np.float32), max(1, 4_000_000 // len(rows))
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], value[order]
    for base in range(0, int(shared.sum()), width):
        a, z = np.searchsorted(value, [base, base + width])
        m = np.zeros((len(rows), width), np.float32)
        m[owner[a:z], value[a:z] - base] = 1
        total += m @ m.T
    return total[place[i], place[j]].astype(np.int64)


def linked(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: Fraction) -> np.ndarray:
    if not len(i):
        return np.zeros(0, bool)
    size = np.array([len(s) for s in sets], np.int64)
    both = common(sets, i, j)
    return threshold.denominator * both >= threshold.numerator * (size[i] + size[j] - both)


def least_connected(n: int, tiles) -> np.ndarray:
    """For each of n things the least that it is connected with by pairs; tiles: arrays (i, j), one after another."""
    label = np.arange(n)
    for i, j in tiles:
        while len(i):
            x, y = label[i], label[j]
            apart = x != y
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            low, high = np.minimum(x, y), np.maximum(x, y)
            np.minimum.at(label, high, low)
            while (label != (up := label[label])).any():
                label = up
    return label


def two_sides(table: pa.Table, column: str) -> tuple[list[int], list[bytes], np.ndarray, np.ndarray]:
    """Of a task over two blocks: its rows by name, each once, their names, and those of the left and the right block."""
    names, right = table.column(column).to_pylist(), np.asarray(table.column("right").to_numpy(zero_copy_only=False), bool)
    one = table.column("a")[0].as_py() == table.column("b")[0].as_py() and not ("next" in table.column_names and table.column("next")[0].as_py())
    rows = sorted({(n, s): k for k, (n, s) in enumerate(zip(names, right.tolist(), strict=True))}.values(), key=names.__getitem__)
    names, right = [names[k] for k in rows], right[rows]
    every = np.arange(len(rows))
    return rows, names, every if one else every[~right], every if one else every[right]


def tied(rows: DataFrame, threshold: Fraction, tolerance: float) -> DataFrame:
    """(__class, __to): ties between classes that share a bucket and have a pair of which the sketch leaves hope."""
    bands = rows.select("__class", F.explode("__bands").alias("__band"))
    names = [F.bit_xor(F.xxhash64(F.lit(i), "__class")).alias(f"__f{i}") for i in (1, 2)]
    buckets = bands.groupBy("__band").agg(F.count("*").alias("__n"), *names).where("__n > 1")
    buckets = buckets.groupBy("__n", "__f1", "__f2").agg(F.min("__band").alias("__band")).select("__band", F.ceil(F.col("__n") / SKETCH_BLOCK).cast("int").alias("__blocks"))
    shared = bands.join(buckets, "__band").groupBy("__class").agg(F.collect_list(F.struct("__band", "__blocks")).alias("__in"))  # a bucket of each band at most
    dealt = rows.select("__class", "__sketch").join(shared, "__class").select("__class", "__sketch", F.explode("__in").alias("i")).select("__class", "__sketch", "i.*")
    own = F.pmod(F.xxhash64("__class"), F.col("__blocks")).cast("int")
    dealt = dealt.select("__class", "__sketch", "__band", own.alias("__b"), F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("k"))
    dealt = dealt.select("__class", "__sketch", "__band", F.least("__b", "k").alias("a"), F.greatest("__b", "k").alias("b"), (F.col("__b") > F.col("k")).alias("right"))
    least = int(least_matches(threshold, tolerance, SKETCH)[SKETCH])

    def go(table: pa.Table) -> pa.Table:
        rows, names, left, right = two_sides(table, "__class")
        sketch = np.frombuffer(b"".join(table.column("__sketch").take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), SKETCH)
        facing = np.ascontiguousarray(sketch[right].T)

        def pairs():
            for at in range(0, len(left), TILE):
                hits = np.zeros((len(left[at : at + TILE]), len(right)), np.uint8)
                for own, other in zip(sketch[left[at : at + TILE]].T, facing, strict=True):
                    hits += own[:, None] == other[None, :]
                i, j = np.nonzero(hits >= least)
                i, j = left[at + i], right[j]
                yield i[i != j], j[i != j]

        label = least_connected(len(rows), pairs())
        out = np.flatnonzero(label != np.arange(len(rows))).tolist()
        return pa.table({"__class": pa.array([names[k] for k in out], pa.binary()), "__to": pa.array([names[label[k]] for k in out], pa.binary())})

    return dealt.groupBy("__band", "a", "b").applyInArrow(go, "__class binary, __to binary")


def starred(ties: DataFrame) -> DataFrame:
    """Ties of the same components: of each class only that to its least one, and between that and the others, each once."""
    of_class = ties.groupBy("__class").agg(F.min("__to").alias("u"), F.collect_set("__to").alias("others"))  # one for each task of the class at most
    between = of_class.select("u", F.explode("others").alias("v")).where("u <> v")
    return of_class.select("u", F.col("__class").alias("v")).unionByName(between).distinct()


def members(ties: DataFrame, classes: DataFrame) -> DataFrame:
    """Classes with candidates, their component, size range and block, and the tasks that they take part in."""
    found = connected_components(starred(ties), "u", "v").select(F.col("node").alias("__class"), F.col("component").alias("__comp"))
    own = found.join(classes.select("__class", "__size", "__copies", F.col("__rep.k1").alias("__k1"), F.col("__rep.k2").alias("__k2")), "__class")
    own = own.withColumn("__z", F.floor(F.log("__size") / F.log(F.lit(1.25))).cast("int")).checkpoint()
    limit = F.greatest(F.lit(2), F.least(F.lit(BLOCK), F.floor(F.lit(float(BLOCK_GRAMS)) / F.pow(F.lit(1.25), F.col("__z") + 1))))
    ranges = own.groupBy("__comp", "__z").agg(F.count("*").alias("__n")).select("__comp", "__z", "__n", F.ceil(F.col("__n") / limit).cast("int").alias("__blocks"))
    order = Window.partitionBy("__comp").orderBy("__z")  # a row for each size range of a component: some dozens
    near = lambda f, by: F.when(f("__z").over(order) == F.col("__z") + by, f("__blocks").over(order))
    ranges = ranges.withColumn("__above", near(F.lead, 1)).withColumn("__below", near(F.lag, -1)).checkpoint()
    own = own.join(ranges, ["__comp", "__z"]).withColumn("__b", F.pmod(F.xxhash64("__class"), F.col("__blocks")).cast("int"))

    def tasks(n: Column, make) -> Column:
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), make)).otherwise(F.array().cast("array<struct<z:int,next:boolean,a:int,b:int,right:boolean>>"))

    def task(z, next_z: bool, a, b, right) -> Column:
        return F.struct(z.cast("int").alias("z"), F.lit(next_z).alias("next"), a.cast("int").alias("a"), b.cast("int").alias("b"), right.alias("right"))

    z, b = F.col("__z"), F.col("__b")
    inner = tasks(F.when(F.col("__n") > 1, F.col("__blocks")).otherwise(0), lambda k: task(z, False, F.least(b, k), F.greatest(b, k), b > k))
    above = tasks(F.coalesce("__above", F.lit(0)), lambda k: task(z, True, b, k, F.lit(False)))
    below = tasks(F.coalesce("__below", F.lit(0)), lambda k: task(z - 1, True, k, b, F.lit(True)))
    return own.select("__class", "__comp", "__copies", *KEY, F.concat(inner, above, below).alias("__tasks")).where(F.size("__tasks") > 0)


def with_sets(docs: DataFrame, who: DataFrame, width: int) -> DataFrame:
    """Members with their n-grams and signatures, for each task."""
    schema = "__class binary, __comp binary, __copies long, __tasks array<struct<z:int,next:boolean,a:int,b:int,right:boolean>>, __grams binary, __sig binary"
    source = docs.join(who.hint("shuffle_hash"), KEY).select("__class", "__comp", "__copies", "__tasks", "__text")

    def go(parts):
        for part in parts:
            for a, z, data, off in B.chunks(*B.buffers(part.column(4))):
                grams, bounds = gram_sets(data, off, width)
                sig = signatures(grams, bounds)
                raw = [grams[x:y].tobytes() for x, y in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*(part.column(i).slice(a, z - a) for i in range(4)), pa.array(raw, pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())], ["__class", "__comp", "__copies", "__tasks", "__grams", "__sig"])

    return B.ship(source).mapInArrow(go, schema)


def compared(sets: DataFrame, threshold: Fraction, tolerance: float) -> DataFrame:
    """For each task and linked class: the class, its number of linked documents there, and what it is connected with."""
    least = least_matches(threshold, tolerance, len(SCALE))
    rows = sets.select("__class", "__comp", "__copies", "__grams", "__sig", F.explode("__tasks").alias("t")).select("*", "t.*").drop("t", "__tasks")

    def go(table: pa.Table) -> pa.Table:
        rows, names, left, right = two_sides(table, "__class")
        taken = table.take(pa.array(rows))
        sets = [np.frombuffer(g, np.uint64) for g in taken.column("__grams").to_pylist()]
        sig = np.frombuffer(b"".join(taken.column("__sig").to_pylist()), np.uint32).reshape(len(names), -1)
        copies = np.asarray(taken.column("__copies"), np.int64)
        i, j = candidates(sig[left], sig[right], left is right, least)
        i, j = left[i], right[j]
        ok = linked(sets, i, j, threshold)
        i, j = i[ok], j[ok]
        links = np.bincount(i, copies[j], len(names)) + np.bincount(j, copies[i], len(names))
        label = least_connected(len(names), [(i, j)])
        out = np.flatnonzero(links).tolist()
        return pa.table({"__class": pa.array([names[k] for k in out], pa.binary()), "__links": pa.array(links[out].astype(np.int64)), "__to": pa.array([names[label[k]] for k in out], pa.binary())})

    return rows.groupBy("__comp", "z", "next", "a", "b").applyInArrow(go, "__class binary, __links long, __to binary")


def groups(docs: DataFrame, width: int = WIDTH, threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE, text: str = "text") -> DataFrame:
    """A row for each document: doc_id, class_id, n_links, is_first, and its key.

    class_id: the least doc_id of the documents connected by links; n_links: how many others are linked
    with it, copies included; is_first: this row (or one equal to it) is the first of its class.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("__id"), B.text_or_empty(text).alias("__text"))
    plain = plain.select("__id", *document_key("__id", "__text"), "__text")
    rows = written(class_rows(plain, width))
    rep = F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__k1").alias("k1"), F.col("__k2").alias("k2")))
    classes = rows.groupBy("__class").agg(rep.alias("__rep"), F.count("*").alias("__copies"), F.max("__size").alias("__size"))
    first = rows.join(classes.where(F.col("__size") > 0).select("__class", F.col("__rep.k1").alias("__k1"), F.col("__rep.k2").alias("__k2")), ["__class", *KEY], "left_semi")
    ties = written(tied(first, threshold, tolerance))
    found = written(compared(with_sets(plain, members(ties, classes), width), threshold, tolerance))
    links = found.groupBy("__class").agg(F.sum("__links").alias("__links"))
    joined = connected_components(starred(found.where(F.col("__class") != F.col("__to"))), "u", "v").select(F.col("node").alias("__class"), F.col("component").alias("__comp"))
    of_class = classes.join(joined, "__class", "left").join(links, "__class", "left").select("__class", "__rep", "__copies", F.coalesce("__comp", "__class").alias("__comp"), F.coalesce("__links", F.lit(0)).alias("__links"))
    heads = of_class.groupBy("__comp").agg(F.min("__rep").alias("__head"))
    of_class = of_class.join(heads, "__comp").select("__class", "__head", (F.col("__links") + F.col("__copies") - 1).alias("n_links"))
    out = rows.select("__id", *KEY, "__class").join(of_class, "__class")
    is_first = (F.col("__k1") == F.col("__head.k1")) & (F.col("__k2") == F.col("__head.k2"))
    return out.select(F.col("__id").alias("doc_id"), F.col("__head.id").alias("class_id"), "n_links", is_first.alias("is_first"), *KEY)


def keep_first(docs: DataFrame, width: int = WIDTH, threshold: Fraction = THRESHOLD, text: str = "text") -> DataFrame:
    """One document of each class: the first one, once. All columns stay as they are."""
    firsts = groups(docs, width, threshold, text=text).where("is_first").select(*KEY).distinct()
    own = docs.select(B.packed(docs), *document_key(F.col("doc_id").cast("long"), B.text_or_empty(text)))
    return B.unpacked(own.join(firsts, KEY, "left_semi").groupBy(*KEY).agg(F.first(B.ROW).alias(B.ROW)), docs.columns)
