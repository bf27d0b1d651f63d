"""Lexical search, alignment of two vocabularies and mixing, against brute force and on odd rows."""

import hashlib
import heapq
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from graphquarry.llm import alignment, batches, lexical, mixing  # noqa: E402
from tests.llm.test_edges import NAMES  # noqa: E402
from tests.llm.test_operators import LONG, ODD, SCHEMA  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ITEMS = [(1, "The cat, the DOG and w17 w23!"), (2, None), (3, "..."), (4, "Café 日本語 naïve"), (None, "one two three"), (5, "one two three"), (1, "thirty dogs")]
LETTERS = ["a", "the", "Zoë", " ", "  ", "\n", "\r\n", "\t", ".", ",", "!?", " ", "　", " ", "\x85", "\x1c", "▁", "<s>", "<0x0A>", "<|endoftext|>", "don't", "()", ";\r", "ほ", "日本", "🙂", "²", "1234", "'", "é", "​", "﻿", "x"]


def mixed_texts(n, seed):
    rng = random.Random(seed)
    return [(100 + k, "".join(rng.choices(LETTERS, k=rng.randint(1, 60)))) for k in range(n)]


@pytest.fixture()
def small_batches(spark):
    """A chunk is a batch at most, so that small tables have several shards and blocks."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_varints():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**35, 2**62], np.int64)
    data, size = batches.varints(values)
    assert batches.from_varints(data).tolist() == values.tolist() and int(size.sum()) == len(data)
    assert size.tolist() == [1, 1, 1, 2, 2, 3, 6, 9]
    assert not len(batches.from_varints(batches.varints(values[:0])[0]))


def ranked(docs, items, k=50):
    find = lambda t: re.findall(lexical.TERM, (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    terms = [(d, find(t)) for d, t in docs]
    full = [(d, Counter(t), len(t)) for d, t in terms if t]
    n, total = len(full), sum(x for *_, x in full)
    df = Counter(t for _, c, _ in full for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, size in full:
            m = 50 + 50 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(find(text)) if t in c)
            if score:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(heapq.nsmallest(k, scored))]
    return Counter(out)


@pytest.mark.parametrize("size", [lexical.SHARD_BYTES, 3000])
def test_search_against_brute_force(spark, monkeypatch, small_batches, size):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 200)  # several blocks of queries
    docs = [*ODD, *mixed_texts(200, 1)]
    frame = spark.createDataFrame(docs, SCHEMA).select("*", *(F.lit(n).alias(n) for n in NAMES)).repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    index = lexical.build(frame, shard_bytes=size)
    for k in (3, 50):
        assert Counter(map(tuple, lexical.search(index, items, k).collect())) == ranked(docs, ITEMS, k)
    shards = index.where("term is null").count()
    assert shards == 3 if size > 100_000 else shards > 5
    assert index.agg(F.sum(F.when(F.col("term").isNull(), F.col("total")).otherwise(-F.col("total"))).alias("n")).first()["n"] == 0


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(lexical.build(none), items).count() == 0
    some = lexical.build(spark.createDataFrame(ODD, SCHEMA))
    assert lexical.search(some, items.limit(0)).count() == 0
    assert lexical.search(some, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    words = spark.createDataFrame([("x1", "one cat"), (None, "one")], SCHEMA.replace("long", "string"))
    assert [(r.rank, r.doc_id) for r in lexical.search(lexical.build(words), items.where("item_id = 1")).orderBy("rank").collect()] == [(1, None)]


def test_equal_scores_by_doc_id(spark):
    docs = spark.createDataFrame([(k * 7919 % 1000, "same words here") for k in range(400)] + [(2000, "other")] * 500, SCHEMA).repartition(5)
    rows = lexical.search(lexical.build(docs), spark.createDataFrame([(1, "words")], "item_id long, text string")).orderBy("rank").collect()
    ids = sorted(k * 7919 % 1000 for k in range(400))[:50]
    assert [r.doc_id for r in rows] == ids and [r["rank"] for r in rows] == list(range(1, 51))


def aligned(docs):
    """Whole texts by the libraries alone, and all pairs of a group."""
    own = alignment.Pair(A, B)
    byte = {}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    for n, b in enumerate([*shown, *(b for b in range(256) if b not in shown)]):
        byte[chr(b if n < len(shown) else 256 + n - len(shown))] = b
    of_a = lambda i: bytes(byte[c] for c in own.a.id_to_token(i))
    of_b = lambda i: bytes([int(own.b.id_to_piece(i)[3:5], 16)]) if own.b.is_byte(i) else own.b.id_to_piece(i).replace("▁", " ").encode()
    made, count = [], Counter()
    for d, t in docs:
        groups, links, sides = [], [], ([], [])
        if t:
            ids = own.a.encode(" " + t, add_special_tokens=False).ids, own.b.encode(t)
            if b"".join(map(of_a, ids[0])) == (" " + t).encode() == b"".join(map(of_b, ids[1])):
                for side, x, of in zip(sides, ids, (of_a, of_b), strict=True):
                    at = 0
                    for i in x:
                        side.append((i, at, at + len(of(i))))
                        at = side[-1][2]
                before = 0
                for cut in sorted({e for *_, e in sides[0]} & {e for *_, e in sides[1]}):
                    x, y = ([p for p in side if before < p[2] <= cut] for side in sides)
                    groups.append(",".join(str(p[0]) for p in x) + "|" + ",".join(str(p[0]) for p in y))
                    links += [(p[0], q[0]) for p in x for q in y if p[1] < q[2] and q[1] < p[2]]
                    before = cut
        count.update(links)
        made.append((d, len(sides[0]), len(sides[1]), ";".join(groups), len(groups), links))
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return Counter((d, a, b, n, len(x), sum(count[p] == most[p[1]] for p in x), sum(count[p] for p in x), hashlib.sha256(g.encode()).hexdigest() if g else "", g) for d, a, b, g, n, x in made)


@pytest.mark.parametrize("size,hot", [(alignment.BLOCK_BYTES, alignment.HOT), (2000, 5)])
def test_alignment_against_brute_force(spark, monkeypatch, small_batches, size, hot):
    monkeypatch.setattr(alignment, "HOT", hot)
    docs = [*ODD, *mixed_texts(300, 2), (7, "▁ mark"), (8, ".start"), (9, "\nline"), (9, "x" * 500)]
    frame = spark.createDataFrame(docs, SCHEMA).select("*", *(F.lit(n).alias(n) for n in NAMES)).repartition(3)
    rows = alignment.align(frame, A, B, keep=("doc_id", *NAMES), groups=True, block_bytes=size).collect()
    assert Counter((r.doc_id, *(r[c] for c in (*alignment.MADE, "groups"))) for r in rows) == aligned(docs)
    assert all(r[n] == n for r in rows for n in NAMES)


def test_files_that_do_not_cut(spark, monkeypatch):
    assert alignment.Pair(A, B).cuts
    docs = [*ODD[:7], *mixed_texts(40, 3)]
    want = aligned(docs)
    monkeypatch.setattr(alignment, "crossed", lambda before, c: True)
    batches.held("none", lambda: None)
    assert not alignment.Pair(A, B).cuts
    own = alignment.Pair(A, B)
    texts = [(" " + t).encode() if t else b"" for _, t in docs]
    off = np.cumsum([0, *map(len, texts)])
    starts, _, _ = own.units(np.frombuffer(b"".join(texts), np.uint8), off)
    assert len(starts) == sum(bool(t) for t in texts)
    good = own.faithful(np.frombuffer(b"".join(texts), np.uint8), off)
    ids = {d: bool(g) for (d, *_, g) in want}
    assert [bool(x) for x, t in zip(good, texts, strict=True) if t] == [ids[d] for (d, t), x in zip(docs, texts, strict=True) if x]


def test_alignment_of_nothing(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA), A, B).count() == 0
    rows = alignment.align(spark.createDataFrame([(1, None), (2, "")], SCHEMA), A, B).collect()
    assert sorted(map(tuple, rows)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def levels(sizes, most=3):
    """Targets by sharing the excess again and again. sizes: source -> words, in order."""
    weight = {s: 1 + k % 3 for k, s in enumerate(sizes)}
    left, full, words = dict(sizes), {}, sum(sizes.values())
    while left:
        share = (words - sum(full.values())) / sum(weight[s] for s in left)
        over = [s for s in left if share * weight[s] >= most * left[s]]
        if not over:
            return full | {s: share * weight[s] for s in left}
        for s in over:
            full[s] = most * left.pop(s)
    return full


def mixed(docs):
    """Documents of a source in the order of their hash."""
    size = lambda t: len(re.findall(mixing.WORD, t or ""))
    place = lambda d, t: int(hashlib.md5((str(d) if d is not None else "t" + (t or "")).encode()).hexdigest()[:15], 16)
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += size(t)
    target = levels({s: sizes[s] for s in sorted(sizes, key=lambda s: (s is None, s or ""))})
    taken = {}
    for s, n in sizes.items():
        times = int(target[s] // n) if n else 0
        rest, own, before = target[s] - times * n, defaultdict(int), 0
        for d, t, x in docs:
            if x == s:
                own[place(d, t)] += size(t)
        below = 0
        for h in sorted(own):
            if before <= rest < before + own[h]:
                below = h + (2 * rest > 2 * before + own[h])
            before += own[h]
        for d, t, x in docs:
            if x == s:
                taken[d, t, s] = size(t) * (times + (place(d, t) < below))
    return [(d, size(t), sizes[s], target[s], taken[d, t, s]) for d, t, s in docs]


def sourced(n, seed):
    rng = random.Random(seed)
    docs = [(d, t, "odd") for d, t in ODD]
    for k in range(n):
        source = rng.choice(["hot"] * 12 + ["a", "b", "ü", "日", "", "tiny"] + [None])
        docs.append((1000 + k, " ".join(["w"] * (rng.randint(0, 3) if source == "tiny" else rng.choice([0, 5, 50, 400]))), source))
    return docs


def test_mix_against_brute_force(spark):
    docs = sourced(1500, 4)
    frame = spark.createDataFrame(docs, SCHEMA + ", source string").select("*", *(F.lit(n).alias(n) for n in NAMES)).repartition(4)
    rows = mixing.mix(frame, keep=("doc_id", "source", *NAMES)).collect()
    close = lambda rs: Counter((d, a, b, round(c, 6), e) for d, a, b, c, e in rs)
    assert close((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in rows) == close(mixed(docs))
    assert all(r[n] == n for r in rows for n in NAMES if n not in mixing.OWN)
    got, target, longest = Counter(), {}, defaultdict(int)
    for r in rows:
        got[r.source] += r.taken
        target[r.source] = r.target
        longest[r.source] = max(longest[r.source], r.size)
        assert r.taken <= 3 * r.size
    assert all(abs(got[s] - t) <= max(longest[s], 1) for s, t in target.items())
    assert abs(sum(target.values()) - sum(r.size for r in rows)) < 1e-6
    assert any(abs(t - 3 * sum(r.size for r in rows if r.source == s)) < 1e-6 for s, t in target.items())  # one is full


def test_mix_levels_and_nesting(spark, monkeypatch):
    """Few bits make the boundary bucket be refined; larger budgets take all that smaller ones do."""
    monkeypatch.setattr(mixing, "BITS", 4)
    monkeypatch.setattr(mixing, "LEVELS", 15)
    docs = spark.createDataFrame([(k, "w " * (1 + k % 9), "ab"[k % 2]) for k in range(600)], SCHEMA + ", source string")
    before = None
    for share in (1, 2, 3, 5):
        weights = spark.createDataFrame([("a", share), ("b", 10)], "source string, weight int")
        rows = {r.doc_id: (r.taken, r.target) for r in mixing.mix(docs, weights).collect()}
        a = {d: x[0] for d, x in rows.items() if d % 2 == 0}
        assert abs(sum(a.values()) - rows[0][1]) <= 9
        assert before is None or all(a[d] >= before[d] for d in a)
        before = a
    assert {d: x[0] for d, x in rows.items() if d % 2 == 0} == before


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA + ", source string")).count() == 0
    rows = mixing.mix(spark.createDataFrame([(1, None, None), (2, "", "x")], SCHEMA + ", source string")).collect()
    assert sorted(map(tuple, rows)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
