"""Every operator against brute force and on odd inputs: nulls, empty and long texts, repeats, clashing columns, empty tables."""

import base64
import hashlib
import inspect
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from graphquarry.llm import batches, byte_bpe, classifier, line_dedup, media, ngram_join, packing, rules, substring_dedup, token_counts, url_filter  # noqa: E402

WORD = re.compile(r"[^ \t-\r]+")
BPE, WORDS, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"))
PROSE = "the cat sat on a mat while thirty dogs of the town ran past it and sang in tune to all who came by "
LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(4000))
ODD = [
    (1, PROSE * 4), (2, None), (3, ""), (4, "   \n\t "), (5, PROSE * 4), (6, LONG), (7, "naïve café 日本語 — it's 12 o'clock\r\n\x0b…"),
    (8, "a" * 3000), (9, LONG[:9000] + " x " + LONG[9000:]), (10, "one two"), (10, "one two"), (11, "one two three"), (None, PROSE * 4), (12, "<|endoftext|> ***&&& !!!"),
    (13, "\n".join(["Page 1 of 7", "same line here"] * 3)), (14, "é" * 700 + " \u3000x\x85y\x1cz"),
]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def odd(spark):
    """The odd rows, with further columns whose names operators use themselves."""
    return spark.createDataFrame(ODD, SCHEMA).withColumns({"score": F.lit("s"), "n_words": F.lit("n"), "__x": F.lit(1), "words": F.lit("w"), "n_tokens": F.lit("t")}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def texts(rows):
    return [(d, t or "") for d, t in rows]


def test_words_and_hashes():
    raw = [t for _, t in texts(ODD)]
    data, off = batches.buffers(pa.array(raw))
    starts, ends, first = batches.word_bounds(data, off)
    got = [[x.decode() for x in batches.strings(data, starts[a:b], ends[a:b])] for a, b in zip(first, first[1:], strict=False)]
    assert got == [WORD.findall(t) for t in raw]
    hashes = batches.word_hashes(data, starts, ends)
    flat = [w for g in got for w in g]
    assert len({*zip(flat, hashes.tolist(), strict=True)}) == len(set(flat)) == len(set(hashes.tolist()))


def test_interner_keeps_numbers():
    table = batches.Interner(most=3)
    for words in (["a", "b", "a", ""], ["c", "d", "b", "a"], ["x", "y", "z", "a", "x"]):
        data, off = batches.buffers(pa.array(words))
        index, new = table.index(data, off[:-1], off[1:])
        assert [len({i for i, w in zip(index, words, strict=True) if w == v}) for v in set(words)] == [1] * len(set(words))
        assert len(set(index.tolist())) == len(set(words))
        table.commit(new)


def test_byte_bpe_matches_library(odd, empty):
    import tiktoken

    with open(BPE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = byte_bpe.encode_documents(odd, BPE, digests=True, keep=("doc_id", "text", "__x")).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    encoded = byte_bpe.encode_documents(odd, BPE, keep=("doc_id", "text"))
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in byte_bpe.decode_documents(encoded, BPE, keep=("text",)).collect())
    assert byte_bpe.encode_documents(empty, BPE).collect() == []


def test_byte_bpe_long_piece_equals_matrix():
    bpe = byte_bpe.tokenizer(BPE, public_tokenizers.PATTERN)
    piece = b"abracadabra" * 20
    assert bpe.by_heap(piece) == bpe.merge([piece], np.array([len(piece)]))[0]


def adpcm_reference(block):
    value, index = struct.unpack("<h", block[:2])[0], min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for n in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            change = (step >> 3) + (step if n & 4 else 0) + (step >> 1 if n & 2 else 0) + (step >> 2 if n & 1 else 0)
            value = max(-32768, min(32767, value - change if n & 8 else value + change))
            index = max(0, min(88, index + int(media.INDEX_CHANGE[n])))
            out.append(value)
    return out


def test_telephony(odd, empty):
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 64 * 20, np.uint8)
    assert media.adpcm_blocks(data).tolist() == [adpcm_reference(data[i : i + 64].tobytes()) for i in range(0, len(data), 64)]
    assert media.MU_LAW_PCM[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0] and media.A_LAW_PCM[[0x55, 0xD5, 0x2A]].tolist() == [-8, 8, -32256]
    assert media.resampled(np.array([8, 8, 8], np.int16)).tolist() == [8] * 6 and len(media.resampled(np.zeros(0, np.int16))) == 0
    for kind in (media.MU_LAW, media.A_LAW, media.IMA_ADPCM):
        for r in media.telephony(odd, F.encode("text", "utf-8"), keep=("doc_id", "text"), kind=kind).collect():
            raw = (r.text or "").encode()
            padded = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
            assert media.wav_data(bytes(r.media))[3] == padded and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
            assert media.wav_data(bytes(r.pcm))[:2] == (media.PCM, 16000)
    assert media.telephony(empty, F.encode("text", "utf-8")).collect() == []


def test_classifier_learns_and_takes_odd_rows(spark, odd, empty, documents, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    model = classifier.train(documents, labels)
    rows = classifier.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r["__x"] == 1 for r in rows)
    assert len({(r.text or "", r.score) for r in rows}) == len({r.text or "" for r in rows})
    assert classifier.score(empty, model).collect() == [] and classifier.train(empty, labels).bias == 0
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert {r.score for r in classifier.score(odd, classifier.train(odd, none)).collect()} == {0.5}


def test_classifier_holds_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = classifier.score(docs.select("doc_id", "text"), classifier.train(docs, labels)).join(labels, "doc_id").where(~classifier.learnable()).collect()
    assert len(scored) > 30 and sum(r.predicted == r.quality for r in scored) >= 0.9 * len(scored)


def test_classifier_bound_is_not_lowered():
    assert inspect.signature(classifier.train).parameters["sample"].default == classifier.SAMPLE == 3000


def rules_reference(text):
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    spots = defaultdict(list)
    for i in range(len(w) - 7):
        spots[tuple(w[i : i + 8])].append(i)
    covered = {i + k for at in spots.values() if len(at) > 1 for i in at for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rules(odd, empty):
    rows = rules.judged(odd).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        n, chars, symbols, dup, repeat = rules_reference(r.text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 20 or 100 * repeat > 30 * n) and (r.kept is False or not r.failed_rules) and r["__x"] == 1
    assert rules.judged(empty).collect() == []


def substring_reference(rows, width):
    first = {}
    key = lambda d: float("inf") if d is None else d
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            first[k] = min(first.get(k, float("inf")), key(d))
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = {i + k for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < key(d) for k in range(width)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("width", [1, 3, 50])
def test_substring_dedup(odd, empty, width):
    order = lambda rows: sorted(rows, key=repr)
    got = [tuple(r) for r in substring_dedup.remove_repeats(odd, width, digests=True).collect()]
    assert order(got) == order(substring_reference(ODD, width))
    kept = substring_dedup.remove_repeats(odd, width).collect()
    assert Counter(hashlib.sha256(" ".join(WORD.findall(r.text)).encode()).hexdigest() for r in kept) == Counter(x[3] for x in got)
    assert all(r["__x"] == 1 and r.n_removed == sum(b - a for a, b in r.removed) for r in kept)
    assert substring_dedup.remove_repeats(empty, width).collect() == []


def grams(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def join_reference(rows):
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if (not sets[i] and not sets[j]) or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    least = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    return [(d, least[find(i)], links[i]) for i, (d, _) in enumerate(rows)]


def near_rows():
    rng = np.random.default_rng(3)
    rows, base = list(ODD), [f"v{x}" for x in rng.integers(0, 9000, 160)]
    for k in range(60):
        w = list(base)
        for _ in range(k % 6):
            w[rng.integers(0, len(w))] = f"edit{k}"
        rows.append((100 + k, " ".join(w)))
    return rows


def test_ngram_join(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)  # several blocks for one component
    rows = near_rows()
    got = ngram_join.groups(spark.createDataFrame(rows, SCHEMA).repartition(3)).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(join_reference(rows), key=repr)
    kept = ngram_join.keep_first(odd)
    assert kept.columns == odd.columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == sorted({c for _, c, _ in join_reference(ODD)})
    assert ngram_join.groups(empty).collect() == [] and ngram_join.keep_first(empty).collect() == []


def test_ngram_join_on_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    got = ngram_join.groups(documents).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got)) == sorted(join_reference(rows))


def test_bayesian_bound():
    least = ngram_join.least_matches(ngram_join.THRESHOLD, 1e-9, 200)
    assert least[20] < least[100] < least[200] < 160  # a pair of similarity 0.8 has 160 equal values of 200 on average


def wordpiece(word, initial, continuing):
    n, i = 0, 0
    while i < len(word):
        pieces = continuing if i else initial
        j = next((j for j in range(len(word), i, -1) if word[i:j] in pieces), None)
        if j is None:
            return 1
        n, i = n + 1, j
    return n


def test_token_counts(odd, empty):
    initial, continuing = map(set, token_counts.word_pieces(PIECES))
    for r in token_counts.count_tokens(odd, PIECES, keep=("doc_id", "text")).collect():
        w = WORD.findall(r.text or "")
        assert (r.n_words, r.n_tokens) == (len(w), sum(wordpiece(x, initial, continuing) for x in w))
    assert token_counts.count_tokens(empty, PIECES).collect() == []


def test_token_counts_small_vocabulary():
    automaton = token_counts.Automaton(["a", "ab", "abcde"], ["c", "cd", "x", "de", "d"])
    words = ["abcd", "abcdx", "abcde", "abcdz", "a", "", "ab", "abc", "abcdde", "z"]
    assert automaton.counts(words).tolist() == [0 if not w else wordpiece(w, {"a", "ab", "abcde"}, {"c", "cd", "x", "de", "d"}) for w in words]


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.org/es/x", "https://a.example.org/en/17?x#y", "http://example.org", "http://x.com/fr/", "http://xcom/fr/", "http://y.com/de/?q", "ftp://m.z.net/a#b", "http://a.net/es/1.html", "x://h?://b.org/", "http://org/", "http://ÄB.org/é"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    for i, url in enumerate(urls):
        host = path = ""
        if url and "://" in url:
            host, path = re.fullmatch(r"([^/?#]*)([^?#]*).*", url.split("://", 1)[1], re.S).groups()
            host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        verdict = best.verdict if best else "block" if any(re.match(url_filter.pattern(g), host + path) for g in url_filter.BLOCKED) else "allow"
        r = got[i]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best.name if best else None, verdict)
    assert url_filter.filter_urls(pages.limit(0)).collect() == []


def test_shift_and_over_many_words():
    globs = tuple(f"{'ab' * k}*c**{k}" for k in range(40))
    automaton = url_filter.ShiftAnd(globs)
    assert automaton.words > 1
    strings = [f"{'ab' * k}{m}c/x{k}" for k in range(40) for m in ("", "zz", "/")]
    hit = automaton.matches(*batches.buffers(pa.array(strings)))
    assert hit.tolist() == [[bool(re.match(url_filter.pattern(g), s)) for g in globs] for s in strings]


def test_packing(odd, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    literals = ["a <|endoftext|> b", "x<|endoftext|>y<|startoftext|>", "<|endoftext|>", "A<|ENDOFTEXT|>b", "<|endoftext|><|endoftext|> it's <|endoftext", "plain text", "end <|startoftext|>", ""]
    every = [*ODD, *((100 + k, x) for k, x in enumerate(literals))]
    rows = packing.pack_documents(odd.select("doc_id", "text").unionByName(odd.sparkSession.createDataFrame(every[len(ODD) :], SCHEMA)), WORDS, limit=512).collect()
    want = Counter()
    for d, text in texts(every):
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 512):
            part = ids[k : k + 512]
            want[d, k // 512, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.pack_documents(empty, WORDS).collect() == []


def test_best_two_fit():
    count = np.zeros(11, np.int64)
    count[[6, 3, 2]] = 1, 1, 2  # greedy puts 3 beside 6; two of 2 fill it
    assert packing.best_two_fit(count, 10)[0] == (1, {6: 1, 2: 2})
    rng = np.random.default_rng(5)
    count = np.bincount(rng.integers(1, 101, 5000), minlength=101)
    plan = packing.best_two_fit(count, 100)
    used = np.zeros(101, np.int64)
    for times, filling in plan:
        assert sum(n * k for n, k in filling.items()) <= 100
        for n, k in filling.items():
            used[n] += times * k
    assert (used == count).all() and sum(times for times, _ in plan) <= 1.02 * (count @ np.arange(101)) / 100


def lines_reference(rows, depth=3, similar=0.7, least=10, words=3):
    docs = sorted({(d is None, d, t or "") for d, t in rows}, key=lambda x: (x[0], x[1] or 0))
    found = []
    for place, (_, _, t) in enumerate(docs):
        for pos, line in enumerate(t.split("\n")):
            w = ["<*>" if re.search("[0-9@]|://", x) else x for x in WORD.findall(line)]
            if len(w) >= words:
                found.append((place, pos, len(w), tuple(w[:depth]), tuple(w)))
    seen = defaultdict(set)
    for place, _, n, head, w in found:
        seen[n, head, w].add(place)
    lead = {}
    for (n, head, w), where in seen.items():
        lead[n, head] = max(lead.get((n, head), (0, "", ())), (len(where), " ".join(w), w))
    group = {k: (k[0], k[1], lead[k[0], k[1]][2] if sum(a == b for a, b in zip(k[2], lead[k[0], k[1]][2], strict=True)) >= similar * k[0] else k[2]) for k in seen}
    where = defaultdict(set)
    for k, places in seen.items():
        where[group[k]] |= places
    gone = defaultdict(set)
    for place, pos, n, head, w in found:
        g = group[n, head, w]
        if len(where[g]) >= least and place != min(where[g]):
            gone[docs[place][1:]].add(pos)
    return Counter((d, "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone[d, t or ""]), len(gone[d, t or ""])) for d, t in rows)


def test_line_dedup(spark, odd, empty):
    rows = list(ODD)
    for k in range(30):
        user = ["anna", "bert", "carl"][k % 3]
        rows.append((200 + k, f"unique text number {'x' * k} here\nPosted by {user} on 2024-01-{k:02d} at our site\nshort line\n\nAll rights are reserved by us" + "\nread more at http://a.b/c" * (k < 9)))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for least in (10, 2):
        got = line_dedup.drop_lines(docs, least_docs=least).collect()
        assert Counter((r.doc_id, r.text, r.n_dropped) for r in got) == lines_reference(rows, least=least)
    out = line_dedup.drop_lines(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_dropped"] and out.count() == len(ODD)
    assert line_dedup.drop_lines(empty).collect() == []


def groups_reference(rows, least=10):
    """Dropped (doc_id, line) where each leaf leads again and again among the templates left."""
    lines = {(d, x) for d, t in rows for x in t.split("\n") if len(x.split()) >= 3}
    where, gone = defaultdict(set), set()
    for d, x in lines:
        where[tuple("<*>" if re.search("[0-9@]|://", y) else y for y in x.split())].add(d)
    for leaf in {(len(w), w[:3]) for w in where}:
        left = [w for w in where if (len(w), w[:3]) == leaf]
        while left:
            lead = max(left, key=lambda w: (len(where[w]), " ".join(w)))
            group = [w for w in left if sum(a == b for a, b in zip(w, lead, strict=True)) >= 0.7 * len(w)]
            left = [w for w in left if w not in group]
            docs = set().union(*(where[w] for w in group))
            if len(docs) >= least:
                gone |= {(d, " ".join(w)) for w in group for d in where[w] if d != min(docs)}
    return gone


def test_line_dedup_several_groups_in_a_leaf(spark):
    """Unrelated lines of a leaf must not keep a family of it; families that follow the second one are found too."""
    names = [f"{a}{b}" for a in "abcde" for b in "vwxyz"]
    family = {0: "posted by our own staff today in town", 1: "posted by our {} friends went home early", 2: "posted by our {} rivals came back late", 3: "posted by our {} cousins sang with them"}
    rows = [(i, family[0]) for i in range(100)]
    rows += [(1000 * k + i, family[k].format(names[i])) for k, n in ((1, 20), (2, 12), (3, 9)) for i in range(n)]
    want = groups_reference(rows)
    assert Counter(d // 1000 for d, _ in want) == {0: 99, 1: 19, 2: 11}
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert {(r.doc_id, dict(rows)[r.doc_id]) for r in line_dedup.drop_lines(docs).collect() if r.n_dropped} == want
    fewer = [r for r in rows if r[0] >= 100]
    got = line_dedup.drop_lines(spark.createDataFrame(fewer, SCHEMA)).where("n_dropped > 0").collect()
    assert {r.doc_id for r in got} == {d for d, _ in want if d >= 100}


def test_variable_words():
    java = re.compile(line_dedup.VARIABLE)
    for line in ("a b2 c", "x@y z", "see http://q.r now", "a:b c::d e:/f", "1", "no fields", "::// x", "é9 ü"):
        want = " ".join("<*>" if re.search("[0-9@]|://", w) else w for w in line.split(" "))
        assert java.sub("<*>", line) == want


def test_line_dedup_groups_of_large_leaves(spark):
    rng = random.Random(4)
    # one leaf of many templates, another of a few, and lines that are like no other
    body = [" ".join(["a b c", *(rng.choice("xy") for _ in range(5)), rng.choice("uvw")]) for _ in range(300)] + ["a b d x", "a b d y", "a b d x"] * 5
    body += [f"a b c {''.join(rng.choices('ghij', k=4))} {''.join(rng.choices('ghij', k=4))} p q r {i % 7}z" for i in range(40)]
    rows = [(k % 90, k % 90, k % 3 + len(t.split()), t) for k, t in enumerate(body)]
    rows = sorted({(d % 90, d % 90, len(t.split()), t) for d, _, _, t in rows})
    by_doc = spark.createDataFrame(rows, "__k1 long, __k2 long, __l1 long, __template string").withColumn("__l2", F.lit(0).cast("long")).withColumn("__id", F.col("__k1"))
    want, near = {}, lambda a, b: 10 * sum(x == y for x, y in zip(a.split(), b.split(), strict=True)) >= 7 * len(a.split())
    docs = {}
    for d, _, leaf, t in rows:
        docs.setdefault((leaf, t), set()).add(d)
    leads: dict = {}
    for leaf, t in sorted(docs, key=lambda x: (len(docs[x]), x[1]), reverse=True):
        lead = next((y for y in leads.setdefault(leaf, []) if near(t, y)), None)
        if lead is None:
            leads[leaf].append(lead := t)
        want.setdefault((leaf, lead), set()).add(t)
    large = {k: v for k, v in want.items() if len(set().union(*(docs[k[0], t] for t in v))) >= 10}
    for head in (512, 3):
        got: dict = {}
        for r in line_dedup.groups(by_doc, 0.7, 10, head).collect():
            got.setdefault((r["__l1"], r["__group"]), set()).add(r["__template"])
        assert len(large) > 3 and {k: v for k, v in got.items() if k in large} == large
        assert sum(map(len, got.values())) == len({(leaf, t) for leaf, t in docs if any(leaf == k[0] and t in v for k, v in got.items())})


def test_line_dedup_takes_one_round_for_many_groups(spark, monkeypatch):
    lines = [f"s s s {chr(97 + i % 26)}{chr(97 + i // 26)} {chr(98 + i % 20)}{chr(97 + i % 23)} t{chr(97 + i % 19)}" for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    calls, plain = [], line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda *a: calls.append(1) or plain(*a))
    assert line_dedup.drop_lines(docs).where("n_dropped > 0").isEmpty()
    assert len(calls) < 8
