"""The stored index against reading everything: the best hits, what is read for them, and changes."""

import random

import pytest
from pyspark.sql import functions as F

from graphquarry.operators import ranked, search

WORDS = "load store parse parser parsing index query table row rows column cache graph node edge walk path file line token name kind scan join merge sort list count total state".split()
SCHEMA = "id string, kind string, name string, short_name string, summary string, properties string"


def entity(k, rng):
    name = "_".join(rng.choices(WORDS, k=rng.randint(1, 3)))
    return (f"e{k:05d}", rng.choice(["class", "function", "module"]), f"pkg.{name}", name, " ".join(rng.choices(WORDS, k=rng.randint(0, 25))) if k % 3 else None, "{}")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return {(e := entity(k, rng))[0]: e for k in range(3000)}


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    ranked.RANGE, before = 40, ranked.RANGE
    made = ranked.Index.create(spark.createDataFrame(list(rows.values()), SCHEMA).repartition(4), f"{tmp_path_factory.mktemp('index')}/i", 8)
    yield made
    ranked.RANGE = before


class Plain:
    """BM25 of all entities in Python."""

    def __init__(self, rows):
        import re

        self.docs = {}
        for e in rows.values():
            words = re.findall(r"[^\W_]+", " ".join(x for x in e[2:5] if x).lower())
            terms = [search.stem(w) for w in words]
            self.docs[e[0]] = (e[1], terms)
        self.mean = sum(len(t) for _, t in self.docs.values()) / len(self.docs)

    def top(self, text, k, kind=None):
        terms, out = search.query_terms(text), []
        df = {t: sum(t in own for _, own in self.docs.values()) for t in terms}
        for i, (of, own) in self.docs.items():
            if all(t in own for t in terms) and kind in (None, of):
                score = 0.0
                for t in terms:
                    tf = own.count(t)
                    score += ranked.idf(len(self.docs), df[t]) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own) / self.mean)))
                out.append((i, score))
        return sorted(out, key=lambda x: (-round(x[1], 9), x[0]))[:k]


def same(got, want):
    assert [i for i, _ in got] == [i for i, _ in want]
    assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(got, want, strict=True))


def test_top_equals_reading_everything(spark, index, rows):
    plain, rng, read, most = Plain(rows), random.Random(9), 0, 0
    for n in range(25):
        text = " ".join(rng.choices(WORDS, k=1 + n % 3))
        kind = "class" if n % 4 == 3 else None
        seen = []
        same(index.top(text, 10, kind, seen), plain.top(text, 10, kind))
        if n % 3 == 0 and kind is None:  # others have few hits in all, and need most ranges that have any
            read, most = read + sum(seen), most + index.bounds(search.query_terms(text), index.weights(search.query_terms(text))).count()
    assert read < 0.3 * most  # of the ranges that have the term
    assert index.top("", 5) == index.top("nosuchword load", 5) == index.top("load", 0) == []


def test_all_hits_equal_the_unstored_index(spark, index, rows):
    entities = spark.createDataFrame(list(rows.values()), SCHEMA)
    a = {r.id: round(r.score, 9) for r in index.ranked("parsing tables").collect()}
    b = {r.id: round(r.score, 9) for r in search.bm25(search.inverted_index(entities), "parsing tables").collect()}
    assert a and a == b


def test_files_are_pruned(spark, index):
    terms = ["load", "cach"]
    plan = index.rows_of(terms, "postings").where(F.col("range").isin(5, 6))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") and "In(term" in plan and "In(range" in plan
    narrow = index.bounds(terms, index.weights(terms))._jdf.queryExecution().executedPlan().toString()
    assert "hits" not in narrow  # bounds are read without postings


def test_changes_by_segments(spark, index, rows):
    rng, now, current = random.Random(11), dict(rows), index
    for step in range(3):
        changed = {f"e{k:05d}": entity(k, rng) for k in rng.sample(range(3200), 120)}
        removed = [k for k in rng.sample(sorted(now), 30) if k not in changed]
        current = current.replace(spark.createDataFrame(list(changed.values()), SCHEMA), spark.createDataFrame([(k,) for k in removed], "id string"))
        now = {k: v for k, v in (now | changed).items() if k not in removed}
        assert current.state["docs"] == len(now)
        plain = Plain(now)
        for text in ("load", "graph node", "parse list"):
            same(current.top(text, 12), plain.top(text, 12))
    one = current.merged()
    assert len(one.segments) == 1 and len(current.segments) == 4
    same(one.top("edge walk", 12), plain.top("edge walk", 12))
    same(index.top("load", 12), Plain(rows).top("load", 12))  # the first version is still there


def test_find_pages(spark, index, rows):
    entities = spark.createDataFrame(list(rows.values()), SCHEMA)
    ids = lambda **x: [r.id for r in ranked.find(entities, index, **x).collect()]
    plain = Plain(rows)
    first = [i for i, _ in plain.top("merge sort", 5000)]
    rest = sorted(e[0] for e in rows.values() if any("merge sort" in (x or "") for x in (*e[:1], *e[2:5])) and e[0] not in first)
    everything = first + rest
    assert ids(text="merge sort", limit=7) == everything[:7]
    assert ids(text="merge sort", limit=50, offset=len(first) - 3) == everything[len(first) - 3 : len(first) + 47]
    assert ids(text="pkg.load", limit=5) == sorted(e[0] for e in rows.values() if "pkg.load" in e[2])[:5]
    for bad in ({"text": " "}, {"text": "x", "offset": search.MOST_OFFSET + 1}):
        with pytest.raises(ValueError):
            ids(**bad)


def test_words_are_counted_where_entities_lie(spark, rows):
    entities = spark.createDataFrame([*rows.values(), ("none", "class", "", None, None, "{}"), ("odd", "class", "Été x2 ies sses 日本 x2", "A", "½ caresses", "{}")], SCHEMA)
    got = ranked.counted(entities)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = search.inverted_index(entities).groupBy("id").agg(F.max("length").alias("length"), F.sort_array(F.collect_list(F.struct("term", "tf"))).alias("terms"))
    assert {r.id: (r.length, r.terms) for r in got.collect()} == {r.id: (r.length, r.terms) for r in want.collect()}


def test_hits_are_dealt_in_passes(spark, rows, index, tmp_path, monkeypatch):
    monkeypatch.setattr(ranked, "DOCS", 1000)
    monkeypatch.setattr(ranked, "RANGE", 40)
    made = ranked.Index.create(spark.createDataFrame(list(rows.values()), SCHEMA), f"{tmp_path}/i", 8)
    assert made.top("load store", 10) == index.top("load store", 10)
    a, b = (i.read(i.segments[0], "postings").selectExpr("term", "range", "n", "most", "hits.id as ids", "bucket") for i in (made, index))
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_a_text_that_is_not_of_words_makes_no_index(spark, rows):
    entities = spark.createDataFrame(list(rows.values()), SCHEMA)
    assert ranked.find(entities, lambda: pytest.fail("an index was made"), "pkg.load", None, 5).count() == 5
