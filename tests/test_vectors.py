"""The vector index against the exact scan, and the exact scan against numpy."""

import numpy as np
import pytest

from graphquarry.operators import vectors


def test_exact_against_numpy(spark):
    rng = np.random.default_rng(1)
    own = rng.normal(size=(300, 8))
    rows = [(f"v{n}", x.tolist()) for n, x in enumerate(own)] + [("zero", [0.0] * 8), ("short", [1.0, 2.0]), ("null", None), ("hole", [1.0, None] * 4), ("empty", []), ("v3copy", own[3].tolist())]
    frame = spark.createDataFrame(rows, "entity_id string, vec array<double>").repartition(3)
    asked = spark.createDataFrame([(n, own[n].tolist()) for n in range(0, 40, 3)] + [(90, [1.0, 2.0]), (91, [0.0] * 8)], "query long, vec array<double>")
    got = {}
    for r in vectors.nearest(frame, asked, 5).collect():
        got.setdefault(r.query, []).append((r["rank"], r.id))
    whole = {i: np.asarray(v, np.float32).astype(float) for i, v in rows if v and None not in v and any(v)}
    for n in range(0, 40, 3):
        q = np.float32(own[n]).astype(float)
        near = sorted((-round(float(v @ q / np.linalg.norm(v) / np.linalg.norm(q)), 12), i) for i, v in whole.items() if len(v) == 8)[:5]
        assert [i for _, i in sorted(got[n])] == [i for _, i in near]
    assert got[90] == [(1, "short")] and 91 not in got


def recall(index, frame, asked, k=20, **how):
    want, got = set(), set()
    for r in vectors.nearest(frame, asked, k).collect():
        want.add((r.query, r.id))
    scores = {}
    for r in index.search(asked, k, **how).collect():
        got.add((r.query, r.id))
        scores[r.query, r.id] = r.score
    return len(want & got) / len(want), scores


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_recall_of_every_twentieth_row(spark, table):
    frame = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet").selectExpr("vec_id as entity_id", "embedding as vec")
    asked = frame.where("entity_id % 20 = 0").selectExpr("entity_id as query", "vec")
    index = vectors.VectorIndex.build(frame)
    assert index.rows.count() == frame.count()  # every row is in a list
    share, scores = recall(index, frame, asked)
    assert share >= 0.95, share
    exact = {(r.query, r.id): r.score for r in vectors.nearest(frame, asked, 20).collect()}
    assert all(abs(s - exact[p]) < 1e-6 for p, s in scores.items() if p in exact)


def test_few_lists_where_vectors_lie_in_groups(spark):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(60, 24))
    rows = [(n, (middle[n % 60] + 0.15 * rng.normal(size=24)).tolist()) for n in range(3000)]
    frame = spark.createDataFrame(rows, "entity_id long, vec array<float>")
    index = vectors.VectorIndex.build(frame)
    assert index.probes < 0.2 * len(index.centres)
    share, _ = recall(index, frame, frame.where("entity_id % 20 = 0").selectExpr("entity_id as query", "vec"))
    assert share >= 0.95, share


def test_long_lists_are_cut(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PART", 40)
    rng = np.random.default_rng(3)
    same = rng.normal(size=16)
    rows = [(f"a{n:03}", (same + 0.01 * rng.normal(size=16)).tolist()) for n in range(300)] + [(f"b{n:03}", rng.normal(size=16).tolist()) for n in range(100)]
    frame = spark.createDataFrame(rows, "entity_id string, vec array<float>")
    index = vectors.VectorIndex.build(frame, lists=6)
    assert max(index.parts.values()) > 1 and index.rows.groupBy("list", "part").count().agg({"count": "max"}).first()[0] < 120
    asked = spark.createDataFrame([(n, rows[n][1]) for n in (0, 5, 310)], "query long, vec array<float>")
    share, _ = recall(index, frame, asked, 20, probes=6)
    assert share >= 0.95
    only = frame.where("entity_id like 'b%'").selectExpr("entity_id as id")
    assert all(r.id.startswith("b") for r in index.search(asked, 5, probes=6, fresh=only).collect())


def test_nothing(spark):
    none = spark.createDataFrame([], "entity_id string, vec array<float>")
    asked = spark.createDataFrame([(1, [1.0])], "query long, vec array<float>")
    assert vectors.VectorIndex.build(none) is None and vectors.nearest(none, asked).count() == 0
    assert vectors.nearest(spark.createDataFrame([("a", [1.0])], "entity_id string, vec array<float>"), asked.limit(0)).count() == 0
