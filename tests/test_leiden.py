"""Communities: both forms alike, connected, and no worse than moves without refinement."""

import random
import time

import numpy as np
import pytest

from graphquarry.operators import cluster


def planted(n, groups, seed, inner=6, outer=1):
    rng, edges = random.Random(seed), {}
    for u in range(n):
        for _ in range(inner):
            v = rng.randrange(u % groups, n, groups)
            edges[u, v] = edges.get((u, v), 0) + rng.randint(1, 5)
        for _ in range(outer):
            v = rng.randrange(n)
            edges[u, v] = edges.get((u, v), 0) + 1
    return edges


def level(edges):
    names = sorted({f"m{x:05d}" for e in edges for x in e})
    at = {x: i for i, x in enumerate(names)}
    u, v = (np.array([at[f"m{e[k]:05d}"] for e in edges]) for k in (0, 1))
    return cluster.Level(names, u, v, np.array(list(edges.values()), np.int64), 1.0)


def frame(spark, edges):
    return spark.createDataFrame([(f"m{u:05d}", f"m{v:05d}", w) for (u, v), w in edges.items()], "from_id string, to_id string, reference_count long")


def whole(own, place):
    """Moves and aggregation by communities, without refinement."""
    at, now, place = np.arange(own.n), own, place
    while True:
        new = now.moved(np.arange(now.n))
        if now.quality(new) <= now.quality(np.arange(now.n)):
            return place
        now, up, kept = now.aggregated(cluster.least_of(new))
        at = up[at]
        place = cluster.least_of(at)


def connected(own, place):
    return len(np.unique(cluster.parts_of(own, place))) == len(np.unique(place))


def test_no_worse_than_moves_alone_and_connected():
    better = 0
    for seed in range(20):
        own = level(planted(60 + 10 * seed, 4 + seed % 5, seed, 2 + seed % 4, 1 + seed % 3))
        place = cluster.leiden(own)
        plain = whole(own, np.arange(own.n))
        assert connected(own, place)
        assert own.quality(place) >= own.quality(plain), seed
        better += own.quality(place) > own.quality(plain)
    assert better >= 5


def test_parts_are_connected_and_within_communities():
    for seed in range(10):
        own = level(planted(80, 5, 50 + seed, 3, 2))
        place = own.moved(np.arange(own.n))
        part = own.refined(place)
        assert connected(own, part) and all(len(np.unique(place[part == p])) == 1 for p in np.unique(part))
        assert len(np.unique(part)) < own.n


def test_planted_groups_are_found():
    own = level(planted(300, 6, 1, 8, 1))
    place = cluster.leiden(own)
    groups = {}
    for name, c in zip(own.names, place, strict=True):
        groups.setdefault(int(name[1:]) % 6, []).append(c)
    assert sum(max(x.count(c) for c in set(x)) for x in groups.values()) > 0.95 * own.n


def test_one_task_gives_the_same(spark):
    edges = planted(40, 4, 1, 3, 1)
    own = level(edges)
    assert {r.id: r.community for r in cluster.communities(frame(spark, edges)).collect()} == {n: own.names[c] for n, c in zip(own.names, cluster.leiden(own), strict=True)}


def test_joins_give_the_same(spark, monkeypatch):
    """With few rounds, as each is a few jobs; the numpy form has as few here."""
    for name, value in (("ROUNDS", 4), ("LEVELS", 2), ("PASSES", 1)):
        monkeypatch.setattr(cluster, name, value)
    edges = planted(16, 3, 0, 3, 1)
    own = level(edges)
    want = {n: own.names[c] for n, c in zip(own.names, cluster.leiden(own), strict=True)}
    assert {r.id: r.community for r in cluster.communities(frame(spark, edges), small=0).collect()} == want
    assert 1 < len(set(want.values())) < 16


def test_few_jobs_for_many_modules(spark):
    graph = frame(spark, planted(1500, 30, 3)).repartition(4).cache()
    graph.count()
    spark.sparkContext.setJobGroup("leiden", "")
    began = time.perf_counter()
    found = cluster.communities(graph).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("leiden"))
    spark.sparkContext.setJobGroup("", "")
    assert len(found) == 1500 and jobs <= 30, jobs
    assert time.perf_counter() - began < 60


def test_odd_graphs(spark):
    schema = "from_id string, to_id string, reference_count long"
    assert cluster.communities(spark.createDataFrame([], schema)).count() == 0
    rows = cluster.communities(spark.createDataFrame([("a", "a", 3), ("b", "c", 0), (None, "d", 1), ("e", None, 1)], schema)).collect()
    assert sorted(map(tuple, rows)) == [("a", "a"), ("b", "b"), ("c", "c")]


def test_fallback_rule(spark):
    """Components stand in where at most one community is large enough, and only if they are more."""
    schema = "from_id string, to_id string, reference_count long"
    pair = spark.createDataFrame([(f"a{i}", f"a{j}", 5) for i in range(4) for j in range(4) if i != j] + [("b0", "b1", 5), ("b1", "b0", 5)], schema)
    made, _ = cluster.materialised(pair)
    assert [sorted(r.members) for r in made.collect()] == [["a0", "a1", "a2", "a3"]]  # two communities, one large enough, one such component
    made, _ = cluster.materialised(pair, least_size=9)
    assert made.count() == 0
