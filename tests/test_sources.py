"""Extraction from Python files, SARIF, snapshots, and streams."""

import json
import random

from pyspark.sql import functions as F

from graphquarry.sources import python_code as P
from graphquarry.sources import tree
from graphquarry.streaming import feeds

CODE = '''
"""Doc."""
from __future__ import annotations
import os.path as osp
from typing import TYPE_CHECKING, overload
from . import helper
if TYPE_CHECKING:
    import heavy
__all__ = ["Service"]

class Base:
    pass

class Service(Base):
    def run(self, x):
        def inner():
            return helper.go(x)
        import lazy
        return inner()

@overload
def make(a): ...
def make(a):
    "Makes."
    return Service().run(a)

def test_make():
    make(1).stop()
'''
FILES = [("src/pkg/core.py", CODE), ("src/pkg/helper.py", "def go(x):\n    return x\n"), ("src/pkg/__init__.py", ""), ("src/pkg/bad.py", "def (:"), ("src/pkg/none.py", None)]


def extracted(spark):
    return P.extract(spark.createDataFrame(FILES, "path string, content string"))


def test_entities_and_tags(spark):
    rows = extracted(spark)
    got = {r.id: r for r in P.entities(rows).collect()}
    assert set(got) == {"python:module:" + m for m in ("pkg.core", "pkg.helper", "pkg", "pkg.bad", "pkg.none")} | {
        "python:class:pkg.core.Base", "python:class:pkg.core.Service", "python:function:pkg.core.Service.run", "python:function:pkg.core.Service.run.<locals>.inner",
        "python:function:pkg.core.make", "python:function:pkg.core.test_make", "python:function:pkg.helper.go"}
    assert got["python:function:pkg.core.make"].signature == "(a)" and json.loads(got["python:function:pkg.core.make"].properties) == {"docstring": "Makes."}
    assert json.loads(got["python:module:pkg.bad"].properties) == {"syntax_degraded": "syntax_error"}
    tags = {(r.entity_id.split(":")[-1], r.tag) for r in P.tags(rows).collect()}
    assert {("pkg.core.Service", "exported-api"), ("pkg.core.test_make", "test"), ("pkg.helper.go", "public-surface")} <= tags and ("pkg.core.make", "exported-api") not in tags
    assert P.problems(P.entities(rows)).count() == 0


def test_edges_and_sites(spark):
    rows = extracted(spark)
    edges, sites = P.resolve_sites(rows, P.entities(rows))
    got = {(r.kind, r.from_id.split(":")[-1], r.to_id.split(":")[-1]): r for r in edges.collect()}
    assert ("contains", "pkg.core.Service", "pkg.core.Service.run") in got and ("inherits_from", "pkg.core.Service", "pkg.core.Base") in got
    assert ("calls", "pkg.core.Service.run.<locals>.inner", "pkg.helper.go") in got and ("calls", "pkg.core.test_make", "pkg.core.make") in got
    props = {k[2]: json.loads(r.properties) for k, r in got.items() if k[0] == "imports"}
    assert props["heavy"]["type_only"] is True and props["lazy"]["scope"] == "function" and props["os.path"]["scope"] == "module" and props["pkg.helper"]["level"] == 1
    assert {"().stop", "().run"} <= {r.callee_expr for r in sites.collect()}


def test_tree_and_snapshot(spark, tmp_path):
    (tmp_path / "a/node_modules").mkdir(parents=True)
    for name, text in (("a/x.py", "é = 1\n"), ("a/y.txt", ""), ("a/node_modules/z.py", ""), ("a/skip.py", "")):
        (tmp_path / name).write_text(text)
    found = tree.files(spark, str(tmp_path), (".py",), ("**/skip.py",))
    assert [(r.path, r.content) for r in found.collect()] == [("a/x.py", "é = 1\n")]
    edges = spark.createDataFrame([("calls", "a", "b"), ("imports", "a", "c")], "kind string, from_id string, to_id string")
    tree.write_snapshot({"edges": edges}, str(tmp_path / "store"), "v1")
    assert tree.read_snapshot(spark, str(tmp_path / "store"), "edges").where("kind = 'calls'").count() == 1


def test_sarif(spark, tmp_path):
    log = {"runs": [{"tool": {"driver": {"name": "lint"}}, "results": [
        {"ruleId": "R1", "level": "error", "message": {"text": "bad"}, "partialFingerprints": {"b": "2", "a": "1"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "x.py"}, "region": {"startLine": 3}}}]},
        {"ruleId": "R2", "message": {"text": "hm"}}]}]}
    (tmp_path / "log.sarif").write_text(json.dumps(log, indent=1))
    got = {r.rule_id: r for r in tree.sarif(spark, str(tmp_path / "log.sarif")).collect()}
    assert (got["R1"].severity, got["R1"].path, got["R1"].line_start, got["R1"].fingerprint) == ("high", "x.py", 3, "1") and (got["R2"].severity, got["R2"].path) == ("medium", None)


def trips(crashes, most, width):
    """Every failure held against all others."""
    return {(k, t, n) for k, t in crashes if (n := sum(a == k and 0 <= t - b < width for a, b in crashes)) > most}


def test_breaker_stream(spark, tmp_path):
    """Random times, dealt to files out of order, over several batches."""
    rng, micros = random.Random(2), 1_000_000
    crashes = [(rng.choice("pqr"), rng.choice([rng.randrange(0, 900 * micros), rng.randrange(0, 900) * micros])) for _ in range(240)]
    crashes += [("burst", s * micros) for s in (5, 20, 40, 64)] + [("edge", s * micros) for s in (0, 1, 2, 60)] + [("near", s * micros) for s in (0, 1, 2, 59)]
    want = {(k, t + 1_700_000_000 * micros, n) for k, t, n in trips(crashes, 3, 60 * micros)}
    assert {k for k, *_ in want} >= {"burst", "near"} and "edge" not in {k for k, *_ in want}
    crashes = sorted(((k, t + 1_700_000_000 * micros) for k, t in crashes), key=lambda x: x[1])
    for n in range(4):  # each file holds a quarter, in any order, and the next one goes back by up to a minute
        part = crashes[n * len(crashes) // 4 : (n + 1) * len(crashes) // 4] + [("end", 1_700_010_000 * micros)] * (n == 3)
        rng.shuffle(part)
        spark.createDataFrame(part, "key string, us long").select("key", F.timestamp_micros("us").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream = feeds.breaker(source, late="20 minutes").select("key", F.unix_micros("ts").alias("us"), "n")
    feeds.appended(stream, f"{tmp_path}/out", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert len(got) == len(set(got))
    assert sorted(set(got) - want) == sorted(want - set(got)) == []
    whole = spark.createDataFrame(crashes, "key string, us long").select("key", F.timestamp_micros("us").alias("ts"))
    assert {(r.key, r.us, r.n) for r in feeds.tripped(whole).select("key", F.unix_micros("ts").alias("us"), "n").collect()} == want


def test_changed_files(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "path string, hash string")
    prior = spark.createDataFrame([("a", "1"), ("b", "0"), ("c", None)], "path string, hash string")
    assert sorted(r.path for r in feeds.changed_files(files, prior).collect()) == ["b", "c"]


class Lists:
    """The lists of a state, and its timers, in memory."""

    def __init__(self):
        self.lists, self.timers = {}, []

    def getListState(self, name, schema):  # noqa: N802
        held = self.lists.setdefault(name, [])

        class State:
            get = staticmethod(lambda: iter(list(held)))
            appendList = staticmethod(held.extend)  # noqa: N815
            clear = staticmethod(held.clear)
            put = staticmethod(lambda rows: held.__setitem__(slice(None), rows))

        return State

    def registerTimer(self, ms):  # noqa: N802
        self.timers.append(ms)


def test_breaker_of_a_full_window(spark):
    import time
    from types import SimpleNamespace

    handle, n = Lists(), 60_000
    state = feeds.Rolling(3, 10**9)
    state.init(handle)
    at = [i * 1000 + i % 2 * 1000 for i in range(n)]
    began = time.perf_counter()
    state.handleInputRows(("k",), [{"at": x} for x in reversed(at)], None)
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: n - 2, getExpiryTimeInMs=lambda: 1)
    out = list(state.handleExpiredTimer(("k",), clock, clock))
    assert time.perf_counter() - began < 15  # each failure once against all of the window takes minutes
    for r in (out[0], out[7000], out[-1]):
        assert r.n == sum(x <= r.at for x in at)
    assert len(out) == len({x for x in at if x < (n - 2) * 1000 and sum(y <= x for y in at[:8]) > 3})


def test_breaker_keeps_two_slices_of_a_key():
    from types import SimpleNamespace

    width, found, most = 1_000_000, [], 0
    at = [i * 1000 for i in range(-5000, 5000)]
    for part in range(-6, 7):
        handle = Lists()
        state = feeds.Rolling(3, width)
        state.init(handle)
        rows = [{"at": x} for x in at if x // width in (part - 1, part)]
        if rows:
            state.handleInputRows(("k", part), rows, None)
            most = max(most, len(handle.lists["waiting"]))
            for ms in (part * 1000 + 500, (part + 2) * 1000):
                clock = SimpleNamespace(getCurrentWatermarkInMs=lambda ms=ms: ms, getExpiryTimeInMs=lambda ms=ms: ms)
                found += [("k", r.at, r.n) for r in state.handleExpiredTimer(("k", part), clock, clock)]
            assert not any(handle.lists.values())  # the slice's end has passed
    want = {("k", x, min(1000, i + 1)) for i, x in enumerate(at) if i >= 3}
    assert most == 2000 and len(found) == len(want) and set(found) == want


def test_stale_counts_in_nearest_seconds(spark):
    rows = spark.sql("SELECT id AS run_id, timestamp_micros(us) AS ts FROM VALUES ('a', 100600000L), ('b', 131400000L), ('c', 101400000L) AS t(id, us)")
    now = rows.selectExpr("max(ts) AS now")
    found = {r.run_id: r.stale_for_status for r in feeds.stale(rows, now).collect()}
    assert found == {"a": False, "b": False, "c": False}
    late = spark.sql("SELECT 'a' AS run_id, timestamp_micros(100400000L) AS ts")
    assert [r.stale_for_status for r in feeds.stale(late, spark.sql("SELECT timestamp_micros(130600000L) AS now")).collect()] == [True]
