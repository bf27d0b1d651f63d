"""Context, neighbourhoods, runs, caches, sheets, paths, secrets, snapshots and communities on small cases."""

import hashlib
import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from graphquarry.functions import expr as X
from graphquarry.operators import cluster, graph, identity, lifecycle, orientation, secrets, store, traverse
from graphquarry.sources import tree

ENTITY = "id string, plugin_id string, kind string, name string, short_name string, parent_id string, source_file_path string, source_line_start long, source_line_end long, content_hash string, properties string, summary string, signature string"


def entities(spark, *rows):
    """(id, kind, parent, first line, last line, properties)."""
    full = [(i, "py", k, i.split(":")[-1], i.split(":")[-1].split(".")[-1], p, "a.py", a, b, "h", x, None, None) for i, k, p, a, b, x in rows]
    return spark.createDataFrame(full, ENTITY)


def test_context_of_lines(spark):
    span = {"definition": {"decorator_line_start": 10, "decl_line": 12, "body_line_start": 14}}
    e = entities(spark, ("py:module:m", "module", None, 1, 100, "{}"), ("py:class:m.C", "class", "py:module:m", 5, 60, '{"definition":{"decl_line":5}}'), ("py:function:m.C.f", "function", "py:class:m.C", 10, 20, json.dumps(span)), ("py:function:m.C.g", "function", "py:class:m.C", 10, 20, "not json"))
    edges = spark.createDataFrame([("contains", "py:module:m", "py:class:m.C"), ("contains", "py:class:m.C", "py:function:m.C.f"), ("contains", "py:class:m.C", "py:function:m.C.g")], "kind string, from_id string, to_id string")
    asked = spark.createDataFrame([("a.py", n) for n in (3, 5, 7, 10, 11, 12, 13, 14, 20, 21, 500)], "source_file_path string, line long")
    got = {r.line: r for r in orientation.entity_context(e, edges, asked).collect()}
    assert {n: r.match_reason for n, r in got.items()} == {3: "containing_range", 5: "declaration", 7: "containing_range", 10: "decorator_range", 11: "decorator_range", 12: "declaration", 13: "declaration", 14: "body_range", 20: "body_range", 21: "containing_range", 500: "no_match"}
    assert got[12].containing_stack == ["py:module:m", "py:class:m.C", "py:function:m.C.f"] and got[12].alternatives == ["py:function:m.C.g"]
    assert got[500].id is None and got[500].containing_stack == [] and got[5].alternatives == []


def test_neighbourhood_rolls_up_and_truncates(spark):
    e = entities(spark, ("py:module:m", "module", None, 1, 9, "{}"), *((f"py:function:m.f{i}", "function", "py:module:m", 1, 2, "{}") for i in range(4)), ("py:function:o.x", "function", None, 1, 2, "{}"), ("py:class:o.B", "class", None, 1, 2, '{"briefing_blocked":"secret_present"}'))
    rows = [("contains", "py:module:m", f"py:function:m.f{i}", "resolved", None, None) for i in range(4)]
    rows += [("references", f"py:function:m.f{i}", "py:function:o.x", "resolved", None, i) for i in range(2)] + [("references", "py:function:m.f0", "py:function:m.f1", "resolved", None, 5), ("calls", "py:function:o.x", "py:function:m.f0", "resolved", None, 6)]
    edges = spark.createDataFrame(rows, "kind string, from_id string, to_id string, confidence string, properties string, source_byte_start long")
    got = {(r.subject, r.bucket, r.neighbour): (r.total, r.truncated) for r in orientation.neighbourhood(edges, e, e, 3).collect()}
    assert got["py:module:m", "references_out", "py:function:o.x"] == (1, False)
    assert ("py:module:m", "references_out", "py:function:m.f1") not in got and ("py:module:m", "references_in", "py:function:m.f0") not in got
    assert got["py:function:m.f0", "references_out", "py:function:m.f1"] == (2, False) and got["py:function:m.f0", "container", "py:module:m"] == (1, False)
    assert sorted(k[2] for k in got if k[:2] == ("py:module:m", "contained")) == [f"py:function:m.f{i}" for i in range(3)] and got["py:module:m", "contained", "py:function:m.f0"] == (4, True)
    assert not any(k[0] == "py:class:o.B" for k in got)


def test_byte_positions(spark):
    text = "eins\nzwei é\n\n日本\nend"
    raw = text.encode()
    spots = spark.createDataFrame([("f", n) for n in [*range(len(raw) + 1), len(raw) + 1, -1]], "path string, source_byte_start long")
    got = {r.source_byte_start: (r.line, r.column) for r in graph.byte_positions(spots, spark.createDataFrame([("f", text)], "path string, content string")).collect()}
    for n in range(len(raw) + 1):
        head = raw[:n]
        assert got[n] == (head.count(b"\n") + 1, n - (head.rfind(b"\n") + 1))
    assert got[len(raw) + 1] == got[-1] == (None, None)


def test_run_states(spark):
    log = [("a", "begin beat complete fail"), ("b", "begin cancel beat resume beat"), ("c", "begin lost"), ("d", "resume beat"), ("e", "begin complete resume"), ("f", "begin skip"), ("g", "begin fail cancel")]
    rows = [(run, i, action, f"t{i}", "why" if action == "fail" else None) for run, actions in log for i, action in enumerate(actions.split())]
    got = {r.id: (r.status, r.reason, r.heartbeat_at) for r in store.run_states(spark.createDataFrame(rows, "run_id string, seq int, action string, at string, reason string")).collect()}
    assert got == {"a": ("completed", None, "t1"), "b": ("running", None, "t4"), "c": ("failed", "channel closed", "t0"), "e": ("completed", None, "t0"), "f": ("skipped_no_plugins", None, "t0"), "g": ("failed", "why", "t0")}
    assert store.may_sweep("completed", False, 0, True) and not any(store.may_sweep(*x) for x in (("failed", False, 0, True), ("completed", True, 0, True), ("completed", False, 1, True), ("completed", False, 0, False)))


def test_guidance_inserts_fail_on_duplicates(spark):
    old, new = (spark.createDataFrame(rows, "id string, content string") for rows in ([("a", "x")], [("b", "y"), ("a", "z")]))
    assert store.insert_sheets(old, new.where("id = 'b'")).count() == 2
    with pytest.raises(PySparkException):
        store.insert_sheets(old, new).collect()


def test_paths_stay_below_the_root(spark):
    cases = {"a/b.py": "a/b.py", "./a//b.py": "a/b.py", "a/../b": "b", "..": None, "../root/x": "x", "../roots/x": None, "/w/root/x": "x", "/w/root": "", "/w/rootx": None, "/etc/passwd": None, "a/../../..": None, "": ""}
    rows = spark.createDataFrame([(p,) for p in cases], "path string")
    assert {r.path: r.rel for r in rows.select("path", store.inside("/w/root/", F.col("path")).alias("rel")).collect()} == cases


def test_store_versions_and_cursors(spark):
    assert store.checked_version(None) == store.checked_version(1)
    with pytest.raises(ValueError):
        store.checked_version(99)
    rows = spark.range(7).select(F.col("id"))
    pages, cursor = [], 0
    while cursor is not None:
        page = store.cursor_page(rows, [F.col("id")], 3, cursor).collect()
        pages.append([r.id for r in page])
        cursor = page[0].next_cursor if page else None
    assert pages == [[0, 1, 2], [3, 4, 5], [6]]


def plain_entropy(text):
    import math
    from collections import Counter

    raw = text.encode()
    return -sum(c / len(raw) * math.log2(c / len(raw)) for c in Counter(raw).values()) if raw else 0.0


def test_entropy_counts_bytes(spark):
    texts = ["", "a", "aab", "é", "日本語 text", "Xq7Zk2Lm9Pw4Rt8Vb3Nc6Jd1", "x" * 5000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.entropy(F.col("t")).alias("e")).collect()
    assert {r.t: r.e for r in got} == pytest.approx({t: plain_entropy(t) for t in texts})


def test_facets_of_any_text(spark):
    rows = spark.createDataFrame([('{"a":"[x","b":["x"],"c":{"d":1},"e":1,"f":true,"g":null,"h":"{"}',), ("no json",), (None,)], "j string")
    got = rows.select(*(X.scalar_facet(F.col("j"), c).alias(c) for c in "abcefgh")).collect()
    assert tuple(got[0]) == ("[x", None, None, "1", "true", None, "{") and tuple(got[1]) == tuple(got[2]) == (None,) * 7


def rules(spark, *texts):
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, content string")
    out = {}
    for r in secrets.scan(rows).collect():
        data = texts[int(r.path)].encode()
        assert r.secret_hash == hashlib.sha1(data[r.byte_offset : r.byte_offset + r.length]).hexdigest()
        out.setdefault(int(r.path), []).append((r.rule_id, data[r.byte_offset : r.byte_offset + r.length].decode()))
    return [sorted(out.get(i, [])) for i in range(len(texts))]


def test_random_strings_and_their_borders(spark):
    body, digits = "Zx81QwErTy7UiOp9LkJh4GfDs2Aa", "0123456789abcdef0123456789abcdef01234567"
    got = rules(spark, f"sha={digits}", f"blob={body}", f"blob {body}== end", f"{body}===", f"-{body}-", f"x{digits}", f"{digits} and {digits}z", "a" * 60, f"token: '{body}'")
    assert got[0] == [("HighEntropyHex", digits)]
    assert got[1] == [] and got[2] == [("HighEntropyBase64", body + "==")] and got[3] == []
    assert got[4] == [("HighEntropyBase64", body)] and got[5] == [] and got[6] == [("HighEntropyHex", digits)] and got[7] == []
    assert got[8] == [("ContextualCredential", body)]  # a named hit hides the random one


def test_baselines(spark):
    good = {"type": "GitHub Token", "hashed_secret": "a" * 40, "line_number": 3, "justification": "sample"}
    log = lambda results, version="1.0": (json.dumps({"version": version, "results": results}),)
    files = [log({"./x.py": [good, good | {"is_secret": True, "line_number": 4}]}), log({"y.py": [good | {"justification": " "}, good | {"hashed_secret": "zz"}, good | {"type": "Other"}], "../up": [good]}), log({"z.py": [good]}, "2.0"), ("not json",)]
    base, refused = secrets.baseline(spark.createDataFrame(files, "json string"))
    assert sorted((r.path, r.line, r.rule_id, r.is_secret) for r in base.collect()) == [("x.py", 3, "GitHubPat", False), ("x.py", 4, "GitHubPat", True)]
    assert sorted((r.path, r.problem) for r in refused.collect()) == [("../up", "path"), ("y.py", "hash"), ("y.py", "justification"), ("y.py", "type"), ("z.py", "version")]


def test_last_descriptor_and_first_fitting_rename_count(spark):
    alive = spark.createDataFrame([("s1", "old1", "h1", "g"), ("s2", "old2", "h2", "g")], "sei string, locator string, body_hash string, signature string")
    now = spark.createDataFrame([("new", "h1", "x", 2), ("new", "h9", "x", 1)], "locator string, body_hash string, signature string, seq int")
    renames = spark.createDataFrame([("old0", "new", 0), ("old2", "new", 1), ("old1", "new", 2)], "old_locator string, new_locator string, seq int")
    got = identity.match_identities(alive, now, renames, "r").collect()
    assert [(r.locator, r.sei, r.event) for r in got] == [("new", "s1", "locator_changed")]


def test_kept_columns_stay_null(spark):
    old = spark.createDataFrame([("a", None, "m1")], "id string, issue_id string, message string")
    new = spark.createDataFrame([("a", "X", "m2"), ("b", "Y", "m3")], "id string, issue_id string, message string")
    assert sorted(map(tuple, lifecycle.upsert_findings(old, new).collect())) == [("a", None, "m2"), ("b", "Y", "m3")]


def test_readers_always_find_a_version(spark, tmp_path):
    for n in (1, 2, 3):
        tree.write_snapshot({"t": spark.createDataFrame([(n,)], "n int")}, str(tmp_path), f"v{n}")
        assert tree.read_snapshot(spark, str(tmp_path), "t").first().n == n
    assert tree.read_snapshot(spark, str(tmp_path), "t", "v1").first().n == 1


def cliques(k, size):
    """k cliques in a ring, one edge between each and the next."""
    rows = [(f"c{c}.n{i}", f"c{c}.n{j}", 1) for c in range(k) for i in range(size) for j in range(i)]
    return rows + [(f"c{c}.n0", f"c{(c + 1) % k}.n1", 1) for c in range(k)]


def test_communities_of_cliques(spark):
    g = spark.createDataFrame(cliques(6, 5), "from_id string, to_id string, reference_count long")
    got = {}
    for r in cluster.communities(g).collect():
        got.setdefault(r.community, set()).add(r.id)
    assert sorted(map(sorted, got.values())) == [sorted(f"c{c}.n{i}" for i in range(5)) for c in range(6)]
    made, weak = cluster.materialised(g)
    assert sorted(r.name for r in made.collect()) == [f"Subsystem {r.id.split(':')[-1]}" for r in made.orderBy("name").collect()] or made.count() == 6
    assert weak.count() == 0


def newman(rows, group):
    """Modularity of the undirected graph."""
    total, degree, inner = sum(w for *_, w in rows), {}, 0
    for a, b, w in rows:
        inner += w * (group[a] == group[b])
        for x in (a, b):
            degree[group[x]] = degree.get(group[x], 0) + w
    return inner / total - sum((d / (2 * total)) ** 2 for d in degree.values())


def test_communities_do_not_lose_to_components(spark):
    rng = random.Random(4)
    rows = [(f"n{a:02}", f"n{b:02}", 5 if a // 8 == b // 8 else 1) for a in range(32) for b in range(a) if rng.random() < (0.7 if a // 8 == b // 8 else 0.05)]
    g = spark.createDataFrame(rows, "from_id string, to_id string, reference_count long")
    found = {r.id: r.community for r in cluster.communities(g).collect()}
    parts = {r.id: r.component for r in traverse.weighted_components(g).select(F.explode("members").alias("id"), "component").collect()}
    planted = {f"n{i:02}": i // 8 for i in range(32)}
    assert newman(rows, found) >= max(newman(rows, {i: parts.get(i, i) for i in found}), 0.95 * newman(rows, planted), 0.3)


def test_one_community_falls_back_to_components(spark):
    g = spark.createDataFrame([("a", "b", 9), ("b", "c", 9), ("a", "c", 9)], "from_id string, to_id string, reference_count long")
    made, weak = cluster.materialised(g)
    assert [r.members for r in made.collect()] == [["a", "b", "c"]] and weak.count() == 1
    none = g.limit(0)
    assert cluster.communities(none).count() == 0


def test_scratch_goes_when_a_caller_is_done(spark):
    from graphquarry.operators import components

    outer = components.written(spark.range(3))
    with components.scratch(spark):
        inner = components.written(spark.range(4))
        path = components._folders[-1]
        assert inner.count() == 4
    at, files = components.file_system(spark, path)
    assert not files.exists(at) and outer.count() == 3


def test_sites_are_counted_by_text(spark):
    e = entities(spark, *((f"py:function:m.f{i}", "function", None, 1, 2, "{}") for i in range(3)), ("py:function:m.g", "function", None, 1, 2, "{}"))
    rows = [("py:function:m.g", "h", f"k{i}", i, text, i) for i, text in enumerate(["f1", "x.f1", "A::f1", "f10", "m.f2", "f1"])] + [("py:function:m.g", "old", "k9", 9, "f1", 9)]
    sites = spark.createDataFrame(rows, "caller_entity_id string, caller_content_hash string, site_key string, site_ordinal long, callee_expr string, source_byte_start long")
    assert {r.to_id: r.n for r in graph.unresolved_counts(sites, e, e).collect()} == {"py:function:m.f1": 4, "py:function:m.f2": 1}
    assert graph.unresolved_callers(sites, e, e).count() == 5
    assert graph.sites_of(sites, e, "py:function:m.g").count() == 6 and graph.sites_of(sites, e, "py:function:m.g", 2).count() == 2


def test_equal_sites_count_each(spark):
    e = entities(spark, *((f"py:function:m.{x}", "function", None, 1, 2, "{}") for x in ("f1", "g")))
    rows = 3 * [("py:function:m.g", "h", "k", 0, "x.f1", 0)] + [("py:function:m.g", "h", "l", 1, "f1", 1)]
    sites = spark.createDataFrame(rows, "caller_entity_id string, caller_content_hash string, site_key string, site_ordinal long, callee_expr string, source_byte_start long")
    assert [tuple(r) for r in graph.unresolved_counts(sites, e, e).collect()] == [("py:function:m.f1", 4)]
    assert graph.unresolved_callers(sites, e, e).count() == 4
    pages = sorted((r["rank"], r.site_key, r.total) for r in graph.unresolved_pages(sites, e, e, 3).collect())
    assert pages == [(1, "k", 4), (2, "k", 4), (3, "k", 4)]


def test_first_edges_read_no_further_kinds(spark, monkeypatch):
    rows = [(k, f"n{i % 7}", f"m{i}", c, p) for i, (k, c, p) in enumerate((k, c, p) for k in ("zz", "calls", "contains", "between", "inherits_from", None) for c in ("resolved", "ambiguous") for p in (None, 3, 1))]
    edges = spark.createDataFrame(rows, "kind string, from_id string, to_id string, confidence string, source_byte_start long")
    plain = lambda n: edges.orderBy("kind", "from_id", "to_id", "confidence", F.coalesce("source_byte_start", F.lit(-1))).limit(n).collect()
    read = []
    monkeypatch.setattr(graph, "written", lambda x: read.append(x) or x)
    for n in (1, 7, 20, 36, 50):
        assert graph.first_edges(edges, n).collect() == plain(n)
    read.clear()
    assert graph.first_edges(edges, 14).count() == 14 and len(read) == 1  # null, between and calls come before any other span



def test_edges_are_not_sent_to_their_ends(spark):
    known = [("a",), ("b",), ("c",)]
    rows = [("calls", "a", "b"), ("calls", "a", "x"), ("calls", "x", "b"), ("calls", None, "b"), ("calls", "a", None), ("uses", "x", "y"), ("calls", "c", "c")]
    edges, entities = spark.createDataFrame(rows, "kind string, from_id string, to_id string"), spark.createDataFrame(known, "id string")
    ready, waiting = (lifecycle.ready_edges(edges, entities, x) for x in (True, False))
    names = {x for x, in known}
    assert sorted(map(tuple, ready.collect())) == sorted(r for r in rows if {*r[1:]} <= names)
    assert sorted(map(repr, map(tuple, waiting.collect()))) == sorted(repr(r) for r in rows if not {*r[1:]} <= names)
    for out in (ready, waiting):  # no shuffle and no sort of the edges where few ends are lost
        assert not {"Exchange hashpartitioning", "SortMergeJoin"} & {x for x in ("Exchange hashpartitioning", "SortMergeJoin") if x in out._jdf.queryExecution().executedPlan().toString()}


def test_buckets_that_are_not_asked_for_leave_relations_unread(spark, data):
    from graphquarry.operators import orientation
    from graphquarry.sources.fixtures import Tables

    t = Tables(spark, data)
    lib = t.entities.where("plugin_id = 'lib'")
    near = orientation.neighbourhood(t.edges, t.entities, lib, 10)
    callers = orientation.neighbourhood(t.edges, t.entities, lib, 10, buckets=("callers",))
    assert sorted(callers.collect()) == sorted(near.where("bucket = 'callers'").collect())
    assert "decorates" not in callers._jdf.queryExecution().optimizedPlan().toString()
    assert not callers.isEmpty() and {r.bucket for r in near.select("bucket").distinct().collect()} >= {"relations_in", "relations_out"}


def test_edges_stay_where_they_are_when_few_files_are_replaced(spark, tmp_path):
    from graphquarry.operators import lifecycle

    spark.range(1000).selectExpr("'calls' as kind", "cast(id as string) as from_id", "cast(id % 3 as string) as source_file_id").write.parquet(str(tmp_path / "e"))
    old = spark.read.parquet(str(tmp_path / "e"))
    new = spark.createDataFrame([("calls", "n", "0")], old.schema)
    out = lifecycle.replace_anchored_edges(old, new, new.select("source_file_id"))
    assert out.count() == 667 and "hashpartitioning(source_file_id" not in out._jdf.queryExecution().executedPlan().toString()
