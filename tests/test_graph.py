"""Graph operators on small graphs with hand-made results, and the catalogue against DuckDB."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from graphquarry.functions import expr as X
from graphquarry.operators import components, graph, guidance, identity, lifecycle, lookup, search, secrets, traverse
from pyspark.sql import functions as F

ENTITY = "id string, plugin_id string, kind string, name string, short_name string, parent_id string, source_file_path string, source_line_start long, source_line_end long, content_hash string, properties string, summary string"
EDGE = "kind string, from_id string, to_id string, confidence string, properties string, source_byte_start long"


def entities(spark, *rows):
    base = {"plugin_id": "py", "kind": "function", "name": None, "short_name": None, "parent_id": None, "source_file_path": "a.py", "source_line_start": None, "source_line_end": None, "content_hash": "h", "properties": "{}", "summary": None}
    names = [x.split()[0] for x in ENTITY.split(", ")]
    return spark.createDataFrame([tuple((base | {"id": i} | extra)[n] for n in names) for i, extra in rows], ENTITY)


def edges(spark, *rows):
    full = [(k, a, b, *(rest + ("resolved", None, 0)[len(rest) :])) for k, a, b, *rest in [(*r[:3], *r[3:]) for r in rows] for rest in [tuple(rest)]]
    return spark.createDataFrame(full, EDGE)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("glob, path, ok", [("src/auth/**", "src/auth/t/r.py", True), ("src/auth/**", "src/auth", True), ("**/r.py", "r.py", True), ("**/r.py", "a/b/r.py", True), ("src/*.py", "src/a/m.py", False), ("src/v?.py", "src/v10.py", False), ("src/v?.py", "src/v1.py", True), ("a/**/b", "a/b", True), ("a.c", "abc", False), ("**", "x/y", True)])
def test_glob(glob, path, ok):
    assert bool(re.match(X.glob_regex(glob), "/" + path)) == ok


def test_ambiguous_calls_expand_and_coupling_does_not(spark):
    e = edges(spark, ("calls", "a", "b", "ambiguous", '{"candidates":["c","b"]}'), ("calls", "d", "b"), ("calls", "d", "x", "inferred"))
    target = spark.createDataFrame([("c",), ("b",)], "id string")
    assert rows(graph.callers(e, target, "ambiguous").select("to_id", "from_id", "pass")) == [("b", "a", 0), ("b", "d", 0), ("c", "a", 1)]
    assert rows(graph.callers(e, target).select("to_id", "from_id")) == [("b", "d")]
    assert rows(graph.coupling(e, "inferred")) == [("a", 0, 1, 1), ("b", 2, 0, 2), ("d", 0, 2, 2), ("x", 1, 0, 1)]


def test_decorates_candidates_are_turned(spark):
    e = edges(spark, ("decorates", "a", "b", "ambiguous", '{"candidates":["c"]}'), ("inherits_from", "k", "l", "ambiguous", '{"candidates":["m"]}'))
    out = {(r.id, r.neighbour) for r in graph.relations(e).where("direction = 'out'").collect()}
    assert out == {("a", "b"), ("c", "b"), ("k", "l"), ("k", "m")}


def test_runtime_imports(spark):
    props = [None, "not json", '{"type_only":true}', '{"type_only":1}', '{"scope":"function"}', '{"type_only":false,"scope":"module"}']
    df = spark.createDataFrame([(i, p) for i, p in enumerate(props)], "i int, properties string")
    assert [r.i for r in df.where(X.runtime_import(F.col("properties"))).orderBy("i").collect()] == [0, 1, 5]


def test_cycles(spark):
    pairs = [("a", "b"), ("b", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("b", "c"), ("s", "s"), ("x", "y"), ("p", "p"), ("p", "q"), ("q", "p")]
    got = traverse.cycles(spark.createDataFrame(pairs, "from_id string, to_id string"))
    assert rows(got) == [("a", "a"), ("a", "b"), ("c", "c"), ("c", "d"), ("c", "e"), ("p", "p"), ("p", "q"), ("s", "s")]


def test_components(spark):
    pairs = [("a", "b"), ("c", "b"), ("d", "e"), ("f", "f"), (None, "a")] + [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)]
    got = dict(rows(components.connected_components(spark.createDataFrame(pairs, "x string, y string"), "x", "y")))
    assert got["c"] == "a" and got["e"] == "d" and got["f"] == "f" and got["n040"] == "n000"


def test_execution_paths_are_simple(spark):
    calls = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d")], "from_id string, to_id string")
    got = traverse.execution_paths(calls, spark.createDataFrame([("a",)], "id string"), 3)
    assert sorted(r.path for r in got.collect()) == [["a", "b"], ["a", "b", "c"], ["a", "b", "d"]]


def test_dead_code_order_of_filters(spark):
    blocked = {"properties": '{"briefing_blocked":"x"}'}
    e = entities(spark, ("root", {}), ("used", {}), ("dead", {"short_name": "dead"}), ("hook", {}), ("shy", {"short_name": "shy"}), ("kept", blocked), ("mod", {"kind": "module"}), ("other", {"plugin_id": "rs"}))
    tags = spark.createDataFrame([("root", "py", "entry-point"), ("hook", "py", "plugin-hook")], "entity_id string, plugin_id string, tag string")
    got = traverse.dead_code(e, edges(spark, ("calls", "root", "used", "inferred")), tags, spark.createDataFrame([("shy",)], "id string"))
    assert {r.id: r.outcome for r in got.collect()} == {"dead": "dead", "shy": "shielded", "kept": "blocked", "other": "no_roots"}
    assert traverse.dead_code(e, edges(spark, ("calls", "root", "used")), tags.limit(0), e.select("id")).count() == 0


def test_entity_at_line_prefers_innermost(spark):
    e = entities(spark, ("m", {"kind": "module", "source_line_start": 1, "source_line_end": 50}), ("c", {"kind": "class", "source_line_start": 5, "source_line_end": 9}), ("f", {"source_line_start": 5, "source_line_end": 9}))
    asked = spark.createDataFrame([("a.py", 6), ("a.py", 20), ("b.py", 1)], "source_file_path string, line long")
    assert rows(lookup.at_line(e, asked).select("line", "id")) == [(6, "f"), (20, "m")]


def test_entity_at_line_meets_few(spark):
    """Nested spans of all lengths, and a hot file: a line meets a few entities of it, not all."""
    spans = [("hot.py", 3 * i, 3 * i + 1) for i in range(3000)] + [("hot.py", -5, 10**9), ("hot.py", 0, 2**62), ("hot.py", 15, 16), ("hot.py", 9, 8)] + [("n.py", 1000 - k, 1000 + k * k) for k in range(40)]
    e = entities(spark, *((f"e{i}", {"source_file_path": p, "source_line_start": a, "source_line_end": z}) for i, (p, a, z) in enumerate(spans)))
    asked = [("hot.py", x) for x in range(-7, 9010)] + [("n.py", x) for x in range(900, 3000, 7)]
    want = []
    for p, x in asked:
        inside = [(z - a, f"e{i}") for i, (q, a, z) in enumerate(spans) if q == p and a <= x <= z]
        want += [(p, x, min(inside)[1], min(inside)[0])] if inside else []
    lines = spark.createDataFrame(asked, "source_file_path string, line int")
    assert rows(lookup.at_line(e, lines)) == sorted(want)
    assert lookup.meeting(e, lines).where("source_file_path = 'hot.py'").count() < 10 * len(asked)


def test_entity_at_every_line(spark, data):
    from graphquarry.sources.fixtures import Tables

    every, want = Tables(spark, data).entities.collect(), []
    files = {}
    for r in every:
        files.setdefault(r.source_file_path, []).append(r)
    for p, x in {(r.source_file_path, r.source_line_start + 3) for r in every if r.kind == "function"}:
        inside = [(r.source_line_end - r.source_line_start, {"function": 0, "class": 1, "module": 2}.get(r.kind, 3), r.id) for r in files[p] if r.source_line_start <= x <= r.source_line_end]
        want += [(p, x, min(inside)[2], min(inside)[0])] if inside else []
    assert rows(entry.queries()["jon12_entity_at_line"](spark, data)) == sorted(want)


def test_identities(spark):
    alive = spark.createDataFrame([("s1", "a", "h1", "g1"), ("s2", "b", "h2", "g2"), ("s3", "c", None, None), ("s4", "d", "h4", "g4"), ("s5", "e", "h4", "g4")], "sei string, locator string, body_hash string, signature string")
    now = spark.createDataFrame([("a", "x", "y"), ("b2", "h2", "g2"), ("c2", None, None), ("d2", "h4", "g4")], "locator string, body_hash string, signature string")
    renames = spark.createDataFrame([("c", "c2")], "old_locator string, new_locator string")
    got = {r.locator: (r.event, r.sei) for r in identity.match_identities(alive, now, renames, "r").collect()}
    assert got["a"] == ("carried", "s1") and got["b2"] == ("moved", "s2") and got["c2"] == ("locator_changed", "s3")
    assert got["d2"][0] == "born"  # two vanished ones fit
    assert {r.sei for r in identity.orphans(alive, identity.match_identities(alive, now, renames, "r")).collect()} == {"s4", "s5"}


def test_call_sites_have_no_cap(spark):
    from graphquarry.operators import orientation

    edges = spark.range(10_050).selectExpr("'calls' kind", "concat('c', id) from_id", "'lib:function:p5' to_id", "'resolved' confidence", "cast(null as string) properties", "id source_byte_start")
    callers = spark.range(10_050).selectExpr("concat('c', id) id", "'a.py' source_file_path", "'n' name", "'n' short_name", "'h' content_hash")
    callers = callers.unionByName(spark.createDataFrame([("lib:function:p5", "b.py", "p5", "p5", "h")], "id string, source_file_path string, name string, short_name string, content_hash string"))
    sites = spark.createDataFrame([("c1", "h", "k1", 1, "x.p5", 7), ("c2", "old", "k2", 1, "p5", 8)], "caller_entity_id string, caller_content_hash string, site_key string, site_ordinal long, callee_expr string, source_byte_start long")
    subject = spark.createDataFrame([("lib:function:p5",)], "id string")
    every = orientation.call_sites(edges, sites, callers, subject, "callee")
    assert every.where("bound").count() == 10_050 and [r.text for r in every.where("not bound").collect()] == ["x.p5"]
    assert orientation.call_sites(edges, sites, callers, subject, "callee", cap=200).where("bound").count() == 200


def test_upserts(spark):
    old = spark.createDataFrame([("f1", "open", "old"), ("f2", "acknowledged", "old")], "id string, status string, message string")
    new = spark.createDataFrame([("f2", "open", "new"), ("f3", "open", "new")], "id string, status string, message string")
    assert rows(lifecycle.upsert_findings(old, new)) == [("f1", "open", "old"), ("f2", "acknowledged", "new"), ("f3", "open", "new")]


def test_collisions(spark):
    now = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), ("c", "z"), ("d", "x")], "id string, path string")
    prior = spark.createDataFrame([("c", "w"), ("d", "x")], "id string, path string")
    assert {r.id: r["shape"] for r in lifecycle.collisions(now, prior).collect()} == {"a": "same_file", "b": "cross_file", "c": "cross_run"}


def test_guidance(spark):
    sheet = "id string, expires string, match_rules array<struct<type:string,pattern:string,value:string,id:string>>, content string, scope_rank int, authored_at string"
    sheets = spark.createDataFrame([("g1", None, [("path", "src/**", None, None), ("kind", None, "class", None)], "one", 1, None), ("g2", "2020-01-01T00:00:00Z", [("kind", None, "class", None)], "two", 2, None), ("g3", None, [("tag", None, "t", None), ("group", None, "z", None)], "three", 3, None)], sheet)
    facts = spark.createDataFrame([("e1", "class", "src/a/b.py", ["t", "u"], None), ("e2", "function", "lib/x.py", [], None)], "entity_id string, kind string, path string, tags array<string>, subsystem string")
    guides = spark.createDataFrame([("g3", "e2")], "sheet string, entity_id string")
    got = guidance.matching(sheets, facts, guides, "2024-01-01T00:00:00Z")
    assert {(r.entity_id, r.sheet): r.matched_by for r in got.collect()} == {("e1", "g1"): ["kind", "path"], ("e1", "g3"): ["tag"], ("e2", "g3"): ["guides"]}
    assert guidance.composed(got, sheets).where("entity_id = 'e1'").collect()[0].text == "one\n\nthree"


def test_secrets(spark):
    text = "key = AKIA" + "ABCDEFGHIJKLMNOP\n# password = 'notasecret1'\n\npassword = 'realsecret99'\nblob " + "0123456789abcdef" * 3 + "\nghp_" + "a1" * 18
    found = secrets.scan(spark.createDataFrame([("f", text), ("g", "nothing here"), ("h", None)], "path string, content string")).collect()
    assert [(r.rule_id, r.line) for r in sorted(found, key=lambda r: r.byte_offset)] == [("AwsAccessKeyId", 1), ("ContextualCredential", 4), ("HighEntropyHex", 5), ("GitHubPat", 6)]


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("rational", "ration"), ("electrical", "electr"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("sky", "sky")])
def test_stem(word, want):
    assert search.stem(word) == want


def test_search_folds_ascii_only_and_escapes(spark):
    e = entities(spark, ("x:f:Über_100%", {"name": "Über_100%"}), ("x:f:other", {"name": "uber1000"}))
    assert [r.id for r in search.containing(e, "BER_100%").collect()] == ["x:f:Über_100%"]
    assert search.containing(e, "über").count() == 0


def value(v):
    return round(v, 6) if isinstance(v, float) else v


SMALL = ["agg04_coupling", "agg05_module_dependencies", "grf11_subsystem_of", "grf18_circular_imports", "grf20_dead_code", "sei03_match", "jon12_entity_at_line", "snk07_inferred_edges"]


def equals_duckdb(spark, data, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents"):
        con.sql(f"CREATE VIEW {t} AS FROM '{data}/{t}.parquet'")
    df, want = entry.queries()[name](spark, data), con.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()), key=repr)
    return df


def test_incremental_takes_all_documents(spark, data):
    assert equals_duckdb(spark, data, "lif09_incremental").count() == spark.read.parquet(f"{data}/documents.parquet").count()


@pytest.mark.parametrize("name, end", [("grf01_callers", "to_id"), ("grf02_callees", "from_id")])
def test_calls_of_all_entities(spark, data, name, end):
    from graphquarry.sources.fixtures import Tables

    got = {r[end] for r in equals_duckdb(spark, data, name).select(end).distinct().collect()}
    t = Tables(spark, data)
    ids = {r.id for r in t.entities.select("id").collect()}
    calls = {r[end] for r in t.edges.where("kind = 'calls' and confidence in ('resolved', 'ambiguous')").select(end).collect()}
    assert calls & ids <= got <= ids


@pytest.mark.parametrize("name", SMALL)
def test_catalogue_equals_duckdb(spark, data, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS FROM '{data}/{t}.parquet'")
    df = entry.queries()[name](spark, data)
    columns = sorted(df.columns)
    want = con.sql(entry.oracle_sql()[name])
    got = sorted((tuple(value(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert columns == sorted(want.columns)
    assert got == sorted((tuple(value(r[want.columns.index(c)]) for c in columns) for r in want.fetchall()), key=repr)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_edges_filtered_away_are_not_made(spark, data):
    from graphquarry.sources.fixtures import VIEWS, Tables

    t = Tables(spark, data)
    for kinds in ("kind = 'calls'", "kind in ('contains', 'imports')"):
        plan = t.edges.where(kinds)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Union" not in plan
    whole = t.bound(VIEWS["edges"])
    assert t.edges.columns == whole.columns and t.edges.where("kind = 'inherits_from'").count() > 0
    assert t.edges.exceptAll(whole).isEmpty() and whole.exceptAll(t.edges).isEmpty()


def test_only_the_kinds_that_are_read_are_stored(spark, tmp_path):
    """A query over imports, containment or calls stores none of the other kinds."""
    import shutil

    from graphquarry.plans import catalog, catalog_store  # noqa: F401  the latter adds to the catalogue
    from graphquarry.sources import fixtures

    folder = str(tmp_path / "copy")
    shutil.copytree("/root/testdata/sf0.001", folder)
    kinds = lambda: {k[2][6:] for k in fixtures._folders if k[1] == folder and k[2].startswith("edges/")}
    for name, want in (("flt17_runtime_imports", {"imports"}), ("flt13_scope_membership", {"imports", "contains"}), ("jon19_test_callers", {"imports", "contains", "calls"})):
        catalog.QUERIES[name](spark, folder).count()
        assert kinds() == want, name


def test_relations_read_edges_once(spark):
    rows = [("inherits_from", "a", "b", "ambiguous", '{"candidates":["b","c"]}'), ("inherits_from", "a", "c", "ambiguous", None), ("decorates", "d", "e", "ambiguous", '{"candidates":["f"]}'), ("derives", "a", "b", "resolved", '{"candidates":["z"]}')]
    e = edges(spark, *rows, *rows[:1])
    found = graph.relations(e)
    got = sorted((r.id, r.neighbour, r.kind, r.direction, r.confidence) for r in found.collect())
    pairs = [("a", "b", "inherits_from", "ambiguous"), ("a", "c", "inherits_from", "ambiguous"), ("d", "e", "decorates", "ambiguous"), ("f", "e", "decorates", "ambiguous"), ("a", "b", "derives", "resolved")]
    assert got == sorted([(a, b, k, "out", c) for a, b, k, c in pairs] + [(b, a, k, "in", c) for a, b, k, c in pairs])
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_looked_up_in_sizes_that_spans_have(spark):
    from graphquarry.operators import lookup

    e = spark.createDataFrame([("f", "a", "function", 10, 18), ("f", "m", "module", 1, 100000)], "source_file_path string, id string, kind string, source_line_start long, source_line_end long")
    met = lookup.meeting(e, spark.range(1, 50).select(F.lit("f").alias("source_file_path"), F.col("id").alias("line")))
    assert "LeftSemi" in met._jdf.queryExecution().optimizedPlan().toString()
    assert {r.line for r in met.where("id = 'm'").collect()} == set(range(1, 50)) and {r.line for r in met.where("id = 'a'").collect()} >= set(range(10, 19))


def test_edges_to_no_module_end_at_the_first_join(spark, monkeypatch):
    e = edges(spark, ("contains", "r", "m", "resolved", None), ("contains", "r", "n", "resolved", None), ("contains", "m", "f", "resolved", None), ("contains", "n", "g", "resolved", None), ("calls", "f", "lib", "resolved", None), ("calls", "f", "g", "ambiguous", '{"candidates":["lib","n"]}'), ("references", "g", "f", "resolved", None), ("calls", "f", "g", "inferred", None))
    ids = spark.createDataFrame([("r", "module"), ("m", "module"), ("n", "module"), ("f", "function"), ("g", "function"), ("lib", "function")], "id string, kind string")
    kept, original = [], graph.written
    monkeypatch.setattr(graph, "written", lambda rows: kept.append(original(rows)) or kept[-1])
    found = graph.module_dependencies_by_home(e, traverse.homes(e, ids), lambda of: traverse.module_ancestors(e, ids, of=of))
    got = sorted((r.from_module, r.to_module, r.reference_count, r.kinds) for r in found.collect())
    plain = graph.module_dependencies(e, traverse.module_ancestors(e, ids))
    assert got == sorted((r.from_module, r.to_module, r.reference_count, r.kinds) for r in plain.collect()) and ("m", "n", 2, ["calls"]) in got
    ends = [r[c] for rows in kept for c in rows.columns if c.startswith("to_") for r in rows.collect()]
    assert ends and "lib" not in ends


def test_grouped_edges_are_not_dealt_again(spark, data):
    """Calls and references are grouped where their join on the order's key has them."""
    from graphquarry.sources.fixtures import Tables, branches

    t = Tables(spark, data)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")
    try:
        for kind in ("calls", "references"):
            parts = [s for s in branches("edges") if s.startswith(f"SELECT '{kind}', oid")]
            plan = t.kind_of(kind, parts)._jdf.queryExecution().sparkPlan().toString() + t.kind_of(kind, parts)._jdf.queryExecution().executedPlan().toString()
            assert len(parts) == 1 and "hashpartitioning(ok" in plan.replace("l_orderkey", "ok") and "hashpartitioning(oid" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
