"""Registered queries of sources, extraction, snapshots and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphquarry.operators.components import new_folder, written
from graphquarry.plans.catalog import query
from graphquarry.sources import python_code as P
from graphquarry.sources import rust_code as R
from graphquarry.sources import vocabulary as W
from graphquarry.sources import tree
from graphquarry.streaming import feeds

TABLES = ("benchmark", "conversations", "customer", "documents", "embeddings", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")


def folder_of(t) -> str:
    """A new folder below the checkpoint folder, which every machine reads."""
    return new_folder(t.spark, "query")


# --- trees and logs ----------------------------------------------------------------------------------


@query("src01_walk", "SELECT unnest([" + ", ".join(f"'{x}.parquet'" for x in TABLES) + "]) AS path")
def _(t):
    walked = tree.files(t.spark, t.folder, ("parquet",), ("event?.parquet", "**/tmp/*"))
    return walked.select(F.regexp_replace("path", "/part-[^/]*$", "").alias("path")).distinct()  # a table may be a folder of parts


@query("src02_scan_files", "SELECT 'src/n' || CAST(n_nationkey AS VARCHAR) || '.py' AS path FROM {nation} UNION ALL SELECT 'etc/' || CAST(n_nationkey AS VARCHAR) || '.env' FROM {nation} UNION ALL SELECT 'etc/.env.' || CAST(n_nationkey AS VARCHAR) FROM {nation}")
def _(t):
    n = F.col("n_nationkey").cast("string")
    names = lambda *ways: t.nation.select(F.explode(F.array(*(F.concat(F.lit(a), n, F.lit(z)) for a, z in ways))).alias("path"), F.lit("x").alias("content"))
    sources = names(("src/n", ".py"))
    return tree.scan_files(sources, sources.unionByName(names(("etc/", ".env"), ("etc/.env.", ""), ("etc/", ".txt"), ("env/", ".md")))).select("path")


@query("src06_sarif", "SELECT 'tool' || CAST(doc_id % 3 AS VARCHAR) AS tool, 'R' || CAST(quality AS VARCHAR) AS rule_id, CASE doc_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'info' ELSE 'medium' END AS severity, 'f' || CAST(doc_id AS VARCHAR) || '.py' AS path, doc_id AS line_start, 'p' || CAST(doc_id AS VARCHAR) AS fingerprint FROM {labels}")
def _(t):
    n = F.col("doc_id")
    text = lambda head, c: F.concat(F.lit(head), c.cast("string"))
    place = F.struct(F.struct(F.struct(F.concat(text("f", n), F.lit(".py")).alias("uri")).alias("artifactLocation"), F.struct(n.alias("startLine")).alias("region")).alias("physicalLocation"))
    level = F.when(n % 4 == 0, "error").when(n % 4 == 1, "warning").when(n % 4 == 2, "note")
    prints = F.create_map(F.lit("b"), F.lit("other"), F.lit("a"), text("p", n))
    result = F.struct(text("R", F.col("quality")).alias("ruleId"), level.alias("level"), F.struct(F.lit("m").alias("text")).alias("message"), prints.alias("partialFingerprints"), F.array(place).alias("locations"))
    log = F.to_json(F.struct(F.array(F.struct(F.struct(F.struct(text("tool", n % 3).alias("name")).alias("driver")).alias("tool"), F.array(result).alias("results"))).alias("runs")))
    return tree.sarif_results(t.labels.select(log.alias("json"))).select("tool", "rule_id", "severity", "path", "line_start", "fingerprint")


@query("src07_rename_hints", "SELECT 'geo:class:old' || substr(name, 3) AS old_locator, id AS new_locator FROM {entities} WHERE kind = 'class' AND starts_with(name, 'r1.')")
def _(t):
    from graphquarry.operators.identity import renamed_locators

    renames = t.spark.createDataFrame([("old/x.py", "none/x.py"), ("old.py", "r1.py")], "old_path string, new_path string")
    return renamed_locators(t.entities.where("kind = 'class'").select(F.col("id").alias("locator")), renames)


@query("snk11_prior_index", "SELECT DISTINCT source_file_path AS path, 'two' AS hash FROM {entities}")
def _(t):
    root = folder_of(t)
    paths = t.entities.select(F.col("source_file_path").alias("path")).distinct()
    for version in ("one", "two"):
        tree.write_snapshot({"index": paths.withColumn("hash", F.lit(version))}, root, version)
    return tree.read_snapshot(t.spark, root, "index")


@query("snk13_backup", "SELECT kind, count(*) AS n FROM {edges} GROUP BY kind")
def _(t):
    root = folder_of(t)
    tree.write_snapshot({"edges": t.edges}, root, "backup")
    return tree.read_snapshot(t.spark, root, "edges").groupBy("kind").agg(F.count("*").alias("n"))


# --- extraction --------------------------------------------------------------------------------------


def sources(t) -> DataFrame:
    """A Python file for each part, with two classes, calls into the next part's file, and imports of several kinds."""
    n = F.col("p_partkey")
    last = t.part.agg(F.count("*").alias("__n"))  # one row
    rows = t.part.crossJoin(F.broadcast(last))
    other = ((n + 1) % F.col("__n")).cast("string")
    head = F.concat(F.lit("from typing import TYPE_CHECKING\nfrom pkg.n"), other, F.lit(" import start as other\nimport os\nif TYPE_CHECKING:\n    import heavy\n\n"))
    code = F.concat(head, F.lit("class Base:\n    pass\n\nclass Model(Base):\n    def run(self, a, b=1):\n        import lazy\n        return other(self)\n\ndef start(x):\n    def inner():\n        return x\n    return Model().run(x)\n"))
    made = rows.select(F.concat(F.lit("src/pkg/n"), n.cast("string"), F.lit(".py")).alias("path"), code.alias("content"))
    return made.repartition(t.spark.sparkContext.defaultParallelism)  # as many files are spread over a store


def extracted(t) -> DataFrame:
    """The sources' rows, parsed once."""
    return written(P.extract(sources(t)))


NAME = "'pkg.n' || CAST(p_partkey AS VARCHAR)"
NEXT = "'pkg.n' || CAST((p_partkey + 1) % (SELECT count(*) FROM {part}) AS VARCHAR)"
EACH = f"(SELECT {NAME} AS m, {NEXT} AS o FROM {{part}})"
DECLARED = "(VALUES ('module', ''), ('class', '.Base'), ('class', '.Model'), ('function', '.Model.run'), ('function', '.start'), ('function', '.start.<locals>.inner')) v(kind, tail)"


@query("ext01_entities", f"SELECT kind || ':' || m || tail AS entity FROM {EACH}, {DECLARED}")
def _(t):
    return P.entities(extracted(t)).select(F.concat_ws(":", "kind", "name").alias("entity"))


@query("ext02_signatures", f"SELECT m || tail AS qualname, CASE tail WHEN '.Model' THEN '(Base)' WHEN '.Base' THEN '()' WHEN '.Model.run' THEN '(self, a, b=1)' WHEN '.start' THEN '(x)' WHEN '' THEN NULL ELSE '()' END AS signature FROM {EACH}, {DECLARED}")
def _(t):
    return P.entities(extracted(t)).select(F.col("name").alias("qualname"), "signature")


@query("ext03_contains", f"SELECT 'python:' || a || ':' || m || x AS from_id, 'python:' || b || ':' || m || y AS to_id FROM {EACH}, (VALUES ('module', '', 'class', '.Base'), ('module', '', 'class', '.Model'), ('class', '.Model', 'function', '.Model.run'), ('module', '', 'function', '.start'), ('function', '.start', 'function', '.start.<locals>.inner')) v(a, x, b, y)")
def _(t):
    rows = extracted(t)
    edges, _ = P.resolve_sites(rows, P.entities(rows))
    return edges.where("kind = 'contains'").select("from_id", "to_id")


@query("ext04_imports", f"SELECT 'python:module:' || m AS from_id, 'python:module:' || CASE i WHEN 'next' THEN o ELSE i END AS to_id, i = 'heavy' AS type_only, CASE i WHEN 'lazy' THEN 'function' ELSE 'module' END AS scope FROM {EACH}, (VALUES ('next'), ('os'), ('heavy'), ('lazy'), ('typing')) v(i)")
def _(t):
    rows = extracted(t)
    edges, _ = P.resolve_sites(rows, P.entities(rows))
    field = lambda name: F.get_json_object("properties", f"$.{name}")
    return edges.where("kind = 'imports'").select("from_id", "to_id", F.coalesce(field("type_only") == "true", F.lit(False)).alias("type_only"), field("scope").alias("scope"))


@query("ext05_resolved_edges", f"SELECT 'calls' AS kind, 'python:function:' || m || '.Model.run' AS from_id, 'python:function:' || o || '.start' AS to_id FROM {EACH} UNION ALL SELECT 'calls', 'python:function:' || m || '.start', 'python:class:' || m || '.Model' FROM {EACH} UNION ALL SELECT 'inherits_from', 'python:class:' || m || '.Model', 'python:class:' || m || '.Base' FROM {EACH}")
def _(t):
    rows = extracted(t)
    edges, _ = P.resolve_sites(rows, P.entities(rows))
    return edges.where("kind in ('calls', 'inherits_from')").select("kind", "from_id", "to_id")


@query("ext06_unresolved_sites", f"SELECT 'python:function:' || m || '.start' AS caller_entity_id, '().run' AS callee_expr FROM {EACH}")
def _(t):
    rows = extracted(t)
    return P.resolve_sites(rows, P.entities(rows))[1].select("caller_entity_id", "callee_expr")


@query("ext07_tags", f"SELECT 'python:' || kind || ':' || m || tail AS entity_id, 'public-surface' AS tag FROM {EACH}, {DECLARED} WHERE tail IN ('.Base', '.Model', '.start')")
def _(t):
    return P.tags(extracted(t)).select("entity_id", "tag")


@query("src05_file_stats", f"SELECT 'src/' || replace(m, '.', '/') || '.py' AS path, CASE WHEN m LIKE '%7' THEN 1 ELSE 6 END AS entities, CASE WHEN m LIKE '%7' THEN 0 ELSE 3 END AS tags, CASE WHEN m LIKE '%7' THEN 'PY-SYNTAX-ERROR' END AS finding FROM {EACH}")
def _(t):
    files = sources(t)
    broken = files.withColumn("content", F.when(F.col("path").like("%7.py"), F.concat(F.lit("def (:\n"), "content")).otherwise(F.col("content")))
    stats = P.file_stats(P.extract(broken))
    return stats.select("path", F.col("entities").cast("int").alias("entities"), F.col("tags").cast("int").alias("tags"), "finding")


@query("ext13_parse_guard", "SELECT 'deep' || CAST(r_regionkey AS VARCHAR) AS path, CASE r_regionkey WHEN 0 THEN NULL ELSE 'syntax_error' END AS degraded FROM {region}")
def _(t):
    k = F.col("r_regionkey")
    bad = F.when(k == 0, F.lit("x = 1\n")).when(k == 1, F.concat(F.lit("x = "), F.repeat(F.lit("("), 5000))).when(k == 2, F.lit("def f(:\n")).when(k == 3, F.lit("x = '\u0000'\n")).otherwise(F.concat(F.repeat(F.lit("if x:\n "), 3), F.lit("\npass")))
    rows = t.region.select(F.concat(F.lit("deep"), k.cast("string")).alias("path"), bad.alias("content"))
    return P.entities(P.extract(rows)).select(F.col("source_file_path").alias("path"), F.get_json_object("properties", "$.syntax_degraded").alias("degraded"))


# --- streams -----------------------------------------------------------------------------------------


def event_stream(t) -> DataFrame:
    schema = t.events.schema
    return t.spark.readStream.schema(schema).parquet(f"{t.folder}/event[s].parquet")


def drained(t, stream: DataFrame) -> DataFrame:
    """What a stream appends to a log when it has read all there is."""
    root = folder_of(t)
    feeds.appended(stream, f"{root}/log", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{root}/log")


@query("str05_breaker", "WITH e AS (SELECT event_type AS key, epoch_us(CAST(ts AS TIMESTAMP)) AS us FROM {events}), n AS (SELECT key, us, count(*) OVER (PARTITION BY key ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)::INTEGER AS n FROM e) SELECT DISTINCT key, us, n FROM n WHERE n > 3 AND us <= (SELECT max(us) FROM e) - 3600000000")
def _(t):
    crashes = event_stream(t).select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return drained(t, feeds.breaker(crashes, 3, 86400, "1 hour")).select("key", F.unix_micros("ts").alias("us"), "n")


@query("str05_tripped", "WITH e AS (SELECT event_type AS key, epoch_us(CAST(ts AS TIMESTAMP)) AS us FROM {events}), n AS (SELECT key, us, count(*) OVER (PARTITION BY key ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW)::INTEGER AS n FROM e) SELECT DISTINCT key, us, n FROM n WHERE n > 3")
def _(t):
    crashes = t.events.select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return feeds.tripped(crashes, 3, 3600).select("key", F.unix_micros("ts").alias("us"), "n")


@query("str04_changed_files", "SELECT 'u' || CAST(event_id AS VARCHAR) AS path FROM {events} WHERE event_id % 3 <> 0")
def _(t):
    n = F.col("event_id")
    name = F.concat(F.lit("u"), n.cast("string"))
    files = event_stream(t).select(name.alias("path"), F.lit("new").alias("hash"))
    prior = t.events.where(n % 3 == 0).select(name.alias("path"), F.lit("new").alias("hash"))
    return drained(t, feeds.changed_files(files, prior)).select("path")


@query("str06_lineage_log", "SELECT event_id AS seq, 'sei' || CAST(user_id AS VARCHAR) AS sei, event_type AS event FROM {events}")
def _(t):
    return drained(t, event_stream(t).select(F.col("event_id").alias("seq"), F.concat(F.lit("sei"), F.col("user_id").cast("string")).alias("sei"), F.col("event_type").alias("event")))


@query("str02_upserted_heartbeats", "SELECT 'run' || CAST(user_id AS VARCHAR) AS run_id, max(event_id) AS last FROM {events} GROUP BY user_id")
def _(t):
    from graphquarry.operators.lifecycle import latest

    root = folder_of(t)
    beats = event_stream(t).select(F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("run_id"), F.col("event_id").alias("last"))

    def merge(rows: DataFrame, batch: int) -> None:
        latest(rows.withColumn("seq", F.col("last")), ["run_id"], "seq").select("run_id", "last").write.mode("overwrite").parquet(f"{root}/batch={batch}")

    feeds.upserts(beats, merge, f"{root}-state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(root).groupBy("run_id").agg(F.max("last").alias("last"))


@query("str01_batches", "SELECT event_type, count(*) AS n FROM {events} GROUP BY event_type")
def _(t):
    root = folder_of(t)

    def merge(rows: DataFrame, batch: int) -> None:
        rows.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{root}/batch={batch}")

    feeds.upserts(feeds.bounded_files(t.spark, f"{t.folder}/event[s].parquet", t.events.schema, 100), merge, f"{root}-state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(root).groupBy("event_type").agg(F.sum("n").alias("n"))


@query("str03_stale_runs", "WITH l AS (SELECT 'run' || CAST(user_id AS VARCHAR) AS run_id, max(CAST(epoch(CAST(ts AS TIMESTAMP)) AS BIGINT)) AS s FROM {events} GROUP BY user_id), m AS (SELECT max(s) AS m FROM l) SELECT run_id, m - s > 30 AS stale_for_status, m - s > 86400 AS stale_for_store FROM l, m")
def _(t):
    beats = t.events.select(F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("run_id"), F.col("ts").cast("timestamp").alias("ts"))
    now = beats.agg(F.max("ts").alias("now"))
    return feeds.stale(beats, now).select("run_id", "stale_for_status", "stale_for_store")


# --- Rust --------------------------------------------------------------------------------------------


def rust_sources(t) -> DataFrame:
    """A crate for each supplier: a struct with two impl blocks, a trait, a test, and a call into the next crate."""
    n = F.col("s_suppkey")
    last = t.supplier.agg(F.count("*").alias("__n"))  # one row
    rows = t.supplier.crossJoin(F.broadcast(last))
    other = ((n + 1) % F.col("__n")).cast("string")
    code = F.concat(F.lit("use c"), other, F.lit("::start as other;\n\npub trait Marker {}\n\n#[derive(Debug, Marker)]\npub struct Model { x: u32 }\n\nimpl Marker for Model {}\n\nimpl Model {\n    pub fn run(&self) -> u32 { other(); helper(self.x) }\n}\n\npub fn start() { Model::make(); }\n\nfn helper(x: u32) -> u32 { x }\n\n#[test]\nfn works() { start(); }\n"))
    made = rows.select(F.concat(F.lit("c"), n.cast("string"), F.lit("/src/lib.rs")).alias("path"), code.alias("content"))
    return made.repartition(t.spark.sparkContext.defaultParallelism)


def rust_rows(t) -> DataFrame:
    return written(R.extract(rust_sources(t)))


CRATES = "(SELECT 'c' || CAST(s_suppkey AS VARCHAR) AS c, 'c' || CAST((s_suppkey + 1) % (SELECT count(*) FROM {supplier}) AS VARCHAR) AS o FROM {supplier})"
RUST = "(VALUES ('module', ''), ('trait', '.Marker'), ('struct', '.Model'), ('impl', '.Model.impl[Marker]'), ('impl', '.Model.impl#<>'), ('function', '.Model.impl#<>.run'), ('function', '.start'), ('function', '.helper'), ('function', '.works')) v(kind, tail)"


@query("ext09_rust_entities", f"SELECT 'rust:' || kind || ':' || c || tail AS id, CASE tail WHEN '' THEN 1 WHEN '.Marker' THEN 3 WHEN '.Model' THEN 5 WHEN '.Model.impl[Marker]' THEN 8 WHEN '.Model.impl#<>' THEN 10 WHEN '.Model.impl#<>.run' THEN 11 WHEN '.start' THEN 14 WHEN '.helper' THEN 16 ELSE 18 END AS line, CASE tail WHEN '.helper' THEN 'x: u32' END AS params FROM {CRATES}, {RUST}")
def _(t):
    e = R.entities(rust_rows(t))
    params = F.when(F.col("name").endswith(".helper"), F.get_json_object("signature", "$.params[0]"))
    return e.select("id", F.col("source_line_start").cast("int").alias("line"), params.alias("params"))


@query("ext10_rust_resolution", f"SELECT 'rust:function:' || c || f AS from_id, text, 'rust:function:' || CASE text WHEN 'other' THEN o || '.start' ELSE c || '.' || text END AS to_id FROM {CRATES}, (VALUES ('.Model.impl#<>.run', 'other'), ('.Model.impl#<>.run', 'helper'), ('.works', 'start')) v(f, text)")
def _(t):
    rows = rust_rows(t)
    edges, _ = R.resolve_sites(rows, R.entities(rows))
    calls = edges.where("kind = 'calls' and confidence = 'resolved'").select("from_id", "to_id")
    other = F.split("from_id", "[:.]")[2] != F.split("to_id", "[:.]")[2]
    return calls.select("from_id", F.when(other, "other").otherwise(F.element_at(F.split("to_id", "[.]"), -1)).alias("text"), "to_id")


@query("ext11_rust_edges", f"SELECT kind, 'rust:' || a || ':' || c || x AS from_id, 'rust:' || b || ':' || CASE kind WHEN 'imports' THEN o ELSE c END || y AS to_id FROM {CRATES}, (VALUES ('derives', 'struct', '.Model', 'trait', '.Marker'), ('implements', 'impl', '.Model.impl[Marker]', 'trait', '.Marker'), ('imports', 'module', '', 'function', '.start'), ('contains', 'module', '', 'struct', '.Model'), ('contains', 'impl', '.Model.impl#<>', 'function', '.Model.impl#<>.run')) v(kind, a, x, b, y)")
def _(t):
    rows = rust_rows(t)
    edges, _ = R.resolve_sites(rows, R.entities(rows))
    shown = (F.col("kind") != "contains") & (F.col("kind") != "calls") & (F.col("kind") != "references")
    held = (F.col("kind") == "contains") & (F.col("to_id").endswith(".Model") | F.col("to_id").endswith(".run"))
    return edges.where(shown | held).select("kind", "from_id", "to_id")


@query("ext11_rust_unresolved", f"SELECT 'rust:function:' || c || '.start' AS caller_entity_id, 'Model::make' AS callee_expr FROM {CRATES}")
def _(t):
    rows = rust_rows(t)
    return R.resolve_sites(rows, R.entities(rows))[1].select("caller_entity_id", "callee_expr")


@query("ext12_rust_tags", f"SELECT 'rust:' || kind || ':' || c || tail AS entity_id, tag FROM {CRATES}, (VALUES ('trait', '.Marker', 'exported-api'), ('struct', '.Model', 'exported-api'), ('function', '.Model.impl#<>.run', 'exported-api'), ('function', '.start', 'exported-api'), ('function', '.works', 'test')) v(kind, tail, tag)")
def _(t):
    return R.tags(rust_rows(t)).select("entity_id", "tag")


# --- vocabularies of decorators ----------------------------------------------------------------------


VOCABULARY = '{"version": "2", "entries": [{"canonical_name": "trusted", "group": 1, "attrs": {"tier": "T1"}}, {"canonical_name": "external_boundary", "group": 2}]}'


@query("src09_descriptor", "SELECT 'enabled' AS status, '2' AS version, 2 AS entries UNION ALL SELECT 'version_skew', '2', 2 UNION ALL SELECT 'absent', NULL, 0 UNION ALL SELECT 'absent', NULL, 0")
def _(t):
    out = None
    for text, expected in ((VOCABULARY, "2"), (VOCABULARY, "3"), ("{broken", "2"), (None, "2")):
        entries, state = W.descriptor(t.spark, text, expected)
        one = state.crossJoin(entries.agg(F.count("*").cast("int").alias("entries"))).select("status", F.col("descriptor_version").alias("version"), "entries")  # two rows
        out = one if out is None else out.unionByName(one)
    return out


@query("ext08_decorated", "SELECT 'python:function:pkg.n' || CAST(p_partkey AS VARCHAR) || '.' || f AS entity_id, tag, line FROM {part}, (VALUES ('taken', 'wardline', 3), ('taken', 'wardline:external_boundary', 3), ('kept', 'wardline', 7), ('kept', 'wardline:trusted', 7)) v(f, tag, line)")
def _(t):
    code = F.lit("import guard\n\n@guard.external_boundary(tier=1)\ndef taken(): pass\n\n@other\n@trusted\ndef kept(): pass\n\ndef plain(): pass\n")
    files = t.part.select(F.concat(F.lit("src/pkg/n"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), code.alias("content")).repartition(t.spark.sparkContext.defaultParallelism)
    facts, tags = W.decorated(P.extract(files), W.descriptor(t.spark, VOCABULARY, "2")[0])
    return tags.join(facts, "entity_id").select("entity_id", "tag", F.get("decorators", F.lit(0))["line"].cast("int").alias("line"))
