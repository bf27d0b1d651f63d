"""The registered queries of the graph operators over the projected test graph, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphquarry.functions import expr as X
from graphquarry.operators import graph as G
from graphquarry.operators import lookup as L
from graphquarry.operators import traverse as V
from graphquarry.schema import RELATION_KINDS
from graphquarry.sources.fixtures import Tables, duckdb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of `Tables` under a name, with SQL over the same views (braces of its own are doubled)."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = duckdb(sql)
        return f

    return add


def ids(t: Tables, *values: str) -> DataFrame:
    return t.spark.createDataFrame([(v,) for v in values], "id string")


# Fragments of SQL that several queries share. Braces are doubled, because views are bound by format().
BLOCK = "CASE WHEN properties IS NULL THEN NULL WHEN NOT json_valid(properties) THEN 'malformed_properties_json' ELSE json_extract_string(properties, '$.briefing_blocked') END"
RUNTIME = "(properties IS NULL OR NOT json_valid(properties) OR (coalesce(json_extract_string(properties, '$.type_only'), '0') NOT IN ('1', 'true') AND coalesce(json_extract_string(properties, '$.scope'), 'module') = 'module'))"
CANDIDATES = "coalesce(CASE WHEN json_valid(properties) THEN CAST(json_extract(properties, '$.candidates') AS VARCHAR[]) END, [])"
ROOTS = "('entry-point', 'http-route', 'test', 'data-model', 'cli-command', 'exported-api', 'public-surface', 'allow-dead-code')"
ANCESTORS = "anc(id, module, depth) AS (SELECT id, id, 0 FROM {entities} UNION ALL SELECT anc.id, e.from_id, depth + 1 FROM anc JOIN {edges} e ON e.kind = 'contains' AND e.to_id = anc.module WHERE depth < 32)"
EXPANDED = "SELECT from_id, to_id, confidence, source_byte_start, 0 AS pass FROM {{edges}} WHERE kind = 'calls' AND confidence IN ({0}) UNION ALL SELECT from_id, c, confidence, source_byte_start, 1 FROM (SELECT from_id, to_id, confidence, source_byte_start, unnest(" + CANDIDATES + ") AS c FROM {{edges}} WHERE kind = 'calls' AND confidence = 'ambiguous') WHERE c <> to_id"
ALL_CALLS = EXPANDED.format("'resolved', 'ambiguous', 'inferred'")
AMBIGUOUS_CALLS = EXPANDED.format("'resolved', 'ambiguous'")


# --- scans, filters, lookups -------------------------------------------------------------------------


@query("src03_table_scan", "SELECT * FROM {entities}")
def _(t):
    return t.entities


@query("flt01_entity_by_id", "SELECT id, kind, name, content_hash FROM {entities} WHERE id = 'lib:function:p7'")
def _(t):
    return L.by_id(t.entities, "lib:function:p7").select("id", "kind", "name", "content_hash")


@query("flt02_entity_by_ref", "SELECT id, kind FROM {entities} WHERE id IN (SELECT current_locator FROM {bindings} WHERE status = 'alive' AND sei = 'sei:' || md5('geo:module:r1'))")
def _(t):
    import hashlib

    return L.by_ref(t.entities, t.bindings, "sei:" + hashlib.md5(b"geo:module:r1").hexdigest()).select("id", "kind")


@query("flt03_existing_ids", "SELECT id FROM {entities} WHERE id IN (SELECT to_id FROM {edges} WHERE kind = 'calls')")
def _(t):
    return L.existing(t.entities, t.edges_of("calls").select(F.col("to_id").alias("id")))


@query("flt04_visibility", f"WITH w AS (SELECT id FROM {{entities}} WHERE kind = 'class' UNION SELECT 'geo:class:none') SELECT w.id, CASE WHEN e.id IS NULL THEN 'not_found' WHEN {BLOCK} IS NOT NULL THEN 'blocked' ELSE 'visible' END AS state, {BLOCK} AS reason FROM w LEFT JOIN {{entities}} e ON e.id = w.id")
def _(t):
    return L.visibility(t.entities, t.entities.where("kind = 'class'").select("id").unionByName(ids(t, "geo:class:none")))


@query("flt05_entities_by_kind", "SELECT id, name FROM {entities} WHERE kind = 'class' ORDER BY id LIMIT 51")
def _(t):
    return L.of_kind(t.entities, "class", 50).select("id", "name")


@query("flt06_known_kinds", "SELECT DISTINCT kind AS name FROM {entities} UNION ALL SELECT DISTINCT tag FROM {tags}")
def _(t):
    return L.known(t.entities, "kind").select(F.col("kind").alias("name")).unionAll(L.known(t.tags, "tag"))


@query("flt07_tags_of_entity", "SELECT entity_id, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags FROM {tags} GROUP BY entity_id")
def _(t):
    return L.tags_of(t.tags).select("entity_id", F.array_join("tags", ",").alias("tags"))


@query("flt08_entity_by_path", "SELECT source_file_path, id, kind FROM (SELECT *, row_number() OVER (PARTITION BY source_file_path ORDER BY CASE kind WHEN 'file' THEN 0 WHEN 'module' THEN 1 ELSE 2 END, id) AS n FROM {entities}) WHERE n = 1")
def _(t):
    return L.by_path(t.entities)


@query("flt10_language", "SELECT id, CASE WHEN plugin_id IN ('python', 'rust') THEN plugin_id WHEN source_file_path LIKE '%.py' THEN 'python' WHEN source_file_path LIKE '%.rs' THEN 'rust' END AS language FROM {entities}")
def _(t):
    return t.entities.select("id", X.language(F.lit(None).cast("string"), F.col("plugin_id"), F.col("source_file_path")).alias("language"))


@query("flt11_block_reason", f"SELECT id, {BLOCK} AS reason FROM {{entities}} WHERE {BLOCK} IS NOT NULL")
def _(t):
    return t.entities.select("id", X.block_reason(F.col("properties")).alias("reason")).where("reason is not null")


@query("flt12_scope", "SELECT id FROM {entities} WHERE source_file_path LIKE 'src/r1/%/customers.py' AND kind = 'class'")
def _(t):
    return L.in_scope(t.entities.where("kind = 'class'"), "src/r1/*/customers.py").select("id")


@query("flt13_scope_membership", "SELECT id FROM {entities} WHERE id = 'geo:module:r2' OR starts_with(split_part(id, ':', 3), 'r2.')")
def _(t):
    return L.in_scope(t.entities, "geo:module:r2", lambda x: V.descendants(t.edges_of("contains"), ids(t, x))).select("id")


@query("flt14_namespace", "SELECT id FROM {entities} WHERE split_part(id, ':', 3) = 'r3' OR starts_with(split_part(id, ':', 3), 'r3.')")
def _(t):
    return L.in_namespace(t.entities, "r3").select("id")


@query("flt15_glob", "SELECT DISTINCT source_file_path FROM {entities} WHERE regexp_matches(source_file_path, '^src(/.*)?/test_[^/]*[.]py$')")
def _(t):
    return t.entities.where(X.matches_glob(F.col("source_file_path"), "src/**/test_*.py")).select("source_file_path").distinct()


@query("flt16_confidence_ceiling", "SELECT confidence, count(*) AS n FROM {edges} WHERE confidence IN ('resolved', 'ambiguous') GROUP BY confidence")
def _(t):
    return t.edges.where(X.within_ceiling(F.col("confidence"), "ambiguous")).groupBy("confidence").agg(F.count("*").alias("n"))


@query("flt17_runtime_imports", f"SELECT from_id, to_id FROM {{edges}} WHERE kind = 'imports' AND {RUNTIME}")
def _(t):
    return t.edges_of("imports").where(X.runtime_import(F.col("properties"))).select("from_id", "to_id")


@query("flt18_path_scope", "SELECT id FROM {entities} WHERE NOT (lower(source_file_path) LIKE '%/test/%' OR lower(source_file_path) LIKE '%/tests/%' OR starts_with(split_part(source_file_path, '/', -1), 'test_'))")
def _(t):
    return t.entities.where(X.admits(F.col("source_file_path"), "production")).select("id")


LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY updated_at DESC, ingest_seq DESC) AS n FROM {{taints}} WHERE {key} IS NOT NULL) WHERE n = 1"


@query("flt19_taint_facet", "WITH l AS (" + LATEST.format(key="entity_id") + ") SELECT e.id, e.kind, e.id IN (SELECT entity_id FROM {findings}) AS has_findings FROM {entities} e JOIN l ON l.entity_id = e.id WHERE json_valid(fact_json) AND CASE WHEN json_valid(fact_json) THEN json_extract_string(fact_json, '$.tier') END = 'T1'")
def _(t):
    return L.with_taint(t.entities, t.taints, tier="T1", findings=t.findings)


@query("flt20_entity_findings", "SELECT id, rule_id, severity, status FROM {findings} WHERE severity = 'WARN' AND status = 'open'")
def _(t):
    return L.findings_of(t.findings, severity="WARN", status="open").select("id", "rule_id", "severity", "status")


@query("flt21_project_findings", "SELECT f.id, f.rule_id, f.kind, f.severity, f.status, f.entity_id, e.source_file_path, e.source_line_start, f.created_at FROM {findings} f JOIN {entities} e ON e.id = f.entity_id WHERE f.kind = 'fact'")
def _(t):
    return L.project_findings(t.findings, t.entities, kind="fact")


@query("flt22_redaction", f"SELECT id, kind, CASE WHEN {BLOCK} IS NULL THEN name END AS name, CASE WHEN {BLOCK} IS NULL THEN short_name END AS short_name, CASE WHEN {BLOCK} IS NULL THEN source_file_path END AS source_file_path, CASE WHEN {BLOCK} IS NULL THEN summary END AS summary, {BLOCK} AS briefing_blocked FROM {{entities}}")
def _(t):
    return L.redacted(t.entities)


@query("flt23_source_lines", "WITH f AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM {documents}) SELECT concat('d', CAST(doc_id AS VARCHAR)) AS id, CAST(1 AS BIGINT) AS first_line, array_to_string(lines[1:3], chr(10)) AS text FROM f")
def _(t):
    e = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("doc_id").cast("string").alias("source_file_path"), F.lit(2).cast("long").alias("source_line_start"), F.lit(2).cast("long").alias("source_line_end"), F.lit("{}").alias("properties"))
    files = t.documents.select(F.col("doc_id").cast("string").alias("source_file_path"), F.col("text").alias("content"))
    return L.source_lines(files, e, 1, 1)


# --- joins -------------------------------------------------------------------------------------------


@query("jon01_findings_for_emit", f"SELECT f.id, f.rule_id, e.source_file_path FROM {{findings}} f JOIN {{entities}} e ON e.id = f.entity_id WHERE f.run_id = 'run1' AND {BLOCK} IS NULL")
def _(t):
    open_ = t.entities.where(X.block_reason(F.col("properties")).isNull()).select(F.col("id").alias("entity_id"), "source_file_path")
    return t.findings.where("run_id = 'run1'").join(open_, "entity_id").select("id", "rule_id", "source_file_path")


LIVE = "SELECT s.*, e.source_file_path AS caller_path FROM {sites} s JOIN {entities} e ON e.id = s.caller_entity_id AND e.content_hash = s.caller_content_hash"


@query("jon03_live_sites", "SELECT site_key, caller_entity_id, callee_expr, site_ordinal FROM (" + LIVE + ")")
def _(t):
    return G.live_sites(t.sites, t.entities).select("site_key", "caller_entity_id", "callee_expr", "site_ordinal")


@query("jon04_unresolved_callers", "WITH l AS (" + LIVE + ") SELECT g.id AS to_id, site_key, caller_entity_id, callee_expr, coalesce(caller_path = g.source_file_path, false) AS same_file, CASE WHEN contains(callee_expr, '.') THEN 'attribute-receiver' ELSE 'dynamic' END AS why FROM l JOIN {entities} g ON g.short_name = regexp_extract(callee_expr, '([^.:]*)$', 1)")
def _(t):
    return G.unresolved_callers(t.sites, t.entities, t.entities)


@query("jon04_unresolved_pages", "WITH l AS (" + LIVE + "), r AS (SELECT g.id AS to_id, count(*) OVER (PARTITION BY g.id) AS total, row_number() OVER (PARTITION BY g.id ORDER BY caller_entity_id, site_key)::INTEGER AS rank, site_key, caller_entity_id, callee_expr, coalesce(caller_path = g.source_file_path, false) AS same_file, CASE WHEN contains(callee_expr, '.') THEN 'attribute-receiver' ELSE 'dynamic' END AS why FROM l JOIN {entities} g ON g.short_name = regexp_extract(callee_expr, '([^.:]*)$', 1)) SELECT * FROM r WHERE rank <= 5")
def _(t):
    return G.unresolved_pages(t.sites, t.entities, t.entities, 5)


@query("jon05_unresolved_counts", "WITH l AS (" + LIVE + ") SELECT g.id AS to_id, count(*) AS n FROM l JOIN {entities} g ON g.short_name = regexp_extract(callee_expr, '([^.:]*)$', 1) GROUP BY g.id")
def _(t):
    return G.unresolved_counts(t.sites, t.entities, t.entities)


@query("jon06_shielded", "WITH l AS (" + LIVE + ") SELECT id FROM {entities} WHERE short_name IN (SELECT trim(regexp_extract(callee_expr, '([^.:]*)$', 1)) FROM l)")
def _(t):
    return G.targeted_by_sites(t.sites, t.entities)


@query("jon07_site_candidates", "WITH l AS (" + LIVE + "), x AS (SELECT DISTINCT callee_expr, trim(split_part(callee_expr, '.', -1)) AS short FROM l), c AS (SELECT callee_expr, id FROM x JOIN {entities} e ON e.short_name = short WHERE short <> '' UNION SELECT callee_expr, id FROM x JOIN {entities} e ON e.name = callee_expr WHERE short <> '' UNION SELECT callee_expr, id FROM x JOIN {entities} e ON lower(split_part(e.name, '.', -1)) = lower(short) AND contains(e.name, '.') WHERE short <> '') SELECT DISTINCT site_key, id FROM l JOIN c USING (callee_expr)")
def _(t):
    return G.site_candidates(t.sites, t.entities)


@query("jon08_tagged", "SELECT id FROM {entities} WHERE id IN (SELECT entity_id FROM {tags} WHERE tag = 'deprecated')")
def _(t):
    return L.with_tag(t.entities, t.tags, "deprecated").select("id")


@query("jon10_identity_hash", "SELECT sei, current_locator, content_hash FROM {bindings} LEFT JOIN {entities} ON id = current_locator WHERE status = 'alive'")
def _(t):
    return t.bindings.where("status = 'alive'").join(t.entities.select(F.col("id").alias("current_locator"), "content_hash"), "current_locator", "left").select("sei", "current_locator", "content_hash")


@query("jon11_parent_mismatch", "WITH e AS (SELECT id, CASE WHEN kind = 'class' AND source_line_start % 3000 = 0 THEN 'geo:module:other' ELSE parent_id END AS parent_id FROM {entities}), c AS (SELECT to_id, from_id FROM {edges} WHERE kind = 'contains' AND to_id NOT LIKE '%.o1_') SELECT coalesce(id, to_id) AS id, parent_id, from_id FROM e FULL JOIN c ON to_id = id WHERE parent_id IS DISTINCT FROM from_id")
def _(t):
    from graphquarry.operators.lifecycle import parent_mismatches

    wrong = F.when((F.col("kind") == "class") & (F.col("source_line_start") % 3000 == 0), "geo:module:other").otherwise(F.col("parent_id"))
    return parent_mismatches(t.entities.withColumn("parent_id", wrong), t.edges_of("contains").where("to_id not like '%.o1_'")).select("id", "parent_id", "from_id")


@query("jon12_entity_at_line", "WITH a AS (SELECT DISTINCT source_file_path, source_line_start + 3 AS line FROM {entities} WHERE kind = 'function') SELECT source_file_path, line, id, span FROM (SELECT a.source_file_path, line, id, source_line_end - source_line_start AS span, row_number() OVER (PARTITION BY a.source_file_path, line ORDER BY source_line_end - source_line_start, CASE kind WHEN 'function' THEN 0 WHEN 'class' THEN 1 WHEN 'module' THEN 2 ELSE 3 END, id) AS n FROM a JOIN {entities} e ON e.source_file_path = a.source_file_path AND line BETWEEN source_line_start AND source_line_end) WHERE n = 1")
def _(t):
    asked = t.entities.where("kind = 'function'").select("source_file_path", (F.col("source_line_start") + 3).alias("line")).distinct()
    return L.at_line(t.entities, asked)


@query("jon13_latest_taint_by_sei", "SELECT sei, entity_id, fact_json, updated_at, ingest_seq FROM (" + LATEST.format(key="sei") + ")")
def _(t):
    return L.latest_facts(t.taints, "sei").select("sei", "entity_id", "fact_json", "updated_at", "ingest_seq")


@query("jon14_prior_locators", "WITH f AS (SELECT source_file_path AS path, list_sort(list(id)) AS ids FROM {entities} GROUP BY source_file_path) SELECT path, CASE WHEN path LIKE '%customers.py' THEN md5(path) END AS hash, sha256(array_to_string(ids, ',')) AS locators, CAST(len(ids) AS INTEGER) AS n FROM f")
def _(t):
    from graphquarry.operators.lifecycle import prior_snapshot

    prior = t.entities.where("source_file_path like '%customers.py'").select(F.col("source_file_path").alias("path"), F.md5("source_file_path").alias("hash")).distinct()
    return prior_snapshot(t.entities, prior).select("path", "hash", F.sha2(F.array_join("locators", ","), 256).alias("locators"), F.size("locators").alias("n"))


@query("jon15_resolve_qualnames", "SELECT name AS qualname, CASE count(*) WHEN 1 THEN 'exact' ELSE 'ambiguous' END AS result_kind, array_to_string(list_sort(list(id)), ',') AS entity_ids FROM {entities} WHERE kind NOT IN ('file', 'subsystem') GROUP BY name UNION ALL SELECT 'no.such', 'none', ''")
def _(t):
    from graphquarry.operators.identity import resolve_qualnames

    asked = t.entities.select(F.col("name").alias("qualname")).distinct().unionByName(t.spark.createDataFrame([("no.such",)], "qualname string"))
    return resolve_qualnames(t.entities, asked).select("qualname", "result_kind", F.array_join("entity_ids", ",").alias("entity_ids"))


@query("jon17_seis_for_locators", "SELECT current_locator, sei FROM {bindings} WHERE status = 'alive' AND current_locator IN (SELECT entity_id FROM {tags} WHERE tag = 'data-model')")
def _(t):
    asked = t.tags.where("tag = 'data-model'").select(F.col("entity_id").alias("current_locator"))
    return t.bindings.where("status = 'alive'").join(asked, "current_locator", "left_semi").select("current_locator", "sei")


@query("jon18_reconcile_by_qualname", "WITH f AS (SELECT id, CASE WHEN rule_id <> 'PY-TOXIC' THEN split_part(entity_id, ':', 3) END AS qualname FROM {findings}) SELECT e.id, f.id AS finding FROM f JOIN {entities} e ON split_part(e.id, ':', 3) = f.qualname UNION ALL SELECT NULL, id FROM f WHERE qualname IS NULL")
def _(t):
    from graphquarry.operators.orientation import reconciled

    external = t.findings.select("id", F.when(F.col("rule_id") != "PY-TOXIC", X.qualname(F.col("entity_id"))).alias("qualname"))
    matched, nameless = reconciled(t.entities, external)
    return matched.select("id", "finding").unionByName(nameless.select(F.lit(None).cast("string").alias("id"), F.col("id").alias("finding")))


@query("jon19_test_callers", "SELECT DISTINCT to_id, from_id FROM {edges} WHERE kind = 'calls' AND confidence = 'resolved' AND from_id IN (SELECT entity_id FROM {tags} WHERE tag = 'test')")
def _(t):
    return G.test_callers(t.edges_of("calls"), t.tags)


CHURN = "WITH c AS (SELECT entity_id, churn_count, last_changed_at, row_number() OVER (ORDER BY entity_id) AS seq FROM {churn}), i AS (SELECT CASE WHEN seq % 2 = 0 THEN 'sei:' || md5(entity_id) ELSE entity_id END AS key, churn_count, last_changed_at FROM c), j AS (SELECT e.id, CASE WHEN s.key IS NOT NULL THEN s.churn_count WHEN l.key IS NOT NULL THEN l.churn_count ELSE 0 END AS churn_count, CASE WHEN s.key IS NOT NULL THEN s.last_changed_at ELSE l.last_changed_at END AS last_changed_at FROM {entities} e LEFT JOIN {bindings} b ON b.current_locator = e.id AND b.status = 'alive' LEFT JOIN i s ON s.key = b.sei LEFT JOIN i l ON l.key = e.id) "


def churn_items(t):
    """Churn as a neighbour reports it: half of it by identity, half by locator."""
    odd = F.pmod(F.row_number().over(Window.orderBy("entity_id")), F.lit(2)) == 1  # a sequence for the test's items
    return t.churn.select(F.when(odd, None).otherwise(F.concat(F.lit("sei:"), F.md5("entity_id"))).alias("sei"), F.when(odd, F.col("entity_id")).alias("locator"), "churn_count", "last_changed_at", F.lit(0).alias("seq"))


@query("jon20_churn_join", CHURN + "SELECT id, churn_count FROM j")
def _(t):
    from graphquarry.operators.orientation import with_churn

    return with_churn(t.entities, t.bindings, churn_items(t)).select("id", "churn_count")


@query("srt07_stored_churn", CHURN + "SELECT id, last_changed_at FROM j WHERE churn_count >= 1 ORDER BY last_changed_at DESC, id LIMIT 100")
def _(t):
    from graphquarry.operators.orientation import by_recency, with_churn

    return by_recency(with_churn(t.entities, t.bindings, churn_items(t)), 100).select("id", "last_changed_at")


# --- aggregations ------------------------------------------------------------------------------------


@query("agg01_totals", "SELECT (SELECT count(*) FROM {entities}) AS entities, (SELECT count(*) FROM {entities} WHERE kind = 'subsystem') AS subsystems, (SELECT count(*) FROM {edges}) AS edges")
def _(t):
    a = t.entities.agg(F.count("*").alias("entities"), F.count_if(F.col("kind") == "subsystem").alias("subsystems"))
    return a.crossJoin(t.edges.agg(F.count("*").alias("edges")))  # two rows of counts


@query("agg02_per_plugin", "SELECT plugin_id, count(*) AS n FROM {entities} GROUP BY plugin_id")
def _(t):
    return t.entities.groupBy("plugin_id").agg(F.count("*").alias("n"))


@query("agg03_per_file", "SELECT source_file_path, count(*) AS n FROM {entities} GROUP BY source_file_path")
def _(t):
    return t.entities.groupBy("source_file_path").agg(F.count("*").alias("n"))


def coupling_sql(ceiling: str, leave: str = "false") -> str:
    return f"WITH p AS (SELECT DISTINCT from_id, to_id FROM {{edges}} WHERE (kind = 'calls' OR (kind = 'imports' AND {RUNTIME})) AND confidence IN ({ceiling}) AND NOT ({leave})), o AS (SELECT from_id AS id, count(*) AS n FROM p GROUP BY 1), i AS (SELECT to_id AS id, count(*) AS n FROM p GROUP BY 1) SELECT coalesce(o.id, i.id) AS id, CAST(coalesce(i.n, 0) AS BIGINT) AS fan_in, CAST(coalesce(o.n, 0) AS BIGINT) AS fan_out, CAST(coalesce(i.n, 0) + coalesce(o.n, 0) AS BIGINT) AS total FROM o FULL JOIN i ON i.id = o.id ORDER BY total DESC, id LIMIT 200"


@query("agg04_coupling", coupling_sql("'resolved', 'ambiguous', 'inferred'"))
def coupling(t):
    return G.hotspots(t.edges_of("calls", "imports"), 200, "inferred")


@query("agg04_coupling_app_only", coupling_sql("'resolved'", "from_id IN (SELECT entity_id FROM {tags} WHERE tag = 'test') OR to_id IN (SELECT entity_id FROM {tags} WHERE tag = 'test')"))
def _(t):
    return G.hotspots(t.edges_of("calls", "imports"), 200, "resolved", t.tags.where("tag = 'test'").select(F.col("entity_id").alias("id")).distinct())


@query("agg05_module_dependencies", "WITH RECURSIVE " + ANCESTORS + ", m AS (SELECT anc.id, module FROM anc JOIN {entities} e ON e.id = module AND e.kind = 'module'), f AS (SELECT kind, from_id, unnest(CASE WHEN kind = 'calls' AND confidence = 'ambiguous' THEN list_distinct(list_concat([to_id], " + CANDIDATES + ")) ELSE [to_id] END) AS to_id FROM {edges} WHERE kind IN ('calls', 'references', 'imports') AND confidence <> 'inferred') SELECT a.module AS from_module, b.module AS to_module, count(*) AS reference_count, array_to_string(list_sort(list(DISTINCT f.kind)), ',') AS kinds FROM f JOIN m a ON a.id = f.from_id JOIN m b ON b.id = f.to_id WHERE a.module <> b.module GROUP BY 1, 2")
def _(t):
    inside = t.edges_of("contains")
    found = G.module_dependencies_by_home(t.edges_of("calls", "references", "imports"), V.homes(inside, t.entities), lambda of: V.module_ancestors(inside, t.entities, of=of))
    return found.select("from_module", "to_module", "reference_count", F.array_join("kinds", ",").alias("kinds"))


@query("agg06_linkages", f"WITH c AS ({ALL_CALLS}) SELECT to_id AS id, from_id AS neighbour, count(*) AS call_site_count, CASE min(CASE confidence WHEN 'resolved' THEN 0 WHEN 'ambiguous' THEN 1 ELSE 2 END) WHEN 0 THEN 'resolved' WHEN 1 THEN 'ambiguous' ELSE 'inferred' END AS confidence FROM c WHERE from_id IN (SELECT id FROM {{entities}} WHERE {BLOCK} IS NULL) GROUP BY to_id, from_id")
def _(t):
    return G.linkages(t.edges_of("calls"), t.entities)


@query("agg07_finding_anchor", "WITH e AS (SELECT source_file_path, id, kind, plugin_id FROM {entities} UNION ALL SELECT DISTINCT source_file_path, 'core:file:' || source_file_path, 'file', 'core' FROM {entities}) SELECT source_file_path, arg_min(id, (CASE WHEN kind = 'module' THEN 0 WHEN plugin_id <> 'core' THEN 1 ELSE 2 END, id)) AS anchor FROM e GROUP BY source_file_path")
def _(t):
    from graphquarry.operators.lifecycle import finding_anchors

    files = t.entities.select("source_file_path", F.concat(F.lit("core:file:"), "source_file_path").alias("id"), F.lit("file").alias("kind"), F.lit("core").alias("plugin_id")).distinct()
    return finding_anchors(t.entities.select(*files.columns).unionByName(files)).select("source_file_path", F.col("entity_id").alias("anchor"))


@query("agg08_secret_anchor", "SELECT source_file_path, min(entity_id) AS anchor FROM {findings} JOIN {entities} e ON e.id = entity_id WHERE rule_id = 'PY-TOXIC' GROUP BY source_file_path")
def _(t):
    return t.findings.where("rule_id = 'PY-TOXIC'").join(t.entities.select(F.col("id").alias("entity_id"), "source_file_path"), "entity_id").groupBy("source_file_path").agg(F.min("entity_id").alias("anchor"))


@query("agg09_latest_finding", "WITH c AS (SELECT id, entity_id, created_at, CAST(substr(id, 2) AS BIGINT) AS n FROM {findings} WHERE rule_id = 'PY-QUALITY'), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, id DESC) AS k FROM c) WHERE k = 1) SELECT entity_id, CASE WHEN n % 7 = 0 THEN '' WHEN n % 3 = 0 THEN 'same.py' ELSE 'a' || CAST(n % 5 AS VARCHAR) || '.py,b.py' END AS paths, CASE WHEN n % 7 = 0 THEN NULL ELSE 'cross_file' END AS shape FROM l")
def _(t):
    from graphquarry.operators.lifecycle import last_collision

    n = F.substring("id", 2, 20).cast("long")
    first = F.when(n % 3 == 0, "same.py").otherwise("b.py")
    other = F.when(n % 3 == 0, "same.py").otherwise(F.concat(F.lit("a"), (n % 5).cast("string"), F.lit(".py")))
    made = F.to_json(F.struct(F.struct(first.alias("first_source_file_path"), other.alias("colliding_source_file_path"), F.lit("cross_file").alias("shape")).alias("metadata")))
    rows = t.findings.withColumn("evidence", F.when(n % 7 == 0, "not json").otherwise(made)).withColumn("updated_at", F.col("created_at"))
    return last_collision(rows, "PY-QUALITY").select("entity_id", F.array_join("paths", ",").alias("paths"), "shape")


@query("agg10_tier_consensus", "WITH l AS (" + LATEST.format(key="entity_id") + "), x AS (SELECT split_part(split_part(entity_id, ':', 3), '.', 1) AS subsystem, json_extract_string(CASE WHEN json_valid(fact_json) THEN fact_json END, '$.tier') AS tier FROM l) SELECT subsystem, count(*) AS members, count(DISTINCT tier) AS tiers, CASE WHEN count(*) >= 2 AND count(DISTINCT tier) >= 2 THEN 'mixing' WHEN count(DISTINCT tier) = 1 THEN 'unanimous' END AS verdict FROM x WHERE tier IS NOT NULL GROUP BY subsystem")
def _(t):
    from graphquarry.operators.lifecycle import tier_consensus

    last = L.latest_facts(t.taints, "entity_id").select(F.get(F.split(X.qualname(F.col("entity_id")), "[.]"), F.lit(0)).alias("subsystem"), F.when(X.is_json(F.col("fact_json")), X.scalar_facet(F.col("fact_json"), "tier")).alias("tier"))
    return tier_consensus(last)


@query("agg11_guidance_churn", "SELECT split_part(entity_id, '.', 2) AS sheet, CAST(sum(churn_count) AS BIGINT) AS churn FROM {churn} GROUP BY 1 HAVING sum(churn_count) >= 50")
def _(t):
    from graphquarry.operators.guidance import churned

    return churned(t.churn.select(F.get(F.split("entity_id", "[.]"), F.lit(1)).alias("sheet"), "churn_count", F.lit(False).alias("pinned")))


@query("agg13_p95", "SELECT event_type, coalesce(quantile_disc(value, 0.95), 0) AS p95 FROM {events} GROUP BY event_type")
def _(t):
    return t.events.groupBy("event_type").agg(F.expr("coalesce(percentile_disc(0.95) WITHIN GROUP (ORDER BY value), 0)").alias("p95"))


@query("agg15_average_weight", "SELECT greatest(1.0, avg(CASE WHEN n > 0 THEN least(n, 4294967295) END)) AS bar FROM (SELECT CAST(l_orderkey AS BIGINT) * 1000000 * (l_linenumber - 1) AS n FROM {lineitem})")
def _(t):
    return V.average_weight(t.lineitem.select((F.col("l_orderkey").cast("long") * 1000000 * (F.col("l_linenumber") - 1)).alias("reference_count")))


@query("agg17_guidance_tags", "WITH g AS (SELECT id, CAST(CASE WHEN kind = 'class' THEN 5 ELSE 4 END AS INTEGER) AS scope_rank, short_name FROM {entities} WHERE kind IN ('class', 'module')) SELECT g.id, scope_rank, 'On ' || short_name AS content, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags FROM g LEFT JOIN {tags} ON entity_id = g.id GROUP BY ALL")
def _(t):
    from graphquarry.operators.guidance import sheets

    made = F.to_json(F.struct(F.col("kind").alias("scope_level"), F.concat(F.lit("On "), "short_name").alias("content")))
    rows = t.entities.where("kind in ('class', 'module')").withColumn("properties", made).withColumn("kind", F.lit("guidance"))
    return sheets(rows, t.tags).select("id", "scope_rank", "content", F.array_join("tags", ",").alias("tags"))


# --- graph -------------------------------------------------------------------------------------------


@query("grf01_callers", f"WITH c AS ({AMBIGUOUS_CALLS}) SELECT to_id, from_id, source_byte_start, arg_min(confidence, pass) AS confidence, min(pass) AS pass FROM c WHERE to_id IN (SELECT id FROM {{entities}}) GROUP BY to_id, from_id, source_byte_start")
def _(t):
    return G.callers(t.edges_of("calls"), t.entities, "ambiguous")


@query("grf02_callees", f"WITH c AS ({AMBIGUOUS_CALLS}) SELECT from_id, to_id, source_byte_start, arg_min(confidence, pass) AS confidence, min(pass) AS pass FROM c WHERE from_id IN (SELECT id FROM {{entities}}) GROUP BY from_id, to_id, source_byte_start")
def _(t):
    return G.callees(t.edges_of("calls"), t.entities, "ambiguous")


@query("grf03_neighbours", "SELECT to_id AS id, from_id AS neighbour, source_byte_start, confidence FROM {edges} WHERE kind = 'references'")
def _(t):
    return G.neighbours(t.edges_of("references"), "references", "in")


RELATIONS = "WITH r AS (SELECT * FROM {edges} WHERE kind IN ('decorates', 'inherits_from', 'implements', 'derives')), c AS (SELECT kind, from_id, to_id, confidence, unnest(" + CANDIDATES + ") AS c FROM r WHERE confidence = 'ambiguous'), p AS (SELECT kind, from_id, to_id, confidence FROM r UNION SELECT kind, CASE WHEN kind = 'decorates' THEN c ELSE from_id END, CASE WHEN kind = 'decorates' THEN to_id ELSE c END, confidence FROM c) SELECT from_id AS id, to_id AS neighbour, kind, 'out' AS direction, confidence FROM p UNION ALL SELECT to_id, from_id, kind, 'in', confidence FROM p"


@query("grf04_relations", RELATIONS)
def _(t):
    return G.relations(t.listed(*RELATION_KINDS), t.blocks)


@query("grf05_children", "SELECT from_id AS id, to_id AS neighbour FROM {edges} WHERE kind = 'contains'")
def _(t):
    return G.neighbours(t.edges_of("contains"), "contains").select("id", "neighbour")


DOWN = "WITH RECURSIVE d(root, id, depth) AS (SELECT id, id, 0 FROM {entities} WHERE kind = 'module' UNION ALL SELECT root, to_id, depth + 1 FROM d JOIN {edges} e ON e.kind = 'contains' AND from_id = d.id) "


@query("grf06_descendants", DOWN + "SELECT root, id, depth FROM d")
def _(t):
    return V.descendants(t.edges_of("contains"), t.entities.where("kind = 'module'"))


@query("grf07_module_rollup", "SELECT DISTINCT from_id AS \"inner\", to_id AS \"outer\", source_byte_start FROM {edges} WHERE kind = 'references' AND starts_with(split_part(from_id, ':', 3), 'r1.') AND NOT starts_with(split_part(to_id, ':', 3), 'r1.')")
def _(t):
    return G.module_rollup(t.edges_of("references"), V.descendants(t.edges_of("contains"), ids(t, "geo:module:r1")).select("id"))


@query("grf08_ancestors", "WITH RECURSIVE " + ANCESTORS + " SELECT id, module AS ancestor, depth FROM anc")
def _(t):
    return V.ancestors(t.edges_of("contains"), t.entities)


@query("grf09_module_ancestors", "WITH RECURSIVE " + ANCESTORS + " SELECT anc.id, module, depth FROM anc JOIN {entities} e ON e.id = module AND e.kind = 'module'")
def _(t):
    return V.module_ancestors(t.edges_of("contains"), t.entities)


@query("grf10_containing_module", "WITH RECURSIVE " + ANCESTORS + " SELECT anc.id, arg_min(module, depth) AS module FROM anc JOIN {entities} e ON e.id = module AND e.kind = 'module' GROUP BY anc.id")
def _(t):
    return V.containing_module(t.edges_of("contains"), t.entities)


@query("grf11_subsystem_of", "WITH RECURSIVE " + ANCESTORS + " SELECT anc.id, arg_min(module, depth) AS module, arg_min(s.to_id, depth) AS subsystem FROM anc JOIN {edges} s ON s.kind = 'in_subsystem' AND s.from_id = module GROUP BY anc.id")
def _(t):
    return V.subsystem_of(t.edges_of("contains", "in_subsystem"), t.entities)


@query("grf12_subsystem_members", "SELECT to_id AS subsystem, id, name FROM {edges} e JOIN {entities} m ON m.id = e.from_id AND m.kind = 'module' WHERE e.kind = 'in_subsystem'")
def _(t):
    return G.subsystem_members(t.edges_of("in_subsystem"), t.entities)


PATHS = "WITH RECURSIVE c AS (SELECT DISTINCT from_id, to_id FROM {edges} WHERE kind = 'calls' AND confidence = 'resolved'), p(root, path) AS (SELECT DISTINCT entity_id, [entity_id] FROM {tags} WHERE tag = 'http-route' UNION ALL SELECT root, list_append(path, to_id) FROM p JOIN c ON from_id = path[-1] WHERE len(path) <= 4 AND NOT list_contains(path, to_id)) "


@query("grf13_execution_paths", PATHS + "SELECT root, array_to_string(path, ' > ') AS path FROM p WHERE len(path) > 1")
def _(t):
    roots = t.tags.where("tag = 'http-route'").select(F.col("entity_id").alias("id")).distinct()
    return V.execution_paths(G.expanded_calls(t.edges_of("calls")), roots, 4).select("root", F.array_join("path", " > ").alias("path"))


VISITS = "WITH RECURSIVE c AS (SELECT DISTINCT from_id, to_id FROM (" + AMBIGUOUS_CALLS + ")), n AS (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY to_id) AS k FROM c), v(root, path, place, simple) AS (SELECT id, [id], CAST([] AS BIGINT[]), true FROM {entities} WHERE kind = 'function' UNION ALL SELECT root, list_append(path, to_id), list_append(place, k), NOT list_contains(path, to_id) FROM v JOIN n ON from_id = path[-1] WHERE simple AND len(path) <= 4), r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY place) AS i, count(*) OVER (PARTITION BY root) AS total FROM v WHERE len(path) > 1) "


@query("grf13_budgeted_paths", VISITS + "SELECT root, array_to_string(path, ' > ') AS path, total > 6 AS truncated FROM r WHERE i <= 6 AND simple")
def _(t):
    roots = t.entities.where("kind = 'function'").select("id")
    return V.budgeted_paths(G.expanded_calls(t.edges_of("calls"), "ambiguous"), roots, 4, 6).select("root", F.array_join("path", " > ").alias("path"), "truncated")


@query("grf13_longest_paths", PATHS + "SELECT root, array_to_string(path, ' > ') AS path FROM p WHERE len(path) > 1 ORDER BY len(path) DESC, path LIMIT 200")
def _(t):
    roots = t.tags.where("tag = 'http-route'").select(F.col("entity_id").alias("id")).distinct()
    return V.first_paths(V.execution_paths(G.expanded_calls(t.edges_of("calls")), roots, 4)).select("root", F.array_join("path", " > ").alias("path"))


@query("grf18_circular_imports", f"WITH RECURSIVE e AS (SELECT DISTINCT from_id, to_id FROM {{edges}} WHERE kind = 'imports' AND {RUNTIME}), r(a, b) AS (SELECT from_id, to_id FROM e UNION SELECT a, to_id FROM r JOIN e ON from_id = b), s AS (SELECT x.a, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a) SELECT component, count(*) AS size, array_to_string(list_sort(list(a)), ',') AS members FROM s GROUP BY component")
def _(t):
    return V.circular_imports(t.edges_of("imports")).select("component", "size", F.array_join("members", ",").alias("members"))


LINKS = f"links AS (SELECT from_id, to_id FROM {{edges}} WHERE kind = 'calls' OR (kind = 'imports' AND {RUNTIME}) UNION SELECT from_id, unnest({CANDIDATES}) FROM {{edges}} WHERE kind = 'calls' AND confidence = 'ambiguous')"
START = f"(SELECT entity_id FROM {{tags}} WHERE tag IN {ROOTS} OR tag IN ('dynamic-dispatch', 'reflection'))"
REACH = f"WITH RECURSIVE {LINKS}, reach(id) AS (SELECT entity_id FROM {START} UNION SELECT to_id FROM reach JOIN links ON from_id = reach.id) "


@query("grf19_reachable", REACH + "SELECT DISTINCT id FROM reach")
def _(t):
    start = V.roots_of(t.tags).unionByName(t.tags.where(F.col("tag").isin("dynamic-dispatch", "reflection"))).select(F.col("entity_id").alias("id"))
    return V.reachable(V.live_links(t.edges_of("calls", "imports")), start)


@query("grf20_dead_code", REACH + ", live AS (" + LIVE + f") SELECT id, plugin_id, CASE WHEN short_name IN (SELECT trim(regexp_extract(callee_expr, '([^.:]*)$', 1)) FROM live) THEN 'shielded' WHEN {BLOCK} IS NOT NULL THEN 'blocked' ELSE 'dead' END AS outcome FROM {{entities}} e WHERE kind NOT IN ('file', 'project', 'subsystem', 'guidance', 'module', 'impl') AND id NOT IN (SELECT id FROM reach) AND id NOT IN (SELECT entity_id FROM {{tags}} WHERE tag IN ('framework-handler', 'plugin-hook'))")
def _(t):
    return V.dead_code(t.entities, t.edges_of("calls", "imports"), t.tags, G.targeted_by_sites(t.sites, t.entities))


WEIGHTED = "WITH RECURSIVE g AS (SELECT from_id, to_id, count(*) AS n FROM (SELECT 'm' || CAST(c_nationkey AS VARCHAR) AS from_id, 'm' || CAST(s_nationkey AS VARCHAR) AS to_id FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {customer} ON c_custkey = o_custkey JOIN {supplier} ON s_suppkey = l_suppkey) GROUP BY 1, 2)"


def module_graph(t: Tables) -> DataFrame:
    name = lambda c: F.concat(F.lit("m"), F.col(c).cast("string"))
    rows = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    return rows.groupBy(name("c_nationkey").alias("from_id"), name("s_nationkey").alias("to_id")).agg(F.count("*").alias("reference_count"))


@query("grf22_weighted_components", WEIGHTED + ", b AS (SELECT greatest(1.0, avg(n)) AS bar FROM g WHERE from_id <> to_id), s AS (SELECT from_id AS a, to_id AS b FROM g, b WHERE n >= bar * 1.0 AND from_id <> to_id), u AS (SELECT a, b FROM s UNION SELECT b, a FROM s), r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b), c AS (SELECT a, least(a, min(b)) AS component FROM r GROUP BY a) SELECT component, count(*) AS size FROM c GROUP BY component")
def _(t):
    return V.weighted_components(module_graph(t)).select("component", "size")


@query("agg14_modularity", WEIGHTED + ", m AS (SELECT sum(n) AS m FROM g), o AS (SELECT from_id AS id, sum(n) AS o FROM g GROUP BY 1), i AS (SELECT to_id AS id, sum(n) AS i FROM g GROUP BY 1) SELECT round(sum((n - o * i / m) / m), 9) AS modularity FROM g JOIN o ON o.id = from_id JOIN i ON i.id = to_id, m WHERE length(from_id) = length(to_id)")
def _(t):
    g = module_graph(t)
    groups = g.select(F.col("from_id").alias("id")).union(g.select("to_id")).distinct().select("id", F.length("id").alias("group"))
    return V.modularity(g, groups).select(F.round("modularity", 9).alias("modularity"))


# --- paging and ranking ------------------------------------------------------------------------------


@query("srt02_page", "SELECT id FROM {entities} WHERE kind = 'class' ORDER BY id LIMIT 20 OFFSET 40")
def _(t):
    return L.page(t.entities.where("kind = 'class'").select("id"), [F.col("id")], 20, 40)


@query("srt02_page_facts", "SELECT count(*) AS total, CAST(40 AS BIGINT) AS \"offset\", CAST(20 AS BIGINT) AS \"limit\", CAST(greatest(0, least(20, count(*) - 40)) AS BIGINT) AS returned, count(*) > 60 AS truncated FROM {entities} WHERE kind = 'class'")
def _(t):
    return L.page_facts(t.entities.where("kind = 'class'"), 20, 40)


@query("srt05_edge_order", "SELECT kind, from_id, to_id FROM {edges} ORDER BY kind, from_id, to_id, confidence, coalesce(source_byte_start, -1) LIMIT 500")
def _(t):
    return G.first_edges(t.edges, 500).select("kind", "from_id", "to_id")


@query("srt06_high_churn", "SELECT entity_id, churn_count FROM {churn} ORDER BY churn_count DESC, entity_id LIMIT 50")
def _(t):
    return t.churn.select("entity_id", "churn_count").orderBy(F.col("churn_count").desc_nulls_last(), "entity_id").limit(50)


@query("srt06_recent_change", "SELECT entity_id, last_changed_at FROM {churn} WHERE churn_count >= 1 ORDER BY last_changed_at DESC, entity_id LIMIT 50")
def _(t):
    return t.churn.where("churn_count >= 1").select("entity_id", "last_changed_at").orderBy(F.col("last_changed_at").desc_nulls_last(), "entity_id").limit(50)


for _tag in ("entry-point", "http-route", "data-model", "test", "deprecated", "todo"):

    @query(f"sch13_{_tag.replace('-', '_')}", f"SELECT id FROM {{entities}} WHERE id IN (SELECT entity_id FROM {{tags}} WHERE tag = '{_tag}')")
    def _(t, tag=_tag):
        return L.with_tag(t.entities, t.tags, tag).select("id")
