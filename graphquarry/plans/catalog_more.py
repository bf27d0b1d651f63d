"""Registered queries of guidance, caches, runs and scopes, and of extraction over generated sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphquarry.functions import expr as X
from graphquarry.operators import graph as G
from graphquarry.operators import guidance as U
from graphquarry.operators import lifecycle as C
from graphquarry.operators import lookup as L
from graphquarry.operators import search as S
from graphquarry.operators import traverse as V
from graphquarry.plans.catalog import BLOCK, query
from graphquarry.sources import python_code as P
from graphquarry.sources import tree

RULES = "id string, expires string, match_rules array<struct<type:string,pattern:string,value:string,id:string>>, content string, scope_rank int, authored_at string"


def sheets(t):
    rows = [
        ("g1", None, [("path", "src/r1/**", None, None)], "Mind region one.", 3, "2024-01-01"),
        ("g2", None, [("kind", None, "class", None), ("tag", None, "todo", None)], "Classes are data.", 5, None),
        ("g3", "2020-01-01T00:00:00Z", [("kind", None, "module", None)], "Expired.", 1, None),
        ("g4", None, [("entity", None, None, "lib:function:p3"), ("subsystem", None, None, "core:subsystem:r2")], "One part.", None, "2023-05-05"),
    ]
    return t.spark.createDataFrame(rows, RULES)


def facts(t):
    e = t.entities.select(F.col("id").alias("entity_id"), "kind", F.col("source_file_path").alias("path"))
    tags = L.tags_of(t.tags)
    sub = V.subsystem_of(t.edges_of("contains", "in_subsystem"), t.entities).select(F.col("id").alias("entity_id"), "subsystem")
    return e.join(tags, "entity_id", "left").join(sub, "entity_id", "left")


def matched(t):
    return U.matching(sheets(t), facts(t), t.spark.createDataFrame([("g1", "lib:function:p5")], "sheet string, entity_id string"), "2024-06-01T00:00:00Z")


MATCHED = """WITH RECURSIVE anc(id, module, depth) AS (SELECT id, id, 0 FROM {entities} UNION ALL SELECT anc.id, e.from_id, depth + 1 FROM anc JOIN {edges} e ON e.kind = 'contains' AND e.to_id = anc.module WHERE depth < 32),
sub AS (SELECT anc.id, arg_min(s.to_id, depth) AS subsystem FROM anc JOIN {edges} s ON s.kind = 'in_subsystem' AND s.from_id = module GROUP BY anc.id),
m AS (SELECT id AS entity_id, 'g1' AS sheet, 'path' AS w FROM {entities} WHERE source_file_path = 'src/r1' OR starts_with(source_file_path, 'src/r1/')
 UNION ALL SELECT id, 'g2', 'kind' FROM {entities} WHERE kind = 'class' UNION ALL SELECT entity_id, 'g2', 'tag' FROM {tags} WHERE tag = 'todo'
 UNION ALL SELECT id, 'g4', 'entity' FROM {entities} WHERE id = 'lib:function:p3' UNION ALL SELECT id, 'g4', 'subsystem' FROM sub WHERE subsystem = 'core:subsystem:r2' UNION ALL SELECT 'lib:function:p5', 'g1', 'guides') """


@query("sch08_guidance", MATCHED + "SELECT entity_id, sheet, array_to_string(list_sort(list(DISTINCT w)), ',') AS matched_by FROM m GROUP BY entity_id, sheet")
def _(t):
    return matched(t).select("entity_id", "sheet", F.array_join("matched_by", ",").alias("matched_by"))


@query("sch09_guidance_expiry", "SELECT id, CASE WHEN id LIKE '%1' THEN true ELSE false END AS by_time, CASE WHEN id LIKE '%1' THEN true ELSE false END AS by_text FROM (SELECT 's' || CAST(r_regionkey AS VARCHAR) AS id FROM {region})")
def _(t):
    rows = t.region.select(F.concat(F.lit("s"), F.col("r_regionkey").cast("string")).alias("id"), F.when(F.col("r_regionkey") == 1, "2020-01-01T00:00:00Z").otherwise("2030-01-01T00:00:00Z").alias("expires"))
    now = F.lit("2024-06-01T00:00:00Z")
    return rows.select("id", U.expired(F.col("expires"), now).alias("by_time"), U.expired_as_text(F.col("expires"), now).alias("by_text"))


@query("sch10_invalidated_summaries", "SELECT id AS entity_id FROM {entities} WHERE NOT starts_with(source_file_path, 'src/r1/') AND id <> 'lib:function:p5'")
def _(t):
    return U.invalidated(t.entities.select(F.col("id").alias("entity_id")), matched(t), "g1")


@query("mis07_composed_guidance", MATCHED + ", c AS (SELECT entity_id, sheet, CASE sheet WHEN 'g1' THEN 'Mind region one.' WHEN 'g2' THEN 'Classes are data.' ELSE 'One part.' END AS content, CASE sheet WHEN 'g1' THEN 1 WHEN 'g2' THEN 2 ELSE 3 END AS o FROM (SELECT DISTINCT entity_id, sheet FROM m)) SELECT entity_id, string_agg(content, chr(10) || chr(10) ORDER BY o) AS text, sha256(string_agg(content, chr(10) || chr(10) ORDER BY o)) AS fingerprint FROM c GROUP BY entity_id")
def _(t):
    return U.composed(matched(t), sheets(t))


@query("sch06_summary_state", "WITH c AS (SELECT to_id AS entity_id, count(DISTINCT from_id) AS callers FROM {edges} WHERE kind = 'calls' AND confidence = 'resolved' GROUP BY to_id) SELECT id AS entity_id, CASE WHEN source_line_start % 4 = 0 THEN 'expired' WHEN abs(coalesce(callers, 0) - 20) * 2 > 20 THEN 'stale' ELSE 'fresh' END AS state FROM {entities} LEFT JOIN c ON c.entity_id = id")
def _(t):
    made = F.when(F.col("source_line_start") % 4 == 0, "2023-01-01T00:00:00Z").otherwise("2024-05-30T00:00:00Z")
    cache = t.entities.select(F.col("id").alias("entity_id"), made.alias("created_at"), F.lit(20).alias("caller_count"))
    callers = G.expanded_calls(t.edges_of("calls")).groupBy(F.col("to_id").alias("entity_id")).agg(F.count_distinct("from_id").alias("callers"))
    return S.summary_state(cache, "2024-06-01", 30, callers)


@query("mis15_open_anchors", f"SELECT id FROM {{entities}} WHERE {BLOCK} IS NULL AND content_hash = md5(name)")
def _(t):
    e = t.entities
    return e.where(X.block_reason(F.col("properties")).isNull() & (F.col("content_hash") == F.md5("name"))).select("id")


@query("mis17_counts", "SELECT (SELECT count(*) FROM {bindings} WHERE status = 'alive') AS alive, (SELECT count(*) FROM {embeddings}) AS vectors")
def _(t):
    return t.bindings.agg(F.count_if(F.col("status") == "alive").alias("alive")).crossJoin(t.embeddings.agg(F.count("*").alias("vectors")))  # two rows of counts


@query("mis09_untracked", "SELECT 'src/new/' || CAST(n_nationkey AS VARCHAR) || '.py' AS path FROM {nation}")
def _(t):
    name = lambda folder, end: F.concat(F.lit(folder), F.col("n_nationkey").cast("string"), F.lit(end)).alias("path")
    paths = t.nation.select(name("src/new/", ".py")).unionByName(t.nation.select(name("doc/", ".md"))).unionByName(t.entities.select(F.col("source_file_path").alias("path")).distinct())
    return tree.untracked(paths, t.entities)


@query("grf17_unresolved_why", "SELECT site_key, CASE WHEN contains(callee_expr, '.') THEN 'attribute-receiver' ELSE 'dynamic' END AS why FROM {sites}")
def _(t):
    return t.sites.select("site_key", X.unresolved_why(F.col("callee_expr")).alias("why"))


@query("lif05_stale_guidance", "SELECT 's' || CAST(n_nationkey AS VARCHAR) AS sheet, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 25 ELSE 60 END AS BIGINT) AS churn FROM {nation} WHERE n_nationkey % 2 = 1 OR n_nationkey % 3 = 0")
def _(t):
    even = F.col("n_nationkey") % 2 == 0
    rows = t.nation.select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("sheet"), F.when(even, 25).otherwise(60).cast("long").alias("churn_count"), (F.col("n_nationkey") % 3 == 0).alias("pinned"))
    return U.churned(rows)


@query("ext14_validation", "SELECT id, 'UNDECLARED-KIND' AS rule_id FROM {entities} WHERE kind = 'module'")
def _(t):
    return P.problems(t.entities, ("class", "function"))


@query("set04_difference", "SELECT id FROM {entities} WHERE id NOT IN (SELECT current_locator FROM {bindings} WHERE status = 'alive') AND id NOT IN (SELECT entity_id FROM {tags})")
def _(t):
    a = t.bindings.where("status = 'alive'").select(F.col("current_locator").alias("id"))
    return t.entities.select("id").join(a, "id", "left_anti").join(t.tags.select(F.col("entity_id").alias("id")), "id", "left_anti")


@query("win03_last_write", "SELECT user_id, max(event_id) AS event_id FROM {events} GROUP BY user_id")
def _(t):
    return C.latest(t.events.select("user_id", "event_id", F.col("event_id").alias("seq")), ["user_id"], "seq").select("user_id", "event_id")
