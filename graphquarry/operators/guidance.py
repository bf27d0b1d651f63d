"""Guidance sheets: which apply to an entity, which are stale or expired, and their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphquarry.functions import expr as X
from graphquarry.operators.components import written
from graphquarry.schema import SCOPE_RANKS

RULES = "array<struct<type:string,pattern:string,value:string,id:string>>"


def sheets(entities: DataFrame, tags: DataFrame) -> DataFrame:
    """Guidance entities with the fields of their properties, their rank, and their tags."""
    p = F.col("properties")
    field = lambda name: F.get_json_object(p, f"$.{name}")
    level = field("scope_level")
    rank = F.lit(None).cast("int")
    for name, n in SCOPE_RANKS.items():
        rank = F.when(level == name, F.lit(n)).otherwise(rank)
    own = tags.groupBy(F.col("entity_id").alias("id")).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    rows = entities.where("kind = 'guidance'").select("id", level.alias("scope_level"), rank.alias("scope_rank"), field("content").alias("content"), field("expires").alias("expires"), F.coalesce(field("pinned").isin("true", "1"), F.lit(False)).alias("pinned"), field("authored_at").alias("authored_at"), F.from_json(field("match_rules"), RULES).alias("match_rules"))
    return rows.join(own, "id", "left")


def expired(expires: Column, now: Column) -> Column:
    """By time: both as seconds. What cannot be read does not expire."""
    return F.coalesce(X.unix_seconds(expires) < X.unix_seconds(now), F.lit(False))


def expired_as_text(expires: Column, now: Column) -> Column:
    """As the analysis pass compares: by text."""
    return F.coalesce(expires < now, F.lit(False))


def glob_trie(globs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, seg, child, regex), (node, sheet)): the steps of all patterns (sheet, pattern) as one trie of segments, and where sheets end.

    A node is what stands before it, from `^` on. regex is null for literal segments and for `**`, which is written once where it stands several times in a row.
    """
    segs = F.split("pattern", "/", -1)
    segs = F.filter(segs, lambda x, i: ~((x == "**") & (i > 0) & (F.get(segs, i - 1) == "**")))
    rows = globs.select("sheet", segs.alias("s")).select("sheet", "s", F.posexplode("s").alias("i", "seg"))
    name = lambda n: F.concat_ws("/", F.lit("^"), F.slice("s", 1, n))
    literal = F.regexp_replace("seg", r"([.+^$(){}|\[\]\\])", r"\\$1")
    regex = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(literal, r"\*", "[^/]*"), r"\?", "[^/]"), F.lit("$"))
    steps = rows.select(name(F.col("i")).alias("node"), "seg", name(F.col("i") + 1).alias("child"), F.when((F.col("seg") != "**") & F.col("seg").rlike(r"[*?]"), regex).alias("regex")).distinct()
    return written(steps), written(rows.select(F.concat_ws("/", F.lit("^"), "s").alias("node"), "sheet").distinct())


def glob_hits(paths: DataFrame, globs: DataFrame) -> DataFrame:
    """(path, sheet): paths that a pattern (sheet, pattern) fits; `*` and `?` stay within a segment, `**` is any number of whole ones.

    Paths walk down the trie of all patterns, a segment in each round: literal segments are an equi-join on node and segment, and only
    the wildcards that stand at a path's own node are tried on it. So ten thousand patterns of one shape, as `**/name.py`, cost
    a path no more than one, and no path meets all patterns. As many rounds as the longest path has segments.
    """
    steps, ends = glob_trie(globs)
    exact, wild = steps.where("regex is null and seg <> '**'").select("node", "seg", "child"), steps.where("regex is not null").select("node", "regex", "child")
    anys = steps.where("seg = '**'").select("node", "child")
    opened = lambda rows: rows.unionByName(rows.join(anys, "node").select("path", "s", F.col("child").alias("node"))).distinct()
    at = written(opened(paths.select("path", F.split("path", "/", -1).alias("s"), F.lit("^").alias("node"))))
    found, n = None, 0
    while True:
        done = at.where(F.size("s") == n).join(ends, "node").select("path", "sheet")
        found, left = done if found is None else found.unionByName(done), at.where(F.size("s") > n)
        if left.isEmpty():
            return found.distinct()
        here = left.select("path", "s", "node", F.get("s", F.lit(n)).alias("seg"))
        new = here.join(exact, ["node", "seg"]).select("path", "s", F.col("child").alias("node"))
        new = new.unionByName(here.join(wild, "node").where(F.expr("rlike(seg, regex)")).select("path", "s", F.col("child").alias("node")))
        stay = here.where(F.col("node").endswith("/**")).select("path", "s", "node")
        at, n = written(opened(new.unionByName(stay))), n + 1


def matching(sheets: DataFrame, facts: DataFrame, guides: DataFrame, now: str) -> DataFrame:
    """(entity_id, sheet, matched_by): sheets that guide an entity by an edge or by a rule, expired ones left out.

    facts: (entity_id, kind, path, tags, subsystem); guides: (sheet, entity_id). Rules by tag, kind,
    subsystem and entity are equi-joins; path globs are those of `glob_hits`.
    """
    live = sheets.where(~expired(F.col("expires"), F.lit(now)))
    rules = live.select(F.col("id").alias("sheet"), F.explode("match_rules").alias("r")).select("sheet", "r.*")
    edge = guides.join(live.select(F.col("id").alias("sheet")), "sheet", "left_semi").select("entity_id", "sheet", F.lit("guides").alias("by"))
    parts = [edge]
    for name, key, want in (("kind", F.col("kind"), "value"), ("subsystem", F.col("subsystem"), "id"), ("entity", F.col("entity_id"), "id"), ("tag", F.explode_outer("tags"), "value")):
        left = facts.select("entity_id", key.alias("__key"))
        parts.append(left.join(rules.where(F.col("type") == name).select("sheet", F.col(want).alias("__key")), "__key").select("entity_id", "sheet", F.lit(name).alias("by")))
    paths = facts.where("path is not null").select("path").distinct()  # a file once, however much is in it
    hit = glob_hits(paths, rules.where("type = 'path' and pattern is not null").select("sheet", "pattern"))
    of_path = facts.where("path is not null").select("entity_id", "path")
    parts.append(of_path.join(hit, "path").select("entity_id", "sheet", F.lit("path").alias("by")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("entity_id", "sheet").agg(F.array_sort(F.collect_set("by")).alias("matched_by"))


def order() -> list[Column]:
    """Broad scopes first, those without one last; then by when they were authored, unknown first; then by id."""
    return [F.coalesce("scope_rank", F.lit(2147483647)), F.col("authored_at").asc_nulls_first(), F.col("id")]


def ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*order())


def placed(rows: DataFrame) -> DataFrame:
    """The sheets with their place in order, from 1. Sheets are few: all of them are one window."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order())).cast("long"))


def composed(matched: DataFrame, sheets: DataFrame) -> DataFrame:
    """(entity_id, text, fingerprint): contents of an entity's sheets in order, a blank line between."""
    rows = matched.join(sheets.select(F.col("id").alias("sheet"), "content", "scope_rank", "authored_at"), "sheet")
    key = F.struct(F.coalesce("scope_rank", F.lit(2147483647)).alias("r"), F.col("authored_at").alias("a"), F.col("sheet").alias("s"), F.col("content").alias("c"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["c"]), "\n\n")
    return rows.groupBy("entity_id").agg(text.alias("text")).withColumn("fingerprint", F.sha2("text", 256))


def churned(rows: DataFrame, limit: int = 50, pinned_limit: int = 20) -> DataFrame:
    """(sheet, churn) of sheets whose entities changed at least 50 times, 20 if pinned."""
    sums = rows.groupBy("sheet").agg(F.sum("churn_count").alias("churn"), F.max("pinned").alias("p"))
    return sums.where(F.col("churn") >= F.when(F.col("p"), pinned_limit).otherwise(limit)).select("sheet", "churn")


def invalidated(cache: DataFrame, matched: DataFrame, sheet: str) -> DataFrame:
    """The summary cache without entries of entities that the sheet guides."""
    return cache.join(matched.where(F.col("sheet") == sheet).select("entity_id"), "entity_id", "left_anti")
