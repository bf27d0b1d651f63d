"""Upserts, sweeps, run state, freshness and integrity, over immutable snapshots."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphquarry.functions import expr as X
from graphquarry.operators.components import written
from graphquarry.operators.graph import Blocks
from graphquarry.schema import ANCHORED_KINDS, STRUCTURAL_KINDS


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key that is last in order. Aggregated before the shuffle, so repeats of a key do not meet in a task."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r"))
    return best.select(*keys, "__r.*").select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """New rows replace old ones of their key; columns in `keep` stay as the old row has them, null or not.

    order: a column of `new` by which the last of several rows wins.
    """
    if order is not None:
        new = latest(new, keys, order).drop(order)
    columns = old.columns
    a, b = (d.select(*keys, F.struct(*(c for c in columns if c not in keys)).alias(s)) for d, s in ((old, "__o"), (new, "__n")))
    both = a.join(b, keys, "full")
    first = lambda x, y, c: F.when(F.col(x).isNotNull(), F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}"))
    value = lambda c: first("__o", "__n", c) if c in keep else first("__n", "__o", c)
    return both.select(*(F.col(c) if c in keys else value(c).alias(c) for c in columns))


def upsert_findings(old: DataFrame, new: DataFrame) -> DataFrame:
    """What people decided about a finding stays: status, reason, issue and creation time."""
    return upsert(old, new, ["id"], tuple(c for c in ("status", "suppression_reason", "issue_id", "created_at") if c in old.columns))


def replace_tags(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tags of an entity by a plugin are replaced as a whole."""
    return old.join(new.select("entity_id", "plugin_id").distinct(), ["entity_id", "plugin_id"], "left_anti").unionByName(new)


def replace_for(old: DataFrame, new: DataFrame, key: str, touched: DataFrame, only: Column | None = None) -> DataFrame:
    """Rows of touched keys go (those that `only` holds for), and the new ones come."""
    marked = old.where(only) if only is not None else old
    gone = written(touched.select(key).distinct())  # its size is known then: few keys go to the rows, and the rows stay where they are
    rest = marked.join(gone, key, "left_anti").select(*old.columns)
    other = old.where(~F.coalesce(only, F.lit(False))) if only is not None else None
    return (rest if other is None else rest.unionByName(other)).unionByName(new)


def replace_anchored_edges(edges: DataFrame, new: DataFrame, files: DataFrame, key: str = "source_file_id") -> DataFrame:
    return replace_for(edges, new, key, files, F.col("kind").isin(*ANCHORED_KINDS))


def replace_anchored_blocks(blocks: Blocks, files: DataFrame, key: str = "source_file_id") -> Blocks:
    """What stays of edges that are given by blocks, whose sources have the file: a file's sources go with all of their edges, and none is made."""
    if blocks.kind not in ANCHORED_KINDS:
        return blocks
    return replace(blocks, sources=blocks.sources.join(files.select(key).distinct(), key, "left_anti"))


def reconcile_blocks(entities: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Entities with `briefing_blocked` set or taken off by their file's verdict (source_file_path, reason, null: open)."""
    rows = entities.join(verdicts.select("source_file_path", F.col("reason").alias("__reason"), F.lit(True).alias("__seen")), "source_file_path", "left")
    fields = F.from_json("properties", "map<string,string>")
    kept = F.map_filter(F.coalesce(fields, F.create_map().cast("map<string,string>")), lambda k, v: k != "briefing_blocked")
    made = F.when(F.col("__reason").isNotNull(), F.map_concat(kept, F.create_map(F.lit("briefing_blocked"), F.col("__reason")))).otherwise(kept)
    new = F.when(F.col("__seen") & X.is_json(F.coalesce("properties", F.lit("{}"))), F.to_json(made)).otherwise(F.col("properties"))
    return rows.withColumn("properties", new).select(*entities.columns)


def insert_inferred(edges: DataFrame, inferred: DataFrame) -> DataFrame:
    """Inferred calls join those known, where no call between the two is known yet; earlier inferred ones of the callers go."""
    stale = inferred.select("from_id").distinct()
    ours = (F.col("kind") == "calls") & (F.col("confidence") == "inferred")
    kept = edges.where(~ours).unionByName(edges.where(ours).join(stale, "from_id", "left_anti").select(*edges.columns))
    new = inferred.dropDuplicates(["kind", "from_id", "to_id"]).join(kept.select("kind", "from_id", "to_id"), ["kind", "from_id", "to_id"], "left_anti")
    return kept.unionByName(new.select(*edges.columns))


def edge_violations(edges: DataFrame) -> DataFrame:
    """(kind, from_id, to_id, reason): edges that break their kind's contract."""
    kind, span = F.col("kind"), F.col("source_byte_start")
    reason = (
        F.when(kind.isin(*STRUCTURAL_KINDS) & (F.col("confidence") != "resolved"), "structural_not_resolved")
        .when(kind.isin(*STRUCTURAL_KINDS) & span.isNotNull(), "structural_with_span")
        .when(kind.isin(*ANCHORED_KINDS) & span.isNull(), "anchored_without_span")
        .when(kind.isin(*ANCHORED_KINDS) & (F.col("confidence") == "inferred"), "inferred_at_scan")
        .when(~kind.isin(*STRUCTURAL_KINDS, *ANCHORED_KINDS), "unknown_kind")
    )
    return edges.select("kind", "from_id", "to_id", reason.alias("reason")).where("reason is not null")


def finding_anchors(entities: DataFrame) -> DataFrame:
    """(source_file_path, entity_id): what findings of a file are hung on: a module, else what a plugin made, else the core's file; then the least id."""
    rank = F.when(F.col("kind") == "module", 0).when(F.col("plugin_id") != "core", 1).otherwise(2)
    rows = entities.where(F.col("source_file_path").isNotNull())
    return rows.groupBy("source_file_path").agg(F.min_by("id", F.struct(rank, "id")).alias("entity_id"))


def last_collision(findings: DataFrame, rule_id: str) -> DataFrame:
    """(entity_id, paths, shape): of each entity the collision (of this rule) last updated, with its files in order, each once.

    Evidence that cannot be read gives no paths and no shape.
    """
    last = findings.where(F.col("rule_id") == rule_id).groupBy("entity_id").agg(F.max_by("evidence", F.struct("updated_at", "id")).alias("e"))
    field = lambda name: F.get_json_object("e", f"$.metadata.{name}")
    named = F.filter(F.array(field("first_source_file_path"), field("colliding_source_file_path")), lambda x: x.isNotNull() & (x != ""))
    return last.select("entity_id", F.array_sort(F.array_distinct(named)).alias("paths"), field("shape").alias("shape"))


def prior_snapshot(entities: DataFrame, prior: DataFrame) -> DataFrame:
    """(path, hash, locators): each file of the run before with its whole hash, where it is known (prior: path, hash), and the ids that it had."""
    had = entities.where(F.col("source_file_path").isNotNull()).groupBy(F.col("source_file_path").alias("path")).agg(F.array_sort(F.collect_list("id")).alias("locators"))
    return had.join(prior.select("path", "hash"), "path", "left").select("path", "hash", "locators")


def parent_mismatches(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, parent_id, from_id): where an entity's parent and its `contains` edge do not agree."""
    held = edges.where("kind = 'contains'").select(F.col("to_id").alias("id"), "from_id")
    both = entities.select("id", "parent_id").join(held, "id", "full")
    return both.where(~F.col("parent_id").eqNullSafe(F.col("from_id"))).select("id", "parent_id", "from_id")


def ready_edges(edges: DataFrame, entities: DataFrame, ready: bool = True, blocks: Blocks | None = None) -> DataFrame:
    """Edges whose two ends exist, or with ready=False those that wait.

    Ends are made distinct before they are looked up, so that the edges themselves are not sent to the entities.
    Edges of blocks come as (kind, from_id, to_id) alone, and so do the others then; none is made that is not asked for.
    """
    if blocks is not None:
        names = ["kind", "from_id", "to_id"]
        return reduce(DataFrame.unionByName, (b.edges().select(*names) for b in ready_blocks(blocks, entities, ready)), ready_edges(edges, entities, ready).select(*names))
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).where("id is not null").distinct()
    lost = written(ends.join(entities.select("id"), "id", "left_anti"))  # few as a rule; then edges meet them where they are
    out = edges
    for end in ("from_id", "to_id"):
        out = out.join(lost.select(F.col("id").alias(end), F.lit(True).alias(f"__lost_{end}")), end, "left")
    waits = F.col("from_id").isNull() | F.col("to_id").isNull() | F.col("__lost_from_id").isNotNull() | F.col("__lost_to_id").isNotNull()
    return out.where(~waits if ready else waits).select(*edges.columns)


def ready_blocks(blocks: Blocks, entities: DataFrame, ready: bool) -> list[Blocks]:
    """The blocks cut to the ends that make edges that are ready, or that wait: those from lost sources, and those from the others to lost targets."""
    ids = lambda end: entities.select(F.col("id").alias(end))
    found, lost = (blocks.sources.join(ids("from_id"), "from_id", how) for how in ("left_semi", "left_anti"))
    if ready:
        return [replace(blocks, sources=found, targets=blocks.targets.join(ids("to_id"), "to_id", "left_semi"))]
    waiting = blocks.targets.join(ids("to_id"), "to_id", "left_anti")
    return [replace(blocks, sources=lost), replace(blocks, sources=found, targets=waiting)]


def sweep_stale(findings: DataFrame, run_id: str) -> DataFrame:
    """Findings without the open, unlinked ones of other runs."""
    stale = (F.col("status") == "open") & F.col("issue_id").isNull() & (F.col("run_id") != run_id)
    return findings.where(~F.coalesce(stale, F.lit(False)))


def sweep_rules(findings: DataFrame, run_id: str, rules: DataFrame, entities: DataFrame, files: DataFrame) -> DataFrame:
    """The same, but only for rules (rule_id) and for entities of examined files (source_file_path). Empty lists retire nothing."""
    looked = entities.join(files, "source_file_path", "left_semi").select(F.col("id").alias("entity_id"))
    stale = findings.where((F.col("status") == "open") & F.col("issue_id").isNull() & (F.col("run_id") != run_id)).join(rules, "rule_id", "left_semi").join(looked, "entity_id", "left_semi")
    return findings.join(stale.select("id"), "id", "left_anti").select(*findings.columns)


def deletion_findings(entities: DataFrame, deleted_files: DataFrame, run_id: str) -> DataFrame:
    rows = entities.join(deleted_files, "source_file_path", "left_semi")
    return rows.select(F.concat(F.lit("deleted:"), "id").alias("id"), F.lit(run_id).alias("run_id"), F.lit("ENTITY-DELETED").alias("rule_id"), F.col("id").alias("entity_id"))


def collisions(descriptors: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """(id, shape, paths): ids found more than once: in one file, in several, or in another file in the run before.

    descriptors and prior: (id, path). One row for each id.
    """
    now = descriptors.groupBy("id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("path")).alias("paths"))
    if prior is not None:
        now = now.join(prior.groupBy("id").agg(F.min("path").alias("__old")), "id", "left")
    else:
        now = now.withColumn("__old", F.lit(None).cast("string"))
    moved = F.col("__old").isNotNull() & ~F.array_contains("paths", F.col("__old"))
    shape = F.when((F.col("n") > 1) & (F.size("paths") > 1), "cross_file").when(F.col("n") > 1, "same_file").when(moved, "cross_run")
    paths = F.when(moved & (F.col("n") == 1), F.array_sort(F.array_union("paths", F.array("__old")))).otherwise(F.col("paths"))
    return now.select("id", shape.alias("shape"), paths.alias("paths")).where("shape is not null")


def fail_stale_runs(runs: DataFrame, oldest: str) -> DataFrame:
    """Running runs whose heartbeat is missing or before `oldest` count as failed."""
    stale = (F.col("status") == "running") & (F.col("heartbeat_at").isNull() | (F.col("heartbeat_at") < oldest))
    return runs.withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))


def last_run(runs: DataFrame, completed: bool = False, with_commit: bool = False, other_than: str | None = None) -> DataFrame:
    rows = runs.where("status = 'completed'") if completed else runs
    rows = rows.where("analyzed_at_commit is not null") if with_commit else rows
    rows = rows if other_than is None else rows.where(F.col("id") != other_than)
    return rows.agg(F.max_by(F.struct(*runs.columns), F.struct("started_at", "id")).alias("r")).where("r is not null").select("r.*")


def needs_work(files: DataFrame, prior: DataFrame, plugin_changed: bool = False) -> DataFrame:
    """(path, work): whether a file (path, hash) differs from the run before, or is in doubt."""
    rows = files.join(prior.select("path", F.col("hash").alias("__old")), "path", "left")
    same = F.col("hash").isNotNull() & F.col("hash").eqNullSafe(F.col("__old"))
    return rows.select("path", (F.lit(plugin_changed) | ~same).alias("work"))


def freshness(analyzed_at: Column, commit: Column, head: Column, head_at: Column, modified: Column, dirty: Column, untracked: Column, observed: Column) -> Column:
    """never_analyzed, drift, stale_worktree, fresh or unknown. A missing file is no drift.

    commit, head: commits analysed and current; head_at: the current one's time; modified, dirty: counts of
    indexed files changed since or staged; observed: whether any indexed file could be looked at.
    """
    mismatch = head != commit
    newer = X.unix_seconds(head_at) > X.unix_seconds(analyzed_at)
    drift = F.coalesce(mismatch, F.coalesce(newer, F.lit(False))) | (F.coalesce(modified, F.lit(0)) > 0) | (F.coalesce(dirty, F.lit(0)) > 0)
    seen = F.coalesce(observed, F.lit(False)) | mismatch.isNotNull() | newer.isNotNull()
    return F.when(analyzed_at.isNull(), "never_analyzed").when(drift, "drift").when(F.coalesce(untracked, F.lit(False)), "stale_worktree").when(seen, "fresh").otherwise("unknown")


def repair(entities: DataFrame, files: DataFrame) -> DataFrame:
    """Entities of files that exist (source_file_path), without links to parents that went with the others."""
    kept = entities.where("source_file_path is null").unionByName(entities.where("source_file_path is not null").join(files, "source_file_path", "left_semi").select(*entities.columns))
    alive = kept.select(F.col("id").alias("parent_id"), F.lit(True).alias("__alive"))
    return kept.join(alive, "parent_id", "left").withColumn("parent_id", F.when(F.col("__alive"), F.col("parent_id"))).select(*entities.columns)


def collapse_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Imports whose target is known: `from X import sub` means module X.sub if there is one.

    imports: (from_id, to_id, imported_name, level); modules: (id).
    """
    inner = F.when((F.col("level") == 0) & F.col("imported_name").isNotNull(), F.concat_ws(".", "to_id", "imported_name"))
    rows = imports.withColumn("__inner", inner)
    a = modules.select(F.col("id").alias("__inner"), F.lit(True).alias("__has"))
    rows = rows.join(a, "__inner", "left").withColumn("to_id", F.when(F.col("__has"), F.col("__inner")).otherwise(F.col("to_id")))
    return rows.join(modules.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(*imports.columns)


def tier_consensus(rows: DataFrame) -> DataFrame:
    """(subsystem, members, tiers, verdict) of rows (subsystem, tier)."""
    sums = rows.where("tier is not null").groupBy("subsystem").agg(F.count("*").alias("members"), F.count_distinct("tier").alias("tiers"))
    return sums.withColumn("verdict", F.when((F.col("members") >= 2) & (F.col("tiers") >= 2), "mixing").when(F.col("tiers") == 1, "unanimous"))


def wire_findings(findings: DataFrame, entities: DataFrame, default_path: str | None = None) -> DataFrame:
    """(id, wire): findings as JSON for a tracker; without a path or a default they are left out."""
    at = entities.select(F.col("id").alias("entity_id"), F.coalesce("source_file_path", F.lit(default_path).cast("string")).alias("path"), "source_line_start", "source_line_end")
    rows = findings.join(at, "entity_id", "left").where("path is not null")
    wire = F.to_json(F.struct("path", "rule_id", "message", X.wire_severity(F.col("severity")).alias("severity"), F.col("source_line_start").alias("line_start"), F.col("source_line_end").alias("line_end")))
    return rows.select("id", wire.alias("wire"))


def issues(associations: DataFrame, entities: DataFrame, cap: int | None = None) -> DataFrame:
    """(issue_id, entity_id, state) of associations (issue_id, entity_id, content_hash, seq): not_found, matched, drifted or unknown; the first of each issue.

    cap: the first so many by seq, as a tool shows; None: all.
    """
    one = associations.groupBy("issue_id").agg(F.min_by(F.struct("entity_id", "content_hash"), "seq").alias("a"), F.min("seq").alias("seq")).select("issue_id", "a.*", "seq")
    e = entities.select(F.col("id").alias("entity_id"), F.col("content_hash").alias("__now"), F.lit(True).alias("__known"))
    state = F.when(F.col("__known").isNull(), "not_found").when(F.col("__now").isNull(), "unknown").when(F.col("__now").eqNullSafe(F.col("content_hash")), "matched").otherwise("drifted")
    rows = one.join(e, "entity_id", "left")
    return (rows if cap is None else rows.orderBy("seq", "issue_id").limit(cap)).select("issue_id", "entity_id", state.alias("state"))
