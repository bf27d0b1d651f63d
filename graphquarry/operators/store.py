"""Runs, caches, prior indexes, guidance sheets, cursors and paths, as transformations of immutable tables."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphquarry.functions import expr as X
from graphquarry.operators import graph as G
from graphquarry.operators import lifecycle as C
from graphquarry.operators import lookup as L
from graphquarry.schema import SCHEMA_VERSION, SCOPE_RANKS

#: The most rows that interactive tools look at. Operators take None, so batch work sees all; pass these for a tool's answer.
SCAN_CAPS = {"facets": 50_000, "edges": 500_000, "entities": 500_000, "vectors": 200_000, "find_offset": 100_000, "scope": 50_000, "stats": 20_000, "guidance": 2_000}


def capped(rows: DataFrame, order: list[Column], what: str | None = None) -> DataFrame:
    """The first rows in order that a tool looks at, and one more, which tells that there are more. Without a name, all."""
    return rows.orderBy(*order) if what is None else rows.orderBy(*order).limit(SCAN_CAPS[what] + 1)


def cursor_page(rows: DataFrame, order: list[Column], limit: int, cursor: int = 0, most: int = 500) -> DataFrame:
    """A page with next_cursor on every row (null on the last page), found by asking for one row more than fits."""
    limit, cursor = max(1, min(limit, most)), max(0, cursor)
    probe = rows.orderBy(*order).offset(cursor).limit(limit + 1)
    n = F.row_number().over(Window.orderBy(*order))  # over the page alone, limit + 1 rows
    more = F.count("*").over(Window.partitionBy()) > limit
    return probe.select("*", n.alias("__n"), F.when(more, F.lit(cursor + limit)).cast("long").alias("next_cursor")).where(F.col("__n") <= limit).drop("__n")


def inside(root: str, path: Column) -> Column:
    """The path relative to the root, or null where it leaves it. `.` and `..` and doubled slashes are worked out; nothing is read.

    Absolute paths must lie below the root. A path that is the root itself has an empty relative one.
    """
    base = [p for p in posixpath.normpath(root).split("/") if p]
    absolute = path.startswith("/")
    full = F.when(absolute, path).otherwise(F.concat(F.lit("/" + "/".join(base) + "/"), path))
    step = lambda a, p: F.when(p.isin("", "."), a).when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p))
    parts = F.aggregate(F.split(full, "/"), F.array().cast("array<string>"), step)
    below = F.slice(parts, F.lit(1), F.lit(len(base))) == F.array(*(F.lit(p) for p in base)).cast("array<string>")
    return F.when(below, F.array_join(F.slice(parts, F.lit(len(base) + 1), F.size(parts) + 1), "/"))


# --- runs --------------------------------------------------------------------------------------------


def run_states(events: DataFrame) -> DataFrame:
    """(id, status, started_at, completed_at, reason, heartbeat_at) of runs after their events (run_id, seq, action, at, reason).

    begin starts a run; beat refreshes it; complete, skip (no plugins), fail and lost (the writer's channel
    closed) end it; cancel fails a run that is running; resume takes one up again that is not completed.
    What comes after an end, resume apart, changes nothing. A run's events are few, and folded in their order.
    """
    ended = {"complete": "completed", "skip": "skipped_no_plugins", "fail": "failed", "lost": "failed", "cancel": "failed"}
    fields = ("status", "started_at", "completed_at", "reason", "heartbeat_at")
    start = F.struct(*(F.lit(None).cast("string").alias(f) for f in fields))
    made = lambda s, **new: F.struct(*(new.get(f, s[f]).cast("string").alias(f) for f in fields))
    null = F.lit(None)

    def step(s: Column, e: Column) -> Column:
        running = s["status"] == "running"
        out = F.when((e["action"] == "begin") & s["status"].isNull(), made(s, status=F.lit("running"), started_at=e["at"], heartbeat_at=e["at"]))
        out = out.when((e["action"] == "resume") & s["status"].isNotNull() & (s["status"] != "completed"), made(s, status=F.lit("running"), completed_at=null, reason=null, heartbeat_at=e["at"]))
        out = out.when((e["action"] == "beat") & running, made(s, heartbeat_at=e["at"]))
        for action, status in ended.items():
            reason = F.coalesce(e["reason"], F.lit({"lost": "channel closed", "cancel": "cancelled"}.get(action)).cast("string"))
            out = out.when((e["action"] == action) & running, made(s, status=F.lit(status), completed_at=e["at"], reason=reason))
        return out.otherwise(s)

    rows = events.groupBy(F.col("run_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("seq", "action", "at", "reason"))).alias("e"))
    return rows.select("id", F.aggregate("e", start, step).alias("s")).select("id", "s.*").where("status is not null")


def job_status(states: DataFrame, now: Column, beat: Column, seconds: int = 30) -> DataFrame:
    """(id, state) as someone who waits for a run sees it: running, stalled (no heartbeat for so long), cancelled, failed, completed or skipped.

    now, beat: the time and a run's last heartbeat, in seconds.
    """
    status = F.col("status")
    state = F.when((status == "running") & (beat.isNull() | (now - beat > seconds)), "stalled").when((status == "failed") & (F.col("reason") == "cancelled"), "cancelled")
    return states.select("id", state.when(status == "skipped_no_plugins", "skipped").otherwise(status).alias("state"))


def may_sweep(status: str, resumed: bool, skipped_files: int, identities: bool) -> bool:
    """Whether a run may retire findings that it did not see again: a completed one that is no resumption, skipped nothing, and kept identities."""
    return status == "completed" and not resumed and skipped_files == 0 and identities


# --- caches ------------------------------------------------------------------------------------------

SUMMARY_KEY = ["entity_id", "content_hash", "prompt_template_id", "model_tier", "guidance_fingerprint"]


def touched(cache: DataFrame, hits: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The cache with last_accessed_at of the hits (columns `keys`) set."""
    seen = hits.select(*keys).distinct().withColumn("__hit", F.lit(True))
    out = cache.join(seen, keys, "left")
    return out.withColumn("last_accessed_at", F.when(F.col("__hit"), F.lit(at)).otherwise(F.col("last_accessed_at"))).select(*cache.columns)


def looked_up(cache: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Entries of the cache for asked keys."""
    return cache.join(asked.select(*keys).distinct(), keys, "left_semi").select(*cache.columns)


def without_entities(cache: DataFrame, gone: DataFrame) -> DataFrame:
    """The cache without entries of entities (column entity_id)."""
    return cache.join(gone.select("entity_id").distinct(), "entity_id", "left_anti").select(*cache.columns)


def dispatch_inputs(sites: DataFrame, entities: DataFrame, callers: DataFrame, most_sites: int | None = None, most_candidates: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What a provider of inferred calls is asked about callers (column id): their live sites in order, and the entities those may mean.

    (caller_entity_id, site_key, site_ordinal, callee_expr) and (caller_entity_id, id); of each caller so many at
    most (a tool takes 100), candidates in the order of the sites that name them first. None: all.
    """
    live = G.live_sites(sites, entities).join(callers.select(F.col("id").alias("caller_entity_id")), "caller_entity_id", "left_semi")
    live = live.select("caller_entity_id", "caller_content_hash", "site_key", "site_ordinal", "callee_expr", "source_byte_start")
    if most_sites is not None:
        live = L.ranked(live, "caller_entity_id", [F.col("site_ordinal"), F.col("site_key")], most_sites)
    found = G.site_candidates(live, entities, most_candidates).join(live.select("site_key", "caller_entity_id", "site_ordinal"), "site_key")
    first = found.groupBy("caller_entity_id", "id").agg(F.min(F.struct("site_ordinal", "site_key")).alias("__first"))
    if most_candidates is not None:
        first = L.ranked(first, "caller_entity_id", [F.col("__first"), F.col("id")], most_candidates)
    return live.select("caller_entity_id", "site_key", "site_ordinal", "callee_expr"), first.select("caller_entity_id", "id")


def known_targets(inferred: DataFrame, candidates: DataFrame) -> DataFrame:
    """Inferred calls (from_id, to_id, ...) to entities that the provider was offered; what it made up goes."""
    offered = candidates.select(F.col("caller_entity_id").alias("from_id"), F.col("id").alias("to_id"))
    return inferred.join(offered, ["from_id", "to_id"], "left_semi").select(*inferred.columns)


# --- prior index -------------------------------------------------------------------------------------


def replace_prior_index(index: DataFrame, now: DataFrame, skipped: DataFrame) -> DataFrame:
    """The index (path, hash) of a run: files of `now`, and of the old one those that the run skipped (column path) as unchanged."""
    kept = index.join(skipped.select("path").distinct(), "path", "left_semi").join(now.select("path"), "path", "left_anti")
    return kept.select("path", "hash").unionByName(now.select("path", "hash"))


def stale_markers(markers: DataFrame, plugins: DataFrame) -> DataFrame:
    """(plugin_id, changed): whether a plugin (plugin_id, version) is another than the one that made the index."""
    old = markers.select("plugin_id", F.col("version").alias("__old"))
    return plugins.join(old, "plugin_id", "left").select("plugin_id", (~F.col("version").eqNullSafe(F.col("__old"))).alias("changed"))


def checked_version(stored: int | None) -> int:
    """The version that a store is to have; one that is newer than this code is refused."""
    if stored is not None and stored > SCHEMA_VERSION:
        raise ValueError(f"the store has version {stored}, this code knows {SCHEMA_VERSION}")
    return SCHEMA_VERSION


def pending_migrations(applied: DataFrame, known: DataFrame) -> DataFrame:
    """Known migrations (version, name) that are not applied (version), in order. Applying them again finds none."""
    return known.join(applied.select("version"), "version", "left_anti").orderBy("version")


def with_signatures(entities: DataFrame, signatures: DataFrame) -> DataFrame:
    """Entities with signatures (id, signature) set where there is a new one."""
    new = signatures.select("id", F.col("signature").alias("__new"))
    return entities.join(new, "id", "left").withColumn("signature", F.coalesce("__new", "signature")).select(*entities.columns)


# --- guidance ----------------------------------------------------------------------------------------


def insert_sheets(sheets: DataFrame, new: DataFrame) -> DataFrame:
    """The sheets and the new ones. Fails if a new id is there already or twice among the new ones."""
    twice = sheets.select("id").unionByName(new.select("id")).groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    told = new.join(twice, "id", "left").withColumn("__ok", F.when(F.col("n").isNotNull(), F.raise_error(F.concat(F.lit("sheet exists: "), "id")).cast("boolean")).otherwise(True))
    return sheets.unionByName(told.where("__ok").select(*sheets.columns))


def upsert_sheets(sheets: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """New sheets replace those of their id; when a sheet was authored first stays."""
    return C.upsert(sheets, new, ["id"], tuple(c for c in ("authored_at",) if c in sheets.columns), order)


def delete_sheets(sheets: DataFrame, gone: DataFrame) -> DataFrame:
    return sheets.join(gone.select("id"), "id", "left_anti").select(*sheets.columns)


def imported_sheets(portable: DataFrame) -> DataFrame:
    """Sheets of portable files (column json): id from the name, rank from the level; files without name or content, or with another level, are left out."""
    field = lambda name: F.get_json_object("json", f"$.{name}")
    level = field("scope_level")
    rank = F.lit(None).cast("int")
    for name, n in SCOPE_RANKS.items():
        rank = F.when(level == name, F.lit(n)).otherwise(rank)
    rows = portable.where(X.is_json(F.col("json")))
    out = rows.select(F.concat(F.lit("core:guidance:"), X.slug(field("name"))).alias("id"), field("name").alias("name"), level.alias("scope_level"), rank.alias("scope_rank"), field("content").alias("content"), normal_time(field("expires")).alias("expires"))
    return out.where("name <> '' and content <> '' and scope_rank is not null")


def exported_sheets(sheets: DataFrame) -> DataFrame:
    """(id, json): sheets as portable files, with their keys in order."""
    return sheets.select("id", F.to_json(F.struct(*sorted(c for c in sheets.columns if c not in ("id", "scope_rank")))).alias("json"))


def promoted(proposals: DataFrame, accepted: DataFrame) -> DataFrame:
    """Proposals (id, ...) that were accepted (column id), as sheets."""
    return proposals.join(accepted.select("id"), "id", "left_semi").select(*proposals.columns)


def normal_time(text: Column) -> Column:
    """A date or time as ISO text with milliseconds in UTC; a date is its first instant; what cannot be read is null."""
    return F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def days_before(now: Column, days: int) -> Column:
    return F.date_format(F.try_to_timestamp(now) - F.expr(f"interval {int(days)} days"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


# --- batches of a service ----------------------------------------------------------------------------


def resolved_files(entities: DataFrame, asked: DataFrame, root: str) -> DataFrame:
    """(path, status, id, etag) of asked paths: ok with the entity that stands for the file, not_found, blocked, or invalid where it leaves the root."""
    rows = asked.select("path").distinct().withColumn("__rel", inside(root, F.col("path")))
    best = L.by_path(entities).select(F.col("source_file_path").alias("__rel"), "id")
    facts = entities.select("id", "content_hash", X.block_reason(F.col("properties")).alias("__why"))
    hit = rows.join(best, "__rel", "left").join(facts, "id", "left")
    status = F.when(F.col("__rel").isNull(), "invalid").when(F.col("id").isNull(), "not_found").when(F.col("__why").isNotNull(), "blocked").otherwise("ok")
    etag = F.sha2(F.concat_ws("|", "id", "content_hash"), 256)
    return hit.select("path", status.alias("status"), F.when(status == "ok", F.col("id")).alias("id"), F.when(status == "ok", etag).alias("etag"))


def linkage_batch(edges: DataFrame, entities: DataFrame, asked: DataFrame, role: str = "callers", limit: int = 50, most: int = 200) -> DataFrame:
    """(id, found, neighbour, call_site_count, confidence, total): linkages of asked ids, by neighbour, `limit` of each; a row without neighbour for those that have none."""
    rows = G.linkages(edges, entities, role).join(asked.select("id").distinct(), "id", "left_semi")
    totals = rows.groupBy("id").agg(F.count("*").alias("total"))
    kept = L.ranked(rows, "id", [F.col("neighbour")], max(1, min(limit, most)))
    known = entities.select("id", F.lit(True).alias("found"))
    out = asked.select("id").distinct().join(known, "id", "left").join(totals, "id", "left").join(kept, "id", "left")
    return out.select("id", F.coalesce("found", F.lit(False)).alias("found"), "neighbour", "call_site_count", "confidence", F.coalesce("total", F.lit(0)).cast("long").alias("total"))
