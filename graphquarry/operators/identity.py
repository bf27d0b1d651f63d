"""Stable identities across runs, and resolving names to entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphquarry.functions import expr as X


def resolve_qualnames(entities: DataFrame, asked: DataFrame, kinds: tuple[str, ...] | None = None, plugin: str | None = None) -> DataFrame:
    """(qualname, result_kind, entity_ids): exact, ambiguous (sorted ids) or none, for each asked qualname.

    Names may be given with `::`, or as whole ids. Files and subsystems are not looked for.
    """
    rows = entities.where(~F.col("kind").isin("file", "subsystem"))
    if kinds is not None:
        rows = rows.where(F.col("kind").isin(*kinds))
    if plugin is not None:
        rows = rows.where(F.col("plugin_id") == plugin)
    whole = F.size(F.split("qualname", ":", 3)) == 3
    dotted = F.replace("qualname", F.lit("::"), F.lit("."))
    full = whole & ~F.col("qualname").contains("::")
    name = F.when(full, X.qualname(F.col("qualname"))).otherwise(dotted)
    want = asked.select("qualname").distinct().withColumn("__name", name).withColumn("__full", full)
    found = want.join(rows.select(X.qualname(F.col("id")).alias("__name"), "id"), "__name").where(~F.col("__full") | (F.col("id") == F.col("qualname")))
    hits = found.groupBy("qualname").agg(F.array_sort(F.collect_set("id")).alias("entity_ids"))
    out = want.select("qualname").join(hits, "qualname", "left").withColumn("entity_ids", F.coalesce("entity_ids", F.array().cast("array<string>")))
    kind = F.when(F.size("entity_ids") == 0, "none").when(F.size("entity_ids") == 1, "exact").otherwise("ambiguous")
    return out.select("qualname", kind.alias("result_kind"), "entity_ids")


def renamed_locators(current: DataFrame, file_renames: DataFrame) -> DataFrame:
    """(old_locator, new_locator) for current ids (column locator) below a renamed file (old_path, new_path).

    A path stands for its module without the extension and `__init__`; a leading `src/` is not taken off.
    """

    def module(c: str):
        bare = F.regexp_replace(F.regexp_replace(c, r"\.pyi?$", ""), "/__init__$", "")
        return F.replace(bare, F.lit("/"), F.lit("."))

    moved = file_renames.select(module("old_path").alias("__old"), module("new_path").alias("__new")).distinct()
    name = X.qualname(F.col("locator"))
    parts = F.split(name, "[.]")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    rows = current.select("locator", F.explode(prefixes).alias("__new")).join(moved, "__new")
    head = F.array_join(F.slice(F.split("locator", ":", 3), 1, 2), ":")
    rest = F.substring(X.qualname(F.col("locator")), F.length("__new") + 1, F.length("locator"))
    return rows.select(F.concat(head, F.lit(":"), F.col("__old"), rest).alias("old_locator"), F.col("locator").alias("new_locator"))


def last_of_locator(descriptors: DataFrame) -> DataFrame:
    """One descriptor for each locator: the last by seq, or where there is none the greatest."""
    rest = F.struct("body_hash", "signature")
    order = F.struct("seq", rest) if "seq" in descriptors.columns else rest
    return descriptors.groupBy("locator").agg(F.max_by(rest, order).alias("d")).select("locator", "d.*")


def match_identities(alive: DataFrame, descriptors: DataFrame, renames: DataFrame, run_id: str) -> DataFrame:
    """(locator, sei, event) for the entities of a run: carried (no event), locator_changed, moved, or born.

    alive: (sei, locator, body_hash, signature) of bindings that are alive; descriptors: (locator, body_hash,
    signature, and seq if it is there) of this run, the last of several for a locator by seq counts (without
    seq the greatest); renames: (old_locator, new_locator, and seq if it is there).
    An entity keeps its locator's identity; else takes that of the first renamed locator that vanished with
    an equal body (null equals null); else the only vanished one with equal body and signature, both known;
    else gets a new one. An identity claimed twice goes to the first locator; the others get new ones.
    """
    now = last_of_locator(descriptors).select("locator", "body_hash", "signature")
    carried = now.join(alive.select("locator", "sei"), "locator", "left")
    gone = alive.join(now.select("locator"), "locator", "left_anti")
    order = F.col("seq") if "seq" in renames.columns else F.lit(0)
    old = gone.select(F.col("locator").alias("old_locator"), F.col("sei").alias("__renamed"), F.col("body_hash").alias("__body"))
    fits = renames.select("old_locator", F.col("new_locator").alias("locator"), order.alias("__order")).join(old, "old_locator").join(now.select("locator", F.col("body_hash").alias("__own")), "locator").where(F.col("__body").eqNullSafe(F.col("__own")))
    named = fits.groupBy("locator").agg(F.min_by("__renamed", F.struct("__order", "old_locator")).alias("__renamed"))
    only = gone.where("body_hash is not null and signature is not null").groupBy("body_hash", "signature").agg(F.count("*").alias("__n"), F.min("sei").alias("__moved")).where("__n = 1").drop("__n")
    rows = carried.join(named, "locator", "left").join(only, ["body_hash", "signature"], "left")
    by_name = F.col("__renamed")
    event = F.when(F.col("sei").isNotNull(), "carried").when(by_name.isNotNull(), "locator_changed").when(F.col("__moved").isNotNull(), "moved").otherwise("born")
    claimed = rows.select("locator", F.coalesce("sei", by_name, "__moved").alias("__sei"), event.alias("event"))
    first = claimed.where("__sei is not null").groupBy("__sei").agg(F.min(F.struct((F.col("event") != "carried").alias("later"), "locator")).alias("f")).select("__sei", F.col("f.locator").alias("__first"))
    out = claimed.join(first, "__sei", "left")
    mine = F.col("__first").isNotNull() & (F.col("__first") == F.col("locator"))
    return out.select("locator", F.when(mine, F.col("__sei")).otherwise(X.mint_sei(F.col("locator"), F.lit(run_id))).alias("sei"), F.when(mine, F.col("event")).otherwise("born").alias("event"))


def orphans(alive: DataFrame, matched: DataFrame) -> DataFrame:
    """Bindings that are alive, and whose identity this run did not match."""
    return alive.join(matched.select("sei"), "sei", "left_anti")


def resolve(bindings: DataFrame, entities: DataFrame, asked: DataFrame) -> DataFrame:
    """(ref, sei, current_locator, alive, content_hash) of locators or identities; unknown ones are not alive."""
    b = bindings.select("sei", "current_locator", "status")
    by_sei = asked.join(b, F.col("ref") == F.col("sei")).select("ref", "sei", "current_locator", "status")
    by_loc = asked.join(b.where("status = 'alive'"), F.col("ref") == F.col("current_locator")).select("ref", "sei", "current_locator", "status")
    hit = by_sei.unionByName(by_loc).join(entities.select(F.col("id").alias("current_locator"), "content_hash"), "current_locator", "left")
    return asked.select("ref").distinct().join(hit, "ref", "left").select("ref", "sei", "current_locator", F.coalesce(F.col("status") == "alive", F.lit(False)).alias("alive"), "content_hash")


def upsert_bindings(bindings: DataFrame, matched: DataFrame, descriptors: DataFrame, run_id: str) -> DataFrame:
    """The bindings after a run: matched ones alive at their new locator, the rest of those alive orphaned; born_run_id stays."""
    new = matched.join(last_of_locator(descriptors), "locator", "left").select("sei", F.col("locator").alias("__loc"), F.col("body_hash").alias("__body"), F.col("signature").alias("__sig"))
    both = bindings.join(new, "sei", "full")
    hit = F.col("__loc").isNotNull()
    return both.select("sei", F.when(hit, F.col("__loc")).otherwise(F.col("current_locator")).alias("current_locator"), F.when(hit, F.col("__body")).otherwise(F.col("body_hash")).alias("body_hash"), F.when(hit, F.col("__sig")).otherwise(F.col("signature")).alias("signature"), F.when(hit, "alive").when(F.col("status") == "alive", "orphaned").otherwise(F.col("status")).alias("status"), F.coalesce("born_run_id", F.lit(run_id)).alias("born_run_id"))


def lineage_of(matched: DataFrame, orphaned: DataFrame, run_id: str) -> DataFrame:
    """Events to append: one for each identity that did not simply carry on."""
    a = matched.where("event <> 'carried'").select("sei", "event", F.col("locator").alias("new_locator"))
    b = orphaned.select("sei", F.lit("orphaned").alias("event"), F.lit(None).cast("string").alias("new_locator"))
    return a.unionByName(b).withColumn("run_id", F.lit(run_id))
