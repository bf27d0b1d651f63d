"""Point lookups, facets, scopes, paging and redaction over entities, tags and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphquarry.functions import expr as X
from graphquarry.operators.lines import excerpts

NONE: list[str] = []


def by_id(entities: DataFrame, entity_id: str) -> DataFrame:
    return entities.where(F.col("id") == entity_id)


def by_ref(entities: DataFrame, bindings: DataFrame, ref: str, prefix: str = "sei:") -> DataFrame:
    """An entity by its id, or by a stable identity that is alive."""
    if not ref.startswith(prefix):
        return by_id(entities, ref)
    alive = bindings.where((F.col("sei") == ref) & (F.col("status") == "alive")).select(F.col("current_locator").alias("id"))
    return entities.join(alive, "id", "left_semi")


def existing(entities: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those of the wanted ids (column id) that exist."""
    return wanted.select("id").distinct().join(entities.select("id"), "id", "left_semi")


def visibility(entities: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, state (not_found, blocked, visible) and reason for each wanted id."""
    known = entities.select("id", F.lit(True).alias("__known"), X.block_reason(F.col("properties")).alias("reason"))
    state = F.when(F.col("__known").isNull(), "not_found").when(F.col("reason").isNotNull(), "blocked").otherwise("visible")
    return wanted.select("id").distinct().join(known, "id", "left").select("id", state.alias("state"), "reason")


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 200) -> DataFrame:
    """The rows of a page in order; the limit is kept within 1 and `most`, the offset at 0 or more."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, most)))


def page_facts(rows: DataFrame, limit: int, offset: int = 0, most: int = 200) -> DataFrame:
    """One row: total, offset, limit, returned, truncated."""
    limit, offset = max(1, min(limit, most)), max(0, offset)
    total = rows.agg(F.count("*").alias("total"))
    returned = F.greatest(F.lit(0), F.least(F.lit(limit), F.col("total") - offset)).cast("long")
    return total.select("total", F.lit(offset).cast("long").alias("offset"), F.lit(limit).cast("long").alias("limit"), returned.alias("returned"), (F.col("total") > offset + returned).alias("truncated"))


def of_kind(entities: DataFrame, kind: str, cap: int | None = None) -> DataFrame:
    """Entities of a kind by id; with a cap one more than that, which tells that there are more."""
    out = entities.where(F.col("kind") == kind).orderBy("id")
    return out if cap is None else out.limit(cap + 1)


def known(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).distinct()


def tags_of(tags: DataFrame) -> DataFrame:
    """entity_id and its distinct tags in order."""
    return tags.groupBy("entity_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def with_tag(entities: DataFrame, tags: DataFrame, *names: str) -> DataFrame:
    """Entities that have any of the tags."""
    return entities.join(tags.where(F.col("tag").isin(*names)).select(F.col("entity_id").alias("id")), "id", "left_semi")


def with_any_tag(tags: DataFrame, *names: str) -> DataFrame:
    """(entity_id) that carry any of the tags."""
    return tags.where(F.col("tag").isin(*names)).select("entity_id").distinct()


def plugins(entities: DataFrame) -> DataFrame:
    """(plugin_id, functions): the plugins that made entities, and whether functions are among them."""
    return entities.groupBy("plugin_id").agg(F.bool_or(F.col("kind") == "function").alias("functions"))


def normal_lines(text: Column) -> Column:
    """A text as it is hashed: its lines, without carriage returns at their ends, joined by line feeds."""
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.rtrim(x, F.lit("\r"))), "\n")


def by_path(entities: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """For each source path the entity that stands for it: file before module before others, then id."""
    rank = F.when(F.col("kind") == "file", 0).when(F.col("kind") == "module", 1).otherwise(2)
    rows = entities.where(F.col("source_file_path").isNotNull())
    if paths is not None:
        rows = rows.join(paths, "source_file_path", "left_semi")
    return rows.groupBy("source_file_path").agg(F.min(F.struct(rank.alias("rank"), "id", "kind")).alias("__best")).select("source_file_path", "__best.id", "__best.kind")


def in_namespace(entities: DataFrame, namespace: str) -> DataFrame:
    name = X.qualname(F.col("id"))
    return entities.where((name == namespace) | name.startswith(namespace + "."))


def in_scope(entities: DataFrame, scope: str | None, descendants=None) -> DataFrame:
    """A scope argument: none or `project`, an entity id (it and what it contains), a path glob, a namespace.

    descendants: a function from an id to a DataFrame with column id.
    """
    if scope in (None, "", "project"):
        return entities
    if scope.count(":") >= 2 and descendants is not None:
        return entities.join(descendants(scope).select("id"), "id", "left_semi")
    if any(c in scope for c in "*?/"):
        return entities.where(X.matches_glob(F.col("source_file_path"), scope))
    return in_namespace(entities, scope)


def redacted(entities: DataFrame) -> DataFrame:
    """Rows as shown: content of blocked ones is null, and names that look like secrets are withheld."""
    reason = X.block_reason(F.col("properties"))
    shown = lambda c: F.when(F.col("__reason").isNull(), F.col(c))
    named = lambda c: F.when(F.col("__reason").isNull() & ~F.coalesce(X.looks_secret(F.col(c)), F.lit(False)), F.col(c))
    return entities.withColumn("__reason", reason).select("id", "kind", named("name").alias("name"), named("short_name").alias("short_name"), shown("source_file_path").alias("source_file_path"), shown("summary").alias("summary"), F.col("__reason").alias("briefing_blocked"))


def findings_of(findings: DataFrame, entity_id: str | None = None, **facets: str) -> DataFrame:
    """Findings of an entity (or all), by kind, severity or status, newest first."""
    rows = findings if entity_id is None else findings.where(F.col("entity_id") == entity_id)
    for name, value in facets.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows.orderBy(F.col("created_at").desc_nulls_last(), F.col("id"))


def project_findings(findings: DataFrame, entities: DataFrame, **facets: str) -> DataFrame:
    """Findings with the place of their entity."""
    at = entities.select(F.col("id").alias("entity_id"), "source_file_path", "source_line_start")
    return findings_of(findings, None, **facets).join(at, "entity_id").select("id", "rule_id", "kind", "severity", "status", "entity_id", "source_file_path", "source_line_start", "created_at")


def with_taint(entities: DataFrame, taints: DataFrame, tier: str | None = None, group: str | None = None, findings: DataFrame | None = None) -> DataFrame:
    """Entities whose latest taint fact has the facets (strings, numbers and truth values as text), and whether they have findings."""
    last = latest_facts(taints, "entity_id")
    for name, value in (("tier", tier), ("group", group)):
        if value is not None:
            last = last.where(X.is_json(F.col("fact_json")) & (X.scalar_facet(F.col("fact_json"), name) == value))
    out = entities.join(last.select(F.col("entity_id").alias("id")), "id", "left_semi").select("id", "kind")
    if findings is None:
        return out
    has = findings.select(F.col("entity_id").alias("id"), F.lit(True).alias("__has")).distinct()
    return out.join(has, "id", "left").select("id", "kind", F.coalesce("__has", F.lit(False)).alias("has_findings"))


def latest_facts(taints: DataFrame, key: str) -> DataFrame:
    """The most recent fact of each key: updated_at, then ingest_seq. Aggregated, so a hot key is no task of its own."""
    rows = taints.where(F.col(key).isNotNull())
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct("updated_at", "ingest_seq")).alias("__best"))
    return best.select("__best.*")


def meeting(entities: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked (source_file_path, line) with the entities that share a bucket of lines with them, before the exact test.

    A span of n lines lies in buckets of 16 lines, or 16 times as many as often as needed for n: two at most (16 for
    spans over 2^60). An asked line looks in its bucket of each of the 15 sizes, where spans are about as long as it.
    """
    spans = entities.where(F.col("source_line_start") <= F.col("source_line_end")).select("source_file_path", "id", "kind", *(F.col(c).cast("long").alias(c) for c in ("source_line_start", "source_line_end")))
    spans = spans.withColumn("__size", F.expr("least(15, int((length(bin(source_line_end - source_line_start)) + 3) div 4))"))
    spans = spans.withColumn("__bucket", F.explode(F.expr("sequence(shiftright(source_line_start, 4 * __size), shiftright(source_line_end, 4 * __size))")))
    lines = asked.select("source_file_path", F.col("line").cast("long").alias("__line"), "line", F.explode(F.sequence(F.lit(1), F.lit(15))).alias("__size"))
    lines = lines.join(F.broadcast(spans.select("__size").distinct()), "__size", "left_semi")  # 15 rows at most
    lines = lines.withColumn("__bucket", F.expr("shiftright(__line, 4 * __size)")).drop("__line")
    return lines.join(spans, ["source_file_path", "__size", "__bucket"])


def at_line(entities: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked (source_file_path, line) the innermost entity: least span, then kind, then id."""
    rank = F.when(F.col("kind") == "function", 0).when(F.col("kind") == "class", 1).when(F.col("kind") == "module", 2).otherwise(3)
    hit = meeting(entities, asked).where(F.col("line").between(F.col("source_line_start"), F.col("source_line_end")))
    key = F.struct((F.col("source_line_end") - F.col("source_line_start")).alias("span"), rank.alias("rank"), F.col("id").alias("id"))
    return hit.groupBy("source_file_path", "line").agg(F.min(key).alias("__best")).select("source_file_path", "line", "__best.id", "__best.span")


def source_lines(files: DataFrame, entities: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """id, first line and text of each open entity with lines around it, from files (source_file_path, content) or a table of lines (path, line, start, size, text)."""
    files = files if "start" in files.columns else files.select(F.col("source_file_path").alias("path"), "content")
    first, last = F.col("source_line_start") - before, F.col("source_line_end") + after
    return excerpts(entities.where(X.block_reason(F.col("properties")).isNull()).select("id", F.col("source_file_path").alias("path"), first.alias("first"), last.alias("last")), files)


def ranked(rows: DataFrame, bucket: str, order: list[Column], limit: int) -> DataFrame:
    """The first `limit` rows of each bucket."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(bucket).orderBy(*order))).where(F.col("__n") <= limit).drop("__n")
