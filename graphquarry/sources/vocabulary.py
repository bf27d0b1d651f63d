"""Vocabularies of decorators that mark trust boundaries: reading a descriptor, and what it says of decorated entities."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the tag that entities with a known decorator carry, alone and before each decorator's name.
TAG = "wardline"
ENTRIES = "canonical_name string, group int, attrs map<string,string>"
STATE = "status string, descriptor_version string, reason string"


def parsed(text: str):
    """YAML where a reader for it is installed; else its subset JSON."""
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def descriptor(spark: SparkSession, text: str | None, expected: str) -> tuple[DataFrame, DataFrame]:
    """(entries, state) of a descriptor file's text. Whatever is wrong with it degrades it and stops nothing.

    state is one row: enabled; version_skew if the version is another than expected (entries hold all the
    same); absent, with a reason, if there is none or it cannot be read. A descriptor is one small file, so it
    is read on the driver.
    """
    status, version, reason, entries = "absent", None, "not_found", []
    if text is not None:
        try:
            data = parsed(text)
            version = str(data["version"])
            for e in data["entries"]:
                if not isinstance(e["canonical_name"], str) or not e["canonical_name"] or isinstance(e["group"], bool) or not isinstance(e["group"], int):
                    raise ValueError("an entry without name or group")
                entries.append((e["canonical_name"], e["group"], {str(k): str(v) for k, v in (e.get("attrs") or {}).items()}))
            if len({n for n, *_ in entries}) < len(entries):
                raise ValueError("a name twice")
            status, reason = ("enabled" if version == expected else "version_skew"), None
        except Exception:  # a broken descriptor is none, whatever its reader raises
            status, version, reason, entries = "absent", None, "malformed", []
    return spark.createDataFrame(entries, ENTRIES), spark.createDataFrame([(status, version, reason)], STATE)


def decorated(rows: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((entity_id, decorators), (entity_id, plugin_id, tag)) of extracted Python rows whose decorators' last names are known.

    decorators: of each entity by line, with canonical_name, qualified_name, group, attrs and line.
    """
    sites = rows.where("what = 'site'").select(F.from_json("data", "kind string, from_id string, text string, line long").alias("d")).select("d.*").where("kind = 'decorates'")
    named = sites.withColumn("canonical_name", F.element_at(F.split("text", "[.]"), -1)).join(entries, "canonical_name")
    one = F.struct("line", "canonical_name", F.col("text").alias("qualified_name"), "group", F.map_entries("attrs").alias("attrs"))
    facts = named.groupBy(F.col("from_id").alias("entity_id")).agg(F.array_sort(F.collect_list(one)).alias("decorators"))
    tags = named.select(F.col("from_id").alias("entity_id"), F.lit("python").alias("plugin_id"), F.explode(F.array(F.lit(TAG), F.concat(F.lit(TAG + ":"), "canonical_name"))).alias("tag")).distinct()
    return facts, tags
