"""Source trees, SARIF logs and stored tables as DataFrames."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphquarry.functions import expr as X

#: Folders that are never walked, and files that hold settings and are scanned for secrets besides sources.
SKIPPED = (".git", "node_modules", "__pycache__", ".venv", "venv", "target", "dist", "build")
SIDECARS = r"(^|/)(\.env(\.[^/]*)?|[^/]*\.env)$"


def files(spark: SparkSession, root: str, extensions: tuple[str, ...], ignored: tuple[str, ...] = ()) -> DataFrame:
    """(path, content, size, modified) of the source files below a folder; paths are relative to it.

    ignored: globs, as an ignore file has them. Reading is by Spark, so that any store it knows will do.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    path = F.regexp_replace(F.col("path"), f"^[a-z0-9]+:/*{base.lstrip('/')}/", "")
    out = rows.select(path.alias("path"), F.col("content").alias("raw"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    inside = F.exists(F.split("path", "/"), lambda s: s.isin(*SKIPPED))
    out = out.where(~inside & F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*(e.lstrip(".") for e in extensions)))
    for glob in ignored:
        out = out.where(~X.matches_glob(F.col("path"), glob))
    return out.withColumn("content", F.col("raw").cast("string")).drop("raw").select("path", "content", "size", "modified")


def scan_files(sources: DataFrame, every: DataFrame) -> DataFrame:
    """What is scanned for secrets: sources and setting files, each path once."""
    return sources.select("path", "content").unionByName(every.where(F.col("path").rlike(SIDECARS)).select("path", "content")).dropDuplicates(["path"])


def untracked(paths: DataFrame, entities: DataFrame) -> DataFrame:
    """Paths (column path) of a kind that is indexed already, which no entity has."""
    ending = lambda c: F.regexp_extract(c, r"(\.[^./]+)$", 1)
    kinds = entities.select(ending("source_file_path").alias("__e")).where("__e <> ''").distinct()
    rows = paths.withColumn("__e", ending("path")).join(kinds, "__e", "left_semi")
    return rows.join(entities.select(F.col("source_file_path").alias("path")), "path", "left_anti").select("path")


SARIF = "runs array<struct<tool:struct<driver:struct<name:string>>,results:array<struct<ruleId:string,level:string,message:struct<text:string>,partialFingerprints:map<string,string>,fingerprints:map<string,string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:bigint,endLine:bigint>>>>>>>>"


def sarif_results(logs: DataFrame) -> DataFrame:
    """(tool, rule_id, severity, message, path, line_start, line_end, fingerprint) of the results in SARIF logs (column json).

    Level error is high, warning medium, all else info; the first location counts; of the fingerprints the
    first by name does, partial ones before full ones. Logs that cannot be read have no results.
    """
    runs = logs.select(F.explode(F.from_json("json", f"struct<{SARIF.replace('runs array', 'runs:array', 1)}>")["runs"]).alias("run"))
    rows = runs.select(F.col("run.tool.driver.name").alias("tool"), F.explode("run.results").alias("r"))
    place = F.get("r.locations", F.lit(0))["physicalLocation"]
    prints = lambda c: F.get(F.transform(F.array_sort(F.map_entries(c)), lambda e: e["value"]), F.lit(0))
    level = F.when(F.col("r.level") == "error", "high").when(F.coalesce("r.level", F.lit("warning")) == "warning", "medium").otherwise("info")
    return rows.select("tool", F.col("r.ruleId").alias("rule_id"), level.alias("severity"), F.col("r.message.text").alias("message"), place["artifactLocation"]["uri"].alias("path"), place["region"]["startLine"].alias("line_start"), place["region"]["endLine"].alias("line_end"), F.coalesce(prints("r.partialFingerprints"), prints("r.fingerprints")).alias("fingerprint"))


def sarif(spark: SparkSession, path: str) -> DataFrame:
    """The results in SARIF files, one log each."""
    return sarif_results(spark.read.text(path, wholetext=True).select(F.col("value").alias("json")))


def write_snapshot(tables: dict[str, DataFrame], root: str, version: str) -> None:
    """Tables of a run below root/version; edges by kind. Readers see it once a line in root/current names it.

    Lines are only ever added, each by one commit, so a reader finds the old version or the new one and
    never none. Of several the last written counts.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, rows in tables.items():
        writer = rows.write.mode("overwrite")
        (writer.partitionBy("kind") if name == "edges" else writer).parquet(f"{root}/{version}/{name}")
    spark.createDataFrame([(version, time.time_ns())], "version string, seq long").coalesce(1).write.mode("append").json(f"{root}/current")


def read_snapshot(spark: SparkSession, root: str, name: str, version: str | None = None) -> DataFrame:
    if version is None:
        version = spark.read.schema("version string, seq long").json(f"{root}/current").agg(F.max_by("version", "seq")).first()[0]
    return spark.read.parquet(f"{root}/{version}/{name}")
