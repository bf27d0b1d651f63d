"""Stored tables that change by deltas: a change of a few rows writes a few rows.

A table lies in a folder as parts, Parquet folders cut by a hash of some key columns into buckets. The first part is the
base; a change adds a part of new rows and of keys that are gone. A commit is a small file that lists the parts, written
aside and renamed, so that a reader sees one state or the next, and of two writers one is refused. Readers
merge: of each key the row of the latest part holds. Only buckets that have changed are merged, the others are
read as they are; filters and columns reach the files of both. `compact` merges the buckets that many
parts have touched, and nothing else; `vacuum` deletes parts that no commit lists any more.

Rows of a key must agree in the columns that the table is cut by, which are some of the key. A change may
hold a key several times, if an order says which row is last. Null keys are keys like others.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphquarry.operators.components import file_system, remove

BUCKET, GONE, SEQ = "__bucket", "__gone", "__seq"


class Conflict(RuntimeError):
    """Another writer committed first; what was read is no longer the latest state."""


def commits(spark: SparkSession, path: str) -> list[int]:
    at, files = file_system(spark, f"{path}/_commits")
    return sorted(int(x.getPath().getName()[:-5]) for x in files.listStatus(at) if x.getPath().getName().endswith(".json")) if files.exists(at) else []


def state_of(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict]:
    """(version, state) of the latest commit or the given one."""
    version = max(commits(spark, path)) if version is None else version
    at, files = file_system(spark, f"{path}/_commits/{version:020d}.json")
    stream = files.open(at)
    try:
        return version, json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, version: int, state: dict) -> int:
    """Publish a state as this version. It appears whole or not at all; a version that is there already is a conflict."""
    jvm = spark.sparkContext._jvm
    aside, files = file_system(spark, f"{path}/_commits/{uuid.uuid4().hex}.new")
    out = files.create(aside, True)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    target, _ = file_system(spark, f"{path}/_commits/{version:020d}.json")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(aside, target, none)  # fails where the target is
    except Exception as e:
        files.delete(aside, False)
        if files.exists(target):
            raise Conflict(f"version {version} of {path} is there already") from e
        raise
    return version


def bucket(by: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")


class Stored:
    """A table of parts under a path."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path = spark, path
        self.version, self.state = state_of(spark, path, version)
        self.keys, self.by, self.buckets = self.state["keys"], self.state["by"], self.state["buckets"]
        self.schema = T.StructType.fromJson(self.state["schema"])

    @staticmethod
    def create(rows: DataFrame, path: str, keys: list[str], by: list[str] | None = None, buckets: int = 64) -> Stored:
        """Write the rows, one for each key, as a new table's base."""
        by = by or keys
        if not set(by) <= set(keys):
            raise ValueError("a table is cut by columns of its key")
        spark, name = rows.sparkSession, f"part-{uuid.uuid4().hex}"
        rows.withColumn(BUCKET, bucket(by, buckets)).repartition(BUCKET).sortWithinPartitions(BUCKET, *by).write.partitionBy(BUCKET).parquet(f"{path}/{name}")
        nullable = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
        part = {"name": name, "seq": 0, "delta": False, "buckets": list(range(buckets))}
        commit(spark, path, 0, {"keys": keys, "by": by, "buckets": buckets, "schema": nullable.jsonValue(), "parts": [part]})
        return Stored(spark, path, 0)

    def latest(self) -> Stored:
        return Stored(self.spark, self.path)

    def part(self, p: dict, only: set[int] | None) -> DataFrame | None:
        own = sorted(set(p["buckets"]) if only is None else only & set(p["buckets"]))
        if not own:
            return None
        schema = T.StructType([*self.schema, *([T.StructField(GONE, T.BooleanType())] if p["delta"] else []), T.StructField(BUCKET, T.IntegerType())])
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{p['name']}")
        return rows if len(own) == self.buckets else rows.where(F.col(BUCKET).isin(own))

    def read(self, only: set[int] | None = None) -> DataFrame:
        """The rows of this version, of some buckets if asked."""
        found = [(p, rows) for p in self.state["parts"] if (rows := self.part(p, only)) is not None]
        base = [rows.select(BUCKET, *self.schema.names) for p, rows in found if not p["delta"]]
        deltas = [rows.withColumn(SEQ, F.lit(p["seq"])) for p, rows in found if p["delta"]]
        union = lambda parts: reduce(DataFrame.unionByName, parts)
        if not base and not deltas:
            return self.spark.createDataFrame([], self.schema)
        if not deltas:
            return union(base).select(*self.schema.names)
        touched = sorted({b for p, _ in found if p["delta"] for b in p["buckets"]} & (only if only is not None else set(range(self.buckets))))
        rest = [c for c in self.schema.names if c not in self.keys]
        newest = union(deltas).groupBy(*self.keys).agg(F.max_by(F.struct(GONE, *rest), SEQ).alias("r"))
        out = newest.where(~F.col(f"r.{GONE}")).select(*self.keys, *(F.col("r").getField(c).alias(c) for c in rest)).select(*self.schema.names)
        if base:
            old, keys = union(base), newest.select(*(F.col(k).alias(f"__{k}") for k in self.keys))
            same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys))
            quiet = old.where(~F.col(BUCKET).isin(touched)).select(*self.schema.names)
            busy = old.where(F.col(BUCKET).isin(touched)).join(keys, same, "left_anti").select(*self.schema.names)
            out = quiet.unionByName(busy).unionByName(out)
        return out

    def buckets_of(self, keys: DataFrame) -> set[int]:
        """The buckets that keys fall into; at most as many values as there are buckets."""
        return {r[0] for r in keys.select(bucket(self.by, self.buckets)).distinct().collect()}

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows whose cutting columns are among those of `keys`; only their buckets are read."""
        return self.read(self.buckets_of(keys)).join(keys.select(*self.by).distinct(), self.by, "left_semi")

    def change(self, rows: DataFrame | None = None, gone: DataFrame | None = None) -> Stored:
        """The next version: rows replace those of their keys or come new, and keys in `gone` go. A key in both stays as `rows` has it."""
        given = [rows.select(*self.schema.names, F.lit(False).alias(GONE))] if rows is not None else []
        if gone is not None:
            lost = gone.select(*self.keys).distinct()
            if rows is not None:
                lost = lost.join(rows.select(*self.keys), self.keys, "left_anti")
            given.append(lost.select(*(F.col(f.name) if f.name in self.keys else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema), F.lit(True).alias(GONE)))
        name = f"part-{uuid.uuid4().hex}"
        made = reduce(DataFrame.unionByName, given).withColumn(BUCKET, bucket(self.by, self.buckets))
        made.repartition(BUCKET).sortWithinPartitions(BUCKET, *self.by).write.partitionBy(BUCKET).parquet(f"{self.path}/{name}")
        seq = 1 + max(p["seq"] for p in self.state["parts"])
        return self.publish([*self.state["parts"], {"name": name, "seq": seq, "delta": True, "buckets": self.written_buckets(name)}])

    def upsert(self, rows: DataFrame, keep: tuple[str, ...] = (), order: str | None = None) -> Stored:
        """`change` where columns in `keep` stay as the old row of the key has them, null or not; `order` says which of several rows is last."""
        from graphquarry.operators.lifecycle import latest

        if order is not None:
            rows = latest(rows, self.keys, order).drop(order)
        if keep:
            old = self.lookup(rows).select(*self.keys, F.struct(*keep).alias("__old"))
            rows = rows.join(old, self.keys, "left").select(*(F.when(F.col("__old").isNotNull(), F.col(f"__old.{c}")).otherwise(F.col(c)).alias(c) if c in keep else c for c in self.schema.names))
        return self.change(rows)

    def replace(self, rows: DataFrame, touched: DataFrame, only: Column | None = None) -> Stored:
        """Rows with the cutting columns of `touched` go (those that `only` holds for), and the new ones come."""
        old = self.lookup(touched)
        return self.change(rows, old if only is None else old.where(only))

    def compact(self, least: int = 1) -> Stored:
        """Merge the buckets that at least so many changes have touched into base files; other buckets' files stay."""
        times: dict[int, int] = {}
        for p in self.state["parts"]:
            for b in p["buckets"] if p["delta"] else []:
                times[b] = times.get(b, 0) + 1
        busy = {b for b, n in times.items() if n >= least}
        if not busy:
            return self
        name = f"part-{uuid.uuid4().hex}"
        merged = self.read(busy).withColumn(BUCKET, bucket(self.by, self.buckets))
        merged.repartition(BUCKET).sortWithinPartitions(BUCKET, *self.by).write.partitionBy(BUCKET).parquet(f"{self.path}/{name}")
        left = [p | {"buckets": [b for b in p["buckets"] if b not in busy]} for p in self.state["parts"]]
        seq = max(p["seq"] for p in self.state["parts"])
        return self.publish([p for p in left if p["buckets"]] + [{"name": name, "seq": seq, "delta": False, "buckets": self.written_buckets(name)}])

    def written_buckets(self, name: str) -> list[int]:
        at, files = file_system(self.spark, f"{self.path}/{name}")
        return sorted(int(x.getPath().getName().partition("=")[2]) for x in files.listStatus(at) if x.isDirectory() and x.getPath().getName().startswith(BUCKET))

    def publish(self, parts: list[dict]) -> Stored:
        return Stored(self.spark, self.path, commit(self.spark, self.path, self.version + 1, self.state | {"parts": parts}))

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete all but the last `keep` commits and the parts that these do not list; not while older versions are being read, or changes written."""
        versions = commits(self.spark, self.path)
        kept = {p["name"] for v in versions[-keep:] for p in state_of(self.spark, self.path, v)[1]["parts"]}
        at, files = file_system(self.spark, self.path)
        lost = [n for x in files.listStatus(at) if (n := x.getPath().getName()).startswith("part-") and n not in kept]
        remove(self.spark, *(f"{self.path}/_commits/{v:020d}.json" for v in versions[:-keep]), *(f"{self.path}/{n}" for n in lost))
        return lost
