"""Tables that change by deltas: what is read, what is written, and what readers and writers see in between."""

import os
import random

import pytest
from pyspark.sql import functions as F

from graphquarry.operators import lifecycle, versions

SCHEMA = "path string, id long, v string, created string"


def size(path):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def rows_of(table):
    return sorted(map(tuple, table.read().collect()), key=repr)


@pytest.fixture()
def table(spark, tmp_path):
    rows = spark.range(0, 40000).select(F.concat(F.lit("f"), F.floor(F.col("id") / 100).cast("string")).alias("path"), "id", F.md5(F.col("id").cast("string")).alias("v"), F.lit("old").alias("created"))
    return versions.Stored.create(rows, f"{tmp_path}/t", ["path", "id"], ["path"], 64)


def test_changes_against_a_dictionary(spark, tmp_path):
    rng, want = random.Random(5), {(f"p{k % 7}" if k % 11 else None, k): ("a", "old") for k in range(60)}
    start = spark.createDataFrame([(*k, *v) for k, v in want.items()], SCHEMA)
    table = versions.Stored.create(start, f"{tmp_path}/t", ["path", "id"], ["path"], 8)
    for step in range(6):
        new = {(rng.choice(["p1", "p2", "q", None]), rng.randint(0, 80)): (f"s{step}", "new") for _ in range(8)}
        gone = rng.sample(sorted(want, key=repr), 4)
        if step % 2:
            table = table.change(spark.createDataFrame([(*k, *v) for k, v in new.items()], SCHEMA), spark.createDataFrame([(*k, None, None) for k in gone], SCHEMA))
            want = {k: v for k, v in want.items() if k not in gone} | new
        else:
            dated = [(*k, *v, 1) for k, v in new.items()] + [(*k, "never", "never", 0) for k in new]
            table = table.upsert(spark.createDataFrame(dated, SCHEMA + ", seq int"), ("created",), "seq")
            want |= {k: (v[0], want[k][1] if k in want and k[0] is not None else v[1]) for k, v in new.items()}
        assert rows_of(table) == sorted(((*k, *v) for k, v in want.items()), key=repr), step
        if step == 3:
            table = table.compact(2)
            assert rows_of(table) == sorted(((*k, *v) for k, v in want.items()), key=repr)
    before = table.compact()
    assert not any(p["delta"] for p in before.state["parts"])
    assert rows_of(before) == sorted(((*k, *v) for k, v in want.items()), key=repr)
    assert before.vacuum() and rows_of(before.latest()) == rows_of(before)


def test_bytes_written_follow_the_change(spark, table):
    base = size(table.path)
    changed = table.read().where("path in ('f1', 'f2', 'f3', 'f4')").withColumn("v", F.md5("v"))  # 1 %
    later = table.change(changed)
    assert size(table.path) - base < 0.03 * base
    assert later.read().count() == 40000 and later.read().join(table.read(), ["path", "id", "v"]).count() == 39600
    touched = {b for p in later.state["parts"] if p["delta"] for b in p["buckets"]}
    assert len(touched) <= 4
    before = size(table.path)
    assert later.compact().read().count() == 40000
    assert size(table.path) - before < 0.15 * base  # touched buckets alone


def test_readers_see_old_or_new(spark, table):
    reader = table.read()  # a query that was planned before the change
    n = reader.agg(F.count("*"), F.sum(F.crc32("v"))).first()
    changed = table.change(table.read().where("id % 100 = 0").withColumn("v", F.lit("x")), table.read().where("id % 100 = 1"))
    compacted = changed.compact()
    assert reader.agg(F.count("*"), F.sum(F.crc32("v"))).first() == n
    assert changed.read().count() == compacted.read().count() == 39600
    assert versions.Stored(spark, table.path, 0).read().count() == 40000
    # A change that is written but not published is seen by nobody.
    os.rename(f"{table.path}/_commits/{2:020d}.json", f"{table.path}/_commits/{2:020d}.lost")
    assert table.latest().version == 1 and table.latest().read().count() == 39600


def test_second_writer_is_refused(spark, table):
    a, b = table.latest(), table.latest()
    a.change(a.read().where("id = 5").withColumn("v", F.lit("a")))
    with pytest.raises(versions.Conflict):
        b.change(b.read().where("id = 5").withColumn("v", F.lit("b")))
    assert [r.v for r in table.latest().read().where("id = 5").collect()] == ["a"]
    again = b.latest()
    assert [r.v for r in again.change(again.read().where("id = 5").withColumn("v", F.lit("b"))).read().where("id = 5").collect()] == ["b"]


def test_only_asked_buckets_are_read(spark, table):
    asked = spark.createDataFrame([("f7",)], "path string")
    plan = table.lookup(asked)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__bucket" in plan or "PartitionFilters: [(__bucket" in plan
    assert table.lookup(asked).count() == 100
    changed = table.replace(table.read().limit(0), asked, F.col("id") % 2 == 0)
    assert changed.read().count() == 39950 and changed.lookup(asked).count() == 50
    assert lifecycle.replace_for(table.read(), table.read().limit(0), "path", asked, F.col("id") % 2 == 0).exceptAll(changed.read()).count() == 0


def test_edges_that_are_made_are_not_stored_to_be_changed(spark, data, monkeypatch):
    from graphquarry.plans import catalog, catalog_store  # noqa: F401  the latter adds to the catalogue
    from graphquarry.sources.fixtures import Tables

    kinds, table = [], Tables.table
    monkeypatch.setattr(Tables, "table", lambda self, rows, *more: kinds.append({r.kind for r in rows.select("kind").distinct().collect()}) or table(self, rows, *more))
    for name in ("snk02_upsert_edges", "snk04_replace_file_edges"):
        assert catalog.QUERIES[name](spark, data).where("kind = 'inherits_from'").count() == Tables(spark, data).edges.where("kind = 'inherits_from'").count() > 0
    assert len(kinds) == 2 and all("inherits_from" not in k and "calls" in k for k in kinds)
