"""Structured Streaming forms of what a running analysis does: heartbeats, breakers, upserts, lineage.

The graph operators are batch; these feed their tables.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from graphquarry.shipping import ship


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Rolling(StatefulProcessor):
    """For each key, failures that wait until the watermark has passed them, and those of the last `width` microseconds.

    A timer behind the first that waits hands on all that the watermark has passed, in the order of time, however it came in, and
    sets the next. The window's first failure moves on with its last, so that each is met twice, however many a window holds.
    One state for each key; it holds the failures of one width and of the time that rows may be late. A key may come in slices of one
    width (key, number): what lies before the slice only counts, and the state goes when the watermark has passed the slice's end.
    """

    def __init__(self, most: int, width: int):
        self.most, self.width = most, width

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting, self.recent = (handle.getListState(n, "at long") for n in ("waiting", "recent"))

    def handleInputRows(self, key, rows, timerValues):
        new = sorted(row["at"] for row in rows)
        self.waiting.appendList([(x,) for x in new])
        self.handle.registerTimer(new[0] // 1000 + 1)  # in milliseconds, behind the failure
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        due = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        waiting = sorted(x[0] for x in self.waiting.get())
        start, end = (key[1] * self.width, (key[1] + 1) * self.width) if len(key) > 1 else (float("-inf"), float("inf"))
        if not waiting or waiting[0] >= due:
            if due >= end:
                self.recent.clear()
            return iter(())
        passed = bisect_left(waiting, due)
        recent, later, out = [x[0] for x in self.recent.get()], waiting[passed:], []
        times, first = recent + waiting[:passed], 0
        for last in range(len(recent), len(times)):
            at = times[last]
            while at - times[first] >= self.width:
                first += 1
            n = last - first + 1
            if n > self.most and at >= start and times[last + 1 : last + 2] != [at]:
                out.append(Row(key=key[0], at=at, n=n))
        if due >= end:
            self.recent.clear()
        else:
            self.recent.put([(x,) for x in times[first:]])
            if len(key) > 1:
                self.handle.registerTimer(end // 1000 + 1)
        self.waiting.clear()
        if later:
            self.waiting.put([(x,) for x in later])
            self.handle.registerTimer(later[0] // 1000 + 1)
        return iter(out)

    def close(self) -> None:
        pass


def breaker(crashes: DataFrame, most: int = 3, width: float = 60, late: str = "1 minute") -> DataFrame:
    """(key, ts, n): failures (columns key, ts) after which a key has had more than `most` of them in the last `width` seconds, itself included.

    The window rolls: a failure counts until it is `width` old. Failures of one time give one row with all of them. Rows come
    once the watermark has passed them; failures that are later than `late` are lost. Null keys and times are left out. A key is dealt by
    slices of one width, each failure to its own and, as one that only counts, to the next: a task holds two slices of a key, however long the stream.
    """
    spark = crashes.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKS:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # the one that keeps lists and timers
    rows = ship(crashes).where("key is not null and ts is not null").withWatermark("ts", late).select("key", "ts", F.unix_micros("ts").alias("at"))
    span = round(width * 1_000_000)
    own = F.expr(f"(at - pmod(at, {span})) div {span}")
    rows = rows.withColumn("slice", F.explode(F.array(own, own + 1)))
    found = rows.groupBy("key", "slice").transformWithState(Rolling(most, span), f"key {rows.schema['key'].dataType.simpleString()}, at long, n int", "Append", "EventTime")
    return found.select("key", F.timestamp_micros("at").alias("ts"), "n")


def tripped(crashes: DataFrame, most: int = 3, width: float = 60) -> DataFrame:
    """The same of a table that is complete."""
    rows = crashes.where("key is not null and ts is not null").select("key", "ts", F.unix_micros("ts").alias("at"))
    last = Window.partitionBy("key").orderBy("at").rangeBetween(1 - round(width * 1_000_000), 0)
    return rows.select("key", "ts", F.count("*").over(last).cast("int").alias("n")).where(F.col("n") > most).distinct()


def last_heartbeats(beats: DataFrame, late: str = "1 hour") -> DataFrame:
    """(run_id, heartbeat_at) per hour of event time, for an upsert of runs."""
    rows = beats.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "run_id").agg(F.max("ts").alias("heartbeat_at"))
    return rows.select("run_id", "heartbeat_at")


def changed_files(files: DataFrame, prior: DataFrame) -> DataFrame:
    """Files of a stream (path, hash) that differ from a snapshot's."""
    old = prior.select("path", F.col("hash").alias("__old"))
    return files.join(old, "path", "left").where(F.col("hash").isNull() | ~F.col("hash").eqNullSafe(F.col("__old"))).drop("__old")


def upserts(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """A writer that hands each micro-batch to `merge(rows, batch_id)`; merging a batch twice must not matter."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("update")


def appended(stream: DataFrame, path: str, checkpoint: str):
    """An append-only Parquet log, such as that of identities."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def bounded_files(spark: SparkSession, path: str, schema, most: int = 100) -> DataFrame:
    """A stream of files of rows, at most so many files in a batch: what waits between an extractor and its writer is bounded."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most).parquet(path)


def stale(beats: DataFrame, now: DataFrame, status_seconds: int = 30, store_seconds: int = 24 * 3600) -> DataFrame:
    """(run_id, heartbeat_at, stale_for_status, stale_for_store) of heartbeats (run_id, ts) against a time (now: one row).

    What shows a run's state gives up after half a minute, what fails it after a day. Times count in whole seconds, each to the nearest.
    """
    last = beats.groupBy("run_id").agg(F.max("ts").alias("heartbeat_at")).crossJoin(F.broadcast(now))  # one row
    seconds = lambda ts: F.rint(F.unix_micros(ts) / 1e6).cast("long")
    age = seconds(F.col("now")) - seconds(F.col("heartbeat_at"))
    return last.select("run_id", "heartbeat_at", (age > status_seconds).alias("stale_for_status"), (age > store_seconds).alias("stale_for_store"))
