"""Connected components by iterated joins."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's shared folder, from spark.checkpoint.dir. Only in local mode a folder of ours stands in where that is unset."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            folder = os.path.join(tempfile.gettempdir(), "graphquarry-checkpoints")
        sc.setCheckpointDir(folder)


def written(rows: DataFrame, *by: str) -> DataFrame:
    """The rows, written as Parquet (in a folder for each value of `by`) below the checkpoint folder and read again: smaller there than a checkpoint."""
    spark = rows.sparkSession
    path = new_folder(spark, "rows")
    rows.write.mode("overwrite").partitionBy(*by).option("compression", "zstd").parquet(path)
    _folders.append(path)
    return spark.read.schema(rows.schema).parquet(path).select(*rows.columns)


def new_folder(spark: SparkSession, kind: str = "table") -> str:
    """A path below the checkpoint folder; what is written there goes with the session, where nothing deletes it before."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{kind}-{uuid.uuid4().hex}"
    at, files = file_system(spark, path)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


_folders: list[str] = []


def file_system(spark: SparkSession, path: str):
    """(path, file system) of Hadoop's for a folder, which need not be on this machine."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders where they are."""
    for p in paths:
        at, files = file_system(spark, p)
        files.delete(at, True)


@contextmanager
def scratch(spark: SparkSession):
    """What `written` leaves within goes at the end. For work whose results are stored by then: lazy ones could not be read any more.

    Gives a function that keeps one such table. Shuffle files of what was written go too, as far as nothing refers to them:
    Spark deletes them when the driver's JVM collects its garbage, which is asked for here.
    """
    before, kept = len(_folders), []

    def keep(rows: DataFrame) -> DataFrame:
        kept.append(_folders[-1])
        return rows

    yield keep
    remove(spark, *(x for x in _folders[before:] if x not in kept))
    _folders[before:] = kept
    freed(spark)


def freed(spark: SparkSession) -> None:
    """Have the shuffle files deleted that nothing refers to any more: Spark does so when the driver's JVM collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every end of an undirected edge; a component is named by its least node.

    In each round a node takes the least label of its neighbours and then the label of its label, so
    that distances shrink as in pointer jumping. Labels are written to the checkpoint folder after
    each round; the driver sees only whether any changed. Edges with a null end are left out.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    one = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().checkpoint()
    labels = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")).select(F.col("u").alias("node"), "label").checkpoint()
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("u")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        of_label = labels.select(F.col("node").alias("at"), F.col("label").alias("jump"))
        step = step.join(of_label, F.col("label") == F.col("at")).select("node", "old", F.least("label", "jump").alias("label")).checkpoint()
        labels = step.select("node", "label")
        if step.where(F.col("label") != F.col("old")).isEmpty():
            return labels.withColumnRenamed("label", "component")
