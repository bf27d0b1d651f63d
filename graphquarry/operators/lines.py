"""The lines of files as rows with their byte ranges, and range joins on buckets of them.

A file's text is read once, when its lines are made; excerpts and positions then touch the lines that they ask for,
however long the file is. A line covers its bytes and the newline behind it, the last one the place behind its end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphquarry.shipping import ship

LINES = "path string, line long, start long, size long, text string"
#: Bits of a bucket of bytes, and of a bucket of lines.
BYTE_BITS, LINE_BITS, BATCH_ROWS = 12, 6, 50_000


def lines_of(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, line, start, size, text): each line with its number from 1, first byte and number of bytes, newline apart. Null contents have none.

    The rows of a file come in batches of bounded number and nothing is shuffled. Store them by path (`stored`) where they are read again.
    """

    def run(parts):
        for part in parts:
            for name, text in zip(part.column(0), part.column(1), strict=True):
                data = text.as_buffer()
                raw = np.frombuffer(data, np.uint8)
                ends = np.append(np.flatnonzero(raw == 10), len(raw))
                starts = np.append(0, ends[:-1] + 1)
                for a in range(0, len(ends), BATCH_ROWS):
                    s, e = starts[a : a + BATCH_ROWS], ends[a : a + BATCH_ROWS]
                    texts = [data.slice(x, y - x).to_pybytes().decode("utf-8", "replace") for x, y in zip(s.tolist(), e.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(s), pa.string()), pa.array(np.arange(a + 1, a + 1 + len(s))), pa.array(s), pa.array(e - s), pa.array(texts, pa.string())], [x.split()[0] for x in LINES.split(", ")])

    return ship(files.select(F.col(path).cast("string"), F.col(content).cast("string")).where(F.col(content).isNotNull())).mapInArrow(run, LINES)


def stored(lines: DataFrame, folder: str, buckets: int = 64) -> DataFrame:
    """The lines, written by buckets of their path and sorted, so that a reader of some files skips row groups of others."""
    lines.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")).repartitionByRange("bucket", "path", "line").sortWithinPartitions("bucket", "path", "line").write.partitionBy("bucket").parquet(folder)
    return lines.sparkSession.read.schema(LINES + ", bucket int").parquet(folder).drop("bucket")


def as_lines(files: DataFrame) -> DataFrame:
    """Lines, from a table of them or of files (path, content)."""
    return files if "start" in files.columns else lines_of(files)


def spread(first: Column, last: Column, bits: int) -> Column:
    """The buckets that a range touches."""
    return F.explode(F.sequence(F.shiftright(first, bits), F.shiftright(last, bits)))


def positions(spots: DataFrame, files: DataFrame) -> DataFrame:
    """Spots (path, source_byte_start, ...) of known files with the 1-based line and the 0-based byte column of their offset; neither outside the file.

    Different places are joined with the lines that touch their bucket of bytes, and come back to the spots.
    """
    lines = as_lines(files).select("path", "line", "start", "size")
    ranges = lines.select(F.col("path").alias("p"), "line", "start", "size", spread(F.col("start"), F.col("start") + F.col("size"), BYTE_BITS).alias("bucket"))
    asked = spots.select("path", F.col("source_byte_start").cast("long").alias("at")).where("at >= 0").distinct().withColumn("own", F.shiftright("at", BYTE_BITS))
    met = asked.join(ranges, (F.col("path") == F.col("p")) & (F.col("own") == F.col("bucket")) & F.col("at").between(F.col("start"), F.col("start") + F.col("size")))
    met = met.select(F.col("path").alias("__path"), F.col("at").alias("__at"), F.col("line"), (F.col("at") - F.col("start")).alias("column"))
    known = spots.join(lines.where("line = 1").select("path"), "path", "left_semi")
    return known.join(met, (F.col("path") == F.col("__path")) & (F.col("source_byte_start") == F.col("__at")), "left").select(*spots.columns, "line", "column")


def excerpts(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(id, first_line, text) of wanted (id, path, first, last): the lines from first (1 at least) to last, as far as the file has them.

    Nothing for a range that begins behind the file's end. An id that is asked for twice has a row for each first line.
    """
    first = F.greatest(F.lit(1).cast("long"), F.col("first").cast("long"))
    rows = wanted.select("id", "path", first.alias("first_line"), F.col("last").cast("long").alias("last")).where("first_line is not null and last is not null")
    rows = rows.withColumn("bucket", spread(F.col("first_line"), F.greatest("first_line", "last"), LINE_BITS))
    lines = as_lines(files).select("path", F.shiftright("line", LINE_BITS).alias("bucket"), "line", "text")
    met = rows.join(lines, ["path", "bucket"]).where(F.col("line").between(F.col("first_line"), F.greatest("first_line", "last")))
    own = F.collect_list(F.when(F.col("line") <= F.col("last"), F.struct("line", "text")))
    found = met.groupBy("id", "path", "first_line", "last").agg(F.min("line").alias("least"), F.array_sort(own).alias("l"))
    return found.where("least = first_line").select("id", "first_line", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))
