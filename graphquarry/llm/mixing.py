"""Mixing sources to target weights: hash-threshold histograms, without sorting documents.

A source's target is its share of all words by weight, up to `most` times its own size; what goes over is
shared among the others by weight until none is above. A document has a fixed place in its source, a hash
of 60 bits of its doc_id. A target of 2.4 times the size takes every document twice, and once more those
whose hash lies below a threshold, so that a larger budget takes all that a smaller one does. Thresholds:

1. words are summed by source and the first `BITS` bits of the hash; running sums over these at most 4096
   buckets of a source show the bucket in which the budget ends;
2. only documents of that bucket are looked at again, by the next bits of their hash, until a bucket
   has one hash: five levels at most, each with a 4096th of the rows of the one before;
3. documents are filtered by their source's threshold. The one at the threshold is taken if that brings
   the source nearer to its target, so that a source misses it by half a document at most.

Sums are made before shuffles, so that a source with a third of all rows is in no single task. Sources
are ranked and their running sums made by ranges (`running`), so that their number is not bounded either.
All is built-in functions; what later steps read is written to the checkpoint folder.

Null texts have no words. Null sources are one source, the last one; empty ones are sources like any
other. Rows without doc_id have the hash of their text. Rows equal in doc_id are taken alike, all or none
at the threshold, whose miss is then theirs together. Long texts are taken whole. An empty table
gives no rows. Other columns are passed on if asked for, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphquarry.llm import batches as B
from graphquarry.operators.components import written

BITS, LEVELS = 12, 5
WEIGHTS, MOST = (1, 2, 3), 3
WORD = r"[^\x20\x09-\x0D]+"
OWN = ("size", "source_size", "target", "taken")


def place(text: str) -> Column:
    """60 bits of a hash of doc_id, or of the text of rows without one."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), B.text_or_empty(text)))
    return F.conv(F.substring(F.md5(key), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def running(rows: DataFrame, order: list[str], **sums: Column) -> DataFrame:
    """The rows with sums over all rows before each in the order, by ranges of it: no task has more than a range or a row for each range."""
    dealt = written(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    whole = dealt.groupBy("__range").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    ranges = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = whole.select("__range", *(F.coalesce(F.sum(n).over(ranges), F.lit(0)).alias(f"__{n}") for n in sums))
    inner = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.select("*", *(F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(n) for n, c in sums.items()))
    return own.join(bases, "__range").select(*rows.columns, *((F.col(n) + F.col(f"__{n}")).alias(n) for n in sums))


def targets(sources: DataFrame, most: float = MOST) -> DataFrame:
    """(key, total, weight, target) from (key, total, weight); null weights and those of 0 or less have no share.

    Sources in the order of the level at which they are full: those before the first one that is not full
    get all they can, and the others the level that is left for each unit of weight.
    """
    valid = sources.where("weight > 0").withColumn("cap", most * F.col("total")).withColumn("full_at", F.col("cap") / F.col("weight"))
    words = sources.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first()["n"]
    weights = valid.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("n")).first()["n"]
    level = (words - F.col("caps")) / (weights - F.col("before"))
    rows = written(running(valid, ["full_at", "key"], caps=F.col("cap"), before=F.col("weight")).withColumn("level", level))
    open_at = rows.where(F.col("cap") > F.col("level") * F.col("weight")).agg(F.min(F.struct("full_at", "key", "level")).alias("x")).first()["x"]
    target = F.col("cap").cast("double") if open_at is None else F.least(F.col("cap").cast("double"), open_at["level"] * F.col("weight"))
    return sources.join(rows.select("key", target.alias("target")), "key", "left").fillna(0.0, ["target"])


def thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(key, below): documents of a source whose place is below that are taken once more. rows: key, place, size; plan: key, rest."""
    found, left = [], plan.select("key", "rest", F.lit(0).cast("long").alias("base"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        buckets = rows.groupBy("key", F.shiftright("place", shift).alias("bucket")).agg(F.sum("size").alias("own"), F.min("place").alias("low"), F.max("place").alias("high"))
        before = F.coalesce(F.sum("own").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        edge = buckets.withColumn("before", before).join(left, "key").withColumn("before", F.col("before") + F.col("base"))
        edge = written(edge.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("own"))))
        nearer = 2 * F.col("rest") > 2 * F.col("before") + F.col("own")
        found.append(edge.where("low = high").select("key", (F.col("low") + nearer.cast("long")).alias("below")))
        several = edge.where("low < high")
        if several.isEmpty():
            break
        rows = written(rows.join(several.select("key", "bucket"), "key").where(F.shiftright("place", shift) == F.col("bucket")).select("key", "place", "size"))
        left = several.select("key", "rest", F.col("before").alias("base"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def mix(docs: DataFrame, weights: DataFrame | None = None, most: int = MOST, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The documents with size (words), source_size, target (words of their source) and taken (words of them that the mix has).

    weights: (source, weight), a row for each source, null for the null one. Without it sources weigh 1, 2, 3, 1, ... by
    code point, null last. taken is size times the number of times that the document is in the mix.
    """
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string"))).alias("key")
    passed = [c for c in keep if c not in OWN]
    rows = written(docs.select(B.packed(docs, passed), key, place(text).alias("place"), F.regexp_count(B.text_or_empty(text), F.lit(WORD)).cast("long").alias("size")))
    sources = rows.groupBy("key").agg(F.sum("size").alias("total"))
    if weights is None:
        listed = F.array(*(F.lit(w) for w in WEIGHTS))
        sources = running(sources, ["key"], rank=F.lit(1)).select("key", "total", F.get(listed, F.pmod("rank", F.lit(len(WEIGHTS))).cast("int")).alias("weight"))
    else:
        sources = sources.join(weights.select(key, "weight"), "key", "left")
    plan = targets(written(sources), most)
    times = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(F.lit(0)).cast("long")
    plan = written(plan.withColumn("times", times).withColumn("rest", F.col("target") - F.col("times") * F.col("total")))
    found = thresholds(rows.select("key", "place", "size"), plan)
    plan = written(plan.join(found, "key", "left").select("key", "total", "target", "times", F.coalesce("below", F.lit(0)).alias("below")))
    taken = F.col("size") * (F.col("times") + (F.col("place") < F.col("below")).cast("long"))
    out = rows.join(plan, "key").select(B.ROW, "size", F.col("total").alias("source_size"), "target", taken.alias("taken"))
    return B.unpacked(out, [*passed, *OWN], {n: n for n in OWN})


def oracle() -> str:
    """The mix in SQL, where documents are sorted by their hash."""
    return f"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 't' || coalesce(text, ''))), 1, 15))::BIGINT AS place FROM documents),
s AS (SELECT key, total, {MOST} * total AS cap, 1 + (row_number() OVER (ORDER BY key) - 1) % 3 AS weight FROM (SELECT key, sum(size)::BIGINT AS total FROM d GROUP BY key)),
r AS (SELECT *, ((sum(total) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
    FROM s WINDOW b AS (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, least(cap::DOUBLE, coalesce((SELECT arg_min(level, (cap / weight, key)) FROM r WHERE cap > level * weight) * weight, cap)) AS target FROM r),
t AS (SELECT *, CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END::BIGINT AS times FROM p),
h AS (SELECT key, place, sum(size) AS own, coalesce(sum(sum(size)) OVER (PARTITION BY key ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d GROUP BY key, place),
e AS (SELECT key, place + (2 * (target - times * total) > 2 * before + own)::BIGINT AS below FROM h JOIN t USING (key) WHERE before <= target - times * total AND target - times * total < before + own)
SELECT doc_id, size, total AS source_size, target, (size * (times + (place < coalesce(below, 0))::BIGINT))::BIGINT AS taken FROM d JOIN t USING (key) LEFT JOIN e USING (key)"""
