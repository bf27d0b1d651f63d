"""A stored inverted index with block maxima: top hits read a few blocks, and a change adds a segment.

A segment has, in Parquet below the index's folder,

  postings  a row for each term and range: the entities of the range that have the term, with term frequencies, the
            largest of these, and the range's text length; a folder for each bucket of terms, sorted by term and range
  forward   a row for each entity: kind, length, range and terms; by buckets of ids
  terms     by how much the segment changes the number of entities that have a term
  gone      entities of earlier segments that this one replaces or removes

A range is some `RANGE` entities of one text length, picked by a hash, so that all ranges of a term have a tight
bound of their scores: its largest frequency in texts of just that length. `top` reads the bounds first (narrow columns
of the terms' buckets), and then postings of the most promising ranges alone, in growing waves, until no range left
can have a hit that belongs to the best; ties included, so that the result is that of reading everything.

Commits list the segments (`versions`), so a reader sees the index before or after a change. `merged` makes one segment
of all. Terms are Porter stems of name, short name and summary; a query asks for all its terms.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphquarry.operators import versions
from graphquarry.operators.components import freed, written
from graphquarry.operators.search import B as LENGTH_SHARE
from graphquarry.operators.search import K1, containing, is_ranked_text, query_terms, stem, words_of
from graphquarry.shipping import ship

RANGE, FIRST_WAVE, PAGE = 1024, 4, 4096
#: Entities whose hits are dealt at once, roughly.
DOCS = 16_000_000
#: Bounds are whole numbers of this unit, rounded up, so that their sums do not depend on an order.
UNIT = 1 << 20
SCHEMAS = {
    "postings": "term string, range long, length long, n long, most long, hits array<struct<id:string,kind:string,tf:long>>, bucket int",
    "forward": "id string, kind string, length long, range long, terms array<struct<term:string,tf:long>>, bucket int",
    "terms": "term string, df long, bucket int",
    "gone": "id string",
}


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


def in_bucket(column: str, buckets: int) -> Column:
    return F.pmod(F.crc32(F.col(column)), F.lit(buckets)).cast("int").alias("bucket")


def idf(docs: int, df: int) -> float:
    return math.log((docs - df + 0.5) / (df + 0.5) + 1)


def part(tf: Column, length: Column, mean: float) -> Column:
    """What one term adds to a score, before its idf; it grows with tf and falls with the length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - LENGTH_SHARE + LENGTH_SHARE * length / F.lit(mean)))


class Index:
    """An index under a path, in its latest version or the given one."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path = spark, path
        self.version, self.state = versions.state_of(spark, path, version)
        self.buckets, self.segments = self.state["buckets"], self.state["segments"]

    @staticmethod
    def create(entities: DataFrame, path: str, buckets: int = 16) -> Index:
        spark = entities.sparkSession
        state = {"buckets": buckets, "segments": [], "docs": 0, "length": 0}
        versions.commit(spark, path, 0, state)
        return Index(spark, path, 0).add(counted(entities))

    def add(self, forward: DataFrame, old: DataFrame | None = None, instead: bool = False) -> Index:
        """Write a segment of (id, kind, length, terms); `old` has the same of entities that go from earlier ones, `instead` drops these segments."""
        name, kept = f"segment-{uuid.uuid4().hex}", [] if instead else self.segments
        root, b, spark = f"{self.path}/{name}", self.buckets, self.spark
        sizes = written(forward.groupBy("length").agg(F.ceil(F.count("*") / RANGE).alias("ranges")))  # its size is known then: few lengths go to the rows
        placed = forward.join(sizes, "length").withColumn("range", F.shiftleft("length", 32) + F.pmod(F.xxhash64("id"), F.col("ranges"))).drop("ranges")
        placed = placed.select("id", "kind", "length", "range", "terms", in_bucket("id", b))
        placed.sortWithinPartitions("bucket", "id").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{root}/forward")  # entities stay where they are
        stored = self.read({"name": name}, "forward")
        hits = stored.select("id", "kind", "length", "range", F.inline("terms")).withColumn("bucket", in_bucket("term", b))
        passes = min(b, 1 + stored.count() // DOCS)
        for n in range(passes):  # hits are dealt once, some buckets at a time, whose shuffle files are gone before the next ones' come
            dealt = hits.where(F.col("bucket") % passes == n).repartitionByRange("bucket", "term", "range")
            blocks = dealt.groupBy("bucket", "term", "range").agg(F.first("length").alias("length"), F.count("*").alias("n"), F.max("tf").alias("most"), F.sort_array(F.collect_list(F.struct("id", "kind", "tf"))).alias("hits"))
            blocks = blocks.select("term", "range", "length", "n", "most", "hits", "bucket").sortWithinPartitions("bucket", "term", "range")
            blocks.write.mode("append").partitionBy("bucket").option("compression", "zstd").parquet(f"{root}/postings")
            del dealt, blocks
            freed(spark)
        new = self.read({"name": name}, "postings").groupBy("term").agg(F.sum("n").alias("df"))
        total = lambda rows: rows.agg(F.count("*").alias("docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
        gain = total(stored)
        loss = {"docs": 0, "length": 0}
        if old is not None:
            old.select("id").write.parquet(f"{root}/gone")
            loss = total(old)
            new = new.unionByName(old.select(F.explode("terms.term").alias("term")).groupBy("term").agg((-F.count("*")).alias("df")))
        new.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0").withColumn("bucket", in_bucket("term", b)).repartition("bucket").sortWithinPartitions("term").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{root}/terms")
        freed(spark)
        before = {"docs": 0, "length": 0} if instead else self.state
        seq = 1 + max([0, *(s["seq"] for s in self.segments)])
        state = self.state | {"segments": [*kept, {"name": name, "seq": seq, "gone": old is not None}], **{k: before[k] + gain[k] - loss[k] for k in ("docs", "length")}}
        return Index(self.spark, self.path, versions.commit(self.spark, self.path, self.version + 1, state))

    def read(self, segment: dict, what: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[what]).parquet(f"{self.path}/{segment['name']}/{what}")

    def every(self, what: str) -> DataFrame:
        """Rows of all segments with the segment's number."""
        found = [self.read(s, what).withColumn("seq", F.lit(s["seq"])) for s in self.segments if what != "gone" or s["gone"]]
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], SCHEMAS[what] + ", seq int")

    def live(self, rows: DataFrame) -> DataFrame:
        """The rows (id, seq) of which no later segment says that they are gone."""
        if not any(s["gone"] for s in self.segments):
            return rows
        gone = self.every("gone").groupBy(F.col("id").alias("gone")).agg(F.max("seq").alias("since"))
        return rows.join(gone, (F.col("id") == F.col("gone")) & (F.col("seq") < F.col("since")), "left_anti")

    def replace(self, entities: DataFrame, removed: DataFrame | None = None) -> Index:
        """The next version: entities come new or instead of those with their ids, and those whose ids are in `removed` (id) go."""
        ids = entities.select("id") if removed is None else entities.select("id").unionByName(removed.select("id"))
        ids = ids.distinct()
        asked = [r[0] for r in ids.select(in_bucket("id", self.buckets)).distinct().collect()]  # as many as there are buckets
        old = self.live(self.every("forward").where(F.col("bucket").isin(asked)).join(ids, "id", "left_semi"))
        return self.add(counted(entities), old)

    def merged(self) -> Index:
        """One segment of all that is live."""
        return self.add(self.live(self.every("forward")).select("id", "kind", "length", "terms"), instead=True)

    def rows_of(self, terms: list[str], what: str) -> DataFrame:
        """Rows of some terms: their buckets' folders, and the row groups that may hold them."""
        return self.every(what).where(F.col("bucket").isin(sorted({bucket_of(t, self.buckets) for t in terms})) & F.col("term").isin(terms))

    def postings(self, terms: list[str]) -> DataFrame:
        """(term, id, tf, length) of some terms, live ones alone: what `search.inverted_index` has of them."""
        return self.live(self.rows_of(terms, "postings").select("term", "length", "seq", F.inline("hits"))).select("term", "id", "tf", "length")

    def weights(self, terms: list[str]) -> dict[str, float]:
        df = {r.term: r.df for r in self.rows_of(terms, "terms").groupBy("term").agg(F.sum("df").alias("df")).collect()}  # a row for each term
        return {t: idf(self.state["docs"], df[t]) for t in terms if df.get(t, 0) > 0}

    def ranked(self, text: str) -> DataFrame:
        """(id, score) of all hits."""
        terms = query_terms(text)
        weights = self.weights(terms)
        if not terms or len(weights) < len(terms):
            return self.spark.createDataFrame([], "id string, score double")
        return self.scored(self.postings(terms), terms, weights).select("id", "score")

    def scored(self, rows: DataFrame, terms: list[str], weights: dict[str, float]) -> DataFrame:
        """Scores of entities that have all terms; parts are added in the order of terms, so that equal entities have equal scores."""
        own = part(F.col("tf"), F.col("length"), self.mean)
        parts = [F.max(F.when(F.col("term") == t, weights[t] * own)) for t in terms]
        return rows.groupBy("id").agg(reduce(lambda a, b: a + b, parts).alias("score")).where("score is not null")

    @property
    def mean(self) -> float:
        return self.state["length"] / max(1, self.state["docs"])

    def bounds(self, terms: list[str], weights: dict[str, float]) -> DataFrame:
        """(bound, seq, range): ranges that have all terms, and the most that an entity there can score."""
        weight = reduce(lambda a, t: a.when(F.col("term") == t, weights[t]), terms, F.when(F.lit(False), 0.0))
        rows = self.rows_of(terms, "postings").select("term", "seq", "range", F.ceil(weight * part(F.col("most"), F.col("length"), self.mean) * UNIT).alias("bound"))
        return rows.groupBy("seq", "range").agg(F.sum("bound").alias("bound"), F.count("*").alias("n")).where(F.col("n") == len(terms)).select("bound", "seq", "range")

    def top(self, text: str, k: int, kind: str | None = None, seen: list | None = None) -> list[tuple[str, float]]:
        """The k best (id, score), better ones first and equal ones by id. seen: gets the number of ranges that were read, by waves."""
        terms = query_terms(text)
        weights = self.weights(terms)
        if not terms or len(weights) < len(terms) or k <= 0:
            return []
        bounds, best, page, last, wave = self.bounds(terms, weights), [], [], None, FIRST_WAVE
        while True:
            if not page:
                left = bounds if last is None else bounds.where((F.col("bound") < last[0]) | ((F.col("bound") == last[0]) & (F.struct("seq", "range") > F.struct(F.lit(last[1]), F.lit(last[2])))))
                page = [tuple(r) for r in left.orderBy(F.col("bound").desc(), "seq", "range").limit(PAGE).collect()]
                if not page:
                    return best
                last = page[-1]
            least = math.floor(best[-1][1] * UNIT) if len(best) == k else 0
            now = [x for x in page[:wave] if x[0] >= least]
            if not now:
                return best
            page, wave = page[wave:], 2 * wave
            if seen is not None:
                seen.append(len(now))
            rows = self.rows_of(terms, "postings").where(F.col("range").isin(sorted({x[2] for x in now})))
            of_seq = reduce(lambda a, b: a | b, ((F.col("seq") == s) & F.col("range").isin([x[2] for x in now if x[1] == s]) for s in {x[1] for x in now}))
            hits = self.live(rows.where(of_seq).select("term", "length", "seq", F.inline("hits")))
            hits = hits if kind is None else hits.where(F.col("kind") == kind)
            found = self.scored(hits, terms, weights).orderBy(F.col("score").desc(), "id").limit(k)
            best = sorted([*best, *((r.id, r.score) for r in found.collect())], key=lambda x: (-x[1], x[0]))[:k]  # 2 k rows at most


def counted(entities: DataFrame) -> DataFrame:
    """(id, kind, length, terms) of entities that have any term. An entity's words lie in its row, so they are counted there and not dealt."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(1 << 16)(stem)
        kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())]))
        for part in parts:
            words = part.column("words").to_pylist()
            terms = [Counter(known(w) if w.isalpha() else w for w in own) for own in words]  # no other word has a stem but itself
            terms = pa.array([[{"term": t, "tf": own[t]} for t in sorted(own)] for own in terms], kind)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("kind"), pa.array([len(own) for own in words], pa.int64()), terms], ["id", "kind", "length", "terms"])

    rows = entities.select("id", "kind", words_of().alias("words")).where("id is not null and size(words) > 0")
    return ship(rows).mapInArrow(run, "id string, kind string, length long, terms array<struct<term:string,tf:long>>")


def find(entities: DataFrame, index: Index | Callable[[], Index], text: str, kind: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """(id, kind, name) in order: ranked hits first, then those that only contain the text, by id; each once, a page of them.

    A page that ranked hits fill needs no scan for the text, and a text that is not of words needs no index: one that is
    given as a function is not made then. Offsets are bounded as in `search.find`.
    """
    from graphquarry.operators.search import checked_page

    checked_page(text, offset)
    need = offset + limit
    best = (index() if callable(index) else index).top(text, need, kind) if is_ranked_text(text) else []
    rows = entities.sparkSession.createDataFrame([(n, i) for n, (i, _) in enumerate(best)], "rank long, id string")
    own = entities if kind is None else entities.where(F.col("kind") == kind)
    if len(best) < need:
        hits = containing(own, text).join(F.broadcast(rows.select("id")), "id", "left_anti")  # `need` rows at most
        rows = rows.unionByName(hits.orderBy("id").limit(need - len(best)).select(F.lit(len(best)).cast("long").alias("rank"), "id"))
    page = rows.orderBy("rank", "id").offset(offset).limit(limit)
    return own.select("id", "kind", "name").join(F.broadcast(page), "id").orderBy("rank", "id").select("id", "kind", "name")
