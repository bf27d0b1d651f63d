"""Nearest vectors by cosine: an index of inverted lists with byte codes, and the exact scan.

`VectorIndex.build` fits centroids on a sample of at most `SAMPLE` vectors (those with the least hashes of their id), and
then puts every vector into the list of its nearest centroid, with a byte for each dimension of what is left between
the two. `search` looks for each query in the lists of its nearest centroids, ranks what is there by the
codes, and ranks the best of these again by the vectors themselves, so that scores are exact; only a neighbour
in a list that was not looked at, or far behind by its code, is missed. How many lists that takes is measured on the
sample: few where vectors lie in groups, most of them where they are noise. `nearest` misses none.

Long lists are cut into parts of about `PART` vectors by a hash of their id, so that no task has more. Centroids are
broadcast: `LISTS` of them at most. Vectors without length, and those of another number of dimensions than
the index, are like nothing and in no list. Equal scores are in order of ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphquarry.functions import expr as X
from graphquarry.operators.components import written
from graphquarry.shipping import ship

SAMPLE, LISTS, PART, STEPS, BLOCK, TRIED, RECALL = 20_000, 1024, 50_000, 12, 512, 500, 0.975
ROWS = "list int, part int, id string, scale float, code binary, vec array<float>"


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-30)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float32).reshape(-1, dim)


def centroids(sample: np.ndarray, many: int) -> np.ndarray:
    """Spherical k-means from the first rows on; a centroid that loses all of its rows stays where it was."""
    at = sample[:many].copy()
    for _ in range(STEPS):
        home = (sample @ at.T).argmax(1)
        sums = np.zeros_like(at)
        np.add.at(sums, home, sample)
        full = np.linalg.norm(sums, axis=1) > 0
        at[full] = unit(sums[full])
    return at


def needed(sample: np.ndarray, centres: np.ndarray, share: float) -> int:
    """How many lists have to be looked at for this share of the 20 nearest of `TRIED` vectors of the sample, themselves apart."""
    at, home = np.linspace(0, len(sample) - 1, min(TRIED, len(sample))).astype(int), (sample @ centres.T).argmax(1)
    scores = sample[at] @ sample.T
    scores[np.arange(len(at)), at] = -2
    near = np.argsort(-scores, axis=1, kind="stable")[:, : min(20, len(sample) - 1)]
    turn = np.empty((len(at), len(centres)), np.int64)
    np.put_along_axis(turn, np.argsort(-(sample[at] @ centres.T), axis=1, kind="stable"), np.arange(len(centres))[None], axis=1)
    turn = np.sort(np.take_along_axis(turn, home[near], axis=1).ravel())
    return int(turn[min(len(turn) - 1, int(np.ceil(share * len(turn))))]) + 1 if len(turn) else len(centres)


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, equal ones by id; some more where the last ones are equal."""
    if len(scores) <= k:
        return np.arange(len(scores))
    return np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])


def usable(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    length = F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    whole = F.size(vec) > 0
    return vectors.where(F.when(whole & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x)), length > 0).otherwise(False))


class VectorIndex:
    def __init__(self, rows: DataFrame, centres: np.ndarray, parts: dict[int, int], probes: int):
        self.rows, self.centres, self.parts, self.probes = rows, centres, parts, probes

    @staticmethod
    def build(vectors: DataFrame, id: str = "entity_id", vec: str = "vec", lists: int | None = None) -> VectorIndex | None:
        """An index of (id, vec), written to the checkpoint folder; None of an empty table. lists: by default twice the root of the number of vectors."""
        rows = usable(vectors.select(F.col(id).cast("string").alias("id"), F.col(vec).cast("array<float>").alias("vec")))
        sizes = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "dim").limit(1).collect()
        if not sizes:
            return None
        dim, n = sizes[0]["dim"], sizes[0]["n"]
        rows = rows.where(F.size("vec") == dim)
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").toArrow()["vec"].combine_chunks()
        many, sample = max(1, min(lists or round(2 * n**0.5), LISTS, len(sample))), unit(matrix(sample, dim))
        centres = centroids(sample, many)
        probes = needed(sample, centres, RECALL)
        shared = rows.sparkSession.sparkContext.broadcast(centres)

        def run(parts):
            for part in parts:
                if not len(part):
                    continue
                own = unit(matrix(part.column(1), dim))
                home = (own @ shared.value.T).argmax(1)
                left = own - shared.value[home]
                scale = np.maximum(np.abs(left).max(1), 1e-30) / 127
                codes = np.round(left / scale[:, None]).astype(np.int8)
                code = pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(np.arange(0, codes.size + 1, dim, dtype=np.int32)), pa.py_buffer(codes)])
                yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), part.column(0), pa.array(scale.astype(np.float32)), code, part.column(1)], ["list", "id", "scale", "code", "vec"])

        made = written(ship(rows).mapInArrow(run, ROWS.replace("part int, ", "")))
        parts = {r["list"]: -(-r["n"] // PART) for r in made.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row for each list
        many_parts = F.element_at(F.create_map(*(F.lit(x) for kv in parts.items() for x in kv)), F.col("list"))
        placed = made.select("list", F.pmod(F.xxhash64("id"), many_parts).cast("int").alias("part"), "id", "scale", "code", "vec")
        return VectorIndex(written(placed.repartitionByRange("list", "part").sortWithinPartitions("list", "part")), centres, parts, probes)

    def search(self, queries: DataFrame, k: int = 20, probes: int | None = None, again: int = 10, id: str = "query", vec: str = "vec", fresh: DataFrame | None = None) -> DataFrame:
        """(query, id, score, rank): of each query (id, vec) the k nearest that are found in the lists of its `probes` nearest centroids.

        probes: by default as many as were needed on the sample for a share of `RECALL`. again: so many times k are ranked again by their vectors. fresh: (id) of the vectors that may be found.
        """
        dim, probes = self.centres.shape[1], min(len(self.centres), probes or self.probes)
        asked = usable(queries.select(F.col(id).alias("query"), F.col(vec).cast("array<float>").alias("vec"))).where(F.size("vec") == dim)
        shared = asked.sparkSession.sparkContext.broadcast((self.centres, self.parts))
        kind = asked.schema["query"].dataType

        def probe(parts):
            centres, many = shared.value
            for part in parts:
                near = np.argsort(-(unit(matrix(part.column(1), dim)) @ centres.T), axis=1, kind="stable")[:, :probes] if len(part) else np.zeros((0, probes), int)
                rows = [(n, l, p) for n, of in enumerate(near.tolist()) for l in of for p in range(many.get(l, 0))]
                at = pa.array([r[0] for r in rows], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())], ["query", "vec", "of", "p"])

        most = again * k
        found_schema = T.StructType([T.StructField("query", kind), T.StructField("id", T.StringType()), T.StructField("near", T.FloatType())])

        def scan(rows: pa.Table, codes: pa.Table) -> pa.Table:
            rows, codes, out = rows.combine_chunks(), codes.combine_chunks(), []
            if len(codes) and len(rows):
                ids = np.asarray(codes.column("id").to_pylist(), object)
                bytes_ = codes.column("code").chunk(0)
                left = np.frombuffer(bytes_.buffers()[2], np.int8)[: 0 if not len(codes) else None]
                start = np.frombuffer(bytes_.buffers()[1], np.int32)[bytes_.offset]
                left = left[start : start + len(codes) * dim].reshape(-1, dim)
                scale, own = np.asarray(codes.column("scale"), np.float32), shared.value[0][codes.column("list")[0].as_py()]
                for a in range(0, len(rows), BLOCK):
                    q = unit(matrix(rows.column("vec").slice(a, BLOCK).combine_chunks(), dim))
                    near = q @ own + (left.astype(np.float32) @ q.T * scale[:, None])
                    for n in range(len(q)):
                        best = top(near[:, n], ids, most)
                        out.append((rows.column("query").slice(a + n, 1).combine_chunks().take(pa.array(np.zeros(len(best), np.int32))), ids[best], near[best, n]))
            if not out:
                return pa.Table.from_pylist([], schema=pa.schema([("query", rows.schema.field("query").type), ("id", pa.string()), ("near", pa.float32())]))
            return pa.table({"query": pa.concat_arrays([x[0] for x in out]), "id": pa.array(np.concatenate([x[1] for x in out]).tolist(), pa.string()), "near": pa.array(np.concatenate([x[2] for x in out]).astype(np.float32))})

        spots = ship(asked).mapInArrow(probe, T.StructType([*asked.schema.fields, T.StructField("of", T.IntegerType()), T.StructField("p", T.IntegerType())]))
        codes = self.rows.select("list", "part", "id", "scale", "code")
        if fresh is not None:
            codes = codes.join(fresh.select("id"), "id", "left_semi").select("list", "part", "id", "scale", "code")
        found = spots.groupBy("of", "p").cogroup(codes.groupBy("list", "part")).applyInArrow(scan, found_schema)
        first = Window.partitionBy("query").orderBy(F.col("near").desc(), "id")
        kept = found.select("*", F.row_number().over(first).alias("n")).where(F.col("n") <= most).select("query", "id")
        rows = kept.join(self.rows.select("id", F.col("vec").alias("__v")), "id").join(asked.select("query", F.col("vec").alias("__q")), "query")
        return ranked(rows.select("query", "id", X.cosine(F.col("__v"), F.col("__q")).alias("score")), k)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.round("score", 12).desc(), "id")
    return scored.where("score is not null").select("query", "id", "score", F.row_number().over(best).alias("rank")).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id: str = "entity_id", vec: str = "vec") -> DataFrame:
    """(query, id, score, rank): the k nearest of each query (query, vec) among all vectors, exactly.

    Queries go round in blocks of bounded size; each task keeps its best for each query.
    """
    rows = usable(vectors.select(F.col(id).cast("string").alias("id"), F.col(vec).cast("array<float>").alias("vec")))
    kind, out = queries.schema["query"].dataType, None
    schema = T.StructType([T.StructField("query", kind), T.StructField("id", T.StringType()), T.StructField("score", T.DoubleType())])
    asked = usable(queries.select("query", F.col("vec").cast("array<float>").alias("vec")))
    block: list = []

    def scanned(block: list) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast([(r["query"], np.asarray(r["vec"], np.float64)) for r in block])

        def run(parts):
            best: dict[int, list] = {}
            for part in parts:
                size = np.asarray(part.column(1).value_lengths(), np.int64)
                for dim in set(size.tolist()):
                    k_ = np.flatnonzero(size == dim)
                    own = unit(matrix(part.column(1).take(pa.array(k_)), dim).astype(np.float64))  # in doubles, as near copies differ by little
                    ids = np.asarray(part.column(0).take(pa.array(k_)).to_pylist(), object)
                    for n, (_, q) in enumerate(shared.value):
                        if len(q) == dim:
                            s = own @ (q / np.linalg.norm(q))
                            at = top(s, ids, k)
                            best[n] = sorted([*best.get(n, []), *zip((-np.round(s[at], 12)).tolist(), ids[at].tolist(), s[at].tolist(), strict=True)])[:k]
            found = [(shared.value[n][0], i, s) for n, x in best.items() for _, i, s in x]
            yield pd.DataFrame(found, columns=["query", "id", "score"])

        return ship(rows).mapInArrow(lambda parts: (pa.RecordBatch.from_pandas(x, preserve_index=False) for x in run(parts) if len(x)), schema)

    for r in asked.toLocalIterator():
        block.append(r)
        if len(block) == BLOCK:
            out, block = scanned(block) if out is None else out.unionByName(scanned(block)), []
    if block:
        out = scanned(block) if out is None else out.unionByName(scanned(block))
    return ranked(out if out is not None else rows.sparkSession.createDataFrame([], schema), k)
