"""Approximate nearest neighbours by a hash-prefix forest.

Every vector gets one long string of sign bits in each of TREES trees; the sorted array of a tree's strings is its
prefix tree, the vectors that share a prefix being one range of it. Every task keeps the sorted arrays of up to SHARD vectors at a
time; a query's range in each is found by binary search, and adds up over all of them.

A query first descends to its longest prefix that ENOUGH vectors, over all trees, share with it, and is compared exactly with these. With s the
k-th best similarity so far, two vectors of similarity s share a prefix of d bits in a tree with probability (1 - arccos(s) / pi) ** d: the query
ascends, in all trees at once, to the longest prefix for which all trees together miss such a vector with a probability of at most
MISS, and is compared with all vectors that share it. At prefix length 0 all vectors are candidates: a query which ascends
that far is answered exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import whole_id, written

TREES = 24
BITS = 60
#: Longest prefix that is told apart; so many vectors share it where N is over 2 ** DEPTHS times as many.
DEPTHS = 40
NEIGHBOURS = 10
#: Every so many ids are queries.
EVERY = 50
#: Shared prefixes, over all trees, that a query descends to.
ENOUGH = 400
MISS = 0.05
SEED = 23
#: Vectors in the sorted arrays of a task at once, queries told to all tasks at once, queries multiplied at once.
SHARD, BLOCK, ROWS = 1 << 16, 1 << 14, 128


def planes(dimension: int, trees: int = TREES, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dimension, trees * BITS), dtype=np.float32)


def strings(vectors: np.ndarray, hyperplanes: np.ndarray) -> np.ndarray:
    """(vectors, trees) strings of BITS bits, the first bit highest, as int64."""
    weight = np.left_shift(np.int64(1), np.arange(BITS - 1, -1, -1, dtype=np.int64))
    out = np.empty((len(vectors), hyperplanes.shape[1] // BITS), np.int64)
    for start in range(0, len(vectors), 1 << 12):
        signs = (vectors[start : start + (1 << 12)] @ hyperplanes > 0).reshape(-1, out.shape[1], BITS)
        out[start : start + (1 << 12)] = signs @ weight
    return out


def usable(embeddings: DataFrame) -> DataFrame:
    """(id, vector) of rows that can be searched: unit vectors of one length, the commonest (the longest of equally common)."""
    value = F.col("embedding").cast("array<float>")
    rows = embeddings.where("try_cast(vec_id as bigint) is not null and embedding is not null and size(embedding) > 0").select(whole_id("vec_id").alias("id"), value.alias("vector"))
    rows = rows.where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = rows.withColumn("norm", norm).where("norm > 0")
    rows = rows.groupBy("id").agg(F.min(F.struct("vector", "norm")).alias("one")).select("id", "one.*")
    rows = rows.select("id", F.transform("vector", lambda x: (x.cast("double") / F.col("norm")).cast("float")).alias("vector"))
    rows = written(rows, "vectors")
    size = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("vector") == (size.n if size else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.float32)


class Forest:
    """The sorted arrays of some vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, hyperplanes: np.ndarray):
        self.ids, self.vectors = ids, vectors
        found = strings(vectors, hyperplanes)
        self.order = np.argsort(found, axis=0, kind="stable")
        self.sorted = np.take_along_axis(found, self.order, axis=0)

    def ranges(self, asked: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, trees) begin and end of the range of vectors that share depth bits with each query's strings."""
        low = (BITS - depth).astype(np.int64)
        begin, end = np.empty(asked.shape, np.int64), np.empty(asked.shape, np.int64)
        for t in range(asked.shape[1]):
            prefix = asked[:, t] >> low
            begin[:, t] = np.searchsorted(self.sorted[:, t], prefix << low)
            end[:, t] = np.searchsorted(self.sorted[:, t], ((prefix + 1) << low) - 1, side="right")
        return begin, end

    def best(self, ids: np.ndarray, vectors: np.ndarray, asked: np.ndarray, depth: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, id, similarity) of the k best, equal ones by id, of the vectors that share depth bits with a query in any tree; itself not counted."""
        begin, end = self.ranges(asked, depth)
        few = (end - begin).sum(axis=1) < len(self.ids) / 8
        for q in np.flatnonzero(few):
            some = np.unique(np.concatenate([self.order[a:b, t] for t, (a, b) in enumerate(zip(begin[q], end[q]))]))
            yield self._top(ids[q], self.ids[some], self.vectors[some] @ vectors[q], k)
        many = np.flatnonzero(~few)
        for start in range(0, len(many), ROWS):
            rows = many[start : start + ROWS]
            products = vectors[rows] @ self.vectors.T
            for q, near in zip(rows, products):
                if depth[q]:
                    shared = np.zeros(len(self.ids), bool)
                    for t, (a, b) in enumerate(zip(begin[q], end[q])):
                        shared[self.order[a:b, t]] = True
                    yield self._top(ids[q], self.ids[shared], near[shared], k)
                else:
                    yield self._top(ids[q], self.ids, near, k)

    @staticmethod
    def _top(query: int, ids: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        near = np.where(ids == query, np.float32(-2), near)
        if len(near) > k:
            some = np.flatnonzero(near >= -np.partition(-near, k - 1)[k - 1])
            ids, near = ids[some], near[some]
        some = np.lexsort((ids, -near))[:k]
        some = some[near[some] > -2]
        return np.full(len(some), query), ids[some], near[some]


def _over_shards(vectors: DataFrame, work: Callable[[Forest], Iterator[pa.RecordBatch]], trees: int, seed: int, schema: str) -> DataFrame:
    """What work makes of the forests of all vectors, SHARD of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0

        def built(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(parts)
            matrix = _matrix(table["vector"].combine_chunks())
            yield from work(Forest(table["id"].to_numpy(), matrix, planes(matrix.shape[1], trees, seed)))

        for batch in batches:
            for start in range(0, batch.num_rows, SHARD):
                part = batch.slice(start, SHARD)
                if rows + part.num_rows > SHARD:
                    yield from built(waiting)
                    waiting, rows = [], 0
                waiting.append(part)
                rows += part.num_rows
        if rows:
            yield from built(waiting)

    return vectors.mapInArrow(run, schema)


def _longest(vectors: DataFrame, known, trees: int, seed: int, enough: int) -> np.ndarray:
    """Per query of a block the longest prefix that enough others, over all trees, share with it; 0 where there are fewer."""

    def counted(forest: Forest) -> Iterator[pa.RecordBatch]:
        _, _, asked = known.value
        for depth in range(1, DEPTHS + 1):
            begin, end = forest.ranges(asked, np.full(len(asked), depth))
            n = (end - begin).sum(axis=1)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), depth, np.int32)), pa.array(n[some])], names=["query", "depth", "n"])
            if not len(some):
                break

    counts = _over_shards(vectors, counted, trees, seed, "query long, depth int, n long").groupBy("query", "depth").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= enough + trees).groupBy("query").agg(F.max("depth").alias("depth")).toArrow()  # itself is in each tree; a row for each query of the block
    depth = np.zeros(len(known.value[0]), np.int64)
    depth[found["query"].to_numpy()] = found["depth"].to_numpy()
    return depth


def _compared(vectors: DataFrame, known, depth: np.ndarray, who: np.ndarray, k: int, trees: int, seed: int) -> DataFrame:
    """(query, id, rank, similarity) of the k best that share depth bits with each query of a block that is among who."""
    told = vectors.sparkSession.sparkContext.broadcast((who, depth[who]))

    def best(forest: Forest) -> Iterator[pa.RecordBatch]:
        (ids, own, asked), (some, bits) = known.value, told.value
        for start in range(0, len(some), ROWS * 8):
            part = some[start : start + ROWS * 8]
            out = list(forest.best(ids[part], own[part], asked[part], bits[start : start + ROWS * 8], k))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(3)], names=["query", "id", "similarity"])

    found = _over_shards(vectors, best, trees, seed, "query long, id long, similarity float")
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "id", "rank", "similarity")


def neighbours(embeddings: DataFrame, k: int = NEIGHBOURS, every: int = EVERY, trees: int = TREES, miss: float = MISS, enough: int = ENOUGH, seed: int = SEED) -> DataFrame:
    """(vec_id, neighbour_id, rank, similarity, prefix) of the k nearest, by cosine, of every vector whose vec_id is a multiple of every, among all vectors.

    embeddings: vec_id, embedding; others are ignored. rank counts from 1, equal similarities by neighbour_id; prefix is the prefix length at which the search ended. A vector is not its own
    neighbour; equal vectors of other vec_ids are. Rows without a vec_id that is a whole number, null, empty or zero vectors, and
    vectors with a null, NaN or infinite value or of another length than most have no neighbours and are none. Rows of equal
    vec_id count once, by the least vector. Fewer than k others: all of them. An empty table gives no rows. miss of 0: exact.

    Queries go in blocks of about BLOCK, each told to all tasks; with few queries that is one.
    """
    vectors = usable(embeddings)
    queries = vectors.where(F.pmod("id", F.lit(every)) == 0)
    blocks = -(-queries.count() // BLOCK)
    done: list[DataFrame] = []
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow().sort_by("id").combine_chunks()
        if not own.num_rows:
            continue
        matrix = _matrix(own["vector"].combine_chunks())
        known = vectors.sparkSession.sparkContext.broadcast((own["id"].to_numpy(), matrix, strings(matrix, planes(matrix.shape[1], trees, seed))))
        first = _longest(vectors, known, trees, seed, enough)
        found = written(_compared(vectors, known, first, np.arange(len(first)), k, trees, seed), "first")
        worst = found.groupBy("query").agg(F.count("*").alias("n"), F.min("similarity").alias("s")).toArrow()
        s = np.full(len(first), -1.0)
        full = worst["n"].to_numpy() >= k
        s[np.searchsorted(own["id"].to_numpy(), worst["query"].to_numpy()[full])] = worst["s"].to_numpy()[full]
        share = 1 - np.arccos(np.clip(s, -1, 1)) / np.pi
        missed = (1 - share[:, None] ** np.arange(DEPTHS + 1)) ** trees  # grows with the prefix; none is missed at 0
        last = np.minimum((missed <= miss).sum(axis=1) - 1, first)
        more = np.flatnonzero(last < first)
        ends = vectors.sparkSession.createDataFrame(pa.table({"query": own["id"].combine_chunks(), "prefix": pa.array(last.astype(np.int32)), "again": pa.array(last < first)}))
        done.append(found.join(ends.where("not again"), "query").drop("again"))
        if len(more):
            again = written(_compared(vectors, known, last, more, k, trees, seed), "again")
            done.append(again.join(ends.where("again"), "query").drop("again"))
    if not done:
        return vectors.sparkSession.createDataFrame([], "vec_id long, neighbour_id long, rank int, similarity double, prefix int")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(F.col("query").alias("vec_id"), F.col("id").alias("neighbour_id"), "rank", F.col("similarity").cast("double").alias("similarity"), "prefix")
