"""Nearest neighbours by a hash-prefix forest.

The corpus is dealt by a hash of its ids into shards of about ``SHARD_ROWS`` vectors.  A shard's rows reach one task in
order: first its vectors, which become the forest, then the queries, which are streamed past it ``QUERY_ROWS`` at a time.
So the corpus is exchanged once, a forest is built once, a stated query set meets all rows in blocks, and no task grows
with the table.  Inside a shard every vector is indexed, in ``TREES`` trees.  A tree is a sorted array of
``BITS``-bit hash strings, one bit per random hyperplane.  A query descends each tree to its longest prefix matches,
then ascends in all trees at once: at depth d its candidates share the first d bits with it in some tree.

How far it ascends follows from what it found.  Two vectors at angle a share d bits of a tree with probability
(1 - a/pi)**d; with the similarity of the k-th best candidate so far, the chance that one as near is still unseen is
(1 - p**d)**TREES.  The query stops where that chance is at most ``MISS``.  Queries with near copies stop deep, queries
without neighbours ascend far; no bound cuts the candidates.

Inner products of vectors of different length become angles by one more component, sqrt(max norm**2 - norm**2).

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows
without id; an id that repeats counts once, with its smallest vector; vectors of different dimensions are never
compared; an empty table gives no rows; ties go to the smaller id; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 16384
LEAST_ROWS = 2048  # of a shard that only gives another task something to do
QUERY_ROWS = 1024
TREES = 48
BITS = 32
MISS = 0.1
NEAREST = 20


def usable(vector: Column) -> Column:
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(ok & F.exists(vector, lambda x: x != 0), F.lit(False))


class Forest:
    """Sorted hash strings of one shard's vectors (rows of ``vectors``, float32)."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, seed: int = 11):
        self.vectors, self.trees = vectors, trees
        norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64))
        self.top = float(norms.max())
        self.planes = np.random.default_rng(seed).normal(
            size=(vectors.shape[1] + 1, trees * BITS)).astype(np.float32)
        lifted = np.column_stack([vectors / self.top, np.sqrt(np.maximum(0, 1 - (norms / self.top) ** 2))])
        self.codes = self._hash(lifted.astype(np.float32))
        self.order = np.argsort(self.codes, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(self.codes, self.order, 0).T.copy()
        self.order = self.order.T.copy()

    def _hash(self, lifted: np.ndarray) -> np.ndarray:
        weights = (1 << np.arange(BITS - 1, -1, -1, dtype=np.uint64))
        out = np.empty((len(lifted), self.trees), np.uint64)
        for a in range(0, len(lifted), 4096):
            bits = (lifted[a:a + 4096] @ self.planes > 0).reshape(-1, self.trees, BITS)
            out[a:a + 4096] = bits @ weights
        return out

    def ranges(self, codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(trees, queries): where the strings with the first ``depth`` bits of each query lie."""
        shift = np.uint64(BITS - depth)
        first = (codes >> shift) << shift
        low = np.stack([np.searchsorted(s, f, "left") for s, f in zip(self.sorted, first.T, strict=True)])
        last = first + ((np.uint64(1) << shift) - np.uint64(1))
        high = np.stack([np.searchsorted(s, f, "right") for s, f in zip(self.sorted, last.T, strict=True)])
        return low, high

    def search(self, queries: np.ndarray, ids: np.ndarray, query_ids: np.ndarray, k: int,
               miss: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (positions, double-precision scores) of its k nearest found, nearest first."""
        lengths = np.sqrt(np.einsum("ij,ij->i", queries, queries, dtype=np.float64))
        codes = self._hash(np.column_stack([queries / lengths[:, None], np.zeros(len(queries))]).astype(np.float32))
        spans: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def at(depth: int) -> tuple[np.ndarray, np.ndarray]:
            if depth not in spans:
                spans[depth] = self.ranges(codes, depth)
            return spans[depth]

        out = []
        for i, q in enumerate(queries):
            # descend: the deepest level with enough matches to judge by
            depth = BITS
            while depth and int((at(depth)[1][:, i] - at(depth)[0][:, i]).sum()) < 8 * k:
                depth -= 1
            while True:
                low, high = at(depth)
                seen = np.zeros(len(self.vectors), bool)
                for t in range(self.trees):
                    seen[self.order[t, low[t, i]:high[t, i]]] = True
                found = np.flatnonzero(seen)
                found = found[ids[found] != query_ids[i]]
                near = self.vectors[found] @ q
                if depth == 0:
                    break
                if len(found) > k:
                    kth = float(np.partition(near, len(near) - k)[len(near) - k])
                    p = 1 - math.acos(max(-1.0, min(1.0, kth / (lengths[i] * self.top)))) / math.pi
                    # the depth at which the chance to miss such a neighbour is small enough
                    share = 1 - miss ** (1 / self.trees)
                    want = int(math.log(share) / math.log(p)) if 0 < p < 1 else BITS if p else 0
                    if want >= depth:
                        break
                    # one stop on the way sharpens the estimate before most candidates are read
                    depth = max(want, 0) if depth - want <= 3 else depth - max(2, (depth - want) // 2)
                else:
                    depth -= 1
            if len(found) > k:
                kth = np.partition(near, len(near) - k)[len(near) - k]
                found = found[near >= kth - 1e-5 * max(1.0, lengths[i] * self.top)]
            # row by row in one order of summation, so equal vectors score alike
            scores = (self.vectors[found].astype(np.float64) * q.astype(np.float64)).sum(1)
            best = np.lexsort((ids[found], -scores))[:k]
            out.append((found[best], scores[best]))
        return out


SCHEMA = "query_id long, vec_id long, score double"


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _walk(k: int, miss: float, trees: int, query_rows: int):
    """Rows sorted by (shard, dim, is_query, vec_id): each shard's vectors, then the queries that meet them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, forest, own = None, [], None, None
        for batch in batches:
            place = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], 1)
            ids = batch.column(3).to_numpy()
            cut = np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(ids)], strict=True):
                if a == b:
                    continue
                if (shard := tuple(place[a, :2].tolist())) != here:
                    here, held, forest = shard, [], None
                if not place[a, 2]:
                    held.append((ids[a:b], _matrix(batch.column(4).slice(a, b - a))))
                    continue
                if forest is None:
                    if not held:  # no vector of this length here
                        continue
                    own = np.concatenate([x for x, _ in held])
                    forest = Forest(np.concatenate([x for _, x in held]), trees)
                    held = []
                for c in range(a, b, query_rows):
                    d = min(b, c + query_rows)
                    found = forest.search(_matrix(batch.column(4).slice(c, d - c)), own, ids[c:d], k, miss)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(ids[c:d], [len(x) for x, _ in found])),
                         pa.array(np.concatenate([own[x] for x, _ in found])), pa.array(np.concatenate([y for _, y in found]))],
                        names=["query_id", "vec_id", "score"])
    return run


def nearest(embeddings: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding",
            k: int = NEAREST, miss: float = MISS, trees: int = TREES, shard_rows: int = SHARD_ROWS,
            query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row where ``is_query`` (of ``vec_id``) holds."""
    rows = (embeddings.where(usable(F.col(vector)) & F.col(vec_id).isNotNull())
            .select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
            .groupBy("vec_id").agg(F.min("vector").alias("vector"))
            .withColumn("dim", F.size("vector")))
    total = embeddings.agg(F.count(vec_id)).first()[0]
    tasks = embeddings.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-total // shard_rows), min(tasks, total // LEAST_ROWS))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards).cast("long"))
    corpus = rows.withColumn("shard", shard).withColumn("is_query", F.lit(False))
    queries = (rows.where(is_query).withColumn("is_query", F.lit(True))
               .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))))
    columns = ["shard", "dim", "is_query", "vec_id", "vector"]
    found = (corpus.select(columns).unionByName(queries.select(columns))
             .repartition(shards, "shard").sortWithinPartitions(*columns[:4])
             .mapInArrow(_walk(k, miss, trees, query_rows), SCHEMA))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (found.withColumn("rank", place).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
