"""Nearest neighbours by a permutation index.

Every vector is represented by the order of its nearest pivots. A block of
vectors is posted in inverted files, one for each pivot, that hold the vector
and the pivot's place in its order. A query walks the files of its own nearest
pivots, adds up the footrule distance of the two orders (a pivot missing from
an order counts as behind its end), and the vectors of least footrule are
reranked by the exact inner product in double precision.

The pivots are the only fitted part: ``PIVOTS`` vectors out of ``SAMPLE`` drawn
by the hash of their id, leaving out those that nearly repeat a chosen one. All vectors are indexed, in blocks of bounded size dealt by the hash
of the id; queries meet the blocks in groups of bounded size; each block
returns its best ``k`` for each query and a last window keeps the best of
these. Of equal vectors, a block needs only the ``k + 1`` of smallest id, as
ties go to the smaller id, so a vector that fills a third of the table costs
no recall.

Defined results: vectors that are null, zero, or hold null, NaN or infinite
components take no part, neither as queries nor as candidates, and neither do
rows without an id or of another dimension than the most common one; of rows
that repeat an id each one is a candidate, and one asks: the least vector; a query never finds its own id; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 4096
PIVOTS = 256
ALIKE = 0.8  # a pivot's largest cosine with an earlier one
ORDER = 48
RERANK = 0.15
LEAST_RERANK = 200
BLOCK_ROWS = 8192
BLOCK_BYTES = 32 << 20
GROUP_QUERIES = 4096


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col(embedding)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(v, lambda x: x == 0)
    kept = vectors.where(F.col(vec_id).isNotNull() & v.isNotNull() & ~bad & ~zero)
    return kept.select(F.col(vec_id).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def orders(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """For each row the ORDER nearest pivots, nearest first (ties: the
    earlier pivot)."""
    near = x @ pivots.T
    k = min(ORDER, pivots.shape[0])
    return np.argsort(-near, axis=1, kind="stable")[:, :k].astype(np.int16)


def spread(x: np.ndarray) -> np.ndarray:
    """Up to PIVOTS unit vectors of a sample, no two nearly alike as long as
    the sample has others."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x
    nearest, chosen = np.full(len(x), -np.inf), []
    free = np.ones(len(x), bool)
    while len(chosen) < min(PIVOTS, len(x)):
        open_ = free & (nearest <= ALIKE)
        i = int(np.flatnonzero(open_)[0]) if open_.any() else int(np.where(free, nearest, np.inf).argmin())
        chosen.append(i)
        free[i] = False
        nearest = np.maximum(nearest, x @ x[i])
    return x[chosen]


class Block:
    """Inverted files of one block of vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, k: int) -> None:
        row = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
        order = np.lexsort((ids, np.unique(row, return_inverse=True)[1]))
        same = np.concatenate([[True], row[order][1:] != row[order][:-1]]) if len(row) else np.zeros(0, bool)
        place = np.arange(len(row)) - np.maximum.accumulate(np.where(same, np.arange(len(row)), 0))
        keep = order[place <= k]
        keep = keep[np.argsort(ids[keep], kind="stable")]
        self.ids, self.x, self.pivots = ids[keep], x[keep], pivots
        self.order = orders(self.x, pivots)
        self.depth = self.order.shape[1]
        flat = self.order.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        ends = np.searchsorted(flat[by_pivot], np.arange(len(pivots) + 1))
        rows, places = by_pivot // self.depth, (by_pivot % self.depth).astype(np.int32)
        self.files = [(rows[a:b], places[a:b]) for a, b in zip(ends, ends[1:])]

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Footrule distance of every vector's order to ``order``."""
        n = self.depth
        out = np.full(len(self.ids), n * (n + 1), np.int32)  # nothing in common
        for at, pivot in enumerate(order.tolist()):
            rows, places = self.files[pivot]
            out[rows] += np.abs(places - at) - (n - places) - (n - at)
        return out

    def nearest(self, query: int, v: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, inner products) of the best ``k`` of this block."""
        n = len(self.ids)
        take = max(LEAST_RERANK, k + 1, int(np.ceil(RERANK * n)))
        rank = self.footrule(order).astype(np.int64) * n + np.arange(n)
        rows = np.argpartition(rank, take)[:take] if take < n else np.arange(n)
        rows = rows[self.ids[rows] != query]
        score = (self.x[rows] * v).sum(axis=1)
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows][best], score[best]


def _matrix(t: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    v = t.column("v").combine_chunks()
    return t.column("vec_id").to_numpy(), v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def search(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id",
           embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the ``k``
    nearest of ``vectors`` other than itself."""
    spark = vectors.sparkSession
    data = usable(vectors, vec_id, embedding)
    asked = usable(queries, vec_id, embedding)
    sizes = data.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim, total = (sizes[0]["d"], sizes[0]["count"]) if sizes else (1, 0)
    data = data.where(F.size("v") == dim)
    asked = asked.where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v"))
    drawn = data.select("v", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(min(SAMPLE, BLOCK_BYTES // (8 * dim)))
    pivots = spread(np.array([r["v"] for r in drawn.collect()], np.float64).reshape(-1, dim))
    blocks = max(1, -(-total // max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dim)))))
    groups = max(1, -(-asked.count() // GROUP_QUERIES))
    shared = spark.sparkContext.broadcast(pivots)

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = data.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("part", every(groups))
    right = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")).withColumn("block", every(blocks))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if a.num_rows and b.num_rows:
            block = Block(*_matrix(a, dim), shared.value, k)
            asked_ids, asked_x = _matrix(b, dim)
            for q, v, order in zip(asked_ids.tolist(), asked_x, orders(asked_x, shared.value)):
                ids, score = block.nearest(q, v, order, k)
                for to, some in zip(out, (np.full(len(ids), q), ids, score)):
                    to.append(some)
        q, i, s = (np.concatenate(x) if x else np.zeros(0) for x in out)
        return pa.table({"query_id": pa.array(q.astype(np.int64)), "vec_id": pa.array(i.astype(np.int64)), "score": pa.array(s.astype(np.float64))})

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(
        run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
