"""Approximate nearest neighbours by collision counting over single projections.

Rows fall into blocks by a hash. A block keeps, for each of PROJECTIONS random directions, its vectors sorted by their
projection. For a query, a window centred on the query's own projection is opened in every sorted array; a vector
collides in each array whose window holds it. Vectors with at least THRESHOLD of all collisions are verified by their
exact distance. Virtual rehashing widens all windows by GROWTH, counting only what is new, until the k-th verified
distance is at most REACH half-widths, or the block is exhausted. A block's best k go to a merge that ranks them.

A row of the base set moves once, to its block; queries, a stated set, go to every block. A partition is sorted by
block with the block's vectors before its queries and is streamed: a block's arrays are built once, and memory holds
one block and one batch of queries, whatever the size of either side.

Defined cases: vectors that are null, zero, hold null or non-finite components, or differ in length from a query take
no part with it; rows with a null vec_id take no part; ties go to the smaller vec_id; rows that repeat a vec_id answer
once, with the nearest; fewer candidates than k give all of them; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

PROJECTIONS, THRESHOLD, GROWTH, REACH = 96, 0.6, 1.2, 1.1
BLOCK_ROWS = 8192


def sound(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of doubles) of rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0.0))


def exact(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = vectors - q
    return np.sqrt((d * d).sum(axis=1))


class Block:
    """Sorted single-projection arrays of one block of vectors of one length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS):
        self.ids, self.vectors, self.verified, self.searches = ids, vectors, 0, 0
        self.directions = np.random.default_rng(6).normal(size=(vectors.shape[1], projections))
        p = (vectors @ self.directions).T
        self.order = p.argsort(axis=1, kind="stable")
        self.sorted = np.take_along_axis(p, self.order, axis=1)
        # First half-width: so wide that about 1 in 10 rows falls into a window at the middle of an array.
        n = len(ids)
        lo, hi = self.sorted[:, int(n * 0.45)], self.sorted[:, min(n - 1, int(n * 0.55))]
        self.start = max(float(np.median(hi - lo)) / 2, float(np.median(self.sorted[:, -1] - self.sorted[:, 0])) / max(n, 2), 1e-12)

    def search(self, q: np.ndarray, k: int, skip: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct ids and distances of at most k found, nearest first."""
        n, m = len(self.ids), len(self.sorted)
        at, counts, dist = q @ self.directions, np.zeros(n, np.int64), np.full(n, np.inf)
        low = high = [int(np.searchsorted(p, a)) for p, a in zip(self.sorted, at)]
        own, half, need = self.ids == skip, self.start, int(np.ceil(THRESHOLD * m))
        while True:
            wider = [(int(np.searchsorted(p, a - half, "left")), int(np.searchsorted(p, a + half, "right"))) for p, a in zip(self.sorted, at)]
            fresh = [o[a:b] for o, (x, _), y in zip(self.order, wider, low) for a, b in ((x, y),)] + [o[a:b] for o, (_, x), y in zip(self.order, wider, high) for a, b in ((y, x),)]
            counts += np.bincount(np.concatenate(fresh), minlength=n)
            low, high = [x for x, _ in wider], [x for _, x in wider]
            new = np.flatnonzero((counts >= need) & ~own & np.isinf(dist))
            if len(new):
                dist[new] = exact(self.vectors[new], q)
            found = np.flatnonzero(dist <= REACH * half)
            done = max(low) == 0 and min(high) == n
            if done or len(np.unique(self.ids[found])) >= k:
                break
            half *= GROWTH
        found = np.flatnonzero(np.isfinite(dist))
        self.verified, self.searches = self.verified + len(found), self.searches + 1
        best = found[np.lexsort((self.ids[found], dist[found]))]
        best = best[np.sort(np.unique(self.ids[best], return_index=True)[1])][:k]
        return self.ids[best], dist[best]


def _answers(rows: list, queries: list, k: int) -> list:
    """(query_id, vec_id, score) columns for each of the queries against a block's arrays by length of vector."""
    out = []
    for qid, v in queries:
        if (block := rows.get(len(v))) is not None:
            ids, dist = block.search(v, k, qid)
            out.append((np.full(len(ids), qid, np.int64), ids, dist))
    return out


def _searcher(k: int):
    """Streams a partition sorted by block, and in it by kind: rows of the base set, then queries."""
    def pairs(batch):
        lists = batch.column("v")
        values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        return zip(batch.column("block").to_pylist(), batch.column("kind").to_pylist(), batch.column("id").to_pylist(), (values[a:b] for a, b in zip(offsets[:-1], offsets[1:])))

    def arrays(members):
        sizes = {len(v) for _, v in members}
        return {n: Block(np.array([i for i, v in members if len(v) == n], np.int64), np.stack([v for _, v in members if len(v) == n])) for n in sizes}

    def run(batches):
        current, members, built = None, [], None
        for batch in batches:
            asked, out = [], []
            for block, kind, i, v in pairs(batch):
                if block != current:
                    out += _answers(built or {}, asked, k)
                    current, members, built, asked = block, [], None, []
                if kind == 0:
                    members.append((i, v))
                else:
                    if built is None:
                        built, members = arrays(sorted(members, key=lambda r: (r[0], r[1].tobytes()))), []
                    asked.append((i, v))
            out += _answers(built or {}, asked, k)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for queries(vec_id, embedding) against vectors(vec_id, embedding)."""
    blocks = max(1, -(-vectors.count() // block_rows))
    rows = sound(vectors).distinct().select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "v")
    asked = sound(queries).distinct().select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), F.col("vec_id").alias("id"), "v")
    # Three partitions for each block, so that few blocks share one.
    dealt = rows.unionByName(asked).repartition(3 * blocks, "block").sortWithinPartitions("block", "kind")
    met = dealt.mapInArrow(_searcher(k), "query_id long, vec_id long, score double")
    one = met.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir):
    from .common import table

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where("vec_id % 100 = 0"), 10)
