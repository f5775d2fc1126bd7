"""Exact top-k search by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are dealt into segments of bounded size. A segment has, for each dimension, the list of its
vectors sorted by that component. A query walks the lists of all dimensions at once, from the top
where its own component is positive and from the bottom where it is negative. Vectors are scored in
full when first seen. The components at the depth reached bound the score of all that is unseen;
the walk stops when that bound cannot reach the k-th score so far, over all segments of the lane.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill.llm.common import stored, table

SEGMENT, BLOCK, LANE = 4096, 256, 8  # vectors in a segment, queries in a block, segments in a lane


class Segment:
    """Vectors (integers) with their sorted lists."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        largest = np.abs(vectors).max(initial=0)
        exact = np.float32 if largest * largest * vectors.shape[1] < 1 << 24 else np.float64  # products are whole numbers
        self.ids, self.x = ids[order], vectors[order].astype(exact)
        down = np.argsort(-self.x, axis=0, kind="stable").astype(np.int32)
        self.lists = down, down[::-1]  # from the top and from the bottom; a column is a dimension's list
        values = np.take_along_axis(self.x, down, axis=0).astype(np.float64)
        self.values = values, values[::-1]

    def search(self, query_id: int, q: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """best (scores, ids), at most k of them and in order, with this segment's vectors taken in."""
        n = len(self.ids)
        sides = [(lists, values, dims, q[dims]) for lists, values, dims in zip(self.lists, self.values, (np.nonzero(q > 0)[0], np.nonzero(q < 0)[0]), strict=True)]
        own = q.astype(self.x.dtype)
        scores, ids = best
        seen = self.ids == query_id
        left, depth, step = n - int(seen.sum()), 0, max(k, n // 24)
        if len(scores) == k and self.bound(sides, 0) < scores[-1]:
            return best
        while left:
            end = min(n, depth + step)
            new = np.zeros(n, bool)
            for lists, _, dims, _ in sides:
                new[lists[depth:end, dims].ravel()] = True
            if end == n:
                new[:] = True  # dimensions in which the query is 0 have no list to walk
            new &= ~seen
            at = np.nonzero(new)[0]
            seen |= new
            left -= len(at)
            if len(at):
                found = ((self.x @ own)[at] if 4 * len(at) > n else self.x[at] @ own).astype(np.float64)
                if len(scores) == k:  # what doesn't reach the k-th score can't stay
                    reach = found >= scores[-1]
                    at, found = at[reach], found[reach]
                s, i = np.concatenate([scores, found]), np.concatenate([ids, self.ids[at]])
                if len(s) > 4 * k:  # only what reaches the k-th score, ties with it too
                    keep = s >= np.partition(s, len(s) - k)[len(s) - k]
                    s, i = s[keep], i[keep]
                order = np.lexsort((i, -s))[:k]
                scores, ids = s[order], i[order]
            if len(scores) == k and self.bound(sides, end - 1) < scores[-1]:
                break
            depth, step = end, 2 * step
        return scores, ids

    @staticmethod
    def bound(sides: list, at: int) -> float:
        """The most that a vector can score that no list has shown down to depth `at`."""
        return sum(float(w @ values[at, dims]) for _, values, dims, w in sides)


def quantised(vectors: DataFrame, id_col: str, vector: str, scale: float) -> DataFrame:
    """id and v (integers floor(scale * x)); rows with a null id or a null or non-finite component go."""
    x = F.col(vector)
    whole = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & F.coalesce(whole, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("double")).alias("v"))


def top_k(queries: DataFrame, vectors: DataFrame, *, k: int = 20) -> DataFrame:
    """queries and vectors (id, v as from quantised()) to query_id, rank, vec_id, score.

    All vectors but those with the query's own id are candidates; ties go to the smaller id.
    Vectors of another length than the query's are no candidates. Rows that repeat an id each count.
    No queries or no vectors give no rows. A lane returns at most k rows a query.
    """
    queries = stored(queries.select(F.col("id"), "v", F.size("v").alias("dim")), "topk-queries")
    vectors = stored(vectors.select(F.col("id"), "v", F.size("v").alias("dim")), "topk-vectors")
    nq, nv = queries.count(), vectors.count()
    blocks, segments = max(1, -(-nq // BLOCK)), max(1, -(-nv // SEGMENT))
    lanes = -(-segments // LANE)
    deal = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(n)).cast("int")
    left = queries.withColumn("block", deal(blocks, "q")).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    right = vectors.withColumn("segment", deal(segments, "v")).withColumn("lane", (F.col("segment") / LANE).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dim, own in q.groupby("dim"):
            there = v[v["dim"] == dim]
            parts = [Segment(s["id"].to_numpy(np.int64), np.stack(s["v"].to_numpy())) for _, s in there.groupby("segment")]
            for i, x in zip(own["id"].to_numpy(np.int64), own["v"], strict=True):
                best = np.zeros(0), np.zeros(0, np.int64)
                for part in parts:
                    best = part.search(i, np.asarray(x), k, best)
                out.append(pd.DataFrame({"query_id": i, "vec_id": best[1], "score": best[0].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(np.int64)

    found = left.groupBy("block", "lane").cogroup(right.groupBy("block", "lane")).applyInPandas(search, "query_id long, vec_id long, score long")
    return ranked(found, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    return top_k(vectors.where(F.col("id") % 20 == 0), vectors, k=20)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64.0::DOUBLE * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0
)
SELECT query_id, row_number() OVER r::INT AS rank, vec_id, score FROM s
WINDOW r AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER r <= 20
"""
