"""An index of vectors on disk: inverted lists around coarse centroids.

Centroids are trained on a bounded sample; every vector is written to the list of its nearest one,
with its norm. A search ranks the centroids for each query, reads the folders of the `nprobe` lists
alone, and scores what is there exactly. With all lists it is the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from lakequill.functions import vectors as V
from lakequill.session import stored

SAMPLE = 65_536  # vectors at most that centroids are trained on, drawn by hash of the id
QUERY_BYTES = 64 << 20  # of queries that one pass over the lists holds; more take more passes
CELLS = 1 << 22  # scores that a task holds at once


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists without nulls, all of one length, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1)


def has_angle(vector: str) -> Column:
    """Whether a vector is there, is finite and has a length above zero."""
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    return vectors.where(has_angle(vector))


def drawn(vectors: DataFrame, total: int, *, id_col: str, vector: str, sample: int = SAMPLE) -> np.ndarray:
    """Unit vectors, `sample` of the total at most, that the hash of the id draws, in its order."""
    share = min(1.0, 1.2 * sample / max(1, total))
    some = vectors.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    return unit(matrix(some.select(id_col, vector).orderBy(F.xxhash64(id_col), id_col).limit(sample).toArrow().column(1).combine_chunks()))


def clustered(rows: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids, `lists` at most, of unit vectors: spherical k-means."""
    centroids = rows[np.random.default_rng(7).permutation(len(rows))[:lists]]
    for _ in range(rounds):
        home = np.argmax(rows @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, rows)
        empty = ~np.bincount(home, minlength=len(centroids)).astype(bool)
        centroids = np.where(empty[:, None], centroids, unit(sums))
    return centroids


def train(vectors: DataFrame, *, lists: int, id_col: str, vector: str, sample: int = SAMPLE) -> np.ndarray:
    """Unit centroids, `lists` at most, from a sample that the hash of the id draws."""
    total = vectors.count()
    return clustered(drawn(vectors, total, id_col=id_col, vector=vector, sample=sample), lists) if total else np.zeros((0, 1))


def assigned(vectors: DataFrame, centroids: np.ndarray, vector: str) -> DataFrame:
    """vectors with list (number of the nearest centroid) and norm."""
    names = vectors.columns
    at = names.index(vector)
    held = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = matrix(batch.column(at))
                norms = np.linalg.norm(rows, axis=1)
                home = np.argmax(rows @ held.value.T, axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32()), pa.array(norms, pa.float64())], [*names, "list", "norm"])

    return vectors.mapInArrow(run, StructType(list(vectors.schema.fields)).add("list", "integer").add("norm", "double"))


class VectorIndex:
    """An index at a path. Columns named list and norm are the index's own."""

    def __init__(self, spark: SparkSession, path: str, *, id_col: str = "chunk_id", vector: str = "embedding"):
        self.spark, self.path, self.id_col, self.vector = spark, path, id_col, vector
        rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
        self.centroids = np.array([r["centroid"] for r in rows], dtype=np.float64).reshape(len(rows), -1 if rows else 0)

    @classmethod
    def build(cls, vectors: DataFrame, path: str, *, id_col: str = "chunk_id", vector: str = "embedding", lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """Train, assign and write. lists: by default the square root of the number of vectors, 4096 at most.

        Vectors that are null, not finite, or of length zero are left out; they have no cosine.
        """
        good = usable(vectors, vector)
        lists = lists or max(1, min(4096, round(good.count() ** 0.5)))
        centroids = train(good, lists=lists, id_col=id_col, vector=vector, sample=sample)
        rows = [(i, c.tolist()) for i, c in enumerate(centroids)]
        vectors.sparkSession.createDataFrame(rows, "list int, centroid array<double>").write.parquet(f"{path}/centroids")
        index = cls(vectors.sparkSession, path, id_col=id_col, vector=vector)
        index.add(vectors)
        index.calibrate()
        return index

    def add(self, vectors: DataFrame) -> None:
        """Append vectors to the lists of their nearest centroids.

        Written by ranges of list and id hash: a list is in few files, and a large one spreads over tasks.
        """
        rows = assigned(usable(vectors, self.vector), self.centroids, self.vector)
        rows.repartitionByRange("list", F.xxhash64(self.id_col)).write.partitionBy("list").mode("append").parquet(f"{self.path}/lists")

    def rows(self) -> DataFrame:
        """Everything indexed."""
        return self.spark.read.parquet(f"{self.path}/lists")

    def calibrate(self, *, queries: int = 128, k: int = 10) -> None:
        """Measure recall by number of probed lists: where, in the order of a query's lists, its true neighbours are.

        The queries are that many indexed vectors, drawn by hash; their neighbours come from the exact search.
        """
        if not len(self.centroids):
            return
        drawn = self.rows().orderBy(F.xxhash64(self.id_col, F.lit("recall")), self.id_col).limit(queries)
        asked = drawn.select(F.col(self.id_col).alias("query_id"), F.col(self.vector).alias("qv"))
        found = self.search(asked, k=k + 1).where(F.col("query_id") != F.col(self.id_col)).select("query_id", "list").toArrow()
        held = asked.toArrow()
        near = np.argsort(-(unit(matrix(held.column(1).combine_chunks())) @ self.centroids.T), axis=1, kind="stable")
        row = {q: i for i, q in enumerate(held.column(0).to_pylist())}
        place = np.argsort(near, axis=1)  # of each list among a query's
        needed = np.array([place[row[q], c] for q, c in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True)], dtype=int)
        share = np.cumsum(np.bincount(needed, minlength=len(self.centroids))) / max(1, len(needed))
        self.spark.createDataFrame([(i + 1, float(x)) for i, x in enumerate(share)], "nprobe int, recall double").write.mode("overwrite").parquet(f"{self.path}/recall")

    def probes(self, recall: float) -> int:
        """The fewest lists that reached the recall when it was measured last; all, if none did."""
        if not len(self.centroids):
            return 1
        enough = self.spark.read.parquet(f"{self.path}/recall").where(F.col("recall") >= recall).agg(F.min("nprobe")).first()[0]
        return enough or len(self.centroids)

    def search(self, queries: DataFrame, *, k: int, nprobe: int | None = None, floor: float = -1.0, query_id: str = "query_id", query_vector: str = "qv", where: list[Column] | None = None) -> DataFrame:
        """query_id, id, similarity, list, rank: the k nearest of every query among its nprobe nearest lists (all, without nprobe).

        where: conditions on the indexed columns, applied before ranking. Queries are held in
        memory in passes of QUERY_BYTES; a single pass is lazy, the results of several are stored.
        """
        good = usable(queries.select(query_id, query_vector), query_vector)
        if not len(self.centroids):
            return good.where(F.lit(False)).select(query_id, F.lit(0).cast("long").alias(self.id_col), F.lit(0.0).alias("similarity"), F.lit(0).alias("list"), F.lit(1).alias("rank"))
        width = 8 * max(1, self.centroids.shape[1])
        passes = -(-good.count() * width // QUERY_BYTES) or 1
        if passes == 1:
            return self._pass(good, k, nprobe, floor, query_id, query_vector, where)
        out = None
        for i in range(passes):
            part = self._pass(good.where(F.pmod(F.xxhash64(query_id), F.lit(passes)) == i), k, nprobe, floor, query_id, query_vector, where)
            part = stored(part, "index-search")
            out = part if out is None else out.unionAll(part)
        return out

    def _pass(self, queries: DataFrame, k: int, nprobe: int | None, floor: float, query_id: str, query_vector: str, where: list[Column] | None) -> DataFrame:
        held = queries.toArrow()
        vectors = units_of(held, self.centroids.shape[1])
        near = np.argsort(-(vectors @ self.centroids.T), axis=1, kind="stable")[:, : nprobe or len(self.centroids)]
        asked = {int(c): np.nonzero((near == c).any(axis=1))[0] for c in np.unique(near)}
        found = self.rows()
        if len(asked) < len(self.centroids):
            found = found.where(F.col("list").isin(sorted(asked)))  # folders of other lists aren't read
        for condition in where or []:
            found = found.where(condition)
        scored = scored_pairs(found.select(self.id_col, self.vector, "list"), queries, held, asked, k, floor)
        order = Window.partitionBy(query_id).orderBy(F.col("similarity").desc(), self.id_col)
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def units_of(held: pa.Table, width: int) -> np.ndarray:
    return unit(matrix(held.column(1).combine_chunks())) if held.num_rows else np.zeros((0, width))


def scored_pairs(found: DataFrame, queries: DataFrame, held: pa.Table, asked: dict[int, np.ndarray] | None, k: int, floor: float) -> DataFrame:
    """query id, id, similarity, list of each query's k best rows, and those that tie with them, of every batch and list.

    found: id, vector, list. queries and what they hold: id, vector. asked: the places of the
    queries that look into a list (None: all look into all). Scores come from one product a batch.
    """
    id_col, _, part = found.columns
    query_id = queries.columns[0]
    names = [query_id, id_col, "similarity", part]
    shared = found.sparkSession.sparkContext.broadcast((held.column(0).combine_chunks(), units_of(held, 1), asked))
    list_type = pa.int64() if isinstance(found.schema[part].dataType, LongType) else pa.int32()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, units, wanted = shared.value
        everyone = np.arange(len(units))
        for batch in batches:
            lists = batch.column(2).to_numpy()
            for c in np.unique(lists):
                own = batch.filter(pa.array(lists == c))
                rows = unit(matrix(own.column(1))).T
                looking = everyone if wanted is None else wanted[int(c)]
                step = max(1, CELLS // own.num_rows)
                for i in range(0, len(looking), step):
                    who = looking[i : i + step]
                    scores = np.round(units[who] @ rows, V.EXACT)
                    # rows that tie with the kth stay
                    least = np.partition(scores, -k, axis=1)[:, -k][:, None] if own.num_rows > k else -np.inf
                    q, r = np.nonzero((scores >= floor) & (scores >= least))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(who[q])), own.column(0).take(pa.array(r)), pa.array(scores[q, r], pa.float64()), pa.array(np.full(len(q), c), list_type)], names)

    schema = StructType().add(query_id, queries.schema[query_id].dataType).add(id_col, found.schema[id_col].dataType).add("similarity", DoubleType()).add(part, found.schema[part].dataType)
    return found.mapInArrow(score, schema)


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int, floor: float = -1.0, id_col: str = "chunk_id", vector: str = "embedding", query_id: str = "query_id", query_vector: str = "qv", by: str | None = None) -> DataFrame:
    """query_id, id, similarity, rank (and by): the k nearest vectors of every query, in each group if by names one. The exact search without an index.

    Vectors or queries that are null, not finite or of length zero take no part. Queries are held
    in memory in passes of QUERY_BYTES, and vectors are read once a pass; a single pass is lazy.
    """
    asked = usable(queries.select(query_id, query_vector), query_vector)
    sizes = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(query_vector)).alias("w")).first()
    passes = -(-sizes["n"] * 8 * (sizes["w"] or 1) // QUERY_BYTES) or 1
    group = F.xxhash64(F.col(by).cast("string")) if by else F.lit(0).cast("long")
    found = usable(vectors, vector).select(id_col, vector, group.alias("_list"))
    order = Window.partitionBy(query_id, "_list").orderBy(F.col("similarity").desc(), id_col)
    out = None
    for i in range(passes):
        mine = asked if passes == 1 else asked.where(F.pmod(F.xxhash64(query_id), F.lit(passes)) == i)
        part = scored_pairs(found, mine, mine.toArrow(), None, k, floor).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_list")
        part = part if passes == 1 else stored(part, "nearest")
        out = part if out is None else out.unionAll(part)
    return out
