"""A stored index of terms: posting blocks with positions and score bounds.

A block holds up to BLOCK postings of one term whose documents have the term about as often,
ascending by id, with the most places that a posting of it has. A search reads the folders of its terms alone and takes three steps. It bounds each block of
each query's rarest term by what the overlapping blocks of the other terms allow. It scores the
documents of the best blocks, which gives a least score for the k best. Then it scores those of the
remaining blocks whose bound reaches that score; the others can't hold a better document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from lakequill.functions import text as T
from lakequill.functions import vectors as V
from lakequill.operators.search import covers
from lakequill.session import stored

BLOCK = 128
BUCKETS = 64  # folders that terms are hashed to


def bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def postings(docs: DataFrame, *, id_col: str, text: str) -> DataFrame:
    """id, term, positions (ascending, from 1). A document is one row, so its lists are made in place, without a shuffle."""
    kind = docs.schema[id_col].dataType

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 200):
                words = whole.column(1).slice(i, 200)
                flat, sizes = words.flatten().dictionary_encode(), words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                if not len(flat):
                    continue
                codes, doc = flat.indices.to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
                pos = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
                order = np.lexsort((codes, doc))  # stable: places stay ascending
                codes, doc = codes[order], doc[order]
                starts = np.concatenate([[0], 1 + np.nonzero((np.diff(codes) != 0) | (np.diff(doc) != 0))[0]])
                places = pa.ListArray.from_arrays(pa.array(np.append(starts, len(codes)), pa.int32()), pa.array(pos[order], pa.int32()))
                yield pa.RecordBatch.from_arrays([whole.column(0).slice(i, 200).take(pa.array(doc[starts])), flat.dictionary.take(pa.array(codes[starts])), places], [id_col, "term", "positions"])

    schema = StructType().add(id_col, kind).add("term", StringType()).add("positions", ArrayType(IntegerType()))
    return docs.select(id_col, T.lexemes(F.col(text)).alias("_words")).mapInArrow(lists, schema)


def tier(positions: Column) -> Column:
    """Postings are ordered by how many places they have, in powers of two, so that the blocks with many come apart."""
    return F.floor(F.log2(F.size(positions))).cast("int")


def packed(batch: pa.RecordBatch, size: int) -> pa.RecordBatch:
    """Sorted postings (bucket, term, tier, id, positions) as BLOCKS rows; a block ends with its term, tier or batch."""
    n = batch.num_rows
    term, layer = batch.column(1).dictionary_encode().indices.to_numpy(), batch.column(2).to_numpy()
    fresh = np.concatenate([[True], (np.diff(term) != 0) | (np.diff(layer) != 0)])
    since = np.arange(n) - np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    starts = np.nonzero(since % size == 0)[0]
    ends = np.append(starts[1:], n)
    ids, places = batch.column(3), batch.column(4)
    most = np.maximum.reduceat(places.value_lengths().to_numpy(), starts)
    offsets = pa.array(np.append(starts, n), pa.int32())
    take = lambda c, at: batch.column(c).take(pa.array(at))
    return pa.RecordBatch.from_arrays(
        [take(0, starts), take(1, starts), take(3, starts), take(3, ends - 1), pa.array(most, pa.int32()), pa.ListArray.from_arrays(offsets, ids), pa.ListArray.from_arrays(offsets, places)],
        ["bucket", "term", "first", "last", "most", "ids", "positions"])


class TermIndex:
    """An index at a path. Ids are integers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.buckets = spark.read.parquet(f"{path}/settings").first()["buckets"]

    @classmethod
    def build(cls, docs: DataFrame, path: str, *, id_col: str = "chunk_id", text: str = "chunk_text", block: int = BLOCK, buckets: int = BUCKETS) -> TermIndex:
        """Null texts have no terms. An id comes once. Postings are sorted by ranges of (term, id): a frequent term spreads over tasks."""
        docs.sparkSession.createDataFrame([(buckets,)], "buckets int").write.parquet(f"{path}/settings")
        index = cls(docs.sparkSession, path)
        index.add(docs, id_col=id_col, text=text, block=block)
        return index

    def add(self, docs: DataFrame, *, id_col: str = "chunk_id", text: str = "chunk_text", block: int = BLOCK) -> None:
        """Append documents whose ids the index doesn't have yet."""

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield packed(batch, block)

        rows = postings(docs, id_col=id_col, text=text).select(bucket(F.col("term"), self.buckets).alias("bucket"), "term", tier(F.col("positions")).alias("tier"), F.col(id_col).cast("long").alias("id"), "positions")
        keys = ["bucket", "term", F.desc("tier"), "id"]
        made = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(pack, "bucket int, term string, first long, last long, most int, ids array<long>, positions array<array<int>>")
        made.write.option("compression", "zstd").partitionBy("bucket").mode("append").parquet(f"{self.path}/blocks")

    def rows(self) -> DataFrame:
        schema = "term string, first long, last long, most int, ids array<long>, positions array<array<int>>, bucket int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/blocks")

    def asked(self, queries: DataFrame, query_id: str, query: str) -> DataFrame:
        """query_id, term, n (terms of the query) of every distinct term."""
        terms = queries.select(query_id, F.array_distinct(T.lexemes(F.col(query))).alias("_t"))
        return terms.select(query_id, F.size("_t").alias("n"), F.explode("_t").alias("term"))

    def blocks(self, asked: DataFrame, columns: list[str]) -> DataFrame:
        """The blocks of the asked terms. The terms' folders alone are read, and of these the row groups that can hold a term."""
        terms = asked.select("term").distinct()
        few = [r["term"] for r in terms.limit(1001).collect()]
        found = self.rows()
        if len(few) <= 1000:
            wanted = self.spark.createDataFrame([(t,) for t in few], "term string").select(bucket(F.col("term"), self.buckets).alias("b")).distinct()
            found = found.where(F.col("bucket").isin([r["b"] for r in wanted.collect()])).where(F.col("term").isin(few))
        else:
            found = found.join(terms, "term", "left_semi")
        return found.select(*columns)

    def search(self, queries: DataFrame, *, k: int, query_id: str = "query_id", query: str = "query", id_col: str = "chunk_id", report: list | None = None) -> DataFrame:
        """query_id, id, lexical_score, rank: the k best documents that have all terms of the query, by cover density.

        Ties go to the smaller id. Queries without terms find nothing. With report, the numbers of
        all blocks of the leading terms and of those that were scored are appended to it.
        """
        asked = stored(self.asked(queries, query_id, query), "terms-asked")
        heads = stored(self.blocks(asked, ["term", "first", "last", "most", F.size("ids").alias("docs")]), "terms-blocks")
        sizes = heads.groupBy("term").agg(F.sum("docs").alias("df"))
        ranked = asked.join(sizes, "term").withColumn("_have", F.count(F.lit(1)).over(Window.partitionBy(query_id))).where("_have = n")
        lead = Window.partitionBy(query_id).orderBy("df", "term")
        ranked = stored(ranked.withColumn("place", F.row_number().over(lead)), "terms-ranked")

        own = ranked.where("place = 1").join(heads, "term").select(query_id, "n", "term", "first", "last", "most", "docs")
        others = ranked.where("place > 1").select(query_id, F.col("term").alias("other")).join(heads.select(F.col("term").alias("other"), F.col("first").alias("f"), F.col("last").alias("l"), F.col("most").alias("m")), "other")
        # ranges of ids meet by the cells of a grid, so that blocks are joined by equality
        step = heads.agg(F.max(F.col("last") - F.col("first")).alias("w"), F.percentile_approx(F.col("last") - F.col("first"), 0.5).alias("h")).first()
        width = max(1, (step["h"] or 0), (step["w"] or 0) // 64)
        grid = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
        met = own.withColumn("cell", grid("first", "last")).join(others.withColumn("cell", grid("f", "l")), [query_id, "cell"], "left")
        inside = (F.col("f") <= F.col("last")) & (F.col("l") >= F.col("first"))
        per_other = met.groupBy(query_id, "n", "term", "first", "last", "docs", "most", "other").agg(F.max(F.when(inside, F.col("m"))).alias("m"))
        least = per_other.groupBy(query_id, "n", "term", "first", "last", "docs", "most").agg(F.min("m").alias("m"), F.count(F.when(F.col("m").isNull() & F.col("other").isNotNull(), 1)).alias("_none"), F.count("other").alias("_others"))
        # every cover starts at another term of its own among those around one place of a term: n covers a place at most
        places = F.when(F.col("n") == 1, F.col("most")).otherwise(F.least("most", F.col("m")) * F.col("n"))
        r = F.lit(0.1) * places
        bounds = least.where("n = 1 OR (_none = 0 AND _others = n - 1)").withColumn("bound", F.round(r / (r + 1), V.EXACT))
        order = Window.partitionBy(query_id).orderBy(F.col("bound").desc(), "first")
        bounds = stored(bounds.withColumn("before", F.sum("docs").over(order) - F.col("docs")), "terms-bounds")

        first = self._scored(bounds.where(F.col("before") < 2 * k), ranked, query_id, id_col)
        first = stored(first, "terms-first")
        best = Window.partitionBy(query_id).orderBy(F.col("lexical_score").desc(), id_col)
        floor = first.withColumn("_r", F.row_number().over(best)).where(F.col("_r") == k).select(query_id, F.col("lexical_score").alias("_least"))
        rest = bounds.where(F.col("before") >= 2 * k).join(floor, query_id, "left").where("_least IS NULL OR bound >= _least").drop("_least")
        if report is not None:
            report += [bounds.count(), bounds.where(F.col("before") < 2 * k).count() + rest.count()]
        found = first.unionByName(self._scored(rest, ranked, query_id, id_col))
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def _scored(self, chosen: DataFrame, ranked: DataFrame, query_id: str, id_col: str) -> DataFrame:
        """query_id, id, lexical_score of the documents of chosen blocks that have every term."""
        full = self.blocks(ranked, ["term", "first", "last", F.arrays_zip("ids", "positions").alias("held")])
        own = chosen.select(query_id, "term", "first", "last").join(full, ["term", "first", "last"]).select(query_id, F.explode("held").alias("x")).select(query_id, F.col("x.ids").alias("id"))
        terms = ranked.select(query_id, "n", "place", "term")
        every = full.select("term", F.explode("held").alias("x")).select("term", F.col("x.ids").alias("id"), F.col("x.positions").alias("positions"))
        per_query = own.join(terms, query_id).join(every, ["term", "id"])
        hits = F.flatten(F.collect_list(F.transform("positions", lambda p: F.struct(p.alias("p"), F.col("place").alias("k")))))
        docs = per_query.groupBy(query_id, "id", "n").agg(F.count(F.lit(1)).alias("_have"), F.array_sort(hits).alias("hits")).where("_have = n")
        return docs.select(query_id, F.col("id").alias(id_col), F.round(covers(F.col("hits"), F.col("n")), V.EXACT).alias("lexical_score"))
