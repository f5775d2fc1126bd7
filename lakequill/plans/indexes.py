"""Queries over stored indexes, similarity joins and tables with versions."""

from pyspark.sql import functions as F

from lakequill.functions import text as T
from lakequill.operators import chunking, memory
from lakequill.operators.term_index import TermIndex
from lakequill.operators.vector_index import VectorIndex
from lakequill.plans.registry import query
from lakequill.plans.retrieval import CHARS, COS, LEX, cover_sql
from lakequill.session import new_path
from lakequill.sources.versions import VersionedTables, replace_documents


def built_index(t, lists: int | None = None) -> VectorIndex:
    return VectorIndex.build(t.embeddings, new_path(t.spark, "vectors"), id_col="vec_id", lists=lists)


def twentieths(t):
    """The rows whose id is divisible by 20, as queries."""
    return t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))


@query(f"""SELECT query_id, vec_id, sim AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id)::INT AS rank FROM (
  SELECT q.vec_id AS query_id, c.vec_id, {COS.format('c.embedding', 'q.embedding')} AS sim FROM embeddings c JOIN embeddings q ON q.vec_id % 20 = 0)) WHERE rank <= 10""")
def vector_index_search(t):
    """All lists of a stored index: the exact search."""
    return built_index(t).search(twentieths(t), k=10).drop("list")


@query()
def vector_index_probe(t):
    """As many of the nearest lists alone as reached a recall of 0.95 when the index was built; tests measure the recall."""
    index = built_index(t)
    return index.search(twentieths(t), k=10, nprobe=index.probes(0.95)).drop("list")


NEW = f"""fresh AS (SELECT * FROM embeddings a WHERE vec_id >= 250 AND NOT EXISTS (SELECT 1 FROM embeddings b WHERE b.vec_id < 250 AND b.label = a.label AND {COS.format('a.embedding', 'b.embedding')} >= 0.35))"""


@query(f"""WITH RECURSIVE {NEW},
before AS (SELECT b.vec_id, list(a.vec_id) AS near FROM fresh a JOIN fresh b ON a.label = b.label AND a.vec_id < b.vec_id AND {COS.format('a.embedding', 'b.embedding')} >= 0.35 GROUP BY b.vec_id),
asked AS (SELECT vec_id, coalesce(near, []) AS near, row_number() OVER (ORDER BY vec_id) AS no FROM fresh LEFT JOIN before USING (vec_id)),
stay(no, ids) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT a.no, CASE WHEN list_has_any(s.ids, a.near) THEN s.ids ELSE list_append(s.ids, a.vec_id) END FROM stay s JOIN asked a ON a.no = s.no + 1)
SELECT unnest(ids) AS vec_id FROM stay WHERE no = (SELECT count(*) FROM asked)""")
def memory_batch_new(t):
    """As memory_new_only, with the batch in order: what nearly equals a vector that stayed goes."""
    rows = t.embeddings.select("vec_id", "label", "embedding")
    return memory.new_only(rows.where("vec_id >= 250"), rows.where("vec_id < 250"), scope="label", floor=0.35, order="vec_id").select("vec_id")


@query(cover_sql(f"SELECT item_id AS query_id, list_distinct({LEX}[1:item_id % 3 + 1]) AS terms FROM benchmark WHERE len({LEX}) > 0", 10))
def term_index_search(t):
    """The first one to three words of every benchmark item, by a stored index."""
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.array_join(F.slice(T.lexemes(F.col("text")), 1, (F.col("item_id") % 3 + 1).cast("int")), " ").alias("query"))
    index = TermIndex.build(t.documents, new_path(t.spark, "terms"), id_col="doc_id", text="text")
    return index.search(asked, k=10, id_col="doc_id").drop("rank")


PIECES = CHARS.replace("FROM documents", "FROM d")


@query(f"""WITH d AS (SELECT doc_id, text FROM documents WHERE doc_id % 10 <> 0), old AS ({PIECES}),
new AS (WITH d AS (SELECT doc_id, 'Second edition. ' || text AS text FROM documents WHERE doc_id % 10 = 0) {PIECES}),
first AS (WITH d AS (SELECT doc_id, text FROM documents WHERE doc_id % 10 = 0) {PIECES})
SELECT 2 AS version, doc_id, chunk_index, sha256(chunk_text) AS digest FROM (SELECT * FROM old UNION ALL SELECT * FROM new)
UNION ALL SELECT 1, doc_id, chunk_index, sha256(chunk_text) FROM (SELECT * FROM old UNION ALL SELECT * FROM first)""")
def versioned_replace(t):
    """Documents with their chunks, every tenth replaced by a second edition; the chunks in both versions."""
    tables = VersionedTables(t.spark, new_path(t.spark, "versions"))
    docs = t.documents.select("doc_id", "text")
    replace_documents(tables, docs, chunking.char_chunks(docs))
    again = docs.where("doc_id % 10 = 0").withColumn("text", F.concat(F.lit("Second edition. "), "text"))
    replace_documents(tables, again, chunking.char_chunks(again))
    digest = F.sha2(F.col("chunk_text").cast("binary"), 256).alias("digest")
    return tables.read("chunks").select(F.lit(2).alias("version"), "doc_id", "chunk_index", digest).unionAll(tables.read("chunks", 1).select(F.lit(1), "doc_id", "chunk_index", digest))
