"""Queries that call tools from SQL and that learn from feedback."""

from pyspark.sql import functions as F

from lakequill.operators import feedback, graph, memory, orchestrate, ranker, rerank, tools
from lakequill.operators.term_index import TermIndex
from lakequill.plans.registry import query
from lakequill.plans.retrieval import COS, LEX
from lakequill.session import new_path, stored


def tooled(t) -> tools.Registry:
    return tools.register(t.spark, t.documents, TermIndex.build(t.documents, new_path(t.spark, "terms"), id_col="doc_id", text="text"))


@query(f"""WITH asked AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(q), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS terms FROM (SELECT item_id, array_to_string(string_split(text, ' ')[1:2], ' ') AS q FROM benchmark)),
words AS (SELECT doc_id, unnest({LEX}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
found AS (SELECT item_id, doc_id, round(sum(0.1::DOUBLE * tf / (1 + 0.1::DOUBLE * tf)), 6) AS score FROM (SELECT item_id, terms, unnest(terms) AS term FROM asked) JOIN tf USING (term) GROUP BY item_id, doc_id, terms HAVING count(*) = len(terms))
SELECT item_id, doc_id, score, length(substr(text, 1, 4000)) AS passage_chars FROM (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 5) JOIN documents USING (doc_id)""")
def tool_search(t):
    """search_documents called laterally for the first two words of every benchmark item."""
    asked = t.benchmark.select("item_id", F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("words"))
    return tooled(t).lateral(asked, "search_documents", q="r.words").select("item_id", "doc_id", "score", F.length("passage").alias("passage_chars"))


@query("""SELECT source, doc_id, n_chars FROM documents WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3""")
def tool_listing(t):
    """list_documents called laterally for every source."""
    return tooled(t).lateral(t.documents.select("source").distinct(), "list_documents", of_source="r.source", k="3")


def answer_candidates(t):
    """Each answer of a conversation with its question, and the answers that the next three conversations give at the same turn."""
    asked = feedback.training_pairs(t.conversations, conv="conv_id", turn="turn", role="role", text="text")
    near = asked.select(F.explode(F.sequence(F.col("conv_id") - 3, F.col("conv_id"))).alias("conv_id"), "turn", F.col("conv_id").alias("of"), F.col("answer").alias("shown"))
    rows = asked.join(near, ["conv_id", "turn"]).select(F.concat_ws("/", "conv_id", "turn").alias("query_id"), "of", (F.col("of") == F.col("conv_id")).alias("relevant"), *ranker.features(F.col("question"), F.col("shown")))
    return rows.withColumn("similarity", F.col("overlap"))


@query()
def ranker_training(t):
    """The model that the conversations' answers give, and whether it would be promoted."""
    model = ranker.fit(answer_candidates(t), query="query_id", tie="of")
    row = (model.weights, model.pairs, round(model.ndcg_before, 6), round(model.ndcg_after, 6), model.promoted)
    return t.spark.createDataFrame([row], "weights array<double>, pairs long, ndcg_before double, ndcg_after double, promoted boolean")


@query()
def ranker_rerank(t):
    """Answers of every question reordered by the model, its score mixed into theirs."""
    rows = answer_candidates(t)
    weights = ranker.fit(rows, query="query_id", tie="of").weights
    scored = rows.withColumn("rerank_score", F.round(ranker.score(weights), 6)).withColumn("combined_score", F.round("similarity", 6))
    return rerank.cross_encoded(scored).select("query_id", "of", "relevant", "rerank_score", "combined_score")


@query(f"""WITH d AS (SELECT name, min(type) AS type FROM (SELECT unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) AS name, ['GPE', 'ORG', 'LAW'][item_id % 3 + 1] AS type FROM benchmark) WHERE length(name) BETWEEN 5 AND 200 GROUP BY 1)
SELECT doc_id, name, type, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) AS name FROM documents) JOIN d USING (name) GROUP BY ALL""")
def entity_dictionary(t):
    """The benchmark's longer words as names of three types, found in all documents by one automaton."""
    word = F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    kind = F.element_at(F.array(F.lit("GPE"), F.lit("ORG"), F.lit("LAW")), (F.col("item_id") % 3 + 1).cast("int"))
    names = t.benchmark.select(word.alias("name"), kind.alias("type")).where("length(name) >= 5")
    return graph.extract_known(t.documents, names, id_col="doc_id", text="text")


@query(f"""WITH q AS (SELECT vec_id AS query_id, embedding AS qv, CASE WHEN vec_id % 40 = 0 THEN [] ELSE [label, (label + 1) % 5] END AS scopes FROM embeddings WHERE vec_id % 20 = 0),
found AS (SELECT query_id, vec_id FROM (SELECT query_id, m.vec_id, {COS.format('m.embedding', 'qv')} AS sim FROM q JOIN embeddings m ON len(scopes) = 0 OR list_contains(scopes, m.label))
  WHERE sim >= 0.2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) <= 3)
SELECT m.vec_id, count(query_id) AS use_count, count(query_id) > 0 AS touched FROM embeddings m LEFT JOIN found f ON f.vec_id = m.vec_id GROUP BY m.vec_id""")
def memory_retrieval(t):
    """Vectors as memories of the workspaces that their labels are, retrieved for every twentieth, and how often each was used."""
    none = F.lit(None).cast("timestamp")
    memories = t.embeddings.withColumns({"use_count": F.lit(0).cast("long"), "last_used": none})
    scopes = F.when(F.col("vec_id") % 40 == 0, F.array().cast("array<int>")).otherwise(F.array(F.col("label"), ((F.col("label") + 1) % 5).cast("int")))
    asked = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"), scopes.alias("scopes"))
    _, after = memory.retrieve(memories, asked, F.lit("2026-01-01").cast("timestamp"), floor=0.2, id_col="vec_id", scope="label")
    return after.select("vec_id", "use_count", F.col("last_used").isNotNull().alias("touched"))


@query("""SELECT conv_id AS query_id, CASE WHEN tool = 'mail' THEN 'failed' WHEN tool = 'turns' THEN 'ok' ELSE 'unknown' END AS status, tool, CASE WHEN tool = 'turns' THEN least(count(*), 2) WHEN tool = 'mail' THEN 1 ELSE 0 END AS rows, true AS partial
FROM conversations, (VALUES ('turns'), ('mail'), ('none')) v(tool) GROUP BY conv_id, tool""")
def job_trace(t):
    """Three tools for every conversation: its first two turns, one that always fails, and one that isn't there; the trace of the jobs."""
    asked = t.conversations.groupBy(F.col("conv_id").alias("query_id")).agg(F.min("text").alias("query")).withColumn("tools", F.array(F.lit("turns"), F.lit("mail"), F.lit("none")))
    tools_ = {
        "turns": lambda q: q.join(t.conversations.withColumnRenamed("conv_id", "query_id").select("query_id", F.col("turn").alias("seq")), "query_id").select("query_id", "seq"),
        "mail": lambda q: q.select("query_id", F.raise_error(F.lit("no connection")).alias("x")),
    }
    jobs = stored(orchestrate.job_matrix(asked, tools_, retries=1, most=2), "jobs")
    return orchestrate.trace(jobs, asked).drop("query").join(orchestrate.outcome(jobs), "query_id")
