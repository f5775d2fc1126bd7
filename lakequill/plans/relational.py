"""Queries of the relational layer: listings, integrity, feedback, metrics, conversations, graph, windows."""

from pyspark.sql import functions as F

from lakequill.operators import feedback, graph, memory, orchestrate, tables
from lakequill.plans.registry import Tables, query
from lakequill.sources import sinks
from lakequill.streaming import streams

AS_OF = "(SELECT max(o_orderdate) FROM orders)"


def as_of(t: Tables):
    return t.orders.agg(F.max("o_orderdate").alias("as_of"))


def rated(t: Tables):
    return t.labels.withColumn("rating", 2 * F.col("quality") - 1)


@query("SELECT 2 * quality - 1 AS rating, count(*) AS n FROM labels GROUP BY 1")
def feedback_by_type(t):
    return feedback.by_type(rated(t).select(F.col("rating")), "rating")


@query("SELECT count(*) AS total, count(*) FILTER (quality = 1) AS positive, count(*) FILTER (quality = 0) AS negative, round(count(*) FILTER (quality = 1)::DOUBLE / count(*), 3) AS positive_rate FROM labels")
def feedback_stats(t):
    return feedback.stats(rated(t))


@query("""SELECT date_trunc('day', ts)::DATE AS day, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS positive, count(*) FILTER (event_type = 'error') AS negative
FROM events GROUP BY 1""")
def feedback_trend_daily(t):
    rating = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return feedback.daily(t.events.withColumn("rating", rating), "ts", "rating")


def event_counts(t):
    return feedback.counters(t.events, "user_id", "event_type", {"click": "retrieved", "purchase": "positive", "error": "negative"})


COUNTS = "SELECT user_id, count(*) FILTER (event_type = 'click') AS retrieved, count(*) FILTER (event_type = 'purchase') AS positive, count(*) FILTER (event_type = 'error') AS negative FROM events GROUP BY 1"


@query(COUNTS)
def counter_upsert(t):
    """Counters of the first half of the events, with those of the second half added."""
    names = {"click": "retrieved", "purchase": "positive", "error": "negative"}
    old = feedback.counters(t.events.where("event_id % 2 = 0"), "user_id", "event_type", names)
    new = feedback.counters(t.events.where("event_id % 2 = 1"), "user_id", "event_type", names)
    return feedback.upsert_counts(old, new, ["user_id"])


@query(f"""SELECT user_id, retrieved, positive, negative, round(positive::DOUBLE / retrieved, 6) AS rate FROM ({COUNTS})
WHERE retrieved >= 3 AND positive::DOUBLE / retrieved <= 0.5 ORDER BY retrieved DESC, user_id LIMIT 50""")
def stale_chunks(t):
    return feedback.stale(event_counts(t), key="user_id", retrieved=3, ratio=0.5)


PAIRS = """WITH a AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS user_turn FROM conversations)
SELECT a.conv_id, a.turn, q.text AS question, a.text AS answer FROM a JOIN conversations q ON q.conv_id = a.conv_id AND q.turn = a.user_turn WHERE a.role = 'assistant'"""


@query(PAIRS)
def feedback_pairs_prev_turn(t):
    return feedback.training_pairs(t.conversations, conv="conv_id", turn="turn", role="role", text="text")


@query("""WITH r AS (SELECT user_id, (event_type = 'purchase')::INT AS rel, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r,
  row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'purchase')::INT DESC, event_id) AS i FROM events),
g AS (SELECT user_id, sum(CASE WHEN r <= 10 THEN rel / log2(r + 1) ELSE 0 END) AS d, sum(CASE WHEN i <= 10 THEN rel / log2(i + 1) ELSE 0 END) AS x FROM r GROUP BY 1)
SELECT user_id, round(CASE WHEN x > 0 THEN d / x ELSE 0 END, 6) AS ndcg FROM g""")
def ndcg_at_k(t):
    from lakequill.operators.rerank import ndcg

    rows = t.events.select("user_id", "event_id", (F.col("event_type") == "purchase").cast("int").alias("rel"))
    return ndcg(rows, by="user_id", rank="event_id", relevant="rel", k=10)


@query("""SELECT conv_id, turn, text FROM conversations c WHERE role = 'user' AND (
  EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.conv_id AND 2 * quality - 1 < 0.5) OR NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.conv_id))""")
def low_confidence_queries(t):
    return feedback.unanswered(t.conversations, rated(t).withColumnRenamed("doc_id", "conv_id"), conv="conv_id").select("conv_id", "turn", "text")


def stop_list() -> str:
    from lakequill.functions.text import STOP_WORDS

    return ", ".join(f"'{w}'" for w in STOP_WORDS)


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS term FROM conversations WHERE role = 'user') WHERE term NOT IN ({stop_list()}) GROUP BY 1")
def knowledge_gap_terms(t):
    return feedback.gap_terms(t.conversations.where("role = 'user'"), "text")


@query("""WITH l AS (SELECT event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 1000),
g AS (SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high, round(avg(value), 4) AS mean, list_sort(list(value)) AS v FROM l GROUP BY 1)
SELECT event_type, n, total, low, high, mean, v[least(floor(n * 50 / 100)::BIGINT, n - 1) + 1] AS p50, v[least(floor(n * 95 / 100)::BIGINT, n - 1) + 1] AS p95, v[least(floor(n * 99 / 100)::BIGINT, n - 1) + 1] AS p99 FROM g""")
def histogram_percentiles(t):
    return feedback.histogram(t.events, by="event_type", value="value", order=[F.col("ts").desc(), F.col("event_id").desc()])


@query("SELECT event_type, count(*) FILTER (value <= 10.0) AS le_10_0, count(*) FILTER (value <= 50.0) AS le_50_0, count(*) FILTER (value <= 100.0) AS le_100_0, count(*) AS le_inf FROM events GROUP BY 1")
def histogram_buckets(t):
    return feedback.buckets(t.events, by="event_type", value="value", limits=(10.0, 50.0, 100.0))


@query("SELECT l_orderkey, round(least(1.0, greatest(0.0, avg(l_discount * 10))), 4) AS confidence FROM lineitem GROUP BY 1")
def answer_confidence(t):
    return feedback.confidence(t.lineitem.withColumn("combined_score", F.col("l_discount") * 10), "l_orderkey")


# listings and integrity
@query("""SELECT s.source, coalesce(d.n, 0) AS n_docs, coalesce(r.n, 0) AS n_rated FROM (SELECT DISTINCT source FROM documents) s
LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY 1) d USING (source) LEFT JOIN (SELECT source, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1) r USING (source)""")
def workspace_counts(t):
    docs = t.documents.select("doc_id", "source")
    return tables.counts_of(docs.select("source").distinct(), "source", n_docs=(docs, "source"), n_rated=(docs.join(t.labels, "doc_id"), "source"))


@query("SELECT c_custkey, c_name, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def doc_listing_counts(t):
    return tables.counts_of(t.customer.select("c_custkey", "c_name"), "c_custkey", n_orders=(t.orders, "o_custkey"))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def dedup_keep_newest(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    return tables.keep_newest(rows, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])


@query("SELECT sha256(coalesce(text, '')) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(t):
    h = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("content_hash")
    return t.documents.select("doc_id", h).groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("""WITH e AS (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 3 END AS c FROM documents WHERE doc_id % 3 <> 0)
SELECT d.doc_id, CASE WHEN e.doc_id IS NULL THEN 'insert' WHEN e.h = sha256(d.text) AND c > 0 THEN 'skip' ELSE 'replace' END AS decision FROM documents d LEFT JOIN e USING (doc_id)""")
def ingest_decision(t):
    """All documents against a store that has two thirds of them, some changed, some without chunks."""
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    store = t.documents.where("doc_id % 3 <> 0").select("doc_id", F.sha2(changed.cast("binary"), 256).alias("content_hash"), F.when(F.col("doc_id") % 7 == 0, 0).otherwise(3).alias("chunk_count"))
    new = t.documents.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    return tables.ingest_decision(new, store, ["doc_id"]).select("doc_id", "decision")


@query("""WITH now AS (SELECT doc_id, n_chars FROM documents WHERE doc_id % 11 <> 0), was AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 13 <> 0)
SELECT doc_id, CASE WHEN was.doc_id IS NULL THEN 'added' WHEN now.doc_id IS NULL THEN 'deleted' ELSE 'modified' END AS event FROM now FULL JOIN was USING (doc_id)
WHERE was.doc_id IS NULL OR now.doc_id IS NULL OR now.n_chars <> was.n_chars""")
def snapshot_diff(t):
    """Two listings of the documents: some are new, some gone, some of another size."""
    now = t.documents.where("doc_id % 11 <> 0").select("doc_id", "n_chars")
    was = t.documents.where("doc_id % 13 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("n_chars"))
    return tables.snapshot_diff(now, was, "doc_id", "n_chars")


@query(f"SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < {AS_OF} - INTERVAL 168 HOUR")
def stale_documents(t):
    rows = t.orders.select("o_orderkey", "o_orderdate").join(as_of(t))  # one row
    return tables.stale(rows, F.col("as_of"), 168, "o_orderdate").drop("as_of")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def purgeable_documents(t):
    return tables.purgeable(t.documents.select("doc_id"), "doc_id", (t.labels, "doc_id"))


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 HAVING count(*) = 1")
def last_owner_guard(t):
    return tables.sole_owners(t.orders, group="o_custkey", user="o_orderkey", role="o_orderstatus", owner="O")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def backfill_members(t):
    return tables.backfill(t.customer.select("c_custkey", "c_nationkey"), t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT doc_id, source, source = 'src1' AS retired FROM documents")
def soft_delete(t):
    docs = t.documents.select("doc_id", "source", F.lit(None).cast("timestamp").alias("deleted_at"))
    gone = tables.retire(docs, F.col("source") == "src1", F.lit("2026-01-01").cast("timestamp"))
    return gone.select("doc_id", "source", F.col("deleted_at").isNotNull().alias("retired"))


@query("SELECT doc_id, source FROM documents WHERE lower(text) LIKE '%license%'")
def ilike_search(t):
    return tables.substring_search(t.documents, "text", "License").select("doc_id", "source")


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM documents")
def text_preview(t):
    from lakequill.functions.text import preview

    return t.documents.select("doc_id", preview(F.col("text")).alias("preview"))


@query("""SELECT c.conv_id, max(turn) AS last_turn, count(*) AS n FROM conversations c GROUP BY 1 ORDER BY last_turn DESC, conv_id LIMIT 20 OFFSET 5""")
def conversation_listing(t):
    rows = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("n"))
    return tables.page(rows, [F.col("last_turn").desc(), F.col("conv_id")], limit=20, offset=5)


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def last_n_turns(t):
    return tables.last_n(t.conversations.select("conv_id", "turn", "role"), "conv_id", "turn", 3)


@query("SELECT conv_id, string_agg('## ' || upper(role[1]) || lower(role[2:]) || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn, '## ' || upper(role[1]) || lower(role[2:]) || chr(10) || chr(10) || text) AS markdown FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def conversation_export(t):
    return sinks.conversation_markdown(t.conversations.where("text IS NOT NULL"), conv="conv_id", turn="turn", role="role", text="text")


@query("""SELECT conv_id, string_agg(upper(role[1]) || lower(role[2:]) || ': ' || substr(text, 1, 500), chr(10) ORDER BY turn, upper(role[1]) || lower(role[2:]) || ': ' || substr(text, 1, 500)) AS transcript
FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 20) GROUP BY 1""")
def memory_transcript(t):
    return memory.transcript(t.conversations, conv="conv_id", turn="turn", role="role", text="text")


# graph
@query("""WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
SELECT a.l_suppkey AS source, b.l_suppkey AS target, count(*) AS weight FROM m a JOIN m b USING (l_orderkey) WHERE a.l_suppkey < b.l_suppkey GROUP BY 1, 2""")
def entity_cooccurrence(t):
    return graph.edges(t.lineitem, "l_orderkey", "l_suppkey")


@query("""WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), e AS (SELECT DISTINCT a.l_suppkey AS s, b.l_suppkey AS x FROM m a JOIN m b USING (l_orderkey) WHERE a.l_suppkey <> b.l_suppkey)
SELECT s AS seed, x AS neighbour FROM e WHERE s IN (1, 2, 3) AND x NOT IN (1, 2, 3)""")
def entity_neighbors(t):
    edges = graph.edges(t.lineitem, "l_orderkey", "l_suppkey")
    return graph.neighbours(edges, t.supplier.where("s_suppkey IN (1, 2, 3)").select(F.col("s_suppkey").alias("seed")))


@query("SELECT l_partkey::VARCHAR AS name, l_returnflag AS type, count(DISTINCT l_orderkey) AS doc_count FROM lineitem GROUP BY 1, 2")
def entity_vertices(t):
    return graph.vertices(t.lineitem.select("l_orderkey", F.col("l_partkey").cast("string").alias("name"), F.col("l_returnflag").alias("type")), "l_orderkey")


@query("""WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), e AS (SELECT a.l_suppkey AS s, b.l_suppkey AS x FROM m a JOIN m b USING (l_orderkey) WHERE a.l_suppkey < b.l_suppkey GROUP BY 1, 2)
SELECT s_nationkey, count(DISTINCT s) AS entities, count(*) AS relations FROM e JOIN supplier ON s_suppkey = s GROUP BY 1""")
def ontology_types(t):
    return graph.ontology(graph.edges(t.lineitem, "l_orderkey", "l_suppkey"), t.supplier, key="s_suppkey", kind="s_nationkey")


# windows; the same functions take streams
@query("SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def tumbling_window(t):
    return streams.tumbling(t.events, ts="ts", by="event_type", value="value", length="1 hour").withColumn("total", F.round("total", 4))


@query("""WITH s AS (SELECT event_type, value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events)
SELECT start, start + INTERVAL 2 HOUR AS end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY 1, 2, 3""")
def sliding_window(t):
    return streams.tumbling(t.events, ts="ts", by="event_type", value="value", length="2 hours", slide="1 hour").withColumn("total", F.round("total", 4))


@query("""WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM a)
SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS end, user_id, count(*) AS n FROM b GROUP BY user_id, k""")
def session_window(t):
    return streams.sessions(t.events, ts="ts", by="user_id", gap="6 hours")


@query("SELECT (event_type || '_total{kind=\"' || event_type || '\"} ' || count(*)) AS line FROM events GROUP BY event_type")
def metrics_export(t):
    counts = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("value"))
    return sinks.prometheus(counts.select(F.concat("event_type", F.lit("_total")).alias("name"), F.create_map(F.lit("kind"), "event_type").alias("labels"), "value"))


# sync and cache counters, registry, listings
@query("SELECT user_id, count(*) FILTER (event_type = 'signup') AS added, count(*) FILTER (event_type = 'view') AS updated, count(*) FILTER (event_type = 'error') AS deleted FROM events GROUP BY 1")
def sync_run_counters(t):
    return feedback.counters(t.events, "user_id", "event_type", {"signup": "added", "view": "updated", "error": "deleted"})


@query("SELECT user_id, round(count(*) FILTER (event_type = 'view')::DOUBLE / count(*), 4) AS hit_rate FROM events GROUP BY 1")
def cache_hit_rate(t):
    return t.events.groupBy("user_id").agg(F.round(F.count_if(F.col("event_type") == "view") / F.count(F.lit(1)), 4).alias("hit_rate"))


@query("SELECT p_partkey, p_partkey = 7 AS active FROM part")
def model_registry(t):
    return tables.activate(t.part.select("p_partkey"), 7, "p_partkey")


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 10")
def top_entities(t):
    return tables.page(t.part.groupBy("p_type").agg(F.count(F.lit(1)).alias("n")), [F.col("n").desc(), F.col("p_type")], limit=10)


@query("SELECT conv_id FROM (SELECT conv_id, max(turn) AS last, max(CASE WHEN role = 'system' THEN turn END) AS done FROM conversations GROUP BY 1) WHERE done IS NULL OR done < last")
def memory_due(t):
    """Conversations with turns after the last one from which memories were extracted."""
    c = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("updated_at"), F.max(F.when(F.col("role") == "system", F.col("turn"))).alias("memory_extracted_at"))
    return memory.due(c).select("conv_id")


@query("""SELECT vec_id AS id, coalesce(n, 0) AS use_count, n IS NOT NULL AS was_used FROM embeddings LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) ON user_id = vec_id""")
def memory_usage(t):
    m = t.embeddings.select(F.col("vec_id").alias("id"), F.lit(0).cast("long").alias("use_count"), F.lit(None).cast("timestamp").alias("last_used"))
    hits = t.events.where("event_type = 'click'").select(F.col("user_id").alias("id"))
    return memory.used(m, hits, F.lit("2026-01-01").cast("timestamp")).select("id", "use_count", F.col("last_used").isNotNull().alias("was_used"))


@query("""WITH m AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_orderkey % 4 <> 0)
SELECT a.l_suppkey AS source, b.l_suppkey AS target, count(*) AS weight FROM m a JOIN m b USING (l_orderkey) WHERE a.l_suppkey < b.l_suppkey GROUP BY 1, 2""")
def document_edges_dropped(t):
    """The graph once a quarter of the orders is deleted."""
    gone = t.orders.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return graph.edges(graph.without_document(t.lineitem, gone, "l_orderkey"), "l_orderkey", "l_suppkey")


@query("SELECT count(*) FILTER (s IS NOT NULL) AS n_semantic, count(*) FILTER (h IS NOT NULL) AS n_hybrid, count(*) FILTER (s IS NOT NULL AND h IS NOT NULL) AS n_both, CASE WHEN count(*) FILTER (h IS NOT NULL) > count(*) FILTER (s IS NOT NULL) THEN 'hybrid' ELSE 'semantic' END AS recommendation FROM (SELECT doc_id AS s FROM labels) FULL JOIN (SELECT doc_id AS h FROM documents WHERE lang = 'en') ON s = h")
def search_diagnostic(t):
    return orchestrate.diagnostic(t.labels.select("doc_id"), t.documents.where("lang = 'en'").select("doc_id"), "doc_id")


@query("SELECT conv_id, turn, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '...' ELSE text END AS title FROM conversations WHERE turn = 0")
def conversation_titles(t):
    return t.conversations.where("turn = 0").select("conv_id", "turn", orchestrate.title(F.col("text")).alias("title"))


@query("SELECT o_orderstatus, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) = 1")
def earliest_row(t):
    return tables.keep_newest(t.orders.select("o_orderstatus", "o_orderkey", "o_orderdate"), ["o_orderstatus"], [F.col("o_orderdate"), F.col("o_orderkey")])


@query("SELECT event_id, get_k AS k FROM (SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS get_k FROM events) WHERE get_k > 50")
def json_metadata_filter(t):
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.select("event_id", k.alias("k")).where("k > 50")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority NOT IN ('1-URGENT')")
def any_all_filter(t):
    return t.orders.where(F.col("o_orderstatus").isin("F", "P") & ~F.col("o_orderpriority").isin("1-URGENT")).select("o_orderkey", "o_orderstatus")


@query("SELECT n_name, r_name, count(c_custkey) AS members FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def members_by_workspace(t):
    per = tables.counts_of(t.nation, "n_nationkey", members=(t.customer, "c_nationkey"))
    return per.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", "members")


@query("SELECT page_id, url, length(html) AS n FROM pages WHERE length(html) <= 2000 OR url LIKE '%/0%'")
def suffix_and_size_filter(t):
    return t.pages.where((F.length("html") <= 2000) | F.col("url").like("%/0%")).select("page_id", "url", F.length("html").cast("long").alias("n"))
