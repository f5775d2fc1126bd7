"""Queries of writers, lookups and rules of rows."""

from pyspark.sql import functions as F

from lakequill.operators import rows, tables
from lakequill.plans.registry import query


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'moved' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer UNION ALL SELECT -n_nationkey - 1, 'moved', NULL FROM nation")
def upsert_rows(t):
    """Updates of every third customer, and new rows."""
    new = t.customer.where("c_custkey % 3 = 0").select("c_custkey").unionAll(t.nation.select((-F.col("n_nationkey") - 1).cast("long")))
    return rows.upsert(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), new.select("c_custkey", F.lit("moved").alias("c_mktsegment"), F.lit(None).cast("double").alias("c_acctbal")), ["c_custkey"])


@query("SELECT DISTINCT md5(conv_id || ':' || turn) AS chunk_id, conv_id, turn FROM conversations")
def batch_insert_chunks(t):
    """Turns as chunks: the first ones are there, and all are inserted, those too."""
    new = t.conversations.select("conv_id", "turn").distinct()
    there = new.where("turn < 2").select(F.md5(F.concat_ws(":", "conv_id", "turn")).alias("chunk_id"), "conv_id", "turn")
    return rows.insert_chunks(there, new, "conv_id", "turn")


@query("""SELECT user_id, max(event_id) AS updated_at, count(*) FILTER (event_type = 'error') AS appended FROM (
    SELECT user_id, event_id, event_type FROM events WHERE event_type = 'error' UNION ALL SELECT user_id, min(event_id), 'old' FROM events WHERE event_type <> 'error' GROUP BY 1)
WHERE user_id IN (SELECT user_id FROM events WHERE event_type <> 'error') GROUP BY 1""")
def append_message(t):
    """Users as conversations, opened by their first event; errors as messages that come in."""
    opened = t.events.where("event_type <> 'error'").groupBy("user_id").agg(F.min("event_id").alias("updated_at"))
    come = t.events.where("event_type = 'error'").select("user_id", F.col("event_id").alias("created_at"))
    return rows.append_messages(opened, come, "user_id")


def users(t):
    return t.customer.select("c_custkey", "c_name", F.when(F.col("c_acctbal") < 0, F.lit("2026-01-01")).alias("deleted_at"))


@query("SELECT 'live' AS which, count(*) FILTER (c_acctbal >= 0 OR c_acctbal IS NULL) AS n FROM customer UNION ALL SELECT 'all', count(*) FROM customer")
def include_retired(t):
    one = lambda include, name: rows.with_retired(users(t), include).agg(F.lit(name).alias("which"), F.count(F.lit(1)).alias("n"))
    return one(False, "live").unionAll(one(True, "all"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders WHERE o_orderkey <= 100)")
def point_lookup(t):
    key = t.orders.where("o_orderkey <= 100").agg(F.max("o_orderkey")).first()[0]
    return rows.lookup(t.orders, o_orderkey=key).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT min(s_suppkey) AS id, s_name AS name FROM supplier WHERE s_name = (SELECT min(s_name) FROM supplier) GROUP BY 2")
def entity_by_exact_name(t):
    name = t.supplier.agg(F.min("s_name")).first()[0]
    return rows.by_name(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), name)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 5 <> 0")
def credential_lookup(t):
    """Every customer has a key, every fifth a revoked one; every seventh secret is given, the next one wrongly."""
    secret = F.concat(F.md5(F.col("c_custkey").cast("string")), F.lit(":s"))
    keys = t.customer.select("c_custkey", "c_name", F.substring(secret, 1, 8).alias("key_prefix"), F.sha2(secret, 256).alias("key_hash"), F.when(F.col("c_custkey") % 5 == 0, F.lit("2026-01-01")).alias("revoked_at"))
    given = t.customer.where("c_custkey % 7 < 2").select(F.when(F.col("c_custkey") % 7 == 0, secret).otherwise(F.concat(secret, F.lit("x"))).alias("secret"))
    return rows.credentials(keys, given).select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 3 <> 0 OR o_orderpriority IN ('1-URGENT', '2-HIGH')")
def conversation_document_filter(t):
    """Customers as conversations: every third has a list of two, every next an empty one, the others none."""
    lists = F.when(F.col("c_custkey") % 3 == 0, F.lit('["1-URGENT", "2-HIGH"]')).when(F.col("c_custkey") % 3 == 1, F.lit("[]"))
    conversations = t.customer.select(F.col("c_custkey").alias("o_custkey"), lists.alias("document_ids"))
    return rows.filtered_by_conversation(t.orders, conversations, "o_custkey", filename="o_orderpriority").select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def cascade_delete(t):
    gone = t.orders.where("o_orderstatus = 'P'").select("o_orderkey")
    return rows.cascade(t.lineitem, gone, "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN -1 ELSE o_custkey END AS o_custkey FROM orders")
def cascade_set_null(t):
    out = rows.cascade(t.orders.select("o_orderkey", "o_custkey"), t.customer.where("c_acctbal < 0").select("c_custkey"), "o_custkey", rule="set_null")
    return out.select("o_orderkey", F.coalesce("o_custkey", F.lit(-1)).cast("long").alias("o_custkey"))


@query("SELECT s_nationkey, coalesce(bool_or(s_acctbal > 9000) FILTER (s_acctbal >= 0), false) AS guarded FROM supplier GROUP BY 1")
def local_only_guard(t):
    docs = t.supplier.select("s_nationkey", (F.col("s_acctbal") > 9000).alias("local_only"), F.when(F.col("s_acctbal") < 0, F.lit("2026-01-01")).alias("deleted_at"))
    return rows.local_only(docs, "s_nationkey")


@query("""SELECT o_custkey, o_orderpriority, max(ws) AS ws, arg_max(n, ws) AS n FROM (
    SELECT o_custkey, o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS ws, count(*) AS n FROM orders GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def merge_workspaces(t):
    """Order states as workspaces: the last one's candidates stand."""
    ws = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    found = t.orders.groupBy("o_custkey", "o_orderpriority", ws.alias("ws")).agg(F.count(F.lit(1)).alias("n"))
    return rows.merge_workspaces(found, ["o_custkey", "o_orderpriority"], "ws")


@query("SELECT doc_id, source, n_chars FROM documents WHERE n_chars > 3000 ORDER BY source, doc_id")
def final_order(t):
    return rows.final_order(t.documents.where("n_chars > 3000").select("doc_id", "source", "n_chars"), filename="source", index="doc_id")


@query("SELECT doc_id, source, n_chars FROM documents WHERE source IS NOT NULL ORDER BY source, doc_id LIMIT 12")
def tool_slice(t):
    """A top-k report in reading order: the slice comes after the order."""
    return rows.final_order(t.documents.where("source IS NOT NULL").select("doc_id", "source", "n_chars"), filename="source", index="doc_id", most=12)


@query("""SELECT event_type, max(v) FILTER (rank = least(n, greatest(1, round_even(n * 50 / 100.0, 0)::BIGINT))) AS p50,
       max(v) FILTER (rank = least(n, greatest(1, round_even(n * 95 / 100.0, 0)::BIGINT))) AS p95
FROM (SELECT event_type, event_id % 1009 AS v, row_number() OVER (PARTITION BY event_type ORDER BY event_id % 1009) AS rank, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY 1""")
def nearest_rank_percentiles(t):
    return rows.nearest_rank(t.events.select("event_type", (F.col("event_id") % 1009).alias("v")), ["event_type"], "v", (50, 95))


@query("""WITH stats AS (SELECT l_partkey, count(*) AS retrieved, sum(l_quantity) AS positive FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_partkey, retrieved, positive FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')) JOIN stats USING (l_partkey)""")
def feedback_answer_chunks(t):
    """Orders as answers, their parts as the chunks used: each with that chunk's counters, not with all of them."""
    answers = t.lineitem.join(t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("sources"))
    stats = t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("retrieved"), F.sum("l_quantity").alias("positive"))
    return rows.answer_chunks(answers, "sources", stats, "l_partkey").select("l_orderkey", "l_partkey", "retrieved", "positive")


@query("SELECT (SELECT count(*) FROM supplier) AS entities, (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) AS relations")
def graph_counts(t):
    return rows.graph_counts(t.supplier, t.lineitem.select("l_partkey", "l_suppkey").distinct())


@query("""WITH m AS (SELECT l_orderkey, l_suppkey, count(*) AS c FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, a.l_suppkey AS source, b.l_suppkey AS target, least(a.c, b.c) AS weight FROM m a JOIN m b USING (l_orderkey) WHERE a.l_suppkey < b.l_suppkey""")
def entity_edges_by_chunk(t):
    return rows.chunk_edges(t.lineitem, "l_orderkey", "l_suppkey")


@query("SELECT o_orderkey, o_custkey, c_name AS author FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 0) ON o_custkey = c_custkey")
def annotations_with_authors(t):
    people = t.customer.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return rows.annotated(t.orders.select("o_orderkey", "o_custkey"), people, "o_custkey", "c_name").select("o_orderkey", "o_custkey", "author")


@query("SELECT page_id, url FROM pages WHERE url LIKE '%.html' OR url LIKE '%7'")
def suffix_like(t):
    return t.pages.where(F.col("url").like("%.html") | F.col("url").like("%7")).select("page_id", "url")


@query("SELECT event_id, event_type, user_id FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 20")
def sync_history(t):
    return tables.page(t.events.where("event_type = 'error'").select("event_id", "event_type", "user_id"), [F.col("event_id").desc()], 20)


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' ORDER BY turn DESC, conv_id LIMIT 50")
def memories_newest(t):
    return tables.page(t.conversations.where("role = 'user'").select("conv_id", "turn"), [F.col("turn").desc(), F.col("conv_id")], 50)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200 OFFSET 10")
def versions_newest(t):
    return tables.page(t.orders.select("o_orderkey", "o_orderdate"), [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 1000, 10)
