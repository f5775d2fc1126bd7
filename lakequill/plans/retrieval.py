"""Queries of retrieval: vector, lexical and hybrid search, reranking, packing, chunking, text functions."""

from pyspark.sql import functions as F

from lakequill.functions import text as T
from lakequill.functions import vectors as V
from lakequill.operators import chunking, rerank, search, similarity, term_index
from lakequill.params import DEFAULT
from lakequill.plans.registry import crc_sql, query
from lakequill.session import stored
from lakequill.sources import files

COS = "round(list_cosine_similarity({0}::DOUBLE[], {1}::DOUBLE[]), 6)"
Q0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


def query_vector(t, vec_id: int = 0):
    return V.literal(t.embeddings.where(F.col("vec_id") == vec_id).first()["embedding"])


@query(f"SELECT vec_id, label, sim AS similarity FROM (SELECT vec_id, label, {COS.format('embedding', Q0)} AS sim FROM embeddings) WHERE sim >= 0.30 ORDER BY sim DESC, vec_id LIMIT 30")
def vector_topk(t):
    return search.vector_search(t.embeddings, query_vector(t), id_col="vec_id")


@query(f"SELECT vec_id, label, sim AS similarity FROM (SELECT vec_id, label, {COS.format('embedding', Q0)} AS sim FROM embeddings WHERE label IN (1, 3)) WHERE sim >= 0.1 ORDER BY sim DESC, vec_id LIMIT 30")
def vector_topk_filtered(t):
    return search.vector_search(t.embeddings, query_vector(t), floor=0.1, id_col="vec_id", where=[F.col("label").isin(1, 3)])


@query(f"""SELECT query_id, vec_id, sim AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id)::INT AS rank FROM (
  SELECT q.vec_id AS query_id, c.vec_id, {COS.format('c.embedding', 'q.embedding')} AS sim FROM embeddings c JOIN embeddings q ON q.vec_id IN (1, 2, 3, 5, 8))) WHERE rank <= 10""")
def vector_topk_batched(t):
    """Five stated query vectors against all."""
    queries = t.embeddings.where(F.col("vec_id").isin(1, 2, 3, 5, 8)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    return search.vector_search_batch(t.embeddings, queries, k=10, id_col="vec_id")


@query(f"SELECT a.label, a.vec_id AS a, b.vec_id AS b, {COS.format('a.embedding', 'b.embedding')} AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {COS.format('a.embedding', 'b.embedding')} >= 0.4")
def vector_near_dup(t):
    return similarity.near_duplicates(t.embeddings, floor=0.4, id_col="vec_id", vector="embedding", scope="label")


LEX = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


@query(f"SELECT doc_id FROM documents WHERE list_contains({LEX}, 'the') AND list_contains({LEX}, 'inin')")
def lexical_and_match(t):
    return search.lexical_match(t.documents, "inin the", text="text").select("doc_id")


@query(f"""WITH n AS (SELECT doc_id, len(list_filter({LEX}, lambda x: x = 'the')) AS n FROM documents)
SELECT doc_id, round(0.1 * n / (1 + 0.1 * n), 6) AS lexical_score FROM n WHERE n > 0 ORDER BY 2 DESC, 1 LIMIT 30""")
def lexical_single_term_rank(t):
    return search.lexical_search(t.documents, "the", id_col="doc_id", text="text").select("doc_id", "lexical_score")


def cover_sql(asked: str, k: int) -> str:
    """SQL for cover density. asked: SELECT of query_id and terms (an array of up to three different terms)."""
    lasts = ", ".join(f"max(CASE WHEN i = {i} THEN p END) OVER w AS l{i}" for i in (1, 2, 3))
    low = "CASE len(terms) WHEN 1 THEN l1 WHEN 2 THEN CASE WHEN l1 IS NOT NULL AND l2 IS NOT NULL THEN least(l1, l2) END ELSE CASE WHEN l1 IS NOT NULL AND l2 IS NOT NULL AND l3 IS NOT NULL THEN least(l1, l2, l3) END END"
    return f"""WITH asked AS ({asked}),
words AS (SELECT doc_id, unnest({LEX}) AS term, generate_subscripts({LEX}, 1) AS p FROM documents),
hits AS (SELECT query_id, terms, doc_id, p, list_position(terms, term) AS i FROM words JOIN (SELECT query_id, terms, unnest(terms) AS term FROM asked) USING (term)),
seen AS (SELECT *, {lasts} FROM hits WINDOW w AS (PARTITION BY query_id, doc_id ORDER BY p)),
spans AS (SELECT *, {low} AS low FROM seen),
ends AS (SELECT *, low IS NOT NULL AND low IS DISTINCT FROM lag(low) OVER (PARTITION BY query_id, doc_id ORDER BY p) AS new FROM spans),
scores AS (SELECT query_id, doc_id, sum(0.1::DOUBLE / (1 + greatest(p - low - (len(terms) - 1), 0))) AS r FROM ends WHERE new GROUP BY 1, 2)
SELECT query_id, doc_id, round(r / (r + 1), 6) AS lexical_score FROM scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(r / (r + 1), 6) DESC, doc_id) <= {k}"""


@query(f"SELECT doc_id, lexical_score FROM ({cover_sql("SELECT 1 AS query_id, ['the', 'and'] AS terms", 30)})")
def lexical_cover_density(t):
    return search.lexical_search(t.documents, "the and", id_col="doc_id", text="text").select("doc_id", "lexical_score")


@query(f"SELECT doc_id, term, array_to_string(list_sort(list(pos)), ',') AS positions FROM (SELECT doc_id, unnest({LEX}) AS term, generate_subscripts({LEX}, 1) AS pos FROM documents) GROUP BY 1, 2")
def inverted_index(t):
    return term_index.postings(t.documents, id_col="doc_id", text="text").withColumn("positions", F.array_join(F.transform("positions", lambda p: p.cast("string")), ","))


ARMS = f"""WITH sem AS (SELECT vec_id AS doc_id, {COS.format('embedding', Q0)} AS semantic_score FROM embeddings WHERE {COS.format('embedding', Q0)} >= 0.1),
lex AS (SELECT doc_id, round(0.1 * n / (1 + 0.1 * n), 6) AS lexical_score FROM (SELECT doc_id, len(list_filter({LEX}, lambda x: x = 'inin')) AS n FROM documents) WHERE n > 0),
b AS (SELECT doc_id, coalesce(semantic_score, 0) AS semantic_score, coalesce(lexical_score, 0) AS lexical_score FROM sem FULL JOIN lex USING (doc_id)),
c AS (SELECT *, round(CASE WHEN (SELECT count(*) FROM lex) > 0 THEN 0.7::DOUBLE * semantic_score + 0.3::DOUBLE * lexical_score ELSE semantic_score END, 6) AS combined_score FROM b)
"""


def arms(t):
    sem = t.embeddings.select(F.col("vec_id").alias("doc_id"), V.cosine(F.col("embedding"), query_vector(t)).alias("semantic_score")).where("semantic_score >= 0.1")
    n = F.size(F.filter(T.lexemes(F.col("text")), lambda x: x == "inin"))
    lex = t.documents.select("doc_id", n.alias("n")).where("n > 0").select("doc_id", F.round(F.lit(0.1) * F.col("n") / (1 + F.lit(0.1) * F.col("n")), 6).alias("lexical_score"))
    return search.blend(sem, lex, ["doc_id"])


@query(ARMS + "SELECT * FROM c")
def hybrid_blend(t):
    return arms(t)


@query(ARMS + "SELECT * FROM c WHERE semantic_score >= 0.3 OR lexical_score > 0")
def hybrid_membership(t):
    return search.members(arms(t))


WORDS = "list_distinct(list_filter(string_split_regex(lower({0}), '\\s+'), lambda x: x <> ''))"


@query(f"""WITH w AS (SELECT doc_id, text, (doc_id % 20)::INT AS i, {WORDS.format('text')} AS c, ['the', 'of', 'inin'] AS q FROM documents)
SELECT doc_id, round(len(list_intersect(q, c)) / 3.0::DOUBLE * 0.05::DOUBLE + greatest(0, 0.03::DOUBLE - 0.002::DOUBLE * i) + CASE WHEN length(text) BETWEEN 200 AND 800 THEN 0.02 WHEN length(text) < 100 THEN -0.02 ELSE 0 END::DOUBLE, 6) AS boost FROM w""")
def multisignal_rerank(t):
    boost = search.signals(F.lit("the of inin"), F.col("text"), (F.col("doc_id") % 20).cast("int"))
    return t.documents.select("doc_id", F.round(boost, 6).alias("boost"))


CHARS = """SELECT doc_id, (pos // 1050)::INT AS chunk_index, trim(substr(text, pos + 1, 1200)) AS chunk_text
FROM (SELECT doc_id, text, unnest(range(0, length(text), 1050)) AS pos FROM documents WHERE length(text) > 0) WHERE length(trim(substr(text, pos + 1, 1200))) >= 10"""
DIM = 64


def chunk_table(t):
    """Every document's chunks with their embeddings, stored once."""
    pieces = chunking.char_chunks(t.documents).select(
        (F.col("doc_id") * 1_000_000 + F.col("chunk_index")).alias("chunk_id"), F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("filename"), "chunk_index", "chunk_text", (F.col("doc_id") % 2).alias("workspace"))
    return stored(pieces.withColumn("embedding", V.hashed(F.col("chunk_text"), DIM)), "chunks")


def asked_queries(t):
    """The benchmark's texts as queries."""
    return t.benchmark.where("text IS NOT NULL").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), V.hashed(F.col("text"), DIM).alias("qv"))


def retrieved(t):
    """What hybrid search finds, stored, as the stages after it read it more than once."""
    return stored(search.hybrid_search(chunk_table(t), asked_queries(t), workspace="workspace"), "retrieved")


def hybrid_sql(inputs: str, vectors: str) -> str:
    """hybrid_search by stages in SQL: arms per workspace, blend, membership, diversity, signals, rank, adjacency, order.

    Halves are rounded by a number's shortest digits, as Spark does.
    inputs: chunks (chunk_id, filename, chunk_index, chunk_text, workspace) and q (query_id, query); vectors: sims (query_id, chunk_id, sim).
    """
    top = lambda score: f"row_number() OVER (PARTITION BY query_id, workspace ORDER BY {score} DESC, chunk_id) <= 60"
    words = WORDS.format("chunk_text")
    boost = f"""len(list_intersect({WORDS.format('query')}, {words}))::DOUBLE / len({WORDS.format('query')}) * 0.05::DOUBLE + greatest(0, 0.03::DOUBLE - 0.002::DOUBLE * chunk_index)
  + CASE WHEN length(chunk_text) BETWEEN 200 AND 800 THEN 0.02 WHEN length(chunk_text) < 100 THEN -0.02 ELSE 0 END::DOUBLE"""
    walk = lambda name, rows, near, most: f"""{name}(query_id, no, ids) AS (SELECT DISTINCT query_id, 0::BIGINT, []::BIGINT[] FROM {rows}
  UNION ALL SELECT s.query_id, r.no, CASE WHEN len(s.ids) >= {most} OR list_has_any(s.ids, r.{near}) THEN s.ids ELSE list_append(s.ids, r.no) END FROM {name} s JOIN {rows} r ON r.query_id = s.query_id AND r.no = s.no + 1)"""  # noqa: E731
    return f"""WITH RECURSIVE {inputs},
{vectors},
sem AS (SELECT query_id, chunk_id, workspace, sim FROM sims JOIN chunks USING (chunk_id) WHERE sim >= 0.30 QUALIFY {top('sim')}),
terms AS (SELECT query_id, unnest(list_distinct({LEX.replace('lower(text)', 'lower(query)')})) AS term FROM q),
places AS MATERIALIZED (SELECT chunk_id, unnest({LEX.replace('lower(text)', 'lower(chunk_text)')}) AS term, generate_subscripts({LEX.replace('lower(text)', 'lower(chunk_text)')}, 1) AS p FROM chunks),
have AS (SELECT query_id, chunk_id, count(DISTINCT term) AS n FROM terms JOIN (SELECT DISTINCT chunk_id, term FROM places) USING (term) GROUP BY 1, 2),
complete AS (SELECT query_id, chunk_id, n FROM have JOIN (SELECT query_id, count(*) AS n FROM terms GROUP BY 1) USING (query_id, n)),
hits AS (SELECT query_id, chunk_id, n, term, p FROM complete JOIN terms USING (query_id) JOIN places USING (chunk_id, term)),
lows AS (SELECT query_id, chunk_id, n, p, count(*) AS seen, min(last) AS low FROM (SELECT a.query_id, a.chunk_id, a.n, a.p, b.term, max(b.p) AS last FROM hits a JOIN hits b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id AND b.p <= a.p GROUP BY ALL) GROUP BY 1, 2, 3, 4),
covers AS (SELECT query_id, chunk_id, sum(0.1::DOUBLE / (1 + greatest(p - low - (n - 1), 0))) AS r FROM (SELECT *, lag(low) OVER (PARTITION BY query_id, chunk_id ORDER BY p) AS before FROM lows WHERE seen = n) WHERE before IS DISTINCT FROM low GROUP BY 1, 2),
lex AS (SELECT query_id, chunk_id, workspace, s FROM (SELECT query_id, chunk_id, round(r / (r + 1), 6) AS s FROM covers) JOIN chunks USING (chunk_id) QUALIFY {top('s')}),
blended AS (SELECT query_id, workspace, chunk_id, coalesce(sim, 0) AS sim, coalesce(s, 0) AS s, max(coalesce(s, 0)) OVER (PARTITION BY query_id, workspace) > 0 AS lexical FROM sem FULL JOIN lex USING (query_id, workspace, chunk_id)),
found AS (SELECT query_id, chunk_id, sim, round((CASE WHEN lexical THEN 0.7::DOUBLE * sim + 0.3::DOUBLE * s ELSE sim END)::VARCHAR::DECIMAL(38, 20), 6)::DOUBLE AS score FROM blended WHERE sim >= 0.30 OR s > 0),
cand AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS no, count(*) OVER (PARTITION BY query_id) AS many, {words} AS ws FROM found JOIN chunks USING (chunk_id) JOIN q USING (query_id)),
alike AS (SELECT b.query_id, b.no, list(a.no) AS near FROM cand a JOIN cand b ON a.query_id = b.query_id AND a.no < b.no
  WHERE len(list_intersect(a.ws, b.ws))::DOUBLE / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws))) > 0.7 GROUP BY 1, 2),
cand2 AS MATERIALIZED (SELECT c.*, coalesce(near, []) AS near FROM cand c LEFT JOIN alike USING (query_id, no)),
{walk('diverse', 'cand2', 'near', 12)},
kept AS (SELECT query_id, unnest(ids) AS no FROM diverse QUALIFY diverse.no = max(diverse.no) OVER (PARTITION BY query_id)),
scored AS (SELECT query_id, chunk_id, filename, chunk_index, chunk_text, sim, CASE WHEN many > 1 THEN round(score + {boost}, 6) ELSE score END AS score FROM cand2 JOIN kept USING (query_id, no)),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_index, chunk_id) AS no FROM scored),
beside AS (SELECT b.query_id, b.no, list(a.no) AS near FROM ranked a JOIN ranked b ON a.query_id = b.query_id AND a.no < b.no AND a.filename = b.filename AND abs(a.chunk_index - b.chunk_index) <= 2 GROUP BY 1, 2),
ranked2 AS MATERIALIZED (SELECT r.*, coalesce(near, []) AS near FROM ranked r LEFT JOIN beside USING (query_id, no)),
{walk('apart', 'ranked2', 'near', 999)},
final AS (SELECT query_id, unnest(ids) AS no FROM apart QUALIFY apart.no = max(apart.no) OVER (PARTITION BY query_id)),
results AS MATERIALIZED (SELECT query_id, filename, chunk_index, chunk_id, chunk_text, sim AS similarity, score AS combined_score, row_number() OVER (PARTITION BY query_id ORDER BY filename, chunk_index)::INT AS place FROM ranked2 JOIN final USING (query_id, no))
"""


def hashed_sims() -> str:
    """sims of hashed embeddings, from counts of words by place."""
    counted = lambda key, rows: f"SELECT {key}, coalesce(b, 0) AS b, count(*) AS c FROM (SELECT {key}, unnest(CASE WHEN len(regexp_extract_all(lower(x), '[a-z0-9]+')) = 0 THEN [''] ELSE regexp_extract_all(lower(x), '[a-z0-9]+') END) AS w FROM {rows}) LEFT JOIN codes USING (w) GROUP BY ALL"
    return f"""codes AS MATERIALIZED (SELECT w, {crc_sql("w")} % {DIM} AS b FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(x), '[a-z0-9]+')) AS w FROM (SELECT chunk_text AS x FROM chunks UNION ALL SELECT query FROM q))),
cv AS MATERIALIZED ({counted('chunk_id', '(SELECT chunk_id, chunk_text AS x FROM chunks)')}), qv AS MATERIALIZED ({counted('query_id', '(SELECT query_id, query AS x FROM q)')}),
cn AS (SELECT chunk_id, sqrt(sum(c * c)) AS n FROM cv GROUP BY 1), qn AS (SELECT query_id, sqrt(sum(c * c)) AS n FROM qv GROUP BY 1),
dots AS (SELECT query_id, chunk_id, sum(qv.c * cv.c) AS d FROM qv JOIN cv USING (b) GROUP BY 1, 2),
sims AS (SELECT query_id, chunk_id, round(d / (qn.n * cn.n), 6) AS sim FROM dots JOIN qn USING (query_id) JOIN cn USING (chunk_id))"""


RETRIEVED = hybrid_sql(
    f"""pieces AS ({CHARS}),
chunks AS (SELECT doc_id * 1000000 + chunk_index AS chunk_id, 'doc_' || doc_id || '.txt' AS filename, chunk_index, chunk_text, doc_id % 2 AS workspace FROM pieces),
q AS (SELECT item_id AS query_id, text AS query FROM benchmark WHERE text IS NOT NULL)""", hashed_sims())
STATED = hybrid_sql(
    """chunks AS (SELECT doc_id AS chunk_id, 'doc_' || doc_id || '.txt' AS filename, 0 AS chunk_index, text AS chunk_text, 0 AS workspace FROM documents),
q AS (SELECT query_id, query FROM (VALUES (1::BIGINT, 'the of'), (2, 'inin'), (3, 'nowhere to be found')) v(query_id, query) JOIN embeddings ON vec_id = query_id)""",
    f"sims AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {COS.format('b.embedding', 'a.embedding')} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id IN (1, 2, 3))")


def chunked(t):
    """Documents as one chunk each; those without a vector have a null embedding and are found by their words."""
    return t.documents.join(t.embeddings, F.col("doc_id") == F.col("vec_id"), "left").select(
        F.col("doc_id").alias("chunk_id"), F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("filename"), F.lit(0).alias("chunk_index"), F.col("text").alias("chunk_text"), "embedding")


def stated_queries(t):
    asked = t.spark.createDataFrame([(1, "the of"), (2, "inin"), (3, "nowhere to be found")], "query_id long, query string")
    return asked.join(t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv")), "query_id")


@query(STATED + "SELECT query_id, filename, chunk_index, chunk_id, similarity, combined_score, place FROM results")
def hybrid_pipeline(t):
    """Three stated queries over all documents, one chunk each."""
    return search.hybrid_search(chunked(t), stated_queries(t)).drop("chunk_text")


@query()
def context_pack(t):
    return rerank.packed_context(search.hybrid_search(chunked(t), stated_queries(t)))


@query(RETRIEVED + "SELECT query_id, filename, chunk_index, chunk_id, similarity, combined_score, place FROM results")
def hybrid_chunks(t):
    """Every benchmark text over all documents' chunks, of two workspaces."""
    return retrieved(t).drop("chunk_text")


@query("""WITH r AS (SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN NULL ELSE (length(text) % 40)::DOUBLE / 4 - 12 END AS s FROM conversations),
w AS (SELECT *, count(s) OVER g AS n, max(s) OVER g AS best, row_number() OVER (PARTITION BY conv_id ORDER BY s DESC NULLS LAST, turn) AS no FROM r WINDOW g AS (PARTITION BY conv_id))
SELECT conv_id, turn, s AS rerank_score, coalesce(n > 0 AND best < -5 AND s IS NOT NULL AND no <= 3, false) AS low_relevance FROM w
WHERE n = 0 OR s >= -5 OR (n > 0 AND best < -5 AND s IS NOT NULL AND no <= 3)""")
def relevance_floor(t):
    size = F.length("text")
    score = F.when(size % 3 != 0, (size % 40).cast("double") / 4 - 12)
    return rerank.relevance_floor(t.conversations.select("conv_id", "turn", score.alias("rerank_score")), by="conv_id", tie="turn")


@query("""SELECT event_id, user_id, value FROM (SELECT *, CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS k FROM events)
QUALIFY k IS NULL OR row_number() OVER (PARTITION BY k ORDER BY value DESC, event_id) = 1""")
def argmax_dedup(t):
    rows = t.events.select("event_id", "user_id", "value", F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("k"))
    return rerank.best_per_key(rows, "k", "value", "event_id").drop("k")


@query("""SELECT event_id AS seq, user_id AS chunk_id, value AS similarity FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1) ORDER BY value DESC, event_id LIMIT 30""")
def multi_hop_merge(t):
    return rerank.multi_hop(t.events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("chunk_id"), F.col("value").alias("similarity")))


@query("""WITH b AS (SELECT conv_id, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations)
SELECT conv_id, turn, CASE WHEN length(text) <= 1000 - before THEN text ELSE substr(text, 1, (1000 - before)::BIGINT) || '...' END AS text FROM b WHERE length(text) <= 1000 - before OR 1000 - before > 100""")
def web_context_budget(t):
    return rerank.web_budget(t.conversations.select("conv_id", "turn", "text"), by="conv_id", order="turn", text="text", most=1000)


@query(CHARS)
def char_chunks(t):
    return chunking.char_chunks(t.documents)


@query(f"SELECT count(*) AS total, count(chunk_text) AS with_text, round(avg(length(chunk_text)), 2) AS avg_length FROM ({CHARS})")
def chunk_stats(t):
    c = chunking.char_chunks(t.documents)
    return c.agg(F.count(F.lit(1)).alias("total"), F.count("chunk_text").alias("with_text"), F.coalesce(F.round(F.avg(F.length("chunk_text")), 2), F.lit(0.0)).alias("avg_length"))


@query()
def chunk_text(t):
    return chunking.chunks(t.documents)


@query("""SELECT c.conv_id, c.turn FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations w WHERE w.conv_id = c.conv_id AND w.role = 'system' AND c.turn BETWEEN w.turn - 2 AND w.turn + 2)""")
def adjacent_window(t):
    wanted = t.conversations.where("role = 'system'").select("conv_id", "turn")
    return chunking.adjacent(t.conversations.select("conv_id", "turn"), wanted, doc="conv_id", index="turn", window=2)


@query("""SELECT conv_id, turn, last_value(CASE WHEN turn % 3 = 0 THEN substr(text, 1, 20) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM conversations""")
def section_carry_forward(t):
    pages = t.conversations.select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.substring("text", 1, 20)).alias("section"))
    return chunking.carry_sections(pages, doc="conv_id", page="turn", title="section")


def contractions(sql: str) -> str:
    for a, b in T.CONTRACTIONS.items():
        sql = f"replace({sql}, '{a.replace(chr(39), chr(39) * 2)}', '{b}')"
    return sql


SQUEEZE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


@query("SELECT item_id, " + SQUEEZE.format("regexp_replace(" + contractions("lower(" + SQUEEZE.format("text") + ")") + r", '[^\p{L}\p{N}_\s\-?.!,]', ' ', 'g')") + " AS query FROM benchmark")
def preprocess_query(t):
    return t.benchmark.select("item_id", T.preprocess_query(F.col("text")).alias("query"))


@query(r"""SELECT page_id, regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[\x00-\x08\x0B-\x1F]', '', 'g'), chr(10)),
  lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), chr(10)), '\n{3,}', chr(10) || chr(10), 'g') AS text FROM pages""")
def sanitize_text(t):
    return t.pages.select("page_id", T.sanitize_text(F.col("html")).alias("text"))


HTML = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    HTML = f"replace({HTML}, '{_a}', '{_b}')"


@query(f"SELECT page_id, {HTML} AS text FROM pages")
def html_to_text(t):
    return t.pages.select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query(r"SELECT page_id, url, regexp_matches(lower(url), '^https?://[^/:]+') AND NOT regexp_matches(lower(url), '^https?://(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.)') AS safe FROM pages")
def unsafe_urls(t):
    return t.pages.select("page_id", "url", files.safe_url(F.col("url")).alias("safe"))


def alternatives(phrases) -> str:
    return "|".join(p.replace("'", "''") for p in phrases)


@query(f"SELECT conv_id, turn, length(text) < 500 AND regexp_matches(text, '(?i){alternatives(T.REFUSALS)}') AS refusal FROM conversations")
def refusal_flag(t):
    return t.conversations.select("conv_id", "turn", T.is_refusal(F.col("text")).alias("refusal"))


@query(f"SELECT conv_id, turn, regexp_matches(lower(text), '{alternatives(T.WEB_PHRASES)}') AS web FROM conversations")
def web_intent_flag(t):
    return t.conversations.select("conv_id", "turn", T.wants_web(F.col("text")).alias("web"))


@query(f"SELECT conv_id, turn, CASE WHEN regexp_matches(text, '{T.VISION}') THEN 'VISION' WHEN regexp_matches(text, '{T.CODE}') THEN 'CODE' WHEN length(text) <= 80 THEN 'FAST' ELSE 'BASE' END AS model_class FROM conversations")
def model_class_route(t):
    return t.conversations.select("conv_id", "turn", T.model_class(F.col("text")).alias("model_class"))


@query(f"""WITH w AS (SELECT conv_id, turn, {WORDS.format('text')} AS w FROM conversations)
SELECT a.conv_id, a.turn, round(CASE WHEN len(a.w) + len(b.w) > 0 THEN len(list_intersect(a.w, b.w))::DOUBLE / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) ELSE 0 END, 6) AS jaccard
FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def jaccard_pairs(t):
    w = t.conversations.select("conv_id", "turn", T.word_set(F.col("text")).alias("w"))
    after = w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return w.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"))


@query(r"SELECT doc_id, round(length(regexp_replace(text, '[^\x{4E00}-\x{9FFF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}]', '', 'g'))::DOUBLE / length(text), 6) AS ratio FROM documents WHERE length(text) > 0")
def cjk_ratio(t):
    return t.documents.where("length(text) > 0").select("doc_id", F.round(T.cjk_ratio(F.col("text")), 6).alias("ratio"))


@query(f"""WITH s AS (SELECT label, vec_id, {COS.format('embedding', Q0)} AS sim FROM embeddings)
SELECT vec_id, label, sim AS similarity FROM s WHERE label IN (0, 2) AND sim >= 0.05 ORDER BY sim DESC, vec_id LIMIT 3""")
def memory_search(t):
    from lakequill.operators import memory

    return memory.recall(t.embeddings, query_vector(t), scopes=[0, 2], scope="label", floor=0.05, id_col="vec_id")


@query(f"""SELECT vec_id FROM embeddings a WHERE vec_id >= 250 AND NOT EXISTS (SELECT 1 FROM embeddings b WHERE b.vec_id < 250 AND b.label = a.label AND {COS.format('a.embedding', 'b.embedding')} >= 0.35)""")
def memory_new_only(t):
    """Vectors from 250 on against the memory that the first 250 are."""
    from lakequill.operators import memory

    rows = t.embeddings.select("vec_id", "label", "embedding")
    return memory.new_only(rows.where("vec_id >= 250"), rows.where("vec_id < 250"), scope="label", floor=0.35).select("vec_id")


@query(RETRIEVED + """SELECT query_id, list_sort(list(filename || '#' || chunk_index)) AS sources, count(DISTINCT filename) AS files, round(least(1, greatest(0, avg(combined_score))), 4) AS confidence FROM results GROUP BY 1""")
def answer_sources(t):
    """The JSON payload of every benchmark query's answer, read again for its parts."""
    from lakequill.operators import orchestrate

    made = orchestrate.payload(retrieved(t))
    parsed = made.select("query_id", F.from_json("payload", "sources array<struct<filename: string, chunk_index: int, chunk_id: long, similarity: double>>, chunk_ids array<long>, files array<string>, confidence double").alias("p"))
    return parsed.select("query_id", F.array_sort(F.transform("p.sources", lambda x: F.concat_ws("#", x["filename"], x["chunk_index"]))).alias("sources"), F.size("p.files").cast("long").alias("files"), "p.confidence")


@query(f"""WITH asked AS (SELECT item_id AS query_id, list_distinct({LEX}[1:2]) AS terms FROM benchmark WHERE len({LEX}) > 0),
words AS (SELECT doc_id, unnest({LEX}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
found AS (SELECT query_id, doc_id, round(sum(0.1::DOUBLE * tf / (1 + 0.1::DOUBLE * tf)), 6) AS score FROM (SELECT query_id, terms, unnest(terms) AS term FROM asked) JOIN tf USING (term) GROUP BY query_id, doc_id, terms HAVING count(*) = len(terms)),
docs AS (SELECT query_id, 'documents' AS tool, doc_id AS id FROM found QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 3),
pages_of AS (SELECT query_id, 'pages' AS tool, page_id AS id FROM asked JOIN pages ON page_id % 40 = query_id % 40),
rows_of AS (SELECT * FROM docs UNION ALL SELECT * FROM pages_of)
SELECT query_id, tool, id, 'ok' AS status FROM rows_of
UNION ALL SELECT query_id, tool, NULL, 'empty' FROM asked, (VALUES ('documents'), ('pages')) v(tool) WHERE (query_id, tool) NOT IN (SELECT query_id, tool FROM rows_of)
UNION ALL SELECT query_id, 'mail', NULL, 'unknown' FROM asked""")
def tool_jobs(t):
    """Three tools for every benchmark item: a search by table function, pages by key, and one that isn't there."""
    from lakequill.operators import orchestrate
    from lakequill.plans.learned import tooled

    lex = T.lexemes(F.col("text"))
    asked = t.benchmark.where(F.size(lex) > 0).select(F.col("item_id").alias("query_id"), F.array_join(F.slice(lex, 1, 2), " ").alias("query"), F.array(F.lit("documents"), F.lit("pages"), F.lit("mail")).alias("tools"))
    registry, pages = tooled(t), t.pages.select("page_id", (F.col("page_id") % 40).alias("k"))
    tools = {
        "documents": lambda q: registry.lateral(q, "search_documents", q="r.query", k="3").select("query_id", F.col("doc_id").alias("id")),
        "pages": lambda q: q.withColumn("k", F.col("query_id") % 40).join(pages, "k").select("query_id", F.col("page_id").alias("id")),
    }
    return orchestrate.job_matrix(asked, tools).select("query_id", "tool", F.get_json_object("result", "$.id").cast("long").alias("id"), "status")


@query()
def answer_payload(t):
    from lakequill.operators import orchestrate

    return orchestrate.payload(search.hybrid_search(chunked(t), stated_queries(t)))


@query(f"""WITH q AS (SELECT query_id, query FROM (VALUES (1::BIGINT, 'the of'), (2, 'inin'), (3, 'nowhere to be found')) v(query_id, query) JOIN embeddings ON vec_id = query_id),
hits AS (SELECT doc_id, round(0.1 * n / (1 + 0.1 * n), 6) AS lexical_score FROM (SELECT doc_id, len(list_filter({LEX}, lambda x: x = 'inin')) AS n FROM documents) WHERE n > 0 ORDER BY 2 DESC, 1 LIMIT 3),
rows_of AS (SELECT query_id, 'documents' AS tool, doc_id AS id FROM q, hits WHERE query LIKE '%inin%' UNION ALL SELECT query_id, 'pages', page_id FROM q, (SELECT page_id FROM pages ORDER BY 1 LIMIT 2))
SELECT query_id, tool, id, 'ok' AS status FROM rows_of
UNION ALL SELECT query_id, tool, NULL, 'empty' FROM q, (VALUES ('documents'), ('pages')) v(tool) WHERE (query_id, tool) NOT IN (SELECT query_id, tool FROM rows_of)
UNION ALL SELECT query_id, 'mail', NULL, 'unknown' FROM q""")
def job_matrix(t):
    """Three tools for the stated queries; each gives a few rows, which meet the queries by a key."""
    from lakequill.operators import orchestrate

    asked = stated_queries(t).select("query_id", "query", F.array(F.lit("documents"), F.lit("pages"), F.lit("mail")).alias("tools"))
    hits = search.lexical_search(t.documents, "inin", k=3, id_col="doc_id", text="text").select(F.lit("inin").alias("word"), F.col("doc_id").alias("id"))
    first = t.pages.orderBy("page_id").limit(2).select(F.lit(1).alias("one"), F.col("page_id").alias("id"))
    tools = {
        "documents": lambda q: q.where(F.col("query").contains("inin")).withColumn("word", F.lit("inin")).join(hits, "word").select("query_id", "id"),
        "pages": lambda q: q.withColumn("one", F.lit(1)).join(first, "one").select("query_id", "id"),
    }
    return orchestrate.job_matrix(asked, tools).select("query_id", "tool", F.get_json_object("result", "$.id").cast("long").alias("id"), "status")


@query("SELECT doc_id, sha256('default:' || text) AS cache_key FROM documents WHERE text IS NOT NULL")
def embedding_cache_keys(t):
    return t.documents.where("text IS NOT NULL").select("doc_id", F.sha2(F.concat(F.lit("default:"), "text").cast("binary"), 256).alias("cache_key"))


@query(f"""WITH pieces AS ({CHARS}), words AS (SELECT doc_id, chunk_index, unnest(CASE WHEN len(regexp_extract_all(lower(chunk_text), '[a-z0-9]+')) = 0 THEN [''] ELSE regexp_extract_all(lower(chunk_text), '[a-z0-9]+') END) AS w FROM pieces),
codes AS (SELECT w, CASE WHEN w = '' THEN 0 ELSE {crc_sql("w")} % {DIM} END AS place FROM (SELECT DISTINCT w FROM words)),
counts AS (SELECT doc_id, chunk_index, place, count(*) AS c FROM words JOIN codes USING (w) GROUP BY ALL)
SELECT doc_id, chunk_index, place::INT AS place, round(c / sqrt(sum(c * c) OVER (PARTITION BY doc_id, chunk_index)), 6) AS value FROM counts""")
def chunk_embeddings(t):
    """The embedding of every chunk, where it isn't 0; each distinct text goes to the model once."""
    from lakequill.operators import orchestrate

    made = orchestrate.embedded(chunking.char_chunks(t.documents), lambda c: V.hashed(c, DIM), text="chunk_text")
    return made.select("doc_id", "chunk_index", F.posexplode("embedding").alias("place", "value")).where("value <> 0").withColumn("value", F.round("value", 6))


@query()
def embedded_chunks(t):
    """Every distinct chunk embedded once, by the deterministic stand-in for a model."""
    from lakequill.operators import orchestrate

    return orchestrate.embedded(chunking.char_chunks(t.documents), lambda c: V.embed(c, 32), text="chunk_text").select("doc_id", "chunk_index", F.array_join("embedding", ",").alias("embedding"))


@query(r"""SELECT doc_id, name, 'ORG' AS type FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+'))) AS name FROM documents) WHERE length(name) BETWEEN 2 AND 200""")
def entity_mentions(t):
    from lakequill.operators import graph

    return graph.extract(t.documents, id_col="doc_id", text="text")


assert DEFAULT.top_k == 30  # the SQL above has the defaults
