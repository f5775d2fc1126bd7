"""Queries that load files of many kinds, cut code, mail and markdown, read logs, and build prompts. Files are made from the tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from lakequill.functions import text as T
from lakequill.operators import chunking, feedback, memory, orchestrate, rerank, tables
from lakequill.plans.registry import query
from lakequill.plans.retrieval import alternatives
from lakequill.session import new_path
from lakequill.sources import files

SUFFIXES = (".docx", ".xlsx", ".eml", ".txt", ".md", ".pdf", ".png")


def packed(names: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in names.items():
            z.writestr(name, text)
    return out.getvalue()


def made_file(suffix: str, key: int, name: str, segment: str) -> bytes:
    """A small file of a kind about a customer; the PDF is none."""
    p = lambda t: f"<p><r><t>{t}</t></r></p>"
    if suffix == ".docx":
        head = f'<p><pPr><pStyle val="Heading1"/></pPr><r><t>{name}</t></r></p>'
        return packed({"word/document.xml": f"<d>{head}{p(f'{segment} customer')}<tbl><tr><tc>{p(f'key {key}')}</tc></tr></tbl></d>"})
    if suffix == ".xlsx":
        cell = lambda t: f'<c t="inlineStr"><is><t>{t}</t></is></c>'
        return packed({"xl/workbook.xml": '<w><sheets><sheet name="Customers"/></sheets></w>', "xl/worksheets/sheet1.xml": f"<w><row>{cell(name)}<c><v>{key}</v></c></row><row><c/></row></w>"})
    if suffix == ".eml":
        return f"Subject: {name}\r\nFrom: desk@example.org\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nSegment {segment}.".encode()
    return {".txt": f"Plain text of {name}", ".md": f"# {name}\n\n{segment}", ".pdf": "no signature", ".png": "no image"}[suffix].encode()


@query("""WITH c AS (SELECT c_custkey AS k, c_name AS n, coalesce(c_mktsegment, '') AS s, c_custkey % 7 AS kind FROM customer)
SELECT k, ['DOCX', 'EXCEL', 'EMAIL', 'TXT', 'MD', 'PDF', 'IMAGE'][kind + 1] AS doc_type,
  CASE kind WHEN 0 THEN '# ' || n || chr(10) || chr(10) || s || ' customer' || chr(10) || chr(10) || 'key ' || k
    WHEN 1 THEN '[Sheet: Customers]' || chr(10) || n || ' | ' || k
    WHEN 2 THEN 'Subject: ' || n || chr(10) || chr(10) || 'From: desk@example.org' || chr(10) || chr(10) || 'Segment ' || s || '.'
    WHEN 3 THEN 'Plain text of ' || n WHEN 4 THEN '# ' || n || chr(10) || chr(10) || s END AS text,
  CASE kind WHEN 5 THEN 'wrong signature' WHEN 6 THEN 'no loader for .png' END AS error FROM c""")
def loaded_files(t):
    """Files of seven kinds to text, or to an error row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kinds = [SUFFIXES[k % len(SUFFIXES)] for k in b["c_custkey"]]
            content = [made_file(x, k, n, s) for x, k, n, s in zip(kinds, b["c_custkey"], b["c_name"], b["s"], strict=True)]
            yield pd.DataFrame({"k": b["c_custkey"], "path": [f"in/{k}{x}" for k, x in zip(b["c_custkey"], kinds, strict=True)], "content": content})

    made = t.customer.select("c_custkey", "c_name", F.coalesce("c_mktsegment", F.lit("")).alias("s")).mapInPandas(run, "k long, path string, content binary")
    typed = made.select("k", files.extension(F.col("path")).alias("ext"), files.doc_type(F.col("path")).alias("doc_type"), "content")
    return files.load_documents(typed).select("k", "doc_type", "text", "error")


@query("""WITH c AS (SELECT c_custkey AS k, c_name AS n, chr(10) AS nl FROM customer),
p AS (SELECT k, CASE k % 3
  WHEN 0 THEN ['import os, sys', 'def f_' || k || '():' || nl || '    return "' || n || '"', '@cached' || nl || 'class C' || k || ':' || nl || '    x = ' || k]
  WHEN 1 THEN ['import x from "y";', 'export async function f' || k || '() { return 1 }', 'const g' || k || ' = (a) => a;']
  ELSE ['Dear ' || n || ',' || nl || nl || 'your number is ' || k || '.'] END AS parts FROM c)
SELECT k, (i - 1)::INT AS chunk_index, parts[i] AS chunk_text FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM p)""")
def typed_chunks(t):
    """Python, JavaScript and mail, each by the chunker of its type."""
    k, n = F.col("c_custkey").cast("string"), F.col("c_name")
    python = F.concat(F.lit("import os, sys\n\n\ndef f_"), k, F.lit('():\n    return "'), n, F.lit('"\n\n\n@cached\nclass C'), k, F.lit(":\n    x = "), k, F.lit("\n"))
    js = F.concat(F.lit('import x from "y";\nexport async function f'), k, F.lit("() { return 1 }\n\nconst g"), k, F.lit(" = (a) => a;\n"))
    mail = F.concat(F.lit("Dear "), n, F.lit(",\n\nyour number is "), k, F.lit(".\n"))
    kind = F.col("c_custkey") % 3
    made = t.customer.select(
        F.col("c_custkey").alias("k"), F.when(kind == 0, python).when(kind == 1, js).otherwise(mail).alias("text"),
        F.when(kind == 0, "CODE_PYTHON").when(kind == 1, "CODE_JS").otherwise("EMAIL").alias("doc_type"))
    return chunking.chunks(made, id_col="k", doc_type="doc_type")


@query(r"""WITH c AS (SELECT c_custkey AS k, c_name AS n, chr(10) AS nl FROM customer), f AS (
SELECT k, regexp_replace(lower(n), '[^\w\s-]', '', 'g') AS anchor, n AS title, 1 AS level, '# ' || n || nl || 'intro' || nl || '## Part' || nl || 'one' || nl || '### Deep Dive' || nl || '## Part' || nl || 'two' AS fragment FROM c
UNION ALL SELECT k, 'part', 'Part', 2, '## Part' || nl || 'one' || nl || '### Deep Dive' FROM c UNION ALL SELECT k, 'deep-dive', 'Deep Dive', 3, '### Deep Dive' FROM c
UNION ALL SELECT k, 'part-1', 'Part', 2, '## Part' || nl || 'two' FROM c)
SELECT k, anchor, title, level::INT AS level, fragment FROM f""")
def markdown_fragments(t):
    text = F.concat(F.lit("# "), "c_name", F.lit("\nintro\n## Part\none\n### Deep Dive\n## Part\ntwo\n"))
    return chunking.markdown_fragments(t.customer.select(F.col("c_custkey").alias("k"), text.alias("text")), id_col="k", text="text").select("k", "anchor", "title", "level", "fragment")


@query("""WITH l AS (SELECT event_id, event_type = 'error' AS bad, row_number() OVER (ORDER BY event_id DESC) AS back FROM events),
s AS (SELECT event_id, bad, row_number() OVER (ORDER BY event_id)::INT AS no FROM l WHERE back <= 500)
SELECT no, 'event ' || event_id AS message FROM (SELECT * FROM s WHERE bad ORDER BY no DESC LIMIT 50)""")
def log_errors(t):
    """The last errors of a log that is written from the events."""
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" - app - "), level, F.lit(" - run:1 - event "), F.col("event_id").cast("string"))
    path = new_path(t.spark, "log")
    t.events.select("event_id", line.alias("value")).coalesce(1).sortWithinPartitions("event_id").select("value").write.text(path)
    return files.log_tail(t.spark, path, limit=50, level="error").select("no", "message")


def synonym_sql() -> str:
    words = ", ".join(f"'{w}'" for w in T.SYNONYMS)
    swapped = "CASE w " + " ".join(f"WHEN '{a}' THEN replace(q, '{a}', '{b}')" for a, b in T.SYNONYMS.items()) + " END"
    return f"""WITH s AS (SELECT item_id, 'the total price of each product in ' || item_id || ' and its cost' AS q FROM benchmark),
v AS (SELECT item_id, q, list_distinct(list_filter(string_split_regex(lower(q), '\\s+'), lambda x: x IN ({words}))) AS ws FROM s),
o AS (SELECT item_id, q, unnest(ws) AS w, list_position(string_split_regex(lower(q), '\\s+'), unnest(ws)) AS p FROM v)
SELECT item_id, q AS variant FROM s UNION ALL SELECT item_id, {swapped} FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY p) <= 2)"""


@query(synonym_sql())
def query_variants(t):
    """Queries with up to two synonyms, one replaced in each variant."""
    asked = F.concat(F.lit("the total price of each product in "), F.col("item_id").cast("string"), F.lit(" and its cost"))
    return t.benchmark.select("item_id", F.explode(T.expand_query(asked)).alias("variant"))


@query("""SELECT conv_id, 'Relevant memories:' || chr(10) || string_agg('[' || upper(role) || '] ' || text, chr(10) ORDER BY turn) AS prompt FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL GROUP BY conv_id""")
def memory_prompts(t):
    return memory.prompt(t.conversations.where("role IS NOT NULL AND text IS NOT NULL"), kind="role", content="text", order="turn", by=["conv_id"])


@query("""WITH p AS (SELECT conv_id, turn, text AS question, CASE WHEN turn % 3 > 0 THEN role || ' said' END AS context, CASE WHEN turn % 2 = 0 THEN '' WHEN turn = 1 THEN 'Relevant memories: one' END AS memories FROM conversations)
SELECT conv_id, turn, concat_ws(chr(10) || chr(10), nullif(memories, ''), CASE WHEN context <> '' THEN 'Context:' || chr(10) || context END, CASE WHEN context <> '' THEN 'Question: ' || question ELSE question END) AS prompt FROM p""")
def question_prompts(t):
    """Prompts with and without context and memories."""
    context = F.when(F.col("turn") % 3 > 0, F.concat("role", F.lit(" said")))
    memories = F.when(F.col("turn") % 2 == 0, "").when(F.col("turn") == 1, "Relevant memories: one")
    return t.conversations.select("conv_id", "turn", orchestrate.prompt(F.col("text"), context, memories).alias("prompt"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN '' ELSE 'i' || conv_id END AS intent, CASE WHEN turn % 4 = 3 THEN 0 WHEN turn % 4 = 2 THEN 3 ELSE turn % 4 + 1 END::INT AS questions,
  turn % 4 = 2 AS synthesis, CASE turn % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END::INT AS hops FROM conversations""")
def query_plans(t):
    """Plans from the JSON in a model's answer: bounded hops, at most three sub-questions, defaults where there is none."""
    kind = F.col("turn") % 4
    subs = F.when(kind == 0, '["a"]').when(kind == 1, '["a","b"]').otherwise('["a","b","c","d"]')
    hops = F.when(kind == 0, "-2").when(kind == 1, "2").otherwise("9")
    answer = F.concat(F.lit('Sure: {"intent": "i'), F.col("conv_id").cast("string"), F.lit('", "sub_questions": '), subs, F.lit(', "estimated_hops": '), hops, F.when(kind == 2, ', "synthesis_required": true').otherwise(""), F.lit("} done"))
    plan = T.query_plan(F.when(kind == 3, F.lit("no plan")).otherwise(answer))
    return t.conversations.select("conv_id", "turn", plan.alias("p")).select("conv_id", "turn", "p.intent", F.size("p.sub_questions").alias("questions"), F.col("p.synthesis_required").alias("synthesis"), F.col("p.estimated_hops").alias("hops"))


@query(f"""SELECT conv_id, turn, length(answer) < {T.REFUSAL_LENGTH} AND regexp_matches(answer, '(?i){alternatives(T.REFUSALS)}') AND conv_id % 3 = 0 AS remote
FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN 'I cannot say. ' || substr(text, 1, 300 * (turn::INT % 4)) ELSE text END AS answer FROM conversations)""")
def remote_fallback(t):
    """Whether a refused answer may go to a remote model: only if its sources say that they needn't stay local."""
    answer = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("I cannot say. "), F.substring(F.col("text"), F.lit(1), (300 * (F.col("turn") % 4)).cast("int")))).otherwise(F.col("text"))
    local = F.when(F.col("conv_id") % 3 == 0, False).when(F.col("conv_id") % 3 == 1, True)
    return t.conversations.select("conv_id", "turn", orchestrate.cloud_fallback(answer, local).alias("remote"))


@query("""SELECT conv_id, turn, round(CASE WHEN turn % 3 = 0 THEN c ELSE 0.7::DOUBLE * c + 0.3::DOUBLE * (length(text) % 13 - 6) END, 6) AS combined_score FROM (SELECT *, (length(text) % 100)::DOUBLE / 100 AS c FROM conversations)""")
def cross_encoded(t):
    """A cross-encoder's score mixed in, where there is one."""
    rows = t.conversations.select("conv_id", "turn", ((F.length("text") % 100).cast("double") / 100).alias("combined_score"), F.when(F.col("turn") % 3 != 0, (F.length("text") % 13 - 6).cast("double")).alias("rerank_score"))
    return rerank.cross_encoded(rows).select("conv_id", "turn", F.round("combined_score", 6).alias("combined_score"))


@query("""SELECT user_id, min(event_id) AS event_id FROM events WHERE event_id % 2 = 0 GROUP BY 1
UNION ALL SELECT user_id, -1 FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 2 = 0) GROUP BY 1""")
def insert_missing(t):
    """Rows whose key is there already do nothing; of new ones that repeat a key one comes in."""
    there = t.events.where("event_id % 2 = 0").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return feedback.insert_new(there, t.events.select("user_id", F.lit(-1).cast("long").alias("event_id")), ["user_id"])


@query("SELECT event_id FROM events WHERE event_id % 5 = 0 OR ts + INTERVAL 10 DAY >= TIMESTAMP '2024-01-20 00:00:00'")
def tokens_not_expired(t):
    """Tokens that last ten days, every fifth for ever."""
    rows = t.events.select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("ts") + F.expr("INTERVAL 10 DAYS")).alias("expires_at"))
    return tables.not_expired(rows, F.lit("2024-01-20 00:00:00").cast(rows.schema["expires_at"].dataType)).select("event_id")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'VISION' WHEN l_linenumber IN (2, 3) THEN 'CODE' WHEN l_linenumber >= 5 THEN 'LARGE' WHEN l_linenumber = 4 THEN 'FAST' END AS model_class FROM lineitem""")
def model_class_by_documents(t):
    """The class of model by types of documents, hops and synthesis."""
    n = F.col("l_linenumber")
    kinds = F.when(n == 1, F.array(F.lit("image"), F.lit("txt"))).when(n == 2, F.array(F.lit("code_js"))).when(n == 3, F.array(F.lit("CODE_PYTHON"))).otherwise(F.array(F.lit("txt")))
    hops = F.when(n >= 5, 2).otherwise(1)
    return t.lineitem.select("l_orderkey", "l_linenumber", T.model_class(F.lit("short one"), hops, n >= 5, kinds).alias("model_class"))
