"""Operators of retrieval and of the relational layer on small inputs and at their boundary values."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lakequill.functions import text as T
from lakequill.functions import vectors as V
from lakequill.operators import chunking, feedback, graph, memory, rerank, search, tables
from lakequill.params import Params
from lakequill.sources import files, sinks
from lakequill.streaming import streams


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)


def one(spark, expr, **cols):
    row = spark.createDataFrame([tuple(cols.values())], list(cols))
    return row.select(expr.alias("x")).first()["x"]


def test_params():
    with pytest.raises(ValueError):
        Params(chunk_overlap=1200)
    with pytest.raises(ValueError):
        Params(rerank_top_k=31)


# text functions
@pytest.mark.parametrize(("given", "want"), [("  What's   the Größe? (now) ", "what is the größe? now"), ("can't", "cannot"), ("a_b-c, d! e#", "a_b-c, d! e"), ("", "")])
def test_preprocess(spark, given, want):
    assert one(spark, T.preprocess_query(F.col("q")), q=given) == want


def test_text_functions(spark):
    assert one(spark, T.expand_query(F.col("q")), q="total cost of price") == ["total cost of price", "sum cost of price", "total expense of price"]
    assert one(spark, T.sanitize_text(F.col("q")), q="<b>a</b>  b\x00\n\n\n\n c\t") == "a b\n\nc"
    assert one(spark, T.sanitize_filename(F.col("q")), q="../../etc/pa sswd?.txt") == "pa sswd.txt"
    assert one(spark, T.sanitize_filename(F.col("q")), q="...") == "unnamed_file"
    assert len(one(spark, T.sanitize_filename(F.col("q")), q="a" * 300 + ".txt")) == 255
    assert one(spark, T.escape_like(F.col("q")), q="5%_[x]\\") == "5\\%\\_\\[x\\]\\\\"
    assert one(spark, T.html_to_text(F.col("q")), q="<style>x</style><p>a &amp; b</p><script>1</script>c") == "a & b c"
    assert one(spark, T.terms(F.col("q")), q="What is the AI budget of ab") == ["budget"]
    assert one(spark, T.slug(F.col("q")), q="Hello, World - again!") == "hello-world-again"
    assert [one(spark, T.preview(F.col("q")), q="x" * n).endswith("...") for n in (200, 201)] == [False, True]
    assert [one(spark, T.is_refusal(F.col("q")), q=("I cannot" + "x" * 500)[:n]) for n in (499, 500)] == [True, False]
    assert one(spark, T.wants_web(F.col("q")), q="Please GOOGLE IT")
    assert one(spark, T.cjk_ratio(F.col("q")), q="漢字ab") == 0.5


@pytest.mark.parametrize(("query", "want"), [("describe this diagram", "VISION"), ("def foo(): pass", "CODE"), ("x" * 80, "FAST"), ("x" * 81, "BASE"), ("please refactor it", "CODE")])
def test_model_class(spark, query, want):
    assert one(spark, T.model_class(F.col("q")), q=query) == want


def test_model_class_signals(spark):
    assert one(spark, T.model_class(F.col("q"), F.lit(2), F.lit(True)), q="x") == "LARGE"
    assert one(spark, T.model_class(F.col("q"), doc_types=F.array(F.lit("code_js"))), q="x") == "CODE"


def test_query_plan(spark):
    plan = one(spark, T.query_plan(F.col("q")), q='Sure: {"intent": "compare", "sub_questions": ["a","b","c","d"], "estimated_hops": 9} ok')
    assert (plan["intent"], plan["sub_questions"], plan["estimated_hops"], plan["synthesis_required"]) == ("compare", ["a", "b", "c"], 3, False)
    assert one(spark, T.query_plan(F.col("q")), q="no json")["estimated_hops"] == 1


def test_vectors(spark):
    assert one(spark, V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))), q=1) == pytest.approx(0.707107)
    assert one(spark, V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), q=1) == 0.0
    e = one(spark, V.embed(F.col("q"), 16), q="a b a")
    assert sum(x * x for x in e) == pytest.approx(1.0, abs=1e-6) and one(spark, V.embed(F.col("q"), 4), q="!")[0] == 1.0


# chunking
def test_character_windows():
    text = "abcdefghijklmnopqrstuvwxyz" * 4
    parts = chunking.by_characters(text, 30, 10)
    assert all(b[:10] == a[-10:] for a, b in zip(parts, parts[1:], strict=False) if len(b) >= 10)
    assert parts[-1] == text[100:]


def test_recursive_split_keeps_all_words():
    rng = random.Random(1)
    text = "".join(rng.choice(["alpha ", "beta. ", "gamma\n", "delta\n\n", "eps, "]) for _ in range(800))
    parts = chunking.chunk_text(text, 200, 20)
    assert all(len(p) <= 220 for p in parts) and parts[0].split()[0] == text.split()[0] and parts[-1].split()[-1] == text.split()[-1]
    assert set(text.split()) <= {w for p in parts for w in p.split()}


def test_chunk_boundaries():
    assert chunking.chunk_text("ab") == ["ab"] and chunking.chunk_text(" ") == [] and chunking.chunk_text(None) == []
    assert len(chunking.chunk_text("x" * 1200)) == 1 and len(chunking.chunk_text("x" * 1201)) == 2
    assert all(len(c) >= 10 for c in chunking.chunk_text("word. " * 400))


def test_tables_repeat_their_header():
    rows = "\n".join(f"| val{i:02} | dat{i:02} |" for i in range(400))
    text = f"[Table 1 on page 1]\n| Col1 | Col2 |\n{rows}"
    parts = chunking.chunk_text(text)
    assert len(parts) > 1 and all(p.startswith("[Table 1 on page 1]\n| Col1 | Col2 |") and len(p) <= 3000 for p in parts)
    assert sum(p.count("| val") for p in parts) == 400


def test_code_chunks():
    parts = chunking.chunk_python("import os\nimport sys\n\n@dec\ndef f():\n    return 1\n\nclass A:\n    x = 1\n")
    assert parts == ["import os\nimport sys", "@dec\ndef f():\n    return 1", "class A:\n    x = 1"]
    assert chunking.chunk_python("def broken(:") == ["def broken(:"]
    assert len(chunking.chunk_js("const a = 1;\nfunction foo() { return 1 }\nclass Bar { x() {} }\n")) == 3


def test_chunk_frames(spark):
    docs = spark.createDataFrame([(1, "word " * 600, "TXT"), (2, None, "TXT"), (3, "def f():\n    return 12345\n", "CODE_PYTHON")], "doc_id long, text string, kind string")
    got = values(chunking.chunks(docs, doc_type="kind"), "doc_id", "chunk_index")
    assert got == [(1, 0), (1, 1), (1, 2), (3, 0)]
    pages = spark.createDataFrame([(1, 1, "first page text", "Intro"), (1, 2, "second page text", None), (1, 3, "ok", None), (2, 1, "other document", None)], "d long, p int, t string, s string")
    got = values(chunking.page_chunks(pages, doc="d", page="p", text="t", title="s"), "d", "page_number", "section_title", "chunk_index")
    assert got == [(1, 1, "Intro", 0), (1, 2, "Intro", 1), (2, 1, None, 0)]
    md = spark.createDataFrame([(1, "# A\nx\n## B\ny\n# A\nz")], "d long, t string")
    assert values(chunking.markdown_fragments(md, id_col="d", text="t"), "anchor", "fragment") == [("a", "# A\nx\n## B\ny"), ("a-1", "# A\nz"), ("b", "## B\ny")]
    wanted = spark.createDataFrame([(1, 1)], "doc_id long, chunk_index int")
    assert values(chunking.adjacent(chunking.chunks(docs, doc_type="kind"), wanted, doc="doc_id", window=9), "chunk_index") == [(0,), (1,), (2,)]


# search
def test_blend_and_membership(spark):
    sem = spark.createDataFrame([("a", 0.8), ("b", 0.6), ("c", 0.1)], "k string, semantic_score double")
    lex = spark.createDataFrame([("a", 0.5), ("b", 1.0), ("d", 0.9)], "k string, lexical_score double")
    got = {r["k"]: r["combined_score"] for r in search.blend(sem, lex, ["k"]).collect()}
    assert got == pytest.approx({"a": 0.71, "b": 0.72, "c": 0.07, "d": 0.27})
    assert values(search.members(search.blend(sem, lex, ["k"])), "k") == [("a",), ("b",), ("d",)]
    assert {r["k"]: r["combined_score"] for r in search.blend(sem, lex.limit(0), ["k"]).collect()}["a"] == 0.8


def cover_ranks(tokens, wanted):
    hits = [i + 1 for i, t in enumerate(tokens) if t in wanted]
    spans = [(p, q) for p in hits for q in hits if p <= q and set(wanted) <= {t for t in tokens[p - 1 : q]}]
    least = {(p, q) for p, q in spans if not any((a, b) != (p, q) and p <= a and b <= q for a, b in spans)}
    r = sum(0.1 / (1 + (q - p) - (len(wanted) - 1)) for p, q in least)
    return r / (r + 1)


def test_cover_density(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdex") for _ in range(rng.randint(2, 25)))) for i in range(60)]
    df = spark.createDataFrame(rows, "i long, t string")
    for wanted in (["a"], ["a", "b"], ["a", "b", "c"]):
        got = {r["i"]: r["s"] for r in df.select("i", search.cover_density(T.lexemes(F.col("t")), F.array(*[F.lit(w) for w in wanted])).alias("s")).collect()}
        for i, t in rows:
            if set(wanted) <= set(t.split()):
                assert got[i] == pytest.approx(cover_ranks(t.split(), wanted)), (t, wanted)


def test_lexical_guards(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "beta"), (3, None)], "chunk_id long, chunk_text string")
    assert search.lexical_search(df, "").count() == 0
    assert values(search.lexical_search(df, "Beta, ALPHA!"), "chunk_id") == [(1,)]


def test_vector_floor_is_inclusive(spark):
    df = spark.createDataFrame([(1, [0.3, 0.9539392]), (2, [0.29, 0.957]), (3, None)], "chunk_id long, embedding array<double>")
    assert values(search.vector_search(df, V.literal([1.0, 0.0])), "chunk_id") == [(1,)]
    batch = search.vector_search_batch(df, spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, qv array<double>"), k=1, floor=0.0)
    assert values(batch, "query_id", "chunk_id") == [(7, 1)]


@pytest.mark.parametrize(("size", "index", "want"), [(99, 20, -0.02), (100, 20, 0.0), (199, 20, 0.0), (200, 20, 0.02), (800, 20, 0.02), (801, 20, 0.0), (150, 14, 0.002), (150, 15, 0.0), (150, 16, 0.0)])
def test_signals(spark, size, index, want):
    assert one(spark, search.signals(F.lit("zzz"), F.col("t"), F.lit(index)), t="x" * size) == pytest.approx(want)


def test_sequential_stages():
    assert rerank.not_adjacent([("a", 0), ("b", 0), ("a", 1), ("b", 5)]) == [0, 1, 3]
    assert rerank.not_adjacent([("d", 0), ("d", 2)]) == [0] and rerank.not_adjacent([("d", 0), ("d", 3)]) == [0, 1]
    seven, ten = "a b c d e f g", "a b c d e f g h i j"
    assert rerank.diverse([seven, ten], 0.7, 9) == [0, 1] and rerank.diverse([seven, ten], 0.69, 9) == [0]
    assert rerank.diverse(["x", "y", "z"], 0.7, 2) == [0, 1]


def test_relevance_floor(spark):
    rows = [("q", 1, -11.4), ("q", 2, 0.81), ("q", 3, -5.0), ("q", 4, None), ("r", 1, -9.0), ("r", 2, -8.0), ("r", 3, -7.0), ("r", 4, -6.0), ("s", 1, None)]
    df = spark.createDataFrame(rows, "q string, i int, rerank_score double")
    got = values(rerank.relevance_floor(df, by="q", tie="i"), "q", "i", "low_relevance")
    assert got == [("q", 2, False), ("q", 3, False), ("r", 2, True), ("r", 3, True), ("r", 4, True), ("s", 1, False)]
    assert rerank.relevance_floor(df.where("q = 'r'"), by="q", tie="i", limit=0).count() == 1


def test_cross_encoder(spark):
    df = spark.createDataFrame([("b", 0.9, 0.1), ("a", 0.3, 0.9), ("n", 0.4, None)], "k string, combined_score double, rerank_score double")
    assert values(rerank.cross_encoded(df, weight=0.5), "k", "combined_score") == [("a", 0.6), ("b", 0.5), ("n", 0.4)]


def test_packing():
    rows = [("a", "one " * 10, None, None), ("b", "two", 3, "S" * 60), ("a", "three", None, None)]
    text = rerank.pack(rows)
    assert text.index("one") < text.index("three") < text.index("two") and f"[Passage (p. 3, {'S' * 47}...)]" in text
    assert rerank.pack(rows, 10) == "" and "three" not in rerank.pack(rows, 80)
    assert "two" in rerank.pack([("a", "x" * 500, None, None), ("b", "two", None, None)], 120)
    assert rerank.rich_text("- item\nHead:\nplain  text") == "  - item\n\n**Head:**\nplain text"
    assert rerank.rich_text(" a | b \n c | d \n\n e | f ") == "a | b\nc | d\ne | f"


def test_best_per_key(spark):
    df = spark.createDataFrame([(1, 0.7, 1), (1, 0.9, 2), (1, 0.9, 3), (None, 0.1, 4), (None, 0.2, 5)], "chunk_id long, similarity double, seq int")
    assert values(rerank.best_per_key(df, "chunk_id", "similarity", "seq"), "seq") == [(2,), (4,), (5,)]


# graph, memory, feedback
def test_graph(spark):
    m = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y"), (1, "z"), (2, "y"), (2, "x")], "chunk long, name string")
    e = graph.edges(m, "chunk", "name")
    assert values(e) == [("x", "y", 2), ("x", "z", 1), ("y", "z", 1)]
    seeds = spark.createDataFrame([("x",)], "seed string")
    assert values(graph.neighbours(e, seeds)) == [("x", "y"), ("x", "z")] and graph.neighbours(e, seeds.limit(0)).count() == 0
    found = graph.extract(spark.createDataFrame([(1, "met Acme Corp and Acme Corp"), (2, " ")], "c long, t string"), id_col="c", text="t")
    assert values(found) == [(1, "Acme Corp", "ORG")]


def test_memory(spark):
    known = spark.createDataFrame([(1, "w", [1.0, 0.0])], "id long, workspace_id string, embedding array<double>")
    new = spark.createDataFrame([(2, "w", [0.92, 0.3919184]), (3, "w", [0.9, 0.4358899]), (4, "v", [1.0, 0.0])], known.schema)
    assert values(memory.new_only(new, known), "id") == [(3,), (4,)]
    assert values(memory.recall(known.union(new), V.literal([1.0, 0.0]), scopes=["v"]), "id") == [(4,)]
    assert values(memory.recall(known.union(new), V.literal([1.0, 0.0]), scopes=[]), "id") == [(1,), (2,), (4,)]


def test_feedback(spark):
    df = spark.createDataFrame([(1, 1), (2, -1), (3, 1)], "i int, rating int")
    assert values(feedback.stats(df)) == [(3, 2, 1, 0.667)] and feedback.stats(df.limit(0)).first()["positive_rate"] is None
    counts = spark.createDataFrame([(1, 9, 0), (2, 10, 1), (3, 10, 2), (4, 50, 0)], "k int, retrieved long, positive long")
    assert [r["k"] for r in feedback.stale(counts, key="k").collect()] == [4, 2]
    new = spark.createDataFrame([(1, 5), (9, 9)], "k int, v int")
    assert values(feedback.insert_new(spark.createDataFrame([(1, 1)], new.schema), new, ["k"])) == [(1, 1), (9, 9)]
    v = spark.createDataFrame([(1, "old", 1), (1, "new", 2)], "k int, x string, at int")
    assert values(feedback.upsert_latest(v.limit(0), v, ["k"], "at"), "x") == [("new",)]


@pytest.mark.parametrize("n", [1, 20, 100])
def test_percentiles(spark, n):
    df = spark.createDataFrame([("m", float(i), i) for i in range(n)], "name string, v double, i int")
    r = feedback.histogram(df, by="name", value="v", order=[F.col("i").desc()]).first()
    assert [r["p50"], r["p95"], r["p99"]] == [float(min(int(n * p / 100), n - 1)) for p in (50, 95, 99)]


# tables
def test_ingest_decision(spark):
    there = spark.createDataFrame([("a", None, "h1", 5), ("b", "w", "h1", 5), ("c", "w", "h1", 0)], "f string, w string, content_hash string, chunk_count int")
    new = spark.createDataFrame([("a", None, "h1"), ("a", "w", "h1"), ("b", "w", "h2"), ("c", "w", "h1")], "f string, w string, content_hash string")
    assert values(tables.ingest_decision(new, there, ["f", "w"]), "f", "w", "decision") == [("a", "w", "insert"), ("a", None, "skip"), ("b", "w", "replace"), ("c", "w", "replace")]


def test_rules(spark):
    now, was = (spark.createDataFrame(r, "k string, v int") for r in ([("a", 1), ("b", 2), ("c", None)], [("b", 1), ("c", None), ("d", 1)]))
    assert values(tables.snapshot_diff(now, was, "k", "v")) == [("a", "added"), ("b", "modified"), ("d", "deleted")]
    m = spark.createDataFrame([("w", "u1", "owner"), ("w", "u2", "member"), ("x", "u1", "owner"), ("x", "u2", "owner")], "w string, u string, r string")
    assert values(tables.sole_owners(m, group="w", user="u", role="r", owner="owner")) == [("w", "u1")]
    assert [tables.page(spark.range(300), [F.col("id")], limit=n, offset=o).count() for n, o in ((0, 0), (1, -1), (200, 0), (201, 150))] == [1, 1, 200, 150]
    gone = tables.retire(spark.createDataFrame([(1, None), (2, "x")], "i int, deleted_at string"), F.lit(True), F.lit("now"))
    assert values(gone) == [(1, "now"), (2, "x")]


# sources and sinks
def office(names):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, t in names.items():
            z.writestr(n, t)
    return b.getvalue()


W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def test_loaders():
    docx = office({"word/document.xml": f'<d xmlns="{W}"><p><pPr><pStyle val="Heading1"/></pPr><r><t>Title</t></r></p><p><r><t>Body text</t></r></p><tbl><tr><tc><p><r><t>Cell</t></r></p></tc></tr></tbl></d>'})
    assert files.docx_text(docx) == "# Title\n\nBody text\n\nCell"
    xlsx = office({"xl/workbook.xml": '<w><sheets><sheet name="S1"/></sheets></w>', "xl/sharedStrings.xml": "<sst><si><t>Name</t></si></sst>", "xl/worksheets/sheet1.xml": '<w><row><c t="s"><v>0</v></c><c><v>3</v></c></row><row><c/></row></w>'})
    assert files.xlsx_text(xlsx) == "[Sheet: S1]\nName | 3"
    eml = b"Subject: Hi\nFrom: a@b.c\nContent-Type: text/plain; charset=utf-8\n\nHello there"
    assert files.eml_text(eml) == "Subject: Hi\n\nFrom: a@b.c\n\nHello there"
    assert files.load("DOCX", ".docx", b"nope")[1] and files.load("TXT", ".txt", b"\xff\xfe bad bytes here")[1] and files.load("PDF", ".pdf", b"%PDF-broken")[1]
    assert files.load("TXT", ".txt", b"123456789")[1] == "too little text" and files.load("TXT", ".txt", b"1234567890")[0] == "1234567890"
    assert files.problem(".png", b"\x89PNG....") is None and files.problem(".gif", b"PNG") and files.problem(".txt", b"")


def test_read_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.TXT").write_text("some text of a file")
    (tmp_path / "sub" / "b.py").write_text("def f():\n    return 1\n")
    (tmp_path / "c.bin").write_bytes(b"\x00\x01")
    got = values(files.load_documents(files.read_files(spark, str(tmp_path))), "name", "doc_type", "error")
    assert got == [("a.TXT", "TXT", None), ("b.py", "CODE_PYTHON", None), ("c.bin", "UNKNOWN", "no loader for .bin")]


@pytest.mark.parametrize(("url", "safe"), [("https://example.com/x", True), ("http://10.0.0.1", False), ("ftp://example.com", False), ("http://localhost:80", False), ("http://172.16.0.1", False), ("http://172.32.0.1", True), ("http://169.254.169.254/latest", False), ("http://[::1]/", False), ("not a url", False), (None, False), ("http://metadata.google.internal", False)])
def test_safe_url(spark, url, safe):
    assert spark.createDataFrame([(url,)], "u string").select(files.safe_url(F.col("u")).alias("x")).first()["x"] == safe


@pytest.mark.parametrize(("line", "title"), [("Introduction:", "Introduction"), ("Big Heading Here", "Big Heading Here"), ("1. Not A Title", None), ("ab", None), ("word", None), ("Ab " * 33 + "A", None), ("lower case line", None)])
def test_section_title(line, title):
    assert files.section_title(line) == title


def test_logs(spark):
    lines = ['{"timestamp": "t", "level": "INFO", "logger": "l", "message": "m"}', "2026-01-01 10:00 - app - ERROR - f:1 - [r] it - broke", "plain text", "  "]
    got = values(files.log_records(spark.createDataFrame([(x,) for x in lines], "value string")), "timestamp", "level", "message", "parsed")
    assert got == sorted([("t", "INFO", "m", True), ("2026-01-01 10:00", "ERROR", "[r] it - broke", False), (None, None, "plain text", False)], key=str)


def test_sinks(spark, tmp_path):
    turns = spark.createDataFrame([(1, 2, "assistant", "b"), (1, 1, "user", "a")], "c long, t long, role string, text string")
    assert sinks.conversation_markdown(turns, conv="c", turn="t", role="role", text="text").first()["markdown"] == "## User\n\na\n\n## Assistant\n\nb"
    assert sinks.conversation_json(turns, conv="c", turn="t", role="role", text="text").first()["json"] == '[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]'
    sinks.write_jsonl(turns, str(tmp_path / "x"))
    assert spark.read.json(str(tmp_path / "x")).count() == 2
    target = sinks.replace_table(turns, str(tmp_path / "t"), "1")
    assert spark.read.parquet(target).count() == 2


# streams
def test_stream_windows_equal_batch(spark, tmp_path):
    rows = [("2026-01-01 00:05:00", "a", 1.0), ("2026-01-01 00:55:00", "a", 2.0), ("2026-01-01 01:05:00", "b", 4.0), ("2026-01-01 09:00:00", "a", 8.0)]
    df = spark.createDataFrame(rows, "t string, k string, v double").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = streams.tumbling(stream, ts="ts", by="k", value="v", length="1 hour").writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert values(spark.table("tumbled")) == values(streams.tumbling(df, ts="ts", by="k", value="v", length="1 hour"))
    query = streams.sessions(stream, ts="ts", by="k", gap="1 hour").writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert values(spark.table("sessions")) == values(streams.sessions(df, ts="ts", by="k", gap="1 hour"))


def test_ingest_is_incremental(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.txt").write_text("first file text")

    def poll():
        stream = streams.new_files(spark, src).withColumn("content_hash", F.sha2("content", 256))
        streams.ingest(stream, out, check).awaitTermination()
        return spark.read.parquet(out).count()

    assert poll() == 1
    (tmp_path / "src" / "b.txt").write_text("first file text")  # the same content again
    (tmp_path / "src" / "c.txt").write_text("another file text")
    assert poll() == 2
    assert poll() == 2


def test_changes(spark, tmp_path):
    now = spark.createDataFrame([("a", 1)], "k string, v int")
    state = str(tmp_path / "state")
    assert values(streams.changes(spark, now, state, key="k", version="v")) == [("a", "added")]
    now.write.parquet(state)
    assert streams.changes(spark, now, state, key="k", version="v").count() == 0


def test_entities_late_in_a_long_text(spark):
    found = graph.extract(spark.createDataFrame([(1, "met Acme Corp. " + "word " * 4000 + "then Late Name came")], "c long, t string"), id_col="c", text="t")
    assert sorted(r["name"] for r in found.collect()) == ["Acme Corp", "Late Name"]


def test_documents_without_a_vector_are_found_by_their_words(spark):
    from types import SimpleNamespace

    from lakequill.plans import retrieval

    docs = spark.createDataFrame([(1, "plain words"), (2, "other words"), (700, "rare inin here")], "doc_id long, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "vec_id long, embedding array<float>")
    found = retrieval.hybrid_pipeline.__wrapped__ if hasattr(retrieval.hybrid_pipeline, "__wrapped__") else retrieval.hybrid_pipeline
    rows = found(SimpleNamespace(spark=spark, documents=docs, embeddings=vectors)).collect()
    assert (2, 700) in {(r["query_id"], r["chunk_id"]) for r in rows}


def test_log_shapes(spark):
    lines = ["2026 - a - INFO - f:1 - x - DEBUG - y", "no - a - INFO - f:1 - x", '{"level": "INFO", "n": 1}', "{broken", "\x1b[31m2026 - a - ERROR - f - m\x1b[0m"]
    got = values(files.log_records(spark.createDataFrame([(x,) for x in lines], "value string")), "timestamp", "level", "logger", "message", "parsed")
    assert got == sorted([
        (None, "DEBUG", None, "2026 - a - INFO - f:1 - x - DEBUG - y", False), (None, "INFO", None, "no - a - INFO - f:1 - x", False), (None, "INFO", None, None, True),
        (None, None, None, "{broken", False), ("2026", "ERROR", "a", "m", False)], key=str)


def test_row_rules(spark):
    from lakequill.operators import rows

    docs = spark.createDataFrame([(1, True, None), (1, False, None), (2, True, "2026"), (3, None, None), (4, False, None)], "ws long, local_only boolean, deleted_at string")
    assert values(rows.local_only(docs, "ws"), "ws", "guarded") == [(1, True), (2, False), (3, True), (4, False)]
    found = spark.createDataFrame([("c1", "a"), ("c1", "b"), ("c2", "b"), ("c3", "b"), ("c4", None)], "c string, filename string")
    lists = spark.createDataFrame([("c1", '["a"]'), ("c2", "[]"), ("c4", '["a"]')], "c string, document_ids string")
    assert values(rows.filtered_by_conversation(found, lists, "c"), "c", "filename") == [("c1", "a"), ("c2", "b"), ("c3", "b")]
    numbers = spark.createDataFrame([(x,) for x in [5, 1, 4, 2, None]], "v long").selectExpr("'g' AS g", "v")
    assert values(rows.nearest_rank(numbers, ["g"], "v", (1, 50, 95)), "p1", "p50", "p95") == [(1, 2, 5)]
    old, new = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, x string, y long"), spark.createDataFrame([(2, None, 9), (3, "c", 3)], "k long, x string, y long")
    assert values(rows.upsert(old, new, ["k"]), "k", "x", "y") == [(1, "a", 1), (2, "b", 9), (3, "c", 3)]
