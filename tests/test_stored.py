"""Indexes, similarity joins, tables with versions, streams with state, pages, tools and the ranker."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakequill.functions import text as T
from lakequill.operators import chunking, graph, memory, orchestrate, ranker, rows, search, similarity, term_index, tools
from lakequill.operators.joins import with_group
from lakequill.operators.term_index import TermIndex
from lakequill.operators.vector_index import VectorIndex
from lakequill.sources import files, listing, pages
from lakequill.sources.versions import Conflict, VersionedTables, replace_documents
from lakequill.streaming import stateful, streams


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# vectors
def clustered(seed, n, dim=16, centres=12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim)) * 3
    return [(i, (middle[i % centres] + rng.normal(size=dim)).tolist()) for i in range(n)]


def cosine(a, b):
    a, b = np.array(a), np.array(b)
    return round(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), 6)


@pytest.fixture(scope="module")
def vectors(spark):
    odd = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] + [1.0] * 15)]
    rows = clustered(1, 600)
    rows.append((700, rows[5][1]))  # a copy
    return rows, spark.createDataFrame(rows + odd, "chunk_id long, embedding array<double>").withColumn("label", F.col("chunk_id") % 3)


def test_vector_index(spark, vectors, tmp_path):
    rows, df = vectors
    index = VectorIndex.build(df, f"file://{tmp_path}/index", lists=20)
    asked = [r for r in rows if r[0] % 20 == 0]
    queries = spark.createDataFrame([*asked, (77, None)], "query_id long, qv array<double>")
    exact = {q: [i for _, i in sorted((-cosine(v, x), i) for i, x in rows)[:10]] for q, v in asked}
    got = {}
    for r in index.search(queries, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert got == exact
    nprobe = index.probes(0.95)
    assert nprobe < 20  # the vectors have clusters, so few lists are enough
    near = {(r["query_id"], r["chunk_id"]) for r in index.search(queries, k=10, nprobe=nprobe).collect()}
    assert sum((q, i) in near for q, ids in exact.items() for i in ids) / (10 * len(exact)) >= 0.9
    plan = index.search(queries, k=10, nprobe=2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [list" in plan  # other lists' folders aren't read
    kept = index.search(queries, k=3, floor=0.5, where=[F.col("label") == 1]).collect()
    assert kept and all(r["chunk_id"] % 3 == 1 and r["similarity"] >= 0.5 for r in kept)
    index.add(spark.createDataFrame([(5000, asked[0][1], 0)], df.schema))
    assert 5000 in [r["chunk_id"] for r in index.search(queries, k=2, nprobe=1).where(f"query_id = {asked[0][0]}").collect()]


def test_vector_index_of_nothing_and_in_passes(spark, vectors, tmp_path, monkeypatch):
    from lakequill.operators import vector_index

    rows, df = vectors
    empty = VectorIndex.build(df.limit(0), f"file://{tmp_path}/empty")
    queries = spark.createDataFrame(rows[:30], "query_id long, qv array<double>")
    assert empty.search(queries, k=3).count() == 0
    index = VectorIndex.build(df, f"file://{tmp_path}/full", lists=8)
    whole = rows_of(index.search(queries, k=4))
    monkeypatch.setattr(vector_index, "QUERY_BYTES", 8 * 16 * 7)  # 7 queries a pass
    monkeypatch.setattr(vector_index, "CELLS", 50)
    assert rows_of(index.search(queries, k=4)) == whole


@pytest.mark.parametrize("floor", [0.3, 0.85, 0.97])
def test_near_duplicates(spark, vectors, floor, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 16)  # many blocks a cell
    rows, df = vectors
    rows = rows[:240] + [r for r in rows if r[0] == 700]
    df = df.where("chunk_id < 240 OR chunk_id IN (700, 9001, 9002)").withColumn("scope", F.when(F.col("label") > 0, F.col("label")))
    want = sorted((s, a, b) for a, x in rows for b, y in rows if a < b and (s := a % 3) == b % 3 and cosine(x, y) >= floor)
    got = similarity.near_duplicates(df, floor=floor, id_col="chunk_id", vector="embedding", scope="scope", pivots=9)
    assert sorted((r["scope"] or 0, r["a"], r["b"]) for r in got.collect()) == want
    assert (0.97 < floor) or any(b == 700 for *_, b in want) or rows[5][0] % 3 != 700 % 3


def test_near_duplicates_plan_and_bounds(spark, vectors):
    _, df = vectors
    plan = similarity.near_duplicates(df, floor=0.9, id_col="chunk_id", vector="embedding", scope="label")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    with pytest.raises(ValueError, match="floor"):
        similarity.near_duplicates(df, floor=0.0, id_col="chunk_id", vector="embedding", scope="label")


def test_new_only_in_order(spark):
    """A chain of near neighbours: the second goes, the third stays as the second isn't there to refuse it. Null scopes are one scope."""
    turn = lambda deg: [math.cos(math.radians(deg)), math.sin(math.radians(deg))]
    schema = "id long, workspace_id long, embedding array<double>"
    new = [(1, 1, turn(0)), (2, 1, turn(20)), (3, 1, turn(40)), (4, 1, turn(60)), (5, 1, turn(0)), (6, 2, turn(20)), (7, None, turn(5)), (8, None, turn(5)), (9, 1, None), (10, 1, turn(181))]
    known = spark.createDataFrame([(100, 1, turn(180))], schema)
    got = memory.new_only(spark.createDataFrame(new, schema), known, floor=0.92, order="id")
    assert sorted(r["id"] for r in got.collect()) == [1, 3, 6, 7, 9]
    without = memory.new_only(spark.createDataFrame(new, schema), known, floor=0.92)
    assert sorted(r["id"] for r in without.collect()) == [1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert memory.new_only(known.limit(0), known, floor=0.92, order="id").count() == 0


def counted(monkeypatch):
    """Rows that the joins write to the shared folder from now on, by name."""
    rows, put = {}, similarity.stored

    def stored(df, name, *more, **by):
        out = put(df, name, *more, **by)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(similarity, "stored", stored)
    return rows


def test_near_duplicates_writes_no_copies(spark, vectors, monkeypatch):
    """A low floor, with which pivots leave nothing out: every vector is written once, and links without copies aren't joined."""
    _, df = vectors
    written = counted(monkeypatch)
    got = similarity.near_duplicates(df.where("chunk_id < 600"), floor=0.1, id_col="chunk_id", vector="embedding", scope="label")
    assert got.count() > 600 and sum(written.values()) == 600, written
    assert "Join" not in got.select("a")._jdf.queryExecution().executedPlan().toString().replace("BroadcastHashJoin", "")


@pytest.mark.parametrize("pivots", [None, 5])
def test_near_duplicates_with_odd_ids_and_copies(spark, monkeypatch, pivots):
    """Copies of some vectors, rows without an id, ids that come twice; single precision, blocks that don't come out even."""
    monkeypatch.setattr(similarity, "BLOCK", 12)
    monkeypatch.setattr(similarity, "TILE", 5)
    monkeypatch.setattr(similarity, "PIECE_BYTES", 200)
    gen = np.random.default_rng(8)
    rows = [(f"d{i:03}", None if i % 4 == 0 else i % 4, [float(x) for x in gen.standard_normal(4).astype(np.float32)]) for i in range(120)]
    rows += [(f"e{i:03}", rows[i % 7][1], rows[i % 7][2]) for i in range(20)] + [("d003", 3, rows[1][2]), (None, 3, rows[3][2]), ("d007", 3, rows[7][2])]
    want = sorted((str(s), a, b, cosine(x, y)) for a, s, x in rows for b, t, y in rows if a and b and a < b and s == t and cosine(x, y) >= 0.6)
    got = similarity.near_duplicates(spark.createDataFrame(rows, "id string, scope long, embedding array<float>"), floor=0.6, id_col="id", vector="embedding", scope="scope", pivots=pivots)
    assert sorted((str(r["scope"]), r["a"], r["b"], r["similarity"]) for r in got.collect()) == want


@pytest.mark.parametrize("floor, some", [(0.2, False), (0.97, True)])
def test_pivots_only_where_they_prune(spark, vectors, monkeypatch, floor, some):
    """The sample decides on pivots; the pairs are the same."""
    chosen, choose = [], similarity.pivots_for
    monkeypatch.setattr(similarity, "pivots_for", lambda *x: chosen.append(choose(*x)) or chosen[-1])
    rows, df = vectors
    tight = [(i, (np.array(v) * 0.02 + np.array(rows[i % 12][1])).tolist(), 1) for i, v in rows]
    got = similarity.near_duplicates(spark.createDataFrame(tight, df.schema), floor=floor, id_col="chunk_id", vector="embedding", scope="label")
    want = sorted((a, b) for a, x, _ in tight for b, y, _ in tight if a < b and cosine(x, y) >= floor)
    assert sorted((r["a"], r["b"]) for r in got.collect()) == want
    assert (chosen[0] is not None) == some


def test_new_only_writes_no_pairs(spark, monkeypatch):
    """Vectors that are nearly all alike: what is written doesn't grow with pairs."""
    gen = np.random.default_rng(5)
    rows = [(i, "w", [float(x) for x in 1 + 0.2 * gen.standard_normal(8)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, workspace_id string, embedding array<double>")
    written = counted(monkeypatch)
    assert [r["id"] for r in memory.new_only(df, df.limit(0), floor=0.5, order="id").collect()] == [0]
    assert sum(written.values()) <= 4 * len(rows), written


@pytest.mark.parametrize("known_rows", [0, 3, 60])
def test_new_only_in_runs(spark, monkeypatch, known_rows):
    """More vectors than a block in a scope, and more that stay; known ones in single precision, fewer than a block or more."""
    monkeypatch.setattr(similarity, "BLOCK", 40)
    monkeypatch.setattr(similarity, "TILE", 8)
    gen = np.random.default_rng(6)
    vector = lambda: [float(x) for x in gen.standard_normal(6).astype(np.float32)]
    rows = [(i, None if i % 5 == 0 else "w", vector()) for i in range(130)]
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(0, 130, 9)]  # later copies
    rows = [rows[i] for i in gen.permutation(len(rows))]
    known = [(1000 + i, "w" if i % 8 else "x", vector()) for i in range(known_rows)]
    schema = "id long, workspace_id string, embedding array<{}>"
    near = lambda a, b: a[1] == b[1] and cosine(a[2], b[2]) >= 0.75
    want = []
    for r in sorted(rows):
        if not any(near(r, k) for k in [*known, *want]):
            want.append(r)
    assert sum(r[1] == "w" for r in want) > 40 or known_rows == 60
    got = memory.new_only(spark.createDataFrame(rows, schema.format("double")), spark.createDataFrame(known, schema.format("float")), floor=0.75, order="id")
    assert sorted(r["id"] for r in got.collect()) == [r[0] for r in want]


def test_with_group(spark):
    rows = spark.createDataFrame([(i, i % 7 if i % 2 else 0, None if i % 9 == 0 else i) for i in range(200)], "i long, k long, x long")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k <> 3")
    counts = {r["k"]: r["n"] for r in groups.collect()}
    for total in (200, 200_000_000):  # all groups are large, or none is
        got = with_group(rows, groups, ["k"], "i", "n", total).collect()
        assert len(got) == 200 and all(r["n"] == counts.get(r["k"]) for r in got)


# terms
def plain_cover(words, terms):
    """By definition: every shortest span with all terms."""
    at = [i for i, w in enumerate(words) if w in terms]
    spans = [(a, b) for a in at for b in at if a <= b and {w for w in words[a : b + 1] if w in terms} == set(terms)]
    spans = [(a, b) for a, b in spans if not any((c, d) != (a, b) and a <= c and d <= b for c, d in spans)]
    r = sum(0.1 / (1 + max(0, b - a - (len(terms) - 1))) for a, b in spans)
    return round(r / (r + 1), 6)


@pytest.mark.parametrize("block", [4, 128])
def test_term_index(spark, tmp_path, block):
    rng = random.Random(block)
    docs = [(i, " ".join(rng.choice("aaaabbbccd") for _ in range(rng.randint(1, 40)))) for i in range(150)] + [(500, None), (501, ""), (502, "?!")]
    df = spark.createDataFrame(docs, "chunk_id long, chunk_text string")
    index = TermIndex.build(df.where("chunk_id <> 7"), f"file://{tmp_path}/terms", block=block, buckets=4)
    index.add(df.where("chunk_id = 7"), block=block)
    asked = [(1, "a"), (2, "B a"), (3, "c, b a"), (4, "d"), (5, "a nowhere"), (6, ""), (7, "d c b a")]
    report = []
    got = index.search(spark.createDataFrame(asked, "query_id long, query string"), k=5, report=report).orderBy("query_id", "rank").collect()
    for q, text in asked:
        terms = {t for t in text.lower().replace(",", "").split()}
        scores = [(-plain_cover((t or "").split(), terms), i) for i, t in docs if terms and terms <= set((t or "").split())]
        assert [(r["chunk_id"], r["lexical_score"]) for r in got if r["query_id"] == q] == [(i, -s) for s, i in sorted(scores)[:5]], text
    if block == 4:
        assert report[1] < 0.8 * report[0]  # blocks that can't reach the best aren't scored


def test_postings_in_place(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, None), (3, "A")], "id long, text string")
    df = term_index.postings(docs, id_col="id", text="text")
    assert rows_of(df) == [(1, "a", [2]), (1, "b", [1, 3]), (3, "a", [1])]
    assert "Exchange" not in df._jdf.queryExecution().toString()
    lex = T.lexemes(F.col("text"))
    assert docs.where("id = 1").select(search.cover_density(lex, F.array(F.lit("a"), F.lit("b")))).first()[0] == pytest.approx(0.2 / 1.2)


# versions
def test_versions(spark, tmp_path):
    t = VersionedTables(spark, f"file://{tmp_path}/db")
    docs = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    parts = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, chunk_index long, chunk_text string")
    assert t.versions() == []
    assert replace_documents(t, docs((1, "one"), (2, "two")), parts((1, 0, "on"), (1, 1, "ne"), (2, 0, "two"))) == 1
    old = t.read("chunks", 1)
    assert replace_documents(t, docs((1, "uno")), parts((1, 0, "uno"))) == 2
    assert rows_of(t.read("chunks").drop("_written")) == [(1, 0, "uno"), (2, 0, "two")]
    assert old.count() == 3 and t.read("chunks", 1).count() == 3  # readers of the old state aren't disturbed
    assert rows_of(t.read("documents", retired=True)) == [(1, "one", 1, 2), (1, "uno", 2, None), (2, "two", 1, None)]
    assert t.commit(retire={"documents": ("doc_id", docs((2, ""), (None, ""), (77, ""))), "chunks": ("doc_id", docs((2, "")))}) == 3
    assert rows_of(t.read("documents").select("doc_id")) == [(1,)]
    assert t.compact("chunks") == 4 and rows_of(t.read("chunks")) == [(1, 0, "uno", 4)] and t.read("chunks", 2).count() == 2
    with pytest.raises(ValueError, match="no table"):
        t.read("other")


def test_writers_that_meet(spark, tmp_path, monkeypatch):
    """A writer that finds its number taken goes after the other one, unless both changed a key; what it wrote is then in no version."""
    t = VersionedTables(spark, f"file://{tmp_path}/db")
    frame = lambda *ids: spark.createDataFrame([(i,) for i in ids], "doc_id long")
    t.commit(add={"documents": frame(1, 2)})
    claim = VersionedTables._claim
    first = []

    def raced(self, version, manifest):
        if not first:
            first.append(True)
            VersionedTables(spark, self.path).commit(add={"documents": frame(3)}, retire={"documents": ("doc_id", frame(1))})
        return claim(self, version, manifest)

    monkeypatch.setattr(VersionedTables, "_claim", raced)
    assert t.commit(retire={"documents": ("doc_id", frame(2))}) == 3 and rows_of(t.read("documents").select("doc_id")) == [(3,)]
    first.clear()
    with pytest.raises(Conflict):
        t.commit(retire={"documents": ("doc_id", frame(1))})
    assert t.versions() == [1, 2, 3, 4]


# streams
def feed(spark, path, no, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/batch{no}")


def stream_of(spark, path, schema):
    return stateful.configured(spark).readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def test_listing_changes_restart(spark, tmp_path):
    """Three polls; the stream is stopped and restarted from its checkpoint between them."""
    src, out, check = (f"{tmp_path}/{x}" for x in ("src", "out", "check"))
    schema = "k string, v string, poll timestamp"
    at = lambda i: f"2024-01-01 00:0{i}:00"
    polls = [[("a", "1"), ("b", "1"), ("c", None)], [("a", "1"), ("b", "2"), ("d", "1")], [("a", "1"), ("c", "1")]]
    for i, listed in enumerate(polls):
        df = spark.createDataFrame([(k, v, at(i)) for k, v in listed], "k string, v string, poll string").withColumn("poll", F.col("poll").cast("timestamp"))
        df.coalesce(1).write.parquet(f"{src}/batch{i}")
        stateful.drained(stateful.listing_changes(stream_of(spark, src, schema), key="k", version="v", poll="poll"), out, check).awaitTermination()
    got = sorted((str(r["poll"])[14:16], r["k"], r["event"]) for r in spark.read.parquet(out).collect())
    assert got == [("00", "a", "added"), ("00", "b", "added"), ("00", "c", "added"), ("01", "b", "modified"), ("01", "c", "deleted"), ("01", "d", "added"), ("02", "b", "deleted"), ("02", "c", "added"), ("02", "d", "deleted")]


def test_presence_and_last_samples(spark, tmp_path):
    schema = "u string, ts timestamp, i long, v double"
    second = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + F.col(s))
    batches = [[("x", 0, 1, 5.0), ("x", 20, 2, 1.0), ("y", 10, 3, 9.0), ("x", 60, 4, 2.0), (None, 5, 5, 1.0)], [("y", 75, 6, 3.0), ("z", 100, 7, 4.0), ("x", 89, 8, 7.0)]]
    for no, rows in enumerate(batches):
        spark.createDataFrame(rows, "u string, s long, i long, v double").select("u", second("s").alias("ts"), "i", "v").coalesce(1).write.parquet(f"{tmp_path}/src/batch{no}")
        stateful.drained(stateful.presence(stream_of(spark, f"{tmp_path}/src", schema), by="u", ts="ts"), f"{tmp_path}/p", f"{tmp_path}/pc").awaitTermination()
        stateful.drained(stateful.last_samples(stream_of(spark, f"{tmp_path}/src", schema), by="u", ts="ts", tie="i", value="v", last=3), f"{tmp_path}/h", f"{tmp_path}/hc").awaitTermination()
    who = spark.read.parquet(f"{tmp_path}/p").select("u", "event", (F.unix_timestamp("ts") - 1_700_000_000).alias("s"))
    assert rows_of(who) == sorted([("x", "joined", 0), ("x", "left", 50), ("x", "joined", 60), ("y", "joined", 10), ("y", "left", 40), ("y", "joined", 75), ("z", "joined", 100)], key=str)
    last = spark.read.parquet(f"{tmp_path}/h").where("u = 'x'").orderBy("seen").collect()
    assert [(r["seen"], r["n"], r["low"], r["high"], r["p50"]) for r in last] == [(3, 3, 1.0, 5.0, 2.0), (4, 3, 1.0, 7.0, 2.0)]


def test_sync_log(spark, tmp_path):
    schema = "k long, event string"
    feed(spark, f"{tmp_path}/src", 0, [(1, "added"), (2, "added"), (3, "deleted")], schema)
    run = lambda stream: stateful.synced(stream, f"{tmp_path}/out", f"{tmp_path}/log", f"{tmp_path}/check", source="s").awaitTermination()
    run(stream_of(spark, f"{tmp_path}/src", schema))
    feed(spark, f"{tmp_path}/src", 1, [(4, "modified")], schema)
    with pytest.raises(Exception, match="boom"):
        run(stream_of(spark, f"{tmp_path}/src", schema).withColumn("x", F.when(F.col("k") == 4, F.raise_error(F.lit("boom"))).otherwise(1)))
    log = lambda: [tuple(r) for r in spark.read.parquet(f"{tmp_path}/log").orderBy("batch_no").select("source", "added", "modified", "deleted", F.col("error").isNull()).collect()]
    assert log() == [("s", 2, 0, 1, True), ("s", 0, 0, 0, False)]
    run(stream_of(spark, f"{tmp_path}/src", schema).withColumn("x", F.lit(1)))  # the failed batch is repeated
    assert log() == [("s", 2, 0, 1, True), ("s", 0, 1, 0, True)] and spark.read.parquet(f"{tmp_path}/out").count() == 4


def test_ingest_once(spark, tmp_path):
    """Keys are kept over a restart; the second run reads only what is new."""
    schema, out = "content_hash string, v long", f"{tmp_path}/out"
    for no, rows_ in enumerate([[("a", 1), ("a", 1), ("b", 2)], [("b", 9), ("c", 3), (None, 4), (None, 4)]]):
        feed(spark, f"{tmp_path}/src", no, rows_, schema)
        streams.ingest_once(stream_of(spark, f"{tmp_path}/src", schema), out, f"{tmp_path}/check").awaitTermination()
    assert rows_of(spark.read.parquet(out)) == [("a", 1), ("b", 2), ("c", 3), (None, 4)]


def test_listing_source(spark, tmp_path):
    src = tmp_path / "src"
    (src / "sub" / "deep").mkdir(parents=True)
    for name, text in {"a.txt": "1", "b.md": "22", "c.bin": "3", "sub/d.TXT": "4", "sub/deep/e.txt": "5", ".hidden.txt": "6"}.items():
        (src / name).write_text(text)
    listing.register(spark)
    got = spark.read.format("listing").option("extensions", "txt, .md").option("most_bytes", "1").load(str(src))
    assert sorted((r["path"].removeprefix(f"{src}/"), r["prefix"], r["size"]) for r in got.collect()) == [("a.txt", "", 1), ("sub/d.TXT", "sub", 1), ("sub/deep/e.txt", "sub", 1)]

    def poll():
        stream = stateful.configured(spark).readStream.format("listing").option("extensions", "txt").load(f"file://{src}")
        stateful.drained(stateful.listing_changes(stream, key="path", version="version", poll="poll"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
        return sorted((r["path"].rsplit("/", 1)[1], r["event"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    first = [("a.txt", "added"), ("d.TXT", "added"), ("e.txt", "added")]
    assert poll() == first
    time.sleep(0.05)
    (src / "a.txt").write_text("longer")
    (src / "sub" / "d.TXT").unlink()
    assert poll() == sorted([*first, ("a.txt", "modified")])
    assert poll() == sorted([*first, ("a.txt", "modified"), ("d.TXT", "deleted")])  # a source that is read in one batch deletes at its next poll


# pages
def test_pages(spark):
    lines = [["Annual Report:"], ["First line of a text that is long enough (with brackets) to pass the gate"], ["year", "total"], ["2024", "12,5 €"], ["after the table, some words more to read"]]
    for deflate in (True, False):
        pdf = pages.written_pdf([lines, [["Second page"]], []], deflate)
        files = spark.createDataFrame([("a.pdf", pdf), ("b.pdf", b"%PDF-1.4 broken"), ("c.pdf", None)], "name string, content binary")
        got = pages.expanded(files, "page_rows").orderBy("name", "page_number").collect()
        first = "Annual Report:\nFirst line of a text that is long enough (with brackets) to pass the gate\nafter the table, some words more to read\n\n[Table 1 on page 1]\nyear | total\n2024 | 12,5 €"
        assert [tuple(r)[:4] for r in got[:3]] == [("a.pdf", 1, first, "Annual Report"), ("a.pdf", 2, "Second page", None), ("a.pdf", 3, "", None)]
        assert [(r["name"], r["page_number"]) for r in got[3:]] == [("b.pdf", None), ("c.pdf", None)] and all(r["error"] for r in got[3:])


def test_extractors_in_turn():
    """One that is missing or fails is passed over, and so is one that finds too little if another finds enough."""
    short, long = [("few", [])], [("many " * 30, [])]

    def missing(data):
        raise ImportError

    def failing(data):
        raise RuntimeError("bad xref")

    assert pages.pdf_pages(b"", (missing, failing, lambda d: short, lambda d: long)) == long
    assert pages.pdf_pages(b"", (lambda d: short, failing)) == short
    with pytest.raises(ValueError, match="bad xref"):
        pages.pdf_pages(b"", (missing, failing))


def test_literal_strings():
    content = rb"BT 14 TL 1 0 0 1 10 700 Tm (a\(b\)\051 \101) Tj T* [(sp) -20 (lit)] TJ 0 -30 Td <48 69> Tj ET"
    assert pages.lines_of(pages.placed_strings(content)) == [["a(b)) A"], ["split"], ["Hi"]]


def test_slides(spark):
    from lakequill.plans.paged import pptx_file

    data = pptx_file([(2, "Goals", "win & grow\n\nsoon"), (1, "", "only text here"), (3, "", "")])
    files = spark.createDataFrame([("a.pptx", data), ("b.pptx", b"no zip"), ("c.pptx", pptx_file([(1, "", "")]))], "name string, content binary")
    got = pages.expanded(files, "slide_rows").orderBy("name", "slide_number").collect()
    assert [tuple(r) for r in got[:2]] == [("a.pptx", 1, "only text here", "only text here", None), ("a.pptx", 2, "Goals\nwin & grow\nsoon", "Goals", None)]
    assert [(r["name"], r["error"] is not None) for r in got[2:]] == [("b.pptx", True), ("c.pptx", True)]


# tools and the ranker
def test_tools(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fish blue fish", "s", 18), (2, "red bird", "s", 8), (3, "blue sky", "t", 8), (4, None, None, 0)], "doc_id long, text string, source string, n_chars long")
    registry = tools.register(spark, docs, TermIndex.build(docs, f"file://{tmp_path}/t", id_col="doc_id", text="text", buckets=2))
    hit = registry.call("search_documents", {"q": "Fish, red", "color": "dropped"}).collect()
    assert [(r["doc_id"], r["score"]) for r in hit] == [(1, round(0.1 / 1.1 + 0.2 / 1.2, 6))]
    assert [r["doc_id"] for r in registry.call("search_documents", {"q": "red", "k": 1}).collect()] == [1]
    assert registry.call("search_documents", {"q": "?!"}).count() == 0
    assert [r["passage"] for r in registry.call("read_document", {"id": 1, "start": 5, "most": 4}).collect()] == ["fish"]
    lateral = registry.lateral(spark.createDataFrame([("red",), ("blue",), ("none",)], "w string"), "search_documents", q="r.w", k="1")
    assert rows_of(lateral.select("w", "doc_id")) == [("blue", 1), ("red", 1)]
    assert registry.call("current_datetime", {}).count() == 1
    assert rows_of(registry.catalog().select("name"))[0] == ("current_datetime",) and '"required": ["q"]' in {r["name"]: r["parameters"] for r in registry.catalog().collect()}["search_documents"]
    with pytest.raises(KeyError):
        registry.call("unknown", {})
    with pytest.raises(TypeError, match="needs q"):
        registry.call("search_documents", {})
    assert registry.remove("read_document") and not registry.remove("read_document")


def test_ranker(spark):
    """Weights as plain numpy has them; a model that ranks better is promoted, one from too few pairs isn't."""
    rng = np.random.default_rng(3)
    rows = [(str(q), i, i == 0, *(float(x) for x in rng.random(3) * 0.2), float(rng.random()) + (0.5 if i == 0 else 0), float(rng.random())) for q in range(150) for i in range(4)]
    rows = [(q, i, rel, a, b, c, d, s) for q, i, rel, a, b, c, d, s in rows]
    df = spark.createDataFrame(rows, "query_id string, i long, relevant boolean, coverage double, overlap double, precision double, length double, similarity double")
    model = ranker.fit(df, query="query_id", tie="i", steps=12)
    learned = {r["query_id"] for r in df.where(~ranker.held_out("query_id")).select("query_id").distinct().collect()}
    x = np.array([[good[3:7], np.mean([r[3:7] for r in rows if r[0] == q and not r[2]], axis=0)] for q in learned for good in rows if good[0] == q and good[2]])
    d, w = x[:, 0] - x[:, 1], np.zeros(4)
    for _ in range(12):
        w = w + 2.0 * ((d / (1 + np.exp(d @ w))[:, None]).mean(axis=0) - 1e-3 * w)
    assert model.weights == pytest.approx(w.tolist(), abs=1e-6) and model.pairs == len(d)
    assert model.ndcg_after > model.ndcg_before and model.promoted
    few = ranker.fit(df.where("query_id < '12'"), query="query_id", tie="i", steps=3)
    assert few.pairs < ranker.LEAST_PAIRS and not few.promoted
    assert ranker.fit(df.limit(0), query="query_id", tie="i", steps=2).weights == [0.0] * 4
    texts = spark.createDataFrame([("red fish", "a red fish swims"), ("red fish", None)], "query string, chunk_text string")
    scores = [r["rerank_score"] for r in ranker.reranked(texts, [1.0, 0.0, 0.0, 0.0]).collect()]
    assert scores == [1.0, 0.0]


# the rest
def test_known_names(spark):
    docs = spark.createDataFrame([(1, "New York, New York; York. Yorkshire newNew Yorks"), (2, None), (3, ""), (4, "C++ and C")], "id long, text string")
    names = spark.createDataFrame([("New York", "GPE"), ("York", "GPE"), ("York", "EVENT"), ("C++", "PRODUCT"), ("x", "ORG"), ("and", "DATE")], "name string, type string")
    assert rows_of(graph.extract_known(docs, names, id_col="id", text="text")) == [(1, "New York", "GPE", 2), (1, "York", "EVENT", 1), (4, "C++", "PRODUCT", 1)]
    assert graph.extract_known(docs, names.limit(0), id_col="id", text="text").count() == 0


def test_memories_for_queries(spark):
    memories = spark.createDataFrame([(1, "w", [1.0, 0.0], 2, None), (2, "w", [0.9, 0.1], 0, None), (3, "v", [1.0, 0.0], 0, None), (4, "w", [1.0, 0.0], 0, "gone")], "id long, workspace_id string, embedding array<double>, use_count long, deleted_at string")
    memories = memories.withColumn("last_used", F.lit(None).cast("timestamp"))
    queries = spark.createDataFrame([(1, [1.0, 0.0], ["w"]), (2, [1.0, 0.0], None), (3, [0.0, 1.0], [])], "query_id long, qv array<double>, scopes array<string>")
    found, after = memory.retrieve(memories, queries, F.lit("2026-01-01").cast("timestamp"), k=2)
    assert rows_of(found.select("query_id", "id")) == [(1, 1), (1, 2), (2, 1), (2, 3)] and "embedding" not in found.columns
    named = found.withColumn("memory_type", F.lit("fact")).withColumn("content", F.concat(F.lit("m"), "id"))
    assert rows_of(memory.prompt(named, by=["query_id"])) == [(1, "Relevant memories:\n[FACT] m1\n[FACT] m2"), (2, "Relevant memories:\n[FACT] m1\n[FACT] m3")]
    assert rows_of(after.select("id", "use_count", F.col("last_used").isNotNull())) == [(1, 4, True), (2, 1, True), (3, 1, True), (4, 0, False)]


def test_job_matrix_survives_a_tool(spark):
    queries = spark.createDataFrame([(1, "a" * 200, ["ok", "bad", "none"]), (2, "b", ["ok"])], "query_id long, query string, tools array<string>")
    calls = []

    def bad(q):
        calls.append(1)
        return q.select("query_id", F.raise_error(F.lit("no line")).alias("x"))

    found = {"ok": lambda q: q.where("query_id = 1").select("query_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("seq")), "bad": bad}
    jobs = orchestrate.job_matrix(queries, found, retries=2, most=3)
    got = rows_of(jobs.groupBy("query_id", "tool", "status").count())
    assert got == [(1, "bad", "failed", 1), (1, "none", "unknown", 1), (1, "ok", "ok", 3), (2, "ok", "empty", 1)] and len(calls) == 3
    assert {len(r["query"]) for r in orchestrate.trace(jobs, queries).collect()} == {100, 1}
    assert rows_of(orchestrate.outcome(jobs)) == [(1, True), (2, False)]


def test_log_tail(spark, tmp_path):
    lines = [f"2026-01-01 00:00:{i:02} - app - {'ERROR' if i % 5 == 0 else 'INFO'} - run:{i} - line {i}" for i in range(40)] + ["", '{"level": "ERROR", "message": "Json LINE"}']
    (tmp_path / "app.log").write_text("\n".join(lines))
    path = f"file://{tmp_path}/app.log"
    assert [r["message"] for r in files.log_tail(spark, path, limit=4).collect()] == ["line 38", "line 39", "Json LINE"]
    assert [r["message"] for r in files.log_tail(spark, path, limit=2, level="error").collect()] == ["line 35", "Json LINE"]
    assert [r["message"] for r in files.log_tail(spark, path, limit=1, contains="LINE 3").collect()] == ["line 39"]
    assert files.log_tail(spark, path, limit=1, contains="line 1").count() == 0  # beyond the last ten lines


def test_rows_cleared_and_kept_once(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k long, v string, w string")
    new = spark.createDataFrame([(1, None, None), (3, "c", None)], old.schema)
    assert rows_of(rows.upsert(old, new, ["k"], clear=("w",))) == [(1, "a", None), (2, "b", "y"), (3, "c", None)]
    there = spark.createDataFrame([], "chunk_id string, d long, i long")
    assert rows.insert_chunks(there, spark.createDataFrame([(1, 0), (1, 0), (1, 1)], "d long, i long"), "d", "i").count() == 2


def test_tables_end_at_the_next_marker():
    text = "before " * 200 + "\n\n[Table 1 on page 1]\na | b\n\nc | d\n[Table 2 on page 2]\ne | f"
    assert chunking.chunk_text(text)[-2:] == ["[Table 1 on page 1]\na | b\n\nc | d", "[Table 2 on page 2]\ne | f"]
    assert len(chunking.chunk_js("let a = function () { return 1 }\nexport async function foo() {}\nconst b = async (x) => x\nclass Bar {}\n")) == 4


def test_hybrid_by_workspace(spark):
    """Copies of one file and index in two workspaces are one result; results come in reading order; a learned score is mixed in."""
    texts = [("alpha beta gamma " * 20, "a"), ("alpha delta " * 20, "b"), ("nothing here " * 20, "c")]
    chunks = spark.createDataFrame([(i + 10 * w, f"{n}.txt", 0, t, [1.0, float(i)], w) for w in (0, 1) for i, (t, n) in enumerate(texts)], "chunk_id long, filename string, chunk_index int, chunk_text string, embedding array<double>, workspace long")
    queries = spark.createDataFrame([(1, "alpha", [1.0, 0.0])], "query_id long, query string, qv array<double>")
    got = search.hybrid_search(chunks, queries, workspace="workspace").orderBy("place").collect()
    assert [(r["place"], r["filename"], r["chunk_id"]) for r in got] == [(1, "a.txt", 10), (2, "b.txt", 11), (3, "c.txt", 12)]
    mixed = search.hybrid_search(chunks, queries, workspace="workspace", weights=[1.0, 0.0, 0.0, 0.0]).orderBy("place").collect()
    assert mixed[0]["combined_score"] > mixed[2]["combined_score"] and mixed[0]["combined_score"] != got[0]["combined_score"]


@pytest.mark.parametrize("small", [0, 10**6])
def test_nearest_rank(spark, monkeypatch, small):
    """With brackets from the sketch, and without; null groups, ties, one value, nulls."""
    monkeypatch.setattr(rows, "SMALL", small)
    monkeypatch.setattr(rows, "ACCURACY", 100)
    rng = random.Random(9)
    data = [(k, rng.randint(0, 400) / 4) for k in ("a", "b", None) for _ in range(700)] + [("c", 1.0), ("c", None), ("d", None)]
    got = {r["k"]: tuple(r)[1:] for r in rows.nearest_rank(spark.createDataFrame(data, "k string, v double"), ["k"], "v", (0.0, 12.5, 50.0, 99.0, 100.0)).collect()}
    want = {}
    for k in ("a", "b", None, "c"):
        v = sorted(x for g, x in data if g == k and x is not None)
        want[k] = tuple(v[min(len(v), max(1, round(p / 100 * len(v)))) - 1] for p in (0.0, 12.5, 50.0, 99.0, 100.0))
    assert got == want
