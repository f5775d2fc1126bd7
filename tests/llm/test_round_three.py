"""Merkle manifest, prefix trie and token counts against plain versions."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from lakequill.llm import manifest, prefix_trie, registry, token_counts


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def fields(row):
    return [("-" if v is None else f"{len(str(v).encode())}:{v}") for v in row]


# manifest
def brute_tree(nodes, fanout):
    """The root and each node's siblings, level by level."""
    levels, proofs, at = [nodes], [[] for _ in nodes], list(range(len(nodes)))
    while len(levels[-1]) > 1:
        below = levels[-1]
        for k, i in enumerate(at):
            first = i - i % fanout
            proofs[k].append((below[first:i], below[i + 1 : first + fanout]))
        at = [i // fanout for i in at]
        levels.append([h(*below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return levels[-1][0], proofs


def brute_manifest(rows, fanout):
    """rows: (order, group, leaf). order, leaf -> subroot, root, proof."""
    null_first = lambda v: (v is not None, v if v is not None else 0)
    groups = {}
    for o, g, leaf in rows:
        groups.setdefault(g, []).append((null_first(o), leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([leaf for _, leaf in sorted(groups[g])], fanout) for g in names}
    root, tops = brute_tree([trees[g][0] for g in names], fanout)
    out = []
    for g, top in zip(names, tops, strict=True):
        for (_, leaf), proof in zip(sorted(groups[g]), trees[g][1], strict=True):
            out.append((leaf, trees[g][0], root, ",".join("".join(a) + "." + "".join(b) for a, b in proof + top)))
    return sorted(out)


@pytest.mark.parametrize(("levels", "fanout", "sizes"), [(1, 3, [27, 1, 28]), (2, 3, [10, 40, 3, 9, 2]), (3, 2, [17]), (6, 3, [1]), (2, 4, [70, 5])])
def test_manifest(spark, levels, fanout, sizes):
    rows = [(i if i % 9 else None, [None, "a", "é", "Z", ""][g], h(str(g), str(i))) for g, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, leaf string").withColumn("root", F.lit("x")).withColumn("_index", F.lit("y"))
    got = manifest.manifest(docs, levels=levels, fanout=fanout)
    assert got.columns == ["doc_id", "source", "leaf", "_index", "subroot", "root", "proof"]
    found = got.collect()
    assert sorted((r["leaf"], r["subroot"], r["root"], r["proof"]) for r in found) == brute_manifest(rows, fanout)
    assert all(manifest.fold(r["leaf"], r["proof"]) == r["root"] for r in found)


def test_manifest_query(spark, odd, odd_rows, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["op13_manifest"](spark, str(tmp_path)).collect()
    key = lambda i, t, lang, s, n: fields((i, s, lang, n, t))
    leaves = {(h(*key(*r))): r for r in odd_rows}
    want = brute_manifest([(r[0], r[3], h(*key(*r))) for r in odd_rows], 3)
    assert sorted((r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in got) == sorted((a, b, c, h(p.replace(".", "").replace(",", ""))) for a, b, c, p in want)
    for r in got:
        i, t, *_ = leaves[r["leaf"]]
        tampered = i is not None and zlib.crc32(str(i).encode()) % 2 == 0 and "\n" in (t or "")
        assert r["verified"] == (not tampered) == (r["folded_root"] == r["root"])
    assert any(not r["verified"] for r in got)


def test_manifest_of_nothing(spark, none):
    assert manifest.manifest(none.withColumn("leaf", F.lit("x"))).count() == 0


# prefix trie
def brute_trie(convs):
    """convs: id -> list of (role, text)."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for p, ms in members.items():
        subtree = [q for q in members if q[: len(p)] == p]
        kids = [q for q in subtree if len(q) == len(p) + 1]
        leaf = lambda q: not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in members)
        ends = ",".join(map(str, sorted(c for c in ms if len(convs[c]) == len(p))))
        out.append((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), len(kids), sum(map(leaf, subtree)), sum((len(members[q]) - 1) * len(q[-1][1]) for q in subtree if q), h(ends)))
    return sorted(out, key=str)


def trie_rows(df):
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    assert df.columns == names and {t for c, t in df.dtypes if c != "ends_sha256"} == {"bigint"}
    return sorted((tuple(r) for r in df.collect()), key=str)


def conversations(seed, n):
    rng = random.Random(seed)
    return {i * 7: [(rng.choice(["user", "bot"]), rng.choice(["a", "bé", ""])) for _ in range(rng.randint(0, 5))] for i in range(n)}


@pytest.mark.parametrize("seed", [1, 2])
def test_prefix_trie(spark, seed, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PACKED", 12)  # many packed rows a node
    convs = conversations(seed, 60)
    rows = [(c, t, r, x, "z") for c, turns in convs.items() for t, (r, x) in enumerate(turns)] + [(None, 1, "user", "lost", "z")]
    random.Random(seed).shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth string").withColumn("text", F.when(F.col("text") != "", F.col("text")))
    ids = spark.createDataFrame([(c,) for c in convs] * 2, "conv_id long")
    assert trie_rows(prefix_trie.prefix_trie(turns, ids)) == brute_trie(convs)


def test_prefix_trie_hot_and_long(spark):
    """Half of the conversations are one text; one has 60 turns that two others share; turns repeat and tie."""
    long = [("user", str(i // 2)) for i in range(60)]
    convs = {c: [("user", "hi"), ("bot", "hello")] for c in range(40)} | {100: long, 101: long[:50], 102: long, 200: [("user", "hi")]}
    rows = [(c, t, r, x) for c, turns in convs.items() for t, (r, x) in enumerate(turns)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert trie_rows(prefix_trie.prefix_trie(turns)) == brute_trie(convs)
    tied = spark.createDataFrame([(1, None, "user", "b"), (1, 3, "user", "a"), (1, 3, "user", "a"), (2, 1, "user", "b")], turns.schema)
    assert [r[:4] for r in trie_rows(prefix_trie.prefix_trie(tied))] == [(1, 0, None, 2), (1, 1, 1, 2), (1, 2, 1, 1), (1, 3, 1, 1)]
    assert prefix_trie.prefix_trie(turns.limit(0)).count() == 0


def test_trie_query(spark, tmp_path):
    rng = random.Random(4)
    convs = {i: [("user", rng.choice("ab")) for _ in range(rng.randint(1, 8))] for i in [*range(90, 130), 205, 300, 311]}
    rows = [(c, t if t else None, r, x) for c, turns in convs.items() for t, (r, x) in enumerate(turns)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")

    def rebuilt(c):
        k = zlib.crc32(str(c).encode()) % 6
        return convs.get(c - c % 100, [])[:k] + convs[c][k:]

    assert trie_rows(registry.QUERIES["op11_prefix_trie"](spark, str(tmp_path))) == brute_trie({c: rebuilt(c) for c in convs})


# token counts
@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter()


ALPHABET = ["a", "e", "th", " ", "\n", "é", "é", "̣", "ß", "1", "'s", "'", "!!", "ing", "日", "\t", "<|endoftext|>", "<|", "|>", "İ", "가", "ᆨ", "🎉", "tion", "\x1c", "　", "Σ", "'re", "aaaa"]


def library(counter, text):
    return len(counter.tokenizer.encode(text, add_special_tokens=False))


def test_parts_as_the_library(counter):
    rng = random.Random(5)
    for _ in range(1500):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 100)))
        assert counter.count(text) == library(counter, text)


def test_splices(counter):
    """Chunks of random texts, with and without spaces, spliced at the first and at the last common token."""
    rng, seams = random.Random(6), 0
    for k in range(1500):
        letters = ALPHABET if k % 2 else [x for x in ALPHABET if not x.isspace()]
        text = "".join(rng.choice(letters) for _ in range(rng.randint(60, 200)))
        size, overlap = rng.choice([(60, 30), (48, 24), (80, 20)])
        count = max(1, -(-(len(text) - overlap) // size))
        ends = [len(text) if i == count - 1 else (i + 1) * size + overlap for i in range(count)]
        parts = [token_counts.encoded_chunk(counter, text[i * size : e], i * size, size, overlap, i == count - 1) for i, e in enumerate(ends)]
        common = [set(a[2]) & set(b[1]) for a, b in zip(parts, parts[1:], strict=False)]
        if all(common):
            seams += len(common)
            for pick in (min, max):
                places = [pick(c) for c in common]
                assert parts[-1][0] + sum(a[2][p] - b[1][p] for a, b, p in zip(parts, parts[1:], places, strict=False)) == library(counter, text), ascii(text)
    assert seams > 500


def test_token_counts(spark, odd, odd_rows, none, clash, counter):
    giant = "ab" * 3000  # no space: chunks hold parts of one word
    extra = [(500, giant, "en", "a", 1), (501, "aaaa" * 900 + " <|endoftext|> x", "en", "a", 1), (500, giant, "en", "a", 1)]
    docs = odd.unionAll(spark.createDataFrame(extra, odd.schema)).withColumn("n_bytes", F.lit("x")).withColumn("_k1", F.lit("y"))
    got = token_counts.token_counts(docs, size=512, overlap=64, limit=100)
    assert got.columns == [c for c in docs.columns if c != "n_bytes"] + ["n_bytes", "n_tokens", "over_limit"]
    want = sorted(((i, len((t or "").encode()), n := library(counter, t or ""), n > 100) for i, t, *_ in odd_rows + extra), key=str)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got.collect()), key=str) == want
    assert token_counts.token_counts(none).count() == 0 and token_counts.token_counts(clash).count() == len(odd_rows)
    with pytest.raises(ValueError, match="overlap"):
        token_counts.token_counts(odd, size=10, overlap=6)


def test_widening(spark, counter):
    """A text without any common token in its overlaps is cut again until it has one chunk."""
    text = "a" * 2000  # tokens of a run of one letter keep their distance from where the chunk starts
    long = spark.createDataFrame([(1, 2, text)], "_k1 long, _k2 long, _text string")
    first = token_counts.spliced(token_counts.encoded(long, 101, 40, None)).collect()
    assert [r["_n"] for r in first] == [None]
    assert [r["_n"] for r in token_counts.long_counts(long, None, 101, 40).collect()] == [library(counter, text)]


def test_count_query(spark, odd, odd_rows, counter, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["op12_token_counts"](spark, str(tmp_path))
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}
    assert sorted(((r["doc_id"], r["n_tokens"], r["over_limit"]) for r in got.collect()), key=str) == sorted(((i, n := library(counter, t or ""), n > 2048) for i, t, *_ in odd_rows), key=str)


def test_exact_dedup_shuffles_no_text(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    plan = registry.QUERIES["op10_exact_dedup"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    joins = plan[: plan.rindex("Join")]
    assert "text#" not in joins and "sha2" in plan[len(joins) :]
