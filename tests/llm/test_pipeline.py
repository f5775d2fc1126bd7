"""The pipeline against a brute-force version, stage by stage, and the entry points."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np


def mixed(rows):
    """rows (doc_id, text, source) as often as they are taken, by sorting."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    names = sorted(s for s in by if s is not None) + [None] * (None in by)
    total = {s: sum(size(t) for _, t, _ in by[s]) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, budget, target = set(names), 1.5 * sum(total.values()), {}
    while left:
        share = {s: budget * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] >= 2 * total[s]}
        for s in over or left:
            target[s] = 2.0 * total[s] if over else share[s]
        budget -= sum(target[s] for s in over)
        left = left - over if over else set()
    out = []
    for s in names:
        passes = int(target[s] // total[s]) if total[s] else 0
        rest = target[s] - passes * total[s]
        out += [r for r in by[s] for _ in range(passes)]
        used, groups = 0, defaultdict(list)
        for r in by[s]:
            groups[int(hashlib.md5(f"mix:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:15], 16)].append(r)
        for _, same in sorted(groups.items()):
            n = sum(size(t) for _, t, _ in same)
            if rest <= 0 or used + n > rest:
                if rest > 0 and used + n - rest < rest - used:
                    out += same
                break
            used += n
            out += same
    return out


def near(rows):
    sets = []
    for _, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    best = {}
    for g, r in zip(group, rows, strict=True):
        key = (r[0] is None, r[0] or 0)
        if g not in best or key < best[g][0]:
            best[g] = (key, r)
    return [r for _, r in best.values()]


def test_stages(spark, odd, odd_rows, none, clash):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as P
    from lakequill.llm.common import stored

    rows = [(i, t, s) for i, t, _, s, _ in odd_rows if any(c.isalpha() for c in t or "")]
    best = {}
    for r in rows:
        if r[1] not in best or (r[0] is not None and (best[r[1]][0] is None or r[0] > best[r[1]][0])):
            best[r[1]] = r
    expected = [rows, list(best.values())]
    expected.append(near(expected[-1]))
    expected.append(mixed(expected[-1]))
    docs = odd
    key = lambda r: (str(r[0]), hashlib.md5((r[1] or "").encode()).hexdigest())
    for (name, stage), want in zip(P.STAGES, expected, strict=False):
        docs = stored(stage(spark, docs, "unused"), "test")
        assert docs.columns == odd.columns
        if name in ("language ID", "near dedup", "mixing"):
            assert Counter(key(r) for r in docs.select("doc_id", "text").collect()) == Counter(map(key, want)), name
        else:  # rows that repeat id and text differ in nothing
            assert Counter(r["text"] for r in docs.collect()) == Counter(t for _, t, _ in want), name
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = Counter((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"]) for r in P.encode(spark, docs, "unused").collect())
    want = Counter()
    for i, t, _ in expected[-1]:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want[(str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())] += 1
    assert got == want
    for _, stage in P.STAGES:  # empty tables, and columns with the names of results
        assert stage(spark, none, "unused").count() == 0
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, clash, "unused").columns == clash.columns


def test_entry_points():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {n.split("_")[0] for n in names if re.match(r"op\d", n)} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_unlabelled_table_keeps_texts_with_letters(spark):
    """Without any label no prototype is learned; texts with letters stay all the same."""
    import corpus_pipeline

    rows = [(1, "some words", None, "a", 10), (2, "12 34", None, "a", 5), (3, None, None, "a", 0), (4, "", None, "a", 0), (5, "été", None, "b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.keep_languages(spark, docs, "").collect()) == [1, 5]
