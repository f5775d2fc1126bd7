"""BPE encoding and decoding by dynamic programming over prefixes.

A byte-level BPE encoding of a prefix ends in exactly one token. For every prefix of a word the
tokens that end there come from an automaton over the vocabulary; the one that is compatible with
the last token of the prefix before it is stored, and following these back from the end gives the
ids. Two tokens are compatible if no merge across their boundary would happen before the merges
that make the two, so the merges of the word never have to be replayed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill.llm.common import table

# The pre-tokenizer's pattern and white space of byte-level BPE.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
CACHED = 400_000  # encoded pieces, encoded words and pairs of tokens, of each, that a worker holds at once
LONG = 64  # pieces above this many characters aren't cached


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str | None = None):
        with open(path or default_vocabulary(), encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_letters().items()}
        raw = lambda s: bytes(back[c] for c in s).decode("latin-1")  # noqa: E731  one character a byte
        ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: s.encode("latin-1") for s, i in ids.items()} | {i: s.encode() for s, i in self.special.items()}
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, (a, b) in enumerate((raw(a), raw(b)) for a, b in merges):
            pair = ids[a], ids[b]
            self.rank.setdefault(pair, r)
            self.parts.setdefault(ids[a + b], pair)
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.packed = {i: i.to_bytes(4, "little") for i in self.bytes_of}
        self.spines: tuple[dict, dict] = {}, {}
        self.automaton = ahocorasick.Automaton()
        for s, i in ids.items():
            if len(s) == 1 or self.whole(i):
                self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        self.find = regex.compile(PATTERN).findall
        self.gaps = re.compile(rf"[{SPACE}]{{3}}").search
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def spine(self, t: int, side: int) -> list[tuple[int, float]]:
        """The tokens at one edge of t (side 1: its right edge) with the rank of the merge that ends each."""
        known = self.spines[side].get(t)
        if known is None:
            known, until, x = [], float("inf"), t
            while True:
                known.append((x, until))
                if x not in self.parts:
                    break
                until = self.rank[self.parts[x]]
                x = self.parts[x][side]
            self.spines[side][t] = known
        return known

    def whole(self, t: int) -> bool:
        """Whether the bytes of t are encoded as t alone."""
        if t not in self.parts:
            return False
        left, right = self.parts[t]
        own = self.rank[left, right]
        return all(own <= r for r in self.crossing(left, right))

    def crossing(self, left: int, right: int) -> Iterator[int]:
        """Ranks of merges across the boundary that come before the edges are merged away.

        Of equal ranks the one further left comes first.
        """
        for a, a_until in self.spine(left, 1):
            for b, b_until in self.spine(right, 0):
                r = self.rank.get((a, b))
                if r is not None and r < a_until and r <= b_until:
                    yield r

    def compatible(self, key: int) -> bool:
        """key: the left token times 2**20, plus the right one."""
        if len(self.pairs) >= CACHED:
            self.pairs.clear()
        known = self.pairs[key] = next(self.crossing(key >> 20, key & 0xFFFFF), None) is None
        return known

    def encode_word(self, word: str) -> bytes:
        """Ids of one pre-token, given as one character a byte."""
        n = len(word)
        last, start, pairs = [-1] * n, [0] * n, self.pairs
        for end, (t, length) in self.automaton.iter(word):
            if last[end] < 0:
                first = end - length
                if first >= 0:
                    left = last[first]
                    if left < 0:
                        continue
                    key = left << 20 | t
                    ok = pairs.get(key)
                    if ok is False or (ok is None and not self.compatible(key)):
                        continue
                last[end], start[end] = t, first
        out, end = [], n - 1
        while end >= 0:
            out.append(self.packed[last[end]])
            end = start[end]
        out.reverse()
        return b"".join(out)

    def encode_piece(self, piece: str) -> bytes:
        words = self.words
        out = []
        for w in self.find(piece):
            ids = words.get(w)
            if ids is None:
                ids = self.encode_word(w if w.isascii() else w.encode().decode("latin-1"))
                if len(w) <= LONG:
                    if len(words) >= CACHED:
                        words.clear()
                    words[w] = ids
            out.append(ids)
        return b"".join(out)

    def encode_plain(self, text: str) -> bytes:
        """Ids of a text without special tokens, as little-endian unsigned 32-bit integers.

        Cut at single spaces first, with the space left on the right part: pre-tokens never go
        over such a cut unless three or more white space characters meet.
        """
        if self.gaps(text):
            words, lead = self.find(text), ""
        else:
            words, lead = text.split(" "), " "
        known, out = self.pieces, []
        for k, w in enumerate(words):
            if k:
                w = lead + w  # noqa: PLW2901
            ids = known.get(w)
            if ids is None:
                ids = self.encode_piece(w)
                if len(w) <= LONG:
                    if len(known) >= CACHED:
                        known.clear()
                    known[w] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if not self.specials or not any(s in text for s in self.special):
            return self.encode_plain(text)
        return b"".join(np.uint32(self.special[x]).astype("<u4").tobytes() if k % 2 else self.encode_plain(x) if x else b"" for k, x in enumerate(self.specials.split(text)))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, *, text: str = "text", path: str | None = None) -> DataFrame:
    """docs with n_tokens, ids (binary, little-endian unsigned 32-bit integers) and decoded added.

    Null texts count as empty ones: 0 tokens. Texts are encoded whole. Columns of docs that have
    these names are replaced. `path` is the vocabulary file, readable on every executor.
    """
    kept = [c for c in docs.columns if c not in ("n_tokens", "ids", "decoded")]
    at = kept.index(text)
    schema = docs.select(*kept).schema.add("n_tokens", "long").add("ids", "binary").add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(path)
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                ids = [bpe.encode(t) if t else b"" for t in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())],
                    [*kept, "n_tokens", "ids", "decoded"])

    return docs.select(*kept).mapInArrow(run, schema)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
