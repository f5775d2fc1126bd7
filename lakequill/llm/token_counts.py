"""Token counts by overlap resynchronisation.

Huge texts are cut at fixed places into chunks that overlap, which any task may encode. In the
overlap, both encodings list their tokens with offsets. A token that both have, with the same start,
end and id, is a proven splice: in the left encoding it follows what it follows in the whole text,
in the right one it precedes what it precedes there, and a sequence of tokens in which every two
neighbours stand together in some valid encoding is the encoding of the whole (a merge that crosses
one of their boundaries would have crossed it there). The left chunk must go on for as many characters
as a special string or contraction may have, and the next character must not combine with what comes
before it. Where an overlap has no such token, the text is cut again with chunks and overlaps twice
as wide, until the text is one chunk.

Between the overlaps, parts of the text between spaces are counted one by one and remembered: no
token and no special string contains a space, and nothing combines with one.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill.llm.common import once, stored, table

CHUNK = 16_384  # characters from one chunk's start to the next's
OVERLAP = 256
CACHED = 400_000  # parts of texts that a worker remembers
LONG = 64  # longer ones aren't remembered


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Counter:
    """Counts as the library has them, without added special tokens, truncation or padding."""

    def __init__(self, path: str | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_vocabulary())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {"": 0}
        #: characters that decide how the one before them is cut: special strings and contractions
        self.ahead = max([3, *(len(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())])

    def learn(self, parts: Iterable[str]) -> None:
        new = [p for p in set(parts) if p not in self.known]
        if new:
            if len(self.known) + len(new) > CACHED:
                self.known = {"": 0}
                new = list(set(parts))
            self.known.update(zip(new, map(len, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))

    def count(self, text: str) -> int:
        parts = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        counts = list(map(self.known.get, parts))
        if None not in counts:
            return sum(counts)
        long = [p for p in parts if len(p) > LONG]
        short = [p for p in parts if len(p) <= LONG] if long else parts
        self.learn(short)
        known = self.known
        return sum(known[p] for p in short) + sum(len(self.tokenizer.encode(p, add_special_tokens=False)) for p in long)

    def tokens(self, text: str) -> list[tuple[int, int, int]]:
        """start, end, id."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        return [(a, b, i) for (a, b), i in zip(e.offsets, e.ids, strict=True)]


def joins(c: str) -> bool:
    """Whether a character may combine with the one before it: marks, and vowels and finals of Hangul."""
    return unicodedata.category(c)[0] == "M" or "ᅠ" <= c <= "ᇿ"


def places(tokens: list[tuple[int, int, int]], at: int) -> dict[int, int]:
    """Packed (start, end, id) of the tokens that share no character with a neighbour, with their number. at is added to offsets."""
    out = {}
    for k, (a, b, i) in enumerate(tokens):
        alone = (k == 0 or tokens[k - 1][1] <= a) and (k + 1 == len(tokens) or tokens[k + 1][0] >= b)
        if alone and 0 < b - a < 1 << 15:
            out[(a + at) << 31 | (b - a) << 16 | i] = k
    return out


def edge(text: str, size: int) -> int:
    """The first place from size on with a space, or the end."""
    found = [k for k in (text.find(c, size) for c in " \n\t\r") if k >= 0]
    return min(found, default=len(text))


def back_edge(text: str, size: int) -> int:
    """After the last space before size, or 0."""
    return max(text.rfind(c, 0, size) for c in " \n\t\r") + 1


def encoded_chunk(counter: Counter, text: str, at: int, size: int, overlap: int, last: bool) -> tuple[int, dict[int, int], dict[int, int]]:
    """Tokens of the chunk text, which starts at `at`, and the places of those in its left and in its right overlap."""
    head = edge(text, overlap) if at else 0
    tail = len(text) if last else back_edge(text, size)
    if head >= tail:
        left = right = counter.tokens(text)
        n, first, tail = len(left), 0, 0
    else:
        left, right = counter.tokens(text[:head]), counter.tokens(text[tail:])
        first = len(left) + counter.count(text[head:tail])
        n = first + len(right)
    heads = {p: k for p, k in places(left, at).items() if _end(p) - at <= overlap and not joins(text[_end(p) - at:][:1] or " ")} if at else {}
    tails = {p: k + first for p, k in places(right, at + tail).items() if p >> 31 >= at + size and _end(p) + counter.ahead <= at + len(text)} if not last else {}
    return n, heads, tails


def _end(place: int) -> int:
    return (place >> 31) + (place >> 16 & 0x7FFF)


ROW_KEY = ["_k1", "_k2"]
CHUNKS = "_k1 long, _k2 long, _chunk long, _last boolean, _tokens long, _heads array<long>, _head_at array<long>, _tails array<long>, _tail_at array<long>"


def encoded(long: DataFrame, size: int, overlap: int, path: str | None) -> DataFrame:
    """A row per chunk of long (_k1, _k2, _text): CHUNKS. Chunks are dealt over all tasks, whatever text they are of."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, text in (tuple(c[i].as_py() for c in batch.columns) for i in range(batch.num_rows)):
                count = max(1, -(-(len(text) - overlap) // size))  # what is left after the last full chunk is longer than the overlap
                for i in range(count):
                    end = len(text) if i == count - 1 else (i + 1) * size + overlap
                    yield pa.RecordBatch.from_pydict({"_k1": [k1], "_k2": [k2], "_chunk": [i], "_last": [i == count - 1], "_part": [text[i * size:end]]})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once(("token counts", path), lambda: Counter(path))
        for batch in batches:
            done = [encoded_chunk(counter, t, i * size, size, overlap, last) for i, last, t in zip(*(batch.column(c).to_pylist() for c in ("_chunk", "_last", "_part")), strict=True)]
            longs = lambda rows: pa.array(rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (*ROW_KEY, "_chunk", "_last")), pa.array([n for n, *_ in done], pa.int64()),
                 longs([list(h) for _, h, _ in done]), longs([list(h.values()) for _, h, _ in done]), longs([list(t) for *_, t in done]), longs([list(t.values()) for *_, t in done])],
                [c.split()[0] for c in CHUNKS.split(", ")])

    parts = long.mapInArrow(cut, "_k1 long, _k2 long, _chunk long, _last boolean, _part string")
    return parts.repartition(*ROW_KEY, "_chunk").mapInArrow(encode, CHUNKS)


def spliced(chunks: DataFrame) -> DataFrame:
    """_k1, _k2, _n of every text; _n is null if an overlap has no common token. Chunks of repeated rows count once."""
    chunks = chunks.dropDuplicates([*ROW_KEY, "_chunk"])
    left = chunks.where("NOT _last").select(*ROW_KEY, (F.col("_chunk") + 1).alias("_chunk"), "_tails", "_tail_at")
    right = chunks.where("_chunk > 0").select(*ROW_KEY, "_chunk", "_heads", "_head_at")
    common = F.array_min(F.array_intersect("_tails", "_heads"))
    at = lambda places, numbers: F.try_element_at(F.col(numbers), F.array_position(F.col(places), F.col("_common")).cast("int"))
    seams = left.join(right, [*ROW_KEY, "_chunk"]).withColumn("_common", common).select(*ROW_KEY, F.when(F.col("_common").isNotNull(), at("_tails", "_tail_at") - at("_heads", "_head_at")).alias("_n"))
    ends = chunks.where("_last").select(*ROW_KEY, F.col("_tokens").alias("_n"))
    return seams.unionAll(ends).groupBy(*ROW_KEY).agg(F.when(F.count("_n") == F.count(F.lit(1)), F.sum("_n")).alias("_n"))


def long_counts(long: DataFrame, path: str | None, size: int, overlap: int) -> DataFrame:
    """_k1, _k2, _n of every text of long (_k1, _k2, _text)."""
    done, todo = None, long
    while True:
        chunks = stored(encoded(todo, size, overlap, path), "token-chunks")  # read three times
        counts = stored(spliced(chunks), "token-counts")
        known = counts.where("_n IS NOT NULL")
        done = known if done is None else done.unionAll(known)
        failed = counts.where("_n IS NULL").select(*ROW_KEY)
        if failed.isEmpty():
            return done
        size, overlap = 2 * size, 2 * overlap
        todo = long.join(failed, ROW_KEY, "left_semi")


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", path: str | None = None, limit: int = 2048, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (more than limit tokens) added.

    Null texts count as empty: 0 bytes, 0 tokens. Texts are counted whole, as the library encodes
    them without added special tokens; special strings in a text are special tokens. Repeated rows
    each get their count. Columns of docs with the new names are replaced. An empty table gives
    none. `path` is the vocabulary file, readable on every executor; overlap is under half of size.
    """
    if 2 * overlap > size:
        raise ValueError("overlap must be at most half of size")
    names = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    kept = {c: f"_c{i}" for i, c in enumerate(names)}  # apart from the join's own names, and pruned if not read
    t = F.coalesce(F.col(text), F.lit(""))
    is_long = F.length(t) > size + overlap
    keys = [F.xxhash64(F.lit(k), F.col(id_col).cast("string"), t).alias(k) for k in ROW_KEY]

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = once(("token counts", path), lambda: Counter(path))
        for batch in texts:
            yield pd.Series([counter.count(x) for x in batch], dtype="int64")

    short = docs.where(~is_long).select(*names, F.octet_length(t).cast("long").alias("n_bytes"), count(t).alias("n_tokens"))
    long = docs.where(is_long)
    counts = long_counts(long.select(*keys, t.alias("_text")), path, size, overlap)
    rows = long.select(*[F.col(c).alias(k) for c, k in kept.items()], F.octet_length(t).cast("long").alias("_bytes"), *keys)
    found = rows.join(counts, ROW_KEY, "left").select(*[F.col(k).alias(c) for c, k in kept.items()], F.col("_bytes").alias("n_bytes"), F.col("_n").alias("n_tokens"))
    return short.unionAll(found).withColumn("over_limit", F.col("n_tokens") > limit)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
