"""Substring dedup by hashing paragraphs, lines and runs of sentences.

Units of a text are its paragraphs of several lines, its lines, and from every sentence on the
shortest run of sentences of RUN_WORDS words or more. A unit is normalised (A-Z lower-cased, white
space runs made one space) and hashed, whatever its length. Of units with one digest, over all
documents, the earliest ranked occurrence (least document id, then least offset) stays; the others
are removed from their texts. Removed spans keep the offsets that they had in the original text.

Runs of sentences find a passage that is set within longer lines, or that lines divide otherwise:
all its whole sentences, if they come to RUN_WORDS words. Lines and paragraphs find the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakequill.llm.common import stored, table

# Each pattern cuts the whole of a text into pieces; what follows a piece (line breaks, spaces) is part of it.
SENTENCE, LINE, PARAGRAPH = r"[^.!?\n]+[.!?\n ]*|[.!?\n ]+", r"[^\n]+\n*|\n+", r"[^\n]+(?:\n[^\n]+)*\n*|\n+"
RUN_WORDS = 12
PASSAGE = 30  # words from which on a run of repeated units counts as a passage
KINDS = ("paragraph", "line", "sentences")
LAST = (1 << 63) - 1  # ranks documents without an id


def pieces(text: str, pattern: str) -> list[tuple[int, int, list[bytes]]]:
    """Start, end and normalised words of each piece that has words."""
    found = ((m.start(), m.end(), m[0].encode("utf-8", "surrogatepass").lower().split()) for m in re.finditer(pattern, text))
    return [x for x in found if x[2]]


def text_units(text: str, kinds: tuple[str, ...] = KINDS, run_words: int = RUN_WORDS) -> Iterator[tuple[int, int, bytes]]:
    """Start, end (code points, end exclusive) and normalised text of every unit."""
    if "paragraph" in kinds:
        for a, b, ws in pieces(text, PARAGRAPH):
            if "\n" in text[a:b].rstrip("\n"):
                yield a, b, b" ".join(ws)
    lines = set()
    if "line" in kinds:
        for a, b, ws in pieces(text, LINE):
            lines.add((a, b))
            yield a, b, b" ".join(ws)
    if "sentences" in kinds:
        each = pieces(text, SENTENCE)
        every = [w for _, _, ws in each for w in ws]
        ends = np.cumsum([len(ws) for _, _, ws in each]).tolist()
        last, start = 0, 0
        for a, _, ws in each:
            while last < len(each) and ends[last] < start + run_words:
                last += 1
            if last == len(each):
                break
            if (a, each[last][1]) not in lines:
                yield a, each[last][1], b" ".join(every[start : ends[last]])
            start += len(ws)


def row_key(id_col: str, text: str) -> list:
    """Rank of a row (its id; null ranks last) and 32 bits of its text's hash, which tell rows of one id apart."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("_rank"), F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF)).alias("_h")]


def units(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", kinds: tuple[str, ...] = KINDS, run_words: int = RUN_WORDS) -> DataFrame:
    """h1, h2 (the digest), id (rank), at (start and text hash in one number, in order of start) and end of every unit."""
    names = ["h1", "h2", "id", "at", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for cut in range(0, whole.num_rows, 500):
                batch = whole.slice(cut, 500)
                ids, starts, ends, digests = [], [], [], []
                for i, h, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for a, b, content in text_units(t or "", kinds, run_words):
                        ids.append(i)
                        starts.append(a << 32 | h)
                        ends.append(b)
                        digests.append(sha256(content).digest()[:16])
                h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (h[:, 0], h[:, 1], ids, starts, ends)], names)

    return docs.select(*row_key(id_col, text), text).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def repeats(docs: DataFrame, **options) -> DataFrame:
    """One row per occurrence of a unit that occurs more than once: id, start, h, end, and whether it goes.

    The earliest occurrence stays, and so does one that overlaps the earliest within its own text.

    Units meet by digest in one shuffle. Those that make up a thousandth of all units or more, by an
    estimate from a sixteenth of the documents, are a thousand at most: their earliest occurrences
    are found by partial aggregation and broadcast, so that no task holds all of a frequent line.
    The estimate decides the way only, never the result.
    """
    found = stored(units(docs, **options), "line-units")
    digest = ["h1", "h2"]
    part = found.where(F.pmod(F.xxhash64("id", F.col("at").bitwiseAND(F.lit(0xFFFFFFFF))), F.lit(16)) == 0)
    often = F.count(F.lit(1)) * 1000 >= part.count()
    frequent = stored(part.groupBy(*digest).agg(often.alias("often")).where("often"), "line-frequent")
    first, last = F.min(F.struct("id", "at", "end")), F.max(F.struct("id", "at"))
    marked = found.join(F.broadcast(frequent), digest, "left")
    ends = marked.groupBy(*[F.when(F.col("often"), F.col(c)).alias(c) for c in digest]).agg(first.alias("fk"), last.alias("fm"))
    group = Window.partitionBy(*digest, F.when(F.col("fk").isNotNull(), F.col("at")))  # frequent units are dealt by place
    every = found.join(F.broadcast(ends), digest, "left").select("*", F.coalesce("fk", first.over(group)).alias("k"), F.coalesce("fm", last.over(group)).alias("m"))
    start, h = F.shiftright("at", 32).cast("int"), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF))
    own = (F.col("id") == F.col("k.id")) & (h == F.col("k.at").bitwiseAND(F.lit(0xFFFFFFFF)))
    return every.where((F.col("k.id") != F.col("m.id")) | (F.col("k.at") != F.col("m.at"))).select(
        "id", start.alias("start"), h.alias("h"), F.col("end").cast("int").alias("end"),
        (~own | (start >= F.col("k.end"))).alias("goes"), F.when(F.col("k.id") < LAST, F.col("k.id")).alias("keep_id"),
        F.shiftright("k.at", 32).cast("int").alias("keep_start"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans, which are in order and apart."""
    edges = [0, *(x for s in spans for x in s), len(text)]
    return "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


ADDED = {"clean_text": "string", "removed_spans": "string", "n_removed": "integer", "words_removed": "integer", "longest_repeat": "integer"}


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with these columns added, one row for each row:

    clean_text, the text without its removed units; removed_spans ("start:end" in original offsets,
    comma-joined); n_removed, their number; words_removed; and longest_repeat, the words of the
    longest run of units that occur elsewhere too, whether they stay or go.

    Null texts stay null and, like empty ones, have no units. Rows without an id rank last, in order
    of offset and hash. Rows that repeat an id and text in full rank alike: their units stay or go
    together. Columns of docs with the names that are added are replaced. An empty table gives no
    rows. A document's own spans are gathered by its row: no more than its text has.
    """
    found = repeats(docs, id_col=id_col, text=text, **options)
    spans = found.groupBy(F.col("id").alias("_id"), F.col("h").alias("_hash")).agg(F.collect_set(F.struct("start", "end", "goes")).alias("_spans"))
    names = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(*names, *row_key(id_col, text))
    rows = rows.join(spans, (F.col("_rank") == F.col("_id")) & (F.col("_h") == F.col("_hash")), "left").select(*names, "_spans")
    at, schema = names.index(text), docs.select(*names).schema
    for name, kind in ADDED.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                new: list[tuple] = []
                for t, found in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                    every = [(s["start"], s["end"], s["goes"]) for s in found or []]
                    gone = merged([(a, b) for a, b, goes in every if goes])
                    n_words = lambda a, b, t=t: len(t[a:b].encode("utf-8", "surrogatepass").split())
                    longest = max((n_words(a, b) for a, b in merged([(a, b) for a, b, _ in every])), default=0)
                    new.append((None if t is None else cut(t, gone), ",".join(f"{a}:{b}" for a, b in gone), len(gone), sum(n_words(a, b) for a, b in gone), longest))
                kinds = pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()
                added = [pa.array(c, k) for c, k in zip(zip(*new, strict=True), kinds, strict=True)] if new else [pa.array([], k) for k in kinds]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *added], [*names, *ADDED])

    return rows.mapInArrow(run, schema)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: what was removed from its text, and whether it holds a repeated passage."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs).select(
        "doc_id", "removed_spans", "n_removed", "words_removed", "longest_repeat", (F.col("longest_repeat") >= PASSAGE).alias("has_passage"),
        F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("clean_sha256"))


OP8_SQL = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
tiles AS (
    SELECT doc_id, 'p' AS kind, unnest(regexp_extract_all(t, '{PARAGRAPH}')) AS tile, generate_subscripts(regexp_extract_all(t, '{PARAGRAPH}'), 1) AS no FROM docs
    UNION ALL
    SELECT doc_id, 'l', unnest(regexp_extract_all(t, '{LINE}')), generate_subscripts(regexp_extract_all(t, '{LINE}'), 1) FROM docs
    UNION ALL
    SELECT doc_id, 's', unnest(regexp_extract_all(t, '{SENTENCE}')), generate_subscripts(regexp_extract_all(t, '{SENTENCE}'), 1) FROM docs
),
placed AS (
    SELECT doc_id, kind, no, tile, sum(length(tile)) OVER (PARTITION BY doc_id, kind ORDER BY no) AS stop,
           regexp_extract_all(translate(tile, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
    FROM tiles
),
worded AS (
    SELECT doc_id, kind, no, tile, (stop - length(tile))::INT AS start, stop::INT AS stop, ws,
           sum(len(ws)) OVER (PARTITION BY doc_id, kind ORDER BY no)::INT AS words
    FROM placed WHERE len(ws) > 0
),
texts AS (SELECT doc_id, list_sort(list({{'no': no, 'ws': ws}})) AS every FROM worded WHERE kind = 's' GROUP BY doc_id),
flat AS (SELECT doc_id, flatten(list_transform(every, lambda x: x.ws)) AS every FROM texts),
starts AS (SELECT doc_id, start, words - len(ws) AS before, words - len(ws) + {RUN_WORDS} AS need FROM worded WHERE kind = 's'),
stops AS (SELECT doc_id, stop, words FROM worded WHERE kind = 's'),
runs AS (
    SELECT s.doc_id, s.start, e.stop, array_to_string(list_slice(f.every, s.before + 1, e.words), ' ') AS content
    FROM starts s ASOF JOIN stops e ON s.doc_id = e.doc_id AND s.need <= e.words JOIN flat f ON f.doc_id = s.doc_id
),
units AS (
    SELECT doc_id, start, stop, array_to_string(ws, ' ') AS content FROM worded
    WHERE kind = 'l' OR (kind = 'p' AND contains(rtrim(tile, chr(10)), chr(10)))
    UNION ALL SELECT * FROM runs
),
known AS (SELECT content, min(struct_pack(i := doc_id, s := start, e := stop)) AS k FROM units GROUP BY content
          HAVING min(struct_pack(i := doc_id, s := start)) <> max(struct_pack(i := doc_id, s := start))),
found AS (SELECT DISTINCT doc_id, start, stop, doc_id <> k.i OR start >= k.e AS goes FROM units JOIN known USING (content)),
both_ways AS (SELECT doc_id, start, stop, 'any' AS which FROM found UNION SELECT doc_id, start, stop, 'goes' FROM found WHERE goes),
edges AS (
    SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY doc_id, which ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens
    FROM both_ways
),
islands AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, which ORDER BY start, stop) AS no FROM edges),
spans AS (SELECT doc_id, which, no, min(start) AS a, max(stop) AS b FROM islands GROUP BY ALL),
counted AS (
    SELECT doc_id, which, a, b, len(regexp_extract_all(substring(t, a + 1, b - a), '[^\x20\x09-\x0D]+')) AS n,
           substring(t, a - (a - lag(b, 1, 0) OVER w) + 1, a - lag(b, 1, 0) OVER w) AS ahead,
           CASE WHEN lead(a) OVER w IS NULL THEN substring(t, b + 1) ELSE '' END AS rest
    FROM spans JOIN docs USING (doc_id) WINDOW w AS (PARTITION BY doc_id, which ORDER BY a)
),
gone AS (SELECT doc_id, string_agg(a || ':' || b, ',' ORDER BY a) AS removed_spans, count(*) AS n, sum(n) AS words, string_agg(ahead || rest, '' ORDER BY a) AS clean
         FROM counted WHERE which = 'goes' GROUP BY doc_id),
longest AS (SELECT doc_id, max(n) AS n FROM counted WHERE which = 'any' GROUP BY doc_id)
SELECT doc_id, coalesce(removed_spans, '') AS removed_spans, coalesce(gone.n, 0)::INT AS n_removed, coalesce(words, 0)::INT AS words_removed,
       coalesce(longest.n, 0)::INT AS longest_repeat, coalesce(longest.n, 0) >= {PASSAGE} AS has_passage, sha256(coalesce(clean, t)) AS clean_sha256
FROM docs LEFT JOIN gone USING (doc_id) LEFT JOIN longest USING (doc_id)
"""
