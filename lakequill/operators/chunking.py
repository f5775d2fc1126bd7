"""Splitting texts into chunks."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakequill.functions import text as T
from lakequill.params import DEFAULT

# Separators from the strongest to the weakest.
SEPARATORS = ("\n\n\n", "\n\n", "\n", ". ", "! ", "? ", "; ", ": ", ", ", " ", "")
CJK = re.compile("[一-鿿぀-ゟ゠-ヿ가-힯]")
TABLE = re.compile(r"\[Table \d+ on page \d+\]")
JS_START = re.compile(r"^(?:export\s+)?(?:(?:async\s+)?(?:function|class)\s+\w|const\s+\w+\s*=\s*(?:async\s*)?\()", re.MULTILINE)


def by_characters(text: str, size: int, overlap: int) -> list[str]:
    """Windows of size characters, each starting overlap before the last one's end; trimmed, blanks dropped."""
    step = size - overlap
    return [piece for at in range(0, len(text), step) if (piece := text[at : at + size].strip())]


def by_separators(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces ended by the strongest separator present, gathered up to size.

    A full chunk seeds the next with its last `overlap` characters; a piece that is itself too long
    is split by the weaker separators and seeds nothing.
    """
    if len(text) <= size:
        return [text] if text else []
    strongest = next((s for s in separators if not s or s in text), "")
    if not strongest:
        return by_characters(text, size, overlap)
    weaker = separators[separators.index(strongest) + 1 :]
    *ended, last = text.split(strongest)
    out: list[str] = []
    held = ""
    for piece in [p + strongest for p in ended] + [last]:
        if len(piece) > size:
            out += [held.strip(), *by_separators(piece, size, overlap, weaker)]
            held = ""
        elif len(held) + len(piece) > size:
            out.append(held.strip())
            held = (held[-overlap:] if overlap > 0 else "") + piece
        else:
            held += piece
    return [c for c in [*out, held.strip()] if c.strip()]


def split_table(table: str, most: int) -> list[str]:
    """A table's rows in pieces of up to most characters, each with the header lines."""
    if len(table) <= most:
        return [table]
    rows = table.split("\n")
    head, rest = rows[:2] if TABLE.match(rows[0]) else rows[:1], rows[2:] if TABLE.match(rows[0]) else rows[1:]
    out, held = [], list(head)
    for row in rest:
        if len("\n".join([*held, row])) > most and len(held) > len(head):
            out.append("\n".join(held))
            held = list(head)
        held.append(row)
    return [*out, "\n".join(held)] if len(held) > len(head) or not out else out


def split_with_tables(text: str, size: int, overlap: int, table_size: int) -> list[str]:
    """Each table from its marker to the next one or the end, the text before the first as usual."""
    out, at = [], 0
    for m in re.finditer(r"\[Table \d+ on page \d+\].*?(?=\[Table \d+ on page \d+\]|\Z)", text, re.DOTALL):
        out += by_separators(text[at : m.start()].strip(), size, overlap)
        out += split_table(m[0].strip(), table_size)
        at = m.end()
    return out + by_separators(text[at:].strip(), size, overlap)


def chunk_text(text: str | None, size: int = 0, overlap: int = 0, table_size: int = DEFAULT.table_chunk_size, least: int = DEFAULT.min_chunk) -> list[str]:
    """Chunks of a text; 0 means the default size or overlap. Texts up to size are one chunk."""
    size, overlap = size or DEFAULT.chunk_size, overlap or DEFAULT.chunk_overlap
    text = (text or "").strip()
    if len(text) <= size:
        return [text] if text else []
    if len(CJK.findall(text)) > 0.1 * len(text):
        found = by_characters(text, size, overlap)
    elif TABLE.search(text):
        found = split_with_tables(text, size, overlap, table_size)
    else:
        found = by_separators(text, size, overlap)
    return [c.strip() for c in found if len(c.strip()) >= least]


def chunk_python(source: str) -> list[str]:
    """What stands before the first top-level function or class, then each of them; chunk_text if it isn't Python."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return chunk_text(source)
    lines = source.split("\n")
    tops = [n for n in tree.body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
    if not tops:
        return chunk_text(source)
    starts = [min([n.lineno, *(d.lineno for d in n.decorator_list)]) for n in tops]
    parts = ["\n".join(lines[: starts[0] - 1])] + ["\n".join(lines[a - 1 : n.end_lineno]) for a, n in zip(starts, tops, strict=True)]
    return [p.strip() for p in parts if len(p.strip()) >= DEFAULT.min_chunk]


def chunk_js(source: str) -> list[str]:
    """Blocks from one top-level declaration to the next; chunk_text if there is none."""
    starts = [m.start() for m in JS_START.finditer(source)]
    if not starts:
        return chunk_text(source)
    cuts = [0, *starts, len(source)]
    return [p for a, b in zip(cuts, cuts[1:], strict=False) if len(p := source[a:b].strip()) >= DEFAULT.min_chunk]


def chunk_email(text: str, size: int = DEFAULT.chunk_size) -> list[str]:
    return [text.strip()] if 0 < len(text.strip()) <= 2 * size else chunk_text(text, size)


CHUNKERS = {"CODE_PYTHON": chunk_python, "CODE_JS": chunk_js, "CODE_TS": chunk_js, "EMAIL": chunk_email}
VERSIONS = {k: f"{k.lower()}-1" for k in CHUNKERS} | {"*": "text-1"}


def chunks(docs: DataFrame, *, id_col: str = "doc_id", carry: tuple[str, ...] = (), text: str = "text", doc_type: str | None = None, size: int = 0, overlap: int = 0) -> DataFrame:
    """id, carried columns, chunk_index, chunk_text of every document, by the chunker of its type. Narrow: no shuffle."""
    own = [id_col, *carry]
    n = len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [CHUNKERS[k](t or "") if k in CHUNKERS else chunk_text(t, size, overlap) for t, k in zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist(), strict=True)]
            at = pa.array([i for i, p in enumerate(parts) for _ in p], pa.int64())
            index = pa.array([k for p in parts for k in range(len(p))], pa.int32())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns[:n]), index, pa.array([c for p in parts for c in p], pa.string())], [*own, "chunk_index", "chunk_text"])

    rows = docs.select(*own, F.col(text).alias("_text"), (F.col(doc_type) if doc_type else F.lit("TXT")).alias("_kind"))
    return rows.mapInArrow(run, docs.select(*own).schema.add("chunk_index", "integer").add("chunk_text", "string"))


def char_chunks(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", size: int = DEFAULT.chunk_size, overlap: int = DEFAULT.chunk_overlap, least: int = DEFAULT.min_chunk) -> DataFrame:
    """Character windows without leaving the JVM: id, chunk_index (over all windows), chunk_text."""
    step = size - overlap
    at = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step)))
    rows = docs.select(id_col, text, F.explode(at).alias("_at"))
    out = rows.select(id_col, (F.col("_at") / step).cast("int").alias("chunk_index"), F.trim(F.substring(text, F.col("_at") + 1, F.lit(size))).alias("chunk_text"))
    return out.where(F.length("chunk_text") >= least)


def carry_sections(pages: DataFrame, *, doc: str, page: str, title: str) -> DataFrame:
    """title carried forward to the pages after it, within a document."""
    so_far = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn(title, F.last(title, ignorenulls=True).over(so_far))


def page_chunks(pages: DataFrame, *, doc: str, page: str, text: str, title: str, size: int = 0, overlap: int = 0) -> DataFrame:
    """Chunks of pages with their page number and section, indexed through the document."""
    carried = carry_sections(pages, doc=doc, page=page, title=title)
    parts = chunks(carried, id_col=doc, carry=(page, title), text=text, size=size, overlap=overlap)
    order = Window.partitionBy(doc).orderBy(page, "chunk_index")
    return parts.where(F.length("chunk_text") >= DEFAULT.min_chunk).select(
        doc, F.col(page).alias("page_number"), F.col(title).alias("section_title"), (F.row_number().over(order) - 1).alias("chunk_index"), "chunk_text")


def slide_chunks(slides: DataFrame, *, slide: str, text: str) -> DataFrame:
    """One chunk a slide of min_chunk characters or more; the index is the slide's place, gaps kept."""
    return slides.where(F.length(F.trim(text)) >= DEFAULT.min_chunk).withColumn("chunk_index", F.col(slide) - 1)


def markdown_fragments(docs: DataFrame, *, id_col: str, text: str) -> DataFrame:
    """id, anchor, title, level, fragment: each heading's text up to the next of its level or higher.

    Anchors are slugs; those that repeat in a document get -1, -2 and so on.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                heads = [(m.start(), len(m[1]), m[2].strip()) for m in re.finditer(r"^(#{1,6})\s+(.+)$", t or "", re.MULTILINE)]
                for n, (start, level, title) in enumerate(heads):
                    end = next((a for a, other, _ in heads[n + 1 :] if other <= level), len(t))
                    at.append(i)
                    rows.append((n, level, title, t[start:end].strip()))
            kinds = pa.int32(), pa.int32(), pa.string(), pa.string()
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *columns], [id_col, "no", "level", "title", "fragment"])

    kind = dict(docs.dtypes)[id_col]
    found = docs.select(id_col, text).mapInArrow(run, f"{id_col} {kind}, no int, level int, title string, fragment string").withColumn("_slug", T.slug(F.col("title")))
    again = F.row_number().over(Window.partitionBy(id_col, "_slug").orderBy("no")) - 1
    return found.withColumn("anchor", F.when(again > 0, F.concat_ws("-", "_slug", again)).otherwise(F.col("_slug"))).drop("_slug")


def adjacent(chunks_: DataFrame, wanted: DataFrame, *, doc: str, index: str = "chunk_index", window: int = 1) -> DataFrame:
    """The chunks within `window` (5 at most) of the wanted (doc, index), live ones alone if there is deleted_at.

    Each wanted row names the 2 * window + 1 indexes that it covers, so this is an equi-join.
    """
    w = max(0, min(5, window))
    cover = wanted.select(F.col(doc), F.explode(F.sequence(F.col(index) - w, F.col(index) + w)).alias(index)).distinct()
    live = chunks_.where("deleted_at IS NULL") if "deleted_at" in chunks_.columns else chunks_
    return live.join(cover, [doc, index])
