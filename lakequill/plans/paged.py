"""Queries over pages and slides: files are made from the tables, read as files, and cut into rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.operators import chunking
from lakequill.plans.registry import query
from lakequill.sources import pages

LINES = 20  # of a page


def pdf_files(t) -> DataFrame:
    """doc_id, content: each document as a PDF file of LINES lines a page, with a table of its columns on every page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = []
            for text, lang, source in zip(b["text"], b["lang"], b["source"], strict=True):
                lines = text.split("\n")
                table = [["language", lang], ["source", source]]
                made.append(pages.written_pdf([[[x] for x in lines[i : i + LINES]] + table for i in range(0, len(lines), LINES)]))
            yield pd.DataFrame({"doc_id": b["doc_id"], "content": made})

    whole = t.documents.select("doc_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    return whole.mapInPandas(run, "doc_id long, content binary")


def pptx_file(slides: list[tuple[int, str, str]]) -> bytes:
    """A presentation of (number, title, text), with a paragraph a line."""
    out = io.BytesIO()
    paragraph = lambda t: f"<a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p>"
    with zipfile.ZipFile(out, "w") as z:
        for no, title, text in slides:
            head = f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:txBody>{paragraph(title)}</p:txBody></p:sp>'
            body = f"<p:sp><p:txBody>{''.join(paragraph(x) for x in text.split(chr(10)))}</p:txBody></p:sp>"
            z.writestr(f"ppt/slides/slide{no}.xml", f'<p:sld xmlns:p="p" xmlns:a="a"><p:spTree>{head}{body}</p:spTree></p:sld>')
    return out.getvalue()


def pptx_files(t) -> DataFrame:
    """conv_id, content: each conversation as a presentation with a slide a turn, its role as title."""

    def make(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("turn")
        return pd.DataFrame({"conv_id": g["conv_id"].iloc[:1], "content": [pptx_file(list(zip((g["turn"] + 1).tolist(), g["role"], g["text"], strict=True)))]})

    whole = t.conversations.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    return whole.groupBy("conv_id").applyInPandas(make, "conv_id long, content binary")


@query(r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
p AS (SELECT *, unnest(range(0, greatest(len(lines), 1), 20)) AS i FROM d),
b AS (SELECT doc_id, (i // 20 + 1)::INT AS page_number, regexp_replace(array_to_string(lines[i + 1:i + 20], chr(10)), '^\s+|\s+$', '', 'g') AS body, lang, source FROM p)
SELECT doc_id, page_number, sha256((CASE WHEN body = '' THEN '' ELSE body || chr(10) || chr(10) END) || '[Table 1 on page ' || page_number || ']' || chr(10) || 'language | ' || lang || chr(10) || 'source | ' || source) AS digest FROM b""")
def pdf_page_rows(t):
    """Pages of PDF files with their tables, by a table function called laterally."""
    rows = pages.expanded(pdf_files(t), "page_rows")
    return rows.where("error IS NULL").select("doc_id", "page_number", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query()
def pdf_page_chunks(t):
    """The pages' chunks, with sections carried forward."""
    rows = pages.expanded(pdf_files(t), "page_rows").where("error IS NULL")
    return chunking.page_chunks(rows, doc="doc_id", page="page_number", text="text", title="section_title")


@query(r"""WITH s AS (SELECT conv_id, turn, role, list_filter(list_transform(list_prepend(coalesce(role, ''), string_split(coalesce(text, ''), chr(10))), lambda x: trim(x)), lambda x: x <> '') AS lines FROM conversations)
SELECT conv_id, (turn + 1)::INT AS slide_number, turn::INT AS chunk_index, coalesce(nullif(trim(role), ''), lines[1]) AS title, sha256(array_to_string(lines, chr(10))) AS digest FROM s WHERE length(array_to_string(lines, chr(10))) >= 10""")
def pptx_slide_chunks(t):
    """Slides of presentations, one chunk each."""
    rows = pages.expanded(pptx_files(t), "slide_rows").where("error IS NULL")
    return chunking.slide_chunks(rows, slide="slide_number", text="text").select("conv_id", "slide_number", "chunk_index", "title", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
