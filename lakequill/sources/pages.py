"""Pages of PDF files and slides of presentations as rows, by table functions.

    spark.sql("SELECT f.name, p.* FROM files f, LATERAL page_rows(f.content) p")

A file that can't be read gives one row with an error. PDF text comes from the first extractor that
finds LEAST_TEXT characters in the file: installed libraries first, then the reader below, which
knows plain and deflated content streams with literal or hexadecimal strings.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill.sources.files import pipe_rows, section_title, tag, texts

LEAST_TEXT = 100  # an extractor that finds less is passed over if another one finds more
GAP = 20  # units between strings of a line that make them cells

OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b((?:(?!stream\r?\n).)*?(?:stream\r?\n.*?endstream\s*)?)\bendobj", re.DOTALL)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
TOKEN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\[|\]|[-+]?\d*\.?\d+|/[^\s/<>\[\]()]+|[A-Za-z'\"*]+", re.DOTALL)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def pdf_string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1].strip() == b"" else ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.DOTALL)
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


def placed_strings(content: bytes) -> list[tuple[float, float, str]]:
    """x, y and text of the strings that a content stream shows, from its moves (Td, TD, Tm, T*) and shows (Tj, TJ, ', ")."""
    out, args, x, y, lead = [], [], 0.0, 0.0, 12.0
    number = lambda k: float(args[k])
    for token in TOKEN.findall(content):
        if not re.fullmatch(rb"[A-Za-z'\"*]+", token):
            args.append(token)
            continue
        try:
            if token == b"BT":
                x = y = 0.0
            elif token in (b"Td", b"TD"):
                x, y = x + number(-2), y + number(-1)
                lead = -number(-1) if token == b"TD" else lead
            elif token == b"Tm":
                x, y = number(-2), number(-1)
            elif token == b"TL":
                lead = number(-1)
            elif token in (b"T*", b"'", b'"'):
                y -= lead
            if token in (b"Tj", b"TJ", b"'", b'"'):
                out.append((x, y, "".join(pdf_string(a) for a in args if a[:1] in (b"(", b"<"))))
        except (IndexError, ValueError):
            pass  # a broken operator shows nothing
        args = []
    return out


def lines_of(strings: list[tuple[float, float, str]]) -> list[list[str]]:
    """The cells of each line, top down: strings of one height, apart if GAP lies between their starts."""
    rows: dict[float, list[tuple[float, str]]] = {}
    for x, y, text in strings:
        rows.setdefault(round(y, 1), []).append((x, text))
    out = []
    for _, parts in sorted(rows.items(), reverse=True):
        cells, last = [], None
        for x, text in sorted(parts, key=lambda p: p[0]):
            if last is not None and x - last < GAP:
                cells[-1] += text
            else:
                cells.append(text)
            last = x
        out.append(cells)
    return out


def laid_out(lines: list[list[str]]) -> tuple[str, list[list[list[str]]]]:
    """Text of the lines that are no table, and tables: two lines or more in a row with as many cells, two at least."""
    text, tables, run = [], [], []
    for cells in [*lines, []]:
        if run and len(cells) != len(run[0]):
            if len(run) > 1:
                tables.append(run)
            else:
                text += [" ".join(r) for r in run]
            run = []
        if len(cells) > 1:
            run.append(cells)
        elif cells:
            text.append(cells[0])
    return "\n".join(text), tables


Pages = list[tuple[str, list[list[list[str]]]]]


def plain_pdf(data: bytes) -> Pages:
    objects = {int(m[1]): m[2] for m in OBJECT.finditer(data)}
    refs = lambda body, name: [int(n) for n in re.findall(rb"(\d+)\s+\d+\s+R", (re.search(rb"/" + name + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body) or [b"", b""])[1])]

    def leaves(n: int, depth: int = 0) -> Iterator[bytes]:
        body = objects.get(n, b"")
        if depth < 50 and re.search(rb"/Type\s*/Pages\b", body):
            for kid in refs(body, b"Kids"):
                yield from leaves(kid, depth + 1)
        elif re.search(rb"/Type\s*/Page\b", body):
            yield body

    roots = [r for body in objects.values() if re.search(rb"/Type\s*/Catalog\b", body) for r in refs(body, b"Pages")]
    if not roots:
        raise ValueError("no page tree")
    out = []
    for page in leaves(roots[0]):
        parts = []
        for n in refs(page, b"Contents"):
            if m := STREAM.search(objects.get(n, b"")):
                head, length = m.string[: m.start()], re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", m.string[: m.start()])
                body = m.string[m.start(1) : m.start(1) + int(length[1])] if length else m[1]
                parts.append(zlib.decompressobj().decompress(body) if b"FlateDecode" in head else body)
        out.append(laid_out(lines_of(placed_strings(b"\n".join(parts)))))
    return out


def with_pdfplumber(data: bytes) -> Pages:
    import pdfplumber

    with pdfplumber.open(io.BytesIO(data)) as pdf:
        return [(p.extract_text() or "", p.extract_tables() or []) for p in pdf.pages]


def with_pypdf(data: bytes) -> Pages:
    import pypdf

    return [(p.extract_text() or "", []) for p in pypdf.PdfReader(io.BytesIO(data)).pages]


EXTRACTORS: tuple[Callable[[bytes], Pages], ...] = (with_pdfplumber, with_pypdf, plain_pdf)


def pdf_pages(data: bytes, extractors: tuple[Callable[[bytes], Pages], ...] = EXTRACTORS) -> Pages:
    """The pages from the first extractor that finds LEAST_TEXT characters, else from the one that finds most; ValueError if none finds any."""
    best, error = [], "no text"
    for extract in extractors:
        try:
            pages = extract(data)
        except ImportError:
            continue
        except Exception as e:  # the next one may read it
            error = f"{type(e).__name__}: {e}"
            continue
        size = lambda ps: sum(len(t.strip()) + sum(len(pipe_rows(x)) for x in tables) for t, tables in ps)
        if size(pages) >= LEAST_TEXT:
            return pages
        best = max(best, pages, key=size)
    if not any(t.strip() or tables for t, tables in best):
        raise ValueError(error)
    return best


def page_text(text: str, tables: list[list[list[str]]], page: int) -> str:
    """A page's text with its tables after it, each under its marker."""
    parts = [text.strip()] + [f"[Table {i} on page {page}]\n{pipe_rows(rows)}" for i, rows in enumerate(tables, 1)]
    return "\n\n".join(p for p in parts if p).replace("\x00", "")


def pptx_slides(data: bytes) -> list[tuple[int, str, str | None]]:
    """Number, text and title of the slides that have text. The title is that of the title placeholder, or the first line."""
    z = zipfile.ZipFile(io.BytesIO(data))
    found = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    out = []
    for no, name in found:
        title, lines = None, []
        for shape in (x for x in ElementTree.fromstring(z.read(name)).iter() if tag(x) in ("sp", "graphicFrame")):
            own = [t for p in shape.iter() if tag(p) == "p" if (t := texts(p).strip())]
            if any(tag(x) == "ph" and x.attrib.get("type") in ("title", "ctrTitle") for x in shape.iter()) and own:
                title = title or own[0]
            lines += own
        if lines:
            out.append((no, "\n".join(lines), title or lines[0]))
    return out


PAGE_SCHEMA = "page_number int, text string, section_title string, error string"
SLIDE_SCHEMA = "slide_number int, text string, title string, error string"


class PageRows:
    """page_number, text, section_title of each page, or one row with an error."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            pages = pdf_pages(bytes(content or b""))
        except Exception as e:
            yield None, None, None, str(e) or type(e).__name__
            return
        for no, (text, tables) in enumerate(pages, 1):
            yield no, page_text(text, tables, no), section_title(text), None


class SlideRows:
    """slide_number, text, title of each slide with text, or one row with an error."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            slides = pptx_slides(bytes(content or b""))
        except Exception as e:
            yield None, None, None, str(e) or type(e).__name__
            return
        for no, text, title in slides:
            yield no, text, title, None
        if not slides:
            yield None, None, None, "no text"


def register(spark: SparkSession) -> list[str]:
    """page_rows(content) and slide_rows(content) for SQL."""
    spark.udtf.register("page_rows", F.udtf(PageRows, returnType=PAGE_SCHEMA))
    spark.udtf.register("slide_rows", F.udtf(SlideRows, returnType=SLIDE_SCHEMA))
    return ["page_rows", "slide_rows"]


def expanded(files: DataFrame, function: str, content: str = "content") -> DataFrame:
    """files, but for the content, with the rows that page_rows or slide_rows gives for each."""
    register(files.sparkSession)
    kept = ", ".join(f"f.`{c}`" for c in files.columns if c != content)
    return files.sparkSession.sql(f"SELECT {kept}, t.* FROM {{files}} AS f, LATERAL {function}(f.`{content}`) AS t", files=files)


def written_pdf(pages: list[list[list[str]]], deflate: bool = True) -> bytes:
    """A plain PDF file: pages of lines of cells, one string each, for export and tests."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (3 + 2 * i) for i in range(len(pages))) + b"] /Count %d >>" % len(pages)]
    for i, lines in enumerate(pages):
        ops = [b"BT /F1 10 Tf"]
        for k, cells in enumerate(lines):
            for j, cell in enumerate(cells):
                ops.append(b"1 0 0 1 %d %d Tm <FEFF%s> Tj" % (40 + 120 * j, 100_000 - 12 * k, cell.encode("utf-16-be").hex().encode()))
        body = b"\n".join([*ops, b"ET"])
        body = zlib.compress(body) if deflate else body
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (4 + 2 * i))
        objects.append(b"<< /Length %d%s >>\nstream\n" % (len(body), b" /Filter /FlateDecode" if deflate else b"") + body + b"\nendstream")
    out, at = b"%PDF-1.4\n", []
    for n, o in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n" % n + o + b"\nendobj\n"
    table = b"".join(b"%010d 00000 n \n" % a for a in at)
    return out + b"xref\n0 %d\n0000000000 65535 f \n" % (len(at) + 1) + table + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (len(at) + 1, len(out))
