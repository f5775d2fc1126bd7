"""Reading documents: files of many kinds to text, by one binary scan."""

from __future__ import annotations

import email
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Document types by extension.
TYPES = {
    ".pdf": "PDF", ".docx": "DOCX", ".txt": "TXT", ".md": "MD", ".pptx": "PPTX", ".py": "CODE_PYTHON", ".js": "CODE_JS", ".ts": "CODE_TS",
    ".eml": "EMAIL", ".png": "IMAGE", ".jpg": "IMAGE", ".jpeg": "IMAGE", ".gif": "IMAGE", ".webp": "IMAGE", ".xlsx": "EXCEL",
}
# The bytes that files of a kind have at an offset.
MAGIC = {".pdf": (0, b"%PDF"), ".png": (0, b"\x89PNG"), ".jpg": (0, b"\xff\xd8\xff"), ".jpeg": (0, b"\xff\xd8\xff"), ".gif": (0, b"GIF8"), ".webp": (8, b"WEBP")}
OFFICE = {".docx": "word/", ".pptx": "ppt/", ".xlsx": "xl/"}
LEAST_TEXT = 10


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def doc_type(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("UNKNOWN"))


def read_files(spark: SparkSession, path: str, *, pattern: str = "*", most_bytes: int | None = None) -> DataFrame:
    """path, name, ext, doc_type, modified, length, content, content_hash of files, folders included; with most_bytes, of those no longer than that."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return raw.where(F.lit(True) if most_bytes is None else F.col("length") <= most_bytes).select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), extension(F.col("path")).alias("ext"), doc_type(F.col("path")).alias("doc_type"),
        F.col("modificationTime").alias("modified"), "length", "content", F.sha2("content", 256).alias("content_hash"))


def problem(ext: str, data: bytes) -> str | None:
    """Why content doesn't match its extension; None if it does."""
    if not data:
        return "File is empty (0 bytes)"
    if ext in OFFICE:
        try:
            names = zipfile.ZipFile(io.BytesIO(data)).namelist() if data[:4] == b"PK\x03\x04" else []
        except zipfile.BadZipFile:
            names = []
        return None if any(n.startswith(OFFICE[ext]) for n in names) else f"not a valid {ext[1:]} file"
    if ext in (".txt", ".md"):
        try:
            data[:512].decode("utf-8")
        except UnicodeDecodeError as e:
            return None if len(data) > 512 and e.start >= 509 else "invalid UTF-8"
        return None
    if ext in MAGIC:
        at, magic = MAGIC[ext]
        return None if data[at : at + len(magic)] == magic else "wrong signature"
    return None


def pipe_rows(rows: list[list]) -> str:
    return "\n".join(" | ".join("" if c is None else str(c).strip() for c in r) for r in rows if r)


def tag(node) -> str:
    return node.tag.rpartition("}")[2]


def texts(node) -> str:
    return "".join(x.text or "" for x in node.iter() if tag(x) == "t")


def docx_text(data: bytes) -> str:
    """Paragraphs, headings 1 to 3 with # marks, then the cells of all tables."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    inside = {p for t in body.iter() if tag(t) == "tbl" for p in t.iter()}
    out = []
    for p in (x for x in body.iter() if tag(x) == "p" and x not in inside):
        if t := texts(p).strip():
            style = next((v for s in p.iter() if tag(s) == "pStyle" for v in s.attrib.values()), "")
            m = re.fullmatch(r"Heading\s?([1-3])", style)
            out.append("#" * int(m[1]) + " " + t if m else t)
    for t in (x for x in body.iter() if tag(x) == "tbl"):
        out += [c for row in t.iter() if tag(row) == "tr" for cell in row if tag(cell) == "tc" if (c := texts(cell).strip())]
    return "\n\n".join(out)


def pptx_text(data: bytes) -> str:
    z = zipfile.ZipFile(io.BytesIO(data))
    slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    parts = [(no, "\n".join(t for p in ElementTree.fromstring(z.read(n)).iter() if tag(p) == "p" if (t := texts(p).strip()))) for no, n in slides]
    return "\n\n".join(f"[Slide {no}]\n{t}" for no, t in parts if t)


def xlsx_text(data: bytes) -> str:
    """[Sheet: name] and pipe-separated rows; empty rows and sheets are left out."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = z.namelist()
    shared = [texts(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if tag(s) == "si"] if "xl/sharedStrings.xml" in names else []
    sheets = [s.attrib["name"] for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if tag(s) == "sheet"]
    files = sorted((int(m[1]), n) for n in names if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
    out = []
    for title, (_, n) in zip(sheets, files, strict=False):
        rows = []
        for row in (x for x in ElementTree.fromstring(z.read(n)).iter() if tag(x) == "row"):
            cells = []
            for c in (x for x in row if tag(x) == "c"):
                v = next((x.text for x in c if tag(x) == "v"), None)
                cells.append(shared[int(v)] if c.attrib.get("t") == "s" and v is not None else texts(c) if c.attrib.get("t") == "inlineStr" else v)
            if any(c is not None for c in cells):
                rows.append(cells)
        if rows:
            out.append(f"[Sheet: {title}]\n{pipe_rows(rows)}")
    return "\n\n".join(out)


def eml_text(data: bytes) -> str:
    """Subject, From and Date, then every plain text part."""
    msg = email.message_from_bytes(data)
    parts = [f"{h}: {msg[h]}" for h in ("Subject", "From", "Date") if msg.get(h)]
    for part in msg.walk():
        if part.get_content_type() == "text/plain" and (raw := part.get_payload(decode=True)):
            try:
                parts.append(raw.decode(part.get_content_charset() or "utf-8", "replace"))
            except LookupError:
                parts.append(raw.decode("utf-8", "replace"))
    return "\n\n".join(parts).strip()


def pdf_text(data: bytes) -> str:
    """Needs pypdf; raises ImportError without it."""
    import pypdf

    return "\n\n".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(data)).pages)


LOADERS = {"DOCX": docx_text, "PPTX": pptx_text, "EXCEL": xlsx_text, "EMAIL": eml_text, "PDF": pdf_text}


def load(kind: str, ext: str, data: bytes) -> tuple[str | None, str | None]:
    """(text, error) of one file."""
    if kind in ("IMAGE", "UNKNOWN"):
        return None, f"no loader for {ext or 'files without extension'}"
    if error := problem(ext, data):
        return None, error
    try:
        text = LOADERS[kind](data) if kind in LOADERS else data.decode("utf-8", "replace")
    except Exception as e:  # a broken file is a row with an error, not a failed job
        return None, f"{type(e).__name__}: {e}"
    text = text.replace("\x00", "")
    return (text, None) if len(text.strip()) >= LEAST_TEXT else (None, "too little text")


def load_documents(files: DataFrame) -> DataFrame:
    """files (as from read_files) with text and error in place of content."""
    kept = [c for c in files.columns if c not in ("content", "text", "error")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [load(k, e, bytes(d)) for k, e, d in zip(b["doc_type"], b["ext"], b["content"], strict=True)]
            yield b[kept].assign(text=[t for t, _ in got], error=[e for _, e in got])

    return files.mapInPandas(run, files.select(*kept).schema.add("text", "string").add("error", "string"))


def heading(line: str) -> str | None:
    """What a line says as a heading: it ends in a colon, or is two words or more in title or upper case; else None."""
    if not 3 <= len(line) < 100 or re.match(r"\d+\.", line):
        return None
    cased = (line.istitle() or line.isupper()) and len(line.split()) > 1
    return line.rstrip(":") if line[-1] == ":" else line if cased else None


def section_title(text: str | None) -> str | None:
    """The first heading among a page's first five lines."""
    opening = (text or "").strip().split("\n", 5)[:5]
    return next((title for title in (heading(x.strip()) for x in opening) if title is not None), None)


# Levels, in the order in which they are looked for.
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")
LOG_FIELDS = ("timestamp", "logger", "level", "place", "message")
LOG_LINE = "^" + " - ".join([r"(\d{4}(?:(?! - ).)*)", *[r"((?:(?! - ).)*)"] * 3, "(.*)"]) + "$"


def log_records(lines: DataFrame, line: str = "value", carry: tuple[str, ...] = ()) -> DataFrame:
    """timestamp, level, logger, message, parsed and raw of log lines, JSON or text, and carried columns; blank lines go.

    A text line of another shape than LOG_LINE is its own message.
    """
    record = F.when(F.trim(line).startswith("{"), F.from_json(line, "map<string,string>"))
    rows = lines.where(F.trim(line) != "").select(*carry, F.col(line).alias("raw"), record.alias("json"), F.regexp_replace(line, "\x1b\\[[0-9;]*m", "").alias("text"))
    named = F.coalesce(*[F.when(F.col("text").contains(f" - {x} - "), F.lit(x)) for x in LEVELS])
    rows = rows.withColumn("named", named).withColumn("fits", F.regexp_extract("text", LOG_LINE, LOG_FIELDS.index("level") + 1).eqNullSafe(F.col("named")))
    of_text = {f: F.when(F.col("fits"), F.regexp_extract("text", LOG_LINE, k)) for k, f in enumerate(LOG_FIELDS, 1)}
    of_text |= {"level": F.col("named"), "message": F.coalesce(of_text["message"], "text")}
    field = lambda f: F.when(F.col("json").isNotNull(), F.col("json")[f]).otherwise(of_text[f]).alias(f)
    return rows.select(*carry, *map(field, ("timestamp", "level", "logger", "message")), F.col("json").isNotNull().alias("parsed"), "raw")


MOST_LINES = 2000  # of a log that a tail shows


def log_tail(spark: SparkSession, path: str, *, limit: int = 200, level: str | None = None, contains: str | None = None) -> DataFrame:
    """no, and the columns of log_records, of the last `limit` lines of a log, newest last.

    With a filter, the last ten times as many lines are looked through, so fewer rows may come out.
    Level and text are compared without regard to case. Lines have the order of the files' times,
    names and bytes. Blank lines count as lines and give no row.
    """
    limit = max(1, min(limit, MOST_LINES))
    scan = 10 * limit if level or contains else limit
    meta = [F.col(f"_metadata.{c}").alias(c) for c in ("file_modification_time", "file_path", "file_block_start")]
    lines = spark.read.text(path).select("value", *meta, F.monotonically_increasing_id().alias("_in"))
    order = ["file_modification_time", "file_path", "file_block_start", "_in"]
    last = lines.orderBy(*[F.desc(c) for c in order]).limit(scan)  # each task keeps as many rows
    placed = last.withColumn("no", F.row_number().over(Window.orderBy(*order)))  # scan rows at most
    rows = log_records(placed, carry=("no",))
    if level:
        rows = rows.where(F.col("level") == level.upper())
    if contains:
        rows = rows.where(F.lower("raw").contains(contains.lower()))
    return rows.orderBy(F.desc("no")).limit(limit).orderBy("no")


def safe_url(url: Column) -> Column:
    """http or https, and neither a local name nor a private, loopback, link-local or reserved address."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    octet = lambda i: F.try_element_at(F.split(host, r"\."), F.lit(i)).try_cast("int")
    a, b = octet(1), octet(2)
    is_ip = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    closed = a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | (a >= 240) | ((a == 198) & b.isin(18, 19)) | ((a == 192) & (b == 0))
    bad = host.isin("localhost", "metadata.google.internal") | host.rlike(r"^\[?(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*)\]?$") | (is_ip & closed)
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & (host != "") & ~F.coalesce(bad, F.lit(False)), F.lit(False))
