"""Secret scans: fixed patterns, and a randomness test battery with false-discovery control.

Besides the base patterns, every long run of key-like characters is a candidate. Its encoding (hex,
base32, base64) is inferred from its characters, its symbols become digits, and three tests ask
whether it could be uniformly random: chi-squared over the alphabet, runs about the middle, and
serial correlation. Fisher's method makes one p-value of the three. Random strings have uniform
p-values; made-up words and numbers crowd near 0. For each class of lengths the histogram of
p-values over the whole corpus gives the share of random strings (those above 1/2, doubled), and
with it the expected share of false ones above any threshold (each distinct string counts once,
however often it is copied); the lowest threshold that keeps it
below the set rate decides. Short strings, on which the tests say little, so need more. Below 1/BINS
bins halve: a string is no secret if its p-value is so small that of all random ones together less
than the set rate would lie there.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill.llm.common import stored, table

KINDS = ("assign", "access", "hex", "random")
# The base patterns and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
LONG_HEX = re.compile(r"[0-9a-f]{32,}")  # as HEX, since its runs are maximal and short ones are dropped

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
ENCODINGS = (
    ("hex", "0123456789abcdef", re.compile(r"[0-9a-f]+|[0-9A-F]+")),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", re.compile(r"[A-Z2-7]+")),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", re.compile(r"[A-Za-z0-9+/]+")),
)
BINS, LENGTHS = 64, (20, 24, 32, 40, 64, 128)  # p-value bins; least lengths of the classes
LEAST_BIN = -60  # bin -k holds p-values below 2**-k / BINS, bin 0 those from half of 1 / BINS on
RATE = 0.05


def encoding(s: str) -> tuple[str, str, str] | None:
    """Name, alphabet and body of what s could encode; None for plain numbers and what has no letter."""
    body = s.rstrip("=").replace("-", "+").replace("_", "/")
    if not re.search("[A-Za-z]", body):
        return None
    for name, alphabet, pattern in ENCODINGS:
        if pattern.fullmatch(body):
            return name, alphabet, body.lower() if name == "hex" else body
    return None


def chi2_tail(x: float, df: int) -> float:
    """P(chi-squared with df degrees > x), by the cube-root normal approximation."""
    if x <= 0:
        return 1.0
    v = 2 / (9 * df)
    return normal_tail(((x / df) ** (1 / 3) - 1 + v) / math.sqrt(v))


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def randomness(body: str, alphabet: str) -> float:
    """One p-value from the battery under the hypothesis that body is uniformly random."""
    n, k = len(body), len(alphabet)
    digits = [alphabet.index(c) for c in body]
    # chi-squared uniformity; short strings have few of each symbol, so symbols are pooled to about 5 of each
    cells = min(k, max(2, n // 5))
    counts = [0] * cells
    for d in digits:
        counts[d * cells // k] += 1
    share = [0] * cells
    for d in range(k):
        share[d * cells // k] += 1
    chi = sum((c - n * s / k) ** 2 / (n * s / k) for c, s in zip(counts, share, strict=True))
    p = [chi2_tail(chi, cells - 1)]
    # runs above and below the middle of the alphabet
    high = [d >= k / 2 for d in digits]
    a = sum(high)
    b = n - a
    if a and b and n > 2:
        mean, var = 1 + 2 * a * b / n, 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
        runs = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
        p.append(2 * normal_tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0)
    else:
        p.append(2.0 ** (1 - n))
    # correlation of neighbours
    m = sum(digits) / n
    var = sum((d - m) ** 2 for d in digits)
    r = sum((x - m) * (y - m) for x, y in zip(digits, digits[1:], strict=False)) / var if var else 1.0
    p.append(2 * normal_tail(abs(r + 1 / n) * math.sqrt(n)))
    fisher = -2 * sum(math.log(max(x, 1e-300)) for x in p)
    half = fisher / 2  # 6 degrees of freedom
    return min(1.0, math.exp(-half) * (1 + half + half * half / 2))


def length_class(n: int) -> int:
    return sum(n >= x for x in LENGTHS) - 1


def p_bin(p: float) -> int:
    return min(BINS - 1, int(p * BINS)) if p * BINS >= 1 else max(LEAST_BIN, math.ceil(math.log2(max(p * BINS, 1e-300))))


def scan_text(t: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int, bytes]]]:
    """Base spans (kind, start, end), and candidates (start, end, length class, p-value bin, digest of the string)."""
    base = [(0, m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in t:
        base += [(1, m.start(), m.end()) for m in ACCESS.finditer(t) if m.end() - m.start() >= LEAST["access"]]
    base += [(2, m.start(), m.end()) for m in LONG_HEX.finditer(t)]
    more = []
    for m in CANDIDATE.finditer(t):
        if found := encoding(m[0]):
            p = randomness(found[2], found[1])
            more.append((m.start(), m.end(), length_class(len(found[2])) if len(found[2]) >= LENGTHS[0] else 0, p_bin(p), sha256(m[0].encode()).digest()[:16]))
    return base, more


def thresholds(histogram: dict[tuple[int, int], int], rate: float = RATE) -> list[int]:
    """For each class of lengths the least bin from which on candidates count as secrets (BINS: none do)."""
    out = []
    for c in range(len(LENGTHS)):
        counts = [histogram.get((c, b), 0) for b in range(BINS)]
        counts[0] += sum(histogram.get((c, b), 0) for b in range(LEAST_BIN, 0))
        random_each = sum(counts[BINS // 2 :]) / (BINS / 2)  # random strings spread evenly over the bins
        cut, above = BINS, 0
        for b in range(BINS - 1, -1, -1):
            above += counts[b]
            if above and max(0.0, above - random_each * (BINS - b)) <= rate * above:
                cut = b
        while cut <= 0 and cut > LEAST_BIN and random_each * 2.0 ** (cut - 1) >= rate:
            cut -= 1
        out.append(cut)
    return out


def scan(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """One row per row of docs: its id and spans, an array of (kind, start, end) by start, then kind.

    Kinds are numbers into KINDS; 3, random, is what the battery adds. Offsets are in code points,
    end exclusive. Candidates within a base span aren't added again. Null texts count as empty:
    no spans. The histogram that reaches the driver has len(LENGTHS) * (BINS - LEAST_BIN) rows at most.
    """
    schema = f"{id_col} long, base array<struct<kind:int,start:int,end:int>>, more array<struct<start:int,end:int,c:int,b:int,d:binary>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        candidate = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("c", pa.int32()), ("b", pa.int32()), ("d", pa.binary())]))
        for batch in batches:
            base, more = [], []
            for t in batch.column(1).to_pylist():
                x, y = scan_text(t or "")
                base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in x])
                more.append([dict(zip(("start", "end", "c", "b", "d"), s, strict=True)) for s in y])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(more, candidate)], [id_col, "base", "more"])

    found = stored(docs.select(F.col(id_col).cast("long").alias(id_col), text).mapInArrow(run, schema), "secrets")
    bins = found.where(F.size("more") > 0).select(F.explode("more").alias("m")).select("m.c", "m.b", "m.d").distinct().groupBy("c", "b").count().collect()
    cuts = F.array(*[F.lit(c) for c in thresholds({(r[0], r[1]): r[2] for r in bins}, rate)])
    new = F.filter("more", lambda m: (m["b"] >= F.element_at(cuts, m["c"] + 1)) & ~F.exists("base", lambda s: (s["start"] <= m["start"]) & (s["end"] >= m["end"])))
    as_spans = F.transform(new, lambda m: F.struct(F.lit(3).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    by_start = lambda a: F.transform(F.array_sort(F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select(id_col, by_start(F.concat("base", as_spans)).alias("spans"))


def joined(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
