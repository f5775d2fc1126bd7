"""Language ID with hyperdimensional profiles.

Each letter (and the gap between words) has a random vector of +1 and -1, seeded by its code
point. A trigram's vector binds its letters: the elementwise product of the first letter's vector
rotated by two places, the second's by one and the third's. A text's vector is the bundle (sum) of
its trigrams' vectors, a language's prototype the bundle of its training texts. A text gets the
language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill.llm.common import crc_rem, table

DIM, SEED = 1024, 20
CACHED = 16384  # trigram vectors that a worker holds at once
PIECE = 1 << 20  # code points turned into trigrams at once; bounds memory, not the text

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of the whole text (21 bits a letter, 0 for the gap between words) and their counts."""
    low = text.lower()
    found = []
    carry = np.zeros(1, np.uint64)  # the last two symbols so far
    for i in range(0, len(low), PIECE):
        cp = np.frombuffer(low[i : i + PIECE].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        cp[~letters()[cp]] = 0
        if i + PIECE >= len(low):
            cp = np.append(cp, np.uint64(0))
        cp = np.concatenate([carry, cp])
        keep = np.ones(len(cp), bool)
        keep[1:] = (cp[1:] != 0) | (cp[:-1] != 0)
        cp = cp[keep]
        if len(cp) > 2:
            found.append(np.unique((cp[:-2] << np.uint64(42)) | (cp[1:-1] << np.uint64(21)) | cp[2:], return_counts=True))
        carry = cp[-2:]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(found) == 1:
        return found[0]
    codes, back = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    return codes, np.bincount(back, np.concatenate([n for _, n in found])).astype(np.int64)


class Space:
    """Hypervectors, made when first needed; holds a bounded number of them."""

    def __init__(self, dim: int = DIM, seed: int = SEED):
        self.dim, self.seed = dim, seed
        self.by_letter: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.vectors = np.empty((CACHED, dim), np.float32)

    def letter(self, cp: int) -> np.ndarray:
        v = self.by_letter.get(cp)
        if v is None:
            if len(self.by_letter) >= CACHED:
                self.by_letter.clear()
            bits = np.random.Generator(np.random.Philox(key=[self.seed, cp])).integers(0, 2, self.dim)
            v = self.by_letter[cp] = (2 * bits - 1).astype(np.float32)
        return v

    def bound(self, code: int) -> np.ndarray:
        a, b, c = code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros(self.dim, np.float64)
        for i in range(0, len(codes), CACHED // 2):
            part, rows = codes[i : i + CACHED // 2].tolist(), self.rows
            at = [rows.get(c, -1) for c in part]
            if -1 in at:
                if len(rows) + at.count(-1) > CACHED:
                    rows.clear()
                for c in part:
                    if c not in rows:
                        self.vectors[len(rows)] = self.bound(c)
                        rows[c] = len(rows)
                at = [rows[c] for c in part]
            out += counts[i : i + CACHED // 2].astype(np.float32) @ self.vectors[at]
        return out


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", id_col: str = "doc_id", per_lang: int = 4000, dim: int = DIM, seed: int = SEED) -> dict[str, np.ndarray]:
    """Prototypes from about per_lang labelled rows of each language, drawn by a hash of the id.

    Fitting is bounded by per_lang; rows with a null text, label or id are left out. One vector
    per language and task reaches the driver, from at most 8 tasks.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(id_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not counts:
        return {}
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11) / float(1 << 53)
    part = F.element_at(F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_lang / n)))]), F.col(lang))
    sample = rows.where(draw < part).select(F.col(lang).alias("lang"), F.col(text).alias("text")).repartition(8)

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Space(dim, seed), {}
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = space.bundle(*trigrams(t))
                sums[k] = sums[k] + v if k in sums else v
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "v": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    out: dict[str, np.ndarray] = {}
    for k, v in sorted((r[0], bytes(r[1])) for r in sample.mapInArrow(bundled, "lang string, v binary").collect()):
        out[k] = out.get(k, 0) + np.frombuffer(v)
    return {k: v / np.linalg.norm(v) for k, v in out.items() if v.any()}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], *, text: str = "text", dim: int = DIM, seed: int = SEED) -> DataFrame:
    """docs with lang_pred and score (cosine with that language's prototype, 0 to 1) added.

    A text that is null or has no letter, and every text where nothing was learned, gets `und` and
    0. Ties go to the language that sorts first. Columns of docs with these names are replaced.
    Whole texts count, of any length. An empty table gives no rows.
    """
    names = sorted(prototypes)
    matrix = np.array([prototypes[k] for k in names]) if names else np.zeros((0, dim))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = kept.index(text)
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(dim, seed)
        for batch in batches:
            langs, scores = [], []
            for t in batch.column(at).to_pylist():
                codes, counts = trigrams(t) if t else ((), ())
                best, score = "und", 0.0
                if len(codes) and names:
                    v = space.bundle(codes, counts)
                    cos = matrix @ v / max(np.linalg.norm(v), 1e-12)
                    k = int(cos.argmax())
                    best, score = names[k], float(min(1.0, max(0.0, cos[k])))
                langs.append(best)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"])

    return docs.select(*kept).mapInArrow(predict, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_rem("doc_id", 4) == 2, F.lit(False))
    prototypes = fit(docs.where(~held_out))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), prototypes).select("doc_id", "held_out", "lang_pred", "score")
