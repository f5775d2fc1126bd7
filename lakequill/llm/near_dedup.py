"""MinHash near-dedup: banded candidates, odd sketches to choose among them, full sets to confirm.

1. Every document gets its set of word shingles, a hash of the set (its class), 200 MinHash samples,
   40 band keys of 5 samples and an odd sketch: each sample flips one of 512 bits, so the bits in
   which two sketches differ count the samples in which two sets differ. Two sets of similarity 0.75
   share a band with a probability of 1 - 2e-5.
2. Classes that share a band key are a bucket. Every class is compared with one class of each of its
   buckets, drawn anew in each of a few rounds, by sketch; the best are confirmed on the full sets
   and joined. A group of near copies thus falls into few components with a number of comparisons
   in proportion to its size.
3. What is then still outside the largest component is compared with the rest, so that no link
   between components is left out: within small buckets pair by pair, those that sketches can't
   rule out; within clusters of classes that share large buckets, block against block, where one
   matrix product counts the shared shingles of all pairs. Pairs of a large group are never rows.
4. In the first round a class is linked to one drawn before it at most, so that these links are
   trees, whose tops are found by doubling; later components come from min-label propagation over
   links between components.

Classes are 64-bit hashes: n distinct texts give about n*n/2**65 false merges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill.llm.common import by_group, discard, stored, table

SHINGLE, BANDS, ROWS = 5, 40, 5
SAMPLES, WORDS = BANDS * ROWS, 8  # MinHash samples; 64-bit words of a sketch
CACHED = 400_000  # word hashes that a worker holds at once
LARGE = 64  # members from which on a bucket counts as large
BLOCK, COLUMNS = 256, 8192  # classes in a block; shingles that a matrix product takes at once
MIX = np.uint64(0xFF51AFD7ED558CCD)


def shingle_set(text: str | bytes | None, size: int = SHINGLE, known: dict | None = None) -> np.ndarray:
    """Sorted 48-bit hashes of the distinct shingles of size words; of all words if there are fewer."""
    if not text:
        return np.zeros(0, np.uint64)
    words = (text.encode() if isinstance(text, str) else text).lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = {} if known is None else known
    if len(known) > CACHED:
        known.clear()
    hashes = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh64_intdigest(w)
        hashes.append(h)
    h = np.array(hashes, np.uint64)
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(len(h), size), np.uint64)
    for k in range(min(size, len(h))):
        out = (out ^ h[k : k + n]) * MIX
        out ^= out >> np.uint64(32)
    return np.unique(out >> np.uint64(16))


def pack(s: np.ndarray) -> bytes:
    return s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


class Signer:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mul = (rng.integers(0, 1 << 32, (SAMPLES, 1), dtype=np.uint32) | np.uint32(1))
        self.xor = rng.integers(0, 1 << 32, (SAMPLES, 1), dtype=np.uint32)
        self.flip = rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)

    def samples(self, s: np.ndarray) -> np.ndarray:
        h = (s ^ (s >> np.uint64(24))).astype(np.uint32)
        out = None
        for i in range(0, len(h), 4096):  # a block stays in the processor's cache
            low = ((h[i : i + 4096] ^ self.xor) * self.mul).min(axis=1)
            out = low if out is None else np.minimum(out, low)
        return out

    def sign(self, s: np.ndarray) -> tuple[list[int], list[int]]:
        """Band keys and the odd sketch, as signed 64-bit integers."""
        low = self.samples(s)
        packed = low.astype("<u4").tobytes()
        step = ROWS * 4
        keys = [xxhash.xxh64_intdigest(packed[k * step : (k + 1) * step], seed=k) for k in range(BANDS)]
        bits = (((low.astype(np.uint64) ^ self.flip) * MIX) >> np.uint64(64 - 9)).astype(np.int64)
        odd = np.bincount(bits, minlength=64 * WORDS).astype(np.uint8) & 1
        return np.array(keys, np.uint64).view(np.int64).tolist(), np.packbits(odd).view("<i8").tolist()


def sketch_limit(similarity: float) -> int:
    """The most bits in which sketches of sets that similar differ: the mean and five deviations."""
    bits, balls = 64 * WORDS, 2 * SAMPLES * (1 - similarity)
    mean = bits / 2 * (1 - np.exp(-2 * balls / bits))
    return int(mean + 5 * np.hypot(np.sqrt(mean), 2 * np.sqrt(SAMPLES * similarity * (1 - similarity)) * np.exp(-2 * balls / bits)))


SKETCH = [f"s{i}" for i in range(WORDS)]


def signatures(docs: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """id, h (hash of the text, with the id its address), n (set size), sid (class; null for no words), keys, s0.."""
    schema = "id long, h long, n long, sid long, keys array<long>, " + ", ".join(f"{c} long" for c in SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, known = Signer(), {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                n, sid, keys, sketch = [], [], [], []
                for t in batch.column(2).to_pylist():
                    s = shingle_set(t, size, known)
                    n.append(len(s))
                    if len(s):
                        k, odd = signer.sign(s)
                        sid.append(int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64)))
                    else:
                        k, odd = None, [None] * WORDS
                        sid.append(None)
                    keys.append(k)
                    sketch.append(odd)
                cols = [pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(keys, pa.list_(pa.int64())), *(pa.array(list(c), pa.int64()) for c in zip(*sketch, strict=True))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["id", "h", "n", "sid", "keys", *SKETCH])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.col(text).cast("binary")).mapInArrow(run, schema)


def full_sets(docs: DataFrame, chosen: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """chosen: sid, id, h. The packed full set of each sid, read from the text at that address."""
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_h"), F.col(text).cast("binary").alias("_t"))
    # shuffled at every size: chosen grows with the input
    rows = texts.hint("merge").join(chosen, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_h") == F.col("h"))).select("sid", "_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(shingle_set(t, size, known)) for t in batch.column(1).to_pylist()], pa.binary())], ["sid", "shingles"])

    return rows.mapInArrow(run, "sid long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, grows: bool) -> DataFrame:
    """Components (ca, cb) of the pairs (a, b, ca, cb) whose full sets have 100 * intersection >= percent * union.

    grows: as many pairs as there are near copies, so that joins are by shuffle at every size.
    """
    left = sets.select(F.col("sid").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("sid").alias("b"), F.col("shingles").alias("y"))
    if grows:
        left, right = left.hint("merge"), right.hint("merge")
    rows = pairs.join(left, "a").join(right, "b").select("ca", "cb", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = unpack(x.as_py()), unpack(y.as_py())
                both = np.concatenate([s, t])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["ca", "cb"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "ca long, cb long")


def tops(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """nodes (sid) to (sid, comp): comp is the top of its tree. parents (ca, cb): a node's parent; none twice, no cycles."""
    labels = stored(nodes.join(parents.select(F.col("ca").alias("sid"), "cb"), "sid", "left").select("sid", F.coalesce("cb", "sid").alias("comp")), "near-all-labels")
    while True:
        up = labels.select(F.col("sid").alias("comp"), F.col("comp").alias("top"))
        new = stored(labels.join(up, "comp").select("sid", F.col("top").alias("comp"), (F.col("top") != F.col("comp")).alias("moved")), "near-all-labels")
        discard(labels)
        labels = new
        if labels.where("moved").isEmpty():
            return labels.select("sid", "comp")


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (sid, comp): comp is the least node reachable. Only nodes that edges name."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "near-edges")
    labels = stored(both.groupBy(F.col("a").alias("sid")).agg(F.min("b").alias("m")).select("sid", F.least("sid", "m").alias("comp")), "near-labels")
    while True:
        hop = both.join(labels.select(F.col("sid").alias("b"), "comp"), "b").groupBy(F.col("a").alias("sid")).agg(F.min("comp").alias("near"))
        nearer = labels.withColumnRenamed("comp", "was").join(hop, "sid").select("sid", "was", F.least("was", "near").alias("to"))
        up = labels.select(F.col("sid").alias("to"), F.col("comp").alias("top"))
        new = stored(nearer.join(up, "to").select("sid", F.col("top").alias("comp"), (F.col("top") != F.col("was")).alias("moved")), "near-labels")
        discard(labels)
        labels = new
        if labels.where("moved").isEmpty():
            discard(both)
            return labels.select("sid", "comp")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set on the left with each on the right."""
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)
    for i in range(0, len(common), COLUMNS):
        part = common[i : i + COLUMNS]
        sides = []
        for side in (left, right):
            m = np.zeros((len(side), len(part)), np.float32)
            for r, s in enumerate(side):
                s = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], "right")]  # noqa: PLW2901
                at = np.minimum(np.searchsorted(part, s), len(part) - 1)
                m[r, at[part[at] == s]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def links_in_clusters(clusters: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (ca, cb) between components within clusters (sid, cluster): what is outside a cluster's
    largest component against all of it, in blocks. One link for each two components and blocks."""
    nodes = clusters.join(labels, "sid")
    per = nodes.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("c"))
    sizes = per.groupBy("cluster").agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("n")).select("cluster", F.col("m.comp").alias("main"), "n", (F.col("n") - F.col("m.c")).alias("n_out")).where("n_out > 0")
    rows = nodes.join(sizes, "cluster").join(sets.select("sid", "shingles"), "sid")
    deal = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "sid"), F.ceil(F.col(n) / BLOCK)).cast("int")
    packed = lambda d, at, name: d.groupBy("cluster", at).agg(F.collect_list(F.struct("sid", "comp", "shingles")).alias(name), F.first("n").alias(f"n_{name}"))
    every = packed(rows.withColumn("block", deal("n", "all")), "block", "every")
    outside = packed(rows.where("comp <> main").withColumn("own", deal("n_out", "out")), "own", "outside")
    outside = outside.withColumn("block", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n_outside") / BLOCK) - 1).cast("int"))))
    pairs = outside.join(every, ["cluster", "block"]).select("outside", "every")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[int, int]] = set()
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                x, y = x.as_py(), y.as_py()  # noqa: PLW2901
                left, right = ([unpack(r["shingles"]) for r in side] for side in (x, y))
                both = shared_counts(left, right)
                total = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :]
                apart = np.array([r["comp"] for r in x])[:, None] != np.array([r["comp"] for r in y])[None, :]
                for i, j in zip(*np.nonzero(apart & (100 * both >= percent * (total - both))), strict=True):
                    found.add((x[i]["comp"], y[j]["comp"]))
            yield pa.RecordBatch.from_pydict({"ca": pa.array([a for a, _ in found], pa.int64()), "cb": pa.array([b for _, b in found], pa.int64())})

    return pairs.mapInArrow(run, "ca long, cb long")


def near_components(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = 75, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """signatures (id, n, sid) and labels (sid, comp) of the classes that share a bucket."""
    signed = stored(signatures(docs, id_col, text, size), "near-signed")
    rows = signed.where("sid is not null")
    one = stored(rows.groupBy("sid").agg(F.min(F.struct("id", "h", "n", *SKETCH, "keys")).alias("x")).select("sid", "x.*"), "near-classes")
    keyed = one.select(F.explode(F.array_distinct("keys")).alias("key"), "sid")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_m"), F.min("sid").alias("first")).where("_m > 1")
    members = stored(keyed.join(sizes, "key"), "near-members")
    sets = stored(full_sets(docs, one.join(members, "sid", "left_semi").select("sid", "id", "h"), id_col, text, size).dropDuplicates(["sid"]), "near-sets")
    buckets = stored(members.join(one.select("sid", "n", *SKETCH), "sid").withColumn("large", F.col("_m") >= LARGE).drop("_m"), "near-buckets")
    discard(members)
    discard(one)
    places = buckets.count()

    limit = sketch_limit(percent / 100)
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"r.{c}"))) for c in SKETCH[1:]), F.bit_count(F.col(SKETCH[0]).bitwiseXOR(F.col(f"r.{SKETCH[0]}"))))
    alike = (apart <= limit) & (F.lit(100) * F.least("n", "r.n") >= percent * F.greatest("n", "r.n")) & (F.col("comp") != F.col("r.comp"))

    def joined(links: DataFrame) -> bool:
        """Move the labels of components that links (ca, cb) join; whether any moved."""
        nonlocal labels
        links = stored(links, "near-links")
        if links.isEmpty():
            return False
        moves = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        new = stored(labels.join(moves.select(F.col("sid").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("sid", F.coalesce("to", "comp").alias("comp")), "near-all-labels")
        discard(labels)
        discard(links)
        labels = new
        return True

    for k in range(max(1, rounds)):  # after the first, only where groups are large
        open_ = buckets.where("large").join(labels, "sid") if k else buckets.withColumn("comp", F.col("sid"))
        drawn = F.struct(F.xxhash64(F.lit(k), "sid").alias("o"), "sid", "comp", "n", *SKETCH)
        mark = open_.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(drawn).alias("r"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("key", "r", "n")
        met = by_group(open_.select("key", "sid", "comp", "n", *SKETCH), mark, ["key"], "sid", places).select("*", "_found.r").where("r is not null").where(alike).select("sid", "comp", F.col("r.sid").alias("other"), F.col("r.comp").alias("to"), apart.alias("d"))
        best = met.groupBy(*(("comp", "to") if k else ("sid",))).agg(F.min(F.struct("d", "sid", "other")).alias("p"))
        ends = ("comp", "to") if k else ("p.sid", "p.other")
        pairs = stored(best.select(F.col("p.sid").alias("a"), F.col("p.other").alias("b"), *[F.col(x).alias(c) for x, c in zip(ends, ("ca", "cb"), strict=True)]), "near-pairs")
        if not k:  # the other one is drawn before in every bucket, by one order: a class has one parent at most, and there are no cycles
            links = stored(confirmed(pairs, sets, percent, grows=True), "near-links")
            labels = tops(buckets.select("sid").distinct(), links)
            discard(links)
        elif not joined(confirmed(pairs, sets, percent, grows=False)):
            break
        discard(pairs)
    open_ = stored(buckets.where("NOT large").join(labels, "sid"), "near-open")
    largest = open_.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max(F.struct("c", "comp")).alias("m"), F.count(F.lit(1)).alias("comps")).where("comps > 1").select("key", F.col("m.comp").alias("main"))
    outside = open_.join(largest, "key").where("comp <> main").select("key", F.struct("sid", "comp", "n", *SKETCH).alias("r"))
    both = [F.struct("sid", "comp"), F.struct("r.sid", "r.comp")]
    rest = open_.join(outside, "key").where(alike).select(F.least(*both).alias("x"), F.greatest(*both).alias("y")).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"), F.col("x.comp").alias("ca"), F.col("y.comp").alias("cb")).distinct()
    pairs = stored(rest, "near-pairs")
    joined(confirmed(pairs, sets, percent, grows=True))
    discard(pairs)
    discard(open_)
    large = stored(buckets.where("large").select("first", "sid").distinct(), "near-large")
    discard(buckets)
    if not large.isEmpty():
        clusters = components(large.select(F.col("first").alias("a"), F.col("sid").alias("b"))).select("sid", F.col("comp").alias("cluster"))
        joined(links_in_clusters(clusters, labels, sets, percent))
    discard(large)
    discard(sets)
    return signed, labels


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = 75) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id and kept.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets; a
    component's id is its least document id. Null texts and texts without words have an empty set
    and are linked with nothing. Null ids give way to others of their component; a component of
    null ids alone has a null component_id and all its rows are kept. Rows that repeat an id are
    treated alike. An empty table gives no rows.
    """
    signed, labels = near_components(docs, id_col=id_col, text=text, size=size, percent=percent)
    classes = signed.where("sid is not null").groupBy("sid").agg(F.min("id").alias("lo"), F.count(F.lit(1)).alias("rows"))
    labelled = classes.join(labels, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    total = signed.count()  # no less than there are classes
    comps = labelled.groupBy("comp").agg(F.min("lo").alias("least"), F.count(F.lit(1)).alias("n"))
    least = by_group(labelled, comps, ["comp"], "sid", total).select("sid", F.col("_found.least").alias("least"), F.col("rows").alias("n"))
    rows = signed.select("id", F.col("n").alias("_size"), "sid")
    return by_group(rows, least, ["sid"], "id", total).select(
        F.col("id").alias(id_col), F.col("_size").alias("n_shingles"),
        F.when(F.col("sid").isNull(), F.col("id")).otherwise(F.col("_found.least")).alias("component_id"),
    ).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that stay: of each component the one with the least id; all without words.

    Rows that repeat both id and text are one document.
    """
    signed, labels = near_components(docs, id_col=id_col, text=text, **options)
    classes = signed.where("sid is not null").groupBy("sid").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("x"))
    first = classes.join(labels, "sid", "left").groupBy(F.coalesce("comp", "sid")).agg(F.min("x").alias("x")).select("x.id", "x.h")
    stay = first.union(signed.where("sid is null").select("id", "h")).select(F.col("id").alias("_stay_id"), F.col("h").alias("_stay_h"))
    return docs.join(stay, F.col(id_col).cast("long").eqNullSafe(F.col("_stay_id")) & (F.xxhash64(text) == F.col("_stay_h")), "left_semi")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
