"""LM scoring: counts over the whole training part, and a causal self-attention model in numpy.

A text is a sequence of words and an end; a word is given by its subword ids in a public BPE
vocabulary. The probability of a word is made of two factors:

    P(class of the word | the words before it)  *  P(word | its class)

The first factor is the model's: one head of causal self-attention, whose query, keys and values are
means of those of a word's subword ids, added to counted transitions from a word to the next class.
The second is counted: a known word has its share of its class, less what is set aside for unknown
words (Good-Turing: the share of words that occur once); an unknown word is spelled by subword ids,
as counts over the distinct words of the class have it. A word's class follows from its subword ids:
what comes after words with these ids decides it. The probabilities of all words add up to no more
than one.

Texts are turned into subword ids once, and stored so; all that follows reads arrays of ids. Word
counts, subword counts, the classes and the transitions rest on the whole training part; each
is a distributed aggregation. Attention weights start at random and learn in tasks, in rounds: in
each round every task takes the weights through its texts of that round, and the weights of the
tasks are averaged by their words. The rounds share out the training texts (SHARES), so that each
of them is learned from once.

Scoring reads texts whole. A text is cut into blocks of BLOCK words, each padded text on its own;
the window of a block is the block and the one before it, so that windows overlap and each word is
scored once, with 8 to 15 words before it as context, in batches of masked attention.

Word counts are looked up in two ways. The most frequent words (HEAVY at most, whatever the corpus)
are broadcast; what is rarer is joined by a hash of its ids. A word scores alike either way.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakequill.llm.common import crc_rem, once, stored, table

HEAVY = 1 << 19  # words that are broadcast, at most
TOGETHER = 20_000  # distinct words that are encoded at once
COUNTED = 2_000_000  # subword ids of distinct words that a task counts before it hands them on
DIM, BLOCK = 16, 8
CLASSES, OWN = 48, 16  # classes; of these, the most frequent words of a single id, one each
ROWS, SHARED = 4096, 64  # rows of the tables by subword id; of these, those that rarer ids share
FEATURES, AXES = 128, 12  # columns of the counts that classes are made from, and what is kept of them
END = 50256  # starts and ends a text; not an id of the vocabulary's tokens
STOP = np.array([END], "u2").tobytes()
SHARES = (1 / 8, 7 / 8)  # of the training texts, that the rounds of training take: all of them, each in one round
RATES = (0.03, 0.01)  # of the rounds
TEXTS = 2048  # texts whose distinct words are told apart at once, at most
PIECE = 1 << 17  # words that a task trains on at once
CHUNK, BATCH = 256, 512  # blocks that are scored at once, and that make a step of training, at most
FIXED = 1 << 20  # weights are summed as integers of this scale, so that their order doesn't matter
MOST = np.float32(50)  # scores of keys and of classes are held within this bound on either side
TABLES = ("q", "k", "v")


class Subwords:
    """Subword ids of words with a space before them, as unsigned 16-bit integers (of the machines' byte order).

    Only the first id of a word starts with a space, so that ids one after the other still tell the
    words apart.
    """

    def __init__(self, path: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.opens = np.zeros(END + 1, bool)  # ids that start words
        self.opens[[i for b, i in ranks.items() if b[:1] == b" "]] = True
        self.opens[END] = True

    def texts_ids(self, texts: pa.Array) -> pa.Array:
        """Ids of all words of each text, without the end; none for a null. Each distinct word is encoded once."""
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        each = split.values.dictionary_encode()
        ids = self.words_ids(each.dictionary).take(each.indices)
        starts = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1) if len(ids) else np.zeros(1, np.int32)
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(starts[split.offsets.to_numpy()]), ids.buffers()[2]])

    def words_ids(self, distinct: pa.Array) -> pa.Array:
        """Ids of each word. Words are encoded together, as what the pattern takes starts at the space before a word and
        ends with it, unless there are spaces beyond ASCII in words; these are encoded alone, as is the empty one that
        splitting leaves where a text starts or ends with space."""
        alone = pc.or_(pc.equal(distinct, ""), pc.match_substring_regex(distinct, r"[\x{85}\p{Z}]"))
        few = {i: array("H", self.encode(" " + w) if w else ()).tobytes() for i, w in zip(pc.indices_nonzero(alone).to_pylist(), distinct.filter(alone).to_pylist(), strict=True)}
        rest = distinct.filter(pc.invert(alone)) if few else distinct
        ids = [np.zeros(0, "u2")]
        for i in range(0, len(rest), TOGETHER):
            part = rest.slice(i, TOGETHER)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), " ")[0].as_py()
            ids.append(np.array(array("H", self.encode(" " + joined))))
        ids = np.concatenate(ids)
        ends = np.append(np.nonzero(self.opens[ids])[0], len(ids)) * 2
        if len(ends) != len(rest) + 1:
            raise ValueError("a word's first id alone starts with a space: the vocabulary doesn't keep to that")
        out = pa.Array.from_buffers(pa.binary(), len(rest), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids.tobytes())])
        if few:
            place = np.cumsum(~alone.to_numpy(zero_copy_only=False)) - 1
            place[list(few)] = len(rest) + np.arange(len(few))
            out = pa.concat_arrays([out, pa.array(few.values(), pa.binary())]).take(pa.array(place))
        return out

    def text_ids(self, text: str | None) -> bytes:
        return self.texts_ids(pa.array([text], pa.string()))[0].as_py()


def vocabulary_of(path: str | None) -> Subwords:
    """The vocabulary, read once in each worker process."""
    return once(("lm-subwords", path), lambda: Subwords(path))


def tokenised(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """docs with ids, which holds the subword ids of all words of the text, in its place."""
    kept = [c for c in docs.columns if c not in (text, "ids")]
    schema = docs.select(*kept).schema.add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = vocabulary_of(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], subwords.texts_ids(batch.column(len(kept)))], schema.names)

    return docs.select(*kept, text).mapInArrow(run, schema)


def in_row(texts: list[bytes], opens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of some texts, each with its end, one after the other; starts and sizes of their words."""
    ids = np.frombuffer(b"".join([x for t in texts for x in (t, STOP)]), "u2").astype(np.int64)
    starts = np.nonzero(opens[ids])[0]
    return ids, starts, np.diff(np.append(starts, len(ids)))


class Words:
    """The words of some texts, by distinct ones: ids one after the other, starts, sizes and hashes; and each text's words."""

    def __init__(self, texts: list[bytes], opens: np.ndarray):
        ids, starts, sizes = in_row(texts, opens)
        h = hashes(ids, starts, sizes)
        self.hash, at, self.targets = distinct(h)
        self.ids, self.starts, self.sizes = gathered(ids, starts[at], sizes[at])
        ends = np.nonzero(ids[starts] == END)[0]
        self.n = np.diff(np.append(-1, ends))  # words and the end of each text
        self.end = int(self.targets[ends[0]]) if len(ends) else 0

    def firsts(self) -> np.ndarray:
        return self.ids[self.starts]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct numbers in order, a place of each, and where each number is among them: as np.unique, without sorting them all."""
    each = pa.array(h).dictionary_encode()
    values, which = each.dictionary.to_numpy(), each.indices.to_numpy()
    order = np.argsort(values)
    rank, at = np.empty(len(values), np.int64), np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    at[which] = np.arange(len(h))
    return values[order], at[order], rank[which]


def hashes(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, by their ids in order: a random number for each id, times an odd one for its place."""
    if not len(starts):
        return np.zeros(0, np.int64)
    by_id, by_place = mixed(np.arange(1, END + 2, dtype=np.uint64)), mixed(np.arange(int(sizes.max()), dtype=np.uint64) + np.uint64(1 << 32)) | np.uint64(1)
    each = np.take(by_id, ids)
    each *= np.take(by_place, np.arange(len(ids)) - np.repeat(starts, sizes))
    return mixed(np.add.reduceat(each, starts)).view(np.int64)


def gathered(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Some words' ids one after the other, and their starts there and sizes."""
    new = np.cumsum(sizes) - sizes
    return ids[np.repeat(starts - new, sizes) + np.arange(int(sizes.sum()))], new, sizes


def sums(of: np.ndarray, rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray, singly: int) -> np.ndarray:
    """The table's rows of each group added up; one after the other, as most groups are small, and what is beyond singly by reduceat."""
    order = np.argsort(-np.minimum(sizes, singly + 1).astype(np.int8), kind="stable")  # groups that still have rows come first
    at, n = starts[order], np.bincount(np.minimum(sizes, singly + 1), minlength=singly + 2)[::-1].cumsum()[::-1]  # n[k]: groups of k rows or more
    out = np.take(of, rows[at], axis=0)
    for k in range(1, singly):
        if not n[k + 1]:
            break
        out[: n[k + 1]] += np.take(of, rows[at[: n[k + 1]] + k], axis=0)
    if n[singly + 1]:
        long = order[: n[singly + 1]]
        more, new, _ = gathered(rows, starts[long] + singly, sizes[long] - singly)
        out[: len(long)] += np.add.reduceat(np.take(of, more, axis=0), new, axis=0)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return np.take(out, back, axis=0)


def means(of: np.ndarray, rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Mean of the table's rows of each word."""
    return sums(of, rows, starts, sizes, 12) / sizes[:, None].astype(np.float32)


def word_counts(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """h (hash), ids and c of every distinct word of all texts, the end among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opens = vocabulary_of(path).opens
        held: list[tuple] = []

        def merged() -> tuple:
            h, c = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            ids, sizes = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
            each, at, which = distinct(h)
            ids, _, sizes = gathered(ids, (np.cumsum(sizes) - sizes)[at], sizes[at])
            return each, np.bincount(which, c).astype(np.int64), ids, sizes

        def out() -> pa.RecordBatch:
            h, c, ids, sizes = merged()
            ends = pa.array(np.concatenate([[0], np.cumsum(2 * sizes)]), pa.int32())
            words = pa.Array.from_buffers(pa.binary(), len(sizes), [None, ends.buffers()[1], pa.py_buffer(ids.astype("u2").tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(h), words, pa.array(c)], ["h", "ids", "c"])

        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                w = Words(batch.column(0).slice(i, TEXTS).to_pylist(), opens)
                held.append((w.hash, np.bincount(w.targets), w.ids, w.sizes))
                if sum(len(x[2]) for x in held) > COUNTED:
                    held = [merged()]
                    if len(held[0][2]) > COUNTED // 2:
                        yield out()
                        held = []
        if held:
            yield out()

    return tokens.select("ids").mapInArrow(run, "h long, ids binary, c long").groupBy("h", "ids").agg(F.sum("c").alias("c"))


def summed(frame: DataFrame, size: int) -> np.ndarray:
    """Column c added up by cell, as an array: a row per cell and task comes in, one per cell goes out."""
    got = frame.groupBy("cell").agg(F.sum("c").alias("c")).toArrow()  # as arrays: rows as objects take many times the memory
    out = np.zeros(size, np.int64)
    out[got["cell"].to_numpy()] = got["c"].to_numpy()
    return out


def cells(total: np.ndarray) -> pa.RecordBatch:
    at = np.nonzero(total)[0]
    return pa.RecordBatch.from_pydict({"cell": pa.array(at, pa.int64()), "c": pa.array(total[at], pa.int64())})


def listed(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the words of a batch of the vocabulary, their starts and sizes."""
    each = batch.column(column).to_pylist()
    sizes = np.array([len(x) // 2 for x in each], np.int64)
    return np.frombuffer(b"".join(each), "u2").astype(np.int64), np.cumsum(sizes) - sizes, sizes


def subword_counts(vocabulary: DataFrame) -> np.ndarray:
    """Three rows of counts by id: in all words, as first ids of all words, as the only ids of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, END + 1))
        for batch in batches:
            (ids, starts, sizes), c = listed(batch, 0), batch.column(1).to_numpy()
            total[0] += np.bincount(ids, np.repeat(c, sizes), END + 1)
            total[1] += np.bincount(ids[starts], c, END + 1)
            total[2] += np.bincount(ids[starts], c * (sizes == 1), END + 1)
        yield cells(total.ravel().astype(np.int64))

    return summed(vocabulary.select("ids", "c").mapInArrow(run, "cell long, c long"), 3 * (END + 1)).reshape(3, END + 1)


def class_counts(vocabulary: DataFrame, kinds: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """By class: words, words that occur once, and distinct words; and by class, first or later, and id: over distinct words.

    Among later ids, END counts the words, each of which stops once.
    """
    shared = vocabulary.sparkSession.sparkContext.broadcast(kinds)
    size = CLASSES * 2 * (END + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few, total = np.zeros((CLASSES, 3)), np.zeros((CLASSES, 2, END + 1), np.int64)
        for batch in batches:
            (ids, starts, sizes), c = listed(batch, 0), batch.column(1).to_numpy()
            kind = kinds_of(shared.value, ids, starts, sizes)
            for k, x in enumerate((c, c == 1, np.ones(len(c)))):
                few[:, k] += np.bincount(kind, x, CLASSES)
            later = np.ones(len(ids), np.int64)
            later[starts] = 0
            np.add.at(total, (np.repeat(kind, sizes), later, ids), 1)
            np.add.at(total, (kind, 1, END), 1)
        yield cells(np.concatenate([few.ravel().astype(np.int64), total.ravel()]))

    out = summed(vocabulary.select("ids", "c").mapInArrow(run, "cell long, c long"), CLASSES * 3 + size)
    return out[: CLASSES * 3].reshape(CLASSES, 3), out[CLASSES * 3 :].reshape(CLASSES, 2, END + 1)


def id_rows(counts: np.ndarray) -> np.ndarray:
    """The table row of every id: the most frequent have one each, the others share SHARED rows."""
    row = ROWS - SHARED + np.arange(END + 1) % SHARED
    order = np.argsort(-counts, kind="stable")[: ROWS - SHARED]
    row[order] = np.arange(len(order))
    return row


def features(first: np.ndarray) -> np.ndarray:
    """The most frequent first ids have a column each, the others one together."""
    column = np.full(END + 1, FEATURES - 1)
    column[np.argsort(-first, kind="stable")[: FEATURES - 1]] = np.arange(FEATURES - 1)
    return column


def followed(tokens: DataFrame, row: np.ndarray, path: str | None, *, column: np.ndarray | None = None, kinds: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """How often a word of each column (by its first id) comes after one that has an id of each row, over all texts.

    Given classes instead of columns: how often each class comes after a word of each row, by its first id.
    """
    shared, width = tokens.sparkSession.sparkContext.broadcast((row, column, kinds)), CLASSES if column is None else FEATURES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, column, kinds = shared.value
        opens, total = vocabulary_of(path).opens, np.zeros(ROWS * width, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                texts = batch.column(0).slice(i, TEXTS).to_pylist()
                if column is None:
                    w = Words(texts, opens)
                    before = np.concatenate([[w.end], w.targets[:-1]])  # every text ends with the end
                    cell = row[w.firsts()][before] * width + kinds_of(kinds, w.ids, w.starts, w.sizes)[w.targets]
                else:
                    ids, starts, sizes = in_row(texts, opens)
                    after = np.roll(column[ids[starts]], -1)  # after the last end comes the first word, as after any end
                    cell = row[ids] * width + np.repeat(after, sizes)
                total += np.bincount(cell, minlength=len(total))
        yield cells(total)

    return summed(tokens.select("ids").mapInArrow(run, "cell long, c long"), ROWS * width).reshape(ROWS, width)


def word_kinds(follow: np.ndarray, single: np.ndarray, row: np.ndarray, seed: int = 9) -> dict[str, np.ndarray]:
    """What gives words their classes: a vector for each row, by what follows its ids, and centers (k-means over the rows)."""
    base = (follow.sum(axis=0) + 0.5) / (follow.sum() + 0.5 * FEATURES)
    n = follow.sum(axis=1)
    x = np.sqrt((follow + 20 * base) / (n[:, None] + 20)) - np.sqrt(base)
    x = x @ np.linalg.svd((x * np.sqrt(n + 1e-9)[:, None]).T @ (x * np.sqrt(n + 1e-9)[:, None]))[0][:, :AXES]
    rng = np.random.default_rng(seed)
    chance = (n + 1e-9) * (x * x).sum(axis=1) + 1e-12
    centers = x[rng.choice(ROWS, CLASSES - OWN, replace=False, p=chance / chance.sum())]
    for _ in range(12):
        near = ((centers * centers).sum(axis=1) - 2 * x @ centers.T).argmin(axis=1)
        for c in range(CLASSES - OWN):
            w = n * (near == c)
            if w.sum():
                centers[c] = w @ x / w.sum()
    own = np.full(END + 1, -1)
    own[np.argsort(-single, kind="stable")[:OWN]] = np.arange(OWN)
    return {"row": row, "x": x.astype(np.float32), "centers": centers.astype(np.float32), "own": own}


def kinds_of(kinds: dict[str, np.ndarray], ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Classes of words, by the mean vector of their subword ids; words of a single id may have a class of their own."""
    if not len(starts):
        return np.zeros(0, np.int64)
    x = means(kinds["x"], kinds["row"][ids], starts, sizes)
    c = kinds["centers"]
    apart = (c * c).sum(axis=1)[:, None] - 2 * c @ x.T
    near, least = np.full(len(starts), OWN), apart[0].copy()
    for k in range(1, len(c)):  # faster than argmin over so few
        near[apart[k] < least] = OWN + k
        np.minimum(least, apart[k], out=least)
    own = kinds["own"][ids[starts]]
    return np.where((sizes == 1) & (own >= 0), own, near)


class Model:
    """Arrays of a trained model (what tasks need is broadcast as a plain dict of arrays) and the sums made with them."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a = arrays
        i, j = np.arange(BLOCK)[:, None], np.arange(2 * BLOCK)[None, :]
        self.back = i + BLOCK - j  # how far back a key lies; below 0: not yet seen
        self.causal = (self.back >= 0).astype(np.float32)

    @staticmethod
    def start(kinds: dict[str, np.ndarray], few: np.ndarray, spelling: np.ndarray, pairs: np.ndarray, seed: int = 9) -> Model:
        """A model before training: what is counted, and random attention weights."""
        mass, once = few[:, 0].astype(np.float64), few[:, 1]
        base = (mass + 0.5) / (mass + 0.5).sum()
        rng = np.random.default_rng(seed)
        small = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
        escape = np.where(mass > 0, np.minimum(0.9, np.maximum(once, 0.5) / np.maximum(mass, 1)), 1)
        every = (spelling.sum(axis=0) + 0.5) / (spelling.sum(axis=0) + 0.5).sum(axis=1, keepdims=True)
        spell = np.empty(spelling.shape, np.float32)
        for k, each in enumerate(spelling):  # class by class, as sums in doubles for all at once take much memory
            spell[k] = np.log((each + 20 * every) / (each.sum(axis=1, keepdims=True) + 20))
        with np.errstate(divide="ignore"):
            known = np.log1p(-escape) - np.log(np.maximum(mass, 1))
        return Model({
            **kinds, "next": np.log((pairs + 20 * base) / (pairs.sum(axis=1, keepdims=True) + 20)).astype(np.float32),
            "known": known, "escape": np.log(escape), "spell": spell,
            "q": small(ROWS, DIM), "k": small(ROWS, DIM), "v": small(ROWS, DIM), "o": small(DIM, CLASSES) * np.float32(0.1), "r": np.zeros(2 * BLOCK, np.float32)})

    def spelled(self, kind: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Natural logs of unknown words within their classes."""
        sizes = np.diff(np.append(starts, len(ids)))
        later = np.ones(len(ids), np.int64)
        later[starts] = 0
        logs = self.a["spell"][np.repeat(kind, sizes), later, ids].astype(np.float64)
        return np.add.reduceat(logs, starts) + self.a["spell"][kind, 1, END] + self.a["escape"][kind]

    def layout(self, w: Words) -> dict:
        """Texts padded to whole blocks, by their distinct words."""
        room = -(-w.n // BLOCK) * BLOCK
        at = np.cumsum(room) - room
        place = np.repeat(at - (np.cumsum(w.n) - w.n), w.n) + np.arange(len(w.targets))
        inputs = np.full(int(room.sum()) + BLOCK, w.end)
        inputs[BLOCK + place[1:]] = w.targets[:-1]
        inputs[BLOCK + at] = w.end
        kind = kinds_of(self.a, w.ids, w.starts, w.sizes)
        goal = np.full(int(room.sum()), -1)
        goal[place] = kind[w.targets]
        first = np.zeros(len(goal) // BLOCK, bool)
        first[at // BLOCK] = True
        return {"rows": self.a["row"][w.ids], "starts": w.starts, "size": w.sizes, "inputs": inputs, "goal": goal, "first": first, "place": place, "kind": kind}

    def tables(self) -> np.ndarray:
        """The tables side by side: a row has an id's query, key and value."""
        return np.concatenate([self.a[t] for t in TABLES], axis=1)

    def forward(self, vectors: np.ndarray, inputs: np.ndarray, first: np.ndarray, before: np.ndarray) -> tuple:
        """Attention of some blocks: queries, keys, values, weights, sums, and exponentials of the classes' scores.

        vectors: queries, keys and values of the distinct words, side by side.
        """
        x = np.take(vectors, inputs, axis=0)
        window = lambda x: np.lib.stride_tricks.as_strided(x, (len(x) // BLOCK - 1, 2 * BLOCK, DIM), (BLOCK * x.strides[0], *x.strides))
        q, k, v = x[BLOCK:].reshape(-1, BLOCK, 3 * DIM)[:, :, :DIM], window(x[:, DIM : 2 * DIM]), window(x[:, 2 * DIM :])
        e = np.matmul(q, np.ascontiguousarray(k.transpose(0, 2, 1)))
        e += self.a["r"][np.clip(self.back, 0, 2 * BLOCK - 1)]
        np.exp(np.clip(e, -MOST, MOST, out=e), out=e)
        e *= self.causal
        e[first, :, :BLOCK] = 0
        e /= (e.reshape(-1, 2 * BLOCK) @ np.ones((2 * BLOCK, 1), np.float32)).reshape(-1, BLOCK, 1)
        h = np.matmul(e, v)
        d = h.reshape(-1, DIM) @ self.a["o"]
        d += np.take(self.a["next"], before, axis=0)
        np.exp(np.clip(d, -MOST, MOST, out=d), out=d)
        return q, k, v, e, h, d

    def class_logs(self, lay: dict) -> np.ndarray:
        """Natural logs of the probabilities of the words' classes, given the words before them."""
        vectors, out = means(self.tables(), lay["rows"], lay["starts"], lay["size"]), np.empty(len(lay["goal"]))
        before = lay["rows"][lay["starts"]]
        for at in range(0, len(lay["first"]), CHUNK):
            part = slice(at, min(len(lay["first"]), at + CHUNK))
            inputs = lay["inputs"][part.start * BLOCK : (part.stop + 1) * BLOCK]
            d = self.forward(vectors, inputs, lay["first"][part], before[inputs[BLOCK:]])[5]
            goal = lay["goal"][part.start * BLOCK : part.stop * BLOCK]
            out[part.start * BLOCK : part.stop * BLOCK] = np.log(d[np.arange(len(goal)), goal] / (d @ np.ones(CLASSES, np.float32)))
        return out[lay["place"]]

    def learn(self, texts: Words, rate: float, seed: int = 9) -> None:
        """One pass over all blocks, in random order, by Adam."""
        lay = self.layout(texts)
        n = len(lay["first"])
        batch = max(16, min(BATCH, n // 32))  # few texts take as many steps as a whole piece
        p = {"tables": self.tables(), "o": self.a["o"], "r": self.a["r"]}
        m = {k: [np.zeros_like(x), np.zeros_like(x), np.empty_like(x)] for k, x in p.items()}
        places = np.random.default_rng(seed).permutation(np.arange(0, n, batch))
        seen = self.back >= 0
        for step, at in enumerate(places.tolist(), 1):
            part = slice(at, min(n, at + batch))
            inputs = lay["inputs"][part.start * BLOCK : (part.stop + 1) * BLOCK]
            order, *groups = grouped(inputs)
            here = inputs[order[groups[0]]]
            inputs = np.empty(len(order), np.int64)
            inputs[order] = np.repeat(np.arange(len(here)), groups[1])
            rows, starts, size = gathered(lay["rows"], lay["starts"][here], lay["size"][here])
            q, k, v, e, h, d = self.forward(means(p["tables"], rows, starts, size), inputs, lay["first"][part], rows[starts][inputs[BLOCK:]])
            d /= d @ np.ones((CLASSES, 1), np.float32)
            goal = lay["goal"][part.start * BLOCK : part.stop * BLOCK]
            d[np.arange(len(d)), goal] -= 1
            d *= (goal >= 0)[:, None] / np.float32(max(1, (goal >= 0).sum()))
            dh = (d @ p["o"].T).reshape(h.shape)
            dp = np.matmul(dh, np.ascontiguousarray(v.transpose(0, 2, 1)))
            ds = e * (dp - ((e * dp).reshape(-1, 2 * BLOCK) @ np.ones((2 * BLOCK, 1), np.float32)).reshape(-1, BLOCK, 1))
            grads = {"o": h.reshape(-1, DIM).T @ d, "r": np.bincount(self.back[seen], ds.sum(axis=0)[seen], 2 * BLOCK).astype(np.float32)}
            each = np.zeros((len(inputs), 3 * DIM), np.float32)
            each[BLOCK:, :DIM] = np.matmul(ds, k).reshape(-1, DIM)
            for name, g in ((1, np.matmul(ds.transpose(0, 2, 1), q)), (2, np.matmul(e.transpose(0, 2, 1), dh))):
                own = each[:, name * DIM : (name + 1) * DIM]  # windows overlap: a key is in two of them
                own[:-BLOCK] += g[:, :BLOCK].reshape(-1, DIM)
                own[BLOCK:] += g[:, BLOCK:].reshape(-1, DIM)
            by_word = sums(each, order, *groups, 4) / size[:, None].astype(np.float32)
            order, *groups = grouped(rows)
            grads["tables"] = np.zeros_like(p["tables"])
            grads["tables"][rows[order[groups[0]]]] = sums(by_word, np.repeat(np.arange(len(here)), size)[order], *groups, 4)
            for name, g in grads.items():
                a, b, root = m[name]
                a *= np.float32(0.9)
                b *= np.float32(0.99)
                np.multiply(g, g, out=root)
                root *= np.float32(0.01)
                b += root
                g *= np.float32(0.1)
                a += g
                np.sqrt(b, out=root)
                root *= np.float32(1 / np.sqrt(1 - 0.99**step))
                root += np.float32(1e-8)
                np.divide(a, root, out=root)
                root *= np.float32(rate * (1 - step / (len(places) + 1)) / (1 - 0.9**step))
                p[name] -= root
        for k, name in enumerate(TABLES):
            self.a[name] = np.ascontiguousarray(p["tables"][:, k * DIM : (k + 1) * DIM])


def grouped(to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of places in which equal numbers stand together, where each number's places start there, and how many they are."""
    order = np.argsort(to.astype(np.uint16) if to.max() < 1 << 16 else to, kind="stable")  # by digits, if so short
    sorted_ = to[order]
    starts = np.append(0, np.nonzero(sorted_[1:] != sorted_[:-1])[0] + 1)
    return order, starts, np.diff(starts, append=len(to))


def learn_in_tasks(tokens: DataFrame, model: Model, rate: float, path: str | None) -> int:
    """Takes attention weights through the texts of every task, and averages them by words; gives the number of words."""
    names = (*TABLES, "o", "r")
    shared = tokens.sparkSession.sparkContext.broadcast(model.a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(shared.value | {k: shared.value[k].copy() for k in names})  # the broadcast arrays serve other tasks of this worker
        opens, texts, held, seen = vocabulary_of(path).opens, [], 0, 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                texts.append(t)
                held += len(t)
                if held > 8 * PIECE:  # about four ids of two bytes a word
                    w = Words(texts, opens)
                    own.learn(w, rate)
                    texts, held, seen = [], 0, seen + len(w.targets)
        if texts:
            w = Words(texts, opens)
            own.learn(w, rate)
            seen += len(w.targets)
        if seen:
            weights = np.concatenate([own.a[k].ravel() for k in names]).astype(np.float64)
            sums = np.concatenate([[seen], np.rint(weights * FIXED) * seen]).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(len(sums)), pa.int64()), "c": pa.array(sums, pa.int64())})

    got = summed(tokens.select("ids").mapInArrow(run, "cell long, c long"), 1 + sum(model.a[k].size for k in names)).astype(np.float64)
    at = 1
    for k in names if got[0] else ():
        size = model.a[k].size
        model.a[k] = (got[at : at + size] / got[0] / FIXED).reshape(model.a[k].shape).astype(np.float32)
        at += size
    return int(got[0])


def train(tokens: DataFrame, *, path: str | None = None, shares: tuple[float, ...] = SHARES, rates: tuple[float, ...] = RATES) -> tuple[Model, DataFrame]:
    """A model of tokenised texts, and the vocabulary (h, ids, c) that its counts come from."""
    vocabulary = stored(word_counts(tokens, path), "lm-words")
    every, first, single = subword_counts(vocabulary)
    row = id_rows(every)
    kinds = word_kinds(followed(tokens, row, path, column=features(first)), single, row)
    model = Model.start(kinds, *class_counts(vocabulary, kinds), followed(tokens, row, path, kinds=kinds))
    for texts, rate in zip(dealt(tokens, shares), rates, strict=True):
        learn_in_tasks(texts, model, rate, path)
    return model, vocabulary


def dealt(tokens: DataFrame, shares: tuple[float, ...]) -> list[DataFrame]:
    """The texts of each round: a round goes on where the one before stopped, so that shares of 1 in all take every text once."""
    drawn = F.shiftrightunsigned(F.xxhash64("ids"), 11) / float(1 << 53)
    return [tokens.where(F.pmod(drawn - F.lit(float(sum(shares[:k]) % 1)), F.lit(1.0)) < share) for k, share in enumerate(shares)]


def frequent(vocabulary: DataFrame) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Hashes, in order, and counts of the most frequent words, HEAVY at most; and h and c of the others."""
    octave = F.floor(F.log2("c") * 8)
    room, least = HEAVY, None  # the lowest eighth of an octave from which on at most HEAVY words are
    for r in sorted(vocabulary.groupBy(octave.alias("o")).count().collect(), reverse=True):
        if r[1] > room:
            break
        room, least = room - r[1], r[0]
    heavy = octave >= least if least is not None else F.lit(False)
    got = vocabulary.where(heavy).select("h", "c").toArrow()
    h, c = got["h"].to_numpy(), got["c"].to_numpy()
    order = np.argsort(h)
    return h[order], c[order], vocabulary.where(~heavy).select("h", "c")


def score_texts(docs: DataFrame, training: DataFrame, *, text: str = "text", path: str | None = None, **options) -> DataFrame:
    """docs, without the text, with n_tokens, n_known, train_tokens, base_score and score added.

    Null texts count as empty ones: one token, the end. `training` has the texts to learn from; with
    none of them all words are unknown. Rows that repeat are scored alike. Columns of docs with these
    names, or named ids, are replaced. An empty table gives no rows. Texts are scored whole, in
    batches of texts; a very long one is a batch of its own size.
    """
    return scored(stored(tokenised(docs, text, path), "lm-texts"), *train(stored(tokenised(training.select(text), text, path), "lm-training"), path=path, **options), path=path)


def scored(tokens: DataFrame, model: Model, vocabulary: DataFrame, *, path: str | None = None) -> DataFrame:
    """Tokenised texts with their scores in place of ids."""
    spark = tokens.sparkSession
    total, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    den = total + 0.5 * (distinct + 1)
    hashes, counts, rare_counts = frequent(vocabulary)
    shared = spark.sparkContext.broadcast((hashes, counts, model.a))

    own = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "ids")
    carried = [c for c in tokens.columns if c not in own]
    rows = tokens.select(*carried, F.monotonically_increasing_id().alias("_uid"), "ids")
    at, schema = len(carried) + 1, rows.drop("ids").schema
    rare_kind = T.ArrayType(T.StructType().add("h", "long").add("spelled", "double").add("known", "double"))
    for name, kind in (("_n", "long"), ("_frequent", "long"), ("_base", "double"), ("_score", "double"), ("_rare", rare_kind)):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, arrays = shared.value
        opens, model = vocabulary_of(path).opens, Model(arrays)
        item = pa.struct([("h", pa.int64()), ("spelled", pa.float64()), ("known", pa.float64())])
        for whole in batches:
            for i in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(i, TEXTS)
                w = Words(batch.column(at).to_pylist(), opens)
                starts = np.cumsum(w.n) - w.n
                lay = model.layout(w)
                found = np.minimum(np.searchsorted(hashes, w.hash), max(0, len(hashes) - 1))
                count = np.where(hashes[found] == w.hash, counts[found], 0) if len(hashes) else np.zeros(len(w.hash), np.int64)
                share = model.a["known"][lay["kind"]]
                known = np.where(count > 0, share + np.log(np.maximum(count, 1)), 0)
                base = np.where(count > 0, np.log10((count + 0.5) / den), 0)
                t = w.targets
                score = np.add.reduceat(model.class_logs(lay) + known[t], starts) / np.log(10)
                unknown = count[t] == 0
                many = np.add.reduceat(unknown.astype(np.int64), starts)
                u, spelled = t[unknown], model.spelled(lay["kind"], w.ids, w.starts)
                items = pa.StructArray.from_arrays([pa.array(w.hash[u]), pa.array(spelled[u]), pa.array(share[u])], fields=list(item))
                rares = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), items)
                new = [pa.array(w.n, pa.int64()), pa.array(w.n - many, pa.int64()), pa.array(np.add.reduceat(base[t], starts), pa.float64()), pa.array(score, pa.float64()), rares]
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], *new], schema.names)

    out = stored(rows.mapInArrow(run, schema), "lm-scored")
    rare = out.where(F.size("_rare") > 0).select("_uid", F.explode("_rare").alias("r")).select("_uid", "r.*")
    c = F.coalesce("c", F.lit(0))
    ten = F.lit(float(np.log(10)))
    word = F.when(c > 0, F.col("known") + F.log(c)).otherwise(F.col("spelled"))
    rest = rare.join(rare_counts, "h", "left").groupBy("_uid").agg(
        F.sum(F.log10((c + 0.5) / F.lit(float(den)))).alias("_b"), F.count_if(c > 0).alias("_k"), (F.sum(word) / ten).alias("_s"))
    return out.join(rest, "_uid", "left").select(
        *carried, F.col("_n").alias("n_tokens"), (F.col("_frequent") + F.coalesce("_k", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_b", F.lit(0.0))).alias("base_score"), (F.col("_score") + F.coalesce("_s", F.lit(0.0))).alias("score"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc_rem("doc_id", 5) == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out.alias("held_out"), "text")
    tokens = stored(tokenised(docs), "lm-texts")
    return scored(tokens, *train(tokens.where("NOT held_out")))
