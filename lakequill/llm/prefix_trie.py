"""Prefix trie of conversations by leaf-peeling message passing.

A node is a distinct sequence of first turns; its members are the conversations that start with it,
and (smallest member, depth) names it. Nodes hold a counter of children that aren't complete. Each
round, the nodes whose counter is at zero send the totals of their subtree to their parent, until
only the root finishes. Nodes in a row that have the same members are one vertex of the peeling, so
that there are as many rounds as there are branchings on a path, and unshared tails need none.

Turns are told apart by SHA-256, prefixes by the exclusive or of two 64-bit hashes of depth and
turn (128 bits): texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakequill.llm.common import by_group, crc_rem, crc_sql, stored, table

KEY = ["depth", "k1", "k2"]
PACKED = 1 << 16  # characters of ids in one row at most, but for a single longer id


def turn_digest(role: Column, text: Column) -> Column:
    r, t = (F.coalesce(c, F.lit("")) for c in (role, text))
    return F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t).cast("binary"), 256)


def paths(turns: DataFrame) -> DataFrame:
    """conv, depth, hashes of the prefix and of the one before it, len, and whether it is the whole conversation.

    turns: conv, at, _digest, _len. Running hashes stream through one sort.
    """
    w = Window.partitionBy("conv").orderBy("at")
    placed = turns.withColumn("depth", F.row_number().over(w).cast("long"))
    for k in ("k1", "k2"):
        placed = placed.withColumn(k, F.bit_xor(F.xxhash64(F.lit(k), "depth", "_digest")).over(w))
    before = [F.lag(k, 1, 0).over(w).alias(p) for k, p in (("k1", "p1"), ("k2", "p2"))]
    return placed.select("conv", *KEY, *before, F.col("_len").alias("len"), F.lead("depth").over(w).isNull().alias("ends"))


def runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    """The node and the other columns of every row."""
    for batch in batches:
        for d, a, b, *rest in zip(*(batch.column(c).to_pylist() for c in (*KEY, *columns)), strict=True):
            yield (d, a, b), *rest


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    while taken := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*taken, strict=True), schema.types, strict=True)], schema=schema)


def packed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one node in rows of PACKED characters, joined by commas, with the first of each row. Rows come sorted by node and id."""

    def packed() -> Iterator[tuple]:
        last, ids, size = None, [], 0
        for node, conv in runs(batches, ["conv"]):
            if ids and (node != last or size >= PACKED):
                yield *last, ids[0], ",".join(map(str, ids))
                ids, size = [], 0
            last = node
            ids.append(conv)
            size += len(str(conv)) + 1
        if ids:
            yield *last, ids[0], ",".join(map(str, ids))

    return batched(packed(), PACKED_SCHEMA, 100)


def hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's ids, fed row by row. Rows come sorted by node and first id."""

    def hashes() -> Iterator[tuple]:
        last, digest = None, None
        for node, ids in runs(batches, ["ids"]):
            if node == last:
                digest.update(b"," + ids.encode())
                continue
            if last is not None:
                yield *last, digest.hexdigest()
            last, digest = node, sha256(ids.encode())
        if last is not None:
            yield *last, digest.hexdigest()

    return batched(hashes(), HASHED_SCHEMA)


NODE = [("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())]
PACKED_SCHEMA = pa.schema([*NODE, ("first", pa.int64()), ("ids", pa.string())])
HASHED_SCHEMA = pa.schema([*NODE, ("ends_sha256", pa.string())])


def ends_digests(ends: DataFrame) -> DataFrame:
    """depth, k1, k2, ends_sha256. A node's many ids are sorted by ranges over all tasks and packed there; one task then hashes the packed runs, in order."""
    packed = ends.repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv").mapInArrow(packed_ids, "depth long, k1 long, k2 long, first long, ids string")
    return packed.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(hashed_ids, "depth long, k1 long, k2 long, ends_sha256 string")


def peeled(vertices: DataFrame) -> DataFrame:
    """conv, n, leaves, saved of every vertex's subtree. vertices: conv, n, parent_conv, parent_n, kids, own."""
    done = [vertices.where("kids = 0").select("conv", "n", "parent_conv", "parent_n", F.lit(1).cast("long").alias("leaves"), F.col("own").alias("saved"))]
    waiting = vertices.where("kids > 0").select("conv", "n", "parent_conv", "parent_n", F.col("kids").alias("remaining"), F.lit(0).cast("long").alias("leaves"), F.col("own").alias("saved"))
    while not waiting.isEmpty():
        sent = done[-1].where("parent_conv IS NOT NULL").groupBy(F.col("parent_conv").alias("conv"), F.col("parent_n").alias("n")).agg(
            F.count(F.lit(1)).alias("_c"), F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
        told = waiting.join(sent, ["conv", "n"], "left")
        state = stored(told.select(
            "conv", "n", "parent_conv", "parent_n", *[(F.col(c) + sign * F.coalesce(m, F.lit(0))).alias(c) for c, m, sign in (("remaining", "_c", -1), ("leaves", "_l", 1), ("saved", "_s", 1))]), "trie-state")
        done.append(state.where("remaining = 0").drop("remaining"))
        waiting = state.where("remaining > 0")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("parent_conv", "parent_n")


def digested(turns: DataFrame, *, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, at (place by order, null first, ties by digest), _digest and _len of every turn with an id."""
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(order).alias("_order"), turn_digest(F.col(role), F.col(text)).alias("_digest"),
        F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("_len"))
    return rows.withColumn("at", F.row_number().over(Window.partitionBy("conv").orderBy(F.asc_nulls_first("_order"), "_digest"))).drop("_order")


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None, *, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per distinct prefix of the conversations, the root (depth 0, no turns) included.

    conv_id (its smallest member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves, saved_tokens (characters that sharing saves in its subtree) and ends_sha256 (digest of
    the ids of the conversations that end there, ascending).

    turns: a row per turn; conversations: one row or more per id, where some may have no turns and so
    end at the root (default: those of turns). Null order comes first, ties go by digest of the turn.
    Null role or text counts as empty. Rows without an id are left out. Repeated rows are turns of
    their own. Other columns are ignored, whatever their names. Without conversations there is no
    root and no row.
    """
    every = turns if conversations is None else conversations
    return trie_of(digested(turns, conv=conv, order=order, role=role, text=text), every.select(F.col(conv).cast("long").alias("conv")).where("conv IS NOT NULL").distinct())


def trie_of(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The trie of turns (conv, at, _digest, _len) and of all conversations (conv, once each)."""
    steps = stored(paths(turns), "trie-paths")
    conversations = stored(conversations, "trie-conversations")
    zero = F.lit(0).cast("long")
    root = conversations.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n")).where("n > 0").select(*[zero.alias(c) for c in KEY], "conv", "n", F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("len"))
    inner = steps.groupBy(*KEY).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("len").alias("len"))
    nodes = stored(root.unionByName(inner), "trie-nodes")

    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("kids"))
    nodes = stored(nodes.join(kids, KEY, "left").fillna(0, ["kids"]), "trie-counted")
    parents = nodes.where("kids > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent_conv"), F.col("n").alias("parent_n"), F.col("kids").alias("n"))
    below = by_group(nodes.withColumnRenamed("n", "_n"), parents, ["p1", "p2", "depth"], "conv", nodes.count()).select(
        *KEY, "conv", F.col("_n").alias("n"), "kids", "len", F.col("_found.parent_conv").alias("parent_conv"), F.col("_found.parent_n").alias("parent_n"))
    nodes = stored(below.withColumn("own", (F.col("n") - 1) * F.col("len")), "trie-linked")

    chain = nodes.groupBy("conv", "n").agg(F.min_by(F.struct("parent_conv", "parent_n"), "depth").alias("p"), F.max_by("kids", "depth").alias("kids"), F.sum("own").alias("own"))
    totals = peeled(stored(chain.select("conv", "n", "p.parent_conv", "p.parent_n", "kids", "own"), "trie-vertices"))
    above = F.sum("own").over(Window.partitionBy("conv", "n").orderBy("depth")) - F.col("own")
    whole = nodes.join(totals, ["conv", "n"]).withColumn("saved_tokens", F.col("saved") - above)

    ending = steps.where("ends").select(*KEY, "conv")
    turnless = conversations.join(ending.select("conv"), "conv", "left_anti").select(*[zero.alias(c) for c in KEY], "conv")
    ended = whole.join(ends_digests(ending.unionByName(turnless)), KEY, "left")
    return ended.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"),
        "saved_tokens", F.coalesce("ends_sha256", F.lit(sha256().hexdigest())).alias("ends_sha256"))


def rebuilt(turns: DataFrame, *, block: int = 100, spread: int = 6) -> DataFrame:
    """Conversations that share openings: turns (conv, at, ...) of c are the first h of conversation c - c % block, then its own after its first h; h = crc32(c) % spread."""
    h = crc_rem("conv", spread)
    own = turns.where(F.col("at") > h).withColumn("_part", F.lit(1))
    heads = turns.where((F.col("conv") % block == 0) & (F.col("at") < spread)).withColumnRenamed("conv", "_base")
    takers = turns.select("conv").distinct().withColumn("_h", h).where("_h > 0").withColumn("_base", F.col("conv") - F.col("conv") % block)
    opening = takers.join(heads, "_base").where(F.col("at") <= F.col("_h")).withColumn("_part", F.lit(0))
    both = own.unionByName(opening.select(*own.columns))
    return both.withColumn("at", F.struct("_part", "at")).drop("_part")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt so that they share openings."""
    turns = stored(digested(table(spark, sf_dir, "conversations")), "trie-turns")
    return trie_of(rebuilt(turns), turns.select("conv").distinct())


OP11_SQL = f"""
WITH own AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, {crc_sql('c::VARCHAR')} % 6 AS h FROM (SELECT DISTINCT c FROM own)),
turns AS (
  SELECT c, 1 AS part, pos, role, text FROM own JOIN convs USING (c) WHERE pos > h
  UNION ALL SELECT v.c, 0, o.pos, o.role, o.text FROM convs v JOIN own o ON o.c = v.c - v.c % 100 AND o.pos <= v.h),
steps AS (SELECT c, row_number() OVER w AS depth, length(text) AS len, list(length(role) || ':' || role || text) OVER (w ROWS UNBOUNDED PRECEDING) AS path FROM turns WINDOW w AS (PARTITION BY c ORDER BY part, pos)),
prefixes AS (SELECT c, depth, len, sha256(path::VARCHAR) AS k FROM steps UNION ALL SELECT c, 0, 0, '' FROM convs),
members AS (SELECT *, min(c) OVER (PARTITION BY depth, k) AS m, depth = max(depth) OVER (PARTITION BY c) AS ends FROM prefixes),
nodes AS (SELECT m, depth, count(*) AS n, min(len) AS len, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM members GROUP BY m, depth),
linked AS (SELECT n.*, p.m AS parent FROM nodes n LEFT JOIN members p ON p.c = n.m AND p.depth = n.depth - 1),
kids AS (SELECT parent AS m, depth - 1 AS depth, count(*) AS kids FROM linked WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT l.*, coalesce(kids, 0) AS kids FROM linked l LEFT JOIN kids USING (m, depth)),
totals AS (SELECT a.m, a.depth, count(*) FILTER (d.kids = 0) AS leaves, sum((d.n - 1) * d.len) AS saved FROM full_nodes d JOIN members a ON a.c = d.m AND a.depth <= d.depth GROUP BY a.m, a.depth)
SELECT m AS conv_id, depth, parent AS parent_conv_id, n AS n_convs, kids AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, ends_sha256 FROM full_nodes JOIN totals USING (m, depth)
"""
