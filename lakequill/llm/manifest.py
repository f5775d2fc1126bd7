"""Merkle manifest of a dataset: superblock reduction.

Leaves are digests of rows, in order within their group (source). A tree of the given fanout stands
over each group, and another over the groups' roots. Leaves are bucketed by index / fanout**levels;
each bucket is collapsed by `levels` levels in one task, and the bucket roots are reduced the same
way until each group has one root. Proofs go down again: what a bucket's root needs is computed
once and appended to the proofs of the bucket's members.

A proof is a string of steps, joined by commas: the run's siblings on the left, a dot, those on the
right. Folding a leaf with its proof gives the root of the dataset.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakequill.llm.common import crc_rem, crc_sql, stored, table

FANOUT = 3
LEVELS = 6  # collapsed in one bucket: 729 leaves
NODE = "_group string, _index long, _n long, _digest string"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` for null, else the count of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def hashed(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def collapsed(digests: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The nodes of each level, from the digests themselves up."""
    out = [digests]
    for _ in range(levels):
        below = out[-1]
        out.append([hashed(below[i:i + fanout]) for i in range(0, len(below), fanout)])
    return out


def height(n: int, fanout: int) -> int:
    h, reach = 0, 1
    while reach < n:
        h, reach = h + 1, reach * fanout
    return h


def proofs_below(nodes: list[list[str]], upper: str, fanout: int) -> list[str]:
    """The proof of each node of the lowest level, given that of the node on top."""
    paths = [upper] * len(nodes[-1])
    for below in reversed(nodes[:-1]):
        steps = []
        for i in range(len(below)):
            first = i - i % fanout
            step = "".join(below[first:i]) + "." + "".join(below[i + 1:first + fanout])
            above = paths[i // fanout]
            steps.append(f"{step},{above}" if above else step)
        paths = steps
    return paths


def fold(leaf: str, proof: str) -> str:
    for step in proof.split(",") if proof else []:
        left, right = step.split(".")
        leaf = hashed([left, leaf, right])
    return leaf


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with _index, from 0 within _group in the given order, and _n, the group's rows.

    Sorted by ranges, so that a large group spreads over tasks; only counts per range and group are
    summed up.
    """
    keys = ["_group", *order]
    placed = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    counts = placed.groupBy("_group", "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    group = Window.partitionBy("_group")
    before = F.sum("_rows").over(group.orderBy("_range")) - F.col("_rows")
    starts = counts.select("_group", "_range", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(group).alias("_n"))
    return placed.join(starts, ["_group", "_range"]).withColumn("_index", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def bucketed(nodes: DataFrame, size: int) -> DataFrame:
    return nodes.withColumn("_bucket", F.floor(F.col("_index") / size).cast("long"))


def reduced(nodes: DataFrame, depth: int, levels: int, fanout: int, name: str) -> DataFrame:
    """The bucket roots of nodes that stand `depth` levels above the leaves."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_index")
        n = int(part["_n"].iloc[0])
        take = min(max(height(n, fanout) - depth, 0), levels)
        top = collapsed(part["_digest"].tolist(), take, fanout)[-1]
        return pd.DataFrame({"_group": part["_group"].iloc[:1], "_index": part["_bucket"].iloc[:1], "_n": [n], "_digest": top})

    columns = ["_group", "_index", "_n", "_digest"]
    return stored(bucketed(nodes.select(*columns), fanout**levels).groupBy("_group", "_bucket").applyInPandas(run, NODE), name)


def tree(leaves: DataFrame, levels: int, fanout: int, name: str) -> list[DataFrame]:
    """The leaves, their bucket roots, the roots of these, and so on up to one root a group."""
    largest = leaves.agg(F.max("_n")).first()[0] or 1
    out = [leaves]
    while (len(out) - 1) * levels < max(1, height(largest, fanout)):
        out.append(reduced(out[-1], (len(out) - 1) * levels, levels, fanout, f"{name}-{len(out)}"))
    return out


def proven(nodes: DataFrame, above: DataFrame, depth: int, levels: int, fanout: int, carried: list[str]) -> DataFrame:
    """nodes with _proof, _subroot and _root, from those of their bucket roots (above: _group, _index, ...)."""
    dropped = ["_digest", "_n"] if not carried else ["_n"]
    kept = [c for c in nodes.columns if c not in dropped]
    schema = nodes.select(*kept).schema.add("_proof", "string").add("_subroot", "string").add("_root", "string")

    def run(part: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_index").reset_index(drop=True)
        take = min(max(height(int(part["_n"].iloc[0]), fanout) - depth, 0), levels)
        nodes = collapsed(part["_digest"].tolist(), take, fanout)
        proof, subroot, root = up[["_proof", "_subroot", "_root"]].iloc[0]
        return part[kept].assign(_proof=proofs_below(nodes, proof, fanout), _subroot=subroot, _root=root)

    buckets = bucketed(nodes, fanout**levels).groupBy("_group", "_bucket")
    return buckets.cogroup(above.withColumnRenamed("_index", "_bucket").groupBy("_group", "_bucket")).applyInPandas(run, schema)


def descended(nodes: list[DataFrame], tops: DataFrame, levels: int, fanout: int, carried: list[str], name: str) -> DataFrame:
    """Proofs of the leaves of a tree, given those of its groups' roots (tops: _group, _index = 0, ...)."""
    above = tops
    for depth in reversed(range(len(nodes) - 1)):
        above = proven(nodes[depth], above, depth * levels, levels, fanout, [] if depth else carried)
        if depth:
            above = stored(above, f"{name}-proofs-{depth}")
    return above


def manifest(leaves: DataFrame, *, group: str = "source", order: str = "doc_id", leaf: str = "leaf", levels: int = LEVELS, fanout: int = FANOUT) -> DataFrame:
    """leaves (order, group and leaf columns, any others are kept) with subroot, root and proof.

    Leaves ascend by the order column within their group (null first; equal ones by leaf, then by
    chance among rows that are the same). Null is a group of its own, the first. Groups are ordered
    by their UTF-8 bytes. Repeated rows are leaves of their own. Columns of leaves named subroot,
    root or proof are replaced. An empty table gives none. Texts aren't needed: only digests are
    shuffled. A group of any size spreads over buckets of fanout**levels leaves.
    """
    names = [c for c in leaves.columns if c not in ("subroot", "root", "proof")]
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    rows = leaves.select(F.struct(*names).alias("_row"), key.alias("_group"), F.col(order).alias("_order"), F.col(leaf).alias("_digest"))
    rows = stored(ranked(rows, ["_order", "_digest"], "manifest-leaves").drop("_order"), "manifest-ranked")
    lower = tree(rows, levels, fanout, "manifest-group")
    subroots = lower[-1].select(F.lit("").alias("_group"), F.col("_group").alias("_name"), "_digest")
    upper = tree(stored(ranked(subroots, ["_name"], "manifest-subroots"), "manifest-subroots-ranked"), levels, fanout, "manifest-root")
    top = upper[-1].select("_group", "_index", F.lit("").alias("_proof"), F.lit("").alias("_subroot"), F.col("_digest").alias("_root"))
    tops = descended(upper, top, levels, fanout, ["_name"], "manifest-root")
    tops = stored(tops.select(F.col("_name").alias("_group"), F.lit(0).cast("long").alias("_index"), "_proof", F.col("_digest").alias("_subroot"), "_root"), "manifest-tops")
    out = descended(lower, tops, levels, fanout, ["_row"], "manifest-group")
    return out.select("_row.*", F.col("_subroot").alias("subroot"), F.col("_root").alias("root"), F.col("_proof").alias("proof"))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""

    @F.pandas_udf("string")
    def run(leaves: pd.Series, proofs: pd.Series) -> pd.Series:
        return pd.Series([fold(a, b) for a, b in zip(leaves, proofs, strict=True)], dtype=object)

    return run(leaf, proof)


def siblings_digest(proof: Column) -> Column:
    """Digest of all siblings of a proof, in its order."""
    return F.sha2(F.translate(proof, ".,", "").cast("binary"), 256)


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its proof, and the root that its tampered text gives."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    fields = {c: field(F.col(c)) for c in COLUMNS}
    tampered = F.when((crc_rem("doc_id", 2) == 0) & F.col("text").contains("\n"), digest(*(fields | {"text": field(F.translate("text", "\n", ""))}).values()))
    # digests are written before they are ranked: sampling the ranges then reads no text
    leaves = stored(docs.select("doc_id", "source", digest(*fields.values()).alias("leaf"), tampered.alias("tampered")), "manifest-digests")
    out = manifest(leaves).withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field_sql(value: str) -> str:
    return f"coalesce(octet_length(encode(({value})::VARCHAR))::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


# Two recursions over the levels: nodes of all trees, then each document's path. Tree '' stands over the sources.
OP13_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS g, {_leaf_sql('text')} AS leaf,
         CASE WHEN {crc_sql('doc_id::VARCHAR')} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql('text')} END AS tampered FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves),
low(g, l, i, n, d) AS (
  SELECT g, 0, i, n, leaf FROM ranked
  UNION ALL
  SELECT g, l + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY g, l, i // 3, n),
sub AS (SELECT g, d AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
high(l, i, n, d) AS (
  SELECT 0, i, n, subroot FROM sub
  UNION ALL
  SELECT l + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY l, i // 3, n),
low_runs AS (SELECT g, l, i // 3 AS r, list(d ORDER BY i) AS ds FROM low WHERE n > 1 GROUP BY ALL),
high_runs AS (SELECT l, i // 3 AS r, list(d ORDER BY i) AS ds FROM high WHERE n > 1 GROUP BY ALL),
walk(doc_id, g, leaf, l, i, f, p) AS (
  SELECT doc_id, g, leaf, 0, i, tampered, '' FROM ranked
  UNION ALL
  SELECT w.doc_id, w.g, w.leaf, w.l + 1, r.r, sha256(array_to_string(ds[1:w.i % 3], '') || f || array_to_string(ds[w.i % 3 + 2:], '')),
         p || array_to_string(ds[1:w.i % 3], '') || array_to_string(ds[w.i % 3 + 2:], '')
  FROM walk w JOIN low_runs r ON w.g = r.g AND w.l = r.l AND w.i // 3 = r.r),
half AS (SELECT * FROM walk QUALIFY l = max(l) OVER (PARTITION BY g)),
rise(doc_id, subroot, leaf, l, i, f, p) AS (
  SELECT doc_id, subroot, leaf, 0, s.i, f, p FROM half JOIN sub s USING (g)
  UNION ALL
  SELECT w.doc_id, w.subroot, w.leaf, w.l + 1, r.r, sha256(array_to_string(ds[1:w.i % 3], '') || f || array_to_string(ds[w.i % 3 + 2:], '')),
         p || array_to_string(ds[1:w.i % 3], '') || array_to_string(ds[w.i % 3 + 2:], '')
  FROM rise w JOIN high_runs r ON w.l = r.l AND w.i // 3 = r.r)
SELECT doc_id, leaf, subroot, (SELECT d FROM high WHERE n = 1) AS root, sha256(p) AS proof_sha256, f AS folded_root, f = (SELECT d FROM high WHERE n = 1) AS verified
FROM rise QUALIFY l = max(l) OVER ()
"""
