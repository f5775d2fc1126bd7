"""Entity graph: vertices, co-occurrence edges, neighbours and ontology counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Entity types that are kept.
KINDS = ("PERSON", "ORG", "GPE", "LOC", "PRODUCT", "EVENT", "WORK_OF_ART", "LAW")


def extract(chunks: DataFrame, *, id_col: str, text: str) -> DataFrame:
    """Stand-in for a model: runs of two capitalised words or more, 2 to 200 characters, as ORG; one row each."""
    spans = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+"), F.lit(0)))
    found = chunks.where(F.length(F.trim(text)) > 0).select(id_col, F.explode(spans).alias("name"))
    return found.where(F.length("name").between(2, 200)).withColumn("type", F.lit("ORG"))


MOST_NAMES = 1_000_000  # of a dictionary that every task holds


def extract_known(chunks: DataFrame, dictionary: DataFrame, *, id_col: str, text: str) -> DataFrame:
    """id, name, type, n: how often each name of a dictionary (name, type) stands in a text as whole words.

    One automaton over all names passes each text once. Of names that overlap the leftmost counts,
    of those the longest. Names have 2 to 200 characters and a type of KINDS; of several types of a
    name the first in the alphabet is taken. A dictionary of over MOST_NAMES names is an error. Null
    and empty texts name nothing.
    """
    names = dictionary.where(F.length("name").between(2, 200) & F.col("type").isin(list(KINDS))).groupBy("name").agg(F.min("type").alias("type"))
    held = {r["name"]: r["type"] for r in names.limit(MOST_NAMES + 1).collect()}
    if len(held) > MOST_NAMES:
        raise ValueError(f"a dictionary of over {MOST_NAMES} names")
    shared = chunks.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name in shared.value:
            automaton.add_word(name, name)
        if shared.value:
            automaton.make_automaton()
        for batch in batches:
            at, found, counts = [], [], []
            for i in range(batch.num_rows if shared.value else 0):
                t = batch.column(1)[i].as_py() or ""
                spans = sorted((end - len(name) + 1, -len(name), name) for end, name in automaton.iter(t))
                seen, after = Counter(), 0
                for start, size, name in spans:
                    end = start - size
                    whole = not (start and (t[start - 1].isalnum() and name[0].isalnum())) and not (end < len(t) and t[end].isalnum() and name[-1].isalnum())
                    if whole and start >= after:
                        seen[name] += 1
                        after = end
                at += [i] * len(seen)
                found += seen
                counts += seen.values()
            kinds = [shared.value[x] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string()), pa.array(kinds, pa.string()), pa.array(counts, pa.int64())], [id_col, "name", "type", "n"])

    kind = chunks.schema[id_col].dataType.simpleString()
    return chunks.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, name string, type string, n long")


def vertices(mentions: DataFrame, chunk: str) -> DataFrame:
    """(name, type) cut to 255 and 50 characters, with the number of chunks that name it."""
    return mentions.select(chunk, F.substring("name", 1, 255).alias("name"), F.substring("type", 1, 50).alias("type")).groupBy("name", "type").agg(F.count_distinct(chunk).alias("doc_count"))


def edges(mentions: DataFrame, chunk: str, key: str) -> DataFrame:
    """Pairs source < target of distinct entities of one chunk, with the number of chunks as weight.

    A chunk has few entities; the join is by chunk.
    """
    one = mentions.select(chunk, key).distinct()
    pairs = one.withColumnRenamed(key, "source").join(one.withColumnRenamed(key, "target"), chunk).where("source < target")
    return pairs.groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))


def neighbours(edges_: DataFrame, seeds: DataFrame, *, most: int | None = None) -> DataFrame:
    """seed, neighbour: one hop either way; seeds themselves are left out. Two equi-joins in place of an OR."""
    both = edges_.select("source", "target").union(edges_.select(F.col("target"), F.col("source"))).toDF("seed", "neighbour")
    out = both.join(seeds.select("seed"), "seed", "left_semi").join(seeds.select(F.col("seed").alias("neighbour")), "neighbour", "left_anti").distinct()
    return out.orderBy("neighbour", "seed").limit(most) if most else out.select("seed", "neighbour")


def ontology(edges_: DataFrame, vertices_: DataFrame, *, key: str, kind: str) -> DataFrame:
    """Per type, distinct entities on the source side and edges."""
    return edges_.join(vertices_.select(F.col(key).alias("source"), kind), "source").groupBy(kind).agg(F.count_distinct("source").alias("entities"), F.count(F.lit(1)).alias("relations"))


def without_document(edges_: DataFrame, gone: DataFrame, doc: str) -> DataFrame:
    return edges_.join(gone.select(doc), doc, "left_anti")
