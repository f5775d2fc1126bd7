"""Long-term memory: scoped search, semantic dedup, extraction windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakequill.operators import search, similarity
from lakequill.operators.vector_index import has_angle
from lakequill.params import DEFAULT
from lakequill.session import stored


def recall(memories: DataFrame, query: Column, *, scopes: list | None = None, scope: str = "workspace_id", k: int = 3, floor: float = 0.55, id_col: str = "id") -> DataFrame:
    """Live memories of the scopes (all, if none is given) with similarity of floor or more, the k nearest."""
    where = [F.col(scope).isin(scopes)] if scopes else []
    return search.vector_search(memories, query, k=k, floor=floor, id_col=id_col, where=where)


def new_only(incoming: DataFrame, known: DataFrame, *, vector: str = "embedding", scope: str = "workspace_id", floor: float = DEFAULT.memory_duplicate, order: str | None = None) -> DataFrame:
    """Incoming memories that no known one of their scope nearly equals.

    With order, they come in that order, and one that nearly equals an incoming one that stayed goes
    too; of equal vectors the first stays (ties: any one). Memories without a vector stay.
    """
    named = lambda rows, *more: rows.select([F.col(c).alias(f"_is{k}") for k, c in enumerate([*similarity.CLASS, *more])])
    marks = [f"_is{k}" for k in range(3)]
    classed = similarity.keyed(incoming, vector, scope).withColumnsRenamed(dict(zip(similarity.CLASS, marks, strict=True)))
    blank = incoming.where(~has_angle(vector))
    if order:
        text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias("_text")
        firsts = similarity.first_of_each(incoming, order=order, vector=vector, scope=scope, floor=floor, known=known)
        fresh = classed.withColumn("_is3", text(order)).join(named(firsts.select(*similarity.CLASS, text("_order")), "_text"), [*marks, "_is3"], "left_semi").dropDuplicates([*marks, "_is3"])
    else:
        fresh = classed.join(named(similarity.near_any(incoming, known, floor=floor, vector=vector, scope=scope)), marks, "left_anti")
    return fresh.select(*incoming.columns).unionAll(blank)


def retrieve(memories: DataFrame, queries: DataFrame, now: Column, *, k: int = 3, floor: float = 0.55, id_col: str = "id", scope: str = "workspace_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Memories for a batch of queries, and the table of memories with their use counted.

    queries: query_id, qv and scopes (array; null or empty: all). Found: query_id, rank, similarity
    and the memory's columns but its vector, the k nearest live ones with similarity of floor or
    more. A memory that several queries find is used once for each.
    """
    from lakequill.operators.vector_index import nearest

    live = memories.where("deleted_at IS NULL") if "deleted_at" in memories.columns else memories
    asked = queries.where("scopes IS NOT NULL AND size(scopes) > 0").select("query_id", F.explode(F.array_distinct("scopes")).alias(scope))
    near = nearest(live, queries, k=k, floor=floor, id_col=id_col, vector=vector, by=scope).drop("rank")
    scoped = near.join(live.select(id_col, scope), id_col).join(asked.withColumn("_in", F.lit(True)), ["query_id", scope], "left")
    free = queries.select("query_id", F.coalesce(F.size("scopes") <= 0, F.lit(True)).alias("_all"))
    best = search.top_k(scoped.join(free, "query_id").where("_all OR _in").select("query_id", id_col, "similarity"), k, "similarity", id_col, ["query_id"])
    found = stored(best, "memories-found")
    return found.join(live.drop(vector), id_col), used(memories, found, now, id_col)


def transcript(turns: DataFrame, *, conv: str, turn: str, role: str, text: str, last: int = 20, most: int = 500) -> DataFrame:
    """conv, transcript: the last turns of a conversation, each cut to most characters, a line each."""
    newest = Window.partitionBy(conv).orderBy(F.col(turn).desc())
    kept = turns.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= last)
    line = F.concat(F.initcap(role), F.lit(": "), F.substring(text, 1, most))
    return kept.groupBy(conv).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(turn, line.alias("l")))), lambda x: x["l"]), "\n").alias("transcript"))


def prompt(memories: DataFrame, *, kind: str = "memory_type", content: str = "content", order: str = "id", by: list[str] | None = None) -> DataFrame:
    """prompt: a header and a line a memory, in order; one text for each group of by. For the few memories that a search finds."""
    lines = F.array_sort(F.collect_list(F.struct(order, F.concat(F.lit("["), F.upper(kind), F.lit("] "), content).alias("l"))))
    return memories.groupBy(*(by or [])).agg(F.concat(F.lit("Relevant memories:\n"), F.array_join(F.transform(lines, lambda x: x["l"]), "\n")).alias("prompt"))


def due(conversations: DataFrame) -> DataFrame:
    """Conversations changed since their memories were extracted."""
    return conversations.where("memory_extracted_at IS NULL OR memory_extracted_at < updated_at")


def used(memories: DataFrame, hits: DataFrame, now: Column, id_col: str = "id") -> DataFrame:
    """use_count and last_used moved for the memories that were hit."""
    n = hits.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"))
    return memories.join(n, id_col, "left").withColumn("use_count", F.col("use_count") + F.coalesce("_n", F.lit(0))).withColumn("last_used", F.when(F.col("_n").isNotNull(), now).otherwise(F.col("last_used"))).drop("_n")
