"""What stands around retrieval: expansion, job matrices, prompts, payloads, embedding without repeats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakequill.operators import graph
from lakequill.session import stored


def graph_expanded(queries: DataFrame, mentions: DataFrame, edges: DataFrame, *, most: int = 5) -> DataFrame:
    """queries (query_id, query) with the names of up to `most` neighbours of the entities they mention appended."""
    near = mentions.select("query_id", F.col("name").alias("seed")).join(graph.neighbours(edges, mentions.select(F.col("name").alias("seed")).distinct()), "seed")
    names = near.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set("neighbour")), 1, most).alias("_names"))
    return queries.join(names, "query_id", "left").withColumn("query", F.concat_ws(" ", "query", "_names")).drop("_names")


def job_matrix(queries: DataFrame, tools: dict[str, Callable[[DataFrame], DataFrame]], *, retries: int | None = None, most: int | None = None) -> DataFrame:
    """query_id, tool, result, status and the rows of each tool for the queries that ask for it.

    queries: query_id, query, tools (array). A tool that isn't known gives one row with the status
    unknown; one that finds nothing, one row with the status empty. With retries, each tool runs by
    itself and its rows are stored: one that fails is tried so many times again, and then gives each
    of its queries a row with the status failed and the error as result; the others aren't
    disturbed. most: rows of a query and tool that are kept, in the order of seq, if the tool gives one.
    """
    jobs = queries.select("query_id", "query", F.explode("tools").alias("tool"))
    parts = []
    for name, run in tools.items():
        mine = jobs.where(F.col("tool") == name)
        attempt = lambda run=run, mine=mine: answered(mine, run(mine.select("query_id", "query")), most)
        parts.append(attempt() if retries is None else tried(attempt, mine, retries))
    unknown = jobs.where(~F.col("tool").isin(list(tools))).select("query_id", "tool", F.lit(None).cast("string").alias("result"), F.lit("unknown").alias("status"))
    out = unknown
    for p in parts:
        out = out.unionByName(p)
    return out


def answered(mine: DataFrame, found: DataFrame, most: int | None) -> DataFrame:
    if most is not None:
        order = Window.partitionBy("query_id").orderBy("seq" if "seq" in found.columns else F.to_json(F.struct(*found.columns)))
        found = found.withColumn("_no", F.row_number().over(order)).where(F.col("_no") <= most).drop("_no")
    got = found.select("query_id", F.to_json(F.struct(*[c for c in found.columns if c != "query_id"])).alias("result"))
    return mine.join(got, "query_id", "left").select("query_id", "tool", "result", F.when(F.col("result").isNull(), "empty").otherwise("ok").alias("status"))


def tried(attempt: Callable[[], DataFrame], mine: DataFrame, retries: int) -> DataFrame:
    error = ""
    for _ in range(retries + 1):
        try:
            return stored(attempt(), "job")
        except Exception as e:  # a tool that fails is a row, not the end of the others
            error = str(e).split("\n")[0][:500]
    return mine.select("query_id", "tool", F.lit(error).alias("result"), F.lit("failed").alias("status"))


def trace(jobs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, tool, status, rows and the query's first 100 characters, a row for each job."""
    n = jobs.groupBy("query_id", "tool", "status").agg(F.count("result").alias("rows"))
    return n.join(queries.select("query_id", F.substring("query", 1, 100).alias("query")), "query_id")


def outcome(jobs: DataFrame) -> DataFrame:
    """query_id, partial: some tools answered and some failed."""
    return jobs.groupBy("query_id").agg(((F.count_if(F.col("status") == "ok") > 0) & (F.count_if(F.col("status") != "ok") > 0)).alias("partial"))


def embedded(texts: DataFrame, embed: Callable[[Column], Column], *, text: str = "text", model: str = "default") -> DataFrame:
    """texts with embedding; each distinct text goes to the model once, keyed by sha256(model:text)."""
    keyed = texts.withColumn("_key", F.sha2(F.concat(F.lit(f"{model}:"), text).cast("binary"), 256))
    once = keyed.where(F.col(text).isNotNull()).groupBy("_key").agg(F.first(text).alias("_t")).select("_key", embed(F.col("_t")).alias("embedding"))
    return keyed.join(once, "_key", "left").drop("_key")


def diagnostic(semantic: DataFrame, hybrid: DataFrame, key: str) -> DataFrame:
    """Counts of both searches and their overlap, and which to use."""
    both = semantic.select(key, F.lit(1).alias("s")).join(hybrid.select(key, F.lit(1).alias("h")), key, "full_outer")
    out = both.agg(F.count("s").alias("n_semantic"), F.count("h").alias("n_hybrid"), F.count_if(F.col("s").isNotNull() & F.col("h").isNotNull()).alias("n_both"))
    return out.withColumn("recommendation", F.when(F.col("n_hybrid") > F.col("n_semantic"), "hybrid").otherwise("semantic"))


def prompt(question: Column, context: Column, memories: Column | None = None) -> Column:
    """A prompt with the sections that aren't empty; without context the question stands alone."""
    has = lambda c: c.isNotNull() & (c != "")
    parts = [] if memories is None else [F.when(has(memories), memories)]
    parts += [F.when(has(context), F.concat(F.lit("Context:\n"), context)), F.when(has(context), F.concat(F.lit("Question: "), question)).otherwise(question)]
    return F.concat_ws("\n\n", *parts)


def payload(sources: DataFrame, *, by: str = "query_id") -> DataFrame:
    """by, payload: sources, chunk ids, file names and confidence of an answer as JSON."""
    item = F.struct("filename", "chunk_index", "chunk_id", "similarity")
    confidence = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.avg("combined_score"))), 4)
    out = sources.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("sources"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"), F.array_sort(F.collect_set("filename")).alias("files"), confidence.alias("confidence"))
    return out.select(by, F.to_json(F.struct("sources", "chunk_ids", "files", "confidence")).alias("payload"))


def title(message: Column, most: int = 60) -> Column:
    return F.when(F.length(message) > most, F.concat(F.substring(message, 1, most), F.lit("..."))).otherwise(message)


def cloud_fallback(answer: Column, local_only: Column) -> Column:
    """Whether to ask a remote model: the answer refuses, and no source must stay local."""
    from lakequill.functions.text import is_refusal

    return is_refusal(answer) & ~F.coalesce(local_only, F.lit(True))


def register(spark: SparkSession) -> list[str]:
    """Functions for SQL: chunk_text(text), calculate(expression)."""
    import ast
    import operator

    from pyspark.sql.types import ArrayType, DoubleType, StringType

    from lakequill.operators.chunking import chunk_text

    known = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.USub: operator.neg, ast.UAdd: operator.pos}

    def value(node):
        if isinstance(node, ast.Constant) and isinstance(node.value, int | float):
            return node.value
        if isinstance(node, ast.BinOp) and type(node.op) is ast.Pow:
            base, power = value(node.left), value(node.right)
            if abs(power) > 100:
                raise ValueError("power too large")
            return base**power
        if isinstance(node, ast.BinOp):
            return known[type(node.op)](value(node.left), value(node.right))
        if isinstance(node, ast.UnaryOp):
            return known[type(node.op)](value(node.operand))
        raise ValueError("not arithmetic")

    def calculate(text: str | None) -> float | None:
        try:
            return float(value(ast.parse(text or "", mode="eval").body))
        except Exception:  # what can't be worked out is null
            return None

    spark.udf.register("chunk_text", lambda t: chunk_text(t), ArrayType(StringType()))
    spark.udf.register("calculate", calculate, DoubleType())
    return ["chunk_text", "calculate"]
