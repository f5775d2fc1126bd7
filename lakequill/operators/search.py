"""Vector, lexical and hybrid search as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakequill.functions import text as T
from lakequill.functions import vectors as V
from lakequill.params import DEFAULT, Params


def top_k(scored: DataFrame, k: int, score: str, tie: str, by: list[str] | None = None) -> DataFrame:
    """The k best rows, of each group if `by` names one; a window group limit prunes before the shuffle."""
    if not by:
        return scored.orderBy(F.col(score).desc(), tie).limit(k)
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vector_search(chunks: DataFrame, query: Column, *, k: int = DEFAULT.top_k, floor: float = DEFAULT.min_similarity, id_col: str = "chunk_id", vector: str = "embedding", where: list[Column] | None = None) -> DataFrame:
    """Chunks with similarity of floor or more to one query vector, the k nearest. Live ones alone if there is deleted_at."""
    for condition in where or []:
        chunks = chunks.where(condition)
    if "deleted_at" in chunks.columns:
        chunks = chunks.where("deleted_at IS NULL")
    scored = chunks.withColumn("similarity", V.cosine(F.col(vector), query)).where(F.col("similarity") >= floor).drop(vector)
    return top_k(scored, k, "similarity", id_col)


def vector_search_batch(chunks: DataFrame, queries: DataFrame, *, k: int, floor: float = -1.0, id_col: str = "chunk_id", vector: str = "embedding", query_id: str = "query_id", by: str | None = None) -> DataFrame:
    """query_id, id, similarity, rank: the k nearest chunks of every query (in each group, if by names one). queries: query_id, qv.

    Queries are held by every task and meet each batch of chunks in one product; k rows a query and
    batch are left before the last ranking, so vectors are never shuffled or copied.
    """
    from lakequill.operators.vector_index import nearest

    return nearest(chunks, queries, k=k, floor=floor, id_col=id_col, vector=vector, query_id=query_id, by=by)


def query_terms(query: str) -> list[str]:
    import re

    return sorted({t for t in re.split(r"[\W_]+", query.lower()) if t})


def lexical_match(docs: DataFrame, query: str, *, text: str) -> DataFrame:
    """Documents that have every term of the query; none for a query without terms."""
    wanted = query_terms(query)
    if not wanted:
        return docs.where(F.lit(False))
    return docs.where(F.size(F.array_except(F.array(*[F.lit(t) for t in wanted]), T.lexemes(F.col(text)))) == 0)


def covers(hits: Column, n: Column) -> Column:
    """Cover-density rank r / (r + 1) of one text: hits are (p, k), the places of the terms 1 to n, ascending.

    A cover is a shortest span with all terms; each adds 0.1 / (1 + words in it that are none of
    them). Spans are found in one pass: at each hit, the least of the terms' last places starts the
    shortest span that ends here, and it is a cover if no earlier end has the same start.
    """
    start = F.struct(F.array_repeat(F.lit(0), n).alias("last"), F.lit(0).alias("from"), F.lit(0.0).alias("rank"))

    def step(acc: Column, x: Column) -> Column:
        last = F.transform(acc["last"], lambda p, i: F.when(i + 1 == x["k"], x["p"]).otherwise(p))
        low = F.array_min(last)
        new = low > acc["from"]
        noise = F.greatest((x["p"] - low) - (n - 1), F.lit(0))
        return F.struct(last.alias("last"), F.when(new, low).otherwise(acc["from"]).alias("from"), (acc["rank"] + F.when(new, F.lit(0.1) / (1 + noise)).otherwise(0.0)).alias("rank"))

    r = F.aggregate(hits, start, step)["rank"]
    return r / (r + 1)


def cover_density(lexemes: Column, wanted: Column) -> Column:
    """Cover-density rank of a text for the terms (an array without repeats), all of which must occur."""
    hits = F.filter(F.transform(lexemes, lambda t, i: F.struct((i + 1).alias("p"), F.array_position(wanted, t).cast("int").alias("k"))), lambda x: x["k"] > 0)
    return covers(hits, F.size(wanted))


def lexical_search(docs: DataFrame, query: str, *, k: int = DEFAULT.top_k, id_col: str = "chunk_id", text: str = "chunk_text") -> DataFrame:
    wanted = query_terms(query)
    found = lexical_match(docs, query, text=text)
    terms = F.array(*[F.lit(t) for t in wanted])
    score = F.round(cover_density(T.lexemes(F.col(text)), terms), V.EXACT) if wanted else F.lit(0.0)
    return top_k(found.withColumn("lexical_score", score), k, "lexical_score", id_col)


def blend(semantic: DataFrame, lexical: DataFrame, key: list[str], *, weight: float = DEFAULT.semantic_weight, by: list[str] | None = None) -> DataFrame:
    """Full outer join of both arms; without any lexical hit (of the query) the semantic score stands alone."""
    both = semantic.join(lexical, key, "full_outer").fillna(0.0, ["semantic_score", "lexical_score"])
    both = both.withColumn("lexical_hit", (F.col("lexical_score") > 0).cast("int"))
    if by:
        both = both.withColumn("_any", F.max("lexical_hit").over(Window.partitionBy(*by)))
    else:  # one row, joined by a constant of its own side
        both = both.withColumn("_one", F.lit(1)).join(F.broadcast(lexical.agg(F.max((F.col("lexical_score") > 0).cast("int")).alias("_any")).withColumn("_one", F.lit(1))), "_one").drop("_one")
    mixed = F.lit(weight) * F.col("semantic_score") + F.lit(round(1 - weight, 10)) * F.col("lexical_score")
    return both.withColumn("combined_score", F.round(F.when(F.col("_any") > 0, mixed).otherwise(F.col("semantic_score")), V.EXACT)).drop("_any", "lexical_hit")


def members(blended: DataFrame, floor: float = DEFAULT.min_similarity) -> DataFrame:
    """Candidates by either arm; never by the blended score."""
    return blended.where((F.col("semantic_score") >= floor) | (F.col("lexical_score") > 0))


def signals(query: Column, text: Column, index: Column) -> Column:
    """Term coverage, early position and length, to add to a score."""
    q = T.word_set(query)
    coverage = F.coalesce(F.try_divide(F.size(F.array_intersect(q, T.word_set(text))).cast("double"), F.size(q).cast("double")), F.lit(0.0)) * 0.05
    position = F.greatest(F.lit(0.0), F.lit(0.03) - F.lit(0.002) * index)
    size = F.length(text)
    return coverage + position + F.when(size.between(200, 800), 0.02).when(size < 100, -0.02).otherwise(0.0)


LEADS = 3


def lexical_search_batch(chunks: DataFrame, queries: DataFrame, *, k: int, id_col: str = "chunk_id", text: str = "chunk_text", by: list[str] | None = None) -> DataFrame:
    """query_id, id, lexical_score (and by): the k best chunks of every query that have all its words, by cover density.

    Each query looks for its LEADS rarest words; only the chunks that have these are read for the others.
    Queries without words find nothing. For many batches over the same texts, use term_index.
    """
    by = by or []
    asked = queries.select("query_id", F.array_distinct(T.lexemes(F.col("query"))).alias("terms")).where(F.size("terms") > 0)
    words = asked.select("query_id", F.explode("terms").alias("term"))
    held = chunks.select(id_col, F.explode(F.array_distinct(T.lexemes(F.col(text)))).alias("term"))
    df = held.join(words.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    group = Window.partitionBy("query_id")
    rare = words.join(df, "term").withColumn("_have", F.count(F.lit(1)).over(group)).withColumn("_no", F.row_number().over(group.orderBy("df", "term")))
    leads = rare.join(asked.select("query_id", F.size("terms").alias("n")), "query_id").where(f"_have = n AND _no <= {LEADS}").select("query_id", "term", F.least("n", F.lit(LEADS)).alias("wanted"))
    pairs = held.join(leads, "term").groupBy("query_id", id_col, "wanted").agg(F.count(F.lit(1)).alias("has")).where("has = wanted").select("query_id", id_col).join(asked, "query_id")
    lexemes = T.lexemes(F.col(text))
    full = pairs.join(chunks.select(id_col, text, *by), id_col).where(F.size(F.array_except("terms", lexemes)) == 0)
    ranked = full.select("query_id", id_col, *by, F.round(cover_density(lexemes, F.col("terms")), V.EXACT).alias("lexical_score"))
    return top_k(ranked, k, "lexical_score", id_col, ["query_id", *by]).drop("rank")


def hybrid_search(chunks: DataFrame, queries: DataFrame, *, params: Params = DEFAULT, id_col: str = "chunk_id", workspace: str | None = None, weights: list[float] | None = None) -> DataFrame:
    """Hybrid retrieval for a batch of queries.

    chunks: chunk_id, filename, chunk_index, chunk_text, embedding. queries: query_id, query, qv.
    Both arms take twice top_k (of each workspace, if that names a column; of chunks that several
    have by file and index, the last workspace's stays); then blend, membership, diversity, signals,
    rank and adjacency. weights, of operators.ranker, mix a learned score in. Returns query_id,
    filename, chunk_index, chunk_id, chunk_text, similarity, combined_score and place, the reading
    order: by file and chunk. Within a query the stages run over a few top_k rows.
    """
    from lakequill.operators import ranker
    from lakequill.operators.rerank import cross_encoded, diverse_and_ranked
    from lakequill.operators.rows import merge_workspaces

    k, by = 2 * params.top_k, [workspace] if workspace else []
    sem = vector_search_batch(chunks, queries, k=k, floor=params.min_similarity, id_col=id_col, by=workspace).select("query_id", id_col, F.col("similarity").alias("semantic_score"))
    lex = lexical_search_batch(chunks, queries, k=k, id_col=id_col, by=by)
    if by:
        sem = sem.join(chunks.select(id_col, *by), id_col)
    found = members(blend(sem, lex, ["query_id", id_col, *by], weight=params.semantic_weight, by=["query_id", *by]), params.min_similarity)
    rows = found.drop(*by).join(chunks.drop("embedding"), id_col).join(queries.select("query_id", "query"), "query_id")
    if by:
        rows = merge_workspaces(rows, ["query_id", "filename", "chunk_index"], workspace)
    if weights:
        rows = cross_encoded(ranker.reranked(rows, weights), weight=params.reranker_weight).drop("rerank_score")
    ranked = diverse_and_ranked(rows, params, id_col)
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("filename", "chunk_index")))
