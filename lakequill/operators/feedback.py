"""Feedback and metrics analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakequill.functions import text as T


def stats(feedback: DataFrame, rating: str = "rating") -> DataFrame:
    """total, positive, negative and the positive rate (null without feedback)."""
    return feedback.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(rating) > 0).alias("positive"), F.count_if(F.col(rating) < 0).alias("negative")).withColumn(
        "positive_rate", F.round(F.try_divide(F.col("positive").cast("double"), F.col("total").cast("double")), 3))


def by_type(feedback: DataFrame, kind: str) -> DataFrame:
    return feedback.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def daily(feedback: DataFrame, ts: str, rating: str) -> DataFrame:
    day = F.date_trunc("day", ts).cast("date").alias("day")
    return feedback.groupBy(day).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(rating) > 0).alias("positive"), F.count_if(F.col(rating) < 0).alias("negative"))


def counters(events: DataFrame, key: str, kind: str, names: dict[str, str]) -> DataFrame:
    """Per key, how many events of each named kind: {kind: column}."""
    return events.groupBy(key).agg(*[F.count_if(F.col(kind) == k).alias(c) for k, c in names.items()])


def upsert_counts(old: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """Counters of old and delta added up by key."""
    values = [c for c in old.columns if c not in key]
    return old.unionByName(delta).groupBy(*key).agg(*[F.sum(c).alias(c) for c in values])


def upsert_latest(old: DataFrame, delta: DataFrame, key: list[str], version: str) -> DataFrame:
    """The row of the greatest version of each key."""
    rest = [c for c in old.columns if c not in key]
    return old.unionByName(delta).groupBy(*key).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(*key, "_r.*")


def insert_new(old: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """old, and the rows of delta whose key it doesn't have."""
    return old.unionByName(delta.join(old.select(*key), key, "left_anti").dropDuplicates(key))


def stale(counts: DataFrame, *, key: str, retrieved: int = 10, ratio: float = 0.10, most: int = 50) -> DataFrame:
    """Chunks that are often retrieved and rarely liked."""
    rate = F.try_divide(F.col("positive").cast("double"), F.col("retrieved").cast("double"))
    return counts.where((F.col("retrieved") >= retrieved) & (rate <= ratio)).withColumn("rate", F.round(rate, 6)).orderBy(F.col("retrieved").desc(), key).limit(most)


def previous_turn(turns: DataFrame, *, conv: str, turn: str, role: str) -> DataFrame:
    """Assistant turns with the greatest user turn before them."""
    before = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("user_turn", F.max(F.when(F.col(role) == "user", F.col(turn))).over(before)).where(F.col(role) == "assistant")


def training_pairs(turns: DataFrame, *, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, question, answer: every answer with the question before it."""
    answers = previous_turn(turns, conv=conv, turn=turn, role=role).where("user_turn IS NOT NULL")
    asked = turns.select(F.col(conv), F.col(turn).alias("user_turn"), F.col(text).alias("question"))
    return answers.join(asked, [conv, "user_turn"]).select(conv, turn, "question", F.col(text).alias("answer"))


def gap_terms(queries: DataFrame, text: str, k: int | None = None) -> DataFrame:
    """term, n: terms of the queries by frequency."""
    out = queries.select(F.explode(T.terms(F.col(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.col("n").desc(), "term").limit(k) if k else out


def unanswered(turns: DataFrame, rated: DataFrame, *, conv: str, floor: float = 0.5) -> DataFrame:
    """User turns of conversations with a rating below the floor, or without any."""
    low = rated.where(F.col("rating") < floor).select(conv).distinct()
    none = turns.select(conv).distinct().join(rated.select(conv), conv, "left_anti")
    return turns.where("role = 'user'").join(low.union(none), conv, "left_semi")


def histogram(samples: DataFrame, *, by: str, value: str, order: list, last: int = 1000) -> DataFrame:
    """count, sum, min, max, avg, p50, p95 and p99 over each name's last samples.

    Percentiles are the sorted value at index min(int(n * p / 100), n - 1). A name keeps `last` rows.
    """
    newest = Window.partitionBy(by).orderBy(*order)
    kept = samples.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= last)
    out = kept.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), F.array_sort(F.collect_list(value)).alias("_v"))
    at = lambda p: F.element_at("_v", (F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1) + 1).cast("int")).alias(f"p{p}")
    return out.select(by, "n", F.round("total", 4).alias("total"), "low", "high", F.round("mean", 4).alias("mean"), at(50), at(95), at(99))


def buckets(samples: DataFrame, *, by: str, value: str, limits: tuple[float, ...] = (0.1, 0.5, 1.0)) -> DataFrame:
    """Cumulative counts up to each limit, and of all."""
    return samples.groupBy(by).agg(*[F.count_if(F.col(value) <= x).alias(f"le_{str(x).replace('.', '_')}") for x in limits], F.count(F.lit(1)).alias("le_inf"))


def confidence(rows: DataFrame, by: str, score: str = "combined_score") -> DataFrame:
    return rows.groupBy(by).agg(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.avg(score))), 4).alias("confidence"))
