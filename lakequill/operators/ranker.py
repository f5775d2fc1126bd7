"""A ranker learned from feedback: pairwise logistic regression, trained by sums that Spark adds up.

A question's relevant answers should score above its other ones. Each step sums the gradient over
all pairs in one pass inside the JVM; only as many numbers as there are features reach the driver.
Questions are split by hash into four fifths that are learned from and one that is held out; a model
is promoted only if it ranks the held out ones better than the order before, and has seen enough pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakequill.functions import text as T
from lakequill.operators.rerank import ndcg
from lakequill.session import stored

FEATURES = ("coverage", "overlap", "precision", "length")
LEAST_PAIRS = 50


def features(question: Column, answer: Column) -> list[Column]:
    """Term coverage, Jaccard similarity, share of the answer's words that are asked for, and log length."""
    q, a = T.word_set(question), T.word_set(answer)
    both = F.size(F.array_intersect(q, a)).cast("double")
    share = lambda n: F.coalesce(F.try_divide(both, F.size(n).cast("double")), F.lit(0.0))
    size = F.log1p(F.length(F.coalesce(answer, F.lit(""))).cast("double")) / 10
    return [share(q).alias("coverage"), T.jaccard(q, a).alias("overlap"), share(a).alias("precision"), size.alias("length")]


def held_out(query: str) -> Column:
    return F.pmod(F.xxhash64(F.col(query).cast("string"), F.lit("split")), F.lit(5)) == 0


def pairs(candidates: DataFrame, query: str, relevant: str) -> DataFrame:
    """Differences in features of each relevant answer to the mean of its question's others.

    Pairing all of them would square large questions; here the join has one row a question on one side.
    """
    others = candidates.where(~F.col(relevant)).groupBy(query).agg(*[F.avg(f).alias(f"_{f}") for f in FEATURES])
    good = candidates.where(F.col(relevant)).join(others, query)
    return good.select(query, *[(F.col(f) - F.col(f"_{f}")).alias(f) for f in FEATURES])


def score(weights: list[float]) -> Column:
    return sum((F.col(f) * F.lit(float(w)) for f, w in zip(FEATURES, weights, strict=True)), F.lit(0.0))


def train(differences: DataFrame, *, steps: int = 30, rate: float = 2.0, decay: float = 1e-3) -> list[float]:
    """Weights that minimise the mean of log(1 + exp(-w.d)) + decay / 2 * |w|^2, by steps down the full gradient."""
    weights = [0.0] * len(FEATURES)
    for _ in range(steps):
        pull = 1 / (1 + F.exp(score(weights)))
        row = differences.agg(F.count(F.lit(1)).alias("n"), *[F.sum(pull * F.col(f)).alias(f) for f in FEATURES]).first()
        if not row["n"]:
            return weights
        weights = [round(w + rate * (row[f] / row["n"] - decay * w), 9) for w, f in zip(weights, FEATURES, strict=True)]
    return weights


@dataclass(frozen=True)
class Trained:
    weights: list[float]
    pairs: int
    ndcg_before: float
    ndcg_after: float

    @property
    def promoted(self) -> bool:
        return self.pairs >= LEAST_PAIRS and self.ndcg_after > self.ndcg_before


def quality(candidates: DataFrame, query: str, relevant: str, by: Column, tie: str, k: int) -> float:
    rows = candidates.withColumn("_rank", F.struct((-by).alias("s"), F.col(tie).alias("t"))).withColumn("_relevant", F.col(relevant).cast("double"))
    return ndcg(rows, by=query, rank="_rank", relevant="_relevant", k=k).agg(F.avg("ndcg")).first()[0] or 0.0


def fit(candidates: DataFrame, *, query: str, tie: str, relevant: str = "relevant", before: str = "similarity", k: int = 5, **options) -> Trained:
    """Train on four fifths of the questions and compare on the rest with the order by `before`.

    candidates: query, tie (an id, for ties), relevant (boolean), before (score) and the FEATURES.
    Questions without a relevant or without another answer give no pair.
    """
    kept = stored(candidates.select(query, tie, relevant, before, *FEATURES), "ranker-candidates")
    differences = stored(pairs(kept.where(~held_out(query)), query, relevant), "ranker-pairs")
    weights = train(differences, **options)
    apart = kept.where(held_out(query))
    n = differences.count()
    return Trained(weights, n, quality(apart, query, relevant, F.col(before), tie, k), quality(apart, query, relevant, score(weights), tie, k))


def reranked(rows: DataFrame, weights: list[float], *, question: str = "query", answer: str = "chunk_text") -> DataFrame:
    """rows with rerank_score, the model's score, for rerank.cross_encoded."""
    named = rows.withColumns({f"_{f}": c for f, c in zip(FEATURES, features(F.col(question), F.col(answer)), strict=True)})
    total = sum((F.col(f"_{f}") * F.lit(float(w)) for f, w in zip(FEATURES, weights, strict=True)), F.lit(0.0))
    return named.withColumn("rerank_score", F.round(total, 6)).drop(*[f"_{f}" for f in FEATURES])


def logistic_loss(weights: list[float], rows: list[tuple]) -> float:
    """For tests and reports: the mean loss over collected differences."""
    return sum(math.log1p(math.exp(-sum(w * x for w, x in zip(weights, r, strict=True)))) for r in rows) / max(1, len(rows))
