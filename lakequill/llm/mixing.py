"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash of its id. A source takes whole passes over itself, then the
documents whose hash is up to a threshold. The thresholds come from histograms: sum words by
source and hash bucket, find the bucket in which the running sum crosses the budget, and split
only that bucket again by the next bits, until it holds a single hash value. Documents are then
filtered by comparing their hash with the threshold; nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakequill.llm.common import stored, table

HASH_BITS, STEP_BITS = 60, 12
SIZE_PATTERN = r"[^\x20\x09-\x0D]+"


def word_count(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(SIZE_PATTERN)), F.lit(0)).cast("long")


def hash60(id_col: str, seed: str = "mix"):
    """60 bits of md5 of the seed and the id; null ids share one value."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """totals (source, source_size) with target added, by water filling.

    Targets follow the weights; those above `most` times their source's size stop there, and the
    excess is shared again by weight among the others until none is above. With sources ordered by
    most * size / weight, the first m are capped, for the least m whose level fits the rest.
    One row per source: this is the only step that sees all sources in one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = totals.withColumn("weight", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    ratio = F.col("cap") / F.col("weight")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(ratio, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    return (
        ranked.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("level", level)
        # the level of the first source that isn't capped holds for all that follow
        .withColumn("water", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(ratio.alias("r"), F.col("source").isNull().alias("n"), F.col("source"), F.col("level").alias("l")))).over(everything)["l"])
        .select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))).alias("target"))
    )


def thresholds(slim: DataFrame, budgets: DataFrame) -> DataFrame:
    """budgets (source, rest: words wanted below a full pass) with _upto: take hashes up to it.

    The boundary hash itself is taken where that comes nearer to the budget. -1: none.
    """
    # _low: hashes below it are all taken, with _sum words; the boundary bucket starts there
    edge = budgets.select("source", "rest", F.lit(0).cast("long").alias("_low"), F.lit(0).cast("long").alias("_sum"))
    rows = slim.select("source", "size", "_h")
    shift = HASH_BITS
    while True:
        shift -= STEP_BITS
        bucket = F.shiftright("_h", shift)
        by_bucket = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        e = edge.withColumnRenamed("source", "_s")
        inside = rows.join(e, F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("_h", shift + STEP_BITS) == F.shiftright("_low", shift + STEP_BITS)))
        sums = inside.groupBy("source", "rest", "_sum", bucket.alias("_bucket")).agg(F.sum("size").alias("_words"), F.min("_h").alias("_first"), F.max("_h").alias("_last"))
        crossed = sums.withColumn("_upto", F.col("_sum") + F.sum("_words").over(by_bucket)).where(F.col("_upto") > F.col("rest"))
        # the first bucket that crosses; sources without one take all they have
        edge = stored(
            crossed.groupBy("source").agg(F.min(F.struct("_bucket", "rest", "_upto", "_words", "_first", "_last")).alias("x")).select(
                "source", "x.rest", F.shiftleft("x._bucket", shift).alias("_low"), (F.col("x._upto") - F.col("x._words")).cast("long").alias("_sum"),
                F.col("x._words").alias("_words"), F.col("x._first").alias("_first"), F.col("x._last").alias("_last")), "mix-edge")
        if shift == 0 or edge.where("_first < _last").isEmpty():
            break
    nearer = F.col("_sum") + F.col("_words") - F.col("rest") < F.col("rest") - F.col("_sum")
    found = edge.select(F.col("source").alias("_s"), F.when(nearer, F.col("_last")).otherwise(F.col("_first") - 1).alias("_edge"))
    return budgets.join(found, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        "source", F.when(F.col("rest") <= 0, F.lit(-1)).otherwise(F.coalesce("_edge", F.lit((1 << HASH_BITS) - 1))).alias("_upto"))


def mix_plan(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """The slim table (_id, source, size, _h) and, per source, its size, target, whole passes and threshold."""
    slim = stored(docs.select(F.col(id_col).alias("_id"), F.col(source).alias("source"), word_count(text).alias("size"), hash60(id_col, seed).alias("_h")), "mix-sizes")
    totals = slim.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    plan = stored(source_targets(totals, weights, share, most), "mix-targets")
    plan = plan.withColumn("_passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    budgets = plan.select("source", (F.col("target") - F.col("_passes") * F.col("source_size")).alias("rest"))
    upto = thresholds(slim, budgets).withColumnRenamed("source", "_s2")
    plan = plan.join(upto, F.col("source").eqNullSafe(F.col("_s2"))).withColumnRenamed("source", "_s").drop("_s2")
    return slim, stored(plan, "mix-plan")


COPIES = "_passes + CASE WHEN _h <= _upto THEN 1 ELSE 0 END"


def mix(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """Per row of docs: its id, source, size, source_size, target (its source's) and taken (words).

    size is the number of words, 0 for null texts; a null source is a source of its own, the last.
    A document is taken 0 to `most` times, always whole. Repeated rows share their hash and are
    taken alike. Sources without words have the target 0. An empty table gives no rows.
    """
    slim, plan = mix_plan(docs, id_col=id_col, **options)
    return slim.join(plan, F.col("source").eqNullSafe(F.col("_s"))).select(
        F.col("_id").alias(id_col), "source", "size", "source_size", "target", (F.col("size") * F.expr(COPIES)).cast("long").alias("taken"))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", source: str = "source", seed: str = "mix", **options) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken. Texts are filtered in place, never shuffled."""
    _, plan = mix_plan(docs, id_col=id_col, source=source, seed=seed, **options)
    own = plan.select(F.struct("_s", "_passes", "_upto").alias("__mix_plan"))  # no name of docs can clash with it
    rows = docs.withColumn("__mix_hash", hash60(id_col, seed)).join(own, F.col(source).eqNullSafe(F.col("__mix_plan._s")))
    copies = F.col("__mix_plan._passes") + F.when(F.col("__mix_hash") <= F.col("__mix_plan._upto"), 1).otherwise(0)
    each = F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies)).otherwise(F.array().cast("array<bigint>"))
    return rows.select(*docs.columns, F.explode(each).alias("__mix_copy")).drop("__mix_copy")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * (SELECT sum(source_size) FROM s) AS budget, (SELECT sum(w) FROM s) AS ws FROM s
), l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER b, 0)) / (ws - coalesce(sum(w) OVER b, 0)) AS level
  FROM o WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT level FROM l WHERE level * w <= cap ORDER BY cap / w, source NULLS LAST LIMIT 1) * w, cap)) AS target FROM l
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes FROM t
), c AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.h) AS same
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       (size * (passes + CASE WHEN rest > 0 AND (upto <= rest OR (upto - same <= rest AND upto - rest < rest - (upto - same))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
