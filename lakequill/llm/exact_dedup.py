"""Exact dedup: a tree merge of sorted digest runs, in DataFrame operations alone.

Every input partition deals its rows to a run: one entry (digest, keep id, rows) per distinct text.
In each binomial round, groups of `fan_in` runs that differ in one digit of their number exchange
entries: an entry goes to the run that has its digest's digit there. A run then merges what it gets,
sorted by digest, and of each digest keeps the smallest (or largest) id. After log(runs) rounds the
number of a run is a part of its digests, so that every digest is in one run, and no run ever held
more than its share: entries for a digest that come together are `fan_in` at most. The rounds shuffle
digests and ids alone; where rows then meet their group, the columns that the result reads go along,
the text only if it is one of them.

An entry is verified by carrying, besides SHA-256, an independent 64-bit hash and the length of
the text: entries merge only when all three agree, at every level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakequill.llm.common import by_group, table

KEY = ["_sha", "_h64", "_len"]
FAN_IN = 4


def digests(docs: DataFrame, text: str) -> list:
    t = F.coalesce(F.col(text), F.lit(""))
    return [F.sha2(t.cast("binary"), 256).alias("_sha"), F.xxhash64(t).alias("_h64"), F.octet_length(t).alias("_len")]


def merge_runs(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", keep: str = "largest", runs: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """One row per distinct text: its digest columns, _keep (id) and _rows.

    runs is rounded up to a power of fan_in; without it, there are as many as shuffle partitions.
    """
    pick, order = {"largest": (F.max, F.desc_nulls_last("_keep")), "smallest": (F.min, F.asc_nulls_last("_keep"))}[keep]
    wanted, rounds = runs or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1
    while fan_in**rounds < wanted:
        rounds += 1
    runs = fan_in**rounds
    level = (
        docs.select(F.col(id_col).alias("_id"), *digests(docs, text), F.pmod(F.spark_partition_id(), F.lit(runs)).cast("long").alias("_run"))
        .groupBy("_run", *KEY).agg(pick("_id").alias("_keep"), F.count(F.lit(1)).alias("_rows"))
    )
    group = Window.partitionBy("_run", *KEY)
    for r in range(rounds):
        digit = lambda c, place=fan_in**r: F.pmod(F.floor(c / place), F.lit(fan_in))
        mine, wants = digit(F.col("_run")), digit(F.pmod("_h64", F.lit(runs)))
        dealt = level.withColumn("_run", (F.col("_run") + (wants - mine) * fan_in**r).cast("long")).repartitionById(runs, F.col("_run").cast("int"))
        level = (
            dealt.sortWithinPartitions("_run", *KEY, order).select("*", F.row_number().over(group.orderBy(order)).alias("_place"), F.sum("_rows").over(group).alias("_sum"))
            .where("_place = 1").select("_run", *KEY, "_keep", F.col("_sum").alias("_rows"))
        )
    return level.drop("_run")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", keep: str = "largest", runs: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256 added.

    Null texts count as empty ones. Ids that are null are kept only where no row of the group has
    an id. Rows that repeat both id and text are one document: all are marked alike, and all count
    in group_size. Columns of docs that have these names are replaced. An empty table gives none.

    Rows meet their group by digest. The groups that hold a thousandth of all rows or more, so a
    thousand at most, are broadcast instead, and their rows spread over the join by id.
    """
    groups = merge_runs(docs, id_col=id_col, text=text, keep=keep, runs=runs, fan_in=fan_in)
    names = [c for c in docs.columns if c not in ("keep_id", "group_size", "kept", "text_sha256")]
    kept = {c: f"_c{i}" for i, c in enumerate(names)}  # names apart from the join's own; those that nothing reads are pruned
    rows = docs.select(*[F.col(c).alias(k) for c, k in kept.items()], F.col(id_col).alias("_id"), *digests(docs, text))
    found = by_group(rows, groups.withColumnRenamed("_rows", "n"), KEY, "_id", docs.count())
    return found.select(
        *[F.col(k).alias(c) for c, k in kept.items()],
        F.col("_found._keep").alias("keep_id"),
        F.col("_found.n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_found._keep")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def distinct_texts(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that stay, exactly one for each distinct text.

    Joined by id and digest together, so that the copies of one text spread over the cluster.
    """
    by = [f"_by_{c}" for c in ("id", *KEY)]  # names that docs doesn't have
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups = merge_runs(docs, id_col=id_col, text=text, **options)
    groups = groups.select(as_text("_keep").alias(by[0]), *[F.col(c).alias(b) for c, b in zip(KEY, by[1:], strict=True)])
    rows = docs.select("*", as_text(id_col).alias(by[0]), *[d.alias(b) for d, b in zip(digests(docs, text), by[1:], strict=True)])
    return rows.join(groups, by, "left_semi").dropDuplicates(by).select(*docs.columns)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
