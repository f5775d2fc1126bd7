"""Writers, lookups and rules of rows: inserts, updates, cascades, credentials, filters, final orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakequill.operators.joins import with_group
from lakequill.session import stored


def upsert(old: DataFrame, new: DataFrame, key: list[str], *, clear: tuple[str, ...] = ()) -> DataFrame:
    """Rows of old with the values of new that aren't null, and the rows that only new has. In the columns of clear, a null of new counts too."""
    values = [c for c in old.columns if c not in key]
    fresh = new.select(*key, *[F.col(c).alias(f"_new_{c}") for c in values], F.lit(True).alias("_there"))
    value = lambda c: F.when(F.col("_there").isNotNull(), F.col(f"_new_{c}")).otherwise(F.col(c)) if c in clear else F.coalesce(f"_new_{c}", c)
    return old.join(fresh, key, "full_outer").select(*key, *[value(c).alias(c) for c in values])


def insert_chunks(existing: DataFrame, new: DataFrame, document: str, index: str) -> DataFrame:
    """existing and new chunks together; the id of a new one is a digest of its document and index, so that writing twice gives the same ids. Of new ones that repeat an id one is kept."""
    added = new.withColumn("chunk_id", F.md5(F.concat_ws(":", document, index))).dropDuplicates(["chunk_id"])
    return existing.unionByName(added.join(existing.select("chunk_id"), "chunk_id", "left_anti").select(*existing.columns))


def append_messages(conversations: DataFrame, messages: DataFrame, conv: str, *, created: str = "created_at", updated: str = "updated_at") -> DataFrame:
    """Conversations touched by their new messages: the later of what they have and their latest message."""
    latest = messages.groupBy(conv).agg(F.max(created).alias("_latest"), F.count(F.lit(1)).alias("appended"))
    return conversations.join(latest, conv, "left").withColumn(updated, F.greatest(updated, "_latest")).withColumn("appended", F.coalesce("appended", F.lit(0))).drop("_latest")


def with_retired(df: DataFrame, include: bool, column: str = "deleted_at") -> DataFrame:
    """Live rows, or all of them."""
    return df.where(F.lit(include) | F.col(column).isNull())


def lookup(df: DataFrame, **values: object) -> DataFrame:
    """Rows by the values of columns; None finds nulls."""
    for c, v in values.items():
        df = df.where(F.col(c).eqNullSafe(F.lit(v)))
    return df


def by_name(entities: DataFrame, name: str, order: str = "id") -> DataFrame:
    """The first entity of exactly this name."""
    return entities.where(F.col("name") == name).orderBy(order).limit(1)


def credentials(keys: DataFrame, secrets: DataFrame, *, prefix: int = 8) -> DataFrame:
    """Live keys that secrets (column secret) open: found by prefix, told by the digest of the whole."""
    given = secrets.select(F.substring("secret", 1, prefix).alias("key_prefix"), F.sha2("secret", 256).alias("_digest"))
    return keys.where("revoked_at IS NULL").join(given, "key_prefix").where(F.col("key_hash") == F.col("_digest")).drop("_digest")


def filtered_by_conversation(candidates: DataFrame, conversations: DataFrame, conv: str, *, names: str = "document_ids", filename: str = "filename") -> DataFrame:
    """Candidates (a conversation and a file name each) whose conversation's JSON list has the name; an empty list, or none, lets all pass."""
    lists = conversations.select(conv, F.from_json(names, "array<string>").alias("_names"))
    open_ = F.col("_names").isNull() | (F.size("_names") == 0)
    return candidates.join(lists, conv, "left").where(open_ | F.array_contains("_names", F.col(filename))).drop("_names")


def cascade(children: DataFrame, gone: DataFrame, column: str, *, rule: str = "cascade") -> DataFrame:
    """Children once the parents in gone (its first column) are deleted: dropped by cascade, kept without their parent by set_null."""
    keys = gone.select(F.col(gone.columns[0]).alias(column)).distinct()
    if rule == "cascade":
        return children.join(keys, column, "left_anti")
    marked = children.join(keys.withColumn("_gone", F.lit(True)), column, "left")
    return marked.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).drop("_gone").select(*children.columns)


def local_only(documents: DataFrame, workspace: str, flag: str = "local_only", deleted: str = "deleted_at") -> DataFrame:
    """Workspaces that must not leave the machine: any live document that says so, or doesn't say (null)."""
    live = F.col(deleted).isNull()
    return documents.groupBy(workspace).agg(F.coalesce(F.max(F.when(live, F.coalesce(F.col(flag), F.lit(True)).cast("int"))), F.lit(0)).cast("boolean").alias("guarded"))


def merge_workspaces(found: DataFrame, key: list[str], order: str) -> DataFrame:
    """Candidates of several workspaces: of those with one key, the one of the last workspace."""
    return found.withColumn("_no", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc()))).where("_no = 1").drop("_no")


def final_order(found: DataFrame, *, filename: str = "filename", index: str = "chunk_index", score: str | None = None, most: int | None = None) -> DataFrame:
    """Results in reading order, by file and chunk; by score if one is given. A slice comes after the order."""
    order = [F.col(filename), F.col(index)]
    out = found.orderBy(*([F.col(score).desc(), *order] if score else order))
    return out if most is None else out.limit(most)


ACCURACY = 10_000  # of the sketch that brackets a percentile
SMALL = 10 * ACCURACY  # groups up to this many rows are their own bracket


def nearest_rank(df: DataFrame, by: list[str], value: str, percents: tuple[float, ...]) -> DataFrame:
    """The value at rank round(p / 100 * n), half to even, between 1 and n; one column p<percent> each. Nulls don't count.

    A mergeable sketch brackets each percentile; what lies below is counted, and only the values
    within are put in order, as counts. So no task sorts a large group.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, value, F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias("_g"))
    margin = 2 / ACCURACY
    shares = [max(0.0, min(1.0, p / 100 + side)) for p in percents for side in (-margin, margin)]
    stats = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_min"), F.max(value).alias("_max"), F.percentile_approx(value, shares, ACCURACY).alias("_q"))
    small = F.col("_n") <= SMALL
    edge = lambda k, side, end: F.when(small | F.lit(end), F.col(side)).otherwise(F.element_at("_q", k + 1))
    brackets = F.array(*[
        F.struct(
            F.lit(i).alias("i"), F.least(F.col("_n"), F.greatest(F.lit(1), F.bround(F.col("_n") * p / 100, 0).cast("long"))).alias("rank"),
            edge(2 * i, "_min", shares[2 * i] <= 0).alias("lo"), edge(2 * i + 1, "_max", shares[2 * i + 1] >= 1).alias("hi"))
        for i, p in enumerate(percents)])
    stats = stored(stats.select("_g", "_n", brackets.alias("_b")), "rank-brackets")
    met = with_group(rows, stats, ["_g"], value, "_n", rows.count())
    each = met.select(*by, "_g", value, F.explode("_b").alias("b")).where(F.col(value) <= F.col("b.hi"))
    # values below a bracket count as one
    counts = each.groupBy(*by, "_g", "b", F.when(F.col(value) >= F.col("b.lo"), F.col(value)).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy("_g", "b.i").orderBy(F.asc_nulls_first("_v")))
    reached = counts.withColumn("_upto", upto).where(F.col("_v").isNotNull() & (F.col("_upto") >= F.col("b.rank")))
    return reached.groupBy(*by).agg(*[F.min(F.when(F.col("b.i") == i, F.col("_v"))).alias(f"p{p:g}") for i, p in enumerate(percents)])


def answer_chunks(answers: DataFrame, sources: str, stats: DataFrame, chunk: str) -> DataFrame:
    """Answers joined to the statistics of the chunks that they used."""
    used = answers.withColumn(chunk, F.explode(F.array_distinct(sources)))
    return used.drop(sources).join(stats, chunk)


def graph_counts(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: entities and relations."""
    both = vertices.select(F.lit(1).alias("v"), F.lit(0).alias("e")).unionAll(edges.select(F.lit(0), F.lit(1)))
    return both.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("entities"), F.coalesce(F.sum("e"), F.lit(0)).alias("relations"))


def chunk_edges(mentions: DataFrame, chunk: str, key: str, weight: Column | None = None) -> DataFrame:
    """Weighted edges by pair and chunk: how often both are named in it, at most as often as the rarer one."""
    each = mentions.groupBy(chunk, key).agg(F.count(F.lit(1)).alias("c") if weight is None else F.sum(weight).alias("c"))
    a, b = (each.select(chunk, F.col(key).alias(n), F.col("c").alias(f"c_{n}")) for n in ("source", "target"))
    return a.join(b, chunk).where("source < target").select(chunk, "source", "target", F.least("c_source", "c_target").alias("weight"))


def annotated(annotations: DataFrame, users: DataFrame, user: str, name: str) -> DataFrame:
    """Annotations with the names of their authors; null once the author is gone."""
    return annotations.join(users.select(user, F.col(name).alias("author")), user, "left")
