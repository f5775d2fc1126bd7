"""Row-state rules over tables: ingest decisions, soft deletion, integrity guards, upserts, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def live(df: DataFrame, column: str = "deleted_at") -> DataFrame:
    return df.where(F.col(column).isNull())


def keep_newest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order; null keys are one group."""
    return df.withColumn("_no", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_no = 1").drop("_no")


def ingest_decision(incoming: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """incoming with decision: skip (same hash, has chunks), replace or insert. Null keys match null keys."""
    known = existing.select(*[F.col(c).alias(f"_k_{c}") for c in key], F.col("content_hash").alias("_hash"), "chunk_count")
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in key]
    rows = incoming.join(known.withColumn("_there", F.lit(True)), same, "left")
    decision = F.when(F.col("_there").isNull(), "insert").when((F.col("_hash") == F.col("content_hash")) & (F.col("chunk_count") > 0), "skip").otherwise("replace")
    return rows.withColumn("decision", decision).drop(*[f"_k_{c}" for c in key], "_hash", "_there")


def snapshot_diff(current: DataFrame, previous: DataFrame, key: str, version: str) -> DataFrame:
    """key, event: added, modified or deleted, from two listings."""
    now = current.select(F.col(key), F.col(version).alias("_now"), F.lit(True).alias("_in_now"))
    was = previous.select(F.col(key), F.col(version).alias("_was"), F.lit(True).alias("_in_was"))
    event = F.when(F.col("_in_was").isNull(), "added").when(F.col("_in_now").isNull(), "deleted").when(~F.col("_now").eqNullSafe(F.col("_was")), "modified")
    return now.join(was, key, "full_outer").select(key, event.alias("event")).where("event IS NOT NULL")


def retire(df: DataFrame, which: Column, now: Column, column: str = "deleted_at") -> DataFrame:
    """Soft deletion: rows that match and are live get a deletion time; others keep theirs."""
    return df.withColumn(column, F.when(which & F.col(column).isNull(), now).otherwise(F.col(column)))


def purgeable(parents: DataFrame, key: str, *children: tuple[DataFrame, str]) -> DataFrame:
    """Parents that no row of any child table refers to. children: (table, its column for the key)."""
    for child, column in children:
        parents = parents.join(child.select(F.col(column).alias(key)), key, "left_anti")
    return parents


def sole_owners(members: DataFrame, *, group: str, user: str, role: str, owner: str) -> DataFrame:
    """group, user: members who are the only owner of their group, and so can't be removed."""
    owners = members.where(F.col(role) == owner)
    return owners.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.min(user).alias(user)).where("_n = 1").select(group, user)


def backfill(wanted: DataFrame, there: DataFrame, key: list[str]) -> DataFrame:
    """The rows of wanted that `there` lacks."""
    return wanted.join(there.select(*key), key, "left_anti")


def counts_of(parents: DataFrame, key: str, **children: tuple[DataFrame, str]) -> DataFrame:
    """parents with a count of each child table, 0 if none; each is counted before it is joined, so they don't multiply."""
    for name, (child, column) in children.items():
        n = child.groupBy(F.col(column).alias(key)).agg(F.count(F.lit(1)).alias(name))
        parents = parents.join(n, key, "left").fillna(0, [name])
    return parents


def stale(df: DataFrame, as_of: Column, hours: int, *columns: str) -> DataFrame:
    """Rows whose first non-null time is more than so many hours before as_of."""
    return df.where(F.coalesce(*columns) < as_of - F.make_dt_interval(hours=F.lit(hours)))


def page(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """Rows offset .. offset + limit in order; limit is held between 1 and 200."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(200, limit)))


def activate(versions: DataFrame, which: int, key: str = "id") -> DataFrame:
    """A registry of versions with exactly one active."""
    return versions.withColumn("active", F.col(key) == which)


def not_expired(tokens: DataFrame, now: Column) -> DataFrame:
    return tokens.where((F.col("expires_at") >= now) | F.col("expires_at").isNull())


def last_n(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.col(order).desc()))).where(F.col("_n") <= n).drop("_n")


def substring_search(df: DataFrame, column: str, needle: str) -> DataFrame:
    """Case-insensitive, with % and _ taken literally."""
    return df.where(F.lower(column).contains(needle.lower()))
