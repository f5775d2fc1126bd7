"""Joins whose keys may be few and large."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LARGE = 1000  # a group with this fraction of all rows is large, so there are that many at most


def with_group(rows: DataFrame, groups: DataFrame, key: list[str], spread: str, size: str, total: int) -> DataFrame:
    """rows with the columns of groups (one row per key; null without a match).

    groups[size] adds up to total at most. Large groups are broadcast, LARGE of them at most, and
    their rows are dealt over the join by spread; the others meet their group by key.
    """
    found = F.struct(*[c for c in groups.columns if c not in key])
    large = groups.where(F.col(size) * LARGE >= total).select(*key, found.alias("_large"))
    marked = rows.join(F.broadcast(large), key, "left")
    salted = marked.withColumn("_salt", F.when(F.col("_large").isNotNull(), F.xxhash64(spread)).otherwise(F.lit(0)))
    small = groups.select(*key, F.lit(0).cast("long").alias("_salt"), found.alias("_small"))
    both = salted.join(small, [*key, "_salt"], "left").withColumn("_found", F.coalesce("_large", "_small"))
    return both.select(*rows.columns, "_found.*")
