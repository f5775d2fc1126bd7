"""Helpers that every operator of this folder shares."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a new one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = getattr(spark.sparkContext, "_lakequill_shared", None)
    if base is None:
        base = spark.sparkContext._lakequill_shared = "file://" + tempfile.mkdtemp(prefix="lakequill-")
    return base


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df once to the shared folder and read it back.

    A lost executor then costs a reread of files, never a rerun of what came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lakequill/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_rem(column: str, n: int):
    """crc32 of the id written as text, modulo n; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def once(key, make):
    """make(), or what it gave before in this worker process: modules travel by value, so their globals start anew in each task."""
    kept = sys.modules.setdefault("_lakequill_worker", types.ModuleType("_lakequill_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def crc_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of an ASCII text, bit by bit."""
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    byte = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {byte}), 4294967295)"


def by_group(rows: DataFrame, groups: DataFrame, key: list[str], spread: str, total: int) -> DataFrame:
    """rows with _found, a struct of the other columns of groups, which has one row per key; null without a match.

    groups.n is a number that adds up to total at most. The groups with a thousandth of it or more, so
    a thousand at most, are broadcast, and their rows are dealt over the join by spread, as are rows
    without a key: no task gets all rows of a large group.
    """
    value = F.struct(*[c for c in groups.columns if c not in key])
    large = groups.where(F.col("n") * 1000 >= total).select(*key, value.alias("_large"))
    marked = rows.join(F.broadcast(large), key, "left")
    apart = F.col("_large").isNotNull() | F.col(key[0]).isNull()
    salted = marked.select("*", F.when(apart, F.xxhash64(F.col(spread).cast("string"))).otherwise(F.lit(0)).alias("_salt"))
    small = groups.select(*key, F.lit(0).cast("long").alias("_salt"), value.alias("_small"))
    return salted.join(small, [*key, "_salt"], "left").withColumn("_found", F.coalesce("_large", "_small")).drop("_large", "_small", "_salt")


def discard(df: DataFrame) -> None:
    """Delete what stored() wrote for df; nothing may read it any more."""
    for path in df.inputFiles()[:1]:
        jvm = df.sparkSession._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path).getParent()
        folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
