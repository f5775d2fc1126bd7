"""Session defaults and table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "lakequill", **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; conf adds to or overrides these."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    builder = SparkSession.builder.appName(name)
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a new one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_lakequill_folder", None)
    if base is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.sparkContext._lakequill_folder = "file://" + tempfile.mkdtemp(prefix="lakequill-")
    return base


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lakequill/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df, written once to the shared folder and read back: a lost executor costs a reread, not a rerun.

    by: its last column, of which each value gets a folder.
    """
    path = new_path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
