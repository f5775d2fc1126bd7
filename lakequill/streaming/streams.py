"""Structured Streaming forms: windows with watermarks, incremental ingest, change capture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakequill.operators.tables import snapshot_diff


def late(events: DataFrame, ts: str, wait: str | None) -> DataFrame:
    return events.withWatermark(ts, wait) if wait and events.isStreaming else events


def tumbling(events: DataFrame, *, ts: str, by: str, value: str, length: str, slide: str | None = None, wait: str | None = "1 hour") -> DataFrame:
    """start, end, by, n, total of each window; sliding ones if slide is given. Batch or stream."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return late(events, ts, wait).groupBy(w, by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n", "total")


def sessions(events: DataFrame, *, ts: str, by: str, gap: str, wait: str | None = "1 hour") -> DataFrame:
    """start, end, by, n of each run of events that are less than gap apart. Batch or stream."""
    return late(events, ts, wait).groupBy(F.session_window(ts, gap), by).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def new_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """A stream of the files that appear under path."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def ingest(stream: DataFrame, into: str, checkpoint: str, *, key: str = "content_hash") -> StreamingQuery:
    """Append rows whose key isn't in the table at `into` yet; each batch is deduplicated and may be empty."""

    def batch(df: DataFrame, no: int) -> None:
        spark = df.sparkSession
        rows = df.dropDuplicates([key])
        try:
            rows = rows.join(spark.read.parquet(into).where(F.col("batch_no") != no).select(key), key, "left_anti")
        except Exception as e:  # the table doesn't exist before the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        # a batch that is repeated after a failure overwrites its own folder
        rows.write.mode("overwrite").parquet(f"{into}/batch_no={no}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_once(stream: DataFrame, into: str, checkpoint: str, *, key: str = "content_hash") -> StreamingQuery:
    """Append each key's first row to the Parquet table at `into`. The keys seen are kept as state, so no batch reads the table; null keys are one key."""
    rows = stream.dropDuplicates([key])
    return rows.writeStream.format("parquet").option("path", into).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def changes(spark: SparkSession, current: DataFrame, state: str, *, key: str, version: str) -> DataFrame:
    """One poll of a source: events against the listing kept at `state` (empty before the first poll)."""
    try:
        previous = spark.read.parquet(state)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        previous = current.limit(0)
    return snapshot_diff(current, previous, key, version)
