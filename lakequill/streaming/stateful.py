"""Streams with keyed state and timers: changes of a listing, presence that expires, histograms of the last samples.

Each operator keeps one small state a key in the state store (RocksDB), so a stream that restarts
from its checkpoint goes on where it stopped. They need the RocksDB provider: call `configured`.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configured(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def ceil_ms(us: int) -> int:
    return -(-us // 1000)


class _Timed(StatefulProcessor):
    """One timer a key: the last one set."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def set_timer(self, ms: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(ms)

    def close(self) -> None:
        pass


class Listing(_Timed):
    """added, modified and deleted of one key. Rows of a poll have its time; a key that the next poll lacks is deleted."""

    schema = "version string, poll long"

    def row(self, key: tuple, event: str, at: int) -> pd.DataFrame:
        return pd.DataFrame({"key_": [key[0]], "event": [event], "us_": [at]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        polls = sorted(((p, v) for part in rows for p, v in zip(part["us_"].tolist(), part["version_"].tolist(), strict=True)), key=lambda x: x[0])
        known = self.state.get() if self.state.exists() else None
        passed = timerValues.getCurrentWatermarkInMs()
        if known is not None and passed > ceil_ms(known[1]):  # a poll came between, and its timer is due in this batch
            yield self.row(key, "deleted", passed * 1000)
            known = None
        for at, version in polls:
            if known is None:
                yield self.row(key, "added", at)
            elif known[0] != version:
                yield self.row(key, "modified", at)
            known = (version, at)
        self.state.update(known)
        self.set_timer(ceil_ms(known[1]) + 1)  # passed by the watermark once a later poll has been read

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        yield self.row(key, "deleted", timerValues.getCurrentWatermarkInMs() * 1000)


class Presence(_Timed):
    """joined and left of one key: it leaves when nothing came for ttl."""

    schema = "last long"

    def __init__(self, ttl_us: int):
        self.ttl = ttl_us

    def rows(self, key: tuple, events: list[tuple[str, int]]) -> pd.DataFrame:
        return pd.DataFrame({"key_": [key[0]] * len(events), "event": [e for e, _ in events], "us_": [at for _, at in events]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out, last = [], self.state.get()[0] if self.state.exists() else None
        for at in sorted(t for part in rows for t in part["us_"].tolist()):
            if last is not None and at - last >= self.ttl:
                out.append(("left", last + self.ttl))
                last = None
            if last is None:
                out.append(("joined", at))
            last = at if last is None else max(last, at)
        self.state.update((last,))
        self.set_timer(ceil_ms(last + self.ttl))
        if out:
            yield self.rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.state.get()[0]
        self.state.clear()
        yield self.rows(key, [("left", last + self.ttl)])


class LastSamples(StatefulProcessor):
    """The histogram of a name's newest samples, after each batch that has some."""

    def __init__(self, last: int):
        self.last = last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "ts long, tie long, value double")
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seen = self.seen.get()[0] if self.seen.exists() else 0
        kept = [tuple(r) for r in self.kept.get()]
        for part in rows:
            new = list(zip(part["us_"].tolist(), part["tie_"].tolist(), part["value_"].tolist(), strict=True))
            kept = heapq.nlargest(self.last, kept + new)  # never more than the state and one part
            seen += len(new)
        self.kept.put(kept)
        self.seen.update((seen,))
        values, n = sorted(v for *_, v in kept), len(kept)
        at = lambda p: values[min(n * p // 100, n - 1)]
        total = sum(values)
        yield pd.DataFrame({"key_": [key[0]], "seen": [seen], "n": [n], "total": [round(total, 4)], "low": [values[0]], "high": [values[-1]], "mean": [round(total / n, 4)], **{f"p{p}": [at(p)] for p in (50, 95, 99)}})

    def close(self) -> None:
        pass


def _timed(rows: DataFrame, key: str, ts: str, wait: str | None, **columns: Column) -> tuple[DataFrame, str]:
    """key_, the time (as a timestamp and as us_, microseconds) and columns, and the type of the key. Null times and keys go."""
    at = F.col(ts).cast("timestamp")
    out = rows.select(F.col(key).alias("key_"), at.alias("_ts"), F.unix_micros(at).alias("us_"), *[c.alias(n) for n, c in columns.items()]).where("key_ IS NOT NULL AND us_ IS NOT NULL")
    return (out.withWatermark("_ts", wait) if wait else out.drop("_ts")), out.schema["key_"].dataType.simpleString()


def _at(ts: str, kind: str) -> Column:
    return F.timestamp_micros("us_").cast(kind).alias(ts)


def listing_changes(listings: DataFrame, *, key: str, version: str, poll: str) -> DataFrame:
    """key, event (added, modified, deleted) and the poll's time, from a stream of listings.

    Every poll lists all keys with one time (in whole milliseconds), and polls come in order, a batch
    each. A poll without any key doesn't
    count as one, so a source that can't be reached deletes nothing. State: version and time a key.
    """
    rows, kind = _timed(listings, key, poll, "0 seconds", version_=F.col(version).cast("string"))
    out = rows.groupBy("key_").transformWithStateInPandas(Listing(), f"key_ {kind}, event string, us_ long", "append", "eventTime")
    return out.select(F.col("key_").alias(key), "event", _at(poll, listings.schema[poll].dataType.simpleString()))


def presence(events: DataFrame, *, by: str, ts: str, ttl: str = "30 seconds", wait: str = "0 seconds") -> DataFrame:
    """by, event (joined, left) and its time. A heartbeat keeps a key present for ttl; left comes once the watermark passes that."""
    rows, kind = _timed(events, by, ts, wait)
    out = rows.groupBy("key_").transformWithStateInPandas(Presence(pd.Timedelta(ttl) // pd.Timedelta(microseconds=1)), f"key_ {kind}, event string, us_ long", "append", "eventTime")
    return out.select(F.col("key_").alias(by), "event", _at(ts, events.schema[ts].dataType.simpleString()))


def last_samples(samples: DataFrame, *, by: str, ts: str, tie: str, value: str, last: int = 1000) -> DataFrame:
    """A row per name and batch: seen (samples so far) and the histogram of its newest `last` samples, as feedback.histogram gives it."""
    rows, kind = _timed(samples.where(F.col(value).isNotNull() & F.col(tie).isNotNull()), by, ts, None, tie_=F.col(tie).cast("long"), value_=F.col(value).cast("double"))
    schema = f"key_ {kind}, seen long, n long, total double, low double, high double, mean double, p50 double, p95 double, p99 double"
    return rows.groupBy("key_").transformWithStateInPandas(LastSamples(last), schema, "append", "none").withColumnRenamed("key_", by)


def drained(stream: DataFrame, into: str, checkpoint: str) -> StreamingQuery:
    """Append what is there now to the Parquet table at `into`, exactly once; the next call goes on from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", into).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def synced(changes: DataFrame, into: str, log: str, checkpoint: str, *, event: str = "event", source: str = "default") -> StreamingQuery:
    """Write batches of change events to `into` and one audit row for each to `log`.

    The row (source, batch_no, added, modified, deleted, error) comes from metrics that the write
    itself observes, without a second pass. A batch that fails leaves a row with its error; when it
    is repeated, its folder and its row are overwritten.
    """
    from pyspark.sql import Observation

    kinds = ("added", "modified", "deleted")

    def batch(df: DataFrame, no: int) -> None:
        def audit(counts: dict, error: str | None) -> None:
            row = [(source, *[int(counts.get(k) or 0) for k in kinds], error)]
            df.sparkSession.createDataFrame(row, "source string, added long, modified long, deleted long, error string").write.mode("overwrite").parquet(f"{log}/batch_no={no}")

        seen = Observation()
        watched = df.observe(seen, *[F.count_if(F.col(event) == k).alias(k) for k in kinds])
        try:
            watched.write.mode("overwrite").parquet(f"{into}/batch_no={no}")
        except Exception as e:
            audit({}, str(e).split("\n")[0][:500])
            raise
        audit(seen.get, None)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
