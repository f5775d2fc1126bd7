"""Queries that run streams with state over the tables, in several batches, and read what they wrote."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.plans.registry import query
from lakequill.session import new_path
from lakequill.streaming import stateful


def fed(t, rows: DataFrame, part, name: str) -> tuple[DataFrame, str]:
    """rows as a stream of one file a batch, in the order of part (0, 1, ...), and a folder for what is made of it.

    A large table would have several files a part; here the order of parts must be the order of batches.
    """
    base = new_path(t.spark, name)
    parts = rows.withColumn("_part", part)
    n = parts.agg(F.max("_part")).first()[0]
    for i in range((n if n is not None else -1) + 1):
        parts.where(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(f"{base}/feed")
    if n is None:
        rows.write.parquet(f"{base}/feed")
    return stateful.configured(t.spark).readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/feed"), base


def result(t, stream: DataFrame, base: str) -> DataFrame:
    stateful.drained(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{base}/out")


def day_third(ts: str):
    """0, 1, 2 for the first, second and third ten days of the month."""
    return F.least(F.floor((F.dayofmonth(ts) - 1) / 10), F.lit(2)).cast("int")


@query("""WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM a),
s AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS stop FROM b GROUP BY user_id, k)
SELECT user_id, 'joined' AS event, start AS ts FROM s UNION ALL SELECT user_id, 'left', stop FROM s WHERE stop <= (SELECT max(ts) FROM events)""")
def presence_stream(t):
    """Who came and went, by state with timers, in three batches."""
    stream, base = fed(t, t.events.select("user_id", "ts"), day_third("ts"), "presence")
    return result(t, stateful.presence(stream, by="user_id", ts="ts", ttl="6 hours"), base)


@query("""WITH polls AS (
  SELECT doc_id, 0 AS poll, n_chars + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS v FROM documents WHERE doc_id % 13 <> 0
  UNION ALL SELECT doc_id, 1, n_chars FROM documents WHERE doc_id % 11 <> 0
  UNION ALL SELECT doc_id, 2, n_chars + CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END FROM documents WHERE doc_id % 5 <> 0),
steps AS (SELECT d.doc_id, k AS poll, p.v AS now, w.v AS was FROM (SELECT DISTINCT doc_id FROM polls) d CROSS JOIN (VALUES (0), (1), (2)) s(k)
  LEFT JOIN polls p ON p.doc_id = d.doc_id AND p.poll = k LEFT JOIN polls w ON w.doc_id = d.doc_id AND w.poll = k - 1)
SELECT doc_id, poll, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'deleted' ELSE 'modified' END AS event FROM steps
WHERE (was IS NULL) <> (now IS NULL) OR now <> was""")
def listing_changes_stream(t):
    """Three listings of the documents, an hour apart: some are new, some gone, some of another size."""
    more = lambda n, by: F.col("n_chars") + F.when(F.col("doc_id") % n == 0, by).otherwise(0)
    polls = [("doc_id % 13 <> 0", more(7, 1)), ("doc_id % 11 <> 0", F.col("n_chars")), ("doc_id % 5 <> 0", more(3, 2))]
    at = lambda i: F.timestamp_seconds(F.lit(1_700_000_000 + 3600 * i))
    parts = [t.documents.where(there).select("doc_id", size.alias("size"), at(i).alias("poll")) for i, (there, size) in enumerate(polls)]
    number = ((F.unix_timestamp("poll") - 1_700_000_000) / 3600).cast("int")
    stream, base = fed(t, parts[0].unionAll(parts[1]).unionAll(parts[2]), number, "listing")
    return result(t, stateful.listing_changes(stream, key="doc_id", version="size", poll="poll"), base).select("doc_id", "event", number.alias("poll"))


@query("""WITH l AS (SELECT event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 1000),
g AS (SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high, round(avg(value), 4) AS mean, list_sort(list(value)) AS v FROM l GROUP BY 1)
SELECT event_type, n, total, low, high, mean, v[least(floor(n * 50 / 100)::BIGINT, n - 1) + 1] AS p50, v[least(floor(n * 95 / 100)::BIGINT, n - 1) + 1] AS p95, v[least(floor(n * 99 / 100)::BIGINT, n - 1) + 1] AS p99 FROM g""")
def histogram_stream(t):
    """histogram_percentiles by bounded state: the last row of every event type after three batches."""
    stream, base = fed(t, t.events.select("event_type", "ts", "event_id", "value"), day_third("ts"), "histogram")
    rows = result(t, stateful.last_samples(stream, by="event_type", ts="ts", tie="event_id", value="value"), base)
    newest = F.max_by(F.struct("n", "total", "low", "high", "mean", "p50", "p95", "p99"), "seen")
    return rows.groupBy("event_type").agg(newest.alias("r")).select("event_type", "r.*")


@query("""SELECT 'events' AS source, 3::BIGINT AS batches, count(*) FILTER (event_type = 'signup') AS added, count(*) FILTER (event_type = 'purchase') AS modified, count(*) FILTER (event_type = 'error') AS deleted, 0::BIGINT AS failed FROM events""")
def sync_log(t):
    """Audit rows that batches of changes leave, summed up."""
    kind = F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "purchase", "modified").when(F.col("event_type") == "error", "deleted")
    stream, base = fed(t, t.events.select("event_id", "ts", kind.alias("event")), day_third("ts"), "sync")
    stateful.synced(stream, f"{base}/out", f"{base}/log", f"{base}/checkpoint", source="events").awaitTermination()
    log = t.spark.read.parquet(f"{base}/log")
    sums = [F.sum(c).alias(c) for c in ("added", "modified", "deleted")]
    return log.groupBy("source").agg(F.count(F.lit(1)).alias("batches"), *sums, F.count("error").alias("failed"))
