"""Streaming queries: run to the end of what is there, then read as a table."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from tarn.operators import ingest as I
from tarn.sources.files import shared_folder
from tarn.sources.versions import Versions
from tarn.streaming import cache, ingest
from tarn.streaming import streams as S

from .common import t
from .registry import query


def _events(spark, d):
    table = t(spark, d, "events")
    # a stream reads folders; a single file is named by a pattern
    return S.read(spark, f"{d}/events.parque[t]", table.schema).withColumn("ts", F.col("ts").cast("timestamp"))


def _finished(spark, stream, name):
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}-{name}"
    S.run_once(stream, f"{at}/out", f"{at}/state")
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


@query("append_stream", "SELECT event_id, user_id, value FROM events WHERE value < 10")
def append_stream(spark, d):
    """The review queue as a stream that appends."""
    return _finished(spark, S.review_queue(_events(spark, d), 10).select("event_id", "user_id", "value"), "append")


@query("window_stream", "WITH w AS (SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) SELECT * FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def window_stream(spark, d):
    """Tumbling hours by type; a window is out once the watermark has passed it."""
    w = S.windowed(_events(spark, d), "ts", "1 hour", None, "10 minutes", ["event_type"])
    return _finished(spark, w.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total")), "window")


#: Requests of the cache: each event asks for its user's entry; errors have no result of their own, and the reports of some are of
#: the next day. What the watermark hasn't passed isn't answered yet.
CACHE = """WITH RECURSIVE w AS (SELECT epoch_us(max(ts)) // 1000 - 600000 AS ms FROM events),
r AS (SELECT user_id::VARCHAR AS key, ts, event_id AS request, event_type <> 'error' AS available, ts::DATE + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS report_date, event_type || ':' || event_id AS result,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events, w WHERE ceil(epoch_us(ts) / 1000) <= ms),
c AS (SELECT key, min(i) AS i FROM r WHERE available GROUP BY key UNION ALL
  SELECT c.key, min(x.i) FROM c JOIN r e ON e.key = c.key AND e.i = c.i JOIN r x ON x.key = c.key AND x.i > c.i AND x.available AND (x.ts > e.ts + INTERVAL 6 HOUR OR e.report_date > x.ts::DATE) GROUP BY c.key),
s AS (SELECT r.*, c.i IS NOT NULL AS stored, max(c.i) OVER (PARTITION BY r.key ORDER BY r.i) AS last, max(c.i) OVER (PARTITION BY r.key ORDER BY r.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r LEFT JOIN c ON c.key = r.key AND c.i = r.i),
a AS (SELECT s.key, s.ts AS moment, s.request, CASE WHEN s.stored THEN CASE WHEN s.before IS NULL THEN 'miss' ELSE 'replaced' END WHEN e.ts + INTERVAL 6 HOUR >= s.ts AND e.report_date <= s.ts::DATE THEN 'hit' ELSE 'unavailable' END AS kind, e.result AS result, e.ts AS saved FROM s LEFT JOIN r e ON e.key = s.key AND e.i = s.last),
n AS (SELECT key, ts, result, lead(ts) OVER (PARTITION BY key ORDER BY i) AS next FROM s WHERE stored)
SELECT key, moment, kind, request, CASE WHEN kind <> 'unavailable' THEN result END AS result, CASE WHEN kind <> 'unavailable' THEN saved END AS saved_at FROM a
UNION ALL SELECT key, ts + INTERVAL 6 HOUR, 'expired', NULL, result, ts FROM n, w WHERE (next IS NULL OR next > ts + INTERVAL 6 HOUR) AND epoch_us(ts + INTERVAL 6 HOUR) // 1000 < ms"""


@query("ttl_stream", CACHE)
def ttl_stream(spark, d):
    """Hits, misses, replacements and expiries of a cache that holds an entry for each user for six hours."""
    next_day = F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    asked = _events(spark, d).select(
        F.col("user_id").cast("string").alias("key"), "ts", F.col("event_id").alias("request"), (F.col("event_type") != "error").alias("available"),
        F.date_add(F.to_date("ts"), next_day).alias("report_date"), F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")).alias("result"),
    )
    with cache.keyed_state(spark):
        return _finished(spark, cache.cached(asked, timedelta(hours=6)), "ttl")


RECORD = "chunk_no int, chunk_id string, chunk string"


@query("ingest_stream", """WITH a AS (SELECT doc_id, coalesce(text, '') AS text, 0 AS n FROM documents UNION ALL SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN upper(lang) || ': ' || coalesce(text, '') ELSE coalesce(text, '') END, 1 FROM documents WHERE doc_id % 3 <> 1),
l AS (SELECT doc_id, arg_max(text, n) AS text FROM a WHERE NOT (doc_id % 11 = 4) GROUP BY doc_id)
SELECT doc_id, left(sha256(text), 16) AS content_hash, doc_id % 5 = 0 AND doc_id % 3 <> 1 AS changed FROM l""")
def ingest_stream(spark, d):
    """A collection after two arrivals of files, the second with changed, unchanged and deleted documents."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}-ingest"
    docs = t(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", F.lit(False).alias("gone"))
    again = F.when(F.col("doc_id") % 5 == 0, F.concat(F.upper("lang"), F.lit(": "), "text")).otherwise(F.col("text"))
    into = Versions(spark, f"{at}/collection", "doc_id", "long", RECORD)
    write = ingest.ingested(into, "text", lambda x: I.chunks(x, "doc_id", "text").select("doc_id", "chunk_no", "chunk_id", "chunk"), tombstone="gone")
    for arrival in (docs, docs.where("doc_id % 3 <> 1 or doc_id % 11 = 4").withColumn("text", again).withColumn("gone", F.col("doc_id") % 11 == 4)):
        arrival.write.mode("append").parquet(f"{at}/files")
        S.each_batch(S.read(spark, f"{at}/files", docs.schema, 1000), write, f"{at}/state")
    first = into.known(before=1).select("doc_id", F.col("content_hash").alias("__first"))
    return into.known().where("not deleted").join(first, "doc_id").select("doc_id", "content_hash", (F.col("content_hash") != F.col("__first")).alias("changed"))
