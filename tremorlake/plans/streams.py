"""Streaming queries over the event table, run to the end of what has landed."""

from __future__ import annotations

import time
from uuid import uuid4

from pyspark.sql import functions as F

from tremorlake.operators.checkpoints import shared_dir
from tremorlake.plans.registry import query
from tremorlake.sources.tables import table
from tremorlake.streaming import feeds


_base = shared_dir


def _events(spark, d):
    schema = table(spark, d, "events").schema
    # a pattern, as the file source takes a plain path for a folder
    s = feeds.feed_stream(spark, f"{d.rstrip('/')}/event[s].parquet", schema, "parquet")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


@query("i02_stream_dedupe", "SELECT event_id, event_type FROM events")
def i02(spark, d):
    s = _events(spark, d)
    return feeds.run_to_table(feeds.once_by_id(s.unionByName(s), "event_id", "ts", "60 days").select("event_id", "event_type"), "append", _base(spark))


@query("i04_stream_windows", "SELECT event_type, CAST(floor(epoch(time_bucket(INTERVAL 6 HOURS, ts))) AS BIGINT) AS start_s, count(*) AS n FROM events GROUP BY 1, 2")
def i04(spark, d):
    s = feeds.window_counts(_events(spark, d), "ts", ["event_type"], "6 hours", delay="60 days")
    return feeds.run_to_table(s, "complete", _base(spark)).select("event_type", F.unix_timestamp("start").alias("start_s"), "n")


@query("i05_stream_latest", "SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS r FROM events) WHERE r = 1")
def i05(spark, d):
    s = feeds.latest_values(_events(spark, d), "event_type", "ts", ["event_id", "value"])
    return feeds.run_to_table(s, "complete", _base(spark)).select("event_type", "event_id", "value")


@query("i09_stream_severe", "SELECT event_id, value FROM events WHERE value >= 150")
def i09(spark, d):
    return feeds.run_to_table(_events(spark, d).filter("value >= 150").select("event_id", "value"), "append", _base(spark))


@query("i03_stream_upsert", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def i03(spark, d):
    """The newest event of each user in a table of hashed buckets."""
    base, s = f"{_base(spark).rstrip('/')}/upsert-{uuid4().hex}", _events(spark, d)
    feeds.upsert_stream(s, f"{base}/table", ["user_id"], "event_id", f"{base}/cp").awaitTermination()
    return feeds.BucketTable(spark, f"{base}/table", s.schema, ["user_id"]).read().select("user_id", "event_id", "value")


@query("i06_stream_match", "WITH a AS (SELECT event_id, date_trunc('minute', ts) AS m, ts FROM events WHERE event_id % 2 = 0), b AS (SELECT event_id AS other, date_trunc('minute', ts) AS m FROM events WHERE event_id % 2 = 1) SELECT a.event_id, b.other FROM a JOIN b ON a.m = b.m")
def i06(spark, d):
    """Even and odd events of the same minute; events without a partner are left out here."""
    a = _events(spark, d).filter("event_id % 2 = 0").select("event_id", "ts")
    b = _events(spark, d).filter("event_id % 2 = 1").select(F.col("event_id").alias("other"), F.col("ts").alias("rts"))
    j = feeds.match_feeds(a, b, "ts", "rts", delay="60 days").filter("other IS NOT NULL").select("event_id", "other")
    return feeds.run_to_table(j, "append", _base(spark))


@query("i08_stream_publish", "SELECT '{\"event_id\":' || CAST(event_id AS VARCHAR) || ',\"event_type\":\"' || event_type || '\"}' AS value FROM events WHERE value >= 200")
def i08(spark, d):
    base = f"{_base(spark).rstrip('/')}/publish-{uuid4().hex}"
    feeds.publish_stream(_events(spark, d).filter("value >= 200").select("event_id", "event_type"), f"{base}/out", f"{base}/cp").awaitTermination()
    return spark.read.text(f"{base}/out")


@query("i07_stream_heartbeat", "SELECT event_type AS feed, count(*) AS n, TRUE AS beats FROM events GROUP BY 1 UNION ALL SELECT 'silent', 0, TRUE")
def i07(spark, d):
    """Rows of each feed, and whether it beats once no more files land; one feed has never sent any."""
    base = f"{_base(spark).rstrip('/')}/beats-{uuid4().hex}"
    known = table(spark, d, "events").select("event_type").distinct().unionByName(spark.range(1).select(F.lit("silent").alias("event_type")))
    q = feeds.start_heartbeats(_events(spark, d), "event_type", 2, f"{base}/out", f"{base}/cp", known)
    out = spark.read.schema("feed string, kind string, n bigint")
    n, end = known.count(), time.time() + 120
    try:
        while time.time() < end and (q.lastProgress is None or out.parquet(f"{base}/out").filter("kind = 'beat'").select("feed").distinct().count() < n):
            time.sleep(1)
    finally:
        q.stop()
    return out.parquet(f"{base}/out").groupBy("feed").agg(F.sum("n").alias("n"), (F.count_if(F.col("kind") == "beat") > 0).alias("beats"))


@query("a32_stream_log", "SELECT count(*) AS n, TRUE AS whole FROM events")
def a32_stream(spark, d):
    """A stream's log: rows over all its batches, and whether each batch is there once."""
    base = f"{_base(spark).rstrip('/')}/log-{uuid4().hex}"
    with feeds.RunLog(spark, f"{base}/log") as log:
        q = _events(spark, d).writeStream.format("noop").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        log.wait(q)
    return log.read().filter(F.col("run") == str(q.runId)).agg(F.sum("rows").alias("n"), (F.count_distinct("batch") == F.max("batch") + 1).alias("whole"))
