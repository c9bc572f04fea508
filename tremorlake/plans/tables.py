"""Queries of whole-table steps."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from tremorlake.operators import tables as T
from tremorlake.operators.checkpoints import checkpointed, drop_folder, shared_dir
from tremorlake.plans.bindings import ctes, env, events
from tremorlake.plans.registry import query
from tremorlake.sources.tables import table


@query("a22_upsert", ctes("ev") + ", u AS (SELECT event_id + CASE WHEN event_id % 10 = 0 THEN 10000000 ELSE 0 END AS event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE magnitude + 1 END AS magnitude FROM ev WHERE event_id % 5 = 0) SELECT coalesce(t.event_id, u.event_id) AS event_id, CASE WHEN u.event_id IS NOT NULL THEN u.magnitude ELSE t.magnitude END AS magnitude, t.zone FROM ev t FULL JOIN u USING (event_id)")
def a22(spark, d):
    t = events(spark, d).select("event_id", "magnitude", "zone")
    i = F.col("event_id")
    u = t.filter(i % 5 == 0).select((i + F.when(i % 10 == 0, 10000000).otherwise(0)).alias("event_id"), F.when(i % 4 == 0, None).otherwise(F.col("magnitude") + 1).alias("magnitude"))
    return T.upsert(t, u, ["event_id"], ["magnitude"])


@query("a23_keep_latest", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def a23(spark, d):
    return T.keep_latest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).drop("o_orderdate")


@query("a24_new_only", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def a24(spark, d):
    return T.new_only(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("a25_resume_pending", ctes("ev", "boxes") + ", plan AS (SELECT CAST(unnest(generate_series(DATE '1999-01-01', DATE '1999-12-31', INTERVAL 1 DAY)) AS DATE) AS d, fault_id FROM boxes) SELECT d, fault_id FROM plan WHERE (d, fault_id) NOT IN (SELECT d, 'z' || CAST(event_id % 5 AS VARCHAR) FROM ev)")
def a25(spark, d):
    from tremorlake.operators.panel import date_zone_spine
    from tremorlake.plans.bindings import boxes

    plan = date_zone_spine(boxes(spark, d), "1999-01-01", "1999-12-31", day="d")
    done = events(spark, d).select("d", F.concat(F.lit("z"), (F.col("event_id") % 5).cast("string")).alias("fault_id"))
    return T.new_only(plan, done, ["d", "fault_id"]).select("d", "fault_id")


@query("a26_date_window", ctes("ev") + " SELECT event_id, least(CAST(d + 30 AS DATE), DATE '2001-07-18', CAST(d + 9 AS DATE)) AS to_day FROM ev")
def a26(spark, d):
    e = events(spark, d).select("event_id", "d", F.date_add("d", 30).alias("e"), F.lit("2001-08-01").cast("date").alias("today"))
    return T.date_window(e, "d", "e", "today", 14, 10).select("event_id", "to_day")


@query("a27_heartbeat", ctes("ev") + " SELECT event_id, zone FROM ev WHERE magnitude > 6.98 UNION ALL SELECT -1, 'heartbeat'")
def a27(spark, d):
    e = events(spark, d).select("event_id", "zone")
    full = T.heartbeat_if_empty(events(spark, d).filter("magnitude > 6.98").select("event_id", "zone"), {"event_id": 0, "zone": "unused"})
    return full.unionByName(T.heartbeat_if_empty(e.filter("event_id < 0"), {"event_id": -1, "zone": "heartbeat"}))


@query("a28_publish_json", "SELECT '{\"n_nationkey\":' || CAST(n_nationkey AS VARCHAR) || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || CAST(n_regionkey AS VARCHAR) || '}' AS value FROM nation")
def a28(spark, d):
    return T.publish_json(table(spark, d, "nation"))


@query("a30_a31_columns", ctes("env") + " SELECT d, kp_max, CAST(NULL AS DOUBLE) AS tec_anomaly FROM env")
def a30(spark, d):
    e = T.add_missing_columns(env(spark, d), {"tec_anomaly": "double", "kp_max": "double"})
    return e.select("d", *T.available_features(e, ["kp_max", "tec_anomaly", "not_there"]))


@query("a33_high_water_mark", "SELECT max(CAST(ts AS DATE)) AS mark, CAST(max(CAST(ts AS DATE)) + 1 AS DATE) AS next_day FROM events WHERE value < 50")
def a33(spark, d):
    return T.high_water_mark(table(spark, d, "events"), "ts", F.col("value") < 50, "2020-01-01")


@query("a29_sinks", ctes("ev") + " SELECT zone, 3 * count(*) AS n, 3 * max(event_id) AS top FROM ev WHERE magnitude >= 6 GROUP BY 1")
def a29(spark, d):
    """The strong events loaded anew over all events, then after themselves as CSV and JSON, and read again."""
    base = f"{shared_dir(spark)}/sinks-{uuid4().hex}"
    all_, e = (x.select("zone", "event_id") for x in (events(spark, d), events(spark, d).filter("magnitude >= 6")))
    T.write_sink(all_, f"{base}/p", partition_by=["zone"])
    T.write_sink(e, f"{base}/p", partition_by=["zone"], rows_a_file=1000)
    T.write_sink(e, f"{base}/csv", kind="csv")
    T.write_sink(e, f"{base}/json", append=True, kind="json")
    read = spark.read.schema("zone string, event_id long")
    back = read.parquet(f"{base}/p").unionByName(read.option("header", True).csv(f"{base}/csv")).unionByName(read.json(f"{base}/json"))
    out = checkpointed(back.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), (F.max("event_id") * 3).alias("top")))
    drop_folder(spark, base)
    return out


@query("a32_run_log", "WITH s AS (SELECT event_type AS feed, sum(value) > 0 AND min(event_id) % 2 = 0 AS ok FROM events GROUP BY 1) SELECT run, count(*) FILTER (ok = (run = 1)) AS passed, count(*) FILTER (ok <> (run = 1)) AS failed, coalesce(string_agg(feed, ',' ORDER BY feed) FILTER (ok <> (run = 1)), '') AS note FROM s, (SELECT unnest([1, 2]) AS run) GROUP BY 1")
def a32(spark, d):
    """Two runs over the feeds, the second with passes and failures changed, appended to one log."""
    path = f"{shared_dir(spark)}/log-{uuid4().hex}"
    s = table(spark, d, "events").groupBy(F.col("event_type").alias("feed")).agg(((F.sum("value") > 0) & (F.min("event_id") % 2 == 0)).alias("ok"))
    T.run_log(s, path, F.lit("2020-01-01").cast("date"))
    T.run_log(s.withColumn("ok", ~F.col("ok")), path, F.lit("2020-01-02").cast("date"))
    out = checkpointed(spark.read.parquet(path).select(F.dayofmonth("run_at").alias("run"), "passed", "failed", "note"))
    drop_folder(spark, path)
    return out


@query("f04_limit", "SELECT '{\"event_id\":' || CAST(event_id AS VARCHAR) || ',\"event_type\":\"' || event_type || '\"}' AS value FROM (SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 25)")
def f04(spark, d):
    """The newest messages, as many as a publisher is allowed."""
    newest = table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).select("event_id", "event_type")
    return T.publish_json(newest, 25)


@query("g02_concat", ctes("ev") + " SELECT zone, d, event_id, CAST(NULL AS DOUBLE) AS tec FROM ev WHERE magnitude < 4 UNION ALL SELECT zone, d, event_id, magnitude FROM ev WHERE magnitude >= 6")
def g02(spark, d):
    """Frames with and without a column, one after the other."""
    e = events(spark, d)
    return T.union_all([e.filter("magnitude >= 6").select("zone", "d", "event_id", F.col("magnitude").alias("tec")), e.filter("magnitude < 4").select("zone", "d", "event_id")])
