"""Queries of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorlake.functions.exprs import ieee_divide
from tremorlake.operators import spatial
from tremorlake.operators.matching import gazetteer_match
from tremorlake.plans.bindings import boxes, ctes, env, events, quakes, reports, scored, sensor
from tremorlake.plans.registry import query
from tremorlake.sources.tables import table

KM = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin((radians({b}lat) - radians({a}lat)) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin((radians({b}lon) - radians({a}lon)) / 2), 2))))"


@query("c01_inner_join", "SELECT n_name, r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def c01(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("customers"))


@query("c02_left_join", ctes("ev", "sensor") + " SELECT e.event_id, s.x FROM ev e LEFT JOIN (SELECT d, x FROM sensor WHERE zone = 'N') s ON e.d = s.d")
def c02(spark, d):
    s = sensor(spark, d).filter("zone = 'N'").select("d", "x")
    return events(spark, d).join(s, "d", "left").select("event_id", "x")


@query("c03_bbox_join", ctes("ev", "boxes") + " SELECT event_id, fault_id, priority FROM ev JOIN boxes ON lat BETWEEN lat_min AND lat_max AND lon BETWEEN lon_min AND lon_max")
def c03(spark, d):
    return spatial.bbox_join(events(spark, d), boxes(spark, d)).select("event_id", "fault_id", "priority")


@query("c04_bbox_or_global", ctes("reports", "boxes") + " SELECT submission_id, fault_id FROM reports JOIN boxes ON lat BETWEEN lat_min AND lat_max AND lon BETWEEN lon_min AND lon_max UNION ALL SELECT submission_id, 'global' FROM reports")
def c04(spark, d):
    return spatial.bbox_or_global(reports(spark, d), boxes(spark, d)).select("submission_id", "fault_id")


@query("c09_lookback", ctes("sensor") + " SELECT a.zone, a.d, count(b.x) AS n, round(avg(b.x), 6) AS mean_x FROM sensor a LEFT JOIN sensor b ON a.zone = b.zone AND b.d BETWEEN a.d - 27 AND a.d - 1 GROUP BY 1, 2")
def c09(spark, d):
    from tremorlake.operators.windows import days_over

    w = days_over("zone", "d", -27, -1)
    return sensor(spark, d).select("zone", "d", F.count("x").over(w).alias("n"), F.round(F.avg("x").over(w), 6).alias("mean_x"))


@query("c11_tolerance_join", ctes("ev") + " SELECT DISTINCT a.event_id FROM ev a JOIN ev b ON a.d = b.d AND abs(a.lat - b.lat) < 20 AND abs(a.lon - b.lon) < 20 WHERE a.magnitude < 4 AND b.magnitude >= 4")
def c11(spark, d):
    ev = events(spark, d)
    return spatial.tolerance_join(ev.filter("magnitude < 4"), ev.filter("magnitude >= 4"), 20, "event_id").select("event_id")


@query("c13_scalar_stats", ctes("env") + " SELECT d, round((kp_max - m) / s, 6) AS z FROM env, (SELECT avg(kp_max) AS m, stddev_samp(kp_max) AS s FROM env)")
def c13(spark, d):
    e = env(spark, d)
    return e.crossJoin(F.broadcast(e.agg(F.avg("kp_max").alias("m"), F.stddev_samp("kp_max").alias("s")))).select("d", F.round(ieee_divide(F.col("kp_max") - F.col("m"), "s"), 6).alias("z"))


@query("c15_semi_anti", ctes("ev") + " SELECT event_id, TRUE AS strong_day FROM ev WHERE d IN (SELECT d FROM ev WHERE magnitude > 6.9) UNION ALL SELECT event_id, FALSE FROM ev WHERE d NOT IN (SELECT d FROM ev WHERE magnitude > 6.9)")
def c15(spark, d):
    ev = events(spark, d)
    days = ev.filter("magnitude > 6.9").select("d").distinct()
    return ev.join(days, "d", "left_semi").select("event_id", F.lit(True).alias("strong_day")).unionByName(ev.join(days, "d", "left_anti").select("event_id", F.lit(False).alias("strong_day")))


@query("c16_rate_lookup", ctes("scored") + ", r AS (SELECT zone, avg(y) AS rate FROM scored WHERE d < DATE '1996-01-01' AND zone <> 'A' GROUP BY 1), g AS (SELECT avg(y) AS rate FROM scored WHERE d < DATE '1996-01-01') SELECT s.zone, round(coalesce(r.rate, g.rate), 6) AS rate, count(*) AS n FROM scored s LEFT JOIN r USING (zone), g WHERE d >= DATE '1996-01-01' GROUP BY 1, 2")
def c16(spark, d):
    s = scored(spark, d)
    train = s.filter("d < DATE '1996-01-01'")
    rates = train.filter("zone <> 'A'").groupBy("zone").agg(F.avg("y").alias("rate"))
    test = s.filter("d >= DATE '1996-01-01'").join(rates, "zone", "left").crossJoin(F.broadcast(train.agg(F.avg("y").alias("all_rate"))))
    return test.groupBy("zone", F.round(F.coalesce("rate", "all_rate"), 6).alias("rate")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "c17_nearest_event",
    ctes("reports", "ev")
    + f""", p AS (SELECT * FROM reports WHERE lat IS NOT NULL), k AS (SELECT submission_id, event_id, {KM.format(a="p.", b="e.")} AS km FROM p JOIN (SELECT * FROM ev WHERE magnitude >= 5) e ON e.d BETWEEN p.experience_date AND p.experience_date + 14)
    SELECT submission_id, event_id, round(km, 4) AS km FROM (SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY km, event_id) AS r FROM k) WHERE r = 1""",
)
def c17(spark, d):
    p = reports(spark, d).filter("lat IS NOT NULL").select("submission_id", F.col("experience_date").alias("d"), "lat", "lon")
    near = spatial.nearest_event(p, events(spark, d).filter("magnitude >= 5"), 0, 14, [], "submission_id")
    return near.select("submission_id", "event_id", F.round("km", 4).alias("km"))


@query("c18_epoch_join", ctes("ev", "sensor") + ", k AS (SELECT CAST(unnest(generate_series(-7, 7)) AS INT) AS rel_day) SELECT event_id, rel_day, x FROM (SELECT * FROM ev WHERE magnitude >= 6.5) e, k JOIN sensor s ON s.zone = 'R' AND s.d = e.d + rel_day")
def c18(spark, d):
    from tremorlake.operators.epoch import epoch_join

    s = sensor(spark, d).filter("zone = 'R'").select("d", "x")
    return epoch_join(events(spark, d).filter("magnitude >= 6.5"), s, 7).select("event_id", "rel_day", "x")


@query("c19_match_streams", "WITH a AS (SELECT ts, value FROM events WHERE event_type = (SELECT min(event_type) FROM events)), b AS (SELECT date_trunc('hour', ts) AS h, max(value) AS bz FROM events WHERE event_type = (SELECT max(event_type) FROM events) GROUP BY 1) SELECT CAST(floor(epoch(a.ts)) AS BIGINT) AS t, value, bz FROM a LEFT JOIN b ON date_trunc('hour', a.ts) = b.h")
def c19(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ends = e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    e = e.crossJoin(F.broadcast(ends)).withColumn("h", F.date_trunc("hour", "ts"))
    b = e.filter("event_type = hi").groupBy("h").agg(F.max("value").alias("bz"))
    return e.filter("event_type = lo").join(b, "h", "left").select(F.unix_timestamp("ts").alias("t"), "value", "bz")


@query(
    "c20_gazetteer_match",
    """WITH s AS (SELECT c_custkey, lower(CASE WHEN c_custkey % 3 = 0 THEN n_name ELSE substr(n_name, 1, 3) || substr(n_name, 5, 40) END) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey),
    p AS (SELECT n_name AS place, 'country' AS kind FROM nation UNION ALL SELECT r_name, 'region' FROM region),
    ex AS (SELECT c_custkey, place, kind, CASE kind WHEN 'country' THEN 0.90 ELSE 0.93 END AS confidence FROM s JOIN p ON s = lower(place)),
    nr AS (SELECT c_custkey, place, kind, CASE levenshtein(s, lower(place)) WHEN 1 THEN 0.88 ELSE 0.86 END AS confidence FROM s JOIN p ON s[1] = lower(place)[1] AND levenshtein(s, lower(place)) BETWEEN 1 AND 2 WHERE c_custkey NOT IN (SELECT c_custkey FROM ex)),
    al AS (SELECT * FROM ex UNION ALL SELECT * FROM nr)
    SELECT c_custkey, place, kind, CAST(confidence AS DOUBLE) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY confidence DESC, place, kind) AS r FROM al) WHERE r = 1""",
)
def c20(spark, d):
    """Nation names with a letter lost or changed, matched to the gazetteer of nations and regions."""
    names = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    spans = names.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("n_name")).otherwise(F.concat(F.substring("n_name", 1, 3), F.substring("n_name", 5, 40))).alias("span"))
    places = table(spark, d, "nation").select(F.col("n_name").alias("place"), F.lit("country").alias("kind")).unionByName(table(spark, d, "region").select(F.col("r_name").alias("place"), F.lit("region").alias("kind")))
    return gazetteer_match(spans, places, "c_custkey")


@query("c21_threshold_join", ctes("ev") + ", t AS (SELECT zone, CAST(5 + row_number() OVER (ORDER BY zone) / 4.0 AS DOUBLE) AS thr FROM (SELECT DISTINCT zone FROM ev)) SELECT event_id, thr FROM ev JOIN t USING (zone) WHERE magnitude >= thr")
def c21(spark, d):
    from pyspark.sql import Window as W

    ev = events(spark, d)
    t = ev.select("zone").distinct().withColumn("thr", F.lit(5.0) + F.row_number().over(W.orderBy("zone")) / 4)  # one row a zone
    return ev.join(t, "zone").filter("magnitude >= thr").select("event_id", "thr")


@query("c22_sub_day_boxes", ctes("quakes") + " SELECT zone, CAST(hour(ts) AS INT) AS hour, count(*) AS n, max(magnitude) AS strongest FROM quakes GROUP BY 1, 2")
def c22(spark, d):
    return quakes(spark, d).groupBy("zone", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.max("magnitude").alias("strongest"))


@query("b27_keyed_correction", ctes("ev") + ", f AS (SELECT event_id, 0.0::DOUBLE AS lat, CASE WHEN event_id % 2 = 0 THEN NULL ELSE 1.5::DOUBLE END AS lon FROM ev WHERE event_id % 10 = 3 OR event_id % 10 = 4) SELECT e.event_id, coalesce(f.lat, e.lat) AS lat, coalesce(f.lon, e.lon) AS lon FROM ev e LEFT JOIN f USING (event_id)")
def b27(spark, d):
    from tremorlake.operators.tables import keyed_correction

    ev = events(spark, d).select("event_id", "lat", "lon")
    fixes = ev.filter("event_id % 10 in (3, 4)").select("event_id", F.lit(0.0).alias("lat"), F.when(F.col("event_id") % 2 == 0, None).otherwise(1.5).alias("lon"))
    return keyed_correction(ev, fixes, ["event_id"], ["lat", "lon"])


@query("b28_fill_labels", "SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 2 = 0 THEN d.lang END, CASE l.quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END) AS label FROM documents d LEFT JOIN labels l USING (doc_id)")
def b28(spark, d):
    from tremorlake.operators.tables import fill_labels

    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("label"))
    return fill_labels(docs, table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").alias("label")), "doc_id", "label")


