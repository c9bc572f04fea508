"""Queries of feed readers: payloads are made from the tables in the feeds' formats and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorlake.plans.bindings import ctes, env, events
from tremorlake.plans.registry import query
from tremorlake.sources import json_feeds as J
from tremorlake.sources import text_formats as T
from tremorlake.sources import xml_feeds as X
from tremorlake.sources.tables import table


def quake_payloads(spark, d):
    """A day's events of a zone as one GeoJSON payload."""
    e = events(spark, d)
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat", "depth_km").alias("coordinates"))
    props = F.struct(F.col("magnitude").alias("mag"), (F.unix_date("d").cast("long") * 86400000).alias("time"), F.col("zone").alias("place"), F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("c"), F.col("event_id").cast("string"))).alias("code"))
    feature = F.struct(F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("ev"), F.col("event_id").cast("string"))).alias("id"), props.alias("properties"), point.alias("geometry"))
    return e.groupBy("zone", "d").agg(F.collect_list(feature).alias("features")).select(F.to_json(F.struct("features")).alias("value"))


@query("a01_quake_features", ctes("ev") + " SELECT CASE WHEN event_id % 5 = 0 THEN 'c' ELSE 'ev' END || CAST(event_id AS VARCHAR) AS event_id, d, lat AS latitude, lon AS longitude, depth_km, magnitude, zone AS place FROM ev")
def a01(spark, d):
    q = J.quake_features(quake_payloads(spark, d))
    return q.select("event_id", F.to_date("time").alias("d"), "latitude", "longitude", "depth_km", "magnitude", "place")


@query("a02_a03_severe_alerts", "SELECT 'E' || CAST(event_id AS VARCHAR) AS id, event_type AS event, CASE WHEN value >= 100 THEN 'Extreme' ELSE 'Severe' END AS severity FROM events WHERE value >= 50")
def a02(spark, d):
    e = table(spark, d, "events")
    sev = F.when(F.col("value") >= 100, "Extreme").when(F.col("value") >= 50, "Severe").otherwise("Minor")
    f = F.struct(F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("id"), F.struct(F.col("event_type").alias("event"), sev.alias("severity")).alias("properties"))
    pay = e.groupBy("user_id").agg(F.collect_list(f).alias("features")).select(F.to_json(F.struct("features")).alias("value"))
    return J.severe_only(J.cap_geojson_alerts(pay), None).select("id", "event", "severity")


@query("a04_cap_xml", "SELECT 'E' || CAST(event_id AS VARCHAR) AS identifier, event_type AS event, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 90 AS DOUBLE) END AS lat FROM events")
def a04(spark, d):
    e = table(spark, d, "events")
    poly = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("<cap:polygon>"), (F.col("event_id") % 90).cast("string"), F.lit(",10 1,2 3,4</cap:polygon>"))).otherwise("")
    entry = F.concat(F.lit('<entry><title>t</title><content type="text/xml"><cap:alert xmlns:cap="urn:x"><cap:identifier>E'), F.col("event_id").cast("string"), F.lit("</cap:identifier><cap:event>"), F.col("event_type"), F.lit("</cap:event>"), poly, F.lit("</cap:alert></content></entry>"))
    pay = e.groupBy("user_id").agg(F.concat(F.lit("<feed>"), F.array_join(F.collect_list(entry), ""), F.lit("</feed>")).alias("value"))
    return X.cap_xml_alerts(pay).select("identifier", "event", "lat")


@query("a06_header_row_json", ctes("env") + " SELECT CAST(d AS VARCHAR) AS time_tag, kp_max AS kp FROM env")
def a06(spark, d):
    rows = env(spark, d).groupBy(F.year("d").alias("y")).agg(F.collect_list(F.array(F.col("d").cast("string"), F.col("kp_max").cast("string"))).alias("r"))
    pay = rows.select(F.to_json(F.concat(F.array(F.array(F.lit("time_tag"), F.lit("kp"))), "r")).alias("value"))
    return J.header_row_json(pay, ["time_tag", "kp"]).select("time_tag", F.col("kp").try_cast("double").alias("kp"))


@query("a07_index_json", ctes("env") + " SELECT CAST(d AS VARCHAR) AS t, kp_max AS kp FROM env")
def a07(spark, d):
    odd = F.year("d") % 2 == 1
    rows = env(spark, d).select(F.year("d").alias("y"), F.create_map(F.when(odd, "time_tag").otherwise("time"), F.col("d").cast("string"), F.when(odd, "Kp").otherwise("kp_index"), F.col("kp_max").cast("string")).alias("m"))
    pay = rows.groupBy("y").agg(F.to_json(F.collect_list("m")).alias("value"))
    return J.index_json(pay, {"t": ["time_tag", "time"], "kp": ["kp", "Kp", "kp_index"]}).select("t", F.col("kp").try_cast("double").alias("kp"))


@query("a10_last_observation", "SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def a10(spark, d):
    e = table(spark, d, "events").withColumn("k", F.struct("ts", "event_id"))
    return J.last_observation(e, ["event_type"], "k").select("event_type", "event_id", "value")


@query("a11_csv_catalog", ctes("ev") + " SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE magnitude END AS mag, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(depth_km AS BIGINT) END AS depth FROM ev")
def a11(spark, d):
    e = events(spark, d).select("event_id", F.when(F.col("event_id") % 4 == 0, "  ").otherwise(F.col("magnitude").cast("string")).alias("mag"), F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.col("depth_km").cast("long").cast("string"))).alias("depth"))
    return T.csv_catalog(e, {"mag": "double", "depth": "bigint"})


@query("a12_kp_table", ctes("env") + " SELECT d, kp_max, round((kp_max + 7 * floor(kp_max / 2)) / 8, 6) AS kp_mean, CASE WHEN sw_speed > 48 THEN sw_speed END AS f107 FROM env")
def a12(spark, d):
    half = F.floor(F.col("kp_max") / 2).cast("string")
    line = F.concat_ws(" ", F.date_format("d", "yyyy MM dd"), F.col("kp_max").cast("string"), *([half] * 7), F.lit("11"), F.when(F.col("sw_speed") > 48, F.col("sw_speed")).otherwise(-1.0).cast("string"))
    lines = env(spark, d).select(line.alias("value")).unionByName(env(spark, d).limit(1).select(F.lit("# comment").alias("value")))
    return T.kp_table(lines).select("d", "kp_max", F.round("kp_mean", 6).alias("kp_mean"), "f107")


@query("a14_omni_hourly", "WITH v AS (SELECT CAST(ts AS DATE) AS d, CAST(floor(value) AS DOUBLE) AS x FROM events WHERE floor(value) <> 99) SELECT d, max(x) / 10 AS kp_max, min(x) / 10 AS kp_min, round(avg(x / 10), 6) AS kp_mean FROM v GROUP BY 1")
def a14(spark, d):
    e = table(spark, d, "events")
    line = F.concat_ws(" ", F.year("ts").cast("string"), F.dayofyear("ts").cast("string"), F.hour("ts").cast("string"), F.floor("value").cast("string"))
    return T.omni_hourly(e.select(line.alias("value")), "kp", 99, 10).select("d", "kp_max", "kp_min", F.round("kp_mean", 6).alias("kp_mean"))


@query("a16_flare_reports", "WITH f AS (SELECT CAST(ts AS DATE) AS d, CASE WHEN value < 20 THEN 'B' WHEN value < 90 THEN 'C' WHEN value < 300 THEN 'M' ELSE 'X' END AS c FROM events) SELECT d, max(c) AS xray_class_max, CAST(bool_or(c = 'M') AS INT) AS has_m_flare, CAST(bool_or(c = 'X') AS INT) AS has_x_flare FROM f GROUP BY 1")
def a16(spark, d):
    from tremorlake.functions.exprs import bin_by

    line = F.concat(F.date_format("ts", "yyyyMMdd"), F.lit(" 0100 "), bin_by("value", [20, 90, 300], ["B", "C", "M", "X"]), F.lit("1.5"))
    return T.flare_reports(table(spark, d, "events").select(line.alias("value"))).drop("xray_max")


@query("a19_daily_network", "WITH c AS (SELECT CAST(l_shipdate AS DATE) AS d, CAST(l_partkey % 200 AS DOUBLE) AS x FROM lineitem) SELECT d, round(avg(x), 4) AS mean, round(var_pop(x), 4) AS variance, CAST(count(*) AS INT) AS n_reporting, 'ok' AS status FROM c GROUP BY 1")
def a19(spark, d):
    li = table(spark, d, "lineitem").withColumn("d", F.to_date("l_shipdate"))
    # a line an order and day, so that no line grows with the table
    cells = li.groupBy("d", "l_orderkey").agg(F.concat(F.lit("13,0,"), F.array_join(F.collect_list((F.col("l_partkey") % 200).cast("string")), ",")).alias("value"))
    lines = cells.select("d", "value").unionByName(li.groupBy("d").agg(F.concat(F.lit("11,1,"), F.count(F.lit(1)).cast("string")).alias("value")))
    return T.daily_network_csv(lines).select("d", F.round("mean", 4).alias("mean"), F.round("variance", 4).alias("variance"), "n_reporting", "status")


@query("a21_unify_hazards", ctes("ev") + " SELECT 'quake-' || CAST(event_id AS VARCHAR) AS event_id, 'quake' AS hazard, CASE WHEN event_id % 3 = 0 THEN make_date(CAST(year(d) AS INT), 1, 1) ELSE d END AS start_day, magnitude AS mag FROM ev UNION ALL SELECT 'wave-' || CAST(event_id AS VARCHAR), 'wave', CASE WHEN event_id % 2 = 0 THEN NULL ELSE d END, NULL FROM ev WHERE event_id % 11 = 0")
def a21(spark, d):
    from tremorlake.sources.catalogs import unify, unify_hazards

    e = events(spark, d)
    gap = F.col("event_id") % 3 == 0
    q = e.select(F.col("event_id").cast("string").alias("id"), F.year("d").alias("yr"), F.when(gap, "").otherwise(F.month("d").cast("string")).alias("mo"), F.when(gap, None).otherwise(F.dayofmonth("d")).alias("dy"), F.lit("25").alias("hr"), "magnitude")
    w = e.filter("event_id % 11 = 0").select(F.col("event_id").alias("id"), F.year("d").alias("yr"), F.when(F.col("event_id") % 2 == 0, 2).otherwise(F.month("d")).alias("mo"), F.when(F.col("event_id") % 2 == 0, 30).otherwise(F.dayofmonth("d")).alias("dy"))
    names = {"id": "id", "year": "yr", "month": "mo", "day": "dy"}
    u = unify_hazards(unify(q, "quake", "s1", names | {"hour": "hr", "mag": "magnitude"}), unify(w, "wave", "s2", names))
    return u.select("event_id", "hazard", F.to_date("start_ts").alias("start_day"), "mag")


@query("a05_first_vertex", ctes("ev") + " SELECT event_id, lat, lon FROM ev")
def a05(spark, d):
    e = events(spark, d)
    v = X.first_polygon_vertex(F.concat(F.lit(" "), F.col("lat").cast("string"), F.lit(","), F.col("lon").cast("string"), F.lit("  1,2 3,4")))
    return e.select("event_id", F.get(v, F.lit(0)).alias("lat"), F.get(v, F.lit(1)).alias("lon"))


@query("a08_nested_series", "SELECT event_type AS site, CAST(user_id AS VARCHAR) AS variable, CAST(ts AS DATE) AS d, value FROM events")
def a08(spark, d):
    e = table(spark, d, "events")
    point = F.struct(F.col("value").cast("string").alias("value"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("dateTime"))
    code = lambda c: F.array(F.struct(F.col(c).cast("string").alias("value")))
    one = e.groupBy("event_type", "user_id").agg(F.collect_list(point).alias("p"))
    series = one.select("event_type", F.struct(F.struct(F.lit("n").alias("siteName"), code("event_type").alias("siteCode")).alias("sourceInfo"), F.struct(code("user_id").alias("variableCode")).alias("variable"), F.array(F.struct(F.col("p").alias("value"))).alias("values")).alias("s"))
    pay = series.select(F.to_json(F.struct(F.struct(F.array("s").alias("timeSeries")).alias("value"))).alias("value"))
    return J.nested_series(pay).select("site", "variable", F.to_date("ts").alias("d"), "value")


@query("a09_gauge_status", "SELECT CAST(s_suppkey AS VARCHAR) AS gauge, CASE WHEN s_suppkey % 4 = 1 THEN NULL ELSE s_acctbal END AS stage FROM supplier WHERE s_suppkey % 10 = 3 OR s_suppkey % 10 = 1")
def a09(spark, d):
    k = F.col("s_suppkey")
    g = table(spark, d, "supplier").select(k.cast("string").alias("gauge"), F.when(k % 10 == 3, "Minor").when(k % 10 == 1, "major").otherwise("none").alias("category"), F.when(k % 4 == 1, -999.0).otherwise(F.col("s_acctbal")).alias("stage"))
    return J.gauge_status(g).select("gauge", "stage")


@query("a13_hourly_dst", ctes("env") + " SELECT d, CAST(least(dst_min, -5) AS INT) AS dst_min, round((dst_min + 22 * -5) / 23, 6) AS dst_mean FROM env WHERE abs(dst_min) < 500")
def a13(spark, d):
    e = env(spark, d)
    line = F.concat(F.lpad(F.dayofmonth("d").cast("string"), 3, " "), F.lit("  "), F.col("dst_min").cast("int").cast("string"), F.repeat(F.lit(" -5"), 22), F.lit(" 9999"))
    return T.hourly_dst(e.select(line.alias("value"), F.year("d").alias("year"), F.month("d").alias("month")), F.col("year"), F.col("month")).select("d", "dst_min", F.round("dst_mean", 6).alias("dst_mean"))


@query("a15_sectioned_report", ctes("env") + " SELECT d, CASE WHEN dst_min > 0 THEN dst_min END AS x FROM env")
def a15(spark, d):
    text = F.concat(F.lit(":Product: daily\n:Energetic:\n# unit\n "), F.col("d").cast("string"), F.lit(" 1.0  "), F.col("dst_min").cast("string"), F.lit("\n:Other:\n 1 2 3\n"))
    return T.sectioned_report(env(spark, d).select("d", text.alias("value")), "Energetic", 2).select("d", "x")


@query("a17_iaga_hourly", ctes("env") + " SELECT d, CASE WHEN kp_max < 9 THEN kp_max * 10 END AS x FROM env")
def a17(spark, d):
    row = F.concat(F.col("d").cast("string"), F.lit(" 00:00:00.000 001 "), F.when(F.col("kp_max") < 9, F.col("kp_max") * 10).otherwise(99999.0).cast("string"), F.lit(" 1.0"))
    text = F.concat(F.lit(" Format\nDATE TIME DOY BOUH BOUD |\n"), F.array_join(F.array_sort(F.collect_list(row)), "\n"))
    files = env(spark, d).groupBy(F.year("d")).agg(text.alias("value"))
    return T.iaga_hourly(files, "H").select(F.to_date("ts").alias("d"), "x")


@query("a18_tenv3_positions", ctes("stations") + ", n AS (SELECT station_id FROM stations GROUP BY 1 HAVING count(*) >= 500) SELECT CAST(station_id AS VARCHAR) AS station_id, count(*) AS n, round(max(east) * 1000, 3) AS east_mm FROM stations JOIN n USING (station_id) GROUP BY 1")
def a18(spark, d):
    from tremorlake.plans.bindings import stations

    s = stations(spark, d)
    line = F.concat_ws(" ", F.col("station_id").cast("string"), F.lit("x"), F.year("d").cast("string"), F.lit("1 2 3 4 5"), F.col("east").cast("string"), F.lit("0"), F.col("north").cast("string"), F.lit("0"), F.col("up").cast("string"))
    p = T.tenv3_positions(s.select(line.alias("value")), 500)
    return p.groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("east_mm"), 3).alias("east_mm"))


@query("a20_ionex_cells", ctes("env") + ", c AS (SELECT d, CAST(unnest(generate_series(0, 19)) AS INT) AS k, CAST(n AS BIGINT) AS n FROM env) SELECT d, 0 AS map_idx, CAST(-180 + 5 * k AS DOUBLE) AS lon, CASE WHEN k = 17 THEN NULL ELSE round(CAST(n + k AS DOUBLE) * 0.1, 6) END AS tec FROM c")
def a20(spark, d):
    """One map of one latitude a day, its values over two lines, one missing."""
    from tremorlake.sources.grids import ionex_cells

    rec = lambda body, label: F.concat(F.rpad(body, 60, " "), F.lit(label))
    num = lambda x, w: F.lpad(x.cast("string"), w, " ")
    values = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: num(F.when(k == 17, 9999).otherwise(F.col("n") + k), 5))
    zeros = F.repeat(F.lit("     0"), 3)
    lines = [
        rec(F.lit("    -1"), "EXPONENT"),
        rec(F.lit("     1"), "START OF TEC MAP"),
        rec(F.concat(num(F.year("d"), 6), num(F.month("d"), 6), num(F.dayofmonth("d"), 6), zeros), "EPOCH OF CURRENT MAP"),
        rec(F.lit("    45.0-180.0 -85.0   5.0 450.0"), "LAT/LON1/LON2/DLON/H"),
        F.array_join(F.slice(values, 1, 16), ""),
        F.array_join(F.slice(values, 17, 4), ""),
        rec(F.lit("     1"), "END OF TEC MAP"),
    ]
    files = env(spark, d).select(F.concat_ws("\n", *lines).alias("value"))
    return ionex_cells(files).select("d", "map_idx", "lon", F.round("tec", 6).alias("tec"))
