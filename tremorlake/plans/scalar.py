"""Queries of projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorlake.functions import exprs as X
from tremorlake.plans.bindings import ctes, env, events, reports, stations
from tremorlake.plans.registry import query
from tremorlake.sources.tables import table


@query("b01_norm_lonlat", ctes("ev") + " SELECT event_id, lon * 3 - 360 * floor((lon * 3 + 180) / 360) AS lon, greatest(-90.0::DOUBLE, least(90.0::DOUBLE, lat * 1.5)) AS lat FROM ev")
def b01(spark, d):
    return events(spark, d).select("event_id", X.norm_lon(F.col("lon") * 3).alias("lon"), X.norm_lat(F.col("lat") * 1.5).alias("lat"))


@query("b02_grid_key", ctes("ev") + " SELECT CAST(CAST(floor(lat / 10) * 10 AS INT) AS VARCHAR) || '_' || CAST(CAST(floor(lon / 10) * 10 AS INT) AS VARCHAR) AS cell, count(*) AS n FROM ev GROUP BY 1")
def b02(spark, d):
    return events(spark, d).groupBy(X.grid_key("lat", "lon").alias("cell")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "b03_depth_bands",
    ctes("ev")
    + """ SELECT CASE WHEN depth_km < 70 THEN 'shallow' WHEN depth_km < 300 THEN 'intermediate' ELSE 'deep' END AS band,
    CASE WHEN d < DATE '1996-08-01' THEN 'minimum' WHEN d < DATE '2000-01-01' THEN 'rising' ELSE 'maximum' END AS cycle, count(*) AS n FROM ev GROUP BY 1, 2""",
)
def b03(spark, d):
    band = X.bin_by("depth_km", [70, 300], ["shallow", "intermediate", "deep"])
    cycle = X.bin_by("d", [F.lit("1996-08-01").cast("date"), F.lit("2000-01-01").cast("date")], ["minimum", "rising", "maximum"])
    return events(spark, d).groupBy(band.alias("band"), cycle.alias("cycle")).agg(F.count(F.lit(1)).alias("n"))


@query("b04_time_split", ctes("ev") + " SELECT CASE WHEN d <= DATE '1998-12-31' THEN 'train' WHEN d <= DATE '1999-12-31' THEN 'validate' WHEN d <= DATE '2001-12-31' THEN 'test' ELSE 'out_of_range' END AS split, count(*) AS n, min(d) AS first_day, max(d) AS last_day FROM ev GROUP BY 1")
def b04(spark, d):
    split = X.time_split("d", [("1998-12-31", "train"), ("1999-12-31", "validate"), ("2001-12-31", "test")], "out_of_range")
    return events(spark, d).groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first_day"), F.max("d").alias("last_day"))


@query("b05_wf_fold", ctes("ev") + " SELECT CAST(CASE WHEN year(d) < 1999 THEN 0 WHEN year(d) <= 2000 THEN year(d) - 1998 ELSE -99 END AS INT) AS fold, CASE WHEN year(d) < 1999 THEN 'train' WHEN year(d) <= 2000 THEN 'test' ELSE 'none' END AS split_type, count(*) AS n FROM ev GROUP BY 1, 2")
def b05(spark, d):
    fold = X.wf_fold("d", 1999, 2000)
    kind = F.when(fold == 0, "train").when(fold > 0, "test").otherwise("none")
    return events(spark, d).groupBy(fold.cast("int").alias("fold"), kind.alias("split_type")).agg(F.count(F.lit(1)).alias("n"))


@query("b06_storm_flags", ctes("env") + " SELECT d, CAST(kp_max >= 5 AS INT) AS kp_storm, CAST(kp_max >= 7 AS INT) AS kp_severe, CAST(dst_min <= -50 AS INT) AS dst_storm, CAST(dst_min <= -100 AS INT) AS dst_severe, CAST(kp_max >= 5 OR dst_min <= -50 AS INT) AS storm_day FROM env")
def b06(spark, d):
    return env(spark, d).select("d", *(c.alias(n) for n, c in X.storm_flags("kp_max", "dst_min").items()))


@query("b07_safe_divide_z", ctes("env") + ", s AS (SELECT avg(sw_speed) AS m, stddev_samp(sw_speed) AS sd FROM env) SELECT d, round(CASE WHEN kp_max <> 0 THEN sw_speed / kp_max END, 6) AS ratio, round(CASE WHEN sd > 0 THEN (sw_speed - m) / sd END, 6) AS z FROM env, s")
def b07(spark, d):
    e = env(spark, d)
    s = e.agg(F.avg("sw_speed").alias("m"), F.stddev_samp("sw_speed").alias("sd"))
    return e.crossJoin(F.broadcast(s)).select("d", F.round(X.safe_divide("sw_speed", "kp_max"), 6).alias("ratio"), F.round(X.z("sw_speed", "m", "sd"), 6).alias("z"))


@query("b08_pct_delta", ctes("env") + " SELECT d, CASE WHEN kp_max > 0 THEN round(100 * (sw_speed - kp_max) / kp_max, 4) END AS pct FROM env")
def b08(spark, d):
    return env(spark, d).select("d", X.pct_delta("sw_speed", "kp_max").alias("pct"))


@query("b09_haversine", ctes("ev") + " SELECT event_id, round(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin((radians(35.0) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(35.0)) * pow(sin((radians(139.0) - radians(lon)) / 2), 2)))), 4) AS km FROM ev")
def b09(spark, d):
    return events(spark, d).select("event_id", F.round(X.haversine_km("lat", "lon", F.lit(35.0), F.lit(139.0)), 4).alias("km"))


@query("b10_local_xy", ctes("ev") + " SELECT event_id, round(radians(lon - 139.0) * 6371.0 * cos(radians(35.0)), 4) AS x, round(radians(lat - 35.0) * 6371.0, 4) AS y FROM ev")
def b10(spark, d):
    x, y = X.local_xy_km("lat", "lon", F.lit(35.0), F.lit(139.0))
    return events(spark, d).select("event_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@query("b11_fault_perp", ctes("stations") + " SELECT station_id, d, round(east * cos(radians(CAST((station_id % 5) * 37 AS DOUBLE))) - north * sin(radians(CAST((station_id % 5) * 37 AS DOUBLE))), 6) AS perp FROM stations")
def b11(spark, d):
    azimuth = F.create_map(*(F.lit(v) for k in range(5) for v in (k, float(k * 37))))
    return stations(spark, d).select("station_id", "d", F.round(X.fault_perp("east", "north", F.element_at(azimuth, (F.col("station_id") % 5).cast("int"))), 6).alias("perp"))


@query("b12_phase", ctes("ev") + ", p AS (SELECT event_id, CAST((event_id * 7) % 720 - 180 AS DOUBLE) AS deg FROM ev) SELECT event_id, CAST(((floor(deg / 45)::BIGINT % 8) + 8) % 8 AS INT) AS bin, list_extract(['new','waxing_crescent','first_quarter','waxing_gibbous','full','waning_gibbous','last_quarter','waning_crescent'], CAST(((floor(deg / 45)::BIGINT % 8) + 8) % 8 AS INT) + 1) AS name, round((1 - cos(radians(deg))) / 2, 6) AS lit FROM p")
def b12(spark, d):
    p = events(spark, d).select("event_id", ((F.col("event_id") * 7) % 720 - 180).cast("double").alias("deg"))
    return p.select("event_id", X.phase_bin("deg").alias("bin"), X.phase_name("deg").alias("name"), F.round(X.illumination("deg"), 6).alias("lit"))


@query("b13_dates", ctes("ev") + " SELECT event_id, CAST(make_date(1995 + CAST(event_id % 6 AS INT), 1, 1) + CAST(event_id % 365 AS INT) AS DATE) AS from_doy, CAST(make_date(1996, 1, 1) + CAST(floor((CAST(event_id % 4 AS DOUBLE) / 4) * 366) AS INT) AS DATE) AS from_decimal, CAST(DATE '1970-01-01' + CAST(event_id AS INT) AS DATE) AS from_epoch FROM ev")
def b13(spark, d):
    i = F.col("event_id")
    return events(spark, d).select("event_id", X.doy_to_date((i % 6 + 1995).cast("int"), i % 365 + 1).alias("from_doy"), X.decimal_year_to_date(F.lit(1996.0) + (i % 4).cast("double") / 4).alias("from_decimal"), F.to_date(F.timestamp_millis(i * 86400000)).alias("from_epoch"))


@query("b14_mask_sentinels", ctes("env") + " SELECT d, CASE WHEN kp_max IN (9, 7) THEN NULL ELSE kp_max END AS kp, CASE WHEN abs(dst_min) >= 190 THEN NULL ELSE dst_min END AS dst FROM env")
def b14(spark, d):
    return env(spark, d).select("d", X.mask_sentinels("kp_max", (9.0, 7.0)).alias("kp"), X.mask_sentinels("dst_min", at_least=190).alias("dst"))


@query("b15_numeric_prefix", "SELECT o_orderpriority AS raw, CAST(try_cast(nullif(regexp_extract(o_orderpriority, '^\\s*(-?\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) AS DOUBLE) AS level, count(*) AS n FROM orders GROUP BY 1, 2")
def b15(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("raw"), X.numeric_prefix("o_orderpriority").alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("b16_geojson_centroid", ctes("ev") + " SELECT event_id, round(CASE event_id % 3 WHEN 0 THEN lat ELSE (3 * lat + 3) / 3 END, 6) AS lat, round(CASE event_id % 3 WHEN 0 THEN lon ELSE (3 * lon + 3) / 3 END, 6) AS lon FROM ev")
def b16(spark, d):
    pt = lambda k: F.format_string("[%s,%s]", (F.col("lon") + k).cast("string"), (F.col("lat") + k).cast("string"))
    ring = F.concat(F.lit("["), pt(0), F.lit(","), pt(1), F.lit(","), pt(2), F.lit("]"))
    geo = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"type":"Point","coordinates":'), pt(0), F.lit("}")))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"type":"Polygon","coordinates":['), ring, F.lit("]}")))
        .otherwise(F.concat(F.lit('{"type":"MultiPolygon","coordinates":[['), ring, F.lit("],["), ring, F.lit("]]}")))
    )
    return events(spark, d).select("event_id", X.geojson_centroid(geo).alias("c")).select("event_id", F.round("c.lat", 6).alias("lat"), F.round("c.lon", 6).alias("lon"))


@query("b17_surrogate_id", "SELECT event_id, 'ev-' || sha1(CAST(event_id AS VARCHAR) || '||' || event_type || '||' || coalesce(props, '')) AS sid FROM events")
def b17(spark, d):
    return table(spark, d, "events").select("event_id", X.surrogate_id("ev-", "event_id", "event_type", "props").alias("sid"))


@query("b18_json_value", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def b18(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("b19_intensity", ctes("reports") + " SELECT submission_id, CAST(CASE urgency_level WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END + CAST(water_imagery AS INT) + CAST(destruction_imagery AS INT) + CASE WHEN emotion IN ('fear', 'dread') THEN 2 WHEN emotion = 'calm' THEN 1 ELSE 0 END AS INT) AS score FROM reports")
def b19(spark, d):
    return reports(spark, d).select("submission_id", X.intensity_score("urgency_level", ["water_imagery", "destruction_imagery"], "emotion").alias("score"))


@query("b20_alias_label", "SELECT doc_id, CASE lower(trim(' ' || upper(lang) || ' ')) WHEN 'en' THEN 'quake' WHEN 'de' THEN 'flood' WHEN 'fr' THEN 'fire' ELSE 'unknown' END AS label FROM documents")
def b20(spark, d):
    raw = F.concat(F.lit(" "), F.upper("lang"), F.lit(" "))
    return table(spark, d, "documents").select("doc_id", X.alias_label(raw, {"en": "quake", "de": "flood", "fr": "fire"}, ["quake", "flood", "fire"], "unknown").alias("label"))


@query("b21_tri_state", ctes("env") + " SELECT d, CAST(CASE WHEN kp_max >= 9 THEN 1 WHEN d >= DATE '1996-01-01' THEN 0 END AS INT) AS has_event FROM env")
def b21(spark, d):
    return env(spark, d).select("d", X.tri_state(F.col("kp_max") >= 9, "d", "1996-01-01").alias("has_event"))


@query("b22_proper_nouns", "SELECT doc_id, CAST(len(list_distinct(list_filter(string_split(regexp_replace(text, '[\"\\\\\\n\\t\\r]', ' ', 'g'), ' '), lambda w: regexp_matches(w, '^[A-Z]') AND lower(w) NOT IN ('the', 'of', 'and')))) AS INT) AS n FROM documents")
def b22(spark, d):
    words = F.split(F.regexp_replace("text", r'["\\\n\t\r]', " "), " ")
    return table(spark, d, "documents").select("doc_id", F.size(X.proper_nouns(F.to_json(words), ["the", "of", "and"])).alias("n"))


@query("b23_strip_title", "SELECT doc_id, md5(CASE WHEN starts_with(source, 'src1') THEN trim(regexp_replace(text, '^[^\\n]*\\n?', ''), ' ') ELSE text END) AS body FROM documents")
def b23(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.strip_title("text", "source", "src1")).alias("body"))


@query(
    "b24_anchor_date",
    ctes("ev")
    + """, t AS (SELECT event_id, d, CASE event_id % 6 WHEN 0 THEN 'felt on ' || strftime(d, '%Y-%m-%d') || ' at noon' WHEN 1 THEN 'it was ' || CAST(event_id % 9 + 1 AS VARCHAR) || ' days ago' WHEN 2 THEN CAST(event_id % 5 + 1 AS VARCHAR) || ' weeks ago' WHEN 3 THEN 'Yesterday evening' WHEN 4 THEN 'last week, I think' ELSE 'no idea' END AS text FROM ev)
    SELECT event_id, CASE event_id % 6 WHEN 0 THEN d WHEN 1 THEN CAST(d - CAST(event_id % 9 + 1 AS INT) AS DATE) WHEN 2 THEN CAST(d - 7 * CAST(event_id % 5 + 1 AS INT) AS DATE) WHEN 3 THEN CAST(d - 1 AS DATE) WHEN 4 THEN CAST(d - 7 AS DATE) END AS anchored,
    CASE event_id % 6 WHEN 0 THEN 'high' WHEN 5 THEN 'none' ELSE 'medium' END AS confidence FROM t""",
)
def b24(spark, d):
    i = F.col("event_id")
    text = (
        F.when(i % 6 == 0, F.concat(F.lit("felt on "), F.date_format("d", "yyyy-MM-dd"), F.lit(" at noon")))
        .when(i % 6 == 1, F.concat(F.lit("it was "), (i % 9 + 1).cast("string"), F.lit(" days ago")))
        .when(i % 6 == 2, F.concat((i % 5 + 1).cast("string"), F.lit(" weeks ago")))
        .when(i % 6 == 3, "Yesterday evening")
        .when(i % 6 == 4, "last week, I think")
        .otherwise("no idea")
    )
    return events(spark, d).select("event_id", X.anchor_date(text, "d").alias("a")).select("event_id", F.col("a.date").alias("anchored"), "a.confidence")


@query("b25_place_spans", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\b(?:in|near|at|from|off)[ \n\t]+((?:\p{Lu}[\p{L}''-]*)(?:[ \n\t]+\p{Lu}[\p{L}''-]*){0,3})', 1)) AS INT) AS n_places FROM documents WHERE lang = 'en'")
def b25(spark, d):
    return table(spark, d, "documents").filter("lang = 'en'").select("doc_id", F.size(X.place_spans("text")).alias("n_places"))


@query("b26_predicates", "SELECT doc_id FROM documents WHERE doc_id BETWEEN 10 AND 900 AND source NOT IN ('src1', 'src2') AND text IS NOT NULL AND source NOT LIKE 'src1%' AND length(text) > 40 AND abs(n_chars - 500) < 400 AND upper(text) LIKE '%THE%' AND left(text, 1) <> 'x'")
def b26(spark, d):
    c = F.col
    return table(spark, d, "documents").filter(c("doc_id").between(10, 900) & ~c("source").isin("src1", "src2") & c("text").isNotNull() & ~c("source").like("src1%") & (F.length("text") > 40) & (F.abs(c("n_chars") - 500) < 400) & F.upper("text").contains("THE") & (F.left("text", F.lit(1)) != "x")).select("doc_id")


@query("b29_math", ctes("ev") + " SELECT event_id, floor(lat) AS f, round(pow(10, magnitude / 4), 6) AS p, round(sqrt(depth_km), 6) AS s, round(ln(magnitude), 6) AS l, round(atan2(lat, lon), 6) AS a, least(greatest(lat, -60.0), 60.0) AS clipped FROM ev")
def b29(spark, d):
    return events(spark, d).select("event_id", F.floor("lat").cast("double").alias("f"), F.round(F.pow(F.lit(10.0), F.col("magnitude") / 4), 6).alias("p"), F.round(F.sqrt("depth_km"), 6).alias("s"), F.round(F.log("magnitude"), 6).alias("l"), F.round(F.atan2("lat", "lon"), 6).alias("a"), F.least(F.greatest("lat", F.lit(-60.0)), F.lit(60.0)).alias("clipped"))


@query("b30_zone_label", ctes("ev") + " SELECT zone, CAST(sum(CASE WHEN zone IN ('1-URGENT', '5-LOW') THEN CAST(magnitude >= 6 AS INT) ELSE CAST(magnitude >= 5 AS INT) END) AS BIGINT) AS positives FROM ev GROUP BY zone")
def b30(spark, d):
    label = F.when(F.col("zone").isin("1-URGENT", "5-LOW"), (F.col("magnitude") >= 6).cast("int")).otherwise((F.col("magnitude") >= 5).cast("int"))
    return events(spark, d).groupBy("zone").agg(F.sum(label).alias("positives"))
