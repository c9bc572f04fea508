"""Queries of aggregations, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremorlake.functions.exprs import pair_corr
from tremorlake.operators import spatial, tables
from tremorlake.plans.bindings import boxes, ctes, env, events, quakes, scored, sensor, stations
from tremorlake.plans.registry import query
from tremorlake.sources.tables import table

CELLS = "cells AS (SELECT CAST(l_shipdate AS DATE) AS d, CAST(l_linenumber AS INT) AS map_idx, CAST((l_suppkey * 37) % 180 AS DOUBLE) - 90 AS lat, CAST((l_partkey * 53) % 360 AS DOUBLE) - 180 AS lon, CAST(l_partkey % 97 AS DOUBLE) AS tec FROM lineitem)"


def cells(spark, d):
    """A gridded field: day, map of the day, place, value."""
    li = table(spark, d, "lineitem")
    return li.select(F.to_date("l_shipdate").alias("d"), F.col("l_linenumber").cast("int").alias("map_idx"), ((F.col("l_suppkey") * 37) % 180 - 90).cast("double").alias("lat"), ((F.col("l_partkey") * 53) % 360 - 180).cast("double").alias("lon"), (F.col("l_partkey") % 97).cast("double").alias("tec"))


@query("d01_daily_counts", ctes("ev") + " SELECT zone, d, count(*) AS n, count(*) FILTER (magnitude >= 5) AS n5, count(*) FILTER (magnitude >= 6) AS n6, max(magnitude) AS max_mag, round(avg(depth_km), 4) AS mean_depth FROM ev GROUP BY 1, 2")
def d01(spark, d):
    return events(spark, d).groupBy("zone", "d").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("magnitude") >= 5).alias("n5"), F.count_if(F.col("magnitude") >= 6).alias("n6"), F.max("magnitude").alias("max_mag"), F.round(F.avg("depth_km"), 4).alias("mean_depth"))


@query("d02_hourly_to_daily", "WITH h AS (SELECT event_type AS zone, date_trunc('hour', ts) AS h, max(value) AS x FROM events GROUP BY 1, 2) SELECT zone, CAST(h AS DATE) AS d, round(avg(x), 6) AS mean_x, min(x) AS min_x, max(x) AS max_x, round(max(x) - min(x), 6) AS range_x, round(stddev_samp(x), 6) AS std_x, count(*) AS n FROM h GROUP BY 1, 2 HAVING count(*) >= 18")
def d02(spark, d):
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("zone"), F.to_date("ts").alias("d"), F.hour("ts").alias("h")).agg(F.max("value").alias("x"))
    g = e.groupBy("zone", "d").agg(F.round(F.avg("x"), 6).alias("mean_x"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.round(F.max("x") - F.min("x"), 6).alias("range_x"), F.round(F.stddev_samp("x"), 6).alias("std_x"), F.count(F.lit(1)).alias("n"))
    return g.filter("n >= 18")


@query(
    "d03_regional_field",
    ctes("boxes")
    + f", {CELLS}, m AS (SELECT d, fault_id, map_idx, avg(tec) AS tec, count(*) AS n FROM cells JOIN boxes ON lat BETWEEN lat_min AND lat_max AND lon BETWEEN lon_min AND lon_max GROUP BY 1, 2, 3) SELECT d, fault_id, round(avg(tec), 4) AS tec_day, round(avg(tec) FILTER (map_idx IN (1, 2, 7)), 4) AS tec_night, CAST(sum(n) AS BIGINT) AS n_cells, count(*) AS n_maps FROM m GROUP BY 1, 2",
)
def d03(spark, d):
    m = spatial.bbox_join(cells(spark, d), boxes(spark, d)).groupBy("d", "fault_id", "map_idx").agg(F.avg("tec").alias("tec"), F.count(F.lit(1)).alias("n"))
    return m.groupBy("d", "fault_id").agg(F.round(F.avg("tec"), 4).alias("tec_day"), F.round(F.avg(F.when(F.col("map_idx").isin(1, 2, 7), F.col("tec"))), 4).alias("tec_night"), F.sum("n").alias("n_cells"), F.count(F.lit(1)).alias("n_maps"))


@query("d04_global_field", f"WITH {CELLS} SELECT d, round(avg(tec), 6) AS tec FROM cells GROUP BY 1")
def d04(spark, d):
    return cells(spark, d).groupBy("d").agg(F.round(F.avg("tec"), 6).alias("tec"))


@query("d05_station_stack", ctes("stations") + " SELECT d, round(quantile_cont(east, 0.5), 6) AS east, round(quantile_cont(north, 0.5), 6) AS north, round(quantile_cont(up, 0.5), 6) AS up, round(stddev_samp(east), 6) AS east_std, count(DISTINCT station_id) AS n_stations FROM stations GROUP BY 1 HAVING count(DISTINCT station_id) >= 3")
def d05(spark, d):
    s = stations(spark, d).groupBy("d").agg(*(F.round(F.percentile(c, 0.5), 6).alias(c) for c in ("east", "north", "up")), F.round(F.stddev_samp("east"), 6).alias("east_std"), F.countDistinct("station_id").alias("n_stations"))
    return s.filter("n_stations >= 3")


@query("d06_max_class", "WITH f AS (SELECT CAST(ts AS DATE) AS d, value, CASE WHEN value < 20 THEN 'A' WHEN value < 60 THEN 'B' WHEN value < 150 THEN 'C' WHEN value < 300 THEN 'M' ELSE 'X' END AS class FROM events) SELECT d, max(value) AS flux, max(class) AS top_class, bool_or(class = 'M') AS any_m, bool_or(class = 'X') AS any_x FROM f GROUP BY 1")
def d06(spark, d):
    from tremorlake.functions.exprs import bin_by

    f = table(spark, d, "events").select(F.to_date("ts").alias("d"), "value", bin_by("value", [20, 60, 150, 300], ["A", "B", "C", "M", "X"]).alias("class"))
    return f.groupBy("d").agg(F.max("value").alias("flux"), F.max_by("class", "value").alias("top_class"), F.bool_or(F.col("class") == "M").alias("any_m"), F.bool_or(F.col("class") == "X").alias("any_x"))


@query("d07_population_stats", ctes("sensor") + " SELECT zone, count(x) AS n, round(avg(x), 6) AS mean_x, round(stddev_samp(x), 6) AS std_x FROM sensor WHERE d < DATE '1999-01-01' AND n_obs >= 2 GROUP BY 1")
def d07(spark, d):
    return sensor(spark, d).filter("d < DATE '1999-01-01' AND n_obs >= 2").groupBy("zone").agg(F.count("x").alias("n"), F.round(F.avg("x"), 6).alias("mean_x"), F.round(F.stddev_samp("x"), 6).alias("std_x"))


@query("d08_quantiles", ctes("sensor") + " SELECT zone, min(x) AS q0, round(quantile_cont(x, 0.25), 4) AS q1, round(quantile_cont(x, 0.5), 4) AS q2, round(quantile_cont(x, 0.75), 4) AS q3, max(x) AS q4 FROM sensor GROUP BY 1")
def d08(spark, d):
    q = F.percentile("x", F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))
    return sensor(spark, d).groupBy("zone").agg(q.alias("q")).select("zone", F.col("q")[0].alias("q0"), *(F.round(F.col("q")[k], 4).alias(f"q{k}") for k in (1, 2, 3)), F.col("q")[4].alias("q4"))


@query("d09_ordered_array", ctes("ev") + " SELECT d, array_to_string(list_sort(list(CAST(CAST(magnitude * 100 AS INT) AS VARCHAR))), ',') AS mags FROM ev GROUP BY 1")
def d09(spark, d):
    return events(spark, d).groupBy("d").agg(F.array_join(F.sort_array(F.collect_list(F.round(F.col("magnitude") * 100).cast("int").cast("string"))), ",").alias("mags"))


@query("d10_corr", ctes("env", "sensor") + ", k AS (SELECT CAST(unnest([0, 1, 3, 7]) AS INT) AS lag) SELECT zone, lag, round(corr(e.kp_max, s.x), 4) AS r_kp, round(corr(e.dst_min, s.x), 4) AS r_dst, count(*) AS n FROM sensor s, k JOIN env e ON s.d = e.d + lag GROUP BY 1, 2")
def d10(spark, d):
    e = env(spark, d).withColumn("lag", F.explode(F.array(*map(F.lit, (0, 1, 3, 7))))).withColumn("d", F.date_add("d", F.col("lag")))
    return sensor(spark, d).join(e, "d").groupBy("zone", "lag").agg(F.round(pair_corr("kp_max", "x"), 4).alias("r_kp"), F.round(pair_corr("dst_min", "x"), 4).alias("r_dst"), F.count(F.lit(1)).alias("n"))


@query("d11_rate_by_bin", ctes("scored") + " SELECT CAST(floor(p * 2) AS INT) AS bin, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round(avg(y), 6) AS rate FROM scored GROUP BY 1")
def d11(spark, d):
    return scored(spark, d).groupBy(F.floor(F.col("p") * 2).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"), F.round(F.avg("y"), 6).alias("rate"))


@query("d12_band_summary", ctes("ev") + " SELECT 'shallow' AS band, count(*) FILTER (depth_km < 70) AS n FROM ev UNION ALL SELECT 'mid', count(*) FILTER (depth_km >= 70 AND depth_km < 300) FROM ev UNION ALL SELECT 'deep', count(*) FILTER (depth_km >= 300) FROM ev")
def d12(spark, d):
    k = F.col("depth_km")
    one = events(spark, d).agg(F.count_if(k < 70).alias("shallow"), F.count_if((k >= 70) & (k < 300)).alias("mid"), F.count_if(k >= 300).alias("deep"))
    return one.unpivot([], ["shallow", "mid", "deep"], "band", "n")


@query("d13_qa_rollup", ctes("sensor") + " SELECT zone, CASE WHEN d < DATE '1999-01-01' THEN 'train' ELSE 'test' END AS split, count(*) AS n, count(x) AS n_x, min(d) AS first_day, max(d) AS last_day, round(avg(x), 4) AS mean_x, round(stddev_samp(x), 4) AS std_x FROM sensor GROUP BY 1, 2")
def d13(spark, d):
    split = F.when(F.col("d") < F.lit("1999-01-01").cast("date"), "train").otherwise("test")
    return sensor(spark, d).groupBy("zone", split.alias("split")).agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("n_x"), F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.round(F.avg("x"), 4).alias("mean_x"), F.round(F.stddev_samp("x"), 4).alias("std_x"))


@query("d14_guarded_ratio", ctes("ev") + " SELECT zone, round(CAST(count(*) FILTER (magnitude >= 6.95) AS DOUBLE) / nullif(count(*) FILTER (depth_km > 698), 0), 6) AS ratio FROM ev GROUP BY 1")
def d14(spark, d):
    return events(spark, d).groupBy("zone").agg(F.round(F.try_divide(F.count_if(F.col("magnitude") >= 6.95).cast("double"), F.count_if(F.col("depth_km") > 698)), 6).alias("ratio"))


@query("d15_binned_counts", ctes("ev") + ", b AS (SELECT CAST(unnest(generate_series(0, 7)) AS INT) AS bin), c AS (SELECT CAST((event_id * 7 % 360) // 45 AS INT) AS bin, count(*) AS n FROM ev WHERE magnitude >= 6.9 GROUP BY 1) SELECT bin, coalesce(n, 0) AS n, round(sum(coalesce(n, 0)) OVER () / 8.0, 6) AS expected, round(coalesce(n, 0) / (sum(coalesce(n, 0)) OVER () / 8.0), 6) AS ratio FROM b LEFT JOIN c USING (bin)")
def d15(spark, d):
    from tremorlake.operators.statistics import binned_counts

    e = events(spark, d).filter("magnitude >= 6.9").select(F.floor((F.col("event_id") * 7 % 360) / 45).cast("int").alias("bin"))
    return binned_counts(e, "bin", 8).select("bin", "n", F.round("expected", 6).alias("expected"), F.round("ratio", 6).alias("ratio"))


@query("d16_grouping_sets", ctes("ev") + " SELECT coalesce(zone, 'pooled') AS zone, count(*) AS n, max(magnitude) AS max_mag FROM ev WHERE zone <> '4-NOT SPECIFIED' GROUP BY GROUPING SETS ((zone), ())")
def d16(spark, d):
    return events(spark, d).filter("zone <> '4-NOT SPECIFIED'").rollup("zone").agg(F.count(F.lit(1)).alias("n"), F.max("magnitude").alias("max_mag")).withColumn("zone", F.coalesce("zone", F.lit("pooled")))


@query("d17_weighted_mean", ctes("sensor") + " SELECT zone, round(sum(x * n_obs) / sum(n_obs), 4) AS weighted FROM sensor WHERE x > 0 GROUP BY 1")
def d17(spark, d):
    return sensor(spark, d).filter("x > 0").groupBy("zone").agg(F.round(F.sum(F.col("x") * F.col("n_obs")) / F.sum("n_obs"), 4).alias("weighted"))


@query("d18_base_rates", ctes("scored") + " SELECT coalesce(zone, 'all') AS zone, round(avg(y), 6) AS rate FROM scored WHERE d < DATE '1999-01-01' GROUP BY ROLLUP (zone)")
def d18(spark, d):
    return scored(spark, d).filter("d < DATE '1999-01-01'").rollup("zone").agg(F.round(F.avg("y"), 6).alias("rate")).withColumn("zone", F.coalesce("zone", F.lit("all")))


@query("d19_between_variance", ctes("scored") + ", m AS (SELECT zone, floor(p) AS bin, avg(y) AS m FROM scored GROUP BY 1, 2) SELECT zone, round(var_pop(m), 8) AS v FROM m GROUP BY 1 HAVING count(m) >= 2")
def d19(spark, d):
    m = scored(spark, d).groupBy("zone", F.floor("p").alias("bin")).agg(F.avg("y").alias("m"))
    return m.groupBy("zone").agg(F.round(F.var_pop("m"), 8).alias("v"), F.count("m").alias("k")).filter("k >= 2").drop("k")


@query("d20_distinct", ctes("ev") + " SELECT year(d) AS y, count(DISTINCT d) AS days, count(DISTINCT zone) AS zones FROM ev GROUP BY 1")
def d20(spark, d):
    return events(spark, d).groupBy(F.year("d").cast("long").alias("y")).agg(F.countDistinct("d").alias("days"), F.countDistinct("zone").alias("zones"))


@query("d21_freshness", "SELECT event_type, count(*) FILTER (ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOURS) AS last_day, count(*) FILTER (ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS) AS last_week FROM events GROUP BY 1")
def d21(spark, d):
    e = table(spark, d, "events")
    e = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))
    since = lambda gap: F.count_if(F.col("ts") >= F.col("now") - F.expr(gap))
    return e.groupBy("event_type").agg(since("INTERVAL 24 HOURS").alias("last_day"), since("INTERVAL 7 DAYS").alias("last_week"))


@query("d22_hazard_summary", ctes("quakes") + " SELECT zone, count(*) AS n, CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day FROM quakes GROUP BY 1")
def d22(spark, d):
    return quakes(spark, d).groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.to_date(F.min("ts")).alias("first_day"), F.to_date(F.max("ts")).alias("last_day")).orderBy(F.desc("n"), "zone")


@query("f01_total_order", ctes("ev") + " SELECT zone, d, event_id FROM ev WHERE magnitude >= 6.5 ORDER BY zone, d, event_id")
def f01(spark, d):
    return events(spark, d).filter("magnitude >= 6.5").select("zone", "d", "event_id").orderBy("zone", "d", "event_id")


@query("f02_top_k", ctes("ev") + " SELECT event_id, magnitude FROM ev ORDER BY magnitude DESC, event_id LIMIT 20")
def f02(spark, d):
    return events(spark, d).select("event_id", "magnitude").orderBy(F.desc("magnitude"), "event_id").limit(20)


@query("f03_latest_n", "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5")
def f03(spark, d):
    r = F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, d, "events").withColumn("r", r).filter("r <= 5").select("event_type", "event_id")


@query("f05_upper_median", ctes("ev") + " SELECT zone, list_extract(list_sort(list(depth_km)), CAST(count(*) // 2 AS BIGINT) + 1) AS med FROM ev GROUP BY 1")
def f05(spark, d):
    r = F.row_number().over(W.partitionBy("zone").orderBy("depth_km")) - 1
    n = F.count(F.lit(1)).over(W.partitionBy("zone"))
    return events(spark, d).select("zone", "depth_km", r.alias("r"), n.alias("n")).filter("r = n div 2").select("zone", F.col("depth_km").alias("med"))


@query("g01_union_all", ctes("ev") + " SELECT zone, d FROM ev WHERE magnitude >= 6.8 UNION ALL SELECT 'global', d FROM ev WHERE magnitude >= 6.8")
def g01(spark, d):
    e = events(spark, d).filter("magnitude >= 6.8").select("zone", "d")
    return tables.union_all([e, e.withColumn("zone", F.lit("global"))])


@query("g03_date_union", ctes("ev", "sensor") + " SELECT d FROM ev WHERE magnitude >= 6.9 UNION SELECT d FROM sensor WHERE n_obs >= 12")
def g03(spark, d):
    return tables.set_union(events(spark, d).filter("magnitude >= 6.9").select("d"), sensor(spark, d).filter("n_obs >= 12").select("d"))


@query("g04_difference", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def g04(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_custkey").distinct().join(o.filter("o_orderstatus = 'F'").select("o_custkey"), "o_custkey", "left_anti")


@query("g05_distinct", ctes("ev") + " SELECT DISTINCT zone, d FROM ev")
def g05(spark, d):
    return events(spark, d).select("zone", "d").distinct()
