"""Queries of window functions over the daily sensor series."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremorlake.operators import windows
from tremorlake.plans.bindings import ctes, env, events, sensor
from tremorlake.plans.panels import FILLED, SPINE, filled_panel
from tremorlake.plans.registry import query


@query("e01_rolling", ctes("sensor") + " SELECT zone, d, round(sum(x) OVER a, 4) AS s7, round(avg(x) OVER b, 4) AS a30, max(x) OVER c AS m90, round(stddev_samp(x) OVER b, 4) AS sd30 FROM sensor WINDOW a AS (PARTITION BY zone ORDER BY d ROWS 6 PRECEDING), b AS (PARTITION BY zone ORDER BY d ROWS 29 PRECEDING), c AS (PARTITION BY zone ORDER BY d ROWS 89 PRECEDING)")
def e01(spark, d):
    r = windows.rolling(sensor(spark, d), "zone", "d", {"s7": ("x", "sum", 7), "a30": ("x", "avg", 30), "m90": ("x", "max", 90), "sd30": ("x", "std", 30)})
    return r.select("zone", "d", F.round("s7", 4).alias("s7"), F.round("a30", 4).alias("a30"), "m90", F.round("sd30", 4).alias("sd30"))


@query("e02_rolling_prior", ctes("sensor") + " SELECT zone, d, round(avg(x) OVER (PARTITION BY zone ORDER BY d ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING), 4) AS a15, max(x) OVER (PARTITION BY zone ORDER BY d ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS m7 FROM sensor")
def e02(spark, d):
    return windows.rolling(sensor(spark, d), "zone", "d", {"a15": ("x", "avg", 15), "m7": ("x", "max", 7)}, prior=True).select("zone", "d", F.round("a15", 4).alias("a15"), "m7")


@query("e03_lags", ctes("sensor") + " SELECT zone, d, lag(x, 1) OVER w AS x_lag1, lag(x, 3) OVER w AS x_lag3, lag(x, 7) OVER w AS x_lag7 FROM sensor WINDOW w AS (PARTITION BY zone ORDER BY d)")
def e03(spark, d):
    return windows.lags(sensor(spark, d), "zone", "d", "x", [1, 3, 7]).drop("x", "n_obs")


@query("e04_deltas", ctes("sensor") + " SELECT zone, d, round(x - lag(x, 3) OVER w, 4) AS d3, round(x - lag(x, 14) OVER w, 4) AS d14 FROM sensor WINDOW w AS (PARTITION BY zone ORDER BY d)")
def e04(spark, d):
    return windows.deltas(sensor(spark, d), "zone", "d", "x", [3, 14]).select("zone", "d", F.round("x_delta3", 4).alias("d3"), F.round("x_delta14", 4).alias("d14"))


@query("e05_max_abs", ctes("env") + " SELECT d, max(abs(dst_min)) OVER (ORDER BY d ROWS 13 PRECEDING) AS worst FROM env")
def e05(spark, d):
    e = env(spark, d).withColumn("all", F.lit(0))
    return windows.rolling(e, "all", "d", {"worst": (F.abs("dst_min"), "max", 14)}).select("d", "worst")


@query("e06_min_periods", ctes("sensor") + " SELECT zone, d, round(CASE WHEN count(x) OVER w >= 15 THEN avg(x) OVER w END, 4) AS base FROM sensor WINDOW w AS (PARTITION BY zone ORDER BY d ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)")
def e06(spark, d):
    return windows.rolling(sensor(spark, d), "zone", "d", {"base": ("x", "avg", 30)}, prior=True, min_periods=15).select("zone", "d", F.round("base", 4).alias("base"))


@query("e07_median_anomaly", ctes("sensor") + " SELECT zone, d, CASE WHEN count(x) OVER w >= 14 THEN CASE WHEN stddev_samp(x) OVER w < 0.01 THEN 0.0 ELSE round((x - quantile_cont(x, 0.5) OVER w) / stddev_samp(x) OVER w, 4) END END AS anomaly FROM sensor WINDOW w AS (PARTITION BY zone ORDER BY d ROWS BETWEEN 27 PRECEDING AND 1 PRECEDING)")
def e07(spark, d):
    return windows.median_anomaly(sensor(spark, d), "zone", "d", "x").select("zone", "d", "anomaly")


@query(
    "e08_iqr_anomaly",
    ctes("sensor")
    + """, q AS (SELECT zone, d, x, n_obs % 5 <> 0 AS clean, quantile_cont(CASE WHEN n_obs % 5 <> 0 THEN x END, 0.25) OVER w AS p25, quantile_cont(CASE WHEN n_obs % 5 <> 0 THEN x END, 0.5) OVER w AS p50, quantile_cont(CASE WHEN n_obs % 5 <> 0 THEN x END, 0.75) OVER w AS p75 FROM sensor
    WINDOW w AS (PARTITION BY zone ORDER BY d RANGE BETWEEN INTERVAL 27 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING))
    SELECT zone, d, round(p25, 4) AS p25, round(p50, 4) AS p50, round(p75, 4) AS p75, round(CASE WHEN p75 - p25 > 0 THEN (x - p50) / (p75 - p25) END, 4) AS iqr_z, CAST(coalesce(clean AND (x < p25 - 1.5 * (p75 - p25) OR x > p75 + 1.5 * (p75 - p25)), FALSE) AS INT) AS outlier FROM q""",
)
def e08(spark, d):
    r = windows.iqr_anomaly(sensor(spark, d), "zone", "d", "x", F.col("n_obs") % 5 != 0)
    return r.select("zone", "d", *(F.round(c, 4).alias(c) for c in ("p25", "p50", "p75", "iqr_z")), "outlier")


@query("e09_b_value", ctes("ev") + f", {SPINE}, {FILLED}, m AS (SELECT zone, d, avg(mean_mag) OVER (PARTITION BY zone ORDER BY d ROWS 89 PRECEDING) AS mm FROM filled) SELECT zone, d, round(CASE WHEN mm > 2.0 THEN 0.4343 / (mm - 2.0) END, 6) AS b FROM m")
def e09(spark, d):
    m = windows.rolling(filled_panel(spark, d), "zone", "d", {"mm": ("mean_mag", "avg", 90)})
    return m.select("zone", "d", F.round(F.when(F.col("mm") > 2.0, F.lit(0.4343) / (F.col("mm") - 2.0)), 6).alias("b"))


@query(
    "e10_quiescence_foreshock",
    ctes("ev")
    + f", {SPINE}, {FILLED}, r AS (SELECT zone, d, n, avg(n) OVER w AS m, stddev_samp(n) OVER w AS sd, sum(n) OVER (PARTITION BY zone ORDER BY d ROWS 6 PRECEDING) AS s7 FROM filled WINDOW w AS (PARTITION BY zone ORDER BY d ROWS 364 PRECEDING)) SELECT zone, d, round(CASE WHEN sd > 0 THEN (n - m) / sd ELSE 0.0 END, 6) AS quiescence_z, round(CASE WHEN sd > 0 THEN (s7 - m) / sd ELSE 0.0 END, 6) AS foreshock_rate_z FROM r",
)
def e10(spark, d):
    r = windows.rolling(filled_panel(spark, d), "zone", "d", {"m": ("n", "avg", 365), "sd": ("n", "std", 365), "s7": ("n", "sum", 7)})
    z = lambda c: F.round(F.when(F.col("sd") > 0, (F.col(c) - F.col("m")) / F.col("sd")).otherwise(0.0), 6)
    return r.select("zone", "d", z("n").alias("quiescence_z"), z("s7").alias("foreshock_rate_z"))


@query("e11_zscore_prior", ctes("sensor") + ", r AS (SELECT zone, d, x, avg(x) OVER w AS m, stddev_samp(x) OVER w AS sd FROM sensor WINDOW w AS (PARTITION BY zone ORDER BY d ROWS BETWEEN 365 PRECEDING AND 1 PRECEDING)) SELECT zone, d, round(CASE WHEN sd > 0 THEN (x - m) / sd END, 6) AS z FROM r")
def e11(spark, d):
    r = windows.rolling(sensor(spark, d), "zone", "d", {"m": ("x", "avg", 365), "sd": ("x", "std", 365)}, prior=True)
    return r.select("zone", "d", F.round(F.when(F.col("sd") > 0, (F.col("x") - F.col("m")) / F.col("sd")), 6).alias("z"))


@query("e12_newest_rank", ctes("ev") + " SELECT zone, event_id, row_number() OVER (PARTITION BY zone ORDER BY d DESC, event_id DESC) AS rank FROM ev")
def e12(spark, d):
    rank = F.row_number().over(W.partitionBy("zone").orderBy(F.col("d").desc(), F.col("event_id").desc()))
    return events(spark, d).select("zone", "event_id", rank.cast("long").alias("rank"))


@query("e13_qcut", ctes("env") + ", c AS (SELECT quantile_cont(sw_speed, 1.0/3) AS a, quantile_cont(sw_speed, 2.0/3) AS b FROM env) SELECT d, CAST(CASE WHEN sw_speed > a THEN 1 ELSE 0 END + CASE WHEN a <> b AND sw_speed > b THEN 1 ELSE 0 END AS INT) AS part FROM env, c")
def e13(spark, d):
    return windows.qcut(env(spark, d), "sw_speed", 3).select("d", "part")


@query(
    "e14_interpolate",
    ctes("sensor")
    + """, s AS (SELECT zone, d, CASE WHEN n_obs % 3 = 0 THEN NULL ELSE x END AS v, row_number() OVER (PARTITION BY zone ORDER BY d) AS i FROM sensor),
    g AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS a, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER p AS ia, first_value(v IGNORE NULLS) OVER n AS b, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER n AS ib FROM s
      WINDOW p AS (PARTITION BY zone ORDER BY d ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY zone ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT zone, d, round(coalesce(v, CASE WHEN i - ia <= 3 THEN CASE WHEN b IS NULL THEN a ELSE a + (b - a) * (i - ia) / (ib - ia) END END), 4) AS filled FROM g""",
)
def e14(spark, d):
    s = sensor(spark, d).select("zone", "d", F.when(F.col("n_obs") % 3 == 0, None).otherwise(F.col("x")).alias("v"))
    return windows.interpolate(s, "zone", "d", "v").select("zone", "d", F.round("filled", 4).alias("filled"))


@query("e16_named_windows", ctes("env") + " SELECT d, CAST(sum(n) OVER w3 AS BIGINT) AS s3, CAST(sum(n) OVER w27 AS BIGINT) AS s27, max(kp_max) OVER w27 AS k27 FROM env WINDOW w3 AS (ORDER BY d ROWS 2 PRECEDING), w27 AS (ORDER BY d ROWS 26 PRECEDING)")
def e16(spark, d):
    e = env(spark, d).withColumn("all", F.lit(0))
    return windows.rolling(e, "all", "d", {"s3": ("n", "sum", 3), "s27": ("n", "sum", 27), "k27": ("kp_max", "max", 27)}).select("d", "s3", "s27", "k27")
