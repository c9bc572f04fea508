"""The daily zone panel: spine, counts, rolling features, forward labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorlake.functions import exprs as X
from tremorlake.operators import panel, windows
from tremorlake.plans.bindings import ctes, env, events, reports, sensor
from tremorlake.plans.registry import query

SPINE = "span AS (SELECT min(d) AS a, max(d) AS b FROM ev), spine AS (SELECT zone, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT DISTINCT zone FROM ev), span)"
FILLED = "filled AS (SELECT s.zone, s.d, count(e.event_id) AS n, count(*) FILTER (e.magnitude >= 5) AS n5, max(e.magnitude) AS max_mag, avg(e.magnitude) AS mean_mag FROM spine s LEFT JOIN ev e ON s.zone = e.zone AND s.d = e.d GROUP BY 1, 2)"


def filled_panel(spark, d):
    """Daily counts on the dense spine, zero where no event fell."""
    ev = events(spark, d)
    daily = ev.groupBy("zone", "d").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("magnitude") >= 5).alias("n5"), F.max("magnitude").alias("max_mag"), F.avg("magnitude").alias("mean_mag"))
    return panel.spine_of(ev, "zone", "d").join(daily, ["zone", "d"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "n5")})


@query(
    "seismic_panel",
    ctes("ev")
    + f", {SPINE}, {FILLED}"
    + """, fut AS (SELECT zone, CAST(d - k AS DATE) AS d, magnitude FROM ev, (SELECT CAST(unnest(generate_series(1, 7)) AS INT) AS k) WHERE magnitude >= 6),
    lab AS (SELECT zone, d, count(*) AS c, max(magnitude) AS m FROM fut GROUP BY 1, 2),
    roll AS (SELECT zone, d, n, n5, sum(n) OVER w7 AS n_7d, sum(n) OVER w30 AS n_30d, max(max_mag) OVER w30 AS max_30d, round(avg(round(max_mag * 100)) OVER w90, 9) AS mean_90d, round(stddev_samp(n) OVER w30, 6) AS std_30d FROM filled
      WINDOW w7 AS (PARTITION BY zone ORDER BY d ROWS 6 PRECEDING), w30 AS (PARTITION BY zone ORDER BY d ROWS 29 PRECEDING), w90 AS (PARTITION BY zone ORDER BY d ROWS 89 PRECEDING))
    SELECT r.zone, r.d, n, n5, CAST(n_7d AS BIGINT) AS n_7d, CAST(n_30d AS BIGINT) AS n_30d, max_30d, mean_90d, std_30d, CAST(c IS NOT NULL AS INT) AS label_7d, coalesce(c, 0) AS count_7d, m AS max_7d,
    CASE WHEN r.d <= DATE '1998-12-31' THEN 'train' WHEN r.d <= DATE '1999-12-31' THEN 'validate' ELSE 'test' END AS split FROM roll r LEFT JOIN lab USING (zone, d)""",
)
def seismic_panel(spark, d):
    p = windows.rolling(filled_panel(spark, d), "zone", "d", {"n_7d": ("n", "sum", 7), "n_30d": ("n", "sum", 30), "max_30d": ("max_mag", "max", 30), "mean_90d": (F.round(F.col("max_mag") * 100), "avg", 90), "std_30d": ("n", "std", 30)})
    p = panel.forward_label(p, events(spark, d), 1, 7, "7d", where=F.col("magnitude") >= 6)
    split = X.time_split("d", [("1998-12-31", "train"), ("1999-12-31", "validate")], "test")
    return p.select("zone", "d", "n", "n5", "n_7d", "n_30d", "max_30d", F.round("mean_90d", 9).alias("mean_90d"), F.round("std_30d", 6).alias("std_30d"), "label_7d", "count_7d", "max_7d", split.alias("split"))


@query("c05_date_zone_spine", "SELECT 'z' || CAST(r_regionkey AS VARCHAR) AS fault_id, CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 DAY)) AS DATE) AS date_val FROM region")
def c05(spark, d):
    from tremorlake.plans.bindings import boxes

    return panel.date_zone_spine(boxes(spark, d), "1995-01-01", "2001-08-01")


def _label_sql(lo, hi, where):
    return f"""SELECT s.zone, s.d, CAST(count(e.event_id) > 0 AS INT) AS label_x, count(e.event_id) AS count_x, max(e.magnitude) AS max_x FROM spine s LEFT JOIN (SELECT * FROM ev WHERE {where}) e
    ON e.zone = s.zone AND e.d BETWEEN s.d + {lo} AND s.d + {hi} GROUP BY 1, 2"""


@query("c06_forward_label", ctes("ev") + f", {SPINE} " + _label_sql(1, 5, "magnitude >= 6 AND depth_km <= 300"))
def c06(spark, d):
    ev = events(spark, d)
    return panel.forward_label(panel.spine_of(ev, "zone", "d"), ev, 1, 5, "x", where=(F.col("magnitude") >= 6) & (F.col("depth_km") <= 300))


@query("c08_same_day_label", ctes("ev") + f", {SPINE} " + _label_sql(0, 6, "magnitude >= 6.5"))
def c08(spark, d):
    ev = events(spark, d)
    return panel.forward_label(panel.spine_of(ev, "zone", "d"), ev, 0, 6, "x", where=F.col("magnitude") >= 6.5)


@query("c07_exists_forward", ctes("ev") + " SELECT event_id, CAST(EXISTS (SELECT 1 FROM ev f WHERE f.zone = e.zone AND f.magnitude >= 6.8 AND f.d BETWEEN e.d + 1 AND e.d + 14) AS INT) AS follows FROM ev e")
def c07(spark, d):
    ev = events(spark, d)
    days = ev.filter("magnitude >= 6.8").select("zone", F.explode(F.sequence(F.date_sub("d", 14), F.date_sub("d", 1), F.expr("INTERVAL 1 DAY"))).alias("d")).distinct().withColumn("hit", F.lit(1))
    return ev.join(days, ["zone", "d"], "left").select("event_id", F.coalesce("hit", F.lit(0)).alias("follows"))


@query("c10_calendar_lag", ctes("sensor") + " SELECT a.zone, a.d, a.x, b.x AS x_lag5 FROM sensor a LEFT JOIN sensor b ON a.zone = b.zone AND b.d = a.d - 5")
def c10(spark, d):
    return panel.calendar_lag(sensor(spark, d).select("zone", "d", "x"), ["x"], 5)


@query(
    "c12_converge",
    ctes("ev", "sensor", "env")
    + f", {SPINE}, day_sensor AS (SELECT d, floor(avg(x)) AS x FROM sensor GROUP BY d) SELECT s.zone, s.d, e.kp_max AS geomag_kp_max, CAST(e.d IS NOT NULL AS INT) AS has_geomag, t.x AS tec_x, CAST(t.d IS NOT NULL AS INT) AS has_tec FROM spine s LEFT JOIN env e ON s.d = e.d LEFT JOIN day_sensor t ON s.d = t.d",
)
def c12(spark, d):
    base = panel.spine_of(events(spark, d), "zone", "d")
    tec = sensor(spark, d).groupBy("d").agg(F.floor(F.avg("x")).cast("double").alias("x"))
    return panel.converge(base, {"geomag": env(spark, d).select("d", "kp_max"), "tec": tec}, ["d"]).select("zone", "d", "geomag_kp_max", "has_geomag", "tec_x", "has_tec")


@query("c14_outer_by_day", ctes("sensor", "env") + " SELECT d, n, x FROM (SELECT d, n FROM env) FULL JOIN (SELECT d, floor(max(x)) AS x FROM sensor WHERE zone = 'A' GROUP BY d) USING (d)")
def c14(spark, d):
    a = sensor(spark, d).filter("zone = 'A'").groupBy("d").agg(F.floor(F.max("x")).cast("double").alias("x"))
    return panel.outer_by_day({"env": env(spark, d).select("d", "n"), "tec": a}).select("d", "n", "x")


@query(
    "report_signal",
    ctes("reports")
    + """, scored AS (SELECT experience_date AS d, CASE urgency_level WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END + CAST(water_imagery AS INT) + CAST(destruction_imagery AS INT) + CASE WHEN emotion IN ('fear', 'dread') THEN 2 WHEN emotion = 'calm' THEN 1 ELSE 0 END AS score, urgency_level, water_imagery FROM reports),
    span AS (SELECT min(d) AS a, max(d) AS b FROM scored), days AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM span),
    daily AS (SELECT d.d, count(s.score) AS n, CAST(coalesce(sum(score), 0) AS BIGINT) AS total, count(*) FILTER (urgency_level = 'high') AS n_high, count(*) FILTER (water_imagery) AS n_water FROM days d LEFT JOIN scored s ON d.d = s.d GROUP BY 1),
    w AS (SELECT *, avg(total) OVER p AS m, stddev_samp(total) OVER p AS sd FROM daily WINDOW p AS (ORDER BY d ROWS BETWEEN 365 PRECEDING AND 1 PRECEDING))
    SELECT d, n, total, n_high, n_water, round(CASE WHEN sd > 0 THEN (total - m) / sd END, 6) AS zscore FROM w""",
)
def report_signal(spark, d):
    r = reports(spark, d).select(F.col("experience_date").alias("d"), X.intensity_score("urgency_level", ["water_imagery", "destruction_imagery"], "emotion").alias("score"), "urgency_level", "water_imagery", F.lit("all").alias("zone"))
    days = panel.spine_of(r, "zone", "d")
    daily = r.groupBy("zone", "d").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"), F.count_if(F.col("urgency_level") == "high").alias("n_high"), F.count_if("water_imagery").alias("n_water"))
    filled = days.join(daily, ["zone", "d"], "left").fillna(0, ["n", "total", "n_high", "n_water"])
    w = windows.rolling(filled, "zone", "d", {"m": ("total", "avg", 365), "sd": ("total", "std", 365)}, prior=True)
    return w.select("d", "n", "total", "n_high", "n_water", F.round(X.z("total", "m", "sd"), 6).alias("zscore"))
