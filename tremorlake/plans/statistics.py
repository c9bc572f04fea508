"""Queries of event-study statistics and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorlake.operators import epoch, spatial
from tremorlake.operators import statistics as S
from tremorlake.plans.bindings import ctes, events, reports, scored, sensor
from tremorlake.plans.joins import KM
from tremorlake.plans.registry import query

SEED = 42
DRAW = "CAST('0x' || substr(md5({}), {}, 8) AS BIGINT)"


def draw(*keys: str, part: int = 0) -> str:
    """SQL of the portable draw, or of a later one of several from one MD5."""
    return DRAW.format(" || '|' || ".join([f"'{SEED}'", *(f"CAST({k} AS VARCHAR)" for k in keys)]), 1 + 8 * part)


EPOCH = "sig AS (SELECT d, x, CAST(n_obs AS DOUBLE) AS w FROM sensor WHERE zone = 'R'), big AS (SELECT event_id, d FROM ev WHERE magnitude >= 6.9), k AS (SELECT CAST(unnest(generate_series(-7, 7)) AS INT) AS rel_day)"
OBS = "obs AS (SELECT rel_day, avg(x) AS x, avg(w) AS w, count(x) AS n FROM big, k JOIN sig ON sig.d = big.d + rel_day GROUP BY 1)"
SHIFT = f"""it AS (SELECT CAST(unnest(generate_series(0, 49)) AS INT) AS iter), raw AS (SELECT iter, event_id, CAST(d + CAST((365 + {draw("iter", "event_id")} % 365) * CASE WHEN {draw("iter", "event_id", part=1)} % 2 = 0 THEN 1 ELSE -1 END AS INT) AS DATE) AS d2, CAST({draw("iter", "event_id", part=2)} % 30 AS INT) AS r FROM big, it),
moved AS (SELECT iter, event_id, CASE WHEN d2 < DATE '1995-01-01' THEN CAST(DATE '1995-01-01' + r AS DATE) WHEN d2 > DATE '2001-08-01' THEN CAST(DATE '2001-08-01' - r AS DATE) ELSE d2 END AS d FROM raw),
nul AS (SELECT iter, rel_day, avg(x) AS x, avg(w) AS w FROM moved, k JOIN sig ON sig.d = moved.d + rel_day GROUP BY 1, 2)"""


def _parts(spark, d):
    sig = sensor(spark, d).filter("zone = 'R'").select("d", "x", F.col("n_obs").cast("double").alias("w"))
    return events(spark, d).filter("magnitude >= 6.9").select("event_id", "d"), sig


def _null(spark, d, iters=50):
    big, sig = _parts(spark, d)
    return epoch.permuted_epoch(big, sig, ["x", "w"], 7, iters, SEED, "1995-01-01", "2001-08-01")


@query("h01_superposed_epoch", ctes("ev", "sensor") + f", {EPOCH}, {OBS} SELECT 'x' AS metric, rel_day, round(x, 4) AS obs_mean, n AS n_obs FROM obs UNION ALL SELECT 'w', rel_day, round(w, 4), n FROM obs")
def h01(spark, d):
    big, sig = _parts(spark, d)
    return epoch.superposed_epoch(big, sig, ["x", "w"], 7).select("metric", "rel_day", F.round("obs_mean", 4).alias("obs_mean"), "n_obs")


@query("h02_permuted_epoch", ctes("ev", "sensor") + f", {EPOCH}, {SHIFT} SELECT iter, 'x' AS metric, rel_day, round(x + 1e-7, 4) AS perm_mean FROM nul UNION ALL SELECT iter, 'w', rel_day, round(w + 1e-7, 4) FROM nul")
def h02(spark, d):
    return _null(spark, d).select("iter", "metric", "rel_day", F.round(F.col("perm_mean") + 1e-7, 4).alias("perm_mean"))


@query(
    "h03_epoch_z",
    ctes("ev", "sensor")
    + f", {EPOCH}, {OBS}, {SHIFT} SELECT rel_day, round(any_value(o.x), 4) AS obs_mean, round(avg(nul.x), 4) AS null_mean, round(stddev_pop(nul.x), 4) AS null_std, round((any_value(o.x) - avg(nul.x)) / stddev_pop(nul.x), 4) AS zscore, round(avg(CAST(nul.x >= o.x AS INT)), 6) AS p_value FROM obs o JOIN nul USING (rel_day) GROUP BY rel_day",
)
def h03(spark, d):
    big, sig = _parts(spark, d)
    z = epoch.epoch_z(epoch.superposed_epoch(big, sig, ["x", "w"], 7), _null(spark, d), ["metric", "rel_day"]).filter("metric = 'x'")
    return z.select("rel_day", *(F.round(c, 4).alias(c) for c in ("obs_mean", "null_mean", "null_std", "zscore")), F.round("p_value", 6).alias("p_value"))


@query("h04_window_summary", ctes("ev", "sensor") + f", {EPOCH}, {OBS}, q AS (SELECT CAST(unnest([3, 5, 7, 14, 30]) AS INT) AS kk) SELECT kk AS k, round(avg(x), 4) AS mean_value FROM obs, q WHERE rel_day <= -1 AND rel_day >= -least(kk, 7) GROUP BY 1")
def h04(spark, d):
    big, sig = _parts(spark, d)
    return epoch.window_summary(epoch.superposed_epoch(big, sig, ["x"], 7), [3, 5, 7, 14, 30], "obs_mean", [], 7).select("k", F.round("mean_value", 4).alias("mean_value"))


@query("h06_bh_fdr", "WITH p AS (SELECT o_custkey, round(CAST(sum(o_orderkey) % 1000 AS DOUBLE) / 100000, 6) AS p FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, o_custkey) AS rank, count(*) OVER () AS n FROM p) SELECT o_custkey, p, p <= rank * 0.05 / n AS rejected FROM r")
def h06(spark, d):
    from tremorlake.sources.tables import table

    p = table(spark, d, "orders").groupBy("o_custkey").agg(F.round((F.sum("o_orderkey") % 1000).cast("double") / 100000, 6).alias("p"))
    return S.bh_fdr(p, "p").select("o_custkey", "p", "rejected")


BINS = "b AS (SELECT zone, CAST((event_id * 7 % 360) // 45 AS INT) AS bin, count(*) AS n FROM ev WHERE magnitude >= 6 GROUP BY 1, 2), t AS (SELECT zone, CAST(sum(n) AS DOUBLE) / 8 AS e FROM b GROUP BY 1)"


@query("h07_chi2_uniform", ctes("ev") + f", {BINS} SELECT b.zone, round(sum(pow(n - e, 2) / e) + (8 - count(*)) * any_value(e), 6) AS chi2 FROM b JOIN t USING (zone) GROUP BY 1")
def h07(spark, d):
    e = events(spark, d).filter("magnitude >= 6").select("zone", F.floor((F.col("event_id") * 7 % 360) / 45).cast("int").alias("bin"))
    return S.chi2_uniform(S.binned_counts(e, "bin", 8, ["zone"]), ["zone"]).select("zone", F.round("chi2", 6).alias("chi2"))


@query(
    "h09_moderation",
    ctes("ev", "sensor")
    + f""", sig AS (SELECT d, x FROM sensor WHERE zone = 'R'), big AS (SELECT event_id, d, CAST(event_id % 4 AS INT) AS bin FROM ev WHERE magnitude >= 6.9), k AS (SELECT CAST(unnest(generate_series(-5, -1)) AS INT) AS rel_day),
    pre AS (SELECT event_id, bin, avg(x) AS m FROM big, k JOIN sig ON sig.d = big.d + rel_day GROUP BY 1, 2), n AS (SELECT event_id, bin, m FROM pre), cum AS (SELECT bin, sum(c) OVER (ORDER BY bin) AS hi, sum(c) OVER (ORDER BY bin) - c AS lo FROM (SELECT bin, count(*) AS c FROM n GROUP BY 1)),
    it AS (SELECT CAST(unnest(generate_series(0, 29)) AS INT) AS iter), sh AS (SELECT iter, m, row_number() OVER (PARTITION BY iter ORDER BY {draw("iter", "event_id")}, event_id) AS r FROM n, it),
    nul AS (SELECT iter, var_pop(a) AS v FROM (SELECT iter, bin, avg(sh.m) AS a FROM sh JOIN cum ON r > lo AND r <= hi GROUP BY 1, 2) GROUP BY 1), obs AS (SELECT var_pop(a) AS v FROM (SELECT bin, avg(m) AS a FROM n GROUP BY 1 HAVING count(*) >= 5))
    SELECT round(any_value(obs.v), 2) AS observed, round(avg(nul.v), 2) AS null_mean, round(avg(CAST(nul.v >= obs.v AS INT)), 6) AS p FROM nul, obs""",
)
def h09(spark, d):
    from tremorlake.operators.moderation import moderation_test

    sig = sensor(spark, d).filter("zone = 'R'").select("d", "x")
    big = events(spark, d).filter("magnitude >= 6.9").select("event_id", "d", (F.col("event_id") % 4).cast("int").alias("bin"))
    t = moderation_test(big, sig, "bin", "x", (-5, -1), 30, SEED)
    return t.select(F.round("observed", 2).alias("observed"), F.round("null_mean", 2).alias("null_mean"), F.round("p", 6).alias("p"))


@query("h13_window_edges", ctes("ev") + f", e AS (SELECT *, pow(10.0, 0.1238 * magnitude + 0.983) AS km_max, CASE WHEN magnitude >= 6.5 THEN pow(10.0, 0.032 * magnitude + 2.7389) ELSE pow(10.0, 0.5409 * magnitude - 0.547) END AS days_max FROM ev WHERE magnitude >= 5) SELECT a.event_id AS src, b.event_id AS dst FROM e a JOIN e b ON (b.d > a.d OR (b.d = a.d AND b.event_id > a.event_id)) AND b.d - a.d <= a.days_max AND {KM.format(a='a.', b='b.')} <= a.km_max")
def h13_edges(spark, d):
    return spatial.window_edges(events(spark, d).filter("magnitude >= 5"))


AUC = """t AS (SELECT {by} p, sum(y) AS pos, count(*) AS n FROM scored GROUP BY {grp} p), c AS (SELECT *, coalesce(sum(n - pos) OVER ({part} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(pos) OVER ({part} ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(n) OVER ({part} ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS seen FROM t)"""


@query(
    "h16_binary_metrics",
    ctes("scored").replace("l_returnflag AS zone FROM", "l_linestatus AS zone FROM")
    + ", "
    + AUC.format(by="zone,", grp="zone,", part="PARTITION BY zone")
    + ", b AS (SELECT zone, avg(pow(p - y, 2)) AS brier FROM scored GROUP BY 1) SELECT zone, CAST(sum(n) AS BIGINT) AS n, round(sum(pos * (below + (n - pos) / 2.0)) / (sum(pos) * sum(n - pos)), 6) AS auroc, round(sum(CAST(pos AS DOUBLE) * tp / seen) / sum(pos), 6) AS avg_precision, round(any_value(brier), 6) AS brier FROM c JOIN b USING (zone) GROUP BY 1",
)
def h16(spark, d):
    from tremorlake.sources.tables import table

    li = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") * 10).alias("p"), F.col("l_linestatus").alias("zone"))
    m = S.binary_metrics(li, "y", "p", ["zone"])
    return m.select("zone", "n", *(F.round(c, 6).alias(c) for c in ("auroc", "avg_precision", "brier")))


@query(
    "h25_correspondence",
    ctes("reports", "ev")
    + f""", p AS (SELECT * FROM reports WHERE lat IS NOT NULL), e AS (SELECT * FROM ev WHERE magnitude >= 5), it AS (SELECT CAST(unnest(generate_series(0, 9)) AS INT) AS iter),
    q AS (SELECT iter, submission_id, CASE WHEN iter = 0 THEN experience_date ELSE CAST(experience_date + CAST({draw("iter", "submission_id")} % 731 - 365 AS INT) AS DATE) END AS d, lat, lon FROM p, it),
    n AS (SELECT iter, submission_id, min({KM.format(a="q.", b="e.")}) AS km FROM q JOIN e ON e.d BETWEEN q.d AND q.d + 14 GROUP BY 1, 2), m AS (SELECT iter, avg(km) AS km FROM n GROUP BY 1)
    SELECT round(max(km) FILTER (iter = 0), 3) AS observed, round(avg(km) FILTER (iter > 0), 3) AS null_mean, round(avg(CAST(km <= (SELECT km FROM m WHERE iter = 0) AS INT)) FILTER (iter > 0), 6) AS p FROM m""",
)
def h25(spark, d):
    from tremorlake.operators.moderation import spatial_correspondence

    p = reports(spark, d).filter("lat IS NOT NULL").select("submission_id", F.col("experience_date").alias("d"), "lat", "lon")
    r = spatial_correspondence(p, events(spark, d).filter("magnitude >= 5"), 9, SEED, "submission_id", 14)
    return r.select(F.round("observed", 3).alias("observed"), F.round("null_mean", 3).alias("null_mean"), F.round("p", 6).alias("p"))


@query("h27_catalog_check", ctes("ev") + " SELECT year(d) AS y, count(*) AS n, count(*) FILTER (magnitude >= 4) AS m4, count(*) FILTER (magnitude >= 6) AS m6, count(*) - count(DISTINCT event_id) AS duplicates FROM ev GROUP BY 1")
def h27(spark, d):
    return events(spark, d).groupBy(F.year("d").cast("long").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("magnitude") >= 4).alias("m4"), F.count_if(F.col("magnitude") >= 6).alias("m6"), (F.count(F.lit(1)) - F.countDistinct("event_id")).alias("duplicates"))


TERMS = ("1.0::DOUBLE", "t", "cos(2 * pi() * t)", "sin(2 * pi() * t)", "cos(4 * pi() * t)", "sin(4 * pi() * t)")
SERIES = ("east", "north", "up")


def least_squares() -> str:
    """SQL of the coefficients of ``SERIES`` on ``TERMS`` by station: the normal equations, then one elimination a term."""
    k, ys = range(len(TERMS)), range(len(SERIES))
    sums = ", ".join([f"sum(x{i} * x{j}) AS m{i}_{j}" for i in k for j in k] + [f"sum(x{i} * {SERIES[c]}) AS m{i}_y{c}" for i in k for c in ys])
    out = [f"x AS (SELECT *, {', '.join(f'{e} AS x{i}' for i, e in enumerate(TERMS))} FROM (SELECT *, (d - DATE '2000-01-01') / 365.25::DOUBLE AS t FROM stations))", f"e0 AS (SELECT station_id, {sums} FROM x GROUP BY 1 HAVING count(*) > {len(TERMS)})"]
    right = [*k, *(f"y{c}" for c in ys)]
    for p in k:
        row = lambda i, j, p=p: f"m{p}_{j} / m{p}_{p}" if i == p else f"m{i}_{j} - m{i}_{p} * m{p}_{j} / m{p}_{p}"
        out.append(f"e{p + 1} AS (SELECT station_id, {', '.join(f'{row(i, j)} AS m{i}_{j}' for i in k for j in right)} FROM e{p})")
    fit = lambda c: " + ".join(f"m{i}_y{c} * x{i}" for i in k)
    return ", ".join(out) + f", r AS (SELECT station_id, {', '.join(f'{SERIES[c]} - ({fit(c)}) AS r{c}' for c in ys)} FROM x JOIN e{len(TERMS)} USING (station_id))"


@query("h22_seasonal_residuals", ctes("stations") + f", {least_squares()} SELECT s.station_id, s.n, {', '.join(f'round(stddev_samp(r{c}), 4) AS {y}_std' for c, y in enumerate(SERIES))} FROM (SELECT station_id, count(*) AS n FROM stations GROUP BY 1) s LEFT JOIN r USING (station_id) GROUP BY 1, 2")
def h22(spark, d):
    """Station series without trend and seasons: number of days and deviation of the residuals by station."""
    from tremorlake.operators.stations import secular_seasonal_resid
    from tremorlake.plans.bindings import stations

    r = secular_seasonal_resid(stations(spark, d), "station_id", "d", ["east", "north", "up"])
    return r.groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), *(F.round(F.stddev_samp(f"{c}_resid"), 4).alias(f"{c}_std") for c in ("east", "north", "up")))


@query("h10_bin_moderation", ctes("ev", "sensor") + ", big AS (SELECT event_id, d, CAST(event_id % 4 AS INT) AS bin FROM ev WHERE magnitude >= 6.5), c AS (SELECT bin, count(*) AS n FROM big GROUP BY 1), x AS (SELECT round(sum(pow(n - e, 2) / e), 6) AS chi2 FROM c, (SELECT sum(n) / 4.0 AS e FROM c)), r AS (SELECT bin, round(avg(s.x) FILTER (s.d = big.d - 1), 4) AS before_1, round(avg(s.x) FILTER (s.d = big.d - 5), 4) AS before_5 FROM big JOIN sensor s ON s.zone = 'R' AND s.d BETWEEN big.d - 5 AND big.d - 1 GROUP BY 1) SELECT bin, n, chi2, before_1, before_5 FROM c JOIN r USING (bin), x")
def h10(spark, d):
    big = events(spark, d).filter("magnitude >= 6.5").select("event_id", "d", (F.col("event_id") % 4).cast("int").alias("bin"))
    counts = S.binned_counts(big, "bin", 4)
    sig = sensor(spark, d).filter("zone = 'R'").select("d", "x")
    at = lambda k: F.round(F.avg(F.when(F.col("rel_day") == -k, F.col("x"))), 4)
    read = epoch.epoch_join(big, sig, 5).groupBy("bin").agg(at(1).alias("before_1"), at(5).alias("before_5"))
    chi = S.chi2_uniform(counts).select(F.round("chi2", 6).alias("chi2"))
    return counts.select("bin", "n").join(read, "bin").crossJoin(F.broadcast(chi))


@query(
    "h20_isotonic",
    ctes("scored")
    + f""", tr AS (SELECT p, y, {draw("row_id")} % 3 AS k FROM scored WHERE d < DATE '1999-01-01'), f AS (SELECT CAST(unnest([0, 1, 2]) AS BIGINT) AS fold), t AS (SELECT fold, p, CAST(sum(y) AS DOUBLE) AS y, count(*) AS n FROM tr, f WHERE k <> fold GROUP BY 1, 2),
    means AS (SELECT a.fold, a.p AS lo, b.p AS hi, (SELECT sum(y) / sum(n) FROM t WHERE t.fold = a.fold AND t.p BETWEEN a.p AND b.p) AS m FROM t a JOIN t b ON a.fold = b.fold AND a.p <= b.p),
    low AS (SELECT x.fold, x.p, lo, min(m) AS m FROM t x JOIN means ON means.fold = x.fold AND lo <= x.p AND hi >= x.p GROUP BY 1, 2, 3), fit AS (SELECT fold, p, max(m) AS c FROM low GROUP BY 1, 2), calib AS (SELECT p, avg(c) AS c FROM fit GROUP BY 1)
    SELECT s.p, count(*) AS n, round(any_value(c), 4) AS calibrated FROM scored s JOIN calib USING (p) WHERE d >= DATE '1999-01-01' GROUP BY 1""",
)
def h20(spark, d):
    """Calibrated rates by score of later rows, fitted on earlier ones."""
    from tremorlake.operators.resampling import isotonic_calibrate

    s = scored(spark, d)
    c = isotonic_calibrate(s.filter("d < DATE '1999-01-01'"), s.filter("d >= DATE '1999-01-01'"), "y", "p", "row_id")
    return c.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("calibrated"), 4).alias("calibrated"))
