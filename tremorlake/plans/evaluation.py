"""Queries of verdicts, nulls, declustering and evaluation, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremorlake.operators import epoch, panel, spatial
from tremorlake.operators import statistics as S
from tremorlake.operators.checkpoints import checkpointed
from tremorlake.operators.resampling import bootstrap_auroc, mixed_sql
from tremorlake.plans.bindings import EV, boxes, ctes, env, events, reports, scored, sensor, stations
from tremorlake.plans.joins import KM
from tremorlake.plans.panels import seismic_panel
from tremorlake.plans.registry import ORACLES, query
from tremorlake.plans.statistics import EPOCH, OBS, SEED, _parts, draw
from tremorlake.sources.tables import table

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
HAZARD = "CASE submission_id % 6 " + " ".join(f"WHEN {i} THEN '{z}'" for i, z in enumerate(PRIORITIES)) + " ELSE 'multiple' END"


def shifts(first: str, last: str, iters: int, source: str = "big", keep: str = "") -> str:
    """SQL of the permuted events of ``source`` (event_id, d and what ``keep`` names) as ``moved``."""
    return f"""it AS (SELECT CAST(unnest(generate_series(0, {iters - 1})) AS INT) AS iter), raw AS (SELECT iter, event_id, {keep} CAST(d + CAST((365 + {draw("iter", "event_id")} % 365) * CASE WHEN {draw("iter", "event_id", part=1)} % 2 = 0 THEN 1 ELSE -1 END AS INT) AS DATE) AS d2, CAST({draw("iter", "event_id", part=2)} % 30 AS INT) AS r FROM {source}, it),
    moved AS (SELECT iter, event_id, {keep} CASE WHEN d2 < DATE '{first}' THEN CAST(DATE '{first}' + r AS DATE) WHEN d2 > DATE '{last}' THEN CAST(DATE '{last}' - r AS DATE) ELSE d2 END AS d FROM raw)"""


@query(
    "h05_stratified_epoch",
    ctes("ev", "reports")
    + f""", rep AS (SELECT {HAZARD} AS hz, experience_date AS d FROM reports), hz AS (SELECT DISTINCT zone AS hazard FROM ev),
    daily AS (SELECT hazard, d, count(*) AS n FROM rep JOIN hz ON hz = hazard OR hz = 'multiple' GROUP BY 1, 2), st AS (SELECT hazard, avg(n) AS m, stddev_samp(n) AS s, count(*) AS days FROM daily GROUP BY 1),
    sig AS (SELECT hazard, d, n, CASE WHEN s > 0 THEN (n - m) / s END AS zscore FROM daily JOIN st USING (hazard)),
    cand AS (SELECT zone AS hazard, event_id, d FROM (SELECT *, CASE WHEN event_id % 11 = 0 THEN NULL ELSE magnitude END AS mag, 'feed' || CAST(event_id % 7 AS VARCHAR) AS src FROM ev) WHERE (mag IS NULL OR mag >= 6) AND NOT contains(src, 'feed3')),
    okay AS (SELECT hazard, count(*) AS n_events FROM cand GROUP BY 1 HAVING count(*) >= 50), big AS (SELECT c.* FROM cand c JOIN okay USING (hazard) JOIN st USING (hazard) WHERE days >= 30),
    k AS (SELECT CAST(unnest(generate_series(-7, 7)) AS INT) AS rel_day),
    obs AS (SELECT b.hazard, rel_day, avg(n) AS n, avg(zscore) AS zscore FROM big b, k JOIN sig ON sig.hazard = b.hazard AND sig.d = b.d + rel_day GROUP BY 1, 2),
    {shifts("1995-01-01", "2001-08-01", 20, keep="hazard,")},
    nul AS (SELECT iter, m.hazard, rel_day, avg(n) AS n, avg(zscore) AS zscore FROM moved m, k JOIN sig ON sig.hazard = m.hazard AND sig.d = m.d + rel_day GROUP BY 1, 2, 3),
    both_ AS (SELECT hazard, 'n' AS metric, rel_day, o.n AS o, nul.n AS v FROM obs o JOIN nul USING (hazard, rel_day) UNION ALL SELECT hazard, 'zscore', rel_day, o.zscore, nul.zscore FROM obs o JOIN nul USING (hazard, rel_day))
    SELECT hazard, metric, rel_day, any_value(n_events) AS n_events, round(any_value(o), 4) AS obs_mean, round(avg(v), 4) AS null_mean, round(avg(CAST(v >= o - 1e-9 AS INT)), 6) AS p_value, avg(CAST(v >= o - 1e-9 AS INT)) < 0.01 AS bonferroni FROM both_ JOIN okay USING (hazard) WHERE v IS NOT NULL GROUP BY 1, 2, 3""",
)
def h05(spark, d):
    e = events(spark, d)
    rep = reports(spark, d).select(F.expr(HAZARD).alias("hazard"), F.col("experience_date").alias("d"))
    sig = epoch.hazard_signal(rep, e.select(F.col("zone").alias("hazard")))
    e = e.select(F.col("zone").alias("hazard"), "event_id", "d", F.when(F.col("event_id") % 11 != 0, F.col("magnitude")).alias("mag"), F.concat(F.lit("feed"), (F.col("event_id") % 7).cast("string")).alias("source"))
    got = epoch.stratified_epoch(e, sig, ["n", "zscore"], 7, 20, SEED, "1995-01-01", "2001-08-01", min_mag=6, without_source="feed3")
    return got.select("hazard", "metric", "rel_day", "n_events", F.round("obs_mean", 4).alias("obs_mean"), F.round("null_mean", 4).alias("null_mean"), F.round("p_value", 6).alias("p_value"), "bonferroni")


@query(
    "h08_uniform_null",
    ctes("ev")
    + f""", big AS (SELECT zone, event_id, CAST((event_id * 7 % 360) // 45 AS INT) AS bin FROM ev WHERE magnitude >= 6), it AS (SELECT CAST(unnest(generate_series(0, 49)) AS INT) AS iter),
    t AS (SELECT zone, count(*) AS n FROM big GROUP BY 1), o AS (SELECT zone, bin, count(*) AS k FROM big GROUP BY 1, 2), c AS (SELECT zone, iter, {draw("iter", "event_id")} % 8 AS bin, count(*) AS k FROM big, it GROUP BY 1, 2, 3),
    obs AS (SELECT zone, sum(pow(k - n / 8.0, 2) / (n / 8.0)) + (8 - count(*)) * any_value(n / 8.0) AS chi2 FROM o JOIN t USING (zone) GROUP BY 1), nul AS (SELECT zone, iter, sum(pow(k - n / 8.0, 2) / (n / 8.0)) + (8 - count(*)) * any_value(n / 8.0) AS v FROM c JOIN t USING (zone) GROUP BY 1, 2)
    SELECT zone, any_value(n) AS n, round(any_value(chi2), 6) AS chi2, round(avg(v), 6) AS null_mean, round(avg(CAST(v >= chi2 - 1e-9 AS INT)), 6) AS p FROM nul JOIN obs USING (zone) JOIN t USING (zone) GROUP BY 1""",
)
def h08(spark, d):
    e = events(spark, d).filter("magnitude >= 6").select("zone", "event_id", F.floor((F.col("event_id") * 7 % 360) / 45).cast("int").alias("bin"))
    got = S.uniform_null_p(e, "bin", 8, 50, SEED, "event_id", ["zone"])
    return got.select("zone", "n", *(F.round(c, 6).alias(c) for c in ("chi2", "null_mean", "p")))


PROFILE = "pr AS (SELECT metric, rel_day, (v - avg(v) OVER (PARTITION BY metric)) / stddev_samp(v) OVER (PARTITION BY metric) AS z FROM (SELECT 'x' AS metric, rel_day, x AS v FROM obs UNION ALL SELECT 'w', rel_day, w FROM obs))"


def profile(spark, d):
    """Observed means of two metrics around the strong events, standardised by metric."""
    big, sig = _parts(spark, d)
    o = epoch.superposed_epoch(big, sig, ["x", "w"], 7)
    s = o.groupBy("metric").agg(F.avg("obs_mean").alias("m"), F.stddev_samp("obs_mean").alias("sd"))
    return o.join(F.broadcast(s), "metric").select("metric", "rel_day", ((F.col("obs_mean") - F.col("m")) / F.col("sd")).alias("z"))


@query(
    "h11_centroid",
    ctes("ev", "sensor")
    + f""", {EPOCH}, {OBS}, {PROFILE}, pos AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY rel_day) - 1 AS i, count(*) OVER (PARTITION BY metric) AS n FROM pr WHERE z > 0 AND rel_day BETWEEN -7 AND -1),
    c AS (SELECT metric, sum(z * rel_day) / sum(z) AS c FROM pos GROUP BY 1), slots AS (SELECT metric, iter, i AS slot, n FROM pos, (SELECT CAST(unnest(generate_series(0, 199)) AS INT) AS iter)),
    picked AS (SELECT s.metric, iter, p.z, p.rel_day FROM slots s JOIN pos p ON p.metric = s.metric AND p.i = {draw("s.metric", "iter", "slot")} % s.n), means AS (SELECT metric, iter, sum(z * rel_day) / sum(z) AS m FROM picked GROUP BY 1, 2),
    ci AS (SELECT metric, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM means GROUP BY 1)
    SELECT metric, round(c, 6) AS centroid, round(low, 6) AS ci_low, round(high, 6) AS ci_high, CASE WHEN c BETWEEN -3 AND -1 THEN 'IONOSPHERIC' WHEN c >= -5 AND c < -3 THEN 'ATMOSPHERIC' WHEN c >= -14 AND c < -5 THEN 'THERMAL' ELSE 'outside' END AS window_class FROM c JOIN ci USING (metric)""",
)
def h11(spark, d):
    got = S.centroid(profile(spark, d), "z", ["metric"], 200, SEED)
    return got.select("metric", *(F.round(c, 6).alias(c) for c in ("centroid", "ci_low", "ci_high")), "window_class")


@query(
    "h12_intensification",
    ctes("ev", "sensor")
    + f""", {EPOCH}, {OBS}, {PROFILE}, t AS (SELECT metric, avg(z) FILTER (rel_day = -1) AS z_late, avg(z) FILTER (rel_day = -5) AS z_early FROM pr GROUP BY 1)
    SELECT metric, rel_day, round(z, 4) AS z, CASE WHEN rel_day BETWEEN -5 AND -1 THEN 'IONOSPHERIC' WHEN rel_day BETWEEN -10 AND -6 THEN 'ATMOSPHERIC' ELSE '' END AS label, z_late > z_early AS rises, (SELECT count(*) = 2 FROM t WHERE z_late > z_early) AS all_primary FROM pr JOIN t USING (metric) WHERE rel_day < 0""",
)
def h12(spark, d):
    pr = profile(spark, d)
    t = S.intensification(pr, "z", ["x", "w"]).select("metric", "rises", "all_primary")
    return pr.filter("rel_day < 0").join(F.broadcast(t), "metric").select("metric", "rel_day", F.round("z", 4).alias("z"), S.day_label(F.col("rel_day")).alias("label"), "rises", "all_primary")


WINDOWS = "e AS (SELECT *, pow(10.0, 0.1238 * magnitude + 0.983) AS km_max, CASE WHEN magnitude >= 6.5 THEN pow(10.0, 0.032 * magnitude + 2.7389) ELSE pow(10.0, 0.5409 * magnitude - 0.547) END AS days_max FROM ev WHERE magnitude >= 5)"
#: Walking in time with the list of main events so far: an event is one if no main event before it has it in its window.
WALK = f"""{WINDOWS}, n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY d, event_id) AS i FROM e),
    pre AS MATERIALIZED (SELECT b.i, list(a.event_id) AS by_ FROM n a JOIN n b ON b.i > a.i AND b.d - a.d <= a.days_max AND {KM.format(a='a.', b='b.')} <= a.km_max GROUP BY 1),
    steps AS MATERIALIZED (SELECT n.i, n.event_id, coalesce(by_, []) AS by_ FROM n LEFT JOIN pre USING (i)),
    walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS main UNION ALL SELECT s.i, CASE WHEN list_has_any(w.main, s.by_) THEN w.main ELSE list_append(w.main, s.event_id) END FROM walk w JOIN steps s ON s.i = w.i + 1),
    final AS (SELECT unnest(main) AS event_id FROM walk WHERE i = (SELECT max(i) FROM walk))"""


@query("h13_decluster", ctes("ev").replace("WITH", "WITH RECURSIVE", 1) + f", {WALK} SELECT e.event_id, magnitude, f.event_id IS NOT NULL AS is_mainshock FROM e LEFT JOIN final f USING (event_id)")
def h13(spark, d):
    return spatial.decluster(events(spark, d).filter("magnitude >= 5"), checkpoint=checkpointed).select("event_id", "magnitude", "is_mainshock")


@query(
    "d23_sequence_survivors",
    ctes("ev", "boxes").replace("WITH", "WITH RECURSIVE", 1)
    + f", {WALK}, held AS (SELECT fault_id, e.event_id, magnitude FROM e JOIN boxes ON lat BETWEEN lat_min AND lat_max AND lon BETWEEN lon_min AND lon_max WHERE d BETWEEN DATE '1997-01-01' AND DATE '1999-12-31') SELECT fault_id, count(*) AS was, count(f.event_id) AS remaining, count(f.event_id) FILTER (magnitude >= 6) AS strong FROM held LEFT JOIN final f USING (event_id) GROUP BY 1",
)
def d23(spark, d):
    """Events of a box and period before declustering and after it."""
    e = spatial.decluster(events(spark, d).filter("magnitude >= 5"), checkpoint=checkpointed)
    held = spatial.bbox_join(e.filter("d BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'"), boxes(spark, d))
    return held.groupBy("fault_id").agg(F.count(F.lit(1)).alias("was"), F.count_if("is_mainshock").alias("remaining"), F.count_if(F.col("is_mainshock") & (F.col("magnitude") >= 6)).alias("strong"))


def _counts(k: str, side: int) -> str:
    """SQL of the replicates' Poisson counts of mean ``k``: (iter, n_below, c), by inverting the distribution's running sums."""
    key = mixed_sql(f"(n_below * 2 + {side})::UHUGEINT + ({SEED}::UHUGEINT << 40)")
    u = f"(({mixed_sql('(z::UHUGEINT + iter::UHUGEINT) % 18446744073709551616::UHUGEINT')} >> 11)::DOUBLE + 0.5) / 9007199254740992"
    return f"""d{side} AS (SELECT n_below, {k} AS k, {key} AS z FROM t WHERE {k} > 0), u{side} AS (SELECT n_below, k, iter, {u} AS u FROM d{side}, it),
    ks{side} AS (SELECT DISTINCT k, greatest(0, floor(k - 12 * sqrt(k) - 24))::BIGINT AS lo, ceil(k + 12 * sqrt(k) + 24)::BIGINT AS hi FROM d{side}),
    pj{side} AS (SELECT k, j, exp(-k + j * ln(k) - lgamma(j + 1)) AS p FROM (SELECT k, unnest(generate_series(lo, hi)) AS j FROM ks{side})), cj{side} AS MATERIALIZED (SELECT k, j, sum(p) OVER (PARTITION BY k ORDER BY j) AS cdf FROM pj{side}),
    c{side} AS (SELECT n_below, iter, j::DOUBLE AS c FROM u{side} ASOF JOIN cj{side} ON u{side}.k = cj{side}.k AND u{side}.u <= cj{side}.cdf)"""


@query(
    "h17_bootstrap_auroc",
    ctes("scored")
    + f""", g AS (SELECT p, CAST(sum(y) AS BIGINT) AS pos, CAST(count(*) - sum(y) AS BIGINT) AS neg FROM scored GROUP BY 1), t AS MATERIALIZED (SELECT pos, neg, CAST(coalesce(sum(pos + neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_below FROM g),
    it AS (SELECT CAST(unnest(generate_series(0, 999)) AS BIGINT) AS iter), {_counts("pos", 0)}, {_counts("neg", 1)},
    w AS (SELECT iter, n_below, coalesce(c0.c, 0) AS pos, coalesce(c1.c, 0) AS neg FROM (SELECT n_below, iter FROM t, it) LEFT JOIN c0 USING (n_below, iter) LEFT JOIN c1 USING (n_below, iter)),
    c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY iter ORDER BY n_below ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM w),
    a AS (SELECT iter, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auroc FROM c GROUP BY 1 HAVING sum(pos) > 0 AND sum(neg) > 0)
    SELECT round(quantile_cont(auroc, 0.025), 6) AS ci_low, round(quantile_cont(auroc, 0.975), 6) AS ci_high, count(*) AS replicates FROM a""",
)
def h17(spark, d):
    got = bootstrap_auroc(scored(spark, d), "y", "p", 1000, SEED)
    return got.select(F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"), "replicates")


def _auroc(score: str, keys: str, name: str) -> str:
    """SQL of the AUROC of a score by keys, as a table (keys, positives, name)."""
    return f"""{name}_t AS (SELECT {keys}, {score} AS s, CAST(sum(y) AS DOUBLE) AS pos, count(*) AS n FROM two GROUP BY ALL), {name}_c AS (SELECT *, coalesce(sum(n - pos) OVER (PARTITION BY {keys} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {name}_t),
    {name} AS (SELECT {keys}, CAST(sum(pos) AS BIGINT) AS positives, CASE WHEN sum(pos) > 0 AND sum(pos) < sum(n) THEN sum(pos * (below + (n - pos) / 2.0)) / (sum(pos) * sum(n - pos)) END AS auroc FROM {name}_c GROUP BY ALL)"""


VERDICTS = f"""WITH two AS (SELECT 's' || CAST(l_partkey % 6 AS VARCHAR) AS system, CAST(year(CAST(l_shipdate AS DATE)) AS BIGINT) AS fold, CAST(l_returnflag = 'R' AS INT) AS y, l_discount + l_quantity / 1000 AS p, l_tax AS base FROM lineitem WHERE CAST(l_shipdate AS DATE) < DATE '2001-01-01'),
    {_auroc("p", "system", "pooled")}, {_auroc("base", "system", "plain")}, {_auroc("p", "system, fold", "folds")},
    spread AS (SELECT system, stddev_pop(auroc) AS fold_std, count(*) FILTER (auroc > 0.5) AS passed, count(auroc) AS folds FROM folds GROUP BY 1),
    v AS (SELECT system, pooled.positives, pooled.auroc, plain.auroc AS base_auroc, fold_std, 2 * passed > folds AS majority, CASE WHEN pooled.positives < 5 OR pooled.auroc IS NULL OR plain.auroc IS NULL THEN 'INSUFFICIENT_DATA' WHEN pooled.auroc < 0.5 OR pooled.auroc - plain.auroc < 0.001 THEN 'NULL' WHEN fold_std > 0.012 THEN 'CONFIRMED_UNSTABLE' ELSE 'CONFIRMED' END AS verdict FROM pooled JOIN plain USING (system) JOIN spread USING (system))"""


def _verdicts(spark, d):
    day = F.to_date("l_shipdate")
    li = table(spark, d, "lineitem").filter(day < F.lit("2001-01-01").cast("date")).select(F.concat(F.lit("s"), (F.col("l_partkey") % 6).cast("string")).alias("system"), F.year(day).cast("long").alias("fold"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") + F.col("l_quantity") / 1000).alias("p"), F.col("l_tax").alias("base"))
    pooled = S.binary_metrics(li, "y", "p", ["system"]).select("system", "positives", "auroc")
    plain = S.binary_metrics(li, "y", "base", ["system"]).select("system", F.col("auroc").alias("base_auroc"))
    folds = S.binary_metrics(li, "y", "p", ["system", "fold"])
    all_ = pooled.join(plain, "system").join(S.fold_spread(folds, "auroc", ["system"]), "system").join(S.majority_of_folds(folds, "auroc", ["system"]), "system")
    return S.verdict(all_, "positives", "auroc", "fold_std", threshold=0.5, unstable=0.012, base_auroc="base_auroc", delta=0.001)


@query("h18_verdict", VERDICTS + " SELECT system, positives, round(auroc, 6) AS auroc, round(base_auroc, 6) AS base_auroc, round(fold_std, 6) AS fold_std, majority, verdict FROM v")
def h18(spark, d):
    """Verdicts of systems from pooled scores, a base model and the spread of yearly folds."""
    return _verdicts(spark, d).select("system", "positives", *(F.round(c, 6).alias(c) for c in ("auroc", "base_auroc", "fold_std")), "majority", "verdict")


@query("h18_systems", VERDICTS + " SELECT count(*) FILTER (verdict LIKE 'CONFIRMED%') AS confirmed, count(*) FILTER (verdict = 'INSUFFICIENT_DATA') AS insufficient, count(*) AS systems, CASE WHEN count(*) FILTER (verdict LIKE 'CONFIRMED%') >= 3 THEN 'CONFIRMED' ELSE 'NULL' END AS verdict FROM v")
def h18_systems(spark, d):
    """The verdict over systems: three or more of them confirmed."""
    return S.verdict_of_systems(_verdicts(spark, d), 3)


@query(
    "h19_baselines",
    ctes("ev")
    + f""", day AS (SELECT zone, d, count(*) FILTER (magnitude >= 6) AS n, CAST(count(*) FILTER (magnitude >= 6) > 0 AS INT) AS y FROM ev GROUP BY 1, 2), c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY zone ORDER BY d RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS recent FROM day),
    tr AS (SELECT * FROM c WHERE d < DATE '1998-01-01' AND zone <> '5-LOW'), rate AS (SELECT zone, avg(y) AS rate FROM tr GROUP BY 1), g AS (SELECT avg(y) AS rate, greatest(max(recent), 1) AS most FROM tr),
    te AS (SELECT zone, y, coalesce(rate.rate, g.rate) AS climatology, least(recent / most, 1.0) AS persistence, g.rate AS global_mean, ({draw("zone || '|' || CAST(d AS VARCHAR)")}) / 4294967296.0 AS uniform FROM c LEFT JOIN rate USING (zone), g WHERE d >= DATE '1998-01-01')
    SELECT zone, count(*) AS n, {", ".join(f"round(avg(pow({c} - y, 2)), 6) AS {c}_brier" for c in ("climatology", "persistence", "global_mean", "uniform"))} FROM te GROUP BY 1""",
)
def h19(spark, d):
    """Brier scores of the four baselines by zone."""
    from tremorlake.operators.windows import days_over

    strong = F.count_if(F.col("magnitude") >= 6)
    day = events(spark, d).groupBy("zone", "d").agg(strong.alias("n"), (strong > 0).cast("int").alias("y"))
    day = day.withColumn("recent", F.coalesce(F.sum("n").over(days_over("zone", "d", -30, -1)), F.lit(0))).withColumn("row_id", F.concat_ws("|", "zone", F.col("d").cast("string")))
    train = day.filter("d < DATE '1998-01-01' AND zone <> '5-LOW'")
    got = S.baselines(train, day.filter("d >= DATE '1998-01-01'"), "y", "zone", "recent", "row_id", SEED)
    return got.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(F.pow(F.col(c) - F.col("y"), 2)), 6).alias(f"{c}_brier") for c in ("climatology", "persistence", "global_mean", "uniform")))


@query(
    "h26_pre_post_contrast",
    ctes("ev", "reports")
    + f""", rep AS (SELECT source, experience_date AS d, CAST(water_imagery AS INT) + submission_id % 5 AS v, CASE WHEN urgency_level IN ('high', 'medium') THEN 1.0 ELSE 0.5 END AS w FROM reports), st AS (SELECT source, avg(v) AS m, stddev_samp(v) AS s FROM rep GROUP BY 1),
    sig AS (SELECT d, sum((v - m) / s * w) AS wz, CAST(sum(w) AS DOUBLE) AS w FROM rep JOIN st USING (source) WHERE s > 0 GROUP BY 1), big AS (SELECT event_id, d FROM ev WHERE magnitude >= 6), k AS (SELECT CAST(unnest(generate_series(-7, 7)) AS INT) AS rel_day),
    obs AS (SELECT sum(wz) FILTER (rel_day < 0) / sum(w) FILTER (rel_day < 0) - sum(wz) FILTER (rel_day > 0) / sum(w) FILTER (rel_day > 0) AS c FROM big, k JOIN sig ON sig.d = big.d + rel_day),
    {shifts("1995-01-01", "2001-08-01", 30)},
    nul AS (SELECT iter, sum(wz) FILTER (rel_day < 0) / sum(w) FILTER (rel_day < 0) - sum(wz) FILTER (rel_day > 0) / sum(w) FILTER (rel_day > 0) AS c FROM moved m, k JOIN sig ON sig.d = m.d + rel_day GROUP BY 1)
    SELECT round(any_value(obs.c), 6) AS observed, round(avg(nul.c), 6) AS perm_mean, round(stddev_pop(nul.c), 6) AS perm_sd, round((any_value(obs.c) - avg(nul.c)) / stddev_pop(nul.c), 4) AS zscore, round(avg(CAST(abs(nul.c) >= abs(obs.c) AS INT)), 6) AS p_two_tailed, round(avg(CAST(nul.c >= obs.c AS INT)), 6) AS p_one_tailed FROM nul, obs""",
)
def h26(spark, d):
    rep = reports(spark, d).select("source", F.col("experience_date").alias("d"), (F.col("water_imagery").cast("int") + F.col("submission_id") % 5).alias("v"), F.when(F.col("urgency_level").isin("high", "medium"), 1.0).otherwise(0.5).alias("w"))
    got = epoch.pre_post_contrast(events(spark, d).filter("magnitude >= 6"), rep, "v", "w", "source", 7, 30, SEED, "1995-01-01", "2001-08-01")
    return got.select(*(F.round(c, 6).alias(c) for c in ("observed", "perm_mean", "perm_sd", "p_two_tailed", "p_one_tailed")), F.round("zscore", 4).alias("zscore"))


FEATURES = ["n", "n5", "n_7d", "n_30d", "max_30d", "mean_90d", "std_30d"]
CUTS = ["1995-12-31", *(f"{1996 + k // 2}-{'06-30' if k % 2 == 0 else '12-31'}" for k in range(11))]
FOLDS = list(zip(CUTS[1:], CUTS[2:], strict=False))[:10]


#: Strongest events of a zone that count; so the labels are as frequent in tables of any size.
STRONGEST = 200


def _labelled_panel(spark, d):
    """The daily panel, with ``y``: whether one of the zone's strongest events comes within seven days."""
    top = W.partitionBy("zone").orderBy(F.desc("magnitude"), "event_id")
    strong = events(spark, d).withColumn("r", F.row_number().over(top)).filter(F.col("r") <= STRONGEST)
    p = panel.forward_label(seismic_panel(spark, d).select("zone", "d", "split", *FEATURES), strong, 1, 7, "y", where=F.lit(True))
    # as the seven days after the last ones are not known
    return p.filter("d < DATE '2001-07-25'").withColumnRenamed("label_y", "y").withColumn("row_id", F.concat_ws("|", "zone", F.col("d").cast("string")))


def _walk_forward(spark, d):
    from tremorlake.operators.models import walk_forward

    return walk_forward(_labelled_panel(spark, d), ["zone"], FEATURES, "y", "d", "row_id", FOLDS)


FOLD_SQL = "folds(fold, cut, until) AS (VALUES " + ", ".join(f"({k}, DATE '{a}', DATE '{b}')" for k, (a, b) in enumerate(FOLDS, 1)) + ")"


@query(
    "h14_fold_table",
    f"""WITH panel AS (SELECT zone, d FROM ({ORACLES['seismic_panel']})), {FOLD_SQL}, strong AS (SELECT zone, d FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY magnitude DESC, event_id) AS r FROM ({EV})) WHERE r <= {STRONGEST}), y AS (SELECT zone, d, CAST(EXISTS (SELECT 1 FROM strong s WHERE s.zone = panel.zone AND s.d BETWEEN panel.d + 1 AND panel.d + 7) AS INT) AS y FROM panel),
    t AS (SELECT zone, fold, count(*) FILTER (d <= cut) AS n_train, count(*) FILTER (d > cut) AS n_test, CAST(coalesce(sum(y) FILTER (d <= cut), 0) AS BIGINT) AS pos_train, CAST(coalesce(sum(y) FILTER (d > cut), 0) AS BIGINT) AS pos_test FROM y JOIN folds ON d <= until WHERE d < DATE '2001-07-25' GROUP BY 1, 2) SELECT *, CASE WHEN pos_train < 3 THEN 'SKIP_INSUFFICIENT_TRAIN' WHEN pos_test = 0 OR pos_test = n_test THEN 'SKIP_NO_TEST_POSITIVES' ELSE 'OK' END AS status FROM t""",
)
def h14_folds(spark, d):
    """Rows, positives and status of the ten folds by zone."""
    from tremorlake.operators.models import fold_rows, fold_table

    return fold_table(fold_rows(_labelled_panel(spark, d), "y", "d", FOLDS), "y", ["zone"])


@query("h14_walk_forward")
def h14(spark, d):
    """Ten expanding half-year folds by zone, 200 trees each, and their exact metrics; fold 0 has all folds of a zone together."""
    scores, _ = _walk_forward(spark, d)
    both = scores.withColumn("fold", F.explode(F.array(F.col("fold"), F.lit(0))))
    return S.binary_metrics(both, "y", "p", ["zone", "fold"]).select("zone", "fold", "n", "positives", *(F.round(c, 4).alias(c) for c in ("auroc", "avg_precision", "brier")))


@query("h15_fit_boosted")
def h15(spark, d):
    """One boosted model a zone on the training years: each feature's share of the gains."""
    from tremorlake.operators import boosting

    models = boosting.fit_boosted(_labelled_panel(spark, d).filter("split = 'train'"), ["zone"], FEATURES, "y", "row_id")
    return boosting.importances(models, ["zone"]).select("zone", "feature", F.round("share", 6).alias("share"))


#: The first split of the first tree, by the definition: quantile classes, drawn rows, whole-number gradients, gains of all cuts.
STUMP = f"""WITH panel AS ({ORACLES["seismic_panel"]}), strong AS (SELECT zone, d FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY magnitude DESC, event_id) AS r FROM ({EV})) WHERE r <= {STRONGEST}),
    tr AS (SELECT *, zone || '|' || CAST(d AS VARCHAR) AS row_id, CAST(EXISTS (SELECT 1 FROM strong s WHERE s.zone = panel.zone AND s.d BETWEEN panel.d + 1 AND panel.d + 7) AS INT) AS y FROM panel WHERE split = 'train'),
    wt AS (SELECT zone, (count(*) - sum(y))::DOUBLE / sum(y) AS w FROM tr GROUP BY 1),
    gh AS (SELECT zone, row_id, floor(ww * (0.5::DOUBLE - y) * 1048576 + 0.5::DOUBLE) AS g, floor(ww * 0.25::DOUBLE * 1048576 + 0.5::DOUBLE) AS h FROM (SELECT tr.zone, row_id, y, CASE WHEN y = 1 THEN w ELSE 1.0::DOUBLE END * CASE WHEN ({draw("row_id")} % 2147483647 * 48271 % 2147483647) / 2147483647::DOUBLE < 0.8::DOUBLE THEN 1 ELSE 0 END AS ww FROM tr JOIN wt USING (zone))),
    long AS ({" UNION ALL ".join(f"SELECT zone, row_id, {i} AS f, '{c}' AS feature, coalesce({c}, 0)::DOUBLE AS x FROM tr" for i, c in enumerate(FEATURES))}),
    edge AS (SELECT zone, f, quantile_disc(x, {[k / 32 for k in range(1, 32)]}) AS e FROM long GROUP BY 1, 2), cls AS (SELECT long.*, len(list_filter(e, lambda q: q < x)) AS c FROM long JOIN edge USING (zone, f)),
    hist AS (SELECT zone, f, feature, c, sum(g) AS g, sum(h) AS h FROM cls JOIN gh USING (zone, row_id) GROUP BY ALL), cum AS (SELECT *, sum(g) OVER o / 1048576 AS gl, sum(h) OVER o / 1048576 AS hl, sum(g) OVER a / 1048576 AS ga, sum(h) OVER a / 1048576 AS ha FROM hist WINDOW o AS (PARTITION BY zone, f ORDER BY c), a AS (PARTITION BY zone, f)),
    gains AS (SELECT *, gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1) AS gain FROM cum WHERE c < 31 AND hl >= 5 AND ha - hl >= 5),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY gain DESC, f, c) AS r FROM gains) WHERE r = 1 AND gain > 0)
    SELECT b.zone, b.feature, round(b.gain, 6) AS gain, round(1 / (1 + exp(CASE WHEN k.c <= b.c THEN gl / (hl + 1) ELSE (ga - gl) / (ha - hl + 1) END * 0.05::DOUBLE)), 9) AS p, count(*) AS n FROM best b JOIN cls k ON k.zone = b.zone AND k.f = b.f GROUP BY ALL"""


@query("h15_first_split", STUMP)
def h15_split(spark, d):
    """One tree of one split for each zone: its feature and gain, and the chances of the rows on its two sides."""
    from tremorlake.operators import boosting

    train = _labelled_panel(spark, d).filter("split = 'train'")
    models = boosting.fit_boosted(train, ["zone"], FEATURES, "y", "row_id", boosting.Boosting(rounds=1, depth=1, colsample=1.0))
    sides = boosting.score(train, models, ["zone"], FEATURES, ["row_id"]).groupBy("zone", F.round("p", 9).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    split = boosting.importances(models, ["zone"]).filter("gain > 0").select("zone", "feature", F.round("gain", 6).alias("gain"))
    return split.join(sides, "zone")


ENV_FEATURES, TEC_FEATURES = ["kp_max", "sw_speed", "dst_min"], ["x", "x_30d"]
SETS = {"env": ENV_FEATURES, "tec": TEC_FEATURES, "seismic": FEATURES, "env+tec": ENV_FEATURES + TEC_FEATURES, "combined": ENV_FEATURES + TEC_FEATURES + FEATURES}


def _streams(spark, d):
    """The labelled panel with the daily environment and field streams beside it."""
    from tremorlake.operators.windows import rolling

    field = rolling(sensor(spark, d).filter("zone = 'R'").select("zone", "d", "x"), "zone", "d", {"x_30d": ("x", "avg", 30)}).drop("zone")
    e = env(spark, d).select("d", *ENV_FEATURES)
    return _labelled_panel(spark, d).join(e, "d", "left").join(field, "d", "left")


def _ablation(spark, d):
    from tremorlake.operators.models import ablation

    p = _streams(spark, d)
    scores, models = ablation(p.filter("split = 'train'"), p.filter("split = 'validate'"), SETS, "y", "row_id")
    return p, scores, models


@query("h21_ablation")
def h21(spark, d):
    """AUROC of environment, field, seismic and combined features, and what each set gains over the seismic one."""
    return S.set_deltas(_ablation(spark, d)[1], "y", "p", "set", "seismic").select("set", "n", "positives", *(F.round(c, 4).alias(c) for c in ("auroc", "delta", "brier")))


@query(
    "h21_deltas",
    f"""WITH two AS (SELECT 'env' AS set_, CAST(l_returnflag = 'R' AS INT) AS y, l_tax AS p FROM lineitem UNION ALL SELECT 'tec', CAST(l_returnflag = 'R' AS INT), l_discount FROM lineitem UNION ALL SELECT 'seismic', CAST(l_returnflag = 'R' AS INT), l_quantity FROM lineitem UNION ALL SELECT 'combined', CAST(l_returnflag = 'R' AS INT), l_quantity + 10 * l_discount FROM lineitem),
    {_auroc("p", "set_", "a")} SELECT set_ AS set, positives, round(auroc, 6) AS auroc, round(auroc - (SELECT auroc FROM a WHERE set_ = 'seismic'), 6) AS delta FROM a""",
)
def h21_deltas(spark, d):
    """What feature sets gain over one of them, for scores that are columns of a table."""
    li, y = table(spark, d, "lineitem"), (F.col("l_returnflag") == "R").cast("int").alias("y")
    each = F.array(*(F.struct(F.lit(s).alias("set"), x.alias("p")) for s, x in (("env", F.col("l_tax")), ("tec", F.col("l_discount")), ("seismic", F.col("l_quantity").cast("double")), ("combined", F.col("l_quantity") + 10 * F.col("l_discount")))))
    scores = li.select(y, F.explode(each).alias("x")).select("y", "x.set", "x.p")
    return S.set_deltas(scores, "y", "p", "set", "seismic").select("set", "positives", F.round("auroc", 6).alias("auroc"), F.round("delta", 6).alias("delta"))


@query("h21_importances")
def h21_importances(spark, d):
    """Features of each set: their share of the trees' gains, and the loss of AUROC when their values are dealt anew."""
    from tremorlake.operators import boosting
    from tremorlake.operators.models import permutation_importance

    p, _, models = _ablation(spark, d)
    drops = permutation_importance(p.filter("split = 'validate'"), models, ["set"], SETS["combined"], "y", "row_id")
    got = boosting.importances(models, ["set"]).join(drops, ["set", "feature"])
    own = F.concat_ws(",", *(F.when(F.col("set") == s, F.lit("," + ",".join(c) + ",")) for s, c in SETS.items()))
    return got.filter(F.contains(own, F.concat(F.lit(","), "feature", F.lit(",")))).select("set", "feature", F.round("share", 6).alias("share"), F.round("drop", 6).alias("drop"))


def _network(spark, d):
    """Suppliers as stations: each 200 in a row are a zone of two degrees, at places of their own and no regular ones."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("station_id"), F.floor(k / 200).cast("string").alias("zone"), (35 + (k * k * 37 + k % 7) % 9973 / 5000.0).cast("double").alias("lat"), (139 + (k * k * k % 9967 + k % 11) / 5000.0).cast("double").alias("lon"))


#: Triangles whose circle through the corners holds no other station, the definition of the triangulation.
TRIANGLES = """net AS (SELECT s_suppkey AS id, CAST(s_suppkey // 200 AS VARCHAR) AS zone, 35 + ((s_suppkey * s_suppkey * 37 + s_suppkey % 7) % 9973) / 5000.0::DOUBLE AS lat, 139 + (s_suppkey * s_suppkey * s_suppkey % 9967 + s_suppkey % 11) / 5000.0::DOUBLE AS lon FROM supplier),
    mid AS (SELECT zone, avg(lat) AS la, avg(lon) AS lo FROM net GROUP BY 1), xy AS (SELECT id, zone, radians(lon - lo) * 6371 * cos(radians(la)) AS x, radians(lat - la) * 6371 AS y FROM net JOIN mid USING (zone)),
    c3 AS (SELECT a.zone, a.id AS a, b.id AS b, c.id AS c, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, c.x AS cx, c.y AS cy, (b.x - a.x) * (c.y - a.y) - (c.x - a.x) * (b.y - a.y) AS turn FROM xy a JOIN xy b ON a.zone = b.zone AND a.id < b.id JOIN xy c ON b.zone = c.zone AND b.id < c.id),
    c4 AS (SELECT *, ((ax - cx) * (ax - cx) + (ay - cy) * (ay - cy)) AS la2, ((bx - cx) * (bx - cx) + (by_ - cy) * (by_ - cy)) AS lb2 FROM c3 WHERE turn <> 0),
    c5 AS (SELECT *, cx + ((by_ - cy) * la2 - (ay - cy) * lb2) / (2 * turn) AS ox, cy + ((ax - cx) * lb2 - (bx - cx) * la2) / (2 * turn) AS oy FROM c4),
    c6 AS (SELECT *, (ax - ox) * (ax - ox) + (ay - oy) * (ay - oy) AS r2 FROM c5),
    tri AS (SELECT *, abs(turn) / 2 AS area FROM c6 WHERE NOT EXISTS (SELECT 1 FROM xy WHERE xy.zone = c6.zone AND xy.id NOT IN (a, b, c) AND (xy.x - ox) * (xy.x - ox) + (xy.y - oy) * (xy.y - oy) < r2)
      AND abs(turn) / 2 >= 1 AND greatest(hypot_(ax - bx, ay - by_), hypot_(bx - cx, by_ - cy), hypot_(cx - ax, cy - ay)) <= 300)"""
for _args in ("ax - bx, ay - by_", "bx - cx, by_ - cy", "cx - ax, cy - ay"):
    _p, _q = _args.split(", ")
    TRIANGLES = TRIANGLES.replace(f"hypot_({_args})", f"sqrt(({_p}) * ({_p}) + ({_q}) * ({_q}))")


@query("h23_triangulate", f"WITH {TRIANGLES} SELECT zone, count(*) AS n, round(sum(area), 2) AS area FROM tri GROUP BY 1")
def h23(spark, d):
    """Triangles of the stations by zone: their number and area."""
    from tremorlake.operators.triangles import triangulate

    return triangulate(_network(spark, d), "zone").groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("area"), 2).alias("area"))


@query(
    "h24_strain",
    ctes("stations")
    + f""", {TRIANGLES}, m AS (SELECT zone, s.d, area, turn, ((vb - va) * (cx - ax) - (vc - va) * (bx - ax)) / -turn AS eyy, ((ub - ua) * (cy - ay) - (uc - ua) * (by_ - ay)) / turn AS exx, ((uc - ua) * (bx - ax) - (ub - ua) * (cx - ax)) / turn AS uy, ((vb - va) * (cy - ay) - (vc - va) * (by_ - ay)) / turn AS vx
    FROM (SELECT tri.*, p.d, p.east AS ua, p.north AS va, q.east AS ub, q.north AS vb, r.east AS uc, r.north AS vc FROM tri JOIN stations p ON p.station_id = a JOIN stations q ON q.station_id = b AND q.d = p.d JOIN stations r ON r.station_id = c AND r.d = p.d) s)
    SELECT zone, d, round(sum((exx + eyy) * area) / sum(area), 4) AS dilatation, round(max(sqrt(pow((exx - eyy) / 2, 2) + pow((uy + vx) / 2, 2))), 4) AS max_shear, count(*) AS n_triangles FROM m GROUP BY 1, 2 HAVING count(*) >= 3""",
)
def h24(spark, d):
    """Daily strain of the zones' triangles."""
    from tremorlake.operators.stations import strain
    from tremorlake.operators.triangles import triangulate

    s = strain(triangulate(_network(spark, d), "zone"), stations(spark, d), "station_id")
    return s.select("zone", "d", F.round("dilatation", 4).alias("dilatation"), F.round("max_shear", 4).alias("max_shear"), "n_triangles")
