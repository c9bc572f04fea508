"""Superposed epochs and their permutation null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.functions.exprs import portable_draws


def epoch_join(events: DataFrame, signal: DataFrame, window: int, day: str = "d", keys: list[str] | None = None) -> DataFrame:
    """Each event with the signal of the days from ``-window`` to ``window`` around it; days without signal have no row."""
    around = events.withColumn("rel_day", F.explode(F.sequence(F.lit(-window), F.lit(window)))).withColumn("_sd", F.date_add(day, F.col("rel_day")))
    s = signal.withColumnRenamed(day, "_sd")
    return around.join(s, ["_sd", *(keys or [])]).drop("_sd")


def superposed_epoch(events: DataFrame, signal: DataFrame, metrics: list[str], window: int, by: list[str] | None = None, day: str = "d") -> DataFrame:
    """Mean and number of values by metric and day relative to the events."""
    long = epoch_join(events, signal, window, day).unpivot([*(by or []), "rel_day"], metrics, "metric", "value")
    return long.groupBy(*(by or []), "metric", "rel_day").agg(F.avg("value").alias("obs_mean"), F.count("value").alias("n_obs"))


def shifted(events: DataFrame, iters: int, seed: int, first_day, last_day, ident: str = "event_id", day: str = "d") -> DataFrame:
    """The events of each permutation: moved by 365 to 729 days either way, and put within the first or last 30
    days of the signal where they would leave it. Draws are hashes of seed, permutation and event."""
    # a short table may lie in one partition; its many copies must not
    events = events.repartition(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), ident)
    e = events.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(iters - 1))))
    u, v, w = portable_draws(3, seed, "iter", ident)
    move = (u % 365 + 365) * F.when(v % 2 == 0, 1).otherwise(-1)
    e = e.withColumn("_d", F.date_add(day, move.cast("int"))).withColumn("_r", (w % 30).cast("int"))
    a, b = F.lit(first_day).cast("date") if isinstance(first_day, str) else first_day, F.lit(last_day).cast("date") if isinstance(last_day, str) else last_day
    return e.withColumn(day, F.when(F.col("_d") < a, F.date_add(a, F.col("_r"))).when(F.col("_d") > b, F.date_sub(b, F.col("_r"))).otherwise(F.col("_d"))).drop("_d", "_r")


def permuted_sums(events: DataFrame, signal: DataFrame, metrics: list[str], window: int, iters: int, seed: int, first_day, last_day, day: str = "d", ident: str = "event_id", by: list[str] | None = None) -> DataFrame:
    """Sums and numbers of values by permutation, metric and relative day: (by, iter, rel_day, metric, s, n).

    Each day has the sums and counts of the signal on all days around it in one row, so a permuted event
    meets it once, whatever the window. All is added up by permutation where the events are: what is
    shuffled has a row a permutation and task, with a column for each metric and relative day."""
    by = by or []
    moved = shifted(events.select(ident, day, *by), iters, seed, first_day, last_day, ident, day)
    days = range(-window, window + 1)
    name = lambda kind, i, r: f"_{kind}{i}_{r + window}"
    around = signal.select(*by, day, *(F.col(m).cast("double").alias(f"_m{i}") for i, m in enumerate(metrics))).withColumn("_r", F.explode(F.sequence(F.lit(-window), F.lit(window))))
    around = around.select(*by, F.date_sub(day, F.col("_r")).alias(day), "_r", *(f"_m{i}" for i in range(len(metrics))))
    at = [(i, r, F.when(F.col("_r") == r, F.col(f"_m{i}"))) for i in range(len(metrics)) for r in days]
    wide = around.groupBy(*by, day).agg(*(F.sum(x).alias(name("s", i, r)) for i, r, x in at), *(F.count(x).alias(name("n", i, r)) for i, r, x in at))
    sums = moved.join(wide, [*by, day]).groupBy(*by, "iter").agg(*(F.sum(name(c, i, r)).alias(name(c, i, r)) for c in ("s", "n") for i, r, _ in at))
    rows = F.array(*(F.struct(F.lit(r).alias("rel_day"), F.lit(metrics[i]).alias("metric"), F.col(name("s", i, r)).alias("s"), F.col(name("n", i, r)).alias("n")) for i, r, _ in at))
    return sums.select(*by, "iter", F.explode(rows).alias("x")).filter("x.n > 0").select(*by, "iter", "x.rel_day", "x.metric", "x.s", "x.n")


def permuted_epoch(events: DataFrame, signal: DataFrame, metrics: list[str], window: int, iters: int, seed: int, first_day, last_day, day: str = "d", ident: str = "event_id", by: list[str] | None = None) -> DataFrame:
    """Means by permutation, metric and relative day, as of ``permuted_sums``."""
    sums = permuted_sums(events, signal, metrics, window, iters, seed, first_day, last_day, day, ident, by)
    return sums.select(*(by or []), "iter", "metric", "rel_day", (F.col("s") / F.col("n")).alias("perm_mean"))


def epoch_z(observed: DataFrame, null: DataFrame, keys: list[str]) -> DataFrame:
    """Observed means against their null: mean, population deviation, z (null where that is zero) and one-tailed p."""
    j = observed.join(null.filter("perm_mean IS NOT NULL"), keys).groupBy(*keys, "obs_mean", "n_obs")
    got = j.agg(F.avg("perm_mean").alias("null_mean"), F.stddev_pop("perm_mean").alias("null_std"), F.avg((F.col("perm_mean") >= F.col("obs_mean")).cast("int")).alias("p_value"), F.count(F.lit(1)).alias("iters"))
    return got.withColumn("zscore", F.when(F.col("null_std") > 0, (F.col("obs_mean") - F.col("null_mean")) / F.col("null_std")))


def window_summary(profile: DataFrame, days: list[int], value: str, keys: list[str], window: int) -> DataFrame:
    """Means of the last k days before the events, for each k, at most ``window``."""
    k = F.explode(F.array(*map(F.lit, days))).alias("k")
    p = profile.select("*", k).filter((F.col("rel_day") <= -1) & (F.col("rel_day") >= -F.least(F.col("k"), F.lit(window))))
    return p.groupBy(*keys, "k").agg(F.avg(value).alias("mean_value"))


def hazard_signal(reports: DataFrame, hazards: DataFrame, hazard: str = "hazard", day: str = "d") -> DataFrame:
    """Daily signal of each hazard from the reports of it and those of ``multiple``: (hazard, day, n, zscore), the last
    against the mean and deviation over the hazard's own days. ``hazards`` has the few hazards that there are."""
    known = hazards.select(hazard).distinct()
    own = reports.filter(F.col(hazard) != "multiple").join(known, hazard, "left_semi")
    # one row with the names of all hazards
    names = known.agg(F.collect_list(hazard).alias("_all"))
    shared = reports.filter(F.col(hazard) == "multiple").select(day).crossJoin(F.broadcast(names)).select(day, F.explode("_all").alias(hazard))
    daily = own.select(hazard, day).unionByName(shared.select(hazard, day)).groupBy(hazard, day).agg(F.count(F.lit(1)).alias("n"))
    stats = daily.groupBy(hazard).agg(F.avg("n").alias("_m"), F.stddev_samp("n").alias("_s"))
    return daily.join(stats, hazard).select(hazard, day, "n", F.try_divide(F.col("n") - F.col("_m"), F.col("_s")).alias("zscore"))


def stratified_epoch(events: DataFrame, signal: DataFrame, metrics: list[str], window: int, iters: int, seed: int, first_day, last_day, hazard: str = "hazard", min_mag: float | None = None, without_source: str | None = None, least_events: int = 50, least_days: int = 30, alpha: float = 0.05, families: int = 5, mag: str = "mag", source: str = "source", day: str = "d", ident: str = "event_id") -> DataFrame:
    """Superposed epochs of all hazards at once against their permutations: (hazard, metric, rel_day, n_events, means,
    zscore, p_value, bonferroni).

    Events count with no magnitude or at least ``min_mag``, and from sources that do not hold ``without_source``.
    Hazards of fewer than ``least_events`` events or ``least_days`` days of signal are left out.
    ``bonferroni`` tells a p value under ``alpha`` / ``families``."""
    if min_mag is not None:
        events = events.filter(F.col(mag).isNull() | (F.col(mag) >= min_mag))
    if without_source is not None:
        events = events.filter(~F.contains(F.col(source), F.lit(without_source)))
    counts = events.groupBy(hazard).agg(F.count(F.lit(1)).alias("n_events")).filter(F.col("n_events") >= least_events)
    counts = counts.join(signal.groupBy(hazard).agg(F.count(F.lit(1)).alias("_d")).filter(F.col("_d") >= least_days), hazard).select(hazard, "n_events")
    events = events.join(counts.select(hazard), hazard, "left_semi")
    seen = epoch_join(events.select(hazard, ident, day), signal.select(hazard, day, *metrics), window, day, [hazard]).unpivot([hazard, "rel_day"], metrics, "metric", "value")
    seen = seen.groupBy(hazard, "metric", "rel_day").agg(F.avg("value").alias("obs_mean"), F.count("value").alias("n_obs"))
    null = permuted_epoch(events, signal, metrics, window, iters, seed, first_day, last_day, day, ident, [hazard])
    out = epoch_z(seen, null, [hazard, "metric", "rel_day"]).withColumn("bonferroni", F.col("p_value") < alpha / families)
    return out.join(counts, hazard)


def pre_post_contrast(events: DataFrame, signal: DataFrame, feature: str, weight: str, source: str, window: int, iters: int, seed: int, first_day, last_day, day: str = "d", ident: str = "event_id") -> DataFrame:
    """Weighted mean of a feature in the days before the events less that of the days after, and the same under
    permutation: one row (observed, perm_mean, perm_sd, zscore, p_two_tailed, p_one_tailed).

    The feature is standardised within its source; sources without deviation have no say."""
    stats = signal.groupBy(source).agg(F.avg(feature).alias("_m"), F.stddev_samp(feature).alias("_s"))
    z = signal.join(stats, source).withColumn("_z", F.when(F.col("_s") > 0, (F.col(feature) - F.col("_m")) / F.col("_s"))).filter("_z IS NOT NULL")
    daily = z.groupBy(day).agg(F.sum(F.col("_z") * F.col(weight)).alias("_wz"), F.sum(weight).cast("double").alias("_w"))

    def contrast(sums: DataFrame, by: list[str]) -> DataFrame:
        part = lambda m, side: F.sum(F.when((F.col("metric") == m) & side, F.col("s")))
        before, after = F.col("rel_day") < 0, F.col("rel_day") > 0
        return sums.groupBy(*by).agg((part("_wz", before) / part("_w", before) - part("_wz", after) / part("_w", after)).alias("c"))

    seen = epoch_join(events.select(ident, day), daily, window, day).groupBy("rel_day").agg(F.sum("_wz").alias("_wz"), F.sum("_w").alias("_w")).unpivot(["rel_day"], ["_wz", "_w"], "metric", "s")
    obs = contrast(seen, []).select(F.col("c").alias("observed"))
    null = contrast(permuted_sums(events, daily, ["_wz", "_w"], window, iters, seed, first_day, last_day, day, ident), ["iter"]).filter("c IS NOT NULL")
    out = null.crossJoin(F.broadcast(obs)).groupBy("observed").agg(
        F.avg("c").alias("perm_mean"), F.stddev_pop("c").alias("perm_sd"), F.avg((F.abs("c") >= F.abs("observed")).cast("int")).alias("p_two_tailed"), F.avg((F.col("c") >= F.col("observed")).cast("int")).alias("p_one_tailed")
    )
    return out.withColumn("zscore", F.when(F.col("perm_sd") > 0, (F.col("observed") - F.col("perm_mean")) / F.col("perm_sd")))
