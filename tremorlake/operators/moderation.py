"""Permutation tests of bins and of nearest distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremorlake.functions.exprs import portable_draw
from tremorlake.operators.epoch import epoch_join
from tremorlake.operators.spatial import nearest_event
from tremorlake.operators.windows import sliced_rank


def moderation_test(events: DataFrame, signal: DataFrame, bin_col: str, metric: str, days: tuple[int, int], iters: int, seed: int, ident: str = "event_id", least: int = 5) -> DataFrame:
    """Whether bins of events differ in the signal of the days before: the population variance of bin means against
    that of shuffled bins. One row: observed, null_mean, null_std, p.

    Each event has one value, its mean over the days; a shuffle gives the values a portable random
    order and deals them to the bins in turn, so bins keep their sizes. Bins of fewer than ``least``
    events are left out of the observed variance. Ranks come from counts by slices of the draws, so
    no task orders a whole shuffle."""
    pre = epoch_join(events, signal, max(map(abs, days))).filter(F.col("rel_day").between(*days)).groupBy(ident, bin_col).agg(F.avg(metric).alias("_m"))
    sizes = pre.groupBy(bin_col).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(F.struct(F.sum("_n").over(W.orderBy(bin_col)).alias("to"), F.col(bin_col).alias("bin")).alias("_s")).agg(F.array_sort(F.collect_list("_s")).alias("_to"))  # one row a bin
    again = pre.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(iters - 1))))
    again = sliced_rank(again.withColumn("_d", portable_draw(seed, "iter", ident)), ["iter"], F.shiftright("_d", 22), ["_d", ident], "_r").select("iter", "_r", "_m")
    dealt = again.crossJoin(F.broadcast(sizes)).withColumn(bin_col, F.filter("_to", lambda s: s["to"] >= F.col("_r"))[0]["bin"])
    means = dealt.groupBy("iter", bin_col).agg(F.avg("_m").alias("a"))
    null = means.groupBy("iter").agg(F.var_pop("a").alias("v"))
    obs = pre.groupBy(bin_col).agg(F.avg("_m").alias("a"), F.count(F.lit(1)).alias("k")).filter(F.col("k") >= least).agg(F.var_pop("a").alias("observed"))
    both = null.crossJoin(F.broadcast(obs))
    return both.groupBy("observed").agg(F.avg("v").alias("null_mean"), F.stddev_pop("v").alias("null_std"), F.avg((F.col("v") >= F.col("observed")).cast("int")).alias("p"))


def spatial_correspondence(points: DataFrame, events: DataFrame, iters: int, seed: int, point_id: str, max_days: int, day: str = "d") -> DataFrame:
    """Whether points lie nearer to the events that follow than at shifted dates: observed mean nearest distance, its
    null by dates moved up to a year either way, z and the share of the null at or below it."""
    it = points.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(iters))))
    move = (portable_draw(seed, "iter", point_id) % 731 - 365).cast("int")
    it = it.withColumn(day, F.when(F.col("iter") == 0, F.col(day)).otherwise(F.date_add(day, move))).withColumn("_p", F.struct("iter", point_id))
    near = nearest_event(it, events, 0, max_days, [], "_p", day)
    means = near.groupBy(F.col("_p.iter").alias("iter")).agg(F.avg("km").alias("km"))
    obs = means.filter("iter = 0").select(F.col("km").alias("observed"))
    j = means.filter("iter > 0").crossJoin(F.broadcast(obs)).groupBy("observed")
    out = j.agg(F.avg("km").alias("null_mean"), F.stddev_pop("km").alias("null_std"), F.avg((F.col("km") <= F.col("observed")).cast("int")).alias("p"))
    return out.withColumn("zscore", F.when(F.col("null_std") > 0, (F.col("observed") - F.col("null_mean")) / F.col("null_std")))
