"""Event-study statistics: binned counts, resampled nulls, corrections, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremorlake.functions.exprs import portable_draw
from tremorlake.operators.checkpoints import written


def binned_counts(df: DataFrame, col: str, n: int, by: list[str] | None = None) -> DataFrame:
    """Counts of bins 0 to n-1, empty ones too, with the expected count and the ratio to it."""
    by = by or []
    counts = df.groupBy(*by, F.col(col).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    groups = counts.select(*by).distinct() if by else df.sparkSession.range(1).select()
    bins = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    out = bins.join(counts, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(W.partitionBy(*by))
    return out.withColumn("expected", total / F.lit(float(n))).withColumn("ratio", F.try_divide(F.col("n"), F.col("expected")))


def chi2_uniform(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The chi-square statistic of binned counts against equal counts, with its degrees of freedom and p value."""
    by = by or []
    e = F.col("expected")
    x = counts.groupBy(*by).agg(F.sum(F.pow(F.col("n") - e, 2) / e).alias("chi2"), (F.count(F.lit(1)) - 1).alias("df"))
    return x.withColumn("p_value", chi2_sf(F.col("chi2"), F.col("df")))


def chi2_sf(x: Column, df: Column) -> Column:
    """The chi-square distribution's upper tail by the finite sums for even and odd degrees of freedom.

    For odd degrees the normal tail comes from the error function's continued series, summed natively."""
    h = x / 2
    k = F.sequence(F.lit(0), F.greatest(F.floor(df / 2).cast("int") - 1, F.lit(0)))
    # even: exp(-h) * sum h^k / k!
    even = F.exp(-h) * F.aggregate(k, F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("t")), lambda a, i: F.struct((a["s"] + a["t"]).alias("s"), (a["t"] * h / (i + 1)).alias("t")), lambda a: a["s"])
    # odd: erfc(sqrt(h)) + exp(-h) * sum h^(k+1/2) / gamma(k+3/2)
    terms = F.sequence(F.lit(0), F.lit(400))
    erf = 2 / F.sqrt(F.lit(3.141592653589793)) * F.exp(-h) * F.aggregate(terms, F.struct(F.lit(0.0).alias("s"), F.sqrt(h).alias("t")), lambda a, i: F.struct((a["s"] + a["t"]).alias("s"), (a["t"] * 2 * h / (2 * i + 3)).alias("t")), lambda a: a["s"])
    m = F.sequence(F.lit(0), F.greatest(F.floor((df - 1) / 2).cast("int") - 1, F.lit(0)))
    tail = F.exp(-h) * F.aggregate(m, F.struct(F.lit(0.0).alias("s"), (F.sqrt(h) * 2 / F.sqrt(F.lit(3.141592653589793))).alias("t")), lambda a, i: F.struct((a["s"] + a["t"]).alias("s"), (a["t"] * 2 * h / (2 * i + 3)).alias("t")), lambda a: a["s"])
    odd = (1 - erf) + F.when(df > 1, tail).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.when(df % 2 == 0, even).otherwise(odd))


def uniform_null_p(df: DataFrame, bin_col: str, bins: int, iters: int, seed: int, ident: str, by: list[str]) -> DataFrame:
    """Chi-square of binned counts against equal counts and its share among draws of as many equal chances: (by, n, chi2,
    null_mean, p). Each row draws its bin anew in each of ``iters`` permutations, which are counted at once."""
    e = F.col("n") / F.lit(float(bins))

    def chi2(c: DataFrame, keys: list[str]) -> DataFrame:
        # empty bins add e each: (0 - e)^2 / e
        t = c.withColumn("n", F.sum("k").over(W.partitionBy(*keys)))
        return t.groupBy(*keys, "n").agg((F.sum(F.pow(F.col("k") - e, 2) / e) + (bins - F.count(F.lit(1))) * e).alias("chi2"))

    count = F.count(F.lit(1)).alias("k")
    obs = chi2(df.groupBy(*by, bin_col).agg(count), by)
    drawn = df.select(*by, ident).withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(iters - 1))))
    null = chi2(drawn.groupBy(*by, "iter", (portable_draw(seed, "iter", ident) % bins).alias("_b")).agg(count), [*by, "iter"])
    j = null.select(*by, F.col("chi2").alias("_c")).join(obs, by)
    # equal counts may differ in the last place of their sums
    return j.groupBy(*by, "n", "chi2").agg(F.avg("_c").alias("null_mean"), F.avg((F.col("_c") >= F.col("chi2") - 1e-9).cast("int")).alias("p"))


def ranked(df: DataFrame, *order: str, by: list[str] | None = None) -> DataFrame:
    """Adds ``rank``, from 1, in the order of the columns ``order`` within groups ``by``.

    A sort of all rows by sampled ranges puts each run of ranks in a part; a row's rank is its place in the part and what the parts before
    hold of its group. So neither a large group nor a value that many rows share meets in one task, unless whole rows are equal."""
    by = by or []
    key = [*by, *order]
    x = written(df.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_at", F.monotonically_increasing_id()))
    x = x.withColumn("_part", F.shiftright("_at", 33))  # the upper bits are the part's number
    parts = x.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_c"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_c").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*(F.col(c).alias(f"_k_{c}") for c in [*by, "_part"]), "_first", before.alias("_before"))
    out = x.join(parts, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*by, "_part"]])
    return out.select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("rank"))


def bh_fdr(df: DataFrame, p: str, alpha: float = 0.05, step_up: bool = False, by: list[str] | None = None) -> DataFrame:
    """Adds ``rank``, ``critical`` = rank * alpha / n and ``rejected``: each p by its own critical value, or all up to
    the largest rank that passes if ``step_up``. Ties take the order of their columns; a null p has neither rank nor verdict."""
    by = by or []
    same = lambda t: [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by]  # noqa: E731, ARG005
    n = df.filter(F.col(p).isNotNull()).groupBy(*(F.col(c).alias(f"_g_{c}") for c in by)).agg(F.count(F.lit(1)).alias("_n"))
    with_one = lambda x, t: x.join(t, same(t), "left") if by else x.crossJoin(F.broadcast(t))  # noqa: E731  one row without groups
    out = with_one(ranked(df.filter(F.col(p).isNotNull()), p, *(c for c in df.columns if c != p and c not in by), by=by), n)
    out = out.withColumn("critical", F.col("rank") * alpha / F.col("_n")).drop("_n", *(f"_g_{c}" for c in by))
    if step_up:
        last = out.filter(F.col(p) <= F.col("critical")).groupBy(*(F.col(c).alias(f"_g_{c}") for c in by)).agg(F.max(p).alias("_cut"))
        out = with_one(out, last).withColumn("rejected", F.coalesce(F.col(p) <= F.col("_cut"), F.lit(False))).drop("_cut", *(f"_g_{c}" for c in by))
    else:
        out = out.withColumn("rejected", F.col(p) <= F.col("critical"))
    return out.unionByName(df.filter(F.col(p).isNull()), allowMissingColumns=True)


def score_table(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    """Counts by distinct score: all later metrics come from it, so ties cost nothing and no single window sees all rows."""
    return df.groupBy(*by, F.col(p).alias("score")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"), F.sum(F.pow(F.col(p) - F.col(y), 2)).alias("sq"))


def edges_of(df: DataFrame, col: str, bits: int = 10) -> DataFrame:
    """One row with the 2^bits - 1 edges of slices of about equally many rows. They come from a mergeable quantile sketch over
    all rows, so a far value does not push the others into one slice."""
    n = 1 << bits
    return df.agg(F.percentile_approx(col, F.array(*(F.lit(k / n) for k in range(1, n))), 40 * n).alias("_edges"))


def with_slice(df: DataFrame, col: str, edges: DataFrame, bits: int = 10) -> DataFrame:
    """``df`` with ``_slice``, from 0 to 2^bits - 1, in the order of ``col``: the number of edges below it, by binary search."""
    halves = F.array(*(F.lit(1 << k) for k in reversed(range(bits))))
    found = F.aggregate(halves, F.lit(0), lambda at, step: F.when(F.get("_edges", at + step - 1) < F.col(col), at + step).otherwise(at))
    return df.crossJoin(F.broadcast(edges)).withColumn("_slice", F.coalesce(found, F.lit(0))).drop("_edges")  # one row


def running_counts(t: DataFrame, by: list[str]) -> DataFrame:
    """Adds to a score table the positives and rows of lower scores (``pos_below``, ``n_below``) and of all (``pos_all``,
    ``n_all``). A slice of scores starts at the sums of those before it and is ordered by itself, so that no task orders all scores."""
    t = with_slice(t, "score", edges_of(t, "score"))
    sums = t.groupBy(*by, "_slice").agg(F.sum("pos").alias("_p"), F.sum("n").alias("_n"))
    whole, before = W.partitionBy(*by), W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*(F.col(c).alias(f"_k_{c}") for c in [*by, "_slice"]), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("_p", "_n")), F.sum("_p").over(whole).alias("pos_all"), F.sum("_n").over(whole).alias("n_all"))
    inside = W.partitionBy(*by, "_slice").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    t = t.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{c}_in") for c in ("pos", "n"))).join(sums, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*by, "_slice"]])
    t = t.drop(*(f"_k_{c}" for c in [*by, "_slice"]))
    return t.withColumns({"pos_below": F.col("_p0") + F.col("pos_in"), "n_below": F.col("_n0") + F.col("n_in")}).drop("_slice", "_p0", "_n0", "pos_in", "n_in")


def binary_metrics(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """AUROC with tied scores averaged, Brier score, average precision, base rate and Brier skill against it; AUROC and
    average precision are null where only one class is there."""
    by = by or []
    t = running_counts(score_table(df, y, p, by), by)
    t = t.withColumns({"neg_below": F.col("n_below") - F.col("pos_below"), "tp": F.col("pos_all") - F.col("pos_below"), "seen": F.col("n_all") - F.col("n_below")})
    a = t.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum("pos").alias("positives"),
        F.sum(F.col("pos") * (F.col("neg_below") + (F.col("n") - F.col("pos")) / 2)).alias("_u"),
        F.sum(F.col("pos") * F.col("tp") / F.col("seen")).alias("_ap"),
        F.sum("sq").alias("_sq"),
    )
    n, k = F.col("n"), F.col("positives")
    rate = k / n
    return a.select(
        *by,
        "n",
        "positives",
        rate.alias("base_rate"),
        F.when((k > 0) & (k < n), F.col("_u") / (k * (n - k))).alias("auroc"),
        F.when(k > 0, F.col("_ap") / k).alias("avg_precision"),
        (F.col("_sq") / n).alias("brier"),
        F.when((k > 0) & (k < n), 1 - (F.col("_sq") / n) / (rate * (1 - rate))).alias("brier_skill"),
    )


def set_deltas(scores: DataFrame, y: str, p: str, model: str, base: str) -> DataFrame:
    """Metrics of each model's scores, with ``delta``: its AUROC less that of the model named ``base``."""
    m = binary_metrics(scores, y, p, [model])
    return m.crossJoin(F.broadcast(m.filter(F.col(model) == base).select(F.col("auroc").alias("_base")))).withColumn("delta", F.col("auroc") - F.col("_base")).drop("_base")  # one row


def verdict(df: DataFrame, positives: str, auroc: str, fold_std: str, threshold: float = 0.55, least: int = 5, unstable: float = 0.15, base_auroc: str | None = None, delta: float = 0.03) -> DataFrame:
    """Adds ``verdict``: too few positives or no score, no skill, skill, or skill that differs much between folds. With
    ``base_auroc``, skill is also ``delta`` more than that of the base model."""
    skill = F.col(auroc) >= threshold
    unknown = (F.col(positives) < least) | F.col(auroc).isNull()
    if base_auroc:
        skill, unknown = skill & (F.col(auroc) - F.col(base_auroc) >= delta), unknown | F.col(base_auroc).isNull()
    v = F.when(unknown, "INSUFFICIENT_DATA").when(~skill, "NULL").when(F.coalesce(F.col(fold_std), F.lit(0.0)) > unstable, "CONFIRMED_UNSTABLE").otherwise("CONFIRMED")
    return df.withColumn("verdict", v)


def verdict_of_systems(df: DataFrame, least: int, verdict_col: str = "verdict") -> DataFrame:
    """The verdict over systems: confirmed where at least ``least`` of them are, stably or not. One row."""
    n = F.count_if(F.startswith(F.col(verdict_col), F.lit("CONFIRMED")))
    return df.agg(n.alias("confirmed"), F.count_if(F.col(verdict_col) == "INSUFFICIENT_DATA").alias("insufficient"), F.count(F.lit(1)).alias("systems")).withColumn("verdict", F.when(F.col("confirmed") >= least, "CONFIRMED").otherwise("NULL"))


def majority_of_folds(df: DataFrame, auroc: str, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Whether more than half of the folds with a score pass: (by, passed, folds, majority)."""
    out = df.groupBy(*by).agg(F.count_if(F.col(auroc) > threshold).alias("passed"), F.count(auroc).alias("folds"))
    return out.withColumn("majority", 2 * F.col("passed") > F.col("folds"))


def fold_spread(df: DataFrame, auroc: str, by: list[str]) -> DataFrame:
    """Mean and population deviation of the folds' scores."""
    return df.groupBy(*by).agg(F.avg(auroc).alias("fold_mean"), F.stddev_pop(auroc).alias("fold_std"))


def baselines(train: DataFrame, test: DataFrame, label: str, zone: str, recent: str, ident: str, seed: int) -> DataFrame:
    """``test`` with the chances of four baselines: the zone's rate in training (all zones' where it has none), the recent
    count over the greatest one in training, all zones' rate, and a portable uniform draw."""
    rates = train.groupBy(zone).agg(F.avg(label).alias("climatology"))
    whole = train.agg(F.avg(label).alias("global_mean"), F.greatest(F.max(recent), F.lit(1)).alias("_most"))
    out = test.join(rates, zone, "left").crossJoin(F.broadcast(whole)).withColumn("climatology", F.coalesce("climatology", "global_mean"))
    clipped = F.least(F.greatest(F.col(recent) / F.col("_most"), F.lit(0.0)), F.lit(1.0))
    return out.withColumn("persistence", clipped).withColumn("uniform", portable_draw(seed, ident) / F.lit(4294967296.0)).drop("_most")


def centroid(profile: DataFrame, z: str, by: list[str], iters: int = 0, seed: int = 42, days: tuple[int, int] = (-7, -1)) -> DataFrame:
    """The centroid of the days with positive z, its class, and with ``iters`` the 2.5 and 97.5 percentiles of resampled days.

    A replicate draws as many days as there are, with replacement and portable draws; a profile has a few days, so one
    row holds them."""
    pos = profile.filter((F.col(z) > 0) & F.col("rel_day").between(*days)).groupBy(*by)
    pos = pos.agg((F.sum(F.col(z) * F.col("rel_day")) / F.sum(z)).alias("centroid"), F.array_sort(F.collect_list(F.struct(F.col("rel_day").alias("d"), F.col(z).alias("z")))).alias("_days"))
    out = pos.withColumn("window_class", window_class(F.col("centroid")))
    if not iters:
        return out.drop("_days")
    one = pos.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(iters - 1)))).withColumn("slot", F.explode(F.sequence(F.lit(0), F.size("_days") - 1)))
    one = one.withColumn("_x", F.get("_days", (portable_draw(seed, *by, "iter", "slot") % F.size("_days")).cast("int")))
    means = one.groupBy(*by, "iter").agg((F.sum(F.col("_x.z") * F.col("_x.d")) / F.sum("_x.z")).alias("c"))
    bounds = means.groupBy(*by).agg(F.percentile("c", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select(*by, F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))
    return out.drop("_days").join(bounds, by)


def window_class(c: Column) -> Column:
    return F.when((c >= -3) & (c <= -1), "IONOSPHERIC").when((c >= -5) & (c < -3), "ATMOSPHERIC").when((c >= -14) & (c < -5), "THERMAL").otherwise("outside")


def day_label(day: Column) -> Column:
    """The window that a single day before the event counts to; day -5 goes to the later one."""
    return F.when(day.between(-5, -1), "IONOSPHERIC").when(day.between(-10, -6), "ATMOSPHERIC").otherwise("")


def intensification(profile: DataFrame, z: str, primary: list[str], late: int = -1, early: int = -5) -> DataFrame:
    """Whether z of the late day is above that of the early day, by metric, and whether it is for all ``primary`` metrics:
    (metric, z_late, z_early, rises, all_primary). A day without a value leaves ``rises`` null and the verdict false."""
    at = lambda k: F.avg(F.when(F.col("rel_day") == k, F.col(z)))
    t = profile.groupBy("metric").agg(at(late).alias("z_late"), at(early).alias("z_early")).withColumn("rises", F.col("z_late") > F.col("z_early"))
    whole = t.agg((F.count_if(F.col("metric").isin(*primary) & F.col("rises")) == len(primary)).alias("all_primary"))
    return t.crossJoin(F.broadcast(whole))
