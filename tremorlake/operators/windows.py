"""Rolling features: frames of one key and order are chosen in one select and share one sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FUNCTIONS = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min, "std": F.stddev_samp, "std_pop": F.stddev_pop, "count": F.count}


def over(keys: list[str] | str, order: str, first: int, last: int = 0):
    return W.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(order).rowsBetween(first, last)


def days_over(keys: list[str] | str, day: str, first: int, last: int = 0):
    """A frame of calendar days, whatever rows there are."""
    return W.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(F.datediff(F.col(day), F.lit("1970-01-01"))).rangeBetween(first, last)


def rolling(df: DataFrame, keys, order: str, spec: dict[str, tuple[str | Column, str, int]], prior: bool = False, min_periods: int = 1) -> DataFrame:
    """Adds for each name (column, function, n) the function over the last n rows, the current one included, or the n
    before it if ``prior``; null with fewer than ``min_periods`` values."""
    cols = []
    for name, (col, fn, n) in spec.items():
        c = F.col(col) if isinstance(col, str) else col
        w = over(keys, order, -n, -1) if prior else over(keys, order, -(n - 1))
        value = FUNCTIONS[fn](c).over(w)
        cols.append((F.when(F.count(c).over(w) >= min_periods, value) if min_periods > 1 else value).alias(name))
    return df.select("*", *cols)


def lags(df: DataFrame, keys, order: str, col: str, steps: list[int]) -> DataFrame:
    w = W.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(order)
    return df.select("*", *(F.lag(col, n).over(w).alias(f"{col}_lag{n}") for n in steps))


def deltas(df: DataFrame, keys, order: str, col: str, steps: list[int]) -> DataFrame:
    w = W.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(order)
    return df.select("*", *((F.col(col) - F.lag(col, n).over(w)).alias(f"{col}_delta{n}") for n in steps))


def median_anomaly(df: DataFrame, keys, order: str, col: str, window: int = 27, least: int = 14) -> DataFrame:
    """Adds ``anomaly``: distance from the median of the prior rows in their sample deviations, to four places; 0 where
    that is under 0.01, null with fewer than ``least`` prior values or for a null."""
    w = over(keys, order, -window, -1)
    std = F.stddev_samp(col).over(w)
    got = F.when(std < 0.01, 0.0).otherwise(F.round((F.col(col) - F.percentile(col, 0.5).over(w)) / std, 4))
    return df.select("*", F.when(F.col(col).isNotNull() & (F.count(col).over(w) >= least), got).alias("anomaly"))


def iqr_anomaly(df: DataFrame, keys, day: str, col: str, clean: Column, days: int = 27, fence: float = 1.5) -> DataFrame:
    """Adds quartiles of the clean values of the prior ``days`` calendar days, ``iqr_z`` = (x - median) / IQR, and
    ``outlier`` by the fences, on clean days."""
    q = F.percentile(F.when(clean, F.col(col)), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(days_over(keys, day, -days, -1))
    out = df.withColumn("_q", q).select("*", F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p50"), F.col("_q")[2].alias("p75")).drop("_q")
    iqr = F.col("p75") - F.col("p25")
    out = out.withColumn("iqr_z", F.when(iqr > 0, (F.col(col) - F.col("p50")) / iqr))
    beyond = (F.col(col) < F.col("p25") - fence * iqr) | (F.col(col) > F.col("p75") + fence * iqr)
    return out.withColumn("outlier", F.when(clean & F.coalesce(beyond, F.lit(False)), 1).otherwise(0))


def qcut(df: DataFrame, col: str, parts: int, out: str = "part") -> DataFrame:
    """Adds the quantile class from 0 by interpolated cut points, closed on the right; equal cut points make one class."""
    cuts = F.array_distinct(F.percentile(col, F.array(*(F.lit(i / parts) for i in range(1, parts)))))
    cut = df.agg(cuts.alias("_cuts"))
    return df.crossJoin(F.broadcast(cut)).withColumn(out, F.when(F.col(col).isNotNull(), F.size(F.filter("_cuts", lambda c: F.col(col) > c)))).drop("_cuts")


def interpolate(df: DataFrame, keys, order: str, col: str, limit: int = 3) -> DataFrame:
    """Adds ``filled``: nulls on the line between their neighbours by row, the first ``limit`` of a gap; behind the last
    value that value is repeated."""
    part = [keys] if isinstance(keys, str) else keys
    row = F.row_number().over(W.partitionBy(*part).orderBy(order))
    x = df.withColumn("_n", row)
    back, ahead = over(part, order, W.unboundedPreceding), over(part, order, 0, W.unboundedFollowing)
    at = F.when(F.col(col).isNotNull(), F.col("_n"))
    x = x.select("*", F.last(col, True).over(back).alias("_a"), F.last(at, True).over(back).alias("_na"), F.first(col, True).over(ahead).alias("_b"), F.first(at, True).over(ahead).alias("_nb"))
    step = F.col("_n") - F.col("_na")
    line = F.when(F.col("_b").isNull(), F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * step / (F.col("_nb") - F.col("_na")))
    return x.withColumn("filled", F.coalesce(F.col(col), F.when(step <= limit, line))).drop("_n", "_a", "_na", "_b", "_nb")


def sliced_rank(df: DataFrame, keys: list[str], part: Column, order: list[str], rank: str) -> DataFrame:
    """Adds ``rank`` (from 1, by ``order`` within ``keys``) where ``part`` rises with the order: a slice starts at the
    count of those before it and is ordered by itself, so no task orders all rows of a key."""
    t = df.withColumn("_part", part)
    counts = t.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*order))
    return t.withColumn("_own", own).join(counts, [*keys, "_part"]).withColumn(rank, F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")
