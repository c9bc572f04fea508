"""Upserts, rebuilds and other whole-table steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], cols: list[str], insert_missing: bool = True) -> DataFrame:
    """The target with ``cols`` of matched rows as the updates have them, nulls too, and new keys inserted if asked."""
    u = updates.select(*keys, *(F.col(c).alias(f"_u_{c}") for c in cols), F.lit(True).alias("_hit"))
    j = target.withColumn("_old", F.lit(True)).join(u, keys, "full_outer" if insert_missing else "left")
    return j.select(*(F.when(F.col("_hit"), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in target.columns))


def keep_latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key by the given descending order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("_rn = 1").drop("_rn")


def new_only(df: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    return df.join(existing.select(*key).distinct(), key, "left_anti")


def add_missing_columns(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    return df.select("*", *(F.lit(None).cast(t).alias(c) for c, t in spec.items() if c not in df.columns))


def available_features(df: DataFrame, wanted: list[str]) -> list[str]:
    return [c for c in wanted if c in df.columns]


def heartbeat_if_empty(df: DataFrame, beat: dict) -> DataFrame:
    """``df``, or one row of the given values where it has none; columns not given are null."""
    spark = df.sparkSession
    one = spark.range(1).select(*((F.lit(beat[f.name]) if f.name in beat else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema))
    some = df.limit(1).select(F.lit(1).alias("_one"))
    return df.unionByName(one.join(F.broadcast(some), how="left_anti"))


def publish_json(df: DataFrame, n: int | None = None) -> DataFrame:
    """Each row as a JSON message ``value``; at most ``n`` where a message limit is asked for."""
    out = df.select(F.to_json(F.struct("*")).alias("value"))
    return out if n is None else out.limit(n)


def high_water_mark(df: DataFrame, ts: str, ok: Column, first_day: str) -> DataFrame:
    """The latest day that succeeded, else the first day, and the day to load next."""
    last = F.coalesce(F.max(F.when(ok, F.to_date(ts))), F.to_date(F.lit(first_day)))
    return df.agg(last.alias("mark")).select("mark", F.date_add("mark", 1).alias("next_day"))


def date_window(df: DataFrame, start: str, end: str, today: str, lag: int, max_days: int) -> DataFrame:
    """A requested range cut at the last safe day and at ``max_days``."""
    safe = F.date_sub(F.col(today), lag)
    last = F.least(F.col(end), safe)
    return df.select("*", F.col(start).alias("from_day"), F.least(last, F.date_add(F.col(start), max_days - 1)).alias("to_day"))


def keyed_correction(df: DataFrame, fixes: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Columns replaced where a correction of equal keys has a value."""
    f = fixes.select(*keys, *(F.col(c).alias(f"_f_{c}") for c in cols))
    return df.join(f, keys, "left").select(*(F.coalesce(F.col(f"_f_{c}"), F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns))


def fill_labels(df: DataFrame, updates: DataFrame, key: str, label: str) -> DataFrame:
    """The label where it has one, else that of the updates."""
    u = updates.select(key, F.col(label).alias("_u"))
    return df.join(u, key, "left").select(*(F.coalesce(F.col(label), F.col("_u")).alias(label) if c == label else F.col(c) for c in df.columns))


def first_present(df: DataFrame, names: dict[str, list[Column]]) -> DataFrame:
    """Columns from the first of several sources that is not null; zero counts as a value."""
    return df.select("*", *(F.coalesce(*alts).alias(n) for n, alts in names.items()))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def write_sink(df: DataFrame, path: str, append: bool = False, kind: str = "parquet", partition_by: list[str] | None = None, rows_a_file: int = 0) -> None:
    """Loads ``df`` into a folder of Parquet, CSV (with a header) or JSON files: all anew, or after what is there; in
    files of at most ``rows_a_file`` rows where a chunk size is asked for."""
    out = df.write.mode("append" if append else "overwrite").format(kind)
    if kind == "csv":
        out = out.option("header", True)
    if rows_a_file:
        out = out.option("maxRecordsPerFile", rows_a_file)
    (out.partitionBy(*partition_by) if partition_by else out).save(path)


def run_log(status: DataFrame, path: str, at: Column, feed: str = "feed", ok: str = "ok") -> None:
    """Appends one row on a run: its time, how many feeds passed and failed, and the feeds that failed, in order."""
    failed = F.array_sort(F.collect_list(F.when(~F.col(ok), F.col(feed))))  # one name a feed
    row = status.agg(F.count_if(ok).alias("passed"), F.count_if(~F.col(ok)).alias("failed"), failed.alias("f")).select(at.alias("run_at"), "passed", "failed", F.array_join("f", ",").alias("note"))
    write_sink(row.coalesce(1), path, append=True)
