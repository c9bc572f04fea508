"""Date spines, forward labels, calendar lags and the convergence of streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def date_zone_spine(zones: DataFrame, start, end, zone: str = "fault_id", day: str = "date_val") -> DataFrame:
    """Every zone on every day from ``start`` to ``end``, both included."""
    days = F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr("INTERVAL 1 DAY")))
    return zones.select(zone).distinct().withColumn(day, days)


def spine_of(df: DataFrame, zone: str, day: str) -> DataFrame:
    """The dense spine over the zones and the range of days that ``df`` has."""
    span = df.agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    zones = df.select(zone).distinct().crossJoin(F.broadcast(span))  # the span is one row
    return zones.select(zone, F.explode(F.sequence("_a", "_b", F.expr("INTERVAL 1 DAY"))).alias(day))


def forward_label(spine: DataFrame, events: DataFrame, lo: int, hi: int, name: str, zone: str = "zone", day: str = "d", mag: str = "magnitude", where: Column | None = None) -> DataFrame:
    """Adds to the spine whether, how often and how strongly events follow within days ``lo`` to ``hi``:
    ``label_name`` 0/1, ``count_name`` and ``max_name`` (null without an event).

    Each event goes to the days that it labels, so the join is on equal keys and grows with the events."""
    if where is not None:
        events = events.filter(where)
    hits = events.select(zone, F.explode(F.sequence(F.date_sub(day, hi), F.date_sub(day, lo), F.expr("INTERVAL 1 DAY"))).alias(day), F.col(mag).alias("_m"))
    hits = hits.groupBy(zone, day).agg(F.count(F.lit(1)).alias(f"count_{name}"), F.max("_m").alias(f"max_{name}"))
    out = spine.join(hits, [zone, day], "left").withColumn(f"count_{name}", F.coalesce(f"count_{name}", F.lit(0)))
    return out.withColumn(f"label_{name}", (F.col(f"count_{name}") > 0).cast("int"))


def calendar_lag(df: DataFrame, cols: list[str], n: int, zone: str = "zone", day: str = "d") -> DataFrame:
    """Values of exactly ``n`` days earlier, null where that day is missing."""
    past = df.select(zone, F.date_add(day, n).alias(day), *(F.col(c).alias(f"{c}_lag{n}") for c in cols))
    return df.join(past, [zone, day], "left")


def converge(base: DataFrame, streams: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Left joins of all streams on the keys, with a ``has_`` flag for each; columns of a stream bear its name."""
    for name, s in streams.items():
        cols = [c for c in s.columns if c not in keys]
        s = s.select(*keys, *(F.col(c).alias(f"{name}_{c}") for c in cols), F.lit(1).alias(f"_has_{name}"))
        base = base.join(s, keys, "left").withColumn(f"has_{name}", F.coalesce(f"_has_{name}", F.lit(0))).drop(f"_has_{name}")
    return base


def outer_by_day(series: dict[str, DataFrame], day: str = "d") -> DataFrame:
    """Full outer join of series by day; a day of any series is kept."""
    out = None
    for s in series.values():
        out = s if out is None else out.join(s, day, "full_outer")
    return out
