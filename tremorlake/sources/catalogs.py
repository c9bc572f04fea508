"""Historical hazard catalogues in one schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.operators.tables import union_all

COLUMNS = ("event_id", "hazard", "start_ts", "end_ts", "mag", "lat", "lon", "region", "source", "notes")


def unify(df: DataFrame, hazard: str, source: str, names: dict[str, str]) -> DataFrame:
    """One catalogue with text columns named by ``names`` (id, year, month, day, hour, minute, mag, lat, lon, region,
    notes): missing months and days are 1, a bad time of day falls back to the day, bad days to no start."""
    col = lambda k: F.nullif(F.trim(F.col(names[k]).cast("string")), F.lit("")) if k in names else F.lit(None).cast("string")
    num = lambda k, kind="double": col(k).try_cast(kind)
    day = [num("year", "int"), F.coalesce(num("month", "int"), F.lit(1)), F.coalesce(num("day", "int"), F.lit(1))]
    zero = F.lit(0)
    at = F.coalesce(F.try_make_timestamp(*day, F.coalesce(num("hour", "int"), zero), F.coalesce(num("minute", "int"), zero), zero), F.try_make_timestamp(*day, zero, zero, zero))
    return df.select(
        F.concat(F.lit(f"{hazard}-"), col("id")).alias("event_id"),
        F.lit(hazard).alias("hazard"),
        at.alias("start_ts"),
        F.lit(None).cast("timestamp").alias("end_ts"),
        num("mag").alias("mag"),
        num("lat").alias("lat"),
        num("lon").alias("lon"),
        col("region").alias("region"),
        F.lit(source).alias("source"),
        col("notes").alias("notes"),
    )


def unify_hazards(*frames: DataFrame) -> DataFrame:
    return union_all([f.select(*COLUMNS) for f in frames])
