"""JSON feeds: each function takes rows of a whole payload in ``value`` and gives typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUAKE_FEED = "features array<struct<id:string,properties:struct<mag:double,magType:string,place:string,time:bigint,updated:bigint,status:string,tsunami:bigint,sig:bigint,net:string,code:string,url:string>,geometry:struct<type:string,coordinates:array<double>>>>"
ALERT_FEED = "features array<struct<id:string,properties:struct<id:string,event:string,headline:string,description:string,severity:string,urgency:string,certainty:string,sent:string,effective:string,onset:string,expires:string,areaDesc:string>,geometry:string>>"
SERIES_FEED = "value struct<timeSeries:array<struct<sourceInfo:struct<siteName:string,siteCode:array<struct<value:string>>>,variable:struct<variableCode:array<struct<value:string>>>,values:array<struct<value:array<struct<value:string,dateTime:string>>>>>>>"


def payloads(spark, path: str) -> DataFrame:
    """Landed files, one row each."""
    return spark.read.text(path, wholetext=True)


def _ts(x: Column) -> Column:
    return F.try_to_timestamp(x)


def quake_features(df: DataFrame) -> DataFrame:
    """One row a feature with an id, else a code, else a time to name it by; short coordinate lists leave depth null."""
    f = df.select(F.explode(F.from_json("value", QUAKE_FEED)["features"]).alias("f"))
    p, xyz = "f.properties.", F.col("f.geometry.coordinates")
    at = lambda k: F.get(xyz, F.lit(k))
    out = f.select(
        F.coalesce("f.id", p + "code", F.col(p + "time").cast("string")).alias("event_id"),
        F.timestamp_millis(p + "time").alias("time"),
        at(1).alias("latitude"),
        at(0).alias("longitude"),
        at(2).alias("depth_km"),
        F.col(p + "mag").alias("magnitude"),
        F.col(p + "magType").alias("magnitude_type"),
        *(F.col(p + c).alias(c) for c in ("place", "status", "tsunami", "sig", "net")),
        F.timestamp_millis(p + "updated").alias("updated"),
        F.col(p + "url").alias("url"),
    )
    return out.filter("event_id IS NOT NULL")


def cap_geojson_alerts(df: DataFrame) -> DataFrame:
    """Alert features as flat rows, with the point of point geometries and an id made up where it is missing."""
    f = df.select(F.explode(F.from_json("value", ALERT_FEED)["features"]).alias("f"))
    p = "f.properties."
    xy = F.when(F.get_json_object("f.geometry", "$.type") == "Point", F.from_json(F.get_json_object("f.geometry", "$.coordinates"), "array<double>"))
    return f.select(
        F.coalesce("f.id", p + "id", F.concat_ws("-", p + "event", p + "sent")).alias("id"),
        *(F.col(p + c).alias(c) for c in ("event", "headline", "description", "severity", "urgency", "certainty")),
        *(_ts(F.col(p + c)).alias(c) for c in ("sent", "effective", "onset", "expires")),
        F.col(p + "areaDesc").alias("area_desc"),
        F.get(xy, F.lit(1)).alias("lat"),
        F.get(xy, F.lit(0)).alias("lon"),
        F.col("f.geometry").alias("geometry"),
        F.to_json("f.properties").alias("raw_json"),
    )


def severe_only(df: DataFrame, n: int | None = 100) -> DataFrame:
    """Alerts that are extreme or severe; at most ``n`` a batch where a limit is asked for."""
    out = df.filter(F.col("severity").isin("Extreme", "Severe"))
    return out if n is None else out.limit(n)


def header_row_json(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows of ``[[h1, h2], [v1, v2], ...]`` by the names in the first; short rows leave the rest null."""
    t = df.select(F.from_json("value", "array<array<string>>").alias("t"))
    r = t.select(F.get("t", F.lit(0)).alias("h"), F.explode(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0)))).alias("r"))
    return r.select(*(F.when(F.array_contains("h", c), F.get("r", (F.array_position("h", c) - 1).cast("int"))).alias(c) for c in cols))


def index_json(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """An array of objects with several names for the same value; the first that is there counts, zero too."""
    m = df.select(F.explode(F.from_json("value", "array<map<string,string>>")).alias("m"))
    return m.select(*(F.coalesce(*(F.col("m")[k] for k in alts)).alias(n) for n, alts in names.items()))


def nested_series(df: DataFrame) -> DataFrame:
    """Sites, their variables and values, two levels down; bad times and values are null."""
    s = df.select(F.explode(F.from_json("value", SERIES_FEED)["value"]["timeSeries"]).alias("s"))
    v = s.select(F.get("s.sourceInfo.siteCode", F.lit(0))["value"].alias("site"), F.col("s.sourceInfo.siteName").alias("name"), F.get("s.variable.variableCode", F.lit(0))["value"].alias("variable"), F.explode(F.get("s.values", F.lit(0))["value"]).alias("v"))
    return v.select("site", "name", "variable", _ts(F.col("v.dateTime")).alias("ts"), F.col("v.value").try_cast("double").alias("value"))


def gauge_status(df: DataFrame, flooding: tuple[str, ...] = ("action", "minor", "moderate", "major"), heartbeat: int = 25) -> DataFrame:
    """Gauges in a flood category; if there are none, the first ``heartbeat`` by name. -999 is null."""
    g = df.withColumn("stage", F.nullif("stage", F.lit(-999.0)))
    wet = g.filter(F.lower("category").isin(*flooding))
    beat = g.orderBy("gauge").limit(heartbeat)
    return wet.unionByName(beat.join(F.broadcast(wet.limit(1).select(F.lit(1).alias("_wet"))), how="left_anti"))


def last_observation(df: DataFrame, key: list[str], ts: str) -> DataFrame:
    """The newest row of each key."""
    cols = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*cols), ts).alias("_r")).select(*key, "_r.*")
