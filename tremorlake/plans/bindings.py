"""Logical inputs over the landed tables, as DataFrames and as the same SQL.

The arithmetic is on integers or is cut by ``floor`` so that every engine gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.sources.tables import table

EV = """SELECT o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS d, o_orderpriority AS zone,
  floor((2 + o_totalprice / 100000) * 100) / 100 AS magnitude, CAST(o_custkey % 700 AS DOUBLE) AS depth_km,
  CAST((o_orderkey * 37) % 18000 AS DOUBLE) / 100 - 90 AS lat, CAST((o_custkey * 53) % 36000 AS DOUBLE) / 100 - 180 AS lon
FROM orders"""

QUAKES = """SELECT event_id, ts, event_type AS zone, floor((2 + value / 100) * 100) / 100 AS magnitude, value FROM events"""

BOXES = """SELECT 'z' || CAST(r_regionkey AS VARCHAR) AS fault_id, CAST(-90 + r_regionkey * 36 AS DOUBLE) AS lat_min, CAST(-90 + r_regionkey * 36 + 45 AS DOUBLE) AS lat_max,
  CAST(-180 + r_regionkey * 60 AS DOUBLE) AS lon_min, CAST(-180 + r_regionkey * 60 + 100 AS DOUBLE) AS lon_max, CAST(r_regionkey + 1 AS INT) AS priority FROM region"""

SENSOR = """SELECT l_returnflag AS zone, CAST(l_shipdate AS DATE) AS d, floor(CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*)) / 100 AS x, CAST(count(*) AS BIGINT) AS n_obs FROM lineitem GROUP BY 1, 2"""

ENV = """SELECT CAST(o_orderdate AS DATE) AS d, CAST(count(*) AS BIGINT) AS n, CAST(max(o_custkey % 10) AS DOUBLE) AS kp_max, floor(avg(o_custkey % 97)) AS sw_speed, CAST(min(o_custkey % 300) - 200 AS DOUBLE) AS dst_min FROM orders GROUP BY 1"""

REPORTS = """SELECT doc_id AS submission_id, CAST(DATE '1995-01-01' + CAST(doc_id % 2399 AS INT) AS DATE) AS experience_date,
  CASE WHEN doc_id % 9 = 0 THEN NULL ELSE CAST((doc_id * 37) % 18000 AS DOUBLE) / 100 - 90 END AS lat,
  CASE WHEN doc_id % 9 = 0 THEN NULL ELSE CAST((doc_id * 53) % 36000 AS DOUBLE) / 100 - 180 END AS lon, source, lang, text,
  CASE quality WHEN 1 THEN 'high' WHEN 0 THEN 'medium' ELSE 'low' END AS urgency_level, coalesce(toxic = 1, FALSE) AS water_imagery, doc_id % 7 = 0 AS destruction_imagery,
  CASE doc_id % 4 WHEN 0 THEN 'fear' WHEN 1 THEN 'calm' WHEN 2 THEN 'dread' END AS emotion
FROM documents LEFT JOIN labels USING (doc_id)"""

STATIONS = """SELECT l_suppkey AS station_id, CAST(l_shipdate AS DATE) AS d, floor(avg(l_partkey % 89) * 100) / 100 AS east, floor(avg(l_partkey % 97) * 100) / 100 AS north, floor(avg(l_orderkey % 53) * 100) / 100 AS up FROM lineitem GROUP BY 1, 2"""

SCORED = """SELECT l_orderkey * 10 + l_linenumber AS row_id, CAST(l_returnflag = 'R' AS INT) AS y, l_discount * 10 AS p, CAST(l_shipdate AS DATE) AS d, l_returnflag AS zone FROM lineitem"""

_SQL = {"ev": EV, "quakes": QUAKES, "boxes": BOXES, "sensor": SENSOR, "env": ENV, "reports": REPORTS, "stations": STATIONS, "scored": SCORED}


def ctes(*names: str) -> str:
    """A WITH clause of the named inputs, for the SQL twins."""
    return "WITH " + ", ".join(f"{n} AS ({_SQL[n]})" for n in names)


def events(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("event_id"),
        F.to_date("o_orderdate").alias("d"),
        F.col("o_orderpriority").alias("zone"),
        (F.floor((F.lit(2) + F.col("o_totalprice") / 100000) * 100).cast("double") / 100).alias("magnitude"),
        (F.col("o_custkey") % 700).cast("double").alias("depth_km"),
        (((F.col("o_orderkey") * 37) % 18000).cast("double") / 100 - 90).alias("lat"),
        (((F.col("o_custkey") * 53) % 36000).cast("double") / 100 - 180).alias("lon"),
    )


def quakes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts", F.col("event_type").alias("zone"), (F.floor((F.lit(2) + F.col("value") / 100) * 100).cast("double") / 100).alias("magnitude"), "value")


def boxes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("r_regionkey")
    return table(spark, d, "region").select(
        F.concat(F.lit("z"), k.cast("string")).alias("fault_id"),
        (k * 36 - 90).cast("double").alias("lat_min"),
        (k * 36 - 45).cast("double").alias("lat_max"),
        (k * 60 - 180).cast("double").alias("lon_min"),
        (k * 60 - 80).cast("double").alias("lon_max"),
        (k + 1).cast("int").alias("priority"),
    )


def sensor(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("zone"), F.to_date("l_shipdate").alias("d"))
    return x.agg((F.floor(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / F.count(F.lit(1))).cast("double") / 100).alias("x"), F.count(F.lit(1)).alias("n_obs"))


def env(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("o_custkey")
    return table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(c % 10).cast("double").alias("kp_max"),
        F.floor(F.avg(c % 97)).cast("double").alias("sw_speed"),
        (F.min(c % 300) - 200).cast("double").alias("dst_min"),
    )


def reports(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    place = lambda m, n, s: F.when(i % 9 == 0, None).otherwise(((i * m) % n).cast("double") / 100 - s)
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select(
        i.alias("submission_id"),
        F.date_add(F.lit("1995-01-01").cast("date"), (i % 2399).cast("int")).alias("experience_date"),
        place(37, 18000, 90).alias("lat"),
        place(53, 36000, 180).alias("lon"),
        "source",
        "lang",
        "text",
        F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "medium").otherwise("low").alias("urgency_level"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("water_imagery"),
        (i % 7 == 0).alias("destruction_imagery"),
        F.when(i % 4 == 0, "fear").when(i % 4 == 1, "calm").when(i % 4 == 2, "dread").alias("emotion"),
    )


def stations(spark: SparkSession, d: str) -> DataFrame:
    cut = lambda c, m: F.floor(F.avg(F.col(c) % m) * 100).cast("double") / 100
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("station_id"), F.to_date("l_shipdate").alias("d")).agg(cut("l_partkey", 89).alias("east"), cut("l_partkey", 97).alias("north"), cut("l_orderkey", 53).alias("up"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (F.col("l_discount") * 10).alias("p"),
        F.to_date("l_shipdate").alias("d"),
        F.col("l_returnflag").alias("zone"),
    )
