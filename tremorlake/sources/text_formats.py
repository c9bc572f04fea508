"""Fixed-width and line formats, as DataFrame expressions over lines or whole files in ``value``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fields(df: DataFrame) -> DataFrame:
    return df.select(F.split(F.trim("value"), r"\s+").alias("f"))


def _num(x: Column) -> Column:
    return x.try_cast("double")


def _at(k: int) -> Column:
    return F.get("f", F.lit(k))


def csv_catalog(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text columns to their types; blanks and values that do not parse are null."""
    return df.select(*(F.nullif(F.trim(c), F.lit("")).try_cast(t).alias(c) if c in types else F.col(c) for c, t in ((c, types.get(c)) for c in df.columns)))


def kp_table(df: DataFrame) -> DataFrame:
    """Lines of year, month, day, eight three-hour values, Ap and F10.7: daily greatest and mean; values of zero or less
    in the last are null; comments and malformed lines are left out."""
    f = _fields(df.filter(~F.col("value").startswith("#"))).filter(F.size("f") >= 13)
    kp = F.filter(F.transform(F.slice("f", 4, 8), _num), lambda x: x.isNotNull() & (x >= 0))
    day = F.try_to_date(F.concat_ws("-", _at(0), F.lpad(_at(1), 2, "0"), F.lpad(_at(2), 2, "0")), "yyyy-MM-dd")
    flux = _num(_at(12))
    out = f.select(day.alias("d"), F.array_max(kp).alias("kp_max"), F.try_divide(F.aggregate(kp, F.lit(0.0), lambda a, x: a + x), F.size(kp)).alias("kp_mean"), _num(_at(11)).alias("ap"), F.when(flux > 0, flux).alias("f107"))
    return out.filter("d IS NOT NULL")


def hourly_dst(df: DataFrame, year: int | Column, month: int | Column) -> DataFrame:
    """Lines of a day and 24 values: least and mean of those under 500 in size. Year and month are those of one file, or
    columns where the lines are of several."""
    v = F.transform(F.regexp_extract_all(F.regexp_extract("value", r"^\s*\d{1,2}\s+(.*)$", 1), F.lit(r"(-?\d+)"), F.lit(1)), lambda x: x.try_cast("int"))
    ok = F.filter("v", lambda x: F.abs(x) < 500)
    d = df.select(F.lit(year).alias("y"), F.lit(month).alias("m"), F.regexp_extract("value", r"^\s*(\d{1,2})\s", 1).try_cast("int").alias("day"), v.alias("v")).filter("day BETWEEN 1 AND 31 AND size(v) >= 24").select("y", "m", "day", ok.alias("v"))
    return d.select(F.make_date("y", "m", "day").alias("d"), F.array_min("v").alias("dst_min"), F.try_divide(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), F.size("v")).alias("dst_mean")).filter("dst_min IS NOT NULL")


def omni_hourly(df: DataFrame, value: str, fill: float, scale: float = 1.0) -> DataFrame:
    """Lines of year, day of year, hour and value: daily greatest, least and mean without fill values."""
    f = _fields(df).filter(F.size("f") >= 4)
    d = f.select(F.expr("date_add(make_date(try_cast(f[0] AS INT), 1, 1), try_cast(f[1] AS INT) - 1)").alias("d"), _num(_at(3)).alias("x")).filter((F.col("x") != fill) & F.col("d").isNotNull())
    return d.groupBy("d").agg(*(fn(F.col("x") / scale).alias(f"{value}_{n}") for n, fn in (("max", F.max), ("min", F.min), ("mean", F.avg))))


def sectioned_report(df: DataFrame, section: str, col: int) -> DataFrame:
    """Of whole files, value ``col`` (from 0) of the first data line behind ``:section:``; zero or less is null."""
    line = F.regexp_extract("value", rf"(?s):{section}:[^\n]*\n(?:[#:][^\n]*\n)*\s*([^\n]*)", 1)
    x = F.get(F.split(F.trim(line), r"\s+"), F.lit(col)).try_cast("double")
    return df.select("*", F.when(x > 0, x).alias("x"))


def flare_reports(df: DataFrame) -> DataFrame:
    """Lines with a day (yymmdd or yyyymmdd) and a flare class such as M2.3: daily greatest flux, top class and flags."""
    r = df.select(F.regexp_extract("value", r"(?:^|\s)(?:31777|)(\d{6,8})", 1).alias("day"), F.regexp_extract("value", r"\b([ABCMX])\s?(\d+(?:\.\d+)?)\b", 1).alias("c"), F.regexp_extract("value", r"\b[ABCMX]\s?(\d+(?:\.\d+)?)\b", 1).try_cast("double").alias("size"))
    power = F.element_at(F.create_map(*(F.lit(v) for p in (("A", 1e-8), ("B", 1e-7), ("C", 1e-6), ("M", 1e-5), ("X", 1e-4)) for v in p)), F.col("c"))
    day = F.when(F.length("day") == 8, F.try_to_date("day", "yyyyMMdd")).otherwise(F.try_to_date("day", "yyMMdd"))
    f = r.filter("c != '' AND day != ''").select(day.alias("d"), "c", (F.col("size") * power).alias("flux")).filter("d IS NOT NULL")
    return f.groupBy("d").agg(F.max("flux").alias("xray_max"), F.max("c").alias("xray_class_max"), F.max((F.col("c") == "M").cast("int")).alias("has_m_flare"), F.max((F.col("c") == "X").cast("int")).alias("has_x_flare"))


def iaga_hourly(df: DataFrame, component: str) -> DataFrame:
    """Whole observatory files: date, time and the column whose header ends in ``component``; 99990 and more is missing."""
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.length(F.trim(x)) > 0)
    w = df.select(lines.alias("l")).withColumn("head", F.get(F.filter("l", lambda x: F.startswith(x, F.lit("DATE"))), F.lit(0)))
    w = w.withColumn("k", F.expr(f"array_position(transform(split(trim(replace(head, '|', '')), '\\\\s+'), h -> right(h, 1)), '{component}')"))
    r = w.filter("head IS NOT NULL AND k > 0").select("k", F.explode("l").alias("x")).filter(F.col("x").rlike(r"^\d{4}-\d{2}-\d{2}\s")).select("k", F.split(F.trim("x"), r"\s+").alias("f"))
    v = F.get("f", F.col("k").cast("int") - 1).try_cast("double")
    return r.select(F.try_to_timestamp(F.concat_ws(" ", _at(0), F.substring(_at(1), 1, 8))).alias("ts"), F.when(F.abs(v) < 99990, v).alias("x"))


def tenv3_positions(df: DataFrame, least_days: int = 365) -> DataFrame:
    """Station lines: name, decimal year and motion in millimetres; stations of fewer days are left out."""
    from pyspark.sql import Window as W

    f = _fields(df).filter(F.size("f") >= 13)
    mm = lambda k: _num(_at(k)) * 1000
    p = f.select(_at(0).alias("station_id"), _num(_at(2)).alias("decimal_year"), mm(8).alias("east_mm"), mm(10).alias("north_mm"), mm(12).alias("up_mm")).filter("decimal_year IS NOT NULL")
    return p.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("station_id"))).filter(F.col("_n") >= least_days).drop("_n")


def daily_network_csv(df: DataFrame) -> DataFrame:
    """Lines of a network file with the day in ``d``: all cells of lines of type 13 pooled to mean, population variance and
    z = mean / deviation, reporting stations of the line of type 11, and a status."""
    cells = df.filter(F.col("value").startswith("13,")).select("d", F.split("value", ",").alias("c")).select("d", F.explode(F.slice("c", F.lit(3), F.greatest(F.size("c") - 2, F.lit(0)))).alias("x")).select("d", F.col("x").try_cast("double").alias("x"))
    stats = cells.groupBy("d").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("variance"), F.count("x").alias("n_cells"), F.count(F.lit(1)).alias("n_all"))
    meta = df.groupBy("d").agg(F.max(F.regexp_extract("value", r"^11,\d+,(\d+)", 1).try_cast("int")).alias("n_reporting"))
    out = meta.join(stats, "d", "left")
    status = F.when(F.col("n_all").isNull(), "no_data").when(F.col("n_cells") == 0, "decode_error").otherwise("ok")
    return out.select("d", "mean", "variance", F.when(F.col("variance") > 0, F.col("mean") / F.sqrt("variance")).alias("z"), "n_reporting", status.alias("status"))
