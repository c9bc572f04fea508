"""Station networks: residuals of a seasonal fit, strain."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def secular_seasonal_resid(df: DataFrame, station: str, day: str, cols: list[str]) -> DataFrame:
    """Station, day and the residuals of each column from a line with yearly and half-yearly waves.

    One group is one station's days. The fit needs more days than its six terms; shorter or null-only
    series have null residuals."""
    kinds = dict(df.dtypes)
    schema = f"{station} {kinds[station]}, {day} {kinds[day]}, " + ", ".join(f"{c}_resid double" for c in cols)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        t = (pd.to_datetime(pdf[day]) - pd.Timestamp("2000-01-01")).dt.days.to_numpy() / 365.25
        a = np.c_[np.ones_like(t), t, np.cos(2 * np.pi * t), np.sin(2 * np.pi * t), np.cos(4 * np.pi * t), np.sin(4 * np.pi * t)]
        out = {station: pdf[station], day: pdf[day]}
        for c in cols:
            y = pdf[c].to_numpy(float)
            ok = ~np.isnan(y)
            out[f"{c}_resid"] = y - a @ np.linalg.lstsq(a[ok], y[ok], rcond=None)[0] if ok.sum() > a.shape[1] else np.nan
        return pd.DataFrame(out)

    return df.select(station, day, *cols).groupBy(station).applyInPandas(fit, schema)


def strain(tri: DataFrame, motion: DataFrame, station: str, day: str = "d", east: str = "east", north: str = "north", zone: str = "zone", least: int = 3) -> DataFrame:
    """Area-weighted daily dilatation and shear by zone from the motion gradient of each triangle whose three stations
    reported; days with fewer than ``least`` triangles are left out."""
    out = tri
    for k in "abc":
        m = motion.select(F.col(station).alias(k), *([F.col(day)] if k == "a" else [F.col(day).alias(day)]), F.col(east).alias(f"u{k}"), F.col(north).alias(f"v{k}"))
        out = out.join(m, [k] if k == "a" else [k, day])
    c = F.col
    twice = (c("bx") - c("ax")) * (c("cy") - c("ay")) - (c("cx") - c("ax")) * (c("by") - c("ay"))
    grad_x = lambda f: ((c(f"{f}b") - c(f"{f}a")) * (c("cy") - c("ay")) - (c(f"{f}c") - c(f"{f}a")) * (c("by") - c("ay"))) / twice
    grad_y = lambda f: ((c(f"{f}c") - c(f"{f}a")) * (c("bx") - c("ax")) - (c(f"{f}b") - c(f"{f}a")) * (c("cx") - c("ax"))) / twice
    out = out.withColumns({"exx": grad_x("u"), "eyy": grad_y("v"), "exy": (grad_y("u") + grad_x("v")) / 2})
    out = out.withColumn("dil", c("exx") + c("eyy")).withColumn("shear", F.sqrt(F.pow((c("exx") - c("eyy")) / 2, 2) + F.pow(c("exy"), 2)))
    g = out.groupBy(zone, day).agg((F.sum(c("dil") * c("area")) / F.sum("area")).alias("dilatation"), F.max("shear").alias("max_shear"), F.count(F.lit(1)).alias("n_triangles"))
    return g.filter(c("n_triangles") >= least)
