"""Gridded ionosphere maps: whole files to cells, by the format's own order of values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "d date, map_idx int, lat double, lon double, tec double"


def _cells(text: str):
    """Cells of one file: a latitude block's values run on over its lines; 9999 is missing."""
    exponent, lat, lons, values, map_idx, day, want = -1, None, (), [], -1, None, 0
    for line in text.splitlines():
        label = line[60:].strip()
        if label == "EXPONENT":
            exponent = int(line[:6])
        elif label == "START OF TEC MAP":
            map_idx = int(line[:6]) - 1
        elif label == "EPOCH OF CURRENT MAP":
            y, m, d = (int(line[k : k + 6]) for k in (0, 6, 12))
            day = pd.Timestamp(y, m, d).date()
        elif label == "LAT/LON1/LON2/DLON/H":
            lat, a, b, step, _ = (float(line[2 + 6 * k : 8 + 6 * k]) for k in range(5))
            want = int(round((b - a) / step)) + 1
            lons, values = tuple(a + step * k for k in range(want)), []
        elif label in ("END OF TEC MAP", "START OF RMS MAP"):
            lat, want = None, 0
            if label == "START OF RMS MAP":
                return
        elif want and lat is not None and day is not None:
            values += [int(line[k : k + 5]) for k in range(0, len(line.rstrip()), 5)]
            if len(values) >= want:
                for lon, v in zip(lons, values, strict=False):
                    yield day, map_idx, lat, lon, None if v == 9999 else v * 10.0**exponent
                want = 0


def ionex_cells(df: DataFrame) -> DataFrame:
    """Cells of whole files in ``value``; pages that are not such files, and files cut off, give what they have."""

    def run(batches):
        for pdf in batches:
            rows = []
            for text in pdf.value:
                got = _cells(text)
                try:
                    for row in got:
                        rows.append(row)
                except ValueError:
                    continue
            yield pd.DataFrame(rows, columns=["d", "map_idx", "lat", "lon", "tec"])

    files = df.select("value").filter(F.col("value").isNotNull() & ~F.ltrim("value").startswith("<"))
    return files.mapInPandas(run, SCHEMA)
