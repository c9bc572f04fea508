"""Column expressions: all run in the JVM, within whole-stage code where Spark allows it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def norm_lon(lon) -> Column:
    """Longitude wrapped into [-180, 180)."""
    x = _c(lon)
    return x - 360 * F.floor((x + 180) / 360)


def norm_lat(lat) -> Column:
    return F.greatest(F.lit(-90.0), F.least(F.lit(90.0), _c(lat)))


def grid_key(lat, lon, deg: int = 10) -> Column:
    """The cell of ``deg`` degrees as ``lat_lon`` of its lower corner."""
    low = lambda x: (F.floor(_c(x) / deg) * deg).cast("int").cast("string")
    return F.concat(low(lat), F.lit("_"), low(lon))


def bin_by(x, edges: list, labels: list[str]) -> Column:
    """The label of the first edge above ``x``, the last label beyond all edges; null for null."""
    out = F.when(_c(x).isNull(), None)
    for edge, label in zip(edges, labels, strict=False):
        out = out.when(_c(x) < edge, label)
    return out.otherwise(labels[-1])


def time_split(d, cuts: list[tuple[str, str]], otherwise: str) -> Column:
    """The label of the first cut date that ``d`` does not pass."""
    out = F.when(_c(d).isNull(), None)
    for day, label in cuts:
        out = out.when(_c(d) <= F.lit(day).cast("date"), label)
    return out.otherwise(otherwise)


def wf_fold(d, first_test_year: int, last_test_year: int, test_from: int = 1) -> Column:
    """Walk-forward fold by year: 0 before the first test year, then 1, 2, ...; -99 beyond the last."""
    y = F.year(_c(d))
    return F.when(y < first_test_year, 0).when(y <= last_test_year, y - first_test_year + test_from).otherwise(-99)


def storm_flags(kp, dst) -> dict[str, Column]:
    """Storm flags; null readings count as quiet."""
    hit = lambda c: F.when(c, 1).otherwise(0)
    kp, dst = _c(kp), _c(dst)
    return {"kp_storm": hit(kp >= 5), "kp_severe": hit(kp >= 7), "dst_storm": hit(dst <= -50), "dst_severe": hit(dst <= -100), "storm_day": hit(F.coalesce(kp >= 5, F.lit(False)) | F.coalesce(dst <= -50, F.lit(False)))}


def safe_divide(a, b) -> Column:
    return F.try_divide(_c(a), _c(b))


def ieee_divide(a, b) -> Column:
    """Division of floating numbers as SQL engines without an error for it do it: by zero it gives an infinity, and NaN for zero or NaN."""
    a, b = _c(a), _c(b)
    by_zero = F.when(a.isNull(), None).when(F.isnan(a) | (a == 0), float("nan")).when(a > 0, float("inf")).otherwise(float("-inf"))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def pair_corr(x, y) -> Column:
    """The correlation over rows that have both (an aggregate); NaN where one of them does not vary, null without rows."""
    x, y = F.when(_c(y).isNotNull(), _c(x)), F.when(_c(x).isNotNull(), _c(y))
    return ieee_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def z(x, mean, std) -> Column:
    """Standard score; null where the deviation is null or zero."""
    return F.when(_c(std) > 0, (_c(x) - _c(mean)) / _c(std))


def pct_delta(x, base) -> Column:
    """Per cent above a positive base, to four places; else null."""
    return F.when(_c(base) > 0, F.round(100 * (_c(x) - _c(base)) / _c(base), 4))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def local_xy_km(lat, lon, lat0, lon0) -> tuple[Column, Column]:
    """Equirectangular kilometres east and north of a reference point."""
    east = F.radians(_c(lon) - _c(lon0)) * EARTH_KM * F.cos(F.radians(_c(lat0)))
    return east, F.radians(_c(lat) - _c(lat0)) * EARTH_KM


def fault_perp(east, north, azimuth_deg) -> Column:
    """The part of a motion at right angles to a fault of the given azimuth."""
    a = F.radians(_c(azimuth_deg))
    return _c(east) * F.cos(a) - _c(north) * F.sin(a)


# Names of the eight phases from new on.
PHASES = ("new", "waxing_crescent", "first_quarter", "waxing_gibbous", "full", "waning_gibbous", "last_quarter", "waning_crescent")


def phase_bin(deg) -> Column:
    return F.pmod(F.floor(_c(deg) / 45), F.lit(8)).cast("int")


def phase_name(deg) -> Column:
    return F.element_at(F.array(*map(F.lit, PHASES)), phase_bin(deg) + 1)


def illumination(deg) -> Column:
    return (1 - F.cos(F.radians(_c(deg)))) / 2


def decimal_year_to_date(x) -> Column:
    """The day of a decimal year, counted in days of that year's length."""
    year = F.floor(_c(x)).cast("int")
    start = F.make_date(year, F.lit(1), F.lit(1))
    length = F.datediff(F.make_date(year + 1, F.lit(1), F.lit(1)), start)
    return F.date_add(start, F.floor((_c(x) - year) * length).cast("int"))


def doy_to_date(year, doy) -> Column:
    return F.date_add(F.make_date(_c(year), F.lit(1), F.lit(1)), (_c(doy) - 1).cast("int"))


def mask_sentinels(x, values=(), at_least: float | None = None) -> Column:
    """Null for fill values, and for magnitudes of ``at_least`` or more."""
    bad = _c(x).isin(*values) if values else F.lit(False)
    if at_least is not None:
        bad = bad | (F.abs(_c(x)) >= at_least)
    return F.when(bad, None).otherwise(_c(x))


def numeric_prefix(s) -> Column:
    return F.regexp_extract(_c(s), r"^\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def surrogate_id(prefix: str, *cols) -> Column:
    """The prefix and the SHA-1 of the columns joined by ``||``; nulls count as empty."""
    return F.concat(F.lit(prefix), F.sha1(F.concat_ws("||", *(F.coalesce(_c(c).cast("string"), F.lit("")) for c in cols))))


# Points by urgency and emotion.
URGENCY = {"high": 3, "medium": 2, "low": 1}
EMOTIONS = {"fear": 2, "dread": 2, "anxiety": 1, "calm": 1}


def points(x, table: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, n in table.items():
        out = F.when(_c(x) == name, n).otherwise(out)
    return out


def intensity_score(urgency, flags: list, emotion) -> Column:
    """Points of urgency and emotion and one for each flag set."""
    return reduce(lambda a, b: a + b, [F.when(F.coalesce(_c(f), F.lit(False)), 1).otherwise(0) for f in flags], points(urgency, URGENCY)) + points(emotion, EMOTIONS)


def alias_label(s, aliases: dict[str, str], allowed: list[str], default: str) -> Column:
    """A label in lower case without outer blanks, through its aliases, or the default if not allowed."""
    clean = F.lower(F.trim(_c(s)))
    for alias, name in aliases.items():
        clean = F.when(F.lower(F.trim(_c(s))) == alias, name).otherwise(clean)
    return F.when(clean.isin(*allowed), clean).otherwise(default)


def tri_state(found, d, covered_from: str) -> Column:
    """1 if found, 0 if not found within coverage, null before it."""
    return F.when(F.coalesce(_c(found), F.lit(False)), 1).when(_c(d) >= F.lit(covered_from).cast("date"), 0)


def proper_nouns(json_array, stop: list[str]) -> Column:
    """Capitalised strings of a JSON array that are not in the stop list, each once, in order."""
    words = F.from_json(_c(json_array), "array<string>")
    return F.array_distinct(F.filter(words, lambda w: w.rlike("^[A-Z]") & ~F.lower(w).isin(*stop)))


def strip_title(text, source, titled: str) -> Column:
    """The text without its first line for one source."""
    return F.when(_c(source).startswith(titled), F.trim(F.regexp_replace(_c(text), r"^[^\n]*\n?", ""))).otherwise(_c(text))


def anchor_date(text, base) -> Column:
    """When a report says it happened: struct of date, confidence and evidence.

    An explicit date is of high confidence; "n days, weeks, months or years ago", yesterday and
    "last week, month or year" count back from ``base`` with medium confidence; else none."""
    t, b = F.lower(_c(text)), _c(base)
    iso = F.regexp_extract(t, r"\b(\d{4}-\d{2}-\d{2})\b", 1)
    day = F.try_to_date(F.nullif(iso, F.lit("")), "yyyy-MM-dd")
    n = F.regexp_extract(t, r"\b(\d{1,4}) (?:day|week|month|year)s? ago\b", 1).try_cast("int")
    unit = F.regexp_extract(t, r"\b\d{1,4} (day|week|month|year)s? ago\b", 1)
    last = F.regexp_extract(t, r"\blast (week|month|year)\b", 1)
    back = F.when(unit == "day", F.date_sub(b, n)).when(unit == "week", F.date_sub(b, n * 7)).when(unit == "month", F.add_months(b, -n)).when(unit == "year", F.add_months(b, -12 * n))
    back_last = F.when(last == "week", F.date_sub(b, 7)).when(last == "month", F.add_months(b, -1)).when(last == "year", F.add_months(b, -12))
    pick = lambda d, conf, why: F.struct(d.alias("date"), F.lit(conf).alias("confidence"), why.alias("evidence"))
    return (
        F.when(day.isNotNull(), pick(day, "high", iso))
        .when(back.isNotNull(), pick(back, "medium", F.concat_ws(" ", n.cast("string"), unit, F.lit("ago"))))
        .when(t.rlike(r"\byesterday\b"), pick(F.date_sub(b, 1), "medium", F.lit("yesterday")))
        .when(back_last.isNotNull(), pick(back_last, "medium", F.concat(F.lit("last "), last)))
        .otherwise(pick(F.lit(None).cast("date"), "none", F.lit("")))
    )


def place_spans(text) -> Column:
    """Title-case names of up to four words after a preposition of place."""
    return F.regexp_extract_all(_c(text), F.lit(r"\b(?:in|near|at|from|off)\s+((?:\p{Lu}[\p{L}'-]*)(?:\s+\p{Lu}[\p{L}'-]*){0,3})"), F.lit(1))


def geojson_centroid(geometry_json) -> Column:
    """Mean of the vertices of a Point, of a Polygon's outer ring, or of all outer rings of a MultiPolygon, as (lat, lon)."""
    kind = F.get_json_object(_c(geometry_json), "$.type")
    coords = F.get_json_object(_c(geometry_json), "$.coordinates")
    vertices = (
        F.when(kind == "Point", F.array(F.from_json(coords, "array<double>")))
        .when(kind == "Polygon", F.element_at(F.from_json(coords, "array<array<array<double>>>"), 1))
        .when(kind == "MultiPolygon", F.flatten(F.transform(F.from_json(coords, "array<array<array<array<double>>>>"), lambda p: F.get(p, F.lit(0)))))
    )
    mean = lambda k: F.try_divide(F.aggregate(vertices, F.lit(0.0), lambda a, v: a + F.get(v, F.lit(k))), F.size(vertices))
    return F.when(F.size(vertices) > 0, F.struct(mean(1).alias("lat"), mean(0).alias("lon")))


def portable_draw(seed, *keys) -> Column:
    """An integer in [0, 2^32) from the MD5 of the seed and keys: the same in every engine and partitioning."""
    said = F.concat_ws("|", F.lit(str(seed)), *(_c(k).cast("string") for k in keys))
    return F.conv(F.substring(F.md5(said), 1, 8), 16, 10).cast("long")


def portable_draws(n: int, seed, *keys) -> list[Column]:
    """Up to four independent draws, as ``portable_draw``, from one MD5."""
    said = F.md5(F.concat_ws("|", F.lit(str(seed)), *(_c(k).cast("string") for k in keys)))
    return [F.conv(F.substring(said, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(n)]
