"""CAP alerts wrapped in Atom entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("identifier", "sent", "event", "headline", "description", "severity", "urgency", "certainty", "effective", "expires", "areaDesc", "polygon")


def _pick(x: Column, name: str) -> Column:
    """The first element of a local name, whatever its namespace."""
    got = F.xpath_string(x, F.lit(f'(//*[local-name()="{name}"])[1]'))
    return F.nullif(F.trim(got), F.lit(""))


def entries(df: DataFrame) -> DataFrame:
    """One row for each Atom entry of the payloads in ``value``."""
    found = F.regexp_extract_all("value", F.lit(r"(?s)(<(?:\w+:)?entry\b.*?</(?:\w+:)?entry>)"), F.lit(1))
    return df.select(F.explode(found).alias("entry"))


def cap_xml_alerts(df: DataFrame) -> DataFrame:
    """Alerts of Atom feeds: inline, or escaped as text in the content; entries without an alert give title and link."""
    e = entries(df)
    bare = F.regexp_replace("entry", r"(</?)\w+:", "$1")
    bare = F.regexp_replace(bare, r"\s+\w+:(\w+)=", " $1=")
    text = F.regexp_extract(bare, r"(?s)<content[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</content>", 1)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    inner = F.regexp_extract(F.regexp_replace(text, r"(</?)\w+:", "$1"), r"(?s)(<alert\b.*</alert>)", 1)
    x = e.select(bare.alias("entry"), F.when(F.length(inner) > 0, inner).otherwise(bare).alias("alert"))
    out = x.select(*(_pick(F.col("alert"), f).alias(f) for f in FIELDS), _pick(F.col("entry"), "title").alias("_title"), F.nullif(F.xpath_string("entry", F.lit("(//link/@href)[1]")), F.lit("")).alias("link"), _pick(F.col("entry"), "id").alias("_id"))
    out = out.withColumns({"identifier": F.coalesce("identifier", "_id", "link"), "headline": F.coalesce("headline", "_title"), "sent": F.try_to_timestamp("sent"), "effective": F.try_to_timestamp("effective"), "expires": F.try_to_timestamp("expires")})
    vertex = first_polygon_vertex(F.col("polygon"))
    return out.select(*FIELDS, "link", F.get(vertex, F.lit(0)).alias("lat"), F.get(vertex, F.lit(1)).alias("lon"))


def first_polygon_vertex(polygon: Column) -> Column:
    """[lat, lon] of the first pair of ``lat,lon lat,lon``."""
    return F.transform(F.split(F.split(F.trim(polygon), r"\s+")[0], ","), lambda v: v.try_cast("double"))
