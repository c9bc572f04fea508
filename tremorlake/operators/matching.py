"""Matching of names in text to a gazetteer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Confidence by kind of place for an exact match, and of a match at one or two edits.
EXACT = {"city": 0.95, "state": 0.93, "region": 0.93, "country": 0.90}
NEAR = {1: 0.88, 2: 0.86}


def gazetteer_match(spans: DataFrame, places: DataFrame, text_id: str, span: str = "span", place: str = "place", kind: str = "kind", max_edits: int = 2) -> DataFrame:
    """The best place for each text: exact names first, then names within ``max_edits`` edits that share the first
    letter and nearly the length; ties go to the smaller name. Texts without a match have no row."""
    s = spans.select(F.col(text_id).alias("_t"), F.lower(F.trim(span)).alias("_s")).filter("_s != ''")
    p = places.select(F.lower(F.trim(place)).alias("_p"), F.col(place).alias("place"), F.col(kind).alias("kind"))
    score = F.lit(0.90)
    for name, c in EXACT.items():
        score = F.when(F.col("kind") == name, c).otherwise(score)
    exact = s.join(p, s["_s"] == p["_p"]).select("_t", "place", "kind", score.alias("confidence"))
    left = s.join(exact.select("_t").distinct(), "_t", "left_anti")
    # blocks of first letter and length: a span looks in the few lengths that edits can reach
    left = left.withColumn("_k", F.substring("_s", 1, 1)).withColumn("_n", F.explode(F.sequence(F.length("_s") - max_edits, F.length("_s") + max_edits)))
    blocked = p.withColumn("_k", F.substring("_p", 1, 1)).withColumn("_n", F.length("_p"))
    near = left.join(blocked, ["_k", "_n"]).withColumn("_e", F.levenshtein("_s", "_p", max_edits)).filter("_e between 1 and 2")
    near = near.select("_t", "place", "kind", F.when(F.col("_e") == 1, NEAR[1]).otherwise(NEAR[2]).alias("confidence"))
    best = exact.unionByName(near).groupBy(F.col("_t").alias(text_id)).agg(F.min(F.struct((-F.col("confidence")).alias("c"), "place", "kind")).alias("b"))
    return best.select(text_id, "b.place", "b.kind", (-F.col("b.c")).alias("confidence"))
