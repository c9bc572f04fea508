"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Slices of the hash range and of the unit interval; a rank is an offset of its slice plus a row
#: number within the slice, so that no source and no order is sorted in one task.
SLICE_BITS = 13
HASH_BITS = 60


def _sliced_rank(df: DataFrame, keys: list[str], slice_col: str, order: list[Column], rank: str, total: str) -> DataFrame:
    """Adds ``rank`` (from 0, by slice and then ``order``, within ``keys``) and ``total`` (rows of ``keys``)."""
    counts = df.groupBy(*keys, slice_col).agg(F.count(F.lit(1)).alias("_ps_c"))
    over = W.partitionBy(*keys)
    counts = counts.select(
        *keys,
        slice_col,
        (F.sum("_ps_c").over(over.orderBy(slice_col).rowsBetween(W.unboundedPreceding, 0)) - F.col("_ps_c")).alias("_ps_before"),
        F.sum("_ps_c").over(over).alias(total),
    )
    numbered = df.withColumn("_ps_rn", F.row_number().over(W.partitionBy(*keys, slice_col).orderBy(*order)))
    return numbered.join(counts, [*keys, slice_col]).withColumn(rank, F.col("_ps_before") + F.col("_ps_rn") - 1).drop("_ps_before", "_ps_rn")


def interleaved(df: DataFrame, n_shards: int, id_col: str = "doc_id", stratum_col: str = "source", seed: int = 42) -> DataFrame:
    """Every row of ``df`` with its ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0).

    Rows are shuffled by a seeded hash and ranked within their stratum; the fractional ranks of
    all strata are sorted together and cut into shards whose row counts are at most one apart, so
    each shard holds each stratum in the whole table's proportion, to within a row or two.

    The shuffle is by MD5 of seed and id, which SQL engines have too. Nulls: a null stratum is a
    stratum of its own, and null ids are hashed as empty. Ties and
    repeated rows take neighbouring ranks in any order. An empty table gives no rows. Other
    columns are carried along; the names ``shard`` and ``slot`` and names that begin with
    ``_ps_`` are the operator's own: columns of those names do not come through.
    """
    cols = [c for c in df.columns if c not in ("shard", "slot") and not c.startswith("_ps_")]
    stratum = F.concat(F.when(F.col(stratum_col).isNull(), "").otherwise("="), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")))
    drawn = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, HASH_BITS // 4)
    row = df.select(*cols, stratum.alias("_ps_s"), F.conv(drawn, 16, 10).cast("long").alias("_ps_h"))
    row = row.withColumn("_ps_slice", F.shiftrightunsigned("_ps_h", HASH_BITS - SLICE_BITS))
    row = _sliced_rank(row, ["_ps_s"], "_ps_slice", [F.col("_ps_h"), F.col(id_col)], "_ps_rank", "_ps_size")
    row = row.withColumn("_ps_frac", (F.col("_ps_rank") + 0.5) / F.col("_ps_size")).drop("_ps_slice", "_ps_rank", "_ps_size")
    row = row.withColumn("_ps_slice", F.floor(F.col("_ps_frac") * (1 << SLICE_BITS))).withColumn("_ps_all", F.lit(0))
    row = _sliced_rank(row, ["_ps_all"], "_ps_slice", [F.col("_ps_frac"), F.col("_ps_s"), F.col("_ps_h"), F.col(id_col)], "_ps_at", "_ps_n")
    row = row.withColumn("shard", F.expr(f"_ps_at * {n_shards}L div _ps_n"))
    first = F.expr(f"(shard * _ps_n + {n_shards - 1}L) div {n_shards}L")
    return row.select(*cols, F.col("shard").cast("int").alias("shard"), (F.col("_ps_at") - first).alias("slot"))


def write_shards(df: DataFrame, path: str, n_shards: int, **kw) -> None:
    """Write ``df`` as one folder a shard, each file in slot order; hot shards may take several tasks."""
    out = interleaved(df, n_shards, **kw)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
