"""A corpus pipeline of five stages over ``documents``; each stage is written and read again before the next.

Quality rules drop rejected documents, SimHash keeps one document of each group of near copies, decontamination drops
documents that overlap a benchmark item, personal data is replaced by its kind, and the last
stage encodes what is left. Two stages leave the session's Arrow batches at a few MB, as their Python runs when the caller
writes them.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.llm import bpe, decontaminate, fertility, pii, simhash
from tremorlake.llm.common import drop_folder, hold_batches, shared_dir
from tremorlake.llm.queries import FERTILITY, vocab_path
from tremorlake.sources.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fertility.keep_good(docs, [vocab_path(v) for v in FERTILITY], lang_col="lang" if "lang" in docs.columns else None)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hold_batches(spark)  # its Python runs when the caller writes
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redact(docs)
    # the character count is that of the text as it is now
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(out.schema["n_chars"].dataType))) if "n_chars" in out.columns else out


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hold_batches(spark)
    return bpe.encode(docs, vocab_path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("PII", personal_data), ("BPE encoding and decoding", encoding)]

#: SQL can express neither the sentencepiece measures nor BPE; the tests hold the run against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the others are written as Parquet to the shared folder and read again. A stage's folder
    is deleted when the next one is written; that of the last but one stays, as the rows returned are read from it."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{k}")
            docs = spark.read.parquet(f"{base}/{k}")
            if k:
                drop_folder(spark, f"{base}/{k - 1}")
    return docs
