"""A training corpus from raw documents: quality, near duplicates, benchmark leaks, mix, token files.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns the table that,
written as Parquet and read again, is the next one's docs. run() applies them to `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lossbook.llm import decontam, dedup, mixing, quality, tokenfile
from lossbook.session import apply_settings, stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    apply_settings(spark)
    return quality.accepted(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    The similarity is 0.8; the 0.85 of `DedupPlan` is op10's. A link is missed by all bands with a chance of 0.67^24, 7e-5.
    """
    apply_settings(spark)
    return dedup.keep_one(docs, dedup.DedupPlan(percent=80))


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    apply_settings(spark)
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    apply_settings(spark)
    return mixing.mixed_rows(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: one row per document in the files."""
    apply_settings(spark)
    return tokenfile.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("near_duplicates", dedup_stage), ("decontamination", decontam_stage),
          ("mixing", mix_stage), ("token_files", token_stage)]
# SQL can express neither the fitted classifier nor the tokenizer
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole `documents` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
