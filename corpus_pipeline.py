"""The training-data pipeline: every stage takes (spark, docs, sf_dir) and returns a DataFrame for the next one.

All stages but the last return the columns of ``docs``, whatever further ones there are and whatever their names. Defined cases: an
empty table stays empty. A null or empty text fails the quality rules, so it goes no further. A row with a null doc_id is
judged, cleaned and packed, but is never taken for a copy or a leak; rows that repeat a doc_id are one document to the
stages that compare documents, and each is kept or goes with it. Very long texts are read whole by every stage. Of
copies the smallest doc_id stays, of repeated spans the first occurrence, so ties don't depend on the order of rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from feedloom.llm.common import table
from feedloom.llm.jaccard_join import drop_near_copies
from feedloom.llm.packing import pack
from feedloom.llm.quality_rules import passing
from feedloom.llm.span_dedup import without_repeats
from feedloom.llm.tiling import drop_leaks


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return passing(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", repeated_spans),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: Compression ratios and token ids are not to be had in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
