"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from feedloom.llm import sql
from feedloom.llm.common import table
from feedloom.llm.jaccard_join import jaccard_join
from feedloom.llm.lbl import lbl_scores
from feedloom.llm.license_scan import license_scan
from feedloom.llm.line_dedup import line_dedup
from feedloom.llm.merkle import merkle_manifest
from feedloom.llm.packing import pack
from feedloom.llm.perplexity import perplexity
from feedloom.llm.quality_rules import quality_rules
from feedloom.llm.runs import periodic_runs
from feedloom.llm.site_style import extract
from feedloom.llm.span_dedup import span_dedup
from feedloom.llm.tiling import leaks
from feedloom.llm.toxicity import toxicity


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op4_lbl_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl_scores(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(table(spark, sf_dir, "documents"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": sql.license_scan(), "op3_jaccard_join": sql.JACCARD_JOIN, "op10_span_dedup": sql.SPAN_DEDUP, "op11_merkle_manifest": sql.MERKLE, "op12_line_dedup": sql.LINE_DEDUP}
