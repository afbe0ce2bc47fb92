"""Evaluation of retrieval: recall at k over labelled queries, and a check of the corpus first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators.retrieval import dot
from feedloom.schemas import LABELLED_QUERIES


class LabelError(ValueError):
    """A labelled query that cannot be used."""


def labelled_queries(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of {text, relevant_entry_ids, note}; blank texts and empty sets are errors."""
    df = spark.read.schema(LABELLED_QUERIES).json(path, multiLine=True)
    if df.filter((F.trim(F.coalesce("text", F.lit(""))) == "") | (F.coalesce(F.size("relevant_entry_ids"), F.lit(0)) <= 0)).limit(1).count():
        raise LabelError("a query has no text or no relevant entries")
    return df


def recall_at_k(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """query_id, recall. hits: query_id, entry_id, rank; relevant: query_id, entry_id. -1 where nothing is relevant."""
    top = hits.filter(F.col("rank") <= max(k, 0)).select("query_id", "entry_id").distinct()
    rel = relevant.filter("entry_id IS NOT NULL").select("query_id", "entry_id").distinct()
    found = top.join(rel, ["query_id", "entry_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("found"))
    total = rel.groupBy("query_id").agg(F.count("*").alias("total"))
    every = relevant.select("query_id").distinct()
    df = every.join(total, "query_id", "left").join(found, "query_id", "left")
    return df.select("query_id", F.when(F.coalesce("total", F.lit(0)) == 0, -1.0).otherwise(F.round(F.coalesce("found", F.lit(0)) / F.col("total"), 6)).alias("recall"))


def mean_recall(recalls: DataFrame) -> DataFrame:
    return recalls.filter("recall >= 0").agg(F.round(F.avg("recall"), 6).alias("mean_recall"))


def corpus_guard(passages: DataFrame) -> DataFrame:
    """passages, titles among them, least and greatest norm of their embeddings: a corpus of the wrong size or model shows here."""
    norm = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    titles = F.col("source") == "title" if "source" in passages.columns else F.col("ordinal") == 0
    return passages.agg(F.count("*").alias("passages"), F.count_if(titles).alias("titles"), F.round(F.min(norm), 6).alias("min_norm"), F.round(F.max(norm), 6).alias("max_norm"))
