"""The passage index: what is pending, passages of entries, replacing them, counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from feedloom.functions.text import extract_text, split, truncate_bytes

VERSION = "v3"
MODEL = "hash@1#64"
PASSAGES = "entry_id long, ordinal int, source string, text string, char_start int, char_end int"


def identity(name: str, revision: str, dimensions: int) -> str:
    return f"{name}@{revision}#{dimensions}"


def content_hash(version: str = VERSION, model: str = MODEL):
    """Changes with pipeline, model, title and content, so a new version offers the whole corpus again."""
    return F.md5(F.concat(F.lit(f"{version}|{model}|"), F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))))


def pending(entries: DataFrame, state: DataFrame, after: int = 0, limit: int = 0) -> DataFrame:
    """entry_id of entries without state, failed before, or changed since; ascending, after a cursor."""
    s = state.select("entry_id", F.col("content_hash").alias("old"), F.col("status").alias("state"))
    df = entries.filter(F.col("entry_id") > after).select("entry_id", content_hash().alias("new")).join(s, "entry_id", "left")
    df = df.filter(F.col("state").isNull() | (F.col("state") == "failed") | (F.col("old") != F.col("new"))).select("entry_id")
    return df.orderBy("entry_id").limit(limit) if limit > 0 else df


def pending_count(entries: DataFrame, state: DataFrame) -> DataFrame:
    return pending(entries, state, after=-1).agg(F.count("*").alias("n"))


def pending_estimate(entries: DataFrame, state: DataFrame) -> DataFrame:
    """Entries less those with a state that isn't failed; reads no text and makes no hashes."""
    done = state.filter("status <> 'failed'").join(entries.select("entry_id"), "entry_id", "left_semi").agg(F.count("*").alias("done"))
    return entries.agg(F.count("*").alias("total")).join(F.broadcast(done)).select(F.greatest(F.col("total") - F.col("done"), F.lit(0)).alias("n"))


def indexed_count(entries: DataFrame, state: DataFrame) -> DataFrame:
    return state.filter("status = 'ok'").join(entries.select("entry_id"), "entry_id", "left_semi").agg(F.count("*").alias("n"))


def max_entry_id(entries: DataFrame) -> DataFrame:
    return entries.agg(F.coalesce(F.max("entry_id"), F.lit(0)).alias("max_id"))


def make_passages(entries: DataFrame, target: int = 320, most: int = 512, overlap: int = 64) -> DataFrame:
    """The title as ordinal 0, then the overlapping passages of the extracted text, with byte offsets."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for entry_id, title, content in zip(pdf["entry_id"], pdf["title"], pdf["content"], strict=True):
                at = 0
                if title and title.strip():
                    out.append((entry_id, 0, "title", title, 0, len(title.encode())))
                    at = 1
                for i, (text, start, end) in enumerate(split(extract_text(content or ""), target, most, overlap), at):
                    out.append((entry_id, i, "content", text, start, end))
            yield pd.DataFrame(out, columns=["entry_id", "ordinal", "source", "text", "char_start", "char_end"])

    return entries.select("entry_id", "title", "content").mapInPandas(rows, PASSAGES)


@udtf(returnType="ordinal int, source string, text string, char_start int, char_end int")
class PassageTable:
    """The passages of one entry as a table function, for SQL's LATERAL: passages_of(title, content)."""

    def eval(self, title: str, content: str):
        at = 0
        if title and title.strip():
            yield 0, "title", title, 0, len(title.encode())
            at = 1
        for i, (text, start, end) in enumerate(split(extract_text(content or "")), at):
            yield i, "content", text, start, end


def passages_by_lateral(entries: DataFrame) -> DataFrame:
    """``make_passages`` in SQL: every entry joined with its own passages."""
    spark = entries.sparkSession
    spark.udtf.register("passages_of", PassageTable)
    return spark.sql("SELECT e.entry_id, p.* FROM {e} AS e, LATERAL passages_of(e.title, e.content) AS p", e=entries.select("entry_id", "title", "content"))


def hashing_embedder(dimensions: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic embedder for use without a model: signed word hashes, normalised."""
    import numpy as np
    import xxhash

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dimensions))
        for i, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = xxhash.xxh64_intdigest(word)
                out[i, h % dimensions] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).tolist()

    return embed


def embed_passages(passages: DataFrame, embed: Callable[[list[str]], list[list[float]]], prefix: str = "", batch: int = 16) -> DataFrame:
    """``passages`` with embedding; the embedder is called with ``batch`` texts, each with the model's prefix for documents."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [prefix + t for t in pdf["text"]]
            pdf["embedding"] = [v for i in range(0, len(texts), batch) for v in embed(texts[i : i + batch])]
            yield pdf

    return passages.mapInPandas(rows, ", ".join(f"{n} {t}" for n, t in passages.dtypes) + ", embedding array<double>")


def replace_passages(passages: DataFrame, state: DataFrame, new: DataFrame, done: DataFrame, as_of, status: str = "ok", reason: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(passages, state) after the entries in ``done`` (entry_id, content_hash) were indexed: ok and skipped drop their old
    passages, failed keeps them."""
    ids = done.select("entry_id")
    kept = passages if status == "failed" else passages.join(ids, "entry_id", "left_anti")
    added = kept.unionByName(new.select(*kept.columns)) if status == "ok" else kept
    rows = done.select("entry_id", "content_hash", F.lit(as_of).cast("timestamp").alias("indexed_at"), F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"))
    return added, state.join(ids, "entry_id", "left_anti").unionByName(rows, allowMissingColumns=True)


def latest_state(log: DataFrame) -> DataFrame:
    """The state table from an append-only log: each entry's last row; of rows of one time the one with the largest hash."""
    last = log.groupBy("entry_id").agg(F.max(F.struct("indexed_at", "content_hash", "status")).alias("s"))
    return last.select("entry_id", "s.content_hash", "s.status", "s.indexed_at")


def failure_cause(reason):
    """Digits become N, so that causes can be counted; at most 120 bytes, ending with a character, and an ellipsis."""
    c = F.trim(F.regexp_replace(reason, r"[0-9]+", "N"))
    return F.when(F.octet_length(c) > 120, F.concat(truncate_bytes(c, 120), F.lit("..."))).otherwise(c)


def passages_of(passages: DataFrame, entry_id: int) -> DataFrame:
    return passages.filter(F.col("entry_id") == entry_id).orderBy("ordinal")


def passages_per_entry(passages: DataFrame, entries: DataFrame) -> DataFrame:
    n = passages.agg(F.count("*").alias("p"))
    return entries.agg(F.count("*").alias("e")).join(F.broadcast(n)).select(F.round(F.try_divide("p", "e"), 6).alias("per_entry"))


def reindex_time(entries: DataFrame, per_entry: float = 13, per_second: float = 33.9) -> DataFrame:
    """entries, seconds: one row, how long indexing all entries takes at a rate of passages."""
    n = entries.agg(F.count("*").alias("entries"))
    return n.select((F.col("entries") * per_entry / per_second).alias("seconds"), "entries")
