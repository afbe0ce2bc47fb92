"""The shared Parquet tables seen as the corpus: entries, feeds, categories, users, passages, index state, tombstones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1_704_067_200  # 2024-01-01 UTC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at(seconds) -> F.Column:
    return F.timestamp_seconds(F.lit(EPOCH) + seconds)


@dataclass(frozen=True)
class Corpus:
    entries: DataFrame
    feeds: DataFrame
    categories: DataFrame
    users: DataFrame


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        d.alias("entry_id"),
        (d % 3 + 1).alias("user_id"),
        (F.substring("source", 4, 9).cast("long") * 3 + d % 3).alias("feed_id"),
        F.sha2("text", 256).alias("hash"),
        F.substring("text", 1, 60).alias("title"),
        F.concat(F.lit("https://example.org/"), "source", F.lit("/"), d.cast("string")).alias("url"),
        F.lit("").alias("comments_url"),
        F.concat(F.lit("author"), (d % 17).cast("string")).alias("author"),
        F.col("text").alias("content"),
        F.when(d % 5 == 0, "read").otherwise("unread").alias("status"),
        (d % 7 == 0).alias("starred"),
        (d % 11 == 0).alias("hidden"),
        F.when(d % 22 == 0, "bulk").alias("hidden_reason"),
        F.when(d % 13 == 0, F.concat(F.lit("share"), d.cast("string"))).otherwise("").alias("share_code"),
        at(d * 60).alias("published_at"),
        at(d * 60).alias("created_at"),
        at(d * 60 + d % 7 * 3600).alias("changed_at"),
        F.array("lang", "source").alias("tags"),
        F.col("lang").alias("language"),
        F.when(d % 4 == 0, at(d * 60)).alias("full_text_fetched_at"),
        (F.length("text") % 40 + 1).cast("int").alias("reading_time"),
    )


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("feed_id")
    ids = entries(spark, sf_dir).select("feed_id").distinct()
    return ids.select(
        f,
        (f % 3 + 1).alias("user_id"),
        ((f % 3 + 1) * 10 + f % 6).alias("category_id"),
        F.concat(F.lit("Feed "), f.cast("string")).alias("title"),
        F.concat(F.lit("https://h"), (f % 5).cast("string"), F.lit(".example.org/feed/"), f.cast("string")).alias("feed_url"),
        F.concat(F.lit("https://h"), (f % 5).cast("string"), F.lit(".example.org/")).alias("site_url"),
        (f % 10 == 9).alias("disabled"),
        (f % 8 == 7).alias("hide_globally"),
        (f % 4).cast("int").alias("parsing_error_count"),
        at(f * 3600).alias("next_check_at"),
        F.when(f % 2 == 0, f).alias("icon_id"),
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("category_id")
    ids = feeds(spark, sf_dir).select("category_id", "user_id").distinct()
    return ids.select(c, "user_id", F.concat(F.lit("Category "), c.cast("string")).alias("title"), (c % 10 == 5).alias("hide_globally"))


def users(spark: SparkSession) -> DataFrame:
    rows = [(1, "anna", "UTC", 265, 500), (2, "bo", "Europe/Paris", 265, 500), (3, "chris", "America/New_York", 200, 400)]
    return spark.createDataFrame(rows, "user_id long, username string, timezone string, default_reading_speed int, cjk_reading_speed int")


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus(entries(spark, sf_dir), feeds(spark, sf_dir), categories(spark, sf_dir), users(spark))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as passages of entries, five an entry."""
    v = F.col("vec_id").cast("long")
    return table(spark, sf_dir, "embeddings").select(v.alias("passage_id"), F.expr("CAST(vec_id AS BIGINT) div 5").alias("entry_id"), (v % 5).cast("int").alias("ordinal"), "embedding", "label")


def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entries(spark, sf_dir).filter("entry_id % 9 = 0")
    return e.select("feed_id", "hash", F.col("published_at").alias("deleted_at"))


def index_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries up to some id as they were indexed: every 6th failed, every 8th with an old hash."""
    e = entries(spark, sf_dir).filter("entry_id % 4 <> 3")
    return e.select(
        "entry_id",
        F.when(F.col("entry_id") % 8 == 0, F.lit("old")).otherwise(F.md5(F.concat(F.lit("v3|hash@1#64|"), "title", "content"))).alias("content_hash"),
        F.col("published_at").alias("indexed_at"),
        F.when(F.col("entry_id") % 6 == 0, "failed").when(F.col("entry_id") % 10 == 1, "skipped").otherwise("ok").alias("status"),
    )


def enclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments of every third entry; some have two, and of these some have the same one twice."""
    e = F.col("entry_id")
    name = lambda kind: F.concat(F.lit("https://cdn.example.org/"), e.cast("string"), F.lit(kind))
    first = F.struct((e * 2).alias("enclosure_id"), name(".mp3").alias("url"), F.when(e % 6 == 0, "audio/mpeg").otherwise("application/octet-stream").alias("mime_type"), (e * 10).alias("size"), (e % 4 * 30).alias("media_progression"))
    second = F.struct((e * 2 + 1).alias("enclosure_id"), F.when(e % 18 == 0, name(".mp3")).otherwise(name(".PNG")).alias("url"), F.lit("video/m4v").alias("mime_type"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("media_progression"))
    both = F.when(e % 9 == 0, F.array(first, second)).otherwise(F.array(first))
    rows = entries(spark, sf_dir).filter(e % 3 == 0).select("user_id", "entry_id", F.explode(both).alias("x"))
    return rows.select("x.enclosure_id", "user_id", "entry_id", "x.url", "x.mime_type", "x.size", "x.media_progression")


def icons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The icons that feeds are linked to, and one that none is linked to for each of these."""
    i = F.col("icon_id")
    ids = feed_icons(spark, sf_dir).select("icon_id").distinct()
    ids = ids.unionByName(ids.select((i + 1_000_000).alias("icon_id")))
    content = F.concat(F.lit("icon"), i.cast("string"))
    kind = F.element_at(F.array(*map(F.lit, ("image/png", "IMAGE/GIF", "text/html", "image/svg+xml"))), (i % 4 + 1).cast("int"))
    return ids.select(i, F.sha2(content, 256).alias("hash"), kind.alias("mime_type"), content.cast("binary").alias("content"), F.when(i % 6 == 0, "").otherwise(F.concat(F.lit("x"), i.cast("string"))).alias("external_id"))


def feed_icons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds(spark, sf_dir).filter("icon_id IS NOT NULL").select("feed_id", "icon_id")


def accounts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(users, integrations, API keys, sessions): customers as users, three of four with settings, their orders as keys, events as sessions."""
    c, o, e = (table(spark, sf_dir, name) for name in ("customer", "orders", "events"))
    user = (F.col("c_custkey") + 1).alias("user_id")
    integrations = c.filter("c_custkey % 4 <> 3").select(user, (F.col("c_nationkey") % 2 == 0).alias("read_later"), (F.col("c_acctbal") < 0).alias("webhook"))
    keys = o.select(F.col("o_orderkey").alias("key_id"), (F.col("o_custkey") + 1).alias("user_id"), F.concat("o_orderpriority", F.lit(" "), F.col("o_orderkey").cast("string")).alias("description"))
    sessions = e.select(F.col("event_id").alias("session_id"), "user_id", F.col("ts").cast("timestamp").alias("created_at"))
    return c.select(user, F.lower("c_name").alias("username")), integrations, keys, sessions


def passage_texts(spark: SparkSession, sf_dir: str, sentences: int = 4) -> DataFrame:
    """Passages of every entry: its title as ordinal 0, and its text cut after every so many lines."""
    e = entries(spark, sf_dir)
    lines = F.split(F.coalesce("content", F.lit("")), "\n")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size(lines) - 1, F.lit(0)), F.lit(sentences)), lambda i: F.array_join(F.slice(lines, i + 1, F.lit(sentences)), "\n"))
    parts = e.select("entry_id", F.posexplode(F.concat(F.array("title"), cut)).alias("ordinal", "text"))
    return parts.select((F.col("entry_id") * 100_000 + F.col("ordinal")).alias("passage_id"), "entry_id", "ordinal", F.when(F.col("ordinal") == 0, "title").otherwise("content").alias("source"), "text")
