"""Lists of a user's things, probes for whether something exists, counts of accounts, schedules."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window



def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """The rows with their place in the list from 1 on, as ``position``; for lists of one user's things, which are short."""
    return df.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def categories_of(categories: DataFrame, user_id: int) -> DataFrame:
    return numbered(categories.filter(F.col("user_id") == user_id), F.col("title"), F.col("category_id"))


def users_list(users: DataFrame) -> DataFrame:
    return numbered(users, F.col("username"), F.col("user_id"))


def keys_of(keys: DataFrame, user_id: int) -> DataFrame:
    return numbered(keys.filter(F.col("user_id") == user_id), F.col("description"), F.col("key_id"))


def sessions_of(sessions: DataFrame, user_id: int) -> DataFrame:
    """Newest first."""
    return numbered(sessions.filter(F.col("user_id") == user_id), F.desc("created_at"), F.col("session_id"))


def exists(df: DataFrame, *conditions: Column) -> DataFrame:
    """One row: whether any row holds all conditions. At most one row leaves the scan."""
    for c in conditions:
        df = df.filter(c)
    return df.limit(1).agg((F.count("*") > 0).alias("found"))


def category_exists(categories: DataFrame, user_id: int, category_id: int) -> DataFrame:
    return exists(categories, F.col("user_id") == user_id, F.col("category_id") == category_id)


def category_title_taken(categories: DataFrame, user_id: int, title: str, other_than: int = 0) -> DataFrame:
    """Whether a category of the user has the title, whatever the case; ``other_than`` leaves out the one being renamed."""
    return exists(categories, F.col("user_id") == user_id, F.lower("title") == title.lower(), F.col("category_id") != other_than)


def feed_exists(feeds: DataFrame, user_id: int, feed_id: int) -> DataFrame:
    return exists(feeds, F.col("user_id") == user_id, F.col("feed_id") == feed_id)


def feed_url_taken(feeds: DataFrame, user_id: int, url: str, other_than: int = 0) -> DataFrame:
    return exists(feeds, F.col("user_id") == user_id, F.col("feed_url") == url, F.col("feed_id") != other_than)


def username_taken(users: DataFrame, username: str, other_than: int = 0) -> DataFrame:
    return exists(users, F.lower("username") == username.lower(), F.col("user_id") != other_than)


def key_taken(keys: DataFrame, user_id: int, description: str) -> DataFrame:
    return exists(keys, F.col("user_id") == user_id, F.lower("description") == description.lower())


def account_counts(users: DataFrame, keys: DataFrame) -> DataFrame:
    """One row: users, keys, users with a key. Two sums of one row each are joined."""
    own = keys.agg(F.count("*").alias("keys"), F.count_distinct("user_id").alias("users_with_key"))
    return users.agg(F.count("*").alias("users")).join(F.broadcast(own))


def users_with(users: DataFrame, integrations: DataFrame, enabled: Column) -> DataFrame:
    """Users whose settings hold ``enabled``; those without settings don't, so the join is an inner one."""
    return users.join(integrations.filter(enabled), "user_id")


def has_integration(integrations: DataFrame, user_id: int, columns: list[str]) -> DataFrame:
    """One row: whether the user has any of the services enabled."""
    any_on = F.lit(False)
    for c in columns:
        any_on = any_on | F.col(c)
    return exists(integrations, F.col("user_id") == user_id, any_on)


def in_window(at: Column, start: int, end: int) -> Column:
    """Whether the hour of ``at`` lies from ``start`` on before ``end``; past midnight if that is less; always if they are equal."""
    if start == end:
        return F.lit(True)
    hour = F.hour(at)
    return (hour >= start) & (hour < end) if start < end else (hour >= start) | (hour < end)


def stored_reading_time(incoming: DataFrame, entries: DataFrame, fresh: Column) -> DataFrame:
    """``incoming`` with reading_time: that of the stored entry of the same feed and hash, else ``fresh``."""
    known = entries.select("feed_id", "hash", F.col("reading_time").alias("_known")).dropDuplicates(["feed_id", "hash"])
    return incoming.join(known, ["feed_id", "hash"], "left").withColumn("reading_time", F.coalesce("_known", fresh)).drop("_known")


def statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """table, files, bytes, rows of tables that are read from files; one pass over the files' metadata and a count, no values."""
    out = None
    for name, df in tables.items():
        files = df.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s")).groupBy("p", "s").agg(F.count("*").alias("n"))
        row = files.agg(F.lit(name).alias("table"), F.count("*").alias("files"), F.coalesce(F.sum("s"), F.lit(-1)).alias("bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
        out = row if out is None else out.unionByName(row)
    return out


def sessions_before(sessions: DataFrame, as_of: datetime, days: int) -> DataFrame:
    return sessions.filter(F.col("created_at") < F.lit(as_of) - F.make_interval(days=F.lit(max(days, 1))))
