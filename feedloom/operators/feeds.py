"""Feed, category and counter queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.operators.lists import has_integration
from feedloom.sources.corpus import Corpus


def status_counts(entries: DataFrame) -> DataFrame:
    """status, n for read, unread and total; 0 where there are none."""
    one = entries.agg(F.count_if(F.col("status") == "read").alias("read"), F.count_if(F.col("status") == "unread").alias("unread"), F.count("*").alias("total"))
    return one.select(F.expr("stack(3, 'read', read, 'unread', unread, 'total', total) AS (status, n)"))


def feed_totals(feeds: DataFrame) -> DataFrame:
    return feeds.agg(F.count_if("disabled").alias("disabled"), F.count_if(~F.col("disabled")).alias("enabled"), F.count("*").alias("total"))


def feeds_with_errors(feeds: DataFrame, limit: int = 1) -> DataFrame:
    return feeds.filter(F.col("parsing_error_count") >= max(limit, 1)).agg(F.count("*").alias("n"))


def feed_counters(entries: DataFrame, user_id: int | None = None) -> DataFrame:
    """feed_id, reads, unreads, visible; hidden unread entries don't count."""
    e = entries if user_id is None else entries.filter(F.col("user_id") == user_id)
    e = e.filter((F.col("status") == "read") | ((F.col("status") == "unread") & ~F.col("hidden")))
    out = e.groupBy("feed_id").agg(F.count_if(F.col("status") == "read").alias("reads"), F.count_if(F.col("status") == "unread").alias("unreads"))
    return out.withColumn("visible", F.col("reads") + F.col("unreads"))


def feed_list(corpus: Corpus, user_id: int) -> DataFrame:
    """Feeds with category and counters: enabled first, most errors, most unread, title."""
    cats = corpus.categories.select("category_id", F.col("title").alias("category_title"))
    counts = feed_counters(corpus.entries, user_id)
    df = corpus.feeds.filter(F.col("user_id") == user_id).join(cats, "category_id", "left").join(counts, "feed_id", "left").fillna(0, ["reads", "unreads", "visible"])
    return df.orderBy("disabled", F.desc("parsing_error_count"), F.desc("unreads"), F.lower("title"), "feed_id")


def category_counts(corpus: Corpus, user_id: int, order: str = "") -> DataFrame:
    """category_id, title, feed_count, total_unread; both sums are made before they are joined.

    With an order, sorted and numbered (position): alphabetical, or else most unread first.
    """
    feeds = corpus.feeds.filter(F.col("user_id") == user_id)
    per_feed = feeds.groupBy("category_id").agg(F.count("*").alias("feed_count"))
    unread = corpus.entries.filter((F.col("user_id") == user_id) & (F.col("status") == "unread") & ~F.col("hidden")).groupBy("feed_id").agg(F.count("*").alias("n"))
    unread = feeds.join(unread, "feed_id").groupBy("category_id").agg(F.sum("n").alias("total_unread"))
    df = corpus.categories.filter(F.col("user_id") == user_id).join(per_feed, "category_id", "left").join(unread, "category_id", "left")
    df = df.select("category_id", "title", F.coalesce("feed_count", F.lit(0)).alias("feed_count"), F.coalesce("total_unread", F.lit(0)).alias("total_unread"))
    if not order:
        return df
    by = [F.col("title")] if order == "alphabetical" else [F.desc("total_unread"), F.col("title")]
    return df.withColumn("position", F.row_number().over(Window.orderBy(*by, "category_id"))).orderBy("position")


def navigation(corpus: Corpus, user_id: int, error_limit: int, integrations: DataFrame | None = None) -> DataFrame:
    """One row: visible unread entries, feeds with errors (0 if the limit is 0), and whether entries can be saved to any service."""
    feeds = corpus.feeds.filter(F.col("user_id") == user_id)
    shown = feeds.filter(~F.col("hide_globally")).join(corpus.categories.filter(~F.col("hide_globally")).select("category_id"), "category_id", "left_semi")
    unread = corpus.entries.filter((F.col("user_id") == user_id) & (F.col("status") == "unread") & ~F.col("hidden")).join(shown.select("feed_id"), "feed_id", "left_semi")
    if integrations is not None:
        unread_of = has_integration(integrations, user_id, [c for c in integrations.columns if c != "user_id"]).select(F.col("found").alias("has_save_entry"))
    errors = feeds.agg(F.count_if((F.col("parsing_error_count") >= max(error_limit, 1)) & F.lit(error_limit > 0)).alias("error_feeds"))
    one = unread.agg(F.count("*").alias("unread")).join(F.broadcast(errors))
    return one if integrations is None else one.join(F.broadcast(unread_of))


FEED_ORDERS = ("feed_id", "title", "feed_url", "site_url", "category_id", "parsing_error_count", "next_check_at", "disabled")


def feeds_sorted(feeds: DataFrame, user_id: int, order: str = "", direction: str = "asc") -> DataFrame:
    """A user's feeds numbered by an order, ties by title whatever the case; by id without one."""
    if order and order not in FEED_ORDERS or direction not in ("asc", "desc"):
        raise ValueError(f"order must be one of {', '.join(FEED_ORDERS)}")
    keys = [F.col(order) if direction == "asc" else F.desc(order), F.lower("title")] if order else []
    return feeds.filter(F.col("user_id") == user_id).withColumn("position", F.row_number().over(Window.orderBy(*keys, "feed_id"))).orderBy("position")


def feed_rows(corpus: Corpus, feed_icons: DataFrame, icons: DataFrame, user_id: int) -> DataFrame:
    """Feeds with category, icon and owner, all by left joins, and their counters."""
    f = corpus.feeds.filter(F.col("user_id") == user_id).drop("icon_id")
    f = f.join(corpus.categories.select("category_id", F.col("title").alias("category_title"), F.col("hide_globally").alias("category_hidden")), "category_id", "left")
    f = with_icons(f, feed_icons, icons).join(corpus.users.select("user_id", "username", "timezone"), "user_id", "left")
    return f.join(feed_counters(corpus.entries, user_id), "feed_id", "left").fillna(0, ["reads", "unreads", "visible"])


def with_icons(df: DataFrame, feed_icons: DataFrame, icons: DataFrame) -> DataFrame:
    """``df`` (with feed_id) with icon_id and icon: 0 and '' unless the feed has an icon that has an external id."""
    own = icons.select("icon_id", F.col("external_id").alias("_external"))
    joined = df.join(feed_icons.select("feed_id", "icon_id"), "feed_id", "left").join(own, "icon_id", "left")
    shown = F.coalesce(F.col("_external") != "", F.lit(False))
    return joined.withColumn("icon", F.when(shown, F.col("_external")).otherwise("")).withColumn("icon_id", F.when(shown, F.col("icon_id")).otherwise(0)).drop("_external")


def weekly_frequency(entries: DataFrame, as_of: datetime) -> DataFrame:
    """feed_id, per_week: a week over the mean distance of last week's entries; 0 with one entry or none, or no distance."""
    last = entries.filter((F.col("published_at") >= F.lit(as_of) - F.expr("INTERVAL 7 DAYS")) & (F.col("published_at") <= F.lit(as_of)))
    seconds = (F.unix_micros(F.max("published_at")) - F.unix_micros(F.min("published_at"))) / 1e6
    n = last.groupBy("feed_id").agg(F.count("*").alias("n"), seconds.alias("seconds"))
    step = F.expr("try_divide(604800, try_divide(seconds, n - 1))")
    return n.select("feed_id", F.coalesce(F.when(F.col("n") > 1, F.ceil(step)), F.lit(0)).cast("long").alias("per_week"))


def due_feeds(feeds: DataFrame, as_of: datetime, batch: int, error_limit: int = 0, per_host: int = 0, user_id: int | None = None, category_id: int | None = None) -> DataFrame:
    """feed_id, host of the feeds to refresh: the longest due first, cut to the batch, and only then capped by host."""
    df = feeds.filter((F.col("next_check_at") < F.lit(as_of)) & ~F.col("disabled"))
    df = df.filter(F.col("parsing_error_count") < error_limit) if error_limit > 0 else df
    df = df.filter(F.col("user_id") == user_id) if user_id else df
    df = df.filter(F.col("category_id") == category_id) if category_id else df
    df = df.orderBy("next_check_at", "feed_id").limit(batch).withColumn("host", F.lower(F.try_parse_url("feed_url", F.lit("HOST"))))
    if per_host > 0:
        rank = F.row_number().over(Window.partitionBy("host").orderBy("next_check_at", "feed_id"))
        df = df.withColumn("rank", rank).filter(F.col("rank") <= per_host)
    return df.select("feed_id", "host")


def next_check(feeds: DataFrame, per_week: DataFrame, as_of: datetime, least: int = 5, most: int = 1440, factor: int = 1, round_robin: int = 0, delays: DataFrame | None = None) -> DataFrame:
    """feed_id, minutes, next_check_at by entry frequency, held between ``least`` and ``most`` minutes; with ``round_robin`` minutes, after
    these. A delay that a feed's server asked for (feed_id, delay in minutes) counts if it is longer, up to ``most``."""
    if round_robin > 0:
        df = feeds.select("feed_id", F.lit(round_robin).alias("minutes"))
    else:
        df = _by_frequency(feeds, per_week, least, most, factor)
    if delays is not None:
        df = df.join(delays.select("feed_id", "delay"), "feed_id", "left").select("feed_id", F.least(F.greatest("minutes", F.coalesce("delay", F.lit(0))), F.greatest("minutes", F.lit(most))).cast("int").alias("minutes"))
    return df.withColumn("next_check_at", F.timestamp_seconds(F.unix_timestamp(F.lit(as_of)) + F.col("minutes") * 60))


def _by_frequency(feeds: DataFrame, per_week: DataFrame, least: int, most: int, factor: int) -> DataFrame:
    df = feeds.select("feed_id").join(per_week, "feed_id", "left")
    minutes = F.when(F.coalesce("per_week", F.lit(0)) <= 0, F.lit(most)).otherwise(F.round(F.lit(7 * 24 * 60) / (F.col("per_week") * factor)).cast("int"))
    return df.select("feed_id", F.least(F.greatest(minutes, F.lit(least)), F.lit(most)).cast("int").alias("minutes"))


def host_failures(causes: DataFrame, most: int = 64) -> DataFrame:
    """cause, n: the ``most`` most frequent causes, all others as one; a top-k, then one sum."""
    n = causes.groupBy("cause").agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), "cause").limit(most)
    rest = n.join(top.select("cause"), "cause", "left_anti").agg(F.sum("n").alias("n")).filter("n > 0").select(F.lit("(other)").alias("cause"), "n")
    return top.unionByName(rest)


def ewma(df: DataFrame, key: str, order: str, value: str, alpha: float = 0.3) -> DataFrame:
    """key, ewma: values folded in order within each key (keys are workers or lanes, their series short)."""
    series = df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value].cast("double")).alias("v"))
    fold = F.aggregate(F.slice("v", F.lit(2), F.size("v")), F.get("v", 0), lambda a, x: a * (1 - alpha) + x * alpha)
    return series.select(key, fold.alias("ewma"))
