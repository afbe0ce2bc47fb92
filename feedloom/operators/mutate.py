"""Changes as pure functions from snapshot to snapshot: each takes DataFrames and returns new ones, to be written or not."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.sources.corpus import Corpus

KEY = ["feed_id", "hash"]
#: Lists of ids up to this length are literals in the plan; longer ones are joined.
LITERALS = 1000


def change(df: DataFrame, when: Column, **columns) -> DataFrame:
    """``df`` with new values where ``when`` holds (not where it is null)."""
    hit = F.coalesce(when, F.lit(False))
    return df.withColumns({c: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in columns.items()})


def among(df: DataFrame, column: str, values: Sequence) -> tuple[DataFrame, Column]:
    """A predicate for membership in a list, which is joined if it is long."""
    if len(values) <= LITERALS:
        return df, F.col(column).isin(*values) if values else F.lit(False)
    mark = df.sparkSession.createDataFrame([(v,) for v in set(values)], f"{column} {dict(df.dtypes)[column]}").withColumn("_among", F.lit(True))
    return df.join(mark, column, "left"), F.coalesce("_among", F.lit(False))


def first_of(df: DataFrame, key: Sequence[str], *order: str) -> DataFrame:
    """One row of each key, the first by those columns of ``order`` that there are, nulls last: the same one however the rows are dealt."""
    by = [F.col(c).asc_nulls_last() for c in order if c in df.columns]
    if not by:
        return df.dropDuplicates(list(key))
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*by))).filter("_rank = 1").drop("_rank")


#: Of rows with the same feed and hash the earliest comes first.
EARLIEST = ("published_at", "entry_id")


def by_key(df: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """``df`` joined with the rows of ``other`` that have its feed and hash; the hash of an entry without text is null, and nulls are equal. ``other``'s key goes."""
    keys = [f"_key_{k}" for k in KEY]
    same = F.col(KEY[0]).eqNullSafe(F.col(keys[0])) & F.col(KEY[1]).eqNullSafe(F.col(keys[1]))
    return df.join(other.withColumnsRenamed(dict(zip(KEY, keys, strict=True))), same, how).drop(*keys)


def new_entries(incoming: DataFrame, entries: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Rows of ``incoming`` that are neither stored nor deleted before; of each feed and hash the earliest."""
    return by_key(by_key(first_of(incoming, KEY, *EARLIEST), entries.select(*KEY), "left_anti"), tombstones.select(*KEY), "left_anti")


#: What a refresh brings to a stored entry; its published_at stays.
REFRESHED = ("title", "url", "comments_url", "content", "author", "reading_time", "tags", "language")


def refresh(entries: DataFrame, incoming: DataFrame, tombstones: DataFrame, update_existing: bool = True, fields: Sequence[str] = REFRESHED) -> tuple[DataFrame, DataFrame]:
    """(the new snapshot, the newly inserted rows). Stored rows take ``fields`` (those that there are) from incoming ones, but keep published_at."""
    fresh = new_entries(incoming, entries, tombstones)
    kept = entries
    if update_existing:
        taken = [f for f in fields if f in entries.columns and f in incoming.columns]
        new = first_of(incoming, KEY, *EARLIEST).select(*KEY, F.lit(True).alias("_new"), *(F.col(f).alias(f"_new_{f}") for f in taken))
        kept = by_key(entries, new, "left").withColumns({f: F.when(F.col("_new"), F.col(f"_new_{f}")).otherwise(F.col(f)) for f in taken}).select(*entries.columns)
    return kept.unionByName(fresh.select(*entries.columns)), fresh


def refresh_with_enclosures(entries: DataFrame, incoming: DataFrame, tombstones: DataFrame, enclosures: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, the newly inserted ones, enclosures) after a refresh. listed: feed_id, hash and the columns of enclosures; a stored
    entry that came again keeps the enclosures that are listed still, and gets those that are new."""
    snapshot, fresh = refresh(entries, incoming, tombstones)
    ids = by_key(snapshot, incoming.select(*KEY).distinct(), "left_semi").select(*KEY, "entry_id")
    current = by_key(listed.drop("entry_id"), ids, "inner").select(*enclosures.columns)
    kept = sync_enclosures(enclosures, current, ids)
    return snapshot, fresh, insert_enclosures(kept, current)


def insert_entry(entries: DataFrame, entry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, one row: entry_id, created): a single entry is inserted unless its feed has the hash already."""
    old = entries.select(*KEY, F.col("entry_id").alias("_old"))
    found = by_key(entry, old, "left").select(F.coalesce("_old", "entry_id").alias("entry_id"), F.col("_old").isNull().alias("created"))
    return entries.unionByName(by_key(entry, entries.select(*KEY), "left_anti").select(*entries.columns)), found


def archive(entries: DataFrame, tombstones: DataFrame, status: str, as_of: datetime, days: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """(entries, tombstones) after the oldest unstarred, unshared ones of a status are deleted; nothing if a limit is off."""
    if days < 0 or limit <= 0:
        return entries, tombstones
    old = F.col("created_at") < F.lit(as_of) - F.make_interval(days=F.lit(max(days, 1)))
    gone = entries.filter((F.col("status") == status) & ~F.col("starred") & (F.col("share_code") == "") & old).orderBy("created_at", "entry_id").limit(limit)
    return _delete(entries, tombstones, gone, as_of)


def flush_history(entries: DataFrame, tombstones: DataFrame, user_id: int, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    gone = entries.filter((F.col("user_id") == user_id) & (F.col("status") == "read") & ~F.col("starred") & (F.col("share_code") == ""))
    return _delete(entries, tombstones, gone, as_of)


def _delete(entries: DataFrame, tombstones: DataFrame, gone: DataFrame, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    marks = gone.filter("hash <> ''").select(*KEY, F.lit(as_of).cast("timestamp").alias("deleted_at"))
    return entries.join(gone.select("entry_id"), "entry_id", "left_anti"), tombstones.unionByName(marks).groupBy(*KEY).agg(F.min("deleted_at").alias("deleted_at"))


def set_status(entries: DataFrame, user_id: int, ids: Sequence[int], status: str, as_of: datetime) -> DataFrame:
    df, hit = among(entries, "entry_id", ids)
    return change(df, (F.col("user_id") == user_id) & hit, status=status, changed_at=F.lit(as_of)).select(*entries.columns)


def set_status_count_visible(corpus: Corpus, user_id: int, ids: Sequence[int]) -> DataFrame:
    """How many of the changed entries are visible: neither feed nor category hide globally."""
    df, hit = among(corpus.entries.filter(F.col("user_id") == user_id), "entry_id", ids)
    return df.filter(hit).join(visible_feeds(corpus), "feed_id", "left_semi").agg(F.count("*").alias("n"))


def visible_feeds(corpus: Corpus) -> DataFrame:
    shown = corpus.categories.filter(~F.col("hide_globally")).select("category_id")
    return corpus.feeds.filter(~F.col("hide_globally")).join(shown, "category_id", "left_semi").select("feed_id")


def set_starred(entries: DataFrame, user_id: int, ids: Sequence[int], value: bool, as_of: datetime) -> DataFrame:
    df, hit = among(entries, "entry_id", ids)
    return change(df, (F.col("user_id") == user_id) & hit, starred=value, changed_at=F.lit(as_of)).select(*entries.columns)


def toggle_starred(entries: DataFrame, user_id: int, entry_id: int, as_of: datetime) -> DataFrame:
    return change(entries, (F.col("user_id") == user_id) & (F.col("entry_id") == entry_id), starred=~F.col("starred"), changed_at=F.lit(as_of))


def set_hidden(entries: DataFrame, user_id: int, ids: Sequence[int], value: bool, as_of: datetime, reason: str | None = None) -> DataFrame:
    """The reason is kept only with hidden; lists of more than one id count as bulk if no reason is given."""
    reason = reason if reason is not None else "bulk" if len(ids) > 1 else None
    df, hit = among(entries, "entry_id", ids)
    kept = reason if value and reason else None
    return change(df, (F.col("user_id") == user_id) & hit, hidden=value, hidden_reason=F.lit(kept).cast("string"), changed_at=F.lit(as_of)).select(*entries.columns)


def toggle_hidden(entries: DataFrame, user_id: int, entry_id: int, as_of: datetime) -> DataFrame:
    mine = (F.col("user_id") == user_id) & (F.col("entry_id") == entry_id)
    return change(entries, mine, hidden=~F.col("hidden"), hidden_reason=F.lit(None).cast("string"), changed_at=F.lit(as_of))


def mark_read(entries: DataFrame, user_id: int, as_of: datetime, before: datetime | None = None, feed_id: int | None = None) -> DataFrame:
    """Unread to read: all of a user, before a time (strictly), of a feed."""
    hit = (F.col("user_id") == user_id) & (F.col("status") == "unread")
    hit = hit & (F.col("published_at") < F.lit(before)) if before is not None else hit
    hit = hit & (F.col("feed_id") == feed_id) if feed_id is not None else hit
    return change(entries, hit, status="read", changed_at=F.lit(as_of))


def _with_feeds(entries: DataFrame, feed_ids: DataFrame) -> DataFrame:
    return entries.join(feed_ids.select("feed_id").distinct().withColumn("_in", F.lit(True)), "feed_id", "left")


def mark_category_read(corpus: Corpus, user_id: int, category_id: int, before: datetime, as_of: datetime) -> DataFrame:
    """The feeds are those of the user in the category; entries follow their feed."""
    feeds = corpus.feeds.filter((F.col("user_id") == user_id) & (F.col("category_id") == category_id))
    hit = F.col("_in") & (F.col("status") == "unread") & (F.col("published_at") < F.lit(before))
    return change(_with_feeds(corpus.entries, feeds), hit, status="read", changed_at=F.lit(as_of)).select(*corpus.entries.columns)


def mark_visible_read(corpus: Corpus, user_id: int, before: datetime, as_of: datetime) -> DataFrame:
    hit = F.col("_in") & (F.col("user_id") == user_id) & (F.col("status") == "unread") & (F.col("published_at") < F.lit(before))
    return change(_with_feeds(corpus.entries, visible_feeds(corpus)), hit, status="read", changed_at=F.lit(as_of)).select(*corpus.entries.columns)


def hide_feed_backlog(entries: DataFrame, user_id: int, feed_id: int, as_of: datetime) -> DataFrame:
    """Every entry of the feed, whatever its status."""
    return change(entries, (F.col("user_id") == user_id) & (F.col("feed_id") == feed_id), hidden=True, hidden_reason="bulk", changed_at=F.lit(as_of))


def hide_unread(corpus: Corpus, user_id: int, before: datetime, as_of: datetime, feed_id: int | None = None, category_id: int | None = None, visible: bool = False) -> DataFrame:
    """Unread, not hidden entries before a time: of a feed, of a category, or of all feeds that are globally visible."""
    hit = (F.col("user_id") == user_id) & (F.col("status") == "unread") & ~F.col("hidden") & (F.col("published_at") < F.lit(before))
    df = corpus.entries
    if feed_id is not None:
        hit = hit & (F.col("feed_id") == feed_id)
    if category_id is not None or visible:
        feeds = visible_feeds(corpus) if visible else corpus.feeds.filter((F.col("user_id") == user_id) & (F.col("category_id") == category_id))
        df, hit = _with_feeds(df, feeds), hit & F.col("_in")
    return change(df, hit, hidden=True, hidden_reason="bulk", changed_at=F.lit(as_of)).select(*corpus.entries.columns)


def set_full_text_fetched(entries: DataFrame, ids: Sequence[int], as_of: datetime) -> DataFrame:
    df, hit = among(entries, "entry_id", ids)
    return change(df, hit, full_text_fetched_at=F.lit(as_of)).select(*entries.columns)


def set_full_text_fetched_by_hash(entries: DataFrame, feed_id: int, hashes: Sequence[str], as_of: datetime) -> DataFrame:
    """Hashes that the feed doesn't have are ignored; without any nothing changes."""
    df, hit = among(entries, "hash", hashes)
    return change(df, hit & (F.col("feed_id") == feed_id), full_text_fetched_at=F.lit(as_of)).select(*entries.columns)


def update_text(entries: DataFrame, entry_id: int, title: str, content: str) -> DataFrame:
    return change(entries, F.col("entry_id") == entry_id, title=title, content=content)


def share(entries: DataFrame, user_id: int, entry_id: int) -> DataFrame:
    """A share code of 20 bytes in hex, made once; here from the entry, so that a lost task makes the same again."""
    code = F.substring(F.sha2(F.concat_ws("|", F.lit("share"), "user_id", "entry_id", "hash"), 256), 1, 40)
    return change(entries, (F.col("user_id") == user_id) & (F.col("entry_id") == entry_id) & (F.col("share_code") == ""), share_code=code)


def unshare(entries: DataFrame, user_id: int, entry_id: int) -> DataFrame:
    return change(entries, (F.col("user_id") == user_id) & (F.col("entry_id") == entry_id), share_code="")


def latest(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The last row of each key by ``order``: upserts as an append-only log read back."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def insert_enclosures(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """URLs are trimmed, empty ones left out, and those that an entry has are ignored; of equal ones the smallest id comes in."""
    key = ["user_id", "entry_id", "url"]
    new = first_of(incoming.withColumn("url", F.trim("url")).filter("url <> ''"), key, "enclosure_id").join(stored.select(*key), key, "left_anti")
    return stored.unionByName(new.select(*stored.columns))


def sync_enclosures(stored: DataFrame, current: DataFrame, entry_ids: DataFrame) -> DataFrame:
    """For the entries given, only enclosures that are still listed stay; none listed, none stay."""
    mine = stored.join(entry_ids.select("entry_id").distinct(), "entry_id", "left_semi").join(current.select("entry_id", "url").distinct(), ["entry_id", "url"], "left_anti")
    return stored.join(mine.select("enclosure_id"), "enclosure_id", "left_anti")


def dedup_enclosures(stored: DataFrame) -> DataFrame:
    """Of equal (user, entry, url) the largest id stays."""
    last = stored.groupBy("user_id", "entry_id", "url").agg(F.max("enclosure_id").alias("enclosure_id"))
    return stored.join(last.select("enclosure_id"), "enclosure_id", "left_semi")


def enclosures_by_entry(enclosures: DataFrame, entry_ids: DataFrame) -> DataFrame:
    """entry_id, enclosures: the list of each entry by id."""
    mine = enclosures.join(entry_ids.select("entry_id").distinct(), "entry_id", "left_semi")
    item = F.struct("enclosure_id", "url", "mime_type", "size", "media_progression")
    return mine.groupBy("entry_id").agg(F.array_sort(F.collect_list(item)).alias("enclosures"))


def set_progress(enclosures: DataFrame, enclosure_id: int, seconds: int) -> DataFrame:
    return change(enclosures, F.col("enclosure_id") == enclosure_id, media_progression=F.lit(seconds).cast("long"))


def create_category(categories: DataFrame, user_id: int, category_id: int, title: str) -> DataFrame:
    new = categories.sparkSession.createDataFrame([(category_id, user_id, title, False)], categories.select("category_id", "user_id", "title", "hide_globally").schema)
    taken = categories.filter((F.col("user_id") == user_id) & (F.lower("title") == title.lower())).select("user_id")
    return categories.unionByName(new.join(taken, "user_id", "left_anti"))


def update_category(categories: DataFrame, user_id: int, category_id: int, title: str, hide_globally: bool) -> DataFrame:
    """Renamed, unless another category of the user has the title, whatever the case."""
    other = categories.filter((F.col("user_id") == user_id) & (F.lower("title") == title.lower()) & (F.col("category_id") != category_id)).limit(1).agg((F.count("*") == 0).alias("_free"))
    mine = (F.col("user_id") == user_id) & (F.col("category_id") == category_id)
    return change(categories.join(F.broadcast(other)), mine & F.col("_free"), title=title, hide_globally=hide_globally).drop("_free")


def remove_categories(corpus: Corpus, user_id: int, ids: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """(categories, feeds): feeds move to the user's first remaining category by title; without one nothing changes."""
    gone = F.col("category_id").isin(*ids) & (F.col("user_id") == user_id)
    rest = corpus.categories.filter(~gone & (F.col("user_id") == user_id)).agg(F.min(F.struct("title", "category_id"))["category_id"].alias("_home"))
    feeds = corpus.feeds.join(F.broadcast(rest))
    feeds = change(feeds, gone & F.col("_home").isNotNull(), category_id=F.col("_home")).drop("_home")
    categories = corpus.categories.join(F.broadcast(rest)).filter(~gone | F.col("_home").isNull()).drop("_home")
    return categories, feeds


def get_or_create_saved_feed(feeds: DataFrame, user_id: int, feed_id: int, category_id: int) -> DataFrame:
    """The synthetic feed of saved pages, once a user."""
    url = f"internal://saved-pages/user/{user_id}"
    new = feeds.sparkSession.createDataFrame([(feed_id, user_id, category_id, url, "Saved pages")], "feed_id long, user_id long, category_id long, feed_url string, title string")
    new = new.join(feeds.select("user_id", "feed_url"), ["user_id", "feed_url"], "left_anti")
    return feeds.unionByName(new, allowMissingColumns=True)


def remove_feed(corpus: Corpus, enclosures: DataFrame, feed_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(feeds, entries, enclosures) without the feed, its entries and what hangs on them."""
    kept = corpus.entries.filter(F.col("feed_id") != feed_id)
    gone = corpus.entries.filter(F.col("feed_id") == feed_id).select("entry_id")
    return corpus.feeds.filter(F.col("feed_id") != feed_id), kept, enclosures.join(gone, "entry_id", "left_anti")


def create_feed(feeds: DataFrame, entries: DataFrame, feed: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(feeds, entries) with the feed and those of its entries whose hash is new."""
    first = by_key(first_of(incoming, KEY, *EARLIEST), entries.select(*KEY), "left_anti")
    return feeds.unionByName(feed, allowMissingColumns=True), entries.unionByName(first.select(*entries.columns))


def update_feed(feeds: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` (feed_id, user_id and any other columns of feeds) replace those columns of the feeds that they name."""
    columns = [c for c in new.columns if c not in ("feed_id", "user_id")]
    rows = new.select("feed_id", "user_id", F.lit(True).alias("_new"), *(F.col(c).alias(f"_new_{c}") for c in columns))
    joined = feeds.join(rows, ["feed_id", "user_id"], "left")
    return joined.withColumns({c: F.when(F.col("_new"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}).select(*feeds.columns)


def record_feed_error(feeds: DataFrame, feed_id: int, message: str) -> DataFrame:
    return change(feeds, F.col("feed_id") == feed_id, parsing_error_count=F.col("parsing_error_count") + 1, parsing_error_message=message)


def reset_feed_errors(feeds: DataFrame) -> DataFrame:
    return feeds.withColumn("parsing_error_count", F.lit(0)).withColumn("parsing_error_message", F.lit(""))


def reset_next_check(feeds: DataFrame, as_of: datetime) -> DataFrame:
    return feeds.withColumn("next_check_at", F.lit(as_of).cast("timestamp"))


def store_icons(icons: DataFrame, feed_icons: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(icons, links). incoming: feed_id, icon_id, hash, mime_type, content; equal content is stored once, links are replaced."""
    new = first_of(incoming, ["hash"], "icon_id").join(icons.select("hash"), "hash", "left_anti")
    icons = icons.unionByName(new.select(*icons.columns), allowMissingColumns=True)
    links = incoming.select("feed_id", "hash").join(icons.select("hash", "icon_id"), "hash").select("feed_id", "icon_id").groupBy("feed_id").agg(F.min("icon_id").alias("icon_id"))
    return icons, feed_icons.join(links.select("feed_id"), "feed_id", "left_anti").unionByName(links)


def without_orphan_icons(icons: DataFrame, feed_icons: DataFrame) -> DataFrame:
    return icons.join(feed_icons.select("icon_id"), "icon_id", "left_semi")


def icons_of_user(icons: DataFrame, feed_icons: DataFrame, feeds: DataFrame, user_id: int) -> DataFrame:
    mine = feed_icons.join(feeds.filter(F.col("user_id") == user_id).select("feed_id"), "feed_id", "left_semi")
    return icons.join(mine.select("icon_id"), "icon_id", "left_semi")


def without_old_sessions(sessions: DataFrame, as_of: datetime, days: int) -> DataFrame:
    return sessions.filter(F.col("created_at") >= F.lit(as_of) - F.make_interval(days=F.lit(max(days, 1))))


def opml(feeds: DataFrame, categories: DataFrame) -> DataFrame:
    """category, outline: one OPML outline for each category with its subscriptions, by title."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&#34;"))
    item = F.concat(F.lit('<outline title="'), esc(F.col("title")), F.lit('" text="'), esc(F.col("title")), F.lit('" xmlUrl="'), esc(F.col("feed_url")), F.lit('" htmlUrl="'), esc(F.col("site_url")), F.lit('" type="rss"/>'))
    items = feeds.select("category_id", F.struct(F.lower("title").alias("k"), item.alias("x")).alias("s")).groupBy("category_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    joined = items.join(categories.select("category_id", F.col("title").alias("category")), "category_id")
    body = F.concat_ws("", F.transform("s", lambda x: x["x"]))
    return joined.select("category", F.concat(F.lit('<outline text="'), esc(F.col("category")), F.lit('">'), body, F.lit("</outline>")).alias("outline"))
