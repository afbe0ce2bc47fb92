"""What the API surfaces ask for, composed of the operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.entries import MAX_IDS, EntryQuery, from_parameters
from feedloom.sources.corpus import Corpus


def unread_page(corpus: Corpus, user_id: int, limit: int = 100, offset: int = 0) -> DataFrame:
    """The first page of the unread list: visible entries, newest first, without content."""
    q = EntryQuery(corpus, user_id).statuses("unread").unread_list_rule().globally_visible().sort("published_at", "desc").stable()
    return q.without_content().limit(limit).offset(offset).page()


def list_entries(corpus: Corpus, user_id: int, **parameters) -> DataFrame:
    return from_parameters(corpus, user_id, parameters).with_total()


def fever_items(corpus: Corpus, user_id: int, since_id: int = 0, max_id: int = 0, ids: tuple[int, ...] = (), size: int = 50) -> DataFrame:
    q = EntryQuery(corpus, user_id)
    q = q.ids(*ids) if ids else q.id_before(max_id).sort("id", "desc") if max_id else q.id_after(since_id).sort("id")
    df = q.limit(size).page()
    flag = lambda c: F.when(c, 1).otherwise(0)
    return df.select(F.col("entry_id").alias("id"), "feed_id", "title", "author", F.col("content").alias("html"), "url", flag(F.col("starred")).alias("is_saved"), flag(F.col("status") == "read").alias("is_read"), F.unix_timestamp("published_at").alias("created_on"))


def id_list(rows: DataFrame, column: str = "entry_id") -> DataFrame:
    """ids: all ids of a list, comma-joined, as the protocol wants them."""
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(column)), lambda x: x.cast("string")), ",").alias("ids"))


def fever_groups(feeds: DataFrame, user_id: int) -> DataFrame:
    df = feeds.filter(F.col("user_id") == user_id).groupBy(F.col("category_id").alias("group_id"))
    return df.agg(F.array_join(F.transform(F.array_sort(F.collect_list("feed_id")), lambda x: x.cast("string")), ",").alias("feed_ids"))


def reading_list(corpus: Corpus, user_id: int, after: datetime | None = None, before: datetime | None = None, exclude_read: bool = False, limit: int = 100, offset: int = 0, oldest_first: bool = False) -> DataFrame:
    q = EntryQuery(corpus, user_id).published(after, before).without_status("removed")
    q = q.without_status("read") if exclude_read else q
    return q.sort("published_at", "asc" if oldest_first else "desc").stable().limit(limit, MAX_IDS).offset(offset).ids_only()


def continuation(returned: int, offset: int, total: int) -> int:
    """The offset of the next page, 0 if there is none."""
    return returned + offset if returned + offset < total else 0


def pages(total: int, offset: int, size: int) -> dict[str, int]:
    """Offsets of the last, next and previous page."""
    last = (max(total - 1, 0) // size) * size if size else 0
    return {"last": last, "next": offset + size if offset + size < total else offset, "prev": max(offset - size, 0)}


def before_or_now(value: int | str | None, now: datetime) -> datetime:
    """A time bound in seconds, or in microseconds from 16 digits on; now if absent."""
    if not value:
        return now
    return datetime.fromtimestamp(int(value) / 1e6 if len(str(value)) >= 16 else int(value))


def page_columns(total: Column, offset: Column, size: Column) -> dict[str, Column]:
    """The same as columns, and the continuation: the offset after a page of ``size``, 0 after the last."""
    more = offset + size < total
    last = F.floor(F.greatest(total - 1, F.lit(0)) / size) * size
    return {"last": last, "next": F.when(more, offset + size).otherwise(offset), "prev": F.greatest(offset - size, F.lit(0)), "continuation": F.when(more, offset + size).otherwise(0)}


def bound(value: Column, now: datetime) -> Column:
    """``before_or_now`` as a column of texts."""
    n = F.nullif(value, F.lit("")).cast("long")
    micros = F.when(F.length(value) >= 16, n).otherwise(n * 1_000_000)
    return F.coalesce(F.timestamp_micros(micros), F.lit(now))
