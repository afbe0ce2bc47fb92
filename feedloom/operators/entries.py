"""Entry queries: an immutable builder of filters, order and page over entries, feeds, categories and users.

Nothing runs until an action; Catalyst pushes the filters to the scans and prunes what isn't selected. Feeds are joined only
where a filter or the wide projection needs them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.sources.corpus import Corpus

#: Most rows of a page, and of a list of ids.
MAX_ENTRIES, MAX_IDS = 1000, 10_000
ORDERS = ("id", "status", "changed_at", "published_at", "created_at", "category_title", "category_id", "title", "author")
DIRECTIONS = ("asc", "desc")
STATUSES = ("read", "unread")
_COLUMN = {"id": "entry_id"}
WIDE = (
    "entry_id user_id feed_id hash published_at title url comments_url author share_code content status starred hidden hidden_reason "
    "created_at changed_at tags language feed_title feed_url site_url category_id category_title timezone icon_id"
).split()


class QueryError(ValueError):
    """A value that a query does not take."""


def check_order(order: str) -> str:
    if order not in ORDERS:
        raise QueryError(f"order must be one of {', '.join(ORDERS)}")
    return order


def check_direction(direction: str) -> str:
    if direction.lower() not in DIRECTIONS:
        raise QueryError("direction must be asc or desc")
    return direction.lower()


def check_status(status: str) -> str:
    if status not in STATUSES:
        raise QueryError("status must be read or unread")
    return status


def check_range(limit: int, offset: int) -> None:
    if limit < 0 or offset < 0:
        raise QueryError("limit and offset must not be negative")


def clamp(limit: int, most: int) -> int:
    return most if limit <= 0 or limit > most else limit


@dataclass(frozen=True)
class EntryQuery:
    corpus: Corpus
    user_id: int | None = None
    conditions: tuple[Callable[[], Column], ...] = ()
    needs_feeds: bool = False
    order: tuple[tuple[str, str], ...] = ()
    size: int = 0
    skip: int = 0
    content: bool = True
    only_unread: bool = False
    hidden_set: bool = False
    ranks: tuple[Column, ...] = field(default=())

    def where(self, *conditions: Column, feeds: bool = False) -> EntryQuery:
        return replace(self, conditions=self.conditions + conditions, needs_feeds=self.needs_feeds or feeds)

    def starred(self, value: bool) -> EntryQuery:
        return self.where(F.col("starred").eqNullSafe(F.lit(value)))

    def hidden(self, value: bool) -> EntryQuery:
        return replace(self.where(F.col("hidden").eqNullSafe(F.lit(value))), hidden_set=True)

    def changed(self, after: datetime | None = None, before: datetime | None = None) -> EntryQuery:
        return self._between("changed_at", after, before)

    def published(self, after: datetime | None = None, before: datetime | None = None) -> EntryQuery:
        return self._between("published_at", after, before)

    def _between(self, column: str, after, before) -> EntryQuery:
        q = self.where(F.col(column) > F.lit(after)) if after is not None else self
        return q.where(F.col(column) < F.lit(before)) if before is not None else q

    def id_after(self, entry_id: int) -> EntryQuery:
        return self.where(F.col("entry_id") > entry_id) if entry_id else self

    def id_before(self, entry_id: int) -> EntryQuery:
        return self.where(F.col("entry_id") < entry_id) if entry_id else self

    def ids(self, *entry_ids: int) -> EntryQuery:
        return self.where(F.col("entry_id").isin(*entry_ids)) if entry_ids else self

    def feed(self, feed_id: int) -> EntryQuery:
        return self.where(F.col("feed_id") == feed_id) if feed_id > 0 else self

    def category(self, category_id: int) -> EntryQuery:
        return self.where(F.col("category_id") == category_id, feeds=True) if category_id > 0 else self

    def statuses(self, *statuses: str) -> EntryQuery:
        if not statuses:
            return self
        return replace(self.where(F.col("status").isin(*map(check_status, statuses))), only_unread=statuses == ("unread",))

    def without_status(self, status: str) -> EntryQuery:
        return self.where(F.col("status") != status) if status else self

    def tags(self, *tags: str) -> EntryQuery:
        """Entries that have all the tags, whatever the case."""
        if not tags:
            return self
        wanted = F.array(*(F.lit(t.lower()) for t in tags))
        return self.where(F.size(F.array_except(wanted, F.transform("tags", F.lower))) == 0)

    def share_code(self, code: str) -> EntryQuery:
        return self.where(F.col("share_code") == code)

    def shared(self) -> EntryQuery:
        return self.where(F.col("share_code") != "")

    def globally_visible(self) -> EntryQuery:
        return self.where(~F.col("category_hidden"), ~F.col("feed_hidden"), feeds=True)

    def status_or_id(self, status: str, entry_id: int) -> EntryQuery:
        """Status, or that entry; either may be left out."""
        if status and entry_id:
            return self.where((F.col("status") == status) | (F.col("entry_id") == entry_id))
        return self.where(F.col("status") == status) if status else self.where(F.col("entry_id") == entry_id) if entry_id else self

    def not_hidden_or_id(self, entry_id: int) -> EntryQuery:
        return self.where(~F.col("hidden") | (F.col("entry_id") == entry_id))

    def search(self, match: Column, rank: Column, as_of: datetime, age_weight: float = 1e-7) -> EntryQuery:
        """Full-text match, ordered by rank minus age."""
        age = F.unix_timestamp(F.lit(as_of)) - F.unix_timestamp("published_at")
        return replace(self.where(match), ranks=(F.desc(rank - age * age_weight),))

    def unread_list_rule(self) -> EntryQuery:
        """A list of exactly the unread ones leaves out what is hidden, unless hidden was asked for."""
        return self.hidden(False) if self.only_unread and not self.hidden_set else self

    def sort(self, order: str, direction: str = "asc") -> EntryQuery:
        return replace(self, order=self.order + ((order, check_direction(direction)),))

    def stable(self) -> EntryQuery:
        """Ties by newest, then by largest id."""
        have = {o for o, _ in self.order}
        return replace(self, order=self.order + tuple((o, "desc") for o in ("published_at", "id") if o not in have))

    def limit(self, size: int, most: int = MAX_ENTRIES) -> EntryQuery:
        return replace(self, size=clamp(size, most))

    def offset(self, skip: int) -> EntryQuery:
        return replace(self, skip=skip) if skip > 0 else self

    def without_content(self) -> EntryQuery:
        return replace(self, content=False)

    def _feeds(self) -> DataFrame:
        c = self.corpus
        cats = c.categories.select("category_id", F.col("title").alias("category_title"), F.col("hide_globally").alias("category_hidden"))
        feeds = c.feeds.select("feed_id", "category_id", F.col("title").alias("feed_title"), "feed_url", "site_url", F.col("hide_globally").alias("feed_hidden"), "icon_id")
        return feeds.join(cats, "category_id")

    def rows(self, wide: bool = False) -> DataFrame:
        """The matching entries, not ordered."""
        df = self.corpus.entries
        if self.user_id is not None:
            df = df.filter(F.col("user_id") == self.user_id)
        joins = wide or self.needs_feeds or any(o.startswith("category") for o, _ in self.order)
        if joins:
            df = df.join(self._feeds(), "feed_id", "inner" if wide else "left")
        if wide:
            df = df.join(self.corpus.users.select("user_id", "timezone"), "user_id")
        for condition in self.conditions:
            df = df.filter(condition)
        return df if self.content else df.withColumn("content", F.lit(""))

    def _page(self, df: DataFrame) -> DataFrame:
        keys = [*self.ranks, *(F.col(_COLUMN.get(o, o)).asc_nulls_last() if d == "asc" else F.col(_COLUMN.get(o, o)).desc_nulls_first() for o, d in self.order)]
        df = df.orderBy(*keys) if keys else df
        df = df.offset(self.skip) if self.skip else df
        return df.limit(self.size) if self.size else df

    def page(self) -> DataFrame:
        return self._page(self.rows(wide=True)).select(*WIDE)

    def ids_only(self) -> DataFrame:
        return self._page(self.rows()).select("entry_id")

    def count(self) -> DataFrame:
        return self.rows().agg(F.count("*").alias("total"))

    def with_total(self) -> DataFrame:
        """The page, each row with the number of all matching entries; one sum is joined, so that no window takes all rows to one task.
        Past the end of the list one row, null but for the total, stands for the page."""
        page = self._page(self.rows(wide=True)).select(*WIDE)
        return self.count().join(page, how="left" if self.skip else "inner").select(*WIDE, "total")

    def zoned(self) -> DataFrame:
        """The page with published_at shown in the user's time zone, and no icon where there is none."""
        return self.page().withColumn("published_at", F.from_utc_timestamp("published_at", F.col("timezone"))).withColumn("icon_id", F.coalesce("icon_id", F.lit(0)))

    def neighbours(self, entry_id: int, order: str = "published_at", direction: str = "desc") -> DataFrame:
        """prev_id and next_id of an entry in the list: the nearest rows on both sides, two top-1 searches instead of a sort of all."""
        column = _COLUMN.get(check_order(order), order)
        df = self.rows().select("entry_id", column, "created_at")
        here = df.filter(F.col("entry_id") == entry_id).select(F.struct(F.col(column).alias("a"), F.col("created_at").alias("b"), (-F.col("entry_id")).alias("c")).alias("here"))
        key = F.struct(F.col(column).alias("a"), F.col("created_at").alias("b"), (-F.col("entry_id")).alias("c"))
        both = df.select("entry_id", key.alias("key")).join(F.broadcast(here))
        before = F.max(F.when(F.col("key") < F.col("here"), F.struct("key", "entry_id")))["entry_id"]
        after = F.min(F.when(F.col("key") > F.col("here"), F.struct("key", "entry_id")))["entry_id"]
        found = both.agg(before.alias("before"), after.alias("after"))
        prev, nxt = ("after", "before") if check_direction(direction) == "desc" else ("before", "after")
        return found.select(F.col(prev).alias("prev_id"), F.col(nxt).alias("next_id"))


def from_parameters(corpus: Corpus, user_id: int, p: dict) -> EntryQuery:
    """The list parameters of an API request; times in unix seconds, 0 or missing means not given."""
    when = lambda name: datetime.fromtimestamp(int(p[name])) if int(p.get(name) or 0) > 0 else None
    check_range(int(p.get("limit") or 0), int(p.get("offset") or 0))
    q = EntryQuery(corpus, user_id).feed(int(p.get("feed_id") or 0)).category(int(p.get("category_id") or 0))
    q = q.statuses(*p.get("status", ())).tags(*p.get("tags", ()))
    q = q.ids(*map(int, p.get("ids", ())))
    if p.get("search"):
        from feedloom.operators.retrieval import full_text

        match, rank = full_text(corpus.entries, p["search"])
        q = q.search(match, rank, p.get("as_of") or datetime.now())
    q = q.id_before(int(p.get("before_entry_id") or 0)).id_after(int(p.get("after_entry_id") or 0))
    q = q.published(when("published_after") or when("after"), when("published_before") or when("before"))
    q = q.changed(when("changed_after"), when("changed_before"))
    if p.get("starred") in ("true", "1", "false", "0"):
        q = q.starred(p["starred"] in ("true", "1"))
    q = q.unread_list_rule().sort(check_order(p.get("order") or "published_at"), p.get("direction") or "asc")
    return q.limit(int(p.get("limit") or 100)).offset(int(p.get("offset") or 0))
