"""Registered queries: each applies one operator, with fixed parameters, to the shared tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions import dates, html, rewrite, text, urls
from feedloom.operators import evaluate, feeds, indexing, mutate, retrieval, rules
from feedloom.operators.entries import EntryQuery
from feedloom.plans import api, changes, indexes, reading, scalars
from feedloom.sources import corpus as C
from feedloom.sources import formats
from feedloom.streaming import live

NOW = datetime(2024, 1, 1, 12)
PAGE = ("entry_id", "feed_id", "title", "status", "starred", "published_at", "feed_title", "category_title")
QUERIES: dict = {**changes.QUERIES, **reading.QUERIES, **scalars.QUERIES, **indexes.QUERIES}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _q(spark, sf, user=None):
    return EntryQuery(C.corpus(spark, sf), user)


@query
def unread_first_page(spark: SparkSession, sf: str) -> DataFrame:
    return api.unread_page(C.corpus(spark, sf), 1).select(*PAGE)


@query
def entries_with_total(spark, sf):
    return _q(spark, sf, 2).statuses("unread").sort("published_at").sort("id").limit(20).offset(10).with_total().select("entry_id", "total")


@query
def entries_by_tags(spark, sf):
    return _q(spark, sf, 1).tags("EN", "Src3").rows().select("entry_id", "language")


@query
def entries_starred(spark, sf):
    return _q(spark, sf).starred(True).shared().ids_only()


@query
def entries_changed_between(spark, sf):
    return _q(spark, sf).changed(datetime(2024, 1, 1, 3), datetime(2024, 1, 1, 9)).rows().select("entry_id", "changed_at")


@query
def entries_by_category(spark, sf):
    return _q(spark, sf).category(10).rows().select("entry_id", "feed_id")


@query
def entries_status_or_id(spark, sf):
    return _q(spark, sf, 1).status_or_id("read", 3).not_hidden_or_id(3).ids_only()


@query
def entry_prev_next(spark, sf):
    return _q(spark, sf, 1).statuses("unread").neighbours(123)


@query
def entry_keyset_page(spark, sf):
    return _q(spark, sf, 1).id_after(100).sort("id").limit(50).ids_only()


@query
def entries_zoned(spark, sf):
    return _q(spark, sf, 2).starred(True).zoned().select("entry_id", "published_at", "icon_id")


@query
def status_counts(spark, sf):
    return feeds.status_counts(C.entries(spark, sf))


@query
def feed_totals(spark, sf):
    return feeds.feed_totals(C.feeds(spark, sf))


@query
def feeds_with_errors(spark, sf):
    return feeds.feeds_with_errors(C.feeds(spark, sf), 2)


@query
def feed_counters(spark, sf):
    return feeds.feed_counters(C.entries(spark, sf), 1)


@query
def feed_list(spark, sf):
    return feeds.feed_list(C.corpus(spark, sf), 1).select("feed_id", "category_title", "reads", "unreads")


@query
def category_counts(spark, sf):
    return feeds.category_counts(C.corpus(spark, sf), 1)


@query
def navigation(spark, sf):
    return feeds.navigation(C.corpus(spark, sf), 1, 2)


@query
def weekly_frequency(spark, sf):
    kind = F.col("event_type")
    number = F.when(kind == "click", 1).when(kind == "error", 2).when(kind == "purchase", 3).when(kind == "signup", 4).otherwise(5).cast("long")
    return feeds.weekly_frequency(C.table(spark, sf, "events").select(number.alias("feed_id"), F.col("ts").cast("timestamp").alias("published_at")), datetime(2024, 1, 20))


@query
def due_feeds(spark, sf):
    return feeds.due_feeds(C.feeds(spark, sf), datetime(2024, 1, 3), 20, 3, 2)


@query
def fever_items(spark, sf):
    return api.fever_items(C.corpus(spark, sf), 1, since_id=50).select("id", "feed_id", "title", "is_read", "is_saved", "created_on")


@query
def fever_groups(spark, sf):
    return api.fever_groups(C.feeds(spark, sf), 1)


@query
def fever_unread_ids(spark, sf):
    return api.id_list(_q(spark, sf, 1).statuses("unread").hidden(False).rows())


@query
def long_item_ids(spark, sf):
    return C.entries(spark, sf).select("entry_id", urls.long_item_id(F.col("entry_id")).alias("item"))


@query
def reading_list_ids(spark, sf):
    return api.reading_list(C.corpus(spark, sf), 1, after=datetime(2024, 1, 1, 1), limit=100, offset=20)


@query
def archive_snapshot(spark, sf):
    entries, _ = mutate.archive(C.entries(spark, sf), C.tombstones(spark, sf), "read", datetime(2024, 1, 5, 8), 4, 30)
    return entries.select("entry_id")


@query
def flush_history_tombstones(spark, sf):
    _, marks = mutate.flush_history(C.entries(spark, sf), C.tombstones(spark, sf), 1, NOW)
    return marks.select("feed_id", "hash")


@query
def set_status(spark, sf):
    return mutate.set_status(C.entries(spark, sf), 1, [3, 6, 7], "read", NOW).select("entry_id", "status", "changed_at")


@query
def set_status_count_visible(spark, sf):
    return mutate.set_status_count_visible(C.corpus(spark, sf), 1, [3, 6, 9, 12, 15])


@query
def toggle_starred(spark, sf):
    return mutate.toggle_starred(C.entries(spark, sf), 1, 21, NOW).select("entry_id", "starred")


@query
def set_hidden_bulk(spark, sf):
    return mutate.set_hidden(C.entries(spark, sf), 2, [1, 4], True, NOW).select("entry_id", "hidden", "hidden_reason")


@query
def mark_read_before(spark, sf):
    return mutate.mark_read(C.entries(spark, sf), 1, NOW, before=datetime(2024, 1, 1, 5)).select("entry_id", "status", "changed_at")


@query
def mark_category_read(spark, sf):
    return mutate.mark_category_read(C.corpus(spark, sf), 1, 10, datetime(2024, 1, 1, 8), NOW).select("entry_id", "status", "changed_at")


@query
def mark_visible_read(spark, sf):
    return mutate.mark_visible_read(C.corpus(spark, sf), 2, datetime(2024, 1, 1, 8), NOW).select("entry_id", "status", "changed_at")


@query
def hide_category(spark, sf):
    return mutate.hide_unread(C.corpus(spark, sf), 1, datetime(2024, 1, 1, 8), NOW, category_id=10).select("entry_id", "hidden")


@query
def hide_feed_backlog(spark, sf):
    return mutate.hide_feed_backlog(C.entries(spark, sf), 1, 3, NOW).select("entry_id", "hidden")


@query
def remove_categories(spark, sf):
    return mutate.remove_categories(C.corpus(spark, sf), 1, [10])[1].select("feed_id", "category_id")


@query
def opml_export(spark, sf):
    return mutate.opml(C.feeds(spark, sf).filter("user_id = 1"), C.categories(spark, sf))


@query
def pending_entries(spark, sf):
    return indexing.pending(C.entries(spark, sf), C.index_state(spark, sf), after=20, limit=200)


@query
def pending_counts(spark, sf):
    e, s = C.entries(spark, sf), C.index_state(spark, sf)
    one = indexing.pending_count(e, s).select(F.col("n").alias("exact")).join(indexing.pending_estimate(e, s).select(F.col("n").alias("estimate")))
    return one.join(indexing.indexed_count(e, s).select(F.col("n").alias("indexed"))).join(indexing.max_entry_id(e))


@query
def latest_state(spark, sf):
    s = C.index_state(spark, sf)
    later = s.filter("entry_id % 2 = 0").withColumn("indexed_at", F.col("indexed_at") + F.expr("INTERVAL 1 DAY")).withColumn("status", F.lit("ok"))
    return indexing.latest_state(s.unionByName(later)).select("entry_id", "status", "indexed_at")


@query
def block_keep_filter(spark, sf):
    block = "EntryTitle=^The\r\nbad line\nEntryTag=^de$\nEntryAuthor=^author3$\nEntryNonsense=x\nEntryTitle=("
    keep = "EntryContent=tion\nEntryTag=^src1$\nEntryDate=after:2024-01-02"
    return rules.apply(C.entries(spark, sf), NOW, block_rules=block, keep_rules=keep).select("entry_id")


@query
def date_rules(spark, sf):
    block = "EntryDate=max-age:60h\nEntryDate=between:2024-01-01,2024-01-01\nEntryDate=before:nonsense\nEntryDate=max-age:x"
    return rules.apply(C.entries(spark, sf), datetime(2024, 1, 3), block_rules=block).select("entry_id")


@query
def url_domain(spark, sf):
    u = F.col("url")
    return C.table(spark, sf, "pages").select("page_id", urls.domain(u).alias("domain"), urls.domain_without_www(u).alias("bare"), urls.root_url(u).alias("root"))


@query
def url_clean(spark, sf):
    return C.table(spark, sf, "pages").select("page_id", urls.clean_url_column(F.col("url")).alias("url"))


@query
def word_count(spark, sf):
    return C.entries(spark, sf).select("entry_id", text.word_count(F.col("content")).alias("words"))


@query
def reading_time(spark, sf):
    return C.entries(spark, sf).select("entry_id", text.reading_time(F.col("content")).alias("minutes"))


@query
def language_normalize(spark, sf):
    return C.entries(spark, sf).select("entry_id", text.normalize_language(F.col("language")).alias("language"))


@query
def strip_tags(spark, sf):
    return C.table(spark, sf, "pages").select("page_id", text.strip_tags(F.col("html")).alias("text"))


@query
def nl2br(spark, sf):
    return rewrite.apply(C.entries(spark, sf), "nl2br").select("entry_id", F.md5("content").alias("digest"))


def _vector(spark, sf):
    return C.passages(spark, sf).filter("passage_id = 7").first()["embedding"]


@query
def knn_cosine_topk(spark, sf):
    return retrieval.knn(C.passages(spark, sf), _vector(spark, sf), 20)


@query
def entry_aggregate(spark, sf):
    hits = retrieval.knn(C.passages(spark, sf), _vector(spark, sf), 50)
    return retrieval.by_entry(hits).withColumn("passages", F.concat_ws(",", F.transform("passages", lambda x: x.cast("string"))))


@query
def similar_entries(spark, sf):
    return retrieval.similar(C.passages(spark, sf), 3, 10)


@query
def recall_at_k(spark, sf):
    """Every 50th passage asks for the passages of its label."""
    p = C.passages(spark, sf)
    q = p.filter("passage_id % 50 = 0").select(F.col("passage_id").alias("query_id"), "label", "embedding")
    hits = retrieval.knn_many(p, q, 10).drop("entry_id").withColumnRenamed("passage_id", "entry_id")
    total = p.groupBy("label").agg(F.count("*").alias("n"))
    found = hits.join(q.select("query_id", "label"), "query_id").join(p.select(F.col("passage_id").alias("entry_id"), F.col("label").alias("own")), "entry_id")
    found = found.groupBy("query_id").agg(F.count_if(F.col("label") == F.col("own")).alias("found"))
    return q.join(total, "label").join(found, "query_id", "left").select("query_id", F.round(F.coalesce("found", F.lit(0)) / F.col("n"), 6).alias("recall"))


@query
def knn_many(spark, sf):
    p = C.passages(spark, sf)
    return retrieval.knn_many(p, p.filter("passage_id % 50 = 0").select(F.col("passage_id").alias("query_id"), "embedding"), 5).select("query_id", "passage_id", "distance", "rank")


@query
def gauges(spark, sf):
    return live.gauges(C.entries(spark, sf), C.feeds(spark, sf), C.index_state(spark, sf))


@query
def corpus_guard(spark, sf):
    return evaluate.corpus_guard(C.passages(spark, sf))


def _events(spark, sf):
    return C.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query
def events_tumbling(spark, sf):
    return live.tumbling(_events(spark, sf))


@query
def events_sliding(spark, sf):
    return live.sliding(_events(spark, sf))


@query
def events_sessions(spark, sf):
    return live.sessions(_events(spark, sf))


@query
def guid_collisions(spark, sf):
    items = C.entries(spark, sf).select("entry_id", "feed_id", F.col("hash").alias("guid"), F.col("entry_id").alias("pos"))
    return formats.collisions(items).select("entry_id", F.col("occurrence").cast("long").alias("occurrence"))


@query
def without_full_text(spark, sf):
    return _q(spark, sf).where(F.col("full_text_fetched_at").isNull()).id_after(10).sort("id").limit(100).ids_only()


@query
def shared_icons(spark, sf):
    f = C.feeds(spark, sf)
    icons = f.filter("icon_id IS NOT NULL").select("icon_id")
    return mutate.icons_of_user(icons, f.select("feed_id", "icon_id").filter("icon_id IS NOT NULL"), f, 1)


@query
def failure_causes(spark, sf):
    causes = C.table(spark, sf, "events").filter("event_type = 'error'").select(indexing.failure_cause(F.col("props")).alias("cause"))
    return feeds.host_failures(causes)


# Queries that SQL cannot express; tests compare them with plain Python.
@query
def extract_text(spark, sf):
    return C.table(spark, sf, "pages").select("page_id", text.extract_text_udf("html").alias("text"))


@query
def split_passages(spark, sf):
    e = C.entries(spark, sf)
    return indexing.make_passages(e)


@query
def readability(spark, sf):
    return C.table(spark, sf, "pages").select("page_id", html.readable_udf("html").alias("content"))


@query
def sanitize(spark, sf):
    return C.table(spark, sf, "pages").select("page_id", html.sanitize_udf("html", "url").alias("content"))


@query
def read_feed_documents(spark, sf):
    """RSS documents made of the entries, read back."""
    e = C.entries(spark, sf)
    item = F.concat(F.lit("<item><title>"), F.regexp_replace("title", "[<>&]", ""), F.lit("</title><link>"), "url", F.lit("</link><guid>"), "hash", F.lit("</guid><pubDate>"), F.date_format("published_at", "dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item>"))
    doc = F.concat(F.lit("<rss version='2.0'><channel><title>f</title><link>https://example.org/</link>"), item, F.lit("</channel></rss>"))
    parsed = formats.read_feeds(e.select("url", doc.alias("content")))
    return parsed.select("url", "title", "hash", dates.parse_common(F.col("published")).alias("published_at"))
