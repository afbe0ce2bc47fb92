"""Registered queries of the change operators, each with its SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.operators import feeds, indexing, lists, mutate
from feedloom.operators.entries import EntryQuery
from feedloom.sources import corpus as C

NOW = datetime(2024, 1, 1, 12)
EIGHT = datetime(2024, 1, 1, 8)
QUERIES: dict = {}
SQL: dict[str, str] = {}
_AT = "TIMESTAMP '2024-01-01 12:00:00'"
_BEFORE = "published_at < TIMESTAMP '2024-01-01 08:00:00'"


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def _flip(hit: str, **columns: str) -> str:
    """All entries with new values where ``hit`` holds."""
    return "SELECT entry_id, " + ", ".join(f"CASE WHEN {hit} THEN {v} ELSE {c} END AS {c}" for c, v in columns.items()) + " FROM entries"


# Refreshing: stored are the entries before id 120 and those of every other feed; all come in, the second half under a new hash as well.
_STORED = "(entry_id < 120 OR feed_id % 2 = 0)"
_INCOMING = """incoming AS (SELECT entry_id, user_id, feed_id, hash, 'new ' || title AS title, url, 'c' AS comments_url, content, author, 7 AS reading_time, 'xx' AS language, published_at + INTERVAL 1 DAY AS published_at FROM entries
  UNION ALL SELECT entry_id + 1000000, user_id, feed_id, 'new' || hash, title, url, 'c', content, author, 7, 'xx', published_at FROM entries WHERE entry_id >= 120)"""


def _stored(spark, sf) -> DataFrame:
    return C.entries(spark, sf).filter(_STORED)


def _incoming(spark, sf) -> DataFrame:
    e = C.entries(spark, sf).withColumns({"comments_url": F.lit("c"), "reading_time": F.lit(7), "language": F.lit("xx")})
    again = e.withColumn("title", F.concat(F.lit("new "), "title")).withColumn("published_at", F.col("published_at") + F.expr("INTERVAL 1 DAY"))
    new = e.filter("entry_id >= 120").withColumn("entry_id", F.col("entry_id") + 1_000_000).withColumn("hash", F.concat(F.lit("new"), "hash"))
    return again.unionByName(new)


_ONE_EACH = """stored AS (SELECT * FROM entries WHERE {stored}), {incoming},
one AS (SELECT * FROM incoming WHERE (feed_id, hash) NOT IN (SELECT (feed_id, hash) FROM stored) AND (feed_id, hash) NOT IN (SELECT (feed_id, hash) FROM tombstones))"""
EXTRA = {
    name: _ONE_EACH.format(stored=_STORED, incoming=_INCOMING)
    for name in ("tombstone_guard", "refresh_upsert", "refresh_inserted", "refresh_without_update")
}


@query("SELECT DISTINCT feed_id, hash FROM one")
def tombstone_guard(spark, sf):
    return mutate.new_entries(_incoming(spark, sf), _stored(spark, sf), C.tombstones(spark, sf)).select("feed_id", "hash")


_SNAPSHOT = """SELECT feed_id, hash, {title} AS title, {comments} AS comments_url, {time} AS reading_time, {language} AS language, s.published_at FROM stored s
  UNION ALL SELECT feed_id, hash, min(title), 'c', 7, 'xx', min(published_at) FROM one GROUP BY 1, 2"""


@query(_SNAPSHOT.format(title="'new ' || title", comments="'c'", time="7", language="'xx'"))
def refresh_upsert(spark, sf):
    snapshot, _ = mutate.refresh(_stored(spark, sf), _incoming(spark, sf), C.tombstones(spark, sf))
    return snapshot.select("feed_id", "hash", "title", "comments_url", "reading_time", "language", "published_at")


@query("SELECT feed_id, hash, min(title) AS title FROM one GROUP BY 1, 2")
def refresh_inserted(spark, sf):
    return mutate.refresh(_stored(spark, sf), _incoming(spark, sf), C.tombstones(spark, sf))[1].select("feed_id", "hash", "title")


@query(_SNAPSHOT.format(title="title", comments="comments_url", time="reading_time", language="language"))
def refresh_without_update(spark, sf):
    snapshot, _ = mutate.refresh(_stored(spark, sf), _incoming(spark, sf), C.tombstones(spark, sf), update_existing=False)
    return snapshot.select("feed_id", "hash", "title", "comments_url", "reading_time", "language", "published_at")


@query("""SELECT enclosure_id, entry_id, url FROM enclosures x WHERE EXISTS (SELECT 1 FROM listed l WHERE l.entry_id = x.entry_id AND l.url = x.url)
  UNION ALL SELECT enclosure_id, entry_id, url FROM listed l WHERE url <> '' AND NOT EXISTS (SELECT 1 FROM enclosures x WHERE x.entry_id = l.entry_id AND x.url = l.url)""")
def refresh_enclosures(spark, sf):
    e, x = C.entries(spark, sf), mutate.first_of(C.enclosures(spark, sf), ["entry_id", "url"], "enclosure_id")
    listed = x.filter("entry_id % 2 = 0").withColumn("enclosure_id", F.col("enclosure_id") + 5_000_000)
    more = x.filter("enclosure_id % 2 = 0").withColumns({"enclosure_id": F.col("enclosure_id") + 9_000_000, "url": F.concat(F.lit("  "), F.col("url"), F.lit("?2 "))})
    both = listed.unionByName(more).join(e.select("entry_id", "feed_id", "hash"), "entry_id")
    first = mutate.first_of(e, mutate.KEY, "entry_id")
    return mutate.refresh_with_enclosures(first, first, C.tombstones(spark, sf), x, both.join(first.select("entry_id"), "entry_id", "left_semi"))[2].join(first.select("entry_id"), "entry_id", "left_semi").select("enclosure_id", "entry_id", "url")


@query("SELECT 5 AS entry_id, FALSE AS created UNION ALL SELECT 9000001, TRUE")
def insert_single_entry(spark, sf):
    e = C.entries(spark, sf)
    old = e.filter("entry_id = 5").withColumn("entry_id", F.lit(9_000_000).cast("long"))
    new = e.filter("entry_id = 5").withColumns({"entry_id": F.lit(9_000_001).cast("long"), "hash": F.lit("another")})
    stored = e.filter("entry_id = 5 OR feed_id <> (5 % 3)").join(e.filter("entry_id = 5").select("feed_id", "hash"), ["feed_id", "hash"], "left_anti").unionByName(e.filter("entry_id = 5"))
    return mutate.insert_entry(stored, old)[1].unionByName(mutate.insert_entry(stored, new)[1])


@query(_flip(f"user_id = 1 AND status = 'unread' AND feed_id = 3 AND {_BEFORE}", status="'read'", changed_at=_AT))
def mark_feed_read(spark, sf):
    return mutate.mark_read(C.entries(spark, sf), 1, NOW, before=EIGHT, feed_id=3).select("entry_id", "status", "changed_at")


@query(_flip("user_id = 3 AND status = 'unread'", status="'read'", changed_at=_AT))
def mark_all_read(spark, sf):
    return mutate.mark_read(C.entries(spark, sf), 3, NOW).select("entry_id", "status", "changed_at")


@query(_flip("user_id = 1 AND entry_id IN (3, 6, 9)", starred="TRUE", changed_at=_AT))
def set_starred(spark, sf):
    return mutate.set_starred(C.entries(spark, sf), 1, [3, 6, 9], True, NOW).select("entry_id", "starred", "changed_at")


@query(_flip("user_id = 2 AND entry_id = 22", hidden="NOT hidden", hidden_reason="NULL"))
def toggle_hidden(spark, sf):
    return mutate.toggle_hidden(C.entries(spark, sf), 2, 22, NOW).select("entry_id", "hidden", "hidden_reason")


@query(_flip("user_id = 2 AND entry_id IN (1, 22)", hidden="FALSE", hidden_reason="NULL"))
def show_entries(spark, sf):
    return mutate.set_hidden(C.entries(spark, sf), 2, [1, 22], False, NOW).select("entry_id", "hidden", "hidden_reason")


@query(_flip("user_id = 1 AND entry_id = 3", hidden="TRUE", hidden_reason="'rule'"))
def hide_with_reason(spark, sf):
    return mutate.set_hidden(C.entries(spark, sf), 1, [3], True, NOW, "rule").select("entry_id", "hidden", "hidden_reason")


@query(_flip(f"user_id = 1 AND status = 'unread' AND NOT hidden AND feed_id = 3 AND {_BEFORE}", hidden="TRUE", hidden_reason="'bulk'"))
def hide_feed(spark, sf):
    return mutate.hide_unread(C.corpus(spark, sf), 1, EIGHT, NOW, feed_id=3).select("entry_id", "hidden", "hidden_reason")


@query(_flip(f"user_id = 2 AND status = 'unread' AND NOT hidden AND feed_id IN (SELECT feed_id FROM visible) AND {_BEFORE}", hidden="TRUE", hidden_reason="'bulk'"))
def hide_visible(spark, sf):
    return mutate.hide_unread(C.corpus(spark, sf), 2, EIGHT, NOW, visible=True).select("entry_id", "hidden", "hidden_reason")


@query(_flip("entry_id IN (1, 2, 3)", full_text_fetched_at=_AT))
def full_text_fetched(spark, sf):
    return mutate.set_full_text_fetched(C.entries(spark, sf), [1, 2, 3], NOW).select("entry_id", "full_text_fetched_at")


@query(_flip("feed_id = 3 AND hash IN ('absent', 'b12a')", full_text_fetched_at=_AT))
def full_text_fetched_by_hash(spark, sf):
    return mutate.set_full_text_fetched_by_hash(C.entries(spark, sf), 3, ["absent", "b12a"], NOW).select("entry_id", "full_text_fetched_at")


@query(_flip("entry_id = 4", title="'New title'", content="'New text'"))
def update_text(spark, sf):
    return mutate.update_text(C.entries(spark, sf), 4, "New title", "New text").select("entry_id", "title", "content")


@query(_flip("user_id = 1 AND entry_id = 3 AND share_code = ''", share_code="left(sha256('share|' || user_id || '|' || entry_id || '|' || hash), 40)"))
def share_entry(spark, sf):
    return mutate.share(C.entries(spark, sf), 1, 3).select("entry_id", "share_code")


@query(_flip("user_id = 2 AND entry_id = 13", share_code="''"))
def unshare_entry(spark, sf):
    return mutate.unshare(C.entries(spark, sf), 2, 13).select("entry_id", "share_code")


# Enclosures.
@query("SELECT enclosure_id, url FROM enclosures UNION ALL SELECT 7000000 + min(enclosure_id), url || '#2' FROM enclosures GROUP BY entry_id, url")
def insert_enclosures(spark, sf):
    x = C.enclosures(spark, sf)
    first = x.groupBy("user_id", "entry_id", "url").agg(F.min("enclosure_id").alias("enclosure_id"))
    more = first.select((F.col("enclosure_id") + 7_000_000).alias("enclosure_id"), "user_id", "entry_id", F.concat(F.lit(" "), "url", F.lit("#2 ")).alias("url"), F.lit("x").alias("mime_type"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("media_progression"))
    blank = more.withColumn("url", F.lit("  "))
    return mutate.insert_enclosures(x, x.unionByName(more).unionByName(blank)).select("enclosure_id", "url")


@query("SELECT enclosure_id FROM enclosures WHERE entry_id % 2 = 1 OR url LIKE '%.PNG'")
def sync_enclosures(spark, sf):
    x = C.enclosures(spark, sf)
    return mutate.sync_enclosures(x, x.filter("url LIKE '%.PNG'"), C.entries(spark, sf).filter("entry_id % 2 = 0")).select("enclosure_id")


@query("SELECT max(enclosure_id) AS enclosure_id FROM enclosures GROUP BY user_id, entry_id, url")
def dedup_enclosures(spark, sf):
    return mutate.dedup_enclosures(C.enclosures(spark, sf)).select("enclosure_id")


@query("SELECT entry_id, count(*) AS n, string_agg(url, ' ' ORDER BY enclosure_id) AS urls FROM enclosures WHERE user_id = 1 GROUP BY 1")
def enclosures_by_entry(spark, sf):
    found = mutate.enclosures_by_entry(C.enclosures(spark, sf), C.entries(spark, sf).filter("user_id = 1"))
    return found.select("entry_id", F.size("enclosures").cast("long").alias("n"), F.concat_ws(" ", F.transform("enclosures", lambda x: x["url"])).alias("urls"))


@query("SELECT enclosure_id, CASE WHEN enclosure_id = 18 THEN 77 ELSE media_progression END AS media_progression FROM enclosures")
def enclosure_progress(spark, sf):
    return mutate.set_progress(C.enclosures(spark, sf), 18, 77).select("enclosure_id", "media_progression")


# Categories and feeds.
@query("SELECT category_id, user_id, title FROM categories UNION ALL SELECT 900, 1, 'Brand new'")
def create_category(spark, sf):
    again = mutate.create_category(C.categories(spark, sf), 1, 900, "Brand new")
    return mutate.create_category(again, 1, 901, "brand NEW").select("category_id", "user_id", "title")


@query("SELECT category_id, CASE WHEN category_id = 10 AND user_id = 1 THEN 'Renamed' ELSE title END AS title, CASE WHEN category_id = 10 AND user_id = 1 THEN TRUE ELSE hide_globally END AS hide_globally FROM categories")
def update_category(spark, sf):
    first = mutate.update_category(C.categories(spark, sf), 1, 10, "Renamed", True)
    return mutate.update_category(first, 1, 13, "RENAMED", True).select("category_id", "title", "hide_globally")


@query("SELECT feed_id, user_id, feed_url FROM feeds UNION ALL SELECT 8000, 1, 'internal://saved-pages/user/1'")
def saved_pages_feed(spark, sf):
    once = mutate.get_or_create_saved_feed(C.feeds(spark, sf), 1, 8000, 10)
    return mutate.get_or_create_saved_feed(once, 1, 8001, 10).select("feed_id", "user_id", "feed_url")


@query("SELECT 'feeds' AS what, count(*) + 1 AS n FROM feeds UNION ALL SELECT 'entries', count(*) + (SELECT count(DISTINCT hash) FROM entries WHERE feed_id = 3) FROM entries")
def create_feed(spark, sf):
    c = C.corpus(spark, sf)
    new = c.feeds.filter("feed_id = 3").withColumn("feed_id", F.lit(7000).cast("long"))
    own = c.entries.filter("feed_id = 3").withColumn("feed_id", F.lit(7000).cast("long"))
    f, e = mutate.create_feed(c.feeds, c.entries, new, own.unionByName(own))
    n = lambda what, df: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    return n("feeds", f).unionByName(n("entries", e))


@query("SELECT feed_id, CASE WHEN feed_id = 4 AND user_id = 2 THEN 'T' ELSE title END AS title, CASE WHEN feed_id = 4 AND user_id = 2 THEN 9 ELSE parsing_error_count END AS parsing_error_count FROM feeds")
def update_feed(spark, sf):
    new = spark.createDataFrame([(4, 2, "T", 9), (5, 1, "not its owner", 9)], "feed_id long, user_id long, title string, parsing_error_count int")
    return mutate.update_feed(C.feeds(spark, sf), new).select("feed_id", "title", "parsing_error_count")


def _with_messages(spark, sf):
    return C.feeds(spark, sf).withColumn("parsing_error_message", F.lit("old"))


@query("SELECT feed_id, parsing_error_count + CASE WHEN feed_id = 4 THEN 1 ELSE 0 END AS parsing_error_count, CASE WHEN feed_id = 4 THEN 'timeout' ELSE 'old' END AS parsing_error_message FROM feeds")
def record_feed_error(spark, sf):
    return mutate.record_feed_error(_with_messages(spark, sf), 4, "timeout").select("feed_id", "parsing_error_count", "parsing_error_message")


@query("SELECT feed_id, 0 AS parsing_error_count, '' AS parsing_error_message FROM feeds")
def reset_feed_errors(spark, sf):
    return mutate.reset_feed_errors(_with_messages(spark, sf)).select("feed_id", "parsing_error_count", "parsing_error_message")


@query(f"SELECT feed_id, {_AT} AS next_check_at FROM feeds")
def reset_next_check(spark, sf):
    return mutate.reset_next_check(C.feeds(spark, sf), NOW).select("feed_id", "next_check_at")


@query("SELECT 'entry' AS what, entry_id AS id FROM entries WHERE feed_id <> 3 UNION ALL SELECT 'feed', feed_id FROM feeds WHERE feed_id <> 3 UNION ALL SELECT 'enclosure', enclosure_id FROM enclosures WHERE entry_id NOT IN (SELECT entry_id FROM entries WHERE feed_id = 3)")
def remove_feed(spark, sf):
    f, e, x = mutate.remove_feed(C.corpus(spark, sf), C.enclosures(spark, sf), 3)
    ids = lambda what, df, c: df.select(F.lit(what).alias("what"), F.col(c).alias("id"))
    return ids("entry", e, "entry_id").unionByName(ids("feed", f, "feed_id")).unionByName(ids("enclosure", x, "enclosure_id"))


@query("SELECT category_id FROM categories WHERE user_id = 1 AND category_id <> 10 OR user_id <> 1")
def remaining_categories(spark, sf):
    return mutate.remove_categories(C.corpus(spark, sf), 1, [10])[0].select("category_id")


# Icons and sessions.
@query("SELECT icon_id, hash FROM icons UNION ALL SELECT 5000, sha256('brand new')")
def store_icons(spark, sf):
    i, links = C.icons(spark, sf), C.feed_icons(spark, sf)
    new = spark.createDataFrame([(2, 4000, "icon4"), (4, 5000, "brand new"), (6, 5001, "brand new")], "feed_id long, icon_id long, text string")
    new = new.select("feed_id", "icon_id", F.sha2("text", 256).alias("hash"), F.lit("image/png").alias("mime_type"), F.encode("text", "UTF-8").alias("content"), F.lit("e").alias("external_id")).coalesce(1).sortWithinPartitions("icon_id")
    return mutate.store_icons(i, links, new.filter("icon_id <> 5001"))[0].select("icon_id", "hash")


@query("SELECT feed_id, CASE feed_id WHEN 2 THEN 4 ELSE icon_id END AS icon_id FROM feed_icons")
def replace_icon_links(spark, sf):
    i, links = C.icons(spark, sf), C.feed_icons(spark, sf)
    new = spark.createDataFrame([(2, 4000, "icon4")], "feed_id long, icon_id long, text string").withColumn("hash", F.sha2("text", 256)).withColumns({"mime_type": F.lit("x"), "content": F.encode("text", "UTF-8"), "external_id": F.lit("")})
    return mutate.store_icons(i, links, new)[1].select("feed_id", "icon_id")


@query("SELECT icon_id FROM icons WHERE icon_id IN (SELECT icon_id FROM feed_icons)")
def without_orphan_icons(spark, sf):
    return mutate.without_orphan_icons(C.icons(spark, sf), C.feed_icons(spark, sf)).select("icon_id")


@query("SELECT event_id AS session_id FROM events WHERE NOT ts < TIMESTAMP '2024-01-09'")
def without_old_sessions(spark, sf):
    return mutate.without_old_sessions(C.accounts(spark, sf)[3], datetime(2024, 1, 12), 3).select("session_id")


# The passage index.
def _indexed(spark, sf, status: str, reason: str | None = None):
    state = C.index_state(spark, sf)
    done = C.entries(spark, sf).filter("entry_id % 5 = 0").select("entry_id", F.lit("h").alias("content_hash"))
    p = C.passage_texts(spark, sf).select("entry_id", "ordinal", "text")
    new = done.select("entry_id", F.lit(0).alias("ordinal"), F.lit("fresh").alias("text"))
    return indexing.replace_passages(p, state.withColumn("reason", F.lit(None).cast("string")), new, done, NOW, status, reason)


_REPLACED = "SELECT entry_id, sum(ordinal)::BIGINT AS ordinals, count(*) AS n, md5(string_agg(text, '|' ORDER BY ordinal)) AS digest FROM ({}) GROUP BY 1"


def _digest(p: DataFrame) -> DataFrame:
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "|")
    return p.groupBy("entry_id").agg(F.sum("ordinal").alias("ordinals"), F.count("*").alias("n"), F.md5(joined).alias("digest"))


@query(_REPLACED.format("SELECT entry_id, ordinal, text FROM texts WHERE entry_id % 5 <> 0 UNION ALL SELECT entry_id, 0, 'fresh' FROM entries WHERE entry_id % 5 = 0"))
def replace_passages(spark, sf):
    return _digest(_indexed(spark, sf, "ok")[0])


@query(_REPLACED.format("SELECT entry_id, ordinal, text FROM texts WHERE entry_id % 5 <> 0"))
def skip_passages(spark, sf):
    return _digest(_indexed(spark, sf, "skipped", "empty")[0])


@query(_REPLACED.format("SELECT entry_id, ordinal, text FROM texts"))
def keep_passages_of_failed(spark, sf):
    return _digest(_indexed(spark, sf, "failed", "timeout")[0])


@query(f"SELECT entry_id, content_hash, status, NULL::VARCHAR AS reason, indexed_at FROM state WHERE entry_id % 5 <> 0 UNION ALL SELECT entry_id, 'h', 'failed', 'timeout', {_AT} FROM entries WHERE entry_id % 5 = 0")
def mark_failed(spark, sf):
    return _indexed(spark, sf, "failed", "timeout")[1].select("entry_id", "content_hash", "status", "reason", "indexed_at")


@query("SELECT round((SELECT count(*) FROM texts) / (SELECT count(*) FROM entries), 6) AS per_entry")
def passages_per_entry(spark, sf):
    return indexing.passages_per_entry(C.passage_texts(spark, sf), C.entries(spark, sf))


@query("SELECT entry_id, ordinal, text FROM texts WHERE entry_id = 7")
def passages_of_entry(spark, sf):
    return indexing.passages_of(C.passage_texts(spark, sf), 7).select("entry_id", "ordinal", "text")


# Counters.
@query("SELECT feed_id % 4 AS k, round(0.3 * max(CASE WHEN feed_id // 4 = 1 THEN parsing_error_count END) + 0.7 * max(CASE WHEN feed_id // 4 = 0 THEN parsing_error_count END), 6) AS ewma FROM feeds WHERE feed_id < 8 GROUP BY 1 HAVING count(*) = 2")
def throughput_ewma(spark, sf):
    f = C.feeds(spark, sf).filter("feed_id < 8").select((F.col("feed_id") % 4).alias("k"), "feed_id", "parsing_error_count")
    both = f.groupBy("k").agg(F.count("*").alias("n")).filter("n = 2").select("k")
    return feeds.ewma(f.join(both, "k", "left_semi"), "k", "feed_id", "parsing_error_count").select("k", F.round("ewma", 6).alias("ewma"))


@query("SELECT * FROM (SELECT cause, n FROM top UNION ALL SELECT '(other)', (sum(n))::BIGINT FROM rest HAVING sum(n) > 0)")
def failure_overflow(spark, sf):
    causes = C.entries(spark, sf).select(indexing.failure_cause(F.concat(F.lit("code "), "feed_id", F.lit(": "), "author")).alias("cause"), "language")
    return feeds.host_failures(causes.select(F.concat_ws(" ", "cause", "language", F.substring("cause", 1, 3)).alias("cause")), 2)


EXTRA["failure_overflow"] = """causes AS (SELECT regexp_replace('code ' || feed_id || ': ' || author, '[0-9]+', 'N', 'g') || ' ' || language || ' cod' AS cause, count(*) AS n FROM entries GROUP BY 1),
top AS (SELECT cause, n FROM causes ORDER BY n DESC, cause LIMIT 2), rest AS (SELECT n FROM causes WHERE cause NOT IN (SELECT cause FROM top))"""
for _name in ("replace_passages", "skip_passages", "keep_passages_of_failed", "passages_per_entry", "passages_of_entry"):
    EXTRA[_name] = """lines AS (SELECT entry_id, title, string_split(content, chr(10)) AS l FROM entries),
texts AS (SELECT entry_id, 0 AS ordinal, title AS text FROM lines UNION ALL SELECT entry_id, k + 1, array_to_string(l[k * 4 + 1 : k * 4 + 4], chr(10)) FROM (SELECT entry_id, l, unnest(range(0, (len(l) + 3) // 4)) AS k FROM lines))"""
EXTRA["refresh_enclosures"] = """pairs AS (SELECT entry_id, url, min(enclosure_id) AS enclosure_id FROM enclosures_all WHERE entry_id IN (SELECT min(entry_id) FROM entries GROUP BY feed_id, hash) GROUP BY 1, 2),
enclosures AS (SELECT * FROM pairs),
listed AS (SELECT enclosure_id + 5000000 AS enclosure_id, entry_id, url FROM pairs WHERE entry_id % 2 = 0 UNION ALL SELECT enclosure_id + 9000000, entry_id, url || '?2' FROM pairs WHERE enclosure_id % 2 = 0)"""


@query("SELECT entry_id FROM entries WHERE full_text_fetched_at IS NULL ORDER BY 1 LIMIT 30 OFFSET 30")
def full_text_backfill_page(spark, sf):
    """The second page of a backfill that has fetched the first."""
    e = C.entries(spark, sf)
    first = EntryQuery(C.corpus(spark, sf)).where(F.col("full_text_fetched_at").isNull()).sort("id").limit(30).ids_only()
    done = mutate.change(e.join(first.withColumn("_done", F.lit(True)), "entry_id", "left"), F.col("_done"), full_text_fetched_at=F.lit(NOW)).select(*e.columns)
    return EntryQuery(_corpus_with(C.corpus(spark, sf), done)).where(F.col("full_text_fetched_at").isNull()).sort("id").limit(30).ids_only()


def _corpus_with(c, entries):
    return C.Corpus(entries, c.feeds, c.categories, c.users)


@query("SELECT event_id AS session_id FROM events WHERE user_id = 1")
def sessions_of_user(spark, sf):
    return lists.sessions_of(C.accounts(spark, sf)[3], 1).select("session_id")
