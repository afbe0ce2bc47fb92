"""Registered queries of lists, probes, retrieval and serving, each with its SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from feedloom.operators import feeds, lists, postings, retrieval, rules, serving
from feedloom.operators.entries import EntryQuery, from_parameters
from feedloom.plans import api
from feedloom.sources import corpus as C

NOW = datetime(2024, 1, 1, 12)
QUERIES: dict = {}
SQL: dict[str, str] = {}
EXTRA: dict[str, str] = {}
_WIDE = "(SELECT e.*, f.title AS feed_title, c.title AS category_title, f.category_id FROM entries e JOIN feeds f USING (feed_id) JOIN categories c ON c.category_id = f.category_id)"


def query(sql: str, extra: str = ""):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        if extra:
            EXTRA[f.__name__] = extra
        return f

    return register


def _q(spark, sf, user=None):
    return EntryQuery(C.corpus(spark, sf), user)


@query("SELECT entry_id, title FROM entries WHERE entry_id IN (3, 5, 8, 13, 21) AND entry_id < 15")
def entries_by_ids(spark, sf):
    return _q(spark, sf).ids(3, 5, 8, 13, 21).id_before(15).rows().select("entry_id", "title")


@query(f"SELECT e.entry_id, t.total FROM (SELECT count(*) AS total FROM {_WIDE} WHERE user_id = 1) t LEFT JOIN (SELECT entry_id FROM entries WHERE FALSE) e ON TRUE")
def empty_page_total(spark, sf):
    """Past the last page the total is still told."""
    return _q(spark, sf, 1).sort("id").limit(10).offset(100_000_000).with_total().select("entry_id", "total")


@query(f"""SELECT entry_id, count(*) OVER () AS total FROM {_WIDE} WHERE user_id = 2 AND feed_id % 3 = 1 AND status = 'unread' AND NOT hidden AND lower(language) = 'en' AND published_at > TIMESTAMP '2024-01-01 00:10:00'
  AND changed_at < TIMESTAMP '2024-01-02' AND NOT starred ORDER BY entry_id DESC LIMIT 7 OFFSET 1""")
def api_list(spark, sf):
    seconds = lambda t: int((t - datetime(1970, 1, 1)).total_seconds())
    p = {"status": ("unread",), "tags": ("EN",), "published_after": seconds(datetime(2024, 1, 1, 0, 10)), "changed_before": seconds(datetime(2024, 1, 2)), "starred": "false", "order": "id", "direction": "desc", "limit": 7, "offset": 1}
    return from_parameters(C.corpus(spark, sf), 2, p).where(F.col("feed_id") % 3 == 1).with_total().select("entry_id", "total")


@query("SELECT entry_id FROM entries WHERE user_id = 3 AND entry_id < 150 AND list_contains(regexp_extract_all(lower(title || ' ' || content), '[\\p{L}\\p{N}]+'), 'der')")
def api_search(spark, sf):
    p = {"ids": tuple(str(i) for i in range(150)), "search": "der", "as_of": NOW}
    return from_parameters(C.corpus(spark, sf), 3, p).rows().select("entry_id")


@query("SELECT entry_id, feed_id FROM entries WHERE share_code = 'share13'")
def entry_by_share_code(spark, sf):
    return _q(spark, sf).share_code("share13").rows().select("entry_id", "feed_id")


# Search.
_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_MARKED = f"""t AS (SELECT entry_id, published_at, user_id, {_TOKENS.format("title")} AS a, {_TOKENS.format("content")} AS b FROM entries)"""


def _sum(n: str) -> str:
    return f"coalesce(list_sum(list_transform(range(1, least({n}, 256) + 1), lambda j: 1 / (j * j))), 0)"


def _rank(*words: str) -> str:
    part = lambda w: f"({_sum(_n('a', w))} + 0.4 * ({_sum(_n('a', w) + ' + ' + _n('b', w))} - {_sum(_n('a', w))}))"
    return f"({' + '.join(map(part, words))}) / (1.64493406685 * {len(words)})"


def _n(column: str, word: str) -> str:
    return f"len(list_filter({column}, lambda x: x = '{word}'))"


def _has(word: str) -> str:
    return f"(list_contains(a, '{word}') OR list_contains(b, '{word}'))"


def _phrase(*words: str) -> str:
    inside = lambda c: f"(' ' || array_to_string({c}, ' ') || ' ') LIKE '% {' '.join(words)} %'"
    return f"({inside('a')} OR {inside('b')})"


@query(f"SELECT entry_id, round({_rank('the', 'ing')}, 6) AS rank FROM t WHERE {_has('the')} AND {_has('ing')}", _MARKED)
def full_text_search(spark, sf):
    match, rank = retrieval.full_text(C.entries(spark, sf), "the ing")
    return _q(spark, sf).where(match).rows().select("entry_id", F.round(rank, 6).alias("rank"))


@query(f"SELECT entry_id, round({_rank('of', 'the', 'und', 'der')}, 6) AS rank FROM t WHERE {_phrase('of', 'the')} AND NOT {_has('was')} OR {_has('und')} AND {_has('der')}", _MARKED)
def full_text_phrases(spark, sf):
    match, rank = retrieval.full_text(C.entries(spark, sf), '"of the" -was or und der')
    return _q(spark, sf).where(match).rows().select("entry_id", F.round(rank, 6).alias("rank"))


@query(f"SELECT entry_id FROM t WHERE {_has('the')} AND user_id = 1 ORDER BY {_rank('the')} - (epoch(TIMESTAMP '2024-01-01 12:00:00') - epoch(published_at)) * 1e-7 DESC, entry_id LIMIT 15", _MARKED)
def search_newest_first(spark, sf):
    match, rank = retrieval.full_text(C.entries(spark, sf), "the")
    return _q(spark, sf, 1).search(match, rank, NOW).sort("id").limit(15).ids_only()


@query("SELECT entry_id FROM entries e WHERE user_id = 2 AND feed_id IN (SELECT feed_id FROM feeds WHERE category_id IN (20, 22, 24)) AND published_at >= TIMESTAMP '2024-01-01 00:05:00' AND published_at <= TIMESTAMP '2024-01-01 03:00:00' AND status = 'unread' AND NOT starred")
def retrieval_filters(spark, sf):
    f = retrieval.Filters(2, category_ids=(20, 22, 24), since=datetime(2024, 1, 1, 0, 5), until=datetime(2024, 1, 1, 3), unread=True, extra=(~F.col("starred"),))
    return f.entry_ids(C.entries(spark, sf), C.feeds(spark, sf))


@query("SELECT entry_id FROM entries WHERE user_id = 1 AND feed_id IN (0, 3, 6) AND starred")
def retrieval_filters_starred(spark, sf):
    return retrieval.Filters(1, feed_ids=(0, 3, 6), starred=True).entry_ids(C.entries(spark, sf))


def _index(spark, sf):
    return postings.index_of(C.entries(spark, sf), sf, "entry_id", "content")


@query("SELECT entry_id, score, rank FROM lexical", "bm25:'the', 'ing', 'der':50")
def bm25_topk(spark, sf):
    return _index(spark, sf).bm25("The ing der", 50, "entry_id")


@query("SELECT entry_id, score, rank FROM lexical", "bm25:'the', 'ing', 'der':50")
def bm25_scan(spark, sf):
    """The same without an index, from the texts."""
    return retrieval.bm25(C.entries(spark, sf), "The ing der", 50, "entry_id", "content")


@query("SELECT entry_id, score, row_number() OVER (ORDER BY score DESC, entry_id) AS rank FROM scored WHERE entry_id IN (SELECT entry_id FROM entries WHERE user_id = 1 AND status = 'unread') QUALIFY rank <= 12", "bm25:'the', 'der':50")
def bm25_within(spark, sf):
    """The filter comes before the limit; the statistics are those of all entries."""
    own = retrieval.Filters(1, unread=True).entry_ids(C.entries(spark, sf))
    return _index(spark, sf).bm25("the der", 12, "entry_id", own)


def _vector(spark, sf):
    return C.passages(spark, sf).filter("passage_id = 7").first()["embedding"]


@query("SELECT passage_id, entry_id, distance, row_number() OVER (ORDER BY distance, passage_id) AS rank FROM d QUALIFY rank <= 9", "knn:9:p.entry_id IN (SELECT entry_id FROM entries WHERE user_id = 1 AND NOT starred)")
def knn_within(spark, sf):
    own = C.entries(spark, sf).filter("user_id = 1 AND NOT starred").select("entry_id")
    return retrieval.knn(C.passages(spark, sf), _vector(spark, sf), 9, own)


_HYBRID = """lexical_passages AS (SELECT p.passage_id, p.entry_id, row_number() OVER (ORDER BY l.rank, p.passage_id) AS rank FROM lexical l JOIN passages p USING (entry_id) WHERE p.ordinal = 0)"""


@query("SELECT passage_id, entry_id, score, row_number() OVER (ORDER BY score DESC, passage_id) AS rank FROM (SELECT passage_id, entry_id, round(sum(1 / (60 + rank)), 9) AS score FROM (SELECT passage_id, entry_id, rank FROM semantic UNION ALL SELECT passage_id, entry_id, rank FROM lexical_passages) GROUP BY 1, 2) QUALIFY rank <= 50", "hybrid")
def rrf_hybrid(spark, sf):
    """BM25 over the entries, as their first passages, fused with the nearest passages."""
    p = C.passages(spark, sf)
    lexical = _index(spark, sf).bm25("The ing der", 50, "entry_id").withColumnRenamed("rank", "r")
    lexical = retrieval.ranked(lexical.join(p.filter("ordinal = 0").select("passage_id", "entry_id"), "entry_id"), F.col("r"), F.col("passage_id"))
    return retrieval.fuse(retrieval.knn(p, _vector(spark, sf), 50), lexical, limit=50)


@query("SELECT l.entry_id, l.rank, e.title FROM lexical l JOIN entries e USING (entry_id) WHERE NOT e.hidden AND e.entry_id % 4 <> 0", "bm25:'the', 'ing', 'der':50")
def search_hydrated(spark, sf):
    """Hits with their entries in the order of rank; some entries are gone by now."""
    hits = _index(spark, sf).bm25("The ing der", 50, "entry_id")
    return serving.hydrate(hits, C.entries(spark, sf).filter("entry_id % 4 <> 0"), without_hidden=True).select("entry_id", "rank", "title")


@query(f"SELECT 'page two' AS asked, TRUE AS degraded, entry_id FROM t WHERE {_has('the')} UNION ALL SELECT 'no embedder', TRUE, entry_id FROM t WHERE {_has('the')} UNION ALL SELECT 'fulltext', FALSE, entry_id FROM t WHERE {_has('the')}", _MARKED)
def search_fallback(spark, sf):
    e = C.entries(spark, sf)
    plain = lambda: e.filter(retrieval.full_text(e, "the")[0])
    ranked = lambda: retrieval.search("semantic", C.passages(spark, sf), "the", 5, retrieval.Filters(1), e)
    out = None
    for asked, args in (("page two", {"offset": 20}), ("no embedder", {}), ("fulltext", {"mode": "fulltext"})):
        rows, degraded = serving.with_fallback(ranked, plain, **args)
        part = rows.select(F.lit(asked).alias("asked"), F.lit(degraded).alias("degraded"), "entry_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT entry_id, '{"entry_id":' || entry_id || ',"score":' || printf('%.1f', entry_id % 7 + 0.5) || ',"snippet":{"text":"x' || entry_id || '","highlights":[{"start":0,"end":1}]}}' AS view FROM entries""")
def entry_views(spark, sf):
    mark = F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end")))
    snippet = F.struct(F.concat(F.lit("x"), "entry_id").alias("text"), mark.alias("highlights"))
    return serving.entry_view(C.entries(spark, sf).select("entry_id", (F.col("entry_id") % 7 + 0.5).cast("double").alias("score"), snippet.alias("snippet")))


@query("""SELECT passage_id, '{"entry_id":' || entry_id || ',"passage_id":' || passage_id || ',"ordinal":' || ordinal || ',"source":"content","score":0.5,"snippet":{"text":"t","highlights":[]}}' AS view FROM passages""")
def passage_views(spark, sf):
    snippet = F.struct(F.lit("t").alias("text"), F.array().cast("array<struct<start:int,end:int>>").alias("highlights"))
    p = C.passages(spark, sf).select("entry_id", "passage_id", "ordinal", F.lit("content").alias("source"), F.lit(0.5).alias("score"), snippet.alias("snippet"))
    return serving.passage_view(p)


@query("""SELECT entry_id, '{"entry_id":' || entry_id || ',"score":0.25}' AS view FROM entries""")
def similar_views(spark, sf):
    return serving.similar_view(C.entries(spark, sf).select("entry_id", F.lit(0.25).alias("score")))


@query("SELECT passage_id, embedding[1]::DOUBLE AS first, len(embedding) AS n FROM passages")
def vector_literals(spark, sf):
    """Vectors to text and back."""
    v = serving.parse_vector(serving.vector_literal(F.col("embedding")))
    return C.passages(spark, sf).select("passage_id", F.get(v, 0).cast("double").alias("first"), F.size(v).cast("long").alias("n"))


_SEEDS = """numbered AS (SELECT passage_id, label, row_number() OVER (PARTITION BY label ORDER BY passage_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM passages)"""


@query("SELECT passage_id FROM numbered WHERE label = 1 AND (n <= 32 OR i IN (SELECT k * n // 32 FROM range(32) r(k)))", _SEEDS)
def seed_stride(spark, sf):
    """The seeds of an entry of many passages: here all passages of one label."""
    p = C.passages(spark, sf).withColumn("entry_id", F.col("label").cast("long")).withColumn("ordinal", F.col("passage_id"))
    return retrieval.seeds(p, 1).select("passage_id")


@query("SELECT entry_id, least(CASE WHEN l > 0 THEN l ELSE 10 END, 100) AS api, least(CASE WHEN l > 0 THEN l ELSE 10 END, 20) AS page, least(greatest(5 * l, 50), 2000) AS lexical, least(greatest(5 * l, 50), 1000) AS vector FROM (SELECT entry_id, entry_id % 700 - 3 AS l FROM entries)")
def search_limits(spark, sf):
    """How much each of many searches gets and fetches, one an entry."""
    limit, r = F.col("entry_id") % 700 - 3, retrieval
    return C.entries(spark, sf).select("entry_id", r.limited(limit).alias("api"), r.limited(limit, r.PAGE_LIMIT).alias("page"), r.fetched(limit, r.MOST_LEXICAL).alias("lexical"), r.fetched(limit, r.MOST_VECTOR).alias("vector"))


@query("SELECT feed_id, t AS total, greatest(t - 1, 0) // 20 * 20 AS last, CASE WHEN o + 20 < t THEN o + 20 ELSE o END AS next, greatest(o - 20, 0) AS prev, CASE WHEN 20 + o < t THEN 20 + o ELSE 0 END AS continuation FROM (SELECT feed_id, count(*) AS t, 20 * (feed_id % 3) AS o FROM entries GROUP BY 1)")
def page_arithmetic(spark, sf):
    """The pages of every feed's entries around an offset."""
    t, o, size = F.col("total"), 20 * (F.col("feed_id") % 3), F.lit(20)
    counts = C.entries(spark, sf).groupBy("feed_id").agg(F.count("*").alias("total"))
    return counts.select("feed_id", "total", *(c.alias(n) for n, c in api.page_columns(t, o, size).items()))


@query("""SELECT entry_id, CASE entry_id % 3 WHEN 2 THEN TIMESTAMP '2024-01-01 12:00:00' ELSE published_at END AS at FROM entries""")
def time_bounds(spark, sf):
    """Bounds in seconds, in microseconds, or absent."""
    seconds = F.unix_timestamp("published_at")
    text = F.when(F.col("entry_id") % 3 == 0, seconds.cast("string")).when(F.col("entry_id") % 3 == 1, (seconds * 1_000_000).cast("string")).otherwise("")
    return C.entries(spark, sf).select("entry_id", api.bound(text, NOW).alias("at"))


@query("SELECT entry_id, 'tag:google.com,2005:reader/item/' || lpad(lower(to_hex(entry_id)), 16, '0') AS item, entry_id AS again, entry_id AS plain FROM entries")
def parse_item_ids(spark, sf):
    from feedloom.functions import urls

    item = urls.long_item_id(F.col("entry_id"))
    return C.entries(spark, sf).select("entry_id", item.alias("item"), urls.parse_item_id(item).alias("again"), urls.parse_item_id(F.col("entry_id").cast("string")).alias("plain"))


# Lists and probes.
@query("""SELECT 'category' AS what, EXISTS (SELECT 1 FROM categories WHERE user_id = 1 AND category_id = 10) AS found UNION ALL SELECT 'category of another', EXISTS (SELECT 1 FROM categories WHERE user_id = 2 AND category_id = 10)
  UNION ALL SELECT 'title', TRUE UNION ALL SELECT 'own title', FALSE UNION ALL SELECT 'feed', EXISTS (SELECT 1 FROM feeds WHERE user_id = 1 AND feed_id = 3) UNION ALL SELECT 'url', EXISTS (SELECT 1 FROM feeds WHERE user_id = 1 AND feed_url = 'https://h3.example.org/feed/3')
  UNION ALL SELECT 'url of another', EXISTS (SELECT 1 FROM feeds WHERE user_id = 1 AND feed_url = 'https://h3.example.org/feed/3' AND feed_id <> 3) UNION ALL SELECT 'user', TRUE UNION ALL SELECT 'nobody', FALSE UNION ALL SELECT 'key', EXISTS (SELECT 1 FROM orders WHERE o_custkey = 85 AND lower(o_orderpriority || ' ' || o_orderkey) = '3-medium 0')""")
def existence_probes(spark, sf):
    cats, f, users, keys = C.categories(spark, sf), C.feeds(spark, sf), C.users(spark), C.accounts(spark, sf)[2]
    probes = {
        "category": lists.category_exists(cats, 1, 10), "category of another": lists.category_exists(cats, 2, 10), "title": lists.category_title_taken(cats, 1, "CATEGORY 10"), "own title": lists.category_title_taken(cats, 1, "Category 10", 10),
        "feed": lists.feed_exists(f, 1, 3), "url": lists.feed_url_taken(f, 1, "https://h3.example.org/feed/3"), "url of another": lists.feed_url_taken(f, 1, "https://h3.example.org/feed/3", 3), "user": lists.username_taken(users, "ANNA"),
        "nobody": lists.username_taken(users, "nobody"), "key": lists.key_taken(keys, 86, "3-medium 0"),
    }
    out = None
    for what, df in probes.items():
        part = df.select(F.lit(what).alias("what"), "found")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT category_id, title, row_number() OVER (ORDER BY title) AS position FROM categories WHERE user_id = 2")
def category_list(spark, sf):
    return lists.categories_of(C.categories(spark, sf), 2).select("category_id", "title", "position")


@query("SELECT lower(c_name) AS username, row_number() OVER (ORDER BY lower(c_name)) AS position FROM customer")
def user_list(spark, sf):
    return lists.users_list(C.accounts(spark, sf)[0]).select("username", "position")


@query("SELECT o_orderkey AS key_id, row_number() OVER (ORDER BY o_orderpriority || ' ' || o_orderkey) AS position FROM orders WHERE o_custkey = 17")
def api_key_list(spark, sf):
    return lists.keys_of(C.accounts(spark, sf)[2], 18).select("key_id", "position")


@query("SELECT event_id AS session_id, row_number() OVER (ORDER BY ts DESC, event_id) AS position FROM events WHERE user_id = 2")
def session_list(spark, sf):
    return lists.sessions_of(C.accounts(spark, sf)[3], 2).select("session_id", "position")


@query("SELECT (SELECT count(*) FROM customer) AS users, count(*) AS keys, count(DISTINCT o_custkey) AS users_with_key FROM orders")
def account_counts(spark, sf):
    users, _, keys, _ = C.accounts(spark, sf)
    return lists.account_counts(users, keys)


@query("SELECT c_custkey + 1 AS user_id, lower(c_name) AS username FROM customer WHERE c_custkey % 4 <> 3 AND c_nationkey % 2 = 0")
def users_with_integration(spark, sf):
    users, integrations, _, _ = C.accounts(spark, sf)
    return lists.users_with(users, integrations, F.col("read_later")).select("user_id", "username")


@query("SELECT (SELECT count(*) FROM entries WHERE user_id = 1 AND status = 'unread' AND NOT hidden AND feed_id IN (SELECT feed_id FROM visible)) AS unread, 0 AS error_feeds, (SELECT bool_or(c_nationkey % 2 = 0 OR c_acctbal < 0) FROM customer WHERE c_custkey = 0) AS has_save_entry")
def navigation_without_limit(spark, sf):
    return feeds.navigation(C.corpus(spark, sf), 1, 0, C.accounts(spark, sf)[1])


@query("SELECT entry_id, hour(published_at) >= 1 AND hour(published_at) < 3 AS day, hour(published_at) >= 2 OR hour(published_at) < 1 AS night, TRUE AS always FROM entries")
def schedule_windows(spark, sf):
    at = F.col("published_at")
    return C.entries(spark, sf).select("entry_id", lists.in_window(at, 1, 3).alias("day"), lists.in_window(at, 2, 1).alias("night"), lists.in_window(at, 5, 5).alias("always"))


@query("SELECT entry_id, CASE WHEN entry_id % 2 = 0 THEN reading_time ELSE 99 END AS reading_time FROM (SELECT e.entry_id, s.reading_time, e.hash, e.feed_id FROM entries e LEFT JOIN (SELECT DISTINCT feed_id, hash, reading_time FROM entries) s USING (feed_id, hash))")
def stored_reading_time(spark, sf):
    e = C.entries(spark, sf)
    incoming = e.drop("reading_time").withColumn("hash", F.when(F.col("entry_id") % 2 == 0, F.col("hash")).otherwise(F.concat(F.lit("new"), "hash")))
    return lists.stored_reading_time(incoming, e, F.lit(99)).select("entry_id", "reading_time")


@query('SELECT \'documents\' AS "table", (SELECT count(*) FROM documents) AS rows UNION ALL SELECT \'embeddings\', (SELECT count(*) FROM embeddings)')
def table_statistics(spark, sf):
    return lists.statistics({n: C.table(spark, sf, n) for n in ("documents", "embeddings")}).select("table", "rows")


# Feeds.
@query("SELECT feed_id, CASE WHEN external_id <> '' THEN icon_id ELSE 0 END AS icon_id, coalesce(external_id, '') AS icon FROM feeds f LEFT JOIN icons USING (icon_id)")
def feed_icons(spark, sf):
    found = feeds.with_icons(C.feeds(spark, sf).drop("icon_id"), C.feed_icons(spark, sf), C.icons(spark, sf))
    return found.select("feed_id", "icon_id", "icon")


@query("""SELECT f.feed_id, f.title, c.title AS category_title, c.hide_globally AS category_hidden, CASE WHEN external_id <> '' THEN f.icon_id ELSE 0 END AS icon_id, 'bo' AS username, 'Europe/Paris' AS timezone, coalesce(unreads, 0) AS unreads FROM feeds f LEFT JOIN categories c USING (category_id) LEFT JOIN icons i ON i.icon_id = f.icon_id
  LEFT JOIN (SELECT feed_id, count(*) AS unreads FROM entries WHERE user_id = 2 AND status = 'unread' AND NOT hidden GROUP BY 1) USING (feed_id) WHERE f.user_id = 2""")
def feed_rows(spark, sf):
    found = feeds.feed_rows(C.corpus(spark, sf), C.feed_icons(spark, sf), C.icons(spark, sf), 2)
    return found.select("feed_id", "title", "category_title", "category_hidden", "icon_id", "username", "timezone", "unreads")


@query("SELECT feed_id, row_number() OVER (ORDER BY parsing_error_count DESC, lower(title), feed_id) AS position FROM feeds WHERE user_id = 1")
def feeds_by_errors(spark, sf):
    return feeds.feeds_sorted(C.feeds(spark, sf), 1, "parsing_error_count", "desc").select("feed_id", "position")


_COUNTS = """counted AS (SELECT c.category_id, c.title, (SELECT count(*) FROM feeds f WHERE f.category_id = c.category_id AND f.user_id = 1) AS feed_count,
  (SELECT count(*) FROM entries e JOIN feeds f USING (feed_id) WHERE f.category_id = c.category_id AND e.user_id = 1 AND status = 'unread' AND NOT hidden) AS total_unread FROM categories c WHERE c.user_id = 1)"""


@query("SELECT *, row_number() OVER (ORDER BY title, category_id) AS position FROM counted", _COUNTS)
def categories_by_title(spark, sf):
    return feeds.category_counts(C.corpus(spark, sf), 1, "alphabetical")


@query("SELECT *, row_number() OVER (ORDER BY total_unread DESC, title, category_id) AS position FROM counted", _COUNTS)
def categories_by_unread(spark, sf):
    return feeds.category_counts(C.corpus(spark, sf), 1, "unread_count")


_WEEK = "per_week AS (SELECT feed_id, feed_id % 9 * 30 AS per_week FROM feeds WHERE feed_id % 4 <> 3)"
_MINUTES = "least(greatest(CASE WHEN coalesce(per_week, 0) <= 0 THEN 1440 ELSE round(10080 / (per_week * 2)) END, 30), 1440)::INT"


def _weekly(spark, sf):
    return C.feeds(spark, sf).filter("feed_id % 4 <> 3").select("feed_id", (F.col("feed_id") % 9 * 30).alias("per_week"))


@query(f"SELECT feed_id, {_MINUTES} AS minutes, TIMESTAMP '2024-01-01 12:00:00' + to_minutes({_MINUTES}) AS next_check_at FROM feeds LEFT JOIN per_week USING (feed_id)", _WEEK)
def next_check_by_frequency(spark, sf):
    return feeds.next_check(C.feeds(spark, sf), _weekly(spark, sf), NOW, least=30, factor=2)


@query("SELECT feed_id, least(greatest(60, CASE WHEN feed_id % 2 = 0 THEN feed_id * 100 ELSE 0 END), 1440)::INT AS minutes FROM feeds", _WEEK)
def next_check_round_robin(spark, sf):
    delays = C.feeds(spark, sf).filter("feed_id % 2 = 0").select("feed_id", (F.col("feed_id") * 100).cast("int").alias("delay"))
    return feeds.next_check(C.feeds(spark, sf), _weekly(spark, sf), NOW, round_robin=60, delays=delays).select("feed_id", "minutes")


@query("SELECT feed_id, 'h' || feed_id % 5 || '.example.org' AS host FROM feeds WHERE user_id = 1 AND category_id = 10 AND NOT disabled ORDER BY next_check_at, feed_id LIMIT 4")
def due_feeds_of_category(spark, sf):
    return feeds.due_feeds(C.feeds(spark, sf), datetime(2024, 2, 1), 4, user_id=1, category_id=10)


# Rules.
@query("SELECT entry_id FROM entries WHERE NOT (regexp_matches(url, 'src[12]/') OR regexp_matches(title, 'src[12]/') OR regexp_matches(author, 'src[12]/') OR regexp_matches(language, 'src[12]/'))")
def blocklist_rule(spark, sf):
    return rules.apply(C.entries(spark, sf), NOW, blocklist="src[12]/").select("entry_id")


@query("SELECT entry_id FROM entries WHERE regexp_matches(author, '3$') OR regexp_matches(url, '3$') OR regexp_matches(title, '3$') OR regexp_matches(language, '3$') OR regexp_matches(source, '3$')")
def keeplist_rule(spark, sf):
    return rules.apply(C.entries(spark, sf), NOW, keeplist="3$").select("entry_id")


@query("SELECT entry_id FROM entries WHERE NOT (published_at < TIMESTAMP '2024-01-01 12:00:00' - INTERVAL 11 HOURS - INTERVAL 30 MINUTES) AND NOT published_at > TIMESTAMP '2024-01-01 12:00:00'")
def age_rule(spark, sf):
    return rules.apply(C.entries(spark, sf), NOW, block_rules="EntryDate=max-age:11h30m\nEntryDate=future").select("entry_id")
