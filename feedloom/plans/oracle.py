"""DuckDB SQL for the queries of catalog.py, over the shared tables."""

from __future__ import annotations

from feedloom.plans import changes, indexes, reading, scalars

PRELUDE = """
entries AS (SELECT doc_id AS entry_id, 1 + doc_id % 3 AS user_id, CAST(substr(source, 4) AS BIGINT) * 3 + doc_id % 3 AS feed_id, sha256(text) AS hash,
  substr(text, 1, 60) AS title, 'https://example.org/' || source || '/' || doc_id AS url, 'author' || (doc_id % 17) AS author, text AS content,
  CASE WHEN doc_id % 5 = 0 THEN 'read' ELSE 'unread' END AS status, doc_id % 7 = 0 AS starred, doc_id % 11 = 0 AS hidden,
  CASE WHEN doc_id % 22 = 0 THEN 'bulk' END AS hidden_reason, CASE WHEN doc_id % 13 = 0 THEN 'share' || doc_id ELSE '' END AS share_code,
  TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS published_at, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at,
  TIMESTAMP '2024-01-01' + to_minutes(doc_id) + to_hours(CAST(doc_id % 7 AS INT)) AS changed_at, lang AS language, source,
  CASE WHEN doc_id % 4 = 0 THEN TIMESTAMP '2024-01-01' + to_minutes(doc_id) END AS full_text_fetched_at, '' AS comments_url, (length(text) % 40 + 1)::INT AS reading_time FROM documents),
enclosures_all AS (SELECT entry_id * 2 AS enclosure_id, user_id, entry_id, 'https://cdn.example.org/' || entry_id || '.mp3' AS url, CASE WHEN entry_id % 6 = 0 THEN 'audio/mpeg' ELSE 'application/octet-stream' END AS mime_type, entry_id * 10 AS size, entry_id % 4 * 30 AS media_progression FROM entries WHERE entry_id % 3 = 0
  UNION ALL SELECT entry_id * 2 + 1, user_id, entry_id, 'https://cdn.example.org/' || entry_id || CASE WHEN entry_id % 18 = 0 THEN '.mp3' ELSE '.PNG' END, 'video/m4v', 0, 0 FROM entries WHERE entry_id % 9 = 0),
feeds AS (SELECT feed_id, 1 + feed_id % 3 AS user_id, (1 + feed_id % 3) * 10 + feed_id % 6 AS category_id, 'Feed ' || feed_id AS title,
  'https://h' || (feed_id % 5) || '.example.org/feed/' || feed_id AS feed_url, 'h' || (feed_id % 5) || '.example.org' AS host,
  feed_id % 10 = 9 AS disabled, feed_id % 8 = 7 AS hide_globally, feed_id % 4 AS parsing_error_count, TIMESTAMP '2024-01-01' + to_hours(CAST(feed_id AS INT)) AS next_check_at,
  CASE WHEN feed_id % 2 = 0 THEN feed_id END AS icon_id FROM (SELECT DISTINCT feed_id FROM entries)),
feed_icons AS (SELECT feed_id, icon_id FROM feeds WHERE icon_id IS NOT NULL),
icons AS (SELECT icon_id, sha256('icon' || icon_id) AS hash, ['image/png', 'IMAGE/GIF', 'text/html', 'image/svg+xml'][icon_id % 4 + 1] AS mime_type, 'icon' || icon_id AS content, CASE WHEN icon_id % 6 = 0 THEN '' ELSE 'x' || icon_id END AS external_id
  FROM (SELECT DISTINCT icon_id FROM feed_icons UNION ALL SELECT DISTINCT icon_id + 1000000 FROM feed_icons)),
categories AS (SELECT category_id, user_id, 'Category ' || category_id AS title, category_id % 10 = 5 AS hide_globally FROM (SELECT DISTINCT category_id, user_id FROM feeds)),
visible AS (SELECT feed_id FROM feeds f JOIN categories c USING (category_id) WHERE NOT f.hide_globally AND NOT c.hide_globally),
passages AS (SELECT CAST(vec_id AS BIGINT) AS passage_id, CAST(vec_id AS BIGINT) // 5 AS entry_id, vec_id % 5 AS ordinal, embedding, label FROM embeddings),
tombstones AS (SELECT feed_id, hash, published_at AS deleted_at FROM entries WHERE entry_id % 9 = 0),
state AS (SELECT entry_id, CASE WHEN entry_id % 8 = 0 THEN 'old' ELSE md5('v3|hash@1#64|' || title || content) END AS content_hash, published_at AS indexed_at,
  CASE WHEN entry_id % 6 = 0 THEN 'failed' WHEN entry_id % 10 = 1 THEN 'skipped' ELSE 'ok' END AS status FROM entries WHERE entry_id % 4 <> 3)"""
ENCLOSURES = ",\nenclosures AS (SELECT * FROM enclosures_all)"
TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
SPACES = r"[\s\x0B\x{85}\p{Z}]+"


def strip(html: str) -> str:
    """Text outside tags, trimmed."""
    tags = r"""(?s)<!--.*?-->|<[!?][^>]*>|</?[A-Za-z](?:[^>=]|=\s*(?:"[^"]*"|''[^'']*'')?)*(?:>|$)"""
    return f"regexp_replace(regexp_replace({html}, '{tags}', '', 'g'), '^{SPACES}|{SPACES}$', '', 'g')"


def shown(html: str) -> str:
    """The text of markup: block tags part words, scripts and styles aren't shown, white space is one space."""
    from feedloom.functions.text import BLOCK_TAGS, HIDDEN_TAGS

    hidden, blocks = "|".join(sorted(HIDDEN_TAGS)), "|".join(sorted(BLOCK_TAGS))
    out = f"regexp_replace({html}, '(?s)<!--.*?-->', '', 'g')"
    out = f"regexp_replace({out}, '(?is)<({hidden})\\b[^>]*>.*?</({hidden})\\s*>', '', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '(?i)</?({blocks})\\b[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g')"
    for name, char in (("copy", "©"), ("middot", "·"), ("mdash", "—"), ("eacute", "é"), ("nbsp", "\u00a0"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("#x27", "''"), ("amp", "&")):
        out = f"replace({out}, '&{name};', '{char}')"
    return f"trim(regexp_replace({out}, '[\\s\\x0B\\x{{85}}\\x{{FEFF}}\\p{{Z}}]+', ' ', 'g'))"


def minutes(html: str) -> str:
    """Reading time of a text at 265 words or 500 characters a minute."""
    cjk = r"[^\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Yi}\p{Bopomofo}]"
    letters = f"regexp_replace({strip(html)}, '\\P{{L}}', '', 'g')"
    many = f"length(regexp_replace(left({letters}, 99), '{cjk}', '', 'g')) > least(length({letters}), 100) // 2"
    return f"CASE WHEN {many} THEN ceil(length({strip(html)}) / 500) ELSE ceil(len(list_filter(regexp_split_to_array({strip(html)}, '{SPACES}'), lambda w: w <> '')) / 265) END::BIGINT"


AS_OF = "TIMESTAMP '2024-01-01 12:00:00'"


def bm25(terms: str, k: int) -> str:
    return f"""t AS (SELECT entry_id, {TOKENS.format('content')} AS t FROM entries),
stats AS (SELECT count(*) AS nd, avg(len(t)) AS avgdl FROM t),
tf AS (SELECT entry_id, dl, term, count(*) AS tf FROM (SELECT entry_id, len(t) AS dl, unnest(t) AS term FROM t) WHERE term IN ({terms}) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
scored AS (SELECT entry_id, round(sum(ln(1 + (nd - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN df USING (term), stats GROUP BY 1),
lexical AS (SELECT entry_id, score, row_number() OVER (ORDER BY score DESC, entry_id) AS rank FROM scored QUALIFY rank <= {k})"""


def knn(k: int, where: str = "TRUE") -> str:
    return f"""d AS (SELECT p.passage_id, p.entry_id, round(1 - list_dot_product(p.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(p.embedding::DOUBLE[], p.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6) + 0.0 AS distance
  FROM passages p, (SELECT embedding FROM passages WHERE passage_id = 7) q WHERE {where}),
semantic AS (SELECT passage_id, entry_id, distance, row_number() OVER (ORDER BY distance, passage_id) AS rank FROM d QUALIFY rank <= {k})"""


_SIMILAR = """s AS (SELECT passage_id AS seed, embedding AS e FROM passages WHERE entry_id = 3),
d AS (SELECT seed, p.passage_id, p.entry_id, round(1 - list_dot_product(p.embedding::DOUBLE[], e::DOUBLE[]) / (sqrt(list_dot_product(p.embedding::DOUBLE[], p.embedding::DOUBLE[])) * sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[]))), 6) + 0.0 AS distance FROM passages p, s WHERE p.entry_id <> 3),
near AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY seed ORDER BY distance, passage_id) <= 50),
best AS (SELECT passage_id, entry_id, min(distance) AS distance FROM near GROUP BY 1, 2),
hits AS (SELECT *, row_number() OVER (ORDER BY distance, passage_id) AS rank FROM best QUALIFY rank <= 50)"""
_PAGE = "entry_id, feed_id, title, status, starred, published_at, feed_title, category_title"
_WIDE = "(SELECT e.*, f.title AS feed_title, c.title AS category_title, f.category_id, f.hide_globally AS fh, c.hide_globally AS ch FROM entries e JOIN feeds f USING (feed_id) JOIN categories c ON c.category_id = f.category_id)"
_CHANGED = "SELECT entry_id, status, changed_at FROM"

BODIES: dict[str, str] = {
    "unread_first_page": f"SELECT {_PAGE} FROM {_WIDE} WHERE user_id = 1 AND status = 'unread' AND NOT hidden AND NOT fh AND NOT ch ORDER BY published_at DESC, entry_id DESC LIMIT 100",
    "entries_with_total": f"SELECT entry_id, count(*) OVER () AS total FROM {_WIDE} WHERE user_id = 2 AND status = 'unread' ORDER BY published_at, entry_id LIMIT 20 OFFSET 10",
    "entries_by_tags": "SELECT entry_id, language FROM entries WHERE user_id = 1 AND lower(language) = 'en' AND lower(source) = 'src3'",
    "entries_starred": "SELECT entry_id FROM entries WHERE starred AND share_code <> ''",
    "entries_changed_between": "SELECT entry_id, changed_at FROM entries WHERE changed_at > TIMESTAMP '2024-01-01 03:00:00' AND changed_at < TIMESTAMP '2024-01-01 09:00:00'",
    "entries_by_category": "SELECT entry_id, feed_id FROM entries JOIN feeds USING (feed_id) WHERE category_id = 10",
    "entries_status_or_id": "SELECT entry_id FROM entries WHERE user_id = 1 AND (status = 'read' OR entry_id = 3) AND (NOT hidden OR entry_id = 3)",
    "entry_prev_next": "SELECT prev_id, next_id FROM (SELECT entry_id, lead(entry_id) OVER w AS prev_id, lag(entry_id) OVER w AS next_id FROM entries WHERE user_id = 1 AND status = 'unread' WINDOW w AS (ORDER BY published_at, created_at, entry_id DESC)) WHERE entry_id = 123",
    "entry_keyset_page": "SELECT entry_id FROM entries WHERE user_id = 1 AND entry_id > 100 ORDER BY entry_id LIMIT 50",
    "entries_zoned": "SELECT entry_id, CAST((published_at AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Paris' AS TIMESTAMP) AS published_at, coalesce(icon_id, 0) AS icon_id FROM entries JOIN feeds USING (feed_id) WHERE entries.user_id = 2 AND starred",
    "status_counts": "SELECT status, count(*) AS n FROM entries GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM entries",
    "feed_totals": "SELECT count(*) FILTER (disabled) AS disabled, count(*) FILTER (NOT disabled) AS enabled, count(*) AS total FROM feeds",
    "feeds_with_errors": "SELECT count(*) AS n FROM feeds WHERE parsing_error_count >= 2",
    "feed_counters": "SELECT feed_id, count(*) FILTER (status = 'read') AS reads, count(*) FILTER (status = 'unread') AS unreads, count(*) AS visible FROM entries WHERE user_id = 1 AND (status = 'read' OR NOT hidden) GROUP BY 1",
    "feed_list": """SELECT feed_id, category_title, coalesce(reads, 0) AS reads, coalesce(unreads, 0) AS unreads FROM (SELECT f.feed_id, c.title AS category_title FROM feeds f LEFT JOIN categories c USING (category_id) WHERE f.user_id = 1)
      LEFT JOIN (SELECT feed_id, count(*) FILTER (status = 'read') AS reads, count(*) FILTER (status = 'unread') AS unreads FROM entries WHERE user_id = 1 AND (status = 'read' OR NOT hidden) GROUP BY 1) USING (feed_id)""",
    "category_counts": """SELECT c.category_id, c.title, coalesce(n, 0) AS feed_count, coalesce(u, 0) AS total_unread FROM categories c LEFT JOIN (SELECT category_id, count(*) AS n FROM feeds GROUP BY 1) USING (category_id)
      LEFT JOIN (SELECT category_id, count(*) AS u FROM entries e JOIN feeds USING (feed_id) WHERE status = 'unread' AND NOT hidden GROUP BY 1) USING (category_id) WHERE c.user_id = 1""",
    "navigation": "SELECT (SELECT count(*) FROM entries WHERE user_id = 1 AND status = 'unread' AND NOT hidden AND feed_id IN (SELECT feed_id FROM visible)) AS unread, (SELECT count(*) FROM feeds WHERE user_id = 1 AND parsing_error_count >= 2) AS error_feeds",
    "weekly_frequency": """SELECT CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END::BIGINT AS feed_id,
      CASE WHEN count(*) > 1 AND max(ts) > min(ts) THEN ceil(604800 / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / (count(*) - 1))) ELSE 0 END::BIGINT AS per_week
      FROM events WHERE ts >= TIMESTAMP '2024-01-13' AND ts <= TIMESTAMP '2024-01-20' GROUP BY event_type""",
    "due_feeds": "SELECT feed_id, host FROM (SELECT * FROM feeds WHERE next_check_at < TIMESTAMP '2024-01-03' AND NOT disabled AND parsing_error_count < 3 ORDER BY next_check_at, feed_id LIMIT 20) QUALIFY row_number() OVER (PARTITION BY host ORDER BY next_check_at, feed_id) <= 2",
    "fever_items": "SELECT entry_id AS id, feed_id, title, CASE WHEN status = 'read' THEN 1 ELSE 0 END AS is_read, CASE WHEN starred THEN 1 ELSE 0 END AS is_saved, epoch(published_at)::BIGINT AS created_on FROM entries WHERE user_id = 1 AND entry_id > 50 ORDER BY entry_id LIMIT 50",
    "fever_groups": "SELECT category_id AS group_id, string_agg(feed_id::VARCHAR, ',' ORDER BY feed_id) AS feed_ids FROM feeds WHERE user_id = 1 GROUP BY 1",
    "fever_unread_ids": "SELECT string_agg(entry_id::VARCHAR, ',' ORDER BY entry_id) AS ids FROM entries WHERE user_id = 1 AND status = 'unread' AND NOT hidden",
    "long_item_ids": "SELECT entry_id, 'tag:google.com,2005:reader/item/' || lpad(lower(to_hex(entry_id)), 16, '0') AS item FROM entries",
    "reading_list_ids": "SELECT entry_id FROM entries WHERE user_id = 1 AND status <> 'removed' AND published_at > TIMESTAMP '2024-01-01 01:00:00' ORDER BY published_at DESC, entry_id DESC LIMIT 100 OFFSET 20",
    "archive_snapshot": f"SELECT entry_id FROM entries WHERE entry_id NOT IN (SELECT entry_id FROM entries WHERE status = 'read' AND NOT starred AND share_code = '' AND created_at < TIMESTAMP '2024-01-05' - INTERVAL 4 DAYS + INTERVAL 8 HOURS ORDER BY created_at, entry_id LIMIT 30)",
    "flush_history_tombstones": "SELECT feed_id, hash FROM entries WHERE user_id = 1 AND status = 'read' AND NOT starred AND share_code = '' UNION SELECT feed_id, hash FROM tombstones",
    "set_status": f"{_CHANGED} (SELECT entry_id, CASE WHEN user_id = 1 AND entry_id IN (3, 6, 7) THEN 'read' ELSE status END AS status, CASE WHEN user_id = 1 AND entry_id IN (3, 6, 7) THEN {AS_OF} ELSE changed_at END AS changed_at FROM entries)",
    "set_status_count_visible": "SELECT count(*) AS n FROM entries WHERE user_id = 1 AND entry_id IN (3, 6, 9, 12, 15) AND feed_id IN (SELECT feed_id FROM visible)",
    "toggle_starred": "SELECT entry_id, CASE WHEN user_id = 1 AND entry_id = 21 THEN NOT starred ELSE starred END AS starred FROM entries",
    "set_hidden_bulk": "SELECT entry_id, CASE WHEN user_id = 2 AND entry_id IN (1, 4) THEN TRUE ELSE hidden END AS hidden, CASE WHEN user_id = 2 AND entry_id IN (1, 4) THEN 'bulk' ELSE hidden_reason END AS hidden_reason FROM entries",
    "mark_read_before": f"{_CHANGED} (SELECT entry_id, CASE WHEN hit THEN 'read' ELSE status END AS status, CASE WHEN hit THEN {AS_OF} ELSE changed_at END AS changed_at FROM (SELECT *, user_id = 1 AND status = 'unread' AND published_at < TIMESTAMP '2024-01-01 05:00:00' AS hit FROM entries))",
    "mark_category_read": f"{_CHANGED} (SELECT entry_id, CASE WHEN hit THEN 'read' ELSE status END AS status, CASE WHEN hit THEN {AS_OF} ELSE changed_at END AS changed_at FROM (SELECT *, status = 'unread' AND published_at < TIMESTAMP '2024-01-01 08:00:00' AND feed_id IN (SELECT feed_id FROM feeds WHERE user_id = 1 AND category_id = 10) AS hit FROM entries))",
    "mark_visible_read": f"{_CHANGED} (SELECT entry_id, CASE WHEN hit THEN 'read' ELSE status END AS status, CASE WHEN hit THEN {AS_OF} ELSE changed_at END AS changed_at FROM (SELECT *, user_id = 2 AND status = 'unread' AND published_at < TIMESTAMP '2024-01-01 08:00:00' AND feed_id IN (SELECT feed_id FROM visible) AS hit FROM entries))",
    "hide_category": "SELECT entry_id, hidden OR (user_id = 1 AND status = 'unread' AND published_at < TIMESTAMP '2024-01-01 08:00:00' AND feed_id IN (SELECT feed_id FROM feeds WHERE user_id = 1 AND category_id = 10)) AS hidden FROM entries",
    "hide_feed_backlog": "SELECT entry_id, hidden OR (user_id = 1 AND feed_id = 3) AS hidden FROM entries",
    "remove_categories": "SELECT feed_id, CASE WHEN user_id = 1 AND category_id = 10 THEN (SELECT arg_min(category_id, title) FROM categories WHERE user_id = 1 AND category_id <> 10) ELSE category_id END AS category_id FROM feeds",
    "opml_export": """SELECT c.title AS category, '<outline text="' || c.title || '">' || string_agg('<outline title="' || f.title || '" text="' || f.title || '" xmlUrl="' || f.feed_url || '" htmlUrl="https://' || f.host || '/" type="rss"/>', '' ORDER BY lower(f.title)) || '</outline>' AS outline
      FROM feeds f JOIN categories c USING (category_id) WHERE f.user_id = 1 GROUP BY c.title""",
    "pending_entries": "SELECT e.entry_id FROM entries e LEFT JOIN state s USING (entry_id) WHERE e.entry_id > 20 AND (s.entry_id IS NULL OR s.status = 'failed' OR s.content_hash <> md5('v3|hash@1#64|' || title || content)) ORDER BY 1 LIMIT 200",
    "pending_counts": "SELECT (SELECT count(*) FROM entries e LEFT JOIN state s USING (entry_id) WHERE s.entry_id IS NULL OR s.status = 'failed' OR s.content_hash <> md5('v3|hash@1#64|' || title || content)) AS exact, greatest((SELECT count(*) FROM entries) - (SELECT count(*) FROM state WHERE status <> 'failed'), 0) AS estimate, (SELECT count(*) FROM state WHERE status = 'ok') AS indexed, (SELECT max(entry_id) FROM entries) AS max_id",
    "latest_state": "SELECT entry_id, status, indexed_at FROM (SELECT entry_id, 'ok' AS status, indexed_at + INTERVAL 1 DAY AS indexed_at FROM state WHERE entry_id % 2 = 0 UNION ALL SELECT entry_id, status, indexed_at FROM state WHERE entry_id % 2 = 1)",
    "block_keep_filter": "SELECT entry_id FROM entries WHERE NOT (regexp_matches(title, '^The') OR language = 'de' OR author = 'author3') AND (regexp_matches(content, 'tion') OR source = 'src1' OR published_at > TIMESTAMP '2024-01-02')",
    "date_rules": "SELECT entry_id FROM entries WHERE NOT (published_at < TIMESTAMP '2024-01-03' - INTERVAL 60 HOURS OR (published_at > TIMESTAMP '2024-01-01' AND published_at < TIMESTAMP '2024-01-01'))",
    "url_domain": r"SELECT page_id, lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS domain, regexp_replace(lower(regexp_extract(url, '://([^/?#:]+)', 1)), '^www\.', '') AS bare, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/' AS root FROM pages",
    "url_clean": r"""SELECT page_id, CASE WHEN len(kept) < len(q) THEN regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_sort(kept), '&') ELSE '' END || regexp_extract(url, '(#.*)$', 1) ELSE url END AS url
      FROM (SELECT page_id, url, q, list_filter(q, lambda p: NOT (starts_with(lower(p), 'utm_') OR starts_with(lower(p), 'mtm_') OR lower(split_part(p, '=', 1)) IN ('fbclid', 'gclid', 'yclid', 'mc_cid', 'msclkid'))) AS kept
      FROM (SELECT page_id, url, CASE WHEN contains(url, '?') THEN string_split(regexp_extract(url, '\?([^#]*)', 1), '&') ELSE [] END AS q FROM pages))""",
    "word_count": r"SELECT entry_id, len(regexp_extract_all(content, '[^\x20\x09-\x0D]+')) AS words FROM entries",
    "reading_time": f"SELECT entry_id, {minutes('content')} AS minutes FROM entries",
    "language_normalize": "SELECT entry_id, lower(replace(trim(language), '_', '-')) AS language FROM entries",
    "strip_tags": f"SELECT page_id, {strip('html')} AS text FROM pages",
    "nl2br": r"SELECT entry_id, md5(replace(content, chr(10), '<br>')) AS digest FROM entries",
    "knn_cosine_topk": "SELECT passage_id, entry_id, distance, rank FROM semantic",
    "entry_aggregate": "SELECT entry_id, arg_min(passage_id, rank) AS best_passage, min(rank) AS best_rank, string_agg(passage_id::VARCHAR, ',' ORDER BY rank) AS passages FROM semantic GROUP BY 1",
    "similar_entries": "SELECT passage_id, entry_id, distance, rank FROM hits",
    "recall_at_k": "SELECT q AS query_id, round(count(*) FILTER (hit) / max(t), 6) AS recall FROM ranked WHERE rank <= 10 GROUP BY 1",
    "knn_many": "SELECT q AS query_id, passage_id, distance, rank FROM ranked WHERE rank <= 5",
    "read_feed_documents": r"SELECT url, CASE WHEN t = '' THEN url ELSE t END AS title, sha256(hash) AS hash, published_at FROM (SELECT url, hash, published_at, regexp_replace(regexp_replace(title, '[<>&]', '', 'g'), '^[\s\x0B]+|[\s\x0B]+$', '', 'g') AS t FROM entries)",
    "extract_text": f"SELECT page_id, {shown('html')} AS text FROM pages",
    "gauges": """SELECT unnest(['entries', 'entries_unread', 'entries_hidden', 'feeds', 'feeds_disabled', 'feeds_broken', 'indexed', 'failed', 'skipped']) AS name, unnest([(SELECT count(*) FROM entries), (SELECT count(*) FROM entries WHERE status = 'unread'),
      (SELECT count(*) FROM entries WHERE hidden), (SELECT count(*) FROM feeds), (SELECT count(*) FROM feeds WHERE disabled), (SELECT count(*) FROM feeds WHERE parsing_error_count > 0), (SELECT count(*) FROM state WHERE status = 'ok'), (SELECT count(*) FROM state WHERE status = 'failed'), (SELECT count(*) FROM state WHERE status = 'skipped')]) AS value""",
    "corpus_guard": "SELECT count(*) AS passages, count(*) FILTER (ordinal = 0) AS titles, round(min(n), 6) AS min_norm, round(max(n), 6) AS max_norm FROM (SELECT sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n, ordinal FROM passages)",
    "events_tumbling": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "events_sliding": "SELECT time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * k) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, range(4) r(k) GROUP BY 1, 2",
    "events_sessions": "SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s",
    "guid_collisions": "SELECT entry_id, row_number() OVER (PARTITION BY feed_id, hash ORDER BY entry_id) - 1 AS occurrence FROM entries",
    "without_full_text": "SELECT entry_id FROM entries WHERE full_text_fetched_at IS NULL AND entry_id > 10 ORDER BY 1 LIMIT 100",
    "shared_icons": "SELECT DISTINCT icon_id FROM feeds WHERE icon_id IS NOT NULL AND user_id = 1",
    "failure_causes": "SELECT regexp_replace(props, '\\d+', 'N', 'g') AS cause, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1",
}
_LONG = "sqrt(list_dot_product({0}.embedding::DOUBLE[], {0}.embedding::DOUBLE[]))"
RANKED = f"""pairs AS (SELECT a.passage_id AS q, b.passage_id, a.label = b.label AS hit, round(1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / ({_LONG.format('a')} * {_LONG.format('b')}), 6) + 0.0 AS distance,
  (SELECT count(*) FROM passages c WHERE c.label = a.label) AS t FROM (SELECT * FROM passages WHERE passage_id % 50 = 0) a, passages b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, passage_id) AS rank FROM pairs)"""
EXTRA = {
    "knn_cosine_topk": knn(20),
    "entry_aggregate": knn(50),
    "similar_entries": _SIMILAR,
    "recall_at_k": RANKED,
    "knn_many": RANKED,
}


def _expanded(extra: str) -> str:
    """bm25:terms:k, knn:k:condition and hybrid stand for the SQL of these searches."""
    kind, _, rest = extra.partition(":")
    if extra == "split":
        return indexes._SPLIT.replace("{shown}", shown("content")).replace("{stop}", indexes._STOP)
    if extra in ("ranked", "similar"):
        return RANKED if extra == "ranked" else _SIMILAR
    if extra.endswith("bm25 of revised"):
        return extra.replace("bm25 of revised", bm25("'now', 'the', 'ing'", 40).replace("FROM entries", "FROM revised").replace("lower(content)", "lower(title || ' ' || content)"))
    if kind == "bm25":
        words, _, k = rest.rpartition(":")
        return bm25(words, int(k))
    if kind == "knn":
        k, _, where = rest.partition(":")
        return knn(int(k), where)
    return f"{bm25("'the', 'ing', 'der'", 50)},\n{knn(50)},\n{reading._HYBRID}" if extra == "hybrid" else extra


def oracle_sql() -> dict[str, str]:
    bodies, extra = dict(BODIES), dict(EXTRA)
    for module in (changes, reading, scalars, indexes):
        bodies |= module.SQL
        extra |= {k: _expanded(x) for k, x in module.EXTRA.items()}
    extra["page_reading_time"] = f"pages_read AS (SELECT page_id, {minutes('html')} AS minutes FROM pages)"
    return {k: f"WITH {'RECURSIVE ' if extra.get(k, '').find('UNION ALL SELECT entry_id, n + 1') > 0 else ''}{PRELUDE}{'' if 'enclosures AS (' in extra.get(k, '') else ENCLOSURES}{',' + extra[k] if k in extra else ''}\n{body}" for k, body in bodies.items()}
