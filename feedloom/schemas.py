"""Explicit schemas of the corpus tables."""

ENTRIES = """entry_id long, user_id long, feed_id long, hash string, published_at timestamp, title string, url string,
comments_url string, author string, content string, status string, starred boolean, hidden boolean, hidden_reason string,
share_code string, reading_time int, created_at timestamp, changed_at timestamp, tags array<string>, language string,
full_text_fetched_at timestamp"""
FEEDS = """feed_id long, user_id long, category_id long, feed_url string, site_url string, title string, disabled boolean,
hide_globally boolean, crawler boolean, parsing_error_count int, next_check_at timestamp, checked_at timestamp,
blocklist_rules string, keeplist_rules string, block_filter_entry_rules string, keep_filter_entry_rules string, url_rewrite_rules string"""
CATEGORIES = "category_id long, user_id long, title string, hide_globally boolean"
USERS = "user_id long, username string, timezone string, default_reading_speed int, cjk_reading_speed int"
ENCLOSURES = "enclosure_id long, user_id long, entry_id long, url string, mime_type string, size long, media_progression long"
ICONS = "icon_id long, hash string, mime_type string, content binary, external_id string"
FEED_ICONS = "feed_id long, icon_id long"
TOMBSTONES = "feed_id long, hash string, deleted_at timestamp"
PASSAGES = "passage_id long, entry_id long, ordinal int, text string, char_start int, char_end int, source string, embedding array<float>"
INDEX_STATE = "entry_id long, content_hash string, indexed_at timestamp, status string, reason string"
LABELLED_QUERIES = "text string, relevant_entry_ids array<long>, note string"
#: A parsed feed document: one row an item, the feed's own fields repeated.
PARSED = """feed_title string, feed_url string, site_url string, title string, url string, hash string, author string, content string,
published string, tags array<string>, comments_url string, enclosures array<struct<url:string,mime_type:string,size:long>>"""
