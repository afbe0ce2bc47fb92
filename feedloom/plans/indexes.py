"""Registered queries of indexes and stores on disk, each with its SQL: what a search finds must be what the tables say, also after changes."""

from __future__ import annotations

import atexit
import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions import stem as S
from feedloom.operators import indexing, mutate, postings, retrieval, sketches, vectors
from feedloom.sources import corpus as C
from feedloom.sources.versions import Store

NOW = datetime(2024, 1, 1, 12)
QUERIES: dict = {}
SQL: dict[str, str] = {}
EXTRA: dict[str, str] = {}


def query(sql: str, extra: str = ""):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        if extra:
            EXTRA[f.__name__] = extra
        return f

    return register


def _scratch(spark, name: str) -> str:
    """A folder of its own for what a query builds and changes; it goes at the end of the program."""
    path = f"{postings.folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(postings._quietly_delete, spark, path)
    return path


# Nearest passages.
def _vector(spark, sf):
    return C.passages(spark, sf).filter("passage_id = 7").first()["embedding"]


@query("SELECT passage_id, entry_id, distance, rank FROM semantic", "knn:20:TRUE")
def knn_index_topk(spark, sf):
    """Lists are left out only where their bound proves that they hold nothing nearer."""
    p = C.passages(spark, sf)
    return vectors.index_of(p, sf).nearest(_vector(spark, sf), 20, exact=True)


@query("SELECT passage_id, entry_id, distance, row_number() OVER (ORDER BY distance, passage_id) AS rank FROM d QUALIFY rank <= 9", "knn:9:p.entry_id IN (SELECT entry_id FROM entries WHERE user_id = 1 AND NOT starred)")
def knn_index_within(spark, sf):
    own = C.entries(spark, sf).filter("user_id = 1 AND NOT starred").select("entry_id")
    return vectors.index_of(C.passages(spark, sf), sf).nearest(_vector(spark, sf), 9, within=own, exact=True)


@query("SELECT count(*) AS asked, TRUE AS enough FROM passages WHERE passage_id % 50 = 0")
def knn_index_recall(spark, sf):
    """Every 50th passage asks the nearest lists for 10; at least nine tenths of what a comparison with all rows finds must be there."""
    p = C.passages(spark, sf)
    q = p.filter("passage_id % 50 = 0").select(F.col("passage_id").alias("query_id"), "embedding")
    found = vectors.index_of(p, sf).nearest_many(q, 10).select("query_id", "passage_id")
    true = retrieval.knn_many(p, q, 10).select("query_id", "passage_id")
    hit = true.join(found, ["query_id", "passage_id"], "left_semi").agg(F.count("*").alias("hits"))
    every = true.agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("asked"))
    return every.join(F.broadcast(hit)).select("asked", (F.col("hits") >= 0.9 * F.col("n")).alias("enough"))


@query("SELECT q AS query_id, passage_id, distance, rank FROM ranked WHERE rank <= 5", "ranked")
def knn_index_many(spark, sf):
    p = C.passages(spark, sf)
    q = p.filter("passage_id % 50 = 0").select(F.col("passage_id").alias("query_id"), "embedding")
    return vectors.index_of(p, sf).nearest_many(q, 5, exact=True).select("query_id", "passage_id", "distance", "rank")


@query("SELECT passage_id, entry_id, distance, rank FROM hits", "similar")
def similar_by_index(spark, sf):
    p = C.passages(spark, sf)
    return vectors.index_of(p, sf).similar(p, 3, 10, exact=True)


_TURNED = """turned AS (SELECT passage_id, entry_id, CASE WHEN passage_id % 7 = 0 THEN list_reverse(embedding) ELSE embedding END AS v FROM passages WHERE passage_id % 11 <> 3),
far AS (SELECT t.passage_id, t.entry_id, round(1 - list_dot_product(t.v::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(t.v::DOUBLE[], t.v::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6) + 0.0 AS distance
  FROM turned t, (SELECT embedding FROM passages WHERE passage_id = 7) q)"""


@query("SELECT passage_id, entry_id, distance, row_number() OVER (ORDER BY distance, passage_id) AS rank FROM far QUALIFY rank <= 15", _TURNED)
def knn_index_after_changes(spark, sf):
    """Two thirds are indexed at first; the others come later, some vectors change, some rows go, and the segments are merged."""
    p = C.passages(spark, sf)
    index = vectors.build(p.filter("passage_id % 3 <> 1"), _scratch(spark, "vectors"))
    index.update(p.filter("passage_id % 3 = 1"))
    index.update(p.filter("passage_id % 7 = 0").withColumn("embedding", F.reverse("embedding")), deleted=p.filter("passage_id % 11 = 3"))
    index.update(deleted=p.filter("passage_id % 77 = 14").select("passage_id"))  # what is gone already
    index.merge()
    return index.nearest(_vector(spark, sf), 15, exact=True)


# Full text.
_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_CODE = "lower(regexp_extract(trim(language), '^([A-Za-z]*)', 1))"


def _tokens(stemmed: bool, source: str = "entries") -> str:
    """tok: entry_id, place, w (weight) of every word, title first; its term, stemmed by language or not."""
    term = S.stem_sql("word", "code") if stemmed else "word"
    return rf"""cut AS (SELECT entry_id, {_CODE} AS code, {_WORDS.format("title")} AS a, {_WORDS.format("content")} AS b FROM {source}),
words AS (SELECT entry_id, code, unnest(list_concat(a, b)) AS word, unnest(range(len(a) + len(b))) AS place, len(a) AS n_title FROM cut),
tok AS (SELECT entry_id, code, {term} AS term, place, CASE WHEN place < n_title THEN 1.0 ELSE 0.4 END AS w FROM words)"""


def _slots(*words: str, stemmed: bool = False) -> str:
    """slot: places of the words asked for, numbered, the first 256 of each."""
    rows = ", ".join(f"('{code}', {i}, '{S.stem_word(w, code)}')" for code in ([*S.RULES] if stemmed else [""]) for i, w in enumerate(words))
    on = "t.code = x.code" if stemmed else "TRUE"
    return f"""asked(code, slot, term) AS (VALUES {rows}),
every AS (SELECT entry_id, slot, place, w FROM tok t JOIN asked x ON t.term = x.term AND {on}),
slot AS (SELECT *, row_number() OVER (PARTITION BY entry_id, slot ORDER BY place) AS j FROM every),
near AS (SELECT a.entry_id, greatest(1 - product(1 - sqrt(a.w * b.w / (1.005 + 0.05 * exp(abs(a.place - b.place) / 1.5 - 2)))), 1e-20) AS rank FROM slot a JOIN slot b ON a.entry_id = b.entry_id AND a.slot < b.slot
  AND abs(a.place - b.place) BETWEEN 1 AND 100 AND a.j <= 256 AND b.j <= 256 GROUP BY 1),
often AS (SELECT entry_id, sum(w / (j * j)) / (1.64493406685 * {len(words)}) AS rank FROM slot WHERE j <= 256 GROUP BY 1)"""


def _hold(*slots: int) -> str:
    return " AND ".join(f"entry_id IN (SELECT entry_id FROM every WHERE slot = {i})" for i in slots)


def _follow(*slots: int) -> str:
    joins = " ".join(f"JOIN every s{n} ON s{n}.entry_id = s0.entry_id AND s{n}.slot = {i} AND s{n}.place = s0.place + {n}" for n, i in enumerate(slots[1:], 1))
    return f"entry_id IN (SELECT s0.entry_id FROM every s0 {joins} WHERE s0.slot = {slots[0]})"


def _text(spark, sf, stemmed: bool = False) -> postings.TextIndex:
    return postings.index_of(C.entries(spark, sf), sf, "entry_id", "content", "title", "language" if stemmed else "")


_FOUND = "SELECT entry_id, round(coalesce({rank}, 1e-20), 6) AS rank FROM (SELECT DISTINCT entry_id FROM tok) LEFT JOIN near USING (entry_id) LEFT JOIN (SELECT entry_id, rank AS many FROM often) USING (entry_id) WHERE {where}"


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("entry_id", F.round("rank", 6).alias("rank"))


@query(_FOUND.format(rank="rank", where=_hold(0, 1)), f"{_tokens(False)},\n{_slots('the', 'ing')}")
def full_text_by_distance(spark, sf):
    return _rounded(_text(spark, sf).search("the ing"))


@query(_FOUND.format(rank="many", where=f"{_follow(0, 1)} AND NOT ({_hold(4)}) OR {_hold(2, 3)}"), f"{_tokens(False)},\n{_slots('of', 'the', 'und', 'der', 'was')}".replace("1.64493406685 * 5", "1.64493406685 * 4").replace("FROM slot WHERE j <= 256 GROUP", "FROM slot WHERE j <= 256 AND slot < 4 GROUP"))
def full_text_index_phrases(spark, sf):
    """The same matches and ranks as full_text_phrases, from places instead of texts."""
    return _rounded(_text(spark, sf).search('"of the" -was or und der'))


@query(_FOUND.format(rank="rank", where=f"{_follow(0, 1)} AND {_hold(2)}"), f"{_tokens(False)},\n{_slots('to', 'thanedble', 'anea')}")
def full_text_phrase_and_word(spark, sf):
    return _rounded(_text(spark, sf).search('"to thanedble" anea'))


@query("SELECT entry_id FROM entries WHERE entry_id NOT IN (SELECT entry_id FROM tok WHERE term IN ('the', 'der'))", _tokens(False))
def full_text_index_without(spark, sf):
    """Words that must not be there, and none that must."""
    return _text(spark, sf).search("-the -der").select("entry_id")


@query(f"SELECT DISTINCT code, word, {S.stem_sql('word', 'code')} AS stem FROM words", _tokens(False))
def stemmed_words(spark, sf):
    """Every word of every text, with its stem in the language of the text."""
    e = C.entries(spark, sf)
    both = F.concat(retrieval.tokens(F.col("title")), retrieval.tokens(F.col("content")))
    words = e.select(S.language(F.col("language")).alias("code"), F.explode(both).alias("word")).distinct()
    return words.select("code", "word", S.stem(F.col("word"), F.col("code")).alias("stem"))


@query(_FOUND.format(rank="rank", where=_hold(0, 1)), f"{_tokens(True)},\n{_slots('tions', 'reeded', stemmed=True)}")
def full_text_stemmed(spark, sf):
    """Words are found by their stems, each in the language of the entry."""
    return _rounded(_text(spark, sf, stemmed=True).search("tions reeded"))


@query(_FOUND.format(rank="rank", where=_follow(0, 1)), f"{_tokens(True)},\n{_slots('and', 'attions', stemmed=True)}")
def full_text_stemmed_phrase(spark, sf):
    return _rounded(_text(spark, sf, stemmed=True).search('"and attions"'))


_REVISED = """revised AS (SELECT entry_id, language, CASE WHEN entry_id % 6 = 0 THEN 'ing und the' ELSE title END AS title, CASE WHEN entry_id % 6 = 0 THEN 'now ' || content ELSE content END AS content FROM entries WHERE entry_id % 10 <> 4)"""


def _revised(spark, sf) -> postings.TextIndex:
    """An index of four fifths of the entries; then the others come, some are rewritten, some deleted, some of these written again and deleted again."""
    e = C.entries(spark, sf).select("entry_id", "title", "content", "language")
    new = e.filter("entry_id % 6 = 0").withColumns({"title": F.lit("ing und the"), "content": F.concat(F.lit("now "), "content")})
    index = postings.build(e.filter("entry_id % 5 <> 2"), _scratch(spark, "text"), "entry_id", "content", "title")
    gone = e.filter("entry_id % 10 = 4").select(F.col("entry_id").alias("doc"))
    index.update(e.filter("entry_id % 5 = 2"), deleted=gone)
    index.update(e.filter("entry_id % 20 = 4"))
    index.update(new.filter("entry_id % 10 <> 4"), deleted=gone)
    return index


@query(_FOUND.format(rank="rank", where=_hold(0, 1)), f"{_REVISED},\n{_tokens(False, 'revised')},\n{_slots('the', 'ing')}")
def full_text_after_changes(spark, sf):
    return _rounded(_revised(spark, sf).search("the ing"))


@query(_FOUND.format(rank="rank", where=_follow(0, 1)), f"{_REVISED},\n{_tokens(False, 'revised')},\n{_slots('und', 'the')}")
def full_text_after_merge(spark, sf):
    index = _revised(spark, sf)
    index.merge(whole=True)
    return _rounded(index.search('"und the"'))


@query("SELECT entry_id, score, rank FROM lexical", f"{_REVISED},\nbm25 of revised")
def bm25_after_changes(spark, sf):
    """Numbers of documents and lengths follow the changes too."""
    return _revised(spark, sf).bm25("now the ing", 40, "entry_id")


# Changes on files.
def _store(spark, sf) -> Store:
    return Store.create(_scratch(spark, "store"), 16, entries=(C.entries(spark, sf), "entry_id"), tombstones=(C.tombstones(spark, sf), "hash"))


_CHANGED = "SELECT entry_id, CASE WHEN hit THEN 'read' ELSE status END AS status, CASE WHEN hit THEN TIMESTAMP '2024-01-01 12:00:00' ELSE changed_at END AS changed_at FROM"


@query(f"{_CHANGED} (SELECT *, user_id = 1 AND entry_id IN (3, 6, 7) AS hit FROM entries)")
def store_set_status(spark, sf):
    store, ids = _store(spark, sf), [3, 6, 7]
    store.change(lambda t: {"entries": mutate.set_status(t["entries"], 1, ids, "read", NOW)}, entries=ids)
    return store.table("entries").select("entry_id", "status", "changed_at")


@query("SELECT 'entries' AS kept, sha256(feed_id || hash) AS item FROM entries WHERE NOT (user_id = 1 AND status = 'read' AND NOT starred AND share_code = '') UNION ALL SELECT DISTINCT 'tombstones', sha256(feed_id || hash) FROM (SELECT feed_id, hash FROM tombstones UNION ALL SELECT feed_id, hash FROM entries WHERE user_id = 1 AND status = 'read' AND NOT starred AND share_code = '')")
def store_flush_history(spark, sf):
    """Entries go and their tombstones come in one version."""
    store = _store(spark, sf)
    gone = (F.col("user_id") == 1) & (F.col("status") == "read") & ~F.col("starred") & (F.col("share_code") == "")
    hashes = store.table("entries").filter(gone).select("hash")

    def flush(t):
        entries, marks = mutate.flush_history(t["entries"], t["tombstones"], 1, NOW)
        return {"entries": entries, "tombstones": marks}

    store.change(flush, entries=gone, tombstones=hashes)
    item = F.sha2(F.concat(F.col("feed_id").cast("string"), "hash"), 256).alias("item")
    parts = [store.table(name).select(F.lit(name).alias("kept"), item) for name in ("entries", "tombstones")]
    return parts[0].unionByName(parts[1])


@query("SELECT entry_id, title FROM entries WHERE entry_id % 10 <> 9 UNION ALL SELECT entry_id, 'late ' || title FROM entries WHERE entry_id % 10 = 9 UNION ALL SELECT entry_id + 1000000, title FROM entries WHERE entry_id % 50 = 1")
def store_upsert(spark, sf):
    """Rows that come in replace those of their id or are added; buckets that get none stay as they are."""
    store = _store(spark, sf)
    e = C.entries(spark, sf)
    new = e.filter("entry_id % 10 = 9").withColumn("title", F.concat(F.lit("late "), "title")).unionByName(e.filter("entry_id % 50 = 1").withColumn("entry_id", F.col("entry_id") + 1_000_000))
    store.change(lambda t: {"entries": t["entries"].join(new.select("entry_id"), "entry_id", "left_anti").unionByName(new)}, entries=new)
    return store.table("entries").select("entry_id", "title")


@query("SELECT entry_id, starred FROM entries WHERE entry_id IN (5, 21, 34)")
def store_lookup(spark, sf):
    """Rows of some ids, read from their buckets alone, in the version before a change."""
    store = _store(spark, sf)
    store.change(lambda t: {"entries": mutate.toggle_starred(t["entries"], 1, 21, NOW)}, entries=[21])
    return store.table("entries", keys=[5, 21, 34], version=1).select("entry_id", "starred")


# Nested parts of feed documents.
_SHOW = """<rss version='2.0' xmlns:itunes='http://www.itunes.com/dtds/podcast-1.0.dtd' xmlns:media='http://search.yahoo.com/mrss/'><channel><link>https://e.org/</link><itunes:explicit>{2}</itunes:explicit><itunes:image href='/show.png'/>
<itunes:category text='Arts'><itunes:category text='Books'><itunes:category text='B{1}'/></itunes:category></itunes:category><itunes:category text='News'/>
<item><title>T</title><itunes:title>Episode {0}</itunes:title><guid>g{0}</guid><link>/{0}</link><itunes:episode>{1}</itunes:episode><itunes:duration>1:0{1}</itunes:duration><media:thumbnail url='/t{0}.png'/><enclosure url='/a{0}.mp3' type='audio/mpeg' length='{0}'/>
<media:group><media:content url='/a{0}.mp3' medium='audio'/><media:content url='/v{0}.mp4' medium='video' fileSize='7'/><media:description>see https://x.org/{0} now</media:description></media:group><media:group><media:peerLink href='/p{0}.torrent' type='application/x-bittorrent'/><media:thumbnail url='/u{0}.png'/></media:group></item></channel></rss>"""


def _episodes(spark, sf):
    from feedloom.sources import formats

    parts = _SHOW.replace("{0}", "\0{0}\0").replace("{1}", "\0{1}\0").replace("{2}", "\0{2}\0").split("\0")
    values = {"{0}": F.col("entry_id").cast("string"), "{1}": (F.col("entry_id") % 7).cast("string"), "{2}": F.when(F.col("entry_id") % 2 == 0, "yes").otherwise("no")}
    content = F.concat(*(values.get(x, F.lit(x)) for x in parts))
    return formats.read_episodes(C.entries(spark, sf).select("url", content.alias("content")))


@query("SELECT 'g' || entry_id AS guid, 'Episode ' || entry_id AS title, (entry_id % 7)::INT AS episode, '1:0' || (entry_id % 7) AS duration, entry_id % 2 = 0 AS explicit, 'https://e.org/show.png' AS image, 'see <a href=\"https://x.org/' || entry_id || '\">https://x.org/' || entry_id || '</a> now' AS description FROM entries")
def podcast_episodes(spark, sf):
    return _episodes(spark, sf).select("guid", "title", "episode", "duration", "explicit", "image", "description")


@query("SELECT 'g' || entry_id AS guid, unnest(['Arts', 'Books', 'B' || (entry_id % 7), 'News']) AS name, unnest(['', 'Arts', 'Books', '']) AS above, unnest([1, 2, 3, 1]) AS depth FROM entries")
def podcast_categories(spark, sf):
    """Categories three levels deep."""
    return _episodes(spark, sf).select("guid", F.inline("categories"))


@query("""SELECT 'g' || entry_id AS guid, unnest(range(5)) AS place, unnest(['thumbnail', 'thumbnail', 'enclosure', 'content', 'peer']) AS kind, unnest([-1, 1, -1, 0, 1]) AS "group", 'https://e.org/' || unnest(['t' || entry_id || '.png', 'u' || entry_id || '.png', 'a' || entry_id || '.mp3', 'v' || entry_id || '.mp4', 'p' || entry_id || '.torrent']) AS url,
  unnest(['image/*', 'image/*', 'audio/mpeg', 'video/*', 'application/x-bittorrent']) AS mime_type, unnest([0, 0, entry_id, 7, 0]) AS size FROM entries""")
def podcast_media(spark, sf):
    """Attachments of items and of their groups; an address that came before isn't repeated."""
    return _episodes(spark, sf).select("guid", F.posexplode("media").alias("place", "m")).select("guid", "place", "m.*")


# Passages.
#: Windows of whole sentences: c has the words before each sentence, b the bytes before each word, and a window ends where it has 320 words, or before 512 are exceeded; the next begins 64 words back.
_SPLIT = """plain AS (SELECT entry_id, title, string_split({shown}, ' ') AS w FROM entries),
ends AS (SELECT entry_id, title, w, list_concat([0], list_filter(range(1, len(w) + 1), lambda i: i = len(w) OR regexp_matches(w[i], '[.!?]$'))) AS c, list_concat([0], list_transform(range(1, len(w) + 1), lambda i: list_sum(list_transform(w[1:i], lambda x: strlen(x) + 1))::BIGINT)) AS b FROM plain WHERE w <> ['']),
windows(entry_id, n, f, t) AS (SELECT entry_id, 0, 0, stop FROM (SELECT entry_id, {stop} AS stop FROM (SELECT *, 0 AS f FROM ends))
  UNION ALL SELECT entry_id, n + 1, f, {stop} FROM (SELECT e.*, x.n, greatest(x.f + 1, len(list_filter(e.c[1:x.t], lambda v: e.c[x.t + 1] - v >= 64)) - 1) AS f FROM windows x JOIN ends e USING (entry_id) WHERE x.t < len(e.c) - 1))"""
_STOP = "CASE WHEN {e} - f > 1 AND c[{e} + 1] - c[f + 1] > 512 THEN {e} - 1 ELSE {e} END".format(e="least(len(list_filter(c, lambda v: v - c[f + 1] < 320)), len(c) - 1)")
_PASSAGES = """SELECT entry_id, 0 AS ordinal, 'title' AS source, title AS text, 0 AS char_start, strlen(title)::INT AS char_end FROM entries WHERE regexp_matches(title, '\\S')
  UNION ALL SELECT entry_id, (n + CASE WHEN regexp_matches(title, '\\S') THEN 1 ELSE 0 END)::INT, 'content', array_to_string(w[c[f + 1] + 1:c[t + 1]], ' '), b[c[f + 1] + 1]::INT, (b[c[t + 1] + 1] - 1)::INT FROM windows JOIN ends USING (entry_id)"""


@query(_PASSAGES, "split")
def passages_by_table_function(spark, sf):
    """Every entry joined laterally with its passages."""
    return indexing.passages_by_lateral(C.entries(spark, sf))


SQL["split_passages"], EXTRA["split_passages"] = _PASSAGES, "split"


# Sketches.
@query("SELECT count(*) AS n, (SELECT count(*) FROM entries) AS total FROM entries WHERE entry_id NOT IN (SELECT entry_id FROM state WHERE status <> 'failed')")
def pending_by_sketches(spark, sf):
    """How much is pending, without a look at an entry: exact at any size, from a bitmap of ids for each file."""
    state = _scratch(spark, "state")
    C.index_state(spark, sf).select("entry_id", "status").write.parquet(state)
    read = spark.read
    entries, done = sketches.FileBitmaps(spark, _scratch(spark, "entries-sketch")), sketches.FileBitmaps(spark, _scratch(spark, "state-sketch"))
    entries.refresh(f"{sf}/documents.parquet", lambda files: read.parquet(*files).select("doc_id"), "doc_id")
    done.refresh(state, lambda files: read.parquet(*files).filter("status <> 'failed'"), "entry_id")
    return sketches.pending(entries, done).withColumn("total", F.lit(entries.count()).cast("long"))
