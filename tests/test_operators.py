import json
import os
import shutil
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from feedloom.operators import entries as E
from feedloom.operators import evaluate, feeds, indexing, mutate
from feedloom.operators import retrieval as R
from feedloom.plans import api, oracle
from feedloom.sources import corpus as C
from feedloom.sources import formats
from feedloom.streaming import live
from tests.oracle import SF

NOW = datetime(2024, 1, 2)


def test_validators():
    for bad in (lambda: E.check_order("nonsense"), lambda: E.check_direction("up"), lambda: E.check_status("gone"), lambda: E.check_range(-1, 0)):
        with pytest.raises(E.QueryError):
            bad()
    assert E.clamp(0, 10) == 10 and E.clamp(11, 10) == 10 and E.clamp(3, 10) == 3


def test_list_entries_rule(spark):
    c = C.corpus(spark, SF)
    got = api.list_entries(c, 1, status=("unread",), limit=5, order="id", direction="desc").collect()
    assert len(got) == 5 and not any(r["hidden"] for r in got)
    assert got[0]["total"] == c.entries.filter("user_id = 1 AND status = 'unread' AND NOT hidden").count()


def test_pages():
    assert api.continuation(20, 40, 100) == 60 and api.continuation(20, 80, 100) == 0
    assert api.pages(95, 20, 20) == {"last": 80, "next": 40, "prev": 0}


def test_enclosures(spark):
    schema = "enclosure_id long, user_id long, entry_id long, url string, mime_type string, size long, media_progression long"
    stored = spark.createDataFrame([(1, 1, 1, "a", "audio/mp3", 1, 0), (2, 1, 1, "b", "x", 1, 0), (3, 1, 2, "a", "x", 1, 0), (4, 1, 2, "a", "x", 1, 0)], schema)
    new = spark.createDataFrame([(5, 1, 1, " a ", "x", 1, 0), (6, 1, 1, "c", "x", 1, 0), (7, 1, 1, " ", "x", 1, 0)], schema)
    assert sorted(r["enclosure_id"] for r in mutate.insert_enclosures(stored, new).collect()) == [1, 2, 3, 4, 6]
    assert sorted(r["enclosure_id"] for r in mutate.dedup_enclosures(stored).collect()) == [1, 2, 4]
    current = spark.createDataFrame([(1, "b")], "entry_id long, url string")
    assert sorted(r["enclosure_id"] for r in mutate.sync_enclosures(stored, current, current).collect()) == [2, 3, 4]


def test_icons_and_sessions(spark):
    icons = spark.createDataFrame([(1, "h1"), (2, "h2")], "icon_id long, hash string")
    links = spark.createDataFrame([(10, 1), (11, 2)], "feed_id long, icon_id long")
    incoming = spark.createDataFrame([(11, 3, "h1"), (12, 3, "h3")], "feed_id long, icon_id long, hash string")
    got, linked = mutate.store_icons(icons, links, incoming)
    assert sorted(r["hash"] for r in got.collect()) == ["h1", "h2", "h3"]
    assert sorted(map(tuple, linked.collect())) == [(10, 1), (11, 1), (12, 3)]
    assert sorted(r["icon_id"] for r in mutate.without_orphan_icons(got, linked).collect()) == [1, 3]


def test_bm25_prefers_rare_terms_and_is_empty_for_blank(spark):
    docs = spark.createDataFrame([(1, "common rare"), (2, "common common"), (3, "common")], "passage_id long, text string")
    assert [r["passage_id"] for r in R.bm25(docs, "rare common", 3).orderBy("rank").collect()][0] == 1
    assert R.bm25(docs, "  ", 3).count() == 0 and R.bm25(docs, "rare", 0).count() == 0


def test_fusion_reads_ranks_only(spark):
    a = spark.createDataFrame([(1, 1, 1, 9.0), (2, 1, 2, 0.1)], "passage_id long, entry_id long, rank int, score double")
    b = spark.createDataFrame([(2, 1, 1, 5.0), (3, 2, 2, 4.0)], "passage_id long, entry_id long, rank int, score double")
    assert [r["passage_id"] for r in R.fuse(a, b).orderBy("rank").collect()] == [2, 1, 3]
    assert [(r["entry_id"], r["best_passage"], r["passages"]) for r in R.by_entry(R.fuse(a, b)).orderBy("best_rank").collect()] == [(1, 2, [2, 1]), (2, 3, [3])]


def test_seeds_stride(spark):
    p = spark.createDataFrame([(i, 7, i, [1.0]) for i in range(70)], "passage_id long, entry_id long, ordinal int, embedding array<float>")
    assert sorted(r["ordinal"] for r in R.seeds(p, 7).collect()) == [i * 70 // 32 for i in range(32)]


def test_search_modes(spark):
    e = C.entries(spark, SF)
    p = indexing.make_passages(e).withColumn("passage_id", F.xxhash64("entry_id", "ordinal"))
    embed = indexing.hashing_embedder()
    p = indexing.embed_passages(p, embed).cache()
    word = e.first()["content"].split()[1]
    for mode in R.MODES:
        got = R.search(mode, p, word, 5, R.Filters(user_id=1), e, lambda q: embed([q])[0])
        assert 0 < got.count() <= 5
        assert got.join(e.filter("user_id <> 1"), "entry_id", "left_semi").count() == 0
    with pytest.raises(R.SearchError):
        R.search("magic", p, word, 5, R.Filters(1), e)
    with pytest.raises(R.SearchError):
        R.search("semantic", p, word, 5, R.Filters(1), e)


def test_recall_and_labels(spark, tmp_path):
    hits = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 6, 3), (2, 9, 1)], "query_id long, entry_id long, rank int")
    rel = spark.createDataFrame([(1, 5), (1, 7), (2, 8), (3, None)], "query_id long, entry_id long")
    assert {r["query_id"]: r["recall"] for r in evaluate.recall_at_k(hits, rel, 2).collect()} == {1: 0.5, 2: 0.0, 3: -1.0}
    f = tmp_path / "q.json"
    f.write_text(json.dumps([{"text": "a", "relevant_entry_ids": [1]}]))
    assert evaluate.labelled_queries(spark, str(f)).count() == 1
    f.write_text(json.dumps([{"text": " ", "relevant_entry_ids": [1]}]))
    with pytest.raises(evaluate.LabelError):
        evaluate.labelled_queries(spark, str(f))


def test_index_replace(spark):
    old = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "entry_id long, ordinal int, text string")
    state = spark.createDataFrame([(1, "h", NOW, "ok", None)], "entry_id long, content_hash string, indexed_at timestamp, status string, reason string")
    done = spark.createDataFrame([(1, "h2")], "entry_id long, content_hash string")
    new = spark.createDataFrame([(1, 0, "c")], "entry_id long, ordinal int, text string")
    for status, want in (("ok", ["b", "c"]), ("skipped", ["b"]), ("failed", ["a", "b"])):
        p, s = indexing.replace_passages(old, state, new, done, NOW, status)
        assert sorted(r["text"] for r in p.collect()) == want and [(r["content_hash"], r["status"]) for r in s.collect()] == [("h2", status)]


def test_ewma_and_causes(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("b", 1, 5.0)], "k string, t int, v double")
    assert {r["k"]: round(r["ewma"], 6) for r in feeds.ewma(df, "k", "t", "v").collect()} == {"a": 13.0, "b": 5.0}
    causes = spark.createDataFrame([(f"c{i % 5}",) for i in range(12)], "cause string")
    got = {r["cause"]: r["n"] for r in feeds.host_failures(causes, 3).collect()}
    assert got == {"c0": 3, "c1": 3, "c2": 2, "(other)": 4}


RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>T</title><link>https://e.org/</link>
<item><title>A</title><link>/a</link><guid>g</guid><pubDate>Thu, 02 Jun 2016 20:33:25 GMT</pubDate><category>x</category><enclosure url="/m.mp3" type="audio/mpeg" length="7"/></item>
<item><title>B</title><link>/b</link><guid>g</guid><description>&lt;p&gt;hi&lt;/p&gt;</description></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><link href="https://e.org/"/><author><name>N</name></author>
<entry><id>1</id><title>E</title><link href="/e"/><content type="xhtml"><div xmlns="http://www.w3.org/1999/xhtml"><p>x</p></div></content><updated>2020-01-01T00:00:00Z</updated></entry></feed>"""
RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/"><channel><title>R</title><link>https://e.org/</link></channel><item><title>I</title><link>/i</link></item></rdf:RDF>"""
JSON = json.dumps({"version": "https://jsonfeed.org/version/1", "title": "J", "home_page_url": "https://e.org/", "items": [{"id": "1", "url": "/j", "content_text": "a < b", "authors": [{"name": "Z"}, {"name": "A"}]}]})


def test_feed_formats(spark):
    docs = spark.createDataFrame([("https://e.org/f", x) for x in (RSS, ATOM, RDF, JSON, "<html/>", "<rss")], "url string, content string")
    kinds = [r["k"] for r in docs.select(formats.feed_format(F.col("content")).alias("k")).collect()]
    assert kinds == ["rss", "atom10", "rdf", "json", "unknown", "rss"]
    got = {r["title"]: r for r in formats.read_feeds(docs).collect()}
    assert got["A"]["url"] == "https://e.org/a" and got["A"]["enclosures"][0]["url"] == "https://e.org/m.mp3" and got["A"]["hash"] != got["B"]["hash"]
    assert got["B"]["content"] == "<p>hi</p>" and got["E"]["content"] == "<div><p>x</p></div>" and got["E"]["author"] == "N"
    assert got["I"]["url"] == "https://e.org/i" and got["a < b"[:100]]["author"] == "A, Z"
    old = '<feed version="0.3" xmlns="http://purl.org/atom/ns#"><title>O</title><entry><id>x</id><title>Old</title><link rel="alternate" href="https://e.org/o"/><issued>2004-01-01</issued></entry></feed>'
    assert formats.parse_feed(old)[0]["published"] == "2004-01-01"


def test_opml():
    text = '<opml><body><outline text="News"><outline text="A" xmlUrl="https://a.org/f"/><outline text="Deep"><outline xmlUrl="https://b.org/f"/></outline></outline><outline text="C" xmlUrl="https://c.org/f" htmlUrl="https://c.org"/></body></opml>'
    assert [(x["title"], x["category"]) for x in formats.opml_subscriptions(text)] == [("A", "News"), ("https://b.org/f", "Deep"), ("C", "")]


def test_stream_windows_match_batch(spark, tmp_path):
    events = C.table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = live.stream(spark, str(tmp_path / "events"), live.EVENTS)
    got = live.drain(live.tumbling(stream), "tumbling", "complete")
    assert got.count() == live.tumbling(events).count()


def test_live_index_offers_each_entry_once(spark, tmp_path):
    e = C.entries(spark, SF).select("feed_id", "hash", "published_at", "entry_id")
    e.unionByName(e).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    fresh = live.new_entries(live.stream(spark, str(tmp_path / "in"), "feed_id long, hash string, published_at timestamp, entry_id long"))
    live.index_live(fresh, lambda df, epoch: seen.extend(r["hash"] for r in df.collect()), str(tmp_path / "cp"), once=True).awaitTermination()
    assert len(seen) == e.select("feed_id", "hash").distinct().count()


def test_a_null_title_or_text_is_offered_when_it_changed(spark):

    e = spark.createDataFrame([(1, None, "text"), (2, "title", None), (3, None, None), (4, "a", "b")], "entry_id long, title string, content string")
    state = lambda version: e.select("entry_id", indexing.content_hash(version).alias("content_hash"), F.lit("ok").alias("status"))
    assert indexing.pending(e, state("old")).count() == 4 and indexing.pending(e, state(indexing.VERSION)).count() == 0


def _twice(spark, names="entry_id long, feed_id long, hash string, title string, published_at timestamp"):
    """Two incoming rows of a feed and hash, the later one first."""
    return spark.createDataFrame([(9, 1, "h", "late", datetime(2024, 1, 3)), (4, 1, "h", "early", datetime(2024, 1, 2))], names).coalesce(1)


def test_refresh_takes_the_earliest_of_equal_rows(spark):
    rows = _twice(spark)
    none, marks = rows.limit(0), rows.limit(0).select("feed_id", "hash")
    snapshot, fresh = mutate.refresh(none, rows, marks)
    assert [tuple(r) for r in snapshot.select("entry_id", "title").collect()] == [(4, "early")] and fresh.count() == 1
    stored = rows.filter("entry_id = 4").withColumns({"entry_id": F.lit(1).cast("long"), "title": F.lit("old")})
    assert [r["title"] for r in mutate.refresh(stored, rows, marks)[0].collect()] == ["early"]


def test_refresh_without_update_takes_the_earliest(spark):
    rows = _twice(spark)
    stored = rows.filter("entry_id = 4").withColumns({"hash": F.lit("other"), "title": F.lit("old")})
    snapshot, _ = mutate.refresh(stored, rows.unionByName(stored.withColumn("title", F.lit("new"))), rows.limit(0).select("feed_id", "hash"), update_existing=False)
    assert sorted((r["hash"], r["title"], r["published_at"].day) for r in snapshot.collect()) == [("h", "early", 2), ("other", "old", 2)]


def test_refresh_takes_null_hashes_for_equal(spark, tmp_path):
    """Entries without text have no hash; stored and deleted ones of a feed keep others of it out, as in the SQL."""
    from feedloom.plans import changes
    from tests.oracle import same

    rows = [(i, None if i % 3 else f"text {i}", "en", f"src{i % 4}", 5) for i in range(100, 160)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "made"))
    os.rename(next(f for f in (tmp_path / "made").iterdir() if f.suffix == ".parquet"), tmp_path / "documents.parquet")
    shutil.rmtree(tmp_path / "made")
    shutil.copy(f"{SF}/embeddings.parquet", tmp_path)
    for name in ("refresh_without_update", "refresh_upsert", "tombstone_guard", "refresh_enclosures"):
        same(spark, changes.QUERIES[name], oracle.oracle_sql()[name], str(tmp_path))


def test_refresh_enclosures_picks_by_id(spark, tmp_path):
    """Where the later of two equal entries is read first, the smaller ids stay all the same."""
    from feedloom.plans import changes
    from tests.oracle import same

    documents = spark.read.parquet(f"{SF}/documents.parquet").limit(60).drop("doc_id", "source")
    both = documents.withColumns({"i": F.monotonically_increasing_id(), "source": F.lit("src1")}).crossJoin(spark.createDataFrame([(900,), (0,)], "more long")).orderBy(F.desc("more"), "i")
    both.select((F.col("i") * 9 + F.col("more")).alias("doc_id"), "text", "lang", "source", "n_chars").coalesce(1).write.parquet(str(tmp_path / "made"))
    os.rename(next(f for f in (tmp_path / "made").iterdir() if f.suffix == ".parquet"), tmp_path / "documents.parquet")
    shutil.rmtree(tmp_path / "made")
    for name in ("embeddings",):
        shutil.copy(f"{SF}/{name}.parquet", tmp_path)
    same(spark, changes.QUERIES["refresh_enclosures"], oracle.oracle_sql()["refresh_enclosures"], str(tmp_path))
