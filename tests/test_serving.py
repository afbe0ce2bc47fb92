"""Serving, postings, lanes: what no SQL can say."""

import json
import time
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.functions import text
from feedloom.operators import indexing, postings, serving
from feedloom.operators import retrieval as R
from feedloom.sources import corpus as C
from feedloom.sources import fetched
from feedloom.streaming import live
from tests.oracle import SF


def test_query_cache_forgets_the_least_used():
    asked = []

    class Counting(serving.HashingEmbedder):
        def query(self, text):
            asked.append(text)
            return super().query(text)

    cache = serving.QueryCache(Counting(8), capacity=2)
    for q in ("a", "b", "a", "c", "a", "b"):
        cache.embed(q)
    assert asked == ["a", "b", "c", "b"] and len(cache) == 2
    cache.switch(Counting(4))
    assert len(cache) == 0 and len(cache.embed("a")) == 4


def test_embedder_prefixes():
    e = serving.HashingEmbedder(16, "search_document: ", "search_query: ")
    assert e.identity == "hash@1#16" and e.documents(["x"])[0] != e.query("x")
    assert e.documents(["x"])[0] == serving.HashingEmbedder(16).query("search_document: x")


def test_remote_embedder():
    model = {"name": "m", "revision": "r", "dimensions": 2}
    answers = {"down": False}

    def post(request):
        if answers["down"]:
            raise OSError("refused")
        return {"vectors": [[float(len(t)), 0.0 if request["task"] == "query" else 1.0] for t in request["texts"]], "model": dict(model)}

    e = serving.RemoteEmbedder(post, 2)
    assert e.identity == "m@r#2" and e.documents(["ab", "c"]) == [[2.0, 1.0], [1.0, 1.0]] and e.query("abc") == [3.0, 0.0] and e.documents([]) == []
    answers["down"] = True
    with pytest.raises(serving.Unavailable) as found:
        e.query("x")
    assert not found.value.restart
    answers["down"], model["revision"] = False, "r2"
    with pytest.raises(serving.Unavailable) as found:
        e.query("x")
    assert found.value.restart
    with pytest.raises(ValueError):
        serving.RemoteEmbedder(post, 768)


def test_fallback_reasons():
    def broken():
        raise R.SearchError("down")

    plain, ranked = (lambda: "plain"), (lambda: "ranked")
    assert serving.with_fallback(ranked, plain) == ("ranked", False) and serving.with_fallback(None, plain) == ("plain", False)
    assert serving.with_fallback(ranked, plain, offset=20) == ("plain", True) and serving.with_fallback(broken, plain) == ("plain", True)
    assert serving.with_fallback(ranked, plain, mode="fulltext", offset=20) == ("plain", False)


def test_snippets_and_source_text(spark):
    rows = [("title", "A needle here", "<p>x</p>", 2, 8, True), ("content", "t", "<p>some <b>needle</b> in text</p>", 0, 4, False), ("content", "t", "<p>nothing</p>", 0, 99, True)]
    df = spark.createDataFrame(rows, "source string, title string, content string, a int, b int, same boolean")
    source = serving.source_text(F.col("source"), F.col("title"), F.col("content"))
    got = [r["s"] for r in df.select(serving.snippet_udf(source, F.lit("stored"), "a", "b", "same", F.lit("needle")).alias("s")).collect()]
    assert got[0]["text"] == "needle" and [(h["start"], h["end"]) for h in got[0]["highlights"]] == [(0, 6)]
    assert got[1]["text"] == "some needle in text" and got[2]["text"] == "stored" and got[2]["highlights"] == []
    view = serving.entry_view(spark.createDataFrame([(1, 0.5)], "entry_id long, score double").withColumn("snippet", F.lit("s"))).first()["view"]
    assert json.loads(view) == {"entry_id": 1, "score": 0.5, "snippet": "s"}


def test_vector_literals(spark):
    df = spark.createDataFrame([("[0.5, -1,2e3]",), ("[]",), ("[a]",), ("0.5",)], "t string")
    assert [r["v"] for r in df.select(serving.parse_vector(F.col("t")).alias("v")).collect()] == [[0.5, -1.0, 2000.0], [], None, None]


def test_websearch():
    assert R.websearch('cat "black dog" -bird or fish') == [[(True, ["cat"]), (True, ["black", "dog"]), (False, ["bird"])], [(True, ["fish"])]]
    assert R.websearch("  or ! ") == [] and R.search_limit(0) == 10 and R.search_limit(500) == 100 and R.search_limit(50, R.PAGE_LIMIT) == 20


def test_search_without_words_finds_nothing(spark):
    e = C.entries(spark, SF)
    assert e.filter(R.full_text(e, " - ")[0]).count() == 0


def test_postings_read_their_buckets_only(spark, tmp_path):
    docs = C.entries(spark, SF)
    index = postings.build(docs, str(tmp_path / "index"), "entry_id", "content")
    got = index.bm25("the der", 20, "entry_id")
    assert got.collect() == R.bm25(docs, "the der", 20, "entry_id", "content").collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan.replace("bucket#", "bucket ").replace("(bucket ", "(bucket") or "bucket" in plan.split("PartitionFilters")[1][:120]
    assert "In(term" in plan or "EqualTo(term" in plan
    assert index.bm25(" ", 20, "entry_id").count() == 0


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(400, 8)).round(1)
    rows = [(i, i // 5, v.tolist()) for i, v in enumerate(m)] + [(900, 1, None), (901, 1, [1.0]), (902, 1, [0.0] * 8)]
    p = spark.createDataFrame(rows, "passage_id long, entry_id long, embedding array<float>").repartition(5)
    queries = p.filter("passage_id % 50 = 0 AND passage_id < 400").select(F.col("passage_id").alias("query_id"), "embedding")
    x = m.astype(np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for r_of in ({q: [(r["passage_id"], r["rank"]) for r in R.knn(p, x[q].tolist(), 7).collect()] for q in range(0, 400, 50)},):
        many = {}
        for r in R.knn_many(p, queries, 7, block=3).collect():
            many.setdefault(r["query_id"], []).append((r["passage_id"], r["rank"]))
        for q, got in r_of.items():
            d = np.round(1 - unit @ unit[q], 6) + 0.0
            want = [(int(i), k) for k, i in enumerate(np.lexsort((np.arange(400), d))[:7], 1)]
            assert sorted(got, key=lambda t: t[1]) == want and sorted(many[q], key=lambda t: t[1]) == want
    assert R.knn(p, x[0].tolist(), 0).count() == 0 and R.knn_many(p, queries.limit(0), 3).count() == 0


def test_hydrate_keeps_order(spark):
    hits = spark.createDataFrame([(7, 1), (3, 2), (9_999_999, 3), (11, 4)], "entry_id long, rank int")
    e = C.entries(spark, SF)
    assert [r["entry_id"] for r in serving.hydrate(hits, e).collect()] == [7, 3, 11]
    assert [r["entry_id"] for r in serving.hydrate(hits, e, without_hidden=True).collect()] == [7, 3]


def test_saved_entries_go_to_the_services_of_their_user(spark, tmp_path):
    folder = str(tmp_path)

    def write(rows):
        with open(f"{folder}/{rows[0]['user_id']}-{rows[0]['entry_id']}.json", "w") as f:
            json.dump([r["entry_id"] for r in rows], f)

    e = C.entries(spark, SF).filter("entry_id < 12").coalesce(1)
    serving.save_entries({"read later": write}, {1: {"read later"}})(e, 0)
    assert [json.loads(p.read_text()) for p in tmp_path.iterdir()] == [[0, 3, 6, 9]]


def test_backoff_and_due(spark):
    assert [live.backoff(n, 10) for n in (1, 2, 3, 4, 5, 9)] == [40, 80, 160, 320, 320, 320]
    rows = [(1, 1, datetime(2024, 1, 1, 0, 0)), (2, 2, datetime(2024, 1, 1, 0, 0)), (3, 9, datetime(2024, 1, 1, 0, 0))]
    df = spark.createDataFrame(rows, "entry_id long, attempts long, failed_at timestamp")
    due = lambda s: sorted(r["entry_id"] for r in live.due_again(df, datetime(2024, 1, 1, 0, 0, s), 1.0).collect())
    assert due(3) == [] and due(4) == [1] and due(8) == [1, 2] and due(32) == [1, 2, 3]


def test_sweep_indexes_every_page(spark):
    e, done = C.entries(spark, SF), []
    none = C.index_state(spark, SF).limit(0)
    pages = live.sweep(lambda after, page: indexing.pending(e, none, after, page), lambda rows: done.extend(r["entry_id"] for r in rows.collect()), page=90)
    assert pages == 3 and sorted(done) == sorted(r["entry_id"] for r in e.select("entry_id").collect())


def waited(done, seconds=40):
    end = time.time() + seconds
    while not done() and time.time() < end:
        time.sleep(0.2)


def test_lane_pauses_and_goes_on(spark, tmp_path):
    src = C.entries(spark, SF).select("feed_id", "hash", "published_at", "entry_id")
    src.filter("entry_id < 50").coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []

    def start():
        s = live.stream(spark, str(tmp_path / "in"), "feed_id long, hash string, published_at timestamp, entry_id long")
        return live.index_live(s, lambda df, epoch: seen.extend(r["entry_id"] for r in df.collect()), str(tmp_path / "cp"), every="1 second")

    lane = live.Lane(start)
    lane.resume()
    waited(lambda: len(seen) >= 50)
    lane.check(available=False)
    assert not lane.running and lane.reason == "embedder unavailable" and len(seen) == 50
    src.filter("entry_id >= 50").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    lane.check(available=True)
    waited(lambda: len(seen) >= src.count())
    lane.pause()
    lane.check(available=True)
    assert sorted(seen) == sorted(r["entry_id"] for r in src.collect()) and not lane.running


def test_throttle_steps_by_one():
    t = live.Throttle(1, 3, samples=2)
    assert [t.observe(1.0) for _ in range(2)] == [1, 1] and t.baseline == 1.0
    assert t.observe(1.0) == 2 and t.observe(0.5) == 3 and t.observe(0.3) == 3
    assert t.observe(0.6) == 2 and t.observe(0.1, load=0.9) == 1 and t.observe(9.0) == 1


def test_retry_tracker_counts_and_gives_up(spark, tmp_path):
    rows = spark.createDataFrame([(1,), (1,), (2,)], "entry_id long")
    rows.coalesce(1).write.parquet(str(tmp_path / "f"))
    q = live.retry_tracker(live.stream(spark, str(tmp_path / "f"), "entry_id long"), most=2).writeStream.format("memory").queryName("tracked").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()  # with timeouts a stream never runs out of batches
    assert q.awaitTermination(60)
    assert {r["entry_id"]: (r["attempts"], r["given_up"]) for r in spark.table("tracked").collect()} == {1: (2, True), 2: (1, False)}


def test_fetched_headers(spark):
    df = spark.createDataFrame([({"expires": "0", "etag": "x", "last-modified": "y"}, 200), ({"expires": "Thu, 02 Jun 2016 20:33:25 GMT", "retry-after": "soon"}, 304), ({"last-modified": "m"}, 429)], "h map<string,string>, s int")
    at = datetime(2016, 6, 2, 20, 30)
    h, s = F.col("h"), F.col("s")
    got = df.select(fetched.is_modified(s, h, F.lit("x"), F.lit("m")), fetched.expires_seconds(h, at), fetched.retry_seconds(h, at), fetched.is_rate_limited(s), fetched.etag(h)).collect()
    assert [tuple(r) for r in got] == [(True, 0, 0, False, ""), (False, 240, 0, False, ""), (False, 0, 0, True, "")]


def test_extracted_passages_are_their_source(spark):
    e = C.entries(spark, SF)
    p = indexing.make_passages(e).join(e.select("entry_id", "title", "content"), "entry_id")
    for r in p.limit(200).collect():
        source = r["title"] if r["source"] == "title" else text.extract_text(r["content"])
        assert source.encode()[r["char_start"] : r["char_end"]].decode() == r["text"]
