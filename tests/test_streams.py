"""Retries in a stream, feeds as a data source, the push sink."""

import os
import time

import pytest
from pyspark.sql import functions as F

from feedloom.sources.feed_source import FeedSource, PushSink, by_key
from feedloom.streaming import retries


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", retries.STATE_STORE)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def attempts_in(folder):
    """An indexer that notes each attempt as a file; entry 2 fails twice, entry 3 always, entry 4 finds the embedder away once."""

    def attempt(row):
        mine = [f for f in os.listdir(folder) if f.startswith(f"{row['entry_id']}-")]
        open(f"{folder}/{row['entry_id']}-{len(mine)}-{time.time()}", "w").close()
        if row["entry_id"] == 4 and not mine:
            raise retries.Unavailable("embedder")
        if row["entry_id"] == 3 or row["entry_id"] == 2 and len(mine) < 2:
            raise ValueError(f"no {row['text']}")

    return attempt


def until(check, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        if check():
            return True
        time.sleep(0.3)
    return False


def test_failed_entries_come_again_and_outlive_a_restart(rocks, tmp_path):
    spark, notes, source = rocks, tmp_path / "notes", str(tmp_path / "in")
    notes.mkdir()
    schema = "entry_id long, text string"
    spark.createDataFrame([(i, f"t{i}") for i in (1, 2, 3, 4)], schema).coalesce(1).write.parquet(source)
    tries = lambda i: sorted(float(f.rpartition("-")[2]) for f in os.listdir(notes) if f.startswith(f"{i}-"))
    outcomes = retries.index_with_retries(spark.readStream.schema(schema).parquet(source), attempts_in(str(notes)), interval=0.5, most=4)
    start = lambda: retries.keep_outcomes(outcomes, str(tmp_path / "out"), str(tmp_path / "checkpoint"), "2 seconds")
    dead = lambda: [tuple(r) for r in retries.dead_letters(spark, str(tmp_path / "out")).collect()]
    query = start()
    assert until(lambda: len(tries(2)) >= 2 and len(tries(3)) >= 2)
    assert until(lambda: not query.status["isTriggerActive"])
    query.stop()
    assert dead() == []
    query = start()  # the state says what is due and when
    assert until(dead, 60)
    query.stop()
    rows = spark.read.schema(retries.OUTCOMES).parquet(str(tmp_path / "out")).collect()
    of = lambda i: sorted((r.attempts, r.outcome) for r in rows if r.entry_id == i)
    assert of(1) == [(1, "indexed")] and of(2) == [(1, "failed"), (2, "failed"), (3, "indexed")]
    assert of(3) == [(1, "failed"), (2, "failed"), (3, "failed"), (4, "dead")] and dead() == [(3, 4, "no t3")]
    assert of(4) == [(0, "paused"), (1, "indexed")]
    due = sorted(r.next_ms for r in rows if r.entry_id == 3 and r.next_ms)
    assert due[1] - due[0] >= 4000 and due[2] - due[1] >= 8000  # after the first 4 intervals of half a second: 8, then 16


RSS = "<rss version='2.0'><channel><title>F</title><link>https://a.example/</link>{}</channel></rss>"
ITEM = "<item><title>T{0}</title><link>https://a.example/{0}</link><guid>{0}</guid><category>c</category><enclosure url='https://a.example/{0}.mp3' type='audio/mpeg' length='7'/></item>"


def write_feeds(folder, names):
    folder.mkdir(exist_ok=True)
    for n in names:
        (folder / f"{n}.xml").write_text(RSS.format(ITEM.format(n) + ITEM.format(f"{n}b")))


def test_feeds_as_a_table(spark, tmp_path):
    from feedloom.sources.formats import read_feeds

    write_feeds(tmp_path / "f", ["x", "y", "z"])
    (tmp_path / "f" / "broken.xml").write_text("<rss")
    (tmp_path / "f" / "doc.json").write_text('{"version": "https://jsonfeed.org/version/1.1", "title": "J", "items": [{"id": "1", "url": "https://j.example/1", "content_text": "hi"}]}')
    spark.dataSource.register(FeedSource)
    got = spark.read.format("feeds").option("filesPerTask", 2).load(str(tmp_path / "f"))
    assert got.rdd.getNumPartitions() == 3
    docs = spark.read.format("binaryFile").load(str(tmp_path / "f")).select(F.regexp_replace("path", "^file:", "").alias("url"), "content")
    assert sorted(map(str, got.drop("document").collect())) == sorted(map(str, read_feeds(docs).collect()))
    assert spark.read.format("feeds").option("pathGlobFilter", "*.json").load(str(tmp_path / "f")).select("title", "document").first()[0] == "hi"


def test_feeds_as_a_stream(spark, tmp_path):
    spark.dataSource.register(FeedSource)
    source, out = tmp_path / "f", str(tmp_path / "out")
    write_feeds(source, ["a", "b", "c"])

    def run():
        stream = spark.readStream.format("feeds").option("files", 2).load(str(source)).select("title", "document")
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").start()
        assert until(lambda: os.path.exists(out) and spark.read.schema("title string").parquet(out).count() >= want, 40)
        q.processAllAvailable()
        q.stop()
        return sorted(r.title for r in spark.read.parquet(out).select("title").collect())

    want = 6
    assert run() == sorted(f"T{n}{s}" for n in "abc" for s in ("", "b"))
    write_feeds(source, ["d"])
    want = 8
    assert run() == sorted(f"T{n}{s}" for n in "abcd" for s in ("", "b"))  # each file once, also after a restart


@pytest.fixture
def pushed(tmp_path):
    """A service that notes what it gets, and fails at entry 250 until it is told to be well."""
    folder = tmp_path / "service"
    folder.mkdir()
    module = tmp_path / f"push_service_{time.time_ns()}.py"
    module.write_text(f"import os, time\nfolder = {str(folder)!r}\n" + "def push(rows):\n    if any(r['entry_id'] == 250 for r in rows) and not os.path.exists(folder + '/well'):\n        raise OSError('service away')\n    with open(f'{folder}/{rows[0][\'entry_id\']}-{time.time_ns()}', 'w') as f:\n        f.write('\\n'.join(str(r['entry_id']) for r in rows))\n")
    return folder, module


def sent(folder):
    return [int(x) for f in os.listdir(folder) if f != "well" for x in open(f"{folder}/{f}").read().split()]


def test_a_repeated_batch_pushes_nothing_twice(spark, tmp_path, pushed):
    folder, module = pushed
    spark.sparkContext.addPyFile(str(module))
    spark.dataSource.register(PushSink)
    source, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    spark.range(1000).select(F.col("id").alias("entry_id")).coalesce(1).write.parquet(source)

    def start():
        stream = by_key(spark.readStream.schema("entry_id long").parquet(source), 2)
        return stream.writeStream.format("push").option("service", f"{module.stem}:push").option("receipts", str(tmp_path / "receipts")).option("checkpointLocation", cp).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="service away"):
        start().awaitTermination()
    some = sent(folder)
    assert 0 < len(some) < 1000  # the task that failed had sent a part of its rows
    (folder / "well").touch()
    start().awaitTermination()
    assert sorted(sent(folder)) == list(range(1000))
    assert '"rows": 1000' in open(tmp_path / "receipts" / "batch=0" / "committed").read()


def test_a_batch_write_can_be_repeated(spark, tmp_path, pushed):
    folder, module = pushed
    (folder / "well").touch()
    spark.sparkContext.addPyFile(str(module))
    spark.dataSource.register(PushSink)
    rows = by_key(spark.range(300).select(F.col("id").alias("entry_id")), 3)
    for _ in range(2):
        rows.write.format("push").option("service", f"{module.stem}:push").option("receipts", str(tmp_path / "r")).option("batch", "nightly-7").mode("append").save()
    assert sorted(sent(folder)) == list(range(300))
