"""Indexes and stores on disk: what they read, what changes leave behind, what failures leave alone."""

import itertools
import os
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.functions import stem as S
from feedloom.operators import mutate, postings, retrieval, vectors
from feedloom.sources import corpus as C
from feedloom.sources.versions import Conflict, Manifest, Store
from tests.oracle import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


# Manifests and stores.
def test_a_version_can_be_taken_once(spark, tmp_path):
    m = Manifest(spark, str(tmp_path / "m"))
    assert m.read() == (0, {})
    assert m.commit(0, {"a": 1}) == 1 and m.commit(1, {"a": 2}) == 2 and m.read() == (2, {"a": 2}) and m.read(1) == (1, {"a": 1})
    with pytest.raises(Conflict):
        m.commit(1, {"a": 3})
    assert m.read() == (2, {"a": 2}) and m.versions() == [1, 2]


@pytest.fixture
def store(spark, tmp_path):
    e = C.entries(spark, SF).select("entry_id", "feed_id", "user_id", "hash", "status", "starred", "share_code", "changed_at")
    return Store.create(str(tmp_path / "store"), 8, entries=(e, "entry_id"), tombstones=(C.tombstones(spark, SF), "hash"))


def test_only_touched_buckets_are_written(spark, store, tmp_path):
    before, old = store.manifest.read()[1], files(tmp_path)
    store.change(lambda t: {"entries": mutate.toggle_starred(t["entries"], 1, 21, C.at(F.lit(0)))}, entries=[21])
    after = store.manifest.read()[1]
    changed = {b for b in before["entries"]["files"] if before["entries"]["files"][b] != after["entries"]["files"][b]}
    touched = {str(r[0]) for r in spark.createDataFrame([(21,)], "entry_id long").select(store._bucket(after["entries"])).collect()}
    assert changed == touched and after["tombstones"] == before["tombstones"]
    assert {f.split("/")[-2] for f in files(tmp_path) - old} == {f"_bucket={b}" for b in touched}
    assert store.table("entries").count() == C.entries(spark, SF).count()
    assert store.table("entries", version=1).filter("starred").count() != store.table("entries").filter("starred").count()


def test_a_lookup_reads_its_buckets(store):
    rows = store.table("entries", keys=[5, 21])
    assert {r.entry_id for r in rows.collect()} == {5, 21} and len(rows.inputFiles()) < len(store.table("entries").inputFiles())


def test_a_failed_change_leaves_the_old_state(spark, store):
    rows, version = sorted(store.table("entries").collect()), store.manifest.read()[0]

    def breaks(t):
        bad = F.when(F.col("entry_id") > 100, F.raise_error(F.lit("no"))).otherwise(F.col("status"))
        return {"entries": t["entries"].withColumn("status", bad)}

    def strays(t):  # rows of buckets that weren't named
        return {"entries": t["entries"].withColumn("entry_id", F.col("entry_id") + 1)}

    for make in (breaks, strays):
        with pytest.raises(Exception, match="no|touch"):
            store.change(make, entries=[21, 150] if make is breaks else [21])
    assert store.manifest.read()[0] == version and sorted(store.table("entries").collect()) == rows
    store.vacuum()
    assert sorted(store.table("entries").collect()) == rows


def test_a_change_beside_another_is_refused(store):
    def slow(t):
        store.change(lambda u: {"entries": u["entries"].filter("entry_id <> 3")}, entries=[3])
        return {"entries": t["entries"].filter("entry_id <> 4")}

    with pytest.raises(Conflict):
        store.change(slow, entries=[4])
    assert {r.entry_id for r in store.table("entries").filter("entry_id < 6").collect()} == {0, 1, 2, 4, 5}


def test_a_change_of_nothing_is_none(store):
    assert store.change(lambda t: {"entries": t["entries"]}, entries=F.col("entry_id") < 0) == store.manifest.read()[0] == 1


def test_tables_switch_together(spark, store):
    gone = (F.col("user_id") == 1) & (F.col("status") == "read") & ~F.col("starred") & (F.col("share_code") == "")
    hashes = store.table("entries").filter(gone).select("hash")
    store.change(lambda t: dict(zip(("entries", "tombstones"), mutate.flush_history(t["entries"], t["tombstones"], 1, None), strict=True)), entries=gone, tombstones=hashes)
    want_e, want_t = mutate.flush_history(C.entries(spark, SF), C.tombstones(spark, SF), 1, None)
    assert {r[0] for r in store.table("entries").select("entry_id").collect()} == {r[0] for r in want_e.select("entry_id").collect()}
    assert sorted(store.table("tombstones").select("hash").collect()) == sorted(want_t.select("hash").collect())
    assert store.table("entries", version=1).count() > store.table("entries").count()


# Text index.
DOCS = "entry_id long, title string, content string, language string"


def plain_search(rows, query):
    """Ids by whole texts: alternatives of words and phrases that must, or must not, be there."""
    words = {i: retrieval.terms_of(f"{t or ''} {c or ''}") for i, t, c, _ in rows}
    has = lambda ws, phrase: any(ws[k : k + len(phrase)] == phrase for k in range(len(ws)))
    return {i for i, ws in words.items() if any(all(has(ws, p) == keep for keep, p in a) for a in retrieval.websearch(query))}


ROWS = [
    (1, "Cats and dogs", "The old cat sat on the old mat. The dog slept.", "en"),
    (2, "Dogs", "old dog, new cat; the mat", "en"),
    (3, "", "mat old the cat", "en-GB"),
    (4, None, None, None),
    (5, "Die Katzen", "Die alte Katze schläft auf der Matte", "de"),
    (6, "123", "old " * 300 + "cat", "en"),
    (7, "x", "", "fr"),
]
SEARCHES = ['"old cat"', "old cat", "old -dog", "-old", '"the old mat" or katze', "cat", '"old mat the"', "cat cat", '-"old cat" mat', "missing", '"dogs the"']


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return postings.build(spark.createDataFrame(ROWS, DOCS), str(tmp_path_factory.mktemp("text")), "entry_id", "content", "title")


@pytest.mark.parametrize("query", SEARCHES)
def test_search_equals_plain_search(index, query):
    assert {r.entry_id for r in index.search(query).collect()} == plain_search(ROWS, query)


def plain_rank(row, a, b):
    words = retrieval.terms_of(f"{row[1] or ''} {row[2] or ''}")
    n_title, left = len(retrieval.terms_of(row[1] or "")), 1.0
    at = {w: [(p, 1.0 if p < n_title else 0.4) for p, x in enumerate(words) if x == w][:256] for w in (a, b)}
    for (p, v), (q, w) in itertools.product(at[a], at[b]):
        if p != q:
            d = abs(p - q)
            left *= 1 - (v * w * (1e-30 if d > 100 else 1 / (1.005 + 0.05 * np.exp(d / 1.5 - 2)))) ** 0.5
    return max(1 - left, 1e-20)


def test_ranks_fall_with_distance(index):
    got = {r.entry_id: r.rank for r in index.search("old cat").collect()}
    by = {r[0]: r for r in ROWS}
    for i, rank in got.items():
        assert rank == pytest.approx(plain_rank(by[i], "old", "cat"), abs=1e-9)
    assert got[1] > got[2] and {r.rank for r in index.search("-cat old").collect()} <= {1e-20}


def test_a_search_reads_postings_of_its_terms_only(index):
    p = plan(index.search('"old cat"'))
    assert "content" not in p and "PartitionFilters: [bucket" in p.replace("isnotnull(bucket#", "bucket").replace("bucket#", "bucket") and ("In(term" in p or "EqualTo(term" in p)


def test_changes_and_merging_equal_a_rebuild(spark, tmp_path):
    rows = {i: (i, f"t{i % 3}", " ".join(f"w{(i * k) % 11}" for k in range(1, 9)), "en") for i in range(40)}
    index = postings.build(spark.createDataFrame([*rows.values()], DOCS), str(tmp_path / "i"), "entry_id", "content", "title")
    for step in range(4):
        new = {i: (i, "changed", f"w1 w{step} extra", "en") for i in range(step, 60, 7 + step)}
        gone = [i for i in range(0, 60, 9) if i % 2 == step % 2 and i not in new]
        index.update(spark.createDataFrame([*new.values()], DOCS), spark.createDataFrame([(i,) for i in gone], "doc long"))
        rows = {i: r for i, r in rows.items() if i not in gone} | new
        fresh = postings.build(spark.createDataFrame([*rows.values()], DOCS), str(tmp_path / f"fresh{step}"), "entry_id", "content", "title")
        checks = lambda x: [sorted(x.bm25("w1 w3 extra", 50, "entry_id").collect()), sorted(x.search('"w1 w2"').collect()), sorted(x.search("-extra").collect())]
        want = checks(fresh)
        assert checks(index) == want
        if step % 2:
            n = len(index.state()["segments"])
            assert index.merge() <= n and checks(index) == want
    index.update(deleted=spark.createDataFrame([(1,), (1000,)], "doc long"))
    assert index.merge(whole=True) == 1
    assert index.state()["n"] == len(rows.keys() - {1}) and index.vacuum() > 0
    assert {r.entry_id for r in index.search("-nothing").collect()} == rows.keys() - {1}


def test_segments_stay_few(spark, tmp_path):
    index = postings.build(spark.createDataFrame(ROWS, DOCS), str(tmp_path / "i"), "entry_id", "content")
    for i in range(6):
        index.update(spark.createDataFrame([(100 + i, "", "old news", "en")], DOCS))
        index.merge()
    assert len(index.state()["segments"]) <= 4 and index.search("news").count() == 6


def test_a_change_during_a_merge_stays(spark, tmp_path):
    index = postings.build(spark.createDataFrame(ROWS, DOCS), str(tmp_path / "i"), "entry_id", "content")
    for text in ("zero", "first"):
        index.update(spark.createDataFrame([(1, "", text, "en")], DOCS))
    store, raced = index.store, []

    def late(data, folder):
        store(data, folder)
        if not raced:
            raced.append(postings.TextIndex(spark, index.path).update(spark.createDataFrame([(1, "", "second", "en")], DOCS)))

    index.store = late
    index.merge()
    assert [r.entry_id for r in index.search("second").collect()] == [1] and index.search("first").count() == 0


@pytest.mark.parametrize("form", ["{:012d}", "{:010d}e1"])
def test_a_segment_name_may_look_like_a_number(spark, tmp_path, monkeypatch, form):
    number = itertools.count(1)
    monkeypatch.setattr("feedloom.sources.versions.uuid", SimpleNamespace(uuid4=lambda: SimpleNamespace(hex=form.format(next(number)) + "0" * 20)))
    index = postings.build(spark.createDataFrame(ROWS, DOCS), str(tmp_path / "i"), "entry_id", "content")
    index.update(spark.createDataFrame([(1, "", "zero", "en")], DOCS))
    assert all(float(s["name"]) for s in index.state()["segments"])
    assert [r.entry_id for r in index.search("zero").collect()] == [1] and index.merge(whole=True) == 1
    assert [r.entry_id for r in index.search("zero").collect()] == [1]


def test_an_id_that_repeats_is_refused(spark, tmp_path):
    index = postings.build(spark.createDataFrame(ROWS, DOCS), str(tmp_path / "i"), "entry_id", "content")
    with pytest.raises(ValueError, match="repeat"):
        index.update(spark.createDataFrame([(1, "", "a", "en"), (1, "", "b", "en")], DOCS))
    assert len(index.state()["segments"]) == 1


def test_a_changed_folder_is_not_stale(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame(ROWS[:2], DOCS).coalesce(1).write.parquet(path)
    ask = lambda: {r.entry_id for r in postings.index_of(spark.read.parquet(path), path, "entry_id", "content").search("mat").collect()}
    assert ask() == {1, 2}
    first = postings.index_of(spark.read.parquet(path), path, "entry_id", "content").path
    assert postings.index_of(spark.read.parquet(path), path, "entry_id", "content").path == first
    spark.createDataFrame(ROWS[2:3], DOCS).coalesce(1).write.mode("append").parquet(path)
    assert ask() == {1, 2, 3} and not os.path.exists(first)


# Stems.
FAMILIES = {
    "en": ["hope hoped hoping hopes", "jump jumps jumped jumping", "city cities", "class classes", "box boxes", "try tries tried trying", "quick quickly", "run runs running", "house houses"],
    "de": ["Katze Katzen", "Kind Kinder Kindern Kindes", "Haus Häuser Häusern", "alt alte alter altes alten", "Lehrerin Lehrerinnen", "klein kleiner kleinste"],
    "fr": ["chat chats", "cheval chevaux", "parler parlons parlez parlait parlent", "petit petite petits petites", "fini finissons finissez"],
    "es": ["gato gatos gata gatas", "hablar hablo hablando hablaron hablaba", "canción canciones", "luz luces", "vivir vive vivieron"],
}


def test_stems_join_inflections(spark):
    rows = [(code, w.lower(), k) for code, families in FAMILIES.items() for k, family in enumerate(families) for w in family.split()]
    df = spark.createDataFrame(rows, "code string, word string, family int").withColumn("stem", S.stem(F.col("word"), F.col("code")))
    got = df.collect()
    assert [r.stem for r in got] == [S.stem_word(r.word, r.code) for r in got]
    families = {}
    for r in got:
        families.setdefault((r.code, r.family), set()).add(r.stem)
    assert all(len(x) == 1 for x in families.values()), {k: v for k, v in families.items() if len(v) > 1}
    assert len({next(iter(x)) + k[0] for k, x in families.items()}) == len(families)  # and keep different words apart


def test_stems_of_other_languages_and_numbers(spark):
    df = spark.createDataFrame([("pl", "domy"), ("en", "b2bs"), ("", "houses"), (None, "houses"), ("en", "is"), ("en", "gas")], "code string, word string")
    assert [r[0] for r in df.select(S.stem(F.col("word"), F.col("code"))).collect()] == ["domy", "b2bs", "houses", "houses", "is", "gas"]
    codes = spark.createDataFrame([("en-GB",), (" DE_at",), (None,), ("",)], "c string").select(S.language(F.col("c")))
    assert [r[0] for r in codes.collect()] == ["en", "de", "", ""]


def test_stemmed_search_by_language(spark, tmp_path):
    rows = [(1, "", "Cities and houses", "en"), (2, "", "the city house", "en"), (3, "", "house city", "xx"), (4, "", "die Häuser", "de"), (5, "", "das alte Haus", "de")]
    index = postings.build(spark.createDataFrame(rows, DOCS), str(tmp_path / "i"), "entry_id", "content", language="language")
    ids = lambda q: {r.entry_id for r in index.search(q).collect()}
    assert ids("city house") == {1, 2, 3} and ids('"city houses"') == {2} and ids("häusern") == {4, 5} and ids("-houses") == {4, 5, 3} and ids('"alten Haus"') == {5}


# Nearest passages.
P = "passage_id long, entry_id long, ordinal int, embedding array<float>"


def points(n=900, d=12, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(15, d))
    x = centres[rng.integers(0, 15, n)] + 0.35 * rng.normal(size=(n, d))
    return [(i, i // 4, i % 4, x[i].astype(np.float32).tolist()) for i in range(n)]


@pytest.fixture(scope="module")
def near(spark, tmp_path_factory):
    odd = [(5000, 5000, 0, None), (5001, 5000, 1, [1.0, 2.0]), (5002, 5000, 2, [0.0] * 12)]
    p = spark.createDataFrame(points() + odd, P)
    return p, vectors.build(p, str(tmp_path_factory.mktemp("vectors")))


def test_recall_without_reading_all_lists(spark, near):
    p, index = near
    q = p.filter("passage_id % 50 = 0 AND passage_id < 5000").select(F.col("passage_id").alias("query_id"), "embedding")
    true = {(r.query_id, r.passage_id) for r in retrieval.knn_many(p, q, 10).collect()}
    got = {(r.query_id, r.passage_id) for r in index.nearest_many(q, 10).collect()}
    assert len(true & got) >= 0.9 * len(true) and index.probes() < 0.5 * len(index.centres())
    one = index.nearest(points()[0][3], 10)
    lists = len(index.centres())
    assert lists > 20 and "PartitionFilters: [" in plan(one) and "list#" in plan(one).split("PartitionFilters: [")[1][:200]
    read = {r[0].split("list=")[1].split("/")[0] for r in index.rows([1, 2]).select(F.input_file_name()).distinct().collect()}
    assert read <= {"1", "2"}


def test_exact_search_equals_a_full_scan(spark, near):
    p, index = near
    for i in (0, 17, 333):
        v = points()[i][3]
        want = [(r.passage_id, r.distance) for r in retrieval.knn(p, v, 12).collect()]
        assert [(r.passage_id, r.distance) for r in index.nearest(v, 12, probes=1, exact=True).collect()] == want
    q = p.filter("passage_id % 40 = 0 AND passage_id < 5000").select(F.col("passage_id").alias("query_id"), "embedding")
    assert sorted(retrieval.knn_many(p, q, 7).collect()) == sorted(index.nearest_many(q, 7, probes=1, exact=True, block=10).collect())


def test_a_filter_comes_before_the_limit(spark, near):
    p, index = near
    own = spark.createDataFrame([(i,) for i in range(0, 225, 13)], "entry_id long")
    v = points()[40][3]
    want = retrieval.knn(p, v, 20, own).collect()
    assert index.nearest(v, 20, within=own, exact=True).collect() == want and len(want) == 20
    assert index.nearest(v, 20, probes=1, within=own).count() == 20  # more lists are read until there are enough
    assert index.nearest(v, 0).count() == 0 and index.nearest([1.0, 2.0], 5).count() == 0


def test_similar_equals_the_scan(spark, near):
    p, index = near
    for entry in (3, 100):
        assert index.similar(p, entry, 5, exact=True).collect() == retrieval.similar(p, entry, 5).collect()


def test_changed_vectors_are_found_where_they_are_now(spark, tmp_path):
    rows = {r[0]: r for r in points(300)}
    index = vectors.build(spark.createDataFrame([*rows.values()], P), str(tmp_path / "v"), lists=20)
    moved = {i: (i, i // 4, i % 4, [-x for x in rows[i][3]]) for i in range(0, 360, 9) if i in rows} | {r[0] + 1000: (r[0] + 1000, *r[1:]) for r in points(30, seed=4)}
    gone = [i for i in range(0, 300, 10) if i not in moved]
    index.update(spark.createDataFrame([*moved.values()], P), spark.createDataFrame([(i,) for i in gone], "passage_id long"))
    rows = {i: r for i, r in rows.items() if i not in gone} | moved
    now = spark.createDataFrame([*rows.values()], P)
    for _ in range(2):
        for v in (points()[9][3], moved[9][3]):
            assert index.nearest(v, 15, probes=2, exact=True).collect() == retrieval.knn(now, v, 15).collect()
        assert index.state()["n"] == len(rows)
        index.update(deleted=spark.createDataFrame([(gone[0],)], "passage_id long"))
        index.merge()


def test_an_index_of_nothing(spark, tmp_path):
    index = vectors.build(spark.createDataFrame([], P), str(tmp_path / "v"))
    assert index.nearest([1.0], 3, exact=True).count() == 0
    text = postings.build(spark.createDataFrame([], DOCS), str(tmp_path / "t"), "entry_id", "content")
    assert text.search("cat").count() == 0 and text.bm25("cat", 3).count() == 0 and text.search("-cat").count() == 0
    text.update(spark.createDataFrame(ROWS, DOCS))
    assert text.search("cat").count() == 4


# Sketches.
def test_sketches_follow_files(spark, tmp_path):
    from feedloom.operators import sketches

    source, reads = str(tmp_path / "rows"), []

    def add(a, b):
        spark.range(a, b).select((F.col("id") % 150).alias("k")).coalesce(1).write.mode("append").parquet(source)

    def read(files):
        reads.append(len(files))
        return spark.read.parquet(*files)

    add(0, 100)
    s = sketches.FileSketches(spark, str(tmp_path / "s"))
    assert len(s.refresh(source, read, "k")) == 1 and s.count() == 100 and s.distinct().first().n == 100
    add(100, 300)
    assert len(s.refresh(source, read, "k")) == 1 and s.count() == 300 and s.distinct().first().n == 150
    assert s.refresh(source, read, "k") == [] and reads == [1, 1]  # only what is new was read
    os.remove(max((f for f in files(source)), key=os.path.getmtime))
    assert s.refresh(source, read, "k") == [] and s.count() == 100 and s.distinct().first().n == 100


def test_sketches_err_within_their_bound(spark, tmp_path):
    from feedloom.operators import sketches

    made = []
    for name, rows in (("all", spark.range(400_000)), ("done", spark.range(250_000, 500_000))):
        rows.repartition(3).write.parquet(str(tmp_path / name))
        s = sketches.FileSketches(spark, str(tmp_path / f"s-{name}"))
        s.refresh(str(tmp_path / name), lambda f: spark.read.parquet(*f), "id")
        made.append(s)
    bound = 4 * 500_000 / 2 ** (sketches.LOG / 2)
    assert abs(sketches.pending_estimate(*made).first().n - 250_000) < bound and abs(made[0].distinct().first().n - 400_000) < bound
    assert "rows" not in plan(sketches.pending_estimate(*made)).split("ReadSchema")[0].split("Location")[0]


def test_bitmaps_are_exact(spark, tmp_path):
    """Repeated keys, null and negative ones, files that go, and more keys than a sketch holds."""
    from feedloom.operators import sketches

    made, key = [], F.when(F.col("id") % 1000 != 7, F.col("id") - 50_000).alias("k")
    for name, rows in (("all", spark.range(400_000).union(spark.range(100, 600)).union(spark.range(100, 200))), ("done", spark.range(250_123, 500_000))):
        rows.select(key).repartition(3).write.parquet(str(tmp_path / name))
        s = sketches.FileBitmaps(spark, str(tmp_path / f"s-{name}"))
        assert len(s.refresh(str(tmp_path / name), lambda f: spark.read.parquet(*f), "k")) == 3
        made.append(s)
    rows = spark.read.parquet(str(tmp_path / "all")).join(spark.read.parquet(str(tmp_path / "done")), "k", "left_anti").filter("k IS NOT NULL")
    assert sketches.pending(*made).first().n == rows.count() == 250_123 - 251 + 600
    assert made[0].distinct().first().n == 400_000 - 400 and made[0].count() == 400_600
    os.remove(max((f for f in files(str(tmp_path / "all"))), key=os.path.getmtime))
    assert made[0].refresh(str(tmp_path / "all"), lambda f: spark.read.parquet(*f), "k") == []
    left = spark.read.parquet(str(tmp_path / "all"))
    assert made[0].count() == left.count() and made[0].distinct().first().n == left.filter("k IS NOT NULL").distinct().count()


def test_postings_are_made_in_slices(spark, monkeypatch):
    """A batch of any size is sorted a few words at a time, with the same postings; a word is stemmed once."""
    import pyarrow as pa

    texts = [f"houses running n{i % 7} und Häuser houses".lower().split() * (1 + i % 4) for i in range(300)] + [[], None]
    n = [len(t or []) for t in texts]
    columns = {"doc": range(302), "language": ["en", "de", "", "xx", "fr", "es"] * 50 + ["en", "de"], "n_title": [min(2, x) for x in n], "dl": pa.array(n, pa.int32()), "terms": pa.array(texts, pa.list_(pa.string()))}
    batch, asked = pa.record_batch({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()}), []
    monkeypatch.setattr(postings.S, "stem_word", lambda w, code, f=S.stem_word: asked.append((w, code)) or f(w, code))
    whole, parts = list(postings._postings([batch], True)), []
    assert len(asked) == len(set(asked))
    monkeypatch.setattr(postings, "SLICE", 50)
    for b in postings._postings([batch], True):
        parts.append(b)
        assert sum(map(len, b.column("places").to_pylist())) <= 50
    rows = lambda made: sorted((r for b in made for r in b.to_pylist()), key=lambda r: (r["doc"], r["term"]))
    assert rows(whole) == rows(parts) and len(parts) > 20
    for r in rows(parts):
        if r["term"]:
            assert [S.stem_word(texts[r["doc"]][p], r["language"]) for p in r["places"]] == [r["term"]] * r["tf"]


def test_an_index_is_made_from_small_batches(spark, tmp_path, monkeypatch):
    """A task gets few rows at once, however many its partition has; the session's own settings come back."""
    made, most, setting = postings._postings, int(postings.HANDED["spark.sql.execution.arrow.maxRecordsPerBatch"]), {k: spark.conf.get(k) for k in postings.HANDED}

    def checked(batches, stem=False):
        for b in batches:
            if b.num_rows > most or b.nbytes > 16 << 20:
                raise ValueError(f"{b.num_rows} rows, {b.nbytes} bytes")
            yield from made([b], stem)

    monkeypatch.setattr(postings, "_postings", checked)
    docs = spark.range(0, 2 * most + 7, 1, 1).select(F.col("id").alias("passage_id"), F.expr("concat('a', id, ' ', repeat('b c d ', 3000))").alias("text"))
    index = postings.build(docs, str(tmp_path / "i"))
    assert index.state()["n"] == 2 * most + 7 and index.search("a5 d").count() == 1
    assert {k: spark.conf.get(k) for k in postings.HANDED} == setting


def test_stems_of_words_and_columns_agree(spark):
    words = spark.read.parquet(f"{SF}/documents.parquet").select("lang", F.explode(retrieval.tokens(F.col("text"))).alias("w")).distinct()
    words = words.unionByName(words.select("lang", F.concat("w", F.element_at(F.array(*map(F.lit, ("ies", "sses", "ingly", "bbed", "innen", "erest", "aux", "ées", "ación", "ces", "s2"))), (F.length("w") % 11 + 1))).alias("w")))
    got = words.select("lang", "w", S.stem(F.col("w"), S.language(F.col("lang"))).alias("s"), S.language(F.col("lang")).alias("code")).collect()
    assert len(got) > 1000 and all(S.stem_word(r["w"], r["code"]) == r["s"] for r in got)


def test_distances_are_compared_in_slices(spark, monkeypatch):
    """What a task holds of distances is bounded, also where very many rows are equally near."""
    import pyarrow as pa

    rng, n = np.random.default_rng(3), 900
    v = rng.normal(size=(n, 4)).round(1).astype(np.float32)
    v[300:700] = v[300]
    batch = pa.record_batch({"passage_id": pa.array(np.arange(n)), "entry_id": pa.array(np.arange(n) // 5), "embedding": pa.array(v.tolist(), pa.list_(pa.float32())), "list": pa.array((np.arange(n) % 3).astype(np.int32))})
    q = v[::30].astype(float) + 0.01
    q /= np.sqrt((q * q).sum(1, keepdims=True))
    ids = np.arange(len(q))
    many = lambda: retrieval._nearest_many([batch, batch.slice(100, 50)], type("Sent", (), {"value": (ids, q)}), 6)
    probed = lambda: vectors._probed([batch], type("Sent", (), {"value": (ids, ids * 6, q, np.ones((len(q), 3), bool))}), 6)
    whole, most, lexsort = [[b.to_pylist() for b in f()] for f in (many, probed)], [], np.lexsort
    for module in (retrieval, vectors):
        monkeypatch.setattr(module, "CELLS", 600)
    monkeypatch.setattr(np, "lexsort", lambda keys, axis=-1: most.append(np.size(keys[0])) or lexsort(keys, axis=axis))
    assert [[b.to_pylist() for b in f()] for f in (many, probed)] == whole
    assert max(most) <= 2 * 600 + len(q) * 6
