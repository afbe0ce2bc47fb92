"""An inverted index on disk that follows changes: postings with places in buckets of terms, in segments.

A query reads the buckets of its terms alone and no text: BM25 from the counts, phrases by joining places, ranks from the distance of words.
Statistics are kept in the manifest, so they cost no scan. ``Segments`` says how changes, deletions and merging work.
"""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions import stem as S
from feedloom.operators.retrieval import CONTENT_WEIGHT, K1, PLACE_SUMS, PLACES, TITLE_WEIGHT, B, ranked, terms, tokens, websearch
from feedloom.sources.versions import Segments, delete

BUCKETS = 64
#: Words that a task sorts at a time, and stems that it remembers.
SLICE, STEMS = 250_000, 200_000
#: While postings are written, the most rows and bytes that Spark hands to Python at once (but always one document).
HANDED = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
#: The bucket of the rows of documents, and of no term.
DOCUMENTS = -1
#: Rank of a match whose words are never near one another.
LEAST_RANK = 1e-20
#: Words further apart than this add nothing that shows in a rank (1e-15).
FAR = 100


def bucket(term: Column) -> Column:
    return F.when(term == "", DOCUMENTS).otherwise((F.crc32(term.cast("binary")) % BUCKETS).cast("int"))


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of a batch's rows with at most so many words, or one row, each with its rows' numbers of words."""
    sizes = pc.list_value_length(batch.column("terms")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(first, last - first), sizes[first:last]
        first = last


def _stemmed(words: pa.DictionaryArray, languages: pa.Array, of: np.ndarray, known: dict[tuple[str, str], str]) -> pa.DictionaryArray:
    """Every word's stem in the language of its row; each different word of a language is stemmed once, and remembered in ``known``."""
    codes = languages.dictionary_encode()
    pairs, inverse = np.unique(codes.indices.to_numpy()[of].astype(np.int64) * len(words.dictionary) + words.indices.to_numpy(), return_inverse=True)
    code, word = np.divmod(pairs, max(len(words.dictionary), 1))
    names, out = codes.dictionary.to_pylist(), []
    for k, w in zip(code.tolist(), words.dictionary.take(pa.array(word)).to_pylist(), strict=True):
        pair = (names[k], w)
        if pair not in known:
            if len(known) >= STEMS:
                known.clear()
            known[pair] = S.stem_word(w, names[k])
        out.append(known[pair])
    stems = pa.array(out, pa.string()).dictionary_encode()
    return pa.DictionaryArray.from_arrays(stems.indices.take(pa.array(inverse)), stems.dictionary)


def _postings(batches: Iterator[pa.RecordBatch], stem: bool = False) -> Iterator[pa.RecordBatch]:
    """doc, language, n_title, dl, terms: a row for each of a document's terms, with its places in order, and one for the document, under the
    empty term. At most SLICE words are sorted at a time, so a task holds a batch and little more, whatever the texts' lengths."""
    known: dict[tuple[str, str], str] = {}
    for whole in batches:
        for batch, sizes in _slices(whole, SLICE):
            lists, none = batch.column("terms"), pa.array(np.zeros(len(sizes), np.int64))
            own = [batch.column("doc"), batch.column("language"), pa.array([""] * len(sizes)), none, none, batch.column("dl"), pa.array([[]] * len(sizes), pa.list_(pa.int32()))]
            yield pa.record_batch(own, ["doc", "language", "term", "tf", "tf_title", "dl", "places"])
            words = lists.flatten().dictionary_encode()
            if not len(words):
                continue
            of = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            words = _stemmed(words, batch.column("language"), of, known) if stem else words
            code = words.indices.to_numpy().astype(np.int64)
            order = np.argsort(of * len(words.dictionary) + code, kind="stable")  # places stay in order
            of, code, place = of[order], code[order], place[order]
            first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (code[1:] != code[:-1])]))
            ends = np.concatenate([first, [len(of)]])
            title = batch.column("n_title").to_numpy(zero_copy_only=False)[of]
            in_title = np.concatenate([[0], np.cumsum(place < title)])
            rows, at = pa.array(of[first]), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(place.astype(np.int32)))
            yield pa.record_batch(
                [batch.column("doc").take(rows), batch.column("language").take(rows), words.dictionary.take(pa.array(code[first])), pa.array(np.diff(ends)), pa.array(np.diff(in_title[ends])), batch.column("dl").take(rows), at],
                ["doc", "language", "term", "tf", "tf_title", "dl", "places"],
            )


POSTINGS = "doc long, language string, term string, tf long, tf_title long, dl int, places array<int>"


class TextIndex(Segments):
    """Postings of columns of texts, numbered through as one text: first the title, if there is one, then the content.

    With ``language`` words are stemmed in the language of their document.
    """

    schema = f"{POSTINGS}, bucket int"

    def make(self, rows: DataFrame, extra: dict) -> DataFrame:
        title = tokens(F.col(extra["title"])) if extra.get("title") else F.array().cast("array<string>")
        code = S.language(F.col(extra["language"])) if extra.get("language") else F.lit("")
        t = rows.select(F.col(extra["id"]).cast("long").alias("doc"), code.alias("language"), title.alias("a"), tokens(F.col(extra["content"])).alias("b"))
        both = F.concat("a", "b")
        t = t.select("doc", "language", F.size("a").alias("n_title"), (F.size("a") + F.size("b")).alias("dl"), both.alias("terms"))
        return t.mapInArrow(partial(_postings, stem=bool(extra.get("language"))), POSTINGS)

    def summaries(self, data: DataFrame) -> dict[str, DataFrame]:
        """The documents' own rows, which lie in one bucket."""
        own = data.filter((F.col("bucket") == DOCUMENTS) & (F.col("term") == "")).select("doc", F.col("dl").cast("long").alias("size"))
        return {"ids": own}

    def store(self, data: DataFrame, folder: str) -> None:
        data = data.drop("bucket").withColumn("bucket", bucket(F.col("term")))
        # Dealt by term, so that a bucket's files are few; Spark splits a task that a frequent term would fill. Sorted, so that a reader skips row groups.
        before = {k: self.spark.conf.get(k) for k in HANDED}
        for k, v in HANDED.items():
            self.spark.conf.set(k, v)
        try:
            data.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term", "doc").write.partitionBy("bucket").parquet(folder)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)

    def postings(self, words: list[str], state: dict, *columns: str) -> DataFrame:
        """The live postings of some terms; of their buckets' files only."""
        buckets = sorted({zlib.crc32(w.encode()) % BUCKETS for w in words})
        where = F.col("bucket").isin(*buckets) & F.col("term").isin(*words) if words else F.lit(False)
        rows = self.rows_of("data", state["segments"]).filter(where).select("segment", "doc", "term", *columns)
        return self.live(rows, state["segments"])

    def bm25(self, query: str, limit: int, doc_id: str = "passage_id", within: DataFrame | None = None) -> DataFrame:
        """doc_id, score, rank of the best matches, ties by id, as retrieval.bm25 gives them."""
        words, state = terms(query), self.state()
        tf = self.postings(words if limit > 0 else [], state, "tf", "dl")
        df = tf.groupBy("term").agg(F.count("*").alias("df"))
        found = tf.withColumnRenamed("doc", doc_id)
        found = found if within is None else found.join(within, doc_id, "left_semi")
        both = found.join(F.broadcast(df), "term")  # a row a query term
        n, average = F.lit(float(state["n"])), F.lit(state["size"] / max(state["n"], 1))
        idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / average))
        scored = both.groupBy(doc_id).agg(F.round(F.sum(part), 6).alias("score"))
        return ranked(scored.orderBy(F.desc("score"), doc_id).limit(max(limit, 0)), F.desc("score"), F.col(doc_id))

    def search(self, query: str, doc_id: str = "entry_id") -> DataFrame:
        """doc_id, rank of every document that a query with quotes, ``or`` and minus finds; no text is read.

        Words that must all be there, and phrases, are ranked by distance: 1 less the product of 1 - sqrt(v w d) over all pairs of places of
        different words, v and w their weights, d falling with their distance. Otherwise each word counts by its places, as in retrieval.full_text.
        """
        alternatives, state = websearch(query), self.state()
        codes = [*S.RULES, ""] if state["extra"].get("language") else [""]
        words = list(dict.fromkeys(w for a in alternatives for _, phrase in a for w in phrase))
        stems = {code: {w: S.stem_word(w, code) for w in words} for code in codes}
        rows = self.postings(sorted({s for of in stems.values() for s in of.values()}), state, "language", "tf_title", "places")
        at = rows.groupBy("doc").agg(F.first("language").alias("language"), F.map_from_entries(F.collect_list(F.struct("term", F.struct("places", "tf_title")))).alias("at"))
        if any(all(not keep for keep, _ in a) for a in alternatives):  # what only lacks words may have no posting at all
            all_ = self.data(state, (F.col("bucket") == DOCUMENTS) & (F.col("term") == "")).select("doc", "language")
            at = all_.join(at.drop("language"), "doc", "left").withColumn("at", F.coalesce("at", F.expr("CAST(map() AS map<string, struct<places: array<int>, tf_title: bigint>>)")))
        match, rank = F.lit(False), F.lit(0.0)
        for code in codes:
            mine = ~F.col("language").isin(*S.RULES) if code == "" and len(codes) > 1 else F.col("language") == code
            found, score = _evaluate(alternatives, stems[code])
            match = F.when(F.coalesce(mine, F.lit(code == "")), found).otherwise(match)
            rank = F.when(F.coalesce(mine, F.lit(code == "")), score).otherwise(rank)
        return at.filter(match).select(F.col("doc").alias(doc_id), rank.alias("rank"))


def _evaluate(alternatives: list[list[tuple[bool, list[str]]]], stems: dict[str, str]) -> tuple[Column, Column]:
    """(match, rank) over a map ``at`` from term to its places and how many of them are in the title."""

    def places(word: str) -> Column:
        return F.coalesce(F.try_element_at("at", F.lit(stems[word]))["places"], F.array().cast("array<int>"))

    def follow(phrase: list[str]) -> Column:
        if len(phrase) == 1:
            return F.size(places(phrase[0])) > 0
        starts = places(phrase[0])
        for i, word in enumerate(phrase[1:], 1):
            starts = F.array_intersect(starts, _moved(places(word), i))
        return F.size(starts) > 0

    match = F.lit(False)
    for alternative in alternatives:
        every = F.lit(True)
        for keep, phrase in alternative:
            every = every & (follow(phrase) if keep else ~follow(phrase))
        match = match | every
    wanted = list(dict.fromkeys(stems[w] for a in alternatives for keep, phrase in a if keep for w in phrase))
    asked = {stems[w] for a in alternatives for _, phrase in a for w in phrase}
    if len(alternatives) != 1 or len(asked) < 2:
        return match, _by_count(wanted)
    return match, _by_distance(wanted)


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def _weighed(term: str) -> Column:
    """Places of a term that count, each with its weight."""
    x = F.try_element_at("at", F.lit(term))
    return F.coalesce(F.transform(F.slice(x["places"], 1, PLACES), lambda p, i: F.struct(p.alias("p"), F.when(i < x["tf_title"], TITLE_WEIGHT).otherwise(CONTENT_WEIGHT).alias("w"))), F.array().cast("array<struct<p:int,w:double>>"))


def _by_count(wanted: list[str]) -> Column:
    sums, rank = F.array(*(F.lit(x) for x in PLACE_SUMS)), F.lit(0.0)
    for term in wanted:
        x = F.try_element_at("at", F.lit(term))
        upper, all_ = F.least(F.coalesce(x["tf_title"], F.lit(0)).cast("int"), F.lit(PLACES)), F.least(F.coalesce(F.size(x["places"]), F.lit(0)), F.lit(PLACES))
        rank = rank + TITLE_WEIGHT * F.get(sums, upper) + CONTENT_WEIGHT * (F.get(sums, F.greatest(all_, F.lit(0))) - F.get(sums, upper))
    return rank / (1.64493406685 * max(len(wanted), 1))


def _apart(a: Column, b: Column, left: Column) -> Column:
    """``left`` times 1 less the nearness of each pair of places of two words."""

    def one(product: Column, x: Column) -> Column:
        def other(inner: Column, y: Column) -> Column:
            d = F.abs(x["p"] - y["p"])
            return inner * (1 - F.sqrt(x["w"] * y["w"] / (1.005 + 0.05 * F.exp(d / 1.5 - 2))))

        return F.aggregate(F.filter(b, lambda y: F.abs(x["p"] - y["p"]).between(1, FAR)), product, other)

    return F.aggregate(a, left, one)


def _by_distance(wanted: list[str]) -> Column:
    left = F.lit(1.0)
    for a, b in combinations(wanted, 2):
        left = _apart(_weighed(a), _weighed(b), left)
    return F.greatest(1 - left, F.lit(LEAST_RANK))


def build(docs: DataFrame, path: str, doc_id: str = "passage_id", text: str = "text", title: str = "", language: str = "") -> TextIndex:
    """Writes an index of ``docs``; with a column for the language words are stemmed."""
    return TextIndex(docs.sparkSession, path).create(docs, id=doc_id, content=text, title=title, language=language)


def folder(spark: SparkSession) -> str:
    """Where an index is written: the folder that the cluster shares, or on one machine a temporary one."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", "")
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="feedloom-index-")
    atexit.register(_quietly_delete, spark, made)
    return made


def _quietly_delete(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # noqa: BLE001  the session may have ended before
        pass


def fingerprint(df: DataFrame) -> str:
    """What the files that ``df`` reads are: their names, sizes and times. It changes when any of them does."""
    spark, h = df.sparkSession, hashlib.sha256()
    for name in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        h.update(f"{name}|{status.getLen()}|{status.getModificationTime()}\n".encode())
    return h.hexdigest()


_built: dict[tuple, tuple[str, str]] = {}


def of_corpus(rows: DataFrame, key: str, make) -> str:
    """The path of what ``make(rows, path)`` has built for a corpus in this session. If its files have changed, it is built anew and the old one goes; all go at the end."""
    spark = rows.sparkSession
    k, now = (spark.sparkContext.applicationId, key), fingerprint(rows)
    if k in _built and _built[k][0] == now:
        return _built[k][1]
    if k in _built:
        _quietly_delete(spark, _built.pop(k)[1])
    path = f"{folder(spark)}/index-{uuid.uuid4().hex}"
    make(rows, path)
    atexit.register(_quietly_delete, spark, path)
    _built[k] = (now, path)
    return path


def index_of(docs: DataFrame, key: str, doc_id: str, text: str, title: str = "", language: str = "") -> TextIndex:
    """The text index of a corpus, built when a session first asks for it, or when its files have changed."""
    path = of_corpus(docs, f"text|{key}|{doc_id}|{text}|{title}|{language}", lambda rows, p: build(rows, p, doc_id, text, title, language))
    return TextIndex(docs.sparkSession, path)
