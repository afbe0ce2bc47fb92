"""Retrieval: BM25, exact cosine search, rank fusion, entries from passages, more like this."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.functions import text as T

K1, B = 1.2, 0.75
RRF_K = 60
SEEDS = 32
OVERFETCH = 5
LEAST_CANDIDATES, MOST_LEXICAL, MOST_VECTOR = 50, 2000, 1000
#: Distances that a task holds at a time.
CELLS = 1_000_000
MODES = ("hybrid", "keyword", "semantic", "passages")
TOKEN = r"[\p{L}\p{N}]+"
#: Weights of title and content in the built-in search.
TITLE_WEIGHT, CONTENT_WEIGHT = 1.0, 0.4
#: Bytes of title and content that the built-in search reads, and places of a word that count.
TITLE_BYTES, CONTENT_BYTES, PLACES = 200_000, 500_000, 256
PLACE_SUMS = [sum(1 / j**2 for j in range(1, n + 1)) for n in range(PLACES + 1)]
#: Hits of a search that names no limit, and the most that the API and the pages give out.
DEFAULT_LIMIT, WEB_LIMIT, PAGE_LIMIT = 10, 100, 20


class SearchError(ValueError):
    """A search that cannot be run, as opposed to one that finds nothing."""


@dataclass(frozen=True)
class Filters:
    """Restrictions on the entries searched; the user is a must, times are inclusive."""

    user_id: int
    feed_ids: tuple[int, ...] = ()
    category_ids: tuple[int, ...] = ()
    since: datetime | None = None
    until: datetime | None = None
    unread: bool = False
    starred: bool = False
    extra: tuple[Column, ...] = field(default=())

    def entry_ids(self, entries: DataFrame, feeds: DataFrame | None = None) -> DataFrame:
        e = entries.filter(F.col("user_id") == self.user_id)
        e = e.filter(F.col("feed_id").isin(*self.feed_ids)) if self.feed_ids else e
        if self.category_ids:
            e = e.join(feeds.filter(F.col("category_id").isin(*self.category_ids)).select("feed_id"), "feed_id", "left_semi")
        e = e.filter(F.col("published_at") >= F.lit(self.since)) if self.since else e
        e = e.filter(F.col("published_at") <= F.lit(self.until)) if self.until else e
        e = e.filter(F.col("status") == "unread") if self.unread else e
        e = e.filter("starred") if self.starred else e
        for condition in self.extra:
            e = e.filter(condition)
        return e.select("entry_id")


def search_limit(limit: int, most: int = WEB_LIMIT) -> int:
    return min(limit if limit > 0 else DEFAULT_LIMIT, most)


def candidates(limit: int, most: int) -> int:
    return min(max(OVERFETCH * limit, LEAST_CANDIDATES), most)


def limited(limit: Column, most: int = WEB_LIMIT) -> Column:
    """``search_limit`` of a column of limits."""
    return F.least(F.when(limit > 0, limit).otherwise(DEFAULT_LIMIT), F.lit(most))


def fetched(limit: Column, most: int) -> Column:
    """``candidates`` of a column of limits."""
    return F.least(F.greatest(OVERFETCH * limit, F.lit(LEAST_CANDIDATES)), F.lit(most))


def terms(query: str) -> list[str]:
    return list(dict.fromkeys(t.lower() for t in re.findall(r"[^\W_]+", query)))


def terms_of(text: str) -> list[str]:
    """The words of a text in order, as ``tokens`` gives them."""
    return [t.lower() for t in re.findall(r"[^\W_]+", text)]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), 1)


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Ranks from 1 on; only ever over a list already cut to a limit, so one task is enough."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def bm25(docs: DataFrame, query: str, limit: int, doc_id: str = "passage_id", text: str = "text", within: DataFrame | None = None) -> DataFrame:
    """doc_id, score, rank of the best matches, ties by id. Only the query's terms leave the scan of the texts.

    Statistics cover all ``docs``; ``within`` (ids) restricts what may be found, before the limit.
    """
    words = terms(query)
    if not words or limit <= 0:
        return docs.select(F.col(doc_id), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    wanted = F.array(*map(F.lit, words))
    t = docs.select(doc_id, tokens(F.col(text)).alias("t")).select(doc_id, F.size("t").alias("dl"), F.filter("t", lambda x: F.array_contains(wanted, x)).alias("hit"))
    stats = t.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    tf = t.filter(F.size("hit") > 0).select(doc_id, "dl", F.explode("hit").alias("term")).groupBy(doc_id, "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    found = tf if within is None else tf.join(within, doc_id, "left_semi")
    both = found.join(F.broadcast(df), "term").join(F.broadcast(stats))  # a row a query term, and one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = both.groupBy(doc_id).agg(F.round(F.sum(part), 6).alias("score"))
    return ranked(scored.orderBy(F.desc("score"), doc_id).limit(limit), F.desc("score"), F.col(doc_id))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _nearest(batches: Iterator[pa.RecordBatch], vector: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """Of each task's passages the nearest, by one matrix product a batch; ties by id."""
    ids, entries, far = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    q = vector / np.sqrt((vector * vector).sum())
    for batch in batches:
        column = batch.column("embedding")
        fits = np.flatnonzero(pc.equal(pc.list_value_length(column), len(vector)).fill_null(False).to_numpy(zero_copy_only=False))
        if not len(fits):
            continue
        m = column.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), -1)
        with np.errstate(invalid="ignore", divide="ignore"):
            d = np.round(1 - m @ q / np.sqrt((m * m).sum(1)), 6) + 0.0  # no negative zero
        ids = np.concatenate([ids, batch.column("passage_id").to_numpy()[fits]])
        entries = np.concatenate([entries, batch.column("entry_id").to_numpy()[fits]])
        far = np.concatenate([far, d])
        best = np.lexsort((ids, far))[:limit]
        ids, entries, far = ids[best], entries[best], far[best]
    yield pa.record_batch([pa.array(ids), pa.array(entries), pa.array(far)], ["passage_id", "entry_id", "distance"])


def knn(passages: DataFrame, vector: list[float], limit: int, within: DataFrame | None = None) -> DataFrame:
    """passage_id, entry_id, distance, rank: the nearest by cosine distance, all passages compared. Only ``limit`` rows leave a task."""
    schema = "passage_id long, entry_id long, distance double"
    p = passages if within is None else passages.join(within, "entry_id", "left_semi")
    v = np.asarray(vector, np.float64)
    near = p.select("passage_id", "entry_id", "embedding").mapInArrow(partial(_nearest, vector=v, limit=max(limit, 0)), schema)
    return ranked(near.orderBy("distance", "passage_id").limit(max(limit, 0)), F.col("distance"), F.col("passage_id"))


def _nearest_many(batches: Iterator[pa.RecordBatch], queries, limit: int) -> Iterator[pa.RecordBatch]:
    """For each query the nearest passages of a task: matrix products with all queries of the block, of at most CELLS distances, or one passage's."""
    ids, q = queries.value
    far = np.full((len(ids), 0), np.inf)
    places: list[np.ndarray] = [np.zeros((len(ids), 0), np.int64) for _ in range(2)]
    rows = np.arange(len(ids))[:, None]
    for batch in batches:
        column = batch.column("embedding")
        fits = np.flatnonzero(pc.equal(pc.list_value_length(column), q.shape[1]).fill_null(False).to_numpy(zero_copy_only=False))
        if not len(fits):
            continue
        step = max(1, CELLS // max(len(ids), 1))
        for part in (fits[i : i + step] for i in range(0, len(fits), step)):
            m = column.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1)
            with np.errstate(invalid="ignore", divide="ignore"):
                d = np.round(1 - q @ (m / np.sqrt((m * m).sum(1, keepdims=True))).T, 6) + 0.0
            far = np.concatenate([far, d], 1)
            places = [np.concatenate([x, np.broadcast_to(batch.column(c).to_numpy()[part], d.shape)], 1) for x, c in zip(places, ("passage_id", "entry_id"), strict=True)]
            best = np.lexsort((places[0], far), axis=1)[:, :limit]
            far, places = far[rows, best], [x[rows, best] for x in places]
    n = far.shape[1]
    yield pa.record_batch([pa.array(np.repeat(ids, n)), *(pa.array(x.reshape(-1)) for x in places), pa.array(far.reshape(-1))], ["query_id", "passage_id", "entry_id", "distance"])


def knn_many(passages: DataFrame, queries: DataFrame, limit: int, block: int = 1000) -> DataFrame:
    """query_id, passage_id, entry_id, distance, rank for every row of queries (query_id, embedding), against all passages.

    Queries are dealt into blocks of about ``block``; a block is sent to the tasks, which compare it with their passages by matrix
    products and give out ``limit`` rows a query. So neither side is paired row by row, and what is sent has a bounded size.
    """
    blocks = max(1, -(-queries.count() // block))
    number, out = F.pmod(F.xxhash64("query_id"), F.lit(blocks)), None
    for b in range(blocks):
        rows = queries.filter(number == b).select("query_id", "embedding").toArrow()
        if not rows.num_rows:
            continue
        q = np.stack([np.asarray(x, np.float64) for x in rows.column("embedding").to_pylist()])
        sent = passages.sparkSession.sparkContext.broadcast((rows.column("query_id").to_numpy(), q / np.sqrt((q * q).sum(1, keepdims=True))))
        part = passages.select("passage_id", "entry_id", "embedding").mapInArrow(partial(_nearest_many, queries=sent, limit=limit), "query_id long, passage_id long, entry_id long, distance double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return passages.select(F.lit(0).cast("long").alias("query_id"), "passage_id", "entry_id", F.lit(0.0).alias("distance"), F.lit(0).alias("rank")).limit(0)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "passage_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= limit)


def fuse(*lists: DataFrame, limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of lists (passage_id, entry_id, rank); raw scores are never read."""
    union = lists[0].select("passage_id", "entry_id", "rank")
    for other in lists[1:]:
        union = union.unionByName(other.select("passage_id", "entry_id", "rank"))
    scored = union.groupBy("passage_id", "entry_id").agg(F.sum(1 / (RRF_K + F.col("rank"))).alias("score"))
    scored = scored.withColumn("score", F.round("score", 9))
    scored = scored.orderBy(F.desc("score"), "passage_id").limit(limit) if limit else scored
    return ranked(scored, F.desc("score"), F.col("passage_id"))


def by_entry(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """entry_id, best_passage, best_rank, passages (best first): entries in the order of their best passage."""
    found = hits.groupBy("entry_id").agg(
        F.min_by("passage_id", "rank").alias("best_passage"), F.min("rank").alias("best_rank"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "passage_id"))), lambda x: x["passage_id"]).alias("passages")
    )
    return found.orderBy("best_rank").limit(limit) if limit else found


def seeds(passages: DataFrame, entry_id: int, most: int = SEEDS) -> DataFrame:
    """At most ``most`` passages of an entry, at even strides."""
    mine = passages.filter(F.col("entry_id") == entry_id)
    w = Window.partitionBy("entry_id").orderBy("ordinal")
    mine = mine.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("entry_id")))
    at = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.floor(k * F.col("n") / most))
    return mine.filter((F.col("n") <= most) | F.array_contains(at, F.col("i").cast("long"))).drop("i", "n")


def similar(passages: DataFrame, entry_id: int, limit: int, within: DataFrame | None = None) -> DataFrame:
    """passage_id, entry_id, distance, rank: what lies nearest to any seed of the entry, the entry itself left out.

    At most SEEDS seeds meet every passage, by matrix products; each seed keeps its nearest only, found by one pass.
    """
    per_seed = candidates(limit, MOST_VECTOR)
    s = seeds(passages, entry_id).select(F.col("passage_id").alias("query_id"), "embedding")
    others = passages.filter(F.col("entry_id") != entry_id)
    others = others if within is None else others.join(within, "entry_id", "left_semi")
    d = knn_many(others, s, per_seed)
    best = d.groupBy("passage_id", "entry_id").agg(F.min("distance").alias("distance"))
    return ranked(best.orderBy("distance", "passage_id").limit(per_seed), F.col("distance"), F.col("passage_id"))


def search(mode: str, passages: DataFrame, query: str, limit: int, filters: Filters, entries: DataFrame, embed=None, feeds: DataFrame | None = None) -> DataFrame:
    """Entries for a query in one of MODES; passages have text and embedding. Unknown modes and a missing embedder are errors."""
    mode, limit = mode or "hybrid", search_limit(limit)
    if mode not in MODES:
        raise SearchError(f"mode must be one of {', '.join(MODES)}")
    within = filters.entry_ids(entries, feeds)
    fetch = OVERFETCH * max(limit, 0)
    lexical = semantic = None
    if mode != "semantic":
        own = passages.join(within, "entry_id", "left_semi").select("passage_id")
        lexical = bm25(passages, query, candidates(fetch, MOST_LEXICAL), within=own).join(passages.select("passage_id", "entry_id"), "passage_id")
    if mode in ("semantic", "hybrid", "passages"):
        if embed is None:
            raise SearchError("no embedder")
        if not query.strip():
            raise SearchError("nothing to embed")
        semantic = knn(passages, embed(query), candidates(fetch, MOST_VECTOR), within)
    if mode == "keyword":
        return by_entry(lexical, limit)
    if mode == "semantic":
        return by_entry(semantic, limit)
    fused = fuse(lexical, semantic)
    return fused.filter(F.col("rank") <= limit) if mode == "passages" else by_entry(fused, limit)


def websearch(query: str) -> list[list[tuple[bool, list[str]]]]:
    """Alternatives of (wanted, words): ``or`` parts alternatives, a minus refuses, quotes hold words together; all else must be there."""
    out: list[list[tuple[bool, list[str]]]] = [[]]
    for minus, quoted, plain in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', query):
        if plain.lower() == "or" and not minus:
            out.append([])
            continue
        words = re.findall(r"[^\W_]+", (quoted or plain).lower())
        if words:
            out[-1].append((not minus, words))
    return [x for x in out if x]


def _places(words: Column, phrase: list[str]) -> Column:
    """Whether the words of a phrase follow one another in an array of words."""
    if len(phrase) == 1:
        return F.array_contains(words, phrase[0])
    starts = F.filter(F.transform(words, lambda x, i: F.when(x == phrase[0], i + 1)), lambda i: i.isNotNull())
    return F.exists(starts, lambda i: F.slice(words, i, len(phrase)) == F.array(*map(F.lit, phrase)))


def full_text(entries: DataFrame, query: str) -> tuple[Column, Column]:
    """(match, rank) of the built-in search over title and content. No stemming.

    The rank is the sum over the words asked for of ``sum w / j**2`` over a word's places j = 1, 2, ... (the title's, which weigh
    more, come first; PLACES of them count), over 1.64493406685 and the number of words.
    """
    title, content = tokens(T.truncate_bytes(F.col("title"), TITLE_BYTES)), tokens(T.truncate_bytes(F.col("content"), CONTENT_BYTES))
    match, wanted = F.lit(False), []
    for alternative in websearch(query):
        every = F.lit(True)
        for keep, phrase in alternative:
            found = _places(title, phrase) | _places(content, phrase)
            every = every & (found if keep else ~found)
            wanted += phrase if keep else []
        match = match | every
    wanted = list(dict.fromkeys(wanted))
    sums, steps = F.array(*(F.lit(x) for x in PLACE_SUMS)), F.lit(PLACES)
    rank = F.lit(0.0)
    for word in wanted:
        count = lambda words, word=word: F.size(F.filter(words, lambda x: x == word))
        upper, all_ = F.least(count(title), steps), F.least(count(title) + count(content), steps)
        rank = rank + TITLE_WEIGHT * F.get(sums, upper) + CONTENT_WEIGHT * (F.get(sums, all_) - F.get(sums, upper))
    return match, rank / (1.64493406685 * max(len(wanted), 1))
