"""An index for nearest passages: lists of a coarse quantiser on disk, in segments.

Centres are fitted on a bounded sample; every row is in the list of its nearest centre, in files of that list. A search compares
the query with the centres and reads the nearest lists, or all lists that may hold a nearer row, which makes it exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.operators.postings import of_corpus
from feedloom.operators.retrieval import CELLS, MOST_VECTOR, _nearest, candidates, knn_many, ranked, seeds
from feedloom.sources.versions import Segments

#: Rows for each list on which its centre is fitted, and the most lists: so a fit reads 2 million rows at the most, and centres of 768 numbers are 25 MB.
SAMPLE, MOST_LISTS = 256, 4096
#: A search reads as many lists, unless told otherwise, as hold this part of the NEIGHBOURS nearest rows of CHECKED rows, measured when the index is built.
TARGET, NEIGHBOURS, CHECKED = 0.95, 10, 256
#: Distances are rounded to six digits, so lists are given up only if they are further than that.
SLACK = 2e-6


def _matrix(column: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of so many numbers, and these at length 1; a vector of zeros stays."""
    fits = np.flatnonzero(pc.equal(pc.list_value_length(column), dimensions).fill_null(False).to_numpy(zero_copy_only=False))
    m = column.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), dimensions)
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return fits, m / np.where(norm > 0, norm, 1)


class VectorIndex(Segments):
    """passage_id, entry_id, embedding by list. Rows whose vector is null or of another length than the index's are not held, as no search finds them."""

    key = "passage_id"
    parts = ("data", "ids", "gone", "reach")
    schema = "passage_id long, entry_id long, embedding array<float>, closeness double, list int"

    def centres(self, state: dict | None = None) -> np.ndarray:
        """The centres by list, at length 1: bounded, so the driver and every task hold them."""
        rows = self.spark.read.parquet(f"{self.path}/{(state or self.state())['extra']['centres']}").orderBy("list").collect()
        return np.asarray([r["centre"] for r in rows], np.float64)

    def make(self, rows: DataFrame, extra: dict) -> DataFrame:
        sent = self.spark.sparkContext.broadcast(self.centres({"extra": extra}))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = sent.value
            for batch in batches:
                fits, m = _matrix(batch.column("embedding"), c.shape[1])
                near = m @ c.T
                best = near.argmax(1)
                yield pa.record_batch([*batch.take(pa.array(fits)).columns, pa.array(near[np.arange(len(fits)), best]), pa.array(best.astype(np.int32))], [*batch.schema.names, "closeness", "list"])

        rows = rows.select(F.col("passage_id").cast("long"), F.col("entry_id").cast("long"), F.col("embedding").cast("array<float>"))
        return rows.mapInArrow(assign, self.schema)

    def summaries(self, data: DataFrame) -> dict[str, DataFrame]:
        """reach: how close to the centre the furthest row of each list is."""
        return {"ids": data.select("passage_id", F.lit(1).cast("long").alias("size")), "reach": data.groupBy("list").agg(F.min("closeness").alias("closeness"))}

    def store(self, data: DataFrame, folder: str) -> None:
        data.hint("rebalance", F.col("list")).sortWithinPartitions("list", "passage_id").write.partitionBy("list").parquet(folder)

    def _lists(self, rows: DataFrame, lists: list[int], state: dict) -> DataFrame:
        return self.live(rows.filter(F.col("list").isin(*lists) if lists else F.lit(False)), state["segments"])

    def rows(self, lists: list[int], state: dict | None = None) -> DataFrame:
        """The live rows of some lists; other lists' files aren't read."""
        state = state or self.state()
        return self._lists(self.rows_of("data", state["segments"]), lists, state)

    def probes(self, state: dict | None = None) -> int:
        return (state or self.state())["extra"]["probes"]

    def nearest(self, vector: list[float], limit: int, probes: int | None = None, within: DataFrame | None = None, exact: bool = False) -> DataFrame:
        """passage_id, entry_id, distance, rank of the nearest rows in the ``probes`` nearest lists; ties by id.

        ``within`` (entry_id) restricts what may be found, before the limit; while that leaves too few, twice as many lists are read. ``exact``: a
        list is left out only if the angles to its centre and to its furthest row prove that it holds nothing nearer than what was found.
        """
        state = self.state()
        c, q = self.centres(state), np.asarray(vector, np.float64)
        limit, schema = max(limit, 0), "passage_id long, entry_id long, distance double"
        if len(q) != c.shape[1] or not limit:
            return ranked(self.spark.createDataFrame([], schema), F.col("distance"), F.col("passage_id"))
        near = c @ (q / (np.sqrt((q * q).sum()) or 1))
        order = np.argsort(-near, kind="stable")
        probes = min(probes or self.probes(state), len(order))

        def found(lists: list[int]) -> DataFrame:
            p = self.rows(lists, state)
            p = p if within is None else p.join(within.select("entry_id").distinct(), "entry_id", "left_semi")
            best = p.select("passage_id", "entry_id", "embedding").mapInArrow(partial(_nearest, vector=q, limit=limit), schema)
            return best.orderBy("distance", "passage_id").limit(limit)

        best = found(order[:probes].tolist())
        if exact or within is not None:
            last = best.agg(F.count("*"), F.max("distance")).first()  # two numbers
            while last[0] < limit and probes < len(order):
                probes = min(2 * probes, len(order))
                best = found(order[:probes].tolist())
                last = best.agg(F.count("*"), F.max("distance")).first()
        if exact and probes < len(order):
            reach = self._furthest(state)
            gap = np.maximum(np.arccos(np.clip(near, -1, 1)) - reach, 0)
            may = np.flatnonzero((reach >= 0) & (1 - np.cos(gap) <= last[1] + SLACK)).tolist()
            best = found(sorted({*order[:probes].tolist(), *may}))
        return ranked(best, F.col("distance"), F.col("passage_id"))

    def _furthest(self, state: dict) -> np.ndarray:
        """For every list the angle between its centre and its furthest row; -1 for lists without rows. A number a list."""
        out, rows = np.full(len(self.centres(state)), -1.0), self.read("reach", state["segments"])
        for i, closeness in [] if rows is None else rows.groupBy("list").agg(F.min("closeness")).collect():
            out[i] = np.arccos(np.clip(closeness, -1, 1))
        return out

    def nearest_many(self, queries: DataFrame, limit: int, probes: int | None = None, block: int = 1000, without_own: bool = False, exact: bool = False) -> DataFrame:
        """query_id, passage_id, entry_id, distance, rank for every row of queries (query_id, embedding; entry_id if its own entry is left out).

        Queries are dealt into blocks of about ``block``. A task compares the rows of a list with the queries that probe it, by one matrix
        product, and gives out ``limit`` rows a query. ``exact``: each query then reads the lists that may hold nearer rows, as in ``nearest``.
        """
        state = self.state()
        c, own = self.centres(state), F.col("entry_id") if without_own else F.lit(-1).cast("long")
        probes = min(probes or self.probes(state), len(c))
        queries = queries.filter(F.size("embedding") == c.shape[1]).select("query_id", own.alias("own"), "embedding")
        blocks, out = max(1, -(-queries.count() // block)), None
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "passage_id"))
        for b in range(blocks):
            got = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()  # a block
            if not got.num_rows:
                continue
            ids, own_ids = got.column("query_id").to_numpy(), got.column("own").to_numpy()
            _, q = _matrix(got.column("embedding").combine_chunks(), c.shape[1])
            near = q @ c.T
            asked = np.zeros(near.shape, bool)
            np.put_along_axis(asked, np.argsort(-near, axis=1, kind="stable")[:, :probes], True, 1)

            def compared(asked: np.ndarray, ids=ids, own_ids=own_ids, q=q) -> DataFrame:
                sent = self.spark.sparkContext.broadcast((ids, own_ids, q, asked))
                rows = self.rows(np.flatnonzero(asked.any(0)).tolist(), state).select("passage_id", "entry_id", "embedding", "list")
                part = rows.mapInArrow(partial(_probed, queries=sent, limit=limit), "query_id long, passage_id long, entry_id long, distance double")
                return part.withColumn("rank", rank).filter(F.col("rank") <= limit)

            if exact and not asked.all():
                last = compared(asked).groupBy("query_id").agg(F.count("*"), F.max("distance")).collect()  # a row a query of the block
                bound = {i: d for i, n, d in last if n >= limit}
                far = np.asarray([bound.get(i, np.inf) for i in ids.tolist()])[:, None]
                reach = self._furthest(state)[None, :]
                gap = np.maximum(np.arccos(np.clip(near, -1, 1)) - reach, 0)
                asked |= (reach >= 0) & (1 - np.cos(gap) <= far + SLACK)
            part = compared(asked)
            out = part if out is None else out.unionByName(part)
        if out is None:
            return self.spark.createDataFrame([], "query_id long, passage_id long, entry_id long, distance double, rank int")
        return out

    def similar(self, passages: DataFrame, entry_id: int, limit: int, probes: int | None = None, exact: bool = False) -> DataFrame:
        """passage_id, entry_id, distance, rank: what lies nearest to any seed of the entry, the entry itself left out."""
        per_seed = candidates(limit, MOST_VECTOR)
        s = seeds(passages, entry_id).select(F.col("passage_id").alias("query_id"), "entry_id", "embedding")
        best = self.nearest_many(s, per_seed, probes, without_own=True, exact=exact).groupBy("passage_id", "entry_id").agg(F.min("distance").alias("distance"))
        return ranked(best.orderBy("distance", "passage_id").limit(per_seed), F.col("distance"), F.col("passage_id"))


def _probed(batches: Iterator[pa.RecordBatch], queries, limit: int) -> Iterator[pa.RecordBatch]:
    """For each query the nearest rows of a task, of the lists that it probes; never more than ``limit`` a query are held, but for those of about CELLS
    distances, however many rows are equally near."""
    ids, own, q, asked = queries.value
    held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # query, passage, entry, distance

    def best(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        every = [np.concatenate(x) for x in zip(*parts, strict=True)]
        order = np.lexsort((every[1], every[3], every[0]))
        every = [x[order] for x in every]
        first = np.searchsorted(every[0], every[0], "left")
        keep = np.arange(len(first)) - first < limit
        return [x[keep] for x in every]

    for batch in batches:
        fits, m = _matrix(batch.column("embedding"), q.shape[1])
        passage, entry, of = (batch.column(n).to_numpy()[fits] for n in ("passage_id", "entry_id", "list"))
        parts, new = [held], 0
        for i in np.unique(of).tolist():
            who, mine = np.flatnonzero(asked[:, i]), np.flatnonzero(of == i)
            step = max(1, CELLS // max(len(who), 1))
            for rows in (mine[k : k + step] for k in range(0, len(mine), step)):
                d = np.round(1 - q[who] @ m[rows].T, 6) + 0.0
                d[entry[rows][None, :] == own[who][:, None]] = np.inf
                if d.shape[1] > limit:
                    cut = np.partition(d, limit - 1, axis=1)[:, limit - 1 : limit]
                    a, b = np.nonzero((d <= cut) & np.isfinite(d))
                else:
                    a, b = np.nonzero(np.isfinite(d))
                parts.append([who[a], passage[rows][b], entry[rows][b], d[a, b]])
                new += len(a)
                if new > CELLS:
                    parts, new = [best(parts)], 0
        held = best(parts)
    yield pa.record_batch([pa.array(ids[held[0]]), *(pa.array(x) for x in held[1:])], ["query_id", "passage_id", "entry_id", "distance"])


def build(passages: DataFrame, path: str, lists: int | None = None, seed: int = 1) -> VectorIndex:
    """An index of ``passages`` (passage_id, entry_id, embedding). About as many lists as the root of the rows, MOST_LISTS at the most.

    The centres are those of spherical k-means on SAMPLE rows a list, picked by hash of the id; all rows are indexed, whether sampled or not.
    """
    from pyspark.ml.clustering import KMeans  # not needed where rows are compared
    from pyspark.ml.functions import array_to_vector

    spark: SparkSession = passages.sparkSession
    whole = passages.filter(F.col("embedding").isNotNull())
    n = whole.count()
    dimensions = (whole.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first() or [1])[0]  # the usual length
    fit = whole.filter(F.size("embedding") == dimensions).select(F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.xxhash64("passage_id", F.lit(seed)).alias("h"))
    fit = fit.filter(F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: F.isnan(x) | x.isNull()))
    lists = min(lists or ceil(sqrt(max(n, 1))), MOST_LISTS)
    share = min(1.0, lists * SAMPLE / max(n, 1))
    sample = fit.filter(F.pmod("h", F.lit(1_000_000)) < F.lit(ceil(share * 1_000_000))).select(array_to_vector("v").alias("features"))
    if sample.isEmpty():
        centres = np.zeros((1, dimensions))
    else:
        model = KMeans(k=max(lists, 2), distanceMeasure="cosine", maxIter=10, seed=seed).fit(sample)
        centres = np.asarray([c for c in model.clusterCenters()], np.float64)
        centres /= np.maximum(np.sqrt((centres * centres).sum(1, keepdims=True)), 1e-300)
    name = f"centres/{uuid.uuid4().hex[:12]}"
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>").coalesce(1).write.parquet(f"{path}/{name}")
    index = VectorIndex(spark, path)
    index.create(passages, centres=name, probes=1)
    version, state = index.manifest.read()
    state["extra"]["probes"] = _calibrated(index, passages, seed)
    index.manifest.commit(version, state)
    return index


def _calibrated(index: VectorIndex, passages: DataFrame, seed: int) -> int:
    """The lists that a search must read to find TARGET of the true neighbours, from a comparison of about CHECKED rows with all rows."""
    state = index.state()
    c = index.centres(state)
    share = min(1.0, CHECKED / max(state["n"], 1))
    asked = passages.filter((F.size("embedding") == c.shape[1]) & (F.pmod(F.xxhash64("passage_id", F.lit(seed + 1)), F.lit(1_000_000)) < F.lit(ceil(share * 1_000_000))))
    asked = asked.select(F.col("passage_id").alias("query_id"), "embedding")
    true = knn_many(passages, asked, NEIGHBOURS + 1).filter("query_id <> passage_id AND NOT isnan(distance)").select("query_id", "passage_id")
    pairs = true.join(index.data(state).select("passage_id", "list"), "passage_id").select("query_id", "list").toArrow()  # NEIGHBOURS a row asked
    if not pairs.num_rows:
        return len(c)
    vectors = asked.toArrow()
    _, q = _matrix(vectors.column("embedding").combine_chunks(), c.shape[1])
    near = q @ c.T
    place = {i: n for n, i in enumerate(vectors.column("query_id").to_pylist())}
    rank = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1)
    needed = np.sort([rank[place[i], of] for i, of in zip(pairs.column("query_id").to_pylist(), pairs.column("list").to_pylist(), strict=True)])
    return int(needed[min(ceil(TARGET * len(needed)), len(needed)) - 1]) + 1


def index_of(passages: DataFrame, key: str) -> VectorIndex:
    """The index of a corpus' passages, built when a session first asks for it, or when its files have changed."""
    return VectorIndex(passages.sparkSession, of_corpus(passages, f"vectors|{key}", build))
