"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters and digits (and of anything outside ASCII), A-Z lower-cased. Documents and items are joined
on seeds, the hashes of ``k`` consecutive tokens. For every pair that may reach the threshold, the longest common runs of
tokens are marked again and again, the longest first and never twice, found by running Karp-Rabin hashes; ``coverage`` is the
share of the item's tokens that end up marked. Order between runs is free, so reordered passages count in full.

A run of m >= k tokens has at least m / k seeds, so a pair that reaches coverage c of n tokens shares at least c * n / k places of
the item's seeds. Hence it shares one of all but that many less one: an item is joined on its rarest seeds only, and seeds that
very many items have pair nothing. Pairs that share fewer places than that aren't tiled.

Only the parts of a document that hold seeds are kept for tiling, as every match of ``k`` tokens or more consists of
seeds. Defined cases: null or empty texts, and items with fewer than ``k`` tokens, match nothing. Repeated rows are
reported once; rows with a null id are not reported, and drop_leaks keeps them. Empty tables give no pairs. A very long text is
searched whole. Of equally long runs the one that comes first in the item is marked first, at its first free place in the
document. Further columns of any name are kept by drop_leaks and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.llm.common import cut, id_bits, id_text
from feedloom.llm.textvec import NOT_ALNUM, grams, mix, powers, signed, words

U = np.uint64
SEED_TOKENS = 5
COVERAGE = 0.6
#: Up to so many seeds (8 bytes each) the benchmark's are sent to the tasks as they are, to drop other seeds before the join; of more a bit set.
SEEDS_SENT = 4_000_000


def windows(tokens: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``size`` tokens, each from the running sum."""
    power, inverse = powers(len(tokens) + 1)
    total = np.zeros(len(tokens) + 1, U)
    np.cumsum(tokens * power[: len(tokens)], out=total[1:])
    return (total[size:] - total[:-size]) * inverse[: len(tokens) - size + 1]


def tile(text: np.ndarray, item: np.ndarray, least: int) -> np.ndarray:
    """Which of the item's tokens are marked. A 0 in ``text`` ends a run."""
    free_t, free_i = text != 0, np.ones(len(item), bool)

    def common(size: int) -> tuple[np.ndarray, np.ndarray]:
        spots = []
        for tokens, free in ((text, free_t), (item, free_i)):
            if len(tokens) < size:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            taken = np.concatenate([[0], np.cumsum(~free)])
            at = np.flatnonzero(taken[size:] == taken[:-size])
            spots.append((at, mix(windows(tokens, size)[at])))
        (at_t, h_t), (at_i, h_i) = spots
        both = np.intersect1d(h_t, h_i)
        keep_t, keep_i = np.isin(h_t, both), np.isin(h_i, both)
        return at_t[keep_t], at_i[keep_i]

    high = min(len(text), len(item))
    while high >= least:
        low, top = least, high  # the longest common run has a length from low to top
        if not len(common(low)[0]):
            break
        while low < top:
            half = (low + top + 1) // 2
            low, top = (half, top) if len(common(half)[0]) else (low, half - 1)
        at_t, at_i = common(low)
        h_t, h_i = mix(windows(text, low)[at_t]), mix(windows(item, low)[at_i])
        places: dict[int, list[int]] = {}
        for a, h in zip(at_t.tolist()[::-1], h_t.tolist()[::-1], strict=True):
            places.setdefault(h, []).append(a)
        marked = False
        for b, h in zip(at_i.tolist(), h_i.tolist(), strict=True):
            spots = places.get(h, [])
            while spots and free_i[b : b + low].all():
                a = spots.pop()
                if free_t[a : a + low].all() and (text[a : a + low] == item[b : b + low]).all():
                    free_t[a : a + low] = False
                    free_i[b : b + low] = False
                    marked = True
        high = low if marked else low - 1
    return ~free_i


def _items(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """item_id, tokens, distinct seeds, and how often the item has each."""
    for batch in batches:
        for w in words(batch.column("text"), separators=NOT_ALNUM):
            g, at = grams(w, k)
            n = w.last - w.first
            found = [np.unique(g[at[i] : at[i + 1]], return_counts=True) for i in range(n)]
            yield pa.record_batch(
                [
                    batch.column("item_id").slice(w.first, n),
                    pa.array([(w.hash[w.bounds[i] : w.bounds[i + 1]] | U(1)).tobytes() for i in range(n)], pa.binary()),
                    pa.array([signed(x) for x, _ in found], pa.list_(pa.int64())),
                    pa.array([x for _, x in found], pa.list_(pa.int64())),
                ],
                ["item_id", "tokens", "seeds", "times"],
            )


class Seeds:
    """The benchmark's seeds: all of them, sorted, or a bit set of ``bits`` bits that lets some others pass too."""

    def __init__(self, seeds: np.ndarray | None, words: np.ndarray | None = None, bits: int = 0):
        self.seeds, self.words, self.bits = seeds, words, bits

    def hit(self, g: np.ndarray) -> np.ndarray:
        if self.seeds is None:
            h = g % U(self.bits)
            return (self.words.view(U)[(h // U(64)).astype(np.int64)] >> (h % U(64))) & U(1) == 1
        if not len(self.seeds):
            return np.zeros(len(g), bool)
        return self.seeds[np.minimum(np.searchsorted(self.seeds, g), len(self.seeds) - 1)] == g


def _excerpts(batches: Iterator[pa.RecordBatch], k: int, sent) -> Iterator[pa.RecordBatch]:
    """doc_id, the tokens that seeds cover (runs divided by a 0), distinct seeds; only documents with a seed."""
    wanted = sent.value
    for batch in batches:
        for w in words(batch.column("text"), separators=NOT_ALNUM):
            g, at = grams(w, k)
            hit = wanted.hit(g)
            count = np.concatenate([[0], np.cumsum(hit)])
            ids, excerpts, seeds = [], [], []
            for i in np.flatnonzero(count[at[1:]] > count[at[:-1]]):
                here = np.flatnonzero(hit[at[i] : at[i + 1]])
                own = w.hash[w.bounds[i] : w.bounds[i + 1]] | U(1)
                mark = np.zeros(len(own) + 1, np.int64)
                mark[here] += 1
                mark[here + k] -= 1
                covered = np.cumsum(mark)[: len(own)] > 0
                gap = covered.copy()
                gap[1:] |= covered[:-1]  # one token after each run stands for its end
                ids.append(w.first + i)
                excerpts.append(np.where(covered, own, U(0))[gap].tobytes())
                seeds.append(signed(np.unique(g[at[i] : at[i + 1]][here])))
            if ids:
                yield pa.record_batch([batch.column("doc_id").take(pa.array(ids)), pa.array(excerpts, pa.binary()), pa.array(seeds, pa.list_(pa.int64()))], ["doc_id", "excerpt", "seeds"])


def least_places(n: int, k: int, coverage: float) -> int:
    """So many places of its seeds an item of n tokens shares with a text that covers it enough."""
    return max(1, int(np.ceil(coverage * n / k - 1e-9)))


def _tiled(batches: Iterator[pa.RecordBatch], k: int, coverage: float) -> Iterator[pa.RecordBatch]:
    """Pairs to doc_id, item_id, tokens of the item, and how many are marked; pairs that can't reach the coverage are left out."""
    for batch in batches:
        rows, total, marked = [], [], []
        columns = (batch.column(c) for c in ("excerpt", "found", "tokens", "seeds", "times"))
        for i, (x, found, y, seeds, times) in enumerate(zip(*columns, strict=True)):
            item = np.frombuffer(y.as_buffer(), U)
            shared = np.isin(np.asarray(seeds.values), np.asarray(found.values))
            if np.asarray(times.values)[shared].sum() < least_places(len(item), k, coverage):
                continue
            rows.append(i)
            marked.append(int(tile(np.frombuffer(x.as_buffer(), U), item, k).sum()))
            total.append(len(item))
        at = pa.array(rows, pa.int64())
        yield pa.record_batch([batch.column("doc_id").take(at), batch.column("item_id").take(at), pa.array(total, pa.int64()), pa.array(marked, pa.int64())], ["doc_id", "item_id", "item_tokens", "matched_tokens"])


def rare_seeds(items: DataFrame, k: int, coverage: float) -> DataFrame:
    """item_id, variant, seed: of each item its rarest seeds, as many as a pair that is covered enough can't do without."""
    seeds = items.select("item_id", F.xxhash64("tokens").alias("variant"), (F.octet_length("tokens") / 8).alias("n"), F.explode(F.arrays_zip("seeds", "times")).alias("s"))
    seeds = seeds.select("item_id", "variant", "n", F.col("s.seeds").alias("seed"), F.col("s.times").alias("times"))
    often = seeds.groupBy("seed").agg(F.count("*").alias("items"))
    own = Window.partitionBy("item_id", "variant")
    before = F.sum("times").over(own.orderBy("items", "seed").rowsBetween(Window.unboundedPreceding, -1))
    needed = F.greatest(F.ceil(F.lit(coverage) * F.col("n") / k - F.lit(1e-9)), F.lit(1))
    ranked = seeds.join(often, "seed").withColumn("before", F.coalesce(before, F.lit(0))).withColumn("total", F.sum("times").over(own))
    return ranked.filter(F.col("before") < F.col("total") - needed + 1).select("item_id", "variant", "seed")


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = SEED_TOKENS, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, item_tokens, matched_tokens, coverage of the pairs that reach ``coverage``."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL")
    items = cut(items.mapInArrow(partial(_items, k=k), "item_id long, tokens binary, seeds array<long>, times array<long>").filter("size(seeds) > 0").dropDuplicates(["item_id", "tokens"]))
    distinct = items.select(F.explode("seeds").alias("seed")).distinct()
    if distinct.count() <= SEEDS_SENT:
        sent = Seeds(np.sort(distinct.toArrow().to_pandas()["seed"].to_numpy(np.int64).view(U)))
    else:
        n, bits = id_bits(distinct, "seed", hashed=True)
        sent = Seeds(None, bits.value, n)
    sent = spark.sparkContext.broadcast(sent)
    found = id_text(docs).filter("doc_id IS NOT NULL").mapInArrow(partial(_excerpts, k=k, sent=sent), "doc_id long, excerpt binary, seeds array<long>")
    found = cut(found.withColumn("row", F.xxhash64("excerpt")))
    pairs = found.select("doc_id", "row", F.explode("seeds").alias("seed")).join(rare_seeds(items, k, coverage), "seed").select("doc_id", "row", "item_id", "variant").distinct()
    both = pairs.join(found.select("doc_id", "row", "excerpt", F.col("seeds").alias("found")), ["doc_id", "row"])
    both = both.join(items.withColumn("variant", F.xxhash64("tokens")), ["item_id", "variant"])
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    tiled = both.repartition(parts, "doc_id", "item_id").mapInArrow(partial(_tiled, k=k, coverage=coverage), "doc_id long, item_id long, item_tokens long, matched_tokens long")
    tiled = tiled.withColumn("coverage", F.col("matched_tokens") / F.col("item_tokens")).filter(F.col("coverage") >= coverage)
    return tiled.groupBy("doc_id", "item_id").agg(F.max("item_tokens").alias("item_tokens"), F.max("matched_tokens").alias("matched_tokens"), F.max("coverage").alias("coverage"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, k: int = SEED_TOKENS, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    gone = leaks(docs, benchmark, k, coverage).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
