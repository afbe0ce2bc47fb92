"""LM scoring by a log-bilinear model, trained in numpy with noise-contrastive estimation.

The event space is that of the unigram base line: every word type of the training text, the end of a text, and one event
for all other words. The ``SHORT`` most frequent types, the end among them, are predicted by the log-bilinear model:
the vectors of the two tokens before are mapped by a matrix each and summed; a type's logit is the product of
that sum with its own vector, plus its bias. One more type of the short list stands for all other words; their share
is dealt out by discounted counts, with what the discount frees for unknown words. Probabilities are exact softmax
values, computed for each distinct context of a chunk by one batched matrix product.

Training: every task runs noise-contrastive estimation over all training text of its partition, from common parameters,
with noise drawn from the unigrams (one noise sample a batch, shared, so noise logits are matrix products). The
tasks' parameters are then averaged, weighted by tokens. Counts cover all training text: they are summed sharded by word
hash. To score, each partition of the table is dealt into batches by hash; each batch asks once for each word that it
has, counts are found where the word's shard is, and travel to the batch in packed form, so no task needs the
whole vocabulary.

Defined cases: a null or empty text is the single end token. Rows that repeat a doc_id count and are scored each.
Rows with a null doc_id are in fold 0, so they train. Without training text every token has the probability 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.llm.common import Scratch, id_fold, id_text
from feedloom.llm.textvec import Words, signed, words

U = np.uint64
SHORT, WIDTH = 1024, 16
BATCH, NOISE, RATE = 2048, 128, 0.1
#: A batch of documents to be scored has about so many bytes of text.
BATCH_BYTES = 32 << 20
#: The hash that stands for the end of a text.
END = U(0x7E57ED0F7E57ED0F)
FOLD, OUT = 7, 2


def chain(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of a chunk with an end after each row; where each row begins, and how many tokens it has."""
    n = len(w.bounds) - 1
    size = np.diff(w.bounds) + 1
    begin = w.bounds[:-1] + np.arange(n)
    out = np.full(len(w.hash) + n, END, U)
    out[np.arange(len(w.hash)) + np.repeat(np.arange(n), size - 1)] = w.hash
    return out, begin, size


def _requests(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
    """word, batch, times in training text: once for each word of a batch (or of a part of it)."""
    skip = None if known is None else known.value
    held: dict[int, list] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for b, parts in held.items():
            h = np.concatenate([p[0] for p in parts])
            t = np.concatenate([p[1] for p in parts])
            u, inverse = np.unique(h, return_inverse=True)
            n = np.bincount(inverse, t, len(u)).astype(np.int64)
            if skip is not None:
                rest = ~np.isin(u, skip)
                u, n = u[rest], n[rest]
            yield pa.record_batch([pa.array(signed(u)), pa.array(np.full(len(u), b, np.int64)), pa.array(n)], ["word", "batch", "n"])
        held.clear()

    for rows in batches:
        own, trains = rows.column("batch").to_numpy(), rows.column("trains").to_numpy(zero_copy_only=False)
        for w in words(rows.column("text")):
            tokens, _, count = chain(w)
            b = np.repeat(own[w.first : w.last], count)
            t = np.repeat(trains[w.first : w.last], count)
            for x in np.unique(b).tolist():
                mine = b == x
                u, inverse = np.unique(tokens[mine], return_inverse=True)
                held.setdefault(x, []).append((u, np.bincount(inverse, t[mine], len(u))))
                size += len(u)
            if size > 4_000_000:
                yield from flush()
                size = 0
    yield from flush()


def _sums(batches: Iterator[pa.RecordBatch], short: int) -> Iterator[pa.RecordBatch]:
    """From (word, c), a row a word: the task's most frequent words (kind 0), and how many words occur c times (kind 1)."""
    top_w, top_c, times = np.zeros(0, np.int64), np.zeros(0, np.int64), {}
    for batch in batches:
        w, c = batch.column("word").to_numpy(), batch.column("c").to_numpy()
        for x, n in zip(*np.unique(c[c > 0], return_counts=True), strict=True):
            times[int(x)] = times.get(int(x), 0) + int(n)
        top_w, top_c = np.concatenate([top_w, w]), np.concatenate([top_c, c])
        if len(top_w) > short:
            best = np.argpartition(-top_c, short - 1)[:short]
            top_w, top_c = top_w[best], top_c[best]
    kinds = np.concatenate([np.zeros(len(top_w), np.int32), np.ones(len(times), np.int32)])
    yield pa.record_batch([pa.array(kinds), pa.array(np.concatenate([top_w, np.array(list(times), np.int64)])), pa.array(np.concatenate([top_c, np.array(list(times.values()), np.int64)]))], ["kind", "word", "c"])


class Model:
    """Vectors of the contexts' and the predicted types; the last type is any other word."""

    def __init__(self, counts: np.ndarray, seed: int = 7):
        random = np.random.default_rng(seed)
        n = len(counts)
        self.unigram = np.log((counts + 0.5) / (counts.sum() + 0.5 * n)).astype(np.float32)
        self.context = random.normal(0, 0.1, (n, WIDTH)).astype(np.float32)
        self.output = np.zeros((n, WIDTH), np.float32)
        self.maps = (np.eye(WIDTH) * 0.5 + random.normal(0, 0.05, (2, WIDTH, WIDTH))).astype(np.float32)
        self.bias = self.unigram.copy()
        self.squares = [np.full(p.shape, 1e-3, np.float32) for p in self.parts]

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.context, self.output, self.maps, self.bias]

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for p in self.parts:
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def sums(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.context[one] @ self.maps[0] + self.context[two] @ self.maps[1]

    def step(self, one: np.ndarray, two: np.ndarray, word: np.ndarray, noise: np.ndarray, rate: float) -> float:
        """One batch of noise-contrastive estimation; returns its loss a token."""
        k = len(noise)
        q = self.sums(one, two)
        log_k = math.log(k)
        true = np.einsum("ij,ij->i", q, self.output[word]) + self.bias[word] - self.unigram[word] - log_k
        false = q @ self.output[noise].T + (self.bias[noise] - self.unigram[noise] - log_k)
        p_true, p_false = (1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in (true, false))
        loss = -(np.log(p_true + 1e-9).mean() + np.log(1 - p_false + 1e-9).sum(1).mean())
        g_true, g_false = 1 - p_true, -p_false
        dq = g_true[:, None] * self.output[word] + g_false @ self.output[noise]
        rows = len(self.bias)
        output = _scatter(np.concatenate([word, noise]), np.concatenate([g_true[:, None] * q, g_false.T @ q]), rows)
        bias = np.bincount(word, g_true, rows) + np.bincount(noise, g_false.sum(0), rows)
        both = np.concatenate([dq @ self.maps[0].T, dq @ self.maps[1].T])
        context = _scatter(np.concatenate([one, two]), both, rows)
        maps = np.stack([self.context[one].T @ dq, self.context[two].T @ dq])
        for part, square, gradient in zip(self.parts, self.squares, (context, output, maps, bias), strict=True):
            square += gradient**2
            part += (rate * gradient / np.sqrt(square)).astype(np.float32)
        return float(loss)

    def log10(self, one: np.ndarray, two: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 of the normalised probability of each token; each distinct context is computed once."""
        n = len(self.bias)
        contexts, inverse = np.unique(one.astype(np.int64) * n + two, return_inverse=True)
        q = self.sums(contexts // n, contexts % n)
        norm = np.empty(len(contexts), np.float32)
        for i in range(0, len(contexts), 8192):
            z = q[i : i + 8192] @ self.output.T
            z += self.bias
            m = z.max(1)
            z -= m[:, None]
            np.exp(z, out=z)
            norm[i : i + 8192] = np.log(z.sum(1)) + m
        logit = np.einsum("ij,ij->i", q[inverse], self.output[word]) + self.bias[word]
        return (logit - norm[inverse]) / math.log(10)


def _scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by row: sorted, so that each row's are added in one go."""
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(rows):
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        out[ordered[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def short_ids(tokens: np.ndarray, sorted_hash: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Each token's number in the short list; len(ids) is any other word."""
    at = np.minimum(np.searchsorted(sorted_hash, tokens), len(sorted_hash) - 1)
    return np.where(sorted_hash[at] == tokens, ids[at], len(ids))


def contexts(ids: np.ndarray, begin: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens one and two before each; before a text stand ends."""
    one = np.concatenate([[end], ids[:-1]])
    one[begin] = end
    two = np.concatenate([[end], one[:-1]])
    two[begin] = end
    return one, two


def _train(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    sorted_hash, ids, counts, end = vocabulary.value
    model = Model(counts)
    random = np.random.default_rng(TaskContext.get().partitionId())
    cumulative = np.cumsum(np.exp(model.unigram, dtype=np.float64))
    seen = 0
    for batch in batches:
        batch = batch.filter(batch.column("trains"))
        for w in words(batch.column("text")):
            tokens, begin, _ = chain(w)
            word = short_ids(tokens, sorted_hash, ids)
            one, two = contexts(word, begin, end)
            order = random.permutation(len(word))
            for i in range(0, len(order), BATCH):
                b = order[i : i + BATCH]
                noise = np.minimum(np.searchsorted(cumulative, random.random(NOISE) * cumulative[-1]), len(counts) - 1)
                model.step(one[b], two[b], word[b], noise, RATE)
                seen += len(b)
    if seen:
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([float(seen)]), pa.array([(model.flat() * seen).astype(np.float64).tobytes()], pa.binary())], ["task", "weight", "sums"])


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.float64) for x in pdf["sums"])
    return pd.DataFrame({"task": [int(pdf["task"].iloc[0])], "weight": [pdf["weight"].sum()], "sums": [np.asarray(total).tobytes()]})


def average(parts: DataFrame) -> DataFrame:
    """At most 64 rows whose weights and sums make up those of all tasks; groups hold the square root of so many at most."""
    schema = "task long, weight double, sums binary"
    for groups in (4096, 64):
        parts = parts.groupBy((F.col("task") % groups).alias("g")).applyInPandas(_add, schema)
    return parts


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of word, all of a word's batches with its count: packed (word, count) by batch, counts over 0."""
    held: dict[int, list] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        keys = list(held)
        packs = [np.concatenate(held[k]).tobytes() for k in keys]
        held.clear()
        for i in range(0, len(keys), 64):
            yield pa.record_batch([pa.array(keys[i : i + 64], pa.int64()), pa.array(packs[i : i + 64], pa.binary())], ["batch", "pack"])

    for rows in batches:
        b = rows.column("batch").to_numpy()
        pairs = np.stack([rows.column("word").to_numpy(), rows.column("c").to_numpy()], 1)
        order = np.argsort(b, kind="stable")
        b, pairs = b[order], pairs[order]
        cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]])) if len(b) else []
        for i in range(len(cut) - 1):
            held.setdefault(int(b[cut[i]]), []).append(pairs[cut[i] : cut[i + 1]])
        size += len(b)
        if size > 2_000_000:
            yield from flush()
            size = 0
    yield from flush()


def _score(batches: Iterator[pa.RecordBatch], vocabulary, flat, totals: dict) -> Iterator[pa.RecordBatch]:
    """Rows in the order of batch, packs before texts."""
    sorted_hash, ids, counts, end = vocabulary.value
    model = Model(counts)
    model.load(flat.value)
    of_short = np.zeros(len(ids) + 1, np.int64)
    of_short[:-1] = counts[:-1]
    n, v, rare, types, freed = (totals[k] for k in ("n", "v", "rare", "types", "freed"))
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
    current, packs, table = None, [], None
    for rows in batches:
        b = rows.column("batch").to_numpy()
        text = rows.column("text")
        is_text = rows.column("kind").to_numpy() == 1
        at = 0
        while at < len(b):
            if b[at] != current:
                current, packs, table = b[at], [], None
            stop = at + int(np.argmax(np.append((b[at:] != b[at]) | (is_text[at:] != is_text[at]), True)))
            if not is_text[at]:
                packs += [np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 2) for x in rows.column("pack").slice(at, stop - at)]
                at = stop
                continue
            if table is None:
                pairs = np.concatenate(packs) if packs else np.zeros((0, 2), np.int64)
                order = np.argsort(pairs[:, 0].view(U) if len(pairs) else pairs[:, 0], kind="stable")
                table, packs = (np.ascontiguousarray(pairs[order, 0]).view(U), np.ascontiguousarray(pairs[order, 1])), []
            for w in words(text.slice(at, stop - at)):
                tokens, begin, size = chain(w)
                word = short_ids(tokens, sorted_hash, ids)
                c = of_short[word]
                other = np.flatnonzero(word == len(ids))
                if len(table[0]) and len(other):
                    spot = np.minimum(np.searchsorted(table[0], tokens[other]), len(table[0]) - 1)
                    c[other] = np.where(table[0][spot] == tokens[other], table[1][spot], 0)
                base = np.log10((c + 1) / (n + v + 1))
                p = model.log10(*contexts(word, begin, end), word).astype(np.float64)
                if rare:
                    share = np.where(c[other] > 0, c[other] - freed, freed * types) / rare
                    p[other] += np.log10(share)
                first = at + w.first
                yield pa.record_batch(
                    [rows.column("doc_id").slice(first, len(begin)), pa.array(size), *(pa.array(np.add.reduceat(x, begin)) for x in ((c > 0).astype(np.int64), base, p))],
                    names,
                )
            at = stop


def lbl_scores(docs: DataFrame, fold: int = FOLD, out: int = OUT, short: int = SHORT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = id_text(docs).withColumn("trains", id_fold("doc_id", fold) != out)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    many = max(parts, (size or 0) // BATCH_BYTES + 1)
    split = docs.rdd.getNumPartitions()
    within = -(-many // max(split, 1))
    docs = docs.withColumn("batch", F.spark_partition_id().cast("long") * within + F.pmod(F.xxhash64("doc_id", "text"), F.lit(within)))

    request = "word long, batch long, n long"
    counts = docs.filter("trains").mapInArrow(partial(_requests, known=None), request).groupBy("word").agg(F.sum("n").alias("c"))
    ends = docs.filter("trains").count()  # every text has one end
    sums = scratch.table(counts.mapInArrow(partial(_sums, short=short), "kind int, word long, c long"))
    times = sums.filter("kind = 1").groupBy("word").agg(F.sum("c").alias("types")).toArrow().to_pandas()  # as many rows as there are different counts
    n, v = int((times["word"] * times["types"]).sum()), int(times["types"].sum())
    if not n:
        return docs.select("doc_id", (~F.col("trains")).alias("held_out"), (F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")) + 1).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    top = sums.filter("kind = 0 AND c > 0").orderBy(F.desc("c"), "word").limit(short).toArrow().to_pandas()
    hashes, c = top["word"].to_numpy(np.int64).view(U), top["c"].to_numpy(np.int64)
    if END not in hashes:
        hashes, c = np.append(hashes[: short - 1], END), np.append(c[: short - 1], ends)
    rare, types = n - int(c.sum()), v - int((c > 0).sum())
    once, twice = (int(times.loc[times["word"] == x, "types"].sum()) for x in (1, 2))
    freed = min(max(once / (once + 2 * twice) if once else 0.5, 0.05), 0.95)
    totals = {"n": n, "v": v, "rare": rare, "types": types, "freed": freed}
    order = np.argsort(hashes)
    end = int(np.flatnonzero(hashes == END)[0])
    vocabulary = spark.sparkContext.broadcast((hashes[order], order, np.append(c, max(rare, 1)), end))

    trained = docs.filter("trains").mapInArrow(partial(_train, vocabulary=vocabulary), "task long, weight double, sums binary")
    rows = average(scratch.table(trained)).toArrow().to_pandas()
    mean = sum(np.frombuffer(x, np.float64) for x in rows["sums"]) / rows["weight"].sum()
    flat = spark.sparkContext.broadcast(mean.astype(np.float32))

    asked = docs.mapInArrow(partial(_requests, known=spark.sparkContext.broadcast(hashes)), request)
    found = asked.withColumn("c", F.sum("n").over(Window.partitionBy("word"))).filter("c > 0").select("word", "batch", "c")
    packs = found.mapInArrow(_resolve, "batch long, pack binary")
    packs = packs.select("batch", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "pack")
    texts = docs.select("batch", F.lit(1).alias("kind"), "doc_id", "text", F.lit(None).cast("binary").alias("pack"))
    dealt = packs.unionByName(texts).repartition(parts, "batch").sortWithinPartitions("batch", "kind")
    scored = dealt.mapInArrow(partial(_score, vocabulary=vocabulary, flat=flat, totals=totals), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", (id_fold("doc_id", fold) == out).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
