"""Toxicity by class-conditional Kneser-Ney models of words.

Toxic and ordinary labelled text are a model each. A word's count is how often it stands in the class's texts, repeats included. What
the classes' counts have in common goes to one shared model, the modified Kneser-Ney probabilities of the counts of both
classes together: of its count of a word a class keeps what exceeds the modified Kneser-Ney discount and a part of both
classes' count that grows with the class's share of all counts, and gives the rest to the shared model. So a word that differs between
the classes by no more than what their documents happen to be about is smoothed by what both know, as a rare one is.

    kept(word | class) = max(c - d(c) - share(class) ** COMMON * (c of both), 0)
    p(word | class)    = kept / total(class) + freed(class) * shared(word),  freed = 1 - sum of kept / total

A text's mark is the difference of the two log-likelihoods over all its words, each as often as it stands there, divided by their
number; all of it, of words that speak for either class. It's given less log(freed(toxic) / freed(ordinary)), which is the difference of every word that no class
keeps, so such words, unknown ones included, add nothing and needn't be looked up. A logistic curve from the mark (its inverse
hyperbolic sine, as marks have long tails) to a probability is fitted on labelled rows that the model marking them hasn't seen.

Counts are summed sharded by word, all of them, from the first occurrence on. Documents send only words that a bit set of the
model's words lets pass; these are joined with the words' values, and the sums by document come back.

Rows whose id fold (crc32 modulo 3) is 0 or 2 train the model, fold 1 teaches nothing. For the curve, a model of fold 0
alone marks the rows of fold 2; the curve's two numbers come from at most ``CURVE_ROWS`` rows.

Defined cases: a null or empty text has no word, so the mark 0 and the score of that. Rows that repeat a doc_id are
scored each; conflicting labels of an id both count. Without labels of both classes every score is 0.5. An empty table gives no
rows; a very long text is read whole; ties of counts need no order. Only doc_id and text are read, so other columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import Scratch, cut, id_bits, id_fold, id_text, likely
from feedloom.llm.textvec import NOT_ALNUM, Words, mix, signed, words
from feedloom.llm.wordkn import discounts

U = np.uint64
CURVE_ROWS = 20_000
CUT = 0.7
#: The power of a class's share of all counts that is the part of both classes' count of a word that the class doesn't keep.
COMMON = 0.4
#: Discount and clear part of ``values``.
DISCOUNT = 2.0
CLEAR = 0.5
#: Marks count by their size up to here, beyond by their logarithm.
FLOOR = 1e-3
#: So many words of a task are held before they are given out.
HELD = 2_000_000
_ROW = U(0x9E3779B97F4A7C15)


def tally(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row (of the chunk) and hash of each distinct word of each row, in the order of rows, and how often it stands there."""
    row = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
    _, at, times = np.unique(mix(w.hash + row.astype(U) * _ROW), return_index=True, return_counts=True)
    order = np.argsort(at)
    at = at[order]
    return row[at], w.hash[at], times[order]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, kind to kind, word, n: how often a word stands in texts of the kind; summed over the task, or over as much of it as HELD allows."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        word, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return word, np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(word)).astype(np.int64)

    def out() -> Iterator[pa.RecordBatch]:
        for k, parts in held.items():
            word, n = merged(parts)
            yield pa.record_batch([pa.array(np.full(len(word), k, np.int32)), pa.array(signed(word)), pa.array(n)], ["kind", "word", "n"])
        held.clear()

    for batch in batches:
        kind = batch.column("kind").to_numpy()
        for w in words(batch.column("text"), separators=NOT_ALNUM):
            of = np.repeat(kind[w.first : w.last], np.diff(w.bounds))
            for k in np.unique(of).tolist():
                found = np.unique(w.hash[of == k], return_counts=True)
                held.setdefault(k, []).append(found)
                size += len(found[0])
            if size > HELD:
                held = {k: [merged(parts)] for k, parts in held.items()}
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > HELD // 2:
                    yield from out()
                    size = 0
    yield from out()


def _both(counts: DataFrame, kinds: tuple[int, ...]) -> tuple[DataFrame, int, int, list[float], Column | None]:
    """word, n0, n1 of these kinds; the classes' totals, the discounts of both together, and a word's shared probability, if both classes have words."""
    sums = [F.sum(F.when(F.col("kind").isin([k for k in kinds if k % 2 == c]), F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)]
    found = counts.filter(F.col("kind").isin(list(kinds))).groupBy("word").agg(*sums)
    both = F.col("n0") + F.col("n1")
    n0, n1, known, *times = found.agg(*(F.coalesce(F.sum(f"n{c}"), F.lit(0)) for c in (0, 1)), F.count("*"), *(F.count_if(both == i) for i in (1, 2, 3, 4))).first()
    if not n0 or not n1:
        return found, n0, n1, [], None
    d, total = discounts(*times), n0 + n1
    rest = (d[0] * times[0] + d[1] * times[1] + d[2] * (known - times[0] - times[1])) / total / (known + 1)
    return found, n0, n1, d, (both - _discount(both, d)) / F.lit(float(total)) + F.lit(rest)


def _discount(c: Column, d: list[float]) -> Column:
    return F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def differences(counts: DataFrame, kinds: tuple[int, ...], name: str) -> DataFrame:
    """word and, as ``name``, what it adds to a mark, for words that a class keeps something of. Odd kinds are toxic."""
    found, n0, n1, d, shared = _both(counts, kinds)
    if shared is None:
        return found.select("word", F.lit(0.0).alias(name)).limit(0)
    both, total = F.col("n0") + F.col("n1"), n0 + n1
    kept = [F.greatest(F.col(f"n{c}") - _discount(F.col(f"n{c}"), d) - both * (n / total) ** COMMON, F.lit(0.0)) for c, n in enumerate((n0, n1))]
    freed = [1 - x / n for x, n in zip(found.agg(*map(F.sum, kept)).first(), (n0, n1), strict=True)]
    p = [x / F.lit(float(n)) + F.lit(f) * shared for x, n, f in zip(kept, (n0, n1), freed, strict=True)]
    return found.filter((kept[0] > 0) | (kept[1] > 0)).select("word", (F.log(p[1] / p[0]) - F.lit(float(np.log(freed[1] / freed[0])))).alias(name))


def values(counts: DataFrame, kinds: tuple[int, ...], name: str) -> DataFrame:
    """The former, clipped form, which ``toxicity`` doesn't use any more: of a word's difference, with one discount and the larger class scaled to the
    smaller one's total, what exceeds ``CLEAR`` of the greatest possible one."""
    found, n0, n1, _, shared = _both(counts, kinds)
    if shared is None:
        return found.select("word", F.lit(0.0).alias(name)).limit(0)
    least, total = min(n0, n1), n0 + n1
    scaled = [F.col("n0") * (least / n0), F.col("n1") * (least / n1)]
    freed = [x / least for x in found.agg(*(F.sum(F.least(x, F.lit(DISCOUNT))) for x in scaled)).first()]
    p = [F.greatest(x - DISCOUNT, F.lit(0.0)) / F.lit(float(least)) + F.lit(f) * shared for x, f in zip(scaled, freed, strict=True)]
    least_clear = CLEAR * float(np.log(total / (least * freed[0])))
    return found.select("word", (F.log(p[1] / p[0]) - F.lit(least_clear)).alias(name)).filter(F.col(name) > 0)


def _hits(batches: Iterator[pa.RecordBatch], n_bits: int, bits, repeats: bool) -> Iterator[pa.RecordBatch]:
    """doc_id, row, number of words, those that the bit set lets pass, and how often each stands there; without repeats each counts once."""
    wanted = bits.value.view(U)
    for batch in batches:
        many, hits, counts = np.zeros(batch.num_rows, np.int64), [], []
        for w in words(batch.column("text"), separators=NOT_ALNUM):
            row, word, times = tally(w)
            many[w.first : w.last] = np.diff(w.bounds) if repeats else np.bincount(row, minlength=w.last - w.first)
            h = bit_place(word) % U(n_bits)
            pass_ = (wanted[(h // U(64)).astype(np.int64)] >> (h % U(64))) & U(1) == 1
            row, word, times = row[pass_], word[pass_], times[pass_] if repeats else np.ones(np.count_nonzero(pass_), np.int64)
            at = np.searchsorted(row, np.arange(w.last - w.first + 1))
            hits += [signed(word[at[i] : at[i + 1]]) for i in range(w.last - w.first)]
            counts += [times[at[i] : at[i + 1]] for i in range(w.last - w.first)]
        columns = [batch.column("doc_id"), batch.column("row"), pa.array(many), pa.array(hits, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))]
        yield pa.record_batch(columns, ["doc_id", "row", "n", "words", "times"])


def bit_place(word: np.ndarray) -> np.ndarray:
    return mix(word ^ _ROW) >> U(1)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([pa.array(signed(bit_place(batch.column("word").to_numpy().view(U))))], ["place"])


def curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by Newton's method with a small penalty on the scaled slope."""
    if len(x) < 2 or y.min() == y.max():
        return 0.0, 0.0
    scale = x.std() or 1.0
    a = np.stack([(x - x.mean()) / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(hessian, a.T @ (y - p) - np.array([1e-2, 1e-6]) * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    slope = w[0] / scale
    return float(slope), float(w[1] - slope * x.mean())


def marked(docs: DataFrame, model: DataFrame, names: tuple[str, ...], repeats: bool = False) -> DataFrame:
    """doc_id and a mark for each of the model's columns ``names`` (word, value or null), for every row: the mean over all words of the
    text with ``repeats``, as ``toxicity`` takes it, else over its distinct words."""
    places = model.select("word").mapInArrow(_places, "place long")
    n_bits, bits = id_bits(places, "place", hashed=True)
    rows = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    hits = cut(rows.mapInArrow(lambda batches: _hits(batches, n_bits, bits, repeats), "doc_id long, row long, n long, words array<long>, times array<long>"))
    once = hits.filter(F.size("words") > 0).select("row", "words", "times").dropDuplicates(["row"])
    found = once.select("row", F.explode(F.arrays_zip("words", "times")).alias("at")).select("row", F.col("at.words").alias("word"), F.col("at.times").alias("times"))
    sums = found.join(model, "word").groupBy("row").agg(*(F.sum(F.col(c) * F.col("times")).alias(c) for c in names))
    mark = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / F.greatest(F.col("n"), F.lit(1))
    return hits.select("doc_id", "row", "n").join(sums, "row", "left").select("doc_id", *(mark(c).alias(c) for c in names))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, mark for every row."""
    docs, scratch = id_text(docs), Scratch(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1) AND doc_id IS NOT NULL").distinct()
    known = known.withColumn("fold", id_fold("doc_id", 3).cast("int")).filter("fold <> 1")
    taught = likely(docs, known).join(known.hint("merge"), "doc_id").select("text", (F.col("fold") + F.col("toxic")).alias("kind"))
    counts = scratch.table(taught.mapInArrow(_count, "kind int, word long, n long").groupBy("kind", "word").agg(F.sum("n").alias("n")))
    model = scratch.table(differences(counts, (0, 1, 2, 3), "mark").join(differences(counts, (0, 1), "trial"), "word", "full_outer"))
    scratch.drop(counts)
    marks = cut(marked(docs, model, ("mark", "trial"), repeats=True))
    scratch.drop(model)
    later = known.filter("fold = 2").orderBy(F.xxhash64("doc_id"), "doc_id").limit(CURVE_ROWS)
    fitted = marks.join(later, "doc_id").select("trial", "toxic").toArrow().to_pandas()
    slope, intercept = curve(np.arcsinh(fitted["trial"].to_numpy(float) / FLOOR), fitted["toxic"].to_numpy(float)) if len(fitted) else (0.0, 0.0)
    out = marks.withColumn("score", _logistic(F.lit(slope) * F.asinh(F.col("mark") / FLOOR) + F.lit(intercept))).withColumn("held_out", id_fold("doc_id", 3) == 1)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "mark")


def _logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
