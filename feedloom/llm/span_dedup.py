"""Substring dedup on sliding sentence spans.

A sentence ends at a line feed or at a word whose last character is ``.``, ``!`` or ``?``. Spans are runs of consecutive
sentences: from every sentence on the shortest run that has ``min_words`` words, and up to every sentence the shortest
such run that ends there. So every sentence of a passage of that many words that repeats lies in a span that repeats.
A run is usually several sentences, and a single one only if it is that long. Longer runs need no hash of their own: each
is made of these. Spans are compared by the hash of their lower-cased words. All documents' spans meet by hash; every
occurrence but the first (smallest doc_id, then the earliest) is removed, that is, each sentence that any such span covers.

Defined cases: null and empty texts, and texts with fewer than ``min_words`` words, are left as they are. Rows that
repeat a doc_id don't count against each other, and each is cut by the spans of its own text; rows with a null doc_id are
compared with themselves only. Text outside removed sentences stays as it is to the byte. An empty table gives no rows; a very long text
has a span or two a sentence like any other. Of equal spans of one document the earliest counts as first. Columns of any
name pass through ``without_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import cut, free, id_text
from feedloom.llm.textvec import Words, sequences, signed, words

MIN_WORDS = 20


def sentences(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each sentence, the word after its last, and where each row's sentences begin."""
    if not len(w.hash):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(w.bounds), np.int64)
    feeds = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(w.data == 10, out=feeds[1:])
    stops = np.isin(w.data[w.end - 1], np.frombuffer(b".!?", np.uint8))
    stops[:-1] |= feeds[w.start[1:]] > feeds[w.end[:-1]]
    stops[np.maximum(w.bounds[1:] - 1, 0)[w.bounds[1:] > w.bounds[:-1]]] = True
    end = np.flatnonzero(stops) + 1
    begin = np.concatenate([[0], end[:-1]])
    return begin, end, np.searchsorted(begin, w.bounds)


def spans(w: Words, min_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, first sentence, sentence after the last, hash) of each row's spans, in the order of first sentences."""
    begin, end, at = sentences(w)
    many, every = len(begin), np.arange(len(begin))
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    last = np.searchsorted(end, begin + min_words)  # the sentence in which a span from here is long enough
    first = np.searchsorted(begin, end - min_words, "right") - 1  # and from which one up to here is
    on, up = last < at[1:][row], first >= at[:-1][row]
    both = np.unique(np.concatenate([every[on] * many + last[on], first[up] * many + every[up]]))
    first, last = np.divmod(both, max(many, 1))
    hashed = sequences(w, begin[first], end[last])
    bounds = np.searchsorted(first, at)
    for i in range(len(w.bounds) - 1):
        mine = slice(bounds[i], bounds[i + 1])
        yield w.first + i, first[mine] - at[i], last[mine] - at[i] + 1, hashed[mine]


def _emit(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text_key").to_numpy()
        ids, known = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        for w in words(batch.column("text")):
            keys, docs, of, starts, stops = [], [], [], [], []
            for row, first, stop, hashed in spans(w, min_words):
                if len(first) and known[row]:
                    _, once = np.unique(hashed, return_index=True)
                    keys.append(hashed[once])
                    docs.append(np.full(len(once), ids[row]))
                    of.append(np.full(len(once), texts[row]))
                    starts.append(first[once].astype(np.int32))
                    stops.append(stop[once].astype(np.int32))
            if keys:
                yield pa.record_batch([pa.array(signed(np.concatenate(keys))), *(pa.array(np.concatenate(x)) for x in (docs, of, starts, stops))], ["key", "doc_id", "text_key", "start", "stop"])


def _clean(text: pa.Array, marks: pa.Array, min_words: int) -> pa.Array:
    """marks: start, stop of the spans that stand first in another document, one after the other."""
    out, total, gone = [], [], []
    for w in words(text):
        begin, end, at = sentences(w)
        rows = spans(w, min_words)
        for i, (row, first, stop, hashed) in enumerate(rows):
            n = at[i + 1] - at[i]
            drop = np.zeros(n + 1, np.int64)
            if len(hashed):
                _, once = np.unique(hashed, return_index=True)
                again = np.ones(len(hashed), bool)
                again[once] = False
                np.add.at(drop, first[again], 1)
                np.add.at(drop, stop[again], -1)
            if marks[row].is_valid:
                m = np.asarray(marks[row].values, np.int64).reshape(-1, 2)
                m = m[m[:, 1] <= n]
                np.add.at(drop, m[:, 0], 1)
                np.add.at(drop, m[:, 1], -1)
            covered = np.cumsum(drop)[:n] > 0
            total.append(n)
            gone.append(int(covered.sum()))
            if not gone[-1]:
                out.append(text[row].as_py())
                continue
            low, high = w.offsets[i], w.offsets[i + 1]
            keep = np.ones(high - low, bool)
            for s in np.flatnonzero(covered) + at[i]:
                a = w.end[begin[s] - 1] if s > at[i] else low  # with the white space before it
                keep[a - low : w.end[end[s] - 1] - low] = False
            out.append(w.data[low:high][keep].tobytes().decode())
    return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], ["text", "n_sentences", "n_removed"])


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_key, marks: the spans of each text of a document of which a document with a smaller id has a copy."""
    rows = id_text(docs).withColumn("text_key", F.xxhash64("text"))
    found = rows.mapInArrow(partial(_emit, min_words=min_words), "key long, doc_id long, text_key long, start int, stop int")
    shared = found.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("key", "first")
    shared = cut(shared)  # so that both sides of the join are dealt anew, and a key of very many documents can be split
    later = found.join(shared, "key").filter("doc_id > first")
    return later.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_set(F.array("start", "stop"))).alias("marks"))


def cleaned(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, Column]:
    """``docs`` joined with their marks (all columns prefixed as they were), and the struct of the cleaned text."""
    key, of, spans_of = free(docs, "_span_doc"), free(docs, "_span_text"), free(docs, "_span_marks")
    marks = repeated_spans(docs, min_words).select(F.col("doc_id").alias(key), F.col("text_key").alias(of), F.col("marks").alias(spans_of))
    same = (F.col("doc_id").cast("long") == F.col(key)) & (F.xxhash64(F.col("text").cast("string")) == F.col(of))
    both = docs.join(marks, same, "left")

    @F.arrow_udf("text string, n_sentences long, n_removed long")
    def clean(text: pa.Array, marks: pa.Array) -> pa.Array:
        return _clean(text, marks, min_words)

    return both, clean(F.col("text").cast("string"), F.col(spans_of))


def span_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text (without the removed sentences), n_sentences, n_removed, changed for every row."""
    both, struct = cleaned(docs.select("doc_id", "text"), min_words)
    out = both.select("doc_id", struct.alias("c")).select("doc_id", "c.*")
    return out.withColumn("changed", F.col("n_removed") > 0)


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows and columns of ``docs`` with the cleaned text, and n_chars (if it is there) to fit."""
    both, struct = cleaned(docs, min_words)
    done = free(docs, "_span_clean")
    out = both.withColumn(done, struct).withColumn("text", F.col(f"{done}.text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(f"{done}.n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
