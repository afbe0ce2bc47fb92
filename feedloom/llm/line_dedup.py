"""Line dedup: lines that many documents hold go from all of them.

Every text is cut at line feeds and every line's key is hashed to 128 bits. A task counts its own documents of a key before the
shuffle, so a line of a third of all rows is one row a task. Keys over the threshold are written as a table; a bounded bit set of them
keeps other lines out of the second pass, and an exact join decides. Texts that lose lines are joined with their places; all other
texts never move.

Defined cases: a row is a document, so rows that repeat a doc_id, or have none, count and are cut each for itself; rows of one text lose
the same lines. A line counts once a document however often it repeats there. A null text stays null and counts as one empty line,
as does an empty one. Keys shorter than ``least_points`` code points never go. Texts of any length are read whole. Further columns of
any name pass through. An empty table stays empty.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import Scratch, free, id_bits

BLANKS = b" \t\n\x0b\x0c\r"
DOCUMENTS, POINTS = 10, 1


def keys_of(text: str | None, least_points: int) -> list[bytes | None]:
    """A 128-bit hash for every line of a text; None for lines whose key is too short to count."""
    keys = [line.strip(BLANKS).lower() for line in (text or "").encode().split(b"\n")]
    long = (lambda k: len(k) >= least_points) if least_points <= 1 else (lambda k: len(k.decode()) >= least_points)
    return [xxhash.xxh3_128_digest(k) if long(k) else None for k in keys]


def _longs(digests: list[bytes]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())]


def frequent(docs: DataFrame, least_documents: int = DOCUMENTS, least_points: int = POINTS) -> DataFrame:
    """k1, k2, n_documents: keys found in at least so many documents."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[bytes] = Counter()
            for text in batch.column(0).to_pylist():
                found.update(k for k in set(keys_of(text, least_points)) if k)
            yield pa.record_batch([*_longs([*found]), pa.array([*found.values()], pa.int64())], ["k1", "k2", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(counts, "k1 long, k2 long, n long")
    return rows.groupBy("k1", "k2").agg(F.sum("n").alias("n_documents")).filter(F.col("n_documents") >= least_documents)


def without_frequent_lines(docs: DataFrame, least_documents: int = DOCUMENTS, least_points: int = POINTS) -> DataFrame:
    """``docs`` with its texts cut, and n_lines (before), n_dropped; underscores follow these names where docs has them."""
    scratch = Scratch(docs.sparkSession)
    common = scratch.table(frequent(docs, least_documents, least_points))
    size, bits = id_bits(common, "k1", hashed=True)
    one, two, gone, n_lines, n_dropped = (free(docs, c) for c in ("text_1", "text_2", "dropped_places", "n_lines", "n_dropped"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = {one: F.xxhash64(text), two: F.xxhash64(F.lit(1), text)}

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bits.value.view(np.uint64)
        for batch in batches:
            keys = [keys_of(t, least_points) for t in batch.column(2).to_pylist()]
            rows = [(i, p, k) for i, ks in enumerate(keys) for p, k in enumerate(ks) if k]
            if not rows:
                continue
            k1, k2 = _longs([k for *_, k in rows])
            h = np.mod(k1.to_numpy(), size)
            may = pa.array((words[h // 64] >> (h % 64).astype(np.uint64)) & np.uint64(1) == 1)
            at = pa.array(np.fromiter((i for i, *_ in rows), np.int64, len(rows)))
            place = pa.array(np.fromiter((p for _, p, _ in rows), np.int32, len(rows)))
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), place, k1, k2], ["t1", "t2", "place", "k1", "k2"]).filter(may)

    lines = docs.select(named[one], named[two], F.col("text").cast("string")).mapInArrow(places, "t1 long, t2 long, place int, k1 long, k2 long")
    marks = lines.join(common.select("k1", "k2"), ["k1", "k2"], "left_semi").groupBy("t1", "t2").agg(F.sort_array(F.collect_set("place")).alias("places"))
    marks = scratch.table(marks)
    n_texts, texts = id_bits(marks, "t1", hashed=True)

    def marked(wanted: bool):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = texts.value.view(np.uint64)
            for batch in batches:
                h = np.mod(batch.column(one).to_numpy(), n_texts)
                found = (words[h // 64] >> (h % 64).astype(np.uint64)) & np.uint64(1) == 1
                yield batch.filter(pa.array(found == wanted))

        rows = docs.withColumns(named)
        return rows.mapInArrow(keep, rows.schema)

    lines = F.split(text, "\n", -1)
    counted = F.size(lines).cast("long").alias(n_lines)
    clean = marked(False).select(*(F.col(f"`{c}`") for c in docs.columns), counted, F.lit(0).cast("long").alias(n_dropped))
    dirty = marked(True).join(marks.select(F.col("t1").alias(one), F.col("t2").alias(two), F.col("places").alias(gone)), [one, two], "left")
    # What lies between two dropped places is one slice, so a text costs what it holds, however many lines go.
    before, after = F.concat(F.array(F.lit(-1)), F.col(gone)), F.concat(F.col(gone), F.array(F.size(lines)))
    cut = F.array_join(F.flatten(F.zip_with(before, after, lambda a, b: F.slice(lines, a + 2, b - a - 1))), "\n")
    kept = F.when(F.col(gone).isNull(), F.col("text").cast("string")).otherwise(cut)
    columns = [kept.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return clean.unionByName(dirty.select(*columns, counted, F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(n_dropped)))


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row of ``docs``."""
    out = without_frequent_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
