"""Periodic run detection: stretches of words that repeat with a period, found in linear time by Lyndon arrays.

The method is that of Ellert and Fischer. The words of a text are an ordered alphabet (their ranks in bytewise order). For the
order and for its reverse, one pass from left to right gives for every place the next smaller suffix, that is the longest Lyndon
word from there. A comparison of two suffixes starts from what their neighbours on the stack have in common, and within
the part that was matched before it takes the length found for its mirror image there; so letters are compared at the frontier of what has been
matched only, which moves to the right alone. Each run has Lyndon roots in one of the two orders, and the length already matched
at its first root is where the run ends; only its start is looked for, over less than one period. No suffix structures, no hashes.

Stretches that can't hold a run of the wanted length are left out before: a run of exponent 3 has every three consecutive words again
within a third of it, so places whose three words don't come again that near in the text break it. That is exact, and what
remains of ordinary prose is little.

Every text is worked on by itself, in Arrow batches of a task; nothing is shuffled. Defined cases: a null or empty text has no words and
no runs. Texts of any length are read whole. Rows that repeat, or have a null doc_id, are each worked on for themselves. Of runs with
one exact ratio the first start counts, then the shorter period. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import id_text

LEAST, EXPONENT = 24, 3


def next_smaller(x: list[int]) -> tuple[list[int], list[int]]:
    """(nss, lce): for every suffix of x the place of the next smaller one, and how many letters both share. The end is smaller than all."""
    n = len(x)
    x = [*x, -1]  # smaller than all letters, in either order
    nss, nlce = [n] * n, [0] * n
    pss, plce = [-1] * n, [0] * n  # of the last smaller suffix before
    left = right = 0  # the match that reaches furthest: x[right:end] == x[left:...]
    end = 0
    for r in range(1, n + 1):
        at = r - 1
        e, scan = 0, True
        while at >= 0:
            if scan:
                go = True
                if r + e < end:  # within the frontier: the mirror image has been compared
                    mirror, d = r - (right - left), right - left
                    to = at - d if at >= right else at
                    known = nlce[to] if nss[to] == mirror else plce[mirror] if pss[mirror] == to else -1
                    if known >= 0:
                        if known < end - r:
                            e, go = known, False
                        else:
                            e = end - r
                if go:
                    while x[at + e] == x[r + e]:
                        e += 1
                    if r + e > end:
                        left, right, end = at, r, r + e
            if x[at + e] > x[r + e]:
                nss[at], nlce[at] = r, e
                f = plce[at]
                at = pss[at]
                # T[at] shares f letters with the suffix that just went: e against f decides, unless they are equal.
                if f < e:
                    e = f
                    break
                scan = f == e
            else:
                break
        if r < n:
            pss[r], plce[r] = at, e
    return nss, nlce


def runs(x: list[int], least: int = LEAST, exponent: int = EXPONENT) -> set[tuple[int, int, int]]:
    """(start, length, period) of the maximal stretches of x with at least so many letters and so many periods (2 or more)."""
    found = set()
    most = max(x, default=0)
    for letters in (x, [most - c for c in x]):
        nss, lce = next_smaller(letters)
        ends, match = np.asarray(nss), np.asarray(lce)
        period = ends - np.arange(len(x))
        for i in np.flatnonzero(match > (exponent - 2) * period).tolist():
            p, e = nss[i] - i, lce[i]
            if i >= p and nss[i - p] == i and lce[i - p] == e + p:
                continue  # not the run's first root
            start = i
            while start and x[start - 1] == x[start - 1 + p]:
                start -= 1
            length = nss[i] + e - start
            if length >= max(least, exponent * p):
                found.add((start, length, p))
    return found


def stretches(x: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int]]:
    """Disjoint (start, stop) outside of which no run of so many letters and periods can be. Exact: a stretch may hold none."""
    todo, out, gram = [(0, len(x))], [], 3
    base = int(x.max()) + 1 if len(x) else 1
    if base >= 1 << 21 or least <= gram or exponent < 3:  # three letters must fit into 63 bits; fewer periods prove nothing
        return [(0, len(x))] if len(x) >= least else []
    while todo:
        a, b = todo.pop()
        n = b - a - gram + 1
        if b - a < least:
            continue
        y = x[a:b].astype(np.int64)
        code = (y[:n] * base + y[1 : n + 1]) * base + y[2:]
        order = np.argsort(code, kind="stable")
        near = np.where(code[order[1:]] == code[order[:-1]], np.diff(order), n + 1)
        gap = np.full(n, n + 1)
        gap[order[1:]] = near
        gap[order[:-1]] = np.minimum(gap[order[:-1]], near)
        good = np.concatenate([[False], gap <= (b - a) // exponent, [False]])
        edges = np.flatnonzero(good[1:] != good[:-1])
        parts = [(a + s, a + t + gram - 1) for s, t in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if t - s + gram - 1 >= least]
        if parts == [(a, b)]:
            out.append((a, b))
        else:
            todo += parts
    return sorted(out)


def text_runs(words: list[bytes], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of a text's runs, by start, then period."""
    if len(words) < least:
        return []
    rank = {w: i for i, w in enumerate(sorted(set(words)))}
    x = np.fromiter(map(rank.__getitem__, words), np.int64, len(words))
    found = set()
    for a, b in stretches(x, least, exponent):
        found |= {(a + s, n, p) for s, n, p in runs(x[a:b].tolist(), least, exponent)}
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not found:
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        steps[start + period] += 1
        steps[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a periodic tail, in every tenth document by crc32 of its id."""
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]


RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def find_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, plant: bool = False) -> DataFrame:
    """doc_id, n_words, runs, collapsed (the words kept, joined by one space) of every row of ``docs``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            ids, sizes, all_runs, texts = batch.column(0), [], [], []
            for doc_id, text in zip(ids.to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (text or "").encode().split()  # bytes split at 0x20 and 0x09 to 0x0D only
                words = planted(words, doc_id) if plant else words
                found = text_runs(words, least, exponent)
                sizes.append(len(words))
                all_runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                texts.append(b" ".join(collapsed(words, found)).decode())
            yield pa.record_batch([ids, pa.array(sizes, pa.int64()), pa.array(all_runs, kind), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return id_text(docs).mapInArrow(rows, RUNS)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of every row of ``docs``, planted tails included."""
    found, runs_ = find_runs(docs, plant=True), F.col("runs")

    def before(a: Column, b: Column) -> Column:
        """Compares exact ratios, then starts, then periods."""
        keys = [(b["length"] * a["period"], a["length"] * b["period"]), (a["start"], b["start"]), (a["period"], b["period"])]
        out = F.lit(0)
        for x, y in reversed(keys):
            out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
        return out

    best = F.get(F.array_sort(runs_, before), 0)
    lines = F.transform(runs_, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    out = found.select("doc_id", F.size(runs_).cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli, "runs_sha256", "collapsed_sha256")
