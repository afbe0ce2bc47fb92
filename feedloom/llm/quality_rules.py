"""Quality rules: counts on words and lines, and compression bands.

zstandard's ratio (bytes in : bytes out) over the whole text, and over fixed chunks of it, tells repetitive text (high)
and noise (low) from prose. Limits depend on length, as short texts compress less. A text passes if its own ratio lies
in the band of its length and at most a share of its whole chunks lies outside the band of a chunk.

Defined cases: a null or empty text has no words and fails. Rows are judged one by one, so repeats and ties change
nothing; columns besides text are kept by ``passing`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import free, likely
from feedloom.llm.textvec import SPACE, Words, grams, words

LEVEL = 3
CHUNK = 4096
#: Bytes from which a band holds, least ratio, greatest ratio: where too little trusted text tells.
BANDS = ((1, 0.8, 2.2), (400, 1.1, 2.4), (1000, 1.25, 2.8), (4000, 1.4, 3.2), (16000, 1.5, 3.6))
CHUNK_BAND = (1.2, 3.4)
#: More than this share of a text's chunks outside their band fails it.
CHUNK_SHARE = 0.5
#: Half the width of a band in standard deviations, trusted texts that limits need, steps of length an octave.
WIDTH, ENOUGH, STEPS = 3.0, 100, 16
#: The step that stands for chunks, and the unit of ratios in sums, which are exact so.
CHUNKS, UNIT = -1, 10_000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, chunk_share double"


def repeat_words(g: np.ndarray) -> int:
    """Words that stand in a 3-word window found twice or more; g: the windows' hashes."""
    if len(g) < 2:
        return 0
    _, inverse, counts = np.unique(g, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    covered = np.zeros(len(g) + 2, bool)
    for j in range(3):
        covered[j : len(g) + j] |= again
    return int(covered.sum())


def dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


class Limits:
    """Bands of ratios by length, from (step, n, sum, sum of squares) of trusted texts and of their chunks."""

    def __init__(self, step: np.ndarray, n: np.ndarray, s: np.ndarray, ss: np.ndarray):
        one = step == CHUNKS
        x, m, s1, s2 = (step[~one] + 0.5) / STEPS, n[~one], s[~one] / UNIT, ss[~one] / UNIT**2
        self.least, self.most = float(x.min()), float(x.max())
        self.middle = (self.least + self.most) / 2
        self.curve = np.polyfit(x - self.middle, s1 / m, min(3, len(x) - 1), w=np.sqrt(m))
        f = np.polyval(self.curve, x - self.middle)
        off = s2 - 2 * f * s1 + f * f * m  # squared distances from the curve
        octave = np.floor(x).astype(np.int64)
        self.first = int(octave.min())
        count, far = np.bincount(octave - self.first, m), np.bincount(octave - self.first, off)
        few = 20  # an octave of few texts leans on the others
        self.spread = np.sqrt(np.maximum((far + few * off.sum() / m.sum()) / (count + few), 1e-6))
        if (chunks := n[one].sum()) >= ENOUGH:
            mean = s[one].sum() / UNIT / chunks
            spread = WIDTH * np.sqrt(max(ss[one].sum() / UNIT**2 / chunks - mean**2, 1e-6))
            self.chunk = float(mean - spread), float(mean + spread)
        else:
            self.chunk = self.band(CHUNK)

    def band(self, size: int) -> tuple[float, float]:
        x = min(max(float(np.log2(size)), self.least), self.most)
        middle, spread = float(np.polyval(self.curve, x - self.middle)), WIDTH * float(self.spread[int(x) - self.first])
        return middle - spread, middle + spread


class Fixed:
    """The bands without trusted text."""

    chunk = CHUNK_BAND

    def band(self, size: int) -> tuple[float, float]:
        return next((lo, hi) for least, lo, hi in reversed(BANDS) if size >= least)


def chunk_ratios(text: bytes, zstd: zstandard.ZstdCompressor) -> list[float]:
    """Ratios of the chunks of a text of CHUNK bytes or more; the last one ends with the text."""
    n = len(text)
    starts = [*range(0, n - CHUNK + 1, CHUNK), *([n - CHUNK] if n % CHUNK else [])] if n >= CHUNK else []
    return [CHUNK / len(zstd.compress(text[i : i + CHUNK])) for i in starts]


def compression(text: bytes, zstd: zstandard.ZstdCompressor, limits: Limits | Fixed) -> tuple[float, float, bool]:
    """Ratio of the whole text, share of its chunks outside their band, and whether it passes."""
    n = len(text)
    if not n:
        return 0.0, 0.0, True
    ratio = n / len(zstd.compress(text))
    (least, most), (low, high) = limits.band(n), limits.chunk
    chunks = chunk_ratios(text, zstd)
    share = sum(not low <= x <= high for x in chunks) / len(chunks) if chunks else 0.0
    return ratio, share, least <= ratio <= most and share <= CHUNK_SHARE


def _sums(flags: np.ndarray, w: Words) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[w.offsets])


def base_failed(n_words: int, repeats: int) -> bool:
    return n_words < 50 or 100 * repeats > 50 * n_words


def judge(text: pa.Array, lang: pa.Array, limits: dict) -> pa.Array:
    """limits: by language, and for all others under None."""
    parts: list[list] = [[] for _ in range(9)]
    zstd = zstandard.ZstdCompressor(level=LEVEL)
    langs = lang.to_pylist()
    for w in words(text, fold_case=False):
        n_words = np.diff(w.bounds)
        word_chars = _sums(~SPACE[w.data] & ((w.data & 0xC0) != 0x80), w)
        symbols = _sums(_SYMBOL[w.data], w)
        g, at = grams(w, 3)
        for i in range(w.last - w.first):
            n, raw = int(n_words[i]), w.data[w.offsets[i] : w.offsets[i + 1]].tobytes()
            repeats = repeat_words(g[at[i] : at[i + 1]])
            failed = base_failed(n, repeats)
            ratio, share, fits = compression(raw, zstd, limits.get(langs[w.first + i]) or limits[None])
            for part, x in zip(parts, (n, int(word_chars[i]), int(symbols[i]), dup_lines(raw), repeats, failed, not failed and fits, ratio, share), strict=True):
                part.append(x)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
    return pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(parts, kinds, strict=True)], names)


def _trusted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, lang to doc_id, lang, step, n, s, ss of the texts that pass the base rules, and of their chunks."""
    zstd = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        rows: list[tuple[int, int, int, int, int]] = []
        for w in words(batch.column("text"), fold_case=False):
            n_words = np.diff(w.bounds)
            g, at = grams(w, 3)
            for i in range(w.last - w.first):
                if base_failed(int(n_words[i]), repeat_words(g[at[i] : at[i + 1]])):
                    continue
                raw = w.data[w.offsets[i] : w.offsets[i + 1]].tobytes()
                ratio = round(UNIT * len(raw) / len(zstd.compress(raw)))
                rows.append((w.first + i, int(STEPS * np.log2(len(raw))), 1, ratio, ratio * ratio))
                chunks = [round(UNIT * x) for x in chunk_ratios(raw, zstd)]
                if chunks:
                    rows.append((w.first + i, CHUNKS, len(chunks), sum(chunks), sum(x * x for x in chunks)))
        if rows:
            row, *sums = (pa.array(x, pa.int64()) for x in zip(*rows, strict=True))
            yield pa.record_batch([batch.column("doc_id").take(row), batch.column("lang").take(row), *sums], ["doc_id", "lang", "step", "n", "s", "ss"])


def learnt(docs: DataFrame, labels: DataFrame | None) -> dict:
    """The limits by language, under None those of all; from sums of a fixed number of steps a language."""
    if labels is None:
        return {None: Fixed()}
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("q")).groupBy("doc_id").agg(F.min("q").alias("q")).filter("q = 1").select("doc_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _lang(docs).alias("lang")).filter("text IS NOT NULL")
    sums = likely(texts, ids, "lang", then=_trusted, schema="doc_id long, lang string, step long, n long, s long, ss long").join(ids, "doc_id")
    rows = sums.groupBy("lang", "step").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss"))).toPandas()
    out = {}
    for lang, part in [(None, rows), *rows.groupby("lang")]:
        part = part.groupby("step", as_index=False)[["n", "s", "ss"]].sum()
        if part["n"][part["step"] != CHUNKS].sum() >= ENOUGH:
            out[lang] = Limits(part["step"].to_numpy(np.int64), *(part[c].to_numpy(float) for c in ("n", "s", "ss")))
    return {None: Fixed()} | out


def _lang(docs: DataFrame) -> Column:
    return F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")


def verdict(docs: DataFrame, labels: DataFrame | None) -> Column:
    """The struct of all counts and decisions for the rows of ``docs``."""
    limits = learnt(docs, labels)

    @F.arrow_udf(SCHEMA)
    def rules(text: pa.Array, lang: pa.Array) -> pa.Array:
        return judge(text, lang, limits)

    return rules(F.col("text").cast("string"), _lang(docs))


def quality_rules(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """doc_id and the verdict's columns for every row. labels: doc_id, quality (1: trusted)."""
    return docs.select("doc_id", verdict(docs, labels).alias("v")).select("doc_id", "v.*")


def passing(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The rows that the rules keep, with all their columns."""
    mark = free(docs, "_rules_kept")
    return docs.withColumn(mark, verdict(docs, labels)["kept"]).filter(F.col(mark)).select(*docs.columns)
