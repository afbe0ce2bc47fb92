"""Interpolated modified Kneser-Ney over word pairs, counted, joined and looked up in shards.

A pair's probability is ``(c - D(c)) / total(first) + T(first) / total(first) * p(second)``; p is the modified Kneser-Ney
probability of a word from the numbers of words that it follows, interpolated with a uniform share for unknown words. T is
the sum of what the discounts take from a word's pairs. The logarithm of a text's probability is a sum of terms that each
belong to one word or one pair:

    sum over words of log p(w) + log(T(w) / total(w)), and over known pairs of log(1 + (c - D(c)) / (T(first) * p(second)))

so a text never has to meet the whole model: its words and pairs go to the shards that hold them, each shard looks up
its own, and the sums come back. Words and pairs are 48 bits of a hash and belong to the shard of their leading bits. What
tasks and shards send each other is packed: sorted keys by their steps, and counts in as few bytes as they need.

The steps, each one pass of a table of packs:

1. Tasks count pairs in chunks of ``HELD``, so their memory is bounded, and send them to the pairs' shards.
2. A shard sums its pairs. For each of its words it sends what it knows (its pairs once, twice and more often seen, their
   total, the words it follows) to the word's own shard.
3. A word's shard sums that, and sends the sums back to all who asked.
4. Texts go to the shards in ``WAVES``, dealt by hash, which holds what is on disk at once to a part of it.

Shards hold about ``SHARD_BYTES`` of text, so there are more of them with more input; up to ``WORD_SHARDS`` of them own words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import Scratch
from feedloom.llm.textvec import Words, mix, signed, words

U = np.uint64
HELD = 2_000_000
SHARD_BYTES, WORD_SHARDS = 16 << 20, 256
WAVES = 4
KEY_BITS = 48
#: What is left of a long: it numbers the texts of a chunk.
REST = U(64 - KEY_BITS)
TEXTS = 1 << (64 - KEY_BITS)
#: The words that stand before and after a text.
START, END = U(0x57A27ED057A2), U(0x7E57ED0F7E57)
_ONE, _TWO = U(0x9FB21C651E98DF25), U(0xD6E8FEB86659FD93)
#: What rows are: a shard's pairs, what a shard knows of words, the sums of it, a word shard's words, texts' pairs and words, about texts.
PAIRS, KNOWN, SUMS, OWN, TEXT_PAIRS, TEXT_WORDS, ABOUT = range(7)
MESSAGE = "shard long, kind int, source long, pack binary"


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _ONE ^ mix(second + _TWO)) >> REST


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return (key * U(shards)) >> U(KEY_BITS)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, bytes of the same significance together; of the first, which is sorted, the steps."""
    steps = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    parts = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in (steps, *columns[1:])]
    head = " ".join([str(len(steps)), *(c.dtype.str for c in columns)]).encode()
    return zstandard.compress(head + b"\n" + b"".join(parts), 1)


def unpack(packed: bytes) -> list[np.ndarray]:
    head, _, body = zstandard.decompress(packed).partition(b"\n")
    n, *kinds = head.decode().split()
    raw, at, out = np.frombuffer(body, np.uint8), 0, []
    for kind in map(np.dtype, kinds):
        size = int(n) * kind.itemsize
        out.append(np.ascontiguousarray(raw[at : at + size].reshape(kind.itemsize, -1).T).view(kind).reshape(-1))
        at += size
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


def small(x: np.ndarray) -> np.ndarray:
    """Counts in the narrowest unsigned type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def chains(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second word of every pair of a chunk's texts, START and END included, and the row of each pair."""
    n = len(w.bounds) - 1
    size = np.diff(w.bounds) + 1
    row = np.repeat(np.arange(n), size)
    second = np.full(len(row), END, U)
    second[np.arange(len(w.hash)) + np.repeat(np.arange(n), size - 1)] = w.hash >> REST
    first = np.full(len(row), START, U)
    first[1:] = second[:-1]
    first[np.cumsum(size) - size] = START
    return first, second, row


def _message(shards, kind: int, source, packs: list[bytes]) -> pa.RecordBatch:
    n = len(packs)
    source = np.full(n, source, np.int64) if np.isscalar(source) else np.asarray(source, np.int64)
    return pa.record_batch([pa.array(np.asarray(shards, np.int64)), pa.array(np.full(n, kind, np.int32)), pa.array(source), pa.array(packs, pa.binary())], ["shard", "kind", "source", "pack"])


def _by_shard(shards: int, key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The shards that sorted keys belong to, and a pack for each."""
    cut = np.searchsorted(shard_of(key, shards), np.arange(shards + 1, dtype=U))
    numbers = np.flatnonzero(cut[1:] > cut[:-1])
    return numbers, [pack(key[cut[s] : cut[s + 1]], *(small(c[cut[s] : cut[s + 1]]) for c in columns)) for s in numbers]


def _count(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """text to packs: the distinct pairs of a chunk with their counts."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out() -> pa.RecordBatch:
        first, second = (np.concatenate(x) for x in zip(*held, strict=True))
        key, at, n = np.unique(pair_key(first, second), return_index=True, return_counts=True)
        first, second = first[at], second[at]
        cut = np.searchsorted(shard_of(key, shards), np.arange(shards + 1, dtype=U))
        numbers = np.flatnonzero(cut[1:] > cut[:-1])
        return _message(numbers, PAIRS, 0, [_pairs(first[cut[s] : cut[s + 1]], second[cut[s] : cut[s + 1]], n[cut[s] : cut[s + 1]]) for s in numbers])

    for batch in batches:
        for w in words(batch.column("text")):
            first, second, _ = chains(w)
            held.append((first, second))
            size += len(first)
            if size > HELD:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def _join(*packs: bytes) -> bytes:
    return len(packs[0]).to_bytes(8, "little") + b"".join(packs)


def _pairs(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> bytes:
    """Two packs: the words, and the pairs as places among them."""
    known, place = np.unique(np.concatenate([first, second]), return_inverse=True)
    pair = (place[: len(first)].astype(U) << U(32)) | place[len(first) :].astype(U)
    order = np.argsort(pair)
    return _join(pack(known), pack(pair[order] >> U(32), small(pair[order] & U(0xFFFFFFFF)), small(n[order])))


def _unpairs(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words, places of the first and second word of each pair, count."""
    size = int.from_bytes(packed[:8], "little")
    (known,), (first, second, n) = unpack(packed[8 : 8 + size]), unpack(packed[8 + size :])
    return known, first.astype(np.int64), second.astype(np.int64), n.astype(np.int64)


def _runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.Table]]:
    """Rows in the order of ``column``, those of one value together."""
    held: list[pa.RecordBatch] = []
    value = None
    for batch in batches:
        key = batch.column(column).to_numpy()
        cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)] if len(key) else []
        for a, b in zip(cut, cut[1:], strict=False):
            if held and key[a] != value:
                yield value, pa.Table.from_batches(held)
                held = []
            value = int(key[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield value, pa.Table.from_batches(held)


def _times(n: np.ndarray) -> list[int]:
    return [int((n == i).sum()) for i in (1, 2, 3, 4)]


def _told(message: pa.RecordBatch, *numbers: int) -> pa.RecordBatch:
    """A message with the same six numbers in each row: sums for the whole model."""
    values = [*numbers, *[0] * (6 - len(numbers))]
    return pa.record_batch([*message.columns, *(pa.array(np.full(message.num_rows, x, np.int64)) for x in values)], [*message.schema.names, *(f"n{i}" for i in range(1, 7))])


TOLD = MESSAGE + ", n1 long, n2 long, n3 long, n4 long, n5 long, n6 long"


def _merge(batches: Iterator[pa.RecordBatch], word_shards: int) -> Iterator[pa.RecordBatch]:
    """Of each shard its pairs (with how many occur once to four times), and what it knows of words, for their shards."""
    for shard, rows in _runs(batches, "shard"):
        parts = [_unpairs(x.as_py()) for x in rows.column("pack")]
        known = np.unique(np.concatenate([p[0] for p in parts]))
        keys, counts = [], []
        for words_of, first, second, n in parts:
            place = np.searchsorted(known, words_of).astype(U)
            keys.append((place[first] << U(32)) | place[second])
            counts.append(n)
        pair, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(inverse, np.concatenate(counts), len(pair)).astype(np.int64)
        first, second = (pair >> U(32)).astype(np.int64), (pair & U(0xFFFFFFFF)).astype(np.int64)
        yield _told(_message([shard], PAIRS, 0, [_join(pack(known), pack(first.astype(U), small(second), small(n)))]), *_times(n))
        of = lambda where, weight=None: np.bincount(where, weight, len(known)).astype(np.int64)  # noqa: E731, B023
        numbers, packs = _by_shard(word_shards, known, of(first, n), of(first[n == 1]), of(first[n == 2]), of(first[n > 2]), of(second))
        yield _told(_message(numbers, KNOWN, shard, packs))


def _sum_words(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Rows in the order of word shard: the sums for each shard that asked (in the order of its words), and the words for the shards
    of their keys, with the totals of the smoothing: pairs' types, words that follow any, and how many follow one to four."""
    for _, rows in _runs(batches, "shard"):
        parts = [unpack(x.as_py()) for x in rows.column("pack")]
        known = np.unique(np.concatenate([p[0] for p in parts]))
        sums = [np.zeros(len(known), np.int64) for _ in range(5)]
        places = [np.searchsorted(known, p[0]) for p in parts]
        for at, p in zip(places, parts, strict=True):
            for total, x in zip(sums, p[1:], strict=True):
                total[at] += x
        yield _told(_message(rows.column("source").to_numpy(), SUMS, 0, [pack(p[0], *(small(x[at]) for x in sums)) for at, p in zip(places, parts, strict=True)]))
        follows = sums[4]
        told = [int(follows.sum()), int((follows > 0).sum()), *_times(follows)]
        for i, (number, packed) in enumerate(zip(*_by_shard(shards, known, *sums), strict=True)):
            yield _told(_message([number], OWN, 0, [packed]), *(told if i == 0 else ()))


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of n-grams that occur once to four times."""
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / max(n3, 1))
    return tuple(min(max(x, 0.05), k - 0.05) for x, k in zip(d, (1, 2, 3), strict=True))


class Smoothing:
    """The numbers that hold for the whole model: discounts of pairs and of words, and the share of an unknown word."""

    def __init__(self, of_pairs: tuple, types: int, known: int, *times: int):
        self.pairs, self.words, self.types = np.array([0.0, *discounts(*of_pairs)]), np.array([0.0, *discounts(*times)]), types
        taken = float(self.words[1:] @ np.array([times[0], times[1], known - times[0] - times[1]]))
        self.unknown = taken / types / (known + 1) if types else 1.0

    def taken(self, one: np.ndarray, two: np.ndarray, more: np.ndarray) -> np.ndarray:
        return self.pairs[1] * one + self.pairs[2] * two + self.pairs[3] * more

    def p(self, follows: np.ndarray) -> np.ndarray:
        return (follows - self.words[np.minimum(follows, 3).astype(np.int64)]) / max(self.types, 1) + self.unknown


class PairModel:
    """Counts of word pairs by shard, and what is known of each word."""

    def __init__(self, texts: Callable[[], DataFrame], size: int, scratch: Scratch):
        """texts: gives a table with text (not the table itself, so that nothing holds on to it). size: bytes of all the text that will
        be scored, for the number of shards."""
        self.scratch = scratch
        self.parts = max(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), 1)
        self.shards = max(self.parts, int(size) // SHARD_BYTES + 1)
        word_shards = min(self.shards, max(WORD_SHARDS, self.parts))
        self.pairs = scratch.table(self._dealt(texts().select("text").mapInArrow(partial(_count, shards=self.shards), MESSAGE)).mapInArrow(partial(_merge, word_shards=word_shards), TOLD))
        self.words = scratch.table(self._dealt(self.pairs.filter(F.col("kind") == KNOWN).select("shard", "kind", "source", "pack")).mapInArrow(partial(_sum_words, shards=self.shards), TOLD))
        self.smoothing = Smoothing(self._told(self.pairs, PAIRS)[:4], *self._told(self.words, OWN))

    def _dealt(self, messages: DataFrame) -> DataFrame:
        return messages.repartition(self.parts, "shard").sortWithinPartitions("shard", "kind")

    @staticmethod
    def _told(table: DataFrame, kind: int) -> tuple:
        return tuple(table.filter(F.col("kind") == kind).agg(*(F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in range(1, 7))).first())

    def score(self, docs: DataFrame, carried: str) -> DataFrame:
        """The columns ``carried`` (name and type each) of docs (which has text too), n (its words and the end) and loglik, a row for each row."""
        names, columns = [c.split()[0] for c in carried.split(", ")], ["shard", "kind", "source", "pack"]
        model = self.pairs.filter(F.col("kind") == PAIRS).select(*columns).unionByName(self.words.select(*columns))
        docs = docs.withColumn("_wave", F.pmod(F.xxhash64("text", *names), F.lit(WAVES))).withColumn("_split", F.spark_partition_id().cast("long"))
        kept, out = f"{carried}, n long, loglik double", None
        for wave in range(WAVES):
            part = self.scratch.table(self._wave(docs.filter(F.col("_wave") == wave).drop("_wave"), model, names).mapInArrow(partial(_by_text, names=names, unknown=self.smoothing.unknown), kept))
            out = part if out is None else out.unionByName(part)
        return out

    def _wave(self, docs: DataFrame, model: DataFrame, names: list[str]) -> DataFrame:
        """The sums of all shards for texts, by chunk."""
        sent = docs.mapInArrow(partial(_look_ups, shards=self.shards, names=names), MESSAGE)
        found = self._dealt(model.unionByName(sent)).mapInArrow(partial(_sum_up, smoothing=self.smoothing), "source long, kind int, pack binary")
        return found.repartition(self.parts, "source").sortWithinPartitions("source")


def _look_ups(batches: Iterator[pa.RecordBatch], shards: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Of each chunk of texts the packs of (pair or word, text's place, count), and one about the texts, which goes along with a shard."""
    chunk, pairs, singles, about, texts, size = None, [], [], [], 0, 0

    def out() -> Iterator[pa.RecordBatch]:
        for kind, found in ((TEXT_PAIRS, pairs), (TEXT_WORDS, singles)):
            both, n = np.unique(np.concatenate(found), return_counts=True)
            numbers, packs = _by_shard(shards, both >> REST, both & U(TEXTS - 1), n)
            yield _message(numbers, kind, chunk, packs)
        sink = pa.BufferOutputStream()
        table = pa.Table.from_batches(about)
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        yield _message([chunk % shards], ABOUT, chunk, [zstandard.compress(sink.getvalue().to_pybytes(), 1)])

    for batch in batches:
        for a in range(0, batch.num_rows, TEXTS // 2):
            piece = batch.slice(a, TEXTS // 2)
            if chunk is None:
                chunk = piece.column("_split")[0].as_py() << 32
            for w in words(piece.column("text")):
                n = w.last - w.first
                if about and (size > HELD or texts + n > TEXTS):
                    yield from out()
                    chunk, pairs, singles, about, texts, size = chunk + 1, [], [], [], 0, 0
                first, second, row = chains(w)
                text = U(texts) + row.astype(U)
                begin = first == START
                pairs.append((pair_key(first, second) << REST) | text)
                singles.append((second << REST) | text)
                singles.append((first[begin] << REST) | text[begin])
                rows = piece.slice(w.first, n)
                about.append(pa.record_batch([pa.array(np.diff(w.bounds) + 1), *(rows.column(c) for c in names)], ["n", *names]))
                texts += n
                size += len(first)
    if about:
        yield from out()


def _found(tables: list[bytes]) -> list[np.ndarray]:
    """Packs of one shape, one after the other, sorted by their first column."""
    columns = [np.concatenate(x) for x in zip(*map(unpack, tables), strict=True)]
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns]


def _values(pairs: list[bytes], sums: list[bytes], own: list[bytes], s: Smoothing) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """What the pairs and the words of a shard add to a text's logarithm, besides that of an unknown word."""
    out = {TEXT_PAIRS: (np.zeros(0, U), np.zeros(0)), TEXT_WORDS: (np.zeros(0, U), np.zeros(0))}
    if pairs:
        word, _, one, two, more, follows = _found(sums)
        # A word's sums come once from its own shard for each shard that asked; here they are in the order of the shard's words.
        known, first, second, n = _unpairs(pairs[0])
        taken, p = s.taken(one, two, more), s.p(follows)
        at = np.searchsorted(word, known)
        key = pair_key(known[first], known[second])
        value = np.log1p((n - s.pairs[np.minimum(n, 3)]) / (taken[at][first] * p[at][second]))
        order = np.argsort(key)
        out[TEXT_PAIRS] = key[order], value[order]
    if own:
        word, total, one, two, more, follows = _found(own)
        left = np.where(total > 0, s.taken(one, two, more) / np.maximum(total, 1), 1.0)
        out[TEXT_WORDS] = word, np.where(word == START, 0.0, np.log(s.p(follows)) - np.log(s.unknown)) + np.log(left)
    return out


def _sum_up(batches: Iterator[pa.RecordBatch], smoothing: Smoothing) -> Iterator[pa.RecordBatch]:
    """Rows in the order of shard, kind: of each chunk's look-ups (texts' places, sums of the values found); what is about texts goes on."""
    shard, model, values = None, {}, None
    for batch in batches:
        chunks, kinds, packs = [], [], []
        for s, kind, source, packed in zip(*(batch.column(c) for c in ("shard", "kind", "source", "pack")), strict=True):
            s, kind, source, packed = s.as_py(), kind.as_py(), source.as_py(), packed.as_py()
            if s != shard:
                shard, model, values = s, {PAIRS: [], SUMS: [], OWN: []}, None
            if kind < TEXT_PAIRS:
                model[kind].append(packed)
                continue
            if kind != ABOUT:
                if values is None:
                    values, model = _values(model[PAIRS], model[SUMS], model[OWN], smoothing), {}
                (keys, value), (key, text, n) = values[kind], unpack(packed)
                if not len(keys):
                    continue
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[at] == key
                if not hit.any():
                    continue
                sums = np.bincount(text[hit], value[at[hit]] * n[hit])
                texts = np.unique(text[hit])
                packed = pack(texts, sums[texts])
            chunks.append(source)
            kinds.append(kind)
            packs.append(packed)
        yield pa.record_batch([pa.array(chunks, pa.int64()), pa.array(kinds, pa.int32()), pa.array(packs, pa.binary())], ["source", "kind", "pack"])


def _by_text(batches: Iterator[pa.RecordBatch], names: list[str], unknown: float) -> Iterator[pa.RecordBatch]:
    """Rows in the order of chunk: the texts with the sums of their values."""
    for _, rows in _runs(batches, "source"):
        total, about = np.zeros(TEXTS), None
        for kind, packed in zip(rows.column("kind").to_pylist(), rows.column("pack"), strict=True):
            if kind == ABOUT:
                about = pa.ipc.open_stream(zstandard.decompress(packed.as_py())).read_all()
            else:
                text, value = unpack(packed.as_py())
                total[text] += value
        n = about.column("n").to_numpy()
        yield from pa.table([*(about.column(c) for c in names), pa.array(n), pa.array(total[: len(n)] + n * np.log(unknown))], [*names, "n", "loglik"]).to_batches()
