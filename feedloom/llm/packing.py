"""Mixture-controlled packing: deficit round-robin over source queues.

Documents are dealt evenly over the tasks, by hash, so that each has all sources. Each task tokenizes its documents into queues by
source. A window of ``size`` tokens is filled by rounds over the
queues: every queue is owed its target share of the window on top of what it is owed from earlier windows (its
deficit), and gives tokens once it is owed ``piece`` of them or has a shorter rest to give. What no queue can
give at its turn comes from those with tokens, the most indebted first, so windows are full while any tokens are left.
What is left of a task's queues (less than a window) goes, with the deficits, to a second round that packs the
rests of ``GROUP`` tasks together in order, and so only one window in each group of tasks ends short.

Target shares are those of the sources' bytes in the whole corpus unless given; a source that a task has run out of is owed on, and
others give in its place. More than ``QUEUES`` sources are hashed to so many queues, so what the tasks are sent is
bounded; pieces keep the names of their sources.

Defined cases: a null or empty text is the single end token. Rows that repeat a doc_id are packed each. A null source is
a source of its own. A short window is padded to ``size``, unless its length is a power of two. An empty table gives no
pieces; a very long text is cut over many windows. Of sources that are owed alike the one seen first gives. Only doc_id,
text and source are read, so other columns do no harm.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import cut

SIZE = 2048
END = 1
PIECE = 256
QUEUES = 1024
GROUP = 64
#: A task starts to pack when its queues hold so many tokens, and packs down to a quarter.
HELD_TOKENS = 4_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, padded_length long, task int, part int, debt double, ids binary, queue string"

_encoders: dict[str, object] = {}


def byte_order() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes are themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str):
    """The vocabulary of a tokenizers file, run by tiktoken: the same ids several times faster (a test compares them).

    Like tokenizers, it reads a special token where a text spells it out.
    """
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        special = {x["content"]: x["id"] for x in read.get("added_tokens", [])}
        order = byte_order()
        ranks = {bytes(order[c] for c in token): i for token, i in read["model"]["vocab"].items() if token not in special}
        _encoders[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[path]


class Packer:
    """Source queues of one task, and the windows drawn from them."""

    def __init__(self, shares: dict[str, float], size: int, piece: int):
        self.shares, self.size, self.piece = shares, size, piece
        self.queues: dict[str, deque] = {}
        self.owed: dict[str, float] = {}
        self.have: dict[str, int] = {}
        self.total = 0

    def put(self, queue: str, source: str, doc, ids: np.ndarray, start: int, doc_tokens: int) -> None:
        if queue not in self.queues:
            self.queues[queue] = deque()
            self.owed.setdefault(queue, 0.0)
            self.have[queue] = 0
        self.queues[queue].append((source, doc, ids, start, doc_tokens))
        self.have[queue] += len(ids)
        self.total += len(ids)

    def draw(self, name: str, n: int) -> Iterator[tuple]:
        """The next n tokens of a queue, as pieces of documents."""
        queue = self.queues[name]
        self.have[name] -= n
        self.total -= n
        self.owed[name] -= n
        while n:
            source, doc, ids, start, doc_tokens = queue.popleft()
            if len(ids) > n:
                queue.appendleft((source, doc, ids[n:], start + n, doc_tokens))
                ids = ids[:n]
            n -= len(ids)
            yield source, doc, ids, start, doc_tokens

    def window(self) -> list[tuple]:
        for s in self.queues:
            self.owed[s] += self.size * self.shares.get(s, 0.0)
        live = [s for s in self.queues if self.have[s]]
        room, out = min(self.size, self.total), []
        for s in live:
            n = min(int(self.owed[s]), self.have[s], room)
            if n > 0 and (n >= self.piece or n == self.have[s]):
                out += self.draw(s, n)
                room -= n
        while room:
            s = max((s for s in live if self.have[s]), key=self.owed.__getitem__)
            n = min(room, self.have[s])
            out += self.draw(s, n)
            room -= n
        return out


class Rows:
    """Output rows, given out as batches."""

    def __init__(self, task: int, size: int):
        self.task, self.size, self.rows = task, size, []

    def add(self, pieces: list[tuple], sequence: int) -> None:
        offset, length = 0, sum(len(p[2]) for p in pieces)
        padded = length if length & (length - 1) == 0 else self.size
        for source, doc, ids, start, doc_tokens in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), doc_tokens, sequence, offset, source, padded, self.task, None, None, None, None))
            offset += len(ids)

    def batch(self) -> pa.RecordBatch:
        schema = pa.schema([pa.field(n, {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in SCHEMA.split(", "))])
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[] for _ in schema]
        self.rows = []
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _pack(batches: Iterator[pa.RecordBatch], path: str, shares, size: int, piece: int, held: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(path)
    task = TaskContext.get().partitionId()
    packer, rows, sequence = Packer(shares.value, size, piece), Rows(task, size), task << 32
    for batch in batches:
        for doc, text, queue, source in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("queue").to_pylist(), batch.column("source").to_pylist(), strict=True):
            ids = np.asarray(encode.encode_to_numpy(text.as_py() or "", allowed_special="all"), np.uint32)
            ids = np.append(ids, np.uint32(END))
            packer.put(queue, source, doc, ids, 0, len(ids))
            if packer.total > held:
                while packer.total > held // 4:
                    rows.add(packer.window(), sequence)
                    sequence += 1
                yield rows.batch()
    while packer.total >= size:
        rows.add(packer.window(), sequence)
        sequence += 1
    part = 0
    for queue in packer.queues:
        for source, doc, ids, start, doc_tokens in packer.queues[queue]:
            rows.rows.append((doc, start, len(ids), 0, doc_tokens, 0, 0, source, 0, task, part, packer.owed[queue], ids.tobytes(), queue))
            part += 1
    yield rows.batch()


def _pack_rests(pdf: pd.DataFrame, shares, size: int, piece: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["task", "part"])
    packer, rows = Packer(shares.value, size, piece), Rows(int(pdf["task"].iloc[0]), size)
    for (_, queue), debt in pdf.groupby(["task", "queue"])["debt"].first().items():
        packer.owed[queue] = packer.owed.get(queue, 0.0) + debt
    for doc, start, doc_tokens, queue, source, ids in zip(pdf["doc_id"], pdf["start"], pdf["doc_tokens"], pdf["queue"], pdf["source"], pdf["ids"], strict=True):
        packer.put(queue, source, None if pd.isna(doc) else int(doc), np.frombuffer(ids, np.uint32), int(start), int(doc_tokens))
    sequence = (1 << 62) + ((int(pdf["task"].iloc[0]) // GROUP) << 32)
    while packer.total:
        rows.add(packer.window(), sequence)
        sequence += 1
    return rows.batch().to_pandas(types_mapper=pd.ArrowDtype)


def pack(docs: DataFrame, tokenizer: str, shares: dict[str, float] | None = None, size: int = SIZE, piece: int = PIECE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, padded_length."""
    spark = docs.sparkSession
    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), source.alias("source"), source.alias("queue"))
    if shares is None:
        sizes = docs.groupBy("queue").agg((F.sum(F.coalesce(F.octet_length("text"), F.lit(0))) + F.count("*")).alias("n"))
        if len(sizes.limit(QUEUES + 1).collect()) > QUEUES:
            docs = docs.withColumn("queue", F.pmod(F.crc32("queue"), F.lit(QUEUES)).cast("string"))
            sizes = docs.groupBy("queue").agg((F.sum(F.coalesce(F.octet_length("text"), F.lit(0))) + F.count("*")).alias("n"))
        found = {r["queue"]: float(r["n"]) for r in sizes.collect()}
        whole = sum(found.values()) or 1.0
        shares = {s: n / whole for s, n in found.items()}
    shared = spark.sparkContext.broadcast(shares)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    docs = docs.repartition(parts, F.xxhash64("doc_id", "text"))
    packed = cut(docs.mapInArrow(partial(_pack, path=tokenizer, shares=shared, size=size, piece=piece, held=HELD_TOKENS), SCHEMA))
    rests = packed.filter("ids IS NOT NULL").withColumn("group", F.floor(F.col("task") / GROUP))
    rests = rests.groupBy("group").applyInPandas(lambda pdf: _pack_rests(pdf.drop(columns="group"), shared, size, piece), SCHEMA)
    out = packed.filter("ids IS NULL").unionByName(rests)
    return out.drop("task", "part", "debt", "ids", "queue")
