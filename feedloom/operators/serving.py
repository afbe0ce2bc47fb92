"""What is done with search results: entries looked up and put in order, a fallback, JSON views, snippets, embedding of queries."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions import text as T
from feedloom.functions.udf import pandas_function
from feedloom.operators.indexing import hashing_embedder, identity
from feedloom.operators.retrieval import SearchError

CACHED_QUERIES = 128


def hydrate(hits: DataFrame, entries: DataFrame, without_hidden: bool = False) -> DataFrame:
    """The entries of hits (entry_id, rank, ...) in the order of rank; hits whose entry is gone are dropped."""
    found = hits.join(entries, "entry_id")
    return (found.filter(~F.col("hidden")) if without_hidden else found).orderBy("rank")


def with_fallback(ranked: Callable[[], DataFrame] | None, plain: Callable[[], DataFrame], mode: str = "hybrid", offset: int = 0) -> tuple[DataFrame, bool]:
    """(rows, degraded). The built-in search answers in its own mode and where there is no ranked one; past the first page, which ranked
    search doesn't know, and where it fails, the built-in one answers as well, and that counts as degraded."""
    if mode == "fulltext" or ranked is None:
        return plain(), False
    if offset > 0:
        return plain(), True
    try:
        return ranked(), False
    except SearchError:
        return plain(), True


def source_text(source: Column, title: Column, content: Column) -> Column:
    """What a passage's offsets count in: the title, or the text of the content."""
    return F.when(source == "title", title).otherwise(T.extract_text_udf(content))


@pandas_function("struct<text:string,highlights:array<struct<start:int,end:int>>>")
def snippet_udf(source: pd.Series, stored: pd.Series, start: pd.Series, end: pd.Series, unchanged: pd.Series, query: pd.Series) -> pd.DataFrame:
    out = [T.snippet(s or "", x or "", int(a), int(b), bool(u), q or "") for s, x, a, b, u, q in zip(source, stored, start, end, unchanged, query, strict=True)]
    return pd.DataFrame({"text": [t for t, _ in out], "highlights": [[{"start": a, "end": b} for a, b in h] for _, h in out]})


def entry_view(hits: DataFrame) -> DataFrame:
    """entry_id, view: a hit (entry_id, score, snippet) as JSON."""
    return hits.select("entry_id", F.to_json(F.struct("entry_id", "score", "snippet")).alias("view"))


def passage_view(hits: DataFrame) -> DataFrame:
    return hits.select("passage_id", F.to_json(F.struct("entry_id", "passage_id", "ordinal", "source", "score", "snippet")).alias("view"))


def similar_view(hits: DataFrame) -> DataFrame:
    """Without a snippet: nothing was searched for."""
    return hits.select("entry_id", F.to_json(F.struct("entry_id", "score")).alias("view"))


class Embedder(Protocol):
    """Turns texts into vectors; documents and queries may be told apart."""

    dimensions: int
    identity: str

    def documents(self, texts: list[str]) -> list[list[float]]: ...

    def query(self, text: str) -> list[float]: ...

    def close(self) -> None: ...


class HashingEmbedder:
    """The embedder without a model. Its prefixes stand before documents and queries, as some models want them."""

    def __init__(self, dimensions: int = 64, document_prefix: str = "", query_prefix: str = ""):
        self.dimensions, self.identity = dimensions, identity("hash", "1", dimensions)
        self.prefixes, self._embed = (document_prefix, query_prefix), hashing_embedder(dimensions)

    def documents(self, texts: list[str]) -> list[list[float]]:
        return self._embed([self.prefixes[0] + t for t in texts])

    def query(self, text: str) -> list[float]:
        return self._embed([self.prefixes[1] + text])[0]

    def close(self) -> None:
        pass


class Unavailable(RuntimeError):
    """The embedder can't be asked now; with ``restart`` it can't be asked any more."""

    def __init__(self, message: str, restart: bool = False):
        super().__init__(message)
        self.restart = restart


class RemoteEmbedder:
    """An embedder behind a JSON request {texts, task} with the answer {vectors, model: {name, revision, dimensions}}; ``post`` carries it.

    A model of other dimensions than asked for is refused, and so is one that changes while in use, as vectors of two models
    can't be compared.
    """

    def __init__(self, post: Callable[[dict], dict], dimensions: int):
        self._post, self.dimensions = post, dimensions
        self.identity = self._identity(post({"texts": [], "task": "document"})["model"])
        if not self.identity.endswith(f"#{dimensions}"):
            raise ValueError(f"the model is {self.identity}, not one of {dimensions} dimensions")

    @staticmethod
    def _identity(model: dict) -> str:
        return identity(model["name"], model["revision"], model["dimensions"])

    def _ask(self, texts: list[str], task: str) -> list[list[float]]:
        if not texts:
            return []
        try:
            answer = self._post({"texts": texts, "task": task})
        except OSError as e:
            raise Unavailable(str(e)) from e
        if self._identity(answer["model"]) != self.identity:
            raise Unavailable(f"the model changed from {self.identity} to {self._identity(answer['model'])}", restart=True)
        if len(answer["vectors"]) != len(texts):
            raise ValueError(f"{len(answer['vectors'])} vectors for {len(texts)} texts")
        return answer["vectors"]

    def documents(self, texts: list[str]) -> list[list[float]]:
        return self._ask(texts, "document")

    def query(self, text: str) -> list[float]:
        return self._ask([text], "query")[0]

    def close(self) -> None:
        pass


class QueryCache:
    """The vectors of the last queries, the least recently used going first; emptied when the embedder changes."""

    def __init__(self, embedder: Embedder, capacity: int = CACHED_QUERIES):
        self.embedder, self.capacity = embedder, capacity
        self._held: OrderedDict[str, list[float]] = OrderedDict()

    def embed(self, query: str) -> list[float]:
        if query not in self._held:
            self._held[query] = self.embedder.query(query)
            if len(self._held) > self.capacity:
                self._held.popitem(last=False)
        self._held.move_to_end(query)
        return self._held[query]

    def switch(self, embedder: Embedder) -> None:
        self.embedder = embedder
        self._held.clear()

    def __len__(self) -> int:
        return len(self._held)


def vector_literal(vector: Column) -> Column:
    """[0.1,0.2] as text."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("float").cast("string")), ","), F.lit("]"))


def parse_vector(literal: Column) -> Column:
    """The floats of such a text; null if it isn't one."""
    parts = F.transform(F.split(F.regexp_extract(literal, r"^\s*\[(.*)\]\s*$", 1), ","), lambda x: F.trim(x).try_cast("float"))
    ok = literal.rlike(r"^\s*\[.*\]\s*$") & ~F.exists(parts, lambda x: x.isNull())
    return F.when(literal.rlike(r"^\s*\[\s*\]\s*$"), F.array().cast("array<float>")).when(ok, parts)


def save_entries(services: dict[str, Callable[[list[dict]], None]], enabled: dict[int, set[str]], columns: tuple[str, ...] = ("entry_id", "user_id", "title", "url", "tags")) -> Callable[[DataFrame, int], None]:
    """A function of (batch, epoch) for foreachBatch: each task sends its rows to the services that their user has enabled."""

    def push(batch: DataFrame, epoch: int) -> None:
        def send(rows) -> None:
            held: dict[str, list[dict]] = {}
            for r in rows:
                for name in enabled.get(r["user_id"], ()):
                    held.setdefault(name, []).append(r.asDict())
            for name, mine in held.items():
                services[name](mine)

        batch.select(*[c for c in columns if c in batch.columns]).foreachPartition(send)

    return push
