"""Indexing with retries inside a stream: a failed entry waits in the stream's state and comes again by a timer, also after a restart."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from feedloom.streaming.live import backoff

OUTCOMES = "entry_id long, outcome string, attempts int, next_ms long, reason string"
#: A stream that starts again makes no batch, and so runs no timer, before something comes in. So a row of this id comes in every second, and does nothing.
TICK = -(1 << 63)
#: The store that timers need; Spark's setting spark.sql.streaming.stateStore.providerClass.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Unavailable(Exception):
    """What indexes is away as a whole: no fault of the entry, which is tried again after one interval and counts no failure."""


class _Retry(StatefulProcessor):
    def __init__(self, attempt: Callable[[dict], None], columns: list[str], schema: str, interval: float, most: int | None):
        self.attempt, self.columns, self.schema, self.interval, self.most = attempt, columns, schema, interval, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", f"{self.schema}, failures int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] == TICK:
            return
        last = None
        for pdf in rows:  # of several rows of an entry the last counts, and its failures start anew
            if len(pdf):
                last = pdf.iloc[-1]
        if last is None:
            return
        yield self._run(key, tuple(_plain(last[c]) for c in self.columns), 0, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.waiting.exists():
            *row, failures = self.waiting.get()
            yield self._run(key, tuple(row), failures, timerValues)

    def _run(self, key, row: tuple, failures: int, timers) -> pd.DataFrame:
        now = timers.getCurrentProcessingTimeInMs()
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old[0] if isinstance(old, (tuple, list)) else old)
        try:
            self.attempt(dict(zip(self.columns, row, strict=True)))
            self.waiting.clear()
            return self._row(key, "indexed", failures + 1, None, None)
        except Unavailable as e:
            outcome, reason, wait = "paused", str(e), self.interval
        except Exception as e:  # noqa: BLE001  whatever the entry fails with is its reason
            failures += 1
            outcome, reason, wait = "failed", str(e), backoff(failures, self.interval)
        if self.most is not None and failures >= self.most:
            self.waiting.clear()
            return self._row(key, "dead", failures, None, reason)
        at = now + max(int(wait * 1000), 1)
        self.waiting.update((*row, failures))
        self.handle.registerTimer(at)
        return self._row(key, outcome, failures, at, reason)

    @staticmethod
    def _row(key, outcome: str, attempts: int, at: int | None, reason: str | None) -> pd.DataFrame:
        out = pd.DataFrame({"entry_id": [int(key[0])], "outcome": [outcome], "attempts": [attempts], "reason": [reason]})
        out["next_ms"] = pd.array([at], dtype="Int64")
        return out[["entry_id", "outcome", "attempts", "next_ms", "reason"]]

    def close(self) -> None:
        pass


def _plain(v):
    """A value of a pandas row as the state takes it."""
    if v is None or v is pd.NaT or isinstance(v, float) and v != v:
        return None
    return v.to_pydatetime() if isinstance(v, pd.Timestamp) else v.item() if hasattr(v, "item") else v


def index_with_retries(entries: DataFrame, attempt: Callable[[dict], None], interval: float = 60, most: int | None = None) -> DataFrame:
    """A stream of outcomes (OUTCOMES) of ``attempt``, which indexes an entry (a dict of its columns) or raises.

    A failed entry is kept in the state with its columns and tried again after 4, 8, 16, then 32 intervals; a newer row of the entry takes its
    place. After ``most`` failures (None: never) its outcome is ``dead`` and it is forgotten: these rows are the dead letters. State and
    timers are part of the checkpoint, so they outlive a restart. The session's state store must be STATE_STORE.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema)
    worker = _Retry(attempt, entries.columns, schema, interval, most)
    ticks = entries.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
    ticks = ticks.select(F.lit(TICK).cast("long").alias("entry_id"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in entries.schema if f.name != "entry_id"))
    return entries.unionByName(ticks).groupBy("entry_id").transformWithStateInPandas(statefulProcessor=worker, outputStructType=OUTCOMES, outputMode="Append", timeMode="ProcessingTime")


def keep_outcomes(outcomes: DataFrame, path: str, checkpoint: str, every: str = "1 minute"):
    """Starts a query that appends outcomes to a table, each once, in folders by outcome."""
    writer = outcomes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("outcome")
    return writer.outputMode("append").trigger(processingTime=every).start()


def dead_letters(spark: SparkSession, path: str) -> DataFrame:
    """entry_id, attempts, reason of the entries that were given up; other outcomes' files aren't read."""
    return spark.read.schema(OUTCOMES).parquet(path).filter("outcome = 'dead'").select("entry_id", "attempts", "reason")
