"""Incremental indexing and event windows with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, folder: str, schema: str, glob: str = "*.parquet", files: int = 50) -> DataFrame:
    """New Parquet files of a folder, at most ``files`` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", glob).parquet(folder)


def new_entries(entries: DataFrame, delay: str = "7 days") -> DataFrame:
    """Each (feed_id, hash) once; state older than the watermark is dropped."""
    return entries.withWatermark("published_at", delay).dropDuplicatesWithinWatermark(["feed_id", "hash"])


def index_live(entries: DataFrame, index: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, every: str = "1 minute"):
    """Runs ``index(batch, epoch)`` for every batch of new entries; a failed batch is offered again after restart."""
    writer = entries.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def retry_tracker(failures: DataFrame, most: int = 5, forget: str = "6 hours") -> DataFrame:
    """entry_id, attempts, given_up: counts failures of each entry; entries silent for a while are forgotten."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((n,))
        hours = int(forget.split()[0])
        state.setTimeoutDuration(hours * 3_600_000)
        yield pd.DataFrame({"entry_id": [key[0]], "attempts": [n], "given_up": [n >= most]})

    return failures.groupBy("entry_id").applyInPandasWithState(update, "entry_id long, attempts long, given_up boolean", "attempts long", "update", GroupStateTimeout.ProcessingTimeTimeout)


#: A failed entry waits for so many intervals, twice as many after every further failure, up to the most.
FIRST_WAIT, MOST_WAIT = 4, 32


def backoff(failures: int, interval: float) -> float:
    """Seconds until an entry that has failed so often in a row is tried again."""
    return min(FIRST_WAIT * 2 ** max(failures - 1, 0), MOST_WAIT) * interval


def due_again(failures: DataFrame, as_of, interval: float) -> DataFrame:
    """entry_id of failures (entry_id, attempts, failed_at) whose wait is over."""
    waits = F.least(F.lit(FIRST_WAIT) * F.pow(F.lit(2), F.greatest(F.col("attempts") - 1, F.lit(0))), F.lit(MOST_WAIT)) * interval
    return failures.filter(F.unix_timestamp("failed_at") + waits <= F.unix_timestamp(F.lit(as_of))).select("entry_id")


def sweep(pending: Callable[[int, int], DataFrame], index: Callable[[DataFrame], None], page: int = 10_000) -> int:
    """Indexes everything that is pending, a page of ascending ids after the other; how many pages that took. ``pending`` takes the id after
    which to look and the size of a page. A page is one job over the cluster, and only its last id comes to the driver."""
    after, pages = -1, 0
    while True:
        rows = pending(after, page)
        last = rows.agg(F.max("entry_id")).first()[0]
        if last is None:
            return pages
        index(rows)
        after, pages = last, pages + 1


class Lane:
    """A stream that can be paused and goes on where it was, from its checkpoint."""

    def __init__(self, start: Callable[[], object]):
        self._start, self._query, self.reason = start, None, "not started"

    @property
    def running(self) -> bool:
        return self._query is not None and self._query.isActive

    def resume(self) -> None:
        if not self.running:
            self._query, self.reason = self._start(), ""

    def pause(self, reason: str = "paused") -> None:
        if self._query is not None:
            self._query.stop()
        self._query, self.reason = None, reason

    def check(self, available: bool) -> None:
        """Pauses while the embedder is down, and resumes what was paused for that."""
        if not available and self.running:
            self.pause("embedder unavailable")
        elif available and self.reason == "embedder unavailable":
            self.resume()


class Throttle:
    """How many batches run at once: one step down when the service time a worker, or the load a core, is too high, else one up."""

    def __init__(self, least: int = 1, most: int = 4, margin: float = 1.5, load_limit: float = 0.8, samples: int = 5):
        self.least, self.most, self.margin, self.load_limit, self.samples = max(least, 1), max(most, least, 1), margin, load_limit, samples
        self.workers, self.baseline, self._seen = self.least, 0.0, 0

    def observe(self, seconds: float, load: float | None = None) -> int:
        """The number of workers after a batch that took so many seconds an entry; the first batches only tell what is usual."""
        service = seconds * self.workers
        if self._seen < self.samples:
            self._seen += 1
            self.baseline += (service - self.baseline) / self._seen
        elif load is not None and load > self.load_limit or service > self.margin * self.baseline > 0:
            self.workers = max(self.workers - 1, self.least)
        else:
            self.workers = min(self.workers + 1, self.most)
        return self.workers


def gauges(entries: DataFrame, feeds: DataFrame, state: DataFrame) -> DataFrame:
    """name, value of what a monitor shows; every gauge is a sum that tasks make in part."""
    e = entries.agg(F.count("*").alias("entries"), F.count_if(F.col("status") == "unread").alias("entries_unread"), F.count_if(F.col("hidden")).alias("entries_hidden"))
    f = feeds.agg(F.count("*").alias("feeds"), F.count_if(F.col("disabled")).alias("feeds_disabled"), F.count_if(F.col("parsing_error_count") > 0).alias("feeds_broken"))
    s = state.agg(F.count_if(F.col("status") == "ok").alias("indexed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "skipped").alias("skipped"))
    one = e.join(F.broadcast(f)).join(F.broadcast(s))
    names = ", ".join(f"'{c}', {c}" for c in one.columns)
    return one.select(F.expr(f"stack({len(one.columns)}, {names}) AS (name, value)"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: events and values by type and window."""
    return _windows(events, F.window("ts", width), late)


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    return _windows(events, F.window("ts", width, step), late)


def _windows(events: DataFrame, window, late: str) -> DataFrame:
    df = events.withWatermark("ts", late) if events.isStreaming else events
    df = df.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return df.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Extension: each user's sessions, parted by a gap."""
    df = events.withWatermark("ts", late) if events.isStreaming else events
    df = df.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return df.select("user_id", F.col("w.start").alias("session_start"), "n")


def drain(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now into a memory table, for tests and reports."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
