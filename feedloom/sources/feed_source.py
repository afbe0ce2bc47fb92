"""Feed documents as a Spark data source, read as a table or a stream, and a sink that pushes entries to services once.

    spark.dataSource.register(FeedSource)
    spark.read.format("feeds").load("/feeds")
    spark.readStream.format("feeds").option("files", 100).load("/feeds")

Folders are listed with Arrow's file systems, so any address that these open will do.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from fnmatch import fnmatch

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from feedloom.schemas import PARSED

#: Files of one task unless told otherwise, and files of a stream's batch.
FILES, BATCH = 64, 1000
_NAMES = [x.strip().split()[0] for x in re.split(r",\s*(?![^<]*>)", PARSED)]


def _listing(path: str, pattern: str) -> list[tuple[int, str]]:
    """(time of change in ns, address) of the files below a path, in that order."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = system.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((f.mtime_ns or 0, f.path) for f in found if f.type == fs.FileType.File and fnmatch(f.base_name, pattern) and not f.base_name.startswith((".", "_")))


class Files(InputPartition):
    def __init__(self, root: str, files: list[str]):
        self.root, self.files = root, files


def _items(partition: Files) -> Iterator[tuple]:
    """The items of some documents; one that is broken gives none."""
    from pyarrow import fs

    from feedloom.sources.formats import parse_feed

    system = fs.FileSystem.from_uri(partition.root)[0] if "://" in partition.root or partition.root.startswith("file:") else fs.LocalFileSystem()
    for name in partition.files:
        with system.open_input_stream(name) as stream:
            data = stream.read()
        try:
            items = parse_feed(data, name)
        except (ValueError, TypeError):
            continue
        for item in items:
            row = [item[n] for n in _NAMES]
            row[_NAMES.index("enclosures")] = [(e["url"], e["mime_type"], e["size"]) for e in item["enclosures"]]
            yield (*row, name)


def _parts(root: str, files: list[str], size: int) -> list[Files]:
    return [Files(root, files[i : i + size]) for i in range(0, len(files), size)] or [Files(root, [])]


class _Options:
    def __init__(self, options):
        self.path, self.pattern = options["path"], options.get("pathGlobFilter", "*")
        self.size, self.batch = int(options.get("filesPerTask", FILES)), int(options.get("files", BATCH))


class FeedReader(DataSourceReader):
    def __init__(self, options):
        self.o = _Options(options)

    def partitions(self) -> list[Files]:
        return _parts(self.o.path, [p for _, p in _listing(self.o.path, self.o.pattern)], self.o.size)

    def read(self, partition: Files) -> Iterator[tuple]:
        return _items(partition)


class FeedStreamReader(DataSourceStreamReader):
    """Offsets are the time of change and the name of the last file read; a file that comes with an earlier time isn't seen."""

    def __init__(self, options):
        self.o, self.at = _Options(options), None

    def initialOffset(self) -> dict:
        return {"time": -1, "name": ""}

    def latestOffset(self) -> dict:
        """At most ``files`` files further than the last batch."""
        start = self.at or (-1, "")
        new = [f for f in _listing(self.o.path, self.o.pattern) if f > start][: self.o.batch]
        self.at = new[-1] if new else start
        return {"time": self.at[0], "name": self.at[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        a, b = (start["time"], start["name"]), (end["time"], end["name"])
        self.at = max(self.at or b, b)  # after a restart the stream goes on from here
        return _parts(self.o.path, [f[1] for f in _listing(self.o.path, self.o.pattern) if a < f <= b], self.o.size)

    def read(self, partition: Files) -> Iterator[tuple]:
        return _items(partition)

    def commit(self, end: dict) -> None:
        pass


class FeedSource(DataSource):
    """Items of RSS, Atom, RDF and JSON documents with the columns of PARSED, and the document's address."""

    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return PARSED.replace("\n", " ") + ", document string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FeedReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FeedStreamReader(self.options)


class Pushed(WriterCommitMessage):
    def __init__(self, rows: int):
        self.rows = rows


class _Push:
    """Sends a task's rows, CHUNK at a time. After each chunk its keys are put down in ``receipts`` under the batch and the task, whose rows are
    the same, in any order, when it is repeated; so a repetition sends what is missing. Only keys are held, and of earlier attempts alone. Without
    an answer to its last chunk a service may get that chunk's rows again."""

    CHUNK = 100

    def __init__(self, options):
        self.receipts, self.batch, self.key = options["receipts"], options.get("batch"), options.get("key", "entry_id")
        target = options["service"]  # module:function, importable on executors
        self.module, _, self.function = target.partition(":")

    def _service(self):
        from importlib import import_module

        return getattr(import_module(self.module), self.function)

    def _folder(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.receipts) if "://" in self.receipts or self.receipts.startswith("file:") else (fs.LocalFileSystem(), self.receipts)

    def write(self, rows) -> Pushed:
        from pyarrow import fs
        from pyspark import TaskContext

        context = TaskContext.get()
        batch = self.batch or context.getLocalProperty("streaming.sql.batchId") or "0"
        system, root = self._folder()
        folder = f"{root}/batch={batch}/task-{context.partitionId()}"
        system.create_dir(folder, recursive=True)
        before = [f.path for f in system.get_file_info(fs.FileSelector(folder)) if not f.base_name.endswith(".new")]
        sent: set[str] = set()
        for name in before:
            with system.open_input_stream(name) as f:
                sent.update(f.read().decode().split("\n"))
        service, chunk, done = self._service(), [], 0

        def push() -> None:
            nonlocal done
            service(chunk)
            name = f"{folder}/{len(before):08d}"
            with system.open_output_stream(f"{name}.new") as f:
                f.write("\n".join(str(r[self.key]) for r in chunk).encode())
            system.move(f"{name}.new", name)
            before.append(name)
            done += len(chunk)
            chunk.clear()

        for row in rows:
            if str(row[self.key]) in sent:
                done += 1
                continue
            chunk.append(row.asDict())
            if len(chunk) == self.CHUNK:
                push()
        if chunk:
            push()
        return Pushed(done)


class PushWriter(_Push, DataSourceWriter):
    def commit(self, messages) -> None:
        pass

    def abort(self, messages) -> None:
        pass


class PushStreamWriter(_Push, DataSourceStreamWriter):
    """A batch that is committed has its receipts marked, so what was sent can be told by epoch."""

    def commit(self, messages, batchId: int) -> None:
        system, root = self._folder()
        system.create_dir(f"{root}/batch={batchId}", recursive=True)
        with system.open_output_stream(f"{root}/batch={batchId}/committed") as f:
            f.write(json.dumps({"rows": sum(m.rows for m in messages if m), "at": datetime.now(timezone.utc).isoformat()}).encode())

    def abort(self, messages, batchId: int) -> None:
        pass


class PushSink(DataSource):
    """Options: service (module:function that takes a list of dicts), receipts (a shared folder), key (the column that tells rows apart), and, for a
    write that isn't a stream's, batch (a name that is the same when the write is repeated)."""

    @classmethod
    def name(cls) -> str:
        return "push"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return PushWriter(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return PushStreamWriter(self.options)


def by_key(entries: DataFrame, tasks: int, key: str = "entry_id") -> DataFrame:
    """Entries dealt by key, so that a row is in the same task whenever its batch is repeated."""
    return entries.repartition(tasks, F.col(key))
