"""Tables on shared storage that change by whole files. A manifest names the files that are current and is switched at once, so a reader
sees a change wholly or not at all, and a write that fails leaves the old state. Two things are built on it: a store of tables in
buckets, where a change writes the touched buckets anew, and indexes in segments, where it writes a segment of its own."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Someone else has changed the table meanwhile; the change can be made again."""


class Manifest:
    """Numbered JSON documents in a folder; the highest number is current. A number can be taken once only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_manifest/{name}".rstrip("/"))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        fs = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(self._path())] if fs.exists(self._path()) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, version: int | None = None) -> tuple[int, dict]:
        """(version, content); (0, {}) before the first commit."""
        if version is None:
            version = (self.versions() or [0])[-1]
        if not version:
            return 0, {}
        stream = self._fs().open(self._path(f"{version:09d}.json"))
        try:
            return version, json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, after: int, content: dict) -> int:
        """Makes ``content`` the version that follows ``after``."""
        fs, name = self._fs(), self._path(f".{uuid.uuid4().hex}")
        fs.mkdirs(self._path())
        stream = fs.create(name, False)
        stream.write(bytearray(json.dumps(content, sort_keys=True), "utf-8"))
        stream.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        options = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)  # fails where the name is taken
        try:
            hadoop.FileContext.getFileContext(name.toUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(name), fs.makeQualified(self._path(f"{after + 1:09d}.json")), options)
        except Exception as e:
            fs.delete(name, False)
            if after + 1 in self.versions():
                raise Conflict(f"version {after + 1} of {self.path} is taken") from e
            raise
        return after + 1

    def forget(self, keep: int, folders: Callable[[dict], set[str]], inside: tuple[str, ...]) -> int:
        """Deletes all but the last ``keep`` versions, and the folders below ``inside`` that none of these names; how many went."""
        fs, hadoop, versions = self._fs(), self.spark._jvm.org.apache.hadoop.fs, self.versions()
        named: set[str] = set()
        for v in versions[-keep:]:
            named |= folders(self.read(v)[1])
        gone = 0
        for part in inside:
            top = hadoop.Path(f"{self.path}/{part}")
            for status in fs.listStatus(top) if fs.exists(top) else []:
                name = f"{part}/{status.getPath().getName()}"
                if name not in named:
                    fs.delete(status.getPath(), True)
                    gone += 1
        for v in versions[:-keep]:
            fs.delete(self._path(f"{v:09d}.json"), False)
        return gone


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Store:
    """Tables dealt into buckets by a key. A change reads and writes the buckets that it touches; all its tables switch together."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.manifest = spark, path.rstrip("/"), Manifest(spark, path)

    @classmethod
    def create(cls, path: str, buckets: int = 64, **tables: tuple[DataFrame, str]) -> Store:
        """A store of (rows, key column) by name."""
        spark = next(iter(tables.values()))[0].sparkSession
        store, content = cls(spark, path), {}
        for name, (rows, key) in tables.items():
            content[name] = {"key": key, "buckets": buckets, "schema": rows.schema.json(), "files": {}}
            content[name]["files"] = store._write(name, rows, content[name], None)
        store.manifest.commit(0, content)
        return store

    @staticmethod
    def _bucket(table: dict, key: str | None = None) -> Column:
        return F.pmod(F.xxhash64(key or table["key"]), F.lit(table["buckets"])).cast("int")

    def _write(self, name: str, rows: DataFrame, table: dict, only: list[int] | None) -> dict[str, str]:
        """Writes rows by bucket to a folder of their own; the folder of each bucket that has rows. A row outside ``only`` is an error."""
        folder = f"{name}/{uuid.uuid4().hex[:12]}"
        where = self._bucket(table)
        if only is not None:
            where = F.when(where.isin(*only) if only else F.lit(False), where).otherwise(F.raise_error(F.lit(f"a change of {name} gave rows of a bucket that it did not touch")).cast("int"))
        dealt = rows.withColumn("_bucket", where)
        dealt.hint("rebalance", F.col("_bucket")).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        fs, hadoop = self.manifest._fs(), self.spark._jvm.org.apache.hadoop.fs
        names = [s.getPath().getName() for s in fs.listStatus(hadoop.Path(f"{self.path}/{folder}"))]
        return {n.partition("=")[2]: f"{folder}/{n}" for n in names if n.startswith("_bucket=")}

    def _read(self, table: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(table["schema"]))
        files = [f for b, f in sorted(table["files"].items(), key=lambda x: int(x[0])) if buckets is None or int(b) in set(buckets)]
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in files)) if files else self.spark.createDataFrame([], schema)

    def table(self, name: str, keys: list | None = None, version: int | None = None) -> DataFrame:
        """A table as it is, or was; with ``keys`` the rows of these keys, read from their buckets alone."""
        table = self.manifest.read(version)[1][name]
        if keys is None:
            return self._read(table)
        schema = T.StructType([T.StructType.fromJson(json.loads(table["schema"]))[table["key"]]])
        wanted = self.spark.createDataFrame([(k,) for k in keys], schema)
        rows = self._read(table, [r[0] for r in wanted.select(self._bucket(table)).distinct().collect()])
        return rows.filter(F.col(table["key"]).isin(*keys))

    def change(self, make: Callable[[dict[str, DataFrame]], Mapping[str, DataFrame]], **touched: Column | DataFrame | list) -> int:
        """The version after ``make``, which gets the tables and returns the new rows of those named in ``touched``.

        ``touched`` says what changes: a condition on the table's rows, a DataFrame with its key column, or keys; rows that come in count
        as well. ``make`` sees of these tables the touched buckets only, and must return all rows of them; other tables it sees
        whole. Nothing is visible before everything is written; if a version came meanwhile, Conflict is raised and nothing changes.
        """
        version, content = self.manifest.read()
        content, seen, numbers = json.loads(json.dumps(content)), {}, {}
        for name, table in content.items():
            if name not in touched:
                seen[name] = self._read(table)
                continue
            what = touched[name]
            if isinstance(what, Column):
                what = self._read(table).filter(what)
            elif not isinstance(what, DataFrame):
                field = T.StructType.fromJson(json.loads(table["schema"]))[table["key"]]
                what = self.spark.createDataFrame([(k,) for k in what], T.StructType([field]))
            numbers[name] = sorted(r[0] for r in what.select(self._bucket(table)).distinct().collect())  # no more than there are buckets
            seen[name] = self._read(table, numbers[name])
        if not any(numbers.values()):
            return version
        new = make(seen)
        for name, only in numbers.items():
            columns = T.StructType.fromJson(json.loads(content[name]["schema"])).fieldNames()
            files = self._write(name, new[name].select(*columns), content[name], only)
            kept = {b: f for b, f in content[name]["files"].items() if int(b) not in set(only)}
            content[name]["files"] = kept | files
        return self.manifest.commit(version, content)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes what none of the last versions reads, failed writes included. Not while a change is being written."""
        tables = tuple(self.manifest.read()[1])
        return self.manifest.forget(keep, lambda c: {f.rpartition("/")[0] for t in c.values() for f in t["files"].values()}, tables)


class Segments:
    """An index in segments. A change adds a segment and the keys that are void in older ones; merging keeps their number logarithmic.

    Subclasses say how data rows are made from what is indexed (``make``), laid out (``store``), and what is kept of a segment besides (``summaries``
    of the data as written: ids, with key and size, and others). Folders by segment: data, the summaries, and gone (key, size). The manifest has the segments from old to young, and the totals over what is live.
    """

    key = "doc"
    #: Of the data rows as written, with the column that parts their files.
    schema = ""
    parts: tuple[str, ...] = ("data", "ids", "gone")
    #: An older segment is merged with the younger ones unless it has more rows than so many times theirs.
    TIER = 2

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.manifest = spark, path.rstrip("/"), Manifest(spark, path)

    def make(self, rows: DataFrame, extra: dict) -> DataFrame:
        raise NotImplementedError

    def summaries(self, data: DataFrame) -> dict[str, DataFrame]:
        raise NotImplementedError

    def store(self, data: DataFrame, folder: str) -> None:
        raise NotImplementedError

    def state(self) -> dict:
        return self.manifest.read()[1]

    def read(self, part: str, segments: list[dict]) -> DataFrame | None:
        """The rows of a part in these segments, with segment as a column; None if none of them has any."""
        names = [s["name"] for s in segments if s["gone" if part == "gone" else "rows"]]
        if not names:
            return None
        reader = self.spark.read.option("basePath", f"{self.path}/{part}")
        if part in ("data", "ids", "gone"):  # else a name of digits alone is read as a number
            reader = reader.schema(self._columns(part))
        return reader.parquet(*(f"{self.path}/{part}/segment={n}" for n in names))

    def rows_of(self, part: str, segments: list[dict]) -> DataFrame:
        """The same, with no rows if there are none."""
        rows = self.read(part, segments)
        if rows is not None:
            return rows
        return self.spark.createDataFrame([], self._columns(part))

    def _columns(self, part: str) -> str:
        return f"{self.schema if part == 'data' else f'{self.key} long, size long'}, segment string"

    def live(self, rows: DataFrame, segments: list[dict]) -> DataFrame:
        """``rows`` (with segment) without those that a younger segment has replaced or deleted."""
        gone = self.read("gone", segments)
        if gone is None:
            return rows
        age = F.create_map(*(F.lit(x) for i, s in enumerate(segments) for x in (s["name"], i)))
        void = gone.groupBy(F.col(self.key).alias("_key")).agg(F.max(F.element_at(age, F.col("segment"))).alias("_age"))
        return rows.join(void, (F.col(self.key) == F.col("_key")) & (F.element_at(age, F.col("segment")) < F.col("_age")), "left_anti")

    def data(self, state: dict | None = None, where: Column | None = None) -> DataFrame:
        """All live rows, or those that fulfil a condition, which reaches the scan."""
        segments = (state or self.state())["segments"]
        rows = self.rows_of("data", segments)
        return self.live(rows if where is None else rows.filter(where), segments)

    def create(self, rows: DataFrame, **extra) -> Segments:
        self._add(0, {"segments": [], "n": 0, "size": 0, "extra": extra}, rows, None)
        return self

    def update(self, rows: DataFrame | None = None, deleted: DataFrame | None = None) -> int:
        """Indexes ``rows``, in place of older ones with their keys, and drops ``deleted`` (key column); the new version."""
        version, state = self.manifest.read()
        return self._add(version, state, rows, deleted)

    def _add(self, version: int, state: dict, rows: DataFrame | None, deleted: DataFrame | None) -> int:
        name, gone, n, size = uuid.uuid4().hex[:12], 0, state["n"], state["size"]
        new = 0
        if rows is not None:
            self.store(self.make(rows, state["extra"]), f"{self.path}/data/segment={name}")
            self._summarise(name)
            ids = self.spark.read.parquet(f"{self.path}/ids/segment={name}")
            if not ids.groupBy(self.key).count().filter("count > 1").isEmpty():
                raise ValueError(f"rows to be indexed repeat a {self.key}")
            new, added = ids.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
            n, size = n + new, size + added
        else:
            ids = self.spark.createDataFrame([], f"{self.key} long, size long")
            ids.write.parquet(f"{self.path}/ids/segment={name}")
        if state["segments"]:
            void = ids.select(self.key)
            void = void if deleted is None else void.unionByName(deleted.select(self.key)).distinct()
            old = self.live(self.rows_of("ids", state["segments"]), state["segments"])
            old.join(void, self.key, "left_semi").select(self.key, "size").write.parquet(f"{self.path}/gone/segment={name}")
            gone, less = self.spark.read.parquet(f"{self.path}/gone/segment={name}").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
            n, size = n - gone, size - less
        segments = [*state["segments"], {"name": name, "rows": new, "gone": gone}]
        return self.manifest.commit(version, {"segments": segments, "n": n, "size": size, "extra": state["extra"]})

    def _summarise(self, name: str) -> None:
        for part, rows in self.summaries(self.spark.read.schema(self.schema).parquet(f"{self.path}/data/segment={name}")).items():
            rows.write.parquet(f"{self.path}/{part}/segment={name}")

    def merge(self, whole: bool = False) -> int:
        """Writes the youngest segments as one, as far as tiers say, or all of them; the number of segments then. Searches and changes may go
        on meanwhile."""
        segments = self.state()["segments"]
        first, total = len(segments) - 1, segments[-1]["rows"]
        while first and (whole or segments[first - 1]["rows"] <= self.TIER * total):
            first -= 1
            total += segments[first]["rows"]
        # What is void in older segments may be as much as they are.
        if first and sum(s["gone"] for s in segments) > total:
            first = 0
        old = segments[first:]
        if len(old) < 2 and not (first == 0 and old[0]["gone"]):
            return len(segments)
        name = uuid.uuid4().hex[:12]
        self.store(self.live(self.rows_of("data", old), old).drop("segment"), f"{self.path}/data/segment={name}")
        self._summarise(name)
        gone = self.read("gone", old) if first else None
        if gone is not None:
            gone.select(self.key, "size").dropDuplicates([self.key]).write.parquet(f"{self.path}/gone/segment={name}")
        one = {"name": name, "rows": self.spark.read.parquet(f"{self.path}/ids/segment={name}").count(), "gone": 0 if gone is None else self.spark.read.parquet(f"{self.path}/gone/segment={name}").count()}
        while True:
            version, state = self.manifest.read()
            now = [s["name"] for s in state["segments"]]
            if now[first : first + len(old)] != [s["name"] for s in old]:
                raise Conflict("the segments were merged meanwhile")
            merged = [*state["segments"][:first], one, *state["segments"][first + len(old) :]]
            try:
                self.manifest.commit(version, state | {"segments": merged})
                return len(merged)
            except Conflict:  # a change came in: its segment stays younger than the merged one
                continue

    def vacuum(self, keep: int = 1) -> int:
        """Deletes what none of the last versions reads. Not while a change is being written."""
        parts = self.parts
        return self.manifest.forget(keep, lambda c: {f"{p}/segment={s['name']}" for p in parts for s in c["segments"]}, parts)
