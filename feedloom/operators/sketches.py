"""Counts and distinct counts from sketches or bitmaps kept by file: a report reads no rows, and a refresh reads the files that changed alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.sources.versions import Segments

#: Sketches of 2**LOG entries: exact up to so many distinct keys, beyond that with a standard error of 2**(-LOG / 2) of the union, a quarter of a
#: per cent. A file's sketch is 8 bytes a key and half a megabyte at the most.
LOG = 16
LISTING = "file string, bytes long, changed long"


def listing(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, changed of the Parquet files below a path, from the file system alone."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True)
    rows = []
    while found.hasNext():
        f = found.next()
        name = f.getPath().getName()
        if name.endswith(".parquet") and not name.startswith((".", "_")):
            rows.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return spark.createDataFrame(rows, LISTING)


def _file_id(name: Column) -> Column:
    """Of a local file's name, which is given with one slash or three."""
    return F.xxhash64(F.regexp_replace(name, "^file:/+", "file:/"))


class FileSketches(Segments):
    """file_id, file, bytes, changed, rows, sketch: one row a file. ``size`` of the manifest is the number of all rows."""

    key = "file_id"
    schema = "file_id long, file string, bytes long, changed long, rows long, sketch binary"

    def make(self, rows: DataFrame, extra: dict) -> DataFrame:
        return rows

    def store(self, data: DataFrame, folder: str) -> None:
        data.write.parquet(folder)

    def summaries(self, data: DataFrame) -> dict[str, DataFrame]:
        return {"ids": data.select("file_id", F.col("rows").alias("size"))}

    def refresh(self, path: str, read: Callable[[list[str]], DataFrame], key: str) -> list[str]:
        """Brings the sketches up to the files below ``path``; the files that were read. ``read`` gives the rows of some files, with ``key``."""
        now = listing(self.spark, path).withColumn("file_id", _file_id(F.col("file")))
        state = self.state()
        old = self.data(state) if state else self.spark.createDataFrame([], self.schema)
        same = ["file_id", "bytes", "changed"]
        new = now.join(old.select(*same), same, "left_anti")
        gone = old.select("file_id").join(now.select("file_id"), "file_id", "left_anti")
        files = sorted(r.file for r in new.select("file").collect())  # names, of which the driver lists all anyhow
        if not files and gone.isEmpty():
            return []
        rows = None
        if files:
            rows = self.sketched(new, read(files).select(F.col(key).alias("k"), _file_id(F.input_file_name()).alias("file_id")))
        if state:
            self.update(rows, gone)
        else:
            self.create(rows)
        self.merge()
        return files

    def sketched(self, files: DataFrame, keys: DataFrame) -> DataFrame:
        """Data rows of ``files`` (file_id, file, bytes, changed), from the keys (k, file_id) in them."""
        made = keys.groupBy("file_id").agg(F.count("*").alias("rows"), F.theta_sketch_agg("k", LOG).alias("sketch"))
        empty = F.coalesce("rows", F.lit(0).cast("long"))  # a file without rows has no sketch
        return files.join(made, "file_id", "left").select("file_id", "file", "bytes", "changed", empty.alias("rows"), "sketch")

    def count(self) -> int:
        """All rows, repeated keys included."""
        return self.state()["size"]

    def distinct(self) -> DataFrame:
        """One row: n, the estimated number of different keys."""
        return self.union("a").select(_estimate(F.col("a")).alias("n"))

    def union(self, name: str) -> DataFrame:
        return self.data().agg(F.theta_union_agg("sketch", LOG).alias(name))


class FileBitmaps(FileSketches):
    """The same with bitmaps of integer keys, which are exact at any size: for each file a row with its number of rows, and a bitmap of 4 KB for each
    32,768 consecutive keys of which it has some. Plane i has the keys whose number of rows in the file has bit i, so repeated keys count in full.

    Meant for ids that lie close together, an eighth of a byte each; one that lies alone costs 4 KB before compression."""

    schema = "file_id long, file string, bytes long, changed long, rows long, plane int, bucket long, bits binary"

    def summaries(self, data: DataFrame) -> dict[str, DataFrame]:
        return {"ids": data.filter("plane IS NULL").select("file_id", F.col("rows").alias("size"))}

    def sketched(self, files: DataFrame, keys: DataFrame) -> DataFrame:
        counted = keys.groupBy("file_id", F.col("k").cast("long").alias("k")).agg(F.count("*").alias("n"))
        rows = counted.groupBy("file_id").agg(F.sum("n").alias("rows"))
        same = [F.lit(None).cast(t).alias(c) for c, t in (("plane", "int"), ("bucket", "long"), ("bits", "binary"))]
        heads = files.join(rows, "file_id", "left").select("file_id", "file", "bytes", "changed", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), *same)
        planes = F.expr("CASE WHEN n = 1 THEN array(0) ELSE filter(sequence(0, 62), i -> shiftright(n, i) & 1 = 1) END")
        bits = counted.filter("k IS NOT NULL").select("file_id", "k", F.explode(planes).alias("plane"))
        bits = bits.groupBy("file_id", "plane", F.bitmap_bucket_number("k").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("k")).alias("bits"))
        return heads.unionByName(bits.join(files, "file_id").select("file_id", "file", "bytes", "changed", F.lit(0).cast("long").alias("rows"), "plane", "bucket", "bits"))

    def bitmaps(self) -> DataFrame:
        return self.data(where=F.col("plane").isNotNull()).select("file_id", "plane", "bucket", "bits")

    def distinct(self) -> DataFrame:
        """One row: n, the number of different keys."""
        every = self.bitmaps().groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        return every.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0).cast("long")).alias("n"))


def pending(entries: FileBitmaps, done: FileBitmaps) -> DataFrame:
    """One row: n, how many rows of the entries have a key that isn't done; exact, from the bitmaps alone."""
    out = done.bitmaps().groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("out"))
    both = F.explode(F.array("bits", F.coalesce("out", "bits"))).alias("bits")  # what a bitmap adds to those done is what isn't done
    known = F.coalesce(F.bitmap_count("out"), F.lit(0).cast("long")).alias("known")
    united = entries.bitmaps().join(out, "bucket", "left").select("file_id", "plane", "bucket", known, both)
    united = united.groupBy("file_id", "plane", "bucket", "known").agg(F.bitmap_or_agg("bits").alias("bits"))
    n = F.sum(F.expr("shiftleft(bitmap_count(bits) - known, plane)"))
    return united.agg(F.coalesce(n, F.lit(0).cast("long")).alias("n"))


def _estimate(sketch: Column) -> Column:
    return F.coalesce(F.theta_sketch_estimate(sketch), F.lit(0).cast("long"))


def pending_estimate(entries: FileSketches, done: FileSketches) -> DataFrame:
    """One row: n, about how many of the entries are not done, from one sketch of each side. Exact up to 2**LOG keys."""
    both = entries.union("a").join(F.broadcast(done.union("b")))
    n = F.when(F.col("b").isNull(), _estimate(F.col("a"))).when(F.col("a").isNull(), F.lit(0)).otherwise(_estimate(F.theta_difference("a", "b")))
    return both.select(n.cast("long").alias("n"))
