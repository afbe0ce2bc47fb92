"""Helpers shared by the training-data operators: reading tables, cutting lineage, CRC folds."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Seconds that shuffle files get to go.
PAUSE = 0.25
#: Spark's setting that deletes the shuffle files of a write at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a temporary one where it is unset, on one machine only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="feedloom-checkpoint-"))
    return context.getCheckpointDir()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of results that nothing refers to any more; else they stay until the driver's JVM collects.
    They go in the background, so there is a moment for that before the next stage writes."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(PAUSE)


def cut(df: DataFrame) -> DataFrame:
    """``df`` without its lineage, from a checkpoint in the shared folder. Spark deletes it with the last reference."""
    folder(df.sparkSession)
    df = df.checkpoint(eager=True)
    release(df.sparkSession)
    return df


class Scratch:
    """Tables written to the shared folder: smaller than checkpoints, and deleted by ``drop`` or at the end of the program."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}
        self.base = f"{folder(spark)}/scratch-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def table(self, df: DataFrame) -> DataFrame:
        """``df`` as a table. The shuffle files of writing it go at its end, whatever still refers to ``df``."""
        path, schema = f"{self.base}/{len(self.paths)}-{uuid.uuid4().hex[:8]}", df.schema
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        release(self.spark)
        out = self.spark.read.schema(schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(self.paths.pop(id(t)))

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def close(self) -> None:
        try:
            self._delete(self.base)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass


def id_bits(ids: DataFrame, column: str, most: int = 1 << 27, hashed: bool = False) -> tuple[int, object]:
    """A bit set of hashed ids, (number of bits, broadcast array): a filter that lets some other ids pass too.

    It has eight bits an id, from 65,536 up to ``most`` (16 MB), so its size is bounded; an exact join comes after it.
    ``hashed``: the column is a hash already.
    """
    import numpy as np

    n = 1 << 16
    while n < most and n < 8 * ids.count():
        n *= 2
    h = F.pmod(F.col(column) if hashed else F.xxhash64(column), F.lit(n))
    words = ids.select(h.alias("h")).selectExpr("h div 64 AS w", "shiftleft(1L, CAST(h % 64 AS INT)) AS b")
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow().to_pandas()
    bits = np.zeros(n // 64, np.int64)
    bits[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64)
    return n, ids.sparkSession.sparkContext.broadcast(bits)


def id_text(df: DataFrame) -> DataFrame:
    """doc_id and text alone, so that further columns of any name do no harm."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def id_fold(column: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the fold that decides which rows are learnt from."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % modulus, F.lit(0).cast("long"))


def likely(docs: DataFrame, ids: DataFrame, *more: str, then=None, schema: str = "") -> DataFrame:
    """doc_id, text (and ``more`` text columns) of the documents in ``ids``, and of few others: so that a join shuffles little text.

    ``then`` takes these batches on, in the same Python worker, and gives those of ``schema``.
    """
    n, bits = id_bits(ids.select("doc_id").distinct(), "doc_id")
    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", *more, F.pmod(F.xxhash64("doc_id"), F.lit(n)).alias("h"))

    def keep(batches):
        import numpy as np
        import pyarrow as pa

        words = bits.value.view(np.uint64)
        for batch in batches:
            h = batch.column("h").to_numpy()
            found = (words[h // 64] >> (h % 64).astype(np.uint64)) & np.uint64(1) == 1
            yield batch.select(["doc_id", "text", *more]).filter(pa.array(found))

    if then is not None:
        return rows.mapInArrow(lambda batches: then(keep(batches)), schema)
    return rows.mapInArrow(keep, ", ".join(["doc_id long", "text string", *(f"{c} string" for c in more)]))


def free(docs: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name
