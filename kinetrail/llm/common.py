"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Workspace:
    """A folder for written intermediate tables, under ``spark.checkpoint.dir``.

    Written tables cut the lineage: a lost executor costs only the tasks that
    read them again. The folder is shared by the driver and the executors; where
    the setting is absent (tests, local mode) the session's warehouse is used.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
        self.path = f"{base.rstrip('/')}/kinetrail-{tag}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """Write ``df`` once and return a DataFrame that reads it."""
        df.write.parquet(f"{self.path}/{name}", compression=compression)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            where = self._at(name)
            self._fs(where).delete(where, True)

    def result(self, df: DataFrame) -> DataFrame:
        """Write the last table and delete all others of this folder."""
        out = self.write(df, "result")
        for s in self._fs(self._at("")).listStatus(self._at("")):
            if s.getPath().getName() != "result":
                self.drop(s.getPath().getName())
        return out

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self, where):
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())


def fold(column, mod: int):
    """crc32 of the id as text, modulo ``mod``: the fold that contracts name."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(mod))


def fold_of(value, mod: int) -> int:
    return zlib.crc32(str(value).encode()) % mod


def mixed(x):
    """splitmix64 finaliser over a numpy uint64 array."""
    import numpy as np

    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def bounded_rows(rows: DataFrame, key: str, n: int) -> list:
    """At most ``n`` rows of a labelled table, for fitting a classifier.

    Ids are picked by hash, so the choice depends on ids alone; of rows repeated
    with one id the smallest is used.
    """
    ids = rows.select(key).groupBy(key).agg(F.lit(1)).select(key).orderBy(F.xxhash64(F.lit(23), F.col(key)), key).limit(n)
    rest = [c for c in rows.columns if c != key]
    return rows.join(F.broadcast(ids), key).groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select("r.*").collect()


#: What workers keep for later tasks: how to forget it, by the operator that keeps it.
KEPT: dict = {}


def tidy(run, operator: str = ""):
    """``run`` for mapInArrow, which gives freed memory back when its partition is done.

    Spark keeps Python workers for the next stage; what their allocators hold counts
    against the executor all the while. A worker that turns to another operator first
    forgets what the last one has ``KEPT``.
    """

    def tidied(batches):
        import ctypes

        import pyarrow as pa

        from kinetrail.llm.common import KEPT

        for other in [o for o in KEPT if o != operator]:
            KEPT.pop(other)()
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return tidied
