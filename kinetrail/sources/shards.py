"""Tables in hash-bucketed shards, of which a change rewrites only those that it touches.

A row's shard is its key's hash modulo the number of shards. A replacement reads the shards of
the changed keys, drops these keys, adds the new rows, and overwrites just these folders
(dynamic partition overwrite: tasks write aside, the commit moves the folders). It is
idempotent: the same change again gives the same table, so a job or a trigger that is
repeated after a loss does no harm. The number of shards is fixed by the first write and must be
the same in all later ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import keep_latest
from .files import is_folder

SHARD = "shard"


def sharded(df: DataFrame, keys: list[str], shards: int) -> DataFrame:
    return df.withColumn(SHARD, F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int"))


def _write(rows: DataFrame, path: str, shards: int) -> None:
    rows.repartition(shards, SHARD).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(SHARD).parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(SHARD)


def _touched(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The table's rows in the shards of ``keys``; at most as many numbers as there are shards go to the driver."""
    numbers = [r[0] for r in keys.select(SHARD).distinct().collect()]
    return spark.read.parquet(path).filter(F.col(SHARD).isin(numbers))


def replace(new: DataFrame, path: str, keys: list[str], shards: int, targets: DataFrame | None = None) -> None:
    """Rows of the targeted keys (those of ``new``, if None) give way to the rows of ``new``.

    A target without new rows is deleted; a shard that has no row afterwards becomes an empty
    one. Rows of ``new`` outside the targets are an error. Keys must not be null.
    """
    spark = new.sparkSession
    new = sharded(new, keys, shards)
    asked = new.select(*keys, SHARD).distinct() if targets is None else sharded(targets.select(*keys).distinct(), keys, shards)
    if targets is not None and not new.join(asked, keys, "left_anti").isEmpty():
        raise ValueError("new rows outside the targeted keys")
    if not is_folder(spark, path):
        return _write(new, path, shards)
    old = _touched(spark, path, asked)
    rest = old.join(asked.select(*keys), keys, "left_anti")
    rows = rest.unionByName(new.select(*rest.columns))
    left = {r[0] for r in rows.select(SHARD).distinct().collect()}
    _write(rows, path, shards)
    for k in {r[0] for r in asked.select(SHARD).distinct().collect()} - left:  # an overwrite leaves folders without new rows alone
        spark.createDataFrame([], rows.drop(SHARD).schema).write.mode("overwrite").parquet(f"{path}/{SHARD}={k}")


def upsert(batch: DataFrame, path: str, keys: list[str], order: str, shards: int) -> None:
    """Keep-latest: of the table's and the batch's rows of one key the last by ``order`` stays."""
    new = sharded(batch, keys, shards)
    if is_folder(batch.sparkSession, path):
        old = _touched(batch.sparkSession, path, new)
        new = old.unionByName(new.select(*old.columns))
    _write(keep_latest(new, keys, order), path, shards)
