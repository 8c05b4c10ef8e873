"""Versions of a dataset behind one pointer, and a ledger of a batch job's items.

``root/versions/N`` holds version N, ``root/current`` its number. Readers ask for the pointer
and read that folder. An upgrade writes the next version, compares its statistics with the
old one's, switches the pointer by one rename that replaces the old file, and only then drops
the old version; whatever fails before leaves readers with the old one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import keep_latest
from ..operators.positions import numbered
from .files import _path, delete, is_folder


def current_version(spark: SparkSession, root: str) -> int | None:
    where, fs = _path(spark, f"{root}/current")
    if not fs.exists(where):
        return None
    return int(spark.read.text(f"{root}/current", wholetext=True).first()[0])


def version_path(root: str, version: int) -> str:
    return f"{root}/versions/{version}"


def read_current(spark: SparkSession, root: str) -> DataFrame:
    version = current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"no version in {root}")
    return spark.read.parquet(version_path(root, version))


def _switch(spark: SparkSession, root: str, version: int) -> None:
    """The pointer's new text is written aside and renamed over the old file in one step."""
    jvm, (aside, fs), (to, _) = spark.sparkContext._jvm, _path(spark, f"{root}/current.next"), _path(spark, f"{root}/current")
    out = fs.create(aside, True)
    out.write(str(version).encode())
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri() if to.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(aside, to, how)


def publish(df: DataFrame, root: str) -> int:
    """``df`` as the next version; the pointer moves once it is written."""
    spark = df.sparkSession
    version = (current_version(spark, root) or 0) + 1
    df.write.mode("overwrite").parquet(version_path(root, version))
    _switch(spark, root, version)
    return version


def differing(old: DataFrame, new: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Statistics (keys and numbers) that are in one table only or differ by more than the relative tolerance."""
    numbers = [c for c in old.columns if c not in keys]
    both = old.select(*keys, F.struct(*numbers).alias("old")).join(new.select(*keys, F.struct(*[F.col(c) for c in numbers]).alias("new")), keys, "full")
    far = lambda a, b: F.abs(a - b) > tolerance * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))
    wrong = F.col("old").isNull() | F.col("new").isNull()
    for c in numbers:
        a, b = F.col(f"old.{c}").cast("double"), F.col(f"new.{c}").cast("double")
        wrong = wrong | (a.isNull() != b.isNull()) | F.coalesce(far(a, b), F.lit(False))
    return both.filter(wrong)


def upgrade(spark: SparkSession, root: str, convert: Callable[[DataFrame], DataFrame], stats: Callable[[DataFrame], DataFrame], keys: list[str], tolerance: float = 1e-6) -> int:
    """The next version by ``convert``, if ``stats`` of both versions agree; else an error, and the old one stays.

    What an earlier, broken upgrade has left of the next version is overwritten.
    """
    before = current_version(spark, root)
    if before is None:
        raise FileNotFoundError(f"no version in {root}")
    old, at = read_current(spark, root), version_path(root, before + 1)
    convert(old).write.mode("overwrite").parquet(at)
    wrong = differing(stats(old), stats(spark.read.parquet(at)), keys, tolerance).limit(5).collect()
    if wrong:
        delete(spark, at)
        raise ValueError(f"statistics differ: {[r.asDict(recursive=True) for r in wrong]}")
    _switch(spark, root, before + 1)
    delete(spark, version_path(root, before))
    return before + 1


class Ledger:
    """What a batch job has done: rows (item, state, note, step), appended; the last one of an item counts."""

    KIND = "item string, state string, note string, step long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def states(self) -> DataFrame:
        if not is_folder(self.spark, self.path):
            return self.spark.createDataFrame([], self.KIND)
        return keep_latest(self.spark.read.schema(self.KIND).parquet(self.path), ["item"], "step", "state")

    def pending(self, items: DataFrame) -> DataFrame:
        """Items (item string) that no run has finished; failed ones come again."""
        return items.select("item").distinct().join(self.states().filter("state = 'done'"), "item", "left_anti")

    def run(self, items: DataFrame, work: Callable[[DataFrame], DataFrame], size: int) -> int:
        """``work`` on the pending items, ``size`` at a time; how many batches that took.

        ``work`` takes rows (item) and gives rows (item, ok, note), lazily. Its rows are written as
        they are made, one folder of the ledger a batch; items that it does not answer stay
        pending. A restart begins with what is pending then.
        """
        places = numbered(self.pending(items), "item", name="__p")
        batches = -(-places.count() // size)
        first = (self.states().agg(F.max("step")).first()[0] or 0) + 1
        for i in range(batches):
            batch = places.filter(F.floor(F.col("__p") / size) == i).select("item")
            rows = work(batch).select(F.col("item").cast("string").alias("item"), F.when(F.coalesce("ok", F.lit(False)), "done").otherwise("failed").alias("state"), F.col("note").cast("string").alias("note"), F.lit(first + i).cast("long").alias("step"))
            rows.write.mode("append").parquet(self.path)
        return batches
