"""Deletion vectors: frames set aside by a bitmap per episode, and brought back by an undo.

Every deletion is an action with an id: one bitmap for each episode and range of 32,768 frames, made by
Spark's bitmap aggregates and written, compressed, to the action's folder. Nothing of the data is
moved; readers drop the rows whose bit is set in any action that is not undone. An undo writes the
action's id. Both are idempotent: writing an action again replaces it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import is_folder

RANGE, BROADCAST_ROWS = 32_768, 4_096  # frames of a bitmap of 4 KB; 16 MB of bitmaps


def bitmaps(deleted: DataFrame, episode: str, frame: str) -> DataFrame:
    """(episode, bucket, bits) of rows (episode, frame); frames are 0 or more."""
    at = F.col(frame).cast("long") + 1
    return deleted.filter(F.col(frame) >= 0).groupBy(episode, F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


class DeletionLog:
    """Actions under ``path``: ``deleted/action=id`` and ``undone/action=id``."""

    def __init__(self, spark: SparkSession, path: str, episode: str, frame: str = "frame_index"):
        self.spark, self.path, self.episode, self.frame = spark, path.rstrip("/"), episode, frame

    def delete(self, frames: DataFrame, action: int) -> None:
        bitmaps(frames, self.episode, self.frame).write.mode("overwrite").parquet(f"{self.path}/deleted/action={action}", compression="zstd")

    def undo(self, action: int) -> None:
        self.spark.createDataFrame([(1,)], "n int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/undone/action={action}")

    def effective(self) -> DataFrame | None:
        """(episode, bucket, bits) of all actions that stand; None without any."""
        if not is_folder(self.spark, f"{self.path}/deleted"):
            return None
        rows = self.spark.read.parquet(f"{self.path}/deleted")
        if is_folder(self.spark, f"{self.path}/undone"):
            rows = rows.join(F.broadcast(self.spark.read.parquet(f"{self.path}/undone").select("action").distinct()), "action", "left_anti")  # ids of undone actions
        return rows.groupBy(self.episode, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))

    def marked(self, frames: DataFrame, name: str = "aside") -> DataFrame:
        """``frames`` with whether the row is set aside."""
        found = self.effective()
        if found is None:
            return frames.withColumn(name, F.lit(False))
        own = found.select(F.col(self.episode).alias("__e"), F.col("bucket").alias("__b"), "bits")
        own = F.broadcast(own) if own.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else own
        at = F.col(self.frame).cast("long") + 1
        got = frames.join(own, F.col(self.episode).eqNullSafe(F.col("__e")) & (F.bitmap_bucket_number(at) == F.col("__b")), "left")
        bit = F.bitmap_bit_position(at)
        byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.expr("shiftright(__byte, cast(__bit % 8 as int)) & 1") == 1
        got = got.withColumn("__byte", byte).withColumn("__bit", bit).withColumn(name, F.coalesce(hit, F.lit(False)))
        return got.drop("__e", "__b", "bits", "__byte", "__bit")

    def live(self, frames: DataFrame) -> DataFrame:
        return self.marked(frames, "__aside").filter("not __aside").drop("__aside")

    def aside(self, frames: DataFrame) -> DataFrame:
        return self.marked(frames, "__aside").filter("__aside").drop("__aside")
