"""Union, upsert, renumbering and sharding of datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import hash_uniform
from .positions import numbered, numbered_within
from .sampling import split_episodes


def union_common(tables: dict[str, DataFrame], tag: str = "dataset") -> DataFrame:
    """Union over the columns that all tables share; without any, an error."""
    common = [c for c in next(iter(tables.values())).columns if all(c in t.columns for t in tables.values())]
    if not common:
        raise ValueError("the datasets have no common column")
    return reduce(DataFrame.unionByName, [t.select(*common).withColumn(tag, F.lit(name)) for name, t in tables.items()])


def renumber(df: DataFrame, group: str, order: str, start: int = 0, name: str = "index") -> DataFrame:
    """Global consecutive numbers in order of (group, order), over range partitions."""
    return numbered(df, group, order, name=name, start=start)


def upsert(old: DataFrame, new: DataFrame, key: str, targets: DataFrame | None = None) -> DataFrame:
    """Rows of the targeted keys are replaced by the new rows."""
    return old.join((new if targets is None else targets).select(key).distinct(), key, "left_anti").unionByName(new)


def keep_latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Last row per key by the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))
    return df.withColumn("__r", rank).filter("__r = 1").drop("__r")


def shard_ids(df: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """Shards of fixed size per group; a size of 0 or less is one shard."""
    if size <= 0:
        return df.withColumn("shard", F.lit(0).cast("long"))
    return numbered_within(df, group, order, name="shard").withColumn("shard", F.floor(F.col("shard") / size).cast("long"))


def stable_group_order(df: DataFrame, group: str, order: str, inside: str) -> DataFrame:
    """Position of each row when groups come by first appearance, rows by ``inside``, ties by order."""
    first = df.groupBy(F.col(group).alias("__f")).agg(F.min(order).alias("group_at"))
    placed = numbered_within(df.withColumn("__in", F.coalesce(F.col(inside), F.lit(-1))), group, "__in", order, name="place", start=1).drop("__in")
    return placed.join(first, F.col(group).eqNullSafe(F.col("__f"))).select(*df.columns, "group_at", F.col("place").cast("int").alias("place"))


def keep_last_n(df: DataFrame, index: str, capacity: int) -> DataFrame:
    """A ring buffer's content: the rows within ``capacity`` of the largest index."""
    top = df.agg((F.max(index) - capacity).alias("__floor"))
    return df.join(F.broadcast(top), F.col(index) > F.col("__floor")).drop("__floor")  # one row


def range_union(events, low, high):
    """Sorted distinct event frames with an inclusive range added, given in either order."""
    return F.array_sort(F.array_distinct(F.concat(events, F.sequence(F.least(low, high), F.greatest(low, high)))))


def strict_lookup(df: DataFrame, lookup: DataFrame, key: str, value: str) -> DataFrame:
    """``df`` with the looked-up ``value``; a key that the lookup lacks, null included, is an error."""
    found = df.join(lookup.select(F.col(key), F.col(value), F.lit(True).alias("__known")), key, "left")
    missing = F.raise_error(F.concat(F.lit(f"{key} without entry in the lookup: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    kept = F.when(F.col("__known"), F.col(value)).otherwise(missing.cast(lookup.schema[value].dataType))
    return found.withColumn(value, kept).drop("__known")


def merge_splits(rows: DataFrame, mode: str, task: str, episode: str, uid: str, weights: dict | None = None, ratio: float = 0.1, seed: int = 0) -> DataFrame:
    """Rows of several tasks with a ``split`` of train or val, merged.

    Each task's rows are thinned or repeated by its weight (1 if absent) first. ``keep`` leaves
    the split, ``train_only`` drops val rows, ``rebuild`` splits anew by episode over all
    tasks. An episode that is null counts as the empty text.
    """
    if mode not in ("keep", "train_only", "rebuild"):
        raise ValueError(f"unknown mode: {mode}")
    weight = F.coalesce(*[F.when(F.col(task) == k, F.lit(float(w))) for k, w in (weights or {}).items()], F.lit(1.0))
    copies = F.floor(weight) + (hash_uniform(uid, seed) < weight - F.floor(weight)).cast("long")
    got = rows if mode == "rebuild" else rows.filter(F.col("split").isin(["train"] if mode == "train_only" else ["train", "val"]))
    got = got.withColumn("__n", copies).filter("__n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).drop("__n")
    if mode != "rebuild":
        return got
    got = got.drop("split").withColumn("__e", F.coalesce(F.col(episode).cast("string"), F.lit("")))
    return got.join(split_episodes(got.select("__e").distinct(), "__e", ratio, False, seed), "__e").drop("__e")


def append_shifted(old: DataFrame, new: DataFrame, index: str, episode: str, capacity: int) -> DataFrame:
    """A ring buffer after an append: the batch's index and episode, which start at 0, go on from the buffer's last."""
    last = old.agg((F.coalesce(F.max(index), F.lit(-1)) + 1).alias("__i"), (F.coalesce(F.max(episode), F.lit(-1)) + 1).alias("__e"))
    moved = new.join(F.broadcast(last), F.col("__i").isNotNull())  # one row of totals
    moved = moved.withColumn(index, F.col(index) + F.col("__i")).withColumn(episode, F.col(episode) + F.col("__e")).drop("__i", "__e")
    return keep_last_n(old.unionByName(moved), index, capacity)


def read_at(buffer: DataFrame, index: str, wanted: DataFrame, at: str, strict: bool = True) -> DataFrame:
    """Rows of the buffer at positions counted from its oldest row, negative ones from its end.

    The buffer's indices are consecutive; the join is a left one, so that an empty buffer is no
    reason to leave the positions unread. A position outside of it is an error, as is null; unless
    ``strict`` it has no row.
    """
    ends = buffer.agg(F.min(index).alias("__lo"), (F.max(index) + 1).alias("__hi"))
    asked = wanted.join(F.broadcast(ends), F.lit(1) == F.lit(1), "left")  # one row of totals
    place = F.col(at) + F.when(F.col(at) < 0, F.col("__hi")).otherwise(F.col("__lo"))
    inside = place.between(F.col("__lo"), F.col("__hi") - 1)
    if not strict:
        return asked.withColumn("__at", place).drop("__lo", "__hi").join(buffer.withColumnRenamed(index, "__at"), "__at").withColumnRenamed("__at", index)
    wrong = F.raise_error(F.concat(F.lit("position outside of the buffer: "), F.coalesce(F.col(at).cast("string"), F.lit("null")))).cast("long")
    return asked.withColumn("__at", F.when(inside, place).otherwise(wrong)).drop("__lo", "__hi").join(buffer.withColumnRenamed(index, "__at"), "__at", "left").withColumnRenamed("__at", index)
