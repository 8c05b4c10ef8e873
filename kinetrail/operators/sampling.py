"""Splits, samples and weights that depend on keys and a seed, not on row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import hash_key, hash_uniform
from .positions import numbered


def hash_rank(df: DataFrame, group: str, key: str, seed: int | str = 0, name: str = "rank", ties: tuple[str, ...] = ()) -> DataFrame:
    """Rank from 0 inside each group in order of the key's hash, and the group's size in ``{name}_of``.

    The first three hex digits of the hash cut a group into 4,096 slices. Their counts are
    summed up, rows are numbered inside a slice, so a group of a third of all rows is spread
    over that many keys. Rows with one key are in order of ``ties``. Rows with a null group go.
    """
    got = df.withColumn("__h", hash_key(key, seed)).withColumn("__s", F.substring("__h", 1, 3))
    slices = got.groupBy(group, "__s").agg(F.count(F.lit(1)).alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(group).orderBy("__s").rowsBetween(Window.unboundedPreceding, 0))
    slices = slices.select(group, "__s", (upto - F.col("__c")).alias("__from"), F.sum("__c").over(Window.partitionBy(group)).alias(f"{name}_of"))
    inside = F.row_number().over(Window.partitionBy(group, "__s").orderBy("__h", key, *ties)) - 1
    return got.withColumn("__i", inside).join(slices, [group, "__s"]).withColumn(name, F.col("__from") + F.col("__i")).drop("__h", "__s", "__i", "__from")


def interval_sample(df: DataFrame, key: str, block: int, per_block: int, seed: int = 0) -> DataFrame:
    """``per_block`` rows of every block of consecutive ids."""
    by = Window.partitionBy(F.floor(F.col(key) / block)).orderBy(hash_key(key, seed), key)
    return df.withColumn("__r", F.row_number().over(by)).filter(F.col("__r") <= per_block).drop("__r")


def split_episodes(episodes: DataFrame, key: str, ratio: float, half_even: bool = True, seed: int = 0) -> DataFrame:
    """Marks the first n * ratio episodes of a seeded shuffle as ``val``, the others as ``train``.

    Ranks come from ``hash_rank``, so no task holds all episodes.
    """
    got = hash_rank(episodes.withColumn("__all", F.lit(0)), "__all", key, seed, "__rank")
    size = F.rint(F.col("__rank_of") * F.lit(ratio)) if half_even else F.floor(F.col("__rank_of") * F.lit(ratio))
    return got.withColumn("split", F.when(F.col("__rank") < size, "val").otherwise("train")).drop("__all", "__rank", "__rank_of")


def resample(df: DataFrame, key: str, weight: float, seed: int = 0) -> DataFrame:
    """Under 1 each row stays with that chance; above, whole copies and one by chance."""
    whole = int(weight)
    copies = F.lit(whole) + (hash_uniform(key, seed) < F.lit(weight - whole)).cast("int")
    return df.withColumn("copies", copies).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")


def keep_first(df: DataFrame, uid: str, order: str) -> DataFrame:
    """First row of each uid; rows with an empty uid all stay, a null uid counts as one value.

    A grouped minimum, combined on the map side, so that a frequent uid is no window.
    """
    first = df.filter(~F.col(uid).eqNullSafe("")).groupBy(F.coalesce(F.col(uid), F.lit("None")).alias("__u")).agg(F.min_by(F.struct(*df.columns), F.struct(order)).alias("__first"))
    named = first.select("__first.*")
    return named.unionByName(df.filter(F.col(uid).eqNullSafe("")))


def negatives(df: DataFrame, episode: str, event_frame: str, gap: int, n: int, frame: str = "frame_index", seed: int = 0) -> DataFrame:
    """Frames before the event at a stride, at most ``n`` (all if n <= 0) by seeded rank."""
    pool = df.filter((F.col(frame) < F.col(event_frame)) & (F.col(frame) % gap == 0))
    if n <= 0:
        return pool
    by = Window.partitionBy(episode).orderBy(hash_key(F.concat_ws("-", F.col(episode), F.col(frame)), seed), frame)
    return pool.withColumn("__r", F.row_number().over(by)).filter(F.col("__r") <= n).drop("__r")


def mixed_batches(df: DataFrame, label: str, key: str, quota: dict, epoch: int = 0) -> DataFrame:
    """Batches with a fixed number of rows per label, without replacement, while all pools last.

    The rank of a row among its label decides its batch; a batch stays if complete.
    """
    size = F.coalesce(*[F.when(F.col(label) == k, F.lit(n)) for k, n in quota.items()])
    ranked = hash_rank(df.withColumn("__n", size).filter("__n is not null"), label, key, epoch, "__k")
    placed = ranked.withColumn("batch", F.floor(F.col("__k") / F.col("__n"))).drop("__k", "__k_of")
    whole = placed.groupBy("batch").agg(F.count(F.lit(1)).alias("__c")).filter(F.col("__c") == sum(quota.values())).select("batch")
    return placed.join(whole, "batch", "left_semi").drop("__n")


def mixed_draws(df: DataFrame, label: str, key: str, quota: dict, batches: int, seed: int = 0) -> DataFrame:
    """``batches`` batches with a fixed number of rows per label, drawn with replacement.

    A slot's number is the hash of (batch, label, slot) scaled to the pool; pools are numbered
    by ``hash_rank``. A label without rows gives no row.
    """
    pools = hash_rank(df.filter(F.col(label).isin(list(quota))), label, key, seed, "__k")
    sizes = pools.groupBy(label).agg(F.max("__k_of").alias("__n"))
    wanted = F.array(*[F.struct(F.lit(k).alias(label), F.lit(s).alias("slot")) for k, n in quota.items() for s in range(n)])
    slots = df.sparkSession.range(batches).select(F.col("id").alias("batch"), F.explode(wanted).alias("w")).select("batch", f"w.{label}", "w.slot")
    at = F.floor(hash_uniform(F.concat_ws("-", "batch", label, "slot"), seed) * F.col("__n"))
    return slots.join(F.broadcast(sizes), label).withColumn("__k", at).join(pools.drop("__k_of"), [label, "__k"]).drop("__k", "__n")  # one size per label of the quota


def drop_edges(df: DataFrame, episode: str, first: int, last: int, frame: str = "frame_index", only: list | None = None) -> DataFrame:
    """Rows without the first and last frames of their episode, of the episodes in ``only`` (all, if None)."""
    length = F.count(F.lit(1)).over(Window.partitionBy(episode))
    df = df if only is None else df.filter(F.col(episode).isin(list(only)))
    return df.withColumn("__l", length).filter((F.col(frame) >= first) & (F.col(frame) < F.col("__l") - last)).drop("__l")


def sampler_weights(df: DataFrame, group: Column, valid: Column, ratios: dict) -> DataFrame:
    """Valid rows share their group's ratio evenly, others weigh 0; all-zero means uniform."""
    got = df.withColumn("__g", group).withColumn("__v", valid.cast("int"))
    sums = got.groupBy("__g").agg(F.sum("__v").alias("n_valid"), F.count(F.lit(1)).alias("__n"))
    ratio = F.coalesce(*[F.when(F.col("__g") == k, F.lit(float(r))) for k, r in ratios.items()], F.lit(0.0))
    sums = sums.withColumn("__r", F.when(F.col("n_valid") > 0, ratio).otherwise(0.0))
    every = Window.partitionBy()
    sums = sums.withColumn("__total", F.sum("__r").over(every)).withColumn("__rows", F.sum("__n").over(every))
    share = F.when(F.col("__total") == 0, 1.0 / F.col("__rows")).when(F.col("__v") == 1, F.col("__r") / F.col("__total") / F.col("n_valid")).otherwise(0.0)
    return got.join(F.broadcast(sums), "__g").withColumn("weight", share).drop("__g", "__v", "n_valid", "__n", "__r", "__total", "__rows")  # one row per group of ``ratios`` and the rest


def stride_shard(df: DataFrame, order: str, rank: int, world: int) -> DataFrame:
    """Rows rank, rank + world, ... of a table in order."""
    return numbered(df, order, name="__i").filter(F.col("__i") % world == rank).drop("__i")


def weighted_order(df: DataFrame, by: str, key: str, weight: Column, n: int, seed: int = 0) -> DataFrame:
    """n rows per group without replacement, chances in proportion to weight (-ln(u) / w)."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(-F.log(hash_uniform(key, seed) + F.lit(1e-12)) / weight, key))
    return df.withColumn("__r", rank).filter(F.col("__r") <= n).drop("__r")


def permuted(df: DataFrame, key: str, seed: int = 0, name: str = "position") -> DataFrame:
    """All rows numbered from 0 in a seeded shuffle, by ranges of the key's hash; one seed an epoch."""
    mixed = df.withColumn("__h", hash_key(key, seed))
    return numbered(mixed, "__h", key, name=name).drop("__h")
