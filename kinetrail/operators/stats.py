"""Feature statistics that can be stored per episode and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import log_reward, sample_count
from .positions import Ordered, affine_scan, numbered


def scalar_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """min, max, mean, population std and count; NaN counts as missing."""
    x = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    return df.groupBy(*by).agg(F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.count(x).alias("count"))


def vector_stats(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """``scalar_stats`` per vector position."""
    return scalar_stats(df.select(*by, F.posexplode(vector).alias("pos", "x")), [*by, "pos"], "x")


def merge_stats(stats: DataFrame, by: list[str]) -> DataFrame:
    """Statistics of the union from stored parts (parallel variance).

    Two grouped sums, the second around the merged mean, so nothing is collected and no
    digits are lost where the mean is large against the spread.
    """
    n = F.col("count")
    means = stats.groupBy(*by).agg((F.sum(F.col("mean") * n) / F.sum(n)).alias("__m")).select(*[F.col(c).alias(f"__{c}") for c in by], "__m")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    parts = stats.join(means, same) if by else stats.crossJoin(means)  # one row of totals
    spread = F.sum((F.col("std") * F.col("std") + F.pow(F.col("mean") - F.col("__m"), F.lit(2.0))) * n)
    total = F.sum(n)
    return parts.groupBy(*by).agg(F.min("min").alias("min"), F.max("max").alias("max"), F.first("__m").alias("mean"), F.sqrt(spread / total).alias("std"), total.alias("count"))


def square_sum_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """sqrt(E[x*x] - E[x]**2), never below zero."""
    x = F.col(value).cast("double")
    return df.groupBy(*by).agg(F.avg(x).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.avg(x * x) - F.avg(x) * F.avg(x))).alias("std"))


def dictionary(df: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values numbered in order of first appearance."""
    return numbered(df.groupBy(value).agg(F.min(order).alias("first_at")), "first_at", value, name="code")


def first_values(df: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """Per group the first value and all distinct values in order of appearance."""
    each = df.groupBy(by, value).agg(F.min(order).alias("__o"))
    pairs = F.array_sort(F.collect_list(F.struct("__o", value)))
    return each.groupBy(by).agg(F.min_by(value, "__o").alias("first_value"), F.transform(pairs, lambda s: s[value]).alias("all_values"))


def histogram(df: DataFrame, value: str, missing: str = "UNKNOWN") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(value).cast("string"), F.lit(missing)).alias(value)).agg(F.count(F.lit(1)).alias("n"))


def switch_rate(df: DataFrame, episode: str, choice: str, order: str) -> DataFrame:
    """Switches between neighbours over steps; the first step of an episode never switches."""
    changed = F.col(choice) != F.lag(choice).over(Window.partitionBy(episode).orderBy(order))
    return df.withColumn("__s", F.coalesce(changed, F.lit(False)).cast("int")).groupBy(episode).agg(F.sum("__s").alias("switches"), F.avg("__s").alias("switch_rate"), F.count(F.lit(1)).alias("steps"))


def shares(df: DataFrame, by: str, ids: DataFrame) -> DataFrame:
    """Count and share of each id of a small list, zero where absent, and the largest share."""
    counts = ids.join(df.groupBy(by).agg(F.count(F.lit(1)).alias("n")), by, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    everything = Window.partitionBy()
    total = F.greatest(F.lit(1), F.sum("n").over(everything))
    return counts.withColumn("share", F.col("n") / total).withColumn("max_share", F.max(F.col("n") / total).over(everything))


def cumulative_share(df: DataFrame, by: str, pos: str, value: str, tau: float) -> DataFrame:
    """Positions by falling value whose squared share sums to at most ``tau``; the first always."""
    square = F.col(value).cast("double") * F.col(value).cast("double")
    order = Window.partitionBy(by).orderBy(F.col(value).desc(), pos)
    upto = F.sum(square).over(order.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum(square).over(Window.partitionBy(by))
    return df.withColumn("rank", F.row_number().over(order)).withColumn("kept", (F.col("rank") == 1) | (upto <= tau * whole))


def decayed_mean(df: DataFrame, by: str, order: str, value: Column, m: float) -> DataFrame:
    """sum(exp(-m i) x_i) / sum(exp(-m i)) over rows i of a group."""
    i = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    return df.select(by, F.exp(-m * i).alias("w"), value.alias("x")).groupBy(by).agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("ensemble"))


def advantages(df: DataFrame, episode: str, order: str, reward: Column, value: Column, gamma: float, lam: float, done: Column | None = None) -> DataFrame:
    """Backward scan A_t = d_t + gamma lam A_{t+1} per episode, with returns A + V.

    d_t = r_t + gamma V_{t+1} - V_t. At the last step of an episode, and where ``done`` is true,
    nothing of the next step counts; a null ``done`` is false. Null or NaN rewards or values make the
    steps before them null, back to the last end. The scan runs over blocks of positions
    in the order of all rows (``positions.affine_scan``), so an episode may span many tasks.
    """
    number = lambda x: F.nanvl(x.cast("double"), F.lit(None).cast("double"))
    rows = df.select(F.col(episode).alias("__e"), F.col(order).alias("__t"), number(reward).alias("__r"), number(value).alias("__v"), (F.lit(False) if done is None else F.coalesce(done, F.lit(False))).alias("__d"))
    placed = Ordered(rows, "__e", "__t")
    got = placed.neighbours(["__e", "__v"], previous=None, following="__n", position="__p")
    goes_on = F.col("__n").isNotNull() & F.col("__n.__e").eqNullSafe(F.col("__e")) & ~F.col("__d")
    step = F.col("__r") + F.when(goes_on, gamma * F.col("__n.__v")).otherwise(0.0) - F.col("__v")
    got = got.withColumn("__b", step).withColumn("__a", F.when(goes_on, F.lit(gamma * lam)).otherwise(0.0)).drop("__n", "__r", "__d")
    out = affine_scan(got, "__p", placed.count, F.col("__a"), F.col("__b"), "advantage")
    return out.select(F.col("__e").alias(episode), F.col("__t").cast("int").alias(order), "advantage", (F.col("advantage") + F.col("__v")).alias("ret"))


def rollout_stats(df: DataFrame, episode: str, order: str, choice: str, loss: Column, weight: float) -> DataFrame:
    """Steps, reward sum and means of reward and its two parts, switches and their rate: per episode, and of all rows.

    The fit is -ln of the loss (at least 1e-6), a switch costs ``weight``; ``level`` is ``episode`` or ``all``. A step
    with a null or NaN loss counts among steps and switches, not in the sums. Without rows there is no
    row at all. Neighbours come from one order of all rows, so an episode may span many tasks.
    """
    number = F.nanvl(loss.cast("double"), F.lit(None).cast("double"))
    rows = df.select(F.col(episode).alias("__e"), F.col(order).alias("__t"), F.col(choice).alias("__c"), number.alias("__l"))
    got = Ordered(rows, "__e", "__t").neighbours(["__e", "__c"], following=None)
    switched = F.col("previous").isNotNull() & F.col("previous.__e").eqNullSafe(F.col("__e")) & ~F.col("previous.__c").eqNullSafe(F.col("__c"))
    parts = got.select("__e", switched.cast("int").alias("__s"), F.when(F.col("__l").isNotNull(), log_reward(F.col("__l"), F.lit(False), weight)).alias("__f"), F.when(F.col("__l").isNotNull(), -weight * switched.cast("double")).alias("__k"))
    reward = F.col("__f") + F.col("__k")
    sums = [F.count(F.lit(1)).alias("steps"), F.sum(reward).alias("reward_sum"), F.avg(reward).alias("reward_mean"), F.avg("__f").alias("fit_mean"), F.avg("__k").alias("cons_mean"), F.sum("__s").alias("switches"), F.avg("__s").alias("switch_rate")]
    out = parts.rollup("__e").agg(F.grouping("__e").alias("__g"), *sums)
    return out.select(F.when(F.col("__g") == 0, "episode").otherwise("all").alias("level"), F.col("__e").alias(episode), *out.columns[2:])


def sampled(frame: Column, length: Column, least: int = 100, most: int = 10_000, power: float = 0.75) -> Column:
    """True for the evenly spaced frames of an episode of ``length`` that its statistics read.

    There are ``sample_count`` of them from the first to the last, rounded half to even. They lie one
    frame apart or more, so a frame can only be the one of its own nearest slot; no list of frames is made.
    """
    n = sample_count(length, least, most, power)
    step = (length - 1).cast("double") / F.greatest(n - 1, F.lit(1))
    slot = F.round(frame / F.when(step > 0, step))
    return F.coalesce((F.bround(slot * step) == frame) & (slot < n), frame == 0)


def backfill(df: DataFrame, known: DataFrame, episode: str, full: list[str], sparse: list[str], frame: str = "frame_index", **counts) -> DataFrame:
    """Statistics per (episode, feature) of episodes that ``known`` lacks: of all frames for ``full``, of sampled ones for ``sparse``.

    Rows are in order of episode and feature, ranges of episodes a partition. Frames are numbered from 0. NaN counts as missing.
    """
    todo = df.select(episode, frame, *full, *sparse).join(known.select(episode).distinct(), episode, "left_anti")
    lengths = todo.groupBy(episode).agg(F.count(F.lit(1)).alias("__n"))
    rows = todo.join(lengths, episode)
    read = sampled(F.col(frame), F.col("__n"), **counts)
    values = [F.struct(F.lit(c).alias("feature"), F.lit(True).alias("read"), F.col(c).cast("double").alias("x")) for c in full]
    values += [F.struct(F.lit(c).alias("feature"), read.alias("read"), F.col(c).cast("double").alias("x")) for c in sparse]
    long = rows.select(episode, F.explode(F.array(*values)).alias("v")).filter("v.read").select(episode, "v.feature", "v.x")
    return scalar_stats(long, [episode, "feature"], "x").repartitionByRange(episode, "feature").sortWithinPartitions(episode, "feature")
