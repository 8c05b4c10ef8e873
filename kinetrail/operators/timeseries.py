"""Operators over ordered episodes. Every window is partitioned by the episode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .positions import Ordered


def frames(df: DataFrame, episode: str, *order: str) -> DataFrame:
    """Adds the zero-based ``frame_index`` inside each episode."""
    return df.withColumn("frame_index", (F.row_number().over(Window.partitionBy(episode).orderBy(*order)) - 1).cast("long"))


def decimate(df: DataFrame, step: int, frame: str = "frame_index") -> DataFrame:
    """Every ``step``-th frame, from the first; frame numbers are kept."""
    return df.filter(F.col(frame) % step == 0)


def episode_offsets(df: DataFrame, episode: str) -> DataFrame:
    """Half-open global row ranges per episode."""
    lengths = df.groupBy(episode).agg(F.count(F.lit(1)).alias("length"))
    return Ordered(lengths, episode).running_sum("length", "to_index").withColumn("from_index", F.col("to_index") - F.col("length"))


def runs(df: DataFrame, episode: str, key: str, frame: str = "frame_index") -> DataFrame:
    """Maximal runs of equal ``key``: episode, run number, key, first and last frame."""
    by = Window.partitionBy(episode).orderBy(frame)
    new = F.coalesce((~F.col(key).eqNullSafe(F.lag(key).over(by))).cast("int"), F.lit(1))
    numbered = df.withColumn("__new", F.when(F.row_number().over(by) == 1, 1).otherwise(new)).withColumn("run", F.sum("__new").over(by))
    return numbered.groupBy(episode, "run", key).agg(F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"))


def gap_violations(df: DataFrame, episode: str, seconds: str, step: float, tolerance: float, frame: str = "frame_index") -> DataFrame:
    """Frames whose distance from the one before is not ``step`` within the tolerance."""
    gap = F.col(seconds) - F.lag(seconds).over(Window.partitionBy(episode).orderBy(frame))
    return df.withColumn("gap", gap).filter(F.abs(F.col("gap") - step) > tolerance)


def delta_window(df: DataFrame, episode: str, deltas: list[int], values: list[str], frame: str = "frame_index") -> DataFrame:
    """For every frame and delta the row at the clamped frame, with ``is_pad``."""
    last = F.max(frame).over(Window.partitionBy(episode))
    asked = df.select(episode, frame).withColumn("last", last).withColumn("delta", F.explode(F.array(*[F.lit(d) for d in deltas])))
    wanted = F.col(frame) + F.col("delta")
    asked = asked.withColumn("at_frame", F.greatest(F.lit(0), F.least(F.col("last"), wanted))).withColumn("is_pad", (wanted < 0) | (wanted > F.col("last")))
    right = df.select(episode, F.col(frame).alias("at_frame"), *values)
    return asked.join(right, [episode, "at_frame"]).select(episode, frame, "delta", "at_frame", "is_pad", *values)


def horizon_chunk(df: DataFrame, episode: str, value: str, horizon: int, frame: str = "frame_index") -> DataFrame:
    """Values of the next ``horizon`` frames, the tail repeats the last one."""
    over = Window.partitionBy(episode).orderBy(frame).rowsBetween(0, horizon - 1)
    got = F.transform(F.collect_list(F.struct(F.col(value).alias("x"))).over(over), lambda s: s["x"])  # structs keep nulls
    chunk = F.concat(got, F.array_repeat(F.element_at(got, -1), F.lit(horizon) - F.size(got)))
    return df.withColumn("chunk", chunk).withColumn("n_real", F.least(F.lit(horizon), F.size(got)))


def nearest(queries: DataFrame, rows: DataFrame, episode: str, at: str, value: str, key: str, tolerance: float) -> DataFrame:
    """As-of match, nearest either way, inside the episode; ties go to the earlier row.

    Two running windows over the union, one in rising and one in falling order of time;
    each row enters each window once and no pair of rows is ever formed.
    queries (episode, q, at), rows (episode, at, value); key is the query's id.
    """
    both = queries.select(episode, key, F.col(at).alias("__t"), F.lit(None).cast("struct<t:double,v:double>").alias("__r")).unionByName(
        rows.select(episode, F.lit(None).cast(queries.schema[key].dataType).alias(key), F.col(at).alias("__t"), F.struct(F.col(at).cast("double").alias("t"), F.col(value).cast("double").alias("v")).alias("__r"))
    )
    by, upto = Window.partitionBy(episode), (Window.unboundedPreceding, Window.currentRow)
    before = F.last("__r", ignorenulls=True).over(by.orderBy("__t").rangeBetween(*upto))
    after = F.last("__r", ignorenulls=True).over(by.orderBy(F.col("__t").desc()).rangeBetween(*upto))
    found = both.withColumn("__b", before).withColumn("__a", after).filter(F.col(key).isNotNull())
    left, right = F.col("__t") - F.col("__b.t"), F.col("__a.t") - F.col("__t")
    pick = F.when(F.col("__a").isNull() | (left <= right), F.col("__b")).otherwise(F.col("__a"))
    return found.withColumn("__p", pick).select(episode, key, F.col("__p.t").alias("matched_at"), F.col("__p.v").alias("matched_value"), (F.abs(F.col("__p.t") - F.col("__t")) > tolerance).alias("is_pad"))


def velocity(df: DataFrame, episode: str, vector: str, order: str, seconds: Column | None = None, dims: int = 3, freq: float = 5.0) -> DataFrame:
    """Norm of the step of the first ``dims`` components over the time between frames."""
    by = Window.partitionBy(episode).orderBy(order)
    before = F.lag(vector).over(by)
    square = sum(F.pow(F.col(vector)[i].cast("double") - before[i].cast("double"), F.lit(2.0)) for i in range(dims))
    dt = F.greatest(seconds - F.lag(seconds).over(by), F.lit(1e-6)) if seconds is not None else F.lit(1.0 / freq)
    return df.withColumn("velocity", F.sqrt(square) / dt).filter(F.col("velocity").isNotNull())


def low_islands(df: DataFrame, episode: str, value: str, below: float, frame: str = "frame_index", from_frame: int = 0) -> DataFrame:
    """Maximal runs of consecutive frames with ``value`` under the bound; inclusive ends."""
    low = df.filter((F.col(value) < below) & (F.col(frame) >= from_frame))
    island = F.col(frame) - F.row_number().over(Window.partitionBy(episode).orderBy(frame))
    return low.withColumn("__i", island).groupBy(episode, "__i").agg(F.min(frame).alias("start"), F.max(frame).alias("end")).drop("__i")


def merge_islands(islands: DataFrame, episode: str, least: int, gap: int) -> DataFrame:
    """Short islands go first; then neighbours closer than ``gap`` become one."""
    by = Window.partitionBy(episode).orderBy("start")
    kept = islands.filter(F.col("end") - F.col("start") + 1 >= least)
    parted = kept.withColumn("__g", F.sum(F.when(F.col("start") - F.lag("end").over(by) < gap, 0).otherwise(1)).over(by))
    return parted.groupBy(episode, "__g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__g")


def subtask_labels(df: DataFrame, islands: DataFrame, episode: str, parts: int, frame: str = "frame_index") -> DataFrame:
    """Label 0..parts-1 by the first parts-1 island starts; other episodes are skipped."""
    ranked = islands.withColumn("rank", F.row_number().over(Window.partitionBy(episode).orderBy("start"))).filter(F.col("rank") < parts)
    enough = ranked.groupBy(episode).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == parts - 1).select(episode)
    marks = ranked.join(enough, episode, "left_semi").select(episode, F.col("start").alias(frame), F.lit(1).alias("__m"))
    by = Window.partitionBy(episode).orderBy(frame)
    return df.join(enough, episode, "left_semi").join(marks, [episode, frame], "left").withColumn("subtask_index", F.sum(F.coalesce("__m", F.lit(0))).over(by)).drop("__m")


def strided_anchors(df: DataFrame, episode: str, stride: int, horizon: int, frame: str = "frame_index") -> DataFrame:
    """Anchors with a full horizon, their progress, and ``done`` on the last one."""
    length = F.count(F.lit(1)).over(Window.partitionBy(episode))
    got = df.withColumn("length", length).filter((F.col(frame) % stride == 0) & (F.col(frame) < F.col("length") - (horizon - 1)))
    done = F.lead(frame).over(Window.partitionBy(episode).orderBy(frame)).isNull()
    return got.withColumn("progress", F.col(frame) / F.greatest(F.col("length") - 1, F.lit(1))).withColumn("done", done)


def running_state(df: DataFrame, episode: str, is_event: Column, base: int, most: int, frame: str = "frame_index") -> DataFrame:
    """clamp(base + events so far, 0, most), and the state one frame before."""
    by = Window.partitionBy(episode).orderBy(frame)
    state = F.least(F.lit(most), F.greatest(F.lit(0), F.lit(base) + F.sum(is_event.cast("int")).over(by)))
    out = df.withColumn("state", state.cast("int"))
    return out.withColumn("previous_state", F.coalesce(F.lag("state").over(by), F.col("state")))


def sticky(df: DataFrame, episode: str, done: Column, frame: str = "frame_index") -> DataFrame:
    """From the first done frame on, every frame is done."""
    return df.withColumn("sticky_done", F.max(done.cast("int")).over(Window.partitionBy(episode).orderBy(frame)) == 1)


def carry_forward(df: DataFrame, episode: str, value: Column, period: int, frame: str = "frame_index") -> DataFrame:
    """The value of every ``period``-th frame, held until the next; nulls keep the one before."""
    called = F.when(F.col(frame) % period == 0, value)
    return df.withColumn("held", F.last(called, ignorenulls=True).over(Window.partitionBy(episode).orderBy(frame)))


def sticky_note(df: DataFrame, episode: str, done: Column, note: str, text: str, overwrite: bool, name: str, frame: str = "frame_index") -> DataFrame:
    """From the first done frame on ``sticky`` is true and ``name`` is ``text``: everywhere, or only where the note is empty or null."""
    got = df.withColumn("sticky", F.max(F.coalesce(done, F.lit(False))).over(Window.partitionBy(episode).orderBy(frame).rowsBetween(Window.unboundedPreceding, 0)))
    empty = F.coalesce(F.trim(F.col(note)) == "", F.lit(True))
    return got.withColumn(name, F.when(F.col("sticky") & (F.lit(overwrite) | empty), text).otherwise(F.col(note)))


def mark_range(df: DataFrame, low: Column, high: Column, frame: str = "frame_index") -> DataFrame:
    """``moved`` is true for the frames of an inclusive range, given in either order; a soft delete writes the two parts apart."""
    return df.withColumn("moved", F.col(frame).between(F.least(low, high), F.greatest(low, high)))
