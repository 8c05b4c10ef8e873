"""A table of frames as a dataset of the layout: data by chunk, tasks, episodes and an info object.

``root/data`` holds the frames with frame_index and task_index, ``root/meta/tasks`` and
``root/meta/episodes`` JSON lines, ``root/meta/info.json`` the totals. The info object is written last, so a
folder without it is an unfinished conversion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.positions import checkpointed
from ..operators.stats import dictionary
from ..operators.timeseries import frames
from . import layout
from .files import delete, is_folder
from .jsonl import append_lines, write_object

FILE_ROWS = 1_000_000  # of a data file, if episodes are of about the same length


def _with_task(rows: DataFrame, episode: str, task: str | None, by_episode: DataFrame | None, column: str | None) -> DataFrame:
    given = [x is not None for x in (task, by_episode, column)]
    if sum(given) != 1:
        raise ValueError("give one of task, by_episode and column")
    if task is not None:
        return rows.withColumn("task", F.lit(task))
    if column is not None:
        return rows.withColumn("task", F.col(column))
    return rows.join(by_episode.select(F.col(episode), F.col("task")), episode, "left")


def convert(df: DataFrame, root: str, episode: str, order: list[str], chunk: int, version: str, fps: float, task: str | None = None, by_episode: DataFrame | None = None, column: str | None = None) -> dict:
    """Writes the dataset and returns its info object.

    The task of a frame is one text for all, its episode's (``by_episode``: the episode's column and ``task``, one row
    each) or that of a column; tasks are numbered by first appearance in order of episodes and frames. Episodes must
    be 0, 1, 2, ... without a gap and every frame needs a task; the write job counts that, and what breaks it is an
    error and leaves no folder. An empty table is an error too, and so is an existing folder.
    """
    spark = df.sparkSession
    if is_folder(spark, root):
        raise FileExistsError(root)
    rows = checkpointed(frames(_with_task(df, episode, task, by_episode, column), episode, *order))
    place = rows.filter("task is not null").withColumn("__o", F.struct(F.col(episode), F.col("frame_index")))
    tasks = checkpointed(dictionary(place, "task", "__o").select(F.col("code").cast("long").alias("task_index"), "task"))
    whole = rows.join(tasks, "task", "left").drop("task")
    number = F.col(episode)
    sizes = rows.agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("frame_index") == 0).alias("episodes")).first()
    together = max(1, min(chunk, FILE_ROWS * sizes["episodes"] // max(sizes["frames"], 1)))
    seen = layout.write_episodes(whole, root, chunk, episode, together=together, seen={
        "frames": F.count(F.lit(1)),
        "episodes": F.count_if(F.col("frame_index") == 0),
        "low": F.min(number),
        "high": F.max(number),
        "unnumbered": F.count_if(number.isNull()),
        "untasked": F.count_if(F.col("task_index").isNull()),
    })
    try:
        if not seen["frames"]:
            raise ValueError("no frames")
        if seen["unnumbered"] or seen["low"] != 0 or seen["high"] + 1 != seen["episodes"]:
            raise ValueError(f"episodes are not 0 to {seen['episodes'] - 1}: from {seen['low']} to {seen['high']}, {seen['unnumbered']} frames without one")
        if seen["untasked"]:
            raise ValueError(f"{seen['untasked']} frames without a task")
        back = spark.read.parquet(f"{root}/data")
        first = back.groupBy(episode, "task_index").agg(F.min("frame_index").alias("__f"), F.count(F.lit(1)).alias("__n"))
        listed = first.join(tasks, "task_index").groupBy(episode).agg(F.array_sort(F.collect_list(F.struct("__f", "task"))).alias("__t"), F.sum("__n").alias("length"))  # tasks of one episode
        listed = listed.select(F.col(episode).alias("episode_index"), F.transform("__t", lambda t: t["task"]).alias("tasks"), "length")
        append_lines(listed.repartitionByRange("episode_index").sortWithinPartitions("episode_index"), f"{root}/meta/episodes")
        append_lines(tasks.repartitionByRange("task_index").sortWithinPartitions("task_index"), f"{root}/meta/tasks")
        made = spark.read.schema("episode_index long, length long").json(f"{root}/meta/episodes").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("frames")).first()
        if made["n"] != seen["episodes"] or made["frames"] != seen["frames"]:
            raise ValueError(f"{made['n']} episodes of {made['frames']} frames lie there, {seen['episodes']} of {seen['frames']} were written")
    except Exception:
        delete(spark, root)
        raise
    info = {
        "version": version,
        "total_episodes": seen["episodes"],
        "total_frames": seen["frames"],
        "total_tasks": tasks.count(),
        "total_chunks": -(-seen["episodes"] // chunk),
        "chunks_size": chunk,
        "fps": fps,
        "splits": {"train": f"0:{seen['episodes']}"},
        "features": {f.name: {"dtype": f.dataType.simpleString(), "shape": [1]} for f in whole.schema.fields},
    }
    write_object(spark, f"{root}/meta/info.json", info)
    return info
