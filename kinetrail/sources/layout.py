"""Where episodes, videos and metadata of a dataset lie."""

from pyspark.sql import Column, Observation
from pyspark.sql import functions as F


def chunk_of(episode: Column, size: int) -> Column:
    return F.floor(episode / size)


def data_path(episode: Column, size: int) -> Column:
    return F.format_string("data/chunk-%03d/episode_%06d.parquet", chunk_of(episode, size), episode)


def video_path(episode: Column, size: int, key: str) -> Column:
    return F.format_string(f"videos/chunk-%03d/{key}/episode_%06d.mp4", chunk_of(episode, size), episode)


def episode_of(path: Column) -> Column:
    """Episode number of a data or video path, null for other paths."""
    return F.nullif(F.regexp_extract(path, r"episode_(\d+)\.[a-z0-9]+$", 1), F.lit("")).cast("int")


def write_episodes(df, path: str, size: int, episode: str = "episode_index", frame: str = "frame_index", seen: dict | None = None, together: int = 1) -> dict:
    """Frames as parquet under one folder per chunk; an episode is in one file, in order.

    Up to ``together`` episodes of a chunk, by number, go to one task, so that a chunk of short episodes is
    not a file of every task.

    ``seen`` names aggregates that the write job itself computes, behind its shuffle, so that a map task
    that runs twice counts once; their values are returned.
    """
    rows = df.withColumn("episode_chunk", chunk_of(F.col(episode), size))
    rows = rows.repartition("episode_chunk", F.floor(F.pmod(F.col(episode), F.lit(size)) / together)).sortWithinPartitions("episode_chunk", episode, frame)
    watched = Observation() if seen else None
    if watched:
        rows = rows.observe(watched, *[x.alias(k) for k, x in seen.items()])
    rows.write.partitionBy("episode_chunk").parquet(f"{path}/data")
    return watched.get if watched else {}


def read_lengths(spark, path: str, episode: str = "episode_index"):
    """Episode and length of what lies there, in order; one column is read."""
    return spark.read.parquet(f"{path}/data").groupBy(episode).agg(F.count(F.lit(1)).alias("length")).orderBy(episode)


def read_episodes(spark, path: str, size: int, episodes: list[int] | None = None, episode: str = "episode_index"):
    """Frames of all or of the listed episodes; the list also prunes chunk folders."""
    rows = spark.read.parquet(f"{path}/data")
    if episodes is None:
        return rows
    return rows.filter(F.col("episode_chunk").isin(sorted({e // size for e in episodes})) & F.col(episode).isin(episodes))
