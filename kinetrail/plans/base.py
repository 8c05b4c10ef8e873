"""Registration of queries, and the views of the tables that they share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.timeseries import frames

QUERIES: dict = {}
ORACLES: dict = {}

#: Frames of an episode: the events of a user in order of time.
FR = "fr AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index, epoch_us(ts) / 1e6 AS t FROM events)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def read(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def event_frames(spark, d: str, *columns: str) -> DataFrame:
    """events with frame_index and seconds ``t``; only the asked columns are read."""
    cols = dict.fromkeys(["event_id", "user_id", "ts", *columns])
    df = read(spark, d, "events").select(*cols).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return frames(df, "user_id", "ts", "event_id")


def r6(x, name: str):
    return F.round(x, 6).alias(name)
