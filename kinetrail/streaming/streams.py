"""Structured Streaming forms of the stateful operators.

The transforms are the same for batch and stream unless a state is needed; states
are kept per episode and bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, path: str, schema, watermark: str | None = None, ts: str = "ts") -> DataFrame:
    """A stream of parquet files with event time ``ts`` as a timestamp."""
    rows = spark.readStream.schema(schema).parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))
    return rows.withWatermark(ts, watermark) if watermark else rows


def windowed_counts(df: DataFrame, ts: str, length: str, by: str, value: str, slide: str | None = None) -> DataFrame:
    """Counts and sums per window of event time and key."""
    over = F.window(ts, length, slide) if slide else F.window(ts, length)
    return df.groupBy(over.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(df: DataFrame, ts: str, gap: str, by: str) -> DataFrame:
    return df.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", by, "n")


def deduplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """First row per key within the watermark."""
    return df.dropDuplicatesWithinWatermark(keys)


def ring_buffer(df: DataFrame, episode: str, order: str, value: str, capacity: int) -> DataFrame:
    """The last ``capacity`` values of each episode after every trigger."""

    def update(key, batches: Iterator, state: GroupState):
        import pandas as pd

        held = list(zip(*state.get)) if state.exists else []
        for b in batches:
            held += list(zip(b[order].tolist(), b[value].tolist()))
        held = sorted(held)[-capacity:]
        state.update(([h[0] for h in held], [h[1] for h in held]))
        yield pd.DataFrame({episode: [key[0]], "last_orders": [[h[0] for h in held]], "last_values": [[h[1] for h in held]]})

    rows = df.select(episode, F.col(order).cast("long").alias(order), F.col(value).cast("double").alias(value))
    kind = rows.schema[episode].dataType.simpleString()
    return rows.groupBy(episode).applyInPandasWithState(update, f"{episode} {kind}, last_orders array<long>, last_values array<double>", "orders array<long>, vals array<double>", "update", GroupStateTimeout.NoTimeout)


def memory_machine(df: DataFrame, episode: str, order: str, signal: str, step: Callable[[str, str], str], start: str = "START") -> DataFrame:
    """A state per episode, moved by ``step(memory, signal)`` in order of frames.

    ``step`` stands for the model call; an exception keeps the state and marks the row
    failed. Rows of one trigger are taken in order, later triggers go on from there.
    """

    def update(key, batches: Iterator, state: GroupState):
        import pandas as pd

        memory = state.get[0] if state.exists else start
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for at, s in zip(rows[order], rows[signal]):
            failed, before = False, memory
            try:
                memory = step(memory, s)
            except Exception:  # noqa: BLE001 the caller's model may fail in any way
                failed = True
            out.append((key[0], at, before, memory, failed))
        state.update((memory,))
        yield pd.DataFrame(out, columns=[episode, order, "memory_before", "memory", "failed"])

    types = {c: df.schema[c].dataType.simpleString() for c in (episode, order)}
    return df.select(episode, order, signal).groupBy(episode).applyInPandasWithState(update, f"{episode} {types[episode]}, {order} {types[order]}, memory_before string, memory string, failed boolean", "memory string", "append", GroupStateTimeout.NoTimeout)


def upsert_sink(df: DataFrame, path: str, checkpoint: str, keys: list[str], order: str, shards: int = 16):
    """Keep-latest table in hash-bucketed shards; a trigger rewrites the shards of its keys only.

    A trigger that is repeated after a loss gives the same table.
    """
    from ..sources.shards import upsert

    def write(batch: DataFrame, number: int) -> None:
        upsert(batch, path, keys, order, shards)

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
