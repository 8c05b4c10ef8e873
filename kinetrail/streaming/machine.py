"""A state machine per episode with two branches, sticky ends, resets and dead letters.

Each row of an episode is a step. ``detect`` says whether the memory changes at it, ``update`` gives the
new memory and whether the episode is done; both stand for model calls and are passed in. The memory,
whether it is done and the last step are a value state; failures are a list state, counted in every
row and dropped after ``keep_failures`` milliseconds. An idle timer forgets an episode; a query with
timers never runs out of batches, so it needs a trigger that goes on, not ``availableNow``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "step long, mode string, memory_before string, memory string, done boolean, failures int, error string"


def use_state_store(spark: SparkSession) -> None:
    """States with timers and time to live need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class MemoryMachine(StatefulProcessor):
    def __init__(self, detect: Callable, update: Callable, start: str, reset: str, idle_ms: int | None, keep_failures: int | None):
        self.detect, self.update, self.start, self.reset = detect, update, start, reset
        self.idle_ms, self.keep_failures = idle_ms, keep_failures

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("memory", "memory string, done boolean, step long")
        self.failures = handle.getListState("failures", "step long, error string", self.keep_failures)

    def _rows(self, key, rows):
        import pandas as pd

        return pd.DataFrame([(*key, *r) for r in rows], columns=["key", *[c.split()[0] for c in OUTPUT.split(", ")]])

    def _timer(self, now: int) -> None:
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(now + self.idle_ms)

    def handleInputRows(self, key, rows: Iterator, timerValues):
        import pandas as pd

        memory, done, last = self.state.get() if self.state.exists() else (self.start, False, None)
        failed = len(list(self.failures.get()))
        batch = pd.concat(list(rows)).sort_values("step", kind="stable")
        out = []
        for step, signal in zip(batch["step"].tolist(), batch["signal"].tolist()):
            before, mode, error = memory, "DETECT", None
            if signal == self.reset:
                memory, done, mode, failed = self.start, False, "RESET", 0
                self.failures.clear()
            elif done:
                mode = "DONE"  # sticky: nothing moves an episode that is done, but a reset
            else:
                try:
                    if self.detect(memory, signal):
                        mode = "UPDATE"
                        memory, done = self.update(memory, signal)
                except Exception as x:  # noqa: BLE001 the caller's model may fail in any way
                    memory, mode, error, failed = before, "FAILED", f"{type(x).__name__}: {x}", failed + 1
                    self.failures.appendValue((step, error))
            last = step
            out.append((step, mode, before, memory, done, failed, error))
        self.state.update((memory, done, last))
        self._timer(timerValues.getCurrentProcessingTimeInMs())
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        memory, done, last = self.state.get() if self.state.exists() else (self.start, False, None)
        self.state.clear()
        self.failures.clear()
        yield self._rows(key, [(last, "EXPIRED", memory, self.start, done, 0, None)])

    def close(self) -> None:
        pass


def memory_steps(df: DataFrame, episode: str, step: str, signal: str, detect: Callable[[str, str], bool], update: Callable[[str, str], tuple[str, bool]], start: str = "START", reset: str = "RESET", idle_ms: int | None = None, keep_failures: int | None = None) -> DataFrame:
    """One row per step: mode (DETECT, UPDATE, DONE, RESET, FAILED, EXPIRED), memory before and after, error.

    The steps of one trigger are taken in their order. An exception of ``detect`` or ``update`` keeps
    the memory; its row is a dead letter beside the results (``machine_sink`` writes both).
    """
    rows = df.selectExpr(f"`{episode}` as key", f"cast(`{step}` as long) as step", f"cast(`{signal}` as string) as signal")
    machine = MemoryMachine(detect, update, start, reset, idle_ms, keep_failures)
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.groupBy("key").transformWithStateInPandas(machine, f"key {kind}, {OUTPUT}", "append", "none" if idle_ms is None else "processingTime")
    return out.withColumnRenamed("key", episode)


def machine_sink(steps: DataFrame, path: str, checkpoint: str, **trigger):
    """Results and dead letters as JSON lines in ``outcome=steps`` and ``outcome=failures``, each step once."""
    rows = steps.selectExpr("*", "case when error is null then 'steps' else 'failures' end as outcome")
    return rows.writeStream.format("json").partitionBy("outcome").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
