"""The episode state machine: branches, sticky ends, resets, dead letters, restart, timers."""

import json

import pytest

from kinetrail.streaming import machine, streams

KIND = "ep long, frame long, say string"


@pytest.fixture
def rocks(spark):
    machine.use_state_store(spark)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def detect(memory, signal):
    if signal == "boom":
        raise RuntimeError("no model")
    return signal in ("open", "close", "bad")


def update(memory, signal):
    if signal == "bad":
        raise ValueError("bad update")
    return f"{memory}+{signal}", signal == "close"


def put(spark, path, rows, name):
    spark.createDataFrame(rows, KIND).coalesce(1).write.json(str(path / name))


def steps(spark, path, **more):
    rows = spark.readStream.schema(KIND).json(f"{path}/*")
    return machine.memory_steps(rows, "ep", "frame", "say", detect, update, **more)


def run(query):
    query.awaitTermination(180)
    assert query.exception() is None


def test_branches_and_restart_from_the_checkpoint(rocks, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    put(rocks, src, [(1, 2, "open"), (1, 0, "look"), (1, 1, "boom"), (2, 0, "bad"), (2, 1, "open")], "a")
    run(machine.machine_sink(steps(rocks, src), out, cp))
    put(rocks, src, [(1, 3, "close"), (1, 4, "open"), (1, 5, "RESET"), (1, 6, "open"), (2, 2, "boom")], "b")
    run(machine.machine_sink(steps(rocks, src), out, cp))  # a new query on the old checkpoint
    rows = rocks.read.json(out).orderBy("ep", "step").collect()
    got = [(r["ep"], r["step"], r["mode"], r["memory_before"], r["memory"], r["done"], r["failures"], r["error"]) for r in rows]
    assert got == [
        (1, 0, "DETECT", "START", "START", False, 0, None),
        (1, 1, "FAILED", "START", "START", False, 1, "RuntimeError: no model"),
        (1, 2, "UPDATE", "START", "START+open", False, 1, None),
        (1, 3, "UPDATE", "START+open", "START+open+close", True, 1, None),
        (1, 4, "DONE", "START+open+close", "START+open+close", True, 1, None),
        (1, 5, "RESET", "START+open+close", "START", False, 0, None),
        (1, 6, "UPDATE", "START", "START+open", False, 0, None),
        (2, 0, "FAILED", "START", "START", False, 1, "ValueError: bad update"),
        (2, 1, "UPDATE", "START", "START+open", False, 1, None),
        (2, 2, "FAILED", "START+open", "START+open", False, 2, "RuntimeError: no model"),
    ]
    outcomes = {r["outcome"]: r["n"] for r in rocks.read.json(out).groupBy("outcome").count().withColumnRenamed("count", "n").collect()}
    assert outcomes == {"steps": 7, "failures": 3} and json.dumps(outcomes)


def test_an_idle_episode_is_forgotten(rocks, tmp_path):
    import time

    src, out = tmp_path / "in", tmp_path / "out"
    put(rocks, src, [(1, 0, "open")], "a")
    query = machine.machine_sink(steps(rocks, src, idle_ms=1), str(out), str(tmp_path / "cp"), processingTime="200 milliseconds")
    found, sent, until = set(), False, time.time() + 150
    try:
        while time.time() < until and len(found) < 3:
            time.sleep(1)
            assert query.exception() is None
            if list(out.glob("outcome=steps/*.json")):
                found = {(r["mode"], r["memory_before"]) for r in rocks.read.schema("ep long, mode string, memory_before string").json(str(out)).collect()}
            if ("EXPIRED", "START+open") in found and not sent:
                sent = True
                put(rocks, src, [(1, 9, "look")], "b")
    finally:
        query.stop()
    assert found >= {("UPDATE", "START"), ("EXPIRED", "START+open"), ("DETECT", "START")}


def test_upserts_rewrite_their_shards(spark, tmp_path):
    src = tmp_path / "in"
    for name, rows in (("a", [(1, 1, "x"), (2, 5, "y")]), ("b", [(1, 3, "z"), (2, 4, "late")])):
        put(spark, src, rows, name)
        stream = spark.readStream.schema(KIND).json(f"{src}/*")
        run(streams.upsert_sink(stream, str(tmp_path / "t"), str(tmp_path / "cp"), ["ep"], "frame", 4))
    got = spark.read.parquet(str(tmp_path / "t")).select("ep", "frame", "say").collect()
    assert sorted(map(tuple, got)) == [(1, 3, "z"), (2, 5, "y")]
