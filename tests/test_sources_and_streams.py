"""Readers, writers and streams on small files."""

import json

from pyspark.sql import functions as F

from kinetrail.sources import jsonl, layout
from kinetrail.streaming import streams


def test_jsonl_readers(spark, tmp_path):
    root = tmp_path / "meta"
    root.mkdir()
    lines = ['{"episode_index": 1, "tasks": "a", "length": 3}', "", "{broken", '{"episode_index": 1, "tasks": "b", "length": 4}', '{"episode_index": null, "tasks": "c", "length": 4}']
    (root / "train-00000.jsonl").write_text("\n".join(lines) + "\n")
    rows = jsonl.read_tolerant(spark, str(root), "episode_index int, tasks string, length int")
    bad = rows.filter("error is not null").collect()
    assert [(r["line"], r["raw"]) for r in bad] == [(3, "{broken")] and rows.count() == 4
    kept = jsonl.last_per_key(rows.filter("error is null"), "episode_index").collect()
    assert [(r["episode_index"], r["tasks"]) for r in kept] == [(1, "b")]


def test_sharded_jsonl_and_upsert(spark, tmp_path):
    df = spark.range(25).select("id", (F.col("id") % 2).alias("task"))
    jsonl.write_shards(df, str(tmp_path / "out"), "task", "id", 5)
    back = spark.read.json(str(tmp_path / "out"))
    assert back.count() == 25 and {(r["task"], r["shard"]) for r in back.select("task", "shard").distinct().collect()} == {(t, s) for t in (0, 1) for s in range(3)} - {(1, 3)}


def test_episode_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(e, i, [float(i)] * 3) for e in range(5) for i in range(4)], "episode_index int, frame_index int, state array<double>")
    layout.write_episodes(df, str(tmp_path / "ds"), size=2)
    back = layout.read_episodes(spark, str(tmp_path / "ds"), size=2, episodes=[1, 4])
    assert sorted({r["episode_index"] for r in back.collect()}) == [1, 4] and back.count() == 8
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "episode_chunk" in plan.split("PartitionFilters")[1]


EVENTS = "user long, n long, v double, ts timestamp"


def _files(spark, tmp_path):
    spark.createDataFrame([(u, i, float(i), f"2024-01-01 00:{i:02d}:00") for u in (1, 2) for i in range(10)], "user long, n long, v double, ts string").select("user", "n", "v", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    return streams.read_stream(spark, str(tmp_path / "in"), EVENTS, "10 minutes")


def _run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_stream_windows_and_dedup(spark, tmp_path):
    df = _files(spark, tmp_path)
    got = _run(streams.windowed_counts(df, "ts", "5 minutes", "user", "v"), "win", "complete").collect()
    assert sorted((r["user"], r["n"], r["total"]) for r in got) == [(1, 5, 10.0), (1, 5, 35.0), (2, 5, 10.0), (2, 5, 35.0)]
    assert _run(streams.deduplicated(df, ["n"]), "dedup", "append").count() == 10


def test_stream_states(spark, tmp_path):
    df = _files(spark, tmp_path)
    ring = _run(streams.ring_buffer(df, "user", "n", "v", 3), "ring", "update").collect()
    assert {r["user"]: r["last_values"] for r in ring} == {1: [7.0, 8.0, 9.0], 2: [7.0, 8.0, 9.0]}

    def step(memory, signal):
        if signal == 3.0:
            raise RuntimeError("model failed")
        return f"{memory[:5]}{int(signal)}"

    out = _run(streams.memory_machine(df, "user", "n", "v", step), "machine", "append").filter("user = 1").orderBy("n").collect()
    assert [(r["memory_before"], r["memory"], r["failed"]) for r in out[:5]] == [("START", "START0", False), ("START0", "START1", False), ("START1", "START2", False), ("START2", "START2", True), ("START2", "START4", False)]


def test_upsert_sink(spark, tmp_path):
    df = _files(spark, tmp_path)
    q = streams.upsert_sink(df, str(tmp_path / "table"), str(tmp_path / "cp"), ["user"], "n")
    q.awaitTermination(120)
    assert sorted((r["user"], r["n"]) for r in spark.read.parquet(str(tmp_path / "table")).collect()) == [(1, 9), (2, 9)]


def test_every_query_has_sql_of_the_same_columns(spark):
    import duckdb

    from kinetrail.plans import catalog

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    assert set(catalog.ORACLES) == set(catalog.QUERIES)
    for name, f in catalog.QUERIES.items():
        assert sorted(f(spark, d).columns) == sorted(con.sql(catalog.ORACLES[name]).columns), name
    assert json.dumps(sorted(catalog.QUERIES))
