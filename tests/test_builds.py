"""Merges, draws, buffers, parsers and sinks on small tables, with their errors."""

import json

import pytest
from pyspark.sql import functions as F

from kinetrail.functions import jsontext as J
from kinetrail.functions import text as X
from kinetrail.operators import memory, merge, quality, sampling, scoring
from kinetrail.plans import builds
from kinetrail.plans.training_rows import spec_table
from kinetrail.sources import sinks


def one(spark, column):
    return spark.range(1).select(column.alias("c")).collect()[0]["c"]


def test_parsers_and_their_errors(spark):
    assert one(spark, X.int_ranges(F.lit("3, 35:37,,41-40 "))) == [3, 35, 36, 37, 40, 41]
    assert one(spark, X.int_ranges(F.lit(None).cast("string"))) == []
    assert one(spark, X.int_ranges(F.lit("9, 2:5,4 - 7,3,0,12-11,5:2, 6,8:8"))) == [0, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12]
    assert one(spark, X.int_ranges(F.lit("0, 10:1000000,999999-5"))) == [0, *range(5, 1_000_001)]
    assert one(spark, X.weight_spec(F.lit("a=1, b = 0.5,a=2"))) == {"a": 2.0, "b": 0.5}
    assert one(spark, X.weight_spec(F.lit(""))) == {}
    assert one(spark, X.strip_wrapping(F.lit("<<a>>"), "<<", ">>")) == "a"
    assert one(spark, X.strip_wrapping(F.lit("a>>"), "<<", ">>")) == "a"
    assert one(spark, X.strip_wrapping(F.lit(None).cast("string"), "<<", ">>")) is None
    for bad in (X.int_ranges(F.lit("3,x")), X.weight_spec(F.lit("a")), J.required_text(F.lit("  "), "assistant")):
        with pytest.raises(Exception, match="bad|empty"):
            one(spark, bad)
    assert one(spark, J.missing_keys(J.flat_yaml(F.lit("a: 1")), ["a", "b"])) == ["b"]
    assert one(spark, J.missing_keys(F.lit(None).cast("map<string,string>"), ["a"])) == ["a"]


def test_rows_of_a_user_are_beside_each_other_and_long_ones_first(spark, tmp_path):
    cols = ["id AS event_id", "'view' AS event_type", "id / 7D AS value", "cast(pmod(hash(id), 200) AS long) AS user_id"]
    spark.range(0, 20_000, 1, 3).selectExpr(*cols).write.parquet(f"{tmp_path}/events.parquet")
    events = {r["event_id"]: r["user_id"] for r in spark.read.parquet(f"{tmp_path}/events.parquet").collect()}
    got = builds.parsers(spark, str(tmp_path)).select("event_id", "ids", F.spark_partition_id().alias("part")).collect()
    assert {r["event_id"]: r["ids"] for r in got} == {i: sorted({*range(min(u, i % 40), max(u, i % 40) + 1), i}) for i, u in events.items()}
    parts = {}
    for r in got:
        parts.setdefault(events[r["event_id"]], set()).add(r["part"])
    assert len(set.union(*parts.values())) > 8 and max(map(len, parts.values())) <= 3
    placed = [(r["part"], -events[r["event_id"]]) for r in got]
    assert placed == sorted(placed)


def test_hash_rank_equals_one_window(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 7 == 0, None).otherwise("b").alias("g"))
    got = {r["id"]: (r["rank"], r["rank_of"]) for r in sampling.hash_rank(df, "g", "id", 5).collect()}
    keyed = [(r["g"], r["h"], r["id"]) for r in df.filter("g is not null").withColumn("h", sampling.hash_key("id", 5)).collect()]
    want = {}
    for g in "ab":
        mine = sorted(x for x in keyed if x[0] == g)
        want |= {x[2]: (i, len(mine)) for i, x in enumerate(mine)}
    assert got == want
    assert sampling.hash_rank(df.limit(0), "g", "id").count() == 0


def test_merge_modes(spark):
    rows = [(i, "ab"[i % 2], i // 4, "train" if i % 5 else "val") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, task string, episode long, split string")
    run = lambda mode, **k: merge.merge_splits(df, mode, "task", "episode", "id", **k).collect()
    assert sorted(r["id"] for r in run("keep")) == list(range(200))
    assert {r["split"] for r in run("train_only")} == {"train"} and len(run("train_only")) == 160
    again = run("rebuild", ratio=0.2)
    per = {}
    for r in again:
        per.setdefault(r["episode"], set()).add(r["split"])
    assert all(len(s) == 1 for s in per.values()) and sum(s == {"val"} for s in per.values()) == 10
    twice = run("keep", weights={"a": 2.0, "b": 0.0})
    assert len(twice) == 200 and {r["task"] for r in twice} == {"a"}
    with pytest.raises(ValueError):
        run("other")


def test_draws_repeat_and_buffer_goes_on(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(10)], "id long, y int")
    got = sampling.mixed_draws(df, "y", "id", {0: 2, 1: 1}, 50).collect()
    assert len(got) == 150 and all(r["id"] % 2 == r["y"] for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, sampling.mixed_draws(df.repartition(7), "y", "id", {0: 2, 1: 1}, 50).collect()))
    old = spark.createDataFrame([(5, 2), (6, 3)], "i long, e long")
    new = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "i long, e long")
    assert sorted(map(tuple, merge.append_shifted(old, new, "i", "e", 4).collect())) == [(6, 3), (7, 4), (8, 4), (9, 5)]
    assert sorted(map(tuple, merge.append_shifted(old.limit(0), new, "i", "e", 9).collect())) == [(0, 0), (1, 0), (2, 1)]
    at = lambda *x: spark.createDataFrame([(a,) for a in x], "at long")
    assert sorted((r["at"], r["i"]) for r in merge.read_at(new, "i", at(-1, 0, 2), "at").collect()) == [(-1, 2), (0, 0), (2, 2)]
    with pytest.raises(Exception, match="outside"):
        merge.read_at(new, "i", at(3), "at").collect()
    with pytest.raises(Exception, match="outside"):
        merge.read_at(new.limit(0), "i", at(0), "at").collect()
    loose = lambda b: sorted((r["at"], r["i"]) for r in merge.read_at(b, "i", at(-4, -3, 2, 3), "at", strict=False).collect())
    assert loose(new) == [(-3, 0), (2, 2)] and loose(new.limit(0)) == []


def test_votes_and_rules(spark):
    rows = [(1, "DONE", "aaaa", "b", 1), (1, "DONE", "a", None, 2), (1, "NOT DONE", "", "", 3), (1, "NOT DONE", "x", "y", 4), (2, "UNCERTAIN", "q", "r", 5), (3, "odd", "q", "r", 6)]
    df = spark.createDataFrame(rows, "g long, status string, s1 string, s2 string, n long")
    got = {r["g"]: tuple(r)[1:] for r in scoring.majority_texts(df, "g", "status", "s1", "s2", ["DONE", "NOT DONE", "UNCERTAIN"], "n").collect()}
    assert got == {1: ("DONE", "a", None, 2, 2, 2, 0), 2: ("UNCERTAIN", "q", "r", 5, 0, 0, 1)}
    bad = spark.createDataFrame([(1, None, None), (2, {"desc_1": "x" * 513, "desc_2": " ", "status": "?"}, "-3")], "id long, o map<string,string>, ms string")
    rules = {**quality.label_rules(F.col("o"), ["DONE"]), **quality.image_rules(F.lit(None).cast("map<string,string>"), F.lit(None).cast("array<string>"), F.col("ms"), True)}
    assert sorted((r["id"], r["issue"]) for r in quality.issues(bad, ["id"], rules).collect()) == [(2, "label_desc1_too_long"), (2, "label_desc2_empty"), (2, "label_status_invalid"), (2, "timestamp_invalid")]


def test_build_and_sinks(spark, tmp_path):
    frames = spark.createDataFrame([(u, f, "view" if f % 2 else "purchase", float(90 * (f > 2))) for u in range(4) for f in range(9)], "user_id long, frame_index int, event_type string, value double")
    rows = memory.build(frames, spec_table(spark), F.col("value") >= 90, "user_id", "event_type", 0.5, 10)
    memory.write_build(rows, str(tmp_path / "b"), {"ratio": 0.5}, 10)
    assert {p.parent.name for p in (tmp_path / "b" / "rows").glob("*/*/*.json")} <= {"split=train", "split=val"}
    assert max(len(p.read_text().splitlines()) for p in (tmp_path / "b" / "rows").glob("*/*/*.json")) <= 10
    none = memory.build(frames.limit(0), spec_table(spark), F.col("value") >= 90, "user_id", "event_type", 0.5, 10)
    memory.write_build(none, str(tmp_path / "none"), {"ratio": 0.5})
    assert none.count() == 0 and not list((tmp_path / "none" / "rows").glob("*/*/*.json")) and spark.read.json(str(tmp_path / "none" / "meta")).count() == 1
    back = spark.read.json(str(tmp_path / "b" / "rows"))
    assert back.count() == rows.count() == back.select("uid").distinct().count()
    turn = {(r["user_id"], r["frame_index"]) for r in back.filter("label = 'update_transition'").collect()}
    assert turn == {(u, 7) for u in range(4)}  # third of the frames 3, 5, 7
    assert back.groupBy("mode", "split", "shard").count().filter("count > 10").count() == 0
    assert spark.read.json(str(tmp_path / "b" / "meta")).collect()[0]["ratio"] == "0.5"
    df = spark.createDataFrame([(1, None), (2, "bad"), (3, None)], "id long, error string")
    sinks.dead_letter_write(df, str(tmp_path / "d"), F.col("error").isNotNull())
    assert {r["id"] for r in spark.read.json(str(tmp_path / "d/outcome=rows")).collect()} == {1, 3}
    assert [r["id"] for r in spark.read.json(str(tmp_path / "d/outcome=failures")).collect()] == [2]
    assert sum(r["n_rows"] for r in sinks.shard_index(spark, str(tmp_path / "d")).collect()) == 3
    sinks.write_tsv(df, str(tmp_path / "t"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).count() == 3
    sinks.write_votes(df, str(tmp_path / "v"))
    assert spark.read.option("header", True).csv(str(tmp_path / "v/csv")).count() == 3
    assert {json.loads(r["value"])["id"] for r in spark.read.text(str(tmp_path / "v/jsonl")).collect()} == {1, 2, 3}


def test_buffer_reads_with_more_users_than_rows(spark, tmp_path):
    rows = [(i, u, i / 2) for i, u in enumerate([0, 399, 400, 7_000] * 150)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = sorted((r["pos"], r["idx"]) for r in builds.buffer_reads(spark, str(tmp_path)).collect())
    assert got == [(-400, 200), (-1, 599), (0, 200), (399, 599)]


def test_targets_are_judged_as_whole_texts(spark, tmp_path):
    texts = ["4537960215852590 That is", '{"status": "DONE"} x', "1],[2", "1, 2", "", " [1] ", "null", '"a"', "4537960215852590", None]
    rules = quality.target_rules(F.col("t"), ["DONE"])
    got = quality.issues(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), ["i"], rules).collect()
    assert sorted(map(tuple, got)) == [(i, "label_target_text_not_json") for i in range(5)] + [(i, "label_target_text_not_dict") for i in range(5, 9)]
    rows = [(6 * i + k, t, "en") for i, t in enumerate(texts) for k in (0, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, builds.target_issues(spark, str(tmp_path)).collect()))
    assert got == sorted([(24, "label_desc1_empty")] + [(6 * i + 1, "label_target_text_not_json") for i in range(5)])
