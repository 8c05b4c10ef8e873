"""Prompts, second votes, rollouts, spec shapes, assignment, back-fills and conversions."""

import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.functions import prompts as U
from kinetrail.operators import memory as R
from kinetrail.operators import quality as Q
from kinetrail.operators import sampling as P
from kinetrail.operators import scoring as C
from kinetrail.operators import stats as S
from kinetrail.sources import jsonl, layout
from kinetrail.sources.conversion import convert

KEYS = ["Action_Command", "Working_Memory", "Episodic_Context"]


def test_prompts(spark):
    rows = spark.createDataFrame([(1, "pick", {"Action_Command": "go"}, 2, " a\nb \n"), (2, None, None, 1, "  "), (3, "x", {}, None, None)], "k int, task string, m map<string,string>, n int, c string")
    detect = U.detect_prompt("H", F.col("task"), F.col("m"), F.col("n"))
    update = [U.update_prompt("H", F.col("task"), F.col("m"), F.col("n"), F.col("c"), line_end=e) for e in (True, False)]
    got = {r[0]: r[1:] for r in rows.select("k", detect, *update).collect()}
    none = "Action_Command: None | Working_Memory: None | Episodic_Context: None"
    assert got[1][0] == "H\nTask: pick\nMemory: Action_Command: go | Working_Memory: None | Episodic_Context: None\nImages: <image_table> <image_wrist>\n"
    assert got[1][1].endswith("\n\nAllowed_Action_Commands:\na\nb\nImages: <image_table> <image_wrist>\n")
    assert got[2][1] == f"H\nTask: \nPrevious_Memory: {none}\nImages: <image_table>\n"
    assert got[2][2] == got[2][1][:-1] and got[3][2] == f"H\nTask: x\nPrevious_Memory: {none}\nImages: <image_table>"


def test_prompt_and_target_by_mode(spark):
    schema = "mode string, t string, m map<string,string>, l map<string,string>, a array<string>, c array<struct<from:string,value:string>>"
    said = [("user", "old"), ("user", "q"), ("assistant", "r")]
    rows = spark.createDataFrame(
        [
            ("detect", " go ", {"a": None, "b": "1"}, {"Event_Detected": "True"}, None, None),
            ("detect", None, None, None, None, None),
            ("update", "go", {}, {"Action_Command": "x", "Working_Memory": None}, [], None),
            ("update", "go", {"k": "v"}, None, ["p", "q"], None),
            (None, None, None, None, None, said),
        ],
        schema,
    )
    pair = U.prompt_and_target(*[F.col(c) for c in "mode t m l a c".split()], {"detect": "D", "update": "U"})
    got = [tuple(r[0]) for r in rows.select(pair).collect()]
    assert got == [
        ("D\nGlobal_Instruction:\ngo\n\nCurrent_Memory:\na: null\nb: 1", "Event_Detected: true"),
        ("D\nGlobal_Instruction:\n\n\nCurrent_Memory:\n", "Event_Detected: false"),
        ("U\nGlobal_Instruction:\ngo\n\nPrev_Memory:\n\n\nAllowed_Action_Commands:\n", "Working_Memory: null\nEpisodic_Context: \nAction_Command: x"),
        ("U\nGlobal_Instruction:\ngo\n\nPrev_Memory:\nk: v\n\nAllowed_Action_Commands:\n- p\n- q", "Working_Memory: \nEpisodic_Context: \nAction_Command: "),
        ("q", "r"),
    ]
    for bad in ([("user", "q")], [("user", "q"), ("assistant", "")], None):
        with pytest.raises(Exception, match="neither a mode nor both texts"):
            spark.createDataFrame([(None, None, None, None, None, bad)], schema).select(pair).collect()


def test_second_votes_replace_undecided_ones(spark):
    first = [(g, s, "a", "b", i) for i, (g, s) in enumerate([(1, "U"), (1, "U"), (1, "N"), (2, "U"), (3, "D"), (3, "U"), (4, "U"), (None, "U")])]
    again = [(g, s, "c", "d", 10 + i) for i, (g, s) in enumerate([(1, "D"), (2, "U"), (3, "N"), (5, "D")])]
    kind = "g int, status string, one string, two string, i int"
    votes = [C.majority_texts(spark.createDataFrame(rows, kind), "g", "status", "one", "two", ["D", "N", "U"], "i") for rows in (first, again)]
    got = {r["g"]: r for r in C.revote(*votes, "g", "status", ["D", "N", "U"], "U").collect()}
    assert sorted(got, key=str) == [1, 2, 3, 4, None]
    assert got[1][1:] == ("D", "c", "d", 10, 1, 1, 2, True, True)
    assert got[2][1:] == ("U", "a", "b", 3, 0, 0, 1, True, False)
    assert got[3]["status"] == "D" and not got[3]["retried"]
    assert got[4]["retried"] and not got[4]["replaced"] and got[None]["retried"]


def test_rollouts_by_episode_and_whole(spark):
    rng = np.random.default_rng(3)
    rows = [(e, t, int(rng.integers(3)), float(rng.choice([0.0, 0.5, 2.0]))) for e in range(6) for t in range(50)] + [(6, 0, None, 1.0), (6, 1, 2, math.nan), (6, 2, 2, None)]
    df = spark.createDataFrame(rows, "e int, t int, c int, loss double")
    got = {(r["level"], r["e"]): r for r in S.rollout_stats(df.repartition(7), "e", "t", "c", F.col("loss"), 0.5).collect()}
    assert len(got) == 8
    whole, switches = [], 0
    for e in range(7):
        part, rewards, fits, n = [r for r in rows if r[0] == e], [], [], 0
        for i, r in enumerate(part):
            s = i > 0 and part[i - 1][2] != r[2]
            n += s
            if r[3] is not None and not math.isnan(r[3]):
                fits.append(-math.log(max(r[3], 1e-6)))
                rewards.append(fits[-1] - 0.5 * s)
        one = got["episode", e]
        assert (one["steps"], one["switches"]) == (len(part), n) and one["switch_rate"] == pytest.approx(n / len(part))
        assert one["reward_sum"] == pytest.approx(sum(rewards)) and one["fit_mean"] == pytest.approx(np.mean(fits))
        whole += rewards
        switches += n
    every = got["all", None]
    assert (every["steps"], every["switches"]) == (len(rows), switches) and every["reward_mean"] == pytest.approx(np.mean(whole))
    assert S.rollout_stats(df.limit(0), "e", "t", "c", F.col("loss"), 0.5).count() == 0


def test_shapes_of_specs(spark):
    cell = lambda c: dict(zip(KEYS, (c, "w", "e")))
    good = [[cell("go"), cell(" DONE ")], [cell("a"), cell("b"), cell("done")]]
    specs = [
        ("good", 1, [1, 2], good, None, -1, None),
        ("listed", 1, [1, 2], good, [["x"], ["y", "z"]], 3, ["go", " Done"]),
        ("rows", 2, [1, 2], good, [["x"]], -1, None),
        ("length", 1, [2, 2], good, [["x"], ["y"]], -1, None),
        ("end", 1, [1, 2], [good[0], [cell("a"), cell("b"), cell("c")]], [], None, ["go"]),
        ("keys", 0, [0], [[{"Action_Command": "done", "Working_Memory": ""}]], None, 0, []),
        ("nulls", 0, None, None, None, 1, None),
        ("empty", 0, [-1], [[]], None, 1, None),
    ]
    df = spark.createDataFrame(specs, "task_id string, inter int, intra array<int>, grid array<array<map<string,string>>>, filters array<array<string>>, negatives int, commands array<string>")
    got: dict = {}
    for r in R.shape_problems(df, KEYS).collect():
        got.setdefault(r["task_id"], set()).add(r["issue"])
    assert got == {
        "rows": {"grid_rows", "intra_rows", "filter_rows", "filter_row_length"},
        "length": {"grid_row_length", "filter_row_length"},
        "end": {"row_end_not_done", "negatives_missing", "commands_without_done"},
        "keys": {"state_without_episodic_context"},
        "nulls": {"grid_rows", "intra_rows"},
        "empty": {"row_end_not_done"},
    }


def test_pool_and_assignment(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "", None] * 50)], "k int, t string")
    specs = spark.createDataFrame([("s", "a"), ("all", None), ("blank", ""), ("all2", None)], "task_id string, wanted string")
    got = sorted((r["k"], r["task_id"]) for r in R.pool(rows, specs, "t", "wanted", "k", salts=4).collect())
    want = sorted((k, s) for k, t in enumerate(["a", "b", "", None] * 50) for s, w in [("s", "a"), ("all", None), ("blank", ""), ("all2", None)] if w is None or w == t)
    assert got == want and R.pool(rows, specs.limit(0), "t", "wanted", "k").count() == 0
    episodes = spark.createDataFrame([(1, " a ", [3]), (2, "a", []), (3, "b", [1]), (4, "  ", [1]), (5, None, [1]), (6, "c", None)], "e int, t string, f array<int>")
    filters = spark.createDataFrame([("x", 1, 0, "a"), ("x", 0, 2, "a\n"), ("x", 0, 3, ""), ("y", 0, 0, "a"), ("y", 0, 1, "c")], "task_id string, inter int, step int, t string")
    place = lambda need: sorted(R.assigned(episodes, filters, "t", "f", need).select("e", "task_id", "inter", "step").collect())
    assert place(True) == [(1, "x", 0, 2), (1, "y", 0, 0)]
    assert [r[:2] for r in place(False)] == [(1, "x"), (1, "y"), (2, "x"), (2, "y"), (6, "y")]


def test_permutation_is_whole_and_seeded(spark):
    df = spark.range(500).toDF("k")
    order = lambda n, seed: [r["k"] for r in sorted(P.permuted(df.repartition(n), "k", seed).collect(), key=lambda r: r["position"])]
    one = order(3, 1)
    assert one == order(8, 1) and one != order(3, 2) and sorted(one) == list(range(500)) and one != sorted(one)


def test_required_keys(spark):
    rows = spark.createDataFrame([(1, '{"a": 1, "b": null, "x": 2}'), (2, '{"y": {"a": 1}}'), (3, "[1]"), (4, None), (5, "{}"), (6, "{broken")], "k int, row string")
    got: dict = {}
    for r in Q.issues(rows, ["k"], Q.key_rules(F.col("row"), ["a", "b"], {"xy": ["x", "y"]})).collect():
        got.setdefault(r["k"], set()).add(r["issue"])
    assert got == {2: {"missing_a", "missing_b"}, 3: {"row_not_object"}, 4: {"row_not_object"}, 5: {"missing_a", "missing_b", "missing_any_xy"}, 6: {"row_not_object"}}


@pytest.mark.parametrize("least", [1, 7, 100])
def test_sampled_frames_are_the_spaced_ones(spark, least):
    lengths = [1, 2, 3, 9, 50, 99, 100, 101, 640, 5000]
    df = spark.createDataFrame([(n,) for n in lengths], "n long").select("n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("f"))
    got: dict = {}
    for r in df.filter(S.sampled(F.col("f"), F.col("n"), least)).collect():
        got.setdefault(r["n"], []).append(r["f"])
    for n in lengths:
        count = max(min(least, n), min(int(n**0.75), 10_000))
        assert sorted(got[n]) == np.round(np.linspace(0, n - 1, count)).astype(int).tolist()


def test_backfill_leaves_known_episodes(spark, tmp_path):
    df = spark.createDataFrame([(e, f, float(f * e)) for e in range(4) for f in range(200)], "e int, frame_index int, x double").withColumn("y", F.col("x"))
    known = spark.createDataFrame([(1, "x")], "e int, feature string")
    out = S.backfill(df, known, "e", ["x"], ["y"], least=10)
    got = {(r["e"], r["feature"]): r for r in out.collect()}
    assert sorted(got) == [(e, f) for e in (0, 2, 3) for f in ("x", "y")]
    assert got[3, "x"]["count"] == 200 and got[3, "y"]["count"] == int(200**0.75) and got[3, "y"]["max"] == 597
    out.write.parquet(str(tmp_path / "s"))
    assert S.backfill(df, spark.read.parquet(str(tmp_path / "s")), "e", ["x"], ["y"]).select("e").distinct().collect() == [(1,)]


FRAMES = [(e, t, "ab"[(e + t) % 2] if e else "ä") for e in range(5) for t in range(4 + e)]


def test_conversion_by_column_and_back(spark, tmp_path):
    df = spark.createDataFrame(FRAMES, "e long, t int, what string")
    root = str(tmp_path / "set")
    info = convert(df.repartition(5), root, "e", ["t"], 2, "2.0", 5.0, column="what")
    assert jsonl.read_object(spark, f"{root}/meta/info.json") == info
    assert "\n    \"" in open(f"{root}/meta/info.json", encoding="utf-8").read()
    assert (info["total_episodes"], info["total_frames"], info["total_tasks"], info["total_chunks"]) == (5, len(FRAMES), 3, 3)
    assert [tuple(r) for r in layout.read_lengths(spark, root, "e").collect()] == [(e, 4 + e) for e in range(5)]
    tasks = {r["task"]: r["task_index"] for r in spark.read.json(f"{root}/meta/tasks").collect()}
    assert tasks == {"ä": 0, "b": 1, "a": 2}
    listed = {r["episode_index"]: r["tasks"] for r in spark.read.json(f"{root}/meta/episodes").collect()}
    assert listed[0] == ["ä"] and listed[1] == ["b", "a"] and listed[2] == ["a", "b"]
    back = {(r["e"], r["frame_index"]): r["task_index"] for r in layout.read_episodes(spark, root, 2, episode="e").collect()}
    assert back == {(e, t): tasks[w] for e, t, w in FRAMES}
    with pytest.raises(FileExistsError):
        convert(df, root, "e", ["t"], 2, "2.0", 5.0, column="what")


def test_conversion_by_one_task_and_by_episode(spark, tmp_path):
    df = spark.createDataFrame(FRAMES, "e long, t int, what string")
    assert convert(df, str(tmp_path / "one"), "e", ["t"], 50, "2.0", 5.0, task="all")["total_tasks"] == 1
    by = spark.createDataFrame([(e, "xy"[e % 2]) for e in range(5)], "e long, task string")
    info = convert(df, str(tmp_path / "two"), "e", ["t"], 50, "2.0", 5.0, by_episode=by)
    assert info["total_tasks"] == 2 and info["total_chunks"] == 1


@pytest.mark.parametrize(
    "change,message",
    [
        (lambda df: df.filter("e <> 2"), "episodes are not 0 to 3"),
        (lambda df: df.filter("e > 0"), "episodes are not 0 to 3"),
        (lambda df: df.withColumn("e", F.when(F.col("e") < 4, F.col("e"))), "8 frames without one"),
        (lambda df: df.withColumn("what", F.when(F.col("t") > 6, None).otherwise(F.col("what"))), "1 frames without a task"),
        (lambda df: df.limit(0), "no frames"),
    ],
)
def test_a_broken_conversion_leaves_nothing(spark, tmp_path, change, message):
    df = change(spark.createDataFrame(FRAMES, "e long, t int, what string"))
    with pytest.raises(ValueError, match=message):
        convert(df, str(tmp_path / "set"), "e", ["t"], 2, "2.0", 5.0, column="what")
    assert not os.path.exists(tmp_path / "set")


def test_objects_are_replaced_and_checked(spark, tmp_path):
    path = str(tmp_path / "meta" / "info.json")
    for value in ({"a": 1}, {"é": [1, {"b": None}]}):
        jsonl.write_object(spark, path, value)
        assert jsonl.read_object(spark, path) == value
    assert "é" in open(path, encoding="utf-8").read()
    (tmp_path / "list.json").write_text(json.dumps([1]))
    with pytest.raises(ValueError):
        jsonl.read_object(spark, str(tmp_path / "list.json"))


def test_conversion_writes_one_file_for_a_chunk_of_short_episodes(spark, tmp_path):
    df = spark.range(3000).select(F.floor(F.col("id") / 10).alias("e"), F.col("id").alias("t"))
    convert(df, str(tmp_path / "set"), "e", ["t"], 50, "2.0", 5.0, task="all")
    assert sorted(len(list(p.glob("*.parquet"))) for p in (tmp_path / "set" / "data").glob("episode_chunk=*")) == [1] * 6
    layout.write_episodes(df.withColumnRenamed("t", "frame_index"), str(tmp_path / "apart"), 50, "e", together=20)
    files = [p for p in (tmp_path / "apart" / "data").glob("*/*.parquet")]
    assert spark.read.parquet(str(tmp_path / "apart" / "data")).select("e", F.input_file_name()).distinct().count() == 300 and len(files) <= 18
