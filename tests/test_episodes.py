"""Hand-computed vectors and property tests of the episodic operators."""

import random

import pytest
from pyspark.sql import functions as F

from kinetrail.functions import jsontext as J
from kinetrail.functions import text as X
from kinetrail.functions import vectors as V
from kinetrail.operators import memory as R
from kinetrail.operators import merge as M
from kinetrail.operators import quality as Q
from kinetrail.operators import sampling as P
from kinetrail.operators import scoring as C
from kinetrail.operators import stats as S
from kinetrail.operators import timeseries as T
from kinetrail.sources import layout


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def frame_rows(spark, values, episode=1, name="v", kind="double"):
    return spark.createDataFrame([(episode, i, v) for i, v in enumerate(values)], f"ep int, frame_index long, {name} {kind}")


def test_offsets_and_runs(spark):
    df = spark.createDataFrame([(e,) for e, n in ((0, 3), (1, 4), (2, 5)) for _ in range(n)], "ep int")
    assert [(r["from_index"], r["to_index"]) for r in T.episode_offsets(df, "ep").orderBy("ep").collect()] == [(0, 3), (3, 7), (7, 12)]
    rows = frame_rows(spark, [0, 0, 0, 1, 1, 1, 1, 0, None, None], kind="int")
    got = T.runs(rows, "ep", "v").orderBy("run").collect()
    assert [(r["v"], r["first_frame"], r["last_frame"]) for r in got] == [(0, 0, 2), (1, 3, 6), (0, 7, 7), (None, 8, 9)]


def test_delta_window_and_horizon(spark):
    rows = frame_rows(spark, [10.0, 11.0, 12.0, 13.0, 14.0])
    got = {r["delta"]: (r["v"], r["is_pad"]) for r in T.delta_window(rows, "ep", [-4, 0, 1, 2], ["v"]).filter("frame_index = 3").collect()}
    assert got == {-4: (10.0, True), 0: (13.0, False), 1: (14.0, False), 2: (14.0, True)}
    chunks = T.horizon_chunk(frame_rows(spark, [1.0, None, 3.0]), "ep", "v", 3).orderBy("frame_index").collect()
    assert [r["chunk"] for r in chunks] == [[1.0, None, 3.0], [None, 3.0, 3.0], [3.0, 3.0, 3.0]]


def test_nearest_prefers_the_earlier_row(spark):
    rows = spark.createDataFrame([(1, 0.0, 1.0), (1, 0.2, 2.0), (1, 0.4, 3.0)], "ep int, t double, v double")
    asked = spark.createDataFrame([(1, 7, 0.31), (1, 8, 0.1), (1, 9, 5.0), (2, 10, 1.0)], "ep int, q int, t double")
    got = {r["q"]: (r["matched_value"], r["is_pad"]) for r in T.nearest(asked, rows, "ep", "t", "v", "q", 0.19).collect()}
    assert got == {7: (3.0, False), 8: (1.0, False), 9: (3.0, True), 10: (None, None)}


def islands_reference(low, least, gap):
    out, i = [], 0
    frames = [k for k, x in enumerate(low) if x]
    while i < len(frames):
        j = i
        while j + 1 < len(frames) and frames[j + 1] == frames[j] + 1:
            j += 1
        out.append([frames[i], frames[j]])
        i = j + 1
    merged = []
    for s, e in [x for x in out if x[1] - x[0] + 1 >= least]:
        if merged and s - merged[-1][1] < gap:
            merged[-1][1] = e
        else:
            merged.append([s, e])
    return [tuple(x) for x in merged]


def test_islands_against_a_loop(spark):
    random.seed(1)
    cases = [[random.random() for _ in range(random.randint(0, 30))] for _ in range(60)] + [[1, 0, 0, 0, 1, 0, 1, 1, 1, 0, 0]]
    df = spark.createDataFrame([(e, i, float(v)) for e, c in enumerate(cases) for i, v in enumerate(c)], "ep int, frame_index long, v double")
    for least, gap in ((1, 3), (2, 3), (2, 1)):
        got = T.merge_islands(T.low_islands(df, "ep", "v", 0.5), "ep", least, gap).collect()
        want = {(e, *x) for e, c in enumerate(cases) for x in islands_reference([v < 0.5 for v in c], least, gap)}
        assert {(r["ep"], r["start"], r["end"]) for r in got} == want


def test_subtask_labels_skip_short_episodes(spark):
    df = spark.createDataFrame([(e, i) for e in (1, 2) for i in range(8)], "ep int, frame_index long")
    islands = spark.createDataFrame([(1, 3, 3), (1, 6, 7), (2, 4, 4)], "ep int, start long, end long")
    got = T.subtask_labels(df, islands, "ep", 3).orderBy("ep", "frame_index").collect()
    assert [(r["ep"], r["subtask_index"]) for r in got] == [(1, x) for x in (0, 0, 0, 1, 1, 1, 2, 2)]


def test_states_and_anchors(spark):
    df = frame_rows(spark, [0, 0, 1, 0, 1, 0], kind="int")
    got = T.running_state(df, "ep", F.col("v") == 1, 0, 2).orderBy("frame_index").collect()
    assert [(r["state"], r["previous_state"]) for r in got] == [(0, 0), (0, 0), (1, 0), (1, 1), (2, 1), (2, 2)]
    assert [r["sticky_done"] for r in T.sticky(frame_rows(spark, [0, 1, 0], kind="int"), "ep", F.col("v") == 1).orderBy("frame_index").collect()] == [False, True, True]
    anchors = T.strided_anchors(frame_rows(spark, [0.0] * 10), "ep", 3, 4).orderBy("frame_index").collect()
    assert [(r["frame_index"], round(r["progress"], 6), r["done"]) for r in anchors] == [(0, 0, False), (3, 0.333333, False), (6, 0.666667, True)]
    held = T.carry_forward(frame_rows(spark, ["a", "b", "c", None, "e"], kind="string"), "ep", F.col("v"), 3).orderBy("frame_index").collect()
    assert [r["held"] for r in held] == ["a", "a", "a", "a", "a"]


def test_stats_merge_and_nan(spark):
    parts = spark.createDataFrame([("a", 0.0, 2.0, 1.0, 1.0, 2), ("a", 2.0, 4.0, 3.0, 1.0, 2)], "k string, min double, max double, mean double, std double, count long")
    for merge in (S.merge_stats,):
        r = merge(parts, ["k"]).first()
        assert (r["min"], r["max"], r["mean"], r["count"]) == (0.0, 4.0, 2.0, 4) and r["std"] == pytest.approx(2**0.5)
    r = S.scalar_stats(frame_rows(spark, [1.0, float("nan"), None, 3.0]), ["ep"], "v").first()
    assert (r["min"], r["max"], r["mean"], r["std"], r["count"]) == (1.0, 3.0, 2.0, 1.0, 2)


def test_advantages_against_a_loop(spark):
    rows = S.advantages(frame_rows(spark, [1.0, 1.0, 1.0]), "ep", "frame_index", F.col("v"), F.lit(0.0), 1.0, 1.0)
    assert [r["advantage"] for r in rows.orderBy("frame_index").collect()] == [3.0, 2.0, 1.0]
    random.seed(2)
    r, v = [random.random() for _ in range(20)], [random.random() for _ in range(20)]
    df = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(zip(r, v))], "ep int, t int, r double, v double")
    got = S.advantages(df, "ep", "t", F.col("r"), F.col("v"), 0.9, 0.8).orderBy("t").collect()
    a, want = 0.0, []
    for i in reversed(range(20)):
        a = r[i] + 0.9 * (v[i + 1] if i < 19 else 0.0) - v[i] + 0.72 * a
        want.append(a)
    assert [x["advantage"] for x in got] == pytest.approx(want[::-1])


def test_cumulative_share_and_ensemble(spark):
    df = frame_rows(spark, [3.0, 2.0, 1.0])
    kept = S.cumulative_share(df, "ep", "frame_index", "v", 0.5).filter("kept").collect()
    assert [r["v"] for r in kept] == [3.0]
    assert S.decayed_mean(df, "ep", "frame_index", F.col("v"), 0.0).first()["ensemble"] == 2.0


def test_sampling(spark):
    r = one(spark, *[V.sample_count(F.lit(n)).alias(f"n{n}") for n in (50, 464, 500, 1000, 20000)])
    assert list(r) == [50, 100, 105, 177, 1681]
    r = one(spark, V.systematic_indices(F.lit(5), F.lit(3)).alias("a"), V.systematic_indices(F.lit(4), F.lit(3)).alias("b"), V.systematic_indices(F.lit(9), F.lit(1)).alias("c"))
    assert list(r) == [[0, 2, 4], [0, 2, 3], [0]]
    e = spark.range(25).withColumnRenamed("id", "k")
    assert P.split_episodes(e, "k", 0.1).filter("split = 'val'").count() == 2
    assert P.split_episodes(spark.range(35).withColumnRenamed("id", "k"), "k", 0.1).filter("split = 'val'").count() == 4
    assert P.split_episodes(spark.range(35).withColumnRenamed("id", "k"), "k", 0.1, half_even=False).filter("split = 'val'").count() == 3
    uids = spark.createDataFrame(list(enumerate(["a", "a", "", "b", "", None, None])), "pos int, uid string")
    assert sorted(r["pos"] for r in P.keep_first(uids, "uid", "pos").collect()) == [0, 2, 3, 4, 5]
    w = P.sampler_weights(spark.createDataFrame([("on", 1), ("on", 0), ("off", 1)], "g string, ok int"), F.col("g"), F.col("ok") == 1, {"on": 0.25, "off": 0.75}).collect()
    assert sorted((r["g"], r["ok"], r["weight"]) for r in w) == [("off", 1, 0.75), ("on", 0, 0.0), ("on", 1, 0.25)]
    w = P.sampler_weights(spark.createDataFrame([("on", 0), ("off", 0)], "g string, ok int"), F.col("g"), F.col("ok") == 1, {"on": 1, "off": 1}).collect()
    assert [r["weight"] for r in w] == [0.5, 0.5]
    one_batch = P.mixed_batches(spark.range(10).select("id", (F.col("id") % 2).alias("label")), "label", "id", {0: 2, 1: 1})
    assert {(r["batch"], r["n0"], r["n1"]) for r in one_batch.groupBy("batch").agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1")).collect()} == {(0, 2, 1), (1, 2, 1)}


def test_merge(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(2, 0.5)], "k int, w double")
    assert sorted((r["k"], r["dataset"]) for r in M.union_common({"a": a, "b": b}).collect()) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        M.union_common({"a": a.select("v"), "b": b.select("w")})
    rows = spark.createDataFrame([("b", 1), ("a", 2), ("b", 0)], "g string, o int")
    assert sorted((r["g"], r["o"], r["index"]) for r in M.renumber(rows, "g", "o", 5).collect()) == [("a", 2, 5), ("b", 0, 6), ("b", 1, 7)]
    assert sorted(r["k"] for r in M.upsert(a, a.withColumn("k", F.lit(3)), "k", a).collect()) == [3]
    r = one(spark, M.range_union(F.array(F.lit(40), F.lit(1)), F.lit(41), F.lit(35)).alias("x"))
    assert r["x"] == [1, 35, 36, 37, 38, 39, 40, 41]
    assert [r["shard"] for r in M.shard_ids(rows, "g", "o", 0).collect()] == [0, 0, 0]


def test_votes_and_quality(spark):
    df = spark.createDataFrame([(1, "DONE"), (1, "NOT DONE"), (1, "UNCERTAIN"), (2, "UNCERTAIN"), (2, "UNCERTAIN"), (2, "DONE")], "v int, s string")
    got = {r["v"]: r["s"] for r in C.majority(df, "v", "s", ["DONE", "NOT DONE", "UNCERTAIN"]).collect()}
    assert got == {1: "DONE", 2: "UNCERTAIN"}
    bad = Q.not_monotonic(frame_rows(spark, [1.0, 3.0, 2.0, 2.5]), "ep", "frame_index", "v").collect()
    assert [r["frame_index"] for r in bad] == [2]
    issues = Q.issues(frame_rows(spark, [1.0, None]), ["frame_index"], {"low": F.col("v") < 2, "none": F.col("v").isNull()})
    assert sorted((r["frame_index"], r["issue"]) for r in issues.collect()) == [(0, "low"), (1, "none")]


def test_text_functions(spark):
    r = one(
        spark, X.norm_str(F.lit("  a\n b ")).alias("a"), X.norm_str(F.lit(None)).alias("b"), X.norm_str(F.lit(True)).alias("c"), X.norm_bool(F.lit("Yes")).alias("d"), X.norm_bool(F.lit("0")).alias("e"),
        X.norm_bool(F.lit("x")).alias("f"), X.lines(F.lit("a\n\n b ")).alias("g"), X.csv_list(F.lit("a, b,,c ")).alias("h"), X.big_number(F.lit(15_300)).alias("i"), X.big_number(F.lit(2_500_000), 1).alias("j"),
        X.frame_number(F.lit("frame_000123.jpg")).alias("k"), X.frame_number(F.lit("x.jpg")).alias("l"), X.episode_number(F.lit("episode_000007")).alias("m"), X.episode_number(F.lit("bad")).alias("n"),
        X.strip_fences(F.lit("x assistant\n```yaml\na: 1\n```")).alias("o"), X.two_sentences(F.lit("- One.  Two. Three")).alias("p"), X.dataset_name(F.lit("/d/set/videos/c/x.mp4")).alias("q"), X.dataset_name(F.lit("/a/b/c/x.mp4")).alias("r"),
    )
    assert list(r) == ["a b", "None", "true", True, False, None, ["a", "b"], ["a", "b", "c"], "15K", "2.5M", 123, None, 7, None, "a: 1", "One. Two.", "set", "b"]


def test_json_functions(spark):
    r = one(
        spark, J.outer_object(F.lit('note {"status":"done"} end')).alias("a"), J.field(F.lit('{"status": "do,ne", "x": 3'), "status").alias("b"), J.field(F.lit('{"x": 3}'), "x").alias("c"), J.field(F.lit("none"), "x").alias("d"),
        J.clean(F.lit("{“a”: 1,, \"b\": [2,],}\r\n")).alias("e"), J.flat_yaml(F.lit("a: 1\nnoise\nb:  x: y\na: 2")).alias("f"),
    )
    assert list(r) == ['{"status":"done"}', "do,ne", "3", None, '{"a": 1, "b": [2]}', {"a": "2", "b": "x: y"}]
    nested = spark.range(1).select(F.lit(1).alias("a"), F.struct(F.lit(2).alias("c")).alias("b"))
    flat = J.flatten(nested)
    assert flat.columns == ["a", "b/c"] and J.unflatten(flat).schema.simpleString() == "struct<a:int,b:struct<c:int>>"


def test_vector_functions(spark):
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    r = one(
        spark, V.last_subsequence(arr(1, 2, 3, 1, 2, 4), arr(1, 2)).alias("a"), V.last_subsequence(arr(1), arr(1, 2)).alias("b"), V.pad_left(arr(5), F.lit(3), F.lit(0)).alias("c"), V.pad_right(arr(1.0), 3).alias("d"),
        V.delta_index(F.lit(0.5), 5.0).alias("e"), V.min_max(F.lit(5.0), F.lit(0.0), F.lit(10.0)).alias("f"), V.l2(arr(3.0, 4.0)).alias("g"), V.safe_asin(F.lit(2.0)).alias("h"),
    )
    assert list(r)[:5] == [3, None, [0, 0, 5], [1.0, 0.0, 0.0], 2]
    assert list(r)[5:] == pytest.approx([0.0, 5.0, 1.5707963], abs=1e-6)


def test_memory_rows(spark):
    ids = one(spark, R.transition_frame(F.array(F.lit(7), F.lit(9))).alias("a"), R.transition_frame(F.array(*[F.lit(x) for x in (7, 9, 11, 13)])).alias("b"))
    assert list(ids) == [9, 11]
    spec = spark.createDataFrame([("t", 0, 0, 2, "a"), ("t", 0, 1, 2, "b"), ("t", 1, 0, 1, "done")], "task_id string, inter int, step int, n_steps int, command string")
    got = [(r["kind"], r["command_from"], r["command_to"]) for r in R.transitions(spec).orderBy("inter", "step").collect()]
    assert got == [("intra", "a", "b"), ("task_change", "b", "done")]


def test_layout(spark):
    r = one(spark, layout.data_path(F.lit(123), 50).alias("a"), layout.episode_of(F.lit("data/chunk-002/episode_000123.parquet")).alias("b"), layout.episode_of(F.lit("x")).alias("c"))
    assert list(r) == ["data/chunk-002/episode_000123.parquet", 123, None]


def test_salvaged_fields_keep_quotes(spark):
    want = {
        '{"a": "he said "go" now"}': ('he said "go" now', None),
        '{"status": "NOT "DONE""}': (None, 'NOT "DONE"'),
        '{"a": "x", "status": "y"}': ("x", "y"),
        '{"a": "one\n "two" ", "status": "DONE", }': ('one "two"', "DONE"),
        '{"a": "un"closed': ('un"closed', None),
        '{"a": 1, "status": {"deep": 2}}': ("1", '{"deep":2}'),
        "nothing": (None, None),
        '{"a" "x", "status": ""}': (None, None),
    }
    frame = spark.createDataFrame([(t,) for t in want] + [(None,)], "t string")
    got = frame.select("t", *[J.field(J.clean(F.col("t")), k).alias(k) for k in ("a", "status")]).collect()
    assert {r["t"]: (r["a"], r["status"]) for r in got} == {**want, None: (None, None)}


def test_strict_lookup_is_loud(spark):
    tasks = spark.createDataFrame([(0, "a"), (1, None)], "k long, v string")
    assert [tuple(r) for r in M.strict_lookup(spark.range(2).withColumnRenamed("id", "k"), tasks, "k", "v").orderBy("k").collect()] == [(0, "a"), (1, None)]
    with pytest.raises(Exception, match="without entry in the lookup: 2"):
        M.strict_lookup(spark.range(3).withColumnRenamed("id", "k"), tasks, "k", "v").collect()


def test_merged_statistics_keep_their_digits(spark):
    """Exact parts {0, 2} and {1, 3} above 1e9, so that only the merge can lose digits."""
    parts = [(g, 1e9 + x, 1e9 + x + 2, 1e9 + x + 1, 1.0, 2) for g in ("a", None) for x in (0.0, 1.0)]
    frame = spark.createDataFrame(parts, "g string, min double, max double, mean double, std double, count long")
    for by, count in ((["g"], 4), ([], 8)):
        out = S.merge_stats(frame, by).collect()
        assert len(out) == (2 if by else 1)
        for r in out:
            assert r["std"] == pytest.approx(1.25**0.5, rel=1e-9) and (r["count"], r["mean"], r["min"], r["max"]) == (count, 1e9 + 1.5, 1e9, 1e9 + 3)


def test_one_long_episode_takes_linear_plans(spark):
    n = 40_000
    rows = spark.range(n).select(F.lit(1).alias("e"), F.col("id").cast("double").alias("at"), F.col("id").cast("double").alias("v"), F.col("id").alias("k"))
    asked = spark.range(n).select(F.lit(1).alias("e"), F.col("id").alias("q"), (F.col("id") + 0.25).alias("at"))
    found = T.nearest(asked, rows, "e", "at", "v", "q", 1.0)
    assert found.filter("matched_at = q and not is_pad").count() == n
    out = S.advantages(rows, "e", "k", F.lit(1.0), F.lit(0.0), 0.5, 1.0)
    assert out.count() == n and out.filter(F.abs(F.col("advantage") - 2.0) < 1e-9).count() > n - 60
