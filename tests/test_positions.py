"""Global positions, neighbours, running sums and the affine scan against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from kinetrail.operators import merge as M
from kinetrail.operators import sampling as P
from kinetrail.operators import stats as S
from kinetrail.operators.positions import Ordered, affine_scan, numbered, numbered_within


@pytest.fixture
def spread(spark):
    """Range partitions stay apart, however small they are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def rows_of(n=500):
    rng = random.Random(1)
    return [(None if rng.random() < 0.02 else rng.choice("abz"), i, rng.choice([None, 1, 2, -3])) for i in range(n)]


def first(x):
    return (x[0] is not None, x[0] or "", x[1])


def test_positions_neighbours_and_sums(spread):
    rows = rows_of()
    placed = Ordered(spread.createDataFrame(rows, "g string, o long, v long").repartition(5), "g", "o")
    assert len(placed.parts) > 2
    want = sorted(rows, key=first)
    got = sorted(placed.neighbours(["g", "o"], position="p").collect(), key=lambda r: r["p"])
    assert [tuple(r[:3]) for r in got] == want and [r["p"] for r in got] == list(range(len(rows)))
    assert [r["previous"] and tuple(r["previous"]) for r in got] == [None, *[r[:2] for r in want[:-1]]]
    assert [r["following"] and tuple(r["following"]) for r in got] == [*[r[:2] for r in want[1:]], None]
    upto, sums = 0, {}
    for g, o, v in want:
        upto += v or 0
        sums[o] = upto
    assert {r["o"]: r["s"] for r in placed.running_sum("v", "s").collect()} == sums
    falling = numbered(spread.createDataFrame(rows, "g string, o long, v long"), F.col("o").desc(), start=3)
    assert {r["o"]: r["position"] for r in falling.collect()} == {o: len(rows) - 1 - o + 3 for _, o, _ in rows}
    inside: dict = {}
    for g, o, _ in want:
        inside.setdefault(g, []).append(o)
    within = numbered_within(spread.createDataFrame(rows, "g string, o long, v long"), "g", "o")
    assert {r["o"]: r["position"] for r in within.collect()} == {o: i for own in inside.values() for i, o in enumerate(own)}
    assert numbered(spread.createDataFrame([], "o long"), "o").collect() == []


def test_an_empty_partition_between_neighbours(spread):
    rows = [(1, i) for i in range(3)] + [(9, i) for i in range(40)]
    got = Ordered(spread.createDataFrame(rows, "g long, o long"), "g", "o").neighbours(["o"], following=None).orderBy("g", "o").collect()
    assert [r["previous"] and r["previous"]["o"] for r in got] == [None, *[o for _, o in rows[:-1]]]


def loop(rows, gamma, lam):
    out, by = {}, {}
    for e, t, r, v, d in rows:
        by.setdefault(e, []).append((t, r, v, d))
    for e, own in by.items():
        a = after = 0.0
        for i, (t, r, v, d) in enumerate(sorted(own, reverse=True)):
            go = i > 0 and not d
            x = None if r is None or v is None or (go and after is None) else r + (gamma * after if go else 0.0) - v
            a = x if not go or x is None else None if a is None else x + gamma * lam * a
            after = v
            out[e, t] = a
    return out


def test_advantages_with_done_flags_over_several_tasks(spread):
    """One episode spans many partitions and blocks; the others are short or one step long."""
    rng = random.Random(3)
    rows = [("long", t, rng.uniform(-1, 1), rng.uniform(-1, 1), rng.random() < 0.01) for t in range(20_000)]
    rows += [(f"e{i}", t, None if rng.random() < 0.05 else float(t), None if rng.random() < 0.05 else 0.5, rng.choice([None, False, True])) for i in range(60) for t in range(rng.randint(1, 12))]
    rng.shuffle(rows)
    df = spread.createDataFrame(rows, "e string, t long, r double, v double, d boolean").repartition(6)
    placed = Ordered(df, "e", "t")
    assert placed.rows.filter("e = 'long'").select("__part").distinct().count() > 2
    got = S.advantages(df, "e", "t", F.col("r"), F.col("v"), 0.97, 0.9, F.col("d")).collect()
    want = loop(rows, 0.97, 0.9)
    assert len(got) == len(rows)
    for r in got:
        a = want[r["e"], r["t"]]
        assert (r["advantage"] is None) == (a is None) and (a is None or abs(r["advantage"] - a) < 1e-9), r
    empty = S.advantages(df.limit(0), "e", "t", F.col("r"), F.col("v"), 0.9, 0.9)
    assert empty.collect() == []


def test_affine_scan_of_three_levels(spread):
    rng = random.Random(4)
    rows = [(p, rng.choice([0.0, 0.5, -2.0, 1.0]) if p % 7 == 0 else 0.9, rng.uniform(-1, 1)) for p in range(700)]
    got = affine_scan(spread.createDataFrame(rows, "p long, a double, b double"), "p", 700, F.col("a"), F.col("b"), "y", block=8)
    y, want = 0.0, {}
    for p, a, b in reversed(rows):
        y = b + a * y
        want[p] = y
    assert all(abs(r["y"] - want[r["p"]]) < 1e-9 * max(1, abs(want[r["p"]])) for r in got.collect())


def test_shards_strides_and_groups_keep_their_rows(spread):
    rows = rows_of(300)
    df = spread.createDataFrame(rows, "g string, o long, v long")
    got = {r["o"]: r["shard"] for r in M.shard_ids(df, "g", "o", 10).collect()}
    for g in {r[0] for r in rows}:
        assert [got[o] for _, o, _ in sorted((r for r in rows if r[0] == g), key=first)] == [i // 10 for i in range(sum(r[0] == g for r in rows))]
    assert sorted(r["o"] for r in P.stride_shard(df, "o", 1, 4).collect()) == list(range(1, 300, 4))
    order = M.stable_group_order(df, "g", "o", "v").collect()
    by = sorted(rows, key=lambda r: (first((r[0], 0)), -1 if r[2] is None else r[2], r[1]))
    place, seen = {}, {}
    for g, o, v in by:
        seen[g] = seen.get(g, 0) + 1
        place[o] = seen[g]
    assert {r["o"]: r["place"] for r in order} == place
    least = {}
    for g, o, _ in rows:
        least[g] = min(least.get(g, o), o)
    assert all(r["group_at"] == least[r["g"]] for r in order)


def test_first_of_each_uid(spark):
    rows = [("a", 2, "x"), ("a", 1, "y"), ("", 3, "z"), ("", 4, "z"), (None, 6, "n"), (None, 5, "m")]
    got = P.keep_first(spark.createDataFrame(rows, "uid string, o long, t string"), "uid", "o")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 1, "y"), ("", 3, "z"), ("", 4, "z"), (None, 5, "m")], key=str)
