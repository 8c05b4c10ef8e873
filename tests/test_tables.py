"""Line numbers over file blocks, directories as tables, shards, versions, ledger, deletion vectors, YAML."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from kinetrail.functions import jsontext as J
from kinetrail.operators.deletions import DeletionLog
from kinetrail.sources import files, jsonl, shards, versions

SCHEMA = "k int, t string"


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_line_numbers_of_files_over_several_blocks(small_blocks, tmp_path):
    rng, want = random.Random(1), {}
    for name, n in (("b/two.jsonl", 900), ("one.jsonl", 700), ("empty.jsonl", 0), ("short.jsonl", 1)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        lines = [rng.choice(["", "  ", json.dumps({"k": i, "t": "x" * rng.randint(0, 90)}), json.dumps({"k": i, "t": "a\u2028b"}, ensure_ascii=False) + "\r"]) for i in range(n)]
        (tmp_path / name).write_bytes("\n".join(lines).encode() + (b"" if n == 1 else b"\n") * bool(n))
        want[name] = [x.removesuffix("\r") for x in lines]
    rows = jsonl.numbered_lines(small_blocks, str(tmp_path)).collect()
    assert small_blocks.read.text(str(tmp_path / "b" / "two.jsonl")).rdd.getNumPartitions() > 3
    got: dict = {}
    for r in sorted(rows, key=lambda r: r["place"]):
        got.setdefault(r["file"].split(str(tmp_path) + "/")[1], []).append((r["line"], r["raw"]))
    if want["short.jsonl"] == [""]:
        want.pop("short.jsonl")
    assert got == {k: list(enumerate(v, 1)) for k, v in want.items() if v}
    assert sorted(r["place"] for r in rows) == list(range(1, len(rows) + 1))
    parsed = jsonl.read_strict(small_blocks, str(tmp_path), SCHEMA).count()
    assert parsed == sum(bool(x.strip()) for v in want.values() for x in v)


def test_a_bad_line_is_named(small_blocks, tmp_path):
    good = [json.dumps({"k": i, "t": "y" * 50}) for i in range(300)]
    (tmp_path / "part.jsonl").write_text("\n".join([*good, '{"k": 1, broken', *good]) + "\n")
    for read in (lambda: jsonl.read_strict(small_blocks, str(tmp_path), SCHEMA).count(), lambda: jsonl.read_strict(small_blocks, str(tmp_path), SCHEMA).select("k").collect()):
        with pytest.raises(Exception, match=r"JSON parse error: .*part\.jsonl line 301: \{.k.: 1, broken"):
            read()
    bad = jsonl.read_tolerant(small_blocks, str(tmp_path), SCHEMA).filter("error is not null").collect()
    assert [(r["line"], r["raw"]) for r in bad] == [(301, '{"k": 1, broken')]


def test_appended_lines(spark, tmp_path):
    for part in ([(1, "a")], [(2, "b"), (3, None)]):
        jsonl.append_lines(spark.createDataFrame(part, SCHEMA), str(tmp_path / "log"))
    got = jsonl.read_strict(spark, str(tmp_path / "log"), SCHEMA, glob="*.json")
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "b"), (3, None)]


def test_folders_as_tables(spark, tmp_path):
    for chunk, episode, names in (("chunk-000", "episode_000001", ["a.jpg", "b.jpg"]), ("chunk-000", "episode_000002", ["a.jpg"]), ("chunk-001", "episode_000051", ["a.jpg"]), ("other", "x", ["a.jpg"])):
        for n in names:
            p = tmp_path / "frames" / chunk / episode / "table" / n
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_bytes(b"12345")
    (tmp_path / "frames" / "chunk-001" / "episode_000052.mp4").write_bytes(b"1")
    listed = files.listing(spark, str(tmp_path / "frames"))
    got = files.episode_folders(listed).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 2, 10), (0, 2, 1, 5), (1, 51, 1, 5), (1, 52, 1, 1)]
    wanted = spark.createDataFrame([("chunk-000/episode_000001/table",), ("chunk-000/episode_000003/table",)], "path string")
    assert [r["path"] for r in files.missing(wanted, listed, str(tmp_path / "frames")).collect()] == ["chunk-000/episode_000003/table"]
    with pytest.raises(FileNotFoundError):
        files.listing(spark, str(tmp_path / "absent"))


def test_listing_prunes_folders(spark, tmp_path):
    spark.range(40).withColumn("chunk", F.col("id") % 4).write.partitionBy("chunk").parquet(str(tmp_path / "p"))
    got = files.listing(spark, str(tmp_path / "p"), "*.parquet", partitioned=True).filter("chunk = 2")
    assert {r["chunk"] for r in got.collect()} == {2}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "chunk" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_roots_of_lines(spark, tmp_path):
    (tmp_path / "d" / "shards").mkdir(parents=True)
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "x.jsonl").write_text("{}\n")
    assert files.lines_root(spark, str(tmp_path / "d")) == str(tmp_path / "d") + "/shards"
    assert files.lines_root(spark, str(tmp_path / "e")) == str(tmp_path / "e")
    assert files.lines_root(spark, str(tmp_path / "e" / "x.jsonl")).endswith("x.jsonl")
    for bad in ("e/y.jsonl", "none", "e/x.txt"):
        with pytest.raises(ValueError):
            files.lines_root(spark, str(tmp_path / bad))


def test_spec_files(spark, tmp_path):
    kind = "task_id string, inter int, intra array<int>"
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "one.json").write_text('{"task_id": "one",\n "inter": 2, "intra": [1, 2]}')
    (tmp_path / "a" / "b" / "two.json").write_text('{"task_id": "two"}')
    got = files.read_specs(spark, str(tmp_path), kind, "task_id").orderBy("task_id").collect()
    assert [(r["task_id"], r["inter"], r["intra"]) for r in got] == [("one", 2, [1, 2]), ("two", None, None)] and got[1]["file"].endswith("a/b/two.json")
    (tmp_path / "c.json").write_text('{"task_id": "one"}')
    with pytest.raises(ValueError, match=r"duplicate task_id=one in .*one\.json, .*c\.json"):
        files.read_specs(spark, str(tmp_path), kind, "task_id")
    (tmp_path / "c.json").write_text('{"inter": 1}')
    with pytest.raises(ValueError, match=r"no spec with a task_id: .*c\.json"):
        files.read_specs(spark, str(tmp_path), kind, "task_id")


def test_shards_are_replaced_alone_and_again(spark, tmp_path):
    path = str(tmp_path / "t")
    row = lambda ks, v: spark.createDataFrame([(k, i, v) for k in ks for i in range(2)], "k long, i int, v string")
    shards.replace(row(range(60), "old"), path, ["k"], 8)
    stamp = lambda: {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}
    before = stamp()
    for _ in range(2):  # idempotent
        shards.replace(row([3], "new"), path, ["k"], 8, targets=spark.createDataFrame([(3,), (4,)], "k long"))
        got = sorted(map(tuple, shards.read_shards(spark, path).select("k", "i", "v").collect()))
        assert got == sorted([(k, i, "old") for k in range(60) if k not in (3, 4) for i in range(2)] + [(3, i, "new") for i in range(2)])
    assert len(set(before) & set(stamp())) >= len(before) - 2  # other shards keep their files
    with pytest.raises(ValueError):
        shards.replace(row([5], "x"), path, ["k"], 8, targets=spark.createDataFrame([(6,)], "k long"))
    shards.replace(row([], "x"), path, ["k"], 8, targets=spark.createDataFrame([(k,) for k in range(60)], "k long"))
    assert shards.read_shards(spark, path).count() == 0
    for batch in ([(1, 5, "a"), (2, 1, "b")], [(1, 4, "late"), (2, 2, "c")], [(1, 4, "late"), (2, 2, "c")]):
        shards.upsert(spark.createDataFrame(batch, "k long, i int, v string"), path, ["k"], "i", 8)
    assert sorted(map(tuple, shards.read_shards(spark, path).select("k", "i", "v").collect())) == [(1, 5, "a"), (2, 2, "c")]


def test_upgrade_switches_only_what_agrees(spark, tmp_path):
    root = str(tmp_path / "ds")
    with pytest.raises(FileNotFoundError):
        versions.read_current(spark, root)
    versions.publish(spark.createDataFrame([(e, float(i)) for e in range(3) for i in range(5)], "e int, v double"), root)
    stats = lambda df: df.groupBy("e").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))
    for broken in (lambda df: df.filter("v < 4"), lambda df: df.filter("e < 2"), lambda df: df.withColumn("v", F.col("v") * 1.1)):
        with pytest.raises(ValueError, match="statistics differ"):
            versions.upgrade(spark, root, broken, stats, ["e"])
        assert versions.current_version(spark, root) == 1 and not os.path.exists(f"{root}/versions/2") and versions.read_current(spark, root).count() == 15
    assert versions.upgrade(spark, root, lambda df: df.withColumn("w", F.col("v") + 1), stats, ["e"]) == 2
    assert versions.read_current(spark, root).columns == ["e", "v", "w"] and not os.path.exists(f"{root}/versions/1")


def test_ledger_restarts_with_what_is_left(spark, tmp_path):
    ledger = versions.Ledger(spark, str(tmp_path / "ledger"))
    items = spark.createDataFrame([(f"i{k}",) for k in range(10)] + [("i1",)], "item string")
    seen: list = []

    def work(fails):
        def run(batch):
            names = sorted(r["item"] for r in batch.collect())
            seen.append(names)
            if "i7" in names and fails:
                raise RuntimeError("lost")
            return batch.select("item", (~F.col("item").isin(fails)).alias("ok"), F.lit("note").alias("note"))

        return run

    with pytest.raises(RuntimeError):
        ledger.run(items, work(["i2"]), 3)
    assert sorted(r["item"] for r in ledger.pending(items).collect()) == ["i2", "i6", "i7", "i8", "i9"]
    seen.clear()
    assert ledger.run(items, work([]), 3) == 2 and seen == [["i2", "i6", "i7"], ["i8", "i9"]]
    assert ledger.pending(items).count() == 0 and ledger.states().filter("state = 'done'").count() == 10
    assert ledger.run(items, work([]), 3) == 0


def test_deletion_vectors_and_undo(spark, tmp_path):
    frames = spark.createDataFrame([(e, f) for e in (1, 2) for f in (*range(20), 32_767, 32_768, 70_000)] + [(None, 3)], "ep long, frame_index long")
    log = DeletionLog(spark, str(tmp_path / "log"), "ep")
    assert log.live(frames).count() == frames.count()
    log.delete(frames.filter("ep = 1 and frame_index > 15"), 1)
    log.delete(frames.filter("frame_index between 3 and 5"), 2)
    log.delete(frames.filter("frame_index between 3 and 5"), 2)
    rows = {(e, f) for e, f in frames.collect()}
    first = {r for r in rows if r[0] == 1 and r[1] > 15}
    second = {r for r in rows if 3 <= r[1] <= 5}
    assert {tuple(r) for r in log.live(frames).collect()} == rows - first - second
    assert {tuple(r) for r in log.aside(frames).collect()} == first | second
    log.undo(2)
    assert {tuple(r) for r in log.live(frames).collect()} == rows - first
    log.undo(1)
    assert {tuple(r) for r in log.live(frames).collect()} == rows


NESTED = """```yaml
# head
task: wipe   # note
meta:
  a: 1
  b:
    c: "x: y # z"
    d: 'it''s'
list:
- one
- two: 2
  three: 3
-
  - deep
  - er: 1
steps:
  - name: go
    ids:
      - 1
text: |
  line one
    line two

  last
url: http://x.y/z
empty:
noise line
after: >
  folded
  text
task: again
```"""


def test_nested_yaml(spark):
    want = {"meta/a": "1", "meta/b/c": "x: y # z", "meta/b/d": "it's", "list/0": "one", "list/1/two": "2", "list/1/three": "3", "list/2/0": "deep", "list/2/1/er": "1", "steps/0/name": "go", "steps/0/ids/0": "1", "text": "line one\n  line two\n\nlast", "url": "http://x.y/z", "empty": "", "after": "folded text", "task": "again"}
    rows = spark.createDataFrame([(1, NESTED), (2, None), (3, ""), (4, "- a\n- b: c"), (5, "no yaml"), (6, "a:\r\n  - b\r\n")], "i int, t string")
    got = {r["i"]: r["m"] for r in rows.select("i", J.nested_yaml(F.col("t")).alias("m")).collect()}
    assert got == {1: want, 2: None, 3: {}, 4: {"0": "a", "1/b": "c"}, 5: {}, 6: {"a/0": "b"}}


def test_yaml_is_linear(spark):
    import time

    lines = [f"{'  ' * (i % 4)}k{i}: v{i}" for i in range(10_000)]
    began = time.time()
    assert len(J.yaml_paths("\n".join(lines))) == 2_500
    assert time.time() - began < 1
    flat = spark.createDataFrame([("\n".join(f"k{i % 9000}: v{i}" for i in range(n)),) for n in (10, 10_000)], "t string")
    flat.select(F.map_keys(J.flat_yaml(F.col("t")))).collect()
    began = time.time()
    got = [r[0] for r in flat.select(J.flat_yaml(F.col("t"))).collect()]
    assert time.time() - began < 5 and got[1]["k3"] == "v9003" and len(got[1]) == 9000 and list(got[0]) == [f"k{i}" for i in range(10)]
