"""Queries over tables that Spark derives from the given ones, writes and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsontext as J
from ..operators.deletions import DeletionLog
from ..sources import files, jsonl, layout, shards, versions
from ..sources.work import scratch
from .base import FR, event_frames, query, r6, read


@query("numbered_lines", "SELECT event_id, row_number() OVER (ORDER BY event_id) AS place, user_id FROM events")
def numbered_lines(spark, d):
    """Lines of several files in order of names; the numbers are those of the sorted rows."""
    path = scratch(spark, "lines")
    rows = read(spark, d, "events").select("event_id", "user_id")
    rows.repartitionByRange("event_id").sortWithinPartitions("event_id").write.json(path)
    lines = jsonl.numbered_lines(spark, path, "*.json")
    return lines.select("place", F.from_json("raw", "event_id long, user_id long").alias("v")).select("v.event_id", "place", "v.user_id")


@query("required_files_missing", "WITH c AS (SELECT user_id // 50 AS chunk, count(*) FILTER (event_type = 'purchase' AND value > 60) AS n FROM events GROUP BY 1) SELECT 'videos/episode_chunk=' || chunk AS path FROM c WHERE n = 0 OR chunk % 2 = 1")
def required_files(spark, d):
    """Every chunk needs a data and a video folder; videos are written for some, and what lies there is listed."""
    root = scratch(spark, "files")
    frames = event_frames(spark, d, "event_type", "value")
    layout.write_episodes(frames.select("user_id", "frame_index", "event_id"), root, 50, "user_id")
    shown = frames.filter("event_type = 'purchase' and value > 60").withColumn("episode_chunk", layout.chunk_of(F.col("user_id"), 50)).filter("episode_chunk % 2 = 0")
    shown.select("episode_chunk", "event_id").write.partitionBy("episode_chunk").parquet(f"{root}/videos")
    chunks = read(spark, d, "events").select(layout.chunk_of(F.col("user_id"), 50).alias("c")).distinct()
    wanted = chunks.select(F.explode(F.array(*[F.format_string(f"{kind}/episode_chunk=%d", "c") for kind in ("data", "videos")])).alias("path"))
    return files.missing(wanted, files.listing(spark, root, "*.parquet"), root)


@query("listed_chunks", "SELECT user_id // 50 AS episode_chunk, true AS has_files FROM events WHERE user_id < 500 GROUP BY 1")
def listed_chunks(spark, d):
    """The folders' keys are columns of the listing, and the filter prunes folders."""
    root = scratch(spark, "chunks")
    layout.write_episodes(event_frames(spark, d).select("user_id", "frame_index", "event_id"), root, 50, "user_id")
    found = files.listing(spark, f"{root}/data", "*.parquet", partitioned=True).filter("episode_chunk < 10")
    return found.groupBy(F.col("episode_chunk").cast("long").alias("episode_chunk")).agg((F.sum("length") > 0).alias("has_files"))


@query("nested_yaml", "SELECT event_id, event_type AS command, CAST(user_id AS VARCHAR) AS id, props->>'$.k' AS second, 'a # b' AS note, 10 AS n FROM events")
def nested_yaml(spark, d):
    head = F.concat(F.lit("```yaml\n# reply\nplan:\n  command: "), "event_type", F.lit("   # now\n  user:\n    id: '"), F.col("user_id").cast("string"))
    text = F.concat(head, F.lit("'\nsteps:\n- first\n- "), F.get_json_object("props", "$.k"), F.lit("\n- name: x\n  ids:\n    - 1\n    - 2\nnote: \"a # b\"\nraw: |\n  line: 1\n  two\nempty:\nnoise\n```"))
    rows = read(spark, d, "events").select("event_id", J.nested_yaml(text).alias("m"))
    m = F.col("m")
    return rows.select("event_id", m["plan/command"].alias("command"), m["plan/user/id"].alias("id"), m["steps/1"].alias("second"), m["note"].alias("note"), F.size("m").alias("n"))


@query("deletion_vectors", f"WITH {FR}, l AS (SELECT user_id, max(frame_index) FILTER (event_type = 'purchase') AS last FROM fr GROUP BY 1) SELECT event_id, frame_index > coalesce(last, frame_index) AS aside FROM fr JOIN l USING (user_id)")
def deletion_vectors(spark, d):
    """Frames after the last purchase are set aside; a second action takes errors too and is undone."""
    frames = event_frames(spark, d, "event_type").select("user_id", "frame_index", "event_id", "event_type")
    log = DeletionLog(spark, scratch(spark, "deleted"), "user_id")
    last = frames.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("frame_index").alias("last"))
    log.delete(frames.join(last, "user_id").filter("frame_index > last"), 1)
    log.delete(frames.filter("event_type = 'error'"), 2)
    log.undo(2)
    return log.marked(frames).select("event_id", "aside")


@query("version_upgrade", f"WITH {FR} SELECT event_id, user_id, frame_index, value FROM fr")
def version_upgrade(spark, d):
    """Version 1 holds the events, version 2 their frame numbers too; statistics per user must agree."""
    root = scratch(spark, "versions")
    versions.publish(read(spark, d, "events").select("event_id", "user_id", "ts", "value"), root)
    from ..operators.timeseries import frames

    stats = lambda df: df.groupBy("user_id").agg(F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"))
    versions.upgrade(spark, root, lambda df: frames(df, "user_id", "ts", "event_id"), stats, ["user_id"])
    return versions.read_current(spark, root).select("event_id", "user_id", "frame_index", "value")


@query("ledger_restart", "WITH i AS (SELECT source AS item, count(*) FILTER (lang = 'en') AS n FROM documents WHERE source IS NOT NULL GROUP BY 1) SELECT item, CASE WHEN n % 3 = 1 THEN 'failed' ELSE 'done' END AS state, CASE WHEN n % 3 = 0 THEN 2 ELSE 1 END AS run FROM i")
def ledger_restart(spark, d):
    """Sources as items: the first run leaves some unanswered, the second takes these and the failed ones."""
    docs = read(spark, d, "documents").filter("source is not null")
    sizes = docs.groupBy(F.col("source").alias("item")).agg(F.count_if(F.col("lang") == "en").alias("n"))
    ledger = versions.Ledger(spark, scratch(spark, "ledger"))
    work = lambda run: lambda batch: batch.join(sizes, "item").filter(F.lit(run > 1) | (F.col("n") % 3 != 0)).select("item", (F.col("n") % 3 != 1).alias("ok"), F.lit(str(run)).alias("note"))
    items = sizes.select("item")
    ledger.run(items, work(1), 1_000_000)
    ledger.run(ledger.pending(items).join(ledger.states(), "item", "left_anti"), work(2), 1_000_000)  # failed ones wait for another day
    return ledger.states().select("item", "state", F.col("note").cast("int").alias("run"))


@query("shard_replacement", "SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN -value ELSE value END AS value FROM events WHERE user_id % 7 <> 3 OR event_type IN ('view', 'error')")
def shard_replacement(spark, d):
    """Users of one remainder are rewritten with fewer rows, then errors by a keep-latest upsert, twice."""
    path = scratch(spark, "shards")
    rows = read(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.lit(0).alias("version"))
    shards.replace(rows, path, ["user_id"], 8)
    some = rows.filter("user_id % 7 = 3")
    shards.replace(some.filter("event_type in ('view', 'error')"), path, ["user_id"], 8, targets=some)
    latest = scratch(spark, "latest")
    shards.upsert(shards.read_shards(spark, path), latest, ["event_id"], "version", 8)
    for _ in range(2):
        shards.upsert(rows.filter("event_type = 'error'").withColumn("value", -F.col("value")).withColumn("version", F.lit(1)), latest, ["event_id"], "version", 8)
    return shards.read_shards(spark, latest).select("event_id", "user_id", "value")


@query("state_machine_steps", f"WITH {FR}, c AS (SELECT *, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w AS c FROM fr WINDOW w AS (PARTITION BY user_id ORDER BY frame_index)), p AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY user_id ORDER BY frame_index), 0) AS before FROM c) SELECT user_id, frame_index AS step, CASE WHEN before >= 3 THEN 'DONE' WHEN event_type = 'click' THEN 'UPDATE' WHEN event_type = 'error' THEN 'FAILED' ELSE 'DETECT' END AS mode, least(3, c)::INTEGER AS memory, sum(CASE WHEN event_type = 'error' AND before < 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY frame_index)::INTEGER AS failures FROM p")
def state_machine(spark, d):
    """Clicks count up to three, which is the end; an error's update fails and is a dead letter."""
    from ..streaming import machine

    source, out = scratch(spark, "steps"), scratch(spark, "machine")
    event_frames(spark, d, "event_type").select("user_id", "frame_index", "event_type").write.parquet(source)

    def update(memory, signal):
        if signal == "error":
            raise ValueError("no update")
        return str(int(memory) + 1), memory == "2"

    key, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    machine.use_state_store(spark)
    try:
        stream = spark.readStream.schema("user_id long, frame_index long, event_type string").parquet(source)
        steps = machine.memory_steps(stream, "user_id", "frame_index", "event_type", lambda m, s: s in ("click", "error"), update, start="0")
        machine.machine_sink(steps, out, f"{out}-checkpoint").awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    got = spark.read.schema("user_id long, step long, mode string, memory string, failures int").json(out)
    return got.select("user_id", "step", "mode", F.col("memory").cast("int").alias("memory"), "failures")


@query("strict_lines", "SELECT user_id, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1")
def strict_lines(spark, d):
    """Two appended batches of lines, read back strictly."""
    path = scratch(spark, "appended")
    rows = read(spark, d, "events").select("event_id", "user_id", "value", "event_type")
    for part in ("event_type = 'view'", "event_type <> 'view'"):
        jsonl.append_lines(rows.filter(part), path)
    back = jsonl.read_strict(spark, path, "event_id long, user_id long, value double", "*.json")
    return back.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value"), "total"))
