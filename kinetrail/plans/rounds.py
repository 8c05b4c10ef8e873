"""Queries over prompts, second votes, rollouts, spec shapes, back-fills and conversions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts as U
from ..operators import memory as R
from ..operators import quality as Q
from ..operators import sampling as P
from ..operators import scoring as C
from ..operators import stats as S
from ..sources import jsonl
from ..sources.conversion import convert
from ..sources.work import scratch
from .base import FR, event_frames, query, r6, read
from .datasets import h

LINE = "'Action_Command: ' || event_type || ' | Working_Memory: ' || coalesce(CASE WHEN event_id % 4 <> 0 THEN user_id::VARCHAR END, 'None') || ' | Episodic_Context: None'"
NAMES = "'<image_table>' || CASE WHEN event_id % 2 = 0 THEN ' <image_wrist>' ELSE '' END"
STATUSES = ["DONE", "NOT DONE", "UNCERTAIN"]


@query("memory_prompts", f"SELECT event_id, 'Detect.' || chr(10) || 'Task: ' || event_type || chr(10) || 'Memory: ' || {LINE} || chr(10) || 'Images: ' || {NAMES} || chr(10) AS detect, 'Update.' || chr(10) || 'Task: ' || event_type || chr(10) || 'Previous_Memory: ' || {LINE} || chr(10) || CASE WHEN user_id % 3 = 0 THEN '' ELSE chr(10) || 'Allowed_Action_Commands:' || chr(10) || 'go, ' || user_id || chr(10) END || 'Images: ' || {NAMES} AS update FROM events")
def memory_prompts(spark, d):
    """Memories without an episodic context; some lack the working memory, some have no commands."""
    e = read(spark, d, "events").select("event_id", "user_id", "event_type")
    some = F.map_filter(F.create_map(F.lit("Action_Command"), F.col("event_type"), F.lit("Working_Memory"), F.when(F.col("event_id") % 4 != 0, F.col("user_id").cast("string"))), lambda k, v: v.isNotNull())
    commands = F.when(F.col("user_id") % 3 != 0, F.concat(F.lit(" go, "), F.col("user_id").cast("string"), F.lit("\n"))).otherwise(F.lit("  "))
    images = F.when(F.col("event_id") % 2 == 0, 2).otherwise(1)
    return e.select("event_id", U.detect_prompt("Detect.", F.col("event_type"), some, images).alias("detect"), U.update_prompt("Update.", F.col("event_type"), some, images, commands, line_end=False).alias("update"))


@query("row_prompts", "WITH m AS (SELECT *, 'Action_Command: ' || event_type || chr(10) || 'Working_Memory: ' || CASE WHEN event_id % 4 = 0 THEN 'null' ELSE user_id::VARCHAR END AS memory FROM events) SELECT event_id, CASE event_type WHEN 'click' THEN 'D' || chr(10) || 'Global_Instruction:' || chr(10) || props || chr(10) || chr(10) || 'Current_Memory:' || chr(10) || memory WHEN 'view' THEN 'U' || chr(10) || 'Global_Instruction:' || chr(10) || props || chr(10) || chr(10) || 'Prev_Memory:' || chr(10) || memory || CASE WHEN user_id % 2 = 0 THEN chr(10) || chr(10) || 'Allowed_Action_Commands:' || chr(10) || '- go' || chr(10) || '- ' || user_id ELSE '' END ELSE props END AS prompt, CASE event_type WHEN 'click' THEN 'Event_Detected: ' || (value >= 50)::VARCHAR WHEN 'view' THEN 'Working_Memory: ' || user_id || chr(10) || 'Episodic_Context: ' || chr(10) || 'Action_Command: view' ELSE event_type END AS target FROM m")
def row_prompts(spark, d):
    """Clicks are detect rows, views update rows, the others conversations with an earlier question."""
    e = read(spark, d, "events")
    user = F.col("user_id").cast("string")
    memory = F.create_map(F.lit("Action_Command"), F.col("event_type"), F.lit("Working_Memory"), F.when(F.col("event_id") % 4 != 0, user))
    label = F.create_map(F.lit("Event_Detected"), (F.col("value") >= 50).cast("string"), F.lit("Working_Memory"), user, F.lit("Action_Command"), F.col("event_type"))
    mode = F.when(F.col("event_type") == "click", "detect").when(F.col("event_type") == "view", "update")
    turn = lambda who, x: F.struct(F.lit(who).alias("from"), x.alias("value"))
    turns = F.array(turn("user", F.lit("earlier")), turn("user", F.col("props")), turn("assistant", F.col("event_type")))
    allowed = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("go"), user))
    got = U.prompt_and_target(mode, F.concat(F.lit(" "), "props", F.lit("\n")), memory, label, allowed, turns, {"detect": "D", "update": "U"})
    return e.select("event_id", got.alias("g")).select("event_id", "g.prompt", "g.target")


VOTED = (
    "WITH v AS (SELECT user_id, event_id % 2 AS round, CASE event_type WHEN 'purchase' THEN 'DONE' WHEN 'error' THEN 'NOT DONE' WHEN 'view' THEN 'UNCERTAIN' END AS status, event_id, row_number() OVER (PARTITION BY user_id, event_id % 2, event_type ORDER BY len(event_type) + len(props), event_id) AS k FROM events), "
    "c AS (SELECT user_id, round, status, count(*) AS n, max(event_id) FILTER (k = 1) AS pick FROM v WHERE status IS NOT NULL GROUP BY ALL), "
    "m AS (SELECT *, row_number() OVER (PARTITION BY user_id, round ORDER BY n DESC, status) AS best FROM c), "
    "g AS (SELECT user_id, round, max(status) FILTER (best = 1) AS status, max(pick) FILTER (best = 1) AS event_id, coalesce(sum(n) FILTER (status = 'DONE'), 0)::BIGINT AS d, coalesce(sum(n) FILTER (status = 'NOT DONE'), 0)::BIGINT AS nd, coalesce(sum(n) FILTER (status = 'UNCERTAIN'), 0)::BIGINT AS u FROM m GROUP BY ALL), "
    "j AS (SELECT a.*, b.status AS s2, b.event_id AS e2, b.d AS d2, b.nd AS nd2, b.u AS u2, a.status = 'UNCERTAIN' AS retried, a.status = 'UNCERTAIN' AND coalesce(b.status <> 'UNCERTAIN', false) AS replaced FROM g a LEFT JOIN g b ON b.user_id = a.user_id AND b.round = 1 WHERE a.round = 0) "
    "SELECT user_id, CASE WHEN replaced THEN s2 ELSE status END AS status, CASE WHEN replaced THEN e2 ELSE event_id END AS event_id, d + CASE WHEN replaced THEN d2 ELSE 0 END AS votes_done, nd + CASE WHEN replaced THEN nd2 ELSE 0 END AS votes_not_done, u + CASE WHEN replaced THEN u2 ELSE 0 END AS votes_uncertain, retried, replaced FROM j"
)


@query("revote_maps", VOTED)
def revote_maps(spark, d):
    """Even events are the first votes, odd ones the second round of undecided users."""
    e = read(spark, d, "events").select("user_id", "event_type", "props", "event_id")
    status = F.when(F.col("event_type") == "purchase", "DONE").when(F.col("event_type") == "error", "NOT DONE").when(F.col("event_type") == "view", "UNCERTAIN")
    votes = lambda r: C.majority_texts(e.filter(F.col("event_id") % 2 == r).withColumn("status", status), "user_id", "status", "event_type", "props", STATUSES, "event_id")
    return C.revote(votes(0), votes(1), "user_id", "status", STATUSES, "UNCERTAIN").drop("event_type", "props")


@query("rollout_stats", f"WITH {FR}, s AS (SELECT user_id, -ln(greatest(value / 100, 1e-6)) AS fit, CASE WHEN event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY frame_index) THEN 1 ELSE 0 END AS s FROM fr) SELECT CASE WHEN grouping(user_id) = 0 THEN 'episode' ELSE 'all' END AS level, user_id, count(*) AS steps, round(sum(fit - 0.25 * s), 6) AS reward_sum, round(avg(fit - 0.25 * s), 6) AS reward_mean, round(avg(fit), 6) AS fit_mean, round(avg(-0.25::DOUBLE * s), 6) + 0.0 AS cons_mean, sum(s)::BIGINT AS switches, round(avg(s::DOUBLE), 6) AS switch_rate FROM s GROUP BY ROLLUP (user_id)")
def rollout_stats(spark, d):
    frames = event_frames(spark, d, "event_type", "value")
    got = S.rollout_stats(frames, "user_id", "frame_index", "event_type", F.col("value") / 100, 0.25)
    return got.select("level", "user_id", "steps", r6(F.col("reward_sum"), "reward_sum"), r6(F.col("reward_mean"), "reward_mean"), r6(F.col("fit_mean"), "fit_mean"), (F.round("cons_mean", 6) + 0.0).alias("cons_mean"), "switches", r6(F.col("switch_rate"), "switch_rate"))


SHAPES = (
    "WITH s AS (SELECT conv_id, count(*) AS n, arg_max(role, turn) AS last, bool_or(role = 'assistant') AS answered, bool_or(turn % 5 = 4) AS short FROM conversations GROUP BY 1) "
    "SELECT conv_id AS task_id, unnest(list_filter([CASE WHEN conv_id % 3 = 0 THEN 'grid_rows' END, CASE WHEN conv_id % 3 = 0 THEN 'intra_rows' END, CASE WHEN conv_id % 3 = 0 AND conv_id % 2 = 0 THEN 'filter_rows' END, CASE WHEN conv_id % 2 = 0 AND n - 1 + (conv_id % 4 = 0)::INT <> 1 THEN 'filter_row_length' END, CASE WHEN conv_id % 4 = 0 THEN 'grid_row_length' END, CASE WHEN last <> 'assistant' THEN 'row_end_not_done' END, CASE WHEN conv_id % 5 = 0 THEN 'negatives_missing' END, CASE WHEN NOT answered THEN 'commands_without_done' END, CASE WHEN short THEN 'state_without_episodic_context' END], lambda x: x IS NOT NULL)) AS issue FROM s"
)


@query("spec_shapes", SHAPES)
def spec_shapes(spark, d):
    """Conversations as specs of one row whose states are the turns; declared sizes, filters and negatives are wrong or absent for some."""
    t = read(spark, d, "conversations")
    command = F.when(F.col("role") == "assistant", " Done").otherwise(F.col("role"))
    cell = F.create_map(F.lit("Action_Command"), command, F.lit("Working_Memory"), F.length("text").cast("string"), F.lit("Episodic_Context"), F.lit(""))
    cell = F.when(F.col("turn") % 5 == 4, F.map_filter(cell, lambda k, v: k != "Episodic_Context")).otherwise(cell)
    states = t.select(F.col("conv_id").alias("task_id"), F.struct("turn", command.alias("c"), F.to_json(cell).alias("cell")).alias("s"))
    by = states.groupBy("task_id").agg(F.array_sort(F.collect_list("s")).alias("s"))  # turns of one conversation
    n = F.size("s")
    specs = by.select(
        "task_id",
        F.when(F.col("task_id") % 3 == 0, 1).otherwise(0).alias("inter"),
        F.array(n - 1 + (F.col("task_id") % 4 == 0).cast("int")).alias("intra"),
        F.array(F.transform("s", lambda x: F.from_json(x["cell"], "map<string,string>"))).alias("grid"),
        F.when(F.col("task_id") % 2 == 0, F.array(F.array(F.lit("any")))).alias("filters"),
        F.when(F.col("task_id") % 5 != 0, -1).alias("negatives"),
        F.transform("s", lambda x: x["c"]).alias("commands"),
    )
    return R.shape_problems(specs, ["Action_Command", "Working_Memory", "Episodic_Context"])


@query("spec_pool", "SELECT doc_id, task_id FROM documents JOIN (VALUES ('english', 'en'), ('every', NULL), ('french', 'fr'), ('none', 'any'), ('all again', NULL)) s(task_id, wanted) ON wanted IS NULL OR wanted = lang")
def spec_pool(spark, d):
    specs = spark.createDataFrame([("english", "en"), ("every", None), ("french", "fr"), ("none", "any"), ("all again", None)], "task_id string, wanted string")
    return R.pool(read(spark, d, "documents").select("doc_id", "lang"), specs, "lang", "wanted", "doc_id").select("doc_id", "task_id")


@query("assigned_episodes", f"WITH {FR}, e AS (SELECT user_id, max(event_type) FILTER (frame_index = 0) AS text, count(*) FILTER (value >= 98) AS n FROM fr GROUP BY 1), f AS (SELECT task_id, text, min(inter * 10 + step) AS place FROM (VALUES ('buy', 1, 0, 'click'), ('buy', 0, 1, 'click'), ('buy', 0, 0, 'purchase'), ('look', 0, 0, 'click'), ('look', 1, 1, 'view')) v(task_id, inter, step, text) GROUP BY ALL) SELECT user_id, task_id, place // 10 AS inter, place % 10 AS step FROM e JOIN f USING (text) WHERE n > 0")
def assigned_episodes(spark, d):
    """An episode's text is its first event; its event frames are those of high values."""
    fr = event_frames(spark, d, "event_type", "value")
    padded = F.concat(F.lit(" "), F.max(F.when(F.col("frame_index") == 0, F.col("event_type"))), F.lit("\n"))
    episodes = fr.groupBy("user_id").agg(padded.alias("text"), F.collect_list(F.when(F.col("value") >= 98, F.col("frame_index"))).alias("event_frames"))  # frames of one episode
    filters = spark.createDataFrame([("buy", 1, 0, "click"), ("buy", 0, 1, "click"), ("buy", 0, 0, "purchase"), ("look", 0, 0, "click"), ("look", 1, 1, "view")], "task_id string, inter int, step int, text string")
    return R.assigned(episodes, filters, "text", "event_frames").select("user_id", "task_id", "inter", "step")


@query("permuted_frames", f"WITH {FR}, l AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM fr) SELECT event_id, row_number() OVER (ORDER BY {h('event_id', 4)}, event_id) - 1 AS position FROM l WHERE frame_index >= 2 AND frame_index < n - 3")
def permuted_frames(spark, d):
    """All frames but the first two and the last three of their episode, in a seeded shuffle."""
    kept = P.drop_edges(event_frames(spark, d).select("event_id", "user_id", "frame_index"), "user_id", 2, 3)
    return P.permuted(kept.select("event_id"), "event_id", 4)


@query("required_keys", "SELECT event_id, unnest(list_filter([CASE WHEN value <= 5 THEN 'missing_task' END, CASE WHEN user_id % 5 = 0 THEN 'missing_prev_status' END, CASE WHEN event_type = 'view' THEN 'missing_any_image' END, CASE WHEN user_id % 3 = 2 THEN 'missing_any_previous' END, CASE WHEN event_id % 7 = 0 THEN 'missing_any_label' END], lambda x: x IS NOT NULL)) AS issue FROM events WHERE event_id % 11 <> 0 UNION ALL SELECT event_id, 'row_not_object' FROM events WHERE event_id % 11 = 0")
def required_keys(spark, d):
    e = read(spark, d, "events")
    at = lambda when, name: F.when(when, F.col("props")).alias(name)
    user = F.col("user_id")
    row = F.to_json(F.struct(at(F.col("value") > 5, "task"), at(user % 5 != 0, "prev_status"), at(F.col("event_type") == "click", "image_path"), at(~F.col("event_type").isin("click", "view"), "images"), at(user % 3 == 0, "prev"), at(user % 3 == 1, "prev_desc"), at(F.col("event_id") % 7 != 0, "target_text")))
    row = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("["), row)).otherwise(row)
    rules = Q.key_rules(F.col("row"), ["task", "prev_status"], {"image": ["images", "image_path"], "previous": ["prev", "prev_desc"], "label": ["target_text", "api_output"]})
    return Q.issues(e.select("event_id", row.alias("row")), ["event_id"], rules)


@query("stats_backfill", f"WITH {FR}, n AS (SELECT user_id, count(*) AS c FROM events GROUP BY 1), k AS (SELECT user_id, c, greatest(least(10, c), least(floor(c ** 0.75), 10000))::BIGINT AS m FROM n), i AS (SELECT *, unnest(range(m)) AS i FROM k), s AS (SELECT user_id, round_even(i * ((c - 1)::DOUBLE / greatest(m - 1, 1)), 0)::BIGINT AS frame_index FROM i), l AS (SELECT user_id, 'value' AS feature, value AS x FROM fr UNION ALL SELECT user_id, 'event_id', event_id::DOUBLE FROM fr JOIN s USING (user_id, frame_index)) SELECT user_id, feature, round(min(x), 6) AS low, round(max(x), 6) AS high, round(avg(x), 6) AS mean, count(*) AS n FROM l GROUP BY ALL")
def stats_backfill(spark, d):
    """Statistics of a third of the users are there; the others' are appended."""
    path, frames = scratch(spark, "stats"), event_frames(spark, d, "value").select("user_id", "frame_index", "event_id", "value")
    fill = lambda rows, known: S.backfill(rows, known, "user_id", ["value"], ["event_id"], least=10).write.mode("append").parquet(path)
    fill(frames.filter("user_id % 3 = 0"), frames.select("user_id").limit(0))
    fill(frames, spark.read.parquet(path))
    got = spark.read.parquet(path)
    return got.select("user_id", "feature", r6(F.col("min"), "low"), r6(F.col("max"), "high"), r6(F.col("mean"), "mean"), F.col("count").alias("n"))


@query("dataset_conversion", f"WITH {FR}, e AS (SELECT *, dense_rank() OVER (ORDER BY user_id) - 1 AS episode_index FROM fr), t AS (SELECT episode_index, event_type, min(frame_index) AS f, count(*) AS n FROM e GROUP BY ALL) SELECT episode_index, string_agg(event_type, '|' ORDER BY f) AS tasks, sum(n)::BIGINT AS length, (SELECT count(DISTINCT event_type) FROM events) AS total_tasks FROM t GROUP BY 1")
def dataset_conversion(spark, d):
    """Users numbered without gaps are episodes; event types are tasks."""
    root = f"{scratch(spark, 'converted')}/set"
    events = read(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    numbers = S.dictionary(events, "user_id", "user_id").select("user_id", F.col("code").cast("long").alias("episode_index"))
    convert(events.join(numbers, "user_id"), root, "episode_index", ["ts", "event_id"], 50, "2.0", 5.0, column="event_type")
    info = jsonl.read_object(spark, f"{root}/meta/info.json")
    back = spark.read.schema("episode_index long, tasks array<string>, length long").json(f"{root}/meta/episodes")
    return back.select("episode_index", F.array_join("tasks", "|").alias("tasks"), "length", F.lit(info["total_tasks"]).cast("long").alias("total_tasks"))
