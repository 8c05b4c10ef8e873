"""Queries that build training rows, and text and JSON functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import jsontext as J
from ..functions import text as X
from ..operators import memory as R
from ..operators import timeseries as T
from .base import FR, event_frames, query, read

#: The task spec of these queries: (task, states of each row).
GRID = {"buy": [["browse", "pay", "done"]], "look": [["open", "scroll"], ["close", "done"]]}
STATES = [(t, i, s, len(row), c, event) for t, grid in GRID.items() for event in [{"buy": "purchase", "look": "view"}[t]] for i, row in enumerate(grid) for s, c in enumerate(row)]
SPEC = "spec AS (SELECT * FROM (VALUES " + ", ".join(str(x) for x in STATES) + ") v(task_id, inter, step, n_steps, command, event_type))"


def spec_table(spark: SparkSession) -> DataFrame:
    """The spec as nested grids, exploded to states; a handful of rows."""
    rows = [(t, [[{"command": c} for c in row] for row in grid], {"buy": "purchase", "look": "view"}[t]) for t, grid in GRID.items()]
    specs = spark.createDataFrame(rows, "task_id string, grid array<array<struct<command:string>>>, event_type string")
    return R.explode_spec(specs).join(F.broadcast(specs.select("task_id", "event_type")), "task_id")  # a spec file's size


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Detect rows per task state and label: scan, frames, spec explode, join, aggregate."""
    rows = R.detect_rows(event_frames(spark, d, "event_type", "value"), spec_table(spark), "user_id", F.col("value") >= 90, "event_type")
    return rows.groupBy("task_id", "inter", "step", "label").agg(F.count(F.lit(1)).alias("n"))


@query("detect_row_counts", f"WITH {FR}, {SPEC} SELECT task_id, inter, step, CASE WHEN value >= 90 THEN 'detect_pos' ELSE 'detect_neg' END AS label, count(*) AS n FROM fr JOIN spec USING (event_type) WHERE step < n_steps - 1 GROUP BY ALL")
def detect_counts(spark, d):
    return flagship(spark, d)


@query("detect_rows", f"WITH {FR}, {SPEC} SELECT 'DETECT-' || task_id || '-' || user_id || '-' || inter || '-' || step || '-' || frame_index AS uid, event_id, CASE WHEN value >= 90 THEN 'detect_pos' ELSE 'detect_neg' END AS label, 'Task: ' || task_id || '. Memory: ' || command || '.' AS prompt FROM fr JOIN spec USING (event_type) WHERE step < n_steps - 1")
def detect(spark, d):
    rows = R.detect_rows(event_frames(spark, d, "event_type", "value"), spec_table(spark), "user_id", F.col("value") >= 90, "event_type")
    uid = F.concat_ws("-", F.lit("DETECT"), *[F.col(c).cast("string") for c in ("task_id", "user_id", "inter", "step", "frame_index")])
    return rows.select(uid.alias("uid"), "event_id", "label", F.concat(F.lit("Task: "), "task_id", F.lit(". Memory: "), "command", F.lit(".")).alias("prompt"))


TRANS = f"{SPEC}, tr AS (SELECT task_id, event_type, inter, step, command AS command_from, lead(inter) OVER w AS inter_to, lead(step) OVER w AS step_to, lead(command) OVER w AS command_to FROM spec WINDOW w AS (PARTITION BY task_id ORDER BY inter, step)), tc AS (SELECT task_id, event_type, CASE WHEN inter = inter_to THEN 'intra' ELSE 'task_change' END AS kind, inter, step, command_from, inter_to, step_to, command_to FROM tr WHERE inter_to IS NOT NULL)"


@query("memory_transitions", "WITH t AS (SELECT conv_id AS task_id, turn // 2 AS inter, turn % 2 AS step, role AS command FROM conversations), n AS (SELECT *, lead(inter) OVER w AS inter_to, lead(step) OVER w AS step_to, lead(command) OVER w AS command_to FROM t WINDOW w AS (PARTITION BY task_id ORDER BY inter, step)) SELECT task_id, CASE WHEN inter = inter_to THEN 'intra' ELSE 'task_change' END AS kind, inter, step, command AS command_from, inter_to, step_to, command_to FROM n WHERE inter_to IS NOT NULL")
def transitions(spark, d):
    """Conversations as tasks of two states a row: the changes from turn to turn."""
    turn = F.col("turn")
    return R.transitions(read(spark, d, "conversations").select(F.col("conv_id").alias("task_id"), F.floor(turn / 2).alias("inter"), (turn % 2).alias("step"), F.col("role").alias("command")))


@query("update_rows", f"WITH {FR}, {TRANS} SELECT event_id, tc.task_id, inter, step, 'update_' || kind AS label, command_from, command_to FROM fr JOIN tc USING (event_type) WHERE value >= 90")
def updates(spark, d):
    spec = spec_table(spark)
    changes = R.transitions(spec).join(spec.select("task_id", "event_type").distinct(), "task_id")
    events = event_frames(spark, d, "event_type", "value").filter("value >= 90")
    return R.update_rows(events, changes, ["event_type"]).select("event_id", "task_id", "inter", "step", "label", "command_from", "command_to")


@query("first_matching_step", f"WITH {FR}, {SPEC}, m AS (SELECT event_id, task_id, inter, step, row_number() OVER (PARTITION BY event_id ORDER BY task_id, inter, step) AS k FROM fr JOIN spec USING (event_type)) SELECT event_id, task_id, inter, step FROM m WHERE k = 1")
def first_step(spark, d):
    """The spec side is reduced to its first state per filter before the join."""
    best = spec_table(spark).groupBy("event_type").agg(F.min(F.struct("task_id", "inter", "step")).alias("b"))
    return event_frames(spark, d, "event_type").join(best, "event_type").select("event_id", "b.task_id", "b.inter", "b.step")


@query("metadata_filter", "SELECT doc_id FROM documents WHERE lang IS NOT DISTINCT FROM 'en' AND source IS NOT DISTINCT FROM 'src1'")
def metadata_filter(spark, d):
    wanted = {"lang": "en", "source": "src1"}
    bad = F.lit(True)
    for k, v in wanted.items():
        bad = bad & F.col(k).eqNullSafe(v)
    return read(spark, d, "documents").filter(bad).select("doc_id")


@query("variant_frame_rows", f"WITH {FR}, v AS (SELECT unnest([0, 1, 2]) AS base), s AS (SELECT user_id, frame_index, base, least(3, greatest(0, base + sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY base, user_id ORDER BY frame_index)))::INTEGER AS state FROM fr, v) SELECT user_id, frame_index, base, state, coalesce(lag(state) OVER (PARTITION BY base, user_id ORDER BY frame_index), state) AS previous_state FROM s")
def variants(spark, d):
    """Every frame once per starting state; the running count is made once, then shared."""
    fr = event_frames(spark, d, "event_type")
    n = F.sum((F.col("event_type") == "purchase").cast("int")).over(Window.partitionBy("user_id").orderBy("frame_index"))
    rows = fr.withColumn("n", n).withColumn("before", F.lag("n", 1).over(Window.partitionBy("user_id").orderBy("frame_index")))
    rows = rows.withColumn("base", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    clamp = lambda x: F.least(F.lit(3), F.greatest(F.lit(0), F.col("base") + x)).cast("int")
    return rows.select("user_id", "frame_index", "base", clamp(F.col("n")).alias("state"), F.when(F.col("before").isNull(), clamp(F.col("n"))).otherwise(clamp(F.col("before"))).alias("previous_state"))


@query("transition_frame", f"WITH {FR}, e AS (SELECT user_id, list(frame_index ORDER BY frame_index) AS l FROM fr WHERE event_type = 'signup' GROUP BY 1) SELECT user_id, l[least(3, len(l))] AS frame FROM e")
def transition_frame(spark, d):
    e = event_frames(spark, d, "event_type").filter("event_type = 'signup'").groupBy("user_id").agg(F.array_sort(F.collect_list("frame_index")).alias("l"))
    return e.select("user_id", R.transition_frame(F.col("l")).alias("frame"))


@query("event_frame_precedence", f"WITH {FR}, e AS (SELECT user_id, coalesce(list(frame_index ORDER BY frame_index) FILTER (event_type = 'purchase'), []) AS a, coalesce(list(frame_index ORDER BY frame_index) FILTER (event_type = 'signup'), []) AS b, min(frame_index) FILTER (event_type = 'error') AS c FROM fr GROUP BY 1) SELECT user_id, CASE WHEN len(a) > 0 THEN a WHEN len(b) > 0 THEN b WHEN c IS NOT NULL THEN [c] END AS events FROM e")
def precedence(spark, d):
    fr = event_frames(spark, d, "event_type")
    of = lambda t: F.collect_list(F.when(F.col("event_type") == t, F.col("frame_index")))
    e = fr.groupBy("user_id").agg(of("purchase").alias("a"), of("signup").alias("b"), F.min(F.when(F.col("event_type") == "error", F.col("frame_index"))).alias("c"))
    none = F.expr("cast(array() as array<struct<frame:bigint>>)")
    return e.select("user_id", R.event_frames(F.col("a"), F.col("b"), none, F.col("c")).alias("events"))


@query("gated_episodes", f"WITH {FR}, e AS (SELECT user_id, count(*) AS c, max(frame_index) FILTER (event_type = 'signup') AS e FROM fr GROUP BY 1), g AS (SELECT user_id, greatest(1, least(40, c)) AS n_frames, e FROM e) SELECT user_id, n_frames, greatest(0, least(e, n_frames - 1)) AS event FROM g WHERE e IS NOT NULL")
def gated(spark, d):
    e = event_frames(spark, d, "event_type").groupBy("user_id").agg(F.count(F.lit(1)).alias("camera_frames"), F.max(F.when(F.col("event_type") == "signup", F.col("frame_index"))).alias("event"))
    return R.gated(e.withColumn("meta_frames", F.lit(40).cast("long"))).select("user_id", "n_frames", "event")


@query("soft_delete_after_last_event", f"WITH {FR}, l AS (SELECT user_id, max(frame_index) FILTER (event_type = 'purchase') AS m FROM fr GROUP BY 1) SELECT f.user_id, frame_index FROM fr f JOIN l USING (user_id) WHERE frame_index <= m")
def soft_delete(spark, d):
    last = F.max(F.when(F.col("event_type") == "purchase", F.col("frame_index"))).over(Window.partitionBy("user_id"))
    return event_frames(spark, d, "event_type").withColumn("m", last).filter("frame_index <= m").select("user_id", "frame_index")


@query("aligned_pairs", f"WITH {FR}, a AS (SELECT DISTINCT user_id, floor(value / 10)::BIGINT AS f FROM fr WHERE event_type = 'view'), b AS (SELECT DISTINCT user_id, floor(value / 10)::BIGINT AS f FROM fr WHERE event_type = 'click') SELECT user_id, f FROM a JOIN b USING (user_id, f)")
def aligned(spark, d):
    fr = event_frames(spark, d, "event_type", "value").withColumn("f", F.floor(F.col("value") / 10))
    side = lambda t: fr.filter(F.col("event_type") == t).select("user_id", "f").distinct()
    return side("view").join(side("click"), ["user_id", "f"])


@query("row_uids", "SELECT doc_id, substr(sha1(source || '::' || lang || '::' || doc_id), 1, 16) AS uid FROM documents")
def uids(spark, d):
    return read(spark, d, "documents").select("doc_id", R.row_uid(F.col("source"), F.col("lang"), F.col("doc_id")).alias("uid"))


@query("group_row_positions", "SELECT source, list(doc_id ORDER BY doc_id) AS rows FROM documents WHERE source IS NOT NULL GROUP BY source")
def group_rows(spark, d):
    return read(spark, d, "documents").filter("source is not null").groupBy("source").agg(F.array_sort(F.collect_list("doc_id")).alias("rows"))


@query("task_index_cascade", "SELECT d.doc_id, coalesce(l.quality::BIGINT, CASE lang WHEN 'en' THEN 10 WHEN 'de' THEN 11 END, -1)::BIGINT AS task_index FROM documents d LEFT JOIN labels l USING (doc_id)")
def cascade(spark, d):
    by_text = F.when(F.col("lang") == "en", 10).when(F.col("lang") == "de", 11)
    got = read(spark, d, "documents").select("doc_id", "lang").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return got.select("doc_id", F.coalesce(F.col("quality").cast("long"), by_text, F.lit(-1)).cast("long").alias("task_index"))


# text ---------------------------------------------------------------------------


@query("text_normalize", r"SELECT conv_id, turn, coalesce(trim(regexp_replace(text, '\s+', ' ', 'g')), 'None') AS norm, CASE WHEN lower(trim(role)) IN ('user', 'yes', '1') THEN true ELSE false END AS is_user FROM conversations")
def text_normalize(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", X.norm_str(F.col("text")).alias("norm"), F.lower(F.trim("role")).isin("user", "yes", "1").alias("is_user"))


@query("bool_normalize", "SELECT event_id, CASE WHEN (props->>'$.k')::INT % 4 = 1 THEN true WHEN (props->>'$.k')::INT % 4 = 0 THEN false END AS flag FROM events")
def bool_normalize(spark, d):
    k = F.get_json_object("props", "$.k").cast("int") % 4
    word = F.when(k == 1, F.lit(" Yes ")).when(k == 0, F.lit("0")).when(k == 2, F.lit("maybe"))
    return read(spark, d, "events").select("event_id", X.norm_bool(word).alias("flag"))


@query("line_filters", "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, len(list_filter(list_transform(l, lambda x: trim(x, ' ')), lambda x: x <> ''))::INTEGER AS n_lines, md5(array_to_string(list_filter(l, lambda x: NOT starts_with(ltrim(x, ' '), 'Licensed')), chr(10))) AS kept FROM l")
def line_filters(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(X.lines(F.col("text"))).alias("n_lines"), F.md5(X.drop_lines(F.col("text"), ["Licensed"])).alias("kept"))


STEPS = " ".join(f"WHEN abs(n_chars) < 1e{3 * i + 3} THEN round_even(n_chars / 1e{3 * i}, 0)::BIGINT || '{x}'" for i, x in enumerate(["", "K", "M", "B"]))


@query("big_numbers", f"SELECT doc_id, CASE {STEPS} END AS human FROM documents")
def big_numbers(spark, d):
    return read(spark, d, "documents").select("doc_id", X.big_number(F.col("n_chars")).alias("human"))


@query("id_parsing", "SELECT DISTINCT user_id, user_id::INTEGER AS episode, (user_id + 7)::INTEGER AS frame FROM events")
def id_parsing(spark, d):
    users = read(spark, d, "events").select("user_id").distinct()
    return users.select("user_id", X.episode_number(F.format_string("episode_%06d", "user_id")).alias("episode"), X.frame_number(F.format_string("frame_%06d.jpg", F.col("user_id") + 7)).alias("frame"))


@query("status_coercion", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'PURCHASE' WHEN event_type = 'view' THEN 'VIEW' ELSE 'UNCERTAIN' END AS status FROM events")
def status(spark, d):
    return read(spark, d, "events").select("event_id", X.coerce_status(F.concat(F.lit(" "), F.col("event_type")), ["PURCHASE", "VIEW"], "UNCERTAIN").alias("status"))


@query("previews", "SELECT doc_id, left(replace(text, chr(10), ' '), 40) AS preview FROM documents")
def previews(spark, d):
    return read(spark, d, "documents").select("doc_id", X.preview(F.col("text"), 40).alias("preview"))


@query("row_identifiers", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'u' || event_id WHEN event_id % 3 = 1 THEN 'c|' || user_id || '|' || event_id ELSE 'unknown' END AS rid FROM events")
def identifiers(spark, d):
    k = F.col("event_id") % 3
    uid = F.when(k == 0, F.concat(F.lit("u"), F.col("event_id").cast("string"))).otherwise(F.lit(""))
    return read(spark, d, "events").select("event_id", X.row_identifier(uid, F.when(k == 1, F.lit("c")), F.col("user_id"), F.col("event_id")).alias("rid"))


@query("url_dataset_names", "SELECT page_id, CASE WHEN url LIKE '%/videos/%' THEN split_part(split_part(url, '/videos/', 1), '/', -1) ELSE split_part(url, '/', -3) END AS grand, translate(url, ':/', '__') AS safe FROM pages")
def names(spark, d):
    return read(spark, d, "pages").select("page_id", X.dataset_name(F.col("url")).alias("grand"), X.safe_name(F.col("url")).alias("safe"))


@query("two_sentences", r"WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations), p AS (SELECT conv_id, turn, list_filter(list_transform(string_split(t, '.'), lambda x: trim(x)), lambda x: x <> '') AS p FROM t) SELECT conv_id, turn, CASE WHEN len(p) > 0 THEN array_to_string(p[1:2], '. ') || '.' ELSE '' END AS short FROM p")
def sentences(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", X.two_sentences(F.col("text")).alias("short"))


# JSON and conversations ---------------------------------------------------------


@query("json_extract_status", "SELECT event_id, (props->>'$.k')::INTEGER AS k FROM events")
def json_status(spark, d):
    return read(spark, d, "events").select("event_id", J.outer_object(F.concat(F.lit("note "), "props", F.lit(" end"))).alias("o")).select("event_id", F.get_json_object("o", "$.k").cast("int").alias("k"))


@query("json_salvage", """SELECT event_id, 'he said "' || (props->>'$.k') || '" now' AS note, 'NOT "' || event_type || '"' AS status, props->>'$.k' AS k FROM events""")
def salvage(spark, d):
    """Quotes inside values, curly quotes around keys, a line break in a value, a comma too many."""
    k = F.get_json_object("props", "$.k")
    reply = F.concat(F.lit('Sure: {“note”: "he said\n"'), k, F.lit('" now", "status": "NOT "'), F.col("event_type"), F.lit('"", "k": '), k, F.lit(",}"))
    text = J.clean(reply)
    return read(spark, d, "events").select("event_id", *[J.field(text, n).alias(n) for n in ("note", "status", "k")])


@query("flat_yaml", "SELECT event_id, event_type AS command, CAST(user_id AS VARCHAR) AS progress, true AS complete FROM events")
def flat_yaml(spark, d):
    text = F.concat(F.lit("```yaml\nCommand: "), "event_type", F.lit("\nnoise\nProgress: "), F.col("user_id").cast("string"), F.lit("\n```"))
    m = J.flat_yaml(text)
    return read(spark, d, "events").select("event_id", m.alias("m")).select("event_id", F.col("m")["Command"].alias("command"), F.col("m")["Progress"].alias("progress"), (F.size(F.array_except(F.array(F.lit("Command"), F.lit("Progress")), F.map_keys("m"))) == 0).alias("complete"))


@query("yaml_dump", "SELECT event_id, 'Command: ' || event_type || chr(10) || 'User: ' || user_id AS yaml FROM events")
def yaml_dump(spark, d):
    return read(spark, d, "events").select("event_id", J.dump_yaml({"Command": F.col("event_type"), "User": F.col("user_id")}).alias("yaml"))


@query("conversation_pairs", "SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS last_user, arg_max(text, turn) FILTER (role = 'assistant') AS last_assistant FROM conversations GROUP BY conv_id")
def pairs(spark, d):
    last = lambda r: F.max_by("text", F.when(F.col("role") == r, F.col("turn"))).alias(f"last_{r}")
    return read(spark, d, "conversations").groupBy("conv_id").agg(last("user"), last("assistant"))


@query("assistant_replaced", "SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'NEW' ELSE text END AS text FROM conversations UNION ALL SELECT conv_id, max(turn) + 1, 'NEW' FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'assistant') = 0")
def replaced(spark, d):
    turn = F.struct("turn", "role", "text")
    conv = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("c"))
    new = J.replace_assistant(F.col("c"), F.lit("NEW"))
    return conv.select("conv_id", F.explode(new).alias("x")).select("conv_id", "x.turn", "x.text")


@query("camera_order", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN ['side', 'wrist', 'back', 'top'] ELSE ['wrist', 'side', 'back', 'top'] END AS cameras FROM pages")
def cameras(spark, d):
    have = F.array(*[F.lit(x) for x in ("top", "wrist", "back", "side")])
    meta = F.when(F.col("page_id") % 2 == 1, F.array(F.lit("wrist"), F.lit("side"), F.lit("gone")))
    return read(spark, d, "pages").select("page_id", J.ordered(have, meta, ["side", "wrist"]).alias("cameras"))


@query("flatten_struct", "SELECT event_id, event_type AS \"meta/kind\", user_id AS \"meta/who/id\" FROM events")
def flatten_struct(spark, d):
    nested = read(spark, d, "events").select("event_id", F.struct(F.col("event_type").alias("kind"), F.struct(F.col("user_id").alias("id")).alias("who")).alias("meta"))
    return J.flatten(nested)


@query("session_gaps", f"WITH {FR}, g AS (SELECT user_id, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY frame_index) <= 3600 THEN 0 ELSE 1 END AS n FROM fr) SELECT user_id, sum(n)::BIGINT AS sessions FROM g GROUP BY user_id")
def sessions(spark, d):
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("user_id").orderBy("frame_index"))
    return event_frames(spark, d).withColumn("n", F.when(gap <= 3600, 0).otherwise(1)).groupBy("user_id").agg(F.sum("n").alias("sessions"))


@query("tumbling_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def tumbling(spark, d):
    from ..streaming.streams import windowed_counts

    rows = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_counts(rows, "ts", "1 hour", "event_type", "value").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("regional_revenue", "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def revenue(spark, d):
    """N:1 lookups along keys; the dimension tables are joined as the optimizer sizes them."""
    line = read(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("x"))
    each = line.groupBy("l_orderkey").agg(F.sum("x").alias("x"))
    orders, customer = read(spark, d, "orders").select("o_orderkey", "o_custkey"), read(spark, d, "customer").select("c_custkey", "c_nationkey")
    by_nation = each.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("x").alias("x"))
    nation, region = read(spark, d, "nation"), read(spark, d, "region")
    return by_nation.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name", "n_name").agg(F.round(F.sum("x"), 2).alias("revenue"))
