"""Queries over datasets: sampling, splitting, merging, quality, scoring."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.rng import hash_key, hash_uniform
from ..operators import merge as M
from ..operators import quality as Q
from ..operators import sampling as P
from ..operators import scoring as C
from .base import FR, event_frames, query, r6, read

U = "('0x' || substr(md5({k} || ':{s}'), 1, 8))::BIGINT / 4294967296.0"


def u(key: str, seed: int = 0) -> str:
    return U.format(k=f"CAST({key} AS VARCHAR)", s=seed)


def h(key: str, seed: int = 0) -> str:
    return f"md5(CAST({key} AS VARCHAR) || ':{seed}')"


@query("hash_bucket", f"SELECT doc_id, floor(({u('doc_id', 3)}) * 16)::BIGINT AS bucket FROM documents")
def bucket(spark, d):
    return read(spark, d, "documents").select("doc_id", F.floor(hash_uniform("doc_id", 3) * 16).alias("bucket"))


@query("interval_stratified_sample", f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY {h('doc_id')}, doc_id) AS r FROM documents) WHERE r <= 3")
def interval(spark, d):
    return P.interval_sample(read(spark, d, "documents").select("doc_id"), "doc_id", 10, 3)


@query("systematic_split", f"SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY doc_id // 10 ORDER BY {h('doc_id', 1)}, doc_id) = 1 THEN 'test' ELSE 'train' END AS split FROM documents")
def systematic_split(spark, d):
    rows = read(spark, d, "documents").select("doc_id")
    test = P.interval_sample(rows, "doc_id", 10, 1, seed=1).withColumn("split", F.lit("test"))
    return rows.join(test, "doc_id", "left").select("doc_id", F.coalesce("split", F.lit("train")).alias("split"))


@query("hash_split_episode", f"WITH e AS (SELECT DISTINCT user_id FROM events), r AS (SELECT user_id, row_number() OVER (ORDER BY {h('user_id', 42)}, user_id) AS r, count(*) OVER () AS n FROM e) SELECT user_id, CASE WHEN r <= round_even(n * 0.15, 0) THEN 'val' ELSE 'train' END AS split_round, CASE WHEN r <= floor(n * 0.15) THEN 'val' ELSE 'train' END AS split_floor FROM r")
def split(spark, d):
    e = read(spark, d, "events").select("user_id").distinct()
    one = P.split_episodes(e, "user_id", 0.15, True, 42).withColumnRenamed("split", "split_round")
    return one.join(P.split_episodes(e, "user_id", 0.15, False, 42).withColumnRenamed("split", "split_floor"), "user_id")


@query("membership_split", f"WITH v AS (SELECT source FROM (SELECT DISTINCT source FROM documents) WHERE {u('source', 5)} < 0.2) SELECT doc_id, CASE WHEN v.source IS NULL THEN 'train' ELSE 'val' END AS split FROM documents d LEFT JOIN v USING (source)")
def membership(spark, d):
    """Documents of the listed sources are ``val``; the list is a table that is joined."""
    docs = read(spark, d, "documents").select("doc_id", "source")
    listed = docs.select("source").distinct().filter(hash_uniform("source", 5) < 0.2).withColumn("__val", F.lit(True))
    return docs.join(listed, "source", "left").select("doc_id", F.when(F.col("__val"), "val").otherwise("train").alias("split"))


@query("weighted_resample", f"SELECT doc_id, i AS copy FROM (SELECT doc_id, unnest(range(1, 3 + CASE WHEN {u('doc_id', 7)} < 0.5 THEN 1 ELSE 0 END))::INTEGER AS i FROM documents)")
def resample(spark, d):
    return P.resample(read(spark, d, "documents").select("doc_id"), "doc_id", 2.5, 7)


@query("bernoulli_thin", f"SELECT doc_id FROM documents WHERE {u('doc_id', 8)} < 0.4")
def thin(spark, d):
    return P.resample(read(spark, d, "documents").select("doc_id"), "doc_id", 0.4, 8).select("doc_id")


@query("dedup_keep_first", "SELECT doc_id FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1 OR text = ''")
def dedup(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.when(F.col("text") == "", "").otherwise(F.sha2("text", 256)).alias("uid"))  # digests move, texts do not
    return P.keep_first(rows, "uid", "doc_id").select("doc_id")


@query("ordered_distinct", "SELECT source, min(doc_id) AS first_at FROM documents GROUP BY source")
def ordered_distinct(spark, d):
    return read(spark, d, "documents").groupBy("source").agg(F.min("doc_id").alias("first_at"))


@query("negatives_before_event", f"WITH {FR}, e AS (SELECT user_id, min(frame_index) AS e FROM fr WHERE event_type = 'purchase' GROUP BY 1), p AS (SELECT f.user_id, frame_index, row_number() OVER (PARTITION BY f.user_id ORDER BY md5(f.user_id || '-' || frame_index || ':0'), frame_index) AS r FROM fr f JOIN e USING (user_id) WHERE frame_index < e AND frame_index % 2 = 0) SELECT user_id, frame_index FROM p WHERE r <= 3")
def negatives(spark, d):
    fr = event_frames(spark, d, "event_type")
    event = fr.filter("event_type = 'purchase'").groupBy("user_id").agg(F.min("frame_index").alias("e"))
    return P.negatives(fr.join(event, "user_id"), "user_id", "e", 2, 3).select("user_id", "frame_index")


@query("shuffle_head", f"SELECT doc_id FROM documents ORDER BY {h('doc_id', 9)}, doc_id LIMIT 25")
def head(spark, d):
    return read(spark, d, "documents").select("doc_id").orderBy(hash_key("doc_id", 9), "doc_id").limit(25)


@query("mixed_batch", f"WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {h('doc_id')}, doc_id) - 1 AS k FROM labels), b AS (SELECT *, CASE quality WHEN 1 THEN k // 3 ELSE k // 1 END AS batch FROM r), c AS (SELECT batch FROM b GROUP BY batch HAVING count(*) = 4) SELECT doc_id, quality, batch FROM b JOIN c USING (batch)")
def mixed(spark, d):
    return P.mixed_batches(read(spark, d, "labels").select("doc_id", "quality"), "quality", "doc_id", {1: 3, 0: 1}).select("doc_id", "quality", "batch")


@query("sampler_weights", "WITH g AS (SELECT event_id, event_type = 'purchase' AS online, value >= 5 AS ok FROM events), s AS (SELECT online, count(*) FILTER (ok) AS n FROM g GROUP BY 1) SELECT event_id, round(CASE WHEN ok THEN (CASE WHEN online THEN 0.3 ELSE 0.7 END) / n ELSE 0 END, 12) AS weight FROM g JOIN s USING (online)")
def weights(spark, d):
    rows = read(spark, d, "events").select("event_id", "event_type", "value")
    group = F.when(F.col("event_type") == "purchase", "online").otherwise("offline")
    return P.sampler_weights(rows, group, F.col("value") >= 5, {"online": 0.3, "offline": 0.7}).select("event_id", F.round("weight", 12).alias("weight"))


@query("weighted_subset", f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY -ln({u('doc_id', 4)} + 1e-12) / n_chars, doc_id) AS r FROM documents) WHERE r <= 3")
def weighted_subset(spark, d):
    return P.weighted_order(read(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", F.col("n_chars"), 3, 4).select("source", "doc_id")


@query("stride_shard", "SELECT user_id FROM (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS i FROM (SELECT DISTINCT user_id FROM events)) WHERE i % 4 = 1")
def stride(spark, d):
    return P.stride_shard(read(spark, d, "events").select("user_id").distinct(), "user_id", 1, 4)


@query("sorted_page", "SELECT doc_id, source, n_chars FROM documents ORDER BY source, n_chars DESC, doc_id LIMIT 20 OFFSET 40")
def page(spark, d):
    return read(spark, d, "documents").select("doc_id", "source", "n_chars").orderBy("source", F.col("n_chars").desc(), "doc_id").offset(40).limit(20)


@query("first_hit", "SELECT doc_id FROM documents WHERE contains(text, 'License') ORDER BY doc_id LIMIT 1")
def first_hit(spark, d):
    return read(spark, d, "documents").filter(F.col("text").contains("License")).select("doc_id").orderBy("doc_id").limit(1)


# sets and merges ----------------------------------------------------------------


@query("union_common_columns", "SELECT doc_id, 'documents' AS dataset FROM documents UNION ALL SELECT doc_id, 'labels' FROM labels")
def union(spark, d):
    return M.union_common({"documents": read(spark, d, "documents"), "labels": read(spark, d, "labels")})


@query("union_renumber", "SELECT source, doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS index FROM documents")
def renumber(spark, d):
    return M.renumber(read(spark, d, "documents").select("source", "doc_id"), "source", "doc_id")


@query("offset_merge", "SELECT 'a' AS origin, user_id AS episode_index FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT 'b', user_id + 10000 FROM (SELECT DISTINCT user_id FROM events)")
def offset_merge(spark, d):
    e = read(spark, d, "events").select("user_id").distinct()
    return e.select(F.lit("a").alias("origin"), F.col("user_id").alias("episode_index")).unionByName(e.select(F.lit("b").alias("origin"), (F.col("user_id") + 10000).alias("episode_index")))


@query("anti_upsert", "SELECT user_id, event_id, value FROM events WHERE user_id % 7 <> 3 UNION ALL SELECT user_id, event_id, -value FROM events WHERE user_id % 7 = 3 AND event_type = 'view'")
def upsert(spark, d):
    old = read(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    target = old.filter("user_id % 7 = 3")
    new = target.filter("event_type = 'view'").withColumn("value", -F.col("value"))
    return M.upsert(old, new, "user_id", target).select("user_id", "event_id", "value")


@query("semi_anti", "SELECT doc_id, true AS labelled FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, false FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def semi_anti(spark, d):
    docs, labels = read(spark, d, "documents").select("doc_id"), read(spark, d, "labels").select("doc_id")
    return docs.join(labels, "doc_id", "left_semi").withColumn("labelled", F.lit(True)).unionByName(docs.join(labels, "doc_id", "left_anti").withColumn("labelled", F.lit(False)))


@query("set_intersection", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE toxic = 1")
def intersection(spark, d):
    return read(spark, d, "documents").select("doc_id").intersect(read(spark, d, "labels").filter("toxic = 1").select("doc_id"))


@query("schema_difference", "SELECT side, name FROM (SELECT 'missing' AS side, unnest(['lang', 'n_chars', 'source', 'text']) AS name UNION ALL SELECT 'extra', unnest(['quality', 'toxic']))")
def schema_difference(spark, d):
    want, have = read(spark, d, "documents").columns, read(spark, d, "labels").columns
    rows = [("missing", c) for c in want if c not in have] + [("extra", c) for c in have if c not in want]
    return spark.createDataFrame(rows, "side string, name string")


@query("keep_latest", f"WITH {FR} SELECT user_id, event_type, arg_max(event_id, frame_index) AS event_id FROM fr GROUP BY ALL")
def latest(spark, d):
    return M.keep_latest(event_frames(spark, d, "event_type"), ["user_id", "event_type"], "frame_index").select("user_id", "event_type", "event_id")


@query("shard_ids", "SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 16 AS shard FROM documents")
def shards(spark, d):
    return M.shard_ids(read(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 16)


@query("dead_letter_split", "SELECT CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS sink, count(*) AS n FROM events GROUP BY 1")
def dead_letter(spark, d):
    return read(spark, d, "events").groupBy(F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("sink")).agg(F.count(F.lit(1)).alias("n"))


@query("stable_group_order", "SELECT doc_id, min(doc_id) OVER (PARTITION BY source) AS group_at, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id)::INTEGER AS place FROM documents")
def stable(spark, d):
    return M.stable_group_order(read(spark, d, "documents").select("doc_id", "source", "n_chars"), "source", "doc_id", "n_chars").select("doc_id", "group_at", "place")


@query("event_range_union", f"WITH {FR}, e AS (SELECT user_id, list(frame_index ORDER BY frame_index) FILTER (event_type = 'purchase') AS l FROM fr GROUP BY 1) SELECT user_id, list_sort(list_distinct(list_concat(coalesce(l, []), [3, 4, 5]))) AS events FROM e")
def range_union(spark, d):
    e = event_frames(spark, d, "event_type").groupBy("user_id").agg(F.array_sort(F.collect_list(F.when(F.col("event_type") == "purchase", F.col("frame_index")))).alias("l"))
    return e.select("user_id", M.range_union(F.col("l"), F.lit(5).cast("long"), F.lit(3).cast("long")).alias("events"))


# quality and scores -------------------------------------------------------------


@query("quality_issues", "SELECT event_id, unnest(list_filter([CASE WHEN event_type = 'error' THEN 'bad_status' END, CASE WHEN value < 5 THEN 'value_low' END, CASE WHEN len(event_type) > 6 THEN 'name_long' END, CASE WHEN (props->>'$.k')::INT % 9 = 0 THEN 'k_bad' END], lambda x: x IS NOT NULL)) AS issue FROM events")
def issues(spark, d):
    rules = {"bad_status": F.col("event_type") == "error", "value_low": F.col("value") < 5, "name_long": F.length("event_type") > 6, "k_bad": F.get_json_object("props", "$.k").cast("int") % 9 == 0}
    return Q.issues(read(spark, d, "events"), ["event_id"], rules)


@query("null_scan", "SELECT count(*) FILTER (text IS NULL) AS text, count(*) FILTER (lang IS NULL) AS lang, count(*) FILTER (source IS NULL) AS source FROM documents")
def nulls(spark, d):
    return Q.null_counts(read(spark, d, "documents"), ["text", "lang", "source"])


@query("duplicate_first_seen", "SELECT doc_id, first_at FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_at FROM documents) WHERE doc_id > first_at")
def duplicate(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("uid"))
    return Q.duplicates(rows, "uid", "doc_id").select("doc_id", "first_at")


@query("non_monotonic", f"WITH {FR}, b AS (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY frame_index) AS before FROM fr) SELECT event_id, round(value, 6) AS value, round(before, 6) AS before FROM b WHERE value < before")
def monotonic(spark, d):
    out = Q.not_monotonic(event_frames(spark, d, "value"), "user_id", "frame_index", "value")
    return out.select("event_id", r6(F.col("value"), "value"), r6(F.col("before"), "before"))


@query("spec_validation", "WITH s AS (SELECT conv_id, count(*) AS n, arg_max(role, turn) AS last FROM conversations GROUP BY 1), p AS (SELECT * FROM s UNION ALL SELECT * FROM s WHERE n > 4) SELECT conv_id::VARCHAR AS task_id, 'last_state_not_done' AS problem FROM p WHERE last <> 'assistant' UNION ALL SELECT conv_id::VARCHAR, 'duplicate_id' FROM p GROUP BY 1 HAVING count(*) > 1")
def spec_validation(spark, d):
    """Conversations as specs whose states are turns, done when the assistant has the last word; long ones are listed twice."""
    from ..operators.memory import spec_problems

    state = F.struct("turn", F.struct(F.when(F.col("role") == "assistant", "done").otherwise(F.col("role")).alias("command")).alias("cell"))
    turns = F.transform(F.array_sort(F.collect_list(state)), lambda s: s["cell"])  # turns of one conversation
    specs = read(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("task_id")).agg(F.array(turns).alias("grid"))
    return spec_problems(specs.unionByName(specs.filter(F.size(F.col("grid")[0]) > 4)))


@query("majority_vote", "WITH c AS (SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END) AS k FROM c) SELECT user_id, event_type, votes FROM r WHERE k = 1")
def majority(spark, d):
    return C.majority(read(spark, d, "events").select("user_id", "event_type"), "user_id", "event_type", ["purchase", "click", "view", "signup"])


@query("revote_merge", "WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS yes, count(*) FILTER (event_type = 'error') AS no FROM events WHERE event_id % 2 = 0 GROUP BY 1), r AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS yes, count(*) FILTER (event_type = 'error') AS no FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT user_id, CASE WHEN c.yes <> c.no THEN CASE WHEN c.yes > c.no THEN 'DONE' ELSE 'NOT DONE' END WHEN r.yes > r.no THEN 'DONE' WHEN r.yes < r.no THEN 'NOT DONE' ELSE 'UNCERTAIN' END AS status, c.yes + CASE WHEN c.yes = c.no THEN coalesce(r.yes, 0) ELSE 0 END AS done_votes FROM c LEFT JOIN r USING (user_id)")
def revote(spark, d):
    e = read(spark, d, "events").select("user_id", "event_type", (F.col("event_id") % 2).alias("round"))
    count = lambda r, t: F.count_if((F.col("round") == r) & (F.col("event_type") == t))
    v = e.groupBy("user_id").agg(count(0, "purchase").alias("y0"), count(0, "error").alias("n0"), count(1, "purchase").alias("y1"), count(1, "error").alias("n1"), F.count_if(F.col("round") == 0).alias("c")).filter("c > 0")
    pick = lambda y, n, other: F.when(F.col(y) > F.col(n), "DONE").when(F.col(y) < F.col(n), "NOT DONE").otherwise(other)
    unsure = F.col("y0") == F.col("n0")
    return v.select("user_id", pick("y0", "n0", pick("y1", "n1", F.lit("UNCERTAIN"))).alias("status"), (F.col("y0") + F.when(unsure, F.col("y1")).otherwise(0)).alias("done_votes"))


@query("accuracy_by_group", "SELECT event_type, user_id % 3 AS mode, count(*) AS n, count(*) FILTER (value >= 50) AS ok, round(count(*) FILTER (value >= 50)::DOUBLE / count(*) * 100, 6) AS pct FROM events GROUP BY GROUPING SETS ((event_type), (mode), ())")
def accuracy(spark, d):
    rows = read(spark, d, "events").select("event_type", (F.col("user_id") % 3).alias("mode"), "value")
    return C.accuracy(rows, [["event_type"], ["mode"], []], F.col("value") >= 50).select("event_type", "mode", "n", "ok", r6(F.col("pct"), "pct"))


@query("accuracy_denominators", "SELECT round(count(*) FILTER (event_type <> 'error' AND value >= 50)::DOUBLE / count(*) FILTER (event_type <> 'error'), 6) AS of_parsed, count(*) FILTER (event_type = 'error') AS parse_failures, round(count(*) FILTER (event_type <> 'error' AND value >= 50)::DOUBLE / count(*), 6) AS of_all FROM events")
def denominators(spark, d):
    out = C.accuracies(read(spark, d, "events"), F.col("event_type") != "error", F.col("value") >= 50)
    return out.select(r6(F.col("of_parsed"), "of_parsed"), "parse_failures", r6(F.col("of_all"), "of_all"))


@query("prediction_join", "SELECT d.doc_id, l.toxic = CAST(d.n_chars > 1000 AS INTEGER) AS match_toxic, l.quality = CAST(d.n_chars > 500 AS INTEGER) AS match_quality, l.toxic = CAST(d.n_chars > 1000 AS INTEGER) AND l.quality = CAST(d.n_chars > 500 AS INTEGER) AS match FROM documents d JOIN labels l USING (doc_id)")
def predictions(spark, d):
    docs = read(spark, d, "documents").select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("pt"), (F.col("n_chars") > 500).cast("int").alias("pq"))
    got = docs.join(read(spark, d, "labels"), "doc_id").select("doc_id", (F.col("toxic") == F.col("pt")).alias("match_toxic"), (F.col("quality") == F.col("pq")).alias("match_quality"))
    return got.withColumn("match", F.col("match_toxic") & F.col("match_quality"))


@query("latency_after_warmup", f"WITH {FR} SELECT user_id, round(avg(CASE WHEN frame_index >= 3 THEN value END), 6) AS latency FROM fr GROUP BY user_id")
def latency(spark, d):
    return event_frames(spark, d, "value").groupBy("user_id").agg(r6(F.avg(F.when(F.col("frame_index") >= 3, F.col("value"))), "latency"))


@query("global_norm", "SELECT round(sqrt(sum(value * value)), 4) AS norm FROM events")
def norm(spark, d):
    return read(spark, d, "events").agg(F.round(F.sqrt(F.sum(F.col("value") * F.col("value"))), 4).alias("norm"))


@query("cumulative_attention_pairs", f"WITH {FR}, c AS (SELECT user_id, frame_index, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY frame_index) AS c FROM fr), k AS (SELECT user_id, c, count(*) AS n FROM c GROUP BY ALL), s AS (SELECT user_id, n, sum(n) OVER (PARTITION BY user_id ORDER BY c) AS below FROM k) SELECT user_id, sum(n * below)::BIGINT AS allowed_pairs FROM s GROUP BY user_id")
def attention(spark, d):
    """How many pairs (i, j) have cumsum[j] <= cumsum[i]; counted by steps, no pair is formed."""
    steps = F.sum((F.col("event_type") == "purchase").cast("int")).over(Window.partitionBy("user_id").orderBy("frame_index"))
    each = event_frames(spark, d, "event_type").select("user_id", steps.alias("c")).groupBy("user_id", "c").agg(F.count(F.lit(1)).alias("n"))
    below = F.sum("n").over(Window.partitionBy("user_id").orderBy("c"))
    return each.withColumn("below", below).groupBy("user_id").agg(F.sum(F.col("n") * F.col("below")).alias("allowed_pairs"))
