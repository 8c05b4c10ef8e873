"""Queries over episodes: lookups, windows, segments, statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import merge as M
from ..operators import stats as S
from ..operators import timeseries as T
from ..operators.positions import Ordered, numbered
from .base import FR, event_frames, query, r6, read


@query("task_lookup_join", "WITH d AS (SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS task_index FROM events GROUP BY event_type) SELECT e.event_id, d.task_index, e.event_type AS task FROM events e JOIN d USING (event_type)")
def task_lookup(spark, d):
    events = read(spark, d, "events").select("event_id", "event_type")
    tasks = S.dictionary(events, "event_type", "event_id").select("event_type", F.col("code").cast("long").alias("task_index"))
    return M.strict_lookup(events, tasks, "event_type", "task_index").select("event_id", "task_index", F.col("event_type").alias("task"))


@query("lookup_with_defaults", "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), nullif(d.lang, ''), 'unknown task') AS task FROM documents d LEFT JOIN labels l USING (doc_id)")
def lookup_defaults(spark, d):
    labels = read(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("q"))
    return read(spark, d, "documents").select("doc_id", "lang").join(labels, "doc_id", "left").select("doc_id", F.coalesce("q", F.nullif("lang", F.lit("")), F.lit("unknown task")).alias("task"))


@query("episode_offsets", "SELECT user_id, count(*) AS length, (sum(count(*)) OVER (ORDER BY user_id) - count(*))::BIGINT AS from_index, (sum(count(*)) OVER (ORDER BY user_id))::BIGINT AS to_index FROM events GROUP BY user_id")
def offsets(spark, d):
    return T.episode_offsets(read(spark, d, "events").select("user_id"), "user_id")


@query("episode_paths", "SELECT user_id, user_id // 50 AS episode_chunk, format('data/chunk-{:03d}/episode_{:06d}.parquet', user_id // 50, user_id) AS data_path FROM (SELECT DISTINCT user_id FROM events)")
def paths(spark, d):
    from ..sources.layout import data_path

    return read(spark, d, "events").select("user_id").distinct().select("user_id", F.floor(F.col("user_id") / 50).alias("episode_chunk"), data_path(F.col("user_id"), 50).alias("data_path"))


@query("run_boundaries", f"WITH {FR}, c AS (SELECT *, CASE WHEN frame_index = 0 OR event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS n FROM fr WINDOW w AS (PARTITION BY user_id ORDER BY frame_index)), g AS (SELECT *, (sum(n) OVER (PARTITION BY user_id ORDER BY frame_index))::BIGINT AS run FROM c) SELECT user_id, run, event_type, min(frame_index) AS first_frame, max(frame_index) AS last_frame FROM g GROUP BY ALL")
def run_boundaries(spark, d):
    return T.runs(event_frames(spark, d, "event_type"), "user_id", "event_type")


@query("timestamp_gap_violations", f"WITH {FR}, g AS (SELECT user_id, frame_index, t - lag(t) OVER (PARTITION BY user_id ORDER BY frame_index) AS gap FROM fr) SELECT user_id, frame_index, round(gap, 6) AS gap FROM g WHERE abs(gap - 600.0) > 300.0")
def gaps(spark, d):
    return T.gap_violations(event_frames(spark, d), "user_id", "t", 600.0, 300.0).select("user_id", "frame_index", r6(F.col("gap"), "gap"))


@query("delta_grid_check", f"WITH {FR} SELECT event_id, CAST(round_even(value * 5.0, 0) AS INTEGER) AS delta_index, abs(value * 5.0 - round_even(value * 5.0, 0)) / 5.0 <= 0.05 AS on_grid FROM fr")
def delta_grid(spark, d):
    x = F.col("value") * 5.0
    return event_frames(spark, d, "value").select("event_id", V.delta_index(F.col("value"), 5.0).alias("delta_index"), (F.abs(x - F.rint(x)) / 5.0 <= 0.05).alias("on_grid"))


@query("decimate_every_6th", f"WITH {FR} SELECT user_id, frame_index, event_id FROM fr WHERE frame_index % 6 = 0")
def decimate(spark, d):
    return T.decimate(event_frames(spark, d), 6).select("user_id", "frame_index", "event_id")


@query("delta_window_clamped", f"WITH {FR}, l AS (SELECT *, max(frame_index) OVER (PARTITION BY user_id) AS m FROM fr), q AS (SELECT user_id, frame_index, m, unnest([-2, -1, 0, 1, 2, 3]) AS delta FROM l), a AS (SELECT *, greatest(0, least(m, frame_index + delta)) AS at_frame, frame_index + delta < 0 OR frame_index + delta > m AS is_pad FROM q) SELECT a.user_id, a.frame_index, a.delta, a.at_frame, a.is_pad, f.event_id FROM a JOIN fr f ON f.user_id = a.user_id AND f.frame_index = a.at_frame")
def delta_window(spark, d):
    return T.delta_window(event_frames(spark, d), "user_id", [-2, -1, 0, 1, 2, 3], ["event_id"])


@query("action_horizon_chunk", f"WITH {FR}, c AS (SELECT user_id, frame_index, list(event_id) OVER (PARTITION BY user_id ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS l FROM fr) SELECT user_id, frame_index, list_concat(l, list_transform(range(8 - len(l)), lambda i: l[-1])) AS chunk, len(l)::INTEGER AS n_real FROM c")
def horizon(spark, d):
    return T.horizon_chunk(event_frames(spark, d), "user_id", "event_id", 8).select("user_id", "frame_index", "chunk", "n_real")


@query("nearest_timestamp_lookup", f"WITH {FR}, q AS (SELECT event_id AS q, user_id, t + 90.0 AS qt FROM fr WHERE event_type = 'click'), r AS (SELECT user_id, t, value FROM fr WHERE event_type = 'view'), m AS (SELECT q, q.user_id, qt, r.t, value, row_number() OVER (PARTITION BY q ORDER BY abs(r.t - qt), r.t) AS k FROM q JOIN r ON q.user_id = r.user_id) SELECT user_id, q, round(t, 6) AS matched_at, round(value, 6) AS matched_value, abs(t - qt) > 600.0 AS is_pad FROM m WHERE k = 1")
def nearest(spark, d):
    fr = event_frames(spark, d, "event_type", "value")
    asked = fr.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("q"), (F.col("t") + 90.0).alias("at"))
    rows = fr.filter("event_type = 'view'").select("user_id", F.col("t").alias("at"), "value")
    out = T.nearest(asked, rows, "user_id", "at", "value", "q", 600.0).filter("matched_at is not null")
    return out.select("user_id", "q", r6(F.col("matched_at"), "matched_at"), r6(F.col("matched_value"), "matched_value"), "is_pad")


VEL = "v AS (SELECT label, vec_id, sqrt(pow(embedding[1]::DOUBLE - lag(embedding[1]) OVER w, 2) + pow(embedding[2]::DOUBLE - lag(embedding[2]) OVER w, 2) + pow(embedding[3]::DOUBLE - lag(embedding[3]) OVER w, 2)) / 0.2 AS velocity FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id))"


@query("velocity", f"WITH {VEL} SELECT label, vec_id, round(velocity, 6) AS velocity FROM v WHERE velocity IS NOT NULL")
def velocity(spark, d):
    return T.velocity(read(spark, d, "embeddings"), "label", "embedding", "vec_id").select("label", "vec_id", r6(F.col("velocity"), "velocity"))


ISL = f"{FR}, lo AS (SELECT user_id, frame_index, frame_index - row_number() OVER (PARTITION BY user_id ORDER BY frame_index) AS g FROM fr WHERE value < 60.0 AND frame_index >= 2), isl AS (SELECT user_id, min(frame_index) AS s, max(frame_index) AS e FROM lo GROUP BY user_id, g)"
MRG = f"{ISL}, k AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY user_id ORDER BY s) < 3 THEN 0 ELSE 1 END AS n FROM isl WHERE e - s + 1 >= 2), m AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY s) AS g FROM k), mi AS (SELECT user_id, min(s) AS s, max(e) AS e FROM m GROUP BY user_id, g)"


def _islands(spark, d):
    return T.low_islands(event_frames(spark, d, "value"), "user_id", "value", 60.0, from_frame=2)


@query("low_speed_islands", f'WITH {ISL} SELECT user_id, s AS start, e AS "end" FROM isl')
def islands(spark, d):
    return _islands(spark, d)


@query("islands_merged", f'WITH {MRG} SELECT user_id, s AS start, e AS "end" FROM mi')
def merged(spark, d):
    return T.merge_islands(_islands(spark, d), "user_id", 2, 3)


LAB = f"{MRG}, b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s) AS k FROM mi), o AS (SELECT user_id FROM b WHERE k < 4 GROUP BY user_id HAVING count(*) = 3), lb AS (SELECT f.user_id, f.frame_index, (SELECT count(*) FROM b WHERE b.user_id = f.user_id AND b.k < 4 AND b.s <= f.frame_index) AS subtask_index FROM fr f JOIN o USING (user_id))"


def _labels(spark, d):
    fr = event_frames(spark, d, "value")
    return T.subtask_labels(fr, T.merge_islands(_islands(spark, d), "user_id", 2, 3), "user_id", 4)


@query("subtask_labels", f"WITH {LAB} SELECT user_id, frame_index, subtask_index FROM lb")
def subtask_labels(spark, d):
    return _labels(spark, d).select("user_id", "frame_index", "subtask_index")


@query("subtask_segments", f'WITH {LAB} SELECT user_id, subtask_index, min(frame_index) AS start, max(frame_index) AS "end", count(*) AS length FROM lb GROUP BY ALL')
def segments(spark, d):
    return _labels(spark, d).groupBy("user_id", "subtask_index").agg(F.min("frame_index").alias("start"), F.max("frame_index").alias("end"), F.count(F.lit(1)).alias("length"))


@query("strided_anchors", f"WITH {FR}, l AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS length FROM fr), a AS (SELECT * FROM l WHERE frame_index % 3 = 0 AND frame_index < length - 3) SELECT user_id, frame_index, length, round(frame_index::DOUBLE / greatest(length - 1, 1), 6) AS progress, lead(frame_index) OVER (PARTITION BY user_id ORDER BY frame_index) IS NULL AS done FROM a")
def anchors(spark, d):
    return T.strided_anchors(event_frames(spark, d), "user_id", 3, 4).select("user_id", "frame_index", "length", r6(F.col("progress"), "progress"), "done")


@query("episode_batches", "SELECT user_id, (row_number() OVER (ORDER BY user_id) - 1) // 8 AS batch FROM (SELECT user_id FROM events GROUP BY user_id HAVING count(*) > 0)")
def batches(spark, d):
    episodes = read(spark, d, "events").select("user_id").distinct()
    return numbered(episodes, "user_id", name="batch").withColumn("batch", F.floor(F.col("batch") / 8))


@query("drop_edge_frames", f"WITH {FR}, l AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM fr) SELECT user_id, frame_index, event_id FROM l WHERE frame_index >= 2 AND frame_index < n - 3")
def edges(spark, d):
    from ..operators.sampling import drop_edges

    return drop_edges(event_frames(spark, d), "user_id", 2, 3).select("user_id", "frame_index", "event_id")


@query("row_navigation", f"WITH {FR} SELECT event_id, lag(event_id) OVER w AS previous_id, lead(event_id) OVER w AS next_id FROM fr WINDOW w AS (PARTITION BY user_id ORDER BY frame_index)")
def navigation(spark, d):
    by = Window.partitionBy("user_id").orderBy("frame_index")
    return event_frames(spark, d).select("event_id", F.lag("event_id").over(by).alias("previous_id"), F.lead("event_id").over(by).alias("next_id"))


@query("row_navigation_across", "SELECT event_id, user_id, lag(user_id) OVER w AS previous_user, lag(event_id) OVER w AS previous_id, lead(user_id) OVER w AS next_user, lead(event_id) OVER w AS next_id FROM events WINDOW w AS (ORDER BY user_id, ts, event_id)")
def navigation_across(spark, d):
    """Steps that go on into the previous or next episode."""
    rows = read(spark, d, "events").select("user_id", "ts", "event_id")
    near = Ordered(rows, "user_id", "ts", "event_id").neighbours(["user_id", "event_id"])
    return near.select("event_id", "user_id", F.col("previous.user_id").alias("previous_user"), F.col("previous.event_id").alias("previous_id"), F.col("following.user_id").alias("next_user"), F.col("following.event_id").alias("next_id"))


@query("running_event_state", f"WITH {FR}, s AS (SELECT user_id, frame_index, least(5, greatest(0, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY frame_index)))::INTEGER AS state FROM fr) SELECT *, coalesce(lag(state) OVER (PARTITION BY user_id ORDER BY frame_index), state) AS previous_state FROM s")
def running(spark, d):
    return T.running_state(event_frames(spark, d, "event_type"), "user_id", F.col("event_type") == "purchase", 0, 5).select("user_id", "frame_index", "state", "previous_state")


@query("sticky_status", f"WITH {FR} SELECT user_id, frame_index, CASE WHEN bool_or(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY frame_index) THEN 'DONE' ELSE 'NOT_DONE' END AS status FROM fr")
def sticky(spark, d):
    out = T.sticky(event_frames(spark, d, "event_type"), "user_id", F.col("event_type") == "purchase")
    return out.select("user_id", "frame_index", F.when(F.col("sticky_done"), "DONE").otherwise("NOT_DONE").alias("status"))


@query("carry_forward_status", f"WITH {FR} SELECT user_id, frame_index, last_value(CASE WHEN frame_index % 5 = 0 AND event_type <> 'error' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY frame_index) AS held FROM fr")
def carry(spark, d):
    return T.carry_forward(event_frames(spark, d, "event_type"), "user_id", F.when(F.col("event_type") != "error", F.col("event_type")), 5).select("user_id", "frame_index", "held")


@query("action_queue_steps", f"WITH {FR}, c AS (SELECT user_id, frame_index, list(event_id) OVER (PARTITION BY user_id ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS l FROM fr) SELECT user_id, frame_index + i AS step, l[i + 1] AS action FROM (SELECT user_id, frame_index, l, unnest(range(len(l))) AS i FROM c WHERE frame_index % 4 = 0)")
def action_queue(spark, d):
    refill = T.horizon_chunk(event_frames(spark, d), "user_id", "event_id", 4).filter("frame_index % 4 = 0")
    return refill.select("user_id", "frame_index", F.posexplode(F.slice("chunk", F.lit(1), F.col("n_real"))).alias("i", "action")).select("user_id", (F.col("frame_index") + F.col("i")).alias("step"), "action")


@query("latest_frame_per_window", "SELECT user_id, date_trunc('hour', ts) AS hour, arg_max(event_id, row(ts, event_id)) AS event_id FROM events GROUP BY ALL")
def latest(spark, d):
    return read(spark, d, "events").groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


# statistics ---------------------------------------------------------------------

STAT = "round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, count(x) AS count"


def _rounded(df, *by):
    return df.select(*by, *[r6(F.col(c), c) for c in ("min", "max", "mean", "std")], "count")


@query("feature_stats_scalar", f"SELECT user_id, {STAT} FROM (SELECT user_id, value AS x FROM events) GROUP BY user_id")
def scalar(spark, d):
    return _rounded(S.scalar_stats(read(spark, d, "events"), ["user_id"], "value"), "user_id")


@query("feature_stats_vector", f"SELECT label, pos, {STAT} FROM (SELECT label, unnest(range(len(embedding)))::INTEGER AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL")
def vector(spark, d):
    return _rounded(S.vector_stats(read(spark, d, "embeddings"), ["label"], "embedding"), "label", "pos")


@query("stats_merge_partial_final", f"SELECT event_type, {STAT} FROM (SELECT event_type, value AS x FROM events) GROUP BY event_type")
def merged_stats(spark, d):
    parts = S.scalar_stats(read(spark, d, "events"), ["event_type", "user_id"], "value")
    return _rounded(S.merge_stats(parts, ["event_type"]), "event_type")


@query("stats_union_of_features", f"SELECT feature, {STAT} FROM (SELECT 'value' AS feature, value AS x FROM events UNION ALL SELECT 'n_chars', n_chars::DOUBLE FROM documents UNION ALL SELECT 'e0', embedding[1]::DOUBLE FROM embeddings) GROUP BY feature")
def union_stats(spark, d):
    long = lambda t, name, x: read(spark, d, t).select(F.lit(name).alias("feature"), x.cast("double").alias("x"))
    rows = long("events", "value", F.col("value")).unionByName(long("documents", "n_chars", F.col("n_chars"))).unionByName(long("embeddings", "e0", F.col("embedding")[0]))
    return _rounded(S.scalar_stats(rows, ["feature"], "x"), "feature")


@query("stats_square_sums", "SELECT event_type, round(avg(value), 6) AS mean, round(sqrt(greatest(0, avg(value * value) - avg(value) * avg(value))), 6) AS std FROM events GROUP BY event_type")
def square_sums(spark, d):
    return S.square_sum_stats(read(spark, d, "events"), ["event_type"], "value").select("event_type", r6(F.col("mean"), "mean"), r6(F.col("std"), "std"))


@query("dataset_totals", "SELECT count(*) AS total_frames, count(DISTINCT user_id) AS total_episodes, count(DISTINCT event_type) AS total_tasks, ceil(count(DISTINCT user_id) / 50.0)::BIGINT AS total_chunks FROM events")
def totals(spark, d):
    return read(spark, d, "events").agg(F.count(F.lit(1)).alias("total_frames"), F.countDistinct("user_id").alias("total_episodes"), F.countDistinct("event_type").alias("total_tasks"), F.ceil(F.countDistinct("user_id") / 50).alias("total_chunks"))


@query("mean_of_means", "SELECT event_type, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std FROM (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY ALL) GROUP BY event_type")
def means(spark, d):
    each = read(spark, d, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("m"))
    return each.groupBy("event_type").agg(r6(F.avg("m"), "mean"), r6(F.stddev_pop("m"), "std"))


@query("dictionary_encode_first_seen", "SELECT event_type, min(event_id) AS first_at, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM events GROUP BY event_type")
def dictionary(spark, d):
    return S.dictionary(read(spark, d, "events"), "event_type", "event_id").withColumn("code", F.col("code").cast("long"))


@query("episode_first_task", f"WITH {FR}, f AS (SELECT user_id, event_type, min(frame_index) AS o FROM fr GROUP BY ALL) SELECT user_id, arg_min(event_type, o) AS first_value, list(event_type ORDER BY o) AS all_values FROM f GROUP BY user_id")
def first_task(spark, d):
    return S.first_values(event_frames(spark, d, "event_type"), "user_id", "event_type", "frame_index")


@query("masked_counts", "SELECT count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS n_episodes, count(*) FILTER (event_type = 'purchase') AS n_frames FROM events")
def masked(spark, d):
    hit = F.col("event_type") == "purchase"
    return read(spark, d, "events").agg(F.countDistinct(F.when(hit, F.col("user_id"))).alias("n_episodes"), F.count_if(hit).alias("n_frames"))


@query("label_histogram", "SELECT coalesce(CAST(l.quality AS VARCHAR), 'UNKNOWN') AS quality, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def label_histogram(spark, d):
    return S.histogram(read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left"), "quality")


@query("status_histogram", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'purchase', 'view') GROUP BY event_type")
def status_histogram(spark, d):
    return S.histogram(read(spark, d, "events").filter(F.col("event_type").isin("click", "purchase", "view")), "event_type")


@query("weighted_mean", "SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS avg FROM lineitem GROUP BY l_returnflag")
def weighted(spark, d):
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_quantity")) / F.sum("l_quantity"), 4).alias("avg"))


@query("progress_metrics", f"WITH {FR}, m AS (SELECT count(*)::DOUBLE AS n, count(*)::DOUBLE / count(DISTINCT user_id) AS l FROM fr) SELECT user_id, frame_index, (frame_index + 1) * 8 AS samples, round((frame_index + 1) * 8 / l, 6) AS episodes, round((frame_index + 1) * 8 / n, 6) AS epochs FROM fr, m")
def progress(spark, d):
    fr = event_frames(spark, d)
    size = fr.agg(F.count(F.lit(1)).cast("double").alias("n"), F.countDistinct("user_id").alias("e"))
    samples = (F.col("frame_index") + 1) * 8
    return fr.join(F.broadcast(size)).select("user_id", "frame_index", samples.alias("samples"), r6(samples / (F.col("n") / F.col("e")), "episodes"), r6(samples / F.col("n"), "epochs"))  # one row of sizes


@query("array_summary", "SELECT vec_id, round(list_avg(e), 6) AS mean, round(list_stddev_pop(e), 6) AS std, round(list_min(e), 6) AS min, round(list_max(e), 6) AS max FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)")
def array_summary(spark, d):
    e = F.col("e")
    n = F.size(e)
    mean = F.aggregate(e, F.lit(0.0), lambda a, x: a + x) / n
    rows = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).withColumn("m", mean)
    std = F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, x: a + (x - F.col("m")) * (x - F.col("m"))) / n)
    return rows.select("vec_id", r6(F.col("m"), "mean"), r6(std, "std"), r6(F.array_min(e), "min"), r6(F.array_max(e), "max"))


@query("stats_consistency", "WITH a AS (SELECT event_type, avg(value) AS m FROM events GROUP BY 1), b AS (SELECT event_type, sum(value) / count(*) AS m FROM events GROUP BY 1) SELECT event_type, abs(a.m - b.m) <= 1e-6 + 5e-6 * abs(b.m) AS close FROM a JOIN b USING (event_type)")
def consistency(spark, d):
    events = read(spark, d, "events")
    direct = S.scalar_stats(events, ["event_type"], "value").select("event_type", F.col("mean").alias("a"))
    parts = S.merge_stats(S.scalar_stats(events, ["event_type", "user_id"], "value"), ["event_type"]).select("event_type", F.col("mean").alias("b"))
    return direct.join(parts, "event_type").select("event_type", (F.abs(F.col("a") - F.col("b")) <= 1e-6 + 5e-6 * F.abs("b")).alias("close"))


@query("normalize_mean_std", "WITH s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1) SELECT event_id, round((value - m) / (s + 1e-8), 6) AS z, round((value - m) / (s + 1e-8) * s + m, 5) AS back FROM events JOIN s USING (event_type)")
def normalize(spark, d):
    events = read(spark, d, "events").select("event_id", "event_type", "value")
    got = events.join(S.scalar_stats(events, ["event_type"], "value").select("event_type", "mean", "std"), "event_type")
    z = V.normalize(F.col("value"), F.col("mean"), F.col("std"))
    return got.select("event_id", r6(z, "z"), F.round(V.unnormalize(z, F.col("mean"), F.col("std")), 5).alias("back"))


@query("normalize_min_max", "WITH s AS (SELECT event_type, min(value) AS a, max(value) AS b FROM events GROUP BY 1) SELECT event_id, round((value - a) / (b - a + 1e-8) * 2 - 1, 6) AS x FROM events JOIN s USING (event_type)")
def min_max(spark, d):
    events = read(spark, d, "events").select("event_id", "event_type", "value")
    got = events.join(S.scalar_stats(events, ["event_type"], "value").select("event_type", "min", "max"), "event_type")
    return got.select("event_id", r6(V.min_max(F.col("value"), F.col("min"), F.col("max")), "x"))


@query("pad_and_norm", "SELECT vec_id, len(embedding)::INTEGER AS n, 70 AS padded, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def pad(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return e.select("vec_id", F.size("e").alias("n"), F.size(V.pad_right(F.col("e"), 70)).alias("padded"), r6(V.l2(F.col("e")), "norm"))


@query("left_pad_sequences", f"WITH {FR}, s AS (SELECT user_id, list(event_id ORDER BY frame_index) AS v FROM fr GROUP BY user_id), m AS (SELECT max(len(v)) AS n FROM s) SELECT user_id, list_concat(list_transform(range(n - len(v)), lambda i: 0::BIGINT), v) AS padded FROM s, m")
def left_pad(spark, d):
    fr = event_frames(spark, d)
    seq = fr.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_index", "event_id"))), lambda s: s["event_id"]).alias("v"))
    longest = fr.groupBy("user_id").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c").cast("int").alias("n"))
    return seq.join(F.broadcast(longest)).select("user_id", V.pad_left(F.col("v"), F.col("n"), F.lit(0).cast("long")).alias("padded"))  # one row


@query("last_subsequence", "WITH w AS (SELECT doc_id, string_split(text, ' ') AS h FROM documents), n AS (SELECT *, h[1:1] AS k FROM w) SELECT doc_id, list_max(list_filter(range(len(h)), lambda i: h[i + 1:i + 1] = k))::INTEGER AS at FROM n")
def subsequence(spark, d):
    h = F.split("text", " ")
    return read(spark, d, "documents").select("doc_id", h.alias("h")).select("doc_id", V.last_subsequence(F.col("h"), F.slice("h", 1, 1)).alias("at"))


@query("angles", "SELECT event_id, round(radians(value), 6) AS rad, round(degrees(radians(value)), 5) AS deg, round(asin(greatest(-1, least(1, value / 50.0 - 1))), 6) AS gripper FROM events")
def angles(spark, d):
    v = F.col("value")
    return read(spark, d, "events").select("event_id", r6(F.radians(v), "rad"), F.round(F.degrees(F.radians(v)), 5).alias("deg"), r6(V.safe_asin(v / 50.0 - 1), "gripper"))


@query("sample_counts", "WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id, n, greatest(least(10, n), least(floor(pow(n, 0.75)), 10000))::BIGINT AS k FROM n")
def sample_counts(spark, d):
    n = read(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("user_id", "n", V.sample_count(F.col("n"), least=10).alias("k"))


@query("systematic_sample", f"WITH {FR}, n AS (SELECT user_id, count(*) AS n, least(7, count(*)) AS k FROM fr GROUP BY 1), i AS (SELECT user_id, CASE WHEN k > 1 THEN (n - 1)::DOUBLE / (k - 1) ELSE 0 END AS st, unnest(range(k)) AS i FROM n) SELECT i.user_id, f.frame_index, f.event_id FROM i JOIN fr f ON f.user_id = i.user_id AND f.frame_index = round_even(i.i * st, 0)::BIGINT")
def systematic(spark, d):
    fr = event_frames(spark, d)
    n = fr.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    picks = n.select("user_id", F.explode(V.systematic_indices(F.col("n"), F.least(F.lit(7), F.col("n")))).alias("frame_index"))
    return picks.join(fr, ["user_id", "frame_index"]).select("user_id", "frame_index", "event_id")


# rollouts -----------------------------------------------------------------------


@query("switch_rate", f"WITH {FR}, s AS (SELECT user_id, CASE WHEN event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY frame_index) THEN 1 ELSE 0 END AS s FROM fr) SELECT user_id, sum(s)::BIGINT AS switches, round(avg(s::DOUBLE), 6) AS switch_rate, count(*) AS steps FROM s GROUP BY user_id")
def switches(spark, d):
    return S.switch_rate(event_frames(spark, d, "event_type"), "user_id", "event_type", "frame_index").select("user_id", "switches", r6(F.col("switch_rate"), "switch_rate"), "steps")


@query("expert_fraction", "WITH i AS (SELECT unnest(range(12))::INTEGER AS label), c AS (SELECT i.label, count(e.label) AS n FROM i LEFT JOIN embeddings e USING (label) GROUP BY 1) SELECT label, n, round(n / greatest(1, sum(n) OVER ())::DOUBLE, 6) AS share, round(max(n) OVER () / greatest(1, sum(n) OVER ())::DOUBLE, 6) AS max_share FROM c")
def experts(spark, d):
    ids = spark.range(12).select(F.col("id").cast("int").alias("label"))
    return S.shares(read(spark, d, "embeddings").select("label"), "label", ids).select("label", "n", r6(F.col("share"), "share"), r6(F.col("max_share"), "max_share"))


@query("cumulative_share_topk", "WITH u AS (SELECT vec_id, unnest(range(len(embedding)))::INTEGER AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT vec_id, pos, x, row_number() OVER w AS rank, sum(x * x) OVER (PARTITION BY vec_id ORDER BY x DESC, pos ROWS UNBOUNDED PRECEDING) AS c, sum(x * x) OVER (PARTITION BY vec_id) AS s FROM u WINDOW w AS (PARTITION BY vec_id ORDER BY x DESC, pos)) SELECT vec_id, count(*) FILTER (rank = 1 OR c <= 0.5 * s) AS k FROM c GROUP BY vec_id")
def cumulative(spark, d):
    long = read(spark, d, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x"))
    return S.cumulative_share(long, "vec_id", "pos", "x", 0.5).groupBy("vec_id").agg(F.count_if("kept").alias("k"))


@query("ewma_ensemble", f"WITH {FR} SELECT user_id, round(sum(exp(-0.1 * frame_index) * value) / sum(exp(-0.1 * frame_index)), 6) AS ensemble FROM fr GROUP BY user_id")
def ensemble(spark, d):
    return S.decayed_mean(event_frames(spark, d, "value"), "user_id", "frame_index", F.col("value"), 0.1).select("user_id", r6(F.col("ensemble"), "ensemble"))


@query("gae_advantages", f"WITH RECURSIVE {FR}, n AS (SELECT user_id, max(frame_index) AS m FROM fr GROUP BY 1), r AS (SELECT f.user_id, f.frame_index, value / 100.0 - 0.5 AS a, 0.5 AS v FROM fr f JOIN n ON f.user_id = n.user_id AND f.frame_index = n.m UNION ALL SELECT f.user_id, f.frame_index, f.value / 100.0 + 0.9 * 0.5 - 0.5 + 0.9 * 0.8 * r.a, 0.5 FROM fr f JOIN r ON f.user_id = r.user_id AND f.frame_index = r.frame_index - 1) SELECT user_id, frame_index::INTEGER AS frame_index, round(a, 6) AS advantage, round(a + 0.5, 6) AS ret FROM r")
def gae(spark, d):
    out = S.advantages(event_frames(spark, d, "value"), "user_id", "frame_index", F.col("value") / 100.0, F.lit(0.5), 0.9, 0.8)
    return out.select("user_id", "frame_index", r6(F.col("advantage"), "advantage"), r6(F.col("ret"), "ret"))


@query("gae_done_mask", f"WITH RECURSIVE {FR}, n AS (SELECT user_id, max(frame_index) AS m FROM fr GROUP BY 1), r AS (SELECT f.user_id, f.frame_index, value / 100.0 - 0.5 AS a FROM fr f JOIN n ON f.user_id = n.user_id AND f.frame_index = n.m UNION ALL SELECT f.user_id, f.frame_index, f.value / 100.0 + CASE WHEN f.event_type = 'purchase' THEN 0.0 ELSE 0.9 * 0.5 END - 0.5 + CASE WHEN f.event_type = 'purchase' THEN 0.0 ELSE 0.9 * 0.8 * r.a END FROM fr f JOIN r ON f.user_id = r.user_id AND f.frame_index = r.frame_index - 1) SELECT user_id, frame_index::INTEGER AS frame_index, round(a, 6) AS advantage, round(a + 0.5, 6) AS ret FROM r")
def gae_done(spark, d):
    """Ends inside an episode: a purchase is the last step of its rollout."""
    out = S.advantages(event_frames(spark, d, "value", "event_type"), "user_id", "frame_index", F.col("value") / 100.0, F.lit(0.5), 0.9, 0.8, F.col("event_type") == "purchase")
    return out.select("user_id", "frame_index", r6(F.col("advantage"), "advantage"), r6(F.col("ret"), "ret"))


@query("advantage_standardised", "SELECT event_id, round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-8), 6) AS z FROM events WINDOW w AS (PARTITION BY user_id)")
def standardised(spark, d):
    by = Window.partitionBy("user_id")
    return read(spark, d, "events").select("event_id", r6(V.normalize(F.col("value"), F.avg("value").over(by), F.stddev_pop("value").over(by)), "z"))


@query("log_rewards", f"WITH {FR} SELECT event_id, round(-ln(greatest(value / 100.0, 1e-6)) - 0.1 * (CASE WHEN event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY frame_index) THEN 1 ELSE 0 END), 6) + 0.0 AS reward FROM fr")
def rewards(spark, d):
    switched = F.coalesce(F.col("event_type") != F.lag("event_type").over(Window.partitionBy("user_id").orderBy("frame_index")), F.lit(False))
    return event_frames(spark, d, "event_type", "value").select("event_id", (F.round(V.log_reward(F.col("value") / 100.0, switched, 0.1), 6) + 0.0).alias("reward"))


@query("clip_diagnostics", "SELECT event_type, round(avg(abs(value / 50.0 - 1) ), 6) AS mean_shift, count(*) FILTER (abs(value / 50.0 - 1) > 0.2) AS clipped, round(count(*) FILTER (abs(value / 50.0 - 1) > 0.2)::DOUBLE / count(*), 6) AS clip_fraction FROM events GROUP BY event_type")
def clip(spark, d):
    shift = F.abs(F.col("value") / 50.0 - 1)
    n = F.count_if(shift > 0.2)
    return read(spark, d, "events").groupBy("event_type").agg(r6(F.avg(shift), "mean_shift"), n.alias("clipped"), r6(n.cast("double") / F.count(F.lit(1)), "clip_fraction"))


@query("load_balance", "WITH p AS (SELECT vec_id, unnest(range(8))::INTEGER AS e, unnest(list_transform(embedding[1:8], lambda x: abs(x::DOUBLE))) AS x FROM embeddings), q AS (SELECT *, x / sum(x) OVER (PARTITION BY vec_id) AS pr, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, e) AS k FROM p), a AS (SELECT e, count(*) FILTER (k = 1)::DOUBLE / count(*) AS f, avg(pr) AS p FROM q GROUP BY e) SELECT round(8 * sum(f * p), 6) AS balance FROM a")
def balance(spark, d):
    long = read(spark, d, "embeddings").select("vec_id", F.posexplode(F.transform(F.slice("embedding", 1, 8), lambda x: F.abs(x.cast("double")))).alias("e", "x"))
    by = Window.partitionBy("vec_id")
    long = long.withColumn("p", F.col("x") / F.sum("x").over(by)).withColumn("k", F.row_number().over(by.orderBy(F.col("x").desc(), "e")))
    each = long.groupBy("e").agg((F.count_if(F.col("k") == 1).cast("double") / F.count(F.lit(1))).alias("f"), F.avg("p").alias("p"))
    return each.agg(r6(F.sum(F.col("f") * F.col("p")) * 8, "balance"))


@query("ring_buffer_last_n", "SELECT event_id, user_id FROM events WHERE event_id > (SELECT max(event_id) FROM events) - 500")
def ring(spark, d):
    from ..operators.merge import keep_last_n

    return keep_last_n(read(spark, d, "events").select("event_id", "user_id"), "event_id", 500)
