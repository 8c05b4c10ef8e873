"""Queries over catalog rows: paths, metadata patches, schemas, templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.positions import numbered
from ..sources import layout
from .base import FR, event_frames, query, r6, read


@query("path_to_episode", "SELECT DISTINCT user_id, user_id::INTEGER AS episode FROM events")
def path_to_episode(spark, d):
    users = read(spark, d, "events").select("user_id").distinct()
    return users.select("user_id", layout.episode_of(layout.data_path(F.col("user_id"), 50)).alias("episode"))


@query("numeric_name_order", "SELECT user_id, 'img_' || user_id || '.jpg' AS name, row_number() OVER (ORDER BY user_id) AS place FROM (SELECT DISTINCT user_id FROM events)")
def numeric_names(spark, d):
    names = read(spark, d, "events").select("user_id").distinct().withColumn("name", F.format_string("img_%d.jpg", "user_id"))
    return numbered(names.withColumn("n", F.regexp_extract("name", r"_(\d+)\.", 1).cast("long")), "n", "name", name="place", start=1).drop("n")


@query("frame_time_grid", "WITH u AS (SELECT DISTINCT user_id, user_id % 4 AS dur FROM events) SELECT user_id, slot, round(slot / 5.0, 6) AS at FROM (SELECT user_id, unnest(range(dur * 5 + 1)) AS slot FROM u)")
def time_grid(spark, d):
    u = read(spark, d, "events").select("user_id").distinct()
    return u.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("user_id") % 4 * 5)).alias("slot")).select("user_id", "slot", r6(F.col("slot") / 5.0, "at"))


@query("metadata_patch", "SELECT doc_id, coalesce(CAST(l.quality AS VARCHAR), 'none') AS quality, d.lang, CASE WHEN l.doc_id IS NULL THEN 'old' ELSE 'new' END AS state FROM documents d LEFT JOIN labels l USING (doc_id)")
def metadata_patch(spark, d):
    """Old keys stay, the patch's keys win."""
    got = read(spark, d, "documents").select("doc_id", "lang").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    old = F.create_map(F.lit("lang"), F.col("lang"), F.lit("quality"), F.lit("none"), F.lit("state"), F.lit("old"))
    patch = F.when(F.col("quality").isNotNull(), F.create_map(F.lit("quality"), F.col("quality").cast("string"), F.lit("state"), F.lit("new"))).otherwise(F.expr("map()").cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(patch), k))
    merged = F.map_concat(kept, patch)
    return got.select("doc_id", merged.alias("m")).select("doc_id", F.col("m")["quality"].alias("quality"), F.col("m")["lang"].alias("lang"), F.col("m")["state"].alias("state"))


@query("frame_count_rule", "WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS a, count(*) FILTER (event_type = 'signup') AS b FROM events GROUP BY 1) SELECT user_id, CASE WHEN a > 0 AND b > 0 THEN least(a, b) ELSE greatest(a, b) END AS n_frames FROM c")
def frame_count(spark, d):
    of = lambda t: F.count_if(F.col("event_type") == t)
    c = read(spark, d, "events").groupBy("user_id").agg(of("view").alias("a"), of("signup").alias("b"))
    return c.select("user_id", F.when((F.col("a") > 0) & (F.col("b") > 0), F.least("a", "b")).otherwise(F.greatest("a", "b")).alias("n_frames"))


@query("renamed_and_constant_columns", "SELECT event_id, value AS action_fk, value AS action, event_id % 4 AS task_index, user_id + 100 AS episode_index FROM events")
def renamed(spark, d):
    rows = read(spark, d, "events").select("event_id", "user_id", F.col("value").alias("action"))
    if "action_fk" not in rows.columns:  # doing it twice changes nothing
        rows = rows.withColumnRenamed("action", "action_fk").withColumn("action", F.col("action_fk"))
    return rows.withColumn("task_index", F.col("event_id") % 4).withColumn("episode_index", F.col("user_id") + 100).drop("user_id")


@query("vector_unwrap", "SELECT vec_id, embedding[1:7] AS state, embedding[7] AS gripper FROM embeddings")
def unwrap(spark, d):
    nested = read(spark, d, "embeddings").select("vec_id", F.array(F.slice("embedding", 1, 7)).alias("state"))
    return nested.select("vec_id", F.flatten("state").alias("state")).withColumn("gripper", F.element_at("state", -1))


@query("prompt_templates", "SELECT event_id, 'Global_Instruction: ' || event_type || chr(10) || 'Memory: step ' || (event_id % 3) || ' of 3' AS prompt FROM events")
def prompts(spark, d):
    memory = F.format_string("step %d of 3", F.col("event_id") % 3)
    return read(spark, d, "events").select("event_id", F.concat(F.lit("Global_Instruction: "), "event_type", F.lit("\nMemory: "), memory).alias("prompt"))


@query("channel_counts", "SELECT DISTINCT source, CASE WHEN contains(source, '1') THEN 1 WHEN contains(source, '2') THEN 4 ELSE 3 END AS channels FROM documents")
def channels(spark, d):
    s = F.col("source")
    return read(spark, d, "documents").select("source").distinct().select("source", F.when(s.contains("1"), 1).when(s.contains("2"), 4).otherwise(3).alias("channels"))


@query("value_distribution", "SELECT floor(value / 10)::BIGINT AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def distribution(spark, d):
    return read(spark, d, "events").groupBy(F.floor(F.col("value") / 10).alias("k")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value"), "mean"))


@query("chunk_loss_means", f"WITH {FR} SELECT frame_index % 4 AS layer, round(avg(value), 6) AS loss FROM fr GROUP BY 1")
def losses(spark, d):
    return event_frames(spark, d, "value").groupBy((F.col("frame_index") % 4).alias("layer")).agg(r6(F.avg("value"), "loss"))


@query("feature_kinds", "SELECT * FROM (VALUES ('doc_id', 'LONG', 'OTHER'), ('lang', 'STRING', 'OTHER'), ('n_chars', 'LONG', 'OTHER'), ('source', 'STRING', 'OTHER'), ('text', 'STRING', 'OTHER')) v(name, dtype, kind)")
def feature_kinds(spark, d):
    """Semantic kind of each column by its name's start."""
    rows = [(f.name, f.dataType.typeName().upper()) for f in read(spark, d, "documents").schema.fields]
    name = F.col("name")
    kind = F.when(name.startswith("observation.environment_state"), "ENV").when(name.startswith("observation"), "STATE").when(name.startswith("action"), "ACTION").otherwise("OTHER")
    return spark.createDataFrame(rows, "name string, dtype string").withColumn("kind", kind)
