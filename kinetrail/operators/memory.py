"""Training rows from task specs, episodes and event frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hashed_uid, strip_text
from .positions import checkpointed
from .quality import issues
from .sampling import hash_rank, negatives, split_episodes


def explode_spec(specs: DataFrame) -> DataFrame:
    """specs (task_id, grid array<array<struct>>) to one row per (task_id, inter, step)."""
    rows = specs.select("task_id", F.posexplode("grid").alias("inter", "row"))
    return rows.select("task_id", "inter", F.size("row").alias("n_steps"), F.posexplode("row").alias("step", "cell")).select("task_id", "inter", "step", "n_steps", "cell.*")


def spec_problems(specs: DataFrame) -> DataFrame:
    """Ids used twice, and grids whose last state of the last row is not ``done``."""
    twice = specs.groupBy("task_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("task_id", F.lit("duplicate_id").alias("problem"))
    final = F.element_at(F.element_at("grid", -1), -1)["command"]
    return twice.unionByName(specs.filter(final != "done").select("task_id", F.lit("last_state_not_done").alias("problem")))


def shape_problems(specs: DataFrame, keys: list[str]) -> DataFrame:
    """One row (task_id, issue) per rule that a spec's shape breaks.

    ``specs`` has task_id, inter int, intra array<int>, grid array<array<map<string,string>>>, filters
    array<array<string>> and commands array<string> (null or empty: not given) and negatives int. There are inter + 1
    rows of intra + 1 states, each with all ``keys``; a row ends in ``done``, and so do the commands
    name it. A null list counts as empty, so it breaks the rules of lengths.
    """
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    some = lambda c, f: F.coalesce(F.exists(c, f), F.lit(False))
    done = lambda x: F.coalesce(F.lower(F.trim(x)) == "done", F.lit(False))
    rows, given = F.col("inter") + 1, size(F.col("filters")) > 0
    pairs = lambda c, more: F.zip_with(c, F.col("intra"), lambda a, n: a.isNull() | n.isNull() | (F.size(a) != n + more))
    rules = {
        "grid_rows": size(F.col("grid")) != rows,
        "intra_rows": size(F.col("intra")) != rows,
        "filter_rows": given & (size(F.col("filters")) != rows),
        "filter_row_length": given & some(pairs(F.col("filters"), 0), lambda bad: bad),
        "grid_row_length": some(pairs(F.col("grid"), 1), lambda bad: bad),
        "row_end_not_done": some(F.col("grid"), lambda row: ~done(F.try_element_at(row, F.lit(-1))[keys[0]])),
        "negatives_missing": F.col("negatives").isNull(),
        "commands_without_done": (size(F.col("commands")) > 0) & ~some(F.col("commands"), done),
    }
    lacks = lambda k: lambda cell: ~F.coalesce(F.map_contains_key(cell, k), F.lit(False))
    for k in keys:
        rules[f"state_without_{k.lower()}"] = some(F.flatten("grid"), lacks(k))
    return issues(specs, ["task_id"], rules)


def pool(rows: DataFrame, specs: DataFrame, text: str, wanted: str, key: str, salts: int = 32) -> DataFrame:
    """Rows with the specs that want their text; a spec whose ``wanted`` is null takes every row.

    One equi join: every row goes out under its text and under ``any`` with a salt from its key, each
    spec under its text or under ``any`` with every salt, so no key holds all rows.
    """
    way = lambda salt, x: F.struct(F.lit(salt).cast("long").alias("salt") if isinstance(salt, int) else salt.cast("long").alias("salt"), x.alias("text"))
    sides = F.array(way(-1, F.col(text).cast("string")), way(F.pmod(F.xxhash64(key), F.lit(salts)), F.lit("")))
    left = rows.withColumn("__k", F.explode(sides))
    spread = F.transform(F.sequence(F.lit(0), F.lit(salts - 1)), lambda s: way(s, F.lit("")))
    right = specs.withColumn("__k", F.explode(F.when(F.col(wanted).isNull(), spread).otherwise(F.array(way(-1, F.col(wanted).cast("string"))))))
    return left.join(right, "__k").drop("__k")


def assigned(episodes: DataFrame, filters: DataFrame, text: str, events: str, need_event: bool = True) -> DataFrame:
    """Episodes with the first (inter, step) of each task whose filter is their text; others go, as do blank texts.

    ``filters`` has task_id, inter, step and ``text``, one row per allowed text; blanks at both ends don't count.
    With ``need_event``, episodes without event frames go too.
    """
    first = filters.groupBy("task_id", strip_text(F.col(text)).alias("__w")).agg(F.min(F.struct("inter", "step")).alias("__f"))
    got = episodes.withColumn("__w", strip_text(F.col(text))).filter("__w <> ''").join(first, "__w").drop("__w")
    got = got.filter(F.size(events) > 0) if need_event else got
    return got.withColumn("inter", F.col("__f.inter")).withColumn("step", F.col("__f.step")).drop("__f")


def transitions(spec: DataFrame) -> DataFrame:
    """State changes inside a row (intra), and from a row's last state to the next row (task_change)."""
    by = Window.partitionBy("task_id").orderBy("inter", "step")
    after = spec.withColumn("inter_to", F.lead("inter").over(by)).withColumn("step_to", F.lead("step").over(by)).withColumn("command_to", F.lead("command").over(by))
    kind = F.when(F.col("inter") == F.col("inter_to"), "intra").otherwise("task_change")
    return after.filter("inter_to is not null").select("task_id", kind.alias("kind"), "inter", "step", F.col("command").alias("command_from"), "inter_to", "step_to", "command_to")


def detect_rows(frames: DataFrame, spec: DataFrame, episode: str, is_event, on: str) -> DataFrame:
    """One row per frame and non-final state of a matching spec, labelled by its event.

    The spec is exploded first and is the small side; ``on`` is the equality filter.
    """
    states = spec.filter(F.col("step") < F.col("n_steps") - 1)
    label = F.when(is_event, "detect_pos").otherwise("detect_neg")
    return frames.join(states, on).withColumn("label", label).withColumn("event_detected", is_event)


def update_rows(events: DataFrame, changes: DataFrame, on: list[str]) -> DataFrame:
    """One row per event frame and the change that it causes."""
    return events.join(changes, on).withColumn("mode", F.lit("UPDATE")).withColumn("label", F.concat(F.lit("update_"), F.col("kind")))


def transition_frame(ids):
    """The third frame of a list, else the last."""
    return F.element_at(ids, F.least(F.lit(3), F.size(ids)))


def event_frames(custom, frames, events, single):
    """First non-empty of four encodings, sorted and distinct."""
    some = lambda a: F.when(F.size(a) > 0, a)
    one = F.when(single.isNotNull(), F.array(single))
    return F.coalesce(*[F.array_sort(F.array_distinct(x)) for x in (some(custom), some(frames), some(F.filter(F.transform(events, lambda e: e["frame"]), lambda x: x.isNotNull())), one)])


def row_uid(*parts):
    return hashed_uid(*parts)


def gated(episodes: DataFrame) -> DataFrame:
    """Episodes with frames, whose clamped frame count and event are consistent."""
    n = F.greatest(F.lit(1), F.least(F.coalesce("meta_frames", "camera_frames"), F.col("camera_frames")))
    return episodes.filter("camera_frames > 0").withColumn("n_frames", n).withColumn("event", F.greatest(F.lit(0), F.least(F.col("event"), F.col("n_frames") - 1))).filter("event is not null")


def transition_updates(episodes: DataFrame, spec: DataFrame, on: str) -> DataFrame:
    """One ``update_transition`` per episode that state (1, 0) takes: from the last state of row 0, at the third event frame.

    ``episodes`` has ``event_frames``; episodes without one give no row.
    """
    last = spec.filter("inter = 0 and step = n_steps - 1").select("task_id", F.col("command").alias("command_from"))
    to = spec.filter("inter = 1 and step = 0").select("task_id", on, "inter", "step", F.col("command").alias("command_to"))
    got = episodes.filter(F.size("event_frames") > 0).join(to.join(last, "task_id"), on)
    return got.withColumn("frame_index", transition_frame(F.col("event_frames"))).withColumn("label", F.lit("update_transition"))


def event_rows(frames: DataFrame, episodes: DataFrame, episode: str, gap: int, n: int, seed: int = 0) -> DataFrame:
    """Sampled negatives before the first event frame, and that frame as the positive.

    ``episodes`` has ``event_frames`` and ``n_frames``; a first event outside 0 .. n_frames - 1
    or none drops the episode. A negative frame number counts as the first event, so it drops too.
    """
    first = episodes.select(episode, F.array_min("event_frames").alias("event_t"), "n_frames").filter("event_t >= 0 and event_t < n_frames")
    got = frames.join(first, episode)
    return negatives(got, episode, "event_t", gap, n, seed=seed).withColumn("positive", F.lit(False)).unionByName(got.filter("frame_index = event_t").withColumn("positive", F.lit(True)))


def build(frames: DataFrame, spec: DataFrame, is_event, episode: str, on: str, ratio: float, shard: int, seed: int = 0) -> DataFrame:
    """All rows of the tasks: DETECT and UPDATE with uid, episode split and shard.

    DETECT: a row per frame and non-final state. UPDATE: a row per event frame and state
    change inside a row, and the transition row of each episode. Shards of ``shard`` rows per
    (mode, split) hold a seeded shuffle, so that no shard is one task's run. The rows are made
    once and checkpointed, for the ranks read them twice. Without frames there are no rows.
    """
    keep = ["task_id", episode, "inter", "step", "frame_index", "label"]
    detect = detect_rows(frames, spec, episode, is_event, on).select(*keep).withColumn("mode", F.lit("DETECT"))
    events = frames.filter(is_event)
    inner = transitions(spec).filter("kind = 'intra'").join(spec.select("task_id", on).distinct(), "task_id")
    update = update_rows(events, inner, [on]).select(*keep, "mode")
    lists = events.groupBy(episode, on).agg(F.array_sort(F.collect_list("frame_index")).alias("event_frames"))  # event frames of one episode
    turn = transition_updates(lists, spec, on).select(*keep).withColumn("mode", F.lit("UPDATE"))
    split = split_episodes(frames.select(episode).distinct(), episode, ratio, True, seed)
    rows = detect.unionByName(update).unionByName(turn).join(split, episode)
    rows = rows.withColumn("uid", F.concat_ws("-", "label", "task_id", F.col(episode).cast("string"), F.col("inter").cast("string"), F.col("step").cast("string"), F.col("frame_index").cast("string")))
    ranked = hash_rank(checkpointed(rows).withColumn("__g", F.concat_ws("/", "mode", "split")), "__g", "uid", seed, "__k")
    return ranked.withColumn("shard", F.floor(F.col("__k") / shard)).drop("__g", "__k", "__k_of")


def write_build(rows: DataFrame, path: str, meta: dict, shard: int = 500) -> None:
    """JSON lines in a folder per mode and split, files of at most ``shard`` rows in order of shards, and one row of meta.

    An empty build leaves its meta row and a rows folder without lines.
    """
    placed = rows.repartitionByRange("mode", "split", "shard").sortWithinPartitions("mode", "split", "shard", "uid")
    placed.write.partitionBy("mode", "split").option("maxRecordsPerFile", shard).json(f"{path}/rows")
    rows.sparkSession.createDataFrame([{k: str(v) for k, v in meta.items()}]).coalesce(1).write.json(f"{path}/meta")
