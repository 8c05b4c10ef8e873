"""Row rules, duplicates and monotonicity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def issues(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row per violated rule; a rule is true for a bad row."""
    codes = F.filter(F.array(*[F.when(bad, F.lit(code)) for code, bad in rules.items()]), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(codes).alias("issue"))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])


def duplicates(df: DataFrame, uid: str, order: str) -> DataFrame:
    """Repeated rows with the place where their uid was seen first."""
    by = Window.partitionBy(uid)
    return df.withColumn("first_at", F.min(order).over(by)).filter(F.col(order) > F.col("first_at"))


def not_monotonic(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Rows whose value is below that of the row just before, also after a violation."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(order))
    return df.withColumn("before", before).filter(F.col(value) < F.col("before"))


def missing_files(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return wanted.join(present.select(key).distinct(), key, "left_anti")


def key_rules(row: Column, required: list[str], groups: dict[str, list[str]] | None = None) -> dict[str, Column]:
    """Rules of the keys of a row given as JSON text: ``missing_<key>``, and ``missing_any_<name>`` where none of a group is there.

    A key with a JSON null is there. Text that is no JSON object, null too, breaks ``row_not_object`` alone.
    """
    keys = F.json_object_keys(row)
    known = keys.isNotNull()
    rules = {"row_not_object": ~known}
    for k in required:
        rules[f"missing_{k}"] = known & ~F.array_contains(keys, k)
    for name, some in (groups or {}).items():
        rules[f"missing_any_{name}"] = known & ~F.arrays_overlap(keys, F.array(*[F.lit(k) for k in some]))
    return rules


def label_rules(output: Column, statuses: list[str], longest: int = 512) -> dict[str, Column]:
    """Rules of a map with desc_1, desc_2 and status; an absent map breaks none."""
    here, rules = output.isNotNull(), {}
    text = lambda k: F.regexp_replace(F.coalesce(output[k], F.lit("")), r"^\s+|\s+$", "")
    for k in ("desc_1", "desc_2", "status"):
        rules[f"api_output_missing_{k}"] = here & ~F.coalesce(F.array_contains(F.map_keys(output), k), F.lit(False))
    rules["label_status_invalid"] = here & ~F.coalesce(output["status"].isin(statuses), F.lit(False))
    for k, name in (("desc_1", "desc1"), ("desc_2", "desc2")):
        rules[f"label_{name}_empty"] = here & (text(k) == "")
        rules[f"label_{name}_too_long"] = here & (F.length(text(k)) > longest)
    return rules


def target_rules(target: Column, statuses: list[str], longest: int = 512) -> dict[str, Column]:
    """Rules of a target given as JSON text with status, desc_1 and desc_2; a null text breaks none.

    Text that is no JSON, or no object, breaks that rule alone; so does text that goes on behind a JSON value. A
    description that is absent, not a string or blank is empty; a status counts only as a string.
    """
    mark = F.xxhash64(target).cast("string")  # Spark's parser stops behind a first value: the text's own hash must follow it
    both = F.try_parse_json(F.concat(F.lit("["), target, F.lit(',"'), mark, F.lit('"]')))
    value = F.when(F.try_variant_get(both, "$[1]", "string") == mark, F.try_variant_get(both, "$[0]", "variant"))
    kind = F.schema_of_variant(value)
    off = lambda c: F.coalesce(c, F.lit(False))
    whole = off(kind.startswith("OBJECT"))
    own = lambda k: F.when(F.schema_of_variant(F.try_variant_get(value, f"$.{k}", "variant")) == "STRING", F.try_variant_get(value, f"$.{k}", "string"))
    rules = {
        "label_target_text_not_json": target.isNotNull() & value.isNull(),
        "label_target_text_not_dict": off(~kind.startswith("OBJECT")),
        "label_status_invalid": whole & ~off(own("status").isin(statuses)),
    }
    for k, name in (("desc_1", "desc1"), ("desc_2", "desc2")):
        text = F.regexp_replace(F.coalesce(own(k), F.lit("")), r"^\s+|\s+$", "")
        rules[f"label_{name}_empty"] = whole & (text == "")
        rules[f"label_{name}_too_long"] = whole & (F.length(text) > longest)
    return rules


def image_rules(images: Column, cameras: Column, millis: Column, strict: bool = False) -> dict[str, Column]:
    """Rules of a map of image paths, the list of cameras and a time given as text; null breaks none of them."""
    off = lambda c: F.coalesce(c, F.lit(False))
    rules = {
        "images_count_out_of_bounds": off(~F.size(F.map_keys(images)).between(1, 8)),
        "images_value_not_str": off(F.exists(F.map_values(images), lambda v: v.isNull())),
        "images_count_mismatch": off(F.size(F.map_keys(images)) != F.size(cameras)),
        "timestamp_invalid": millis.isNotNull() & off(F.coalesce(millis.try_cast("long") < 0, F.lit(True))),
    }
    if strict:
        rules["images_keys_mismatch_strict"] = off(F.array_sort(F.array_distinct(F.map_keys(images))) != F.array_sort(F.array_distinct(cameras)))
    return rules


def first_nulls(df: DataFrame, key: str, columns: list[str], n: int = 10) -> DataFrame:
    """The report of the first ``n`` rows with a null, in order of the key, and their null columns."""
    bad = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    return df.select(key, bad.alias("null_columns")).filter(F.size("null_columns") > 0).orderBy(key).limit(n)
