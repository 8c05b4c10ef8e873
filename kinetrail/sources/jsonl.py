"""JSON lines: strict and tolerant readers with line numbers, appends, sharded writer.

Files are split into blocks; the lines of each block are counted, and the counts of the
blocks before are a line's offset in its file. No file is held in memory, and of the counts there
is one row a block.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.merge import shard_ids
from .files import _path


def numbered_lines(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """Every line, blank ones too: file, line (from 1), place (from 1, over files by name), raw.

    Lines end at LF; a CR before it is cut off. Inside a task Spark's row ids go on by one a line,
    so a line's number in its block is its id less the least id of the block.
    """
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("lineSep", "\n").text(path)
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"), F.regexp_replace("value", r"\r$", "").alias("raw"))
    blocks = rows.groupBy("file", "__block").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    in_file = Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("__before", F.sum("__n").over(in_file) - F.col("__n"))
    files = {r["file"]: r["n"] for r in blocks.groupBy("file").agg(F.sum("__n").alias("n")).collect()}  # one row a file, as in Spark's own listing
    upto, starts = 0, []
    for f in sorted(files):
        starts.append((f, upto))
        upto += files[f]
    blocks = blocks.join(F.broadcast(spark.createDataFrame(starts, "file string, __from long")), "file")
    line = F.col("__id") - F.col("__first") + F.col("__before") + 1
    return rows.join(F.broadcast(blocks), ["file", "__block"]).select("file", line.alias("line"), (line + F.col("__from")).alias("place"), "raw")


def _parsed(lines: DataFrame, schema: str) -> tuple[DataFrame, list[str]]:
    """Non-blank lines with ``_v``, whose ``_bad`` is the line if it is no object of the schema."""
    rows = lines.filter(F.trim("raw") != "").withColumn("_v", F.from_json("raw", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return rows, [f.name for f in rows.schema["_v"].dataType.fields if f.name != "_bad"]


def read_strict(spark: SparkSession, path: str, schema: str, glob: str = "*.jsonl") -> DataFrame:
    """The rows of all lines; blank lines are skipped, a bad line is an error that names file and line."""
    rows, names = _parsed(numbered_lines(spark, path, glob), schema)
    bad = F.raise_error(F.concat(F.lit("JSON parse error: "), "file", F.lit(" line "), F.col("line").cast("string"), F.lit(": "), F.substring("raw", 1, 200))).cast("boolean")
    return rows.filter(F.when(F.col("_v._bad").isNull(), F.lit(True)).otherwise(bad)).select(*[F.col(f"_v.`{n}`").alias(n) for n in names])


def read_tolerant(spark: SparkSession, path: str, schema: str, glob: str = "*.jsonl") -> DataFrame:
    """Every non-blank line with its file and line number; a bad one has ``error`` and ``raw``."""
    rows, names = _parsed(numbered_lines(spark, path, glob), schema)
    return rows.select("file", "line", "raw", F.when(F.col("_v._bad").isNotNull(), "bad_json").alias("error"), *[F.col(f"_v.`{n}`").alias(n) for n in names])


def append_lines(df: DataFrame, path: str) -> None:
    """The rows of ``df`` as further files of JSON lines; what the folder holds stays."""
    df.write.mode("append").json(path)


def last_per_key(rows: DataFrame, key: str) -> DataFrame:
    """The last line of each key; lines without a key go."""
    by = Window.partitionBy(key).orderBy(F.col("file").desc(), F.col("line").desc())
    return rows.filter(F.col(key).isNotNull()).withColumn("__r", F.row_number().over(by)).filter("__r = 1").drop("__r")


def write_shards(df: DataFrame, path: str, group: str, order: str, size: int) -> None:
    """One folder per group and shard of ``size`` rows, as JSON lines."""
    rows = shard_ids(df, group, order, size)
    rows.repartition(group, "shard").sortWithinPartitions(group, "shard", order).write.partitionBy(group, "shard").json(path)


def write_object(spark: SparkSession, path: str, value: dict) -> None:
    """One JSON object, of metadata's size, as one file: indented by 4, other scripts as they are; replaces a file."""
    where, fs = _path(spark, path)
    out = fs.create(where, True)
    try:
        out.write((json.dumps(value, indent=4, ensure_ascii=False) + "\n").encode())
    finally:
        out.close()


def read_object(spark: SparkSession, path: str) -> dict:
    """The object of such a file; a missing file or text that is no object is an error."""
    value = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no JSON object")
    return value
