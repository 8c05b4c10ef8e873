"""A directory as a table: listings, roots, episode folders and spec files.

A listing reads names, sizes and times only (the content column is pruned away). Where a
folder is laid out as ``key=value``, the keys are columns and filters on them prune folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def is_folder(spark: SparkSession, path: str) -> bool:
    where, fs = _path(spark, path)
    return fs.exists(where) and fs.getFileStatus(where).isDirectory()


def delete(spark: SparkSession, path: str) -> None:
    where, fs = _path(spark, path)
    fs.delete(where, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Moves a file or folder; an existing target is an error."""
    (where, fs), (to, _) = _path(spark, old), _path(spark, new)
    if fs.exists(to) or not fs.rename(where, to):
        raise FileExistsError(f"{old} can't become {new}")


def listing(spark: SparkSession, path: str, glob: str = "*", partitioned: bool = False) -> DataFrame:
    """path, length and modified of every file below; with ``partitioned`` also the folder keys.

    A missing root is an error, as is a root that is no folder of ``key=value`` folders when
    ``partitioned`` is asked for and it has none.
    """
    if not is_folder(spark, path):
        raise FileNotFoundError(f"no such folder: {path}")
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    files = (reader if partitioned else reader.option("recursiveFileLookup", True)).load(path)
    keys = [c for c in files.columns if c not in ("path", "modificationTime", "length", "content")]
    return files.select("path", "length", F.col("modificationTime").alias("modified"), *keys)


def lines_root(spark: SparkSession, path: str, inner: str = "shards", suffix: str = ".jsonl") -> str:
    """Where to read lines: a file itself, a folder's ``inner`` folder if it has one, else the folder."""
    if is_folder(spark, path):
        return f"{path.rstrip('/')}/{inner}" if is_folder(spark, f"{path.rstrip('/')}/{inner}") else path
    where, fs = _path(spark, path)
    if path.endswith(suffix) and fs.exists(where):
        return path
    raise ValueError(f"neither a {suffix} file nor a folder: {path}")


def episode_folders(files: DataFrame) -> DataFrame:
    """(chunk, episode, files, bytes) of the files below ``chunk-N/episode_M`` or ``chunk=N/episode=M``; others go."""
    at = r"chunk[-=](\d+)/episode[_=](\d+)(?:/|\.[A-Za-z0-9]+$)"
    found = files.filter(F.col("path").rlike(at)).select(F.regexp_extract("path", at, 1).cast("long").alias("chunk"), F.regexp_extract("path", at, 2).cast("long").alias("episode"), "length")
    return found.groupBy("chunk", "episode").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def missing(wanted: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Rows of ``wanted`` (path, below ``root``) below which nothing is listed."""
    below = F.regexp_extract("path", r"^.*" + _quoted(root.rstrip("/")) + r"/(.*)/[^/]*$", 1)
    have = files.select(below.alias("path")).distinct()
    return wanted.join(have, "path", "left_anti")


def _quoted(text: str) -> str:
    return r"\Q" + text.split(":", 1)[-1].lstrip("/") + r"\E"


def read_specs(spark: SparkSession, path: str, schema: str, key: str, glob: str = "*.json") -> DataFrame:
    """One row per spec file below ``path``, with its ``file``; spec files are small.

    A file that is no object of the schema, a missing key, or one key in two files is an
    error that names the files.
    """
    if not is_folder(spark, path):
        raise FileNotFoundError(f"no such folder: {path}")
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("v"))
    wrong = rows.filter(F.col("v").isNull() | F.col("v._bad").isNotNull() | F.col(f"v.`{key}`").isNull()).select("file").orderBy("file").limit(5).collect()
    if wrong:
        raise ValueError(f"no spec with a {key}: {', '.join(r['file'] for r in wrong)}")
    twice = rows.groupBy(F.col(f"v.`{key}`").alias("k")).agg(F.array_sort(F.collect_list("file")).alias("files")).filter(F.size("files") > 1).orderBy("k").limit(5).collect()  # files that share a key
    if twice:
        raise ValueError("; ".join(f"duplicate {key}={r['k']} in {', '.join(r['files'])}" for r in twice))
    names = [f.name for f in rows.schema["v"].dataType.fields if f.name != "_bad"]
    return rows.select("file", *[F.col(f"v.`{n}`").alias(n) for n in names])
