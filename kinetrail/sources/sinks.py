"""Writers of reports, dead letters and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dead_letter_write(rows: DataFrame, path: str, failed: Column) -> None:
    """Good rows and failed ones in two folders of one job, so that each row is made once.

    A verdict of null counts as failed. ``rows`` may not have a column ``outcome``.
    """
    outcome = F.when(F.coalesce(~failed, F.lit(False)), "rows").otherwise("failures")
    rows.withColumn("outcome", outcome).write.partitionBy("outcome").json(path)


def shard_index(spark, path: str, glob: str = "*.json") -> DataFrame:
    """One row per written file with rows: its name and their number."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    return files.groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).agg(F.count(F.lit(1)).alias("n_rows"))


def write_tsv(report: DataFrame, path: str) -> None:
    report.write.option("sep", "\t").option("header", True).csv(path)


def write_csv(table: DataFrame, path: str) -> None:
    table.write.option("header", True).csv(path)


def write_votes(votes: DataFrame, path: str) -> None:
    """Votes as CSV and as JSON lines; the table is read from the first write for the second."""
    votes.write.json(f"{path}/jsonl")
    write_csv(votes.sparkSession.read.schema(votes.schema).json(f"{path}/jsonl"), f"{path}/csv")
