"""Votes and accuracies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def majority(df: DataFrame, by: str, status: str, priority: list[str]) -> DataFrame:
    """Most frequent status per group; ties by priority."""
    rank = F.coalesce(*[F.when(F.col(status) == s, F.lit(i)) for i, s in enumerate(priority)], F.lit(len(priority)))
    counts = df.groupBy(by, status).agg(F.count(F.lit(1)).alias("votes"))
    best = F.row_number().over(Window.partitionBy(by).orderBy(F.col("votes").desc(), rank))
    return counts.withColumn("__r", best).filter("__r = 1").drop("__r")


def accuracy(df: DataFrame, sets: list[list[str]], ok: Column) -> DataFrame:
    """n, ok and percent for each grouping set."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    out = df.withColumn("__ok", ok.cast("int")).groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names])
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum("__ok").alias("ok")).withColumn("pct", F.col("ok").cast("double") / F.greatest(F.col("n"), F.lit(1)) * 100.0)


def accuracies(df: DataFrame, parsed: Column, ok: Column) -> DataFrame:
    """The three denominators: parsed rows only, failures counted apart, failures as errors."""
    good = F.count(F.when(parsed & ok, 1)).cast("double")
    seen, every = F.count(F.when(parsed, 1)), F.count(F.lit(1))
    one = F.lit(1)
    return df.agg((good / F.greatest(seen, one)).alias("of_parsed"), (every - seen).alias("parse_failures"), (good / F.greatest(every, one)).alias("of_all"))


def majority_texts(df: DataFrame, by: str, status: str, first: str, second: str, priority: list[str], order: str) -> DataFrame:
    """The winning candidate per group with all vote counts.

    Most frequent status, ties by ``priority``; of its candidates that with the shortest two
    texts, ties to the smallest ``order``. Statuses outside ``priority`` do not vote; null
    texts count as empty.
    """
    size = F.coalesce(F.length(first), F.lit(0)) + F.coalesce(F.length(second), F.lit(0))
    per = df.filter(F.col(status).isin(priority)).groupBy(by, status).agg(F.count(F.lit(1)).alias("__n"), F.min_by(F.struct(first, second, order), F.struct(size, order)).alias("__best"))
    rank = F.coalesce(*[F.when(F.col(status) == s, F.lit(i)) for i, s in enumerate(priority)])
    votes = [F.coalesce(F.max(F.when(F.col(status) == s, F.col("__n"))), F.lit(0)).alias("votes_" + s.lower().replace(" ", "_")) for s in priority]
    got = per.groupBy(by).agg(F.min_by(F.struct(status, "__best"), F.struct(-F.col("__n"), rank)).alias("__w"), *votes)
    return got.select(by, f"__w.{status}", f"__w.__best.{first}", f"__w.__best.{second}", f"__w.__best.{order}", *["votes_" + s.lower().replace(" ", "_") for s in priority])


def revote(first: DataFrame, again: DataFrame, by: str, status: str, priority: list[str], unsure: str) -> DataFrame:
    """Results of ``majority_texts`` of two rounds: undecided groups take the second round's, if that is decisive.

    Then their vote counts are the sums of both rounds; else all is as in the first round.
    ``retried`` says that the group was undecided, ``replaced`` that it took the second result. Groups of
    the second round alone give no row.
    """
    votes = ["votes_" + s.lower().replace(" ", "_") for s in priority]
    own = [c for c in first.columns if c != by and c not in votes]
    second = again.select(F.col(by).alias("__by"), F.struct(*own, *votes).alias("__b"))
    got = first.join(second, F.col(by) == F.col("__by"), "left")
    retried = F.coalesce(F.col(status) == unsure, F.lit(False))
    taken = retried & F.coalesce(F.col(f"__b.{status}") != unsure, F.lit(False))
    one = [F.when(taken, F.col(f"__b.{c}")).otherwise(F.col(c)).alias(c) for c in own]
    sums = [F.when(taken, F.col(v) + F.col(f"__b.{v}")).otherwise(F.col(v)).alias(v) for v in votes]
    return got.select(by, *one, *sums, retried.alias("retried"), taken.alias("replaced"))


def match_fields(truth: Column, guess: Column, keys: list[str], norm) -> dict[str, Column]:
    """``match_<key>`` per key of two parsed maps and ``match``, all of them."""
    one = {f"match_{k}": norm(truth[k]).eqNullSafe(norm(guess[k])) for k in keys}
    every = F.lit(True)
    for c in one.values():
        every = every & c
    return {**one, "match": every}


def match_flag(truth: Column, guess: Column, key: str, norm) -> Column:
    """True if both maps hold a readable boolean under the key, and the same."""
    return F.coalesce(norm(truth[key]) == norm(guess[key]), F.lit(False))
