"""Mixing sources to target weights by temperature.

A source with token share p gets the weight p**a / sum(p**a). The exponent a (1:
natural shares, 0: equal weights, above 1: sharper) is the smallest that keeps the most
repeated source within ``max_repetition`` epochs, and, with ``target_entropy``
(nats), the one that brings the weights' entropy to the target, whichever is
larger. It is found by bisection; one job tries ``WAYS`` - 1 inner points at once,
and the sums over sources stay in Spark, so the number of sources is not bounded.

The budget is ``budget_tokens``, or else the smallest budget in which every
document appears at least once. A source with b budgeted and n own tokens has
floor(b / n) whole epochs and one partial epoch. Documents fall by hash into
blocks of about ``block_tokens``; each epoch is a permutation of the blocks, and
the partial epoch takes blocks in that order until the rest of the budget is
filled. The block on the border is filled document by document, never beyond the
budget.

Defined results. Tokens are runs of non-blank characters; a text without any, or
a null text, counts one token. A null source is a source of its own. Rows
repeated with one id are documents each, unless the partial epoch cuts between
them; they share a block. An empty table gives an empty table. Working columns
have the prefix ``__mx_``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, table

MAX_REPETITION, BLOCK_TOKENS, SEED, WAYS, PASSES, SHARPEST = 1.25, 1 << 16, 17, 64, 4, 64.0
BROADCAST_ROWS, LANE_BITS = 100_000, 10


def source_shares(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    tokens = F.greatest(F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"\S+")), F.lit(1)).cast("long")
    return docs.withColumn("__mx_tokens", tokens).withColumn("__mx_src", F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null")))


def fit_exponent(sources: DataFrame, total: int, max_repetition: float | None, target_entropy: float | None, budget: int | None) -> float:
    """Smallest exponent that meets both targets, to six decimals."""
    p = F.col("__mx_n") / F.lit(float(total))

    def met(points: list[float]) -> dict[float, bool]:
        tried = sources.withColumn("a", F.explode(F.array(*[F.lit(float(x)) for x in points])))
        sums = tried.groupBy("a").agg(
            F.sum(F.pow(p, F.col("a"))).alias("z"), F.sum(F.pow(p, F.col("a")) * F.log(p)).alias("l"), F.max(F.pow(p, F.col("a") - 1)).alias("most"), F.min(F.pow(p, F.col("a") - 1)).alias("least")
        )
        ok = {}
        for r in sums.collect():  # WAYS + 1 rows
            repeats = r["most"] / r["least"] if budget is None else budget * r["most"] / r["z"] / total
            entropy = math.log(r["z"]) - r["a"] * r["l"] / r["z"]
            ok[r["a"]] = (max_repetition is None or repeats <= max_repetition * (1 + 1e-12)) and (target_entropy is None or entropy <= target_entropy + 1e-12)
        return ok

    low, high = 0.0, 1.0
    if met([0.0])[0.0]:
        return 0.0
    if not met([1.0])[1.0]:  # sharper than the natural shares
        low, high = 1.0, SHARPEST
        if not met([high])[high]:
            raise ValueError("no exponent meets the targets")
    for _ in range(PASSES):
        points = [low + (high - low) * i / WAYS for i in range(1, WAYS)]
        ok = met(points)
        high = min([high, *(a for a in points if ok[a])])
        low = max([low, *(a for a in points if not ok[a] and a < high)])
    return round(high + 5e-7, 6) if high not in (1.0, SHARPEST) else high


def _small(df: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """Written, and broadcast only if it has at most BROADCAST_ROWS rows."""
    df = ws.write(df, name)
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", max_repetition: float | None = MAX_REPETITION, target_entropy: float | None = None, budget_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED, prefix: str = "mix_") -> DataFrame:
    """Rows of ``docs``, once per epoch they appear in, with mix_tokens, mix_weight, mix_epoch and mix_order.

    Input columns of such names are replaced; ``prefix`` gives others.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in {f"{prefix}{n}" for n in ("tokens", "weight", "epoch", "order")}]
    ws = Workspace(docs.sparkSession, "mix")
    rows = source_shares(docs, text, source)
    sources = ws.write(rows.groupBy("__mx_src").agg(F.sum("__mx_tokens").alias("__mx_n")), "sources")
    total = sources.agg(F.sum("__mx_n")).first()[0]
    if total is None:
        return rows.select(*kept, F.col("__mx_tokens").alias(f"{prefix}tokens"), F.lit(1.0).alias(f"{prefix}weight"), F.lit(0).cast("long").alias(f"{prefix}epoch"), F.lit(0).cast("long").alias(f"{prefix}order"))
    a = fit_exponent(sources, total, max_repetition, target_entropy, budget_tokens)
    power = F.pow(F.col("__mx_n") / F.lit(float(total)), F.lit(a))
    norm, least = sources.agg(F.sum(power), F.min(power / F.col("__mx_n"))).first()
    budget = float(budget_tokens) if budget_tokens is not None else norm / least
    wanted = F.greatest(F.round(power / norm * budget), F.when(F.lit(budget_tokens is None), F.col("__mx_n")).otherwise(0)).cast("long")
    plan = sources.select("__mx_src", "__mx_n", (power / norm).alias("__mx_weight"), wanted.alias("__mx_b")).select(
        "__mx_src",
        "__mx_weight",
        F.expr("__mx_b div __mx_n").alias("__mx_full"),
        (F.col("__mx_b") % F.col("__mx_n")).alias("__mx_rest"),
        F.ceil(F.col("__mx_n") / F.lit(float(block_tokens))).cast("long").alias("__mx_blocks"),
    )
    rows = rows.join(_small(plan, ws, "plan"), "__mx_src").withColumn("__mx_hash", F.xxhash64(F.lit(seed), F.col(key))).withColumn("__mx_block", F.pmod(F.col("__mx_hash"), F.col("__mx_blocks")))
    first = ["__mx_src", "__mx_block"]
    sized = ws.write(
        rows.groupBy(*first)
        .agg(F.sum("__mx_tokens").alias("__mx_size"), F.first("__mx_full").alias("__mx_f"), F.first("__mx_rest").alias("__mx_r"))
        .withColumn("__mx_place", F.xxhash64(F.lit(seed), F.col("__mx_src"), F.col("__mx_block"), F.col("__mx_f")))
        .withColumn("__mx_lane", F.shiftright("__mx_place", 64 - LANE_BITS)),
        "sized",
    )
    # a running sum per source in two steps, so that no task holds a whole source
    lane = Window.partitionBy("__mx_src").orderBy("__mx_lane").rowsBetween(Window.unboundedPreceding, -1)
    before = sized.groupBy("__mx_src", "__mx_lane").agg(F.sum("__mx_size").alias("__mx_sum")).withColumn("__mx_before", F.coalesce(F.sum("__mx_sum").over(lane), F.lit(0))).drop("__mx_sum")
    taken = Window.partitionBy("__mx_src", "__mx_lane").orderBy("__mx_place", "__mx_block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = (
        sized.join(before, ["__mx_src", "__mx_lane"])
        .withColumn("__mx_to", F.col("__mx_before") + F.sum("__mx_size").over(taken))
        .select(*first, (F.col("__mx_to") <= F.col("__mx_r")).alias("__mx_in"), (F.col("__mx_r") - F.col("__mx_to") + F.col("__mx_size")).alias("__mx_room"))
    )
    rows = rows.join(_small(blocks, ws, "blocks"), first)
    border = ~F.col("__mx_in") & (F.col("__mx_room") > 0)
    inside = Window.partitionBy("__mx_src", "__mx_block").orderBy(F.xxhash64(F.lit(seed), F.col("__mx_hash")), F.col(key), F.xxhash64(text)).rowsBetween(Window.unboundedPreceding, 0)
    copies = F.col("__mx_full") + F.col("__mx_more").cast("long")
    whole = rows.filter(~border).withColumn("__mx_more", F.col("__mx_in"))
    part = rows.filter(border).withColumn("__mx_more", F.sum("__mx_tokens").over(inside) <= F.col("__mx_room"))
    out = whole.unionByName(part).filter(copies > 0).withColumn("__mx_epoch", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    return out.select(
        *kept,
        F.col("__mx_tokens").alias(f"{prefix}tokens"),
        F.col("__mx_weight").alias(f"{prefix}weight"),
        F.col("__mx_epoch").alias(f"{prefix}epoch"),
        F.xxhash64(F.lit(seed), F.col("__mx_src"), F.col("__mx_block"), F.col("__mx_epoch")).alias(f"{prefix}order"),
    )


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text")
