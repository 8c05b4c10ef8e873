"""Exact deduplication with a heavy-hitter split.

1. Each row is reduced to (id, digest); digests are SHA-256 of the text.
2. Every partition keeps a Misra-Gries sketch of ``capacity`` counters. Summed
   over partitions a counter undershoots by at most rows / (capacity + 1), so at
   most ``capacity`` digests reach rows / capacity: a proven bound. The capacity follows the
   rows: it is what keeps a light digest under about ``LIGHT_ROWS`` rows, 1,024 at least and
   65,536 at most.
3. Those candidates are counted exactly; the verified winners (digest, row that
   stays, size) are broadcast and their rows are settled on the map side.
4. The other digests, none of which is frequent, use an ordinary shuffle.

Defined results. Null texts count as empty. Of equal texts the largest id stays;
null ids rank below all others. Of rows repeated with the same id and text one stays. An empty table gives an empty table. Columns of the
input may have any name: the working columns carry the prefix ``__xd_``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, table

CAPACITY, MOST_CAPACITY, LIGHT_ROWS, BROADCAST_GROUPS = 1024, 65_536, 1_000_000, 500_000


def misra_gries(counts: dict, batch: dict, capacity: int) -> dict:
    """Merge two counter maps and reduce them to at most ``capacity`` counters."""
    for k, v in batch.items():
        counts[k] = counts.get(k, 0) + v
    if len(counts) > capacity:
        cut = sorted(counts.values(), reverse=True)[capacity]
        counts = {k: v - cut for k, v in counts.items() if v > cut}
    return counts


def _sketch(capacity: int):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        counts: dict = {}
        seen = 0
        for b in batches:
            seen += b.num_rows
            found = pc.value_counts(b.column(0))
            counts = misra_gries(counts, dict(zip(found.field(0).to_pylist(), found.field(1).to_pylist())), capacity)
        if seen:
            keys = [None, *counts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array([0, *counts.values()], pa.int64()), pa.array([seen] + [0] * len(counts), pa.int64())],
                names=["__xd_digest", "estimate", "seen"],
            )

    return run


def _winners(ids: DataFrame, ws: Workspace, capacity: int | None) -> DataFrame:
    """Digests that are truly frequent, with the row that stays and the size."""
    if capacity is None:
        capacity = max(CAPACITY, min(MOST_CAPACITY, 2 * ids.count() // LIGHT_ROWS))
    sketch = ws.write(ids.select("__xd_digest").mapInArrow(_sketch(capacity), "__xd_digest binary, estimate long, seen long"), "sketch")
    rows = sketch.agg(F.sum("seen")).first()[0] or 0
    frequent = max(2, -(-rows // capacity))
    candidates = sketch.filter("__xd_digest is not null").groupBy("__xd_digest").agg(F.sum("estimate").alias("e")).filter(F.col("e") >= frequent).select("__xd_digest")
    return ws.write(
        ids.join(F.broadcast(candidates), "__xd_digest")
        .groupBy("__xd_digest")
        .agg(F.max(F.struct("__xd_id", "__xd_row")).alias("__xd_stays"), F.count(F.lit(1)).alias("__xd_size")),
        "winners",
    )


def _digest(text: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int | None = None) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256."""
    ws = Workspace(docs.sparkSession, "exact")
    ids = ws.write(docs.select(F.col(key).alias("__xd_id"), _digest(text).alias("__xd_digest")).withColumn("__xd_row", F.monotonically_increasing_id()), "ids")
    winners = _winners(ids, ws, capacity)
    heavy = ids.join(F.broadcast(winners), "__xd_digest")
    same = Window.partitionBy("__xd_digest")
    light = (
        ids.join(F.broadcast(winners.select("__xd_digest")), "__xd_digest", "left_anti")
        .withColumn("__xd_stays", F.max(F.struct("__xd_id", "__xd_row")).over(same))
        .withColumn("__xd_size", F.count(F.lit(1)).over(same))
    )
    return ws.result(heavy.unionByName(light).select(
        F.col("__xd_id").alias(key),
        F.col("__xd_stays.__xd_id").alias("keep_id"),
        F.col("__xd_size").alias("group_size"),
        (F.col("__xd_stays.__xd_row") == F.col("__xd_row")).alias("kept"),
        F.lower(F.hex("__xd_digest")).alias("text_sha256"),
    ))


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, one per distinct text, all columns kept.

    Winners are settled on (digest, id) alone; only groups of two rows and more come back
    to the texts, which are not shuffled while those groups are few enough to broadcast.
    Of rows repeated with one id and text the one with the smallest other columns stays.
    """
    ws = Workspace(docs.sparkSession, "exact")
    ids = ws.write(docs.select(F.col(key).alias("__xd_id"), _digest(text).alias("__xd_digest")).withColumn("__xd_row", F.monotonically_increasing_id()), "ids")
    winners = _winners(ids, ws, capacity)
    each = lambda df: df.groupBy("__xd_digest", "__xd_id").agg(F.count(F.lit(1)).alias("__xd_n")).groupBy("__xd_digest").agg(F.max(F.struct("__xd_id", "__xd_n")).alias("__xd_stays"), F.sum("__xd_n").alias("__xd_size"))
    heavy = each(ids.join(F.broadcast(winners.select("__xd_digest")), "__xd_digest", "left_semi"))
    light = each(ids.join(F.broadcast(winners.select("__xd_digest")), "__xd_digest", "left_anti"))
    groups = ws.write(heavy.unionByName(light).filter("__xd_size > 1").select("__xd_digest", "__xd_stays"), "groups")
    ws.drop("ids", "sketch", "winners")
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS  # else an ordinary join
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.withColumn("__xd_digest", _digest(text)).join(F.broadcast(groups) if few else groups, "__xd_digest", "left")
    stays = rows.filter(F.col("__xd_stays").isNull() | F.col(f"`{key}`").eqNullSafe(F.col("__xd_stays.__xd_id")))
    if groups.filter("__xd_stays.__xd_n > 1").isEmpty():
        return stays.select(*own)
    again = F.coalesce(F.col("__xd_stays.__xd_n"), F.lit(1)) > 1
    repeated = stays.filter(again).groupBy("__xd_digest").agg(F.min(F.struct(*own)).alias("__xd_all")).select("__xd_all.*")  # combined on the map side
    return stays.filter(~again).select(*own).unionByName(repeated)


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
