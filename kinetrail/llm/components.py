"""Connected components of a link table by alternating large and small stars.

Every step is a grouped minimum joined back to the links (Spark splits skewed join
partitions; no neighbourhood is ever collected), written to the shared folder. The
number of rounds grows with the logarithm of the longest chain. Links go to tasks of
about ``TASK_LINKS``, and each task first reduces its own to a forest; where one task
takes them all, that forest is the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

TASK_LINKS = 200_000


def _forest(batches):
    """Links of one partition reduced to a forest: (node, root) with root < node."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def root(x):
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    def flush():
        rows = [(x, root(x)) for x in parent]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["u", "v"])

    for b in batches:
        for a, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            a, c = root(a), root(c)
            if a != c:
                parent[max(a, c)] = min(a, c)
        if len(parent) > 500_000:
            yield flush()
    if parent:
        yield flush()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, which has none: the links are stars."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty()


def components(links: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """links (u, v); gives (u, component) for every node that is not its own minimum."""
    reduced = lambda df: df.select("u", "v").mapInArrow(_forest, "u long, v long").filter("u > v")
    edges = ws.write(reduced(links), f"{name}-0")
    tasks = -(-edges.count() // TASK_LINKS)
    if tasks <= 1:
        return reduced(edges.coalesce(1)).select("u", F.col("v").alias("component"))
    edges = ws.write(reduced(edges.coalesce(tasks)).distinct(), f"{name}-1")
    ws.drop(f"{name}-0")
    step = 1
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = ws.write(large, f"{name}-{step + 1}")
        own = large.groupBy("u").agg(F.min("v").alias("m"))  # u > v holds for all rows
        small = large.join(own, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(own.select("u", F.col("m").alias("v"))).distinct()
        edges = ws.write(small, f"{name}-{step + 2}")
        ws.drop(f"{name}-{step}", f"{name}-{step + 1}")
        step += 2
    return edges.select("u", F.col("v").alias("component"))
