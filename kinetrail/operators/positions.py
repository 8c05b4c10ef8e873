"""Global positions, neighbours and running sums over one order of all rows.

Rows are range-partitioned by the order and sorted inside the partitions; what crosses a
border is one row or one number a partition: their counts and sums are added up on the driver,
their first and last rows are handed on. So no window runs without a key, and a group of any
size lies in as many partitions as it needs. The ordered table is a checkpoint (in
``spark.checkpoint.dir``; the warehouse if that is unset), for two readings of a range
partitioning may draw different borders.

Ties of the order are in no defined sequence and in one partition: end the order with a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 33  # of a row's number inside its partition, in Spark's ids


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
        spark.sparkContext.setCheckpointDir(f"{base.rstrip('/')}/checkpoints")
    return df.checkpoint()


class Ordered:
    """The rows of ``df`` in an order of all of them (columns, or columns with ``desc()``)."""

    def __init__(self, df: DataFrame, *order):
        self.columns = df.columns
        got = df.repartitionByRange(*order).sortWithinPartitions(*order)
        number = F.monotonically_increasing_id()
        self.rows = checkpointed(got.select("*", F.shiftright(number, BITS).cast("int").alias("__part"), number.bitwiseAND((1 << BITS) - 1).alias("__row")))
        sizes = {r["__part"]: r["n"] for r in self.rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
        self.parts = sorted(sizes)
        self.sizes = [sizes[p] for p in self.parts]
        self.count = sum(self.sizes)

    def _borders(self, **columns: list) -> DataFrame:
        rows = list(zip(self.parts, *columns.values()))
        return F.broadcast(self.rows.sparkSession.createDataFrame(rows, ", ".join(["__part int", *[f"{c} long" for c in columns]])))  # one row a partition

    def positions(self, name: str = "position", start: int = 0) -> DataFrame:
        """All columns and the row's place in the order, from ``start``."""
        return self.rows.join(self._borders(__from=_sums(self.sizes, start)), "__part").withColumn(name, F.col("__from") + F.col("__row")).select(*self.columns, name)

    def running_sum(self, value: str, name: str) -> DataFrame:
        """All columns and the sum of ``value`` up to and with the row; nulls count as 0."""
        x = F.coalesce(F.col(value), F.lit(0)).cast("long")
        sums = {r["__part"]: r["s"] for r in self.rows.groupBy("__part").agg(F.sum(x).alias("s")).collect()}
        upto = F.sum(x).over(Window.partitionBy("__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, 0))
        return self.rows.join(self._borders(__from=_sums([sums[p] for p in self.parts])), "__part").withColumn(name, F.col("__from") + upto).select(*self.columns, name)

    def neighbours(self, columns: list[str], previous: str | None = "previous", following: str | None = "following", position: str | None = None) -> DataFrame:
        """All columns, structs of ``columns`` of the row before and after (null at the ends), and the position."""
        own, inside = F.struct(*columns), Window.partitionBy("__part").orderBy("__row")
        near = self._borders(__before=[None, *self.parts[:-1]], __after=[*self.parts[1:], None], __last=[n - 1 for n in self.sizes], __from=_sums(self.sizes))
        got, kept = self.rows.join(near, "__part"), list(self.columns)
        for name, other, edge, there, step in ((previous, "__before", F.lit(0), F.col("__row") == F.col("__last"), F.lag), (following, "__after", F.col("__last"), F.col("__row") == 0, F.lead)):
            if name is not None:
                ends = self.rows.join(near, "__part").filter(there).select(F.col("__part").cast("long").alias(other), own.alias("__end"))
                got = got.withColumn("__near", step(own).over(inside)).join(F.broadcast(ends), other, "left")  # one row a partition
                got = got.withColumn(name, F.when(F.col("__row") == edge, F.col("__end")).otherwise(F.col("__near"))).drop("__near", "__end")
                kept.append(name)
        if position is not None:
            got, kept = got.withColumn(position, F.col("__from") + F.col("__row")), [*kept, position]
        return got.select(*kept)


def _sums(numbers: list[int], start: int = 0) -> list[int]:
    """Sum of all numbers before each one."""
    out = []
    for n in numbers:
        out.append(start)
        start += n
    return out


def numbered(df: DataFrame, *order, name: str = "position", start: int = 0) -> DataFrame:
    return Ordered(df, *order).positions(name, start)


def numbered_within(df: DataFrame, group: str, *order, name: str = "position", start: int = 0) -> DataFrame:
    """Places inside each group; a null group is a group."""
    placed = numbered(df, group, *order, name="__p")
    first = placed.groupBy(F.col(group).alias("__g")).agg(F.min("__p").alias("__first"))
    return placed.join(first, F.col(group).eqNullSafe(F.col("__g"))).withColumn(name, F.col("__p") - F.col("__first") + start).select(*df.columns, name)


def affine_scan(rows: DataFrame, position: str, count: int, a: Column, b: Column, name: str, block: int = 64) -> DataFrame:
    """y of every row, where y_p = b_p + a_p * y_(p+1) and a factor of 0 ignores what follows.

    Positions are 0 .. ``count`` - 1. Rows of a block of positions are composed from its end on to maps
    (A, B) with y = A * (y behind the block) + B; the blocks' own maps make a table shorter by ``block``
    times, which is scanned the same way; then they are applied. A null ``b`` makes y null as far
    back as factors reach; a null factor counts as 0.
    """
    kept, factor = rows.columns, F.coalesce(a.cast("double"), F.lit(0.0))
    own = F.struct(F.col(position).alias("p"), factor.alias("a"), b.cast("double").alias("b"), F.struct(*kept).alias("r"))
    blocks = rows.groupBy(F.floor(F.col(position) / block).alias("k")).agg(F.sort_array(F.collect_list(own), asc=False).alias("rows"))  # at most ``block`` rows

    def compose(acc, x):
        still = x["a"] == 0
        first = F.when(still, F.lit(0.0)).otherwise(x["a"] * acc["a"])
        second = F.when(still, x["b"]).otherwise(x["b"] + x["a"] * acc["b"])
        return F.struct(first.alias("a"), second.alias("b"), F.concat(acc["out"], F.array(F.struct(first.alias("a"), second.alias("b"), x["r"].alias("r")))).alias("out"))

    kind = rows.select(F.array(F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.struct(*kept).alias("r")))).schema[0].dataType.simpleString()
    empty = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).cast("double").alias("b"), F.expr(f"cast(array() as {kind})").alias("out"))
    maps = blocks.select("k", F.aggregate("rows", empty, compose).alias("m")).select("k", "m.a", "m.b", "m.out")
    if count > block:
        maps = checkpointed(maps)
        after = affine_scan(maps.select("k", "a", "b"), "k", -(-count // block), F.col("a"), F.col("b"), "y", block).select((F.col("k") - 1).alias("k"), "y", F.lit(True).alias("known"))
        maps = maps.select("k", "out").join(after, "k", "left")
    else:
        maps = maps.select("k", "out", F.lit(0.0).alias("y"), F.lit(True).alias("known"))
    behind = F.when(F.col("known"), F.col("y")).otherwise(F.lit(0.0))
    got = maps.select(behind.alias("y"), F.explode("out").alias("x"))
    value = F.when(F.col("x.a") == 0, F.col("x.b")).otherwise(F.col("x.b") + F.col("x.a") * F.col("y"))
    return got.select("x.r.*", value.alias(name))
