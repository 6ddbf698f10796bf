"""Ranks, running totals and moving means over any order, of groups of any size: no task holds a whole group.

Rows are range-partitioned by group and order and written once. How many rows of a group the blocks before hold is a small
table, so a row's rank is a sum of two numbers. Ranks cut groups into chunks of equal size, which windows run over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import written_once

#: Rows of a group that one task orders.
CHUNK = 100_000


def _before(of: str, order: str) -> Column:
    """The sum of what a group's rows before have; there are few rows a group."""
    return F.coalesce(F.sum(of).over(Window.partitionBy("_g").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def numbered(df: DataFrame, order: list[Column | str], *by: str) -> DataFrame:
    """df with _g (its group, a struct) and _r: the place of a row in its group, from 0, by `order`; ties have different
    places. Nulls in `by` are a group, an empty table has no rows."""
    rows = df.withColumn("_g", F.struct(*[F.col(b) for b in by]) if by else F.struct(F.lit(0).alias("all")))
    rows = rows.repartitionByRange("_g", *order).sortWithinPartitions("_g", *order)
    rows = written_once(rows.select("*", F.spark_partition_id().alias("_block"), F.monotonically_increasing_id().alias("_place")), "ranks")
    heads = rows.groupBy("_g", "_block").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    heads = heads.select("_g", "_block", (_before("_n", "_block") - F.col("_first")).alias("_shift"))
    return rows.join(heads, ["_g", "_block"]).withColumn("_r", F.col("_place") + F.col("_shift")).select(*df.columns, "_g", "_r")


def running(df: DataFrame, amount: str, order: list[Column | str], *by: str, chunk: int = CHUNK) -> DataFrame:
    """df with _before: the sum of the amounts of its group's rows before each, null amounts as 0."""
    rows = numbered(df, order, *by).withColumn("_c", F.floor(F.col("_r") / chunk))
    sums = rows.groupBy("_g", "_c").agg(F.coalesce(F.sum(amount), F.lit(0)).alias("_n"))
    sums = sums.select("_g", "_c", _before("_n", "_c").alias("_base"))
    w = Window.partitionBy("_g", "_c").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.coalesce(F.sum(amount).over(w), F.lit(0))).join(sums, ["_g", "_c"])
    return rows.withColumn("_before", F.col("_base") + F.col("_own")).select(*df.columns, "_before")


def moving(df: DataFrame, name: str, what: Column, n: int, order: list[Column | str], *by: str, chunk: int = CHUNK) -> DataFrame:
    """df with `name`: the aggregate `what` over a row and the n - 1 before it in its group. The last n - 1 rows of a
    chunk are read by the next one too."""
    size = max(chunk, n)
    own = F.floor(F.col("_r") / size)
    rows = numbered(df, order, *by).withColumn("_c", F.explode(F.when(F.col("_r") % size > size - n, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy("_g", "_c").orderBy("_r").rowsBetween(1 - n, 0)
    return rows.withColumn(name, what.over(w)).where(own == F.col("_c")).select(*[c for c in df.columns if c != name], name)
