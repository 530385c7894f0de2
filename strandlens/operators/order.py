"""Global numbers and running sums without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def numbered(df: DataFrame, order: list[Column], name: str, value: str | None = None, before: str = "before") -> DataFrame:
    """df plus a number from 0 in the given order and, with ``value``, that column's sum over all earlier
    rows as ``before``.

    Sorted in ranges, numbered and summed inside each, and shifted by what the ranges before hold (a
    row per range).
    """
    ranged = checkpointed(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_id", 33))
    total = F.sum(value) if value else F.lit(0).cast("long")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), (total if value else F.first(total)).alias("_t"))
    up = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_part", F.coalesce(F.sum("_n").over(up), F.lit(0)).alias("_rows"), F.coalesce(F.sum("_t").over(up), F.lit(0)).alias("_sum"))
    out = ranged.join(F.broadcast(shifts), "_part").withColumn(name, F.col("_rows") + F.col("_id").bitwiseAND((1 << 33) - 1))
    if value:
        inside = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn(before, F.col("_sum") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return out.drop("_id", "_part", "_rows", "_sum")


def numbered_lines(lines: DataFrame, name: str) -> DataFrame:
    """lines (file, block, ...) plus a number from 0 by file and place in it, as they were read from text
    files: a split's lines (file, and block, where it begins) lie in one task and in their order, so they
    are numbered where they are and shifted by what the splits before hold (a row per split)."""
    held = checkpointed(lines.withColumn("_id", F.monotonically_increasing_id()))
    splits = held.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    up = Window.partitionBy(F.lit(0)).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = splits.select("file", "block", (F.coalesce(F.sum("_n").over(up), F.lit(0)) - F.col("_first")).alias("_shift"))
    return held.join(F.broadcast(shifts), ["file", "block"]).withColumn(name, F.col("_id") + F.col("_shift")).drop("_id", "_shift", "file", "block")
