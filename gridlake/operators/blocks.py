"""Blocks of a raster level: numbering, pruning by window, and coalescing of byte ranges (gaps and islands)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COALESCE_GAP = 32 * 1024
ROWS_PER_TASK = 1 << 18  # of ranges that one task sorts and joins, about; at some 300 bytes a row in its sorts and aggregates


def block_of(row: Column, col: Column, block: int, across: int) -> dict[str, Column]:
    by, bx = F.floor(row / block).cast("int"), F.floor(col / block).cast("int")
    return {"block_idx": (by * across + bx).cast("int"), "bx": bx, "by": by}


def prune(blocks: DataFrame, c0: int, c1: int, r0: int, r1: int, width: int, height: int) -> DataFrame:
    """Blocks that a window [c0, c1) x [r0, r1) overlaps; plain comparisons, so they reach the scan."""
    return blocks.where((F.col("bx") >= c0 // width) & (F.col("bx") <= (c1 - 1) // width) & (F.col("by") >= r0 // height) & (F.col("by") <= (r1 - 1) // height))


def coalesce_ranges(ranges: DataFrame, keys: list[str], gap: int = COALESCE_GAP) -> DataFrame:
    """keys, first, end and pieces of byte ranges (byte_offset, byte_count) joined where they lie at most `gap` apart.

    The number of tasks follows the number of ranges, counted first, so that a task's memory doesn't grow with the table, but with the largest key only."""
    ranges = ranges.repartition(ranges.count() // ROWS_PER_TASK + 1, *keys)
    order = Window.partitionBy(*keys).orderBy("byte_offset", "byte_count")
    reach = F.max(F.col("byte_offset") + F.col("byte_count")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = ranges.withColumn("_start", F.when(reach.isNull() | (F.col("byte_offset") > reach + gap), 1).otherwise(0))
    islands = starts.withColumn("_island", F.sum("_start").over(order))
    return islands.groupBy(*keys, "_island").agg(F.min("byte_offset").alias("first"), F.max(F.col("byte_offset") + F.col("byte_count")).alias("end"), F.count("*").alias("pieces")).drop("_island")


def undo_predictor2(deltas: DataFrame, keys: list[str], order: str, bits: int = 16) -> DataFrame:
    """value: the running sum of delta modulo 2^bits."""
    running = F.sum("delta").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return deltas.withColumn("value", F.pmod(running, F.lit(1 << bits)))


def predictor2(values: DataFrame, keys: list[str], order: str, bits: int = 16) -> DataFrame:
    """delta: each value less the one before it, modulo 2^bits."""
    before = F.coalesce(F.lag("value").over(Window.partitionBy(*keys).orderBy(order)), F.lit(0))
    return values.withColumn("delta", F.pmod(F.col("value") - before, F.lit(1 << bits)))
