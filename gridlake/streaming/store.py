"""Streaming twins: geometry changes into a versioned table, cached answers that expire, stale tiles, and late log lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridlake.operators import geostore

GEOMETRY_TTL, ACCESS_TTL = 3600, 60


def upsert_stream(changes: DataFrame, path: str, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Applies batches of changes to the table at path, which keeps one folder for each batch; a batch that runs again writes the same folder.

    Revisions go on from the table's highest; a batch's changes of one key count once, the last winning."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = geostore.last_changes(batch, keys, order)
        before = load(spark, path, number - 1)
        store = newest.withColumn("revision", F.lit(number)) if before is None else geostore.upsert(before, newest.withColumn("revision", F.lit(number)), keys, order)
        store.write.mode("overwrite").parquet(f"{path}/version={number}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load(spark: SparkSession, path: str, version: int) -> DataFrame | None:
    """The table as of a version; None before the first."""
    return None if version < 0 else spark.read.parquet(f"{path}/version={version}")


def answers(events: DataFrame, key: str, code: str, ts: str, ttl: str = "1 hour") -> DataFrame:
    """Answers worth caching (outages are not), one a key within the TTL, as a stream with bounded state."""
    kept = events.where(geostore.cacheable(F.col(code)))
    return kept.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def stale_tiles(changes: DataFrame, manifest: DataFrame) -> DataFrame:
    """Tiles (provider, z, x, y) that depend on a provider with a newer revision than the one they were drawn from."""
    return changes.join(manifest, "provider").where(F.col("revision") > F.col("drawn_revision")).select("provider", "z", "x", "y")


def attributed_log(log: DataFrame, windows: DataFrame, wait: str = "10 seconds") -> DataFrame:
    """Log lines (ts, prefix) counted by window (name, prefix, t0, t1) and minute; lines later than the wait are left out."""
    joined = log.withWatermark("ts", wait).join(windows, "prefix").where("ts >= t0 and ts <= t1")
    return joined.groupBy(F.window("ts", "1 minute"), "name").agg(F.count("*").alias("lines"))


def incremental_zonal(updates: DataFrame, coverage: DataFrame, ts: str, length: str, wait: str) -> DataFrame:
    """Zonal sums of pixel updates (row, col, value, ts) by window of event time, as the stream goes."""
    joined = updates.withWatermark(ts, wait).join(coverage, ["row", "col"])
    total = joined.groupBy(F.window(ts, length), "zone_id").agg(F.sum("w").alias("count"), F.sum(F.col("w") * F.col("value")).alias("sum"))
    return total.select("zone_id", F.col("window.start").alias("start"), "count", "sum")


def run_once(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop."""
    df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def within(ts: Column, start: Column, end: Column) -> Column:
    return (ts >= start) & (ts <= end)
