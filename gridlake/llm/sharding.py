"""Sharding by rendezvous hashing: every shard bids for a record's stable key, and the highest bid takes it.

A bid is weight / -ln(u) with u in (0, 1) from MD5 of "key:shard", so shards fill in proportion to their weights, and a new
shard only takes the records for which it bids highest. Only DataFrame functions are used. Slots number a shard's
records from 0 in key order: rows are dealt by ranges of the key, counted by (range, shard), and the counts of earlier
ranges are added, so no shard is sorted in one task.

Defined results: a null key counts as the key "null"; null text has size 1 and the CRC-32 of nothing; repeated rows fall
into one shard and get slots of their own; an empty table gives no rows. Extra columns are kept by assign() unless they are named as what it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.llm.common import stored

SHARDS = 8


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard that bids highest for the key; ties go to the higher shard."""
    name = F.coalesce(key.cast("string"), F.lit("null"))

    def bid(shard: int, weight: float) -> Column:
        draw = F.conv(F.substring(F.md5(F.concat(name, F.lit(f":{shard}"))), 1, 12), 16, 10).cast("double")
        return F.struct((F.lit(float(weight)) / -F.ln((draw + 0.5) / F.lit(float(2**48)))).alias("bid"), F.lit(shard).alias("shard"))

    return F.array_max(F.array(*(bid(s, w) for s, w in enumerate(weights))))["shard"]


def assign(records: DataFrame, key: str, weights: list[float]) -> DataFrame:
    """records with shard, and grown_shard as it is with one more shard of the mean weight."""
    grown = [*weights, sum(weights) / len(weights)]
    return records.withColumn("shard", shard_of(F.col(key), weights)).withColumn("grown_shard", shard_of(F.col(key), grown))


def slots(assigned: DataFrame, order: list[str]) -> DataFrame:
    """assigned with slot: the record's place in its shard, in the order given."""
    dealt = stored(assigned.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "sharding-dealt")
    counts = dealt.groupBy("_range", "shard").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_range", "shard", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range", "shard").orderBy(*order))
    ranked = dealt.withColumn("_place", place).join(before, ["_range", "shard"])
    return ranked.withColumn("slot", F.col("_before") + F.col("_place") - 1).drop("_range", "_before", "_place")


def digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    records = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    found = slots(assign(records, "doc_id", [1.0] * shards), ["doc_id", "text_crc32", "size"])
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
