"""Sharding: rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scratch import Scratch

ROWS_PER_BUCKET = 200_000


def rendezvous_score(key: Column, shard: int, weight: float = 1.0) -> Column:
    """Logarithmic rendezvous score w / -ln(u); u in (0, 1) is a hash of key and shard alone."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
    return F.lit(float(weight)) / -F.log(u)


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard of the highest score; of equal scores the lower shard.

    A null key is a key like any other. Adding a shard, or raising its weight, moves only
    records that this shard now wins, in expectation its share of the total weight.
    """
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive")
    scored = [F.struct(rendezvous_score(key, i, w).alias("s"), F.lit(-i).alias("i")) for i, w in enumerate(weights)]
    return -F.array_max(F.array(*scored))["i"]


def shard_records(df: DataFrame, scratch: Scratch, weights: Sequence[float], key: str = "doc_id", text: str = "text", grown_weight: float | None = 1.0) -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard) for every row of df.

    size: UTF-8 bytes and 8 (a null text has none); slot: gapless from 0 in each shard, by key
    and text checksum inside hashed buckets. Repeated rows are counted first and take adjoining slots, so
    a key that holds a third of all rows is one row until the last step. An empty table gives
    an empty result; other columns are ignored, whatever their names.
    """
    bytes_ = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = df.select(F.col(key).alias("_k"), (F.octet_length(bytes_).cast("long") + 8).alias("size"), F.crc32(bytes_).alias("text_crc32"))
    grouped = rows.groupBy("_k", "size", "text_crc32").agg(F.count("*").alias("_n"))
    grown = rendezvous_shard(F.col("_k"), [*weights, grown_weight]).cast("int") if grown_weight else F.lit(None).cast("int")
    kept = scratch.cut(grouped.withColumn("shard", rendezvous_shard(F.col("_k"), weights).cast("int")).withColumn("grown_shard", grown))
    buckets = max(1, -(-kept.count() // (ROWS_PER_BUCKET * len(weights))))
    kept = kept.withColumn("_b", F.pmod(F.xxhash64("_k", "text_crc32", F.lit("slot")), F.lit(buckets)))
    sums = kept.groupBy("shard", "_b").agg(F.sum("_n").alias("_s"))
    starts = sums.select("shard", "_b", (F.sum("_s").over(W.partitionBy("shard").orderBy("_b")) - F.col("_s")).alias("_start"))
    order = W.partitionBy("shard", "_b").orderBy("_k", "text_crc32", "size")
    first = F.sum("_n").over(order) - F.col("_n")
    placed = kept.withColumn("_first", first).join(starts, ["shard", "_b"]).withColumn("_first", F.col("_first") + F.col("_start"))
    slots = F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1))
    return placed.select(F.col("_k").alias(key), "size", "text_crc32", "shard", slots.alias("slot"), "grown_shard")
