"""Sharding by weighted rendezvous hashing, in DataFrame functions only.

Every shard draws a number for every key, -ln(u) / weight with u from a hash of key and shard, and the least draw wins.
A shard's draws don't depend on the other shards, so a new shard takes keys only into itself and a lost shard's keys
spread over the rest. Rows of one key go to one shard. Places within a shard come from two-pass prefix sums: rows are
written with their running number among the shard's rows of their task, the counts of (shard, task) are summed up, and
their sums before each task are joined back; no shard is gathered anywhere.

Null keys are one key. Null texts have size 8 and the checksum of no bytes, very long ones are read whole. Repeated rows have
places of their own. Of equal draws, the lower shard's wins. An empty table gives no rows. Columns but key and text are left
alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewise.llm.common import staged

SHARDS = 24
SALT = 0x5EED


def draw(key: Column, shard: int, weight: float) -> Column:
    """The shard's draw for a key: exponential with rate `weight`."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(SALT + shard), key), 11)
    return -F.log((bits + F.lit(0.5)) * F.lit(2.0**-53)) / F.lit(float(weight))


def choose(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the least draw; shards of weight 0 take nothing."""
    draws = [F.struct(draw(key, n, w).alias("draw"), F.lit(n).alias("shard")) for n, w in enumerate(weights) if w > 0]
    return F.array_min(F.array(*draws))["shard"]


def sharded(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * SHARDS, new_weight: float = 1.0) -> DataFrame:
    """key, size, text_crc32, law, shard, slot (0, 1, ... in each shard), grown_shard (with one more shard)."""
    key_text, body = F.col(key).cast("string"), F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key).alias("key"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        choose(key_text, weights).cast("int").alias("shard"),
        F.spark_partition_id().alias("task"),
        F.monotonically_increasing_id().alias("number"),
    )
    new = F.struct(draw(F.col("key").cast("string"), len(weights), new_weight).alias("draw"), F.lit(len(weights)).alias("shard"))
    old = F.array(*[F.struct(draw(F.col("key").cast("string"), n, w).alias("draw"), F.lit(n).alias("shard")) for n, w in enumerate(weights) if w > 0])
    rows = staged(rows.withColumn("grown_shard", F.array_min(F.concat(old, F.array(new)))["shard"].cast("int")), "shards")
    within = Window.partitionBy("shard", "task").orderBy("number")
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("shard", "task").agg(F.count("*").alias("n")).select("shard", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = rows.withColumn("within", F.row_number().over(within) - 1).join(base, ["shard", "task"])
    return placed.select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("within")).cast("long").alias("slot"), "grown_shard"
    )
