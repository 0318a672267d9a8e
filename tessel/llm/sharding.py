"""Sharding by longest processing time: groups that must stay together go, largest first, to the least-loaded shard.

The heap runs on the driver over a bounded number of units.  Every group of at least 1/(shards * UNITS) of all bytes is
a unit of its own, so there are at most shards * UNITS of them; smaller groups are pooled by hash into UNITS pools,
each one unit.  A small table is scheduled group by group, and on a large one a pool is a vanishing part of a shard.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.common import content_key, field, keep, pack, partitions

#: Bounds what the driver schedules: at most shards * UNITS large groups and UNITS pools.
UNITS = 8192


def longest_first(weights: list[tuple[int, object]], shards: int) -> dict[object, int]:
    """Shard of each (weight, name): largest weight first, each to the shard with the least so far."""
    heap = [(0, s) for s in range(shards)]
    shard_of = {}
    for weight, name in sorted(weights, key=lambda x: (-x[0], x[1])):
        load, s = heapq.heappop(heap)
        shard_of[name] = s
        heapq.heappush(heap, (load + weight, s))
    return shard_of


def shard_documents(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", units: int = UNITS
) -> DataFrame:
    """(row, size, text_crc32, shard, slot): equal texts share a shard, and shards have nearly equal bytes.

    A document's size is the bytes of its text plus 1; null and empty texts are one group of size 1 a row.  Slots number
    the rows of a shard from 0 without gaps, by hash bucket and then id; equal rows may trade slots.  Rows that share an
    id are separate rows.  One group larger than a shard's part can't be split and makes its shard the largest.  An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    k1, k2 = content_key("text")
    rows = keep(
        pack(docs, id_col, text_col).select(
            F.struct(field("row", id_col).alias(id_col)).alias("row"),
            "id",
            (F.octet_length("text") + 1).cast("long").alias("size"),
            F.crc32("text").alias("text_crc32"),
            k1,
            k2,
            F.pmod(k2, F.lit(units)).cast("int").alias("pool"),
        )
    )
    groups = rows.groupBy("k1", "k2", "pool").agg(F.sum("size").alias("weight"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = keep(groups)
    least = max(1, total // (shards * units))
    large = groups.where(F.col("weight") >= least)  # at most total / least rows
    pools = groups.where(F.col("weight") < least).groupBy("pool").agg(F.sum("weight").alias("weight"))
    weights = [(r.weight, (0, r.k1, r.k2)) for r in large.collect()] + [(r.weight, (1, r.pool, 0)) for r in pools.collect()]
    shard_of = longest_first(weights, shards)
    own = spark.createDataFrame([(a, b, s) for (kind, a, b), s in shard_of.items() if kind == 0], "k1 long, k2 long, own_shard int")
    pooled = spark.createDataFrame([(a, s) for (kind, a, _), s in shard_of.items() if kind == 1], "pool int, pool_shard int")
    # both are bounded by the units above, whatever the size of the table
    placed = rows.join(F.broadcast(own), ["k1", "k2"], "left").join(F.broadcast(pooled), "pool", "left")
    placed = placed.withColumn("shard", F.coalesce("own_shard", "pool_shard"))

    buckets = 4 * partitions(spark)
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("id", "k1"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
        .select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    )  # shards * buckets rows
    within = Window.partitionBy("shard", "bucket").orderBy("id", "k1", "k2")
    return (
        placed.withColumn("nth", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), ["shard", "bucket"])
        .select("row", "size", "text_crc32", "shard", (F.col("start") + F.col("nth")).cast("long").alias("slot"))
    )
