"""Every shard of an index next to every block of queries, as a join whose copies and partitions are bounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Partitions per cell of the grid, so that few cells share one by their hash.
SPREAD = 2


def meet(shards: DataFrame, number: Column | str, count: int, packed: DataFrame, blocks: int) -> DataFrame:
    """``packed`` (a row per ``block``) joined to ``shards``, whose ``number`` deals the ``count`` of them into lanes.

    The cells of a grid are the units of work: a shard belongs to one lane and a block to one part. There are as many lanes as
    shards, up to the shuffle partitions; only where these are fewer cells than partitions are the blocks parted too. So a
    block is copied once per lane and a shard once per part. Both sides are shuffled and merged: Spark sizes rows that were packed
    and exploded far too low, and would send all copies through the driver. In a task the shards of a lane wait for the blocks,
    which come one by one.
    """
    tasks = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lanes = max(min(count, tasks), 1)
    parts = max(min(blocks, -(-tasks // lanes)), 1)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = packed.withColumn("part", F.pmod("block", F.lit(parts)).cast("int")).withColumn("lane", each(lanes))
    asking = shards.withColumn("lane", F.pmod(number, F.lit(lanes)).cast("int")).withColumn("part", each(parts))
    cell, dealt = ["lane", "part"], SPREAD * lanes * parts
    # A number of partitions that is named is kept: a cell is much work in few bytes, so small ones must not be put together.
    return asked.repartition(dealt, *cell).hint("merge").join(asking.repartition(dealt, *cell), cell).drop(*cell)
