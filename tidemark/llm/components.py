"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def _least(edges: DataFrame) -> DataFrame:
    """(u, least): the smallest of each u and its neighbours, stored, so that the join with it can split a hot u."""
    return cut_lineage(edges.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least")), "least")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) for every node of ``edges`` (``u``, ``v``, any ordered type).

    Loops and repeated edges do no harm; a null on either side drops the edge. Each round is a grouped minimum and a join,
    written to the shared folder; the number of rounds grows with the logarithm of the longest path.
    """
    edges = cut_lineage(edges.select("u", "v").where(F.col("u") != F.col("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_least(both), "u").where((F.col("v") > F.col("u")) & (F.col("v") != F.col("least")))
            .select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        )
        large = cut_lineage(large, "edges")
        small = large.join(_least(large), "u")
        edges = cut_lineage(
            small.select("u", F.col("least").alias("v"))
            .unionByName(small.where(F.col("v") != F.col("least")).select(F.col("v").alias("u"), F.col("least").alias("v")))
            .distinct(),
            "edges",
        )
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
