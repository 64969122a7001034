"""Shards meet blocks of queries without passing through the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import graph, grid, topk


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize(("shards", "blocks", "tasks"), [(0, 3, 4), (1, 1, 4), (2, 9, 12), (9, 2, 4), (5, 0, 4)])
def test_each_shard_meets_each_block_once(spark, partitions, shards, blocks, tasks):
    partitions(tasks)
    index = spark.range(shards).withColumnRenamed("id", "shard")
    packed = spark.range(blocks).select(F.col("id").cast("int").alias("block"))
    for number in ("shard", F.xxhash64("shard")):
        met = grid.meet(index, number, index.count(), packed, max(blocks, 1))
        assert sorted((r.shard, r.block) for r in met.collect()) == [(s, b) for s in range(shards) for b in range(blocks)]
        assert "Broadcast" not in plan_of(met)


def vectors_of(spark, rows=400):
    data = np.random.default_rng(3).normal(size=(rows, 6))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")


def test_exact_search_broadcasts_no_copies_of_queries(spark, partitions):
    partitions(64)
    found = topk.integer_vectors(vectors_of(spark))
    hits = topk.top_k(found, found.where("key % 20 = 0"), 3)
    assert "Broadcast" not in plan_of(hits)
    assert hits.count() == 60
    assert "Broadcast" not in plan_of(hits)


def test_graph_search_broadcasts_no_copies_of_queries(spark, partitions):
    partitions(64)
    vectors = graph.usable_vectors(vectors_of(spark))
    hits = graph.search(graph.build_index(vectors), vectors, vectors.where("key % 20 = 0"), 3)
    assert "Broadcast" not in plan_of(hits)
    assert hits.count() == 60
    assert "Broadcast" not in plan_of(hits)
