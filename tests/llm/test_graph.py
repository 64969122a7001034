"""Nearest neighbours on pruned graphs against brute force."""

import numpy as np
import pytest
from cases import key
from pyspark.sql import functions as F

from tidemark.llm import graph, queries
from tidemark.session import table


def usable(rows):
    return [(key(i), np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]


def brute(rows, asked, k):
    dims = max(len(v) for _, v in rows)
    matrix = np.array([np.pad(v, (0, dims - len(v))) for _, v in rows])
    out = {}
    for q, v in asked:
        scores = np.zeros(len(rows))
        for d in range(len(v)):
            scores += matrix[:, d] * v[d]
        ranked = sorted((-s, i) for s, (i, _) in zip(scores.tolist(), rows, strict=True) if i != q)
        out[q] = [(i, -s) for s, i in ranked[:k]]
    return out


def answers(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((key(r.row_id), r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, wanted):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in best}) / len(best) for q, best in wanted.items() if best])


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").withColumn("a.b", F.lit(1)).repartition(3)


@pytest.mark.parametrize("kind", ["clusters", "lengths"])
def test_recall_and_exact_scores(spark, monkeypatch, kind):
    for name, value in (("SHARD_NODES", 900), ("BLOCK_QUERIES", 30), ("WALKED", 17), ("BATCH", 64)):
        monkeypatch.setattr(graph, name, value)
    rng = np.random.default_rng(1)
    data = rng.normal(size=(2500, 24)) + 2 * rng.normal(size=(12, 24))[rng.integers(0, 12, 2500)]
    if kind == "lengths":
        data *= rng.lognormal(sigma=0.6, size=(2500, 1))
    data[300:400] = data[300]  # copies
    rows = [(int(i), v.tolist()) for i, v in enumerate(data)]
    rows += [(5000, None), (5001, []), (5002, [0.0] * 24), (5003, [1.0, None]), (5004, [float("nan")] * 24), (5005, [float("inf")] * 24), (5006, [3.0, -1.0]), (None, data[7].tolist())]
    vectors = graph.usable_vectors(frame(spark, rows))
    got = answers(graph.search(graph.build_index(vectors), vectors, vectors.where("key % 20 = 0"), 20))
    kept = usable(rows)
    wanted = brute(kept, [(i, v) for i, v in kept if i % 20 == 0 and i >= 0], 20)
    assert set(got) == set(wanted)
    assert recall(got, wanted) > 0.95
    # What is found has its exact score, in order, ties by id; copies come with the smallest ids first.
    for q, best in got.items():
        exact = dict(brute(kept, [(q, dict(kept)[q])], len(kept))[q])
        assert len(best) == 20 and best == sorted(best, key=lambda x: (-x[1], x[0]))
        assert all(exact[i] == s for i, s in best)
    assert [i for i, _ in got[300]] == [i for i, _ in wanted[300]]


def test_repeated_rows_few_rows_and_no_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [-1.0, 2.0]), (2, [0.5, 0.0]), (None, [0.1, 0.0]), (20, [0.0, -0.0]), (40, [-0.0, 1.0]), (40, [0.0, 1.0])]
    vectors = graph.usable_vectors(frame(spark, rows))
    index = graph.build_index(vectors)
    got = answers(graph.search(index, vectors, vectors.where("key % 20 = 0"), 20))
    assert got[0] == [(1, 1.0), (1, 1.0), (2, 0.5), (key(None), 0.1), (40, 0.0), (40, 0.0), (2, -1.0)]
    assert [i for i, _ in got[40]] == [2, 1, 1, key(None), 0, 2]
    none = vectors.where("false")
    assert graph.search(index, vectors, none).count() == 0
    assert graph.search(graph.build_index(none), none, none).count() == 0
    assert graph.search(graph.build_index(none), none, vectors).count() == 0


def test_edges_are_within_bounds_and_the_same_again():
    data = np.random.default_rng(2).normal(size=(600, 8))
    one, two = graph.Graph.built(data), graph.Graph.built(data)
    assert (one.edges == two.edges).all()
    used = one.edges[:-1] < 600
    assert used.sum(axis=1).max() <= graph.MOST_EDGES and used.any(axis=1).all()
    assert not (one.edges[:-1] == np.arange(600)[:, None]).any()
    reached, todo = {one.start}, [one.start]
    while todo:
        new = {int(v) for v in one.edges[todo.pop()] if v < 600} - reached
        reached |= new
        todo += new
    assert len(reached) > 590


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_query_against_brute_force(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in table(spark, folder, "embeddings").collect()]
    got = answers(queries.QUERIES["op11_nearest_neighbours"](spark, folder).withColumnRenamed("vec_id", "row_id"))
    kept = usable(rows)
    wanted = brute(kept, [(i, v) for i, v in kept if i % 20 == 0], 20)
    assert set(got) == set(wanted) and all(len(best) == 20 for best in got.values())
    assert recall(got, wanted) > 0.97
    for q, best in got.items():
        assert best[0] == wanted[q][0]
