"""Approximate nearest neighbours by inner product, on robust-pruned directed graphs.

Distinct vectors are dealt into shards by their hash; each shard is one task and one graph. Its nodes are inserted in batches:
a greedy beam search on the graph so far proposes neighbours, and pruning keeps the nearest of them and drops each other one
that is nearer to a kept one, by the factor ``SLACK``, than to the node itself, so that edges point in many directions. Edges
are added both ways, and a node with too many is pruned again. A second pass over all nodes mends what the first could not see.

Inner products become distances by one more component that brings all vectors of a shard to the same length. A query is
searched in every shard; the nodes of its last beam are scored again in double precision on the original vectors, and the
best of all shards are merged. A vector that many rows share is one node; the rows are joined to the hits by its hash, the
smallest ids first, so that copies neither crowd a shard nor a beam.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.grid import meet
from tidemark.llm.text import id_of, key_of
from tidemark.session import cut_lineage

#: Nodes of a shard, about; queries packed and walked together.
SHARD_NODES, BLOCK_QUERIES, WALKED = 8192, 2048, 256
#: Edges kept by pruning, edges a node may have before it is pruned again, and how much nearer a kept neighbour must be.
EDGES, MOST_EDGES, SLACK = 32, 48, 1.2
#: Edges that a node gets where it has so many neighbours, diverse or not.
LEAST_EDGES = 16
#: Beam widths of building and searching, nodes expanded per step, and nodes inserted together at most.
BUILD_BEAM, SEARCH_BEAM, EXPANDED, BATCH = 64, 96, 4, 256
SHARD = "shard int, n int, names binary, vectors binary, edges binary, start int"
HITS = "query_key long, query_hash long, h1 long, h2 long, least long, score double"


class Graph:
    """A directed graph over the rows of ``vectors`` (double), and greedy searches on it."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.n = vectors, len(vectors)
        scaled = vectors / max(float(np.abs(vectors).max(initial=0)), 1e-300)
        squares = (scaled**2).sum(axis=1)
        rest = np.sqrt(np.maximum(squares.max(initial=0) - squares, 0))
        # The last row stands for no node.
        self.x = np.zeros((self.n + 1, vectors.shape[1] + 1), np.float32)
        self.x[:-1] = np.concatenate([scaled, rest[:, None]], axis=1)
        self.square = float(squares.max(initial=0))
        self.edges = np.full((self.n + 1, MOST_EDGES), self.n, np.int32)
        self.start = int(np.argmax(self.x[:-1] @ self.x[:-1].mean(axis=0))) if self.n else 0

    @classmethod
    def built(cls, vectors: np.ndarray) -> Graph:
        graph = cls(vectors)
        order = np.random.default_rng(1).permutation(graph.n).astype(np.int32)
        order = np.concatenate([[graph.start], order[order != graph.start]]).astype(np.int32) if graph.n else order
        for again in (False, True):
            at, size = (0, 1) if not again else (0, BATCH)
            while at < graph.n:
                graph._insert(order[at : at + size])
                at += size
                size = min(max(at // 2, 1), BATCH) if not again else BATCH
        return graph

    def walk(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Beam search: ids and similarities of the beams, best first (n: none), and all (query, node) pairs expanded."""
        m, n = len(queries), self.n
        ids, sims = np.full((m, width), n, np.int32), np.full((m, width), -np.inf, np.float32)
        closed = np.ones((m, width), bool)
        ids[:, 0], sims[:, 0], closed[:, 0] = self.start, queries @ self.x[self.start], False
        seen = np.zeros((m, n + 1), bool)
        seen[:, [n, self.start]] = True
        stamp = np.zeros((m, n + 1), np.int32)
        active, who, what = np.arange(m), [], []
        while True:
            open_ = ~closed[active]
            active, open_ = active[open_.any(axis=1)], open_[open_.any(axis=1)]
            if not len(active):
                break
            rows, columns = np.nonzero(open_ & (np.cumsum(open_, axis=1) <= EXPANDED))
            rows = active[rows]
            closed[rows, columns] = True
            chosen = ids[rows, columns]
            who.append(rows)
            what.append(chosen)
            near, of = self.edges[chosen].ravel(), np.repeat(rows, self.edges.shape[1])
            new = ~seen[of, near]
            near, of = near[new], of[new]
            # Of a node met from two sides the last mention stays.
            mark = np.arange(len(near), dtype=np.int32)
            stamp[of, near] = mark
            once = stamp[of, near] == mark
            near, of = near[once], of[once]
            seen[of, near] = True
            found = np.einsum("ij,ij->i", self.x[near], queries[of])
            local = np.searchsorted(active, of)
            counts = np.bincount(local, minlength=len(active))
            place = width + np.arange(len(near)) - np.repeat(np.cumsum(counts) - counts, counts)
            shape = (len(active), width + int(counts.max(initial=0)))
            all_ids, all_sims, all_closed = np.full(shape, n, np.int32), np.full(shape, -np.inf, np.float32), np.ones(shape, bool)
            all_ids[:, :width], all_sims[:, :width], all_closed[:, :width] = ids[active], sims[active], closed[active]
            all_ids[local, place], all_sims[local, place], all_closed[local, place] = near, found, False
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
            ids[active], sims[active], closed[active] = (np.take_along_axis(a, best, axis=1) for a in (all_ids, all_sims, all_closed))
        return ids, sims, np.concatenate(who), np.concatenate(what)

    def _insert(self, nodes: np.ndarray) -> None:
        _, _, who, what = self.walk(self.x[nodes], BUILD_BEAM)
        own = self.edges[nodes]
        lists = _padded(np.concatenate([who, np.repeat(np.arange(len(nodes)), own.shape[1])]), np.concatenate([what, own.ravel()]), len(nodes), self.n)
        kept = self._prune(nodes, lists)
        self.edges[nodes] = self.n
        self.edges[nodes, : kept.shape[1]] = kept
        # The same edges backwards.
        rows, columns = np.nonzero(kept < self.n)
        ends, sources = kept[rows, columns], nodes[rows]
        touched, at = np.unique(ends, return_inverse=True)
        old = self.edges[touched]
        lists = _padded(np.concatenate([np.repeat(np.arange(len(touched)), old.shape[1]), at]), np.concatenate([old.ravel(), sources]), len(touched), self.n)
        many = (lists < self.n).sum(axis=1) > MOST_EDGES
        few = lists[~many, :MOST_EDGES]
        self.edges[touched[~many]] = self.n
        self.edges[touched[~many], : few.shape[1]] = few
        if many.any():
            pruned = self._prune(touched[many], lists[many])
            self.edges[touched[many]] = self.n
            self.edges[touched[many], : pruned.shape[1]] = pruned

    def _prune(self, nodes: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """At most EDGES of each node's listed neighbours (n: none), diverse ones; node lists have no repeats."""
        out = np.full((len(nodes), EDGES), self.n, np.int32)
        for start in range(0, len(nodes), BATCH):
            part, of = lists[start : start + BATCH], nodes[start : start + BATCH]
            vectors = self.x[part]
            far = np.float32(self.square) - np.einsum("ijk,ik->ij", vectors, self.x[of])  # half the squared distance
            far[(part == self.n) | (part == of[:, None])] = np.inf
            order = np.argsort(far, axis=1, kind="stable")
            part, far = np.take_along_axis(part, order, axis=1), np.take_along_axis(far, order, axis=1)
            used = max(int(np.isfinite(far).sum(axis=1).max(initial=0)), 1)
            part, far = part[:, :used], far[:, :used]
            vectors = self.x[part]
            between = np.float32(self.square) - vectors @ vectors.transpose(0, 2, 1)
            free, rows = np.isfinite(far), np.arange(len(of))
            alive = free.copy()
            for slot in range(EDGES):
                first = np.argmax(alive, axis=1)
                there = alive[rows, first]
                if not there.any() and slot >= LEAST_EDGES:
                    break
                # A node with few diverse neighbours gets its nearest other ones too.
                first = np.where(there, first, np.argmax(free, axis=1))
                there |= free[rows, first] & (slot < LEAST_EDGES)
                out[start + rows[there], slot] = part[rows[there], first[there]]
                alive &= SLACK**2 * between[rows, first] > far
                alive[rows, first] = free[rows, first] = False
        return out

    def nearest(self, queries: np.ndarray, k: int, beam: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each query the first row, nodes and exact inner products of the best k nodes found, by blocks of queries."""
        dims = self.vectors.shape[1]
        queries = np.concatenate([queries[:, :dims], np.zeros((len(queries), max(dims - queries.shape[1], 0)))], axis=1)
        scaled = queries / np.maximum(np.abs(queries).max(axis=1, initial=0), 1e-300)[:, None]
        walked = np.concatenate([scaled, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
        for start in range(0, len(queries), WALKED):
            ids = self.walk(walked[start : start + WALKED], max(beam, 2 * k))[0]
            there = ids < self.n
            # One dimension after the other: equal vectors get equal sums in any shape of batch.
            scores, rows = np.zeros(ids.shape), np.minimum(ids, self.n - 1)
            for d in range(dims):
                scores += self.vectors[rows, d] * queries[start : start + WALKED, d][:, None]
            yield start, np.where(there, ids, -1), np.where(there, scores, -np.inf)


def _padded(owners: np.ndarray, values: np.ndarray, n: int, none: int) -> np.ndarray:
    """One row of distinct values per owner, filled up with ``none``."""
    keys = np.unique(owners.astype(np.int64) * (none + 1) + values)
    owners, values = np.divmod(keys, none + 1)
    owners, values = owners[values < none], values[values < none]
    counts = np.bincount(owners, minlength=n)
    out = np.full((n, max(int(counts.max(initial=0)), 1)), none, np.int32)
    out[owners, np.arange(len(owners)) - np.repeat(np.cumsum(counts) - counts, counts)] = values
    return out


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """One row per vector; short vectors are filled with zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), int(sizes.max(initial=0))))
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def usable_vectors(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``key``, ``vector`` (array<double>) and its two hashes ``h1``, ``h2``.

    Rows whose vector is null, empty or zero, or holds a null or non-finite component, are left out; a null id is kept.
    """
    values = F.col(vector_column).cast("array<double>")
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(values, lambda x: x != 0)
    # 0.0 + x, as -0.0 would be another vector.
    vectors = rows.where(values.isNotNull() & fine).select(key_of(id_column).alias("key"), F.transform(values, lambda x: x + F.lit(0.0)).alias("vector"))
    return vectors.select("key", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector", F.lit(2)).alias("h2"))


def build_index(vectors: DataFrame) -> DataFrame:
    """One row per shard (its distinct vectors, their hashes and smallest ids, the graph), a table in the shared folder.

    ``vectors`` comes from ``usable_vectors``. Every vector is a node. The same rows give the same graphs in any order, so a
    lost task can be run again. No rows give no shards.
    """
    nodes = cut_lineage(vectors.groupBy("h1", "h2").agg(F.min("key").alias("least"), F.first("vector").alias("vector")), "nodes")
    shards = max(-(-nodes.count() // SHARD_NODES), 1)

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h1", "ascending"), ("h2", "ascending")]).combine_chunks()
        names = np.stack([table.column(c).to_numpy() for c in ("h1", "h2", "least")], axis=1)
        graph = Graph.built(_matrix(pa.concat_arrays(table.column("vector").chunks)))
        columns = [
            pa.array([int(table.column("shard")[0].as_py())], pa.int32()), pa.array([graph.n], pa.int32()), pa.array([names.tobytes()]),
            pa.array([graph.vectors.tobytes()]), pa.array([graph.edges.tobytes()]), pa.array([graph.start], pa.int32()),
        ]
        return pa.Table.from_arrays(columns, names=["shard", "n", "names", "vectors", "edges", "start"])

    # A graph is minutes of work in few bytes: shards must not share a task because they are small.
    dealt = nodes.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).repartition(4 * shards, "shard")
    return cut_lineage(dealt.groupBy("shard").applyInArrow(build, SHARD), "graphs")


def _pack(table: pa.Table) -> pa.Table:
    names = np.stack([table.column(c).to_numpy() for c in ("key", "h1")], axis=1)
    vectors = _matrix(pa.concat_arrays(table.column("vector").chunks))
    columns = [pa.array([table.column("block")[0].as_py()], pa.int32()), pa.array([len(names)], pa.int32()), pa.array([names.tobytes()]), pa.array([vectors.tobytes()])]
    return pa.Table.from_arrays(columns, names=["block", "asked", "query_names", "query_vectors"])


def search(index: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 20, beam: int = SEARCH_BEAM) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``row_id``, ``score``: the k rows of largest inner product that were found for each query.

    ``vectors`` are the rows of ``index``, ``queries`` any rows of ``usable_vectors``. Rows of a query's own id don't count;
    ties go to the smaller id (null first); rows that repeat an id and a vector are ranked each. A repeated query counts once,
    queries of one id with different vectors each count. Vectors of other lengths are compared as if filled up with zeros.
    """
    asked = cut_lineage(queries.dropDuplicates(["key", "h1", "h2"]), "queries")
    blocks = max(-(-asked.count() // BLOCK_QUERIES), 1)
    packed = (
        asked.withColumn("block", F.pmod("h1", F.lit(blocks)).cast("int")).groupBy("block")
        .applyInArrow(_pack, "block int, asked int, query_names binary, query_vectors binary")
    )
    pairs = meet(index, "shard", index.count(), packed, blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                n, names = row["n"], np.frombuffer(row["names"], np.int64).reshape(-1, 3)
                graph = Graph(np.frombuffer(row["vectors"]).reshape(n, -1))
                graph.edges, graph.start = np.frombuffer(row["edges"], np.int32).reshape(n + 1, -1), row["start"]
                asked_names = np.frombuffer(row["query_names"], np.int64).reshape(-1, 2)
                for start, ids, scores in graph.nearest(np.frombuffer(row["query_vectors"]).reshape(row["asked"], -1), k + 1, beam):
                    least = np.where(ids >= 0, names[np.maximum(ids, 0), 2], 0)
                    order = np.lexsort((least, -scores))[:, : k + 1]
                    rows = np.repeat(np.arange(start, start + len(ids)), order.shape[1])
                    found, best = np.take_along_axis(ids, order, axis=1).ravel(), np.take_along_axis(scores, order, axis=1).ravel()
                    rows, found, best = rows[found >= 0], found[found >= 0], best[found >= 0]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c) for c in (*asked_names[rows].T.copy(), *names[found].T.copy(), best)],
                        names=["query_key", "query_hash", "h1", "h2", "least", "score"],
                    )

    query = ["query_key", "query_hash"]
    hits = pairs.select("n", "names", "vectors", "edges", "start", "asked", "query_names", "query_vectors").mapInArrow(run, HITS)
    by_node = Window.partitionBy(*query).orderBy(F.col("score").desc(), "least", "h1", "h2")
    nodes = hits.withColumn("place", F.row_number().over(by_node)).where(F.col("place") <= k + 1).drop("place")
    # Of the rows that share a vector, k + 1 are as many as any query can use.
    members = vectors.select("h1", "h2", "key").withColumn("place", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("key"))).where(F.col("place") <= k + 1)
    by_row = Window.partitionBy(*query).orderBy(F.col("score").desc(), "key")
    rows = nodes.hint("merge").join(members.select("h1", "h2", "key"), ["h1", "h2"]).where(F.col("key") != F.col("query_key"))
    ranked = rows.withColumn("rank", F.row_number().over(by_row)).where(F.col("rank") <= k)
    return ranked.select(id_of("query_key").alias("query_id"), "rank", id_of("key").alias("row_id"), "score")
