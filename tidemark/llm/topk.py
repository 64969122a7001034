"""Exact top-k by inner product over integer vectors, by MaxScore on posting lists.

A term is a dimension with a sign; its postings are the rows whose component has that sign, so that for a query exactly
one of a dimension's two lists can raise a score. Rows are packed into shards where they are read, a table in the shared
folder, and shards meet blocks of queries in a grid. Per shard and group of queries, dimensions are ordered by the most they
can add (query weight times the shard's largest component, summed over the group). The lists at the end of this order that
together cannot lift a row above a query's k-th best score are non-essential for it: only rows in an essential list of some
query are looked at. These are probed in that order, for all queries at once, until few pairs of a query and a row can
still beat the query's k-th best with what is left; those are followed one by one. The best k of every shard are merged per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.grid import meet
from tidemark.llm.text import NO_ID, key_of
from tidemark.session import cut_lineage

#: Rows of a shard and queries of a block at most.
SHARD_ROWS, BLOCK_QUERIES = 8192, 512
#: Queries searched together, dimensions probed between two cuts, and the share of pairs below which each is followed by itself.
GROUP_QUERIES, PROBED, FEW = 128, 16, 1 / 32
#: Sums below this are exact in doubles.
EXACT = 2.0**52
PACKED = "n int, ids binary, values binary"
HITS = "query_key long, query_hash long, row_key long, score long"


def integer_vectors(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 1024) -> DataFrame:
    """``key`` and ``vector`` (array<long>): floor(scale * x) of each component x as a double.

    Rows whose vector is null, or has a null or non-finite component, are left out. A null id is kept as the lowest number.
    Components and scores have to fit 64-bit integers.
    """
    values = F.col(vector_column).cast("array<double>")
    usable = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(values.isNotNull() & usable).select(
        key_of(id_column).alias("key"), F.transform(values, lambda x: F.floor(x * F.lit(float(scale)))).alias("vector")
    )


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """One row per vector; short vectors are filled with zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), int(sizes.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, SHARD_ROWS):
            batch = whole.slice(start, SHARD_ROWS)
            ids, values = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
            # Ascending ids, so that of equal scores the first one met is the one to keep.
            order = np.lexsort((*values.T[::-1], ids))
            ids, values = ids[order], values[order]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()]), pa.array([values.tobytes()])], names=["n", "ids", "values"]
            )


def _pack_block(pdf: pd.DataFrame) -> pd.DataFrame:
    values = _matrix(pa.array(pdf["vector"], pa.list_(pa.int64())))
    names = pdf[["key", "hash"]].to_numpy(np.int64)
    return pd.DataFrame([{"block": pdf["block"].iloc[0], "asked": len(pdf), "names": names.tobytes(), "weights": values.tobytes()}])


class Shard:
    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.columns = ids, np.ascontiguousarray(values.T)
        self.high = values.max(axis=0, initial=0) if len(values) else np.zeros(values.shape[1], np.int64)
        self.low = values.min(axis=0, initial=0) if len(values) else np.zeros(values.shape[1], np.int64)
        self.postings = [(np.flatnonzero(column > 0), np.flatnonzero(column < 0)) for column in self.columns]

    def best(self, own: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For queries (one row of ``weights`` each): the query, place and score of its best k rows other than ``own``.

        By query, best first, smaller places first among equals.
        """
        dims = min(weights.shape[1], len(self.columns))
        weights, high, low = weights[:, :dims], self.high[:dims], self.low[:dims]
        largest = np.abs(weights.astype(float)) @ np.maximum(high.astype(float), -low.astype(float))
        # Sums of integers that stay below 2 ** 53 are exact in doubles too, which multiply many times faster.
        number = np.float64 if largest.max(initial=0) < EXACT else np.int64
        bounds = np.maximum(weights * high, weights * low)
        order = np.argsort(-bounds.astype(float).sum(axis=0), kind="stable")
        weights, columns, postings = weights[:, order].astype(number), self.columns[order].astype(number), [self.postings[d] for d in order.tolist()]
        # What dimensions from here on can add to each query.
        rest = np.concatenate([np.cumsum(bounds[:, order][:, ::-1], axis=1)[:, ::-1], np.zeros((len(weights), 1), np.int64)], axis=1).astype(number)
        lowest = -np.inf if number is np.float64 else np.iinfo(np.int64).min
        least = np.full(len(weights), lowest, number)  # the k-th best score so far
        queries, places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, number)
        step, start = max(4 * k, 64), 0
        while start < len(self.ids):
            end = min(start + step, len(self.ids))
            found = start + np.flatnonzero(self._listed(start, end, weights, postings, rest, least))
            q, at, partial = self._probe(found, weights, columns, rest, least)
            other = self.ids[at] != own[q]
            queries, places, scores = np.concatenate([queries, q[other]]), np.concatenate([places, at[other]]), np.concatenate([scores, partial[other]])
            ranked = np.lexsort((places, -scores, queries))
            counts = np.bincount(queries, minlength=len(weights))
            ranked = ranked[np.arange(len(ranked)) - np.repeat(np.cumsum(counts) - counts, counts) < k]
            queries, places, scores = queries[ranked], places[ranked], scores[ranked]
            full = counts >= k
            least[full] = scores[np.cumsum(np.minimum(counts, k))[full] - 1]
            start, step = end, 4096
        return queries, places, scores.astype(np.int64)

    @staticmethod
    def _listed(start: int, end: int, weights: np.ndarray, postings: list, rest: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Which rows are in an essential list of a query: without these lists nothing above its k-th best can come together."""
        seen = np.zeros(end - start, bool)
        if (least < 0).any():
            return ~seen  # a row in no list scores up to 0 and is competitive
        essential = rest[:, :-1] > least[:, None]
        for d, both in enumerate(postings):
            for side, listed in zip((weights[:, d] > 0, weights[:, d] < 0), both, strict=True):
                if (essential[:, d] & side).any():
                    lo, hi = np.searchsorted(listed, (start, end))
                    seen[listed[lo:hi] - start] = True
            if seen.all():
                break
        return seen

    @staticmethod
    def _probe(found: np.ndarray, weights: np.ndarray, columns: np.ndarray, rest: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, places and scores above the query's ``least`` among the places ``found``."""
        dims, at = len(columns), 0
        partial = np.zeros((len(weights), len(found)), weights.dtype)
        alive = partial + rest[:, :1] > least[:, None]
        # All pairs together, as long as many of them are alive.
        while at < dims and np.count_nonzero(alive) > FEW * alive.size:
            end = min(at + PROBED, dims)
            partial += weights[:, at:end] @ columns[at:end, found]
            alive = partial + rest[:, end : end + 1] > least[:, None]
            left = alive.any(axis=0)
            if not left.all():
                found, partial, alive = found[left], partial[:, left], alive[:, left]
            if not len(found):
                break
            at = end
        q, place = np.nonzero(alive)
        partial, found = partial[q, place], found[place]
        while at < dims and len(q):
            end = min(at + PROBED, dims)
            for d in range(at, end):
                partial += weights[q, d] * columns[d, found]
            competitive = partial + rest[q, end] > least[q]
            q, found, partial = q[competitive], found[competitive], partial[competitive]
            at = end
        return q, found, partial


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``row_id``, ``score``: the best k candidates of each query, ties to the smaller id.

    Both tables come from ``integer_vectors``. Rows of a query's own id are no candidates for it. Every row of ``candidates`` is
    ranked, those that repeat an id and a vector too; a repeated query counts once, queries of one id with different vectors
    each count. Missing dimensions count as 0. A query without candidates, and empty tables, give no rows.
    """
    asked = cut_lineage(
        queries.withColumn("hash", F.xxhash64("vector")).dropDuplicates(["key", "hash"]), "queries"
    )
    blocks = max(-(-asked.count() // BLOCK_QUERIES), 1)
    packed_queries = (
        asked.withColumn("block", F.pmod(F.xxhash64("key", "hash"), F.lit(blocks)).cast("int"))
        .groupBy("block").applyInPandas(_pack_block, "block int, asked int, names binary, weights binary")
    )
    shards = cut_lineage(candidates.select("key", "vector").mapInArrow(_pack, PACKED), "shards")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                ids = np.frombuffer(row["ids"], np.int64)
                shard = Shard(ids, np.frombuffer(row["values"], np.int64).reshape(row["n"], -1))
                names = np.frombuffer(row["names"], np.int64).reshape(-1, 2)
                weights = np.frombuffer(row["weights"], np.int64).reshape(row["asked"], -1)
                for start in range(0, row["asked"], GROUP_QUERIES):
                    group = names[start : start + GROUP_QUERIES]
                    found, places, scores = shard.best(group[:, 0], weights[start : start + GROUP_QUERIES], k)
                    columns = [group[found, 0], group[found, 1], ids[places], scores]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_key", "query_hash", "row_key", "score"])

    pairs = meet(shards, F.xxhash64("ids"), shards.count(), packed_queries, blocks)
    hits = pairs.select("n", "ids", "values", "asked", "names", "weights").mapInArrow(search, HITS)
    merged = Window.partitionBy("query_key", "query_hash").orderBy(F.col("score").desc(), "row_key")
    return (
        hits.withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= k)
        .select(
            F.when(F.col("query_key") != NO_ID, F.col("query_key")).alias("query_id"), "rank",
            F.when(F.col("row_key") != NO_ID, F.col("row_key")).alias("row_id"), "score",
        )
    )
