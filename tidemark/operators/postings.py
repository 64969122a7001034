"""Inverted index with block maxima, and exact top-k search on it that skips blocks.

Documents become shards where they are read; only small tables are dealt out first. A shard orders its documents by the signs of the leading
directions of its common terms (which part languages and kinds of text) and then by length, so that like documents stand
together, and cuts them into blocks. Per term it holds the postings in document order,
and of each block that has the term the most occurrences and the least length: they bound every score of the block from
above, whatever the corpus' mean length is. A query sums up the bounds of its terms per block. What the best blocks of all
shards score gives a floor under its ``depth``-th document; then only blocks whose bound reaches the floor are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import tokens
from tidemark.session import cut_lineage

# Ranking constants.
BM25_K1 = 1.5
BM25_B = 0.75
#: Documents of a block; documents and tokens of a shard at most (one document always fits).
BLOCK_DOCS, SHARD_DOCS, SHARD_TOKENS = 16, 4096, 4_000_000
#: Common terms and directions by which a shard orders its documents.
COMMON_TERMS, DIRECTIONS = 256, 4
#: Tables of less than these estimated bytes are dealt out before they are indexed, into tasks of at most so many; larger ones are
#: indexed where they lie.
SPREAD_BYTES, TASK_BYTES = 256_000_000, 16_000_000
#: Beyond so many shards the floor of a query is taken from all of them.
SEEDED_SHARDS = 16
#: Queries that meet a shard together.
QUERY_BLOCK = 1024
#: Queries of less than these estimated bytes in all go to every task at once; more of them meet the shards lane by lane.
SENT_BYTES, TERM_BYTES = 8_000_000, 32
PARTS = ("lengths", "docs", "tfs", "blocks", "block_counts", "block_tfs", "block_lengths")
NUMBERS = np.int32


def build_postings(
    documents: DataFrame, doc_id: str, text: str, block_docs: int = BLOCK_DOCS, shard_docs: int = SHARD_DOCS, shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """One row per shard, as a table in the shared folder. A null or empty text is a document without terms."""
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < SPREAD_BYTES:
        # A small table may lie in one piece of one file; its texts are dealt out, so that all tasks share the work.
        rows = rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)), "doc_id")
    narrow = rows.select("doc_id", tokens(F.col("text")).alias("tokens"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    schema = f"n int, words long, block_docs int, doc_ids array<{id_type}>, terms array<string>, counts array<int>, " + ", ".join(f"{p} binary" for p in PARTS)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(batch.column(1).value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            start = 0
            while start < batch.num_rows:
                size = max(int(np.searchsorted(np.cumsum(lengths[start : start + shard_docs]), shard_tokens, side="right")), 1)
                yield _shard(batch.slice(start, size), lengths[start : start + size], block_docs)
                start += size

    return cut_lineage(narrow.mapInArrow(shards, schema), "postings")


def _order(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Documents that share common terms one after the other, shorter ones first."""
    n, counts = len(lengths), np.bincount(codes, minlength=1)
    column = np.full(len(counts), -1)
    common = np.argsort(-counts, kind="stable")[:COMMON_TERMS]
    column[common] = np.arange(len(common))
    seen = column[codes] >= 0
    matrix = np.zeros((n, len(common)))
    matrix[np.repeat(np.arange(n), lengths)[seen], column[codes[seen]]] = 1
    matrix -= matrix.mean(axis=0)
    directions = np.linalg.eigh(matrix.T @ matrix)[1][:, ::-1][:, :DIRECTIONS]
    sides = ((matrix @ directions > 0) << np.arange(directions.shape[1])).sum(axis=1)
    return np.lexsort((lengths, sides))


def _shard(batch: pa.RecordBatch, lengths: np.ndarray, block_docs: int) -> pa.RecordBatch:
    n = batch.num_rows
    coded = batch.column(1).flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = _order(codes, lengths)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    pairs, tfs = np.unique(codes * n + np.repeat(place, lengths), return_counts=True)
    terms, docs = np.divmod(pairs, n)
    lengths = lengths[order]
    counts = np.bincount(terms, minlength=len(coded.dictionary))
    # Blocks: postings of one term in one stretch of documents.
    blocks = docs // block_docs
    first = np.flatnonzero(np.concatenate([[True], (np.diff(terms) != 0) | (np.diff(blocks) != 0)])) if len(docs) else np.zeros(0, np.int64)
    numbers = {
        "lengths": lengths, "docs": docs, "tfs": tfs, "blocks": blocks[first], "block_counts": np.bincount(terms[first], minlength=len(counts)),
        "block_tfs": np.maximum.reduceat(tfs, first) if len(first) else first, "block_lengths": np.minimum.reduceat(lengths[docs], first) if len(first) else first,
    }
    columns = [
        pa.array([n], pa.int32()), pa.array([int(lengths.sum())], pa.int64()), pa.array([block_docs], pa.int32()), _one_list(batch.column(0).take(pa.array(order))),
        _one_list(coded.dictionary), _one_list(pa.array(counts, pa.int32())), *[pa.array([numbers[p].astype(NUMBERS).tobytes()]) for p in PARTS],
    ]
    return pa.RecordBatch.from_arrays(columns, names=["n", "words", "block_docs", "doc_ids", "terms", "counts", *PARTS])


def _one_list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _within(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the stretches [start, start + size), one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def meet_shards(shards: DataFrame, packed: DataFrame, ids: str, blocks: int, lanes: int, sent: bool) -> DataFrame:
    """Every shard next to every block of queries; ``packed`` has one row per ``block``.

    Queries that are small (``sent``) go to all tasks, whatever size Spark expects of them: a shuffle by the block would bring all
    shards to the few tasks that hold a block. Others meet the shards in lanes: a shard belongs to one, a block is listed in all.
    """
    each = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    if sent:
        return each.join(F.broadcast(packed), "block")
    lane = F.pmod(F.xxhash64(F.element_at(ids, 1), F.element_at(ids, -1), F.size(ids)), F.lit(lanes)).cast("int")
    listed = packed.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    # Merged, as a table of blocks in memory would grow with the queries; one block and one shard are held at a time.
    return each.withColumn("lane", lane).join(listed.hint("merge"), ["block", "lane"]).drop("lane")


class Shard:
    """The part of a shard that the asked terms need."""

    def __init__(self, row: dict, asked: pa.Array, mean: float):
        part = {p: np.frombuffer(row[p].as_py(), NUMBERS) for p in PARTS}
        counts = row["counts"].values.to_numpy(zero_copy_only=False).astype(np.int64)
        self.n, self.ids = row["n"].as_py(), row["doc_ids"].values
        self.block_docs = row["block_docs"].as_py()
        self.n_blocks = -(-self.n // self.block_docs)
        found = pc.fill_null(pc.index_in(asked, value_set=row["terms"].values), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        here, block_counts = found >= 0, part["block_counts"].astype(np.int64)
        safe = np.maximum(found, 0)
        none = not len(counts)
        self.sizes = np.zeros(len(asked), np.int64) if none else np.where(here, counts[safe], 0)
        self.block_sizes = np.zeros(len(asked), np.int64) if none else np.where(here, block_counts[safe], 0)
        at = _within((np.cumsum(counts) - counts)[safe], self.sizes) if not none else np.zeros(0, np.int64)
        at_block = _within((np.cumsum(block_counts) - block_counts)[safe], self.block_sizes) if not none else np.zeros(0, np.int64)
        self.starts, self.block_starts = np.cumsum(self.sizes) - self.sizes, np.cumsum(self.block_sizes) - self.block_sizes

        def impact(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
            return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / max(1.0, mean)))

        self.docs = part["docs"][at]
        self.impacts = impact(part["tfs"][at].astype(float), part["lengths"][self.docs])
        self.blocks = part["blocks"][at_block]
        self.best = impact(part["block_tfs"][at_block].astype(float), part["block_lengths"][at_block])

    def _bounds(self, terms: np.ndarray, gains: np.ndarray) -> np.ndarray:
        sizes = self.block_sizes[terms]
        at = _within(self.block_starts[terms], sizes)
        # A little more than the sum, as sums in another order may differ in their last digits.
        return np.bincount(self.blocks[at], self.best[at] * np.repeat(gains, sizes), self.n_blocks) * (1 + 1e-9)

    def _scores(self, terms: np.ndarray, gains: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        sizes = self.sizes[terms]
        at = _within(self.starts[terms], sizes)
        inside = chosen[self.docs[at] // self.block_docs]
        return np.bincount(self.docs[at[inside]], (self.impacts[at] * np.repeat(gains, sizes))[inside], self.n)

    def seeds(self, terms: np.ndarray, gains: np.ndarray, depth: int) -> np.ndarray:
        """The best scores in the blocks of the best bounds, ``depth`` at most."""
        bounds = self._bounds(terms, gains)
        chosen = np.zeros(self.n_blocks, bool)
        chosen[np.argsort(-bounds, kind="stable")[: -(-depth // self.block_docs)]] = True
        scores = self._scores(terms, gains, chosen)
        return np.sort(scores[scores > 0])[::-1][:depth]

    def search(self, terms: np.ndarray, gains: np.ndarray, depth: int | None, floor: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents of the blocks that may reach ``floor`` that may be among the first ``depth``; how many were scored."""
        chosen = np.ones(self.n_blocks, bool)
        if depth is not None:
            if not floor:
                best = self.seeds(terms, gains, depth)
                floor = best[-1] if len(best) == depth else 0.0
            chosen = np.round(self._bounds(terms, gains), 9) >= np.round(floor, 9)
        scores = self._scores(terms, gains, chosen)
        hit = np.flatnonzero(scores > 0)
        scored, ranked = len(hit), np.round(scores[hit], 9)
        if depth is not None and scored > depth:
            # Rounding keeps every document that could tie at the cut.
            hit = hit[ranked >= np.partition(ranked, scored - depth)[scored - depth]]
        return hit, scores[hit], scored


def search_postings(
    postings: DataFrame, query_terms: DataFrame, depth: int | None, query_block: int = QUERY_BLOCK, seeded_shards: int = SEEDED_SHARDS,
    sent_bytes: int = SENT_BYTES,
) -> DataFrame:
    """``query_id``, ``doc_id``, ``raw`` of what may be among the first ``depth`` documents of a query (all with None).

    ``query_terms`` has ``query_id``, ``term`` and ``weight``. Rows without ``doc_id`` and ``raw`` hold in ``scored`` how many
    documents of a shard were scored for the query.
    """
    total = postings.agg(F.count(F.lit(1)).alias("shards"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    n, mean = float(total.n), total.words / max(total.n, 1)
    frequency = (
        postings.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("t.terms", "t.counts")
        .join(query_terms.select(F.col("term").alias("terms")).distinct(), "terms", "left_semi")
        .groupBy(F.col("terms").alias("term")).agg(F.sum("counts").alias("df"))
    )
    gain = F.col("weight") * F.ln(1 + (F.lit(n) - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    per_query = query_terms.join(frequency, "term").select("query_id", F.struct("term", gain.alias("gain")).alias("t")).groupBy("query_id").agg(F.collect_list("t").alias("terms"))
    query_type, id_type = query_terms.schema["query_id"].dataType.simpleString(), postings.schema["doc_ids"].dataType.elementType.simpleString()
    asked = cut_lineage(per_query, "asked")
    queries = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms")).first()
    blocks, sent = max(-(-queries.n // query_block), 1), queries.terms * TERM_BYTES < sent_bytes

    def over_shards(queries: DataFrame, work, schema: str) -> DataFrame:
        """``work(shard, ids, terms and gains and floor of each query)`` for every shard and block of queries."""
        packed = (
            queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
            .groupBy("block").agg(F.collect_list(F.struct("query_id", "terms", "floor")).alias("asked"))
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    row = {name: batch.column(name)[at] for name in batch.schema.names}
                    listed = row["asked"].values
                    lists = listed.field("terms")
                    coded = lists.flatten().field("term").dictionary_encode()
                    codes, gains = coded.indices.to_numpy(zero_copy_only=False), lists.flatten().field("gain").to_numpy(zero_copy_only=False)
                    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
                    each = [(codes[a:b], gains[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                    yield work(Shard(row, coded.dictionary, mean), listed.field("query_id"), each, listed.field("floor").to_pylist())

        pairs = meet_shards(postings, packed, "doc_ids", blocks, max(total.shards, 1), sent)
        return pairs.select("n", "block_docs", "doc_ids", "terms", "counts", *PARTS, "asked").mapInArrow(run, schema)

    def seeds(shard: Shard, ids: pa.Array, each: list, floors: list) -> pa.RecordBatch:
        best = [shard.seeds(terms, gains, depth) for terms, gains in each]
        owners = np.repeat(np.arange(len(best)), [len(b) for b in best])
        return pa.RecordBatch.from_arrays([ids.take(pa.array(owners)), pa.array(np.concatenate(best), pa.float64())], names=["query_id", "raw"])

    def hits(shard: Shard, ids: pa.Array, each: list, floors: list) -> pa.RecordBatch:
        found = [shard.search(*query, depth, floor) for query, floor in zip(each, floors, strict=True)]
        hit, scores = (np.concatenate([f[i] for f in found]) for i in range(2))
        owners, none = np.repeat(np.arange(len(found)), [len(f[0]) for f in found]), len(found)
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([ids.take(pa.array(owners)), ids]),
                pa.concat_arrays([shard.ids.take(pa.array(hit)), pa.nulls(none, shard.ids.type)]),
                pa.concat_arrays([pa.array(scores, pa.float64()), pa.nulls(none, pa.float64())]),
                pa.concat_arrays([pa.nulls(len(hit), pa.int64()), pa.array([f[2] for f in found], pa.int64())]),
            ],
            names=["query_id", "doc_id", "raw", "scored"],
        )

    without = asked.withColumn("floor", F.lit(0.0))
    if depth is not None and total.shards > seeded_shards:
        # A query's floor: the depth-th best score among the best blocks of all shards. Of few shards each finds its own floor,
        # which is lower but needs no pass over the index.
        best = over_shards(without, seeds, f"query_id {query_type}, raw double")
        ranked = best.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("raw").desc())))
        floors = ranked.filter(F.col("place") == depth).select("query_id", F.col("raw").alias("floor"))
        without = asked.join(cut_lineage(floors, "floors"), "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    return over_shards(without, hits, f"query_id {query_type}, doc_id {id_type}, raw double, scored long")
