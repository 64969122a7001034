"""Text and vector search over a document table, rank fusion, and scoring of the results."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import clamp
from tidemark.functions.text import content_hash, tokens
from tidemark.operators.aggregates import first_rows_per
from tidemark.operators.asof import newest_per
from tidemark.operators.postings import SENT_BYTES, build_postings, meet_shards, search_postings
from tidemark.session import cut_lineage

# Ranking constants and default depths.
RRF_CONSTANT = 60
RRF_DEPTH = 40
SCORE_THRESHOLD = 0.55
MAX_SELECTED = 20
LOW_CONFIDENCE = 8
QUERY_BLOCK = 1024
SHARD_ROWS = 8192
#: Rows of a group of like vectors on average, and rounds in which the groups are found.
GROUP_ROWS, GROUP_ROUNDS = 64, 4


def terms_of_queries(queries: DataFrame, query_id: str, query_text: str) -> DataFrame:
    terms = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(query_text))).alias("term"))
    return terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("weight"))


def bm25(
    documents: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str, query_text: str,
    depth: int | None = None,
) -> DataFrame:
    """BM25 of every query, of its first ``depth`` documents or of all that share a token with it.

    Documents are tokenised once, into a stored index whose blocks know their largest score; with a depth, blocks that cannot
    hold one of the first documents are skipped (see ``postings``). Scores are divided by the query's best. Each row of
    ``documents`` is a document.
    """
    found = search_postings(build_postings(documents, doc_id, text), terms_of_queries(queries, query_id, query_text), depth)
    scored = found.filter(F.col("raw").isNotNull()).drop("scored")
    if depth is None:
        best = scored.groupBy("query_id").agg(F.max("raw").alias("best"))
        return scored.join(best, "query_id").select("query_id", "doc_id", (F.col("raw") / F.col("best")).alias("score"))
    # The best score of a query is among its first rows, so the cut comes before the division.
    ranked = first_rows_per(scored, ["query_id"], [F.round("raw", 9).desc(), F.col("doc_id").asc()], depth)
    score = F.col("raw") / F.max("raw").over(Window.partitionBy("query_id"))
    return ranked.select("query_id", "doc_id", score.alias("score"), "rank")


def inner_product(left: Column, right: Column) -> Column:
    pairs = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda total, term: total + term)


def nearest_to(documents: DataFrame, vector: str, query: Sequence[float], doc_id: str, depth: int) -> DataFrame:
    """Top documents for one query vector, entirely in the JVM."""
    given = F.array(*[F.lit(float(part)) for part in query])
    scored = documents.select(F.col(doc_id).alias("doc_id"), inner_product(F.col(vector), given).alias("score"))
    return scored.orderBy(F.col("score").desc(), F.col("doc_id").asc()).limit(depth)


def dense_search(
    documents: DataFrame, doc_id: str, vector: str, queries: DataFrame, query_id: str, query_vector: str, depth: int,
) -> DataFrame:
    """Top documents per query vector by inner product, exact.

    Documents become shards where they are read (``vector_shards``). In a shard they are grouped around centres, and each
    group knows its centre and radius: no inner product with a query is above that of the centre plus the query's length
    times the radius. What the best groups of all shards hold gives a floor under a query's ``depth``-th document; groups
    below it are skipped. Queries go to the shards in blocks, to all tasks at once where they are small; nothing
    passes through the driver but counts and small queries.
    """
    found = search_shards(vector_shards(documents, doc_id, vector), queries, query_id, query_vector, depth)
    hits_only = found.filter(F.col("score").isNotNull()).select("query_id", "doc_id", "score")
    return first_rows_per(hits_only, ["query_id"], [F.round("score", 9).desc(), F.col("doc_id").asc()], depth)


def vector_shards(documents: DataFrame, doc_id: str, vector: str, shard_rows: int = SHARD_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per shard, as a table in the shared folder: ids and vectors in the order of their groups, centres and radii."""
    narrow = documents.select(F.col(doc_id).alias("doc_id"), F.col(vector).cast("array<double>").alias("vector")).filter(F.col("vector").isNotNull())
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, shard_rows):
                batch = whole.slice(start, shard_rows)
                vectors = _as_matrix(pa.concat_arrays([batch.column(1)]))
                order, ends, centres, radii = _groups(vectors, max(len(vectors) // group_rows, 1))
                ids = batch.column(0).take(pa.array(order))
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *[pa.array([x.tobytes()]) for x in (vectors[order], ends, centres, radii)]],
                    names=["doc_ids", "vectors", "ends", "centres", "radii"],
                )

    return cut_lineage(narrow.mapInArrow(shards, f"doc_ids array<{id_type}>, vectors binary, ends binary, centres binary, radii binary"), "vectors")


def _groups(vectors: np.ndarray, count: int) -> tuple[np.ndarray, ...]:
    """Order of the rows by group, where each group ends, its mean, and the distance of its farthest row from the mean."""
    centres = vectors[np.linspace(0, len(vectors) - 1, count).astype(int)]
    for _ in range(GROUP_ROUNDS):
        nearest = np.argmax(vectors @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)
        sizes = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, vectors)
        centres = (sums / np.maximum(sizes, 1)[:, None])[sizes > 0]
    nearest = np.argmax(vectors @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)
    used, nearest = np.unique(nearest, return_inverse=True)
    centres, order = centres[used], np.argsort(nearest, kind="stable")
    far = np.sqrt(((vectors - centres[nearest]) ** 2).sum(axis=1))
    radii = np.zeros(len(centres))
    np.maximum.at(radii, nearest, far)
    return order, np.cumsum(np.bincount(nearest, minlength=len(centres))), centres, radii


class _VectorShard:
    def __init__(self, row: dict):
        self.ids, self.ends = row["doc_ids"].values, np.frombuffer(row["ends"].as_py(), np.int64)
        shape = (len(self.ids), -1)
        self.vectors = np.frombuffer(row["vectors"].as_py()).reshape(shape)
        self.centres, self.radii = np.frombuffer(row["centres"].as_py()).reshape(len(self.ends), -1), np.frombuffer(row["radii"].as_py())

    def bounds(self, asked: np.ndarray) -> np.ndarray:
        """One row per query, one column per group; a little more than exact, as sums differ in their last digits."""
        lengths = np.sqrt((asked**2).sum(axis=1))
        reach = lengths[:, None] * self.radii
        return asked @ self.centres.T + reach + 1e-9 * (1 + lengths[:, None] * np.sqrt((self.centres**2).sum(axis=1)) + reach)

    def scores(self, asked: np.ndarray, visited: np.ndarray) -> np.ndarray:
        """Inner products of the rows of the visited groups, -inf for the others."""
        out = np.full((len(asked), len(self.ids)), -np.inf)
        for group, (start, end) in enumerate(zip([0, *self.ends[:-1].tolist()], self.ends.tolist(), strict=True)):
            who = np.flatnonzero(visited[:, group])
            if len(who):
                out[who, start:end] = asked[who] @ self.vectors[start:end].T
        return out

    def first_groups(self, bounds: np.ndarray, depth: int) -> np.ndarray:
        """The groups of the best bounds that together hold ``depth`` rows."""
        order = np.argsort(-bounds, axis=1, kind="stable")
        sizes = np.diff(self.ends, prepend=0)[order]
        enough = np.cumsum(sizes, axis=1) - sizes < depth
        out = np.zeros(bounds.shape, bool)
        np.put_along_axis(out, order, enough, axis=1)
        return out


def search_shards(
    shards: DataFrame, queries: DataFrame, query_id: str, query_vector: str, depth: int, query_block: int | None = None, sent_bytes: int = SENT_BYTES,
) -> DataFrame:
    """``query_id``, ``doc_id``, ``score`` of what may be among the first ``depth``; rows without a score hold in ``scored`` how
    many documents of a shard were scored for the query."""
    asked = cut_lineage(
        queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).cast("array<double>").alias("vector"))
        .filter(F.col("vector").isNotNull()),
        "queries",
    )
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("vector")).alias("parts")).first()
    if not size.n:
        raise ValueError("no query vectors")
    blocks, sent = -(-size.n // (query_block or QUERY_BLOCK)), size.parts * 8 < sent_bytes
    lanes = 1 if sent else max(shards.count(), 1)
    id_type = shards.schema["doc_ids"].dataType.elementType.simpleString()
    query_type = asked.schema["query_id"].dataType.simpleString()

    def over_shards(listed: DataFrame, work, schema: str) -> DataFrame:
        packed = (
            listed.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).groupBy("block")
            .agg(F.collect_list(F.struct("query_id", "vector", "floor")).alias("asked"))
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    row = {name: batch.column(name)[at] for name in batch.schema.names}
                    given = row["asked"].values
                    floors = given.field("floor").to_numpy(zero_copy_only=False)
                    yield work(_VectorShard(row), given.field("query_id"), _as_matrix(given.field("vector")), floors)

        pairs = meet_shards(shards, packed, "doc_ids", blocks, lanes, sent)
        return pairs.select("doc_ids", "vectors", "ends", "centres", "radii", "asked").mapInArrow(run, schema)

    def seeds(shard: _VectorShard, ids: pa.Array, vectors: np.ndarray, floors: np.ndarray) -> pa.RecordBatch:
        scores = shard.scores(vectors, shard.first_groups(shard.bounds(vectors), depth))
        best = -np.sort(-scores, axis=1)[:, :depth]
        rows, columns = np.nonzero(np.isfinite(best))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(best[rows, columns])], names=["query_id", "score"])

    def visit(shard: _VectorShard, ids: pa.Array, vectors: np.ndarray, floors: np.ndarray) -> pa.RecordBatch:
        scores = shard.scores(vectors, np.round(shard.bounds(vectors), 9) >= np.round(floors, 9)[:, None])
        keep = min(depth, scores.shape[1])
        # Rounding keeps every document that could tie at the cut.
        rounded = np.round(scores, 9)
        cut = np.partition(rounded, -keep, axis=1)[:, -keep]
        rows, best = np.nonzero((rounded >= cut[:, None]) & np.isfinite(scores))
        none = len(ids)
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([ids.take(pa.array(rows)), ids]), pa.concat_arrays([shard.ids.take(pa.array(best)), pa.nulls(none, shard.ids.type)]),
                pa.concat_arrays([pa.array(scores[rows, best], pa.float64()), pa.nulls(none, pa.float64())]),
                pa.concat_arrays([pa.nulls(len(rows), pa.int64()), pa.array(np.isfinite(scores).sum(axis=1), pa.int64())]),
            ],
            names=["query_id", "doc_id", "score", "scored"],
        )

    lowest = F.lit(float("-inf"))
    best = over_shards(asked.withColumn("floor", lowest), seeds, f"query_id {query_type}, score double")
    ranked = best.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc())))
    floors = cut_lineage(ranked.filter(F.col("place") == depth).select("query_id", F.col("score").alias("floor")), "floors")
    with_floors = asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", lowest))
    return over_shards(with_floors, visit, f"query_id {query_type}, doc_id {id_type}, score double, scored long")


def _as_matrix(vectors: pa.ListArray) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def restrict(documents: DataFrame, allowed: DataFrame, doc_id: str) -> DataFrame:
    """Keep the documents the caller may see, before anything is scored."""
    return documents.join(allowed.select(doc_id).distinct(), doc_id, "left_semi")


def fuse(keyword: DataFrame, dense: DataFrame, depth: int = RRF_DEPTH) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (query_id, doc_id, score, rank)."""
    left = keyword.select(
        "query_id", "doc_id", F.col("rank").alias("keyword_rank"), F.col("score").alias("keyword_score")
    )
    right = dense.select("query_id", "doc_id", F.col("rank").alias("dense_rank"), F.col("score").alias("vector_score"))
    merged = left.join(right, ["query_id", "doc_id"], "full_outer")
    fused = F.lit(0.0)
    for name in ("keyword_rank", "dense_rank"):
        fused = fused + F.coalesce(1.0 / (RRF_CONSTANT + F.col(name)), F.lit(0.0))
    scored = merged.withColumn("rrf_score", fused)
    order = [F.round("rrf_score", 12).desc(), F.col("doc_id").asc()]
    return first_rows_per(scored, ["query_id"], order, depth).withColumnRenamed("rank", "rrf_rank")


def hits(fused: DataFrame, score: Column) -> DataFrame:
    """Fused candidates as display records with a final score clamped to [0, 1]."""
    final = F.round(clamp(score, 0.0, 1.0), 6)
    return fused.select(
        "query_id", "doc_id", final.alias("score"), final.alias("rerank_score"), "keyword_rank", "dense_rank",
        F.round("rrf_score", 8).alias("rrf_score"),
        F.round(F.coalesce("keyword_score", F.lit(0.0)), 6).alias("keyword_score"),
        F.round(F.coalesce("vector_score", F.lit(0.0)), 6).alias("vector_score"),
        F.lit("rerank_threshold").alias("selection_reason"), F.lit("retrieval").alias("source"),
    )


def select_hits(found: DataFrame, threshold: float = SCORE_THRESHOLD, count: int = MAX_SELECTED) -> DataFrame:
    """Best hits per query at or above the threshold."""
    level = min(1.0, max(0.0, threshold))
    order = [F.col("score").desc(), F.col("doc_id").asc()]
    return first_rows_per(found.filter(F.col("score") >= level), ["query_id"], order, count)


def low_confidence(found: DataFrame, count: int = LOW_CONFIDENCE) -> DataFrame:
    order = [F.col("score").desc(), F.col("doc_id").asc()]
    return first_rows_per(found, ["query_id"], order, count).select("query_id", "doc_id", "score", "rank")


def pin(found: DataFrame, pinned: DataFrame) -> DataFrame:
    """Documents the user confirmed get score 1; those not found are appended."""
    wanted = pinned.select("query_id", "doc_id").distinct().withColumn("__pinned", F.lit(True))
    merged = found.join(wanted, ["query_id", "doc_id"], "full_outer")
    confirmed = F.col("__pinned").isNotNull()
    fixed = {"score": 1.0, "rerank_score": 1.0, "selection_reason": "user_confirmed", "source": "user_confirmed"}
    missing = {"rrf_score": 0.0, "keyword_score": 0.0, "vector_score": 0.0}
    columns = []
    for name in found.columns:
        if name in fixed:
            columns.append(F.when(confirmed, F.lit(fixed[name])).otherwise(F.col(name)).alias(name))
        elif name in missing:
            columns.append(F.coalesce(F.col(name), F.lit(missing[name])).alias(name))
        else:
            columns.append(F.col(name))
    return merged.select(*columns)


def table_candidates(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best score and number of hits per table."""
    return found.groupBy(*keys).agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("field_count"))


def retrieval_quality(gold: DataFrame, ranked: DataFrame) -> DataFrame:
    """Recall and reciprocal rank of the first hit per query of ``gold``.

    ``gold`` has (query_id, doc_id), doc_id NULL for a query without expectations; ``ranked`` has
    (query_id, doc_id, rank).
    """
    places = ranked.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    judged = gold.distinct().join(places, ["query_id", "doc_id"], "left")
    expected = F.count("doc_id")
    return judged.groupBy("query_id").agg(
        F.when(expected == 0, F.lit(1.0)).otherwise(F.count("rank") / expected).alias("recall"),
        F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def table_hit_rate(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Share of the expected tables that hold one of the hits, per query of ``gold``; 1 without expectations.

    ``gold`` has (query_id, table_id), table_id NULL for a query without expectations; ``found`` the tables of the hits.
    """
    seen = found.select("query_id", "table_id").distinct().withColumn("__seen", F.lit(1))
    judged = gold.select("query_id", "table_id").distinct().join(seen, ["query_id", "table_id"], "left")
    expected = F.count("table_id")
    return judged.groupBy("query_id").agg(
        F.when(expected == 0, F.lit(1.0)).otherwise(F.count("__seen") / expected).alias("table_hit_rate")
    )


def mean_quality(per_query: DataFrame) -> DataFrame:
    return per_query.agg(
        F.count(F.lit(1)).alias("queries"),
        F.round(F.avg("recall"), 4).alias("recall"),
        F.round(F.avg("reciprocal_rank"), 4).alias("mrr"),
    )


def build_documents(fields: DataFrame, doc_id: str, parts: Sequence[str]) -> DataFrame:
    """One search text per field description, with a hash that shows when it changed."""
    body = F.concat_ws(" ", *[F.col(name).cast("string") for name in parts])
    return fields.select(
        F.col(doc_id), body.alias("keyword_text"),
        content_hash(F.col(doc_id), *[F.col(name) for name in parts]).alias("content_hash"),
        F.lit(True).alias("active"),
    )


def upsert(stored: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Changed rows replace stored rows of the same key; the rest stays."""
    tagged = stored.withColumn("__version", F.lit(0)).unionByName(
        changed.withColumn("__version", F.lit(1)), allowMissingColumns=True
    )
    return newest_per(tagged, [key], [F.col("__version").desc()]).drop("__version")


def deactivate(stored: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Soft delete: rows named in ``gone`` stay but become inactive."""
    marks = gone.select(key).distinct().withColumn("__gone", F.lit(True))
    joined = stored.join(marks, key, "left")
    active = F.when(F.col("__gone"), F.lit(False)).otherwise(F.col("active"))
    return joined.withColumn("active", active).drop("__gone").select(*stored.columns)
