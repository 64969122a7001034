"""Registered queries: keyword search, vector search, fusion and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import tokens
from tidemark.operators import search
from tidemark.plans.registry import query
from tidemark.session import table

# Fixed value: candidates of each list before fusion.
DEPTH = 30
WORDS = "regexp_extract_all(lower(text), '[a-z0-9_]+')"


@query(
    "term_statistics",
    f"""with t as (select doc_id, unnest({WORDS}) as term from documents)
 select term, count(*) as occurrences, count(distinct doc_id) as documents from t group by 1""",
)
def term_statistics(spark, sf):
    documents = table(spark, sf, "documents")
    per_document = (
        documents.select("doc_id", F.explode(tokens(F.col("text"))).alias("term"))
        .groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    )
    return per_document.groupBy("term").agg(
        F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("documents")
    )


BM25_SQL = f"""
d as (select doc_id, {WORDS} as terms from documents),
tf as (select doc_id, len(terms) as length, term, count(*) as tf
 from (select doc_id, terms, unnest(terms) as term from d) group by all),
df as (select term, count(*) as df from tf group by 1),
n as (select count(*) as n, avg(len(terms)) as mean from d),
q as (select item_id as query_id, term, count(*) as weight from (select item_id, unnest({WORDS}) as term from benchmark) group by all),
raw as (select query_id, doc_id,
  sum(weight * ln(1 + (n.n - df.df + 0.5::double) / (df.df + 0.5::double)) * tf * 2.5::double
   / (tf + 1.5::double * (0.25::double + 0.75::double * length / greatest(1, n.mean)))) as raw
 from q join df using (term) join tf using (term), n group by all),
scored as (select *, raw / max(raw) over (partition by query_id) as score from raw where raw > 0),
keyword as (select query_id, doc_id, score, row_number() over (partition by query_id order by round(raw, 9) desc, doc_id) as rank
 from scored qualify rank <= {DEPTH})
"""


def keyword_hits(spark, sf) -> DataFrame:
    documents, queries = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    return search.bm25(documents, "doc_id", "text", queries, "item_id", "text", DEPTH)


@query(
    "keyword_search",
    f"with {BM25_SQL} select query_id, doc_id, round(score, 6) as score, cast(rank as integer) as rank from keyword",
)
def keyword_search(spark, sf):
    return keyword_hits(spark, sf).withColumn("score", F.round("score", 6))


DENSE_SQL = f"""
parts as (select label, generate_subscripts(embedding, 1) as pos, unnest(embedding)::double as part from embeddings),
means as (select label, pos, avg(part) as part from parts group by all),
centres as (select label as query_id, list(part order by pos) as centre from means group by 1),
dense as (select query_id, vec_id as doc_id, list_inner_product(centre, embedding::double[]) as score,
  row_number() over (partition by query_id order by round(score, 9) desc, vec_id) as rank
 from centres, embeddings qualify rank <= {DEPTH})
"""


def centres(spark, sf) -> DataFrame:
    """Mean vector per label: a handful of queries made from the whole table."""
    parts = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("at", "part"))
    means = parts.groupBy("label", "at").agg(F.avg(F.col("part").cast("double")).alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "part")))
    return means.groupBy(F.col("label").cast("long").alias("query_id")).agg(ordered["part"].alias("centre"))


def dense_hits(spark, sf) -> DataFrame:
    return search.dense_search(
        table(spark, sf, "embeddings"), "vec_id", "embedding", centres(spark, sf), "query_id", "centre", DEPTH
    )


@query(
    "vector_search",
    f"with {DENSE_SQL} select query_id::bigint as query_id, doc_id, round(score, 6) as score, cast(rank as integer) as rank from dense",
)
def vector_search(spark, sf):
    return dense_hits(spark, sf).withColumn("score", F.round("score", 6))


@query(
    "vector_search_single",
    """with parts as (select generate_subscripts(embedding, 1) as pos, unnest(embedding)::double as part from embeddings),
 m as (select list(part order by pos) as centre from (select pos, avg(part) as part from parts group by 1))
 select vec_id as doc_id, round(list_inner_product(centre, embedding::double[]), 6) as score from embeddings, m
 order by list_inner_product(centre, embedding::double[]) desc, vec_id limit 10""",
)
def vector_search_single(spark, sf):
    vectors = table(spark, sf, "embeddings")
    parts = vectors.select(F.posexplode("embedding").alias("at", "part"))
    # One row per dimension: 64 numbers reach the driver.
    rows = parts.groupBy("at").agg(F.avg(F.col("part").cast("double")).alias("part")).orderBy("at").collect()
    found = search.nearest_to(vectors, "embedding", [row["part"] for row in rows], "vec_id", 10)
    return found.withColumn("score", F.round("score", 6))


FUSED_SQL = f"""
{BM25_SQL}, {DENSE_SQL},
merged as (select query_id, doc_id, k.rank as keyword_rank, d.rank as dense_rank, k.score as keyword_score, d.score as vector_score,
  coalesce(1.0::double / (60 + k.rank), 0) + coalesce(1.0::double / (60 + d.rank), 0) as rrf_score
 from keyword k full join dense d using (query_id, doc_id)),
fused as (select *, row_number() over (partition by query_id order by round(rrf_score, 12) desc, doc_id) as rrf_rank
 from merged qualify rrf_rank <= 40),
hits as (select query_id, doc_id, round(least(greatest(coalesce(vector_score, keyword_score), 0), 1), 6) as score,
  keyword_rank, dense_rank, round(rrf_score, 8) as rrf_score, round(coalesce(keyword_score, 0), 6) as keyword_score,
  round(coalesce(vector_score, 0), 6) as vector_score from fused)
"""


def fused_hits(spark, sf) -> DataFrame:
    return search.fuse(keyword_hits(spark, sf), dense_hits(spark, sf))


def scored_hits(spark, sf) -> DataFrame:
    return search.hits(fused_hits(spark, sf), F.coalesce("vector_score", "keyword_score"))


@query(
    "rank_fusion",
    f"with {FUSED_SQL} select query_id, doc_id, cast(keyword_rank as integer) as keyword_rank, cast(dense_rank as integer) as dense_rank,"
    " round(rrf_score, 8) as rrf_score, cast(rrf_rank as integer) as rrf_rank from fused",
)
def rank_fusion(spark, sf):
    return fused_hits(spark, sf).select(
        "query_id", "doc_id", "keyword_rank", "dense_rank", F.round("rrf_score", 8).alias("rrf_score"), "rrf_rank"
    )


@query(
    "selected_hits",
    f"""with {FUSED_SQL} select query_id, doc_id, score, cast(keyword_rank as integer) as keyword_rank,
 cast(dense_rank as integer) as dense_rank, rrf_score, keyword_score, vector_score,
 cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) as rank
 from hits where score >= 0.55 qualify rank <= 20""",
)
def selected_hits(spark, sf):
    chosen = search.select_hits(scored_hits(spark, sf))
    return chosen.drop("rerank_score", "selection_reason", "source")


@query(
    "low_confidence_hits",
    f"""with {FUSED_SQL} select query_id, doc_id, score,
 cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) as rank from hits qualify rank <= 8""",
)
def low_confidence_hits(spark, sf):
    return search.low_confidence(scored_hits(spark, sf))


@query(
    "pinned_hits",
    f"""with {FUSED_SQL}, pinned as (select item_id as query_id, item_id as doc_id, true as mark from benchmark)
 select query_id, doc_id, case when mark then 1.0::double else score end as score, coalesce(rrf_score, 0) as rrf_score,
 case when mark then 'user_confirmed' else 'rerank_threshold' end as selection_reason
 from hits full join pinned using (query_id, doc_id)""",
)
def pinned_hits(spark, sf):
    pinned = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("item_id").alias("doc_id"))
    return search.pin(scored_hits(spark, sf), pinned).select("query_id", "doc_id", "score", "rrf_score", "selection_reason")


@query(
    "candidates_by_source",
    f"""with {BM25_SQL} select source, round(max(score), 6) as score, count(*) as field_count
 from keyword join documents using (doc_id) group by 1""",
)
def candidates_by_source(spark, sf):
    found = keyword_hits(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return search.table_candidates(found, ["source"]).withColumn("score", F.round("score", 6))


@query(
    "restricted_vector_search",
    f"""with allowed as (select doc_id as vec_id from labels where quality = 1),
 e as (select * from embeddings where vec_id in (select vec_id from allowed)),
 {DENSE_SQL.replace("from centres, embeddings", "from centres, e")}
 select query_id::bigint as query_id, doc_id, round(score, 6) as score, cast(rank as integer) as rank from dense""",
)
def restricted_vector_search(spark, sf):
    allowed = table(spark, sf, "labels").filter(F.col("quality") == 1).select(F.col("doc_id").alias("vec_id"))
    seen = search.restrict(table(spark, sf, "embeddings"), allowed, "vec_id")
    found = search.dense_search(seen, "vec_id", "embedding", centres(spark, sf), "query_id", "centre", DEPTH)
    return found.withColumn("score", F.round("score", 6))


@query(
    "retrieval_quality",
    f"""with {DENSE_SQL}, gold as (select label as query_id, vec_id as doc_id from embeddings),
 j as (select g.query_id, count(g.doc_id) as expected, count(d.rank) as hit, min(d.rank) as first
  from gold g left join dense d using (query_id, doc_id) group by 1)
 select count(*) as queries, round(avg(hit / expected), 4) as recall, round(avg(coalesce(1.0::double / first, 0)), 4) as mrr from j""",
)
def retrieval_quality(spark, sf):
    gold = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("query_id"), F.col("vec_id").alias("doc_id"))
    return search.mean_quality(search.retrieval_quality(gold, dense_hits(spark, sf)))


@query(
    "table_hit_rate",
    f"""with {DENSE_SQL}, gold as (select distinct label as query_id, label + step as table_id from embeddings, (values (0), (1)) s(step)),
 hit as (select distinct query_id, label as table_id from dense join embeddings on doc_id = vec_id)
 select g.query_id::bigint as query_id, round(count(h.table_id) / count(*), 4) as table_hit_rate
 from gold g left join hit h using (query_id, table_id) group by 1""",
)
def table_hit_rate(spark, sf):
    """Labels stand for tables: each query expects its own label and the next one among its hits."""
    labels = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("long").alias("table_id"))
    gold = labels.select(F.col("table_id").alias("query_id"), F.explode(F.array("table_id", F.col("table_id") + 1)).alias("table_id"))
    found = dense_hits(spark, sf).join(labels.withColumnRenamed("vec_id", "doc_id"), "doc_id")
    return search.table_hit_rate(gold, found).withColumn("table_hit_rate", F.round("table_hit_rate", 4))


@query(
    "part_documents",
    """select p_partkey, concat_ws(' ', p_name, p_brand, p_type, p_size) as keyword_text,
 left(sha256(to_json({'p0': p_partkey, 'p1': p_name, 'p2': p_brand, 'p3': p_type, 'p4': p_size})), 16) as content_hash,
 true as active from part""",
)
def part_documents(spark, sf):
    return search.build_documents(table(spark, sf, "part"), "p_partkey", ("p_name", "p_brand", "p_type", "p_size"))


@query(
    "customer_upsert",
    """select c.c_custkey, case when c_acctbal < 0 then 0.0 else c_acctbal end as c_acctbal,
 c_custkey in (select o_custkey from orders) as active from customer c""",
)
def customer_upsert(spark, sf):
    stored = table(spark, sf, "customer").select("c_custkey", "c_acctbal").withColumn("active", F.lit(True))
    changed = stored.filter(F.col("c_acctbal") < 0).withColumn("c_acctbal", F.lit(0.0))
    ordering = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    gone = stored.select("c_custkey").join(ordering, "c_custkey", "left_anti")
    return search.deactivate(search.upsert(stored, changed, "c_custkey"), gone, "c_custkey")
