"""Registered queries against their SQL or brute force on the smallest tables, and the pipeline stage by stage."""

import corpus_pipeline
import pytest
import sentencepiece
from cases import near_components, repeats_removed, sha
from compare_oracles import connect, differences
from pyspark.sql import functions as F

from tidemark.llm import minhash, pieces, quality, queries
from tidemark.session import table


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, tiny, name):
    problem, rows = differences(spark, connect(tiny), tiny, name, queries.QUERIES, queries.ORACLES)
    assert problem == ""
    assert rows > 0


def rows_of(spark, sf):
    return [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]


def test_near_dedup_query(spark, tiny):
    got = queries.QUERIES["op5_minhash_near_dedup"](spark, tiny).collect()
    wanted = near_components(rows_of(spark, tiny), 3, 85)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == wanted
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_suffix_dedup_query(spark, tiny):
    rows = rows_of(spark, tiny)
    got = queries.QUERIES["op8_suffix_dedup"](spark, tiny).collect()
    assert sorted(tuple(r) for r in got) == repeats_removed(rows, {t or "": 0 for _, t in rows})


def test_piece_query(spark, tiny):
    library = sentencepiece.SentencePieceProcessor(model_file=__import__("public_tokenizers").path(queries.PIECE_MODEL))
    got = {r.doc_id: r for r in queries.QUERIES["op7_sentencepiece_round_trip"](spark, tiny).collect()}
    for i, text in rows_of(spark, tiny):
        ids = library.encode(text or "")
        assert tuple(got[i]) == (i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_secret_query(spark, tiny):
    from test_text_operators import brute_spans

    got = {r.doc_id: r for r in queries.QUERIES["op9_secret_scan"](spark, tiny).collect()}
    for i, text in rows_of(spark, tiny):
        spans = brute_spans(text or "")
        counts = tuple(sum(s[0] == kind for s in spans) for kind in ("assign", "access", "hex"))
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == counts
        assert got[i].base_sha256 == sha(",".join(f"{k}:{s}:{e}" for k, s, e in spans))


def test_mixing_query_is_whole(spark, tiny):
    got = queries.QUERIES["op1_mixing_sources"](spark, tiny)
    total = got.agg(F.count("*"), F.sum("size")).first()
    assert total[0] == len(rows_of(spark, tiny))
    targets = {r.source: r.target for r in got.select("source", "target").distinct().collect()}
    assert sum(targets.values()) == pytest.approx(total[1])


def test_quality_query_parts_clean_from_the_rest(spark):
    folder = "/root/testdata/sf0.01"
    marks = table(spark, folder, "labels")
    got = queries.QUERIES["op6_quality_classifier"](spark, folder).join(marks, "doc_id")
    clean = got.where("quality = 1 and toxic = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    poor = got.where("quality = 0 or toxic = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert clean > 0.97
    assert poor < 0.4


def test_quality_of_held_out_marks(spark):
    """Fitted on the marks of even ids; of the others, clean, poor and toxic documents are counted apart."""
    folder = "/root/testdata/sf0.1"
    marks, docs = table(spark, folder, "labels"), table(spark, folder, "documents")
    scored = quality.score_marks(docs, marks.where("doc_id % 2 = 0"))
    kept = scored.select("doc_id", quality.keep_clean(scored).cast("int").alias("stays")).join(marks.where("doc_id % 2 = 1"), "doc_id")
    kind = F.expr("case when quality = 0 then 'poor' when toxic = 1 then 'toxic' else 'clean' end").alias("kind")
    rates = {r.kind: r.rate for r in kept.groupBy(kind).agg(F.avg("stays").alias("rate")).collect()}
    assert rates["clean"] > 0.98, rates
    assert rates["poor"] < 0.04, rates
    assert rates["toxic"] < 0.15, rates


def test_pipeline_stage_by_stage(spark, tiny, tmp_path):
    docs = table(spark, tiny, "documents")
    columns, kept = docs.columns, {}
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tiny)
        out.write.parquet(str(tmp_path / str(at)))
        kept[name], docs = docs, spark.read.parquet(str(tmp_path / str(at)))
        assert docs.count() > 0
        if at < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    # Near-dedup: one of each group of its own input.
    rows = [(r.doc_id, r.text) for r in kept["MinHash near-dedup"].collect()]
    wanted = {i for i, _, c in near_components(rows, 5, 80) if i == c}
    assert {r.doc_id for r in kept["mixing sources"].collect()} == wanted
    # Encoding: what the mix has emitted, repeats counted, as the library does it.
    library = sentencepiece.SentencePieceProcessor(model_file=__import__("public_tokenizers").path(corpus_pipeline.PIECE_MODEL))
    mixed = sorted((r.doc_id, r.text) for r in kept["SentencePiece encoding"].collect())
    final = sorted((r.doc_id, r.text, r.ids) for r in docs.collect())
    assert [(i, t) for i, t, _ in final] == [(i, library.decode(library.encode(t))) for i, t in mixed]
    assert all(ids == library.encode(text) for (_, text), (_, _, ids) in zip(mixed, final, strict=True))
    assert minhash.BANDS == 32 and pieces.PASS_CHARS > 0


def test_pipeline_of_no_documents(spark, tiny):
    docs = table(spark, tiny, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tiny)
    assert docs.count() == 0
