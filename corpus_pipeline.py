"""A corpus pipeline of five operators, each over all that the one before has kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import lines, minhash, mixing, pieces, quality
from tidemark.session import cut_lineage, table

#: Name of the tokenizer file, looked up beside the installed tokenizers.
PIECE_MODEL = "piece_bpe_32k.model"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on the rated documents among ``docs``; keeps what is most likely of the highest grade and not toxic."""
    scored = quality.score_marks(docs, table(spark, sf_dir, "labels"))
    return scored.where(quality.keep_clean(scored)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines stay in one document; ``n_chars`` follows the text."""
    return _sized(lines.dedup_lines(docs).drop("n_lines", "n_dropped"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words a shingle, similarity of 0.8 and more; the smallest id of each group stays."""
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of a document as the mix takes copies."""
    return mixing.emit(mixing.mix(docs), docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, the text that they decode to, and their number."""
    with open(public_tokenizers.path(PIECE_MODEL), "rb") as file:
        model = file.read()
    done = pieces.round_trip(docs.select("doc_id", "lang", "source", "text"), model)
    return done.select("doc_id", "lang", "source", F.col("decoded").alias("text"), "ids", F.size("ids").cast("long").alias("n_tokens"))


def _sized(changed: DataFrame, docs: DataFrame) -> DataFrame:
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.char_length("text").cast("long"))
    return changed.select(*docs.columns)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", tokenize),
]
#: Fitted weights, near duplicates and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
