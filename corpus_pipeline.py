"""Corpus pipeline: language ID, line dedup, near-duplicate removal, benchmark
decontamination and subword encoding, in this order, over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor
kept, and returns a DataFrame; all but the last return the columns of ``docs``. A
stage's result is written as Parquet and read again as the next one's documents. Rows
that repeat a doc_id are one document to every stage; a null doc_id is kept by each
stage that addresses documents by id; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from featurespark.functions.columns import unused
from featurespark.llm import decontaminate, jaccard_join, language_id, line_dedup, pieces
from featurespark.llm.shared import reach, stage

#: a prediction below this share of the code space is no language
LEAST_SCORE = 0.5
#: near duplicates: words of a shingle and per cent of similarity
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but those whose doc_id is among ``ids`` (doc_id)."""
    name = unused(docs.columns, "__id")
    return docs.join(ids.select(F.col("doc_id").alias(name)).distinct(), F.col("doc_id").cast("long") == F.col(name), "left_anti")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without text or letters, and those whose
    best language has too small a share, go."""
    found = language_id.identify(docs, language_id.learn(docs))
    unknown = (F.col("lang_pred") == language_id.UNKNOWN) | (F.col("score") < LEAST_SCORE)
    return _without(docs, found.where(unknown)).where(F.col("text").isNotNull())


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated line windows; a document all of whose lines repeat goes.
    ``n_chars`` follows the text where it changed."""
    out = line_dedup.dedup_lines(docs)
    n_lines, n_removed = (F.col(c) for c in out.columns[-2:])
    out = out.where((n_removed < n_lines) | (n_lines == 0))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(n_removed > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of near duplicates the document with the smallest id."""
    linked = jaccard_join.link_components(docs, NEAR_SHINGLE, NEAR_PERCENT)
    return _without(docs, linked.where("doc_id <> component_id"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, n_bytes and round_trip of every document."""
    return pieces.encode_documents(docs, pieces.PieceModel())


STAGES = [
    ("language_id", keep_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", keep_one_of_near),
    ("decontamination", drop_benchmark),
    ("sentencepiece", encode_pieces),
]

#: a trained model and a piece model decide, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    reach(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, f"pipeline-{name}")
    return docs
