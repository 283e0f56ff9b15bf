"""The corpus pipeline: documents pass its stages in order; each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import exact_dedup, mixing, ngram_join, piece_bpe, quality_knn
from spanloom.llm.common import discard, stored, table, tidy
from spanloom.llm.queries import piece_model


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not reject."""
    return quality_knn.good(docs, quality_knn.fit(docs, table(spark, sf_dir, "labels")))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones: five words, a similarity of 0.8 or more."""
    return ngram_join.one_of_each(docs, words=5, numerator=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; a document that is taken twice comes twice."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix: doc_id, n_tokens and digests of ids and of the decoded text."""
    return piece_bpe.encoded(docs, piece_model(), digests=True)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing sources", mix),
    ("SentencePiece encoding", encode),
]
#: Neither the classifier nor the tokenizer can be written in SQL.
ORACLE_SQL = None


@tidy
def _kept(spark: SparkSession, docs: DataFrame, sf_dir: str, stage) -> DataFrame:
    """What a stage keeps, as a table; what it stored on the way is deleted."""
    return stored(stage(spark, docs, sf_dir), "stage", keep=True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    for _, stage in first:
        before, docs = docs, _kept(spark, docs, sf_dir, stage)
        discard(before)
    return last(spark, docs, sf_dir)
