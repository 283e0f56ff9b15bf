"""The queries of the corpus operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import ball_tree, chat, exact_dedup, mixing, ngram_join, pii, piece_bpe, quality_knn, quality_rules, substring_dedup, token_counts, url_filters, vector_codes
from spanloom.llm.common import table


def piece_model() -> bytes:
    """The model file of the public 32k tokenizer; operators take any other path's bytes."""
    import public_tokenizers

    return piece_bpe.read_model(public_tokenizers.path("piece_bpe_32k.model"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.verdicts(quality_rules.ledger(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_knn.scored(docs, quality_knn.fit(docs, table(spark, sf_dir, "labels")))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encoded(table(spark, sf_dir, "documents"), piece_model(), digests=True)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), piece_model())


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = spark.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(fixed)
    return chat.read_digests(chat.formatted(rows.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op11_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.clusters(table(spark, sf_dir, "embeddings"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judged(table(spark, sf_dir, "pages"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


QUERIES = (op1_mixing, op2_quality_rules, op3_quality_classifier, op4_sentencepiece, op5_pii, op6_token_counts, op7_chat_formatting, op8_substring_dedup, op9_ngram_join, op10_exact_dedup, op11_ball_tree, op12_url_filters, op13_vector_codes)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.SQL, "op2_quality_rules": quality_rules.SQL, "op7_chat_formatting": chat.SQL, "op10_exact_dedup": exact_dedup.SQL, "op11_ball_tree": ball_tree.SQL, "op12_url_filters": url_filters.SQL, "op13_vector_codes": vector_codes.SQL}
