"""Token counts from an exact histogram of lengths.

Documents are aggregated by encoded length; every length that occurs is one row. Sums over the lengths above and
below a row answer, for that length as context limit: how many documents fit, all tokens if longer ones are cut
there, and the share of documents up to it, whose first row at or over q is the q-quantile. Limits that do not
occur lie on the line between their neighbours, so the table answers them too (truncated_total).

Defined cases: null and empty texts have length 0; no rows give no rows. Repeated rows count each. Texts of any length
are encoded whole. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm import piece_bpe
from spanloom.llm.common import stored, tidy

#: Lengths in one block of running sums.
BLOCK = 1024


def histogram(lengths: DataFrame) -> DataFrame:
    """lengths: n_tokens. Returns length, n_docs."""
    return lengths.groupBy(F.col("n_tokens").cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))


def limits(counts: DataFrame) -> DataFrame:
    """counts: length, n_docs. Returns for each length, as a limit: n_docs of just that length, docs_over and
    tokens_over (documents longer than it and their tokens), total (tokens with every document cut at the limit)
    and share (of documents up to it). Sums run within blocks of lengths and over the few blocks."""
    block = F.floor(F.col("length") / BLOCK)
    rows = counts.withColumn("block", block).withColumn("tokens", F.col("length") * F.col("n_docs"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum("tokens").alias("words"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("docs").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("words").over(after), F.lit(0)).alias("words_after"),
        F.sum("docs").over(every).alias("all_docs"),
        F.sum("words").over(every).alias("all_words"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("docs_in", F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).withColumn("words_in", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    over, words = F.col("docs_in") + F.col("docs_after"), F.col("words_in") + F.col("words_after")
    return rows.join(blocks, "block").select(
        "length",
        "n_docs",
        over.alias("docs_over"),
        words.alias("tokens_over"),
        (F.col("all_words") - words + F.col("length") * over).alias("total"),
        ((F.col("all_docs") - over) / F.col("all_docs")).alias("share"),
    )


def truncated_total(table: DataFrame, limit: int) -> int:
    """All tokens when every document is cut at any limit, from a limits() table."""
    row = table.filter(F.col("length") <= limit).orderBy(F.desc("length")).select("length", "total", "docs_over").first()
    if row:
        return row.total + (limit - row.length) * row.docs_over
    return limit * (table.agg(F.sum("n_docs")).first()[0] or 0)


def quantile(table: DataFrame, q: float) -> int | None:
    """The shortest length that at least a share q of all documents does not exceed."""
    return table.filter(F.col("share") >= q).agg(F.min("length")).first()[0]


@tidy
def token_counts(docs: DataFrame, model: bytes) -> DataFrame:
    """docs: doc_id, text. The limits() table of the texts' encoded lengths."""
    counts = histogram(piece_bpe.encoded(docs, model, ids=False, decoded=False).select("n_tokens"))
    return limits(stored(counts, "token-lengths", keep=True))
