"""Quality rules as a ledger of bits.

One pass over the texts takes all measurements and evaluates every rule once; the ledger keeps the measurements
and one bit for each rule that fails. A policy is a version and the rules that it counts; verdicts and ablations
under any policy come from the bits alone, by bitwise operations and aggregation, without another look at a text.

Words are maximal runs without space and the controls 9 to 13. Base rules: `short` (under 50 words) and `repeats`
(over half of the words lie in a 3-word window that occurs twice or more in the text).

Defined cases: null text counts as empty: all measurements are 0 and `short` fails. Ratios are compared without
division, so that no rule of ratios fails for a text without words. Texts of any length are measured whole, one at a
time. Repeated rows are judged alike. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import slices, text_bytes

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower", "n_marks")

#: A rule names what fails, over measurements; written so that Spark columns, SQL and numpy all read it alike.
RULES: tuple[tuple[str, str], ...] = (
    ("short", "n_words < 50"),
    ("repeats", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 2 * n_words"),
    ("dup_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("capitals", "n_upper > n_lower"),
    ("marks", "10 * n_marks > 3 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


POLICIES = (Policy("base", ("short", "repeats")), Policy("2024.1", tuple(BIT)))
CURRENT = POLICIES[-1]


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n + 2)
    pairs = ids[:-1] * len(seen) + ids[1:]
    if len(seen) > 1 << 20:  # three numbers of 21 bits would not fit
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:n] * len(seen) + ids[2:]
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    often = counts[which] > 1
    covered = np.zeros(n + 2, bool)
    for k in range(3):
        covered[k : n + k] |= often
    return int(covered.sum())


def measured(body: bytes) -> tuple[int, ...]:
    """MEASURES of one text in UTF-8."""
    words = body.split()
    counts = np.bincount(np.frombuffer(body, np.uint8), minlength=256)
    space = counts[32] + counts[9:14].sum()
    lines = [x for x in body.split(b"\n") if x and not x.isspace()]
    return (
        len(words),
        int(len(body) - counts[128:192].sum() - space),  # bytes that continue a character don't count
        int(counts[list(b"#*$%&|<>")].sum()),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        int(counts[65:91].sum()),
        int(counts[97:123].sum()),
        int(counts[list(b"!?")].sum()),
    )


def _failures(values: dict[str, np.ndarray]) -> np.ndarray:
    bits = np.zeros(len(values["n_words"]), np.int64)
    for name, fails in RULES:
        bits |= np.where(eval(fails, {"__builtins__": {}}, values), BIT[name], 0)  # noqa: S307  fixed expressions above
    return bits


def _ledger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, "text"):
            rows = np.array([measured(x) for x in text_bytes(piece.column(1))], np.int64).reshape(-1, len(MEASURES))
            values = {m: rows[:, i] for i, m in enumerate(MEASURES)}
            columns = [piece.column(0), *(pa.array(values[m]) for m in MEASURES), pa.array(_failures(values))]
            yield pa.record_batch(columns, names=["doc_id", *MEASURES, "failed"])


def ledger(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, MEASURES and failed (a bit for each rule that fails) for each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_ledger, ", ".join(f"{c} long" for c in ("doc_id", *MEASURES, "failed")))


def fails(policy: Policy) -> Column:
    return F.col("failed").bitwiseAND(F.lit(policy.mask)) != 0


def verdicts(book: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """A ledger with base_failed, kept and the policy's version."""
    return book.withColumns({"base_failed": fails(POLICIES[0]), "kept": ~(fails(POLICIES[0]) | fails(policy)), "policy": F.lit(policy.version)})


def ablations(book: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """For each policy and rule of it: documents, kept ones, how many fail the rule, how many fail nothing else, and
    how many would be kept without it. The ledger is first counted by its bits, which leaves 2 ** rules rows at most."""
    by_bits = book.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    spark = book.sparkSession
    cases = spark.createDataFrame([(p.version, p.mask, r, BIT[r]) for p in policies for r in p.rules], "policy string, mask long, rule string, bit long")
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    number = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0)).alias
    return (
        by_bits.join(F.broadcast(cases), F.lit(True), "inner")  # a few rows by policy on one side
        .groupBy("policy", "rule")
        .agg(F.sum("n").alias("n_docs"), number(hit == 0)("kept"), number(F.col("failed").bitwiseAND(F.col("bit")) != 0)("failing"), number(hit == F.col("bit"))("alone"), number(hit.bitwiseAND(F.bitwise_not("bit")) == 0)("kept_without"))
    )


def combined(book: DataFrame, by: str) -> DataFrame:
    """Over the groups of a column of the ledger: bits that some document fails, and bits that all fail."""
    return book.groupBy(by).agg(F.bit_or("failed").alias("some_fail"), F.bit_and("failed").alias("all_fail"))


_BITS = " + ".join(f"CASE WHEN {rule} THEN {BIT[name]} ELSE 0 END" for name, rule in RULES)
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines FROM d),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS n FROM w, unnest(range(1, len(words) - 1)) AS u(i) WHERE len(words) > 2),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  len(regexp_extract_all(text, '[A-Z]')) AS n_upper, len(regexp_extract_all(text, '[a-z]')) AS n_lower, len(regexp_extract_all(text, '[!?]')) AS n_marks FROM w LEFT JOIN c USING (r)),
f AS (SELECT *, ({_BITS})::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {POLICIES[0].mask}) != 0 AS base_failed, (failed & {POLICIES[0].mask | CURRENT.mask}) = 0 AS kept, failed FROM f
"""
