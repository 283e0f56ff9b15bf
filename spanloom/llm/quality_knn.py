"""Quality classifier: the nearest labelled documents vote.

A document becomes a row of terms: its byte bigrams (hashed) and a few about repetition, each the square root of a
share. Labelled rows, weighted by rarity, are projected on their leading singular directions; these latent vectors
and their labels are the model, which is broadcast (its size is fixed by the parameters, not by the data). Every
document is projected alike, its cosine with every labelled vector is computed exactly, block by block, and the
labels of the nearest ones are averaged with their similarities (to a power) as weights.

The labelled rows to fit are a bounded sample: the `per_class` ones of each class that come first by a hash of
their id. Whole texts are read, and neither ids nor other columns enter a score.

Cosines are computed in double precision and rounded to 9 decimals, so that a score does not depend on how rows are
batched. Of labelled rows with equal cosines those with the smaller doc_id come first among the nearest.

Defined cases: null text counts as empty. Empty texts have no bigrams and are scored by what is left, which makes
them alike. With one class only its label is the score; without labels the score is 0.5. Labels other than 0 and 1
and null ones are ignored before anything else; a doc_id labelled both 0 and 1 counts as 1. Of several texts of one
doc_id the fit uses the smallest one (null first). A null doc_id counts as held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import lean, slices, text_bytes

BIGRAMS = 1024
TERMS = BIGRAMS + 4
DIMENSIONS = 64
PER_CLASS = 1500
NEIGHBOURS = 9
POWER = 4
THRESHOLD = 0.3
BLOCK = 256
_SLOT = ((np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)  # 10 bits of a product hash


def features(body: bytes) -> np.ndarray:
    """TERMS of one text in UTF-8."""
    out = np.zeros(TERMS, np.float32)
    codes = np.frombuffer(body, np.uint8).astype(np.int64)
    if len(codes) > 1:
        counts = np.bincount(_SLOT[codes[:-1] * 256 + codes[1:]], minlength=BIGRAMS)
        out[:BIGRAMS] = np.sqrt(counts / counts.sum())
    words = body.split()
    if n := len(words):
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
        out[BIGRAMS] = np.sqrt(1 - len(seen) / n)
        out[BIGRAMS + 3] = 1 / np.sqrt(n)
        if n > 1:
            pairs = ids[:-1] * len(seen) + ids[1:]
            out[BIGRAMS + 1] = np.sqrt(1 - len(np.unique(pairs)) / (n - 1))
            out[BIGRAMS + 2] = np.sqrt((ids[:-1] == ids[1:]).mean())
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    project: np.ndarray  # TERMS x dimensions, rarity weights included
    vectors: np.ndarray  # labelled latent vectors of length 1
    labels: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Of a block of feature rows."""
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        n = len(self.labels)
        cosines = np.round(_unit(rows @ self.project) @ self.vectors.T, 9)
        k = min(NEIGHBOURS, n)
        # Whole numbers that are larger for larger cosines and, among equals, for the rows that come first.
        rank = (cosines * 1e9).round().astype(np.int64) * n + np.arange(n - 1, -1, -1)
        near = np.argpartition(-rank, k - 1, axis=1)[:, :k] if k < n else np.broadcast_to(np.arange(n), rank.shape)
        near = np.sort(near, axis=1)
        weights = np.clip(np.take_along_axis(cosines, near, 1), 1e-6, None) ** POWER
        return np.round(np.clip((weights * self.labels[near]).sum(1) / weights.sum(1), 0, 1), 9)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, dimensions: int = DIMENSIONS) -> Model:
    """docs: doc_id, text; labels: doc_id, quality. Only rows that are not held out are used."""
    rows = labels.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col("quality").try_cast("double").alias("quality"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0.0, 1.0) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    first = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = rows.filter("quality = 0").orderBy(*first).limit(per_class).unionByName(rows.filter("quality = 1").orderBy(*first).limit(per_class))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(some), "doc_id")  # 2 * per_class rows at most
    texts = texts.groupBy("doc_id", "quality").agg(F.min(F.struct("text")).alias("text")).select("doc_id", "quality", "text.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                found = [features(x).tobytes() for x in text_bytes(piece.column(2))]
                yield pa.record_batch([piece.column(0), piece.column(1), pa.array(found, pa.binary())], names=["doc_id", "quality", "terms"])

    sample = sorted(texts.mapInArrow(run, "doc_id long, quality int, terms binary").collect())
    x = np.array([np.frombuffer(r.terms, np.float32) for r in sample], np.float64).reshape(-1, TERMS)
    y = np.array([r.quality for r in sample], np.float64)
    if not len(y):
        return Model(np.zeros((TERMS, 0)), np.zeros((0, 0)), y)
    rare = np.log1p(len(x) / (1 + (x > 0).sum(0)))
    values, directions = np.linalg.eigh((x * rare).T @ (x * rare))
    leading = directions[:, np.argsort(values)[::-1][:dimensions]]
    project = rare[:, None] * leading
    return Model(project, _unit(x @ project), y)


def _blocks(batch: pa.RecordBatch, at: int, model: Model) -> np.ndarray:
    out = [np.zeros(0)]
    bodies = text_bytes(batch.column(at))
    for k in range(0, len(bodies), BLOCK):
        out.append(model.scores(np.array([features(x) for x in bodies[k : k + BLOCK]])))
    return np.concatenate(out)


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, held_out, score, predicted for each row."""
    lean(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                found = _blocks(piece, 1, known.value)
                yield pa.record_batch([piece.column(0), pa.array(found), pa.array(np.where(found >= threshold, 1, 0), pa.int32())], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(run, "doc_id long, score double, predicted int")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least the threshold, with all their columns; one pass, no join."""
    lean(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                yield piece.filter(pa.array(_blocks(piece, at, known.value) >= threshold))

    return docs.mapInArrow(run, docs.schema)
