"""Exact dedup over an extendible-hash index kept in shared files.

Every text gets a 64-bit key. A directory over the leading bits of the keys is doubled until no bucket holds
more text than one owner task should read. Map tasks collapse equal texts before anything moves, so a text sends
one entry per map task however often it occurs. An owner task gets whole buckets, that is ranges of keys, in key
order; entries with one key are chained and told apart by their bytes. Entries of hot keys, of which there are at most
HOT, are first dealt over several owners by where they come from, so that each reads a share of the copies; what is
left of them, one entry an owner, is chained once more. What the owners find is written as index pages to the shared
folder, and documents look their group up there.

Defined cases: null text counts as empty, and empty texts are copies of each other. Texts of any length are compared
whole. A null doc_id never beats another one; a group of nulls only has keep_id null. Just one row of a group is kept: of
several with the largest doc_id the one whose text as written hashes least, of rows that repeat that too any one. All
rows count towards group_size. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import HOT, joined_apart, one_each, slices, stored, text_bytes, text_key, tidy

#: Text that a bucket holds before it is split, and the most bits of a directory (a million buckets).
BUCKET_BYTES = 8 << 20
MAX_DEPTH = 20
#: A map task collapses equal texts within about this much text.
COLLAPSE_BYTES = 32 << 20

#: Owner tasks; with more buckets each gets several.
MOST_TASKS = 20_000

DIGEST = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("key", pa.int64()), ("sha", pa.binary()), ("n_bytes", pa.int64())])
ENTRY = pa.schema([("lane", pa.int32()), ("hot", pa.bool_()), ("key", pa.int64()), ("sha", pa.binary()), ("keep_id", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])
PAGE = pa.schema([("hot", pa.bool_()), ("key", pa.int64()), ("sha", pa.binary()), ("keep_id", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])


def key_of(body: bytes) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(body), "big", signed=True)


def larger(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


class Directory:
    """Slot i is the bucket of the keys whose leading `depth` bits are i (as an unsigned number)."""

    def __init__(self, depth: int, slots: np.ndarray):
        self.depth, self.slots = depth, slots

    @classmethod
    def grown(cls, weights: np.ndarray, capacity: int) -> Directory:
        """weights: what the keys of each slot weigh at the finest depth allowed, a power of two of them."""
        finest = len(weights).bit_length() - 1
        below = np.concatenate([[0], np.cumsum(weights)])
        leaves, todo = [], [(0, 0)]
        while todo:
            depth, prefix = todo.pop()
            wide = 1 << (finest - depth)
            if depth < finest and below[(prefix + 1) * wide] - below[prefix * wide] > capacity:
                todo += [(depth + 1, 2 * prefix + 1), (depth + 1, 2 * prefix)]
            else:
                leaves.append((depth, prefix))
        depth = max(d for d, _ in leaves)  # each split of a bucket at full depth doubled the directory
        slots = np.empty(1 << depth, np.int32)
        for bucket, (d, prefix) in enumerate(leaves):
            slots[prefix << (depth - d) : (prefix + 1) << (depth - d)] = bucket
        return cls(depth, slots)

    def bucket(self, key: int) -> int:
        return int(self.slots[(key & (1 << 64) - 1) >> (64 - self.depth)]) if self.depth else 0

    @property
    def buckets(self) -> int:
        return int(self.slots[-1]) + 1


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bodies = [x.lower() for x in text_bytes(batch.column(1))]  # bytes.lower() changes A-Z only
        yield pa.record_batch([
            batch.column(0),
            batch.column(2),
            pa.array([key_of(x) for x in bodies], pa.int64()),
            pa.array([hashlib.sha256(x).digest() for x in bodies], pa.binary()),
            pa.array([len(x) for x in bodies], pa.int64()),
        ], schema=DIGEST)


def _lane(index: Directory, tasks: int, key: int, hot: bool) -> int:
    """The owner of a key: buckets are dealt in ranges. Hot keys have about as many owners as the root of all."""
    if not hot:
        return index.bucket(key) * tasks // index.buckets
    return (key + TaskContext.get().partitionId() % math.isqrt(tasks)) % tasks


def _entries(known, tasks: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hot = known.value
        held: dict[bytes, list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            keys = [key_of(x) for x in held]
            return pa.record_batch([
                pa.array([_lane(index, tasks, k, k in hot) for k in keys], pa.int32()),
                pa.array([k in hot for k in keys], pa.bool_()),
                pa.array(keys, pa.int64()),
                pa.array([hashlib.sha256(x).digest() for x in held], pa.binary()),
                pa.array([x[0] for x in held.values()], pa.int64()),
                pa.array([x[1] for x in held.values()], pa.int64()),
                pa.array(list(held), pa.binary()),
            ], schema=ENTRY)

        for batch in batches:
            for piece in slices(batch, "text"):
                for doc, body in zip(piece.column(0).to_pylist(), text_bytes(piece.column(1))):
                    body = body.lower()
                    if got := held.get(body):
                        got[0], got[1] = larger(got[0], doc), got[1] + 1
                    else:
                        held[body] = [doc, 1]
                        size += len(body)
                if size > COLLAPSE_BYTES:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    return run


def _pages(last: bool) -> object:
    """Entries come in order of their keys; chain: the different texts of the current key. What is left of hot ones goes
    on with its text, unless this is the last look at them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chain, out = None, [], []

        def close() -> None:
            out.extend((hot and not last, at, sha, keep, n, body if hot and not last else None) for body, sha, keep, n, hot in chain if n > 1 or hot and not last)

        def page() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * len(PAGE)
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, PAGE)], schema=PAGE)

        for batch in batches:
            hots, keys, shas, keeps, counts, bodies = (batch.column(f.name) for f in PAGE)
            for i, key in enumerate(keys.to_pylist()):
                if key != at:
                    close()
                    at, chain = key, []
                body = bodies[i].as_py()
                for link in chain:
                    if link[0] == body:
                        link[2], link[3] = larger(link[2], keeps[i].as_py()), link[3] + counts[i].as_py()
                        break
                else:
                    chain.append([body, shas[i].as_py(), keeps[i].as_py(), counts[i].as_py(), hots[i].as_py()])
            if out:
                yield page()
                out.clear()
        close()
        yield page()

    return run


_PAGE = "hot boolean, key long, sha binary, keep_id long, n long, body binary"


@tidy
def _judged(docs: DataFrame, bucket_bytes: int, max_depth: int) -> DataFrame:
    """doc_id, text_key, sha, keep_id, n and kept for each row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    log = docs.select("doc_id", "text", text_key().alias("text_key")).mapInArrow(_digests, "doc_id long, text_key long, key long, sha binary, n_bytes long")
    log = stored(log.withColumn("row_id", F.monotonically_increasing_id()), "dedup-log")

    per_key = log.groupBy("key").agg(F.max("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n"))
    per_key = stored(per_key, "dedup-keys")
    total, n_keys, n_rows = per_key.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    finest = min(max_depth, max(1, (total // bucket_bytes).bit_length() + 4))
    slot = F.shiftrightunsigned("key", 64 - finest).alias("slot")
    weights = np.zeros(1 << finest, np.int64)
    if n_keys:
        by_slot = per_key.groupBy(slot).agg(F.sum("n_bytes").alias("w")).toArrow()  # 2 ** max_depth rows at most, as arrays
        weights[by_slot["slot"].to_numpy()] = by_slot["w"].to_numpy()
    directory = Directory.grown(weights, bucket_bytes)
    hot = per_key.filter((F.col("n") > 1) & (F.col("n") * HOT > F.lit(n_rows))).select("key").toArrow()  # fewer than HOT rows

    tasks = min(directory.buckets, MOST_TASKS)
    known = spark.sparkContext.broadcast((directory, frozenset(hot["key"].to_pylist())))  # 4 bytes a slot
    entries = docs.mapInArrow(_entries(known, tasks), "lane int, hot boolean, key long, sha binary, keep_id long, n long, body binary")
    owned = entries.repartitionById(tasks, "lane").sortWithinPartitions("key").drop("lane")
    pages = stored(owned.mapInArrow(_pages(last=False), _PAGE), "dedup-pages")
    rest = pages.filter("hot").repartition("key").sortWithinPartitions("key").mapInArrow(_pages(last=True), _PAGE)
    pages = stored(pages.filter("not hot").unionByName(rest).select("key", "sha", "keep_id", "n"), "dedup-groups")

    rows = joined_apart(log.drop("n_bytes"), pages, ["key", "sha"], pages, n_rows, "left")
    one = F.col("n").isNull()
    rows = rows.withColumns({"keep_id": F.when(one, F.col("doc_id")).otherwise(F.col("keep_id")), "n": F.coalesce("n", F.lit(1))})
    rows = stored(rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))), "dedup-rows", keep=True)
    # Of rows that share text and largest doc_id one is kept.
    twins = rows.filter("kept and n > 1").groupBy("key", "sha").agg(F.count(F.lit(1)).alias("same"), F.min(F.struct("text_key", "row_id")).alias("first"))
    twins = stored(twins.filter("same > 1").select("key", "sha", "same", F.col("first.row_id").alias("first_row")), "dedup-twins", keep=True)
    if twins.head(1):  # only rows that have the largest doc_id of their text are looked at again
        last = joined_apart(rows.filter("kept and n > 1"), twins.drop("same"), ["key", "sha"], twins.withColumnRenamed("same", "n"), n_rows, "left")
        rows = last.unionByName(rows.filter("not (kept and n > 1)"), allowMissingColumns=True)
        rows = stored(rows.withColumn("kept", F.col("kept") & (F.col("row_id") == F.coalesce("first_row", "row_id"))), "dedup-last", keep=True)
    return rows.select("doc_id", "text_key", "sha", "keep_id", "n", "kept")


def exact_dedup(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, keep_id, group_size, kept, text_sha256 for each row."""
    rows = _judged(docs, bucket_bytes, max_depth)
    return rows.select("doc_id", "keep_id", F.col("n").cast("long").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256"))


@tidy
def without_copies(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row of each group of equal texts, the one that exact_dedup keeps, with all its columns."""
    own = _judged(docs, bucket_bytes, max_depth).filter("n > 1").groupBy(F.col("doc_id").alias("id"), "text_key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("same"))
    own = stored(own, "dedup-copies", keep=True)
    return one_each(docs, own.filter("not kept").select("id", "text_key"), own.filter("kept and same > 1").select("id", "text_key"))


SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
g AS (SELECT doc_id, body, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
  row_number() OVER (PARTITION BY body ORDER BY doc_id DESC NULLS LAST) AS nth FROM t)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(body) AS text_sha256 FROM g
"""
