"""Substring dedup by seed and extend.

Words are hashed, and of every `least` consecutive words (a window) the smallest hash of `seed` consecutive ones is
its anchor, the first of equals. A window fixes its anchor, so equal windows meet at equal anchors (winnowing), and
the windows of one anchor form a segment around it. Documents are joined on anchors; those that occur once are done.
A match is extended both ways in two steps: occurrences whose whole segments agree match in all windows of the
segment; where an anchor has different segments, one document for each hashes the windows around the anchor, and
windows that agree give how far a match extends to the left and to the right of the anchor: each run of them is an extent,
from the first to the last window. Extents of one document that touch, over all of its anchors, are joined to its maximal
repeats of at least `least` words. A window may have any number of words.

Segments and windows are compared by 128 hash bits. No pairs are formed: every step is an aggregation or a join on
a key, so a passage that a third of all documents share costs a row for each of them; the rows of the hottest anchors
and segments are joined by broadcast (common.joined_apart), so no task gets them all. Texts move only where they
are needed (a bitmap of fixed most size says which may be), keyed by their content, so copies move once a task.

Defined cases: null text counts as empty. Texts under `least` words keep all words. Rows that repeat doc_id, or
doc_id and text, are documents of their own, so a repeated row matches its twin. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Bitmap, joined_apart, key_bitmap, slices, stored, text_bytes, tidy

LEAST = 35
SEED = 8
#: Word hashes that a worker remembers before it starts anew.
KNOWN_WORDS = 300_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
EMPTY = hashlib.sha256(b"").digest()


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = got = xxhash.xxh3_64_intdigest(word)
        return got


_KNOWN = WordHashes()


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2 ** 64, for i up to n."""
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    one = np.ones(1, np.uint64)
    return tuple(np.multiply.accumulate(np.concatenate([one, np.full(n, b, np.uint64)])) for b in (base, inverse))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(29))


class Sequences:
    """Hashes of any runs of words in one go, from prefix sums."""

    def __init__(self, words: list[bytes], base: np.uint64 = _A):
        self.n = len(words)
        codes = np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, self.n)
        self.up, self.down = _powers(base, self.n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * self.up[:-1], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def segments(words: list[bytes], offsets: np.ndarray, least: int, seed: int) -> tuple[np.ndarray, ...]:
    """Over texts in a row, whose words start at offsets: for each segment its anchor's key, the key of all its
    words, its first window and one past its last, as places in `words`."""
    none = np.zeros(0, np.int64)
    n = len(words)
    if n < least:
        return none, none, none, none
    hashes = Sequences(words)
    at = np.arange(n - seed + 1)
    seeds = _mixed(hashes.of(at, at + seed))
    span = least - seed + 1  # seeds in a window
    bits = int(n).bit_length()
    low = np.uint64((1 << bits) - 1)
    best, have = (seeds & ~low) | at.astype(np.uint64), 1  # the place breaks ties, leftmost first
    while have < span:
        step = min(have, span - have)
        best = np.minimum(best[: len(best) - step], best[step:])
        have += step
    inside = np.zeros(n, bool)
    for start, end in zip(offsets[:-1], offsets[1:]):
        inside[start : max(start, end - least + 1)] = True
    windows = np.flatnonzero(inside[: len(best)])
    if not len(windows):
        return none, none, none, none
    anchors = (best[windows] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    first, last = windows[new], windows[np.concatenate([new[1:], [len(windows)]]) - 1]
    anchor = anchors[new]
    shape = ((anchor - first << 32) + last - first).astype(np.uint64)
    whole = _mixed(hashes.of(first, last + least) ^ (shape * _A))
    return seeds[anchor].view(np.int64), whole.view(np.int64), first, last + 1


def _words(bodies: list[bytes]) -> tuple[list[list[bytes]], np.ndarray]:
    lists = [x.split() for x in bodies]
    return lists, np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)


INDEX = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("sha", pa.binary()), ("n_words", pa.int64()), ("anchors", pa.list_(pa.int64())), ("wholes", pa.list_(pa.int64())), ("firsts", pa.list_(pa.int32()))])


def _index(least: int, seed: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_id = TaskContext.get().partitionId() << 40
        for batch in batches:
            for piece in slices(batch, "text"):
                lists, offsets = _words(text_bytes(piece.column(1)))
                anchors, wholes, first, _ = segments([w for x in lists for w in x], offsets, least, seed)
                cuts = np.searchsorted(first, offsets)
                own = first - np.repeat(offsets[:-1], np.diff(cuts))
                ends = pa.array(cuts, pa.int32())
                yield pa.record_batch([
                    pa.array(np.arange(row_id, row_id + len(lists))),
                    piece.column(0),
                    pa.array([hashlib.sha256(b" ".join(x)).digest() for x in lists], pa.binary()),
                    pa.array(np.diff(offsets)),
                    *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in (anchors, wholes, own.astype(np.int32))),
                ], schema=INDEX)
                row_id += len(lists)

    return run


def _texts(bitmap: Bitmap) -> object:
    """sha and text of the texts that the bitmap lets through, each once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for piece in slices(batch, "text"):
                shas, bodies = [], []
                for body in text_bytes(piece.column(0)):
                    joined = b" ".join(body.split())
                    sha = hashlib.sha256(joined).digest()
                    if bitmap.may_have(sha) and sha not in seen:
                        seen.add(sha)
                        shas.append(sha)
                        bodies.append(joined)
                yield pa.record_batch([pa.array(shas, pa.binary()), pa.array(bodies, pa.binary())], names=["sha", "body"])

    return run


def _windows(least: int) -> object:
    """Rows of body and its wanted segments; out: a row for each window of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, wanted in zip(batch.column(0), batch.column(1)):
                words = body.as_py().split()
                hashes, wanted = Sequences(words, _B), wanted.as_py()
                counts = np.array([x["n"] for x in wanted])
                nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                start = np.repeat([x["first"] for x in wanted], counts) + nth
                yield pa.record_batch([
                    pa.array(np.repeat(np.array([x["anchor"] for x in wanted], np.int64), counts)),
                    pa.array(np.repeat(np.array([x["whole"] for x in wanted], np.int64), counts)),
                    pa.array(nth.astype(np.int32)),
                    pa.array(_mixed(hashes.of(start, start + least)).view(np.int64)),
                ], names=["anchor", "whole", "nth", "window"])

    return run


COVER = pa.schema([("sha", pa.binary()), ("n_removed", pa.int64()), ("ranges", pa.list_(pa.int32()))])


def _covered(least: int) -> object:
    """Rows of sha, n_words, firsts, hits (place of a segment, its extents: lowest and highest window that repeat)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                n, firsts = row["n_words"], row["firsts"]
                ranges: list[int] = []
                for place, low, high in sorted((h["place"], e["low"], e["high"]) for h in row["hits"] for e in h["extents"]):
                    end = firsts[place + 1] if place + 1 < len(firsts) else n - least + 1
                    start, stop = firsts[place] + low, min(firsts[place] + high, end - 1) + least
                    if ranges and start <= ranges[-1]:
                        ranges[-1] = max(ranges[-1], stop)
                    else:
                        ranges += [start, stop]
                out.append((row["sha"], sum(ranges[1::2]) - sum(ranges[::2]), ranges))
            columns = list(zip(*out)) or [[]] * 3
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, COVER)], schema=COVER)

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shas = []
        for body, ranges in zip(batch.column(1), batch.column(2).to_pylist()):
            shas.append(hashlib.sha256(b" ".join(without(body.as_py().split(), ranges))).digest())
        yield pa.record_batch([batch.column(0), pa.array(shas, pa.binary())], names=["sha", "kept_sha"])


def without(words: list, ranges: list[int]) -> list:
    """words without those in ranges (start, end, start, end, ...)."""
    out, at = [], 0
    for start, end in zip(ranges[::2], ranges[1::2]):
        out += words[at:start]
        at = end
    return out + words[at:]


def _total(counts: DataFrame) -> int:
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


@tidy
def substring_dedup(docs: DataFrame, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_words, n_removed, kept_sha256 and ranges (places of the removed words:
    start, end, start, end, ...) for each row."""
    if not 0 < seed <= least:
        raise ValueError("a seed has a word or more and is at most as long as a window")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = stored(docs.mapInArrow(_index(least, seed), "row_id long, doc_id long, sha binary, n_words long, anchors array<long>, wholes array<long>, firsts array<int>"), "sub-index", keep=True)

    places = index.select("row_id", F.posexplode(F.arrays_zip("anchors", "wholes"))).select("row_id", F.col("pos").alias("place"), F.col("col.anchors").alias("anchor"), F.col("col.wholes").alias("whole"))
    often = index.select(F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    often = stored(often, "sub-often")
    total = _total(often)
    seeds = stored(joined_apart(places, often.select("anchor"), ["anchor"], often, total), "sub-seeds")

    kinds = stored(seeds.groupBy("anchor", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row_id", "place")).alias("at")), "sub-kinds")
    several = stored(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sub-several")
    apart = joined_apart(kinds.select("anchor", "whole", "at"), several.select("anchor"), ["anchor"], several, _total(several))
    apart = stored(apart.select("anchor", "whole", F.col("at.row_id").alias("at_row"), F.col("at.place").alias("at_place")), "sub-apart")

    first = F.element_at("firsts", F.col("at_place") + 1)
    after = F.try_element_at("firsts", F.col("at_place") + 2)
    size = F.coalesce(after, (F.col("n_words") - least + 1).cast("int")) - first
    wanted = apart.join(index.select("row_id", "sha", "n_words", "firsts"), F.col("at_row") == F.col("row_id"))
    wanted = wanted.groupBy("sha").agg(F.collect_list(F.struct("anchor", "whole", first.alias("first"), size.alias("n"))).alias("wanted"))
    wanted = stored(wanted.select(F.col("sha").alias("want_sha"), "wanted"), "sub-wanted")
    bodies = docs.select("text").mapInArrow(_texts(key_bitmap(wanted, "want_sha")), "sha binary, body binary")
    # A text can come from several tasks; it is hashed once.
    bodies = bodies.join(wanted, F.col("sha") == F.col("want_sha")).dropDuplicates(["sha"]).select("body", "wanted")
    windows = stored(bodies.mapInArrow(_windows(least), "anchor long, whole long, nth int, window long"), "sub-windows")

    # Equal windows lie alike around their anchor, so the anchor tells them apart too.
    agree = stored(windows.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sub-agree")
    whole = kinds.filter("n > 1").select("anchor", "whole")
    reach = joined_apart(windows, agree.select("anchor", "window"), ["anchor", "window"], agree, _total(agree))
    reach = reach.groupBy("anchor", "whole").agg(F.array_sort(F.collect_set("nth")).alias("nths")).join(whole, ["anchor", "whole"], "left_anti")
    edge = lambda by: F.filter("nths", lambda x, i: ~F.coalesce(F.get("nths", i + by) == x + by, F.lit(False)))
    extents = F.zip_with(edge(-1), edge(1), lambda low, high: F.struct(low.alias("low"), high.alias("high")))
    every = F.array(F.struct(F.lit(0).alias("low"), F.lit(least).alias("high")))  # more windows than any segment has
    extent = whole.select("anchor", "whole", every.alias("extents")).unionByName(reach.select("anchor", "whole", extents.alias("extents")))
    extent = stored(extent, "sub-extent")
    hits = joined_apart(seeds, extent, ["anchor", "whole"], kinds, total)
    hits = hits.groupBy(F.col("row_id").alias("hit_row")).agg(F.collect_list(F.struct("place", "extents")).alias("hits"))
    cover = index.join(hits, F.col("row_id") == F.col("hit_row")).dropDuplicates(["sha"]).select("sha", "n_words", "firsts", "hits")
    cover = stored(cover.mapInArrow(_covered(least), "sha binary, n_removed long, ranges array<int>"), "sub-cover", keep=True)

    lengths = index.select(F.col("sha").alias("l_sha"), "n_words").dropDuplicates(["l_sha"])
    partial = cover.join(lengths, F.col("sha") == F.col("l_sha")).filter("n_removed < n_words")
    partial = stored(partial.select(F.col("sha").alias("part_sha"), "ranges"), "sub-partial")
    cut = docs.select("text").mapInArrow(_texts(key_bitmap(partial, "part_sha")), "sha binary, body binary")
    cut = cut.join(partial, F.col("sha") == F.col("part_sha")).dropDuplicates(["sha"]).select("sha", "body", "ranges")
    cut = stored(cut.mapInArrow(_kept, "sha binary, kept_sha binary"), "sub-kept", keep=True)

    outcome = cover.join(cut.withColumnRenamed("sha", "cut_sha"), F.col("sha") == F.col("cut_sha"), "left")
    outcome = outcome.select(F.col("sha").alias("o_sha"), "n_removed", "ranges", F.coalesce("kept_sha", F.lit(EMPTY)).alias("kept_sha"))
    rows = index.select("doc_id", "sha", "n_words").join(outcome, F.col("sha") == F.col("o_sha"), "left")
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.lower(F.hex(F.coalesce("kept_sha", "sha"))).alias("kept_sha256"),
        F.coalesce("ranges", F.array().cast("array<int>")).alias("ranges"),
    )
