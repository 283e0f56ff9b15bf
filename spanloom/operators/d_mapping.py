"""D segments: gapless local alignment of D germlines against the V..J interior, and the best ones of a read.

A column that agrees scores +1, any other -1. The best segment over all diagonals is a maximal-sum run; ties go to
the earliest diagonal, then the earliest end, and a run is as short as its sum allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from spanloom.session import small

MIN_SCORE, MIN_SECOND = 6, 7
FUSION_LOCI = ("IGH", "TRD")


#: Cells of a step of best_runs(), about.
CELLS = 1 << 21


def best_runs(interiors: list[str | None], germlines: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of texts: score, s and e of the best segment (0-based, closed, in the interior; 0, -1, -1 if nothing
    agrees). Pairs of like lengths go together, position by position of their interiors over all diagonals."""
    n, m = (np.array([len(x or "") for x in texts], np.int64) for texts in (interiors, germlines))
    out = np.zeros(len(n), np.int32), np.full(len(n), -1, np.int32), np.full(len(n), -1, np.int32)
    order = np.lexsort((n, m))
    order = order[(n[order] > 0) & (m[order] > 0)]
    done = len(order)
    while done:
        last = order[done - 1]
        size = max(1, min(done, CELLS // int(max(m[last], n[last]))))
        some = order[done - size : done]
        longest = int(n[some].max())
        if size > 1 and size * longest > 2 * CELLS:  # one long interior among short ones
            size = max(1, 2 * CELLS // longest)
            some = order[done - size : done]
        done -= size
        for field, found in zip(out, _best_runs(*(_codes([texts[k] for k in some], pad) for texts, pad in ((interiors, 254), (germlines, 255))))):
            field[some] = found
    return out


def _codes(texts: list[str], pad: int) -> np.ndarray:
    """A column for each text: its letters, then pads, which are no letters."""
    codes = np.array(texts, str)
    codes = codes.view(np.uint32).reshape(len(texts), -1).T
    length = np.array([len(x) for x in texts])
    codes = codes + np.uint32(256) * (codes >= 254)  # other letters than the pads, where there are such
    codes = np.where(np.arange(len(codes))[:, None] < length, codes, np.uint32(pad))
    return np.ascontiguousarray(codes)


def _best_runs(q: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    (n, pairs), m = q.shape, len(d)
    if max(int(q.max()), int(d.max())) < 256:
        q, d = q.astype(np.uint8), d.astype(np.uint8)
    wide = n + m
    kind = np.int16 if wide < 30_000 else np.int32
    large = np.int32 if (min(n, m) + 2) * wide < 1 << 31 else np.int64
    cur, new = np.zeros((m, pairs), kind), np.zeros((m, pairs), kind)
    back = np.arange(m, dtype=large)[:, None]  # an earlier diagonal is one of a later place in the germline
    best, end = np.zeros(pairs, large), np.zeros(pairs, np.int64)
    for i in range(n):
        np.maximum(cur[:-1], 0, out=new[1:])
        new[0] = 0
        new += (q[i] == d) * kind(2)
        new -= kind(1)
        top = (new * large(wide) + back).max(0) + large(n - 1 - i)
        more = top > best
        best[more], end[more] = top[more], i
        cur, new = new, cur
    score = best // wide
    at = best % wide - (n - 1 - end)  # where the segment ends in the germline
    start, left, k = np.full(pairs, -1, np.int64), score.astype(np.int64), np.flatnonzero(score > 0)
    place = 0
    while len(k):  # back from its end, until it has its score
        left[k] += np.where(q[end[k] - place, k] == d[at[k] - place, k], -1, 1)
        whole = left[k] == 0
        start[k[whole]] = end[k[whole]] - place
        k, place = k[~whole], place + 1
    return score, start, np.where(score > 0, end, -1)


def local_rows(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs: keys, interior, d. Returns keys, score, s, e of each row, as best_runs() has them, whatever its case."""
    schema = StructType([*pairs.select(*keys).schema, *(StructField(c, IntegerType()) for c in ("score", "s", "e"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = best_runs(*(batch.column(c).to_pylist() for c in ("_interior", "_d")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *map(pa.array, found)], schema.names)

    return pairs.select(*keys, F.upper("interior").alias("_interior"), F.upper("d").alias("_d")).mapInArrow(run, schema)


def of_locus(reads: DataFrame, germlines: DataFrame) -> DataFrame:
    """reads: locus; germlines: locus, allele, d. A row for each read and D allele of its locus."""
    return reads.join(small(germlines.select("locus", "allele", "d")), "locus")


def best_rows(scored: DataFrame, read: list[str]) -> DataFrame:
    """scored: read, locus, allele, score, s, e (one row an allele). Returns read with d1 and d2, structs of
    allele, score, s and e: d1 the best of at least MIN_SCORE (longer, then the smaller name, breaks ties); d2 for
    FUSION_LOCI the best of at least MIN_SECOND whose own segment does not overlap d1."""
    entry = F.struct("allele", "score", "s", "e")
    # The smallest name wins among equals, so order by the negated numbers and take the least.
    order = F.struct((-F.col("score")).alias("a"), (-(F.col("e") - F.col("s"))).alias("b"), F.col("allele").alias("c"))
    usable = scored.filter((F.col("score") >= MIN_SCORE) & (F.col("s") >= 0))
    first = usable.groupBy(*read).agg(F.min_by(entry, order).alias("d1"))
    apart = (F.col("e") < F.col("d1.s")) | (F.col("s") > F.col("d1.e"))
    rest = usable.join(first, read).filter(F.col("locus").isin(*FUSION_LOCI) & (F.col("score") >= MIN_SECOND) & apart)
    second = rest.groupBy(*read).agg(F.min_by(entry, order).alias("d2"))
    return first.join(second, read, "left")


# The same over numpy, for the annotation kernel


class Germlines:
    """D alleles of one locus, laid out so that all of them are aligned at once."""

    def __init__(self, alleles: list[tuple[str, str]]):
        self.names = [a for a, _ in sorted(alleles)]
        rows = [np.frombuffer(s.upper().encode(), np.uint8) for _, s in sorted(alleles)]
        self.longest = max(map(len, rows), default=0)
        self.codes = np.zeros((len(rows), self.longest), np.uint8)
        for i, row in enumerate(rows):
            self.codes[i, : len(row)] = row
        self.lengths = np.array([len(r) for r in rows])

    def align(self, interior: str) -> list[tuple[int, int, int]]:
        """(score, s, e) for each allele."""
        q = np.frombuffer(interior.upper().encode(), np.uint8)
        n, m = len(q), self.longest
        none = [(0, -1, -1)] * len(self.names)
        if not n or not m:
            return none
        offs = np.arange(-(m - 1), n)
        j = np.arange(n)[None, :] - offs[:, None]  # diagonal x query position -> germline position
        inside = (j >= 0) & (j < m)
        d = self.codes[:, np.clip(j, 0, m - 1)]
        inside = inside[None] & (j[None] < self.lengths[:, None, None])
        sc = np.where(inside, np.where(d == q, 1, -1), 0)
        # Outside its diagonal a run must not continue: positions before it add 0 and never hold the minimum.
        ps = np.cumsum(sc, 2)
        pre = np.where(inside, ps - sc, np.iinfo(np.int32).max)
        mn = np.minimum.accumulate(pre, 2)
        cur = np.where(inside, ps - np.where(mn == np.iinfo(np.int32).max, 0, mn), -1)
        flat = cur.reshape(len(self.names), -1)
        best = flat.argmax(1)  # the first of equals: earliest diagonal, then earliest end
        out = []
        for k, at in enumerate(best):
            score = int(flat[k, at])
            if score <= 0:
                out.append((0, -1, -1))
                continue
            off, end = divmod(int(at), n)
            start = int(np.flatnonzero(pre[k, off, : end + 1] == mn[k, off, end])[-1])
            out.append((score, start, end))
        return out

    def best(self, interior: str, two: bool) -> list[tuple[str, int, int]]:
        """The D segments called in an interior, in order of their starts."""
        found = [(-score, -(e - s), name, s, e) for name, (score, s, e) in zip(self.names, self.align(interior)) if score >= MIN_SCORE]
        if not found:
            return []
        segments = [min(found)]
        if two:
            _, _, _, s1, e1 = segments[0]
            rest = [x for x in found if -x[0] >= MIN_SECOND and (x[4] < s1 or x[3] > e1)]
            segments += [min(rest)] if rest else []
        return sorted(((name, s, e) for _, _, name, s, e in segments), key=lambda x: x[1])
