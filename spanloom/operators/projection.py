"""Interval projection: reference intervals carried through an alignment onto the query.

An alignment is two strings of equal length with gaps as '-', and the 1-based positions where they start. An interval
covers the query positions that are aligned to its reference positions; its extent is the first and the last of
them. It is null where nothing of it is aligned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def project_rows(hits: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """hits: keys, qaln, taln, qstart, tstart; intervals: keys, name, rs, re (1-based, closed). One row a hit and
    interval: keys, name, qs, qe. Columns of the alignment become rows; running counts of residues place them, and
    one aggregation takes the extents."""
    cells = hits.select(*keys, "qstart", "tstart", F.posexplode(F.arrays_zip(F.split("qaln", "").alias("q"), F.split("taln", "").alias("t"))).alias("i", "c"))
    cells = cells.filter("c.q <> '' and c.t <> ''")
    upto = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumns({"qp": F.col("qstart") - 1 + F.sum(F.when(F.col("c.q") != "-", 1).otherwise(0)).over(upto), "tp": F.col("tstart") - 1 + F.sum(F.when(F.col("c.t") != "-", 1).otherwise(0)).over(upto)})
    pairs = cells.filter("c.q <> '-' and c.t <> '-'").select(*(F.col(k).alias(f"_{k}") for k in keys), "qp", "tp")
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("tp").between(F.col("rs"), F.col("re"))]
    return intervals.join(pairs, on, "left").groupBy(*keys, "name").agg(F.min("qp").cast("int").alias("qs"), F.max("qp").cast("int").alias("qe"))


def aligned_pairs(qaln: str, taln: str, qstart: int, tstart: int) -> tuple[np.ndarray, np.ndarray]:
    """1-based query and reference positions of the aligned pairs."""
    q, t = (np.frombuffer(x.encode(), np.uint8) != 45 for x in (qaln, taln))
    both = q & t
    return (qstart - 1 + np.cumsum(q))[both], (tstart - 1 + np.cumsum(t))[both]


def extents(qpos: np.ndarray, tpos: np.ndarray, starts: list[int], ends: list[int]) -> list[tuple[int, int] | None]:
    """For each interval its first and last query position."""
    lo, hi = np.searchsorted(tpos, starts, "left"), np.searchsorted(tpos, ends, "right") - 1
    return [(int(qpos[a]), int(qpos[b])) if a <= b and s > 0 else None for a, b, s in zip(lo, hi, starts)]


def project_point(qpos: np.ndarray, tpos: np.ndarray, at: int) -> int:
    """The query position of one reference position; 0 if it is not aligned."""
    found = extents(qpos, tpos, [at], [at])[0]
    return found[0] if found else 0


def shifted(start: Column, end: Column, shift: Column, first: Column, last: Column) -> tuple[Column, Column]:
    """Extents through an alignment without gaps: query = reference + shift, aligned from query first to last."""
    qs, qe = F.greatest(start + shift, first), F.least(end + shift, last)
    return F.when(qs <= qe, qs), F.when(qs <= qe, qe)
