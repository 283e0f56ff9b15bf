"""Whole-number vectors: exact distances, sums that cannot overflow, and blocks of them as bytes.

A vector's components become floor(scale * x). In a block where all of these are below SAFE in size, distances are exact
in 64 bits (or in doubles, where they are small enough for these); other blocks go over to Python's whole numbers.
Results that a long cannot hold are its largest value.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to here 64 components' squared differences fit in 64 bits, and up to EXACT in the 53 bits of a double.
SAFE, EXACT = 1 << 27, 1 << 22
MOST = (1 << 63) - 1
LIMB = 40


def usable(vector: Column, dims: int, scale: int) -> Column:
    """Whether a vector has exactly so many components, none null, and all of them finite, also after scaling."""
    finite = lambda x: x.isNotNull() & (F.abs(x * scale) < float("inf"))  # noqa: E731  NaN is above every number
    return F.coalesce((F.size(vector) == dims) & F.forall(vector, finite), F.lit(False))


def floors(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit numbers, or as Python's where one is too large for exact distances in these."""
    y = np.floor(x * float(scale))
    if np.abs(y).max(initial=0) < SAFE:
        return y.astype(np.int64)
    return np.array([int(v) for v in y.ravel()], object).reshape(y.shape)


def rows_of(column: pa.Array, dims: int) -> np.ndarray:
    """An Arrow column of lists of so many doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def joint(*parts: np.ndarray) -> list[np.ndarray]:
    """All as Python's whole numbers if one of them is."""
    return [p.astype(object) for p in parts] if any(p.dtype == object for p in parts) else list(parts)


def squared(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x from all rows of z."""
    x, z = joint(x, z)
    if x.dtype != object and max(np.abs(x).max(initial=0), np.abs(z).max(initial=0)) < EXACT:
        f, g = x.astype(np.float64), z.astype(np.float64)
        return ((f * f).sum(1)[:, None] + (g * g).sum(1)[None, :] - 2 * (f @ g.T)).astype(np.int64)
    return (x * x).sum(1)[:, None] + (z * z).sum(1)[None, :] - 2 * (x @ z.T)


def paired(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x from the rows of z of the same number."""
    x, z = joint(x, z)
    return ((x - z) * (x - z)).sum(1)


def longs(values: Iterable) -> pa.Array:
    return pa.array([min(int(v), MOST) for v in values], pa.int64())


def packed(x: np.ndarray) -> bytes:
    """A block of whole numbers in the narrowest type that holds them; those of Python came from doubles."""
    most = max((abs(int(v)) for v in (x.min(initial=0), x.max(initial=0))), default=0)
    kind = "h" if most < 1 << 15 else "i" if most < 1 << 31 else "d"
    return kind.encode() + x.astype({"h": np.int16, "i": np.int32, "d": np.float64}[kind]).tobytes()


def unpacked(body: bytes, dims: int) -> np.ndarray:
    x = np.frombuffer(body, {"h": np.int16, "i": np.int32, "d": np.float64}[chr(body[0])], offset=1).reshape(-1, dims)
    return floors(x, 1) if x.dtype == np.float64 else x.astype(np.int64)


def totals(x: np.ndarray, owner: np.ndarray, k: int) -> np.ndarray:
    """Of the rows of each owner: componentwise sums and, last, how many there are. k rows of dims + 1."""
    rows = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
    out = np.zeros((k, rows.shape[1]), x.dtype)
    order = np.argsort(owner, kind="stable")
    which, first = np.unique(owner[order], return_index=True)
    if len(order):
        out[which] = np.add.reduceat(rows[order], first, axis=0)
    return out


def limbs(sums: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Places, limbs and values of what is not 0: whole numbers of any size as digits of 40 bits with their sign, so that
    sums of a million of them stay longs."""
    out: tuple[list[int], list[int], list[int]] = [], [], []
    flat = sums.ravel()
    for at in np.flatnonzero(flat):
        value, limb = int(flat[at]), 0
        sign = 1 if value > 0 else -1
        value = abs(value)
        while value:
            if digit := value & (1 << LIMB) - 1:
                out[0].append(int(at))
                out[1].append(limb)
                out[2].append(sign * digit)
            value, limb = value >> LIMB, limb + 1
    return out


def summed(rows: DataFrame, size: int) -> list[int]:
    """rows: at, limb, value, as limbs() makes them in many tasks; a few thousand sums reach the driver."""
    out = [0] * size
    for r in rows.groupBy("at", "limb").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] += r["value"] << (LIMB * r["limb"])
    return out


def moved(sums: list[int], old: np.ndarray) -> np.ndarray:
    """New centres: floor(sum / count) by component, where the count, which follows a centre's sums, is not 0."""
    k, dims = old.shape
    new = []
    for i in range(k):
        *s, n = sums[i * (dims + 1) : (i + 1) * (dims + 1)]
        new.append([v // n for v in s] if n else [int(v) for v in old[i]])
    y = np.array(new, object).reshape(k, dims)
    return y.astype(np.int64) if all(abs(v) < SAFE for v in y.ravel()) else y


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of a task in batches of so many, but for the last one."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        while n >= size:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield whole.slice(0, size)
            held, n = [whole.slice(size)], n - size
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
