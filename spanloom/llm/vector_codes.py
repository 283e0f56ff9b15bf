"""Vector code compression: product codebooks by Lloyd's rounds with Elkan's bounds.

Vectors are cut into equal parts, each part position has a codebook of its own. Between rounds a block of vectors is stored
with the entry of each part, an upper bound of its distance from that entry, and a lower bound of its distance from every
entry. In the next round the bounds are shifted by how far the entries have moved. An entry is skipped where its lower bound,
or half its distance from the part's own entry, is strictly above the upper bound; what is left is compared in whole numbers,
where ties go to the lower index. Stored lower bounds are rounded down and upper bounds up, so skipping changes no result.
Each round is one pass from the last round's table to the next, which also holds each block's sums by entry; the driver
gets sums by entry only.

Defined cases: a vector that is null or has a null, NaN or infinite component (also after scaling) is left out, and so is
one with another number of components than `dims`. Of rows that repeat a vec_id each counts; the first entries are those of
the smallest ids, rows of one id ordered by their vectors, null ids last. Fewer vectors than entries make smaller codebooks.
Components of 2 ** 27 or more after scaling are compared as exact whole numbers without bounds; errors and sums that do not
fit a long are its largest value. No vectors give no rows. Labels may be of any type. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import vectors
from spanloom.llm.common import discard, joined_apart, lean, stored, tidy

BLOCK = 4096
#: Relative room that bounds leave for rounding.
ROOM = 1e-9
STATE = "ids array<{0}>, labels array<string>, points binary, code binary, upper binary, lower binary, step binary, compared long, at array<int>, limb array<int>, value array<long>"


def distances(squares: np.ndarray, up: bool) -> np.ndarray:
    """Square roots, rounded so that they bound the true ones."""
    if squares.dtype == object:  # entries that bounds are not used with
        squares = np.array([float(min(v, 1 << 1000)) for v in squares.ravel()]).reshape(squares.shape)
    return np.sqrt(squares.astype(np.float64)) * (1 + ROOM if up else 1 - ROOM)


def nearest(x: np.ndarray, entries: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Moves code to the nearest entry of each row of x, and tightens the bounds. Returns how many distances it took."""
    if x.dtype == object or entries.dtype == object:
        code[:] = vectors.squared(x, entries).argmin(1)
        upper[:], lower[:] = np.inf, 0
        return x.shape[0] * len(entries)
    half = distances(vectors.squared(entries, entries), up=False) / 2
    np.fill_diagonal(half, np.inf)  # a part's own entry needs no look
    rows = np.flatnonzero(((lower <= upper[:, None]) & (half[code] <= upper[:, None])).any(1))
    if not len(rows):
        return 0
    own = code[rows]
    best = vectors.paired(x[rows], entries[own])
    top, low = distances(best, up=True), lower[rows]
    low[np.arange(len(rows)), own] = distances(best, up=False)
    compared = len(rows)
    for b in range(len(entries)):
        some = np.flatnonzero((low[:, b] <= top) & (half[own, b] <= top))
        if not len(some):
            continue
        d = vectors.paired(x[rows[some]], entries[b][None, :])
        compared += len(some)
        low[some, b] = distances(d, up=False)
        better = (d < best[some]) | ((d == best[some]) & (b < own[some]))
        some, d = some[better], d[better]
        own[some], best[some], top[some] = b, d, distances(d, up=True)
    code[rows], upper[rows], lower[rows] = own, top, low
    return compared


def _state(ids: pa.Array, labels: pa.Array, points: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, compared: int, entries: list[np.ndarray]) -> list[pa.Array]:
    """A block as a row. Lower bounds are stored as 16-bit steps of their part's largest."""
    parts, k = len(entries), len(entries[0])
    wide = points.shape[1] // parts
    step = np.maximum(lower.max((0, 2), initial=0), 1e-300) / 65535
    steps = np.floor(np.minimum(lower / step[None, :, None], 65535)).astype(np.uint16)
    highest = np.nextafter(np.maximum(upper, 0).astype(np.float32), np.float32(np.inf))
    sums = vectors.limbs(np.concatenate([vectors.totals(points[:, p * wide : (p + 1) * wide], code[:, p], k) for p in range(parts)]))
    raw = [vectors.packed(points), code.astype(np.uint8).tobytes(), highest.tobytes(), steps.tobytes(), step.tobytes()]
    return [ids, labels, *(pa.array([x], pa.binary()) for x in raw), pa.array([compared]), *(pa.array([c], pa.list_(t)) for c, t in zip(sums, (pa.int32(), pa.int32(), pa.int64())))]


_NAMES = ["ids", "labels", "points", "code", "upper", "lower", "step", "compared", "at", "limb", "value"]


def _read(row: dict, dims: int, parts: int, k: int) -> tuple[np.ndarray, ...]:
    points = vectors.unpacked(row["points"], dims)
    code = np.frombuffer(row["code"], np.uint8).reshape(-1, parts).astype(np.int64)
    upper = np.frombuffer(row["upper"], np.float32).reshape(-1, parts).astype(np.float64)
    lower = np.frombuffer(row["lower"], np.uint16).reshape(-1, parts, k) * np.frombuffer(row["step"])[None, :, None] * (1 - ROOM)
    return points, code, upper, lower


def _assign(points: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, entries: list[np.ndarray]) -> int:
    wide = points.shape[1] // len(entries)
    compared = 0
    for p, e in enumerate(entries):
        own = code[:, p].copy(), upper[:, p].copy(), lower[:, p].copy()
        compared += nearest(points[:, p * wide : (p + 1) * wide], e, *own)
        code[:, p], upper[:, p], lower[:, p] = own
    return compared


def _first(entries: list[np.ndarray], dims: int, scale: int, id_type: pa.DataType) -> object:
    parts, k = len(entries), len(entries[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vectors.blocks(batches, BLOCK):
            points, n = vectors.floors(vectors.rows_of(batch.column(2), dims), scale), batch.num_rows
            code, upper, lower = np.zeros((n, parts), np.int64), np.full((n, parts), np.inf), np.zeros((n, parts, k))
            compared = _assign(points, code, upper, lower, entries)
            lists = pa.array([batch.column(0)], pa.list_(id_type)), pa.array([batch.column(1)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(_state(*lists, points, code, upper, lower, compared, entries), names=_NAMES)

    return run


def _shifted(row: dict, old: list[np.ndarray], new: list[np.ndarray], dims: int) -> tuple[tuple[np.ndarray, ...], int]:
    """A block after its entries have moved, assigned anew."""
    points, code, upper, lower = _read(row, dims, len(new), len(new[0]))
    for p, (a, b) in enumerate(zip(old, new)):
        pair = vectors.joint(a, b)
        way = distances(vectors.paired(*pair), up=True)
        upper[:, p] = (upper[:, p] + way[code[:, p]]) * (1 + ROOM)
        lower[:, p] = np.maximum(lower[:, p] - way[None, :], 0) * (1 - ROOM)
    return (points, code, upper, lower), _assign(points, code, upper, lower, new)


def _next(old: list[np.ndarray], new: list[np.ndarray], dims: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.select(_NAMES[2:7]).to_pylist()):
                state, compared = _shifted(row, old, new, dims)
                yield pa.RecordBatch.from_arrays(_state(batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), *state, compared, new), names=_NAMES)

    return run


def _split(whole: np.ndarray, parts: int) -> list[np.ndarray]:
    return [x.copy() for x in np.split(whole, parts, axis=1)]


@tidy
def compressed(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, dims: int = 64, scale: int = 4096) -> DataFrame:
    """rows: vec_id, embedding, label. Returns vec_id, code, error, label_error, codebooks_sha256 for each usable vector."""
    lean(rows.sparkSession)
    if dims % parts or not 1 <= entries <= 256:
        raise ValueError("parts must divide dims, and entries be 1 to 256")
    rows = rows.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.filter(vectors.usable(F.col("vector"), dims, scale))
    id_type = "string" if rows.schema["id"].dataType.simpleString() == "string" else "bigint"
    rows = rows.withColumn("id", F.col("id").cast(id_type))
    floored = F.transform("vector", lambda x: F.floor(x * scale))
    first = rows.orderBy(F.asc_nulls_last("id"), floored, "vector").select("vector").limit(entries).collect()
    if not first:
        none = rows.select("id").limit(0)
        return none.selectExpr("id AS vec_id", "'' AS code", "0L AS error", "0L AS label_error", "'' AS codebooks_sha256")
    books = _split(vectors.floors(np.array([r.vector for r in first], np.float64).reshape(-1, dims), scale), parts)
    k, wide = len(first), dims // parts
    schema = STATE.format(id_type)
    state = stored(rows.mapInArrow(_first(books, dims, scale, pa.string() if id_type == "string" else pa.int64()), schema), "codes")
    old = books
    for n in range(rounds):
        if n:
            last, state = state, stored(state.mapInArrow(_next(old, books, dims), schema), "codes", keep=n == rounds - 1)
            discard(last)
        flat = state.select(F.explode(F.arrays_zip("at", "limb", "value")).alias("x")).select("x.at", "x.limb", "x.value")
        sums, size = vectors.summed(flat, parts * k * (wide + 1)), k * (wide + 1)
        old, books = books, [vectors.moved(sums[p * size : (p + 1) * size], b) for p, b in enumerate(books)]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.select(_NAMES[2:7]).to_pylist()):
                (points, code, _, _), _ = _shifted(row, old, books, dims)
                error = sum(vectors.paired(points[:, p * wide : (p + 1) * wide], b[code[:, p]]).astype(object) for p, b in enumerate(books))
                names = code.astype(np.uint8).tobytes().hex()
                names = pa.array([names[j : j + 2 * parts] for j in range(0, len(names), 2 * parts)])
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, batch.column(1)[i].values, names, vectors.longs(error)], names=["vec_id", "label", "code", "error"])

    out = stored(state.mapInArrow(coded, f"vec_id {id_type}, label string, code string, error long"), "coded", keep=True)
    out = out.select("vec_id", "code", "error", F.col("label").isNull().alias("unlabelled"), F.coalesce("label", F.lit("")).alias("label"))
    by = out.groupBy("unlabelled", "label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(vectors.MOST)).cast("long").alias("label_error"), F.count(F.lit(1)).alias("n"))
    by = stored(by, "labels", keep=True)
    total = by.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sha = hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()
    out = joined_apart(out, by.drop("n"), ["unlabelled", "label"], by, total)
    return out.select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def _sql(rounds: int = 6) -> str:
    """For DuckDB: every distance of every round, parts as rows of their own."""
    d = "list_sum([({0}[i] - {1}[i])::HUGEINT * ({0}[i] - {1}[i]) FOR i IN range(1, 9)])".format("x.x", "z.z")
    out = """WITH v AS MATERIALIZED (SELECT vec_id, label, row_number() OVER () AS row, [floor(4096 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
x AS MATERIALIZED (SELECT row, p, v[8 * p + 1 : 8 * p + 8] AS x FROM v, range(8) t(p)),
z0 AS MATERIALIZED (SELECT p, c, v[8 * p + 1 : 8 * p + 8] AS z FROM (SELECT v, row_number() OVER (ORDER BY vec_id, v) - 1 AS c FROM v ORDER BY vec_id, v LIMIT 16) f, range(8) t(p)),
"""
    for n in range(rounds + 1):
        out += f"a{n} AS MATERIALIZED (SELECT row, p, any_value(x) AS x, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT x.row, x.p, x.x, c, {d} AS d FROM x JOIN z{n} z ON x.p = z.p) t GROUP BY row, p),\n"
        if n < rounds:
            out += f"""s{n} AS MATERIALIZED (SELECT p, c, i, sum(x[i])::HUGEINT AS s, count(*) AS n FROM a{n}, range(1, 9) t(i) GROUP BY p, c, i),
z{n + 1} AS MATERIALIZED (SELECT z.p, z.c, coalesce(m.z, z.z) AS z FROM z{n} z LEFT JOIN (SELECT p, c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS z FROM s{n} GROUP BY p, c) m USING (p, c)),
"""
    return (
        out
        + f"""e AS MATERIALIZED (SELECT v.vec_id, v.label, string_agg(printf('%02x', c::INTEGER), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} JOIN v USING (row) GROUP BY v.row, v.vec_id, v.label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(z, ','), ',' ORDER BY p, c)) FROM z{rounds}) AS codebooks_sha256 FROM e"""
    )


SQL = _sql()
