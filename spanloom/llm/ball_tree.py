"""Centroid clustering over ball trees.

Each task puts its vectors, a block of them at a time, into a metric tree: a ball is split at the median along the line
between two far points, and stores how many vectors it holds, their whole-number sum, and its radius around their mean.
The trees are written once to the shared folder. A round sends the centroids to every task; from each tree's root down, a
centroid that is farther from a ball than another one by more than the ball's diameter is ruled out for all of it. A ball
with one centroid left is assigned whole, by its count and its sum; a leaf with several is decided vector by vector, in
whole numbers. Bounds are doubles with a margin, so what they rule out is farther for certain: ties always reach a leaf.
Only sums by centroid leave a task.

Defined cases: a vector that is null, has a null, NaN or infinite component (also after scaling) or another number of
components than `dims` is left out. Of rows that repeat a vec_id each counts; for the first centroids they are ordered by
their vectors, null ids last. With fewer than k vectors there are as many centroids. No vectors give no rows. Components
of 2 ** 27 or more after scaling are handled by exact whole numbers without bounds, and distances and their sums that do
not fit a long are its largest value. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import vectors
from spanloom.llm.common import lean, stored, tidy

BLOCK, LEAF = 2048, 24
#: Relative room that bounds leave for rounding.
ROOM = 1e-9


@dataclass
class Tree:
    """Vectors in tree order; node i holds those of [start, start + count), its children are 2 i + 1 and 2 i + 2."""

    points: np.ndarray
    start: np.ndarray
    count: np.ndarray
    sums: np.ndarray
    radius: np.ndarray

    @classmethod
    def built(cls, points: np.ndarray) -> tuple[Tree, np.ndarray]:
        """With the order of the rows in it."""
        order = np.arange(len(points))
        if points.dtype == object:  # too large for bounds: one ball that rules nothing out
            return cls(points, np.zeros(1, np.int64), np.array([len(points)]), points.sum(0)[None, :], np.array([np.inf])), order
        x = points.astype(np.float64)
        levels = max(0, int(np.ceil(np.log2(max(1, len(x)) / LEAF))))
        spans = [(0, len(x))]
        for node in range(2**levels - 1):
            a, b = spans[node]
            own = order[a:b]
            far = x[own[((x[own] - x[own].mean(0)) ** 2).sum(1).argmax()]]
            other = x[own[((x[own] - far) ** 2).sum(1).argmax()]]
            order[a:b] = own[np.argsort(x[own] @ (other - far), kind="stable")]
            spans += [(a, (a + b) // 2), ((a + b) // 2, b)]
        start, end = (np.array(c, np.int64) for c in zip(*spans))
        below = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[order], 0)])
        sums = below[end] - below[start]
        radius = [np.sqrt(((x[order[a:b]] - s / (b - a)) ** 2).sum(1).max()) for (a, b), s in zip(spans, sums)]
        return cls(points[order], start, end - start, sums, np.array(radius)), order

    def owners(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The centroid of each vector; the balls that were assigned whole, and their centroids."""
        owner = np.full(len(self.points), -1, np.int64)
        whole: list[np.ndarray] = [np.zeros(0, np.int64)]
        theirs: list[np.ndarray] = [np.zeros(0, np.int64)]
        k, last = len(centroids), len(self.count) // 2  # nodes from here on are leaves
        exact = lambda a, n, open_: self._nearest(owner, centroids, a, n, open_)
        if self.points.dtype == object or centroids.dtype == object:
            exact(0, len(self.points), np.ones(k, bool))
            return owner, whole[0], theirs[0]
        z = centroids.astype(np.float64)
        nodes, left = np.zeros(1, np.int64), np.ones((1, k), bool)
        while len(nodes):
            mean = self.sums[nodes] / self.count[nodes][:, None]
            far = np.sqrt(((mean[:, None, :] - z[None, :, :]) ** 2).sum(2))
            far[~left] = np.inf
            reach = far.min(1) + 2 * self.radius[nodes]
            left &= far <= (reach + ROOM * (reach + 1))[:, None]
            sure = left.sum(1) == 1
            whole.append(nodes[sure])
            theirs.append(left[sure].argmax(1))
            for a, n, c in zip(self.start[whole[-1]], self.count[whole[-1]], theirs[-1]):
                owner[a : a + n] = c
            leaf = ~sure & (nodes >= last)
            for i in np.flatnonzero(leaf):
                exact(self.start[nodes[i]], self.count[nodes[i]], left[i])
            deep = ~sure & ~leaf
            nodes, left = np.concatenate([2 * nodes[deep] + 1, 2 * nodes[deep] + 2]), np.concatenate([left[deep], left[deep]])
        return owner, np.concatenate(whole), np.concatenate(theirs)

    def _nearest(self, owner: np.ndarray, centroids: np.ndarray, start: int, count: int, open_: np.ndarray) -> None:
        some = np.flatnonzero(open_)
        owner[start : start + count] = some[vectors.squared(self.points[start : start + count], centroids[some]).argmin(1)]  # the first of equals

    def totals(self, centroids: np.ndarray) -> np.ndarray:
        """Sums and counts by centroid: those of whole balls as stored, the other vectors one by one."""
        owner, whole, theirs = self.owners(centroids)
        single = np.ones(len(owner), bool)
        for a, n in zip(self.start[whole], self.count[whole]):
            single[a : a + n] = False
        out = vectors.totals(self.points[single], owner[single], len(centroids))
        balls = np.concatenate([self.sums[whole], self.count[whole][:, None]], 1).astype(out.dtype)
        np.add.at(out, theirs, balls)
        return out


def _trees(dims: int, scale: int, id_type: pa.DataType) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vectors.blocks(batches, BLOCK):
            tree, order = Tree.built(vectors.floors(vectors.rows_of(batch.column(1), dims), scale))
            ids = pa.array([batch.column(0).take(pa.array(order))], pa.list_(id_type))
            big = tree.points.dtype == object
            raw = [vectors.packed(tree.points), tree.start.tobytes(), tree.count.tobytes(), b"" if big else tree.sums.tobytes(), tree.radius.tobytes()]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([x], pa.binary()) for x in raw)], names=["ids", "points", "start", "count", "sums", "radius"])

    return run


def _read(row: dict, dims: int) -> Tree:
    points = vectors.unpacked(row["points"], dims)
    sums = np.frombuffer(row["sums"], np.int64).reshape(-1, dims) if row["sums"] else points.sum(0)[None, :]
    return Tree(points, *(np.frombuffer(row[c], np.int64) for c in ("start", "count")), sums, np.frombuffer(row["radius"]))


def first_centroids(rows: DataFrame, k: int, salt: str, dims: int, scale: int) -> np.ndarray:
    """rows: id, vector. The k with the smallest hashes of salt and id."""
    sha = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")).cast("binary"), 256)
    floored = F.transform("vector", lambda x: F.floor(x * scale))
    first = rows.orderBy(F.asc_nulls_last(sha), F.asc_nulls_last("id"), floored, "vector").select("vector").limit(k).collect()
    return vectors.floors(np.array([r.vector for r in first], np.float64).reshape(-1, dims), scale)


@tidy
def clusters(rows: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, salt: str = "1") -> DataFrame:
    """rows: vec_id, embedding. Returns vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each usable
    vector."""
    lean(rows.sparkSession)
    rows = rows.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector")).filter(vectors.usable(F.col("vector"), dims, scale))
    id_type = rows.schema["id"].dataType.simpleString()
    centroids = first_centroids(rows, k, salt, dims, scale)
    arrow_id = pa.string() if id_type == "string" else pa.int64()
    rows = rows if id_type == "string" else rows.withColumn("id", F.col("id").cast("long"))
    id_type = "string" if id_type == "string" else "bigint"
    made = rows.mapInArrow(_trees(dims, scale, arrow_id), f"ids array<{id_type}>, points binary, start binary, count binary, sums binary, radius binary")
    trees = stored(made, "balls", keep=True)
    found = trees.drop("ids")
    for _ in range(rounds):
        centroids = vectors.moved(vectors.summed(found.mapInArrow(_sums(centroids, dims), "at int, limb int, value long"), centroids.size + len(centroids)), centroids)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.select(["points", "start", "count", "sums", "radius"]).to_pylist()):
                tree = _read(row, dims)
                owner = tree.owners(centroids)[0]
                far = vectors.longs(vectors.paired(tree.points, centroids[owner]))
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(owner, pa.int32()), far], names=["vec_id", "cluster", "distance"])

    out = stored(trees.mapInArrow(assigned, f"vec_id {id_type}, cluster int, distance long"), "clusters", keep=True)
    own = F.sum(F.col("distance").cast("decimal(38,0)"))
    by = out.groupBy("cluster").agg(own.alias("s")).collect()  # k rows at most
    every = sum(int(r.s) for r in by)
    sha = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centroids]
    known = [(r.cluster, min(int(r.s), vectors.MOST), min(every, vectors.MOST), sha[r.cluster]) for r in by]
    known = rows.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sums(centroids: np.ndarray, dims: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for row in batch.to_pylist():
                new = _read(row, dims).totals(centroids)
                out = new if out is None else sum(vectors.joint(out, new))
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(vectors.limbs(out), (pa.int32(), pa.int32(), pa.int64()))], names=["at", "limb", "value"])

    return run


_Z = "list_sum([({0}[i] - {1}[i])::HUGEINT * ({0}[i] - {1}[i]) FOR i IN range(1, 65)])"
_ASSIGN = """a{n} AS MATERIALIZED (SELECT vec_id, row, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, row, v.v, c, {d} AS d FROM v, z{n}) t GROUP BY vec_id, row, v),
"""
_MOVE = """s{n} AS MATERIALIZED (SELECT c, i, sum(v[i])::HUGEINT AS s, count(*) AS n FROM a{n}, range(1, 65) t(i) GROUP BY c, i),
z{next} AS MATERIALIZED (SELECT z.c, coalesce(m.z, z.z) AS z FROM z{n} z LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS z FROM s{n} GROUP BY c) m USING (c)),
"""
SQL = (
    """WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
z0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS z FROM (SELECT v, sha256('1:' || vec_id) AS h FROM v ORDER BY h, v LIMIT 16) t),
"""
    + "".join(_ASSIGN.format(n=n, d=_Z.format("v.v", "z")) + (_MOVE.format(n=n, next=n + 1) if n < 3 else "") for n in range(4))
    + """i AS (SELECT c, sum(d) AS own FROM a3 GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, own::BIGINT AS cluster_inertia, (SELECT sum(own) FROM i)::BIGINT AS inertia, sha256(array_to_string(z, ',')) AS centroid_sha256
FROM a3 JOIN i USING (c) JOIN z3 USING (c)"""
)
