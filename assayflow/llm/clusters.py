"""Centroid clustering with Drake's adaptive bounds.

Beside each vector stands an upper bound of the distance to its centroid, lower bounds to the several next nearest and
one lower bound to all the rest. When centroids move, bounds move by as much; a vector is looked at again only where
they no longer certify its centroid, first against the several, then against all. Comparisons that decide are exact,
in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard
from .common import materialize

#: Next nearest centroids with a bound of their own.
NEXT = 3
#: Entries are floor(SCALE * x); those beyond LARGEST in magnitude have no squared distance that fits a long.
SCALE, LARGEST = 1024, 2.0**27
#: Slack of the bounds, far over what rounding takes from them.
LOOSE = 1e-9


def _squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((x - centroids) ** 2).sum(axis=-1)


def _by_distance(squares: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Columns in the order of distance, then of the centroid's number."""
    return np.lexsort((names, squares), axis=1)


class Bounds:
    """The bounds of some vectors, as arrays: own (centroid), upper, near (numbers), low (their bounds), rest."""

    def __init__(self, own: np.ndarray, upper: np.ndarray, near: np.ndarray, low: np.ndarray, rest: np.ndarray):
        self.own, self.upper, self.near, self.low, self.rest = own, upper, near, low, rest
        self.scans = np.zeros(len(own), np.int64)

    @classmethod
    def scanned(cls, x: np.ndarray, centroids: np.ndarray, near: int) -> Bounds:
        out = cls(np.zeros(len(x), np.int32), np.zeros(len(x)), np.zeros((len(x), near), np.int32), np.zeros((len(x), near)), np.zeros(len(x)))
        out.scan(x, centroids, np.arange(len(x)))
        return out

    def scan(self, x: np.ndarray, centroids: np.ndarray, rows: np.ndarray) -> None:
        """All distances of these rows."""
        k, b = len(centroids), self.near.shape[1]
        squares = np.stack([_squares(x[rows], c) for c in centroids], axis=1)
        names = np.broadcast_to(np.arange(k, dtype=np.int32), squares.shape)
        order = _by_distance(squares, names)
        roots = np.sqrt(np.take_along_axis(squares, order, axis=1))
        self.own[rows], self.upper[rows] = order[:, 0], roots[:, 0]
        self.near[rows], self.low[rows] = order[:, 1 : b + 1], roots[:, 1 : b + 1]
        self.rest[rows] = roots[:, b + 1] if k > b + 1 else np.inf
        self.scans[rows] += k

    def rescan(self, x: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> None:
        """The exact assignment to centroids that have moved by these distances."""
        self.upper = self.upper + moved[self.own]
        self.low = self.low - moved[self.near]
        self.rest = self.rest - moved.max()
        least = lambda rows: np.minimum(self.low[rows].min(axis=1, initial=np.inf), self.rest[rows])
        sure = lambda a, b: a * (1 + LOOSE) + LOOSE < b  # noqa: E731  strictly nearer, so no tie either
        rows = np.flatnonzero(~sure(self.upper, least(slice(None))))
        self.upper[rows] = np.sqrt(_squares(x[rows], centroids[self.own[rows]]))
        self.scans[rows] += 1
        rows = rows[~sure(self.upper[rows], least(rows))]
        among = sure(self.upper[rows], self.rest[rows])
        self.scan(x, centroids, rows[~among])
        rows = rows[among]
        if len(rows):
            names = np.column_stack([self.own[rows], self.near[rows]])
            squares = np.stack([_squares(x[rows], centroids[names[:, j]]) for j in range(names.shape[1])], axis=1)
            order = _by_distance(squares, names)
            names, roots = np.take_along_axis(names, order, axis=1), np.sqrt(np.take_along_axis(squares, order, axis=1))
            self.own[rows], self.near[rows] = names[:, 0], names[:, 1:]
            self.upper[rows], self.low[rows] = roots[:, 0], roots[:, 1:]
            self.scans[rows] += names.shape[1] - 1


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(np.arange(0, (n + 1) * width, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32), np.ascontiguousarray(values).ravel())


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


_STATE = "vec_id {kind}, x array<int>, own int, prior int, upper double, near array<int>, low array<double>, rest double, scans long, distance long"


def _assigned(state: DataFrame, centroids: np.ndarray, moved: np.ndarray | None, near: int, kind: str) -> DataFrame:
    """The state after one more assignment; without bounds yet where moved is None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _rows(b.column("x"), centroids.shape[1]).astype(np.int64)
            if moved is None:
                prior, scans, bounds = np.full(len(x), -1, np.int32), 0, Bounds.scanned(x, centroids, near)
            else:
                take = lambda c: b.column(c).to_numpy(zero_copy_only=False).copy()
                prior, scans = take("own"), take("scans")
                bounds = Bounds(prior.copy(), take("upper"), _rows(b.column("near"), near).copy(), _rows(b.column("low"), near).copy(), take("rest"))
                bounds.rescan(x, centroids, moved)
            flat = [bounds.own, prior, bounds.upper, _lists(bounds.near), _lists(bounds.low), bounds.rest, scans + bounds.scans, _squares(x, centroids[bounds.own])]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), *[c if isinstance(c, pa.Array) else pa.array(c) for c in flat]], names=["vec_id", "x", "own", "prior", "upper", "near", "low", "rest", "scans", "distance"])

    return state.mapInArrow(run, _STATE.format(kind=kind))


def _changes(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """What the vectors that changed their centroid add to each centroid's count and sums, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for b in batches:
            x = np.column_stack([_rows(b.column("x"), dims).astype(np.int64), np.ones(b.num_rows, np.int64)])
            for c in range(k):
                total[c] += x[b.column("own").to_numpy() == c].sum(axis=0) - x[b.column("prior").to_numpy() == c].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), _lists(total)], names=["c", "s"])

    parts = state.filter("own <> prior").select("x", "own", "prior").mapInArrow(run, "c int, s array<long>")
    total = np.zeros((k, dims + 1), np.int64)
    for r in parts.select("c", F.posexplode("s").alias("d", "s")).groupBy("c", "d").agg(F.sum("s").alias("s")).collect():
        total[r["c"], r["d"]] = r["s"]
    return total[:, dims], total[:, :dims]


def _per_cluster(values: list, own: Column, kind: str) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), own + 1)


def cluster(vectors: DataFrame, clusters: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, scans.

    Vectors are taken as the whole numbers floor(1024 x). Those that are null, of another length than dims, or have
    null or non-finite entries, or entries beyond 2^27, are left out. Centroids start as the vectors with the smallest
    SHA-256 of seed:id (a null id is empty; of equal ids by their entries); with fewer vectors there are fewer. Each
    round assigns every vector to the nearest centroid, of equally near ones to that with the smaller number, and
    replaces each centroid that has vectors by the floor of their mean; one that has none stays. Then vectors are
    assigned once more. scans counts the exact distances that each vector took. An empty table gives no rows; ids may
    repeat; other columns are ignored. Each round reads and writes one table, and a lost task repeats from it; the
    table before goes once the next is written.
    """
    spark = vectors.sparkSession
    entries = F.col(vector_col)
    whole = lambda c: F.floor(c.cast("double") * SCALE)
    sound = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * SCALE) < LARGEST))
    kept = vectors.filter(entries.isNotNull() & (F.size(entries) == dims) & sound)
    slim = materialize(kept.select(F.col(id_col).alias("vec_id"), F.transform(entries, lambda c: whole(c).cast("int")).alias("x")), "vectors")
    kind = slim.schema["vec_id"].dataType.simpleString()
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = slim.select("x", name.alias("name")).orderBy("name", "x").limit(clusters).collect()  # as many rows as clusters
    k = len(first)
    if not k:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, scans long")
    centroids = np.array([r["x"] for r in first], np.int64)
    near = max(0, min(NEXT, k - 1))
    counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
    state, moved = slim, None
    for at in range(rounds + 1):
        was, state = state, materialize(_assigned(state, centroids, moved, near, kind), "assigned")
        discard(was)
        if at == rounds:
            break
        more, add = _changes(state, k, dims)
        counts, sums = counts + more, sums + add
        old, centroids = centroids, np.array([s // n if n else c for s, n, c in zip(sums, counts, centroids)])
        moved = np.sqrt(_squares(centroids, old))
        if not moved.any():  # nor will anything change in the rounds to come
            break
    parts = {r["own"]: r["d"] for r in state.groupBy("own").agg(F.sum("distance").alias("d")).collect()}
    own, names = F.col("own"), [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return state.select(
        "vec_id", own.alias("cluster"), "distance", _per_cluster([parts.get(c, 0) for c in range(k)], own, "long").alias("cluster_inertia"),
        F.lit(sum(parts.values())).cast("long").alias("inertia"), _per_cluster(names, own, "string").alias("centroid_sha256"), "scans",
    )
