"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated isotonically."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from . import labelled
from .common import materialize, slices
from .text_stats import NAMES, stats

FEATURES = 192
#: Standard deviations over which the approximated Gaussian kernel falls off.
KERNEL_WIDTH = 4.0
RIDGE = 1e-3
THRESHOLD = 0.3
#: The fold of labelled documents that calibrates; the other training folds fit the scores.
CALIBRATION_FOLD = 1
#: Column of a document's statistics.
STATS = "_stats"
_CLIP = 8.0


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # scores and calibrated values between which scores are interpolated
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -_CLIP, _CLIP)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.concatenate([np.ones((len(x), 1)), z, waves], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.features(x) @ self.weights, self.knots, self.values)


def pool(parts: Iterable[tuple[float, float, float]]) -> list[list[float]]:
    """Pools adjacent violators of parts (sum of y, size, sum of scores) by rising score: their shares of 1 rise.

    Pooling stretches of the parts first changes nothing. Of n labels at most some n ** (2 / 3) pools remain, since
    their shares are different fractions.
    """
    pools: list[list[float]] = []
    for part in parts:
        pools.append(list(part))
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return pools


def curve(pools: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
    """Knots at the pools' mean scores, values their shares of 1, pulled a little inwards.

    Between knots the caller interpolates, so that documents of neighbouring pools keep their order; past the ends the
    lines run on to 0 and 1.
    """
    knots = np.array([p[2] / p[1] for p in pools])
    values = np.array([(p[0] + 0.5) / (p[1] + 1) for p in pools])
    values = np.maximum.accumulate(values)
    pad = max(1.0, float(np.ptp(knots)))
    return np.r_[knots[0] - pad, knots, knots[-1] + pad], np.r_[0.0, values, 1.0]


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(score, kind="stable")
    return curve(pool((v, 1.0, s) for s, v in zip(score[order].tolist(), y[order].tolist())))


def _isotonic(rows: DataFrame, linear: Model) -> tuple[np.ndarray, np.ndarray]:
    """isotonic() over rows (x, y): tasks pool ranges of scores, the driver the pools that remain. Equal scores are one part."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = linear.features(_matrix(b.column("x"))) @ linear.weights
            yield pa.RecordBatch.from_arrays([pa.array(raw.round(12)), b.column("y")], names=["score", "y"])

    def pools(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[float]] = []
        for b in batches:
            y, n, at = (b.column(c).to_numpy().astype(float) for c in ("y", "n", "score"))
            found = pool([*found, *zip(y.tolist(), n.tolist(), (at * n).tolist())])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*found)], names=["y", "n", "total"])

    scores = rows.select("x", "y").mapInArrow(score, "score double, y int").groupBy("score").agg(F.sum("y").alias("y"), F.count("*").alias("n"))
    found = scores.repartitionByRange("score").sortWithinPartitions("score").mapInArrow(pools, "y double, n double, total double").collect()
    return curve(pool(sorted(map(tuple, found), key=lambda p: p[2] / p[1])))


def _matrix(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def measured(docs: DataFrame) -> DataFrame:
    """docs with the statistics of each text as STATS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = pa.array([stats(t).tolist() for t in b.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, x], names=[*b.schema.names, STATS])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(STATS, ArrayType(DoubleType()))]))


def fit(rows: DataFrame, labels: DataFrame, features: int = FEATURES, seed: int = 5) -> Model:
    """Fits on every labelled one of rows (doc_id, STATS) outside the held-out fold. Without both labels the scores are constant.

    Each task sums its own normal equations, Spark sums those, and the driver solves one system whose size depends on
    `features` alone.
    """
    # labels grow with the documents, so they are no table to broadcast
    joined = rows.select("doc_id", F.col(STATS).alias("x")).join(labelled.known(labels, "quality").hint("merge"), "doc_id")
    rows = materialize(joined.select("x", "y", "fold"), "quality-labelled")
    rng = np.random.default_rng(seed)
    p = len(NAMES)
    directions, phases = rng.normal(size=(p, features)) / KERNEL_WIDTH, rng.uniform(0, 2 * np.pi, features)
    each = [F.get("x", F.lit(k)) for k in range(p)]
    n, share, *moments = rows.agg(F.count("*"), F.avg("y"), *map(F.avg, each), *map(F.stddev_pop, each)).first()
    blank = Model(np.zeros(p), np.ones(p), directions, phases, np.zeros(1 + p + features), np.array([0.0]), np.array([0.5]))
    if not n or not 0 < share < 1:
        share = (share * n + 1) / (n + 2) if n else 0.5
        return Model(blank.mean, blank.spread, directions, phases, blank.weights, np.array([0.0]), np.array([share]))
    mean, spread = np.array(moments[:p]), np.array(moments[p:])
    base = Model(mean, np.where(spread > 1e-9, spread, 1.0), directions, phases, blank.weights, blank.knots, blank.values)
    shared = rows.sparkSession.sparkContext.broadcast(base)
    size = 1 + p + features
    upper = np.triu_indices(size, 0, size + 1)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            a = shared.value.features(_matrix(b.column("x")))
            own = a.T @ np.column_stack([a, b.column("y").to_numpy()])
            total = own if total is None else total + own
        if total is not None:
            i, j = upper
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[upper])], names=["i", "j", "v"])

    calibrates = F.col("fold") == CALIBRATION_FOLD
    kinds = {r.calibrates: r.n for r in rows.groupBy(calibrates.alias("calibrates")).agg(F.countDistinct("y").alias("n")).collect()}
    scored = rows.filter(~calibrates) if kinds.get(False, 0) > 1 else rows
    held = rows.filter(calibrates) if kinds.get(True, 0) > 1 else rows
    cells = scored.select("x", "y").mapInArrow(equations, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    system = np.zeros((size, size + 1))
    system[cells["i"], cells["j"]] = cells["v"]
    system[:, :size] += np.triu(system[:, :size], 1).T
    n = system[0, 0]
    penalty = np.full(size, RIDGE * n)
    penalty[0] = 1e-9 * n
    weights = np.linalg.solve(system[:, :size] + np.diag(penalty / size), system[:, size])
    linear = Model(base.mean, base.spread, directions, phases, weights, base.knots, base.values)
    knots, values = _isotonic(held, linear)
    return Model(base.mean, base.spread, directions, phases, weights, knots, values)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id, held_out, score (0 to 1), predicted (score >= threshold).

    Scores come from the text alone. Null and empty texts are scored from zero statistics. A null doc_id is kept and
    not held out; repeated rows are scored each; an empty table gives no rows; other columns are ignored.
    """
    rows = materialize(measured(docs.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "text")).drop("text"), "quality-statistics")
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = shared.value.scores(_matrix(b.column(STATS)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with all its columns, without rows whose score is below the threshold.

    The rows are written with their statistics, so that each text is measured once for the fit and the filter.
    """
    rows, names = materialize(measured(docs), "quality-measured"), docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.scores(_matrix(b.column(STATS))) >= threshold)).select(names)

    return rows.mapInArrow(run, docs.schema)
