"""Embedding whitening from moments merged pairwise.

Each partition computes the count, the local mean and the scatter about it. Two summaries merge by the formula of Chan, Golub and LeVeque, in a
``treeReduce``, so that no large numbers cancel. The driver decomposes the covariance; a second pass over the data takes the
covariance of the whitened vectors the same way and compares it with the identity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.storage import materialise
from tracewell.llm.vectors import lists, matrix, scaled_vectors

COMPONENTS, SHIFT = 8, 100_000
#: Rows whose products are taken at once; levels of the merge.
ROWS, DEPTH = 4096, 3


@dataclass(frozen=True)
class Moments:
    """Count, mean and scatter about the mean (sum of outer products), and the sum, which is exact for whole numbers."""

    n: int
    total: np.ndarray
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Moments:
        total = rows.sum(axis=0)
        mean = total / len(rows)
        apart = rows - mean
        return cls(len(rows), total, mean, apart.T @ apart)

    def merged(self, other: Moments) -> Moments:
        n, gap = self.n + other.n, other.mean - self.mean
        return Moments(n, self.total + other.total, self.mean + gap * (other.n / n), self.scatter + other.scatter + np.outer(gap, gap) * (self.n * (other.n / n)))


def moments(table: DataFrame, column: str) -> Moments | None:
    """The moments of an array column whose rows have one length and no nulls; None without rows.

    One row a task, of the square of the length, enters the merge; each step of it holds two.
    """
    whole = table.schema[column].dataType.elementType.simpleString() == "bigint"
    kind = np.int64 if whole else np.float64

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = matrix(batch.column(0), kind)
            for at in range(0, len(rows), ROWS):
                own = Moments.of(rows[at : at + ROWS])
                held = own if held is None else held.merged(own)
        if held is not None:
            yield pa.record_batch([pa.array([held.n]), *(pa.array([x.tobytes()], pa.binary()) for x in (held.total, held.mean, held.scatter))], names=["n", "total", "mean", "scatter"])

    def read(r) -> Moments:
        mean = np.frombuffer(r["mean"])
        return Moments(r["n"], np.frombuffer(r["total"], kind), mean, np.frombuffer(r["scatter"]).reshape(len(mean), -1))

    parts = table.select(column).mapInArrow(kernel, "n long, total binary, mean binary, scatter binary").rdd.map(read)
    return parts.map(lambda m: m).treeReduce(Moments.merged, DEPTH) if not table.isEmpty() else None


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: ``(x - mean) @ axes`` has the identity as its covariance. Components without variance have axes of NaN."""

    n: int
    total: np.ndarray
    axes: np.ndarray
    explained: np.ndarray

    @classmethod
    def fit(cls, m: Moments, components: int) -> Whitening:
        value, vector = np.linalg.eigh(m.scatter / m.n)
        value, vector = value[::-1], vector[:, ::-1]
        k, least = min(components, len(value)), max(value[0], 0) * len(value) * np.finfo(float).eps
        real = value[:k] > least
        axes = np.where(real, vector[:, :k] / np.sqrt(np.where(real, value[:k], 1)), np.nan)
        trace = np.trace(m.scatter) / m.n
        return cls(m.n, m.total, axes, np.maximum(value[:k], 0) / trace if trace > 0 else np.full(k, np.nan))

    def project(self, rows: np.ndarray) -> np.ndarray:
        return (rows - self.total / self.n) @ self.axes

    def deviation(self, rows: np.ndarray) -> list[int | None]:
        """Sums of (n * x - total)², exact; None beyond 64 bits."""
        largest = float(np.abs(rows).max(initial=0)) * self.n + float(np.abs(self.total).max())
        if 4 * largest * largest * rows.shape[1] < 2**62:
            return ((self.n * rows - self.total) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * x - t) ** 2 for x, t in zip(row, self.total.tolist(), strict=True)) for row in rows.tolist()]
        return [d if d < 2**63 else None for d in exact]


def whiten(table: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None, float | None]:
    """((vec_id, deviation, whitened array<double>), transform, identity error) of the ``embeddings`` rows with a whole vector.

    Rows whose vector is null, empty or holds null or non-finite components are dropped; ``scaled_vectors`` says what is done with other lengths and with very
    large components. Repeated rows and null ids are rows like any other, in the fit too. Components with equal eigenvalues come in any order. A component without
    variance (fewer independent rows than components, or all rows equal) is null in every row, and its share too if there is no variance at all; the
    identity error, taken over the others, is then null if there are none. A deviation beyond 64 bits is null. An empty table gives no rows. Other columns are
    ignored. The driver and each task hold numbers in the square of the vectors' length.
    """
    points = materialise(scaled_vectors(table).select("vec_id", F.transform("x", lambda c: c + SHIFT).alias("x")), "points")
    kind = "vec_id long, deviation long, whitened array<double>"
    m = moments(points, "x")
    if m is None:
        return table.sparkSession.createDataFrame([], kind), None, None
    fit = Whitening.fit(m, components)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column(1))
            for at in range(0, len(rows), ROWS):
                own = rows[at : at + ROWS]
                yield pa.record_batch([batch.column(0).slice(at, len(own)), pa.array(fit.deviation(own), pa.int64()), lists(fit.project(own))], names=["vec_id", "deviation", "whitened"])

    out = materialise(points.mapInArrow(kernel, kind), "whitened")
    real = np.flatnonzero(~np.isnan(fit.axes[0])) if fit.axes.size else np.array([], int)
    if not len(real):
        return out, fit, None
    second = moments(out.select(F.slice("whitened", 1, int(real[-1]) + 1).alias("w")), "w")
    return out, fit, float(np.abs(second.scatter / second.n - np.eye(len(second.mean))).max())


def whitening_rows(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each kept row and component, numbered from 1; all cases as in ``whiten``."""
    out, fit, error = whiten(table, components)
    n, shares = (fit.n, [None if np.isnan(s) else float(s) for s in fit.explained]) if fit else (0, [])
    each = out.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "w"))
    share = F.get(F.lit(shares).cast("array<double>") if shares else F.array().cast("array<double>"), F.col("at"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.when(~F.isnan("w"), F.col("w")).alias("whitened"), share.alias("explained"), F.lit(error).cast("double").alias("identity_error")
    )
