"""Whitening of embeddings: leading eigenvectors of the covariance by Chebyshev-filtered subspace iteration.

Vectors become integers, each distinct one counts once. A pass sums X'(XQ) over the centred rows X of all tasks, for a
block Q of a few dozen columns; no covariance matrix is made. Each round applies a Chebyshev polynomial of it to the
block, a pass a degree, which damps what lies below the block's smallest Ritz value, then orthonormalises and takes
Ritz vectors, until the residuals certify them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Entries become floor(SCALE * entry).
SCALE = 256
#: Columns of the block besides the wanted ones; vectors of no more dimensions than the block are done by one pass.
GUARD = 28
#: Degree of the polynomial, and rounds after which the certificate has to hold.
DEGREE, ROUNDS = 8, 100
#: Components of a smaller share of the largest eigenvalue are rounding, not variance.
LEAST = 1e-12
#: Residuals a round must reach, in units of the largest eigenvalue, and those that will do when rounds no longer lower them.
CERTIFIED, SETTLED = 2e-15, 1e-12
LONGEST = 2.0**63


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


#: Partial sums of more tasks are added up by fewer tasks before they go to the driver.
DIRECT = 64


def _total(df: DataFrame, rows: Callable[[np.ndarray], np.ndarray], dim: int, shape: tuple[int, ...], kind: type = float) -> np.ndarray:
    """The sum of rows(matrix) over all batches of df(x): DIRECT arrays of `shape` or a few more reach the driver."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for batch in batches:
            if len(batch):
                total += rows(_matrix(batch.column(0), dim))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["sum"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_py(), kind).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["sum"])

    parts = df.select("x").mapInArrow(part, "sum binary")
    tasks = df.rdd.getNumPartitions()
    while tasks > DIRECT:
        tasks = math.isqrt(tasks)
        parts = parts.repartition(tasks).mapInArrow(again, "sum binary")
    return sum((np.frombuffer(row[0], kind).reshape(shape) for row in parts.collect()), np.zeros(shape, kind))


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id and x, the vector's entries as floor(256 * entry), of rows without null or non-finite entries.

    Null and empty vectors are dropped, and so are those of another length than most rows have (of equally many the
    longer), as they have no place in a covariance. Entries beyond a long become its bounds. Repeated rows stay.
    """
    entry = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = F.transform(entry, lambda c: F.floor(F.least(F.greatest(F.lit(float(SCALE)) * c, F.lit(-LONGEST)), F.lit(LONGEST - 1024))).cast("long"))
    kept = vectors.select("vec_id", "embedding").where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite).select("vec_id", scaled.alias("x"))
    lengths = kept.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return kept.where(F.size("x") == (lengths[0] if lengths else 0))


class Fit:
    """n, the sums by dimension and the leading eigenpairs of the covariance of the distinct vectors of rows(x)."""

    def __init__(self, distinct: DataFrame, dim: int, components: int, guard: int = GUARD, degree: int = DEGREE) -> None:
        self.distinct, self.dim, self.passes = distinct, dim, 0
        self.n = distinct.count()
        self.sums = _total(distinct, lambda x: x.sum(0), dim, (dim,), np.int64)
        self.mean = np.array([int(s) / self.n for s in self.sums]) if self.n else np.zeros(dim)
        mean = self.mean
        self.trace = float(_total(distinct, lambda x: np.square(x - mean).sum(), dim, ())) / max(self.n, 1)
        self.values, self.vectors, self.residuals = self._solve(min(components, dim), guard, degree)
        real = self.values > LEAST * max(self.trace, np.finfo(float).tiny)
        self.values, self.vectors = self.values[real], self.vectors[:, real]

    def _apply(self, q: np.ndarray) -> np.ndarray:
        """The covariance times q."""
        mean = self.mean
        self.passes += 1

        def rows(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ q)

        return _total(self.distinct, rows, self.dim, q.shape) / self.n

    def _solve(self, wanted: int, guard: int, degree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        width = min(self.dim, wanted + guard)
        if not self.n or self.trace <= 0:
            return np.zeros(0), np.zeros((self.dim, 0)), np.zeros(0)
        q = np.linalg.qr(np.random.default_rng(17).standard_normal((self.dim, width)))[0]
        image = self._apply(q)
        least, stale = np.inf, 0
        for _ in range(ROUNDS):
            values, turn = np.linalg.eigh((q.T @ image + image.T @ q) / 2)
            values, turn = values[::-1], turn[:, ::-1]
            q, image = q @ turn, image @ turn
            residual = np.linalg.norm(image[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0) / values[0]
            worst = float(residual.max())
            stale = 0 if worst < least / 2 else stale + 1
            least = min(least, worst)
            if worst <= CERTIFIED or width == self.dim or (worst <= SETTLED and stale >= 2):
                return values[:wanted], q[:, :wanted], residual
            # Filter: what lies in [0, values[-1]] is mapped into [-1, 1], all above grows.
            middle = max(values[-1], LEAST * values[0]) / 2
            scale = middle / (values[0] - middle)
            first = scale
            before, now = q, (image - middle * q) * (scale / middle)
            for _ in range(degree - 1):
                following = 1 / (2 / first - scale)
                before, now = now, (self._apply(now) - middle * now) * (2 * following / middle) - (scale * following) * before
                scale = following
            q = np.linalg.qr(now)[0]
            image = self._apply(q)
        raise RuntimeError(f"no certificate after {ROUNDS} rounds: residual {worst:.1e} of the largest eigenvalue")

    def identity_error(self) -> float:
        """The largest entry of the whitened covariance minus the identity, by a pass of its own."""
        mean, axes, k = self.mean, self.vectors / np.sqrt(self.values), len(self.values)

        def rows(x: np.ndarray) -> np.ndarray:
            z = (x - mean) @ axes
            return np.vstack([z.T @ z, z.sum(0)])

        sums = _total(self.distinct, rows, self.dim, (k + 1, k)) / self.n
        return float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max()) if k else 0.0


def whiten(vectors: DataFrame, components: int = 4, guard: int = GUARD, degree: int = DEGREE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    vectors has vec_id and embedding (array of numbers); which rows count is said at `integers`. The fit takes each
    distinct integer vector once, written to the shared folder; each pass reads that table, and a block of dimensions x
    (components + guard) doubles a task goes to the driver. A null id or a repeated row is whitened like any other.
    There are fewer components where the vectors have fewer dimensions or the covariance a smaller rank, so a table of
    equal vectors, or an empty one, gives no rows. Components of equal eigenvalues are any basis of their space, the
    same for all rows. deviation is exact, and null where it exceeds a long.
    """
    rows = integers(vectors)
    distinct = written(rows.select("x").distinct())
    first = distinct.first()
    dim = len(first[0]) if first else 1
    fit = Fit(distinct, dim, components, guard, degree)
    n, sums, mean, k = fit.n, fit.sums, fit.mean, len(fit.values)
    axes, share, error = fit.vectors / np.sqrt(fit.values), fit.values / fit.trace if fit.trace else fit.values, fit.identity_error() if k else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch) or not k:
                continue
            x = _matrix(batch.column(1), dim)
            with np.errstate(over="ignore"):
                # Sums of long products are right modulo 2^64, so a deviation that fits a long is exact.
                exact = np.square(n * x - sums).sum(1)
            fits = np.square(float(n) * x - sums.astype(float)).sum(1) < LONGEST * (1 - 1e-9)
            at = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(at), n)),
                    pa.array(exact[at], mask=~fits[at]),
                    pa.array(((x - mean) @ axes).ravel()),
                    pa.array(np.tile(share, len(x))),
                    pa.array(np.full(len(at), error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    key = dict(rows.dtypes)["vec_id"]
    return rows.mapInArrow(run, f"vec_id {key}, component int, n long, deviation long, whitened double, explained double, identity_error double")
