"""Sums of arrays over tasks, and leading eigenpairs of operators that are only known by such sums."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of partial sums that go to the driver at once; those of more tasks are added up by fewer tasks first.
DIRECT = 1 << 26
#: Operators of at most so many dimensions are done by one product with the identity.
SMALL = 64


def summed(df: DataFrame, add: Callable[[np.ndarray, pa.RecordBatch], None], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all tasks of an array of `shape` to which add(array, batch) adds each Arrow batch of df."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if len(batch):
                add(total, batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.large_binary())], ["sum"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_py()).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.large_binary())], ["sum"])

    parts, tasks = df.mapInArrow(part, "sum binary"), df.rdd.getNumPartitions()
    direct = max(4, DIRECT // (8 * math.prod(shape) + 1))
    while tasks > direct:
        tasks = max(math.isqrt(tasks), 1)
        parts = parts.repartition(tasks).mapInArrow(again, "sum binary")
    return sum((np.frombuffer(row[0]).reshape(shape) for row in parts.collect()), np.zeros(shape))


def leading(product: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, guard: int = 6, certified: float = 1e-11, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the `wanted` largest eigenvalues of a symmetric operator without negative ones.

    A block of wanted + guard vectors is improved within the space of itself, its residuals and its last step: blocked
    subspace iteration with Rayleigh-Ritz, one product with twice the block a round. Only size x block is ever held.
    Ends when the wanted vectors' residuals are below `certified` of the largest eigenvalue.
    """
    wanted = min(wanted, size)
    if size <= SMALL:
        image = product(np.eye(size))
        values, vectors = np.linalg.eigh((image + image.T) / 2)
        return values[::-1][:wanted], vectors[:, ::-1][:, :wanted]
    width = min(wanted + guard, size // 3)
    x = np.linalg.qr(np.random.default_rng(5).standard_normal((size, width)))[0]
    image, step = product(x), np.zeros((size, 0))
    values, turn = np.linalg.eigh((x.T @ image + image.T @ x) / 2)
    x, image = x @ turn[:, ::-1], image @ turn[:, ::-1]
    values = values[::-1]
    for _ in range(rounds):
        residual = image - x * values
        if not values[0] > 0 or np.linalg.norm(residual[:, :wanted], axis=0).max() <= certified * values[0]:
            return values[:wanted], x[:, :wanted]
        new = np.hstack([residual / max(np.linalg.norm(residual), 1e-300), step])
        for _ in range(2):  # once more, as the first pass leaves what rounding hides
            new = new - x @ (x.T @ new)
            basis, weights, _ = np.linalg.svd(new, full_matrices=False)
            new = basis[:, weights > 1e-13 * weights[0]]
        space, images = np.hstack([x, new]), np.hstack([image, product(new)])
        small = space.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:width], turn[:, ::-1][:, :width]
        step = new @ turn[width:]
        x, image = space @ turn, images @ turn
        # Rounding turns x out of orthogonality in the long run.
        x, r = np.linalg.qr(x)
        image = np.linalg.solve(r.T, image.T).T
    raise RuntimeError(f"leading eigenvectors not certified after {rounds} rounds")
