"""Multilayer perceptrons: Spark's own model, fitted over rows that are packed into blocks once.

Spark's estimator goes through a round element by element, which costs several times what the rows' arithmetic does. Here each
task keeps its rows as blocks of doubles and a round is a few array operations on a block; what comes back from a task is one
sum of losses and of gradients. The loss, the first weights (by seed) and the search (L-BFGS of ten steps, strong Wolfe
conditions, stops) are Spark's, but for one thing: each row counts once, while Spark gives a short block the weight of a full one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of the widest layer in a block, so that a round's arrays stay in a core's cache.
BLOCK_VALUES = 1 << 15
#: Bytes of gradients that the driver takes in a round as they are; more are added up in tasks first.
GRADIENT_BYTES = 1 << 24

_SUMS = "n long, loss double, gradient binary"


def _kernel() -> Callable:
    """A function that goes to executors whole: they need not have this module."""

    def loss_and_gradient(w: np.ndarray, layers: Sequence[int], x: np.ndarray, label: np.ndarray) -> tuple[float, np.ndarray]:
        """Sums over the columns of x of the cross-entropy and of its gradient; sigmoid layers, softmax on top, w as Spark lays it out."""
        steps, at = [], 0
        for i, o in pairwise(layers):
            steps.append((w[at : at + i * o].reshape(i, o).T, w[at + i * o : at + i * o + o, None]))
            at += i * o + o
        values = [x]
        with np.errstate(over="ignore"):  # exp of a large number is infinite and its reciprocal 0, as it should be
            for m, b in steps[:-1]:
                z = m @ values[-1] + b
                np.exp(np.negative(z, out=z), out=z)
                z += 1
                values.append(np.reciprocal(z, out=z))
        z = steps[-1][0] @ values[-1] + steps[-1][1]
        z -= z.max(axis=0)
        row = np.arange(z.shape[1])
        own = z[label, row]
        np.exp(z, out=z)
        total = z.sum(axis=0)
        loss = float((np.log(total) - own).sum())
        z /= total
        z[label, row] -= 1
        parts = []
        for at in range(len(steps) - 1, -1, -1):
            parts += [z.sum(axis=1), (values[at] @ z.T).ravel()]
            if at:
                z = steps[at][0].T @ z
                z *= values[at]
                z *= 1 - values[at]
        return loss, np.concatenate(parts[::-1])

    return loss_and_gradient


loss_and_gradient = _kernel()


def minimised(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int, tol: float, memory: int = 10) -> np.ndarray:
    """Where L-BFGS comes to from x in at most this many rounds; f gives value and gradient."""
    value, grad = f(x)
    seen, steps, failed = [value], [], False
    while len(seen) <= rounds and np.linalg.norm(grad) > max(tol * abs(value), 1e-8):
        found = _searched(f, x, value, grad, _direction(grad, steps), 1.0 if steps else 1.0 / np.linalg.norm(grad))
        if found is None:
            if failed:
                break
            steps, failed = [], True
            continue
        failed, (x1, value, grad1) = False, found
        steps = [*steps, (x1 - x, grad1 - grad)][-memory:]
        x, grad = x1, grad1
        seen.append(value)
        if abs(value - max(seen[-20:])) <= tol * seen[0]:
            break
    return x


def _direction(grad: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    d, back = -grad, []
    for s, y in reversed(steps):
        back.append((s @ d) / (s @ y))
        d = d - back[-1] * y
    if steps:
        s, y = steps[-1]
        d = d * ((s @ y) / (y @ y))
    for (s, y), a in zip(steps, reversed(back)):
        d = d + (a - (y @ d) / (s @ y)) * s
    return d


def _searched(f: Callable, x: np.ndarray, value: float, grad: np.ndarray, d: np.ndarray, t: float) -> tuple[np.ndarray, float, np.ndarray] | None:
    """(point, value, gradient) along d where the strong Wolfe conditions hold; None if it is not found."""
    slope = float(grad @ d)
    if not slope < 0:
        return None

    def phi(t: float) -> tuple:
        v, g = f(x + t * d)
        return t, v, float(g @ d), g

    def between(a: tuple, b: tuple) -> float:
        (t0, v0, s0, _), (t1, v1, s1, _) = sorted((a, b), key=lambda p: p[0])
        d1 = s0 + s1 - 3 * (v0 - v1) / (t0 - t1)
        square = d1 * d1 - s0 * s1
        d2 = square**0.5 if square >= 0 else float("nan")
        t = t1 - (t1 - t0) * (s1 + d2 - d1) / (s1 - s0 + 2 * d2) if s1 - s0 + 2 * d2 else float("nan")
        if not t == t:
            return (t0 + t1) / 2
        return min(max(t, t0 + 0.1 * (t1 - t0)), t0 + 0.9 * (t1 - t0))

    def zoomed(low: tuple, high: tuple) -> tuple | None:
        for _ in range(10):
            c = phi(between(low, high))
            if c[1] > value + 1e-4 * c[0] * slope or c[1] >= low[1]:
                high = c
                continue
            if abs(c[2]) <= 0.9 * abs(slope):
                return c
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        return None

    low, end = (0.0, value, slope, grad), None
    for i in range(10):
        c = phi(t)
        if not np.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value + 1e-4 * t * slope or (c[1] >= low[1] and i > 0):
            end = zoomed(low, c)
        elif abs(c[2]) <= 0.9 * abs(slope):
            end = c
        elif c[2] >= 0:
            end = zoomed(c, low)
        else:
            low, t = c, t * 1.5
            continue
        break
    return end and (x + end[0] * d, end[1], end[3])


def _packed(df: DataFrame, features: str, label: str, layers: Sequence[int]) -> DataFrame:
    """(x, label): blocks of rows, a feature's values one after another; classes as ints."""
    size, classes, rows = layers[0], layers[-1], max(1, BLOCK_VALUES // max(layers))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(0).flatten(), dtype=np.float64)
            y = b.column(1).to_numpy(zero_copy_only=False)
            if x.size != b.num_rows * size:
                raise ValueError(f"a row has not {size} features")
            if not ((y >= 0) & (y < classes) & (y == np.floor(y))).all():
                raise ValueError(f"a label is not a whole number from 0 to {classes - 1}")
            x, y = x.reshape(-1, size), y.astype(np.int32)
            for at in range(0, len(y), rows):
                block = [[np.ascontiguousarray(x[at : at + rows].T).tobytes()], [y[at : at + rows].tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in block], ["x", "label"])

    return df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("label")).mapInArrow(pack, "x binary, label binary")


def _sums(blocks: DataFrame, layers: Sequence[int], w: np.ndarray, tasks: int) -> tuple[int, float, np.ndarray]:
    """Rows, and sums of losses and gradients over all blocks."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, grad = 0, 0.0, np.zeros_like(w)
        for b in batches:
            for x, label in zip(b.column(0), b.column(1)):
                y = np.frombuffer(label.as_buffer(), np.int32)
                one, g = loss_and_gradient(w, layers, np.frombuffer(x.as_buffer(), np.float64).reshape(layers[0], -1), y)
                n, loss, grad = n + len(y), loss + one, grad + g
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([loss]), pa.array([grad.tobytes()], pa.binary())], ["n", "loss", "gradient"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, grad = 0, 0.0, np.zeros_like(w)
        for b in batches:
            for k, one, g in zip(*b.columns):
                n, loss, grad = n + k.as_py(), loss + one.as_py(), grad + np.frombuffer(g.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([loss]), pa.array([grad.tobytes()], pa.binary())], ["n", "loss", "gradient"])

    sums = blocks.mapInArrow(part, _SUMS)
    if tasks * w.nbytes > GRADIENT_BYTES:
        sums = sums.repartition(max(1, int(tasks**0.5))).mapInArrow(added, _SUMS)
    rows = sums.collect()  # a row for each task
    return sum(r.n for r in rows), sum(r.loss for r in rows), sum((np.frombuffer(r.gradient) for r in rows), np.zeros_like(w))


class Perceptron(MultilayerPerceptronClassifier):
    """MultilayerPerceptronClassifier whose l-bfgs goes through packed blocks; blockSize only matters to the other solver.

    The model has no training summary.
    """

    def _fit(self, dataset: DataFrame) -> MultilayerPerceptronClassificationModel:
        if self.getSolver() != "l-bfgs":
            return super()._fit(dataset)
        layers = self.getLayers()
        w = self._at(dataset, {}).weights.toArray()  # those given, or those of the seed
        blocks = _packed(dataset, self.getFeaturesCol(), self.getLabelCol(), layers).persist()
        try:
            tasks = blocks.rdd.getNumPartitions()

            def mean(at: np.ndarray) -> tuple[float, np.ndarray]:
                n, loss, grad = _sums(blocks, layers, at, tasks)
                if not n:
                    raise ValueError("there are no rows to learn from")
                return loss / n, grad / n

            w = minimised(mean, w, self.getMaxIter(), self.getTol())
        finally:
            blocks.unpersist()
        return self._copyValues(self._at(dataset, {self.initialWeights: Vectors.dense(w)}))

    def _at(self, dataset: DataFrame, params: dict) -> MultilayerPerceptronClassificationModel:
        """Spark's model with the weights that it begins with: no round is made, over a row of zeros."""
        spark = dataset.sparkSession
        zeros = array_to_vector(F.array_repeat(F.lit(0.0), self.getLayers()[0]))
        one = spark.range(0, 1, 1, 1).select(zeros.alias(self.getFeaturesCol()), F.lit(0.0).alias(self.getLabelCol()))
        model = MultilayerPerceptronClassifier._fit(self.copy({**params, self.maxIter: 0}), one)
        model._java_obj.setSummary(spark._jvm.scala.Option.empty())
        if not self.isSet(self.initialWeights):
            model.clear(model.initialWeights)
        return model
