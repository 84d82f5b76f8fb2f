"""Perceptrons with ReLU layers, L2 penalty, momentum or Adam, and early stop.

Rows are dealt into ``batches`` mini-batches an epoch by a hash of their id, a new deal every epoch.
A step is one job: every task adds up the gradient of its rows of the batch, and the driver, which holds
nothing but the weights, adds the tasks' sums and moves them; the weights go out with the next job's
closure. Tables of up to ``blocks.IN_TASK`` rows are fitted by one task instead. Gradients are added as
whole multiples of 2^-``SCALE``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .. import config as C
from ..session import parts_for
from . import blocks as B
from .boost import _sigmoid, uniform

SCALE = 30


def initial(layers: Sequence[int], rng: np.random.RandomState) -> list[np.ndarray]:
    """Weights [in, out] and biases of every layer, even in +-sqrt(6 / (in + out))."""
    out = []
    for a, b in zip(layers, layers[1:]):
        bound = np.sqrt(6.0 / (a + b))
        out += [rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)]
    return out


def forward(weights: Sequence[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    """Activations of all layers: the input, ReLU layers, the probability of 1."""
    held = [x]
    for i in range(0, len(weights), 2):
        z = held[-1] @ weights[i] + weights[i + 1]
        held.append(np.maximum(z, 0.0) if i + 2 < len(weights) else _sigmoid(z))
    return held


def gradient(weights: Sequence[np.ndarray], x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """The cross-entropy's gradient, summed over the rows."""
    held = forward(weights, x)
    delta, out = held[-1] - y[:, None], []
    for i in range(len(weights) - 2, -1, -2):
        before = held[i // 2]
        out = [before.T @ delta, delta.sum(0), *out]
        if i:
            delta = delta @ weights[i].T * (before > 0)
    return out


@dataclass
class Momentum:
    """Descent with Nesterov's momentum."""

    rate: float
    momentum: float = 0.9

    def move(self, weights: list, grads: list) -> list:
        if not hasattr(self, "speed"):
            self.speed = [np.zeros_like(w) for w in weights]
        self.speed = [self.momentum * v - self.rate * g for v, g in zip(self.speed, grads)]
        return [w + self.momentum * v - self.rate * g for w, v, g in zip(weights, self.speed, grads)]


@dataclass
class Adam:
    rate: float
    b1: float = 0.9
    b2: float = 0.999
    eps: float = 1e-8

    def move(self, weights: list, grads: list) -> list:
        if not hasattr(self, "t"):
            self.t, self.m, self.v = 0, [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        self.t += 1
        self.m = [self.b1 * m + (1 - self.b1) * g for m, g in zip(self.m, grads)]
        self.v = [self.b2 * v + (1 - self.b2) * g * g for v, g in zip(self.v, grads)]
        rate = self.rate * np.sqrt(1 - self.b2**self.t) / (1 - self.b1**self.t)
        return [w - rate * m / (np.sqrt(v) + self.eps) for w, m, v in zip(weights, self.m, self.v)]


@dataclass
class Perceptron:
    layers: list
    weights: list          # flat lists, layer by layer
    history: list          # accuracy on the held-out rows by epoch, with early stop

    def _arrays(self) -> list[np.ndarray]:
        shapes = [s for a, b in zip(self.layers, self.layers[1:]) for s in ((a, b), (b,))]
        return [np.array(w, np.float64).reshape(s) for w, s in zip(self.weights, shapes, strict=True)]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return forward(self._arrays(), x)[-1][:, 0]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the vector ``probability`` of its vector ``features``."""
        width = self.layers[0]

        @pandas_udf("double")
        def p1(x: pd.Series) -> pd.Series:
            return pd.Series(self.probability(np.array(x.tolist(), np.float64).reshape(len(x), width)))

        p = p1(vector_to_array("features"))
        return df.withColumn("_p1", p).withColumn("probability", array_to_vector(F.array(1 - F.col("_p1"), F.col("_p1")))).drop("_p1")

    def to_dict(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_dict(d: dict) -> "Perceptron":
        return Perceptron(**d)


def _split(flat: np.ndarray, like: Sequence[np.ndarray]) -> list[np.ndarray]:
    ends = np.cumsum([w.size for w in like])[:-1]
    return [part.reshape(w.shape) for part, w in zip(np.split(flat, ends), like)]


def fit_perceptron(rows: DataFrame, ids: Sequence[str], hidden: Sequence[int], features: str = "features", label: str = "label",
                   solver: str = "adam", rate: float = 0.01, momentum: float = 0.9, alpha: float = 1e-4, batches: int = 8,
                   epochs: int = 60, patience: int | None = 10, held_out: float = 0.1, tol: float = 1e-4, seed: int = C.SEED) -> Perceptron:
    """A perceptron fitted on a vector column and a 0/1 label.

    ``batches`` steps make an epoch. ``patience``: a share ``held_out`` of the rows is scored after
    every epoch; after so many epochs in a row without ``tol`` more accuracy training stops, and the
    best epoch's weights stay. ``alpha`` is the L2 penalty on the weights, not on the biases.
    """
    if solver not in ("adam", "sgd"):
        raise ValueError(solver)
    given, width, n_rows = B.hashed(rows, ids, features, label, seed)
    pieces = parts_for(rows.sparkSession, n_rows)
    layers = [width, *hidden, 1]
    weights = initial(layers, np.random.RandomState(seed))
    size, unit = sum(w.size for w in weights), 2.0**SCALE

    def aside(h: np.ndarray) -> np.ndarray:
        return uniform(h, -1) < held_out if patience else np.zeros(len(h), bool)

    def batch_of(h: np.ndarray, epoch: int) -> np.ndarray:
        """The mini-batch of every row, -1 for those held out."""
        return np.where(aside(h), -1, (uniform(h, epoch) * batches).astype(int))

    def gradient_of(now: list, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The gradient's sum as whole multiples of 1 / unit, then the number of rows."""
        total = np.zeros(size)
        for i in range(0, len(y), B.CHUNK):
            total += np.concatenate([g.ravel() for g in gradient(now, x[i:i + B.CHUNK], y[i:i + B.CHUNK])])
        return np.append(np.rint(total * unit).astype(np.int64), len(y))

    def hits_of(now: list, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        hit = sum(int(((forward(now, x[i:i + B.CHUNK])[-1][:, 0] > 0.5) == (y[i:i + B.CHUNK] == 1)).sum()) for i in range(0, len(y), B.CHUNK))
        return np.array([hit, len(y)])

    def trained(batch_gradient: Callable[[list, int, int], np.ndarray], hits: Callable[[list], np.ndarray]) -> Perceptron:
        now, history, best, waited = weights, [], (-1.0, weights), 0
        rule = Adam(rate) if solver == "adam" else Momentum(rate, momentum)
        for epoch in range(epochs):
            for batch in range(batches):
                *flat, n = batch_gradient(now, epoch, batch)
                if n:
                    grads = _split(np.array(flat, float) / unit, now)
                    grads = [(g + alpha * w if i % 2 == 0 else g) / n for i, (g, w) in enumerate(zip(grads, now))]
                    now = rule.move(now, grads)
            if patience:
                hit, n = hits(now)
                history.append(float(hit / max(n, 1)))
                waited = 0 if history[-1] > best[0] + tol else waited + 1
                if history[-1] > best[0]:
                    best = history[-1], now
                if waited > patience:
                    break
        final = best[1] if patience else now
        return Perceptron(layers, [w.ravel().tolist() for w in final], history)

    def alone(h: np.ndarray, x: np.ndarray, y: np.ndarray) -> str:
        out, dealt = aside(h), {}

        def batch_gradient(now: list, epoch: int, batch: int) -> np.ndarray:
            if epoch not in dealt:
                dealt.clear()
                dealt[epoch] = batch_of(h, epoch)
            use = np.flatnonzero(dealt[epoch] == batch)
            return gradient_of(now, x[use], y[use])
        held = x[out], y[out]
        return json.dumps(trained(batch_gradient, lambda now: hits_of(now, *held)).to_dict())

    if n_rows <= B.IN_TASK:
        return Perceptron.from_dict(json.loads(B.in_one_task(given, width, n_rows, alone)))
    table = B.packed(given, width, pieces)

    def by_job(now: list, epoch: int, batch: int) -> np.ndarray:
        def step(parts: Iterator[pa.RecordBatch]) -> np.ndarray:
            total = np.zeros(size + 1, np.int64)
            for h, x, y in B.blocks(parts, "<f8"):
                use = np.flatnonzero(batch_of(h, epoch) == batch)
                total += gradient_of(now, x[use], y[use])
            return total
        return B.summed(table, step)

    def hits_by_job(now: list) -> np.ndarray:
        def step(parts: Iterator[pa.RecordBatch]) -> np.ndarray:
            return sum((hits_of(now, x[out], y[out]) for h, x, y in B.blocks(parts, "<f8") for out in [aside(h)]), np.zeros(2, np.int64))
        return B.summed(table, step)
    return trained(by_job, hits_by_job)
