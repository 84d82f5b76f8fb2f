"""Gradient boosting of binned trees with exponential or logistic loss, row subsampling and early stop.

Features are cut once into at most ``bins`` quantile bins. A level of a tree is one job: every task
scores its rows with the trees since the scores were last written, finds their node, and adds up count,
gradient and curvature per (node, feature, bin); the driver adds the tasks' sums, nodes x features x bins
numbers a task, and chooses the splits. The last level's sums also give the leaves, so a tree of depth d
takes d jobs. Tables of up to ``blocks.IN_TASK`` rows are fitted by one task instead. Sums are whole
multiples of 2^-``SCALE``: adding them up in any order gives the same trees on every layout and retry.
Which rows a stage samples and which are held out follows from a hash of the row's id.
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

SCALE = 26
HELD_TREES = 8  # trees by which written scores lag behind


@dataclass
class BoostedTrees:
    """Trees as {node: (feature, threshold)} and {node: value}; node n's children are 2n + 1 and 2n + 2,
    the left one for values up to the threshold."""

    loss: str
    start: float
    rate: float
    trees: list
    history: list

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.trees:
            out += self.rate * leaf_values(tree, x)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.raw(x) * (2.0 if self.loss == "exponential" else 1.0))

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the vector ``probability`` of its vector ``features``."""

        @pandas_udf("double")
        def p1(x: pd.Series) -> pd.Series:
            return pd.Series(self.probability(np.array(x.tolist(), np.float64).reshape(len(x), -1)))

        p = p1(vector_to_array("features"))
        return df.withColumn("_p1", p).withColumn("probability", array_to_vector(F.array(1 - F.col("_p1"), F.col("_p1")))).drop("_p1")

    def to_dict(self) -> dict:
        return asdict(self) | {"trees": [[[int(n), *map(float, v)] for n, v in t.items()] for t in self.trees]}

    @staticmethod
    def from_dict(d: dict) -> "BoostedTrees":
        trees = [{int(n): tuple(v) if len(v) == 1 else (int(v[0]), v[1]) for n, *v in t} for t in d["trees"]]
        return BoostedTrees(**(d | {"trees": trees}))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def nodes_of(tree: dict, x: np.ndarray) -> np.ndarray:
    """The node each row ends in, along the splits that the tree has so far."""
    node = np.zeros(len(x), np.int64)
    split = {n: v for n, v in tree.items() if len(v) == 2}
    if not split:
        return node
    feature = np.full(2 * max(split) + 3, -1)
    bound = np.zeros(len(feature))
    for n, (f, t) in split.items():
        feature[n], bound[n] = f, t
    at = np.arange(len(x))
    while len(at):                               # one level a round
        at = at[feature[node[at]] >= 0]
        own = node[at]
        node[at] = 2 * own + 1 + (x[at, feature[own]] > bound[own])
    return node


def leaf_values(tree: dict, x: np.ndarray) -> np.ndarray:
    leaves = {n: v[0] for n, v in tree.items() if len(v) == 1}
    value = np.zeros(2 * max(tree, default=0) + 3)
    for n, v in leaves.items():
        value[n] = v
    return value[nodes_of(tree, x)]


def gradients(loss: str, y: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(negative gradient, curvature, loss) of every row."""
    if loss == "exponential":
        s = 2 * y - 1
        e = np.exp(-s * f)
        return s * e, e, e
    if loss != "logistic":
        raise ValueError(loss)
    p = _sigmoid(f)
    return y - p, p * (1 - p), np.logaddexp(0.0, f) - y * f


def uniform(ids: np.ndarray, draw: int) -> np.ndarray:
    """Hash-derived numbers in [0, 1) of 64-bit row hashes, other ones for every draw."""
    z = ids.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (draw + 1)) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / 2.0**53


def best_split(h: np.ndarray, min_leaf: int) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of the split of one node's sums [feature, bin, (count, gradient, ..)]
    that parts the mean gradients best; None if there is none. Ties go to the first."""
    left = h.cumsum(1)[:, :-1]
    right = h.sum(1, keepdims=True) - left
    n, m = left[..., 0], right[..., 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = n * m / (n + m) * (left[..., 1] / n - right[..., 1] / m) ** 2
    gain = np.where((n >= min_leaf) & (m >= min_leaf), gain, -1.0)
    if not gain.size or gain.max() <= 1e-12:
        return None
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[f, b]), int(f), int(b)


def fit_boosted(rows: DataFrame, ids: Sequence[str], features: str = "features", label: str = "label", loss: str = "exponential",
                rate: float = 0.03, stages: int = 100, depth: int = 3, min_leaf: int = 40, min_split: int = 20, subsample: float = 1.0,
                patience: int | None = None, held_out: float = 0.1, tol: float = 1e-4, bins: int = 64, seed: int = C.SEED) -> BoostedTrees:
    """Trees fitted stage by stage on a vector column and a 0/1 label.

    ``patience``: hold out a share ``held_out`` of the rows and stop when its loss has not fallen by
    ``tol`` below every one of the last ``patience`` stages; ``history`` is that loss by stage.
    """
    given, width, n_rows = B.hashed(rows, ids, features, label, seed)
    given, pieces = given.checkpoint(), parts_for(rows.sparkSession, n_rows)
    long = given.select(F.posexplode("x").alias("f", "v")).groupBy("f").agg(
        F.percentile_approx("v", [i / bins for i in range(1, bins)], 10_000).alias("q"), F.max("v").alias("top"))
    cuts = {r.f: sorted({v for v in r.q if v < r.top}) for r in long.collect()}  # features x bins numbers
    edges = [np.array(cuts.get(f, [])) for f in range(width)]
    n_bins = max(len(e) for e in edges) + 1
    unit = 2.0**SCALE

    def binned(x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1).astype("<u2")

    def sums_of(h: np.ndarray, x: np.ndarray, y: np.ndarray, f: np.ndarray, tree: dict, stage: int, want: list[int]) -> np.ndarray:
        """Sums of one level's nodes [sum, feature, node, bin], then number and loss of the held-out rows."""
        g, c, lost = gradients(loss, y, f)
        aside = uniform(h, -1) < held_out if patience else np.zeros(len(h), bool)
        use = ~aside & ((uniform(h, stage) < subsample) if subsample < 1 else True)
        place = np.full(2 ** (depth + 1), -1)
        place[want] = np.arange(len(want))
        slot = place[nodes_of(tree, x)]
        at = np.flatnonzero(use & (slot >= 0))
        cells = len(want) * n_bins
        first = slot[at] * n_bins
        cell = (first[:, None] + x[at] + np.arange(width) * cells).ravel()
        flat = [np.bincount(cell, minlength=width * cells)]
        for v in (g[at], c[at]):
            whole = np.rint(v * unit)
            if len(whole) and np.abs(whole).max() * len(whole) < 2.0**53:  # their sum is a whole number as a float, too
                flat.append(np.bincount(cell, np.repeat(whole, width), width * cells).astype(np.int64))
            else:
                flat.append(np.zeros(width * cells, np.int64))
                np.add.at(flat[-1], cell, np.repeat(whole.astype(np.int64), width))
        return np.concatenate([*flat, [int(aside.sum()), int(np.rint(lost[aside] * unit).sum())]]).astype(np.int64)

    def grow(sums: Callable[[list, dict, int, list[int]], np.ndarray]) -> tuple[list, list]:
        trees, history = [], []
        for stage in range(stages):
            tree: dict = {}
            want = [0]
            for d in range(depth):
                *flat, n_aside, lost = sums(trees, tree, stage, want)
                cube = np.array(flat, float).reshape(3, width, len(want), n_bins).transpose(2, 1, 3, 0)
                cube[..., 1:] /= unit
                if d == 0 and stage and patience:
                    history.append(float(lost / unit / max(n_aside, 1)))
                below = []
                for h, n_ in zip(cube, want, strict=True):
                    count = h[0, :, 0].sum()
                    split = best_split(h, min_leaf) if count >= min_split else None
                    if split is None:
                        tree[n_] = (_leaf(h[0].sum(0)),)
                        continue
                    _, f, b = split
                    tree[n_] = (f, b)
                    halves = h[f, :b + 1].sum(0), h[f, b + 1:].sum(0)
                    for child, part in zip((2 * n_ + 1, 2 * n_ + 2), halves, strict=True):
                        tree[child] = (_leaf(part),)
                        below.append(child)
                if d + 1 == depth or not below:
                    break
                want = below
                for n_ in below:  # to be split or made leaves again by the next level
                    tree.pop(n_)
            if patience and stage and not (len(history) <= patience or history[-1] + tol < min(history[-patience - 1:-1])):
                break
            trees.append(tree)
        return trees, history

    def first_score(ones: float) -> float:
        ones = float(np.clip(ones, 1e-9, 1 - 1e-9))
        return float(np.log(ones / (1 - ones)) * (0.5 if loss == "exponential" else 1.0))

    def done(trees: list, history: list, start: float) -> BoostedTrees:
        real = [{n_: (v if len(v) == 1 else (v[0], float(edges[v[0]][v[1]]))) for n_, v in t.items()} for t in trees]
        return BoostedTrees(loss, start, rate, real, history)

    def alone(h: np.ndarray, x: np.ndarray, y: np.ndarray) -> str:
        codes, start = binned(x), first_score(y.mean())
        f, seen = np.full(len(y), start), [0]

        def sums(trees: list, tree: dict, stage: int, want: list[int]) -> np.ndarray:
            for t in trees[seen[0]:]:
                f[:] += rate * leaf_values(t, codes)
            seen[0] = len(trees)
            return sum(sums_of(*[a[i:i + B.CHUNK] for a in (h, codes, y, f)], tree, stage, want) for i in range(0, len(h), B.CHUNK))
        return json.dumps(done(*grow(sums), start).to_dict())

    if n_rows <= B.IN_TASK:
        return BoostedTrees.from_dict(json.loads(B.in_one_task(given, width, n_rows, alone)))
    start = first_score(given.agg(F.avg("y")).first()[0])
    # Scores so far travel as further columns of the blocks and are written again every ``HELD_TREES`` stages.
    table, seen = B.packed(given, width, pieces, binned), 0

    def scored(parts: Iterator[pa.RecordBatch], trees: list) -> Iterator[tuple]:
        for b in parts:
            held = b.column("f").to_pylist() if "f" in b.schema.names else [None] * b.num_rows
            for (h, x, y), f in zip(B.blocks([b], "<u2"), held, strict=True):
                f = np.full(len(y), start) if f is None else np.frombuffer(f, "<f8").copy()
                for t in trees:
                    f += rate * leaf_values(t, x)
                yield h, x, y, f

    def rewritten(trees: list) -> DataFrame:
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for h, x, y, f in scored(parts, trees):
                b = B.block(h, y, x)
                yield b.append_column("f", pa.array([f.tobytes()], pa.binary()))
        return table.mapInArrow(run, B.PACKED + ", f binary").checkpoint()

    def by_job(trees: list, tree: dict, stage: int, want: list[int]) -> np.ndarray:
        nonlocal table, seen
        if len(trees) - seen >= HELD_TREES:
            table, seen = rewritten(trees[seen:]), len(trees)
        later, size = trees[seen:], 3 * width * len(want) * n_bins + 2

        def step(parts: Iterator[pa.RecordBatch]) -> np.ndarray:
            total = np.zeros(size, np.int64)
            for h, x, y, f in scored(parts, later):
                total += sums_of(h, x, y, f, tree, stage, want)
            return total
        return B.summed(table, step)
    return done(*grow(by_job), start)


def _leaf(sums: np.ndarray) -> float:
    """One Newton step: gradient over curvature."""
    return float(sums[1] / sums[2]) if abs(sums[2]) > 1e-12 else 0.0
