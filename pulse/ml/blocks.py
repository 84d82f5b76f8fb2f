"""Training rows as blocks of arrays, for fits that read the same rows hundreds of times.

A block is one record: the hashes, labels and features of up to an Arrow batch of rows as bytes, so a
step over all rows moves a few large cells. Up to ``IN_TASK`` rows a fit needs no job per step: one task
holds them and runs all steps, with the functions that the jobs of larger tables run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

IN_TASK = 1 << 20  # rows that one task holds (126 MB of 15 features)
CHUNK = 1 << 13    # rows that are worked on at once
PACKED = "n int, h binary, y binary, x binary"


def hashed(rows: DataFrame, ids: Sequence[str], features: str, label: str, seed: int) -> tuple[DataFrame, int, int]:
    """(h, x, y) of the rows with their width and number."""
    ensure_checkpoint_dir(rows.sparkSession)
    given = rows.select(F.xxhash64(*ids, F.lit(seed)).alias("h"), vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
    width, n = given.agg(F.coalesce(F.max(F.size("x")), F.lit(0)), F.count(F.lit(1))).first()
    if not width:
        raise ValueError("nothing to fit")
    return given, width, n


def arrays(b: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h, x, y) of a batch of ``hashed`` rows."""
    x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype("<f8", copy=False).reshape(b.num_rows, width)
    return b.column("h").to_numpy(), x, b.column("y").to_numpy()


def block(h: np.ndarray, y: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([len(h)], pa.int32()), *[pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in (h, y, x)]],
                                      ["n", "h", "y", "x"])


def blocks(parts: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(h, x, y) of every block; ``kind`` is the features' type."""
    for b in parts:
        for n, h, y, x in zip(*[b.column(c).to_pylist() for c in ("n", "h", "y", "x")], strict=True):
            yield np.frombuffer(h, "<i8"), np.frombuffer(x, kind).reshape(n, -1), np.frombuffer(y, "<f8")


def packed(given: DataFrame, width: int, pieces: int, of: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> DataFrame:
    """``hashed`` rows as written blocks in at most so many partitions, with ``of`` their features."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            if b.num_rows:
                h, x, y = arrays(b, width)
                yield block(h, y, of(x))
    return given.mapInArrow(run, PACKED).coalesce(pieces).checkpoint()


def summed(table: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum over the tasks of the whole numbers that ``step`` makes of a task's blocks: one record a
    task reaches the driver."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([step(parts).astype("<i8").tobytes()], pa.binary())], ["sums"])
    return np.sum([np.frombuffer(r.sums, "<i8") for r in table.mapInArrow(run, "sums binary").collect()], axis=0)


def in_one_task(given: DataFrame, width: int, n: int, fit: Callable[[np.ndarray, np.ndarray, np.ndarray], str]) -> str:
    """What ``fit`` makes of all n ``hashed`` rows (h, x, y), in the order of their hashes, in one task."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, x, y, at = np.empty(n, np.int64), np.empty((n, width)), np.empty(n), 0
        for b in parts:  # held once: batches go as they are copied
            end = at + b.num_rows
            if b.num_rows:
                h[at:end], x[at:end], y[at:end] = arrays(b, width)
            at = end
        if at != n:
            raise ValueError(f"{at} rows, {n} before")
        yield pa.RecordBatch.from_arrays([pa.array([fit(h, x, y)], pa.string())], ["model"])
    return given.coalesce(1).sortWithinPartitions("h", "x", "y").mapInArrow(run, "model string").first().model
