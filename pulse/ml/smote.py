"""Minority oversampling (M9), distributed.

Neighbours: rows are put in order along several independent random projections. A row's
candidates are the ``WIDTH`` rows before and behind it in each of these orders (blocks of the
order overlap by as much, so a block's edge makes no difference), and in one further round the
neighbours of its neighbours; exact Euclidean distance picks the k nearest among all of them.
Work per row is O(k^2 + projections x WIDTH); no pairs are enumerated, and nothing depends on the
size of the table or on its partitioning. A hash-sized nudge spreads equal projections, so many
equal rows do not end up in one block. Up to ``IN_TASK`` rows are held by one task, which finds
the same neighbours on arrays. Synthetic rows interpolate between a base row and one of
its neighbours with a hash-derived u in [0, 1).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..session import ensure_checkpoint_dir
from . import blocks as B
from .folds import exact_rank as hash_rank
from .folds import hash_key
from .ranks import exact_rank

PROJECTIONS, WIDTH, BLOCK = 8, 12, 1024
IN_TASK = 3 << 19  # rows that one task holds (0.4 GB of 15 features)


def _u(cols, j, seed):
    """Deterministic uniform [0, 1) from a hash of (row id, draw, seed)."""
    h = F.xxhash64(*[F.col(c) for c in cols], j, F.lit(seed))
    return F.pmod(h, F.lit(1 << 24)).cast("double") / float(1 << 24)


def _distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, v: acc + v)


def _nearest(cands: Column, k: int) -> Column:
    """The k nearest of an array of (d, id, x), each id once."""
    return F.slice(F.array_sort(F.array_distinct(cands)), 1, k)


def _merged(d: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of candidates [row, place] with distances d and numbers c (-1: none), each row's k nearest, each
    once; ties go to the smaller number."""
    best, found = np.full((len(d), k), np.inf), np.full((len(d), k), -1)
    order = np.lexsort((c, d), axis=1)
    near, at = (np.take_along_axis(a, order, 1) for a in (d, c))
    keep = at >= 0
    keep[:, 1:] &= at[:, 1:] != at[:, :-1]
    place = keep.cumsum(1) - 1
    row, column = np.nonzero(keep & (place < k))
    place = place[row, column]
    best[row, place], found[row, place] = near[row, column], at[row, column]
    return best, found


def _apart(x: np.ndarray, at: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Squared distances of the rows ``own`` to those numbered ``at`` [row, place], feature by feature."""
    out = np.zeros(at.shape)
    for j in range(x.shape[1]):
        step = x[at, j] - x[own, j][:, None]
        out += step * step
    return out


def nearest_of(x: np.ndarray, nudge: np.ndarray, k: int, weights: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and numbers of the neighbours of all rows, as ``_by_windows`` finds them."""
    n = len(x)
    best, found = np.full((n, k), np.inf), np.full((n, k), -1, np.int32)
    for w in weights:
        p = np.zeros(n)
        for j, v in enumerate(w):
            p += x[:, j] * v
        order = np.argsort(p + (np.abs(p) + 1.0) * nudge, kind="stable").astype(np.int32)
        for i in range(0, n, B.CHUNK):
            own, begin = order[i:i + B.CHUNK], max(i - width, 0)
            around = order[begin:i + len(own) + width]
            columns = np.ascontiguousarray(x[around].T)
            d, c = (np.hstack([a[own], np.full((len(own), 2 * width), none, a.dtype)]) for a, none in ((best, np.inf), (found, -1)))
            for place, off in enumerate([*range(-width, 0), *range(1, width + 1)], k):
                low, high = max(i, -off), min(i + len(own), n - off)  # the rows that have one so far away
                if low < high:
                    apart = np.zeros(high - low)
                    for v in columns:
                        step = v[low + off - begin:high + off - begin] - v[low - begin:high - begin]
                        apart += step * step
                    d[low - i:high - i, place], c[low - i:high - i, place] = apart, order[low + off:high + off]
            best[own], found[own] = _merged(d, c, k)
    first = found.copy()
    for i in range(0, n, B.CHUNK):  # one round over the neighbours' neighbours
        own = np.arange(i, min(i + B.CHUNK, n))
        more = np.where(first[own][..., None] >= 0, first[first[own]], -1).reshape(len(own), -1)
        more[more == own[:, None]] = -1
        apart = _apart(x, more, own)
        apart[more < 0] = np.inf
        best[own], found[own] = _merged(np.hstack([best[own], apart]), np.hstack([found[own], more]), k)
    return best, found


def neighbours(rows: DataFrame, k: int, dim: int, seed: int = C.SEED) -> DataFrame:
    """(_id, _nb): the k nearest other rows of each of ``rows`` (_id, _x array<double>) as an
    array of (d, id, x), nearest first."""
    rng = np.random.RandomState(seed)
    x = F.transform("_x", lambda v: F.coalesce(v, F.lit(0.0)))
    nudge = F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1 << 20)).cast("double") * 1e-15
    weights = np.array([rng.normal(size=dim) for _ in range(PROJECTIONS)]).reshape(PROJECTIONS, dim)
    if (n := rows.count()) > IN_TASK:
        return _by_windows(rows, x, nudge, k, weights)
    # In the order of the ids, of which ties take the smaller.
    given = rows.groupBy("_id").agg(F.min(x).alias("_x")).withColumn("_nudge", nudge).checkpoint()
    kind, width = rows.schema["_id"].dataType, WIDTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, nudge, ids, at = np.empty((n, dim)), np.empty(n), [], 0
        for b in batches:
            end = at + b.num_rows
            x[at:end] = b.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)
            nudge[at:end] = b.column("_nudge").to_numpy()
            ids, at = [*ids, b.column("_id")], end
        if not at:
            return
        x, ids = x[:at], pa.concat_arrays(ids)
        d, c = nearest_of(x, nudge[:at], k, weights, width)
        for i in range(0, len(ids), B.CHUNK):
            near, at = d[i:i + B.CHUNK], c[i:i + B.CHUNK]
            there = at >= 0
            flat = at[there]
            ends = np.append(0, there.sum(1).cumsum())
            parts = [pa.array(near[there]), ids.take(pa.array(flat)),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, dim * len(flat) + 1, dim) if dim else np.zeros(len(flat) + 1, int), pa.int32()), pa.array(x[flat].ravel()))]
            nb = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, ["d", "id", "x"]))
            yield pa.RecordBatch.from_arrays([ids.slice(i, B.CHUNK), nb], ["_id", "_nb"])

    one = T.StructType([T.StructField("d", T.DoubleType()), T.StructField("id", kind), T.StructField("x", T.ArrayType(T.DoubleType()))])
    return given.coalesce(1).sortWithinPartitions("_id").mapInArrow(run, T.StructType([T.StructField("_id", kind), T.StructField("_nb", T.ArrayType(one))]))


def _by_windows(rows: DataFrame, x: Column, nudge: Column, k: int, weights: np.ndarray) -> DataFrame:
    values = []
    for t, drawn in enumerate(weights):
        w = F.array(*[F.lit(float(v)) for v in drawn])
        p = F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
        values.append(F.struct(F.lit(t).alias("t"), (p + (F.abs(p) + 1.0) * nudge).alias("p")))
    # All projections in one long table: one range sort and one window place them all.
    long = rows.select("_id", x.alias("_x"), F.explode(F.array(*values)).alias("_v")).select("_id", "_x", "_v.t", "_v.p")
    placed = exact_rank(long, ["t"], [F.col("p"), F.col("_id")], "_pos")
    own = F.floor(F.col("_pos") / BLOCK)
    at = F.col("_pos") % BLOCK
    # A row stands in its own block and, near an edge, in the one beyond it.
    blocks = F.filter(F.array(own, F.when(at < WIDTH, own - 1), F.when(at >= BLOCK - WIDTH, own + 1)), lambda v: v.isNotNull())
    near = Window.partitionBy("t", "_block").orderBy("_pos").rowsBetween(-WIDTH, WIDTH)
    seen = (placed.withColumn("_own", own).withColumn("_block", F.explode(blocks))
            .withColumn("_c", F.collect_list(F.struct(F.col("_id").alias("id"), F.col("_x").alias("x"))).over(near))
            .where(F.col("_block") == F.col("_own")))
    merged = seen.select("_id", "_x", _nearest(F.transform(F.filter("_c", lambda c: c["id"] != F.col("_id")), lambda c: F.struct(
        _distance(c["x"], F.col("_x")).alias("d"), c["id"].alias("id"), c["x"].alias("x"))), k).alias("_nb"))
    first = merged.groupBy("_id").agg(F.first("_x").alias("_x"), F.flatten(F.collect_list("_nb")).alias("_nb"))
    first = first.select("_id", "_x", _nearest(F.col("_nb"), k).alias("_nb")).checkpoint()
    # One round over the neighbours' neighbours.
    asked = first.select("_id", "_x", F.explode("_nb.id").alias("_of"))
    other = first.select(F.col("_id").alias("_of"), F.col("_nb").alias("_more"))
    more = asked.join(other, "_of").select("_id", F.transform(F.filter("_more", lambda c: c["id"] != F.col("_id")), lambda c: F.struct(
        _distance(c["x"], F.col("_x")).alias("d"), c["id"].alias("id"), c["x"].alias("x"))).alias("_nb"))
    both = first.select("_id", "_nb").unionByName(more).groupBy("_id").agg(F.flatten(F.collect_list("_nb")).alias("_nb"))
    return both.select("_id", _nearest(F.col("_nb"), k).alias("_nb"))


def smote(df: DataFrame, features: Sequence[str], label: str, id_cols: Sequence[str], k: int = 5,
          ratio: float = 1.0, seed: int = C.SEED, trace: bool = False) -> DataFrame:
    """Add synthetic minority rows until minority/majority == ratio.

    Output keeps the input columns (synthetic rows copy the id columns of their base row) and
    adds ``is_synthetic`` (0/1); with ``trace`` also ``neighbour`` (the id columns of the
    neighbour as a struct) and ``u``, both NULL for given rows. ``id_cols`` identify a row.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).agg(F.count(F.lit(1))).collect()}  # one row per class
    extra = {"is_synthetic": F.lit(0)}
    id_type = df.select(F.struct(*id_cols).alias("s")).schema["s"].dataType
    if trace:
        extra |= {"neighbour": F.lit(None).cast(id_type), "u": F.lit(None).cast("double")}
    base = df.withColumns(extra)
    if len(counts) < 2:
        return base
    minority = min(counts, key=lambda c: (counts[c], c))
    majority = max(counts, key=lambda c: (counts[c], -c))
    n_min, n_maj = counts[minority], counts[majority]
    n_new = int(ratio * n_maj) - n_min
    if n_new <= 0:
        return base
    ensure_checkpoint_dir(df.sparkSession)
    feats = list(features)
    mino = df.where(F.col(label) == minority).withColumn("_id", F.struct(*id_cols)).withColumn(
        "_x", F.array(*[F.col(c).cast("double") for c in feats]))
    near = neighbours(mino.select("_id", "_x"), k, len(feats), seed)
    ranked = hash_rank(mino, [], hash_key(list(id_cols), seed), list(id_cols)).join(near, "_id", "left")
    per, left = divmod(n_new, n_min)
    m = F.lit(per) + F.when(F.col("_rank") < left, F.lit(1)).otherwise(F.lit(0))
    gen = ranked.where(m > 0).withColumn("_j", F.explode(F.sequence(F.lit(1), m)))
    nsz = F.coalesce(F.size("_nb"), F.lit(0))
    pick = F.when(nsz > 0, F.element_at(F.col("_nb"), (F.pmod(F.xxhash64(*[F.col(c) for c in id_cols], F.col("_j"),
                                                                        F.lit(seed + 7)), nsz) + 1).cast("int")))
    gen = gen.withColumn("_pick", pick).withColumn("_u", _u(id_cols, F.col("_j"), seed))
    new_x = F.when(F.col("_pick").isNull(), F.col("_x")).otherwise(
        F.zip_with(F.col("_x"), F.col("_pick.x"), lambda a, b: a + F.col("_u") * (b - a)))
    gen = gen.withColumn("_new", new_x)
    other = [c for c in df.columns if c not in feats]
    tail = [F.lit(1).alias("is_synthetic")]
    if trace:
        tail += [F.col("_pick.id").cast(id_type).alias("neighbour"), F.col("_u").alias("u")]
    synth = gen.select(*[F.col(c) for c in other], *[F.col("_new")[i].alias(c) for i, c in enumerate(feats)], *tail)
    return base.unionByName(synth.select(*base.columns))
