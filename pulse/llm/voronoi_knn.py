"""Exact top-k by inner product as a Voronoi join.

1. Pivots: a bounded number of vectors; every vector belongs to the cell of its nearest pivot.
2. Summaries: per cell the distances to the pivot of its k + 1 nearest members. They give each
   query a score that k other vectors surely reach (q.v >= q.p - |q| |v - p|); the smallest of
   them is the bound of the query's group, the cell it lies in.
3. Replication: a vector goes to a group only if the best score it could have with any query
   there (p.v + R |v|, R the radius of the group's queries) reaches the group's bound.
4. Local solution: groups are cut into blocks of queries and of data, each pair of blocks is one
   task's matrix product with a running top k, and the partial lists are merged by rank.

Nothing is broadcast but the pivots and summaries; their number follows the square root of the rows
up to ``MOST_PIVOTS``, so cells grow more slowly than the table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import name, stage_table

PIVOTS = 32          # cells of a small table; pivots and k + 1 distances a cell are all that is broadcast
MOST_PIVOTS = 1024
ROWS_PER_PIVOT = 16  # of the square root of the rows: more than 32 cells from 2^18 rows on
HELD = 1 << 20       # copies of vectors, or bounds of queries, that a task holds at once
QUERY_BLOCK = 2048   # queries and vectors that one task multiplies
DATA_BLOCK = 32768
STRIPE = 2048        # vectors multiplied at once inside a task


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(row, id, vec array<bigint>): floor(scale * x) of every component in double precision and a
    number of the row's own, which holds once written. Rows with a null id, a null vector or null or
    non-finite components are left out."""
    vec = F.transform(name(vector_col).cast("array<double>"), lambda x: x)
    ok = (name(id_col).isNotNull() & vec.isNotNull()
          & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    return df.filter(ok).select(F.monotonically_increasing_id().alias("row"), name(id_col).cast("long").alias("id"),
                                F.transform(vec, lambda x: F.floor(x * F.lit(float(scale)))).alias("vec"))


def _matrix(cells, dtype: str, dim: int) -> np.ndarray:
    """Packed vectors as rows; exact as doubles while dim * max^2 < 2^53, which holds for "<i2"."""
    m = np.frombuffer(b"".join(cells), dtype).reshape(len(cells), dim)
    return m.astype(np.float64) if dtype == "<i2" else m.astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row-wise the k highest scores, ties to the smaller id."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


NONE = np.int64(-(2**63) + 1)  # the score of no vector


def solve(q_rows: np.ndarray, q_ids: np.ndarray, q: np.ndarray, v_rows: np.ndarray, v_ids: np.ndarray, v: np.ndarray,
          k: int) -> pd.DataFrame:
    """Top k of each query row among the vectors, its own row excluded: (query_row, query_id, vec_id, score)."""
    order = np.argsort(v_ids, kind="stable")
    v_rows, v_ids, v = v_rows[order], v_ids[order], v[order]
    best = np.full((len(q_ids), k), NONE)
    best_ids = np.full((len(q_ids), k), np.iinfo(np.int64).max)
    for i in range(0, len(v_ids), STRIPE):
        ids = v_ids[i:i + STRIPE]
        s = (q @ v[i:i + STRIPE].T).astype(np.int64)
        s[q_rows[:, None] == v_rows[None, i:i + STRIPE]] = NONE
        if len(ids) > k:
            # Ids ascend inside a stripe, so (score, -place) as one integer breaks ties by id.
            if np.abs(s[s != NONE]).max(initial=0) < 2**50:
                keyed = np.where(s == NONE, NONE, s * STRIPE - np.arange(len(ids)))
                top = np.argpartition(-keyed, k - 1, axis=1)[:, :k]
            else:
                top = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
            s, found = np.take_along_axis(s, top, 1), ids[top]
        else:
            found = np.broadcast_to(ids, s.shape)
        best, best_ids = _best(np.hstack([best, s]), np.hstack([best_ids, found]), k)
    row, col = np.nonzero(best != NONE)
    return pd.DataFrame({"query_row": q_rows[row], "query_id": q_ids[row], "vec_id": best_ids[row, col], "score": best[row, col]})


def pivots_for(rows: int) -> int:
    """How many pivots a table of so many rows gets."""
    return min(MOST_PIVOTS, max(PIVOTS, math.isqrt(rows) // ROWS_PER_PIVOT))


def stretches(copies: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` copies together, and one row at least."""
    begin, held = 0, 0
    for i, c in enumerate(copies.tolist()):
        if i > begin and held + c > most:
            yield begin, i
            begin, held = i, 0
        held += c
    if begin < len(copies):
        yield begin, len(copies)


def top_k(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 20, scale: int = 64,
          id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None,
          query_block: int = QUERY_BLOCK, data_block: int = DATA_BLOCK) -> DataFrame:
    """The k highest integer inner products of every query row with all other rows.

    Columns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id; fewer rows if
    there are fewer vectors. Components are floor(scale * x). ``pivots`` is how many cells there are at
    most; None: as many as ``pivots_for`` gives for the table. Rows with a null id, null vector,
    or null or non-finite components take no part. Every row is a vector of its own: rows under one
    id find each other, and each query row under one id has ranks of its own. Shorter vectors count as padded with zeros. Empty tables give no rows.
    Other input columns are ignored.
    """
    spark = vectors.sparkSession
    rows = stage_table(integer_vectors(vectors, id_col, vector_col, scale), "integer-vectors")
    size = rows.agg(F.max(F.size("vec")), F.max(F.array_max(F.transform("vec", F.abs))), F.count(F.lit(1))).first()
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not size[2]:
        return spark.createDataFrame([], schema)
    dim, largest, n = max(1, size[0]), size[1] or 0, size[2]
    dtype = "<i2" if largest < 2**15 and dim * largest * largest < 2**53 else "<i4" if largest < 2**31 else "<i8"

    def padded(vec) -> np.ndarray:
        out = np.zeros(dim, np.int64)
        out[:len(vec)] = vec
        return out

    # Pivots: a bounded choice by hash, equal vectors once.
    pivots = pivots or pivots_for(n)
    chosen = rows.orderBy(F.xxhash64("id"), "id", "vec").limit(pivots).collect()
    p = np.unique(np.array([padded(r.vec) for r in chosen]), axis=0).astype(np.float64)
    p_sq = (p * p).sum(1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = np.array([padded(x) for x in b.column("vec").to_pylist()])
            x = m.astype(np.float64)
            sq = (x * x).sum(1)
            d2 = sq[:, None] - 2 * (x @ p.T) + p_sq
            cell = d2.argmin(1)
            dist = np.sqrt(((x - p[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("id"), b.column("query"), pa.array(cell, pa.int32()), pa.array(dist), pa.array(np.sqrt(sq)),
                 pa.array([r.tobytes() for r in m.astype(dtype)], pa.binary())], ["row", "id", "query", "cell", "dist", "norm", "vec"])

    assigned = stage_table(
        rows.withColumn("query", F.coalesce(is_query(F.col("id")), F.lit(False)))
        .mapInArrow(assign, "row bigint, id bigint, query boolean, cell int, dist double, norm double, vec binary"), "assigned")

    # Summaries: pivots x (k + 1) distances.
    nearest = Window.partitionBy("cell").orderBy("dist", "row")
    summary = (assigned.withColumn("r", F.row_number().over(nearest)).filter(F.col("r") <= k + 1)
               .select("cell", "dist").collect())
    s_cell = np.array([r.cell for r in summary])
    s_dist = np.array([r.dist for r in summary])

    def bound(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at_once = max(1, HELD // max(1, len(s_cell)))
        for whole in frames:
            for i in range(0, len(whole), at_once):
                f = whole.iloc[i:i + at_once]
                x = _matrix(f["vec"], dtype, dim).astype(np.float64)
                sure = (x @ p.T)[:, s_cell] - f["norm"].to_numpy()[:, None] * s_dist
                # k others surely score this much; one of the k + 1 may be the query itself.
                low = np.partition(sure, -(k + 1), axis=1)[:, -(k + 1)] if len(s_cell) > k else np.full(len(f), -np.inf)
                yield pd.DataFrame({"cell": f["cell"], "dist": f["dist"], "low": low})

    groups = (assigned.filter("query").select("cell", "dist", "norm", "vec")
              .mapInPandas(bound, "cell int, dist double, low double").groupBy("cell")
              .agg(F.min("low").alias("low"), F.max("dist").alias("radius"), F.count(F.lit(1)).alias("n")).collect())
    if not groups:
        return spark.createDataFrame([], schema)
    g_cell = np.array([g.cell for g in groups])
    g_low = np.array([g.low for g in groups])
    g_radius = np.array([g.radius for g in groups])
    g_blocks = np.array([-(-g.n // query_block) for g in groups])
    d_blocks = -(-n // data_block)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                x = _matrix(b.column("vec").to_pylist(), dtype, dim).astype(np.float64)
                could = x @ p[g_cell].T + b.column("norm").to_numpy()[:, None] * g_radius
                slack = 1 + 1e-9 * np.abs(could)
                rows_, groups_ = np.nonzero(could + slack >= g_low)
                # Written out a bounded number of copies at a time, however many query blocks there are.
                for begin, end in stretches(g_blocks[groups_], most=max(1, HELD // dim)):
                    row, group = rows_[begin:end], groups_[begin:end]
                    block = np.concatenate([np.arange(c) for c in g_blocks[group]])
                    row, group = np.repeat(row, g_blocks[group]), np.repeat(group, g_blocks[group])
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g_cell[group], pa.int32()), pa.array(block, pa.int32()), b.column("block").take(at),
                         b.column("row").take(at), b.column("id").take(at), b.column("vec").take(at)],
                        ["cell", "q_block", "d_block", "row", "id", "vec"])

    keyed = assigned.select("row", "id", "cell", "vec", "norm", "query")
    data = (keyed.select("row", "id", "vec", "norm", F.pmod(F.xxhash64("row"), F.lit(d_blocks)).cast("int").alias("block"))
            .mapInArrow(replicate, "cell int, q_block int, d_block int, row bigint, id bigint, vec binary"))
    blocks_of = F.create_map(*[F.lit(int(x)) for pair in zip(g_cell, g_blocks, strict=True) for x in pair])
    asked = keyed.filter("query").select(
        "cell", F.pmod(F.xxhash64("row", F.lit(1)), blocks_of[F.col("cell")]).cast("int").alias("q_block"),
        F.explode(F.sequence(F.lit(0).cast("int"), F.lit(d_blocks - 1).cast("int"))).alias("d_block"), "row", "id", "vec")

    def local(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_row", "query_id", "vec_id", "score")})
        return solve(q["row"].to_numpy(), q["id"].to_numpy(), _matrix(q["vec"], dtype, dim),
                     v["row"].to_numpy(), v["id"].to_numpy(), _matrix(v["vec"], dtype, dim), k)

    key = ["cell", "q_block", "d_block"]
    partial = asked.groupBy(*key).cogroup(data.groupBy(*key)).applyInPandas(
        local, "query_row bigint, query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return (partial.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
