"""Deterministic splits (M1-M3) and a distributed exact rank.

Randomness comes from an md5 prefix of (key, seed), never from ``rand()``, so assignments do
not depend on partitioning, survive task retries, and any SQL engine can repeat them. Exact ranks
within strata come from ``ranks``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from . import ranks

def hash_key(cols: Sequence[str], seed: int = C.SEED) -> Column:
    """A hash of the columns as text, in [0, 2^60)."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def exact_rank(df: DataFrame, strata: Sequence[str], order: Column, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Add ``_rank`` (0-based) of each row within its stratum, ordered by ``order`` (a hash_key)."""
    ranked = ranks.exact_rank(df.withColumn("_ord", order), strata, [F.col("_ord"), *[F.col(c) for c in tiebreak]])
    return ranked.drop("_ord")


def group_folds(df: DataFrame, key: str, k: int = 5, seed: int = C.SEED) -> DataFrame:
    """M2: every row of a learner lands in the same fold, fold = hash(key) mod k."""
    return df.withColumn("fold", F.pmod(hash_key([key], seed), F.lit(k)).cast("int"))


def strat_group_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = C.SEED) -> DataFrame:
    """M3: learners are dealt round-robin into k folds within their (learner-level) label, in
    hash order, so folds hold equal shares of each class (+-1 learner)."""
    learners = df.groupBy(key).agg(F.max(label).alias("_y"))
    r = exact_rank(learners, ["_y"], hash_key([key], seed), [key])
    folds = r.select(key, F.pmod(F.col("_rank"), F.lit(k)).cast("int").alias("fold"))
    return df.join(folds, key)


def plan_folds(histogram: dict[tuple[int, ...], int], k: int) -> dict[tuple[int, ...], list[int]]:
    """Folds of the groups that are left of each row vector (rows per class) once every fold has
    had the same number of groups with that vector: largest first, each to the fold in which the
    squares of the class shares grow least (with one class: the emptiest), ties to the first."""
    classes = range(len(next(iter(histogram), ())))
    rows = [max(1, sum(v[c] * n for v, n in histogram.items())) for c in classes]
    # Shares over a common denominator: whole numbers, the same on every engine.
    scale = [math.prod(rows[d] for d in classes if d != c) ** 2 for c in classes]
    held, plan = [[0] * len(rows) for _ in range(k)], {}
    for v in sorted(histogram, key=lambda v: (sum(v), v), reverse=True):
        plan[v] = []
        for _ in range(histogram[v] % k):
            f = min(range(k), key=lambda i: sum(scale[c] * held[i][c] * v[c] for c in classes))
            held[f] = [a + b for a, b in zip(held[f], v, strict=True)]
            plan[v].append(f)
    return plan


def even_group_folds(df: DataFrame, key: str, label: str | None = None, k: int = 5, seed: int = C.SEED) -> DataFrame:
    """M2 / M3: whole groups in k folds of even size or, with a 0/1 ``label``, with even rows of
    both classes.

    The driver plans on the histogram of the groups' row vectors, whose size is the number of
    different vectors. Groups of one vector are ranked by hash; as many as k divides are dealt in
    turn, the rest by the plan. A NULL key is a group; a label that is not 1 counts as 0.
    """
    n = [F.count(F.lit(1))] if label is None else [F.count_if(F.coalesce(F.col(label) != 1, F.lit(True))), F.count_if(F.col(label) == 1)]
    names = [f"_n{i}" for i in range(len(n))]
    groups = df.groupBy(F.col(key).alias("_key")).agg(*[x.alias(c) for x, c in zip(n, names, strict=True)])
    ranked = ranks.exact_rank(groups.withColumn("_ord", hash_key(["_key"], seed)), names, [F.col("_ord"), F.col("_key")])
    histogram = {tuple(r[c] for c in names): r["_c"] for r in ranked.groupBy(*names).agg(F.count(F.lit(1)).alias("_c")).collect()}
    plan = [(*v, histogram[v] // k * k, rest) for v, rest in plan_folds(histogram, k).items()]
    schema = ", ".join([f"{c} long" for c in names] + ["_whole long", "_rest array<int>"])
    placed = ranked.join(df.sparkSession.createDataFrame(plan, schema), names).select(
        "_key", F.when(F.col("_rank") < F.col("_whole"), F.col("_rank") % k)
        .otherwise(F.get("_rest", (F.col("_rank") - F.col("_whole")).cast("int"))).cast("int").alias("fold"))
    return df.join(placed, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def stratified_split(df: DataFrame, label: str, key_cols: Sequence[str], train_frac: float = 0.7,
                     seed: int = C.SEED) -> DataFrame:
    """M1: exact per-class shares: the first floor(frac * n_class) rows in hash order train."""
    r = exact_rank(df, [label], hash_key(key_cols, seed), list(key_cols))
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_cls_n"))
    return (r.join(n, label)
            .withColumn("is_train", F.col("_rank") < F.floor(F.col("_cls_n") * train_frac))
            .drop("_rank", "_cls_n"))


def hash_sample(df: DataFrame, key_cols: Sequence[str], n: int, seed: int = C.SEED) -> DataFrame:
    """Uniform sample of n rows without replacement, stable under repartitioning
    (the n smallest hashes). Sampling is the feature here, so the limit is intended."""
    return df.withColumn("_h", hash_key(key_cols, seed)).orderBy("_h", *key_cols).limit(n).drop("_h")
