"""Threshold selection (M22-M25) as aggregates over collapsed score counts.

All searches order candidates by (criterion desc, threshold asc), i.e. ties go to the lowest
threshold, which is what a first-strict-improvement scan in increasing threshold order does.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..session import ensure_checkpoint_dir
from .metrics import _div0, curve_points, points_of_counts, score_counts


def grid(spec: tuple = C.GRID_COARSE) -> list[float]:
    """Grid values exactly as a numpy ``arange(start, stop + step/1000 .. )`` scan produces them.

    Coarse: arange(0.1, 0.95, 0.05) (17 points); fine: arange(0.05, 0.951, 0.01) (91 points).
    """
    start, stop, step = spec
    hi = 0.95 if spec == C.GRID_COARSE else 0.951
    return [float(v) for v in np.arange(start, hi, step)]


def f1_grid(df: DataFrame, group: Sequence[str], score: str, label: str, values: Sequence[float],
            init_best: float = 0.0, default: float = C.DEFAULT_THRESHOLD) -> DataFrame:
    """Best F1 over a fixed grid of thresholds; keep ``default`` unless F1 > init_best."""
    # Rows collapse to score counts first: the score is computed once a row, not once a grid value.
    # A score counts for every grid value not above it: counts collapse to one cell per highest
    # such value, and only the cells (at most grid + 1 per group) meet the grid.
    arr = F.array(*[F.lit(v) for v in values])
    cell = F.size(F.filter(arr, lambda t: t <= F.col(score)))
    cells = score_counts(df, group, score, label).groupBy(*group, cell.alias("cell")).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    g = cells.select(*group, "cell", "pos", "neg", F.posexplode(arr).alias("i", "t"))
    above = F.col("cell") > F.col("i")
    agg = g.groupBy(*group, "t").agg(
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~above, F.col("pos")).otherwise(0)).alias("fn"))
    f1 = _div0(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    scored = agg.select(*group, "t", f1.alias("f1"))
    best = scored.groupBy(*group).agg(
        F.max_by(F.struct("t", "f1"), F.struct(F.col("f1"), -F.col("t"))).alias("b"))
    keep = F.col("b.f1") > init_best
    return best.select(*group, (F.when(keep, F.col("b.t")).otherwise(F.lit(default))).alias("best_threshold"),
                       (F.when(keep, F.col("b.f1")).otherwise(F.lit(init_best))).alias("best_f1"))


def f1_curve(df: DataFrame, group: Sequence[str], score: str, label: str, eps: float = 1e-12) -> DataFrame:
    """Threshold of maximum F1 on the precision-recall curve."""
    return _best_f1(curve_points(df, group, score, label), group, eps)


def train_fold_thresholds(sides: DataFrame, group: Sequence[str], score: str, label: str, eps: float = 1e-12) -> DataFrame:
    """M23 by folds: (group, fold, threshold, train_f1, test_f1).

    ``sides`` holds, for every (group, fold), the scored rows of both sides (``side`` 'train' or
    'test'). One pass collapses them to (group, fold, side, score) counts; the training side's
    curve gives the threshold, at which the test side's counts are added up.
    """
    ensure_checkpoint_dir(sides.sparkSession)
    keys = [*group, "fold"]
    counts = score_counts(sides, [*keys, "side"], score, label).checkpoint()
    best = _best_f1(points_of_counts(counts.where("side = 'train'").drop("side"), keys, score), keys, eps)
    test = counts.where("side = 'test'").join(best.select(*keys, "threshold"), keys)
    hit = F.col(score) >= F.col("threshold")
    tp, fp, fn = (F.coalesce(F.sum(F.when(c, F.col(n))), F.lit(0)) for c, n in ((hit, "pos"), (hit, "neg"), (~hit, "pos")))
    tested = test.groupBy(*keys).agg(_div0(2 * tp, 2 * tp + fp + fn).alias("test_f1"))
    return best.withColumnRenamed("f1", "train_f1").join(tested, keys, "left")


def fold_sides(scored: DataFrame, k: int) -> DataFrame:
    """Rows with one score each (a model that is not fitted per fold) on both sides of all k folds:
    (fold, side) instead of the row's own ``fold``."""
    return (scored.withColumnRenamed("fold", "_own").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
            .withColumn("side", F.when(F.col("_own") == F.col("fold"), "test").otherwise("train")).drop("_own"))


def median_threshold(by_fold: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, threshold, mean_f1): the folds' median threshold and mean test F1."""
    return by_fold.groupBy(*group).agg(F.median("threshold").alias("threshold"), F.avg("test_f1").alias("mean_f1"))


def _best_f1(p: DataFrame, group: Sequence[str], eps: float) -> DataFrame:
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + eps)
    best = p.select(*group, "threshold", f1.alias("f1")).groupBy(*group).agg(
        F.max_by(F.struct("threshold", "f1"), F.struct(F.col("f1"), -F.col("threshold"))).alias("b"))
    return best.select(*group, F.col("b.threshold").alias("threshold"), (F.col("b.f1")).alias("f1"))


def recall_target(df: DataFrame, group: Sequence[str], score: str, label: str,
                  target: float = C.RECALL_TARGET) -> DataFrame:
    """Highest precision with recall >= target; otherwise the max-F1 threshold."""
    p = curve_points(df, group, score, label)
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-9)
    ok = F.col("recall") >= target
    best = p.groupBy(*group).agg(
        F.max_by(F.when(ok, F.col("threshold")),
                 F.when(ok, F.struct(F.col("precision"), -F.col("threshold")))).alias("t_ok"),
        F.count_if(ok).alias("n_ok"),
        F.max_by(F.col("threshold"), F.struct(f1, -F.col("threshold"))).alias("t_f1"))
    use = F.col("n_ok") > 0
    return best.select(*group, F.when(use, F.col("t_ok")).otherwise(F.col("t_f1")).alias("threshold"),
                       F.when(use, F.lit("recall_target")).otherwise(F.lit("max_f1")).alias("rule"))


def precision_floor(df: DataFrame, group: Sequence[str], score: str, label: str,
                    floor: float, default: float = C.DEFAULT_THRESHOLD) -> DataFrame:
    """Highest recall with precision >= floor (lowest such threshold); else default."""
    p = curve_points(df, group, score, label)
    ok = F.col("precision") >= floor
    best = p.groupBy(*group).agg(
        F.max_by(F.when(ok, F.struct(F.col("threshold").alias("t"), F.col("recall").alias("r"))),
                 F.when(ok, F.struct(F.col("recall"), -F.col("threshold")))).alias("b"))
    return best.select(*group, F.coalesce(F.col("b.t"), F.lit(default)).alias("threshold"),
                       (F.coalesce(F.col("b.r"), F.lit(-1.0))).alias("recall"))
