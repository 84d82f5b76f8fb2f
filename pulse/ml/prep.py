"""Preprocessing (M4-M8, M10) as aggregates + column expressions.

Fitting only ever brings per-column statistics to the driver (a handful of numbers per
feature); applying is a projection that stays in whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VarianceThresholdSelector, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread

# ---------------------------------------------------------------- Yeo-Johnson (M8)

def yj_expr(x: Column, lam) -> Column:
    """Yeo-Johnson transform of x; ``lam`` is a float or a column."""
    if not isinstance(lam, Column):
        lam_f = float(lam)
        pos = (F.log1p(x) if abs(lam_f) < 1e-12 else (F.pow(x + 1.0, F.lit(lam_f)) - 1.0) / lam_f)
        neg = (-F.log1p(-x) if abs(lam_f - 2.0) < 1e-12
               else -(F.pow(1.0 - x, F.lit(2.0 - lam_f)) - 1.0) / (2.0 - lam_f))
        return F.when(x >= 0, pos).otherwise(neg)
    pos = F.when(F.abs(lam) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1.0, lam) - 1.0) / lam)
    neg = F.when(F.abs(lam - 2.0) < 1e-12, -F.log1p(-x)).otherwise(
        -(F.pow(1.0 - x, 2.0 - lam) - 1.0) / (2.0 - lam))
    return F.when(x >= 0, pos).otherwise(neg)


def _yj_both(t: np.ndarray, below: np.ndarray | None, lam: float) -> tuple[np.ndarray, np.ndarray]:
    """The transform by ``yj_expr``'s rule from t = log(1 + |x|) and, if no x is negative (``below`` is
    None), what spreads as it does without the constant that (x + 1)^lambda approaches."""
    if abs(lam) < 1e-12:
        y = s = t
    else:
        p = np.exp(lam * t)
        y, s = (p - 1.0) / lam, p / lam
    if below is None:
        return y, s
    y = np.where(below, -t if abs(lam - 2.0) < 1e-12 else -(np.exp((2.0 - lam) * t) - 1.0) / (2.0 - lam), y)
    return y, y


def _moments(y: np.ndarray) -> tuple[float, float]:
    """Mean and sum of squares about it."""
    mean = y.mean()
    d = y - mean
    return mean, d @ d


def _by_lambda(df: DataFrame, cols: Sequence[str], grids: dict) -> DataFrame:
    """(f, lam) -> n, mean, std of the transformed column, and the Jacobian's sum. Every batch of rows is
    transformed where it lies, a column and lambda at a time; what is shuffled is one partial result
    per task, feature and lambda. Variances are centred in the tasks and merged about the common
    mean, not differences of sums."""
    lams = [np.array(sorted(set(map(float, grids[c]))), np.float64) for c in cols]
    names = ["f", "lam", "n", "mean", "m2", "largest", "least", "smean", "sm2", "jac"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((len(g), 5)) for g in lams]  # mean, m2, largest, smean, sm2
        n, least, jac = [0] * len(lams), [np.inf] * len(lams), [0.0] * len(lams)
        with np.errstate(all="ignore"):
            for b in batches:
                for i, grid in enumerate(lams):
                    x = b.column(i).drop_null().to_numpy(zero_copy_only=False)
                    if not len(x):
                        continue
                    low, m = x.min(), len(x)
                    t, below = np.log1p(np.abs(x)), None if low >= 0 else x < 0
                    at, share = n[i] * m / (n[i] + m), m / (n[i] + m)
                    for state, lam in zip(held[i], grid.tolist(), strict=True):
                        # Far from 1 all transformed values crowd at -1/lambda, and their spread is lost to
                        # rounding. Without negative values it is that of (x + 1)^lambda over |lambda|.
                        y, s = _yj_both(t, below, lam)
                        mean, m2 = _moments(y)
                        smean, sm2 = (mean, m2) if s is y else _moments(s)
                        apart, sapart = mean - state[0], smean - state[3]
                        state += (apart * share, m2 + apart * apart * at, 0.0, sapart * share, sm2 + sapart * sapart * at)
                        state[2] = max(state[2], np.abs(y).max())
                    n[i] += m
                    least[i] = min(least[i], low)
                    jac[i] += (np.sign(x) * t).sum()
        rows = [(i, lam, n[i], *state[:3], least[i], *state[3:], jac[i])
                for i, grid in enumerate(lams) if n[i] for lam, state in zip(grid.tolist(), held[i].tolist(), strict=True)]
        types = [pa.int32(), pa.float64(), pa.int64(), *[pa.float64()] * 7]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(names), types, strict=True)], names)

    parts = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]).mapInArrow(
        run, "f int, lam double, n long, mean double, m2 double, largest double, least double, smean double, sm2 double, jac double")
    met = parts.groupBy("f", "lam").agg(
        F.sum("n").alias("n"), *[(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(c) for c in ("mean", "smean")],
        F.max("largest").alias("largest"), F.min("least").alias("least"), F.sum("jac").alias("jac"),
        F.collect_list(F.struct("n", "mean", "m2", "smean", "sm2")).alias("parts"))  # one a task

    def deviation(mean: str, m2: str) -> Column:
        return F.sqrt(F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + p[m2] + p["n"] * (p[mean] - F.col(mean)) ** 2) / F.col("n"))

    return met.select("f", "lam", "n", "mean", deviation("mean", "m2").alias("std"), "largest", "least", deviation("smean", "sm2").alias("spread"), "jac")


def _likelihoods(df: DataFrame, cols: Sequence[str], grids: dict) -> dict:
    """{column: {lambda: log-likelihood}} for the grids; not finite counts as minus infinity."""
    out = {c: {} for c in cols}
    for r in _by_lambda(df, cols, grids).collect():  # columns x grid rows
        std = (r["spread"] if r["least"] >= 0 else r["std"]) or 0.0
        if r["least"] < 0 and std < 1e-10 * r["largest"]:
            std = 0.0  # rounding, no spread
        ll = -np.inf if not 1e-150 < std < 1e150 else -r["n"] * np.log(std) + (r["lam"] - 1.0) * r["jac"]
        out[cols[r["f"]]][r["lam"]] = ll if np.isfinite(ll) else -np.inf
    return out


# Steps of the lambda lattices: multiples of each are searched around the best of the one before.
YJ_STEPS = (0.5, 0.025, 0.0025)


def _lattice(lo: float, hi: float, step: float) -> list[float]:
    return [float(np.round(i * step, 10)) for i in range(int(np.round(lo / step)), int(np.round(hi / step)) + 1)]


def _refine(df: DataFrame, cols: Sequence[str], best: dict, tol: float) -> dict:
    """Parabolic steps for all columns at once, one aggregate a round: the vertex through three
    points around the best lambda is the next, and the points draw together until the step is
    below ``tol``. Where the three points bend upwards, the better side is taken."""
    least = 1e-3  # nearer points differ by rounding
    at, width = dict(best), dict.fromkeys(cols, YJ_STEPS[1])
    live = [c for c in cols]
    for _ in range(40):
        if not live:
            break
        found = _likelihoods(df, live, {c: [at[c] - width[c], at[c], at[c] + width[c]] for c in live})
        for c in list(live):
            left, mid, right = (found[c].get(x, -np.inf) for x in (at[c] - width[c], at[c], at[c] + width[c]))
            bend = left - 2 * mid + right
            if not np.isfinite(bend):
                live.remove(c)
                continue
            step = 0.5 * width[c] * (left - right) / bend if bend < 0 else width[c] * (1 if right > left else -1)
            step = float(np.clip(step, -2 * width[c], 2 * width[c]))
            at[c] += step
            if abs(step) < tol and width[c] <= least:
                live.remove(c)
            elif abs(step) < width[c]:
                width[c] = max(least, width[c] / 5)
    return at


def fit_yeo_johnson(df: DataFrame, cols: Sequence[str], tol: float | None = None) -> dict:
    """MLE lambda per column, without bounds: multiples of 0.5 are tried over a range that is
    widened (by twice as much each time) until the best one lies inside it, then multiples of
    0.025 and 0.0025 between its neighbours. With ``tol`` parabolic steps from the second lattice on
    find the optimum itself, to a last step below it. ``df`` is read once per step: give a written or
    checkpointed frame.

    Returns {col: {"lambda", "mean", "std", "n"}} with mean/std (population, 0 -> 1) of the
    transformed column for the standardisation that follows the transform.
    """
    cols = list(cols)
    df = spread(df.select(*[F.col(c).cast("double").alias(c) for c in cols]))

    def top(c: str) -> float:
        cand = seen[c]
        return max(cand, key=lambda x: (cand[x], -abs(x - 1.0))) if cand else 1.0

    seen: dict = {c: {} for c in cols}
    grids, reach = {c: _lattice(-3, 3, YJ_STEPS[0]) for c in cols}, 6.0
    while grids:
        for c, found in _likelihoods(df, list(grids), grids).items():
            seen[c].update(found)
        at_edge = {}
        for c in grids:
            lo, hi, best = min(seen[c], default=0.0), max(seen[c], default=0.0), top(c)
            if seen[c] and seen[c][best] > -np.inf and best in (lo, hi):
                step = YJ_STEPS[0]
                at_edge[c] = _lattice(lo - reach, lo - step, step) if best == lo else _lattice(hi + step, hi + reach, step)
        grids, reach = at_edge, reach * 2
    for wide, step in zip(YJ_STEPS, YJ_STEPS[1:] if tol is None else YJ_STEPS[1:2]):
        best = {c: top(c) for c in cols}
        fine = {c: _lattice(best[c] - wide, best[c] + wide, step) for c in cols}
        seen = _likelihoods(df, cols, fine)
    best = {c: float(top(c)) for c in cols}
    if tol is not None:
        best = _refine(df, cols, best, tol)
    out = {c: {"lambda": best[c], "mean": 0.0, "std": 1.0, "n": 0} for c in cols}
    for r in _by_lambda(df, cols, {c: [best[c]] for c in cols}).collect():
        sd = float(r["std"] or 0.0)
        out[cols[r["f"]]].update(mean=float(r["mean"]), std=sd if sd > 1e-12 else 1.0, n=int(r["n"]))
    return out


def apply_yeo_johnson(df: DataFrame, params: dict, keep: Sequence[str] = (), prefix: str = "") -> DataFrame:
    cols = [((yj_expr(F.col(c).cast("double"), p["lambda"]) - p["mean"]) / p["std"]).alias(prefix + c)
            for c, p in params.items()]
    return df.select(*[F.col(k) for k in keep], *cols)


# ---------------------------------------------------------------- standardisation (M4)

def fit_standard(df: DataFrame, cols: Sequence[str]) -> dict:
    """Mean and population std per column (zero std -> 1), like a standard scaler."""
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).collect()[0]
    return {c: (float(row[f"m{i}"] or 0.0), float(row[f"s{i}"] or 0.0) or 1.0) for i, c in enumerate(cols)}


def standardize(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), params: dict | None = None) -> DataFrame:
    """M4: (x - mean) / population std; the fitted numbers are the only thing collected."""
    params = params or fit_standard(df, cols)
    return df.select(*[F.col(k) for k in keep],
                     *[((F.col(c) - F.lit(m)) / F.lit(sd)).alias(c) for c, (m, sd) in params.items()])


# ---------------------------------------------------------------- pyspark.ml stages

def assembler(cols: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep")


def variance_filter(in_col: str = "features", out: str = "selected") -> VarianceThresholdSelector:
    """M7: drop constant features (variance threshold 0)."""
    return VarianceThresholdSelector(featuresCol=in_col, outputCol=out, varianceThreshold=0.0)


def onehot_stages(cat_cols: Sequence[str]) -> list:
    """M5: unknown and NULL categories give all-zero vectors; every known category kept.
    NULL is first mapped to the category '(null)' so it is a level of its own."""
    idx = [StringIndexer(inputCol=f"{c}__s", outputCol=f"{c}__i", handleInvalid="keep",
                         stringOrderType="alphabetAsc") for c in cat_cols]
    enc = OneHotEncoder(inputCols=[f"{c}__i" for c in cat_cols], outputCols=[f"{c}__oh" for c in cat_cols],
                        dropLast=True, handleInvalid="keep")
    return idx + [enc]


def fill_null_category(df: DataFrame, cat_cols: Sequence[str]) -> DataFrame:
    return df.select("*", *[F.coalesce(F.col(c), F.lit("(null)")).alias(f"{c}__s") for c in cat_cols])


def onehot_pipeline(cat_cols: Sequence[str]) -> Pipeline:
    return Pipeline(stages=onehot_stages(cat_cols))


def class_weight_col(df: DataFrame, label: str, mode="balanced", out: str = "weight") -> DataFrame:
    """M10: 'balanced' -> n / (2 n_c) per class; a dict maps class -> weight."""
    if isinstance(mode, dict):
        expr = None
        for k, v in mode.items():
            expr = (F.when(F.col(label) == k, F.lit(float(v))) if expr is None
                    else expr.when(F.col(label) == k, F.lit(float(v))))
        return df.withColumn(out, expr.otherwise(F.lit(1.0)))
    counts = {r[0]: r[1] for r in df.groupBy(label).agg(F.count(F.lit(1))).collect()}  # one row per class
    n = sum(counts.values())
    return class_weight_col(df, label, {k: n / (2.0 * v) for k, v in counts.items()}, out)
