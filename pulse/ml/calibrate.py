"""Platt scaling (R7) and the least-squares display sigmoid."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .models import full_parts


def fit_platt(oof: DataFrame, proba: str = "proba", label: str = "label") -> dict:
    """One-feature logistic regression of the label on out-of-fold scores (L2, C=1).

    Returns {"a": slope, "b": intercept}; apply with ``apply_platt``.
    """
    x = VectorAssembler(inputCols=[proba], outputCol="f").transform(
        oof.select(F.col(proba).cast("double").alias(proba), F.col(label).cast("double").alias("y")))
    n = x.count()
    lr = LogisticRegression(featuresCol="f", labelCol="y", regParam=1.0 / max(n, 1), elasticNetParam=0.0,
                            standardization=False, maxIter=200, tol=1e-8)
    m = lr.fit(full_parts(x, n))
    return {"a": float(m.coefficients[0]), "b": float(m.intercept)}


def apply_platt(p: Column, params: dict | None) -> Column:
    """The calibrated probability; without a calibrator (None) the score as it is."""
    if params is None:
        return p
    return 1.0 / (1.0 + F.exp(-(F.lit(params["a"]) * p + F.lit(params["b"]))))


def fit_sigmoid(df: DataFrame, raw: str, target: str, eps: float = 1e-6) -> DataFrame:
    """Least squares of logit(clip(target)) on raw -> k = slope, c = -intercept / slope
    (c = 0.5 when the slope is ~0). One aggregate; returns a one-row DataFrame (k, c)."""
    p = F.least(F.greatest(F.col(target).cast("double"), F.lit(eps)), F.lit(1 - eps))
    y = F.log(p / (1 - p))
    s = df.select(F.col(raw).cast("double").alias("x"), y.alias("y")).agg(
        F.regr_slope("y", "x").alias("k"), F.regr_intercept("y", "x").alias("b"))
    return s.select(F.col("k"), F.when(F.abs(F.col("k")) > 1e-9, -F.col("b") / F.col("k"))
                    .otherwise(F.lit(0.5)).alias("c"))
