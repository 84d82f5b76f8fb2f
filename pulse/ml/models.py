"""Classifiers (M11-M14) and the per-fold training recipe.

The recipe mirrors the reference's two pipelines:
  evaluation:  variance filter -> SMOTE -> Yeo-Johnson + standardise -> classifier
  production:  variance filter ->          Yeo-Johnson + standardise -> classifier
Preprocessing is fitted with aggregates (a few numbers per feature reach the driver) and
applied as column expressions; the classifiers are pyspark.ml estimators.

``make_classifier`` gives pyspark.ml estimators with one setting each ("gbt" has logistic loss, "mlp"
sigmoid units and plain descent). ``boost`` and ``perceptron`` have exponential loss, subsampling
and early stop, and ReLU layers, L2, momentum, Adam and early stop; recipes choose among all.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..session import ensure_checkpoint_dir
from .prep import apply_yeo_johnson, class_weight_col, fit_yeo_johnson
from .smote import smote

ROWS_A_PART = 1 << 12  # training rows of a partition, whatever the session is set to,
MANY_PARTS = 48  # but no more partitions than this
ROWS_A_FULL_PART = 1 << 16  # until each has as many rows as this
IDENTITY = {"lambda": 1.0, "mean": 0.0, "std": 1.0}  # Yeo-Johnson with lambda 1 gives x back

MODEL_NAMES = ("gbt", "rf", "mlp", "logreg_l1")


def make_classifier(name: str, n_features: int, n_rows: int, weight_col: str | None = None,
                    seed: int = C.SEED, C_reg: float = 1.0):
    if name in ("logreg_l1", "logreg_l2"):
        # C * sum(loss) + penalty  <=>  mean loss + (1 / (C * n)) * penalty
        lr = LogisticRegression(featuresCol="features", labelCol="label", maxIter=100,
                                regParam=1.0 / (C_reg * max(n_rows, 1)),
                                elasticNetParam=1.0 if name == "logreg_l1" else 0.0,
                                standardization=False, tol=1e-6)
        if weight_col:
            lr.setWeightCol(weight_col)
        return lr
    if name == "rf":
        rf = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=50, maxDepth=3,
                                    minInstancesPerNode=10, seed=seed, impurity="gini")
        if weight_col:
            rf.setWeightCol(weight_col)
        return rf
    if name == "gbt":
        gbt = GBTClassifier(featuresCol="features", labelCol="label", maxIter=10, maxDepth=3, stepSize=0.03,
                            minInstancesPerNode=40, subsamplingRate=1.0, seed=seed)
        if weight_col:
            gbt.setWeightCol(weight_col)
        return gbt
    if name == "mlp":
        return MultilayerPerceptronClassifier(featuresCol="features", labelCol="label",
                                              layers=[n_features, 135, 2], maxIter=200, seed=seed,
                                              stepSize=0.3, solver="gd", blockSize=128)
    raise ValueError(name)


def kept_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """M7: drop columns whose variance is 0 (one aggregate, one number per column)."""
    row = df.agg(*[F.var_pop(F.col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(cols)]).collect()[0]
    return [c for i, c in enumerate(cols) if (row[f"v{i}"] or 0.0) > 0.0]


@dataclass
class FittedModel:
    name: str
    features: list
    kept: list
    yj: dict
    model: object
    extra: dict = field(default_factory=dict)

    def transform(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Return keep columns + ``proba`` (probability of class 1)."""
        x = apply_yeo_johnson(df, self.yj, keep=keep, prefix="_yj_")
        x = VectorAssembler(inputCols=["_yj_" + c for c in self.kept], outputCol="features",
                            handleInvalid="keep").transform(x)
        out = self.model.transform(x)
        return out.select(*keep, vector_to_array(F.col("probability"))[1].alias("proba"))


@dataclass
class Prepared:
    """Training rows after variance filter, oversampling, Yeo-Johnson (or none) and class weights:
    what all models with the same preparation of a fold have in common."""

    features: list
    kept: list
    yj: dict
    rows: DataFrame
    n: int


def train_parts(n: int) -> int:
    """Partitions of n training rows, by n only. Every step of a fit (200 for the perceptron, up to 100 for
    the logistic models) runs a task on each, so beyond ``MANY_PARTS`` small ones they are filled first."""
    return max(1, min(-(-n // ROWS_A_PART), MANY_PARTS), -(-n // ROWS_A_FULL_PART))


def full_parts(rows: DataFrame, n: int) -> DataFrame:
    """``n`` rows in as few partitions as ``ROWS_A_FULL_PART`` allows, for the logistic models: each of up to
    200 steps is a job of one task a partition, most of whose time is the task's start if it holds few rows."""
    return rows.coalesce(max(1, -(-n // ROWS_A_FULL_PART)))


def prepare(train: DataFrame, features: Sequence[str], label: str, id_cols: Sequence[str],
            oversample: bool = False, smote_ratio: float = 1.0, seed: int = C.SEED, power: bool = True,
            weights=None) -> Prepared:
    """``rows`` is checkpointed: any number of models read it. ``power=False`` leaves the features as
    they are; ``weights`` ('balanced' or {class: weight}) adds a ``weight`` column."""
    ensure_checkpoint_dir(train.sparkSession)
    kept = kept_columns(train, features)
    t = train
    if oversample:
        # materialise once: the oversampled rows feed the fitting passes and the transform
        t = smote(t, kept, label, id_cols, ratio=smote_ratio, seed=seed).checkpoint(eager=True)
    yj = fit_yeo_johnson(t, kept) if power else dict.fromkeys(kept, IDENTITY)
    syn = ["is_synthetic"] if "is_synthetic" in t.columns else []
    x = apply_yeo_johnson(t, yj, keep=[label, *id_cols, *syn]).withColumn("label", F.col(label).cast("double"))
    if weights is not None:
        x = class_weight_col(x, "label", weights)
    # Deterministic layout (hash partitions of the ids, sorted inside): bootstrap sampling and
    # any order-dependent step then give the same model on every run and every task retry. The
    # number of partitions follows the rows, not the session's setting.
    order = [*id_cols, *syn, F.xxhash64(*kept)]
    n = yj[kept[0]]["n"] if kept and power else x.count()
    x = x.repartition(train_parts(n), *id_cols).sortWithinPartitions(*order)
    x = VectorAssembler(inputCols=kept, outputCol="features", handleInvalid="keep").transform(x).checkpoint()
    return Prepared(list(features), kept, yj, x, n)


def fit_prepared(p: Prepared, name: str, seed: int = C.SEED) -> FittedModel:
    clf = make_classifier(name, len(p.kept), p.n, seed=seed)
    rows = full_parts(p.rows, p.n) if name.startswith("logreg") else p.rows
    return FittedModel(name, p.features, p.kept, p.yj, clf.fit(rows))


def fit_model(train: DataFrame, features: Sequence[str], label: str, name: str, id_cols: Sequence[str],
              oversample: bool = False, smote_ratio: float = 1.0, seed: int = C.SEED) -> FittedModel:
    return fit_prepared(prepare(train, features, label, id_cols, oversample, smote_ratio, seed), name, seed)
