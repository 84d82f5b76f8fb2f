"""Training jobs (M26-M28, M15, S7-S10, R7): group-fold evaluation, out-of-fold scores,
leaderboard, refit of the best model, calibration, thresholds and the saved bundle.

The fold loop is owned here (not ``CrossValidator``) because oversampling must touch only
the training side of each fold. Each fit is a distributed pyspark.ml job; the panel is
checkpointed once to the session's checkpoint folder so every fit starts from a short
lineage and a lost executor recomputes from the checkpoint, not from the raw log.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import (GBTClassificationModel, LogisticRegressionModel,
                                       MultilayerPerceptronClassificationModel, RandomForestClassificationModel)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import rules
from ..functions.clean import clean_features
from ..ml import metrics as M
from ..ml import thresholds as TH
from ..ml.boost import BoostedTrees, fit_boosted
from ..ml.calibrate import apply_platt, fit_platt
from ..ml.folds import group_folds
from ..ml.models import FittedModel, Prepared, fit_prepared, prepare
from ..ml.perceptron import Perceptron, fit_perceptron
from ..operators import variants
from ..operators.snapshot import FEATURES_15
from ..session import ensure_checkpoint_dir, spread
from ..sources.demo import LearnerTables, learner_tables

ID = ["id_student", "cutoff"]
CLEAN = "all_nonneg"  # cleaning of training rows; saved with the model and used for scoring
EVAL_MODELS = ("logreg_l1", "rf", "gbt", "mlp")
# Boosting with exponential loss, and ReLU units with L2, momentum and early stop, which
# the pyspark.ml estimators of these names do not have.
GBT = {"loss": "exponential", "rate": 0.03, "depth": 3, "min_leaf": 40, "min_split": 20, "stages": 10}
MLP = {"hidden": (135,), "solver": "sgd", "rate": 0.3, "momentum": 0.9, "alpha": 0.1, "epochs": 1200, "patience": 10}
_MODEL_CLASSES = (LogisticRegressionModel, RandomForestClassificationModel, GBTClassificationModel, MultilayerPerceptronClassificationModel)


def tables(spark: SparkSession, source: str | LearnerTables) -> LearnerTables:
    """The learner tables as given, or those of a folder with the driver tables."""
    return source if isinstance(source, LearnerTables) else learner_tables(spark, source)


def training_panel(spark: SparkSession, source: str | LearnerTables, cutoffs: Sequence[int] | None = None,
                   k: int = 5, **scope) -> DataFrame:
    """V8 panel, cleaned as in training (non-negative), with a group fold per learner. ``scope``:
    module and presentations of the cohort."""
    t = tables(spark, source)
    panel = variants.snapshot_v8(t, cutoffs=cutoffs, **scope)
    x = clean_features(panel, FEATURES_15, CLEAN, keep=["id_student", "cutoff", "y_short"])
    x = group_folds(x, "id_student", k)
    ensure_checkpoint_dir(spark)
    return spread(x.checkpoint(eager=True))


def fit_named(p: Prepared, name: str, id_cols: Sequence[str], seed: int = C.SEED) -> FittedModel:
    """One of ``EVAL_MODELS`` as the training job names it."""
    ids = [*id_cols, *p.kept]  # synthetic rows share their base row's ids
    if name == "gbt":
        model = fit_boosted(p.rows, ids, seed=seed, **GBT)
    elif name == "mlp":
        model = fit_perceptron(p.rows, ids, seed=seed, **MLP)
    else:
        return fit_prepared(p, name, seed)
    return FittedModel(name, p.features, p.kept, p.yj, model)


def evaluate(panel: DataFrame, features: Sequence[str] = FEATURES_15, label: str = "y_short",
             models: Sequence[str] = EVAL_MODELS, k: int = 5, oversample: bool = True, parallelism: int = 8):
    """Per (model, fold) metrics and the out-of-fold prediction table.

    What depends on the fold only (variance filter, oversampling, Yeo-Johnson) is prepared once
    per fold and written; all models of the fold read it. Preparations and fits are independent
    distributed jobs, up to ``parallelism`` of them submitted concurrently from driver threads
    (the counterpart of CrossValidator's parallelism); the predictions are unioned in a fixed
    order and checkpointed before the metrics read them twice.
    """
    from concurrent.futures import ThreadPoolExecutor

    def fold(f):
        return prepare(panel.where(F.col("fold") != f), features, label, ID, oversample=oversample)

    def one(task):
        name, f = task
        fm = fit_named(prepared[f], name, ID)
        return (fm.transform(panel.where(F.col("fold") == f), keep=[*ID, label, "fold"])
                .withColumn("model", F.lit(name)))

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        prepared = list(pool.map(fold, range(k)))
        # The fits of one long task each begin first; the others run many short ones beside them.
        begun = {(name, f): pool.submit(one, (name, f)) for name in sorted(models, key=lambda m: m != "mlp") for f in range(k)}
        preds = [begun[name, f].result() for name in models for f in range(k)]
    oof = reduce(DataFrame.unionByName, preds).checkpoint(eager=True)
    conf = M.confusion(oof, ["model", "fold"], "proba", label, C.DEFAULT_THRESHOLD)
    auc = M.roc_auc(oof, ["model", "fold"], "proba", label)
    per_fold = conf.join(auc, ["model", "fold"]).select(
        "model", "fold", "accuracy", "f1", F.col("recall").alias("sensitivity"), "specificity", "auc")
    return per_fold, oof


def leaderboard(per_fold: DataFrame) -> DataFrame:
    """Mean metrics per model; best first (mean F1, then name)."""
    return (per_fold.groupBy("model").agg(*[F.avg(c).alias(f"mean_{c}") for c in
                                             ("accuracy", "f1", "sensitivity", "specificity", "auc")],
                                           F.median("f1").alias("median_f1"))
            .orderBy(F.col("mean_f1").desc(), "model"))


def best_model(board: DataFrame) -> str:
    """Argmax of mean F1 (ties by name) — one row reaches the driver."""
    return board.orderBy(F.col("mean_f1").desc(), "model").first()["model"]


def save_bundle(spark: SparkSession, fm: FittedModel, path: str, extra: dict) -> None:
    """The fitted classifier (pyspark.ml writer) + a one-row JSON config table."""
    cfg = {"name": fm.name, "features": fm.features, "kept": fm.kept, "yj": fm.yj, **extra}
    if isinstance(fm.model, (BoostedTrees, Perceptron)):
        cfg["own"] = {"kind": type(fm.model).__name__, "model": fm.model.to_dict()}
    else:
        cfg["kind"] = type(fm.model).__name__
        fm.model.write().overwrite().save(os.path.join(path, "model"))
    spark.createDataFrame([(json.dumps(cfg),)], "config string").coalesce(1).write.mode("overwrite").text(
        os.path.join(path, "config"))


def load_bundle(spark: SparkSession, path: str) -> FittedModel:
    """Load classifier + config back."""
    cfg = json.loads(spark.read.text(os.path.join(path, "config")).collect()[0][0])
    if own := cfg.get("own"):
        model = {c.__name__: c for c in (BoostedTrees, Perceptron)}[own["kind"]].from_dict(own["model"])
    else:
        model = next(c for c in _MODEL_CLASSES if c.__name__ == cfg["kind"]).load(os.path.join(path, "model"))
    return FittedModel(cfg["name"], cfg["features"], cfg["kept"], cfg["yj"], model,
                       {k: v for k, v in cfg.items() if k not in ("name", "features", "kept", "yj", "own", "kind")})


def train_job(spark: SparkSession, source: str | LearnerTables, out_path: str, models: Sequence[str] = EVAL_MODELS,
              k: int = 5, **scope) -> dict:
    """Panel -> group-fold evaluation -> best model -> Platt on OOF -> thresholds on the
    blended OOF risk -> refit without oversampling -> save bundle."""
    panel = training_panel(spark, source, k=k, **scope)
    per_fold, oof = evaluate(panel, models=models, k=k)
    board = leaderboard(per_fold)
    name = best_model(board)
    best_oof = oof.where(F.col("model") == name)
    platt = fit_platt(best_oof, "proba", "y_short")
    scored = best_oof.join(panel, [*ID, "y_short", "fold"]).withColumn(
        "risk", rules.blend(apply_platt(F.col("proba"), platt), rules.decline_score_b(), C.BLEND_B_ALPHA))
    scored = scored.withColumn("_g", F.lit(1))
    thr_high = TH.precision_floor(scored, ["_g"], "risk", "y_short", C.PRECISION_FLOOR_HIGH).collect()[0]
    thr_med = TH.precision_floor(scored, ["_g"], "risk", "y_short", C.PRECISION_FLOOR_MEDIUM).collect()[0]
    fm = fit_named(prepare(panel, FEATURES_15, "y_short", ID), name, ID)
    # Q22: calibrator and thresholds come from the oversampled out-of-fold pipeline but are
    # applied to the refit without oversampling; report the mean-score shift between the two.
    shift = (fm.transform(panel, keep=ID).agg(F.avg("proba").alias("p")).collect()[0]["p"]
             - best_oof.agg(F.avg("proba").alias("p")).collect()[0]["p"])
    # Decision thresholds (best F1 on the out-of-fold curve) for raw and calibrated scores.
    best = scored.withColumn("proba_cal", apply_platt(F.col("proba"), platt))
    decide = {k: float(TH.f1_curve(best, ["_g"], c, "y_short").first()["threshold"]) for k, c in (("raw", "proba"), ("calibrated", "proba_cal"))}
    extra = {"platt": platt, "alpha": C.BLEND_B_ALPHA, "mean_score_shift": float(shift), "clean": CLEAN,
             "probability_thresholds": decide,
             "risk_thresholds": {"medium": float(thr_med["threshold"]), "high": float(thr_high["threshold"])}}
    save_bundle(spark, fm, out_path, extra)
    return {"best": name, "bundle": out_path, **extra}


def clean_mode(fm: FittedModel) -> str:
    """How features are cleaned for a bundle: as its training rows were."""
    return fm.extra.get("clean", CLEAN)


def score_with_bundle(fm: FittedModel, features: DataFrame, keep: Sequence[str], form: str = "decline_b") -> DataFrame:
    """Model probability, Platt-calibrated probability, rule score, blended risk, tier.

    form  'decline_b'  calibrated probability with decline score B, the bundle's alpha and its
                       learnt tier thresholds;
          'decline_a'  calibrated probability with decline score A, fixed alpha and tiers;
          'heuristic'  raw probability with the boosted heuristic, and a display value.
    """
    x = clean_features(features, FEATURES_15, clean_mode(fm), keep=list(keep))
    scored = fm.transform(x, keep=[*keep, *FEATURES_15])
    platt = fm.extra.get("platt")  # None: scores pass through
    if form == "heuristic":
        parts = rules.heuristic_blend(F.col("proba"))
        return scored.select(*keep, "proba", *[v.alias(k) for k, v in parts.items()])
    if form == "decline_a":
        out = (scored.withColumn("proba_cal", apply_platt(F.col("proba"), platt))
               .withColumn("decline_score", rules.decline_score_a())
               .withColumn("risk_score", rules.blend(F.col("proba_cal"), F.col("decline_score"), C.BLEND_A["alpha_model"])))
        return out.select(*keep, "proba", "proba_cal", "decline_score", "risk_score",
                          rules.tier(F.col("risk_score"), C.BLEND_A["thr_medium"], C.BLEND_A["thr_high"]).alias("risk_level"))
    if form != "decline_b":
        raise ValueError(form)
    thr = fm.extra.get("risk_thresholds", {"medium": C.BLEND_A["thr_medium"], "high": C.BLEND_A["thr_high"]})
    alpha = fm.extra.get("alpha", C.BLEND_B_ALPHA)
    out = (scored.withColumn("proba_cal", apply_platt(F.col("proba"), platt))
           .withColumn("decline_score", rules.decline_score_b())
           .withColumn("risk_score", rules.blend(F.col("proba_cal"), F.col("decline_score"), alpha)))
    return out.select(*keep, "proba", "proba_cal", "decline_score", "risk_score",
                      rules.tier(F.col("risk_score"), thr["medium"], thr["high"]).alias("risk_level"))
