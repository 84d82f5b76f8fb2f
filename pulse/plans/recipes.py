"""Training recipes as data.

A recipe names its folds, its models with what each needs prepared, how the best one is chosen and
where its threshold comes from. Preparations are a small graph keyed by (fold, oversampling ratio,
power transform, class weights): each is computed and written once and read by all models that share
it. One scored table holds both sides of every (model, fold), so metrics, pooled curves and
thresholds are each one grouped plan over it.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.clean import clean_features
from ..ml import folds as FO
from ..ml import metrics as M
from ..ml import thresholds as TH
from ..ml.boost import fit_boosted
from ..ml.models import FittedModel, Prepared, full_parts, prepare
from ..ml.perceptron import fit_perceptron
from ..operators import variants
from ..operators.snapshot import FEATURES_15
from ..session import ensure_checkpoint_dir, spread
from .train import GBT, MLP, save_bundle, tables


@dataclass(frozen=True)
class Model:
    """A classifier with its settings and preparation: ``oversample`` is the minority's ratio to the
    majority (None: none), ``weights`` 'balanced' or {class: weight}, ``power`` the power transform."""

    name: str
    kind: str                                  # logreg | forest | boosted | perceptron
    settings: dict = field(default_factory=dict)
    oversample: float | None = None
    weights: object = None
    power: bool = True

    def needs(self) -> tuple:
        w = tuple(sorted(self.weights.items())) if isinstance(self.weights, dict) else self.weights
        return self.oversample, self.power, w


@dataclass(frozen=True)
class Recipe:
    models: tuple
    label: str
    folds: str = "group"                       # group | class_group
    k: int = 5
    choose: str = "f1"                         # f1 | auc | pooled_ap
    threshold: str = "fixed"                   # fixed | train_folds
    clean: str = "all_nonneg"

    def light(self, **limits) -> "Recipe":
        """The same recipe with iteration counts of at most ``limits`` (trees, stages, epochs)."""
        return replace(self, models=tuple(replace(m, settings={k: min(v, limits[k]) if k in limits else v for k, v in m.settings.items()})
                                          for m in self.models))


ADAM = {"solver": "adam", "rate": 0.01, "epochs": 1000, "patience": 10}

# The settings of the training variants.
EARLY_WARNING = Recipe(label="y_short", models=(
    Model("boosted", "boosted", GBT, oversample=1.0),
    Model("forest", "forest", {"trees": 50, "depth": 3, "min_leaf": 10}, oversample=1.0),
    Model("perceptron", "perceptron", MLP, oversample=1.0),
    Model("logreg", "logreg", {"penalty": "l1", "C": 1.0}, oversample=1.0)))
UNREGISTER = Recipe(label="target", threshold="train_folds", clean="click_nonneg", models=(
    Model("logreg", "logreg", {"penalty": "l2", "C": 2.0}, weights="balanced"),
    Model("forest", "forest", {"trees": 500, "depth": 10, "min_leaf": 10}, oversample=0.6, weights="balanced", power=False)))
DAY7 = Recipe(label="dropout", folds="class_group", choose="pooled_ap", models=(
    Model("forest", "forest", {"trees": 400, "depth": 12, "min_leaf": 5}, weights="balanced"),
    Model("boosted", "boosted", {"loss": "exponential", "rate": 0.03, "depth": 3, "min_leaf": 40, "min_split": 20, "stages": 150}),
    Model("perceptron", "perceptron", {"hidden": (128, 64), "alpha": 0.0005, **ADAM, "epochs": 800}, oversample=1.0),
    Model("logreg", "logreg", {"penalty": "l1", "C": 1.0}, oversample=1.0)))
OPTIMIZED = Recipe(label="y_short", models=(
    Model("logreg", "logreg", {"penalty": "l2", "C": 1.0}, weights="balanced"),
    Model("forest", "forest", {"trees": 200, "depth": 10, "min_leaf": 4}, weights="balanced"),
    Model("boosted", "boosted", {"loss": "logistic", "rate": 0.05, "depth": 5, "min_leaf": 1, "min_split": 10, "stages": 150, "subsample": 0.8}),
    Model("perceptron", "perceptron", {"hidden": (64, 32), "alpha": 0.001, **ADAM})))


def fit(p: Prepared, m: Model, ids: Sequence[str], seed: int = C.SEED) -> FittedModel:
    s = dict(m.settings)
    weight = {"weightCol": "weight"} if m.weights is not None else {}
    if m.kind == "logreg":
        # C * sum(loss) + penalty is mean loss + penalty / (C * n).
        model = LogisticRegression(maxIter=200, tol=1e-7, standardization=False, regParam=1.0 / (s["C"] * max(p.n, 1)),
                                   elasticNetParam=1.0 if s["penalty"] == "l1" else 0.0, **weight).fit(full_parts(p.rows, p.n))
    elif m.kind == "forest":
        model = RandomForestClassifier(numTrees=s["trees"], maxDepth=s["depth"], minInstancesPerNode=s["min_leaf"], seed=seed, **weight).fit(p.rows)
    elif m.kind == "boosted":
        model = fit_boosted(p.rows, ids, seed=seed, **s)
    elif m.kind == "perceptron":
        model = fit_perceptron(p.rows, ids, seed=seed, **s)
    else:
        raise ValueError(m.kind)
    return FittedModel(m.name, p.features, p.kept, p.yj, model)


def with_folds(panel: DataFrame, recipe: Recipe, key: str, seed: int = C.SEED) -> DataFrame:
    ensure_checkpoint_dir(panel.sparkSession)
    if recipe.folds not in ("group", "class_group"):
        raise ValueError(recipe.folds)
    return spread(FO.even_group_folds(panel, key, recipe.label if recipe.folds == "class_group" else None, recipe.k, seed).checkpoint())


@dataclass
class Run:
    """What a recipe's folds gave: ``scored`` (model, fold, side, ids, label, proba), ``board``, and the
    preparations that were made, by key."""

    scored: DataFrame
    board: DataFrame
    prepared: dict


def run_folds(panel: DataFrame, recipe: Recipe, ids: Sequence[str], key: str = "id_student",
              features: Sequence[str] = FEATURES_15, parallelism: int = 8) -> Run:
    """Every model of the recipe on every fold of ``panel`` (with a ``fold`` column)."""
    label = recipe.label
    keys = sorted({(f, *m.needs()) for m in recipe.models for f in range(recipe.k)}, key=str)

    def make(k):
        f, ratio, power, w = k
        return prepare(panel.where(F.col("fold") != f), features, label, list(ids), oversample=ratio is not None, smote_ratio=ratio or 1.0,
                       power=power, weights=dict(w) if isinstance(w, tuple) else w)

    def one(task):
        m, f = task
        fm = fit(prepared[(f, *m.needs())], m, row_ids(prepared[(f, *m.needs())], ids))
        side = F.when(F.col("fold") == f, "test").otherwise("train")
        return (fm.transform(panel.withColumn("side", side), keep=[*ids, label, "side"])
                .withColumns({"model": F.lit(m.name), "fold": F.lit(f)}))

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        prepared = dict(zip(keys, pool.map(make, keys), strict=True))
        # The fits of one long task each begin first; the others run many short ones beside them.
        begun = {(m.name, f): pool.submit(one, (m, f)) for m in sorted(recipe.models, key=lambda m: m.kind != "perceptron") for f in range(recipe.k)}
        parts = [begun[m.name, f].result() for m in recipe.models for f in range(recipe.k)]
    scored = reduce(DataFrame.unionByName, parts).checkpoint()
    return Run(scored, leaderboard(scored, recipe), prepared)


def row_ids(p: Prepared, ids: Sequence[str]) -> list[str]:
    """Columns that tell the prepared rows apart: synthetic ones share their base row's ids."""
    return [*ids, *p.kept]


def leaderboard(scored: DataFrame, recipe: Recipe) -> DataFrame:
    """Per model: mean metrics over the folds, pooled average precision, the threshold and the F1
    that it gives on the folds' test sides; best first (``choose``, then name)."""
    label, test = recipe.label, scored.where("side = 'test'")
    by = ["model", "fold"]
    conf = M.confusion(test, by, "proba", label, C.DEFAULT_THRESHOLD)
    auc, ap = M.roc_auc(test, by, "proba", label), M.average_precision(test, by, "proba", label)
    means = conf.join(auc, by).join(ap, by).groupBy("model").agg(
        *[F.avg(c).alias(f"mean_{c}") for c in ("accuracy", "precision", "recall", "f1", "specificity", "auc")],
        F.avg("average_precision").alias("mean_ap"), F.median("f1").alias("median_f1"))
    pooled = M.average_precision(test, ["model"], "proba", label).withColumnRenamed("average_precision", "pooled_ap")
    board = means.join(pooled, "model")
    if recipe.threshold == "train_folds":
        per = TH.median_threshold(TH.train_fold_thresholds(scored, ["model"], "proba", label), ["model"])
        board = board.join(per.withColumnRenamed("mean_f1", "threshold_f1"), "model")
    else:
        board = board.withColumns({"threshold": F.lit(C.DEFAULT_THRESHOLD), "threshold_f1": F.col("mean_f1")})
    return board.withColumn("criterion", criterion(recipe)).orderBy(F.col("criterion").desc(), "model")


def criterion(recipe: Recipe):
    return {"f1": F.col("threshold_f1"), "auc": F.col("mean_auc"), "pooled_ap": F.col("pooled_ap")}[recipe.choose]


def panel_of(spark: SparkSession, source, recipe: Recipe) -> tuple[DataFrame, list[str], Sequence[str]]:
    """(cleaned panel with folds, id columns, features) of one of the recipes above."""
    t = tables(spark, source)
    if recipe.label == "target":
        rows = variants.snapshot_v9(t)
    elif recipe.label == "y_short":
        rows = variants.snapshot_v8(t)
    else:
        rows = variants.snapshot_v10(t)
    features = FEATURES_15 if set(FEATURES_15) <= set(rows.columns) else [c for c in rows.columns if c not in ("id_student", recipe.label)]
    ids = [c for c in ("id_student", "cutoff") if c in rows.columns]
    x = clean_features(rows, features, recipe.clean, keep=[*ids, recipe.label])
    return with_folds(x, recipe, "id_student"), ids, features


def train(spark: SparkSession, source, recipe: Recipe, out_path: str | None = None) -> dict:
    """Folds, choice, refit of the best model on all rows and, with ``out_path``, its bundle."""
    panel, ids, features = panel_of(spark, source, recipe)
    run = run_folds(panel, recipe, ids, features=features)
    best = run.board.first()
    m = next(m for m in recipe.models if m.name == best["model"])
    p = prepare(panel, features, recipe.label, ids, oversample=m.oversample is not None, smote_ratio=m.oversample or 1.0, power=m.power, weights=m.weights)
    fm = fit(p, m, row_ids(p, ids))
    extra = {"clean": recipe.clean, "threshold": float(best["threshold"]), "criterion": float(best["criterion"]), "choose": recipe.choose}
    if out_path:
        save_bundle(spark, fm, out_path, extra)
    return {"best": m.name, "model": fm, "run": run, "panel": panel, **extra}
