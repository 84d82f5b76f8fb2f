"""Queries whose rows SQL can confirm although a model's scores cannot be written in SQL.

Each takes the result of a model query, written and read again, and recomputes in plain SQL
expressions what follows from its own columns (calibration, blend, tier, decision, argmax,
optimality of a fit). Ids, rule scores, fold numbers and counts are compared exactly; the other
columns say whether the recomputation agrees.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from .. import oracle as O
from ..functions import rules
from ..functions.clean import clean_features
from ..ml import calibrate as CAL
from ..ml import importance as IMP
from ..ml.models import fit_prepared, prepare
from ..operators import variants
from ..operators.snapshot import FEATURES_15
from ..registry import register
from ..session import scratch_path
from . import catalog as Q
from . import recipes as R
from . import train as TR

IDS = ["id_student", "cutoff"]
_CLEAN = f"q AS (SELECT id_student, cutoff, y_short, {O.clean_sql('all_nonneg')} FROM p)"


def written(df: DataFrame, what: str) -> DataFrame:
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def near(a: str, b: str, tol: float = 1e-9):
    """Whether two SQL expressions agree."""
    return F.expr(f"coalesce(abs(({a}) - ({b})) < {tol}, false)")


def _tier(score: str, medium: float, high: float) -> str:
    return f"CASE WHEN {score} >= {high!r}D THEN 'HIGH' WHEN {score} >= {medium!r}D THEN 'MEDIUM' ELSE 'LOW' END"


# ---------------------------------------------------------------- R4, R12-R14: bundle scores

def _calibrated(platt: dict) -> str:
    return f"1D / (1D + exp(-({platt['a']!r}D * proba + {platt['b']!r}D)))"


def _blended(df: DataFrame, extra: dict, what: str, alpha: float, thr: dict) -> DataFrame:
    return written(df, what).select(
        *IDS, F.round("decline_score", 6).alias("decline_score"),
        F.expr("proba BETWEEN 0 AND 1").alias("proba_ok"), near("proba_cal", _calibrated(extra["platt"])).alias("calibrated_ok"),
        near("risk_score", f"{alpha!r}D * proba_cal + {1 - alpha!r}D * decline_score").alias("risk_ok"),
        F.expr(f"risk_level = {_tier('risk_score', thr['medium'], thr['high'])}").alias("tier_ok"))


def _blend_sql(rule: str, where: str = "") -> str:
    return Q._on_v8(f"SELECT id_student, cutoff, round({rule}, 6) AS decline_score, true AS proba_ok, true AS calibrated_ok, "
                    f"true AS risk_ok, true AS tier_ok FROM q {where}", _CLEAN)


@register("daily_scores_check", _blend_sql(O.DECLINE_B, "WHERE cutoff = 14"))
def daily_scores_check(spark, sf):
    extra = Q._bundle(spark, sf).extra
    return _blended(Q._daily_model(spark, sf), extra, "daily", extra["alpha"], extra["risk_thresholds"])


@register("blended_risk_check", _blend_sql(O.DECLINE_B))
def blended_risk_check(spark, sf):
    fm = Q._bundle(spark, sf)
    return _blended(TR.score_with_bundle(fm, variants.snapshot_v8(Q.T(spark, sf)), IDS), fm.extra, "blended", fm.extra["alpha"], fm.extra["risk_thresholds"])


@register("blended_risk_a_check", _blend_sql(O.DECLINE_A))
def blended_risk_a_check(spark, sf):
    fm = Q._bundle(spark, sf)
    return _blended(TR.score_with_bundle(fm, variants.snapshot_v8(Q.T(spark, sf)), IDS, "decline_a"), fm.extra, "blended_a",
                    C.BLEND_A["alpha_model"], {"medium": C.BLEND_A["thr_medium"], "high": C.BLEND_A["thr_high"]})


@register("blended_risk_heuristic_check", Q._on_v8(f"""SELECT id_student, cutoff, round({O.HEURISTIC}, 6) AS heuristic_risk,
  round(least(greatest({O.HEURISTIC} * 1.15::DOUBLE, 0::DOUBLE), 1::DOUBLE), 6) AS heur_boosted, true AS risk_ok, true AS display_ok FROM q""", _CLEAN))
def blended_risk_heuristic_check(spark, sf):
    out = written(TR.score_with_bundle(Q._bundle(spark, sf), variants.snapshot_v8(Q.T(spark, sf)), IDS, "heuristic"), "heuristic")
    return out.select(*IDS, F.round("heuristic_risk", 6).alias("heuristic_risk"), F.round("heur_boosted", 6).alias("heur_boosted"),
                      near("risk_score", "0.55D * proba + 0.45D * heur_boosted").alias("risk_ok"),
                      near("display", "1D / (1D + exp(-8D * (risk_score - 0.5D)))").alias("display_ok"))


@register("score_calibrated_check", Q._on_v8("""SELECT id_student, cutoff, true AS calibrated_ok, true AS display_ok, true AS decision_ok FROM p"""))
def score_calibrated_check(spark, sf):
    platt, (k, c) = Q._bundle(spark, sf).extra["platt"], Q._display_fit(spark, sf)
    out = written(Q._score_cal(spark, sf), "calibrated").withColumnRenamed("proba_raw", "proba")
    return out.select(*IDS, near("proba_cal", _calibrated(platt)).alias("calibrated_ok"),
                      near("display", f"1D / (1D + exp(-({k!r}D) * (proba_cal - ({c!r}D))))").alias("display_ok"),
                      F.expr("decision = CASE WHEN proba_cal >= 0.5D THEN 1 ELSE 0 END").alias("decision_ok"))


@register("score_with_threshold_check", Q._on_v8("""SELECT id_student, cutoff, 0.5::DOUBLE AS threshold, 'rf' AS model_name, true AS decision_ok,
  true AS score_ok FROM p"""))
def score_with_threshold_check(spark, sf):
    out = written(Q._score_thr(spark, sf, 0.5), "with_threshold")
    fm, p = Q._bundle(spark, sf), Q._panel(spark, sf)
    again = written(fm.transform(p, keep=IDS), "again").withColumnRenamed("proba", "other")
    return out.join(again, IDS).select(*IDS, "threshold", "model_name", F.expr("prediction = CASE WHEN proba >= threshold THEN 1 ELSE 0 END").alias("decision_ok"),
                                       near("proba", "other").alias("score_ok"))


# ---------------------------------------------------------------- R8-R10: serving paths

_V11 = Q.W(Q._V11_CTES, f"p AS ({Q._V11_SELECT})")


@register("score_raw_history_check", _V11 + "\nSELECT student_id, true AS proba_ok, true AS tier_ok, true AS same_as_features FROM p")
def score_raw_history_check(spark, sf):
    fm = Q._bundle(spark, sf)
    rows = clean_features(Q._feature_rows(spark, sf), FEATURES_15, TR.clean_mode(fm), keep=["student_id"])
    other = written(fm.transform(rows, keep=["student_id"]), "from_features")
    out = written(Q._score_single(spark, sf), "raw_history").join(other, "student_id")
    return out.select("student_id", F.expr("dropout_probability BETWEEN 0 AND 1").alias("proba_ok"),
                      F.expr(f"risk_level = {_tier('dropout_probability', *C.TIERS_SINGLE)}").alias("tier_ok"),
                      near("dropout_probability", "proba").alias("same_as_features"))


@register("score_feature_batch_check", _V11 + "\nSELECT student_id, true AS proba_ok, true AS tier_ok FROM p")
def score_feature_batch_check(spark, sf):
    return written(Q._score_features(spark, sf), "feature_batch").select(
        "student_id", F.expr("dropout_probability BETWEEN 0 AND 1").alias("proba_ok"),
        F.expr(f"risk_level = {_tier('dropout_probability', *C.TIERS_BATCH)}").alias("tier_ok"))


@register("score_raw_batch_check", Q.W() + f"""
SELECT CAST(id_student AS VARCHAR) AS student_id, CASE WHEN date_registration IS NULL THEN 'days_since_registration is missing' END AS error,
       date_registration IS NOT NULL AS scored, true AS tier_ok
FROM student_registration WHERE code_module = '{Q.MOD}' AND code_presentation IN {O.PRES}""")
def score_raw_batch_check(spark, sf):
    return written(Q._score_batch(spark, sf), "raw_batch").select(
        "student_id", "error", F.expr("dropout_probability IS NOT NULL").alias("scored"),
        F.expr(f"risk_level <=> CASE WHEN dropout_probability IS NOT NULL THEN {_tier('dropout_probability', *C.TIERS_SINGLE)} END").alias("tier_ok"))


# ---------------------------------------------------------------- M11-M16, M26-M28, S7, S10, J11: fits

@register("model_roundtrip_check", Q._on_v8("""SELECT m.model, count(*) AS n, CAST(0 AS BIGINT) AS n_differ FROM p,
  (SELECT unnest(['rf', 'logreg_l1', 'boosted', 'perceptron']) AS model) m GROUP BY m.model"""))
def model_roundtrip_check(spark, sf):
    """Scores of a model before it is saved and after it is loaded, row by row."""
    p = Q._panel(spark, sf)
    prep = prepare(p, FEATURES_15, "y_short", TR.ID)
    fits = {n: fit_prepared(prep, n) for n in ("rf", "logreg_l1")}
    for m in R.EARLY_WARNING.light(stages=3, epochs=2).models:
        if m.kind in ("boosted", "perceptron"):
            fits[m.name] = R.fit(prep, m, R.row_ids(prep, TR.ID))
    out = []
    for name, fm in fits.items():
        path = scratch_path(spark, f"roundtrip_{name}")
        TR.save_bundle(spark, fm, path, {})
        a, b = fm.transform(p, keep=IDS), TR.load_bundle(spark, path).transform(p, keep=IDS).withColumnRenamed("proba", "other")
        out.append(a.join(b, IDS).groupBy(F.lit(name).alias("model")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("proba").eqNullSafe(F.col("other"))).alias("n_differ")))
    return _union(out)


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("train_fit_check", Q._on_v8("""SELECT m.model, count(*) AS n, CAST(0 AS BIGINT) AS n_bad, true AS better_than_constant, true AS optimal
  FROM p, (SELECT unnest(['rf', 'gbt', 'mlp', 'logreg_l1', 'logreg_l2']) AS model) m GROUP BY m.model"""))
def train_fit_check(spark, sf):
    """Every row scored once within [0, 1], a smaller log loss than the base rate's, and for the logistic
    models the optimality conditions of their penalised likelihood."""
    p = Q._panel(spark, sf)
    prep = prepare(p, FEATURES_15, "y_short", TR.ID)
    out = []
    for name in ("rf", "gbt", "mlp", "logreg_l1", "logreg_l2"):
        fm = fit_prepared(prep, name)
        s = fm.transform(p, keep=[*IDS, "y_short"])
        row = s.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("proba").between(0, 1)).alias("bad"), F.avg("y_short").alias("base"),
                    F.avg(-F.when(F.col("y_short") == 1, F.log(F.greatest("proba", F.lit(1e-15)))).otherwise(F.log(F.greatest(1 - F.col("proba"), F.lit(1e-15))))).alias("loss")).first()
        base = row.base
        constant = -(base * np.log(base) + (1 - base) * np.log(1 - base)) if 0 < base < 1 else 0.0
        out.append((name, row.n, row.bad, bool(row.loss <= constant + 1e-6), _optimal(prep, fm) if name.startswith("logreg") else True))
    return spark.createDataFrame(out, "model string, n long, n_bad long, better_than_constant boolean, optimal boolean")


def _optimal(prep, fm, tol: float = 2e-3) -> bool:
    """|gradient of the mean loss + penalty| near zero at the fitted weights (for L1: within the penalty
    where a weight is zero)."""
    w, b = fm.model.coefficients.toArray(), fm.model.intercept
    lam, l1 = 1.0 / prep.n, fm.name == "logreg_l1"
    x = vector_to_array("features")
    z = F.lit(float(b))
    for i, v in enumerate(w):
        z = z + F.lit(float(v)) * x[i]
    error = 1 / (1 + F.exp(-z)) - F.col("label")
    g = prep.rows.agg(F.avg(error).alias("b"), *[F.avg(error * x[i]).alias(f"g{i}") for i in range(len(w))]).first()
    worst = abs(g["b"])
    for i, v in enumerate(w):
        slope = g[f"g{i}"]
        if not l1:
            worst = max(worst, abs(slope + lam * v))
        else:
            worst = max(worst, abs(slope + lam * np.sign(v)) if v else max(0.0, abs(slope) - lam))
    return bool(worst < tol)


@register("oof_check", Q._on_v8(f"""SELECT id_student, cutoff, CAST({Q._hash_sql('id_student')} % 5 AS INTEGER) AS fold, CAST(1 AS BIGINT) AS times,
  true AS proba_ok FROM p"""))
def oof_check(spark, sf):
    """Every row is scored once, by the fold its learner belongs to."""
    oof = written(TR.evaluate(Q._panel(spark, sf), models=("logreg_l1",), k=5, oversample=False)[1], "oof")
    return oof.groupBy(*IDS).agg(F.max("fold").alias("fold"), F.count(F.lit(1)).alias("times"), F.expr("bool_and(proba BETWEEN 0 AND 1)").alias("proba_ok"))


@register("platt_check", Q._on_v8("SELECT id_student, cutoff, true AS calibrated_ok, true AS optimal FROM p"))
def platt_check(spark, sf):
    """Platt's two conditions: residuals sum to zero, and residual x score balances the penalty."""
    oof = written(TR.evaluate(Q._panel(spark, sf), models=("logreg_l1",), k=5, oversample=False)[1], "platt")
    platt = CAL.fit_platt(oof, "proba", "y_short")
    out = oof.withColumn("proba_cal", CAL.apply_platt(F.col("proba"), platt))
    g = out.agg(F.avg(F.col("proba_cal") - F.col("y_short")).alias("b"), F.sum((F.col("proba_cal") - F.col("y_short")) * F.col("proba")).alias("a"),
                F.count(F.lit(1)).alias("n")).first()
    fine = abs(g.b) < 1e-4 and abs(g.a + platt["a"]) / g.n < 1e-4
    return out.select(*IDS, near("proba_cal", _calibrated(platt)).alias("calibrated_ok"), F.lit(bool(fine)).alias("optimal"))


@register("importance_check", Q._on_v8("""SELECT m.model, CAST((SELECT count(*) FROM kept) AS BIGINT) AS n_features, true AS sums_to_one, true AS known
  FROM (SELECT unnest(['rf', 'gbt', 'logreg_l1']) AS model) m""", f"""q AS (SELECT {O.clean_sql('all_nonneg')} FROM p),
kept AS (SELECT feature FROM ({" UNION ALL ".join(f"SELECT '{c}' AS feature, var_pop({c}) AS v FROM q" for c in FEATURES_15)}) WHERE v > 0)"""))
def importance_check(spark, sf):
    """One importance per kept feature, none negative; those of the trees sum to one."""
    prep = prepare(Q._panel(spark, sf), FEATURES_15, "y_short", TR.ID)
    parts = [IMP.native_importance(spark, fit_prepared(prep, n)) for n in ("rf", "gbt", "logreg_l1")]
    total = F.sum("importance")
    return _union(parts).groupBy("model").agg(
        F.count_distinct("feature").alias("n_features"), (F.when(F.col("model") == "logreg_l1", total > 0).otherwise(F.abs(total - 1) < 1e-9)).alias("sums_to_one"),
        F.expr("bool_and(importance >= 0)").alias("known"))


# ---------------------------------------------------------------- recipes

_RUNS: dict = {}
LIGHT = {"trees": 30, "stages": 12, "epochs": 6}  # fewer iterations, for trials; the registered queries run the recipes whole


def _run(spark, sf, recipe: R.Recipe) -> dict:
    """A recipe's run, once per session and table folder."""
    key = spark.sparkContext.applicationId, sf, recipe.label, recipe.choose
    if key not in _RUNS:
        _RUNS[key] = R.train(spark, sf, recipe)
    return _RUNS[key]


for _key, _recipe in (("train_v8", R.EARLY_WARNING), ("train_v9", R.UNREGISTER), ("train_v10", R.DAY7)):
    register(_key)(lambda spark, sf, r=_recipe: _run(spark, sf, r)["run"].board)


def _recipe_sql(models: tuple, panel: str, k: int = 5) -> str:
    names = ", ".join(f"'{m.name}'" for m in models)
    return panel.replace("@", f"""SELECT m.model, count(*) AS n_test, count(*) * {k - 1} AS n_train, CAST(0 AS BIGINT) AS n_learners_on_both_sides,
  CAST(0 AS BIGINT) AS n_bad, true AS threshold_ok, true AS order_ok FROM p, (SELECT unnest([{names}]) AS model) m GROUP BY m.model""")


CELLS = 1000  # cells of about as many distinct scores each that a group is cut into


def threshold_f1(s: DataFrame, by: list[str], cells: int = CELLS) -> DataFrame:
    """(by, t, f1): the F1 of every distinct score t as threshold, over all rows of its group at or above it.

    ``s``: by, proba, y. Without ``ranks``: scores are cut at quantiles of the distinct ones, what a
    cell adds up is summed over the cells above it, and within a cell over its own scores."""
    counts = written(s.groupBy(*by, F.col("proba").alias("t")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("p")), "scores")
    cuts = counts.groupBy(*by).agg(F.percentile_approx("t", [i / cells for i in range(1, cells)], 20 * cells).alias("cuts"))
    laid = written(counts.join(cuts, by).select(*by, "t", "n", "p", F.size(F.filter("cuts", lambda c: c <= F.col("t"))).alias("cell")), "cells")
    above = Window.partitionBy(*by).orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    held = laid.groupBy(*by, "cell").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).select(
        *by, "cell", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("n", "p")],
        F.sum("p").over(Window.partitionBy(*by)).alias("pos"))
    inside = Window.partitionBy(*by, "cell").orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = laid.select(*by, "cell", "t", F.sum("n").over(inside).alias("n"), F.sum("p").over(inside).alias("p"))
    return run.join(held, [*by, "cell"]).select(*by, "t", (2 * (F.col("p") + F.col("p_above")) / (F.col("n") + F.col("n_above") + F.col("pos"))).alias("f1"))


def _recipe_check(spark, sf, recipe: R.Recipe) -> DataFrame:
    """Sides of the folds exactly, the threshold as the folds' median recomputed on the training
    sides, and the best model first."""
    done = _run(spark, sf, recipe)
    scored, board = done["run"].scored, done["run"].board
    both = (scored.groupBy("model", "fold", "id_student").agg(F.count_distinct("side").alias("sides"))
            .groupBy("model").agg(F.count_if(F.col("sides") > 1).alias("n_learners_on_both_sides")))
    counts = scored.groupBy("model").agg(F.count_if(F.col("side") == "test").alias("n_test"), F.count_if(F.col("side") == "train").alias("n_train"),
                                         F.count_if(~F.coalesce(F.col("proba").between(0, 1), F.lit(False))).alias("n_bad"))
    if recipe.threshold == "train_folds":
        f1 = threshold_f1(scored.where("side = 'train'").select("model", "fold", "proba", F.col(recipe.label).alias("y")), ["model", "fold"])
        top = f1.groupBy("model", "fold").agg(F.max_by("t", F.struct(F.round("f1", 10), -F.col("t"))).alias("t"))
        want = top.groupBy("model").agg(F.median("t").alias("want"))
    else:
        want = board.select("model", F.lit(C.DEFAULT_THRESHOLD).alias("want"))
    rank = board.select("criterion", "model").collect()  # one row a model
    ordered = [tuple(r) for r in rank] == sorted(map(tuple, rank), key=lambda r: (-r[0], r[1])) and done["best"] == rank[0]["model"]
    return (counts.join(both, "model").join(want, "model").join(board.select("model", "threshold"), "model")
            .select("model", "n_test", "n_train", "n_learners_on_both_sides", "n_bad", near("threshold", "want", 1e-6).alias("threshold_ok"),
                    F.lit(ordered).alias("order_ok")))


register("train_v8_check", _recipe_sql(R.EARLY_WARNING.models, Q._on_v8("@")))(lambda spark, sf: _recipe_check(spark, sf, R.EARLY_WARNING))
register("train_v9_check", _recipe_sql(R.UNREGISTER.models, Q.W(O.v9_panel()[0], f"p AS ({O.v9_panel()[1]})") + "\n@"))(
    lambda spark, sf: _recipe_check(spark, sf, R.UNREGISTER))
register("train_v10_check", _recipe_sql(R.DAY7.models, Q.W(O.REG_CLOCK, "p AS (SELECT id_student FROM students)") + "\n@"))(
    lambda spark, sf: _recipe_check(spark, sf, R.DAY7))
