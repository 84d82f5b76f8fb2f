"""Training pipeline sanity on a planted signal, and bundle persistence."""

import tempfile

from pyspark.sql import functions as F

from pulse.ml.models import fit_model
from pulse.operators.snapshot import FEATURES_15
from pulse.plans import train as TR

SF = "/root/testdata/sf0.01"


def test_group_cv_recovers_planted_signal_and_bundle_round_trips(spark):
    panel = TR.training_panel(spark, SF, k=3)
    # planted label: few clicks in the last week
    planted = panel.withColumn("y_short", (F.col("clicks_last_7_days") < 60).cast("int"))
    per_fold, oof = TR.evaluate(planted, models=("rf", "logreg_l1"), k=3)
    board = {r["model"]: r for r in TR.leaderboard(per_fold).collect()}
    assert board["rf"]["mean_auc"] > 0.9 and board["logreg_l1"]["mean_auc"] > 0.9
    # every learner's rows are out-of-fold exactly once per model
    assert oof.groupBy("model", "id_student", "cutoff").count().where("count > 1").count() == 0
    assert oof.count() == 2 * planted.count()
    fm = fit_model(planted, FEATURES_15, "y_short", "rf", TR.ID)
    path = tempfile.mkdtemp(prefix="pulse-bundle-", dir="/tmp")
    TR.save_bundle(spark, fm, path, {"platt": {"a": 1.0, "b": 0.0}})
    back = TR.load_bundle(spark, path)
    a = sorted(tuple(r) for r in fm.transform(planted, keep=TR.ID).collect())
    b = sorted(tuple(r) for r in back.transform(planted, keep=TR.ID).collect())
    assert a == b and back.kept == fm.kept


def test_best_model_chooses_among_all_models_on_all_folds(spark, monkeypatch):
    from pulse.plans import catalog as Q
    seen = []

    def evaluate(panel, models=TR.EVAL_MODELS, k=5):
        seen.append((panel, tuple(models), k))
        return spark.createDataFrame([(m, f, *[0.5 + (m == "mlp") / 10] * 5) for m in models for f in range(k)],
                                     "model string, fold int, accuracy double, f1 double, sensitivity double, specificity double, auc double"), None
    monkeypatch.setattr(Q, "_panel", lambda spark, sf: "panel")
    monkeypatch.setattr(TR, "evaluate", evaluate)
    assert [r.best_model for r in Q._best(spark, "at").collect()] == ["mlp"]
    assert seen == [("panel", ("logreg_l1", "rf", "gbt", "mlp"), 5)]


def test_evaluated_models_are_the_named_ones(spark, tmp_path):
    """Exponential loss for boosting, ReLU units with early stop for the perceptron; both as a bundle."""
    from pulse.ml.boost import BoostedTrees
    from pulse.ml.models import prepare
    from pulse.ml.perceptron import Perceptron
    rows = spark.range(400).selectExpr("id AS id_student", "int(id % 4) AS cutoff", "int(id % 7 + id % 3 > 5) AS y_short", "double(id % 7) AS a", "double(id % 3) AS b")
    p = prepare(rows, ["a", "b"], "y_short", TR.ID)
    gbt, mlp = TR.fit_named(p, "gbt", TR.ID), TR.fit_named(p, "mlp", TR.ID)
    assert isinstance(gbt.model, BoostedTrees) and gbt.model.loss == "exponential" and len(gbt.model.trees) == 10
    assert isinstance(mlp.model, Perceptron) and mlp.model.layers == [2, 135, 1] and mlp.model.history
    for fm in (gbt, mlp):
        TR.save_bundle(spark, fm, f"{tmp_path}/{fm.name}", {})
        back = TR.load_bundle(spark, f"{tmp_path}/{fm.name}")
        assert sorted(back.transform(rows, keep=TR.ID).collect()) == sorted(fm.transform(rows, keep=TR.ID).collect())
