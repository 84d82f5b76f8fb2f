"""Hold-out evaluation of the single-window snapshot.

Stratified 70/30 split by learner hash -> numeric columns standardised with train-fold
population statistics -> categorical columns one-hot encoded (levels learnt on the train
fold, unseen levels all-zero) -> class-weighted logistic model and forest, unweighted boosting and
perceptron -> metrics at 0.5, AUC, step-wise
AP and the F1-grid threshold on the test fold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..ml import metrics as M
from ..ml import prep as P
from ..ml import thresholds as TH
from ..ml.folds import stratified_split
from ..ml.models import make_classifier
from ..operators import early
from ..session import ensure_checkpoint_dir
from ..sources.demo import learner_tables

MODELS = ("logreg_l2", "rf", "gbt", "mlp")


def holdout_eval(data: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str = "dropout",
                 key: str = "id_student", models: Sequence[str] = MODELS) -> DataFrame:
    ensure_checkpoint_dir(data.sparkSession)
    split = stratified_split(data, label, [key]).checkpoint(eager=True)
    train = split.where(F.col("is_train"))
    test = split.where(~F.col("is_train"))
    std = P.fit_standard(train, numeric)
    train_w = P.class_weight_col(train, label)
    weights = {r[0]: r[1] for r in train_w.groupBy(label).agg(F.max("weight")).collect()}

    def prepare(df):
        z = P.standardize(df, numeric, keep=[key, label, *categorical], params=std)
        return P.fill_null_category(z, categorical)

    tr, te = prepare(train), prepare(test)
    enc = P.onehot_pipeline(categorical).fit(tr)
    cols = list(numeric) + [f"{c}__oh" for c in categorical]
    asm = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep")
    tr = asm.transform(enc.transform(tr)).withColumn("label", F.col(label).cast("double"))
    tr = P.class_weight_col(tr, label, weights)
    n_parts = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tr = tr.repartition(n_parts, key).sortWithinPartitions(key)  # same fit on every run
    te = asm.transform(enc.transform(te))
    n_feat = len(tr.select("features").first()["features"])
    n = tr.count()
    out = None
    for name in models:
        clf = make_classifier(name, n_feat, n, weight_col=None if name in ("mlp", "gbt") else "weight")
        pred = clf.fit(tr).transform(te).select(
            key, label, vector_to_array(F.col("probability"))[1].alias("proba")).withColumn("model", F.lit(name))
        out = pred if out is None else out.unionByName(pred)
    conf = M.confusion(out, ["model"], "proba", label, C.DEFAULT_THRESHOLD)
    auc = M.roc_auc(out, ["model"], "proba", label)
    ap = M.average_precision(out, ["model"], "proba", label)
    thr = TH.f1_grid(out, ["model"], "proba", label, TH.grid(C.GRID_COARSE), 0.0)
    return (conf.join(auc, "model").join(ap, "model").join(thr, "model")
            .select("model", "accuracy", "precision", "recall", "f1", "auc", "average_precision",
                    "best_threshold", "best_f1"))


def holdout_v2(spark: SparkSession, sf_dir: str, models: Sequence[str] = MODELS) -> DataFrame:
    t = learner_tables(spark, sf_dir)
    data = early.early_snapshot(early.V2, t, C.MODULE, C.PRESENTATION)
    numeric = [c for c in data.columns if c not in ("id_student", "dropout", "gender", "age_band",
                                                     "min_score", "score_std")]
    return holdout_eval(data, numeric, ["gender", "age_band"], models=models)
