"""Feature importance (M16): model-native importances and permutation importance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from .folds import exact_rank, hash_key
from .metrics import confusion
from .models import FittedModel


def native_importance(spark: SparkSession, fm: FittedModel) -> DataFrame:
    """Tree importances or |coefficients|, named by the kept feature columns (Q19)."""
    m = fm.model
    if hasattr(m, "featureImportances"):
        vals = m.featureImportances.toArray().tolist()
    elif hasattr(m, "coefficients"):
        vals = [abs(v) for v in m.coefficients.toArray().tolist()]
    else:
        vals = [None] * len(fm.kept)  # no importance of its own
    rows = [(fm.name, f, None if v is None else float(v)) for f, v in zip(fm.kept, vals)]
    return spark.createDataFrame(rows, "model string, feature string, importance double")


def permutation_importance(fm: FittedModel, df: DataFrame, label: str, id_cols: Sequence[str],
                           repeats: int = 8, threshold: float = 0.5, seed: int = C.SEED) -> DataFrame:
    """F1 drop when one feature's column is permuted, averaged over repeats.

    Permutation r maps the row at id-order position i to the row at position i in the
    order of hash(ids, seed + r); both positions are exact distributed ranks, and the
    permuted values arrive through one equi-join on (repeat, position): what is shuffled is
    rows x repeats. The copies per feature are made after the join and never shuffled.
    """
    feats = list(fm.kept)
    ids = list(id_cols)
    base = exact_rank(df, [], hash_key(ids, seed), ids).withColumnRenamed("_rank", "_pos")
    reps = df.select(*ids, *feats).withColumn("_repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    order = hash_key([*ids, "_repeat"], seed + 1000)
    src = exact_rank(reps, ["_repeat"], order, ids).select(
        "_repeat", F.col("_rank").alias("_pos"),
        F.array(*[F.col(f).cast("double") for f in feats]).alias("_vals"))
    pairs = F.array(*[F.struct(F.lit(i + 1).alias("fi"), F.lit(f).alias("fn")) for i, f in enumerate(feats)])
    ex = base.withColumn("_repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    j = ex.join(src, ["_repeat", "_pos"]).withColumn("_f", F.explode(pairs))
    perm = F.element_at(F.col("_vals"), F.col("_f.fi"))
    j = j.select(*[c for c in df.columns if c not in feats],
                 *[F.when(F.col("_f.fn") == f, perm).otherwise(F.col(f).cast("double")).alias(f) for f in feats],
                 F.col("_f.fn").alias("_feature"), "_repeat")
    scored = fm.transform(j, keep=[*ids, label, "_feature", "_repeat"])
    f1s = confusion(scored, ["_feature", "_repeat"], "proba", label, threshold)
    ref = confusion(fm.transform(df, keep=[*ids, label]).withColumn("_k", F.lit(1)), ["_k"], "proba",
                    label, threshold)
    ref_f1 = ref.collect()[0]["f1"]
    return (f1s.groupBy("_feature").agg(F.avg("f1").alias("_f1"))
            .select(F.lit(fm.name).alias("model"), F.col("_feature").alias("feature"),
                    (F.lit(ref_f1) - F.col("_f1")).alias("importance")))
