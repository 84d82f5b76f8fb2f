"""Daily scoring jobs (R13-R15, S11, W3, W4): snapshot at one cutoff, score, tier, rank, write.

The batch replaces per-learner HTTP scoring: one DataFrame job computes every learner's
features for the day, scores them with column expressions (and a fitted pipeline when
given), and writes a ``score_date`` partition with dynamic partition overwrite, so a
re-run of the same day replaces exactly that partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import rules
from ..functions.clean import clean_features
from ..operators import variants
from ..operators.snapshot import FEATURES_15
from ..sources.demo import learner_tables


def rule_scored(panel: DataFrame, score: str = "b") -> DataFrame:
    """Clean the 15 features as in training (V8: non-negative) and add rule score + tier."""
    keep = [c for c in panel.columns if c not in FEATURES_15]
    x = clean_features(panel, FEATURES_15, "all_nonneg", keep=keep)
    s = rules.decline_score_b() if score == "b" else rules.decline_score_a()
    return x.withColumn("decline_score", s).withColumn(
        "risk_level", rules.tier(F.col("decline_score"), *C.TIERS_BATCH))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registration-clock panel (V8 spec) -> cleaned features -> decline score B -> tier."""
    t = learner_tables(spark, sf_dir)
    panel = variants.snapshot_v8(t)
    return rule_scored(panel).select("id_student", "cutoff", "y_short", "decline_score", "risk_level")


def daily_rule_scores(spark: SparkSession, sf_dir: str, cutoff_day: int = 14) -> DataFrame:
    """R14 with the rule score: one cutoff, every learner, ranked by score (ties by id)."""
    t = learner_tables(spark, sf_dir)
    panel = variants.snapshot_v8(t, cutoffs=(cutoff_day,))
    scored = rule_scored(panel, "a")
    return scored.select("id_student", "cutoff", "decline_score", "risk_level")


def ranked(df: DataFrame, score: str, key: str = "id_student") -> DataFrame:
    """Global rank by score desc, then key. Ranking is a range-partitioned sort, not a
    single-partition window."""
    return df.orderBy(F.col(score).desc(), F.col(key).asc())


def top_k(df: DataFrame, score: str, k: int, key: str = "id_student") -> DataFrame:
    """K highest scores (TakeOrderedAndProject: per-partition top-k, then merge)."""
    return df.orderBy(F.col(score).desc(), F.col(key).asc()).limit(k)


def top_k_per_group(df: DataFrame, group: str, score: str, k: int, key: str = "id_student") -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(key).asc())
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def alerts(scored: DataFrame, score: str, threshold: float) -> DataFrame:
    """Rows at or above the threshold."""
    return scored.where(F.col(score) >= threshold)


def write_scores(df: DataFrame, path: str, score_date: str) -> None:
    """Partitioned parquet by score_date; only the day's partition is replaced."""
    (df.withColumn("score_date", F.lit(score_date).cast("date"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("score_date").parquet(path))


def write_feature_cache(features: DataFrame, path: str, calculated_at: str) -> None:
    """Computed feature rows with the time they were calculated, by day of calculation; a
    re-run of a day replaces it."""
    at = F.lit(calculated_at).cast("timestamp_ntz")
    (features.withColumn("calculated_at", at).withColumn("calculated_on", at.cast("date"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("calculated_on").parquet(path))


def read_feature_cache(schema: str, spark: SparkSession, path: str, key: str, not_before: str) -> DataFrame:
    """The latest cached row per key that is not older than ``not_before``."""
    rows = (spark.read.schema(schema).parquet(path)
            .where((F.col("calculated_on") >= F.lit(not_before).cast("date")) & (F.col("calculated_at") >= F.lit(not_before).cast("timestamp_ntz"))))
    others = [c for c in rows.columns if c not in (key, "calculated_on")]
    return (rows.groupBy(key).agg(F.max_by(F.struct(*others), "calculated_at").alias("_r"))
            .select(key, "_r.*"))


def write_alerts(scored: DataFrame, path: str, score_date: str, score: str = "risk_score",
                 threshold: float | None = None, level: str = "HIGH") -> None:
    """R15 sink: the day's alert rows (by threshold on ``score``, or by tier) in their own
    score_date partition, replaced on re-run like the scores."""
    rows = alerts(scored, score, threshold) if threshold is not None else scored.where(F.col("risk_level") == level)
    write_scores(rows, path, score_date)
