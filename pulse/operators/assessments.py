"""Assessment aggregates (A9-A14, W1): per learner, or per (learner, cutoff).

Distinct-assessment counts are computed in two levels, (learner, cutoff, assessment) then
(learner, cutoff), so no DISTINCT expansion is planned; both levels group on keys that
start with the learner id and reuse its partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C


def _last_key() -> Column:
    """Ordering of submissions for 'last score': date, then assessment, then submission id."""
    return F.struct(F.col("date_submitted"), F.col("id_assessment"), F.col("id_submission"))


def last_score_agg(score: Column | None = None) -> Column:
    """A10: score of the latest submission that has a score (NULL scores are skipped)."""
    score = F.col("score") if score is None else score
    return F.max(F.when(score.isNotNull(), F.struct(_last_key().alias("k"), score.alias("s")))).getField("s")


def score_stats(subs: DataFrame, key: str = "id_student", pass_rate: bool = True) -> DataFrame:
    """A9-A12 per learner: distinct assessments, mean/max/min/sample-std score, last score,
    pass rate (NULL scores count as not passed, as NaN >= 40 is False).

    The per-learner distinct count is pre-collapsed on (learner, assessment).
    """
    lvl1 = subs.groupBy(key, "id_assessment").agg(
        F.sum("score").alias("_s"), F.count("score").alias("_n"),
        F.sum(F.col("score") * F.col("score")).alias("_ss"),
        F.max("score").alias("_mx"), F.min("score").alias("_mn"),
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(F.col("score") >= C.PASS_MARK).alias("_pass"),
        F.max(F.when(F.col("score").isNotNull(),
                     F.struct(_last_key().alias("k"), F.col("score").alias("s")))).alias("_last"),
    )
    n = F.sum("_n")
    mean = F.sum("_s") / n
    # sample variance from per-assessment partial sums (Q10: one score -> NULL -> 0 later)
    var = (F.sum("_ss") - F.sum("_s") * F.sum("_s") / n) / (n - 1)
    aggs = [
        F.count(F.lit(1)).cast("double").alias("num_assessments"),
        mean.alias("avg_score"),
        F.max("_mx").alias("max_score"),
        F.min("_mn").alias("min_score"),
        F.when(n > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).alias("score_std"),
        F.max("_last").getField("s").alias("last_score"),
    ]
    if pass_rate:
        aggs.append((F.sum("_pass") / F.sum("_rows")).alias("pass_rate"))
    return lvl1.groupBy(key).agg(*aggs)


def last_score_window(subs: DataFrame, key: str = "id_student") -> DataFrame:
    """The same last score through row_number() over the learner's submissions."""
    w = Window.partitionBy(key).orderBy(F.col("date_submitted").desc_nulls_last(),
                                        F.col("id_assessment").desc(), F.col("id_submission").desc())
    scored = subs.where(F.col("score").isNotNull())
    return (scored.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
            .select(key, F.col("score").alias("last_score")))


def assessment_snapshot(panel: DataFrame, subs: DataFrame, window_days: int = C.WINDOW_DAYS,
                        key: str = "id_student") -> DataFrame:
    """A14 + A13 at (learner, cutoff): submissions with a date on or before the cutoff.

    panel  (key, cutoff) rows; subs (key, id_assessment, date_submitted, score, id_submission).
    Returns num_assessments, avg_score, pass_count, last_score, num_assessments_14,
    avg_score_14 with the reference's fill of 0.
    """
    c = F.col("cutoff")
    ws = F.greatest(c - (window_days - 1), F.lit(0))
    # Collapse to (learner, assessment, day) first: a learner with a huge share of the
    # submissions becomes at most assessments x days rows before the cutoff join.
    s = (subs.where(F.col("date_submitted").isNotNull())
         .groupBy(F.col(key).alias("_k"), "id_assessment", "date_submitted")
         .agg(F.sum("score").alias("_s0"), F.count("score").alias("_n0"),
              F.count_if(F.col("score") >= C.PASS_MARK).alias("_p0"),
              F.max(F.when(F.col("score").isNotNull(),
                           F.struct(_last_key().alias("k"), F.col("score").alias("s")))).alias("_l0")))
    # LEFT join from the panel and two aggregates on keys that start with the learner id: both
    # reuse the join's learner partitioning, so no (id, cutoff) re-shuffle and no second join.
    # Panel rows travel as one list per (learner, cutoff), so several rows of a learner stay several.
    others = [x for x in panel.columns if x not in (key, "cutoff")]
    panel = panel.groupBy(key, "cutoff").agg(F.collect_list(F.struct(*others)).alias("_rows"))
    carry = ["_rows"]
    j = panel.join(s, (F.col(key) == F.col("_k")) & (F.col("date_submitted") <= c), "left")
    win = F.col("date_submitted") >= ws
    lvl1 = j.groupBy(key, "cutoff", "id_assessment").agg(
        *[F.max(x).alias(x) for x in carry],
        F.sum("_s0").alias("_s"), F.sum("_n0").alias("_n"), F.sum("_p0").alias("_pass"),
        F.max("_l0").alias("_last"),
        F.count(F.when(win, F.lit(1))).alias("_w"),
        F.sum(F.when(win, F.col("_s0"))).alias("_s14"),
        F.sum(F.when(win, F.col("_n0"))).alias("_n14"),
    )
    lvl2 = lvl1.groupBy(key, "cutoff").agg(
        *[F.max(x).alias(x) for x in carry],
        F.count("id_assessment").alias("num_assessments"),
        (F.sum("_s") / F.sum("_n")).alias("avg_score"),
        F.sum("_pass").alias("pass_count"),
        F.max("_last").getField("s").alias("last_score"),
        F.count(F.when(F.col("_w") > 0, F.lit(1))).alias("num_assessments_14"),
        (F.sum("_s14") / F.sum("_n14")).alias("avg_score_14"),
    )
    cols = ["num_assessments", "avg_score", "pass_count", "last_score", "num_assessments_14", "avg_score_14"]
    lvl2 = lvl2.withColumn("_row", F.explode("_rows"))
    return lvl2.select(key, "cutoff", *[F.col("_row")[x].alias(x) for x in others],
                       *[F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias(x) for x in cols])
