"""Single-window learner snapshots on the course clock (P1-P3, A3, A4, J5) and the
day-7 registration-clock snapshot (P10).

One conditional aggregate over the learner's daily activity inside [start, end] gives
totals, bands, last day and streak; assessment statistics come from
``assessments.score_stats``; registration features from ``cohort``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cohort
from .assessments import score_stats
from .snapshot import SnapshotSpec, build_panel
from ..sources.demo import LearnerTables


@dataclass(frozen=True)
class EarlySpec:
    name: str
    start: int
    end: int
    per_day: int                      # denominator of avg_clicks_per_day
    bands: tuple                      # ((lo, hi, column), ...)
    recency: bool = True              # days_since_last_login + inactivity_streak, trend/ratio
    pass_rate: bool = True
    numeric_extra: tuple = ()         # student_info counters carried as features
    categorical: tuple = ("gender", "age_band")
    fill_min_std: bool = False        # min_score / score_std filled for learners without submissions


V1 = EarlySpec("v1", 0, 100, 100, ((0, 7, "clicks_0_7"), (8, 14, "clicks_8_14"),
                                   (15, 28, "clicks_15_28"), (29, 100, "clicks_29_100")),
               recency=False, pass_rate=False,
               numeric_extra=("num_of_prev_attempts", "studied_credits"),
               categorical=("gender", "region", "age_band", "highest_education", "imd_band", "disability"),
               fill_min_std=True)
V2 = EarlySpec("v2", 0, 14, 14, ((0, 7, "clicks_0_7"), (8, 14, "clicks_8_14")))


def v3_spec(current_day: int = 28, window: int = 14) -> EarlySpec:
    """Trailing window ending at ``current_day``; halves of window//2 days (clamped)."""
    ws = max(0, current_day - window + 1)
    fe = min(current_day, ws + window // 2 - 1)
    ss = min(current_day, fe + 1)
    return EarlySpec(f"v3_{current_day}", ws, current_day, window,
                     ((ws, fe, "clicks_0_7"), (ss, current_day, "clicks_8_14")))


V3 = v3_spec()


def activity_block(spec: EarlySpec, daily: DataFrame, key: str = "id_student") -> DataFrame:
    """A1/A3/A4/A7 + X11 over [start, end] for learners with at least one active day there."""
    d, n = F.col("day"), F.col("clicks")
    inside = daily.where((d >= spec.start) & (d <= spec.end))
    aggs = [F.sum(n).alias("total_clicks"), F.count(d).alias("active_days"), F.max(d).alias("_last")]
    aggs += [F.coalesce(F.sum(F.when((d >= lo) & (d <= hi), n)), F.lit(0)).alias(name)
             for lo, hi, name in spec.bands]
    return inside.groupBy(key).agg(*aggs)


def early_snapshot(spec: EarlySpec, t: LearnerTables, module: str, presentation: str,
                   key: str = "id_student") -> DataFrame:
    students = cohort.scope(t.student_info, module, presentation)
    ids = students.select(key)
    reg = cohort.registration_features(
        cohort.scope(t.student_registration, module, presentation).join(ids, key, "left_semi"))
    vle = cohort.scope(t.student_vle, module, presentation).join(ids, key, "left_semi")
    act = activity_block(spec, cohort.collapse_daily(vle), key)
    subs = (t.student_assessment.join(ids, key, "left_semi")
            .where((F.col("date_submitted") >= spec.start) & (F.col("date_submitted") <= spec.end)))
    ass = score_stats(subs, key, pass_rate=spec.pass_rate)
    data = (students.select(key, cohort.withdrawn_label().alias("dropout"),
                            *spec.numeric_extra, *spec.categorical)
            .join(reg, key, "left").join(act, key, "left").join(ass, key, "left"))

    def z(col):
        return F.coalesce(col.cast("double"), F.lit(0.0))

    total = F.col("total_clicks").cast("double")
    days = F.col("active_days").cast("double")
    band_names = [b[2] for b in spec.bands]
    cols = {
        "reg_day": z(F.col("reg_day")),
        "registered_before_start": z(F.col("registered_before_start")),
    }
    for c in spec.numeric_extra:
        cols[c] = z(F.col(c))
    cols["total_clicks"] = z(total)
    cols["active_days"] = z(days)
    cols["avg_clicks_per_day"] = z(total / spec.per_day)
    cols["avg_clicks_per_active_day"] = z(F.when(days > 0, total / days))
    for b in band_names:
        cols[b] = z(F.col(b))
    if spec.recency:
        h1, h2 = F.col(band_names[0]).cast("double"), F.col(band_names[1]).cast("double")
        cols["trend_click"] = z(h2 - h1)
        cols["ratio_click"] = z((h2 + 1) / (h1 + 1))  # no history -> 0, not 1
        cols["days_since_last_login"] = z(F.lit(spec.end) - F.col("_last"))
        cols["inactivity_streak"] = z(F.lit(spec.end) - F.col("_last"))
    cols["num_assessments"] = z(F.col("num_assessments"))
    cols["avg_score"] = z(F.col("avg_score"))
    cols["max_score"] = z(F.col("max_score"))
    # Learners with submissions: NaN -> 0; learners without: left as NULL.
    has_subs = F.col("num_assessments").isNotNull() | F.lit(spec.fill_min_std)
    cols["min_score"] = F.when(has_subs, z(F.col("min_score")))
    cols["score_std"] = F.when(has_subs, z(F.col("score_std")))
    cols["last_score"] = z(F.col("last_score"))
    if spec.pass_rate:
        cols["pass_rate"] = z(F.col("pass_rate"))
    return data.select(
        F.col(key), F.col("dropout").cast("bigint").alias("dropout"),
        *[v.cast("double").alias(k) for k, v in cols.items()],
        *[F.col(c) for c in spec.categorical])


# P10: day-7 snapshot on the registration clock, window [0, 7] of 8 days, halves 0-3 / 4-7.
V10 = SnapshotSpec("v10", (7,), window_days=8, half_window=4, recent_days=3, denominator=8,
                   window_denominator=8, label="withdrawn", label_name="dropout")

V10_FEATURES = ("days_elapsed_since_reg", "clicks_per_day_total", "active_ratio_total",
                "avg_clicks_per_active_day_total", "days_since_last_active", "clicks_last_3_days",
                "clicks_0_3", "clicks_4_7", "trend_click_7", "ratio_click_7", "inactivity_streak_7")


def snapshot_day7(learners: DataFrame, daily: DataFrame, key: str = "id_student") -> DataFrame:
    """P10 from the generic panel; the elapsed-day column is 8 (days 0..7) and stays NULL
    for learners without activity, as the reference only sets it on aggregated rows."""
    keys = [key] if isinstance(key, str) else list(key)
    p = build_panel(V10, learners, daily.where(F.col("day") <= 7), key)
    has = F.col("active_ratio_total") > 0
    return p.select(
        *keys, "dropout",
        F.when(has, F.lit(8.0)).alias("days_elapsed_since_reg"),
        "clicks_per_day_total", "active_ratio_total", "avg_clicks_per_active_day_total",
        "days_since_last_active",
        F.col("clicks_last_7_days").alias("clicks_last_3_days"),
        F.col("clicks_0_7").alias("clicks_0_3"), F.col("clicks_8_14").alias("clicks_4_7"),
        F.col("trend_click_14").alias("trend_click_7"), F.col("ratio_click_14").alias("ratio_click_7"),
        F.col("inactivity_streak_14").alias("inactivity_streak_7"))


def band_pivot(daily: DataFrame, bands: Sequence[tuple], key: str = "id_student") -> DataFrame:
    """A4 as a pivot: band label per day, then groupBy(key).pivot(band) over known labels."""
    label = None
    for lo, hi, name in bands:
        cond = (F.col("day") >= lo) & (F.col("day") <= hi)
        label = F.when(cond, F.lit(name)) if label is None else label.when(cond, F.lit(name))
    names = [b[2] for b in bands]
    return (daily.withColumn("_band", label).where(F.col("_band").isNotNull())
            .groupBy(key).pivot("_band", names).agg(F.sum("clicks")))
