"""Cohort selection and clock re-basing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.demo import LearnerTables


def scope(df: DataFrame, module: str, presentations: Sequence[str] | str) -> DataFrame:
    """module = m AND presentation IN (...) (F1/F2); filters reach the parquet scan."""
    pres = [presentations] if isinstance(presentations, str) else list(presentations)
    cond = F.col("code_module") == module
    cond = cond & (F.col("code_presentation") == pres[0] if len(pres) == 1
                   else F.col("code_presentation").isin(pres))
    return df.where(cond)


def withdrawn_label(final_result: Column | None = None) -> Column:
    """1 when the final result is 'Withdrawn', else 0 (NULL -> 0)."""
    final_result = F.col("final_result") if final_result is None else final_result
    return F.when(final_result == "Withdrawn", F.lit(1)).otherwise(F.lit(0))


def registration_features(reg: DataFrame) -> DataFrame:
    """reg_day and registered_before_start (NULL day -> 0, like NaN < 0 in pandas)."""
    return reg.select(
        "id_student",
        F.col("date_registration").alias("reg_day"),
        F.when(F.col("date_registration") < 0, F.lit(1)).otherwise(F.lit(0)).alias("registered_before_start"),
    )


def learners_prestart(t: LearnerTables, module: str, presentations: Sequence[str], key="id_student") -> DataFrame:
    """Course-clock cohort: registered on or before day 0, label = withdrew.

    A learner appears once per (id, module, presentation) row of student_info.
    """
    keys = [key] if isinstance(key, str) else list(key)
    valid = scope(t.student_registration, module, presentations).where(F.col("date_registration") <= 0)
    info = scope(t.student_info, module, presentations)
    return (info.join(valid.select(*keys).distinct(), keys, "left_semi")
            .select(*keys, "final_result", withdrawn_label().alias("dropout")))


REGISTRATION_KEY = ("id_student", "code_module", "code_presentation")


def registration_lookup(t: LearnerTables, module: str, presentations: Sequence[str], key="id_student") -> DataFrame:
    """Distinct (key, registration day) rows of the scope: the clock(s) of each learner."""
    keys = [key] if isinstance(key, str) else list(key)
    return scope(t.student_registration, module, presentations).select(*keys, "date_registration").distinct()


def registration_rows(t: LearnerTables, module: str, presentations: Sequence[str], key="id_student") -> DataFrame:
    """Distinct (key, registration day, unregister day) rows of the scope."""
    keys = [key] if isinstance(key, str) else list(key)
    return (scope(t.student_registration, module, presentations)
            .select(*keys, "date_registration", "date_unregistration").distinct())


def learners_registered(t: LearnerTables, module: str, presentations: Sequence[str], key="id_student") -> DataFrame:
    """Registration-clock cohort: distinct (key, dropout) of the scope's student_info rows whose
    key has a registration row."""
    keys = [key] if isinstance(key, str) else list(key)
    reg = registration_lookup(t, module, presentations, keys)
    info = scope(t.student_info, module, presentations)
    return (info.join(reg.select(*keys), keys, "left_semi")
            .select(*keys, withdrawn_label().alias("dropout")).distinct())


def collapse_daily(vle: DataFrame, day_col: str = "date", clicks_col: str = "sum_click",
                   key="id_student") -> DataFrame:
    """One row per (learner, day) with the day's clicks.

    Partial aggregation happens map-side, so a learner holding a large share of the log
    is reduced to at most one row per day before anything is shuffled; afterwards a
    distinct-day count is a plain ``count``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return (vle.groupBy(*keys, F.col(day_col).alias("day"))
            .agg(F.coalesce(F.sum(clicks_col), F.lit(0)).cast("bigint").alias("clicks")))


def rebase_daily(daily: DataFrame, reg_lookup: DataFrame, min_day: int | None = 0,
                 key="id_student") -> DataFrame:
    """J2 + F12 + F6: shift course days onto each learner's registration clock.

    Inner join on the learner key. Two registration days shift the log twice; what falls on
    the same day again is one row (clicks add up, the day counts once), so the result has one
    row per (key, day). The regrouping reuses the join's partitioning. NULL days drop out.
    """
    keys = [key] if isinstance(key, str) else list(key)
    reg = reg_lookup.select(*keys, "date_registration").where(F.col("date_registration").isNotNull())
    out = (daily.join(reg, keys, "inner")
           .select(*keys, (F.col("day") - F.col("date_registration")).alias("day"), "clicks"))
    if min_day is not None:
        out = out.where(F.col("day") >= min_day)
    return out.groupBy(*keys, "day").agg(F.sum("clicks").alias("clicks"))


def module_vle(t: LearnerTables, module: str, presentations: Sequence[str]) -> DataFrame:
    return scope(t.student_vle, module, presentations)


def scoped_submissions(t: LearnerTables, module: str, presentations: Sequence[str]) -> DataFrame:
    """Submissions whose assessment belongs to the module and presentations."""
    dim = scope(t.assessments, module, presentations).select("id_assessment").distinct()
    return t.student_assessment.join(dim, "id_assessment", "left_semi")


def null_profile(df: DataFrame) -> DataFrame:
    """one pass counting NULLs per column, returned long (column_name, null_count)."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    stack = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return counts.selectExpr(f"stack({len(df.columns)}, {stack}) as (column_name, null_count)")
