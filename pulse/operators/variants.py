"""The reference's dataset variants wired to the learner tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cohort
from .assessments import assessment_snapshot
from .early import snapshot_day7
from .snapshot import V4, V5, V6, V7, V8, V9, V11, SnapshotSpec, build_panel, feature_columns
from .. import config as C
from ..sources.demo import LearnerTables


def registration_clock(t: LearnerTables, module: str = C.MODULE,
                       presentations: Sequence[str] = C.PRESENTATIONS, key="id_student"):
    """Cohort learners and their daily activity on the registration clock (days >= 0).

    ``key`` is the id (a learner's registrations share one log) or ``cohort.REGISTRATION_KEY``
    (each registration is a learner of its own with its own presentation's log)."""
    learners = cohort.learners_registered(t, module, presentations, key)
    reg = cohort.registration_lookup(t, module, presentations, key)
    daily = cohort.rebase_daily(cohort.collapse_daily(cohort.module_vle(t, module, presentations), key=key), reg, key=key)
    return learners, daily


def snapshot_v4(t: LearnerTables, module: str = C.MODULE, presentations: Sequence[str] = C.PRESENTATIONS,
                cutoffs: Sequence[int] = C.CUTOFFS_COURSE, spec: SnapshotSpec = V4,
                with_assessments: bool = True) -> DataFrame:
    """Course clock, no lower day bound, withdrew label, plus assessment block."""
    learners = cohort.learners_prestart(t, module, presentations)
    daily = cohort.collapse_daily(cohort.module_vle(t, module, presentations))
    panel = build_panel(spec.with_cutoffs(cutoffs), learners, daily)
    if not with_assessments:
        return panel
    subs = cohort.scoped_submissions(t, module, presentations).join(
        learners.select("id_student"), "id_student", "left_semi")
    return assessment_snapshot(panel, subs)


def snapshot_registration(spec: SnapshotSpec, t: LearnerTables, module: str = C.MODULE,
                          presentations: Sequence[str] = C.PRESENTATIONS,
                          cutoffs: Sequence[int] | None = None, strategy: str = "auto", key="id_student") -> DataFrame:
    """Registration clock panels differing only in their spec."""
    learners, daily = registration_clock(t, module, presentations, key)
    s = spec if cutoffs is None else spec.with_cutoffs(cutoffs)
    return build_panel(s, learners, daily, key=key, strategy=strategy)


def snapshot_v9(t: LearnerTables, module: str = C.MODULE, presentations: Sequence[str] = C.PRESENTATIONS,
                cutoffs: Sequence[int] = C.CUTOFFS_UNREG, key="id_student") -> DataFrame:
    """Unregister label. Learners are the registration rows (NULL unregister -> 999,
    NULL registration day -> 0); the click log is not restricted to the module (Q8). The log is
    joined per registration row: two rows of one day add the clicks up, its days count once."""
    keys = [key] if isinstance(key, str) else list(key)
    reg = cohort.registration_rows(t, module, presentations, key).select(
        *keys, F.coalesce(F.col("date_registration"), F.lit(0)).alias("date_registration"),
        "date_unregistration").distinct()
    daily = cohort.rebase_daily(cohort.collapse_daily(t.student_vle, key=key), reg, key=key)
    return build_panel(V9.with_cutoffs(cutoffs), reg, daily, key=key)


def snapshot_v10(t: LearnerTables, module: str = C.MODULE,
                 presentations: Sequence[str] = C.PRESENTATIONS, key="id_student") -> DataFrame:
    learners, daily = registration_clock(t, module, presentations, key)
    return snapshot_day7(learners, daily, key)


def snapshot_v5(t, module=C.MODULE, presentations=C.PRESENTATIONS, cutoffs=None, key="id_student"):
    return snapshot_registration(V5, t, module, presentations, cutoffs, key=key)


def snapshot_v6(t, module=C.MODULE, presentations=C.PRESENTATIONS, cutoffs=None, key="id_student"):
    return snapshot_registration(V6, t, module, presentations, cutoffs, key=key)


def snapshot_v7(t, module=C.MODULE, presentations=C.PRESENTATIONS, cutoffs=None, key="id_student"):
    return snapshot_registration(V7, t, module, presentations, cutoffs, key=key)


def snapshot_v8(t, module=C.MODULE, presentations=C.PRESENTATIONS, cutoffs=None, strategy="auto", key="id_student"):
    return snapshot_registration(V8, t, module, presentations, cutoffs, strategy, key)


def snapshot_v11(histories: DataFrame, window_days: int = C.WINDOW_DAYS,
                 half_window: int = C.HALF_WINDOW) -> DataFrame:
    """One feature row per request row, from the row's own nested history.

    histories: (student_id, days_since_registration, vle_activities array<struct<date,sum_click>>)

    Computed with higher-order array functions inside the row, so the operator is a pure
    projection: no explode, no shuffle, and every row is independent of the others. Empty
    histories get the worst-case fill (days-since-last = cutoff, streak = window_days).
    Equal to ``build_panel(V11, ...)`` on the exploded rows (tested).
    """
    c = F.col("days_since_registration")
    W, H = window_days, half_window
    ws = F.greatest(c - (W - 1), F.lit(0))
    fe = F.least(c, ws + (H - 1))
    ss = F.least(c, fe + 1)
    arr = F.coalesce(F.col("vle_activities"), F.array().cast(
        "array<struct<date:int,sum_click:int>>"))
    cum = F.filter(arr, lambda x: x["date"] <= c)
    win = F.filter(cum, lambda x: x["date"] >= ws)

    def clicks(a):
        return F.aggregate(a, F.lit(0).cast("bigint"),
                           lambda acc, x: acc + F.coalesce(x["sum_click"], F.lit(0)).cast("bigint"))

    def ndays(a):
        return F.size(F.array_distinct(F.transform(a, lambda x: x["date"])))

    spec = replace(V11, window_days=W, half_window=H, window_denominator=W)
    rows = histories.select("student_id", c.alias("cutoff"), *[v.alias(k) for k, v in {
        "_total": clicks(cum), "_days": ndays(cum), "_last": F.array_max(F.transform(cum, lambda x: x["date"])),
        "_c14": clicks(win), "_d14": ndays(win), "_last14": F.array_max(F.transform(win, lambda x: x["date"])),
        "_h1": clicks(F.filter(win, lambda x: x["date"] <= fe)), "_h2": clicks(F.filter(win, lambda x: x["date"] >= ss)),
        "_last7": clicks(F.filter(cum, lambda x: x["date"] > c - spec.recent_days))}.items()])
    return rows.select("student_id", F.col("cutoff").cast("bigint").alias("cutoff"), *feature_columns(spec, F.col("cutoff")))


def snapshot_v11_panel(histories: DataFrame) -> DataFrame:
    """P11 through the generic panel (explode + collapse + join); reference for tests."""
    learners = histories.select("student_id", F.col("days_since_registration").alias("cutoff"))
    acts = (histories.select("student_id", F.explode("vle_activities").alias("a"))
            .select("student_id", F.col("a.date").alias("day"), F.col("a.sum_click").alias("clicks"))
            .groupBy("student_id", "day").agg(F.sum("clicks").alias("clicks")))
    return build_panel(V11, learners, acts, key="student_id")
