"""The query catalogue: every operator of the survey inventory that has a table-level form.

Each entry reads the driver tables through the demo mapping (``sources.demo``), so its work
grows with ``events``/``customer``; the SQL next to it is the DuckDB oracle.

Sections, in order: scans and sources; filters and cohort; point-in-time panels (V1-V11) and
labels; panel-grain joins and aggregates; course-clock blocks; assessment statistics;
cleaning, rule scores and tiers; evaluation on the deterministic score (metrics, curves,
threshold searches); sources, validation and sinks; learning (folds, preprocessing, SMOTE,
models, calibration, importance, bundle scoring); streaming upkeep; hold-out evaluation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from .. import oracle as O
from ..functions import rules
from ..functions.clean import clean_features, safe_div
from ..ml import calibrate as CAL
from ..ml import folds as FO
from ..ml import importance as IMP
from ..ml import metrics as M
from ..ml import prep as PREP
from ..ml import thresholds as TH
from ..ml.models import fit_model, fit_prepared, kept_columns, prepare
from ..ml.smote import smote as _smote
from ..operators import assessments as A
from ..operators import cohort, early, variants
from ..operators.snapshot import FEATURES_15, V5, cutoff_panel, window_bounds
from ..registry import register
from ..session import scratch_path
from ..sources import history as H
from ..sources import validate as VAL
from ..sources.versions import Bundles
from ..sources.demo import learner_tables
from ..sources.history import learner_histories
from ..streaming.daily_rollup import read_daily_rollup, run_daily_rollup
from . import daily as D
from . import train as TR
from .holdout import holdout_v2

W = O.with_demo
MOD, PRES, PRES1 = C.MODULE, C.PRESENTATIONS, C.PRESENTATION


def T(spark, sf):
    return learner_tables(spark, sf)


def R6(df, *cols):
    """Round to six places for the comparison; the operators return unrounded values."""
    return df.withColumns({c: F.round(c, 6) for c in cols})


# ---------------------------------------------------------------- scans / sources

register("scan_tables", W() + """
SELECT 'student_info' AS table_name, CAST(count(*) AS BIGINT) AS row_count FROM student_info
UNION ALL SELECT 'student_registration', count(*) FROM student_registration
UNION ALL SELECT 'student_vle', count(*) FROM student_vle
UNION ALL SELECT 'student_assessment', count(*) FROM student_assessment
UNION ALL SELECT 'assessments', count(*) FROM assessments""")(
    lambda spark, sf: _scan_counts(T(spark, sf)))


def _scan_counts(t):
    parts = [getattr(t, n).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
             for n in ("student_info", "student_registration", "student_vle", "student_assessment", "assessments")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


register("scan_pruned", W() + """
SELECT id_student, CAST(date AS BIGINT) AS date, CAST(sum_click AS BIGINT) AS sum_click FROM student_vle""")(
    lambda spark, sf: T(spark, sf).student_vle.select(
        "id_student", F.col("date").cast("bigint"), F.col("sum_click").cast("bigint")))

# ---------------------------------------------------------------- filters / cohort

register("cohort_single", W() + f"""
SELECT id_student, final_result FROM student_info
WHERE code_module = '{MOD}' AND code_presentation = '{PRES1}'""")(
    lambda spark, sf: cohort.scope(T(spark, sf).student_info, MOD, PRES1).select("id_student", "final_result"))

register("cohort_multi", W() + f"""
SELECT id_student, code_presentation FROM student_info
WHERE code_module = '{MOD}' AND code_presentation IN {O.PRES}""")(
    lambda spark, sf: cohort.scope(T(spark, sf).student_info, MOD, PRES).select("id_student", "code_presentation"))

register("cohort_prestart", W(O.COURSE_COHORT) + """
SELECT CAST(id_student AS BIGINT) AS id_student, CAST(dropout AS BIGINT) AS dropout FROM students""")(
    lambda spark, sf: cohort.learners_prestart(T(spark, sf), MOD, PRES).select(
        "id_student", F.col("dropout").cast("bigint")))

register("label_withdrawn", W(O.REG_CLOCK) + """
SELECT CAST(id_student AS BIGINT) AS id_student, CAST(dropout AS BIGINT) AS dropout FROM students""")(
    lambda spark, sf: cohort.learners_registered(T(spark, sf), MOD, PRES).select(
        "id_student", F.col("dropout").cast("bigint")))

register("day_range", W() + f"""
SELECT id_student, CAST(date AS BIGINT) AS date, CAST(sum_click AS BIGINT) AS sum_click FROM student_vle
WHERE code_module = '{MOD}' AND code_presentation = '{PRES1}' AND date >= 0 AND date <= 14""")(
    lambda spark, sf: cohort.scope(T(spark, sf).student_vle, MOD, PRES1)
    .where(F.col("date").between(0, 14))
    .select("id_student", F.col("date").cast("bigint"), F.col("sum_click").cast("bigint")))

register("notnull_filter", W() + """
SELECT id_submission, id_student, CAST(date_submitted AS BIGINT) AS date_submitted, score
FROM student_assessment WHERE date_submitted IS NOT NULL AND score IS NOT NULL""")(
    lambda spark, sf: T(spark, sf).student_assessment.dropna(subset=["date_submitted", "score"])
    .select("id_submission", "id_student", F.col("date_submitted").cast("bigint"), "score"))

register("rebased_clock", W(O.REG_CLOCK) + """
SELECT id_student, CAST(dsr AS BIGINT) AS days_since_reg, CAST(sum_click AS BIGINT) AS sum_click FROM vle_mod""")(
    lambda spark, sf: _rebased_rows(T(spark, sf)))


def _rebased_rows(t):
    reg = cohort.registration_lookup(t, MOD, PRES).where(F.col("date_registration").isNotNull())
    vle = cohort.module_vle(t, MOD, PRES)
    return (vle.join(reg.select("id_student", "date_registration"), "id_student")
            .select("id_student", (F.col("date") - F.col("date_registration")).cast("bigint").alias("days_since_reg"),
                    F.col("sum_click").cast("bigint"))
            .where(F.col("days_since_reg") >= 0))


register("distinct_registrations", W() + f"""
SELECT DISTINCT id_student, CAST(date_registration AS BIGINT) AS date_registration FROM student_registration
WHERE code_module = '{MOD}' AND code_presentation IN {O.PRES}""")(
    lambda spark, sf: cohort.scope(T(spark, sf).student_registration, MOD, PRES)
    .select("id_student", F.col("date_registration").cast("bigint")).distinct())

register("null_profile", W() + """
SELECT column_name, CAST(null_count AS BIGINT) AS null_count FROM (
  SELECT 'id_assessment' AS column_name, count(*) - count(id_assessment) AS null_count FROM student_assessment
  UNION ALL SELECT 'id_student', count(*) - count(id_student) FROM student_assessment
  UNION ALL SELECT 'date_submitted', count(*) - count(date_submitted) FROM student_assessment
  UNION ALL SELECT 'is_banked', count(*) - count(is_banked) FROM student_assessment
  UNION ALL SELECT 'score', count(*) - count(score) FROM student_assessment
  UNION ALL SELECT 'id_submission', count(*) - count(id_submission) FROM student_assessment)""")(
    lambda spark, sf: cohort.null_profile(T(spark, sf).student_assessment)
    .select("column_name", F.col("null_count").cast("bigint")))

register("coerce_numeric", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k_num,
       TRY_CAST(event_type AS DOUBLE) AS type_num
FROM events""")(
    lambda spark, sf: _coerce(spark, sf))


def _coerce(spark, sf):
    """Numeric coercion where unparsable text becomes NULL (a double, like a coercing
    numeric read), never an error."""
    from ..functions.clean import coerce_double
    from ..sources.tables import read_table
    ev = read_table(spark, sf, "events", ["event_id", "event_type", "props"])
    return ev.select("event_id", coerce_double(F.get_json_object("props", "$.k")).alias("k_num"),
                     coerce_double(F.col("event_type")).alias("type_num"))


register("registration_features", W() + f"""
SELECT id_student, CAST(date_registration AS BIGINT) AS reg_day,
       CAST(CASE WHEN date_registration < 0 THEN 1 ELSE 0 END AS BIGINT) AS registered_before_start
FROM student_registration WHERE code_module = '{MOD}' AND code_presentation = '{PRES1}'""")(
    lambda spark, sf: cohort.registration_features(cohort.scope(T(spark, sf).student_registration, MOD, PRES1))
    .select("id_student", F.col("reg_day").cast("bigint"), F.col("registered_before_start").cast("bigint")))

register("semi_join_cohort", W(O.COURSE_COHORT) + """
SELECT id_student, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(sum_click) AS BIGINT) AS clicks
FROM student_vle WHERE id_student IN (SELECT id_student FROM students) GROUP BY id_student""")(
    lambda spark, sf: _semi(T(spark, sf)))


def _semi(t):
    learners = cohort.learners_prestart(t, MOD, PRES).select("id_student")
    return (t.student_vle.join(learners, "id_student", "left_semi").groupBy("id_student")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("sum_click").cast("bigint").alias("clicks")))


register("scoped_submissions", W() + f"""
SELECT id_submission, id_student, id_assessment FROM student_assessment
WHERE id_assessment IN (SELECT id_assessment FROM assessments
                        WHERE code_module = '{MOD}' AND code_presentation IN {O.PRES})""")(
    lambda spark, sf: cohort.scoped_submissions(T(spark, sf), MOD, PRES)
    .select("id_submission", "id_student", "id_assessment"))

# ---------------------------------------------------------------- point-in-time panels


def _sql(parts):
    ctes, select = parts
    return W(ctes) + select


register("snapshot_v4", _sql(O.v4_panel()))(
    lambda spark, sf: variants.snapshot_v4(T(spark, sf), with_assessments=False))
register("snapshot_v5", _sql(O.reg_panel("silent", 7, eligible=True)))(
    lambda spark, sf: variants.snapshot_v5(T(spark, sf)))
register("snapshot_v6", _sql(O.reg_panel("silent", 14)))(lambda spark, sf: variants.snapshot_v6(T(spark, sf)))
register("snapshot_v7", _sql(O.reg_panel("silent", 7)))(lambda spark, sf: variants.snapshot_v7(T(spark, sf)))
register("snapshot_v8", _sql(O.v8_panel()))(lambda spark, sf: variants.snapshot_v8(T(spark, sf)))
register("snapshot_v8_short", _sql(O.v8_panel(C.CUTOFFS_SHORT)))(
    lambda spark, sf: variants.snapshot_v8(T(spark, sf), cutoffs=C.CUTOFFS_SHORT))
_DAILY_CUTS = tuple(range(0, 30))
register("snapshot_v8_daily", _sql(O.v8_panel(_DAILY_CUTS)))(
    lambda spark, sf: variants.snapshot_v8(T(spark, sf), cutoffs=_DAILY_CUTS, strategy="prefix"))
register("snapshot_v9", _sql(O.v9_panel()))(lambda spark, sf: variants.snapshot_v9(T(spark, sf)))

# The panels over tables in which every fifth learner has a second registration (another
# presentation, other registration and unregister days).


def TR2(spark, sf):
    return learner_tables(spark, sf, repeats=True)


def _sql2(parts):
    ctes, select = parts
    return O.with_demo(ctes, repeats=True) + select


register("repeat_snapshot_v4", _sql2(O.v4_panel()))(
    lambda spark, sf: variants.snapshot_v4(TR2(spark, sf), with_assessments=False))
register("repeat_snapshot_v5", _sql2(O.reg_panel("silent", 7, eligible=True)))(
    lambda spark, sf: variants.snapshot_v5(TR2(spark, sf)))
register("repeat_snapshot_v6", _sql2(O.reg_panel("silent", 14)))(lambda spark, sf: variants.snapshot_v6(TR2(spark, sf)))
register("repeat_snapshot_v7", _sql2(O.reg_panel("silent", 7)))(lambda spark, sf: variants.snapshot_v7(TR2(spark, sf)))
register("repeat_snapshot_v8", _sql2(O.v8_panel()))(lambda spark, sf: variants.snapshot_v8(TR2(spark, sf)))
register("snapshot_v8_prefix", _sql2(O.v8_panel()))(
    lambda spark, sf: variants.snapshot_v8(TR2(spark, sf), strategy="prefix"))
register("repeat_snapshot_v9", _sql2(O.v9_panel()))(lambda spark, sf: variants.snapshot_v9(TR2(spark, sf)))
register("snapshot_v8_composite_key", _sql2(O.v8_composite()))(
    lambda spark, sf: variants.snapshot_v8(TR2(spark, sf), key=cohort.REGISTRATION_KEY))

# early single-window snapshots (P1-P3) and the day-7 / per-row-cutoff panels


def _early_sql(spec, **kw):
    return O.early_sql(start=spec.start, end=spec.end, per_day=spec.per_day, bands=spec.bands,
                       recency=spec.recency, pass_rate=spec.pass_rate, extra=spec.numeric_extra,
                       cats=spec.categorical, fill_min_std=spec.fill_min_std, **kw)


register("snapshot_v1", _early_sql(early.V1))(lambda spark, sf: R6(early.early_snapshot(early.V1, T(spark, sf), MOD, PRES1), "score_std"))
register("snapshot_v2", _early_sql(early.V2))(lambda spark, sf: R6(early.early_snapshot(early.V2, T(spark, sf), MOD, PRES1), "score_std"))
register("snapshot_v3", _early_sql(early.V3))(
    lambda spark, sf: R6(early.early_snapshot(early.V3, T(spark, sf), MOD, PRES1), "score_std"))

_V10_SQL = """,
v7 AS (SELECT * FROM vle_mod WHERE dsr >= 0 AND dsr <= 7),
agg AS (SELECT id_student, sum(sum_click) AS total, count(DISTINCT dsr) AS days, max(dsr) AS last FROM v7 GROUP BY 1),
l3 AS (SELECT id_student, sum(sum_click) AS v FROM v7 WHERE dsr >= 5 GROUP BY 1),
a03 AS (SELECT id_student, sum(sum_click) AS v FROM v7 WHERE dsr <= 3 GROUP BY 1),
a47 AS (SELECT id_student, sum(sum_click) AS v FROM v7 WHERE dsr >= 4 GROUP BY 1)
SELECT CAST(s.id_student AS BIGINT) AS id_student, CAST(s.dropout AS BIGINT) AS dropout,
  CASE WHEN agg.id_student IS NULL THEN NULL ELSE 8.0::DOUBLE END AS days_elapsed_since_reg,
  CAST(coalesce(agg.total, 0) AS DOUBLE) / 8 AS clicks_per_day_total,
  CAST(coalesce(agg.days, 0) AS DOUBLE) / 8 AS active_ratio_total,
  CASE WHEN agg.days > 0 THEN CAST(agg.total AS DOUBLE) / agg.days ELSE 0.0 END AS avg_clicks_per_active_day_total,
  CAST(coalesce(7 - agg.last, 0) AS DOUBLE) AS days_since_last_active,
  CAST(coalesce(l3.v, 0) AS DOUBLE) AS clicks_last_3_days,
  CAST(coalesce(a03.v, 0) AS DOUBLE) AS clicks_0_3,
  CAST(coalesce(a47.v, 0) AS DOUBLE) AS clicks_4_7,
  CAST(coalesce(a47.v, 0) AS DOUBLE) - CAST(coalesce(a03.v, 0) AS DOUBLE) AS trend_click_7,
  (CAST(coalesce(a47.v, 0) AS DOUBLE) + 1) / (CAST(coalesce(a03.v, 0) AS DOUBLE) + 1) AS ratio_click_7,
  CAST(coalesce(7 - agg.last, 0) AS DOUBLE) AS inactivity_streak_7
FROM students s LEFT JOIN agg USING (id_student) LEFT JOIN l3 USING (id_student)
LEFT JOIN a03 USING (id_student) LEFT JOIN a47 USING (id_student)"""
register("snapshot_v10", W(O.REG_CLOCK) + _V10_SQL)(
    lambda spark, sf: variants.snapshot_v10(T(spark, sf)))
register("repeat_snapshot_v10", O.with_demo(O.REG_CLOCK, repeats=True) + _V10_SQL)(
    lambda spark, sf: variants.snapshot_v10(TR2(spark, sf)))

register("snapshot_v11", _sql(O.v11_panel()))(
    lambda spark, sf: variants.snapshot_v11(learner_histories(T(spark, sf))))

# labels at (learner, cutoff) grain

_V7 = O.reg_panel("silent", 7)
_V8 = O.v8_panel()
_V9 = O.v9_panel()


def _wrap(parts, select):
    """Wrap a panel query as CTE ``p`` and select from it."""
    ctes, inner = parts
    return W(ctes, f"p AS ({inner})") + "\n" + select


register("label_silent", _wrap(_V7, "SELECT id_student, cutoff, y_short FROM p"))(
    lambda spark, sf: variants.snapshot_v7(T(spark, sf)).select("id_student", "cutoff", "y_short"))
register("label_low_activity", _wrap(_V8, "SELECT id_student, cutoff, y_short FROM p"))(
    lambda spark, sf: variants.snapshot_v8(T(spark, sf)).select("id_student", "cutoff", "y_short"))
register("label_unregister", _wrap(_V9, "SELECT id_student, cutoff, target FROM p"))(
    lambda spark, sf: variants.snapshot_v9(T(spark, sf)).select("id_student", "cutoff", "target"))

# ---------------------------------------------------------------- joins / aggregates on the panel grain


CUTS = C.CUTOFFS_REG
_CUT_SQL = O.cutoffs_cte(CUTS)
_ARR = "[" + ", ".join(str(c) for c in CUTS) + "]"


def _reg(spark, sf):
    return variants.registration_clock(T(spark, sf), MOD, PRES)


def _daily_cut(daily, cond):
    """Attach every cutoff for which ``cond(day, cutoff)`` holds: a Generate over the literal
    cutoff array, filtered per row, so no join and no shuffle."""
    arr = F.array(*[F.lit(c) for c in CUTS])
    return daily.withColumn("cutoff", F.explode(F.filter(arr, lambda c: cond(F.col("day"), c))))


register("learner_cutoff_panel", W(O.REG_CLOCK, _CUT_SQL) + """
SELECT CAST(s.id_student AS BIGINT) AS id_student, CAST(c.cutoff AS BIGINT) AS cutoff FROM students s, cut c""")(
    lambda spark, sf: cutoff_panel(_reg(spark, sf)[0].select("id_student"), CUTS)
    .select("id_student", F.col("cutoff").cast("bigint")))

register("panel_bounds", W(O.REG_CLOCK, _CUT_SQL) + """
SELECT CAST(s.id_student AS BIGINT) AS id_student, CAST(c.cutoff AS BIGINT) AS cutoff,
       CAST(greatest(0, c.cutoff - 13) AS BIGINT) AS w_start,
       CAST(least(c.cutoff, greatest(0, c.cutoff - 13) + 6) AS BIGINT) AS first_end,
       CAST(least(c.cutoff, least(c.cutoff, greatest(0, c.cutoff - 13) + 6) + 1) AS BIGINT) AS second_start
FROM students s, cut c""")(lambda spark, sf: _bounds(spark, sf))


def _bounds(spark, sf):
    p = cutoff_panel(_reg(spark, sf)[0].select("id_student"), CUTS)
    ws, fe, ss = window_bounds(V5, F.col("cutoff"))
    return p.select("id_student", F.col("cutoff").cast("bigint"), ws.cast("bigint").alias("w_start"),
                    fe.cast("bigint").alias("first_end"), ss.cast("bigint").alias("second_start"))


register("events_as_of_cutoff", W(O.REG_CLOCK, _CUT_SQL) + """
SELECT v.id_student, CAST(c.cutoff AS BIGINT) AS cutoff, CAST(v.dsr AS BIGINT) AS day,
       CAST(sum(v.sum_click) AS BIGINT) AS clicks
FROM vle_mod v JOIN cut c ON v.dsr <= c.cutoff GROUP BY 1, 2, 3""")(
    lambda spark, sf: _daily_cut(_reg(spark, sf)[1], lambda d, c: d <= c)
    .select("id_student", F.col("cutoff").cast("bigint"), F.col("day").cast("bigint"), "clicks"))

register("future_activity", W(O.REG_CLOCK, _CUT_SQL) + """
SELECT v.id_student, CAST(c.cutoff AS BIGINT) AS cutoff, CAST(sum(v.sum_click) AS BIGINT) AS future_clicks,
       CAST(count(DISTINCT v.dsr) AS BIGINT) AS future_active_days
FROM vle_mod v JOIN cut c ON v.dsr > c.cutoff AND v.dsr <= c.cutoff + 14 GROUP BY 1, 2""")(
    lambda spark, sf: _daily_cut(_reg(spark, sf)[1], lambda d, c: (d > c) & (d <= c + 14))
    .groupBy("id_student", "cutoff").agg(F.sum("clicks").cast("bigint").alias("future_clicks"),
                                         F.count(F.lit(1)).alias("future_active_days"))
    .withColumn("cutoff", F.col("cutoff").cast("bigint")))

register("has_future", W(O.REG_CLOCK, _CUT_SQL) + """
SELECT DISTINCT v.id_student, CAST(c.cutoff AS BIGINT) AS cutoff, CAST(1 AS BIGINT) AS has_activity_next
FROM vle_mod v JOIN cut c ON v.dsr > c.cutoff AND v.dsr <= c.cutoff + 7""")(
    lambda spark, sf: _daily_cut(_reg(spark, sf)[1], lambda d, c: (d > c) & (d <= c + 7))
    .groupBy("id_student", "cutoff").agg(F.lit(1).cast("bigint").alias("has_activity_next"))
    .withColumn("cutoff", F.col("cutoff").cast("bigint")))

register("silent_learners", W(O.REG_CLOCK, _CUT_SQL) + """
SELECT CAST(s.id_student AS BIGINT) AS id_student, CAST(c.cutoff AS BIGINT) AS cutoff FROM students s, cut c
WHERE NOT EXISTS (SELECT 1 FROM vle_mod v WHERE v.id_student = s.id_student
                  AND v.dsr > c.cutoff AND v.dsr <= c.cutoff + 7)""")(lambda spark, sf: _silent(spark, sf))


def _silent(spark, sf):
    learners, daily = _reg(spark, sf)
    fut = _daily_cut(daily, lambda d, c: (d > c) & (d <= c + 7)).select("id_student", "cutoff").distinct()
    panel = cutoff_panel(learners.select("id_student"), CUTS)
    return panel.join(fut, ["id_student", "cutoff"], "left_anti").select(
        "id_student", F.col("cutoff").cast("bigint"))


register("eligible_panel", _wrap(O.reg_panel("silent", 7, eligible=True), "SELECT id_student, cutoff FROM p"))(
    lambda spark, sf: variants.snapshot_v5(T(spark, sf)).select("id_student", "cutoff"))

register("cumulative_activity", W(O.REG_CLOCK, _CUT_SQL) + """
SELECT v.id_student, CAST(c.cutoff AS BIGINT) AS cutoff, CAST(sum(v.sum_click) AS BIGINT) AS total_clicks,
       CAST(count(DISTINCT v.dsr) AS BIGINT) AS active_days_total, CAST(max(v.dsr) AS BIGINT) AS last_active
FROM vle_mod v JOIN cut c ON v.dsr <= c.cutoff GROUP BY 1, 2""")(
    lambda spark, sf: _daily_cut(_reg(spark, sf)[1], lambda d, c: d <= c).groupBy("id_student", "cutoff").agg(
        F.sum("clicks").cast("bigint").alias("total_clicks"), F.count(F.lit(1)).alias("active_days_total"),
        F.max("day").cast("bigint").alias("last_active")).withColumn("cutoff", F.col("cutoff").cast("bigint")))

register("trailing14_activity", W(O.REG_CLOCK, _CUT_SQL) + """
SELECT v.id_student, CAST(c.cutoff AS BIGINT) AS cutoff, CAST(sum(v.sum_click) AS BIGINT) AS clicks_last_14_days,
       CAST(count(DISTINCT v.dsr) AS BIGINT) AS active_days_14
FROM vle_mod v JOIN cut c ON v.dsr <= c.cutoff AND v.dsr >= greatest(0, c.cutoff - 13) GROUP BY 1, 2""")(
    lambda spark, sf: _daily_cut(_reg(spark, sf)[1], lambda d, c: (d <= c) & (d >= F.greatest(c - 13, F.lit(0))))
    .groupBy("id_student", "cutoff").agg(F.sum("clicks").cast("bigint").alias("clicks_last_14_days"),
                                         F.count(F.lit(1)).alias("active_days_14"))
    .withColumn("cutoff", F.col("cutoff").cast("bigint")))

register("half_window_clicks", W(O.REG_CLOCK, _CUT_SQL) + """,
b AS (SELECT cutoff, greatest(0, cutoff - 13) AS ws, least(cutoff, greatest(0, cutoff - 13) + 6) AS fe FROM cut)
SELECT v.id_student, CAST(b.cutoff AS BIGINT) AS cutoff,
       CAST(coalesce(sum(CASE WHEN v.dsr <= b.fe THEN v.sum_click END), 0) AS BIGINT) AS clicks_0_7,
       CAST(coalesce(sum(CASE WHEN v.dsr >= least(b.cutoff, b.fe + 1) THEN v.sum_click END), 0) AS BIGINT) AS clicks_8_14
FROM vle_mod v JOIN b ON v.dsr <= b.cutoff AND v.dsr >= b.ws GROUP BY 1, 2""")(lambda spark, sf: _halves(spark, sf))


def _halves(spark, sf):
    d = _daily_cut(_reg(spark, sf)[1], lambda d, c: (d <= c) & (d >= F.greatest(c - 13, F.lit(0))))
    ws, fe, ss = window_bounds(V5, F.col("cutoff"))
    return d.groupBy("id_student", "cutoff").agg(
        F.coalesce(F.sum(F.when(F.col("day") <= fe, F.col("clicks"))), F.lit(0)).cast("bigint").alias("clicks_0_7"),
        F.coalesce(F.sum(F.when(F.col("day") >= ss, F.col("clicks"))), F.lit(0)).cast("bigint").alias("clicks_8_14"),
    ).withColumn("cutoff", F.col("cutoff").cast("bigint"))


register("last_k_clicks", W(O.REG_CLOCK, _CUT_SQL) + """
SELECT v.id_student, CAST(c.cutoff AS BIGINT) AS cutoff,
       CAST(coalesce(sum(CASE WHEN v.dsr > c.cutoff - 7 THEN v.sum_click END), 0) AS BIGINT) AS clicks_last_7_days,
       CAST(coalesce(sum(CASE WHEN v.dsr > c.cutoff - 3 THEN v.sum_click END), 0) AS BIGINT) AS clicks_last_3_days
FROM vle_mod v JOIN cut c ON v.dsr <= c.cutoff AND v.dsr > c.cutoff - 7 GROUP BY 1, 2""")(
    lambda spark, sf: _daily_cut(_reg(spark, sf)[1], lambda d, c: (d <= c) & (d > c - 7))
    .groupBy("id_student", "cutoff").agg(
        F.sum("clicks").cast("bigint").alias("clicks_last_7_days"),
        F.coalesce(F.sum(F.when(F.col("day") > F.col("cutoff") - 3, F.col("clicks"))), F.lit(0))
        .cast("bigint").alias("clicks_last_3_days"))
    .withColumn("cutoff", F.col("cutoff").cast("bigint")))

register("recency", W(O.REG_CLOCK, _CUT_SQL) + """
SELECT v.id_student, CAST(c.cutoff AS BIGINT) AS cutoff, CAST(c.cutoff - max(v.dsr) AS BIGINT) AS days_since_last_active
FROM vle_mod v JOIN cut c ON v.dsr <= c.cutoff GROUP BY v.id_student, c.cutoff""")(
    lambda spark, sf: _daily_cut(_reg(spark, sf)[1], lambda d, c: d <= c).groupBy("id_student", "cutoff")
    .agg((F.col("cutoff") - F.max("day")).cast("bigint").alias("days_since_last_active"))
    .withColumn("cutoff", F.col("cutoff").cast("bigint")))

register("active_day_arrays", W(O.REG_CLOCK, _CUT_SQL) + """
SELECT id_student, CAST(cutoff AS BIGINT) AS cutoff, array_to_string(list_sort(list(DISTINCT dsr)), ',') AS active_days
FROM vle_mod v JOIN cut c ON v.dsr <= c.cutoff AND v.dsr >= greatest(0, c.cutoff - 13) GROUP BY 1, 2""")(
    lambda spark, sf: _daily_cut(_reg(spark, sf)[1], lambda d, c: (d <= c) & (d >= F.greatest(c - 13, F.lit(0))))
    .groupBy("id_student", "cutoff").agg(
        F.array_join(F.array_sort(F.collect_set("day")), ",").alias("active_days"))
    .withColumn("cutoff", F.col("cutoff").cast("bigint")))

register("inactivity_streak", W(O.REG_CLOCK, _CUT_SQL) + """,
lw AS (SELECT v.id_student, c.cutoff, max(v.dsr) AS last_win FROM vle_mod v JOIN cut c
       ON v.dsr <= c.cutoff AND v.dsr >= greatest(0, c.cutoff - 13) GROUP BY 1, 2)
SELECT CAST(s.id_student AS BIGINT) AS id_student, CAST(c.cutoff AS BIGINT) AS cutoff,
       CAST(CASE WHEN lw.last_win IS NULL THEN c.cutoff - greatest(0, c.cutoff - 13) + 1
                 ELSE c.cutoff - lw.last_win END AS BIGINT) AS inactivity_streak
FROM students s CROSS JOIN cut c LEFT JOIN lw ON lw.id_student = s.id_student AND lw.cutoff = c.cutoff""")(
    lambda spark, sf: _streak(spark, sf))


def _streak(spark, sf):
    """X11 closed form with the helper's own empty rule (window length)."""
    learners, daily = _reg(spark, sf)
    lw = (_daily_cut(daily, lambda d, c: (d <= c) & (d >= F.greatest(c - 13, F.lit(0))))
          .groupBy("id_student", "cutoff").agg(F.max("day").alias("last_win")))
    p = cutoff_panel(learners.select("id_student"), CUTS).join(lw, ["id_student", "cutoff"], "left")
    ws = F.greatest(F.col("cutoff") - 13, F.lit(0))
    return p.select("id_student", F.col("cutoff").cast("bigint"),
                    F.coalesce(F.col("cutoff") - F.col("last_win"), F.col("cutoff") - ws + 1)
                    .cast("bigint").alias("inactivity_streak"))


# course-clock blocks of the single-window variants

_SINGLE = f"""
sv AS (SELECT * FROM student_vle WHERE code_module = '{MOD}' AND code_presentation = '{PRES1}')"""


def _single_daily(spark, sf):
    return cohort.collapse_daily(cohort.scope(T(spark, sf).student_vle, MOD, PRES1))


register("banded_clicks", W(_SINGLE) + """
SELECT id_student, CAST(sum(CASE WHEN date <= 7 THEN sum_click ELSE 0 END) AS BIGINT) AS clicks_0_7,
       CAST(sum(CASE WHEN date >= 8 THEN sum_click ELSE 0 END) AS BIGINT) AS clicks_8_14
FROM sv WHERE date >= 0 AND date <= 14 GROUP BY id_student""")(
    lambda spark, sf: early.activity_block(early.V2, _single_daily(spark, sf)).select(
        "id_student", F.col("clicks_0_7").cast("bigint"), F.col("clicks_8_14").cast("bigint")))

register("banded_clicks_100", W(_SINGLE) + """
SELECT id_student,
  CAST(sum(CASE WHEN date BETWEEN 0 AND 7 THEN sum_click END) AS DOUBLE) AS clicks_0_7,
  CAST(sum(CASE WHEN date BETWEEN 8 AND 14 THEN sum_click END) AS DOUBLE) AS clicks_8_14,
  CAST(sum(CASE WHEN date BETWEEN 15 AND 28 THEN sum_click END) AS DOUBLE) AS clicks_15_28,
  CAST(sum(CASE WHEN date BETWEEN 29 AND 100 THEN sum_click END) AS DOUBLE) AS clicks_29_100
FROM sv WHERE date BETWEEN 0 AND 100 GROUP BY id_student""")(
    lambda spark, sf: early.band_pivot(_single_daily(spark, sf), early.V1.bands).select(
        "id_student", *[F.col(b[2]).cast("double").alias(b[2]) for b in early.V1.bands]))

register("activity_outer", W(_SINGLE) + """,
w AS (SELECT * FROM sv WHERE date >= 0 AND date <= 14),
la AS (SELECT id_student, 14 - max(date) AS days_since_last_login FROM w GROUP BY 1),
st AS (SELECT id_student, 14 - max(date) AS inactivity_streak FROM w GROUP BY 1)
SELECT CAST(coalesce(la.id_student, st.id_student) AS BIGINT) AS id_student,
       CAST(la.days_since_last_login AS BIGINT) AS days_since_last_login,
       CAST(st.inactivity_streak AS BIGINT) AS inactivity_streak
FROM la FULL OUTER JOIN st ON la.id_student = st.id_student""")(lambda spark, sf: _outer(spark, sf))


def _outer(spark, sf):
    d = _single_daily(spark, sf).where(F.col("day").between(0, 14))
    la = d.groupBy("id_student").agg((F.lit(14) - F.max("day")).alias("days_since_last_login"))
    st = d.groupBy("id_student").agg((F.lit(14) - F.max("day")).alias("inactivity_streak"))
    return la.join(st, "id_student", "full_outer").select(
        F.col("id_student").cast("bigint"), F.col("days_since_last_login").cast("bigint"),
        F.col("inactivity_streak").cast("bigint"))


# assessment statistics

_SUBS = f"""
ids AS (SELECT DISTINCT id_student FROM student_registration WHERE code_module = '{MOD}' AND code_presentation IN {O.PRES}),
sub AS (SELECT * FROM student_assessment WHERE id_student IN (SELECT id_student FROM ids) AND date_submitted IS NOT NULL)"""


def _subs(spark, sf):
    t = T(spark, sf)
    ids = cohort.scope(t.student_registration, MOD, PRES).select("id_student")
    return t.student_assessment.join(ids, "id_student", "left_semi").where(F.col("date_submitted").isNotNull())


register("score_stats", W(_SUBS) + """
SELECT id_student, CAST(count(DISTINCT id_assessment) AS DOUBLE) AS num_assessments, avg(score) AS avg_score,
       max(score) AS max_score, min(score) AS min_score, round(stddev_samp(score), 6) AS score_std
FROM sub GROUP BY id_student""")(
    lambda spark, sf: A.score_stats(_subs(spark, sf), pass_rate=False).select(
        "id_student", "num_assessments", "avg_score", "max_score", "min_score",
        F.round("score_std", 6).alias("score_std")))

_LAST = """
SELECT id_student, score AS last_score FROM (
  SELECT id_student, score, row_number() OVER (PARTITION BY id_student
         ORDER BY date_submitted DESC, id_assessment DESC, id_submission DESC) AS rn
  FROM sub WHERE score IS NOT NULL) WHERE rn = 1"""

register("last_score", W(_SUBS) + _LAST)(
    lambda spark, sf: _subs(spark, sf).groupBy("id_student").agg(A.last_score_agg().alias("last_score"))
    .where(F.col("last_score").isNotNull()))
register("last_score_window", W(_SUBS) + _LAST)(lambda spark, sf: A.last_score_window(_subs(spark, sf)))

register("pass_count", W(_SUBS) + """
SELECT id_student, CAST(count(*) FILTER (WHERE score >= 40) AS BIGINT) AS pass_count FROM sub GROUP BY 1""")(
    lambda spark, sf: _subs(spark, sf).groupBy("id_student").agg(
        F.count_if(F.col("score") >= C.PASS_MARK).alias("pass_count")))

register("pass_rate", W(_SUBS) + """
SELECT id_student, avg(CASE WHEN score >= 40 THEN 1.0 ELSE 0.0 END) AS pass_rate FROM sub GROUP BY 1""")(
    lambda spark, sf: _subs(spark, sf).groupBy("id_student").agg(
        F.avg(F.when(F.col("score") >= C.PASS_MARK, F.lit(1.0)).otherwise(F.lit(0.0))).alias("pass_rate")))

_V4_ASS = f"""{O.COURSE_COHORT.strip()},
{O.cutoffs_cte(C.CUTOFFS_COURSE)},
tid AS (SELECT DISTINCT id_assessment FROM assessments WHERE code_module = '{MOD}' AND code_presentation IN {O.PRES}),
sub AS (SELECT * FROM student_assessment WHERE id_assessment IN (SELECT id_assessment FROM tid)
        AND id_student IN (SELECT id_student FROM students) AND date_submitted IS NOT NULL),
b AS (SELECT s.id_student, c.cutoff FROM students s, cut c),
ac AS (SELECT b.id_student, b.cutoff, count(DISTINCT id_assessment) AS n, avg(score) AS avg_score,
              count(*) FILTER (WHERE score >= 40) AS pass_count
       FROM b JOIN sub ON sub.id_student = b.id_student AND sub.date_submitted <= b.cutoff GROUP BY 1, 2),
al AS (SELECT id_student, cutoff, score FROM (
         SELECT b.id_student, b.cutoff, score, row_number() OVER (PARTITION BY b.id_student, b.cutoff
                ORDER BY date_submitted DESC, id_assessment DESC, id_submission DESC) AS rn
         FROM b JOIN sub ON sub.id_student = b.id_student AND sub.date_submitted <= b.cutoff
         WHERE score IS NOT NULL) WHERE rn = 1),
aw AS (SELECT b.id_student, b.cutoff, count(DISTINCT id_assessment) AS n14, avg(score) AS avg14
       FROM b JOIN sub ON sub.id_student = b.id_student AND sub.date_submitted <= b.cutoff
        AND sub.date_submitted >= greatest(0, b.cutoff - 13) GROUP BY 1, 2)"""

register("assessment_snapshot", W(_V4_ASS) + """
SELECT CAST(b.id_student AS BIGINT) AS id_student, CAST(b.cutoff AS BIGINT) AS cutoff,
  CAST(coalesce(ac.n, 0) AS DOUBLE) AS num_assessments, CAST(coalesce(ac.avg_score, 0) AS DOUBLE) AS avg_score,
  CAST(coalesce(ac.pass_count, 0) AS DOUBLE) AS pass_count, CAST(coalesce(al.score, 0) AS DOUBLE) AS last_score,
  CAST(coalesce(aw.n14, 0) AS DOUBLE) AS num_assessments_14, CAST(coalesce(aw.avg14, 0) AS DOUBLE) AS avg_score_14
FROM b LEFT JOIN ac USING (id_student, cutoff) LEFT JOIN al USING (id_student, cutoff)
LEFT JOIN aw USING (id_student, cutoff)""")(
    lambda spark, sf: variants.snapshot_v4(T(spark, sf)).select(
        "id_student", "cutoff", "num_assessments", "avg_score", "pass_count", "last_score",
        "num_assessments_14", "avg_score_14"))

register("score_stats_14", W(_V4_ASS) + """
SELECT CAST(b.id_student AS BIGINT) AS id_student, CAST(b.cutoff AS BIGINT) AS cutoff,
  CAST(coalesce(aw.n14, 0) AS DOUBLE) AS num_assessments_14, CAST(coalesce(aw.avg14, 0) AS DOUBLE) AS avg_score_14
FROM b LEFT JOIN aw USING (id_student, cutoff)""")(
    lambda spark, sf: variants.snapshot_v4(T(spark, sf)).select(
        "id_student", "cutoff", "num_assessments_14", "avg_score_14"))


# ---------------------------------------------------------------- cleaning, rule scores, tiers

def _v8(spark, sf):
    return variants.snapshot_v8(T(spark, sf))


def _scored(spark, sf):
    """V8 panel with the decline score A (rounded to 6 places) as the deterministic score."""
    return _v8(spark, sf).select("id_student", "cutoff", "y_short", F.round(rules.decline_score_a(), 6).alias("score"))


_SCORED_SQL = f"s AS (SELECT id_student, cutoff, y_short, round({O.DECLINE_A}, 6) AS score FROM p)"


def _on_v8(select: str, *more: str) -> str:
    ctes, inner = O.v8_panel()
    return W(ctes, f"p AS ({inner})", *more) + "\n" + select


register("cleaned_features", _wrap(_V9, f"SELECT id_student, cutoff, {O.clean_sql('click_nonneg')} FROM p"))(
    lambda spark, sf: clean_features(variants.snapshot_v9(T(spark, sf)), FEATURES_15, "click_nonneg",
                                     keep=["id_student", "cutoff"]))
register("cleaned_features_all", _on_v8(f"SELECT id_student, cutoff, {O.clean_sql('all_nonneg')} FROM p"))(
    lambda spark, sf: clean_features(_v8(spark, sf), FEATURES_15, "all_nonneg", keep=["id_student", "cutoff"]))

register("filled_features", W() + f"""
SELECT id_student, CAST(coalesce(date_registration, 0) AS BIGINT) AS date_registration,
       CAST(coalesce(date_unregistration, 999) AS BIGINT) AS date_unregistration
FROM student_registration WHERE code_module = '{MOD}' AND code_presentation IN {O.PRES}""")(
    lambda spark, sf: cohort.scope(T(spark, sf).student_registration, MOD, PRES)
    .select("id_student", "date_registration", "date_unregistration")
    .fillna({"date_registration": 0, "date_unregistration": 999})
    .select("id_student", F.col("date_registration").cast("bigint"), F.col("date_unregistration").cast("bigint")))

register("safe_ratios", W(O.REG_CLOCK) + """
SELECT id_student, coalesce(CAST(sum(sum_click) AS DOUBLE) / nullif(count(DISTINCT dsr), 0), 0.0) AS clicks_per_active_day,
       coalesce(CAST(sum(sum_click) AS DOUBLE) / nullif(max(dsr) - min(dsr), 0), 0.0) AS clicks_per_span_day
FROM vle_mod GROUP BY id_student""")(lambda spark, sf: _safe(spark, sf))


def _safe(spark, sf):
    d = _reg(spark, sf)[1]
    agg = d.groupBy("id_student").agg(F.sum("clicks").alias("tot"), F.count(F.lit(1)).alias("days"),
                                      (F.max("day") - F.min("day")).alias("span"))
    return agg.select("id_student", safe_div(F.col("tot"), F.col("days")).alias("clicks_per_active_day"),
                      safe_div(F.col("tot"), F.col("span")).alias("clicks_per_span_day"))


register("decline_score_a", _on_v8(f"SELECT id_student, cutoff, {O.DECLINE_A} AS decline_score FROM p"))(
    lambda spark, sf: _v8(spark, sf).select("id_student", "cutoff", rules.decline_score_a().alias("decline_score")))
register("decline_score_b", _on_v8(f"SELECT id_student, cutoff, {O.DECLINE_B} AS decline_score FROM p"))(
    lambda spark, sf: _v8(spark, sf).select("id_student", "cutoff", rules.decline_score_b().alias("decline_score")))

_V9C = f"q AS (SELECT id_student, cutoff, target, {O.clean_sql('click_nonneg')} FROM p)"


def _v9_clean(spark, sf):
    return clean_features(variants.snapshot_v9(T(spark, sf)), FEATURES_15, "click_nonneg",
                          keep=["id_student", "cutoff", "target"])


register("heuristic_risk", W(O.v9_panel()[0], f"p AS ({O.v9_panel()[1]})", _V9C) + f"""
SELECT id_student, cutoff, round({O.HEURISTIC}, 6) AS heuristic_risk FROM q""")(
    lambda spark, sf: _v9_clean(spark, sf).select("id_student", "cutoff",
                                                   F.round(rules.heuristic_risk(), 6).alias("heuristic_risk")))

register("display_sigmoid", W(O.v9_panel()[0], f"p AS ({O.v9_panel()[1]})", _V9C) + f"""
SELECT id_student, cutoff,
  round(least(greatest({O.HEURISTIC} * 1.15::DOUBLE, 0::DOUBLE), 1::DOUBLE), 6) AS heur_boosted,
  round(1.0 / (1.0 + exp(-8.0 * ({O.HEURISTIC} - 0.5))), 6) AS display
FROM q""")(lambda spark, sf: _v9_clean(spark, sf).select(
    "id_student", "cutoff", F.round(rules.boosted(rules.heuristic_risk()), 6).alias("heur_boosted"),
    F.round(rules.display_sigmoid(rules.heuristic_risk()), 6).alias("display")))


def _tier_sql(x, m, h):
    return f"CASE WHEN {x} >= {h} THEN 'HIGH' WHEN {x} >= {m} THEN 'MEDIUM' ELSE 'LOW' END"


register("risk_tiers", _on_v8(f"""SELECT id_student, cutoff,
  {_tier_sql(O.DECLINE_B, 0.30, 0.60)} AS tier_single, {_tier_sql(O.DECLINE_B, 0.35, 0.60)} AS tier_batch,
  {_tier_sql(O.DECLINE_B, 0.40, 0.65)} AS tier_alt FROM p"""))(
    lambda spark, sf: _v8(spark, sf).select(
        "id_student", "cutoff", rules.tier(rules.decline_score_b(), *C.TIERS_SINGLE).alias("tier_single"),
        rules.tier(rules.decline_score_b(), *C.TIERS_BATCH).alias("tier_batch"),
        rules.tier(rules.decline_score_b(), *C.TIERS_ALT).alias("tier_alt")))

register("blended_tiers", _on_v8(f"""SELECT id_student, cutoff,
  round(0.35::DOUBLE * {O.DECLINE_B} + 0.65::DOUBLE * {O.DECLINE_A}, 6) AS risk_score,
  {_tier_sql('round(0.35::DOUBLE * ' + O.DECLINE_B + ' + 0.65::DOUBLE * ' + O.DECLINE_A + ', 6)', 0.22, 0.50)} AS risk_level
  FROM p"""))(lambda spark, sf: _blend_rules(spark, sf))


def _blend_rules(spark, sf):
    """X15 with the rule B score standing in for the model probability (no model needed)."""
    s = F.round(rules.blend(rules.decline_score_b(), rules.decline_score_a(), C.BLEND_A["alpha_model"]), 6)
    return _v8(spark, sf).select("id_student", "cutoff", s.alias("risk_score")).withColumn(
        "risk_level", rules.tier(F.col("risk_score"), C.BLEND_A["thr_medium"], C.BLEND_A["thr_high"]))


register("blended_heuristic", _on_v8(f"""SELECT id_student, cutoff, round({O.HEURISTIC}, 6) AS heuristic_risk, round(h2, 6) AS heur_boosted,
  round(raw, 6) AS risk_score, round(1.0 / (1.0 + exp(-8.0 * (raw - 0.5))), 6) AS display
FROM (SELECT *, 0.55::DOUBLE * {O.DECLINE_B} + (1 - 0.55::DOUBLE) * h2 AS raw FROM (
  SELECT *, least(greatest({O.HEURISTIC} * 1.15, 0), 1) AS h2 FROM p))"""))(
    lambda spark, sf: _v8(spark, sf).select("id_student", "cutoff", *[
        F.round(v, 6).alias(k) for k, v in rules.heuristic_blend(rules.decline_score_b()).items()]))

register("threshold_decision", _on_v8(f"""SELECT id_student, cutoff,
  CAST(CASE WHEN {O.DECLINE_A} >= 0.5 THEN 1 ELSE 0 END AS BIGINT) AS pred FROM p"""))(
    lambda spark, sf: _v8(spark, sf).select("id_student", "cutoff",
                                            rules.decision(rules.decline_score_a(), 0.5).cast("bigint").alias("pred")))

register("action_map", _on_v8(f"""SELECT id_student, cutoff, {_tier_sql(O.DECLINE_B, 0.35, 0.60)} AS risk_level,
  CASE {_tier_sql(O.DECLINE_B, 0.35, 0.60)} WHEN 'HIGH' THEN 'ALERT' WHEN 'MEDIUM' THEN 'REMIND' ELSE 'SAFE' END
  AS action FROM p"""))(
    lambda spark, sf: _v8(spark, sf).select("id_student", "cutoff",
                                            rules.tier(rules.decline_score_b(), *C.TIERS_BATCH).alias("risk_level"))
    .withColumn("action", rules.action(F.col("risk_level"))))

register("tier_counts", _on_v8(f"""SELECT risk_level, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT {_tier_sql(O.DECLINE_B, 0.35, 0.60)} AS risk_level FROM p) GROUP BY 1"""))(
    lambda spark, sf: _v8(spark, sf).select(rules.tier(rules.decline_score_b(), *C.TIERS_BATCH).alias("risk_level"))
    .groupBy("risk_level").agg(F.count(F.lit(1)).alias("n")))

register("daily_alerts", _on_v8(f"""SELECT id_student, cutoff, round({O.DECLINE_A}, 6) AS score FROM p
  WHERE cutoff = 14 AND round({O.DECLINE_A}, 6) >= 0.5"""))(
    lambda spark, sf: D.alerts(_scored(spark, sf).where(F.col("cutoff") == 14), "score", 0.5)
    .select("id_student", "cutoff", "score"))

register("ranked_risk", _on_v8(f"SELECT id_student, cutoff, round({O.DECLINE_A}, 6) AS score FROM p WHERE cutoff = 14"))(
    lambda spark, sf: D.ranked(_scored(spark, sf).where(F.col("cutoff") == 14).select("id_student", "cutoff", "score"),
                               "score"))

register("top10_risk", _on_v8(f"""SELECT id_student, cutoff, round({O.DECLINE_A}, 6) AS score FROM p WHERE cutoff = 14
  ORDER BY score DESC, id_student ASC LIMIT 10"""))(
    lambda spark, sf: D.top_k(_scored(spark, sf).where(F.col("cutoff") == 14).select("id_student", "cutoff", "score"),
                              "score", 10))

register("label_profile", _on_v8("""SELECT cutoff, CAST(count(*) AS BIGINT) AS n_rows,
  round(avg(CAST(y_short AS DOUBLE)), 6) AS positive_rate, CAST(count(DISTINCT id_student) AS BIGINT) AS n_learners,
  CAST(count(*) FILTER (WHERE y_short = 1) AS BIGINT) AS n_pos, CAST(count(*) FILTER (WHERE y_short <> 1) AS BIGINT) AS n_neg
  FROM p GROUP BY cutoff"""))(
    lambda spark, sf: R6(M.label_profile(_v8(spark, sf), ["cutoff"], "y_short", "id_student"), "positive_rate"))

register("panel_union", "SELECT * FROM (" + _wrap(O.reg_panel("silent", 7), """SELECT id_student, cutoff,
  y_short AS label, 'silent_7' AS variant FROM p""") + ") UNION ALL SELECT * FROM (" + _wrap(O.v8_panel(), """SELECT
  id_student, cutoff, y_short AS label, 'low_activity_14' AS variant FROM p""") + ")")(
    lambda spark, sf: variants.snapshot_v7(T(spark, sf)).select(
        "id_student", "cutoff", F.col("y_short").alias("label"), F.lit("silent_7").alias("variant"))
    .unionByName(_v8(spark, sf).select("id_student", "cutoff", F.col("y_short").alias("label"),
                                        F.lit("low_activity_14").alias("variant"))))

# ---------------------------------------------------------------- evaluation on the deterministic score

register("classification_metrics", _on_v8("""SELECT cutoff, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
  CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn,
  round(CASE WHEN tp+fp+tn+fn = 0 THEN 0 ELSE (tp+tn)::DOUBLE / (tp+fp+tn+fn) END, 6) AS accuracy,
  round(CASE WHEN tp+fp = 0 THEN 0 ELSE tp::DOUBLE / (tp+fp) END, 6) AS precision,
  round(CASE WHEN tp+fn = 0 THEN 0 ELSE tp::DOUBLE / (tp+fn) END, 6) AS recall,
  round(CASE WHEN 2*tp+fp+fn = 0 THEN 0 ELSE 2*tp::DOUBLE / (2*tp+fp+fn) END, 6) AS f1,
  round(tn / (tn + fp + 1e-9), 6) AS specificity
FROM (SELECT cutoff, count(*) FILTER (WHERE score >= 0.5 AND y_short = 1) AS tp,
             count(*) FILTER (WHERE score >= 0.5 AND y_short <> 1) AS fp,
             count(*) FILTER (WHERE score < 0.5 AND y_short <> 1) AS tn,
             count(*) FILTER (WHERE score < 0.5 AND y_short = 1) AS fn FROM s GROUP BY cutoff)""", _SCORED_SQL))(
    lambda spark, sf: R6(M.confusion(_scored(spark, sf), ["cutoff"], "score", "y_short", 0.5), "accuracy", "precision", "recall", "f1", "specificity"))

register("class_report", _on_v8("""SELECT cutoff, class, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM (
  SELECT * FROM per
  UNION ALL SELECT cutoff, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM per GROUP BY cutoff
  UNION ALL SELECT cutoff, 'weighted avg', sum(precision*support)/sum(support), sum(recall*support)/sum(support),
                   sum(f1*support)/sum(support), sum(support) FROM per GROUP BY cutoff)""", _SCORED_SQL, """
pr AS (SELECT cutoff, y_short, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred FROM s),
cnt AS (SELECT c.cutoff, k.cls,
          count(*) FILTER (WHERE pr.pred = k.cls AND pr.y_short = k.cls) AS tp,
          count(*) FILTER (WHERE pr.pred = k.cls) AS npred, count(*) FILTER (WHERE pr.y_short = k.cls) AS support
        FROM (SELECT DISTINCT cutoff FROM pr) c CROSS JOIN (SELECT unnest([0, 1]) AS cls) k
        JOIN pr ON pr.cutoff = c.cutoff GROUP BY 1, 2),
per AS (SELECT cutoff, CAST(cls AS VARCHAR) AS class,
          CASE WHEN npred = 0 THEN 0.0 ELSE tp::DOUBLE / npred END AS precision,
          CASE WHEN support = 0 THEN 0.0 ELSE tp::DOUBLE / support END AS recall,
          CASE WHEN (CASE WHEN npred = 0 THEN 0.0 ELSE tp::DOUBLE / npred END)
                    + (CASE WHEN support = 0 THEN 0.0 ELSE tp::DOUBLE / support END) = 0 THEN 0.0
               ELSE 2 * (CASE WHEN npred = 0 THEN 0.0 ELSE tp::DOUBLE / npred END)
                      * (CASE WHEN support = 0 THEN 0.0 ELSE tp::DOUBLE / support END)
                    / ((CASE WHEN npred = 0 THEN 0.0 ELSE tp::DOUBLE / npred END)
                      + (CASE WHEN support = 0 THEN 0.0 ELSE tp::DOUBLE / support END)) END AS f1,
          support FROM cnt)"""))(
    lambda spark, sf: R6(M.class_report(_scored(spark, sf).withColumn("pred", rules.decision(F.col("score"), 0.5)),
                                     ["cutoff"], "pred", "y_short"), "precision", "recall", "f1"))

_CUM = """
g AS (SELECT cutoff, score, count(*) FILTER (WHERE y_short = 1) AS pos, count(*) FILTER (WHERE y_short <> 1) AS neg
      FROM s GROUP BY 1, 2),
c AS (SELECT *, sum(pos) OVER (PARTITION BY cutoff ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cp,
             sum(neg) OVER (PARTITION BY cutoff ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cn,
             sum(pos) OVER (PARTITION BY cutoff) AS "P", sum(neg) OVER (PARTITION BY cutoff) AS "N" FROM g),
pts AS (SELECT cutoff, score AS threshold, cp, cn, "P", "N",
               CASE WHEN cp + cn = 0 THEN 0.0 ELSE cp::DOUBLE / (cp + cn) END AS precision,
               CASE WHEN "P" = 0 THEN 0.0 ELSE cp::DOUBLE / "P" END AS recall FROM c)"""

register("roc_auc", _on_v8("""SELECT cutoff, round(CASE WHEN max("P") * max("N") = 0 THEN NULL
  ELSE sum(pos * ("N" - cn + 0.5 * neg)) / (max("P") * max("N")) END, 6) AS auc
  FROM c GROUP BY cutoff""", _SCORED_SQL, _CUM))(lambda spark, sf: R6(M.roc_auc(_scored(spark, sf), ["cutoff"], "score", "y_short"), "auc"))

register("average_precision", _on_v8("""SELECT cutoff, round(sum(CASE WHEN "P" = 0 THEN NULL
  ELSE pos::DOUBLE / "P" END * (cp::DOUBLE / (cp + cn))), 6)
  AS average_precision FROM c GROUP BY cutoff""", _SCORED_SQL, _CUM))(
    lambda spark, sf: R6(M.average_precision(_scored(spark, sf), ["cutoff"], "score", "y_short"), "average_precision"))

register("pr_curve", _on_v8("""SELECT cutoff, threshold, CAST(cp AS BIGINT) AS tp, CAST(cn AS BIGINT) AS fp,
  round(precision, 6) AS precision, round(recall, 6) AS recall FROM pts""", _SCORED_SQL, _CUM))(
    lambda spark, sf: R6(M.pr_curve(_scored(spark, sf), ["cutoff"], "score", "y_short"), "precision", "recall"))

register("roc_curve", _on_v8("""SELECT cutoff, threshold, round(CASE WHEN "P" = 0 THEN 0.0 ELSE cp::DOUBLE / "P" END, 6) AS tpr,
  round(CASE WHEN "N" = 0 THEN 0.0 ELSE cn::DOUBLE / "N" END, 6) AS fpr FROM pts""", _SCORED_SQL, _CUM))(
    lambda spark, sf: R6(M.roc_curve(_scored(spark, sf), ["cutoff"], "score", "y_short"), "tpr", "fpr"))


def _grid_sql(values, init_best, default):
    arr = "[" + ", ".join(f"{v!r}::DOUBLE" for v in values) + "]"
    return f"""
gr AS (SELECT unnest({arr}) AS t),
gf AS (SELECT s.cutoff, gr.t,
         count(*) FILTER (WHERE s.score >= gr.t AND s.y_short = 1) AS tp,
         count(*) FILTER (WHERE s.score >= gr.t AND s.y_short <> 1) AS fp,
         count(*) FILTER (WHERE s.score < gr.t AND s.y_short = 1) AS fn
       FROM s CROSS JOIN gr GROUP BY 1, 2),
gb AS (SELECT cutoff, t, CASE WHEN 2*tp+fp+fn = 0 THEN 0.0 ELSE 2*tp::DOUBLE / (2*tp+fp+fn) END AS f1 FROM gf),
best AS (SELECT cutoff, arg_max(t, f1 * 10 - t / 1000.0) AS bt, max(f1) AS bf FROM (
           SELECT cutoff, t, f1, row_number() OVER (PARTITION BY cutoff ORDER BY f1 DESC, t ASC) AS rn FROM gb)
         WHERE rn = 1 GROUP BY cutoff)"""


_GC = TH.grid(C.GRID_COARSE)
_GF = TH.grid(C.GRID_FINE)

register("threshold_f1_grid", _on_v8("""SELECT cutoff, round(CASE WHEN bf > 0 THEN bt ELSE 0.5 END, 6) AS best_threshold,
  round(CASE WHEN bf > 0 THEN bf ELSE 0.0 END, 6) AS best_f1 FROM best""", _SCORED_SQL, _grid_sql(_GC, 0.0, 0.5)))(
    lambda spark, sf: R6(TH.f1_grid(_scored(spark, sf), ["cutoff"], "score", "y_short", _GC, 0.0), "best_threshold", "best_f1"))

register("threshold_f1_grid_fine", _on_v8("""SELECT cutoff, round(bt, 6) AS best_threshold, round(bf, 6) AS best_f1
  FROM best""", _SCORED_SQL, _grid_sql(_GF, -1.0, 0.5)))(
    lambda spark, sf: R6(TH.f1_grid(_scored(spark, sf), ["cutoff"], "score", "y_short", _GF, -1.0), "best_threshold", "best_f1"))

register("threshold_f1_curve", _on_v8("""SELECT cutoff, threshold, round(f1, 6) AS f1 FROM (
  SELECT cutoff, threshold, 2 * precision * recall / (precision + recall + 1e-12) AS f1,
         row_number() OVER (PARTITION BY cutoff ORDER BY 2 * precision * recall / (precision + recall + 1e-12) DESC,
                            threshold ASC) AS rn FROM pts) WHERE rn = 1""", _SCORED_SQL, _CUM))(
    lambda spark, sf: R6(TH.f1_curve(_scored(spark, sf), ["cutoff"], "score", "y_short"), "f1"))

register("threshold_median", _on_v8("""SELECT round(median(threshold), 6) AS median_threshold,
  CAST(count(*) AS BIGINT) AS n_groups FROM (
  SELECT cutoff, threshold, row_number() OVER (PARTITION BY cutoff ORDER BY
         2 * precision * recall / (precision + recall + 1e-12) DESC, threshold ASC) AS rn FROM pts) WHERE rn = 1""",
                                      _SCORED_SQL, _CUM))(
    lambda spark, sf: TH.f1_curve(_scored(spark, sf), ["cutoff"], "score", "y_short").agg(
        F.round(F.median("threshold"), 6).alias("median_threshold"), F.count(F.lit(1)).alias("n_groups")))

register("threshold_recall_target", _on_v8("""SELECT o.cutoff,
  CASE WHEN ok.threshold IS NOT NULL THEN ok.threshold ELSE f.threshold END AS threshold,
  CASE WHEN ok.threshold IS NOT NULL THEN 'recall_target' ELSE 'max_f1' END AS rule
FROM (SELECT DISTINCT cutoff FROM pts) o
LEFT JOIN (SELECT cutoff, threshold FROM (SELECT cutoff, threshold, row_number() OVER (PARTITION BY cutoff
             ORDER BY precision DESC, threshold ASC) AS rn FROM pts WHERE recall >= 0.8) WHERE rn = 1) ok
  ON ok.cutoff = o.cutoff
LEFT JOIN (SELECT cutoff, threshold FROM (SELECT cutoff, threshold, row_number() OVER (PARTITION BY cutoff
             ORDER BY 2 * precision * recall / (precision + recall + 1e-9) DESC, threshold ASC) AS rn FROM pts)
           WHERE rn = 1) f ON f.cutoff = o.cutoff""", _SCORED_SQL, _CUM))(
    lambda spark, sf: TH.recall_target(_scored(spark, sf), ["cutoff"], "score", "y_short"))

register("threshold_precision_floor", _on_v8("""SELECT o.cutoff, coalesce(ok.threshold, 0.5) AS threshold,
  round(coalesce(ok.recall, -1.0), 6) AS recall
FROM (SELECT DISTINCT cutoff FROM pts) o
LEFT JOIN (SELECT cutoff, threshold, recall FROM (SELECT cutoff, threshold, recall, row_number() OVER (
             PARTITION BY cutoff ORDER BY recall DESC, threshold ASC) AS rn FROM pts WHERE precision >= 0.3)
           WHERE rn = 1) ok ON ok.cutoff = o.cutoff""", _SCORED_SQL, _CUM))(
    lambda spark, sf: R6(TH.precision_floor(_scored(spark, sf), ["cutoff"], "score", "y_short", C.PRECISION_FLOOR_MEDIUM), "recall"))


# ---------------------------------------------------------------- sources, validation, sinks


_V11_CTES, _V11_SELECT = O.v11_panel()

register("days_since_registration", W() + f"""
SELECT id_student, CAST(date_diff('day', DATE '2024-01-08' + CAST(date_registration AS INTEGER),
                                  DATE '2024-01-22') AS BIGINT) AS days_since_registration
FROM student_registration WHERE code_module = '{MOD}' AND code_presentation IN {O.PRES}
  AND date_registration IS NOT NULL""")(
    lambda spark, sf: H.days_since_registration(
        cohort.scope(T(spark, sf).student_registration, MOD, PRES).where(F.col("date_registration").isNotNull()),
        "2024-01-22").select("id_student", F.col("days_since_registration").cast("bigint")))

register("nested_history_source", W(O.V11_COHORT) + """,
d AS (SELECT id_student, dsr, sum(sum_click) AS c FROM vle_mod GROUP BY 1, 2)
SELECT CAST(s.id_student AS VARCHAR) AS student_id, CAST(s.dsr_today AS BIGINT) AS days_since_registration,
       CAST(count(d.dsr) AS BIGINT) AS n_activities, CAST(coalesce(sum(d.c), 0) AS BIGINT) AS total_clicks
FROM students s LEFT JOIN d ON d.id_student = s.id_student GROUP BY 1, 2""")(lambda spark, sf: _nested(spark, sf))


def _nested(spark, sf):
    """S3 round trip: histories written as JSON lines, read back with the declared schema."""
    path = scratch_path(spark, "histories")
    H.learner_histories(T(spark, sf)).write.mode("overwrite").json(path)
    h = H.read_histories(spark, path)
    return h.select("student_id", F.col("days_since_registration").cast("bigint"),
                    F.size("vle_activities").cast("bigint").alias("n_activities"),
                    F.aggregate("vle_activities", F.lit(0).cast("bigint"),
                                lambda a, x: a + x["sum_click"].cast("bigint")).alias("total_clicks"))


register("feature_rows_source", W(_V11_CTES, f"p AS ({_V11_SELECT})") + "\nSELECT * EXCLUDE (cutoff) FROM p")(
    lambda spark, sf: _feature_rows(spark, sf))


def _feature_rows(spark, sf):
    """S4 round trip: pre-computed 15-feature rows written as parquet, read with the declared schema."""
    path = scratch_path(spark, "feature_rows")
    variants.snapshot_v11(H.learner_histories(T(spark, sf))).drop("cutoff").write.mode("overwrite").parquet(path)
    return H.read_feature_rows(spark, path)


register("feature_cache", W(_V11_CTES, f"p AS ({_V11_SELECT})") + "\nSELECT * EXCLUDE (cutoff), '2024-01-22 06:00:00' AS calculated_at FROM p")(
    lambda spark, sf: _feature_cache(spark, sf))


def _feature_cache(spark, sf):
    """Features cached on two days; the read takes each learner's latest row not older than
    the bound (the earlier day's rows, all zero, must not come back)."""
    path = scratch_path(spark, "feature_cache")
    rows = variants.snapshot_v11(H.learner_histories(T(spark, sf))).drop("cutoff")
    D.write_feature_cache(rows.select("student_id", *[F.lit(0.0).alias(c) for c in FEATURES_15]), path, "2024-01-20 06:00:00")
    D.write_feature_cache(rows, path, "2024-01-22 06:00:00")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in H.FEATURE_ROW_15.fields)
    schema += ", calculated_at timestamp_ntz, calculated_on date"
    got = D.read_feature_cache(schema, spark, path, "student_id", "2024-01-20 00:00:00")
    return got.withColumn("calculated_at", F.date_format("calculated_at", "yyyy-MM-dd HH:mm:ss"))


register("feature_order", W(_V11_CTES, f"p AS ({_V11_SELECT})") + "\nSELECT student_id, "
         + ", ".join(FEATURES_15) + " FROM p")(
    lambda spark, sf: variants.snapshot_v11(H.learner_histories(T(spark, sf))).select("student_id", *FEATURES_15))

register("validate_rows", W(_V11_CTES, f"p AS ({_V11_SELECT})") + """
SELECT student_id,
  CASE WHEN active_ratio_total < 0 OR active_ratio_total > 1 OR active_ratio_14 < 0 OR active_ratio_14 > 1
       THEN 0 ELSE 1 END::BIGINT AS is_valid,
  CASE WHEN active_ratio_total < 0 OR active_ratio_total > 1 THEN 'active_ratio_total out of [0,1]'
       WHEN active_ratio_14 < 0 OR active_ratio_14 > 1 THEN 'active_ratio_14 out of [0,1]' END AS error
FROM p""")(lambda spark, sf: VAL.validate_feature_rows(
    variants.snapshot_v11(H.learner_histories(T(spark, sf))).drop("cutoff"), FEATURES_15)
    .select("student_id", "is_valid", "error"))

# One learner in seven per fault, so that every kind of cause occurs in the given tables.
register("validate_broken_rows", W(_V11_CTES, f"p AS ({_V11_SELECT}), e AS (SELECT *, CAST(student_id AS BIGINT) % 7 AS r FROM p)") + """,
c AS (SELECT student_id, CASE r
  WHEN 0 THEN 'clicks_last_14_days is missing'
  WHEN 1 THEN 'active_ratio_total out of [0,1]'
  WHEN 2 THEN 'trend_click_14 is not numeric'
  WHEN 3 THEN 'active_days_14 is not numeric'
  WHEN 4 THEN 'clicks_per_day_total is not numeric'
  ELSE CASE WHEN active_ratio_total < 0 OR active_ratio_total > 1 THEN 'active_ratio_total out of [0,1]'
            WHEN active_ratio_14 < 0 OR active_ratio_14 > 1 THEN 'active_ratio_14 out of [0,1]' END END AS error FROM e)
SELECT student_id, CASE WHEN error IS NULL THEN 1 ELSE 0 END::BIGINT AS is_valid, error FROM c""")(
    lambda spark, sf: VAL.validate_feature_rows(_broken(variants.snapshot_v11(H.learner_histories(T(spark, sf)))), FEATURES_15)
    .select("student_id", "is_valid", "error"))


def _broken(rows):
    """Faults by id: a NULL, a ratio above one, a NaN, a text, and two faults at once."""
    r = F.col("student_id").cast("bigint") % 7
    nan = F.lit(float("nan"))
    return rows.withColumns({
        "clicks_last_14_days": F.when(r != 0, F.col("clicks_last_14_days")),
        "active_ratio_total": F.col("active_ratio_total") + F.when(r == 1, 2.0).otherwise(0.0),
        "trend_click_14": F.when(r == 2, nan).otherwise(F.col("trend_click_14")),
        "active_days_14": F.when(r == 3, "n/a").otherwise(F.col("active_days_14").cast("string")),
        "clicks_per_day_total": F.when(r == 4, nan).otherwise(F.col("clicks_per_day_total")),
        "clicks_0_7": F.when(r != 4, F.col("clicks_0_7")),
    })


register("batch_error_rows", W() + f"""
SELECT CAST(id_student AS VARCHAR) AS student_id,
       CAST(CASE WHEN date_registration IS NULL THEN NULL ELSE 14 - date_registration END AS BIGINT) AS cutoff,
       CASE WHEN date_registration IS NULL THEN 'days_since_registration is missing' END AS error
FROM student_registration WHERE code_module = '{MOD}' AND code_presentation IN {O.PRES}""")(
    lambda spark, sf: VAL.batch_with_errors(_all_histories(spark, sf)).select("student_id", "cutoff", "error"))


def _all_histories(spark, sf):
    """Histories for every registration row of the cohort, including those whose registration
    day is unknown (their cutoff is NULL and they become error rows)."""
    t = T(spark, sf)
    reg = cohort.registration_lookup(t, MOD, PRES)
    ok = H.learner_histories(t)
    bad = reg.where(F.col("date_registration").isNull()).select(
        F.col("id_student").cast("string").alias("student_id"),
        F.lit(None).cast("int").alias("days_since_registration"),
        F.array().cast("array<struct<date:int,sum_click:int>>").alias("vle_activities"))
    return ok.unionByName(bad)


register("active_history_join", W(O.V11_COHORT) + """,
act AS (SELECT DISTINCT id_student FROM student_vle WHERE code_module = 'BBB' AND code_presentation IN ('2024A','2024B')
        AND date > 7 AND date <= 14),
d AS (SELECT id_student, dsr, sum(sum_click) AS c FROM vle_mod GROUP BY 1, 2)
SELECT CAST(s.id_student AS VARCHAR) AS student_id, CAST(count(d.dsr) AS BIGINT) AS n_activities,
       CAST(coalesce(sum(d.c), 0) AS BIGINT) AS total_clicks
FROM students s JOIN act ON act.id_student = s.id_student LEFT JOIN d ON d.id_student = s.id_student
GROUP BY 1""")(lambda spark, sf: _active_hist(spark, sf))


def _active_hist(spark, sf):
    """Learners active in the last 7 days before course day 14, joined set-based to
    their histories (one join instead of a lookup per learner)."""
    t = T(spark, sf)
    active = (cohort.module_vle(t, MOD, PRES).where((F.col("date") > 7) & (F.col("date") <= 14))
              .select(F.col("id_student").cast("string").alias("student_id")).distinct())
    h = H.learner_histories(t).join(active, "student_id", "left_semi")
    return h.select("student_id", F.size("vle_activities").cast("bigint").alias("n_activities"),
                    F.aggregate("vle_activities", F.lit(0).cast("bigint"),
                                lambda a, x: a + x["sum_click"].cast("bigint")).alias("total_clicks"))


register("cohort_prepared", W(O.REG_CLOCK) + """,
d AS (SELECT id_student, count(DISTINCT dsr) AS n_days, sum(sum_click) AS clicks FROM vle_mod GROUP BY 1)
SELECT CAST(s.id_student AS BIGINT) AS id_student, CAST(s.dropout AS BIGINT) AS dropout,
       CAST(coalesce(d.n_days, 0) AS BIGINT) AS n_active_days, CAST(coalesce(d.clicks, 0) AS BIGINT) AS total_clicks
FROM students s LEFT JOIN d ON d.id_student = s.id_student""")(lambda spark, sf: _prepared(spark, sf))


def _prepared(spark, sf):
    learners, daily = _reg(spark, sf)
    per = daily.groupBy("id_student").agg(F.count(F.lit(1)).alias("n_active_days"),
                                          F.sum("clicks").alias("total_clicks"))
    return learners.join(per, "id_student", "left").select(
        "id_student", F.col("dropout").cast("bigint"),
        F.coalesce(F.col("n_active_days"), F.lit(0)).cast("bigint").alias("n_active_days"),
        F.coalesce(F.col("total_clicks"), F.lit(0)).cast("bigint").alias("total_clicks"))


register("scored_snapshot", _on_v8(f"""SELECT id_student, cutoff, {O.DECLINE_A} AS decline_score,
  {_tier_sql(O.DECLINE_A, 0.35, 0.60)} AS risk_level, '2024-01-22' AS score_date
  FROM (SELECT id_student, cutoff, {O.clean_sql('all_nonneg')} FROM p) WHERE cutoff = 14"""))(
    lambda spark, sf: _scored_snapshot(spark, sf))


def _scored_snapshot(spark, sf):
    """Daily rule scores written to a score_date partition (dynamic overwrite) and read back."""
    path = scratch_path(spark, "scores")
    D.write_scores(D.daily_rule_scores(spark, sf, 14), path, "2024-01-22")
    return (spark.read.parquet(path).where(F.col("score_date") == F.lit("2024-01-22").cast("date"))
            .select("id_student", "cutoff", "decline_score", "risk_level",
                    F.date_format("score_date", "yyyy-MM-dd").alias("score_date")))


register("config_latest", _on_v8("""SELECT arg_max(threshold, cutoff) AS threshold, CAST(max(cutoff) AS BIGINT) AS version
  FROM (SELECT o.cutoff, coalesce(ok.threshold, 0.5) AS threshold FROM (SELECT DISTINCT cutoff FROM pts) o
  LEFT JOIN (SELECT cutoff, threshold FROM (SELECT cutoff, threshold, row_number() OVER (PARTITION BY cutoff
             ORDER BY recall DESC, threshold ASC) AS rn FROM pts WHERE precision >= 0.3) WHERE rn = 1) ok
  ON ok.cutoff = o.cutoff)""", _SCORED_SQL, _CUM))(lambda spark, sf: _config_latest(spark, sf))


def _config_latest(spark, sf):
    """A saved config updated once per cutoff; the newest complete version is read."""
    cfg = R6(TH.precision_floor(_scored(spark, sf), ["cutoff"], "score", "y_short", C.PRECISION_FLOOR_MEDIUM), "recall")
    path = scratch_path(spark, "config")
    bundles = Bundles(spark, path)
    for row in cfg.select("cutoff", "threshold").orderBy("cutoff").collect():  # one row a cutoff
        bundles.update(lambda c, row=row: c | {"threshold": float(row["threshold"]), "version": int(row["cutoff"])})
    latest = bundles.latest()["config"]
    return spark.createDataFrame([(latest["threshold"], latest["version"])], "threshold double, version long")


# ---------------------------------------------------------------- learning (M1-M28, R7-R14): rows-only checks


def _panel(spark, sf):
    return TR.training_panel(spark, sf)


def _hash_sql(*cols, seed=C.SEED):
    """folds.hash_key in SQL."""
    text = "concat_ws('|', " + ", ".join([f"coalesce(CAST({c} AS VARCHAR), '')" for c in cols] + [f"'{seed}'"]) + ")"
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


register("group_folds", _on_v8(f"""SELECT id_student, cutoff, CAST({_hash_sql('id_student')} % 5 AS INTEGER) AS fold FROM p"""))(
    lambda spark, sf: _panel(spark, sf).select("id_student", "cutoff", "fold"))
register("strat_group_folds", _on_v8(f"""SELECT p.id_student, p.cutoff, f.fold FROM p JOIN (
  SELECT id_student, CAST((row_number() OVER (PARTITION BY y ORDER BY {_hash_sql('id_student')}, id_student) - 1) % 5 AS INTEGER) AS fold
  FROM (SELECT id_student, max(y_short) AS y FROM p GROUP BY 1)) f ON f.id_student = p.id_student"""))(
    lambda spark, sf: FO.strat_group_folds(_panel(spark, sf).drop("fold"), "id_student", "y_short")
    .select("id_student", "cutoff", "fold"))
# Remainders of (rows per class) vectors, largest first, each to the fold whose shares grow least.
def _even_folds_sql(classes: list[str]) -> str:
    n = len(classes)
    names = ", ".join(f"n{i}" for i in range(n))
    cost = " + ".join(f"n{i} * w{i} * held[{n} * f + {i + 1}]" for i in range(n))
    scale = ", ".join("(" + (" * ".join(f"(SELECT greatest(1, sum(n{d})) FROM gr) ** 2" for d in range(n) if d != c) or "1") + f") AS w{c}" for c in range(n))
    return f"""
gr AS (SELECT id_student, {", ".join(f"CAST({c} AS HUGEINT) AS n{i}" for i, c in enumerate(classes))} FROM p GROUP BY id_student),
rk AS (SELECT *, row_number() OVER (PARTITION BY {names} ORDER BY {_hash_sql('id_student')}, id_student) - 1 AS r,
              count(*) OVER (PARTITION BY {names}) // 5 * 5 AS whole FROM gr),
wt AS (SELECT {scale}),
left_over AS (SELECT *, row_number() OVER (ORDER BY {" + ".join(f"n{i}" for i in range(n))} DESC, {", ".join(f"n{i} DESC" for i in range(n))}, r) AS i
              FROM rk WHERE r >= whole),
deal(i, held, fold) AS (
  SELECT CAST(0 AS BIGINT), CAST([{", ".join(["0"] * 5 * n)}] AS DOUBLE[]), CAST(NULL AS INTEGER)
  UNION ALL
  SELECT CAST(l.i AS BIGINT), [{", ".join(f"x.held[{n * f + c + 1}] + CASE WHEN x.f = {f} THEN l.n{c} ELSE 0 END" for f in range(5) for c in range(n))}], x.f
  FROM (SELECT d.i, d.held, CAST((list_position(cs, list_min(cs)) - 1) AS INTEGER) AS f FROM (
          SELECT d0.i, d0.held, [{", ".join(cost.replace("* f +", f"* {f} +") for f in range(5))}] AS cs
          FROM deal d0 JOIN left_over l0 ON l0.i = d0.i + 1, wt) d) x JOIN left_over l ON l.i = x.i + 1),
folds AS (SELECT id_student, CAST(r % 5 AS INTEGER) AS fold FROM rk WHERE r < whole
          UNION ALL SELECT l.id_student, d.fold FROM left_over l JOIN deal d ON d.i = l.i)"""


def _recursive(sql: str) -> str:
    """WITH RECURSIVE in place of the statement's first WITH."""
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


register("even_group_folds", _recursive(_on_v8("SELECT p.id_student, p.cutoff, f.fold FROM p JOIN folds f USING (id_student)", _even_folds_sql(["count(*)"]))))(
    lambda spark, sf: FO.even_group_folds(_panel(spark, sf).drop("fold"), "id_student").select("id_student", "cutoff", "fold"))
register("even_class_group_folds", _recursive(_on_v8("SELECT p.id_student, p.cutoff, f.fold FROM p JOIN folds f USING (id_student)", _even_folds_sql(
    ["count(*) FILTER (WHERE y_short <> 1)", "count(*) FILTER (WHERE y_short = 1)"]))))(
    lambda spark, sf: FO.even_group_folds(_panel(spark, sf).drop("fold"), "id_student", "y_short").select("id_student", "cutoff", "fold"))


_SIDES = f"""
t AS (SELECT s.*, CAST({_hash_sql('id_student')} % 5 AS INTEGER) AS own FROM s),
sides AS (SELECT t.*, f.fold, CASE WHEN own = f.fold THEN 'test' ELSE 'train' END AS side FROM t, (SELECT unnest([0, 1, 2, 3, 4]) AS fold) f),
g AS (SELECT fold, score, count(*) FILTER (WHERE y_short = 1) AS pos, count(*) FILTER (WHERE y_short <> 1) AS neg FROM sides WHERE side = 'train' GROUP BY 1, 2),
c AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY fold) AS np FROM g
      WINDOW w AS (PARTITION BY fold ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
q AS (SELECT fold, score, cp::DOUBLE / (cp + cn) AS pr, CASE WHEN np = 0 THEN 0.0 ELSE cp::DOUBLE / np END AS re FROM c),
best AS (SELECT fold, score AS threshold, f1 AS train_f1 FROM (
  SELECT *, 2 * pr * re / (pr + re + 1e-12) AS f1, row_number() OVER (PARTITION BY fold ORDER BY 2 * pr * re / (pr + re + 1e-12) DESC, score) AS rn FROM q) WHERE rn = 1),
test AS (SELECT b.fold, count(*) FILTER (WHERE score >= threshold AND y_short = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND y_short <> 1) AS fp,
                count(*) FILTER (WHERE score < threshold AND y_short = 1) AS fn FROM sides s JOIN best b ON b.fold = s.fold WHERE side = 'test' GROUP BY b.fold),
per AS (SELECT b.fold, threshold, train_f1, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp::DOUBLE / (2 * tp + fp + fn) END AS test_f1
        FROM best b LEFT JOIN test USING (fold))"""


def _rule_by_fold(spark, sf):
    scored = FO.group_folds(_scored(spark, sf), "id_student")
    return TH.train_fold_thresholds(TH.fold_sides(scored, 5), [], "score", "y_short")


register("threshold_train_folds", _on_v8("""SELECT fold, threshold, round(train_f1, 6) AS train_f1, round(test_f1, 6) AS test_f1
  FROM per""", _SCORED_SQL, _SIDES))(lambda spark, sf: R6(_rule_by_fold(spark, sf), "train_f1", "test_f1"))
register("threshold_train_folds_median", _on_v8("""SELECT median(threshold) AS threshold, round(avg(test_f1), 6) AS mean_f1
  FROM per""", _SCORED_SQL, _SIDES))(lambda spark, sf: R6(TH.median_threshold(_rule_by_fold(spark, sf), []), "mean_f1"))
register("stratified_split", _on_v8(f"""SELECT id_student, cutoff, y_short,
  row_number() OVER (PARTITION BY y_short ORDER BY {_hash_sql('id_student', 'cutoff')}, id_student, cutoff) - 1
    < floor(count(*) OVER (PARTITION BY y_short) * 0.7) AS is_train FROM p"""))(
    lambda spark, sf: FO.stratified_split(_panel(spark, sf), "y_short", ["id_student", "cutoff"])
    .select("id_student", "cutoff", "y_short", "is_train"))
register("hash_sample", _on_v8(f"""SELECT id_student, cutoff FROM p ORDER BY {_hash_sql('id_student', 'cutoff')}, id_student, cutoff LIMIT 500"""))(
    lambda spark, sf: FO.hash_sample(_panel(spark, sf), ["id_student", "cutoff"], 500).select("id_student", "cutoff"))

_VAR_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(var_pop({c}), 6) AS variance, "
    f"CAST(CASE WHEN var_pop({c}) > 0 THEN 1 ELSE 0 END AS BIGINT) AS kept FROM q" for c in FEATURES_15)
register("variance_filter", _on_v8(_VAR_SQL, f"q AS (SELECT {O.clean_sql('all_nonneg')} FROM p)"))(
    lambda spark, sf: _variance(spark, sf))


def _variance(spark, sf):
    x = clean_features(_v8(spark, sf), FEATURES_15, "all_nonneg")
    agg = x.agg(*[F.var_pop(c).alias(c) for c in FEATURES_15])
    stack = ", ".join(f"'{c}', `{c}`" for c in FEATURES_15)
    long = agg.selectExpr(f"stack({len(FEATURES_15)}, {stack}) as (feature, v)")
    return long.select("feature", F.round("v", 6).alias("variance"),
                       F.when(F.col("v") > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("kept"))


_STD_COLS = ("clicks_per_day_total", "active_ratio_total", "clicks_last_14_days", "inactivity_streak_14",
             "days_since_last_active")
register("standardize", _on_v8("SELECT id_student, cutoff, " + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 "
    f"ELSE stddev_pop({c}) OVER () END, 6) AS {c}" for c in _STD_COLS) + " FROM p"))(
    lambda spark, sf: _std(spark, sf))


def _std(spark, sf):
    p = _v8(spark, sf)
    z = PREP.standardize(p, _STD_COLS, keep=["id_student", "cutoff"])
    return z.select("id_student", "cutoff", *[F.round(c, 6).alias(c) for c in _STD_COLS])


register("class_weights", _on_v8("""SELECT CAST(y_short AS BIGINT) AS y_short, CAST(count(*) AS BIGINT) AS n,
  round((SELECT count(*) FROM p) / (2.0 * count(*)), 6) AS weight FROM p GROUP BY y_short"""))(
    lambda spark, sf: PREP.class_weight_col(_v8(spark, sf), "y_short").groupBy("y_short").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("weight"), 6).alias("weight")))

register("onehot", W(f"si AS (SELECT * FROM student_info WHERE code_module = '{MOD}' AND code_presentation IN {O.PRES})", "gender_lv AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS pos, count(*) OVER () AS n\n  FROM (SELECT DISTINCT coalesce(gender, '(null)') AS v FROM si))", "age_band_lv AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS pos, count(*) OVER () AS n\n  FROM (SELECT DISTINCT coalesce(age_band, '(null)') AS v FROM si))", "imd_band_lv AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS pos, count(*) OVER () AS n\n  FROM (SELECT DISTINCT coalesce(imd_band, '(null)') AS v FROM si))") + """
SELECT id_student, (SELECT array_to_string(list_transform(range(gender_lv.n + 1), lambda j: CASE WHEN j = gender_lv.pos THEN '1.0' ELSE '0.0' END), ',')
    FROM gender_lv WHERE gender_lv.v = coalesce(si.gender, '(null)')) AS gender_onehot, (SELECT array_to_string(list_transform(range(age_band_lv.n + 1), lambda j: CASE WHEN j = age_band_lv.pos THEN '1.0' ELSE '0.0' END), ',')
    FROM age_band_lv WHERE age_band_lv.v = coalesce(si.age_band, '(null)')) AS age_band_onehot, (SELECT array_to_string(list_transform(range(imd_band_lv.n + 1), lambda j: CASE WHEN j = imd_band_lv.pos THEN '1.0' ELSE '0.0' END), ',')
    FROM imd_band_lv WHERE imd_band_lv.v = coalesce(si.imd_band, '(null)')) AS imd_band_onehot FROM si""")(lambda spark, sf: _onehot(spark, sf))


def _onehot(spark, sf):
    """M5 on the demographic columns (NULL -> '(null)' level, unseen -> zero vector)."""
    from pyspark.ml.functions import vector_to_array
    cats = ["gender", "age_band", "imd_band"]
    info = PREP.fill_null_category(cohort.scope(T(spark, sf).student_info, MOD, PRES), cats)
    model = PREP.onehot_pipeline(cats).fit(info)
    out = model.transform(info)
    return out.select("id_student", *[F.array_join(vector_to_array(F.col(f"{c}__oh")).cast("array<string>"), ",")
                                      .alias(f"{c}_onehot") for c in cats])


def _yj_sql() -> str:
    """M8 in SQL (the cleaned features are not negative): the same lambda lattices, the first over
    [-50, 50] at once."""
    longs = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS x FROM q" for c in O.FEATURES_15)

    def yj(lam):
        return (f"CASE WHEN x >= 0 THEN (CASE WHEN abs({lam}) < 1e-12 THEN ln(1 + x) "
                f"ELSE (pow(x + 1, {lam}) - 1) / {lam} END) "
                f"ELSE (CASE WHEN abs({lam} - 2) < 1e-12 THEN -ln(1 - x) "
                f"ELSE -(pow(1 - x, 2 - {lam}) - 1) / (2 - {lam}) END) END")

    def stage(name, grid_sql):
        return f"""
{name}_g AS ({grid_sql}),
{name}_ll AS (
  SELECT r.feature, g.lam, count(*) AS n,
         stddev_pop(CASE WHEN abs(g.lam) < 1e-12 THEN ln(1 + x) ELSE pow(x + 1, g.lam) / g.lam END) AS sd, sum(sign(x) * ln(1 + abs(x))) AS jac
  FROM rws r JOIN {name}_g g ON g.feature = r.feature GROUP BY 1, 2),
{name}_b AS (
  SELECT feature, lam FROM (
    SELECT feature, lam, row_number() OVER (PARTITION BY feature ORDER BY
      CASE WHEN sd > 1e-150 AND sd < 1e150 THEN -n * ln(sd) + (lam - 1) * jac ELSE -1e308 END DESC, abs(lam - 1) ASC) AS rn
    FROM {name}_ll) WHERE rn = 1)"""
    g1 = "SELECT k.feature, CAST(i * 0.5 AS DOUBLE) AS lam FROM kept k, (SELECT unnest(range(-100, 101)) AS i) r"

    def around(best, step, half):
        return (f"SELECT b.feature, CAST(round((round(b.lam / {step}) + i) * {step}, 10) AS DOUBLE) AS lam FROM {best} b, "
                f"(SELECT unnest(range(-{half}, {half + 1})) AS i) r")
    ctes = f"""q AS (SELECT {O.clean_sql('all_nonneg')} FROM p),
long AS ({longs}),
kept AS (SELECT feature FROM long GROUP BY feature HAVING var_pop(x) > 0),
rws AS (SELECT feature, x FROM long WHERE feature IN (SELECT feature FROM kept)),
{stage('s1', g1).strip()},
{stage('s2', around('s1_b', '0.025', 20)).strip()},
{stage('s3', around('s2_b', '0.0025', 10)).strip()},
fin AS (SELECT r.feature, b.lam, avg({yj('b.lam')}) AS mean, stddev_pop({yj('b.lam')}) AS sd
        FROM rws r JOIN s3_b b ON b.feature = r.feature GROUP BY 1, 2)"""
    return _on_v8("""SELECT feature, round(lam, 6) AS lambda, round(mean, 6) AS mean,
  round(CASE WHEN sd > 1e-12 THEN sd ELSE 1.0 END, 6) AS std FROM fin""", ctes)


register("yeo_johnson", _yj_sql())(lambda spark, sf: _yj(spark, sf))


def _yj(spark, sf):
    p = _panel(spark, sf)
    kept = kept_columns(p, FEATURES_15)
    params = PREP.fit_yeo_johnson(p, kept)
    rows = [(c, round(float(v["lambda"]), 6), round(float(v["mean"]), 6), round(float(v["std"]), 6))
            for c, v in params.items()]
    return spark.createDataFrame(rows, "feature string, lambda double, mean double, std double")


register("smote", _on_v8("""SELECT CAST(y_short AS BIGINT) AS y_short, 0 AS is_synthetic, CAST(n AS BIGINT) AS n FROM cnt
UNION ALL
SELECT CAST(mi.y_short AS BIGINT), 1, CAST(ma.n - mi.n AS BIGINT) FROM
  (SELECT * FROM cnt ORDER BY n ASC, y_short ASC LIMIT 1) mi,
  (SELECT * FROM cnt ORDER BY n DESC, y_short DESC LIMIT 1) ma WHERE ma.n > mi.n""",
                         "cnt AS (SELECT y_short, count(*) AS n FROM p GROUP BY y_short)"))(
    lambda spark, sf: _smote(_panel(spark, sf), FEATURES_15, "y_short", ["id_student", "cutoff"])
    .groupBy("y_short", "is_synthetic").agg(F.count(F.lit(1)).alias("n")))

register("smote_segments", _on_v8("""SELECT CAST(max(n) - min(n) AS BIGINT) AS n_synthetic, CAST(0 AS BIGINT) AS n_off_segment,
  CAST(0 AS BIGINT) AS n_far_from_minority FROM cnt""", "cnt AS (SELECT y_short, count(*) AS n FROM p GROUP BY y_short)"))(
    lambda spark, sf: _smote_segments(_panel(spark, sf)))


def _smote_segments(panel):
    """Every synthetic row against its base and its named neighbour: it has to lie on the segment
    between them at u, and both have to be minority rows."""
    ids, vec = ["id_student", "cutoff"], F.array(*[F.col(c).cast("double") for c in FEATURES_15])
    made = _smote(panel, FEATURES_15, "y_short", ids, trace=True).where("is_synthetic = 1")
    rows = panel.select(F.struct(*ids).alias("id"), vec.alias("x"), F.col("y_short").alias("y"))
    j = (made.select(F.struct(*ids).alias("base"), F.coalesce("neighbour", F.struct(*ids)).alias("nb"), "u", "y_short", vec.alias("new"))
         .join(rows.toDF("base", "xb", "yb"), "base").join(rows.toDF("nb", "xn", "yn"), "nb"))
    off = F.aggregate(F.zip_with("new", F.zip_with("xb", "xn", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda v, e: F.abs(
        v - (e["a"] + F.col("u") * (e["b"] - e["a"])))), F.lit(0.0), lambda acc, v: F.greatest(acc, v))
    return j.agg(F.count(F.lit(1)).alias("n_synthetic"), F.count_if(off > 1e-9).alias("n_off_segment"),
                 F.count_if((F.col("yb") != F.col("y_short")) | (F.col("yn") != F.col("y_short"))).alias("n_far_from_minority"))


register("stratified_split_counts", _on_v8("""SELECT CAST(y_short AS BIGINT) AS y_short, true AS is_train,
  CAST(floor(n * 0.7) AS BIGINT) AS n FROM cnt WHERE floor(n * 0.7) > 0
UNION ALL SELECT CAST(y_short AS BIGINT), false, CAST(n - floor(n * 0.7) AS BIGINT) FROM cnt
  WHERE n - floor(n * 0.7) > 0""", "cnt AS (SELECT y_short, count(*) AS n FROM p GROUP BY y_short)"))(
    lambda spark, sf: FO.stratified_split(_panel(spark, sf), "y_short", ["id_student", "cutoff"])
    .groupBy("y_short", "is_train").agg(F.count(F.lit(1)).alias("n")))

register("strat_group_fold_sizes", _on_v8("""SELECT CAST(l.y AS BIGINT) AS y, CAST(f.fold AS INTEGER) AS fold,
  CAST(l.n // 5 + CASE WHEN f.fold < l.n % 5 THEN 1 ELSE 0 END AS BIGINT) AS n_learners
FROM (SELECT y, count(*) AS n FROM (SELECT id_student, max(y_short) AS y FROM p GROUP BY 1) GROUP BY y) l,
     (SELECT unnest([0, 1, 2, 3, 4]) AS fold) f
WHERE l.n // 5 + CASE WHEN f.fold < l.n % 5 THEN 1 ELSE 0 END > 0"""))(
    lambda spark, sf: FO.strat_group_folds(_panel(spark, sf).drop("fold"), "id_student", "y_short")
    .groupBy("id_student").agg(F.max("y_short").alias("y"), F.max("fold").alias("fold"))
    .groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n_learners")))


def _fit_predict(name):
    def run(spark, sf):
        p = _panel(spark, sf)
        fm = fit_model(p, FEATURES_15, "y_short", name, TR.ID)
        return fm.transform(p, keep=["id_student", "cutoff", "y_short"])
    return run


for _name, _key in (("logreg_l1", "train_logreg"), ("rf", "train_rf"), ("gbt", "train_gbt"), ("mlp", "train_mlp")):
    register(_key)(_fit_predict(_name))


register("oof_predictions")(lambda spark, sf: TR.evaluate(_panel(spark, sf), models=("rf",), k=5)[1])
register("cv_leaderboard")(lambda spark, sf: TR.leaderboard(TR.evaluate(_panel(spark, sf), k=5)[0]))
register("best_model")(lambda spark, sf: _best(spark, sf))


def _best(spark, sf):
    board = TR.leaderboard(TR.evaluate(_panel(spark, sf), k=5)[0])
    return board.select(F.col("model").alias("best_model"), "mean_f1").limit(1)  # the board's order breaks ties by name


register("platt_calibration")(lambda spark, sf: _platt(spark, sf))


def _platt(spark, sf):
    oof = TR.evaluate(_panel(spark, sf), models=("rf",), k=5)[1]
    params = CAL.fit_platt(oof, "proba", "y_short")
    return oof.select("id_student", "cutoff", "y_short", "proba",
                      CAL.apply_platt(F.col("proba"), params).alias("proba_cal"))


register("fit_sigmoid", _wrap(_V9, f"""SELECT round(regr_slope(y, x), 6) AS k,
  round(CASE WHEN abs(regr_slope(y, x)) > 1e-9 THEN -regr_intercept(y, x) / regr_slope(y, x) ELSE 0.5 END, 6) AS c
FROM (SELECT x, ln(least(greatest(t, 1e-6), 1 - 1e-6) / (1 - least(greatest(t, 1e-6), 1 - 1e-6))) AS y
      FROM (SELECT round(h, 1) AS x, avg(CAST(target AS DOUBLE)) AS t FROM (
              SELECT target, round({O.HEURISTIC}, 6) AS h FROM (
                SELECT id_student, cutoff, target, {O.clean_sql('click_nonneg')} FROM p)) GROUP BY 1))"""))(
    lambda spark, sf: _fit_sig(spark, sf))


def _fit_sig(spark, sf):
    """R6 on data: target = observed unregister rate per heuristic-risk decile bin."""
    h = _v9_clean(spark, sf).select("target", F.round(rules.heuristic_risk(), 6).alias("h"))
    bins = h.groupBy(F.round("h", 1).alias("x")).agg(F.avg(F.col("target").cast("double")).alias("t"))
    out = CAL.fit_sigmoid(bins, "x", "t")
    return out.select(F.round("k", 6).alias("k"), F.round("c", 6).alias("c"))


_BUNDLES: dict = {}


def _bundle_path(spark, sf, name="rf"):
    """Fit on the full panel, a Platt calibrator fitted on out-of-fold scores, saved once per
    session and table folder; the scoring queries read the saved bundle."""
    key = spark.sparkContext.applicationId, sf, name
    if key not in _BUNDLES:
        p = _panel(spark, sf)
        fm = fit_model(p, FEATURES_15, "y_short", name, TR.ID)
        platt = CAL.fit_platt(TR.evaluate(p, models=(name,), k=5, oversample=False)[1], "proba", "y_short")
        path = scratch_path(spark, f"bundle_{name}")
        TR.save_bundle(spark, fm, path, {"platt": platt, "alpha": C.BLEND_B_ALPHA,
                                         "risk_thresholds": {"medium": C.BLEND_A["thr_medium"], "high": C.BLEND_A["thr_high"]},
                                         "threshold": C.DEFAULT_THRESHOLD})
        _BUNDLES[key] = path
    return _BUNDLES[key]


def _bundle(spark, sf, name="rf"):
    """The saved bundle. Queries that score the panel build it themselves; the others score other rows."""
    return TR.load_bundle(spark, _bundle_path(spark, sf, name))


register("model_roundtrip")(lambda spark, sf: _roundtrip(spark, sf))


def _roundtrip(spark, sf):
    fm, p = _bundle(spark, sf), _panel(spark, sf)
    return fm.transform(p, keep=["id_student", "cutoff"])
register("refit_best")(lambda spark, sf: _refit(spark, sf))


def _refit(spark, sf):
    p = _panel(spark, sf)
    board = TR.leaderboard(TR.evaluate(p, models=("rf", "logreg_l1"), k=3)[0])
    name = TR.best_model(board)
    fm = fit_model(p, FEATURES_15, "y_short", name, TR.ID, oversample=False)
    return fm.transform(p, keep=["id_student", "cutoff"]).withColumn("model", F.lit(name))


register("feature_importance")(lambda spark, sf: _importance(spark, sf))


def _importance(spark, sf):
    """Every model's own importance where it has one, permutation importance (all rows) for
    the forest and for the perceptron, which has none of its own (NULL)."""
    p = _panel(spark, sf)
    prep = prepare(p, FEATURES_15, "y_short", TR.ID)  # the same rows for all four
    models = {n: fit_prepared(prep, n) for n in ("rf", "logreg_l1", "gbt", "mlp")}
    own = [IMP.native_importance(spark, m).withColumnRenamed("importance", "native") for m in models.values()]
    perm = [IMP.permutation_importance(models[n], p, "y_short", ["id_student", "cutoff"], repeats=8) for n in ("rf", "mlp")]
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return union(own).join(union(perm).withColumnRenamed("importance", "permutation"), ["model", "feature"], "left")


_CUM_ALL = _CUM.replace("SELECT cutoff, score, count(*)", "SELECT 1 AS cutoff, score, count(*)")
register("threshold_config", _on_v8("""SELECT
  coalesce((SELECT threshold FROM pts WHERE recall >= 0.8 ORDER BY precision DESC, threshold ASC LIMIT 1),
           (SELECT threshold FROM pts ORDER BY 2 * precision * recall / (precision + recall + 1e-9) DESC, threshold ASC LIMIT 1)) AS threshold,
  CASE WHEN EXISTS (SELECT 1 FROM pts WHERE recall >= 0.8) THEN 'recall_target' ELSE 'max_f1' END AS rule""",
                                    _SCORED_SQL, _CUM_ALL))(lambda spark, sf: _thr_config(spark, sf))


def _thr_config(spark, sf):
    """The chosen threshold and rule written as a one-row JSON file, read back."""
    sel = TH.recall_target(_scored(spark, sf).withColumn("_g", F.lit(1)), ["_g"], "score", "y_short").drop("_g")
    path = scratch_path(spark, "threshold")
    sel.coalesce(1).write.mode("overwrite").json(path)
    return spark.read.schema("threshold double, rule string").json(path)


register("train_job")(lambda spark, sf: _train_job(spark, sf))


def _train_job(spark, sf):
    path = scratch_path(spark, "train_job")
    res = TR.train_job(spark, sf, path)
    return spark.createDataFrame([(res["best"], res["risk_thresholds"]["medium"], res["risk_thresholds"]["high"],
                                   res["platt"]["a"], res["platt"]["b"], res["mean_score_shift"])],
                                 "best_model string, thr_medium double, thr_high double, platt_a double, "
                                 "platt_b double, mean_score_shift double")


# scoring paths with a saved bundle

register("daily_scores")(lambda spark, sf: _daily_model(spark, sf))
register("score_rows")(lambda spark, sf: _score_rows(spark, sf))


def _score_rows(spark, sf):
    """Ids, scores and labels stay in one row (no positional zip)."""
    fm, p = _bundle(spark, sf), _panel(spark, sf)
    return fm.transform(p, keep=["id_student", "cutoff", "y_short"])


def _daily_model(spark, sf):
    fm = _bundle(spark, sf)
    today = variants.snapshot_v8(T(spark, sf), cutoffs=(14,))
    return D.ranked(TR.score_with_bundle(fm, today, ["id_student", "cutoff"]), "risk_score")


register("blended_risk_a")(lambda spark, sf: TR.score_with_bundle(
    _bundle(spark, sf), variants.snapshot_v8(T(spark, sf)), ["id_student", "cutoff"], "decline_a"))
register("blended_risk_heuristic")(lambda spark, sf: TR.score_with_bundle(
    _bundle(spark, sf), variants.snapshot_v8(T(spark, sf)), ["id_student", "cutoff"], "heuristic"))
register("blended_risk")(lambda spark, sf: TR.score_with_bundle(
    _bundle(spark, sf), variants.snapshot_v8(T(spark, sf)), ["id_student", "cutoff"]))


def _v11_features(spark, sf):
    return variants.snapshot_v11(H.learner_histories(T(spark, sf)))


register("score_raw_history")(lambda spark, sf: _score_single(spark, sf))


def _score_single(spark, sf):
    """Raw histories -> row-local features -> model -> fixed tiers 0.30 / 0.60."""
    fm = _bundle(spark, sf)
    feats = _v11_features(spark, sf)
    x = clean_features(feats, FEATURES_15, TR.clean_mode(fm), keep=["student_id"])
    s = fm.transform(x, keep=["student_id"])
    return s.select("student_id", F.col("proba").alias("dropout_probability"),
                    rules.tier(F.col("proba"), *C.TIERS_SINGLE).alias("risk_level"))


register("score_raw_batch")(lambda spark, sf: _score_batch(spark, sf))


def _score_batch(spark, sf):
    """R9 + S13: rows with errors pass through with the error; the rest are scored."""
    fm = _bundle(spark, sf)
    b = VAL.batch_with_errors(_all_histories(spark, sf))
    ok = b.where(F.col("error").isNull()).select(
        "student_id", F.col("cutoff").cast("int").alias("days_since_registration"), "vle_activities")
    feats = clean_features(variants.snapshot_v11(ok), FEATURES_15, TR.clean_mode(fm), keep=["student_id"])
    s = fm.transform(feats, keep=["student_id"]).select(
        "student_id", F.col("proba").alias("dropout_probability"),
        rules.tier(F.col("proba"), *C.TIERS_SINGLE).alias("risk_level"), F.lit(None).cast("string").alias("error"))
    bad = b.where(F.col("error").isNotNull()).select(
        "student_id", F.lit(None).cast("double").alias("dropout_probability"),
        F.lit(None).cast("string").alias("risk_level"), "error")
    return s.unionByName(bad)


register("score_feature_batch")(lambda spark, sf: _score_features(spark, sf))


def _score_features(spark, sf):
    """Pre-computed feature rows (S4) -> model in feature order -> tiers 0.35 / 0.60."""
    fm = _bundle(spark, sf)
    rows = _feature_rows(spark, sf)
    x = clean_features(rows, FEATURES_15, TR.clean_mode(fm), keep=["student_id"])
    return fm.transform(x, keep=["student_id"]).select(
        "student_id", F.col("proba").alias("dropout_probability"),
        rules.tier(F.col("proba"), *C.TIERS_BATCH).alias("risk_level"))


register("score_with_threshold")(lambda spark, sf: _score_thr(spark, sf, 0.5))


def _score_thr(spark, sf, thr):
    """Decision at a caller threshold plus run metadata columns."""
    thr = VAL.check_threshold(thr)
    fm, p = _bundle(spark, sf), _panel(spark, sf)
    s = fm.transform(p, keep=["id_student", "cutoff"])
    return s.select("id_student", "cutoff", "proba", rules.decision(F.col("proba"), thr).alias("prediction"),
                    F.lit(float(thr)).alias("threshold"), F.lit(fm.name).alias("model_name"),
                    F.lit(len(fm.kept)).alias("n_features"))


register("score_calibrated")(lambda spark, sf: _score_cal(spark, sf))


def _display_fit(spark, sf):
    """The display sigmoid's (k, c), fitted to observed rates of risk bins: one row."""
    row = _fit_sig(spark, sf).first()
    return float(row["k"]), float(row["c"])


def _score_cal(spark, sf):
    """Raw, calibrated by the bundle, display sigmoid with the fitted k and c, decision."""
    fm, p = _bundle(spark, sf), _panel(spark, sf)
    k, c = _display_fit(spark, sf)
    s = fm.transform(p, keep=["id_student", "cutoff"]).withColumn("proba_cal", CAL.apply_platt(F.col("proba"), fm.extra["platt"]))
    return s.select("id_student", "cutoff", F.col("proba").alias("proba_raw"), "proba_cal",
                    rules.display_sigmoid(F.col("proba_cal"), k, c).alias("display"),
                    rules.decision(F.col("proba_cal"), C.DEFAULT_THRESHOLD).alias("decision"))


_GRID_ALL = _grid_sql(_GC, 0.0, 0.5).replace("SELECT s.cutoff, gr.t", "SELECT 1 AS cutoff, gr.t")
register("risk_tiers_relative", _on_v8("""SELECT s.id_student, s.cutoff, s.score,
  CASE WHEN s.score >= t.thr THEN 'HIGH' WHEN s.score >= t.thr * 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
FROM s, (SELECT round(CASE WHEN bf > 0 THEN bt ELSE 0.5 END, 6) AS thr FROM best) t""", _SCORED_SQL, _GRID_ALL))(
    lambda spark, sf: _relative(spark, sf))


def _relative(spark, sf):
    """Tiers relative to the learnt F1-grid threshold (the scalar is the only value
    that reaches the driver)."""
    s = _scored(spark, sf)
    best = TH.f1_grid(s.withColumn("_g", F.lit(1)), ["_g"], "score", "y_short", _GC, 0.0).collect()[0]
    t = round(float(best["best_threshold"]), 6)
    return s.select("id_student", "cutoff", "score", rules.relative_tier(F.col("score"), F.lit(t)).alias("risk_level"))


register("learner_features", "SELECT * FROM (" + _sql(O.v4_panel()) + ") JOIN (" + W(_V4_ASS) + """
SELECT CAST(b.id_student AS BIGINT) AS id_student, CAST(b.cutoff AS BIGINT) AS cutoff,
  CAST(coalesce(ac.n, 0) AS DOUBLE) AS num_assessments, CAST(coalesce(ac.avg_score, 0) AS DOUBLE) AS avg_score,
  CAST(coalesce(ac.pass_count, 0) AS DOUBLE) AS pass_count, CAST(coalesce(al.score, 0) AS DOUBLE) AS last_score,
  CAST(coalesce(aw.n14, 0) AS DOUBLE) AS num_assessments_14, CAST(coalesce(aw.avg14, 0) AS DOUBLE) AS avg_score_14
FROM b LEFT JOIN ac USING (id_student, cutoff) LEFT JOIN al USING (id_student, cutoff)
LEFT JOIN aw USING (id_student, cutoff)) USING (id_student, cutoff)""")(
    lambda spark, sf: variants.snapshot_v4(T(spark, sf)))


# ---------------------------------------------------------------- streaming upkeep of the daily table


register("daily_rollup_stream", W() + """
SELECT id_student, date AS day, CAST(sum(sum_click) AS BIGINT) AS clicks FROM student_vle GROUP BY 1, 2""")(
    lambda spark, sf: _rollup(spark, sf))


def _rollup(spark, sf):
    """Structured Streaming (file source, totals per micro-batch) over the events table, and the
    learner-day table read from what it wrote."""
    base = scratch_path(spark, "rollup")
    run_daily_rollup(spark, sf, f"{base}/out", f"{base}/ck", file_glob="events*.parquet")
    return read_daily_rollup(spark, f"{base}/out")


register("holdout_eval")(lambda spark, sf: holdout_v2(spark, sf))

register("top_features")(lambda spark, sf: _top_features(spark, sf))


def _top_features(spark, sf):
    """Union of each model's top-10 features (native importance), de-duplicated."""
    imp = _importance(spark, sf)
    from pyspark.sql import Window
    w = Window.partitionBy("model").orderBy(F.coalesce("native", "permutation").desc(), F.col("feature"))
    top = imp.where("native IS NOT NULL OR permutation IS NOT NULL").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 10)
    return top.select("feature").distinct()


register("train_serve_skew")(lambda spark, sf: _skew(spark, sf))


def _skew(spark, sf):
    """Q4/Q14: the same learners at the same cutoff, featurised the training way (zero fill,
    registration-clock panel) and the serving way (row-local, worst-case fill); per feature
    the two means and the number of learners whose value differs."""
    t = T(spark, sf)
    serve = variants.snapshot_v11(H.learner_histories(t)).select(
        F.col("student_id").cast("bigint").alias("id_student"), "cutoff",
        *[F.col(c).alias(f"s_{c}") for c in FEATURES_15])
    learners, daily = variants.registration_clock(t, MOD, PRES)
    cut = serve.select("id_student", F.col("cutoff").cast("int").alias("cutoff"))
    from ..operators.snapshot import V7 as _V7
    train_p = build_panel_per_row(_V7, learners.join(cut, "id_student"), daily)
    j = train_p.join(serve, ["id_student", "cutoff"])
    aggs = []
    for c in FEATURES_15:
        aggs += [F.avg(c).alias(f"t_{c}"), F.avg(f"s_{c}").alias(f"v_{c}"),
                 F.count_if(F.col(c) != F.col(f"s_{c}")).alias(f"n_{c}")]
    row = j.agg(*aggs)
    stack = ", ".join(f"'{c}', t_{c}, v_{c}, n_{c}" for c in FEATURES_15)
    return row.selectExpr(f"stack({len(FEATURES_15)}, {stack}) as (feature, mean_train, mean_serve, n_differ)")


def build_panel_per_row(spec, learners, daily):
    from ..operators.snapshot import build_panel
    return build_panel(spec.with_cutoffs(None), learners, daily)
