"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

The SQL follows the reference's own shape where it matters: one aggregate per feature
block, ``count(DISTINCT day)`` on the raw click rows (no day collapse), and a LEFT JOIN
per block, so it is an independent formulation of what the Spark operators compute with
a single conditional aggregate. Tables ``events``, ``customer``, ``nation``, ``region``
are the driver's views; the five learner tables are CTEs of the demo mapping.
"""

from __future__ import annotations

from . import config as C
from .operators.snapshot import FEATURES_15

MOD = C.MODULE
PRES = "('" + "','".join(C.PRESENTATIONS) + "')"
PRES1 = C.PRESENTATION

DEMO = f"""
ev AS (
  SELECT event_id, user_id, event_type, props,
         CAST(date_diff('day', DATE '2024-01-08', CAST(ts AS DATE)) AS INTEGER) AS d
  FROM events),
student_registration AS (
  SELECT CAST(user_id AS BIGINT) AS id_student,
         CASE WHEN user_id % 2 = 0 THEN 'AAA' ELSE 'BBB' END AS code_module,
         CASE WHEN (user_id // 2) % 2 = 0 THEN '2024A' ELSE '2024B' END AS code_presentation,
         CAST(min(CASE WHEN event_type = 'signup' THEN d END) AS INTEGER) AS date_registration,
         CAST(CASE WHEN user_id % 3 = 0 THEN 8 + (user_id * 7) % 14 END AS INTEGER) AS date_unregistration
  FROM ev GROUP BY user_id),
student_info AS (
  SELECT r.code_module, r.code_presentation, r.id_student,
         CASE WHEN r.id_student % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
         n.n_name AS region, g.r_name AS highest_education,
         CASE WHEN c.c_acctbal < 0 THEN NULL WHEN c.c_acctbal < 5000 THEN '0-50%' ELSE '50-100%' END AS imd_band,
         c.c_mktsegment AS age_band,
         CAST((r.id_student // 4) % 3 AS INTEGER) AS num_of_prev_attempts,
         CAST(30 + 30 * (r.id_student % 5) AS INTEGER) AS studied_credits,
         CASE WHEN r.id_student % 10 = 0 THEN 'Y' ELSE 'N' END AS disability,
         CASE WHEN r.date_unregistration IS NOT NULL THEN 'Withdrawn' ELSE 'Pass' END AS final_result
  FROM student_registration r
  LEFT JOIN customer c ON c.c_custkey = r.id_student
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region g ON n.n_regionkey = g.r_regionkey),
student_vle AS (
  SELECT CAST(user_id AS BIGINT) AS id_student,
         CASE WHEN user_id % 2 = 0 THEN 'AAA' ELSE 'BBB' END AS code_module,
         CASE WHEN (user_id // 2) % 2 = 0 THEN '2024A' ELSE '2024B' END AS code_presentation,
         event_id % 5 AS id_site, d AS date,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS sum_click
  FROM ev WHERE event_type = 'click'),
student_assessment AS (
  SELECT event_id % 7 AS id_assessment, CAST(user_id AS BIGINT) AS id_student,
         CASE WHEN event_id % 13 = 0 THEN NULL ELSE d END AS date_submitted,
         0 AS is_banked,
         CASE WHEN event_id % 11 = 0 THEN NULL
              ELSE CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS DOUBLE) END AS score,
         event_id AS id_submission
  FROM ev WHERE event_type = 'purchase'),
assessments AS (
  SELECT CASE WHEN id_assessment % 2 = 0 THEN 'AAA' ELSE 'BBB' END AS code_module,
         p.code_presentation, id_assessment
  FROM (SELECT DISTINCT id_assessment FROM student_assessment) a,
       (SELECT unnest(['2024A', '2024B']) AS code_presentation) p)"""


# The same tables with a second registration for every fifth learner.
DEMO_REPEATS = DEMO.replace("student_registration AS (", "first_registration AS (", 1).replace("""FROM ev GROUP BY user_id),
""", """FROM ev GROUP BY user_id),
student_registration AS (
  SELECT * FROM first_registration
  UNION ALL
  SELECT id_student, code_module, CASE code_presentation WHEN '2024A' THEN '2024B' ELSE '2024A' END,
         CAST(date_registration + CASE WHEN id_student % 10 = 0 THEN 0 ELSE 3 END AS INTEGER),
         CAST(CASE WHEN date_unregistration IS NULL THEN 20 END AS INTEGER)
  FROM first_registration WHERE id_student % 5 = 0),
""", 1)


def with_demo(*ctes: str, repeats: bool = False) -> str:
    """WITH <demo tables>, <extra ctes>"""
    parts = [(DEMO_REPEATS if repeats else DEMO).strip()] + [c.strip() for c in ctes if c]
    return "WITH " + ",\n".join(parts)


# Registration-clock cohort (P12) for the multi-presentation scope.
REG_CLOCK = f"""
reg_lookup AS (
  SELECT DISTINCT id_student, date_registration FROM student_registration
  WHERE code_module = '{MOD}' AND code_presentation IN {PRES}),
students AS (
  SELECT DISTINCT id_student, CASE WHEN final_result = 'Withdrawn' THEN 1 ELSE 0 END AS dropout
  FROM student_info
  WHERE code_module = '{MOD}' AND code_presentation IN {PRES}
    AND id_student IN (SELECT id_student FROM reg_lookup)),
vle_mod AS (
  SELECT v.id_student, v.date - r.date_registration AS dsr, v.sum_click
  FROM student_vle v JOIN reg_lookup r ON v.id_student = r.id_student
  WHERE v.code_module = '{MOD}' AND v.code_presentation IN {PRES}
    AND r.date_registration IS NOT NULL AND v.date - r.date_registration >= 0)"""

COURSE_COHORT = f"""
valid_ids AS (
  SELECT DISTINCT id_student FROM student_registration
  WHERE code_module = '{MOD}' AND code_presentation IN {PRES} AND date_registration <= 0),
students AS (
  SELECT id_student, CASE WHEN final_result = 'Withdrawn' THEN 1 ELSE 0 END AS dropout
  FROM student_info
  WHERE code_module = '{MOD}' AND code_presentation IN {PRES}
    AND id_student IN (SELECT id_student FROM valid_ids)),
vle_mod AS (
  SELECT id_student, date AS dsr, sum_click FROM student_vle
  WHERE code_module = '{MOD}' AND code_presentation IN {PRES}
    AND id_student IN (SELECT id_student FROM students))"""


def cutoffs_cte(cutoffs) -> str:
    return "cut AS (SELECT unnest([" + ", ".join(str(int(c)) for c in cutoffs) + "]) AS cutoff)"


def panel_sql(*, cohort: str, cutoffs, base_from: str = "students s, cut c", base_cols: str = "s.id_student",
              window: int = 14, half: int = 7, clamp: bool = True, halves: str = "split",
              recent: int = 7, den: str = "greatest(b.cutoff, 1)", wden: int = 14,
              fill: str = "zero", label: str | None = None, horizon: int = 0,
              eligible: bool = False, clip: bool = False, elapsed: str = "days_elapsed_since_reg",
              label_name: str = "y_short", extra_select: str = "", base_where: str = "",
              cut_cte: str | None = None,
              id_out: str = "CAST(b.id_student AS BIGINT) AS id_student") -> str:
    """Reference-shaped panel: per-block aggregates over vle_mod joined back to the base."""
    ws = "greatest(0, c.cutoff - %d)" % (window - 1) if clamp else "c.cutoff - %d" % (window - 1)
    if halves == "split":
        fe = f"least(c.cutoff, {ws} + {half - 1})"
        ss = f"least(c.cutoff, least(c.cutoff, {ws} + {half - 1}) + 1)"
    else:
        fe = f"c.cutoff - {half}"
        ss = f"c.cutoff - {half} + 1"
    elig = ""
    if eligible:
        elig = f"""
maxday AS (SELECT id_student, max(dsr) AS md FROM vle_mod GROUP BY id_student),"""
    where = []
    if eligible:
        where.append(f"coalesce((SELECT md FROM maxday m WHERE m.id_student = s.id_student), -1) >= c.cutoff + {horizon}")
    if base_where:
        where.append(base_where)
    wsql = ("WHERE " + " AND ".join(where)) if where else ""
    ctes = f"""{cohort.strip()},
{cut_cte or cutoffs_cte(cutoffs)},{elig}
b AS (
  SELECT {base_cols}, c.cutoff, {ws} AS ws, {fe} AS fe, {ss} AS ss
  FROM {base_from} {wsql}),
kb AS (SELECT DISTINCT id_student, cutoff, ws, fe, ss FROM b),
cum AS (
  SELECT b.id_student, b.cutoff, sum(v.sum_click) AS total_clicks, count(DISTINCT v.dsr) AS active_days_total,
         max(v.dsr) AS last_active
  FROM kb b JOIN vle_mod v ON v.id_student = b.id_student AND v.dsr <= b.cutoff GROUP BY 1, 2),
win AS (
  SELECT b.id_student, b.cutoff, sum(v.sum_click) AS clicks_last_14_days, count(DISTINCT v.dsr) AS active_days_14,
         max(v.dsr) AS last_win
  FROM kb b JOIN vle_mod v ON v.id_student = b.id_student AND v.dsr <= b.cutoff AND v.dsr >= b.ws GROUP BY 1, 2),
h1 AS (
  SELECT b.id_student, b.cutoff, sum(v.sum_click) AS clicks_0_7
  FROM kb b JOIN vle_mod v ON v.id_student = b.id_student AND v.dsr >= b.ws AND v.dsr <= b.fe AND v.dsr <= b.cutoff
  GROUP BY 1, 2),
h2 AS (
  SELECT b.id_student, b.cutoff, sum(v.sum_click) AS clicks_8_14
  FROM kb b JOIN vle_mod v ON v.id_student = b.id_student AND v.dsr >= b.ss AND v.dsr <= b.cutoff AND v.dsr >= b.ws
  GROUP BY 1, 2),
l7 AS (
  SELECT b.id_student, b.cutoff, sum(v.sum_click) AS clicks_last_7_days
  FROM kb b JOIN vle_mod v ON v.id_student = b.id_student AND v.dsr <= b.cutoff AND v.dsr > b.cutoff - {recent}
  GROUP BY 1, 2),
fut AS (
  SELECT b.id_student, b.cutoff, sum(v.sum_click) AS fc, count(DISTINCT v.dsr) AS fd
  FROM kb b JOIN vle_mod v ON v.id_student = b.id_student AND v.dsr > b.cutoff AND v.dsr <= b.cutoff + {max(horizon, 0)}
  GROUP BY 1, 2)"""
    worst = fill == "worst_case"
    since_fill = "b.cutoff" if worst else "0"
    streak_fill = str(window) if worst else "0"
    den_sql = den
    ar_total = f"coalesce(cum.active_days_total, 0) / {den_sql}"
    ar_14 = f"coalesce(win.active_days_14, 0) / {wden}"
    if clip:
        ar_total = f"least(greatest({ar_total}, 0), 1)"
        ar_14 = f"least(greatest({ar_14}, 0), 1)"
    lab = ""
    if label == "silent":
        lab = f"CAST(CASE WHEN coalesce(fut.fd, 0) = 0 THEN 1 ELSE 0 END AS BIGINT) AS {label_name},"
    elif label == "low_activity":
        lab = (f"CAST(CASE WHEN coalesce(fut.fd, 0) <= {C.LOW_ACTIVITY_MAX_DAYS} OR coalesce(fut.fc, 0) <= "
               f"{C.LOW_ACTIVITY_MAX_CLICKS} THEN 1 ELSE 0 END AS BIGINT) AS {label_name},")
    elif label == "withdrawn":
        lab = f"CAST(b.dropout AS BIGINT) AS {label_name},"
    elif label == "unregister":
        lab = (f"CAST(CASE WHEN b.unreg > b.cutoff AND b.unreg <= b.cutoff + {horizon} THEN 1 ELSE 0 END AS BIGINT)"
               f" AS {label_name},")
    h1v = "CAST(coalesce(h1.clicks_0_7, 0) AS DOUBLE)"
    h2v = "CAST(coalesce(h2.clicks_8_14, 0) AS DOUBLE)"
    select = f"""
SELECT {id_out}, CAST(b.cutoff AS BIGINT) AS cutoff, {extra_select} {lab}
  CAST(b.cutoff AS DOUBLE) AS {elapsed},
  CAST(coalesce(cum.total_clicks, 0) AS DOUBLE) / {den_sql} AS clicks_per_day_total,
  CAST({ar_total} AS DOUBLE) AS active_ratio_total,
  CASE WHEN coalesce(cum.active_days_total, 0) > 0
       THEN CAST(cum.total_clicks AS DOUBLE) / cum.active_days_total ELSE 0.0 END AS avg_clicks_per_active_day_total,
  CAST(CASE WHEN cum.last_active IS NULL THEN {since_fill} ELSE b.cutoff - cum.last_active END AS DOUBLE)
       AS days_since_last_active,
  CAST(coalesce(win.clicks_last_14_days, 0) AS DOUBLE) AS clicks_last_14_days,
  CAST(coalesce(win.active_days_14, 0) AS DOUBLE) AS active_days_14,
  CAST(coalesce(win.clicks_last_14_days, 0) AS DOUBLE) / {wden} AS clicks_per_day_14,
  CAST({ar_14} AS DOUBLE) AS active_ratio_14,
  CAST(coalesce(l7.clicks_last_7_days, 0) AS DOUBLE) AS clicks_last_7_days,
  {h1v} AS clicks_0_7,
  {h2v} AS clicks_8_14,
  {h2v} - {h1v} AS trend_click_14,
  ({h2v} + 1) / ({h1v} + 1) AS ratio_click_14,
  CAST(CASE WHEN win.last_win IS NULL THEN {streak_fill} ELSE b.cutoff - win.last_win END AS DOUBLE)
       AS inactivity_streak_14
FROM b
LEFT JOIN cum ON cum.id_student = b.id_student AND cum.cutoff = b.cutoff
LEFT JOIN win ON win.id_student = b.id_student AND win.cutoff = b.cutoff
LEFT JOIN h1 ON h1.id_student = b.id_student AND h1.cutoff = b.cutoff
LEFT JOIN h2 ON h2.id_student = b.id_student AND h2.cutoff = b.cutoff
LEFT JOIN l7 ON l7.id_student = b.id_student AND l7.cutoff = b.cutoff
LEFT JOIN fut ON fut.id_student = b.id_student AND fut.cutoff = b.cutoff"""
    return ctes, select


def panel_query(**kw) -> str:
    ctes, select = panel_sql(**kw)
    return with_demo(ctes) + select


def v4_panel(cutoffs=C.CUTOFFS_COURSE):
    return panel_sql(cohort=COURSE_COHORT, cutoffs=cutoffs, base_cols="s.id_student, s.dropout",
                     label="withdrawn", label_name="dropout", elapsed="days_elapsed_program")


# V5-V8 take every id once.
UNIQUE_IDS = "(SELECT DISTINCT id_student FROM students) s, cut c"


def v8_panel(cutoffs=C.CUTOFFS_REG):
    return panel_sql(cohort=REG_CLOCK, cutoffs=cutoffs, base_from=UNIQUE_IDS, den="(b.cutoff + 1)", label="low_activity",
                     horizon=14, clip=True)


def reg_panel(label, horizon, cutoffs=C.CUTOFFS_REG, eligible=False):
    return panel_sql(cohort=REG_CLOCK, cutoffs=cutoffs, base_from=UNIQUE_IDS, label=label, horizon=horizon, eligible=eligible)


# One learner per registration: the id of the shared blocks is the pair (id, presentation).
COMPOSITE = f"""
reg_lookup AS (
  SELECT DISTINCT id_student || '/' || code_presentation AS id_student, date_registration FROM student_registration
  WHERE code_module = '{MOD}' AND code_presentation IN {PRES}),
students AS (
  SELECT DISTINCT id_student || '/' || code_presentation AS id_student FROM student_info
  WHERE code_module = '{MOD}' AND code_presentation IN {PRES}
    AND id_student || '/' || code_presentation IN (SELECT id_student FROM reg_lookup)),
vle_mod AS (
  SELECT r.id_student, v.date - r.date_registration AS dsr, v.sum_click
  FROM student_vle v JOIN reg_lookup r ON v.id_student || '/' || v.code_presentation = r.id_student
  WHERE v.code_module = '{MOD}' AND v.code_presentation IN {PRES}
    AND r.date_registration IS NOT NULL AND v.date - r.date_registration >= 0)"""


def v8_composite(cutoffs=C.CUTOFFS_REG):
    return panel_sql(cohort=COMPOSITE, cutoffs=cutoffs, base_from=UNIQUE_IDS, den="(b.cutoff + 1)", label="low_activity", horizon=14, clip=True,
                     id_out=f"CAST(split_part(b.id_student, '/', 1) AS BIGINT) AS id_student, '{MOD}' AS code_module, "
                            "split_part(b.id_student, '/', 2) AS code_presentation")


V9_COHORT = f"""
reg_lookup AS (
  SELECT DISTINCT id_student, coalesce(date_registration, 0) AS date_registration,
         coalesce(date_unregistration, 999) AS unreg
  FROM student_registration WHERE code_module = '{MOD}' AND code_presentation IN {PRES}),
students AS (SELECT id_student, unreg FROM reg_lookup),
vle_mod AS (
  SELECT v.id_student, v.date - r.date_registration AS dsr, v.sum_click
  FROM student_vle v JOIN reg_lookup r ON v.id_student = r.id_student
  WHERE v.date - r.date_registration >= 0)"""


def v9_panel(cutoffs=C.CUTOFFS_UNREG):
    return panel_sql(cohort=V9_COHORT, cutoffs=cutoffs, base_cols="s.id_student, s.unreg", clamp=False,
                     halves="tail", label="unregister", horizon=14, clip=True, label_name="target",
                     base_where="s.unreg > c.cutoff")


V11_COHORT = f"""
reg_lookup AS (
  SELECT DISTINCT id_student, date_registration FROM student_registration
  WHERE code_module = '{MOD}' AND code_presentation IN {PRES} AND date_registration IS NOT NULL),
students AS (SELECT id_student, CAST(14 - date_registration AS INTEGER) AS dsr_today FROM reg_lookup),
vle_mod AS (
  SELECT v.id_student, v.date - r.date_registration AS dsr, v.sum_click
  FROM student_vle v JOIN reg_lookup r ON v.id_student = r.id_student
  WHERE v.code_module = '{MOD}' AND v.code_presentation IN {PRES})"""


def v11_panel():
    return panel_sql(cohort=V11_COHORT, cutoffs=(), fill="worst_case",
                     cut_cte="cut AS (SELECT id_student AS cid, dsr_today AS cutoff FROM students)",
                     base_from="students s JOIN cut c ON c.cid = s.id_student",
                     id_out="CAST(b.id_student AS VARCHAR) AS student_id")


def early_sql(*, start: int, end: int, per_day: int, bands, recency: bool = True, pass_rate: bool = True,
              extra=(), cats=("gender", "age_band"), presentation: str = PRES1, fill_min_std: bool = False) -> str:
    """Single-window learner snapshot, block by block as the reference builds it."""
    ex = "".join(f", {c}" for c in extra)
    ca = "".join(f", {c}" for c in cats)
    band_ctes = ",\n".join(
        f"{name} AS (SELECT id_student, sum(sum_click) AS v FROM vle WHERE date >= {lo} AND date <= {hi} GROUP BY 1)"
        for lo, hi, name in bands)
    band_joins = "\n".join(f"LEFT JOIN {name} ON {name}.id_student = s.id_student" for _, _, name in bands)

    def z(x):
        return f"CAST(coalesce({x}, 0) AS DOUBLE)"
    cols = [f"{z('r.reg_day')} AS reg_day", f"{z('r.rbs')} AS registered_before_start"]
    cols += [f"{z('s.' + c)} AS {c}" for c in extra]
    cols += [f"{z('va.total')} AS total_clicks", f"{z('va.days')} AS active_days",
             f"{z(f'CAST(va.total AS DOUBLE) / {per_day}')} AS avg_clicks_per_day",
             f"{z('CAST(va.total AS DOUBLE) / va.days')} AS avg_clicks_per_active_day"]
    cols += [f"CAST(CASE WHEN va.id_student IS NULL THEN 0 ELSE coalesce({n}.v, 0) END AS DOUBLE) AS {n}"
             for _, _, n in bands]
    if recency:
        b1, b2 = bands[0][2], bands[1][2]
        h1 = f"CAST(coalesce({b1}.v, 0) AS DOUBLE)"
        h2 = f"CAST(coalesce({b2}.v, 0) AS DOUBLE)"
        cols += [f"CASE WHEN va.id_student IS NULL THEN 0.0 ELSE {h2} - {h1} END AS trend_click",
                 f"CASE WHEN va.id_student IS NULL THEN 0.0 ELSE ({h2} + 1) / ({h1} + 1) END AS ratio_click",
                 f"{z(f'{end} - va.last')} AS days_since_last_login",
                 f"{z(f'{end} - va.last')} AS inactivity_streak"]
    cols += [f"{z('aa.n')} AS num_assessments", f"{z('aa.avg_score')} AS avg_score",
             f"{z('aa.max_score')} AS max_score",
             f"CASE WHEN aa.id_student IS NULL AND NOT {fill_min_std} THEN NULL "
             "ELSE CAST(coalesce(aa.min_score, 0) AS DOUBLE) END AS min_score",
             f"CASE WHEN aa.id_student IS NULL AND NOT {fill_min_std} THEN NULL "
             "ELSE round(CAST(coalesce(aa.sd, 0) AS DOUBLE), 6) END AS score_std",
             f"{z('ls.score')} AS last_score"]
    if pass_rate:
        cols.append(f"{z('aa.pass_rate')} AS pass_rate")
    sel = ",\n  ".join(cols)
    return with_demo(f"""
students AS (
  SELECT id_student, CASE WHEN final_result = 'Withdrawn' THEN 1 ELSE 0 END AS dropout{ex}{ca}
  FROM student_info WHERE code_module = '{MOD}' AND code_presentation = '{presentation}'),
r AS (
  SELECT id_student, date_registration AS reg_day,
         CASE WHEN date_registration < 0 THEN 1 ELSE 0 END AS rbs
  FROM student_registration WHERE code_module = '{MOD}' AND code_presentation = '{presentation}'
    AND id_student IN (SELECT id_student FROM students)),
vle AS (
  SELECT * FROM student_vle WHERE code_module = '{MOD}' AND code_presentation = '{presentation}'
    AND id_student IN (SELECT id_student FROM students) AND date >= {start} AND date <= {end}),
va AS (SELECT id_student, sum(sum_click) AS total, count(DISTINCT date) AS days, max(date) AS last
       FROM vle GROUP BY 1),
{band_ctes},
ass AS (
  SELECT * FROM student_assessment WHERE id_student IN (SELECT id_student FROM students)
    AND date_submitted >= {start} AND date_submitted <= {end}),
aa AS (
  SELECT id_student, count(DISTINCT id_assessment) AS n, avg(score) AS avg_score, max(score) AS max_score,
         min(score) AS min_score, stddev_samp(score) AS sd,
         avg(CASE WHEN score >= 40 THEN 1.0 ELSE 0.0 END) AS pass_rate
  FROM ass GROUP BY 1),
ls AS (
  SELECT id_student, score FROM (
    SELECT id_student, score, row_number() OVER (PARTITION BY id_student
           ORDER BY date_submitted DESC, id_assessment DESC, id_submission DESC) AS rn
    FROM ass WHERE score IS NOT NULL) WHERE rn = 1)""") + f"""
SELECT CAST(s.id_student AS BIGINT) AS id_student, CAST(s.dropout AS BIGINT) AS dropout,
  {sel}{''.join(f", s.{c}" for c in cats)}
FROM students s
LEFT JOIN r ON r.id_student = s.id_student
LEFT JOIN va ON va.id_student = s.id_student
{band_joins}
LEFT JOIN aa ON aa.id_student = s.id_student
LEFT JOIN ls ON ls.id_student = s.id_student"""


def clip01(x: str) -> str:
    return f"least(greatest({x}, 0::DOUBLE), 1::DOUBLE)"


DECLINE_A = "(" + clip01(
    f"0.3::DOUBLE * {clip01('inactivity_streak_14 / 7.0::DOUBLE')}"
    f" + 0.2::DOUBLE * {clip01('(0.3::DOUBLE - active_ratio_14) / 0.3::DOUBLE')}"
    f" + 0.2::DOUBLE * {clip01('(10.0::DOUBLE - clicks_last_14_days) / 10.0::DOUBLE')}"
    f" + 0.1::DOUBLE * {clip01('days_since_last_active / 7.0::DOUBLE')}"
    f" + 0.15::DOUBLE * {clip01('(0.35::DOUBLE - ((clicks_last_7_days + 1.0) / (clicks_8_14 + 1.0))) / 0.35::DOUBLE')}"
    f" + 0.03::DOUBLE * {clip01('(-trend_click_14) / 30.0::DOUBLE')}"
    f" + 0.02::DOUBLE * {clip01('(0.6::DOUBLE - ratio_click_14) / 0.6::DOUBLE')}") + ")"


def _cl(x, lo, hi):
    return f"least(greatest({x}, {lo}::DOUBLE), {hi}::DOUBLE)"


DECLINE_B = "(" + clip01(
    f"0.3::DOUBLE * {clip01('(1.0::DOUBLE - ' + _cl('ratio_click_14', 0, 3) + ') / 1.0::DOUBLE')}"
    f" + 0.25::DOUBLE * {clip01('(-' + _cl('trend_click_14', -50, 50) + ') / 30.0::DOUBLE')}"
    f" + 0.2::DOUBLE * {clip01('(20.0::DOUBLE - ' + _cl('clicks_last_7_days', 0, 200) + ') / 20.0::DOUBLE')}"
    f" + 0.15::DOUBLE * {clip01(_cl('inactivity_streak_14', 0, 14) + ' / 14.0::DOUBLE')}"
    f" + 0.1::DOUBLE * {clip01(_cl('days_since_last_active', 0, 60) + ' / 14.0::DOUBLE')}") + ")"

HEURISTIC = "(" + clip01(
    "0.45::DOUBLE * (inactivity_streak_14 / 14.0::DOUBLE)"
    " + 0.3::DOUBLE * (1.0::DOUBLE - tanh(clicks_last_14_days / 10.0::DOUBLE))"
    " + 0.15::DOUBLE * (CASE WHEN clicks_last_7_days <= 1 THEN 1.0 ELSE 0.0 END)"
    " + 0.1::DOUBLE * tanh(days_since_last_active / 5.0::DOUBLE)") + ")"

def clean_sql(mode: str, cols=FEATURES_15) -> str:
    """Select list of the X9 cleaner over a relation that has the feature columns."""
    out = []
    for c in cols:
        x = f"coalesce(TRY_CAST({c} AS DOUBLE), 0::DOUBLE)"
        if c in ("active_ratio_total", "active_ratio_14"):
            x = _cl(x, 0, 1)
        if mode == "all_nonneg":
            x = f"greatest({x}, 0::DOUBLE)"
        elif mode == "click_nonneg":
            if c == "inactivity_streak_14":
                x = _cl(x, 0, 14)
            if "click" in c or c == "days_since_last_active":
                x = f"greatest({x}, 0::DOUBLE)"
        out.append(f"{x} AS {c}")
    return ", ".join(out)
