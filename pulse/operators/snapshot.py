"""Point-in-time learner x cutoff panels.

One parameterised operator replaces the reference's per-cutoff loops of five group-bys and
eight merges:

    panel  = learners x explode(cutoffs)                      (no join: a Generate)
    joined = panel LEFT JOIN daily ON id = id AND day <= cutoff + horizon
    out    = joined.groupBy(id, cutoff).agg(~15 conditional aggregates)

``daily`` holds one row per (learner, day), so distinct-day counts are plain counts and the
streak is a closed form (``cutoff - max(active day in window)``). The join and the
aggregate share the learner-key partitioning, so the panel costs one shuffle of
``daily`` and one of the panel keys; a learner with a huge log contributes at most
``days x cutoffs`` rows to its task.

For long cutoff lists (a snapshot for every day) the same columns come from per-learner
prefix sums read at each cutoff's window boundaries (``strategy='prefix'``): O(days +
cutoffs) rows per learner instead of O(days x cutoffs). The features of a (learner, cutoff) are
computed once whatever the number of learner rows: what a row carries (label inputs, kept
columns) travels as one list per learner outside the aggregates, so both strategies give the
same rows for learners with several rows, too.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C

FEATURES_15 = (
    "days_elapsed_since_reg", "clicks_per_day_total", "active_ratio_total",
    "avg_clicks_per_active_day_total", "days_since_last_active", "clicks_last_14_days",
    "active_days_14", "clicks_per_day_14", "active_ratio_14", "clicks_last_7_days",
    "clicks_0_7", "clicks_8_14", "trend_click_14", "ratio_click_14", "inactivity_streak_14",
)


@dataclass(frozen=True)
class SnapshotSpec:
    """What one variant of the point-in-time panel computes.

    cutoffs      fixed list, or None to take a per-row ``cutoff`` column from the learners.
    clamp_start  window start max(0, c-W+1) (True) or c-W+1 (False).
    halves       'split': [ws, min(c, ws+H-1)] and [min(c, first_end+1), c] (they overlap
                 for c <= 6); 'tail': [ws, c-H] and (c-H, c].
    denominator  'max1' -> max(c,1); 'inclusive' -> c+1; int -> that constant.
    fill         'zero': learners without history get 0 for streak and days-since-last;
                 'worst_case': days-since-last = c, streak = window_days.
    label        None | 'silent' | 'low_activity' | 'unregister' | 'withdrawn'.
    eligible     keep (learner, c) only when the learner's last active day >= c + horizon.
    clip_ratios  clip both active ratios into [0, 1].
    """

    name: str
    cutoffs: tuple[int, ...] | None
    window_days: int = C.WINDOW_DAYS
    half_window: int = C.HALF_WINDOW
    clamp_start: bool = True
    halves: str = "split"
    recent_days: int = 7
    denominator: object = "max1"
    window_denominator: int = C.WINDOW_DAYS
    fill: str = "zero"
    label: str | None = None
    horizon: int = 0
    eligible: bool = False
    clip_ratios: bool = False
    elapsed_name: str = "days_elapsed_since_reg"
    label_name: str = "y_short"
    extra: dict = field(default_factory=dict)

    def with_cutoffs(self, cutoffs: Sequence[int] | None) -> "SnapshotSpec":
        return replace(self, cutoffs=None if cutoffs is None else tuple(cutoffs))


# The variants of the reference, as data.
V4 = SnapshotSpec("v4", C.CUTOFFS_COURSE, label="withdrawn", label_name="dropout",
                  elapsed_name="days_elapsed_program")
V5 = SnapshotSpec("v5", C.CUTOFFS_REG, label="silent", horizon=7, eligible=True)
V6 = SnapshotSpec("v6", C.CUTOFFS_REG, label="silent", horizon=14)
V7 = SnapshotSpec("v7", C.CUTOFFS_REG, label="silent", horizon=7)
V8 = SnapshotSpec("v8", C.CUTOFFS_REG, label="low_activity", horizon=14, denominator="inclusive",
                  clip_ratios=True)
V9 = SnapshotSpec("v9", C.CUTOFFS_UNREG, label="unregister", horizon=14, clamp_start=False,
                  halves="tail", clip_ratios=True, label_name="target")
V11 = SnapshotSpec("v11", None, fill="worst_case")


def cutoff_panel(learners: DataFrame, cutoffs: Sequence[int]) -> DataFrame:
    """Learners x cutoffs, as a Generate over a literal array (no join, no shuffle)."""
    arr = F.array(*[F.lit(int(c)) for c in cutoffs])
    return learners.withColumn("cutoff", F.explode(arr))


def window_bounds(spec: SnapshotSpec, c: Column):
    """(window start, first-half end, second-half start) as column expressions."""
    W, H = spec.window_days, spec.half_window
    ws = F.greatest(c - (W - 1), F.lit(0)) if spec.clamp_start else c - (W - 1)
    if spec.halves == "split":
        fe = F.least(c, ws + (H - 1))
        ss = F.least(c, fe + 1)
    else:  # 'tail'
        fe = c - H
        ss = c - H + 1
    return ws, fe, ss


def _denominator(spec: SnapshotSpec, c: Column) -> Column:
    if spec.denominator == "max1":
        return F.greatest(c, F.lit(1))
    if spec.denominator == "inclusive":
        return c + 1
    return F.lit(float(spec.denominator))


def _keys(key) -> list[str]:
    """A learner key is one column or several (e.g. id, module, presentation)."""
    return [key] if isinstance(key, str) else list(key)


def learner_last_day(daily: DataFrame, key="id_student") -> DataFrame:
    """J9 input: each learner's last active day (a per-key aggregate of the daily table)."""
    return daily.groupBy(*_keys(key)).agg(F.max("day").alias("last_day"))


def activity_aggregates(spec: SnapshotSpec, c: Column, d: Column, n: Column) -> list[Column]:
    """The conditional aggregates shared by every variant."""
    ws, fe, ss = window_bounds(spec, c)
    cum = d <= c
    win = cum & (d >= ws)
    aggs = [
        F.sum(F.when(cum, n)).alias("_total"),
        F.count(F.when(cum, d)).alias("_days"),
        F.max(F.when(cum, d)).alias("_last"),
        F.sum(F.when(win, n)).alias("_c14"),
        F.count(F.when(win, d)).alias("_d14"),
        F.max(F.when(win, d)).alias("_last14"),
        F.sum(F.when(win & (d <= fe), n)).alias("_h1"),
        F.sum(F.when(win & (d >= ss), n)).alias("_h2"),
        F.sum(F.when(cum & (d > c - spec.recent_days), n)).alias("_last7"),
    ]
    if spec.horizon:
        fut = (d > c) & (d <= c + spec.horizon)
        aggs += [F.sum(F.when(fut, n)).alias("_fclicks"), F.count(F.when(fut, d)).alias("_fdays")]
    return aggs


def feature_columns(spec: SnapshotSpec, c: Column) -> list[Column]:
    """Turn the aggregate columns into the 15 features with the variant's fill rules."""
    ws, _, _ = window_bounds(spec, c)
    den = _denominator(spec, c)
    total = F.coalesce(F.col("_total"), F.lit(0)).cast("double")
    days = F.col("_days").cast("double")
    c14 = F.coalesce(F.col("_c14"), F.lit(0)).cast("double")
    d14 = F.col("_d14").cast("double")
    h1 = F.coalesce(F.col("_h1"), F.lit(0)).cast("double")
    h2 = F.coalesce(F.col("_h2"), F.lit(0)).cast("double")
    worst = spec.fill == "worst_case"
    since_fill = c if worst else F.lit(0)
    streak_fill = F.lit(spec.window_days) if worst else F.lit(0)
    ratio_total = days / den
    ratio_14 = d14 / spec.window_denominator
    if spec.clip_ratios:
        ratio_total = F.least(F.greatest(ratio_total, F.lit(0.0)), F.lit(1.0))
        ratio_14 = F.least(F.greatest(ratio_14, F.lit(0.0)), F.lit(1.0))
    cols = {
        spec.elapsed_name: c,
        "clicks_per_day_total": total / den,
        "active_ratio_total": ratio_total,
        "avg_clicks_per_active_day_total": F.when(days > 0, total / days).otherwise(F.lit(0.0)),
        "days_since_last_active": F.when(days > 0, c - F.col("_last")).otherwise(since_fill),
        "clicks_last_14_days": c14,
        "active_days_14": d14,
        "clicks_per_day_14": c14 / spec.window_denominator,
        "active_ratio_14": ratio_14,
        "clicks_last_7_days": F.coalesce(F.col("_last7"), F.lit(0)).cast("double"),
        "clicks_0_7": h1,
        "clicks_8_14": h2,
        "trend_click_14": h2 - h1,
        "ratio_click_14": (h2 + 1) / (h1 + 1),
        # X11 closed form: trailing run of inactive days ending at c.
        "inactivity_streak_14": F.when(d14 > 0, c - F.col("_last14")).otherwise(streak_fill),
    }
    return [v.cast("double").alias(k) for k, v in cols.items()]


def label_column(spec: SnapshotSpec, c: Column) -> Column | None:
    """P13-P16 at (learner, cutoff) grain."""
    if spec.label == "silent":  # Q16: 1 exactly when no active day in (c, c+h]
        y = F.when(F.col("_fdays") == 0, F.lit(1)).otherwise(F.lit(0))
    elif spec.label == "low_activity":  # absent future counts as 0 days / 0 clicks -> 1
        y = F.when((F.col("_fdays") <= C.LOW_ACTIVITY_MAX_DAYS)
                   | (F.coalesce(F.col("_fclicks"), F.lit(0)) <= C.LOW_ACTIVITY_MAX_CLICKS), F.lit(1)
                   ).otherwise(F.lit(0))
    elif spec.label == "unregister":
        u = F.col("_unreg")
        y = F.when((u > c) & (u <= c + spec.horizon), F.lit(1)).otherwise(F.lit(0))
    elif spec.label == "withdrawn":
        y = F.col("dropout")
    else:
        return None
    return y.cast("bigint").alias(spec.label_name)


PREFIX_MIN_CUTOFFS = 64  # join is cheaper while days x cutoffs per learner stays small


def _prefix_aggregates(spec: SnapshotSpec, panel: DataFrame, daily: DataFrame, key,
                       group_cols: Sequence[str]) -> DataFrame:
    """The same aggregate columns as ``activity_aggregates`` from prefix sums.

    Every window feature is a difference of per-learner prefix sums at a few boundaries
    (cutoff, window start - 1, half ends, cutoff - recent, cutoff + horizon). Boundary rows are
    unioned with the learner's daily rows and one running window per learner (ordered by
    day, data before boundary at equal days) gives the as-of prefix at each boundary. Work per
    learner is O(active days + 6 x cutoffs) instead of O(active days x cutoffs).
    """
    c = F.col("cutoff")
    ws, fe, ss = window_bounds(spec, c)
    bounds = {"c": c, "ws": ws - 1, "fe": F.greatest(fe, ws - 1), "ss": F.greatest(ss - 1, ws - 1),
              "rc": c - spec.recent_days}
    if spec.horizon:
        bounds["fu"] = c + spec.horizon
    ks = _keys(key)
    carry = [x for x in group_cols if x not in (*ks, "cutoff")]
    arr = F.array(*[F.struct(F.lit(n).alias("bt"), b.cast("int").alias("pos")) for n, b in bounds.items()])
    q = panel.select(*ks, c.cast("int").alias("cutoff"), *carry, F.explode(arr).alias("_q")).select(
        *ks, "cutoff", *carry, F.col("_q.bt").alias("_bt"), F.col("_q.pos").alias("_pos"),
        F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_n"), F.lit(None).cast("int").alias("_d"))
    types = dict(q.dtypes)
    d = daily.select(*ks, F.lit(None).cast("int").alias("cutoff"),
                     *[F.lit(None).cast(types[x]).alias(x) for x in carry],
                     F.lit(None).cast("string").alias("_bt"), F.col("day").cast("int").alias("_pos"),
                     F.lit(0).alias("_kind"), F.col("clicks").cast("bigint").alias("_n"),
                     F.col("day").cast("int").alias("_d"))
    run = Window.partitionBy(*ks).orderBy("_pos", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    u = (d.unionByName(q)
         .withColumn("_P", F.coalesce(F.sum("_n").over(run), F.lit(0)))
         .withColumn("_N", F.count("_d").over(run))
         .withColumn("_L", F.max("_d").over(run))
         .where(F.col("_kind") == 1))

    def at(col, name):
        return F.max(F.when(F.col("_bt") == name, F.col(col)))
    aggs = []
    for n in bounds:
        aggs += [at("_P", n).alias(f"_P_{n}"), at("_N", n).alias(f"_N_{n}")]
    aggs.append(at("_L", "c").alias("_L_c"))
    g = u.groupBy(*ks, "cutoff", *carry).agg(*aggs)  # carried lists: see build_panel
    P = {n: F.col(f"_P_{n}") for n in bounds}
    N = {n: F.col(f"_N_{n}") for n in bounds}
    last_c = F.col("_L_c")
    out = [*[F.col(k) for k in ks], F.col("cutoff"), *[F.col(x) for x in carry],
           F.when(N["c"] > 0, P["c"]).alias("_total"), N["c"].alias("_days"),
           F.when(N["c"] > 0, last_c).alias("_last"),
           F.when(N["c"] - N["ws"] > 0, P["c"] - P["ws"]).alias("_c14"), (N["c"] - N["ws"]).alias("_d14"),
           F.when(N["c"] - N["ws"] > 0, last_c).alias("_last14"),
           (P["fe"] - P["ws"]).alias("_h1"), (P["c"] - P["ss"]).alias("_h2"),
           (P["c"] - P["rc"]).alias("_last7")]
    if spec.horizon:
        out += [(P["fu"] - P["c"]).alias("_fclicks"), (N["fu"] - N["c"]).alias("_fdays")]
    return g.select(*out)


def build_panel(spec: SnapshotSpec, learners: DataFrame, daily: DataFrame,
                key="id_student", keep: Sequence[str] = (), strategy: str = "auto") -> DataFrame:
    """Build the (learner, cutoff) panel for one variant.

    key       the learner key: one column, or several such as (id, module, presentation) so
              that a learner registered twice is two panel learners.
    learners  ``key`` plus, depending on the label, ``dropout`` or ``date_unregistration``; a
              ``cutoff`` column when spec.cutoffs is None. One panel row per learner row and
              cutoff if a column is carried (label input or ``keep``), else one per key; the
              features are those of the key.
    daily     (key, day, clicks), one row per learner and active day, on the variant's
              clock and already restricted to its lower day bound.
    keep      extra learner columns carried to the output.
    strategy  'join'   panel LEFT JOIN daily on key and day <= cutoff + horizon, one aggregate
                       (rows per learner: active days x cutoffs); best for short cutoff lists.
              'prefix' per-learner prefix sums read at each cutoff's boundaries (rows per
                       learner: active days + 6 x cutoffs); for long cutoff lists.
              'auto'   'prefix' from PREFIX_MIN_CUTOFFS cutoffs on, else 'join': a choice of
                       plan only, the rows are the same.
    """
    ks = _keys(key)
    carry = [k for k in keep if k not in (*ks, "cutoff")]
    base = learners
    if spec.label == "withdrawn" and "dropout" not in carry:
        carry.append("dropout")
    if spec.label == "unregister":
        base = base.withColumn("_unreg", F.coalesce(F.col("date_unregistration"), F.lit(999)))
        carry.append("_unreg")
    at = ks if spec.cutoffs is not None else [*ks, "cutoff"]
    if carry:  # one row per key; its learner rows come back after the aggregate
        base = base.groupBy(*at).agg(F.collect_list(F.struct(*carry)).alias("_rows"))
    else:
        base = base.select(*at).distinct()
    panel = base if spec.cutoffs is None else cutoff_panel(base, spec.cutoffs)
    c = F.col("cutoff")
    if spec.label == "unregister":  # still enrolled at the cutoff
        panel = panel.withColumn("_rows", F.filter("_rows", lambda r: r["_unreg"] > F.col("cutoff"))).where(F.size("_rows") > 0)
    if spec.eligible:  # F8 / J9: learner's last day (default -1) >= c + horizon
        last = learner_last_day(daily, ks)
        panel = (panel.join(last, ks, "left")
                 .where(F.coalesce(F.col("last_day"), F.lit(-1)) >= F.col("cutoff") + spec.horizon)
                 .drop("last_day"))
    if strategy == "auto":
        strategy = "prefix" if spec.cutoffs is not None and len(spec.cutoffs) >= PREFIX_MIN_CUTOFFS else "join"
    if strategy == "prefix":
        agg = _prefix_aggregates(spec, panel, daily, key, panel.columns)
    else:
        act = daily.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(ks)], F.col("day").alias("_d"),
                           F.col("clicks").alias("_n"))
        cond = F.col("_d") <= c + spec.horizon
        for i, k in enumerate(ks):
            cond = cond & (F.col(k) == F.col(f"_k{i}"))
        # The list is constant within (key, cutoff): as a grouping column it leaves the aggregate a
        # hash aggregate (an array in the buffer makes Spark sort), on the join's partitioning.
        rows = ["_rows"] if carry else []
        agg = panel.join(act, cond, "left").groupBy(*ks, "cutoff", *rows).agg(
            *activity_aggregates(spec, c, F.col("_d"), F.col("_n")))
    if carry:
        agg = agg.withColumn("_row", F.explode("_rows")).select("*", "_row.*").drop("_row", "_rows")
    out_cols = [*[F.col(k) for k in ks], c.cast("bigint").alias("cutoff")]
    out_cols += [F.col(k) for k in keep if k != "cutoff"]
    lab = label_column(spec, c)
    if lab is not None:
        out_cols.append(lab)
    out_cols += feature_columns(spec, c)
    return agg.select(*out_cols)
