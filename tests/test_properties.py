"""Property tests of the panel operator over generated activity (SURVEY section 5 (c))."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulse.operators.snapshot import V7, V8, V11, build_panel

learner_days = st.lists(st.dictionaries(st.integers(min_value=-3, max_value=40), st.integers(0, 50), max_size=25),
                        min_size=1, max_size=30)


def _frames(spark, learners):
    rows = [(i, d, n) for i, days in enumerate(learners) for d, n in days.items()]
    L = spark.createDataFrame([(i,) for i in range(len(learners))], "id_student long")
    D = spark.createDataFrame(rows or [(0, 0, 0)], "id_student long, day int, clicks long")
    if not rows:
        D = D.limit(0)
    return L, D.where(F.col("day") >= 0)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(learner_days)
def test_panel_invariants(spark, learners):
    L, D = _frames(spark, learners)
    cuts = (3, 5, 7, 10, 14, 21, 30)
    for spec in (V7.with_cutoffs(cuts), V8.with_cutoffs(cuts)):
        for r in build_panel(spec, L, D).collect():
            c = r["cutoff"]
            assert 0.0 <= r["active_ratio_14"] <= 1.0
            assert 0 <= r["inactivity_streak_14"] <= 14
            assert r["clicks_last_7_days"] <= r["clicks_last_14_days"] or c < 6
            if c >= 7:   # the two halves partition the trailing window
                assert r["clicks_0_7"] + r["clicks_8_14"] == r["clicks_last_14_days"]
            if r["active_days_14"] > 0:
                assert r["days_since_last_active"] == r["inactivity_streak_14"]
            # brute force from the generated days
            days = {d: n for d, n in learners[r["id_student"]].items() if 0 <= d <= c}
            ws = max(0, c - 13)
            win = {d: n for d, n in days.items() if d >= ws}
            assert r["clicks_last_14_days"] == sum(win.values())
            assert r["active_days_14"] == len(win)
            assert r["clicks_per_day_total"] * (c + 1 if spec is not None and spec.name == "v8" else max(c, 1)) \
                == __import__("pytest").approx(sum(days.values()))
            if win:
                assert r["inactivity_streak_14"] == c - max(win)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(learner_days)
def test_worst_case_fill_dominates_zero_fill(spark, learners):
    L, D = _frames(spark, learners)
    Lc = L.withColumn("cutoff", F.lit(14))
    zero = {r["id_student"]: r for r in build_panel(V7.with_cutoffs((14,)), L, D).collect()}
    worst = {r["id_student"]: r for r in build_panel(V11, Lc, D).collect()}
    for i, z in zero.items():
        w = worst[i]
        assert w["inactivity_streak_14"] >= z["inactivity_streak_14"]
        assert w["days_since_last_active"] >= z["days_since_last_active"]
        assert w["clicks_last_14_days"] == z["clicks_last_14_days"]
