"""Hand-worked frames for the panel operator (quirks Q1-Q4, Q11, Q16, Q20, Q21) and the
closed-form streak against the reference loop."""

import itertools

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulse.operators.snapshot import V7, V8, V9, V11, SnapshotSpec, build_panel
from pulse.operators.variants import snapshot_v11, snapshot_v11_panel


def loop_streak(days, start, end):
    """Brute force: length of the run of inactive days that ends at ``end``."""
    from itertools import takewhile
    active = set(days)
    return sum(1 for _ in takewhile(lambda d: d not in active, range(end, start - 1, -1)))


def test_streak_closed_form_matches_loop():
    for start in range(0, 4):
        for end in range(start, start + 6):
            span = list(range(start, end + 1))
            for r in range(len(span) + 1):
                for subset in itertools.combinations(span, r):
                    closed = (end - max(subset)) if subset else (end - start + 1)
                    assert closed == loop_streak(list(subset), start, end)


def _frames(spark, learners, acts):
    L = spark.createDataFrame(learners, "id_student long")
    D = spark.createDataFrame(acts, "id_student long, day int, clicks long")
    return L, D


def _row(df, **keys):
    cond = None
    for k, v in keys.items():
        c = F.col(k) == v
        cond = c if cond is None else cond & c
    rows = df.where(cond).collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_half_windows_overlap_for_small_cutoffs(spark):
    # Q1: at c=3 the halves are [0,3] and [3,3]; day 3 counts in both.
    L, D = _frames(spark, [(1,)], [(1, 0, 10), (1, 3, 5)])
    p = build_panel(V7.with_cutoffs([3]), L, D)
    r = _row(p, id_student=1, cutoff=3)
    assert r["clicks_0_7"] == 15.0 and r["clicks_8_14"] == 5.0
    assert r["clicks_last_14_days"] == 15.0


def test_second_half_equals_last7_for_large_cutoffs(spark):
    # Q2: for c >= 13, clicks_8_14 == clicks_last_7_days.
    acts = [(1, d, d + 1) for d in range(0, 30)]
    L, D = _frames(spark, [(1,)], acts)
    p = build_panel(V7.with_cutoffs([13, 14, 21]), L, D)
    for r in p.collect():
        assert r["clicks_8_14"] == r["clicks_last_7_days"]


def test_denominators_and_empty_history(spark):
    # Q3: window shrinks for c < 13 but /14 stays; Q4: zero fill; Q11: empty sums are 0.
    L, D = _frames(spark, [(1,), (2,)], [(1, 1, 7), (1, 2, 7)])
    p = build_panel(V7.with_cutoffs([5]), L, D)
    r = _row(p, id_student=1)
    assert r["clicks_per_day_14"] == 14 / 14 and r["active_ratio_14"] == 2 / 14
    assert r["clicks_per_day_total"] == 14 / 5 and r["inactivity_streak_14"] == 3.0
    e = _row(p, id_student=2)
    assert e["days_since_last_active"] == 0.0 and e["inactivity_streak_14"] == 0.0
    assert e["ratio_click_14"] == 1.0 and e["clicks_last_14_days"] == 0.0


def test_inclusive_denominator_and_low_activity_label(spark):
    L, D = _frames(spark, [(1,), (2,), (3,)],
                   [(1, 0, 4), (1, 5, 1), (1, 6, 1), (2, 0, 1), (2, 4, 50), (3, 0, 2)])
    p = build_panel(V8.with_cutoffs([3]), L, D)
    r1 = _row(p, id_student=1)  # future (3, 17]: days 5, 6 -> 2 days, 2 clicks <= 3 -> low
    assert r1["y_short"] == 1 and r1["clicks_per_day_total"] == 4 / 4
    r2 = _row(p, id_student=2)  # one future day with 50 clicks -> days <= 1 -> low
    assert r2["y_short"] == 1
    r3 = _row(p, id_student=3)  # nothing in the future -> 1
    assert r3["y_short"] == 1


def test_silent_label_is_one_only_without_future_activity(spark):
    L, D = _frames(spark, [(1,), (2,)], [(1, 2, 1), (1, 9, 1), (2, 2, 1)])
    p = build_panel(V7.with_cutoffs([3]), L, D)
    assert _row(p, id_student=1)["y_short"] == 0
    assert _row(p, id_student=2)["y_short"] == 1


def test_unregister_label_and_still_enrolled_filter(spark):
    L = spark.createDataFrame([(1, 20), (2, 10), (3, None)], "id_student long, date_unregistration int")
    D = spark.createDataFrame([(1, 1, 5)], "id_student long, day int, clicks long")
    p = build_panel(V9.with_cutoffs([14]), L, D)
    got = {r["id_student"]: r["target"] for r in p.collect()}
    assert got == {1: 1, 3: 0}  # learner 2 left before the cutoff


def test_worst_case_fill_and_negative_days(spark):
    # Q20/Q21: empty window -> streak 14 even when the window is shorter; no lower day bound.
    L = spark.createDataFrame([(1, 5), (2, 30)], "id_student long, cutoff int")
    D = spark.createDataFrame([(1, -3, 10)], "id_student long, day int, clicks long")
    p = build_panel(V11, L, D)
    r1 = _row(p, id_student=1)
    assert r1["clicks_per_day_total"] == 10 / 5 and r1["active_ratio_total"] == 1 / 5
    assert r1["inactivity_streak_14"] == 14.0 and r1["days_since_last_active"] == 8.0
    r2 = _row(p, id_student=2)
    assert r2["days_since_last_active"] == 30.0 and r2["inactivity_streak_14"] == 14.0


def test_fixture_cases_from_the_smoke_client(spark):
    schema = T.StructType([
        T.StructField("student_id", T.StringType()), T.StructField("days_since_registration", T.IntegerType()),
        T.StructField("vle_activities", T.ArrayType(T.StructType([
            T.StructField("date", T.IntegerType()), T.StructField("sum_click", T.IntegerType())])))])
    rows = [
        ("steady", 60, [(d, 80 + d % 20) for d in range(0, 60, 2)]),
        ("fading", 60, [(d, max(5, 100 - 2 * d)) for d in range(0, 30, 3)]),
        ("none", 30, []),
        ("new", 7, [(d, 100) for d in range(0, 7)]),
        ("long", 180, [(d, 60 + d % 30) for d in range(0, 180, 3)]),
    ]
    h = spark.createDataFrame(rows, schema)
    out = {r["student_id"]: r.asDict() for r in snapshot_v11(h).collect()}
    assert out["steady"]["days_since_last_active"] == 2 and out["steady"]["inactivity_streak_14"] == 2
    assert out["steady"]["active_days_14"] == 6
    f = out["fading"]
    assert f["clicks_last_14_days"] == 0 and f["inactivity_streak_14"] == 14
    assert f["days_since_last_active"] == 33 and f["ratio_click_14"] == 1
    n = out["none"]
    assert n["days_since_last_active"] == 30 and n["inactivity_streak_14"] == 14 and n["ratio_click_14"] == 1
    w = out["new"]
    assert w["clicks_0_7"] == 700 and w["clicks_8_14"] == 0 and w["inactivity_streak_14"] == 1
    assert w["clicks_last_7_days"] == 600
    assert out["long"]["inactivity_streak_14"] == 3
    # the row-local (higher-order function) form equals the generic panel
    a = sorted(tuple(r) for r in snapshot_v11(h).collect())
    b = sorted(tuple(r) for r in snapshot_v11_panel(h).select(*snapshot_v11(h).columns).collect())
    assert a == b


def test_no_leakage_events_after_cutoff_do_not_change_features(spark):
    base = [(1, d, 3) for d in range(0, 10)]
    extra = [(1, d, 99) for d in range(15, 25)]
    L, D1 = _frames(spark, [(1,)], base)
    _, D2 = _frames(spark, [(1,)], base + extra)
    spec = SnapshotSpec("x", (3, 7, 14), label=None)
    a = sorted(tuple(r) for r in build_panel(spec, L, D1).collect())
    b = sorted(tuple(r) for r in build_panel(spec, L, D2).collect())
    assert a == b


def test_repartition_invariance(spark):
    acts = [(i % 7, (i * 5) % 20, i % 11) for i in range(200)]
    L = spark.createDataFrame([(i,) for i in range(7)], "id_student long")
    D = spark.createDataFrame(acts, "id_student long, day int, clicks long") \
        .groupBy("id_student", "day").agg(F.sum("clicks").alias("clicks"))
    a = sorted(tuple(r) for r in build_panel(V8, L, D).collect())
    b = sorted(tuple(r) for r in build_panel(V8, L.repartition(3), D.repartition(5, "day")).collect())
    assert a == b


def test_prefix_strategy_equals_join_strategy(spark):
    from pulse.operators.snapshot import V4 as S4, V5 as S5, V9 as S9
    acts = [(i % 9, (i * 7) % 40 - 5, i % 13 + 1) for i in range(300)]
    L = spark.createDataFrame([(i, 1, 20 + i) for i in range(10)],
                              "id_student long, dropout int, date_unregistration int")
    D = spark.createDataFrame(acts, "id_student long, day int, clicks long") \
        .groupBy("id_student", "day").agg(F.sum("clicks").alias("clicks"))
    for spec in (V7, V8, S5, S4, S9):
        for cuts in ((3, 7, 14), tuple(range(0, 30))):
            s = spec.with_cutoffs(cuts)
            a = build_panel(s, L, D, strategy="join")
            b = build_panel(s, L, D, strategy="prefix").select(*a.columns)
            assert sorted(tuple(r) for r in a.collect()) == sorted(tuple(r) for r in b.collect())


def test_composite_learner_key_avoids_registration_fan_out(spark):
    # Q6: one learner, two presentations with different registration days.
    from pulse.operators.cohort import collapse_daily, rebase_daily
    vle = spark.createDataFrame([(1, "A", 0, 10), (1, "A", 2, 10), (1, "B", 5, 7)],
                                "id_student long, code_presentation string, date int, sum_click int")
    reg = spark.createDataFrame([(1, "A", 0), (1, "B", 4)],
                                "id_student long, code_presentation string, date_registration int")
    ks = ["id_student", "code_presentation"]
    legacy = rebase_daily(collapse_daily(vle), reg, min_day=None)     # id only: every click twice
    assert legacy.agg(F.sum("clicks")).collect()[0][0] == 2 * 27
    comp = rebase_daily(collapse_daily(vle, key=ks), reg, key=ks)
    assert comp.agg(F.sum("clicks")).collect()[0][0] == 27
    learners = reg.select(*ks)
    for strategy in ("join", "prefix"):
        p = {r["code_presentation"]: r for r in build_panel(V7.with_cutoffs([3]), learners, comp, key=ks,
                                                              strategy=strategy).collect()}
        assert p["A"]["clicks_last_14_days"] == 20.0 and p["B"]["clicks_last_14_days"] == 7.0


# One learner with two registrations in the scope: expected values worked out by hand from the
# definition (features per id, log shifted by every registration day, days counted once).

def _repeat_tables(spark, reg_days, clicks, results=("Pass", "Withdrawn")):
    from pulse.sources.demo import LearnerTables
    pres = ("2024A", "2024B")
    info = spark.createDataFrame([("AAA", p, 1, r) for p, r in zip(pres, results)],
                                 "code_module string, code_presentation string, id_student long, final_result string")
    reg = spark.createDataFrame([(1, "AAA", p, d, u) for p, d, u in zip(pres, reg_days, (None, 20))],
                                "id_student long, code_module string, code_presentation string, "
                                "date_registration int, date_unregistration int")
    vle = spark.createDataFrame([(1, "AAA", "2024A", 0, d, n) for d, n in clicks],
                                "id_student long, code_module string, code_presentation string, id_site int, date int, sum_click int")
    return LearnerTables(info, reg, vle, None, None)


def test_two_presentations_same_day_count_once_in_both_strategies(spark):
    from pulse.operators import variants
    t = _repeat_tables(spark, (0, 0), [(0, 5), (5, 5), (20, 5)])
    for strategy in ("join", "prefix"):
        rows = variants.snapshot_v8(t, "AAA", ("2024A", "2024B"), (14,), strategy).collect()
        assert len(rows) == 1
        assert (rows[0]["clicks_last_14_days"], rows[0]["active_ratio_total"] * 15, rows[0]["y_short"]) == (5.0, 2.0, 1)
        assert rows[0]["clicks_per_day_total"] * 15 == 10.0


def test_course_clock_keeps_one_row_per_info_row(spark):
    from pulse.operators import variants
    t = _repeat_tables(spark, (0, 0), [(0, 5), (5, 5)])
    rows = variants.snapshot_v4(t, "AAA", ("2024A", "2024B"), (10,), with_assessments=False).collect()
    assert sorted(r["dropout"] for r in rows) == [0, 1]
    assert all(r["clicks_per_day_total"] * 10 == 10.0 and r["active_days_14"] == 2.0 for r in rows)


def test_two_registration_days_shift_the_log_twice(spark):
    from pulse.operators import variants
    # Days 0, 3, 6 on one clock and -3, 0, 3 on the other: distinct days 0, 3, 6; clicks add up.
    t = _repeat_tables(spark, (0, 3), [(0, 1), (3, 1), (6, 1)])
    for strategy in ("join", "prefix"):
        r = variants.snapshot_v8(t, "AAA", ("2024A", "2024B"), (7,), strategy).collect()[0]
        assert (r["active_days_14"], r["clicks_last_14_days"]) == (3.0, 5.0)
    r10 = variants.snapshot_v10(t, "AAA", ("2024A", "2024B")).collect()
    assert len(r10) == 2 and all(r["active_ratio_total"] == 3 / 8 for r in r10)
    r9 = variants.snapshot_v9(t, "AAA", ("2024A", "2024B"), (7,)).collect()
    assert sorted(r["target"] for r in r9) == [0, 1] and all(r["active_days_14"] == 3.0 for r in r9)


def test_composite_key_in_every_variant(spark):
    from pulse.operators import cohort, variants
    from pulse.sources.demo import learner_tables
    t = learner_tables(spark, "/root/testdata/sf0.001")
    key = cohort.REGISTRATION_KEY
    for make in (variants.snapshot_v5, variants.snapshot_v6, variants.snapshot_v7, variants.snapshot_v8, variants.snapshot_v9, variants.snapshot_v10):
        by_id, by_key = make(t), make(t, key=key)
        # Every learner of these tables registers once: the same rows under either key.
        assert set(by_key.columns) - set(by_id.columns) == {"code_module", "code_presentation"}
        a, b = by_id.distinct(), by_key.select(*by_id.columns).distinct()
        assert a.count() > 0 and (make is variants.snapshot_v9 or (a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0))
    assert cohort.learners_prestart(t, "BBB", ("2024A", "2024B"), key).columns[:3] == list(key)


def test_composite_key_gives_a_row_per_registration(spark):
    from pulse.operators import cohort, variants
    t = _repeat_tables(spark, (0, 3), [(0, 1), (3, 1), (6, 1)])
    rows = {r["code_presentation"]: r for r in variants.snapshot_v8(t, "AAA", ("2024A", "2024B"), (7,), key=cohort.REGISTRATION_KEY).collect()}
    assert rows["2024A"]["clicks_last_14_days"] == 3.0 and rows["2024B"]["clicks_last_14_days"] == 0.0
