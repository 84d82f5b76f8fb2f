"""Rule scores, tiers and cleaning on hand-made feature rows, against plain-Python formulas."""

import math

import pytest
from pyspark.sql import functions as F

from pulse import config as C
from pulse.functions import rules
from pulse.functions.clean import clean_features
from pulse.operators.snapshot import FEATURES_15
from pulse.sources.samples import feature_rows
from pulse.sources.validate import validate_feature_rows

ROWS = [
    {"student_id": "low", "days_elapsed_since_reg": 30, "clicks_per_day_total": 12.0, "active_ratio_total": 0.8,
     "avg_clicks_per_active_day_total": 15.0, "days_since_last_active": 0, "clicks_last_14_days": 200,
     "active_days_14": 12, "clicks_per_day_14": 14.3, "active_ratio_14": 0.86, "clicks_last_7_days": 110,
     "clicks_0_7": 90, "clicks_8_14": 110, "trend_click_14": 20, "ratio_click_14": 1.21, "inactivity_streak_14": 0},
    {"student_id": "medium", "days_elapsed_since_reg": 30, "clicks_per_day_total": 5.0, "active_ratio_total": 0.5,
     "avg_clicks_per_active_day_total": 10.0, "days_since_last_active": 3, "clicks_last_14_days": 40,
     "active_days_14": 4, "clicks_per_day_14": 2.9, "active_ratio_14": 0.29, "clicks_last_7_days": 8,
     "clicks_0_7": 32, "clicks_8_14": 8, "trend_click_14": -24, "ratio_click_14": 0.27, "inactivity_streak_14": 3},
    {"student_id": "high", "days_elapsed_since_reg": 30, "clicks_per_day_total": 1.0, "active_ratio_total": 1.4,
     "avg_clicks_per_active_day_total": 3.0, "days_since_last_active": 12, "clicks_last_14_days": 2,
     "active_days_14": 1, "clicks_per_day_14": 0.14, "active_ratio_14": 0.07, "clicks_last_7_days": 0,
     "clicks_0_7": 2, "clicks_8_14": 0, "trend_click_14": -2, "ratio_click_14": 0.33, "inactivity_streak_14": 12},
]


def clip(x, lo=0.0, hi=1.0):
    return max(lo, min(hi, x))


def py_a(f):
    recent = (f["clicks_last_7_days"] + 1) / (f["clicks_8_14"] + 1)
    parts = [(0.30, f["inactivity_streak_14"] / 7), (0.20, 1 - f["active_ratio_14"] / 0.30),
             (0.20, 1 - f["clicks_last_14_days"] / 10), (0.10, f["days_since_last_active"] / 7),
             (0.15, 1 - recent / 0.35), (0.03, -f["trend_click_14"] / 30), (0.02, 1 - f["ratio_click_14"] / 0.60)]
    return clip(sum(w * clip(x) for w, x in parts))


def py_b(f):
    parts = [(0.30, 1 - clip(f["ratio_click_14"], 0, 3)), (0.25, -clip(f["trend_click_14"], -50, 50) / 30),
             (0.20, 1 - clip(f["clicks_last_7_days"], 0, 200) / 20), (0.15, clip(f["inactivity_streak_14"], 0, 14) / 14),
             (0.10, clip(f["days_since_last_active"], 0, 60) / 14)]
    return clip(sum(w * clip(x) for w, x in parts))


def py_h(f):
    return clip(0.45 * f["inactivity_streak_14"] / 14 + 0.30 * (1 - math.tanh(f["clicks_last_14_days"] / 10))
                + 0.15 * (1.0 if f["clicks_last_7_days"] <= 1 else 0.0)
                + 0.10 * math.tanh(f["days_since_last_active"] / 5))


def test_rule_scores_match_python(spark):
    df = feature_rows(spark, ROWS)
    out = {r["student_id"]: r for r in df.select(
        "student_id", rules.decline_score_a().alias("a"), rules.decline_score_b().alias("b"),
        rules.heuristic_risk().alias("h")).collect()}
    for f in ROWS:
        r = out[f["student_id"]]
        assert r["a"] == pytest.approx(py_a(f), abs=1e-12)
        assert r["b"] == pytest.approx(py_b(f), abs=1e-12)
        assert r["h"] == pytest.approx(py_h(f), abs=1e-12)
    assert out["low"]["a"] < out["medium"]["a"] < out["high"]["a"]


def test_tiers_actions_and_clipping(spark):
    df = feature_rows(spark, ROWS)
    s = df.select("student_id", rules.tier(rules.decline_score_b(), *C.TIERS_BATCH).alias("t"))
    s = s.withColumn("a", rules.action(F.col("t")))
    got = {r["student_id"]: (r["t"], r["a"]) for r in s.collect()}
    assert got["high"] == ("HIGH", "ALERT") and got["low"] == ("LOW", "SAFE")
    cleaned = {r["student_id"]: r for r in clean_features(df, FEATURES_15, "all_nonneg", keep=["student_id"]).collect()}
    assert cleaned["high"]["active_ratio_total"] == 1.0          # ratio > 1 clipped
    assert cleaned["medium"]["trend_click_14"] == 0.0            # negative trend erased (all_nonneg)
    kept = {r["student_id"]: r for r in clean_features(df, FEATURES_15, "click_nonneg", keep=["student_id"]).collect()}
    assert kept["medium"]["trend_click_14"] == 0.0               # name contains 'click'
    assert rules.display_sigmoid is not None


def test_validation_strict_and_lenient(spark):
    rows = [dict(ROWS[0]), dict(ROWS[2])]
    df = feature_rows(spark, rows).drop("clicks_0_7")
    strict = validate_feature_rows(df, FEATURES_15, strict=True).collect()
    assert all(r["is_valid"] == 0 for r in strict)
    lenient = {r["student_id"]: r for r in validate_feature_rows(df, FEATURES_15, strict=False).collect()}
    assert lenient["low"]["is_valid"] == 1 and lenient["low"]["clicks_0_7"] == 0.0
    assert lenient["high"]["error"] == "active_ratio_total out of [0,1]"


def test_request_level_checks(spark):
    from pulse.sources.validate import check_non_empty, check_threshold
    assert check_threshold(0.45) == 0.45
    for bad in (-0.1, 1.5, "x"):
        with pytest.raises(ValueError):
            check_threshold(bad)
    with pytest.raises(ValueError):
        check_non_empty(feature_rows(spark, ROWS).limit(0))
