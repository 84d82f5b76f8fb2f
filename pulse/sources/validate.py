"""Row validation and per-row error isolation.

Invalid rows are not dropped and nothing raises: every row gets ``is_valid`` and an
``error`` text, so a batch is split into a valid set and a quarantine set in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATIO_COLS = ("active_ratio_total", "active_ratio_14")


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required features absent from the input schema (a schema diff on the driver)."""
    have = set(df.columns)
    return [c for c in required if c not in have]


def _first_error(checks: Sequence[tuple[Column, str]]) -> Column:
    out = None
    for cond, msg in checks:
        out = F.when(cond, F.lit(msg)) if out is None else out.when(cond, F.lit(msg))
    return out if out is not None else F.lit(None).cast("string")


def validate_feature_rows(df: DataFrame, features: Sequence[str], strict: bool = True) -> DataFrame:
    """type/NULL/range checks per row; a NULL required feature is an error (strict). With ``strict=False`` missing columns are added
    as 0 (Q24: the request model defaults absent features); with strict they are errors."""
    missing = missing_columns(df, features)
    x = df
    for c in missing:
        x = x.withColumn(c, F.lit(0.0))
    checks = []
    if strict and missing:
        checks.append((F.lit(True), "missing features: " + ",".join(missing)))
    for c in features:
        v = F.col(c).try_cast("double")
        if strict:
            checks.append((F.col(c).isNull(), f"{c} is missing"))
        checks.append((F.col(c).isNotNull() & (v.isNull() | F.isnan(v)), f"{c} is not numeric"))
    for c in RATIO_COLS:
        if c in features:
            v = F.col(c).try_cast("double")
            checks.append(((v < 0) | (v > 1), f"{c} out of [0,1]"))
    err = _first_error(checks)
    return x.withColumn("error", err).withColumn(
        "is_valid", F.when(F.col("error").isNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint"))


def batch_with_errors(histories: DataFrame) -> DataFrame:
    """Raw-history rows that cannot be scored carry an error and no features; the others go
    on. Required: id, cutoff, the activity list, and day and clicks of every activity."""
    err = _first_error([
        (F.col("student_id").isNull(), "student_id is missing"),
        (F.col("days_since_registration").isNull(), "days_since_registration is missing"),
        (F.col("vle_activities").isNull(), "vle_activities is missing"),
        (F.exists("vle_activities", lambda a: a.isNull() | a["date"].isNull() | a["sum_click"].isNull()),
         "an activity has no date or clicks")])
    return histories.select("student_id", F.col("days_since_registration").cast("bigint").alias("cutoff"),
                            "vle_activities", err.alias("error"))


def check_threshold(threshold: float) -> float:
    """A caller-supplied decision threshold must be a number in [0, 1] (request-level
    check on the driver, before any job runs)."""
    t = float(threshold)
    if not 0.0 <= t <= 1.0:
        raise ValueError(f"threshold must be in [0, 1], got {threshold!r}")
    return t


def check_non_empty(df: DataFrame) -> DataFrame:
    """An empty batch is a request error; ``isEmpty`` reads at most one row."""
    if df.isEmpty():
        raise ValueError("empty batch")
    return df
