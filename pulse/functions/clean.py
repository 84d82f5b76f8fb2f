"""Feature cleaning (X1-X9) as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATIO_COLS = ("active_ratio_total", "active_ratio_14")


def coerce_double(c: Column) -> Column:
    """Numeric cast where invalid input becomes NULL (never raises under ANSI)."""
    return c.try_cast("double")


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Clip into [lo, hi]; greatest/least skip NULLs, so fill before clipping."""
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return out


def safe_div(a: Column, b: Column, fill: float = 0.0) -> Column:
    """A / b with 0 (or NULL) denominators mapped to ``fill``."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(float(fill)))


def fill_values(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Constant fill per column."""
    return df.fillna(dict(values))


def clean_features(df: DataFrame, cols: Sequence[str], mode: str = "all_nonneg",
                   keep: Sequence[str] = ()) -> DataFrame:
    """Coerce + fill 0 + clip ratios to [0,1] + the variant's non-negativity rule.

    mode 'all_nonneg'  every feature max(x, 0)                       (V8 training)
         'click_nonneg' streak clipped [0,14], columns named *click* and days-since >= 0 (V9)
         'ratio_only'   only the two ratios are clipped               (one V8 scoring path)
    """
    out = []
    for c in cols:
        x = F.coalesce(coerce_double(F.col(c)), F.lit(0.0))
        if c in RATIO_COLS:
            x = clip(x, 0, 1)
        if mode == "all_nonneg":
            x = F.greatest(x, F.lit(0.0))
        elif mode == "click_nonneg":
            if c == "inactivity_streak_14":
                x = clip(x, 0, 14)
            if "click" in c or c == "days_since_last_active":
                x = F.greatest(x, F.lit(0.0))
        out.append(x.alias(c))
    return df.select(*[F.col(k) for k in keep], *out)
