"""Rule scores, blends, display mapping, tiers and actions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


# What a term makes of its input and its scale.
SHAPES: dict[str, Callable[[Column, float], Column]] = {
    "share": lambda x, s: x / s,
    "rise": lambda x, s: clip01(x / s),
    "lack": lambda x, s: clip01((s - x) / s),
    "fall": lambda x, s: clip01((-x) / s),
    "grow": lambda x, s: F.tanh(x / s),
    "fade": lambda x, s: 1.0 - F.tanh(x / s),
    "at_most": lambda x, s: F.when(x <= s, F.lit(1.0)).otherwise(F.lit(0.0)),
}


@dataclass(frozen=True)
class Term:
    """One weighted term of a rule score: ``weight * shape(input, scale)``.

    default  stands for a NULL input (None: NULL falls to the lower bound).
    bounds   the input is clipped to them first.
    over     the input is the smoothed ratio (feature + 1) / (over + 1).
    """

    weight: float
    feature: str
    shape: str
    scale: float
    default: float | None = 0.0
    bounds: tuple[float, float] | None = None
    over: str | None = None

    def _read(self, name: str) -> Column:
        x = F.col(name).cast("double")
        return x if self.default is None else F.coalesce(x, F.lit(self.default))

    def column(self) -> Column:
        x = self._read(self.feature)
        if self.over:
            x = (x + 1.0) / (self._read(self.over) + 1.0)
        if self.bounds:
            x = F.least(F.greatest(x, F.lit(self.bounds[0])), F.lit(self.bounds[1]))
        return F.lit(self.weight) * SHAPES[self.shape](x, self.scale)


def rule_score(terms: Sequence[Term]) -> Column:
    """The clipped sum of a rule's terms; high means risk."""
    return clip01(reduce(add, [t.column() for t in terms]))


# R1-R3 as data (the numbers are the fixed values listed in config.py).
DECLINE_A = (
    Term(0.30, "inactivity_streak_14", "rise", 7.0),
    Term(0.20, "active_ratio_14", "lack", 0.30),
    Term(0.20, "clicks_last_14_days", "lack", 10.0),
    Term(0.10, "days_since_last_active", "rise", 7.0),
    Term(0.15, "clicks_last_7_days", "lack", 0.35, over="clicks_8_14"),
    Term(0.03, "trend_click_14", "fall", 30.0),
    Term(0.02, "ratio_click_14", "lack", 0.60, default=1.0),
)
DECLINE_B = (
    Term(0.30, "ratio_click_14", "lack", 1.0, None, (0.0, 3.0)),
    Term(0.25, "trend_click_14", "fall", 30.0, None, (-50.0, 50.0)),
    Term(0.20, "clicks_last_7_days", "lack", 20.0, None, (0.0, 200.0)),
    Term(0.15, "inactivity_streak_14", "rise", 14.0, None, (0.0, 14.0)),
    Term(0.10, "days_since_last_active", "rise", 14.0, None, (0.0, 60.0)),
)
HEURISTIC = (
    Term(0.45, "inactivity_streak_14", "share", 14.0, None),
    Term(0.30, "clicks_last_14_days", "fade", 10.0, None),
    Term(0.15, "clicks_last_7_days", "at_most", 1.0, None),
    Term(0.10, "days_since_last_active", "grow", 5.0, None),
)


def decline_score_a() -> Column:
    return rule_score(DECLINE_A)


def decline_score_b() -> Column:
    return rule_score(DECLINE_B)


def heuristic_risk() -> Column:
    return rule_score(HEURISTIC)


def blend(p: Column, rule: Column, alpha: float) -> Column:
    """Alpha * model + (1 - alpha) * rule."""
    return F.lit(alpha) * p + F.lit(1.0 - alpha) * rule


def heuristic_blend(p: Column, alpha: float = C.BLEND_H["alpha_model"]) -> dict[str, Column]:
    """R13, third form: model probability with the boosted heuristic, and its display value."""
    heur = heuristic_risk()
    raw = blend(p, boosted(heur), alpha)
    return {"heuristic_risk": heur, "heur_boosted": boosted(heur), "risk_score": raw, "display": display_sigmoid(raw)}


def boosted(rule: Column, boost: float = C.BLEND_H["heur_boost"]) -> Column:
    return clip01(rule * boost)


def display_sigmoid(raw: Column, k: float = C.BLEND_H["k"], c: float = C.BLEND_H["c"]) -> Column:
    """1 / (1 + exp(-k (raw - c)))."""
    return 1.0 / (1.0 + F.exp(-F.lit(k) * (raw - F.lit(c))))


def tier(score: Column, medium: float, high: float, labels=("LOW", "MEDIUM", "HIGH")) -> Column:
    """Fixed cut-points, HIGH >= high, MEDIUM >= medium."""
    return (F.when(score >= high, F.lit(labels[2])).when(score >= medium, F.lit(labels[1]))
            .otherwise(F.lit(labels[0])))


def tier_cols(score: Column, medium: Column, high: Column) -> Column:
    """Tiers against cut-points held in columns (a joined threshold row)."""
    return F.when(score >= high, F.lit("HIGH")).when(score >= medium, F.lit("MEDIUM")).otherwise(F.lit("LOW"))


def relative_tier(score: Column, thr: Column) -> Column:
    """HIGH >= t, MEDIUM >= 0.6 t, else LOW."""
    return tier_cols(score, thr * C.RELATIVE_MEDIUM_FACTOR, thr)


def decision(score: Column, thr) -> Column:
    """1 when score >= threshold."""
    t = thr if isinstance(thr, Column) else F.lit(float(thr))
    return F.when(score >= t, F.lit(1)).otherwise(F.lit(0))


def action(tier_col: Column) -> Column:
    """LOW -> SAFE, MEDIUM -> REMIND, HIGH -> ALERT."""
    return (F.when(tier_col == "HIGH", F.lit("ALERT")).when(tier_col == "MEDIUM", F.lit("REMIND"))
            .otherwise(F.lit("SAFE")))
