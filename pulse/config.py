"""Fixed values that results depend on.

Fixed values (must stay equal to the behaviour being reproduced):

- cutoff lists (days):
  - course clock, multi-cutoff panel: 14, 30, 60, 90, 120, 150, 180, 210
  - registration clock panels: 3, 5, 7, 10, 14, 21, 30, 45, 60, 90, 120, 150, 180
  - unregister-label panel: 14, 21, 30, 45, 60, 90, 120, 150
- trailing window 14 days, half window 7 days, pass mark 40.
- low-activity label: at most 1 active day or at most 3 clicks in the horizon.
- decline score A: weights streak 0.30, active-ratio 0.20, clicks 0.20, days-since 0.10,
  recent 0.15, trend 0.03, ratio 0.02; norms trend 30, ratio 0.60, streak 7,
  active-ratio 0.30, clicks 10, days-since 7, recent-ratio 0.35.
- decline score B: weights drop_ratio 0.30, drop_trend 0.25, low_last7 0.20,
  high_streak 0.15, high_since 0.10; pre-clips ratio [0,3], trend [-50,50],
  last7 [0,200], streak [0,14], since [0,60]; norms 1, 30, 20, 14, 14.
- heuristic risk: 0.45 streak/14 + 0.30 (1 - tanh(clicks14/10)) + 0.15 [last7 <= 1]
  + 0.10 tanh(since/5).
- blends: alpha 0.35 with tiers 0.22 / 0.50; alpha 0.70; alpha 0.55 with heuristic boost
  1.15 and display sigmoid k=8, c=0.5.
- fixed tiers (medium, high): single-row 0.30 / 0.60, batch 0.35 / 0.60,
  alternative 0.40 / 0.65; relative tiers HIGH >= t, MEDIUM >= 0.6 t.
- threshold grids: 0.10..0.90 step 0.05 and 0.05..0.95 step 0.01; default 0.5.
- precision floors 0.30 (medium) and 0.45 (high); recall target 0.80.
"""

from __future__ import annotations

CUTOFFS_COURSE = (14, 30, 60, 90, 120, 150, 180, 210)
CUTOFFS_REG = (3, 5, 7, 10, 14, 21, 30, 45, 60, 90, 120, 150, 180)
CUTOFFS_UNREG = (14, 21, 30, 45, 60, 90, 120, 150)
CUTOFFS_SHORT = (3, 7, 14)  # the ones that fall inside the 30-day demo log

WINDOW_DAYS = 14
HALF_WINDOW = 7
PASS_MARK = 40.0

LOW_ACTIVITY_MAX_DAYS = 1
LOW_ACTIVITY_MAX_CLICKS = 3

BLEND_A = {"alpha_model": 0.35, "thr_medium": 0.22, "thr_high": 0.50}
BLEND_B_ALPHA = 0.70
BLEND_H = {"alpha_model": 0.55, "heur_boost": 1.15, "k": 8.0, "c": 0.50}

TIERS_SINGLE = (0.30, 0.60)
TIERS_BATCH = (0.35, 0.60)
TIERS_ALT = (0.40, 0.65)
RELATIVE_MEDIUM_FACTOR = 0.6

GRID_COARSE = (0.10, 0.90, 0.05)
GRID_FINE = (0.05, 0.95, 0.01)
DEFAULT_THRESHOLD = 0.5
PRECISION_FLOOR_MEDIUM = 0.30
PRECISION_FLOOR_HIGH = 0.45
RECALL_TARGET = 0.80

# Cohort used on the demo tables (the demo assigns modules AAA/BBB and presentations
# 2024A/2024B from the learner id).
MODULE = "BBB"
PRESENTATIONS = ("2024A", "2024B")
PRESENTATION = "2024B"

SEED = 42
