import re

import numpy as np
from pyspark.sql import functions as F

from pulse.ml import folds as FO
from pulse.ml import metrics as M
from pulse.ml import ranks
from pulse.ml import thresholds as TH


def test_running_sums_against_numpy(spark):
    rng = np.random.RandomState(2)
    rows = [(None if i % 7 == 0 else i % 3, float(v), int(w), i) for i, (v, w) in enumerate(zip(rng.rand(900), rng.randint(0, 9, 900)))]
    df = spark.createDataFrame(rows, "g int, v double, w long, id long")
    for piece in (13, 400, 10_000):
        got = ranks.running_sums(df, ["g"], [F.col("v").desc(), F.col("id")], {"s": F.col("w"), "n": F.lit(1)}, {"total": "s"}, piece).collect()
        assert len(got) == 900
        for g in (None, 0, 1, 2):
            part = sorted((r for r in got if r.g == g), key=lambda r: -r.v)
            assert [r.s for r in part] == np.cumsum([r.w for r in part]).tolist()
            assert [r.n for r in part] == list(range(1, len(part) + 1)) and {r.total for r in part} == {sum(r.w for r in part)}


def test_plan_does_not_grow_and_pieces_do(spark):
    def of(n):
        df = spark.range(n).select((F.col("id") % 2).alias("g"), (F.lit(0.5) + F.rand(3) / 1e6).alias("s"), (F.col("id") % 3 == 0).cast("int").alias("y"))
        out = M.cumulative_desc(M.score_counts(df, ["g"], "s", "y"), ["g"], "s", piece=500)
        return out, len(re.findall(r"\d+\.\d{5,}", out._jdf.queryExecution().optimizedPlan().toString()))
    small, a = of(100)
    large, b = of(10_000)
    assert a == b == 0
    placed = ranks.running_sums(spark.range(10_000), [], [F.col("id")], {"n": F.lit(1)}, piece=500)
    assert placed.where("n <> id + 1").count() == 0
    assert large.count() > 9_900  # crowded scores: every distinct one is a row


def sizes(df, *more):
    return [tuple(r) for r in df.groupBy("fold", *more).count().orderBy("fold", *more).collect()]


def test_even_folds(spark):
    rng = np.random.RandomState(4)
    counts = [int(c) for c in rng.zipf(1.6, 300).clip(1, 60)]
    rows = [(i, j, int(rng.rand() < 0.2 + 0.6 * (i % 5 == 0))) for i, c in enumerate(counts) for j in range(c)] + [(None, 0, 1), (None, 1, 0)]
    df = spark.createDataFrame(rows, "id long, j int, y int")
    even = FO.even_group_folds(df, "id")
    assert even.count() == len(rows) and even.groupBy("id").agg(F.countDistinct("fold").alias("k")).where("k > 1").count() == 0
    n = [r[-1] for r in sizes(even)]
    assert max(n) - min(n) <= max(counts)
    fair = FO.even_group_folds(df, "id", "y")
    ones = np.array([[r[-1] for r in sizes(fair, "y") if r[1] == y] for y in (0, 1)], float)
    share = ones / ones.sum(1, keepdims=True)
    # One group after the other, largest first, to the fold that keeps the shares most even.
    per = {}
    for i, _, y in rows:
        per.setdefault(i, [0, 0])[y] += 1
    held = np.zeros((5, 2))
    total = ones.sum(1)
    for v in sorted(per.values(), key=lambda v: (-sum(v), v)):
        f = min(range(5), key=lambda k: (((held + np.eye(5)[k][:, None] * v) / total) ** 2).sum())
        held[f] += v
    brute = held.T / total[:, None]
    assert np.abs(share - 0.2).max() <= np.abs(brute - 0.2).max() + max(counts) / total.min()
    assert sorted(map(tuple, even.collect()), key=str) == sorted(map(tuple, FO.even_group_folds(df.repartition(7), "id").collect()), key=str)


def test_plan_folds_bounds():
    plan = FO.plan_folds({(3,): 12, (50,): 7, (1,): 4}, 5)
    assert {v: len(r) for v, r in plan.items()} == {(3,): 2, (50,): 2, (1,): 4} and plan[(50,)] == [0, 1] and plan[(3,)] == [2, 3]
    assert FO.plan_folds({}, 5) == {}


def test_thresholds_of_the_training_side(spark):
    rng = np.random.RandomState(6)
    s = rng.rand(400).round(2)
    y = (rng.rand(400) < s).astype(int)
    fold = rng.randint(0, 4, 400)
    df = spark.createDataFrame([(float(a), int(b), int(f)) for a, b, f in zip(s, y, fold)], "s double, y int, fold int")
    got = {r.fold: r for r in TH.train_fold_thresholds(TH.fold_sides(df, 4), [], "s", "y").collect()}

    def f1(mask, t):
        tp, fp, fn = ((s >= t) & (y == 1) & mask).sum(), ((s >= t) & (y == 0) & mask).sum(), ((s < t) & (y == 1) & mask).sum()
        return 2 * tp / (2 * tp + fp + fn)
    for f in range(4):
        best = max(sorted(set(s[fold != f])), key=lambda t: round(f1(fold != f, t), 9))
        assert got[f].threshold == best and abs(got[f].test_f1 - f1(fold == f, best)) < 1e-12
    m = TH.median_threshold(TH.train_fold_thresholds(TH.fold_sides(df, 4), [], "s", "y"), []).first()
    assert m.threshold == np.median([r.threshold for r in got.values()])
