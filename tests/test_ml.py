"""Metrics, thresholds, folds, Yeo-Johnson and SMOTE against brute force on small frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulse.ml import folds as FO
from pulse.ml import metrics as M
from pulse.ml import thresholds as TH
from pulse.ml.prep import fit_yeo_johnson
from pulse.ml.smote import smote


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.RandomState(3)
    n = 400
    y = rng.randint(0, 2, n)
    s = np.round(np.clip(0.3 * y + rng.rand(n) * 0.7, 0, 1), 2)  # many ties
    rows = [(i, int(i % 3), float(s[i]), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, g int, score double, y int"), rows


def brute_auc(pairs):
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    tot = sum((1.0 if p > q else 0.5 if p == q else 0.0) for p in pos for q in neg)
    return tot / (len(pos) * len(neg))


def brute_ap(pairs):
    ths = sorted({s for s, _ in pairs}, reverse=True)
    P = sum(y for _, y in pairs)
    ap, prev_r = 0.0, 0.0
    for t in ths:
        tp = sum(1 for s, y in pairs if s >= t and y == 1)
        fp = sum(1 for s, y in pairs if s >= t and y == 0)
        r = tp / P
        ap += (r - prev_r) * (tp / (tp + fp))
        prev_r = r
    return ap


def test_auc_and_ap_match_brute_force(scored):
    df, rows = scored
    auc = {r["g"]: r["auc"] for r in M.roc_auc(df, ["g"], "score", "y").collect()}
    ap = {r["g"]: r["average_precision"] for r in M.average_precision(df, ["g"], "score", "y").collect()}
    for g in range(3):
        pairs = [(s, y) for _, gg, s, y in rows if gg == g]
        assert auc[g] == pytest.approx(brute_auc(pairs), abs=1e-6)
        assert ap[g] == pytest.approx(brute_ap(pairs), abs=1e-6)


def test_threshold_searches_match_loops(scored):
    df, rows = scored
    pairs = [(s, y) for _, _, s, y in rows]
    one = df.withColumn("_g", F.lit(1))
    # precision floor: lowest threshold whose precision >= floor (max recall)
    ths = sorted({s for s, _ in pairs})
    best_t, best_r = 0.5, -1
    P = sum(y for _, y in pairs)
    for t in ths:
        tp = sum(1 for s, y in pairs if s >= t and y == 1)
        fp = sum(1 for s, y in pairs if s >= t and y == 0)
        p, r = tp / (tp + fp), tp / P
        if p >= 0.6 and r > best_r:
            best_t, best_r = t, r
    got = TH.precision_floor(one, ["_g"], "score", "y", 0.6).collect()[0]
    assert got["threshold"] == pytest.approx(best_t) and got["recall"] == pytest.approx(best_r, abs=1e-6)
    # F1 grid with first strict improvement
    grid = TH.grid((0.10, 0.90, 0.05))
    assert len(grid) == 17
    bt, bf = 0.5, 0.0
    for t in grid:
        tp = sum(1 for s, y in pairs if s >= t and y == 1)
        fp = sum(1 for s, y in pairs if s >= t and y == 0)
        fn = sum(1 for s, y in pairs if s < t and y == 1)
        f1 = 2 * tp / (2 * tp + fp + fn) if tp else 0.0
        if f1 > bf:
            bt, bf = t, f1
    got = TH.f1_grid(one, ["_g"], "score", "y", grid, 0.0).collect()[0]
    assert got["best_threshold"] == pytest.approx(round(bt, 6)) and got["best_f1"] == pytest.approx(bf, abs=1e-6)
    assert len(TH.grid((0.05, 0.95, 0.01))) == 91


def test_exact_rank_is_a_permutation_per_stratum(spark):
    df = spark.range(0, 3000).select(F.col("id"), (F.col("id") % 2).alias("s"))
    r = FO.exact_rank(df, ["s"], FO.hash_key(["id"]), ["id"])
    for s in (0, 1):
        ranks = sorted(x[0] for x in r.where(F.col("s") == s).select("_rank").collect())
        assert ranks == list(range(1500))


def test_group_and_stratified_folds(spark):
    rows = [(i, c, int(i % 4 == 0)) for i in range(200) for c in (3, 7)]
    df = spark.createDataFrame(rows, "id long, cutoff int, y int")
    g = FO.group_folds(df, "id", 5)
    assert g.groupBy("id").agg(F.countDistinct("fold").alias("k")).where("k > 1").count() == 0
    s = FO.strat_group_folds(df, "id", "y", 5)
    per = s.select("id", "y", "fold").distinct().groupBy("y", "fold").count().collect()
    for y in (0, 1):
        counts = [r["count"] for r in per if r["y"] == y]
        assert max(counts) - min(counts) <= 1
    sp = FO.stratified_split(df, "y", ["id", "cutoff"], 0.7)
    for y, n in ((0, 300), (1, 100)):
        assert sp.where((F.col("y") == y) & F.col("is_train")).count() == int(n * 0.7)


def test_yeo_johnson_lambda_close_to_dense_search(spark):
    rng = np.random.RandomState(0)
    x = np.concatenate([rng.exponential(3.0, 800), -rng.exponential(0.5, 200)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    lam = fit_yeo_johnson(df, ["x"])["x"]["lambda"]

    def yj(v, l):
        out = np.empty_like(v)
        p, n = v >= 0, v < 0
        out[p] = np.log1p(v[p]) if abs(l) < 1e-12 else ((v[p] + 1) ** l - 1) / l
        out[n] = -np.log1p(-v[n]) if abs(l - 2) < 1e-12 else -((1 - v[n]) ** (2 - l) - 1) / (2 - l)
        return out

    def ll(l):
        return -len(x) / 2 * np.log(np.var(yj(x, l))) + (l - 1) * np.sum(np.sign(x) * np.log1p(np.abs(x)))
    grid = np.linspace(-3, 3, 6001)
    best = grid[np.argmax([ll(l) for l in grid])]
    assert abs(lam - best) < 0.01


def test_smote_balances_and_interpolates(spark):
    rows = [(i, 0, float(i % 10), float(i % 7)) for i in range(90)] + \
           [(100 + i, 1, 20.0 + i, 5.0 + 0.5 * i) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double")
    out = smote(df, ["a", "b"], "y", ["id"], k=3)
    counts = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts[0] == counts[1] == 90
    syn = out.where("is_synthetic = 1").collect()
    assert len(syn) == 80
    for r in syn:  # convex combinations of minority rows stay inside their bounding box
        assert 20.0 <= r["a"] <= 29.0 and 5.0 <= r["b"] <= 9.5
    again = smote(df, ["a", "b"], "y", ["id"], k=3).where("is_synthetic = 1")
    assert sorted(tuple(x) for x in again.collect()) == sorted(tuple(x) for x in syn)


def test_yeo_johnson_finds_an_optimum_far_outside_the_first_range(spark):
    rng = np.random.RandomState(3)
    for x in (np.append(rng.beta(0.6, 8.0, 600) * 0.4, [0.9]), 1.0 + 0.02 * rng.gamma(1.0, 1.0, 500), 1.0 - 0.01 * rng.gamma(1.0, 1.0, 400)):
        df = spark.createDataFrame([(float(v),) for v in x], "x double").checkpoint()
        got = fit_yeo_johnson(df, ["x"])["x"]

        def ll(lam):  # spread of (x + 1)^lambda: all values are positive
            z = np.log1p(x) if abs(lam) < 1e-12 else (x + 1) ** lam / lam
            return -len(x) * np.log(np.std(z)) + (lam - 1) * np.sum(np.log1p(x))
        coarse = np.arange(-200, 200, 0.5)
        best = coarse[np.argmax([ll(v) for v in coarse])]
        fine = np.arange(best - 0.5, best + 0.5, 0.0005)
        best = fine[np.argmax([ll(v) for v in fine])]
        assert abs(best) > 3 and abs(got["lambda"] - best) <= 0.003


def test_curves_when_all_scores_crowd_together(spark):
    from pulse.ml import metrics as M
    rng = np.random.RandomState(5)
    s, y = 0.5 + rng.rand(2000) / 1000, rng.rand(2000) < 0.4
    df = spark.createDataFrame([(1, float(a), int(b)) for a, b in zip(s, y)], "g int, s double, y int")
    pos, neg = np.sort(s[y]), np.sort(s[~y])
    want = np.mean([(neg < p).mean() + 0.5 * (neg == p).mean() for p in pos])
    assert abs(M.roc_auc(df, ["g"], "s", "y").first()["auc"] - want) < 1e-12
    c = M.cumulative_desc(M.score_counts(df, ["g"], "s", "y"), ["g"], "s", piece=7)
    assert c.count() == len(set(s))


def _recall(x, found, k):
    """Share of the k neighbours that are as near as the true ones."""
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    kth = np.sort(d, axis=1)[:, k - 1]
    return np.mean([np.mean([d[i, j] <= kth[i] + 1e-9 for j in js]) for i, js in found.items()])


def test_oversampling_neighbours_against_brute_force(spark):
    from pulse.ml import smote as S
    from pulse.plans import train as TR
    from pulse.operators.snapshot import FEATURES_15
    panel = TR.training_panel(spark, "/root/testdata/sf0.01")
    rows = panel.where("y_short = 0").select("id_student", "cutoff", *FEATURES_15).collect()
    if len(rows) > panel.count() / 2:
        rows = panel.where("y_short = 1").select("id_student", "cutoff", *FEATURES_15).collect()
    x = np.array([[float(r[c]) for c in FEATURES_15] for r in rows])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "_id long, _x array<double>")
    S.ensure_checkpoint_dir(spark)
    found = {r["_id"]: [c["id"] for c in r["_nb"]] for r in S.neighbours(df, 5, x.shape[1]).collect()}
    assert len(found) == len(x) and all(len(v) == 5 and i not in v for i, v in found.items())
    assert _recall(x, found, 5) >= 0.9


def test_oversampling_neighbours_across_blocks_and_ties(spark, monkeypatch):
    from pulse.ml import smote as S
    monkeypatch.setattr(S, "BLOCK", 64)
    rng = np.random.RandomState(1)
    x = np.concatenate([rng.normal(size=(700, 4)) * [5, 3, 1, 0.2], np.zeros((300, 4))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "_id long, _x array<double>")
    S.ensure_checkpoint_dir(spark)
    found = {r["_id"]: [c["id"] for c in r["_nb"]] for r in S.neighbours(df, 5, 4).collect()}
    assert len(found) == 1000 and _recall(x, found, 5) >= 0.9


def test_yeo_johnson_continuous_optimum(spark):
    rng = np.random.RandomState(9)
    columns = {"a": rng.exponential(3.0, 700), "b": np.append(rng.beta(0.6, 8.0, 699) * 0.4, [0.9]), "c": rng.normal(2, 1, 700), "d": rng.gamma(2.0, 9.0, 700)}
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*columns.values())], "a double, b double, c double, d double").checkpoint()
    got = fit_yeo_johnson(df, list(columns), tol=1e-6)

    def ll(x, lam):
        p = x >= 0
        z = np.where(p, np.expm1(lam * np.log1p(np.where(p, x, 0))) / lam, -np.expm1((2 - lam) * np.log1p(np.where(p, 0, -x))) / (2 - lam))
        return -len(x) * np.log(np.std(z)) + (lam - 1) * np.sum(np.sign(x) * np.log1p(np.abs(x)))
    for c, x in columns.items():
        lo, hi = got[c]["lambda"] - 0.05, got[c]["lambda"] + 0.05
        for _ in range(60):  # golden section
            a, b = hi - 0.618 * (hi - lo), lo + 0.618 * (hi - lo)
            lo, hi = (lo, b) if ll(x, a) > ll(x, b) else (a, hi)
        assert abs((lo + hi) / 2 - got[c]["lambda"]) < 1e-5 * max(1, abs(got[c]["lambda"]))
    assert abs(got["b"]["lambda"]) > 2


def test_calibrator_none_passes_through(spark):
    from pulse.ml.calibrate import apply_platt
    df = spark.createDataFrame([(0.0,), (0.3,), (1.0,)], "p double")
    assert [r[0] for r in df.select(apply_platt(F.col("p"), None)).collect()] == [0.0, 0.3, 1.0]
    assert abs(df.select(apply_platt(F.col("p"), {"a": 2.0, "b": -1.0}).alias("q")).collect()[1]["q"] - 1 / (1 + np.exp(0.4))) < 1e-12


def test_yeo_johnson_statistics_without_a_row_per_lambda(spark):
    """Moments by (column, lambda) equal numpy's, over signs, nulls and layouts, and no row is copied."""
    from pulse.ml import prep as P
    rng = np.random.RandomState(4)
    x = np.column_stack([rng.gamma(1.0, 5.0, 3000), rng.normal(0, 2, 3000)])
    rows = [(float(a), None if i % 7 == 0 else float(b)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(5)
    grids = {"a": [-2.0, 0.0, 0.5, 2.0], "b": [-1.0, 0.0, 1.5, 2.0]}
    found = P._by_lambda(df, ["a", "b"], grids)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.f, r.lam): r for r in found.collect()}
    assert len(got) == 8
    for (f, lam), r in got.items():
        v = np.array([p[f] for p in rows if p[f] is not None])
        t = np.log1p(np.abs(v))
        pos = t if lam == 0 else ((np.abs(v) + 1) ** lam - 1) / lam
        neg = -t if lam == 2 else -((np.abs(v) + 1) ** (2 - lam) - 1) / (2 - lam)
        y = np.where(v >= 0, pos, neg)
        assert r.n == len(v) and r.least == v.min()
        assert [r["mean"], r["std"], r.largest, r.jac] == pytest.approx([y.mean(), y.std(), np.abs(y).max(), (np.sign(v) * t).sum()], rel=1e-9)
        if f == 0 and lam:
            assert r.spread == pytest.approx((((v + 1) ** lam) / lam).std(), rel=1e-9)


def test_rows_are_spread_over_the_cores(spark):
    """Few bytes, much work: a packed frame is dealt out again, a small one stays in one piece."""
    from pulse.session import parts_for, spread
    cores = spark.sparkContext.defaultParallelism
    packed = spark.range(20_000).coalesce(1).checkpoint()
    out = spread(packed)
    assert out.rdd.getNumPartitions() == cores > 1
    assert out.groupBy().agg(F.count_distinct("id"), F.sum("id")).first()[:] == (20_000, 19_999 * 10_000)
    assert parts_for(spark, 100) == 1 and parts_for(spark, (1 << 16) * 100) == 100


def test_training_layout_fills_partitions_at_size(spark):
    """The layout follows the rows only; beyond 48 partitions they are filled before there are more."""
    from pulse.ml.models import train_parts
    assert [train_parts(n) for n in (0, 1, 4096, 4097, 9_750, 58_500)] == [1, 1, 1, 2, 3, 15]
    assert [train_parts(n) for n in (585_000, 48 << 16, 3_510_000)] == [48, 48, 54]


def test_oversampling_neighbours_of_one_task_are_those_of_the_windows(spark, monkeypatch):
    from pulse.ml import smote as S
    rng = np.random.RandomState(4)
    x = np.concatenate([rng.randint(0, 6, (500, 4)).astype(float), np.zeros((60, 4))])  # many equal distances
    df = spark.createDataFrame([((i * 7919) % 1000, i % 3, [None if v == 5 else float(v) for v in r]) for i, r in enumerate(x)], "a long, b int, _x array<double>")
    df = df.selectExpr("struct(if(a = 8, null, a) AS a, b) AS _id", "_x")
    S.ensure_checkpoint_dir(spark)
    found = []
    for most in (S.IN_TASK, 0):
        monkeypatch.setattr(S, "IN_TASK", most)
        found.append(sorted((repr(r._id), [(c.d, c.id, c.x) for c in r._nb]) for r in S.neighbours(df, 5, 4).collect()))
    assert found[0] == found[1] and len(found[0]) == 560
    one = df.limit(1)
    monkeypatch.setattr(S, "IN_TASK", 9)
    assert [r._nb for r in S.neighbours(one, 5, 4).collect()] == [[]] and S.neighbours(df.limit(0), 5, 4).count() == 0
