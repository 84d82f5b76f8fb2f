import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler

from pulse.ml.boost import BoostedTrees, fit_boosted


def data(n, seed=0):
    rng = np.random.RandomState(seed)
    x = np.stack([rng.randint(0, 12, n), rng.randint(0, 9, n), rng.randint(0, 20, n)], 1).astype(float)
    y = (x[:, 0] + 2 * (x[:, 1] > 4) * x[:, 2] / 6 + rng.normal(0, 2, n) > 8).astype(float)
    return x, y


def frame(spark, x, y, parts=3):
    df = spark.createDataFrame([(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, a double, b double, c double, label double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df.repartition(parts))


def brute(x, y, loss, rate, stages, depth, min_leaf):
    """Trees over all thresholds, without bins or sums by node."""
    s, p = 2 * y - 1, y.mean()
    f = np.full(len(y), np.log(p / (1 - p)) * (0.5 if loss == "exponential" else 1.0))
    for _ in range(stages):
        if loss == "exponential":
            g, c = s * np.exp(-s * f), np.exp(-s * f)
        else:
            q = 1 / (1 + np.exp(-f))
            g, c = y - q, q * (1 - q)

        def grow(at, d):
            best = None
            if d < depth and len(at) >= 20:
                for j in range(x.shape[1]):
                    for t in np.unique(x[at, j])[:-1]:
                        left = x[at, j] <= t
                        n, m = left.sum(), (~left).sum()
                        if min(n, m) >= min_leaf:
                            gain = n * m / (n + m) * (g[at][left].mean() - g[at][~left].mean()) ** 2
                            if best is None or gain > best[0] + 1e-9:
                                best = gain, left
            if best is None or best[0] <= 1e-12:
                step[at] = g[at].sum() / c[at].sum()
            else:
                grow(at[best[1]], d + 1)
                grow(at[~best[1]], d + 1)
        step = np.zeros(len(y))
        grow(np.arange(len(y)), 0)
        f = f + rate * step
    return f


@pytest.mark.parametrize("loss", ["exponential", "logistic"])
def test_equals_brute_force(spark, loss):
    x, y = data(300)
    m = fit_boosted(frame(spark, x, y), ["id"], loss=loss, rate=0.3, stages=3, depth=3, min_leaf=15, bins=64)
    assert np.abs(m.raw(x) - brute(x, y, loss, 0.3, 3, 3, 15)).max() < 1e-5
    again = BoostedTrees.from_dict(m.to_dict())
    assert np.array_equal(again.probability(x), m.probability(x))
    scored = m.transform(frame(spark, x, y)).collect()
    assert max(abs(r.probability[1] - m.probability(x)[r.id]) for r in scored) < 1e-12


def test_same_trees_on_every_layout_and_early_stop(spark):
    x, y = data(1500, 1)
    fits = [fit_boosted(frame(spark, x, y, parts), ["id"], rate=0.5, stages=25, depth=2, min_leaf=5, subsample=0.8, patience=3, bins=16) for parts in (2, 5)]
    assert fits[0] == fits[1]
    h = fits[0].history
    assert len(fits[0].trees) < 25 and h[0] > min(h)
    last = h[-1]
    assert not last + 1e-4 < min(h[-4:-1])
    full = fit_boosted(frame(spark, x, y), ["id"], rate=0.5, stages=3, depth=2, min_leaf=5, bins=16)
    assert len(full.trees) == 3 and full.history == []


def test_no_split_and_one_class(spark):
    x = np.ones((60, 3))
    y = (np.arange(60) % 3 == 0).astype(float)
    m = fit_boosted(frame(spark, x, y), ["id"], stages=2)
    assert np.abs(m.probability(x) - 1 / 3).max() < 1e-6
    assert fit_boosted(frame(spark, x, np.ones(60)), ["id"], stages=1).probability(x).min() > 0.99


@pytest.mark.parametrize("loss, subsample, patience", [("exponential", 1.0, None), ("logistic", 0.8, 4)])
def test_one_task_and_a_job_a_level_give_the_same_trees(spark, monkeypatch, loss, subsample, patience):
    from pulse.ml import blocks
    x, y = data(900, 2)
    fits = []
    for most in (blocks.IN_TASK, 0):  # 0: every level is a job, as on large tables
        monkeypatch.setattr(blocks, "IN_TASK", most)
        fits.append(fit_boosted(frame(spark, x, y), ["id"], loss=loss, rate=0.3, stages=11, depth=3, min_leaf=10, subsample=subsample, patience=patience))
    assert fits[0] == fits[1] and len(fits[0].trees) > 8
