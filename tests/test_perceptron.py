import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler

from pulse.ml import perceptron as P


def frame(spark, n, parts=3, seed=0):
    rng = np.random.RandomState(seed)
    x = rng.normal(size=(n, 3))
    y = ((x[:, 0] * x[:, 1] > 0) | (x[:, 2] > 1.2)).astype(float)
    df = spark.createDataFrame([(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, a double, b double, c double, label double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df.repartition(parts)), x, y


def test_gradient_is_the_numerical_one():
    rng = np.random.RandomState(1)
    x, y = rng.normal(size=(7, 4)), (rng.rand(7) < 0.5).astype(float)
    w = P.initial([4, 5, 3, 1], rng)

    def loss():
        p = P.forward(w, x)[-1][:, 0]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()
    for g, a in zip(P.gradient(w, x, y), w):
        flat, d = a.ravel(), g.ravel()
        for i in range(0, flat.size, 3):
            keep = flat[i]
            flat[i] = keep + 1e-6
            up = loss()
            flat[i] = keep - 1e-6
            down = loss()
            flat[i] = keep
            assert abs((up - down) / 2e-6 - d[i]) < 1e-5


def test_steps_of_the_rules():
    w, g = [np.array([1.0, -2.0])], [np.array([0.5, -0.1])]
    one = P.Momentum(0.1, 0.9).move(w, g)[0]
    assert np.allclose(one, w[0] - 0.1 * g[0] - 0.09 * g[0])
    assert np.allclose(P.Adam(0.01).move(w, g)[0], w[0] - 0.01 * np.sign(g[0]), atol=1e-6)


@pytest.mark.parametrize("hidden, solver, rate, alpha", [((12,), "sgd", 0.3, 0.1), ((16, 8), "adam", 0.01, 1e-3)])
def test_learns_and_does_not_depend_on_the_layout(spark, hidden, solver, rate, alpha):
    fits = []
    for parts in (2, 5):
        df, x, y = frame(spark, 600, parts)
        fits.append(P.fit_perceptron(df, ["id"], hidden, solver=solver, rate=rate, alpha=alpha, batches=3, epochs=12, patience=None))
    a, b = (f.probability(x) for f in fits)
    assert np.abs(a - b).max() < 1e-5
    assert ((a > 0.5) == (y == 1)).mean() > max(y.mean(), 1 - y.mean()) + 0.1
    scored = fits[0].transform(df).collect()
    assert max(abs(r.probability[1] - a[r.id]) for r in scored) < 1e-12
    assert np.array_equal(P.Perceptron.from_dict(fits[0].to_dict()).probability(x), a)


def test_early_stop_keeps_the_best_epoch(spark):
    df, x, y = frame(spark, 500)
    m = P.fit_perceptron(df, ["id"], (4,), rate=0.2, batches=2, epochs=40, patience=2)
    assert 3 <= len(m.history) < 40
    from pulse.ml.boost import uniform
    h = np.array([r[0] for r in df.selectExpr(f"xxhash64(id, {P.C.SEED}) AS h", "id").orderBy("id").select("h").collect()])
    held = uniform(h, -1) < 0.1
    assert abs(((m.probability(x[held]) > 0.5) == (y[held] == 1)).mean() - max(m.history)) < 1e-12


def test_steps_run_on_few_even_pieces(spark, monkeypatch):
    """Every step reads all rows: hundreds of small pieces are packed first."""
    from pulse.ml import boost
    seen = []
    for module in (P, boost):
        monkeypatch.setattr(module, "parts_for", lambda s, n: seen.append(n) or 2)
    rows = spark.createDataFrame([(i, float(i % 5), float(i % 2)) for i in range(200)], "id long, a double, label double").repartition(30)
    rows = VectorAssembler(inputCols=["a"], outputCol="features").transform(rows)
    P.fit_perceptron(rows, ["id"], hidden=(2,), epochs=1, batches=1, patience=None)
    boost.fit_boosted(rows, ["id"], stages=1, depth=1)
    assert seen == [200, 200]


def test_one_task_and_a_job_a_step_give_the_same_weights(spark, monkeypatch):
    from pulse.ml import blocks
    df, x, y = frame(spark, 700)
    fits = []
    for most in (blocks.IN_TASK, 0):  # 0: every step is a job, as on large tables
        monkeypatch.setattr(blocks, "IN_TASK", most)
        fits.append(P.fit_perceptron(df, ["id"], (6,), rate=0.05, batches=3, epochs=6, patience=3))
    assert np.abs(fits[0].probability(x) - fits[1].probability(x)).max() < 1e-6
    assert fits[0].history == pytest.approx(fits[1].history)
