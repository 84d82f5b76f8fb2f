"""Model queries whose invariants SQL confirms, on tables large enough to fit models."""

import pytest
from test_oracle import _rows

from pulse import registry
from pulse.plans import checks as K
from pulse.plans import recipes as R

SF = "/root/testdata/sf0.01"
CHEAP = ("blended_risk_check", "blended_risk_heuristic_check", "daily_scores_check", "json_scan_scored", "model_roundtrip_check",
         "score_raw_batch_check", "score_raw_history_check", "score_with_threshold_check")


@pytest.mark.parametrize("name", CHEAP)
def test_check_matches_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    assert _rows(got) == _rows(duck(SF).execute(registry.oracle_sql()[name]).df())


def test_a_recipe_prepares_once_per_key(spark, monkeypatch):
    made = []
    real = R.prepare
    monkeypatch.setattr(R, "prepare", lambda *a, **k: made.append(k) or real(*a, **k))
    small = R.Recipe(label="y_short", k=2, threshold="train_folds", models=(
        R.Model("a", "logreg", {"penalty": "l2", "C": 2.0}, weights="balanced"), R.Model("b", "logreg", {"penalty": "l1", "C": 1.0}, weights="balanced"),
        R.Model("c", "forest", {"trees": 4, "depth": 3, "min_leaf": 5}, oversample=0.6, power=False)))
    panel, ids, features = R.panel_of(spark, SF, small)
    run = R.run_folds(panel, small, ids, features=features)
    assert len(made) == len(run.prepared) == 4  # two folds x two different needs of three models
    assert {k[1:] for k in run.prepared} == {(None, True, "balanced"), (0.6, False, None)}
    board = run.board.collect()
    assert [r.criterion for r in board] == sorted((r.criterion for r in board), reverse=True) and len(board) == 3
    n = panel.count()
    assert {r["model"]: r["count"] for r in run.scored.where("side = 'test'").groupBy("model").count().collect()} == dict.fromkeys("abc", n)


def test_light_keeps_everything_but_iterations():
    light = R.DAY7.light(**K.LIGHT)
    assert [m.name for m in light.models] == [m.name for m in R.DAY7.models] and light.choose == "pooled_ap"
    assert light.models[0].settings == {"trees": 30, "depth": 12, "min_leaf": 5}


def test_threshold_check_equals_all_pairs(spark):
    """F1 of every distinct score, with more scores than cells, ties, and one cell for most of them."""
    import random
    rng = random.Random(5)
    rows = [(m, f, round(rng.random() ** 4, 3), rng.randint(0, 1)) for m in "ab" for f in (0, 1) for _ in range(400)]
    s = spark.createDataFrame(rows, "model string, fold int, proba double, y int")
    got = {(r.model, r.fold, r.t): r.f1 for r in K.threshold_f1(s, ["model", "fold"], cells=8).collect()}
    assert set(got) == {r[:3] for r in rows}
    for (m, f, t), f1 in got.items():
        own = [(p, y) for a, b, p, y in rows if (a, b) == (m, f)]
        tp, n = sum(y for p, y in own if p >= t), sum(p >= t for p, y in own)
        assert f1 == pytest.approx(2 * tp / (n + sum(y for _, y in own)))


@pytest.mark.parametrize("key, recipe", [("train_v8", R.EARLY_WARNING), ("train_v9", R.UNREGISTER), ("train_v10", R.DAY7)])
def test_registered_recipes_run_whole(monkeypatch, key, recipe):
    from types import SimpleNamespace
    ran = []
    monkeypatch.setattr(K, "_RUNS", {})
    monkeypatch.setattr(K.R, "train", lambda spark, sf, r: ran.append(r) or {"run": SimpleNamespace(board="board")})
    session = SimpleNamespace(sparkContext=SimpleNamespace(applicationId="app"))
    assert registry.queries()[key](session, "at") == "board" and ran == [recipe]
    assert all(m.settings["epochs"] >= 800 for m in recipe.models if m.kind == "perceptron")  # early stop ends them
