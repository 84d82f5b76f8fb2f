"""Physical-plan properties that matter at scale."""

import re

import pytest

from pulse import registry

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def static_spark(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def test_no_cartesian_nested_loop_or_python_in_sql_queries(static_spark):
    bad = []
    for name in registry.oracle_sql():
        if name.endswith("_check") or name == "json_scan_scored":  # fit models first; tests/test_checks.py runs them
            continue
        p = _plan(registry.queries()[name](static_spark, SF))
        for k in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
            if k in p:
                bad.append((name, k))
    assert bad == []


def test_panel_aggregate_reuses_join_partitioning(static_spark):
    p = _plan(registry.queries()["snapshot_v8"](static_spark, SF))
    # the final (id, cutoff) aggregate sits directly on the outer join: no Exchange between
    top = p.split("SortMergeJoin")[0]
    assert "Exchange" not in top
    assert "LeftOuter" in p


def test_filters_and_columns_reach_the_scan(static_spark):
    p = _plan(registry.queries()["snapshot_v8"](static_spark, SF))
    scans = [line for line in p.splitlines() if "FileScan parquet" in line and "event_type" in line]
    assert any("EqualTo(event_type,click)" in s for s in scans)
    for s in scans:
        schema = re.search(r"ReadSchema: struct<([^>]*)>", s).group(1)
        assert "value" not in schema  # unused columns are pruned


@pytest.mark.parametrize("name", ["snapshot_v9", "repeat_snapshot_v9", "snapshot_v8_prefix"])
def test_carried_rows_leave_the_panel_aggregates_hash_aggregates(static_spark, name):
    p = _plan(registry.queries()[name](static_spark, SF))
    assert "SortAggregate" not in p and "HashAggregate" in p


def test_a_bundle_is_read_without_building_the_panel(spark, monkeypatch):
    """Queries that score other rows need the saved model only."""
    from pulse.plans import catalog as Q
    monkeypatch.setattr(Q, "_bundle_path", lambda spark, sf, name: f"{sf}/{name}")
    monkeypatch.setattr(Q.TR, "load_bundle", lambda spark, path: path)
    monkeypatch.setattr(Q, "_panel", lambda spark, sf: pytest.fail("panel built"))
    assert Q._bundle(spark, "at") == "at/rf"


def test_importance_prepares_its_rows_once(spark, monkeypatch):
    from pulse.plans import catalog as Q
    seen, panel = [], spark.range(1)
    monkeypatch.setattr(Q, "_panel", lambda spark, sf: panel)
    monkeypatch.setattr(Q, "prepare", lambda p, *a, **k: seen.append(p) or "rows")
    monkeypatch.setattr(Q, "fit_prepared", lambda rows, name: (rows, name))
    monkeypatch.setattr(Q.IMP, "native_importance", lambda spark, m: spark.createDataFrame([(m[1], "a", 1.0)], "model string, feature string, importance double"))
    monkeypatch.setattr(Q.IMP, "permutation_importance", lambda m, *a, **k: spark.createDataFrame([(m[1], "a", 2.0)], "model string, feature string, importance double"))
    got = {r.model: (r.native, r.permutation) for r in Q._importance(spark, "at").collect()}
    assert seen == [panel]
    assert got == {"rf": (1.0, 2.0), "mlp": (1.0, 2.0), "logreg_l1": (1.0, None), "gbt": (1.0, None)}
