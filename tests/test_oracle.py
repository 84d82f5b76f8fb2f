"""Every registered query with oracle SQL matches DuckDB on the smallest fixture."""

import math

import pytest

from pulse import registry

SF = "/root/testdata/sf0.001"


def _norm(v):
    import pandas as pd
    if v is None or v is pd.NA:
        return None
    if hasattr(v, "item"):
        try:
            v = v.item()
        except Exception:  # noqa: BLE001
            pass
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 9)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


# Queries that fit models need the larger tables: tests/test_checks.py.
NAMES = sorted(n for n in registry.oracle_sql() if not n.endswith("_check") and n != "json_scan_scored")


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    con = getattr(test_query_matches_oracle, "_con", None)
    if con is None:
        con = test_query_matches_oracle._con = duck(SF)
    sdf = registry.queries()[name](spark, SF)
    got = sdf.toPandas()
    exp = con.execute(registry.oracle_sql()[name]).df()
    types = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    dtypes = {r[0]: types.get(str(r[1]), str(r[1]))
              for r in con.execute("DESCRIBE " + registry.oracle_sql()[name]).fetchall()}
    assert dtypes == {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    assert sorted(got.columns) == sorted(exp.columns)
    assert len(got) == len(exp)
    assert _rows(got) == _rows(exp)
