"""Every query with SQL gives DuckDB's rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from pulse.llm.queries import QUERIES, SQL

TABLES = "documents embeddings pages benchmark labels conversations".split()


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(map(str, pdf.itertuples(index=False, name=None)))


@pytest.mark.parametrize("key", sorted(SQL))
def test_sql(spark, key):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf, t)}.parquet')")
    want = con.execute(SQL[key]).df()
    got = QUERIES[key](spark, sf)
    types = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    assert {r[0]: types[str(r[1])] for r in con.execute("DESCRIBE " + SQL[key]).fetchall()} == dict(got.dtypes)
    assert rows(got.toPandas()) == rows(want)
    con.close()


def test_entry_lists_them():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert {k.split("_")[0] for k in QUERIES} == {f"op{i}" for i in range(1, 14)}
