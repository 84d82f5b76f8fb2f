import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulse.llm import voronoi_knn
from pulse.llm.voronoi_knn import MOST_PIVOTS, PIVOTS, pivots_for, stretches, top_k

SCHEMA = "vec_id bigint, embedding array<float>"


def brute(rows, k, every=20):
    ints = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and not any(x is None or not math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(ints):
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(ints) if m != n)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("blocks", [{}, {"query_block": 2, "data_block": 16, "pivots": 7}])
def test_table(table, blocks):
    df = table("embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert got(top_k(df, lambda i: i % 20 == 0, **blocks)) == brute(rows, 20)


def test_clusters_ties_and_faulty_rows(spark):
    import random
    rnd = random.Random(4)
    centre = [[rnd.uniform(-1, 1) * 10 for _ in range(4)] for _ in range(4)]
    rows = [(i, [float(c + rnd.gauss(0, 0.02)) for c in centre[i % 4]]) for i in range(200)]
    rows += [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(200, 300)]
    rows += [(300, None), (320, [1.0, None, 0.0, 0.0]), (340, [1.0, float("nan"), 0.0, 0.0]), (360, [float("inf")] * 4),
             (None, [1.0] * 4), (380, [1.0, 2.0]), (381, []), (20, [9.0, 9.0, 9.0, 9.0]), (40, rows[40][1]), (-20, [0.5] * 4)]
    df = spark.createDataFrame(rows, SCHEMA)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    # Shorter vectors are padded with zeros, as zip() does in brute().
    assert got(top_k(df, lambda i: i % 20 == 0, k=5, pivots=8)) == brute(rows, 5)
    assert got(top_k(df.withColumns({"id": F.lit(1), "cell": F.lit(2), "score": F.lit(3)}), lambda i: i % 20 == 0, k=5)) == brute(rows, 5)


def test_few_large_and_no_vectors(spark):
    rows = [(20, [1e9, 1.0]), (1, [2.0, -3e8]), (40, [5.0, 1.0])]
    assert got(top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), lambda i: i % 20 == 0)) == brute(rows, 20)
    assert top_k(spark.createDataFrame([], SCHEMA), lambda i: i % 20 == 0).count() == 0
    assert top_k(spark.createDataFrame([(1, [1.0])], SCHEMA), lambda i: i % 20 == 0).count() == 0


def test_rows_under_one_id(spark, tmp_path):
    import duckdb
    from pulse.llm.queries import QUERIES, SQL
    rows = [(20, [1.0, 0.0]), (20, [9.0, 9.0]), (1, [3.0, 1.0]), (1, [5.0, 0.0]), (2, [2.0, 0.0]), (40, [0.5, 0.5]), (40, [0.5, 0.5])]
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(con.execute(SQL["op7_exact_top_k"]).fetchall())
    assert got(QUERIES["op7_exact_top_k"](spark, str(tmp_path))) == want == brute(rows, 20) and len(want) == 24


def test_pivots_follow_the_rows_up_to_a_bound():
    assert pivots_for(0) == pivots_for(10**5) == PIVOTS and pivots_for(10**11) == MOST_PIVOTS
    few, many = pivots_for(10**6), pivots_for(10**8)
    assert PIVOTS < few < many < MOST_PIVOTS


def test_copies_are_written_out_in_bounded_stretches():
    for most in (1, 3, 10, 1000):
        copies = np.array([1, 5, 2, 2, 9, 1, 1])
        parts = list(stretches(copies, most))
        assert [i for a, b in parts for i in range(a, b)] == list(range(len(copies)))
        assert all(b - a == 1 or copies[a:b].sum() <= most for a, b in parts)
    assert list(stretches(np.zeros(0, int), 4)) == []


def test_few_held_at_once(table, monkeypatch):
    df = table("embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    monkeypatch.setattr(voronoi_knn, "HELD", 256)
    assert got(top_k(df, lambda i: i % 20 == 0, pivots=40, query_block=2)) == brute(rows, 20)
