import pytest
from pyspark.sql import functions as F

from pulse.llm.chat_preference import preference_rows, reply_pairs, turns

S = "conv_id bigint, turn bigint, role string, text string"


@pytest.fixture()
def chat(spark):
    return lambda rows: turns(spark.createDataFrame(rows, S))


def brute(chosen, rejected):
    out = {}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    side = lambda rows, i: [(r or "", t or "") for _, _, r, t in sorted({x for x in rows if x[0] == i}, key=order)]
    line = lambda t: f"<|{t[0]}|>\n{t[1]}<|end|>\n"
    for i in {r[0] for r in chosen} & {r[0] for r in rejected} - {None}:
        a, b = side(chosen, i), side(rejected, i)
        n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

        def mask(ts):
            spans, at = [], 0
            for t in ts:
                if t[0] == "assistant":
                    spans.append([at + len(t[0]) + 5, at + len(line(t))])
                at += len(line(t))
            return spans
        out[i] = (n, "".join(map(line, a[:n])), "".join(map(line, a[n:])), "".join(map(line, b[n:])), mask(a[n:]), mask(b[n:]))
    return out


def got(df):
    return {r.pair_id: (r.common_turns, r.prompt, r.chosen, r.rejected, r.chosen_mask, r.rejected_mask) for r in df.collect()}


def test_pairs(chat):
    chosen = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes é😀"), (2, 0, "user", "q"), (2, 0, "user", "q"), (2, 1, "assistant", None),
              (3, 0, None, "x"), (4, None, "system", "s"), (4, 0, "user", "u"), (4, 0, "user", "v"), (4, 1, "assistant", "a" * 100_000), (5, 0, "user", "only chosen"),
              (None, 0, "user", "no conversation"), (6, 0, "user", "same"), *((7, k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(300))]
    rejected = [(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "user", "u"), (1, 3, "assistant", "more"), (2, 0, "user", "q"), (2, 1, "assistant", ""),
                (3, 0, "user", "x"), (4, None, "system", "s"), (4, 0, "user", "u"), (4, 1, "assistant", "b"), (6, 0, "user", "same"), (6, 1, "assistant", "z"),
                *((7, k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(299))]
    assert got(preference_rows(chat(chosen), chat(rejected))) == brute(chosen, rejected)


def test_empty_and_clashing(spark, chat):
    assert preference_rows(chat([]), chat([])).count() == 0
    df = spark.createDataFrame([(0, 0, "user", "a"), (0, 1, "assistant", "b"), (1, 0, "assistant", "c"), (2, 0, "user", "x"), (3, 0, "assistant", "only")], S)
    clash = df.withColumns({"pair_id": F.lit(9), "which": F.lit(1), "reply": F.lit("r")})
    rows = got(preference_rows(*reply_pairs(turns(clash))))
    assert rows == {0: (1, "<|user|>\na<|end|>\n", "<|assistant|>\nb<|end|>\n", "<|assistant|>\nc<|end|>\n", [[14, 23]], [[14, 23]]),
                    1: (0, "", "<|assistant|>\nc<|end|>\n", "<|assistant|>\nb<|end|>\n", [[14, 23]], [[14, 23]])}


def brute_sides(rows):
    """Chosen and rejected turns of each conversation, row by row."""
    rows = {(i, n, r or "", t or "") for i, n, r, t in rows if i is not None}
    place = lambda n: -1 if n is None else n
    reply = {}
    for i, n, r, t in rows:
        if r == "assistant":
            reply[i] = max(reply.get(i, (-2, "", None)), (place(n), t, n), key=lambda x: x[:2])
    chosen, rejected = [], []
    for i, n, r, t in rows:
        if i in reply and place(n) <= reply[i][0]:
            chosen.append((i, n, r, t))
            if place(n) < reply[i][0] or n is None and (r, t) != ("assistant", reply[i][1]):
                rejected.append((i, n, r, t))
    rejected += [(i, n, "assistant", reply[i ^ 1][1]) for i, (_, _, n) in reply.items() if i ^ 1 in reply]
    return chosen, rejected


def test_null_turns(chat):
    rows = [(0, None, "system", "s"), (0, 0, "user", "a"), (0, 1, "assistant", "b"), (0, 2, "user", "late"),
            (1, None, "assistant", "c"), (1, None, "user", "u"), (1, 3, "user", "late"), (1, None, "assistant", "bb"), (1, None, "assistant", "c"),
            (2, None, "assistant", "alone"), (3, 0, "user", "no reply"), (4, None, "assistant", None), (5, None, "user", None), (5, 0, "assistant", "x")]
    chosen, rejected = reply_pairs(chat(rows))
    sides = brute_sides(rows)
    for side, want in zip((chosen, rejected), sides, strict=True):
        assert {tuple(r) for r in side.collect()} == set(want)
    want = brute(*sides)
    assert got(preference_rows(chosen, rejected)) == want and set(want) == {0, 1, 4, 5}
    assert want[0][:2] == (2, "<|system|>\ns<|end|>\n<|user|>\na<|end|>\n")


def test_table(table):
    t = turns(table("conversations"))
    chosen, rejected = reply_pairs(t)
    raw = lambda d: [tuple(r) for r in d.select("pair_id", "turn", "role", "text").collect()]
    rows = got(preference_rows(chosen, rejected))
    assert rows == brute(raw(chosen), raw(rejected)) and len(rows) > 10


def test_sql_with_null_turns(spark, tmp_path):
    import duckdb
    from pulse.llm.queries import QUERIES, SQL
    rows = [(0, None, "user", "a"), (0, None, "assistant", "b"), (0, 2, "user", "c"), (0, 3, "assistant", "d"), (0, 4, "user", "late"),
            (1, None, "assistant", "x"), (1, None, "assistant", "y"), (1, None, "user", "z"), (1, 1, "user", "after"),
            (2, 1, "assistant", "only"), (3, 1, "user", "no reply"), (4, None, None, None), (4, None, "assistant", None), (5, 1, "assistant", "e")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    q = con.execute(SQL["op3_chat_preference"])
    names = [d[0] for d in q.description]
    got = QUERIES["op3_chat_preference"](spark, str(tmp_path)).select(names).collect()
    want = sorted(q.fetchall())
    assert sorted(map(tuple, got)) == want and {0, 1, 4, 5} <= {r[0] for r in want}
