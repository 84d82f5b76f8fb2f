"""A million characters without a break: every operator on documents comes to an end, with right counts."""

import time

import pytest

import corpus_pipeline as cp
from pulse.llm import bag_search, chat_preference, ctw, exact_dedup, mbs_packing, quality, recompression, secret_forest, simhash_bk
from pulse.llm.mbs_packing import encoder, long_run

N = 1_000_000
RUNS = ["-" * N, " " * N, "\n" * N, "\t \n" * (N // 3), "_a" * (N // 2), "token" * (N // 5), "x=" * (N // 2), "://" * (N // 3),
        "token" + "=" * N, "password=" + ")" * N + "x", "a" * N, "a1" * (N // 2), "a b " * (N // 4)]


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(RUNS)],
                               "doc_id long, text string, lang string, source string, n_chars long")
    df = df.repartition(4).checkpoint()
    df.count()
    return df


def within(seconds, action):
    begin = time.monotonic()
    out = action()
    assert time.monotonic() - begin < seconds
    return out


def test_packing(table):
    rows = within(90, lambda: mbs_packing.pack_documents(table, cp.BPE).collect())
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(cp.BPE)
    assert total == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in enumerate(RUNS)}


def test_encoder_at_the_bound():
    from tokenizers import Tokenizer
    t, encode = Tokenizer.from_file(cp.BPE), encoder(cp.BPE, added_tokens=True)
    for x in ("a" + " " * 5001 + "b", "-" * 5001, "-" * 5000 + " c", " " * 5000):
        assert encode(x).tolist() == t.encode(x, add_special_tokens=False).ids
    assert long_run("-" * 5001) and long_run(" " * 5001) and not long_run("a b " * 9000)


def test_secrets(table):
    found = within(90, lambda: secret_forest.scan(table).collect())
    assert {r.doc_id for r in found} >= {11} and all(r.doc_id not in (0, 1, 2, 3, 12) for r in found)
    assert within(90, lambda: secret_forest.redact(table).count()) == len(RUNS)


@pytest.mark.parametrize("action", [
    lambda d: exact_dedup.exact_groups(d), lambda d: simhash_bk.near_groups(d), lambda d: quality.quality(d),
    lambda d: recompression.repeats(d, window=50).drop("spans"), lambda d: bag_search.ranked(d, d.select(d.doc_id.alias("item_id"), "text"), k=5),
], ids=["exact", "near", "quality", "repeats", "search"])
def test_others(table, action):
    assert within(90, lambda: action(table).count()) > 0


def test_scores(spark, table):
    few = table.filter("doc_id IN (0, 1, 4, 10)")
    assert within(120, lambda: ctw.ctw_scores(few, ctw.one_in_seven, depth=5).count()) == 4


def test_chat(spark):
    rows = [(i, t, r, x) for i, x in enumerate(RUNS[:6]) for t, r in ((0, "user"), (1, "assistant"))]
    turns = chat_preference.turns(spark.createDataFrame([(c, t, r, x) for c, t, r, x in rows], "conv_id long, turn int, role string, text string"))
    chosen, rejected = chat_preference.reply_pairs(turns)
    assert within(60, lambda: chat_preference.preference_rows(chosen, rejected).count()) == 6
