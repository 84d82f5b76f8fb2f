import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulse.llm.queries import QUERIES
from pulse.llm.common import stage_table
from pulse.llm.variant_groups import halves, near_pairs, signatures, spelling_variants, variant_groups

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(rows):
    count = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def edits(word, letters):
    for i in range(len(word) + 1):
        for c in letters:
            yield word[:i] + c + word[i:]
            if i < len(word):
                yield word[:i] + c + word[i + 1:]
        if i < len(word):
            yield word[:i] + word[i + 1:]


def brute(words):
    letters = sorted({c for w in words for c in w})
    out, form = [], {}
    for w, n in words.items():
        near = sorted({e for e in edits(w, letters) if e in words and e != w}, key=lambda e: (-words[e], e))
        form[w] = near[0] if near and words[near[0]] >= 5 * n else None
        out.append((w, form[w], n, len(near), words[form[w]] if form[w] else None))

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted((w, f, root(w), n, k, fn) for w, f, n, k, fn in out)


def rows(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf):
    path = f"/root/testdata/{sf}"
    got = QUERIES["op12_spelling_variants"](spark, path)
    assert got.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    want = brute(words_of((r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()))
    assert rows(got) == sorted(want, key=lambda r: r[0])
    assert any(r[1] for r in want)


def test_cases(docs):
    base = [(i, "Strasse straßenb écoleé ABCDEF abcdeg; Écoleé banana nabana ananab " * 6) for i in range(9)]
    chain = [(20 + i, "letters " * 160 + "lettars " * 30 + "lettar " * 6) for i in range(1)]
    some = base + chain + [(None, "nullid nullid " * 9), (5, None), (6, ""), (7, " ×÷×÷×÷ " * 5), base[0], (30, "x" * 400_000 + " ") , (31, "x" * 400_000)]
    got = rows(spelling_variants(docs(some)))
    assert got == sorted(brute(words_of(some)), key=lambda r: r[0])
    assert {r[0]: r[2] for r in got}["lettar"] == "letters"


def test_long_words_and_forms(docs, spark):
    long = "ab" * 50_000
    table = spark.createDataFrame([(long, 50), (long + "a", 5), ("x" + long, 500), (None, 9), ("abcdef", 5), ("abcdef", 20), ("abcdeg", 5)],
                                  "word string, n long")
    got = {r.word: r for r in variant_groups(table).collect()}
    assert got[long + "a"].form == long and got[long + "a"].root == "x" + long and got[long].n_near == 2
    assert got["abcdeg"].form == "abcdef" and got["abcdef"].n == 25 and len(got) == 5


def test_empty_and_clashing_columns(docs, table):
    assert spelling_variants(docs([])).count() == 0
    clash = table("documents").withColumns({c: F.lit(1) for c in ("word", "n", "form", "root", "key")})
    assert rows(spelling_variants(clash)) == rows(spelling_variants(table("documents")))


@given(st.text("abcé", min_size=2, max_size=9), st.integers(0, 9), st.sampled_from("abcdé"), st.integers(0, 2))
@settings(max_examples=400, deadline=None)
def test_near_words_share_a_signature_and_a_half(word, at, letter, kind):
    at = min(at, len(word) - 1)
    other = word[:at] + (letter if kind < 2 else "") + word[at + (kind > 0):]
    assert set(signatures(word, {})) & set(signatures(other, {}))
    assert set(halves(word)) & set(halves(other))


def test_nothing_that_grows_is_broadcast(spark):
    """A small file of words explodes into many times as many keys, which Spark does not see."""
    words = stage_table(spark.range(2000).selectExpr("concat('word', md5(cast(id as string))) AS word", "id + 5 AS n"), "words")
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (near_pairs(words), variant_groups(words))]
    assert all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans)
