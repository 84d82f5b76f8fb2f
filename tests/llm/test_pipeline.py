import re
from collections import Counter

import corpus_pipeline as cp
import numpy as np
import public_tokenizers as P
import pytest
from test_simhash_bk import slow_fingerprint
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's result, written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for k, (_, f) in enumerate(cp.STAGES):
        out.append((docs, f(spark, docs, SF)))
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        out[-1][1].write.parquet(path)
        docs = spark.read.parquet(path)
        out[-1] = (out[-1][0], docs)
        assert k == len(cp.STAGES) - 1 or docs.columns == columns
    return [({r.doc_id: r.asDict() for r in a.collect()}, b.collect()) for a, b in out]


def test_order():
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "secret scans", "best-fit packing"]


def test_quality_keeps_clean_rows_unchanged(spark, stages):
    before, after = stages[0]
    kept = {r.doc_id for r in after}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(i in kept for i in label if label[i] == 1)
    assert np.mean([i in kept for i in label if label[i] == 0]) <= 0.1
    assert all(before[r.doc_id] == r.asDict() for r in after)


def test_exact_dedup(stages):
    before, after = stages[1]
    first = {}
    for i, r in before.items():
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")
        first[key] = min(i, first.get(key, i))
    assert sorted(r.doc_id for r in after) == sorted(first.values()) and len(first) < len(before)
    assert all(before[r.doc_id] == r.asDict() for r in after)


def test_near_dedup(stages):
    before, after = stages[2]
    fp = {i: slow_fingerprint(r["text"]) for i, r in before.items()}
    group = {i: i for i in fp}
    ids = sorted(fp)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            if (fp[i] ^ fp[j]).bit_count() <= 2 and group[i] != group[j]:
                a, b = sorted((group[i], group[j]))
                group = {k: a if g == b else g for k, g in group.items()}
    assert sorted(r.doc_id for r in after) == sorted(i for i in ids if group[i] == i)
    assert all(before[r.doc_id] == r.asDict() for r in after)


def test_secrets(stages):
    before, after = stages[3]
    planted = re.compile(r'AKIA[A-Z0-9]{16}|(?<=password=)[0-9a-f]{18}|(?<=token = ")[0-9a-f]{40}')
    assert sorted(r.doc_id for r in after) == sorted(before)
    for r in after:
        was = before[r.doc_id]
        assert r.text == (None if was["text"] is None else planted.sub("<SECRET>", was["text"]))
        assert {**was, "text": r.text} == r.asDict()


def test_packing(stages):
    before, after = stages[4]
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    size = {i: len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for i, r in before.items()}
    got = Counter()
    for r in after:
        got[r.doc_id] += r.length
    assert got == size
    sequences = Counter()
    for r in after:
        sequences[r.sequence_id] += r.length
    assert max(sequences.values()) <= 1024 and len(sequences) <= -(-sum(size.values()) // 1024) * 1.02 + 1


def test_run_and_empty_input(spark):
    assert cp.run(spark, "/root/testdata/sf0.001").count() > 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, f in cp.STAGES:
        out = f(spark, docs, SF)
        assert out.count() == 0
        docs = docs


def test_ties_layouts_and_clashing_names(spark):
    from pulse.llm import exact_dedup, recompression, secret_forest, simhash_bk
    rows = [(1, "a  b", "x", 2), (1, "a b", "y", 1), (1, "a b", "w", 9), (1, "a b", "w", 9), (2, "", "p", 1), (2, None, "q", 1), (None, "n", "r", 2),
            (None, "n", "r", 1), (None, 'token = "0123abcd0123abcd"', "s", 0), (None, 'token = "99ffabcd0123abcd"', "s", 0)]
    schema = "doc_id long, text string, keep_key string, secrets int"
    for step in (exact_dedup.drop_exact_copies, simhash_bk.keep_first_of_groups, secret_forest.redact):
        want = None
        for parts, order in ((1, rows), (4, rows[::-1])):
            df = spark.createDataFrame(order, schema).repartition(parts)
            df = df.withColumnsRenamed({}).withColumns({"__key": df.keep_key, "__id": df.secrets, "secret_key": df.keep_key, "keep_key_": df.secrets, "source": df.keep_key})
            out = step(df)
            assert out.columns == df.columns
            got = sorted(map(str, out.collect()))
            want = want or got
            assert got == want
            if step is exact_dedup.drop_exact_copies:
                kept = {(r.doc_id, r.text, r.keep_key, r.secrets) for r in out.collect()}
                assert kept == {(1, "a  b", "x", 2), (2, None, "q", 1), (None, "n", "r", 1), rows[8], rows[9]}
            assert all(r["__id"] == r.secrets and r["__key"] == r.keep_key for r in out.collect())
    df = spark.createDataFrame([(1, "one " * 60, 5, "t"), (2, "one " * 60, 6, "u")], "doc_id long, text string, repeat_id int, repeat_text string")
    out = {r.doc_id: r for r in recompression.without_repeats(df, window=50).collect()}
    assert (out[2].repeat_id, out[2].repeat_text, out[1].repeat_id) == (6, "u", 5)
