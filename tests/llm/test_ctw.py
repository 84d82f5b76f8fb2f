import math
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulse.llm import ctw
from pulse.llm.common import stage_table
from pulse.llm.ctw import ctw_scores, log_gamma, one_in_seven, pack, unpack


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def brute(rows, depth):
    """Exact recursion over explicit context trees, one per bit prefix."""
    texts = [(i, (t or "").encode().lower()) for i, t in rows]
    train = [t for i, t in texts if not held(i)]
    count = {}

    def events(t):
        s = b"\xff" * depth + t + b"\xff"
        for at in range(depth, len(s)):
            for b in range(8):
                yield 1 << b | s[at] >> 8 - b, s[at - depth:at], s[at] >> 7 - b & 1

    kids = {}
    for t in train:
        for node, ctx, bit in events(t):
            for d in range(depth + 1):
                c = ctx[depth - d:]
                count.setdefault((node, c), [0, 0])[bit] += 1
                if d < depth:
                    kids.setdefault((node, c), set()).add(ctx[depth - d - 1:])

    @cache
    def pe(key):
        a, b = count[key]
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @cache
    def pw(key):
        if len(key[1]) == depth:
            return pe(key)
        below = sum(pw((key[0], c)) for c in kids[key])
        return np.logaddexp(pe(key), below) - math.log(2)

    def one(node, ctx):
        reached, left = 0.0, 1.0
        for d in range(depth + 1):
            key = (node, ctx[depth - d:])
            if key not in count:
                return reached + left / 2
            a, b = count[key]
            stop = math.exp(pe(key) - math.log(2) - pw(key)) if d < depth else 1.0
            reached += left * stop * (b + .5) / (a + b + 1)
            left *= 1 - stop
        return reached

    words = Counter(w for t in train for w in [*t.split(), b""])
    n, v = sum(words.values()), len(words)
    out = []
    for i, t in texts:
        tokens = [*t.split(), b""]
        score = sum(math.log10(p if bit else 1 - p) for node, ctx, bit in events(t) for p in [one(node, ctx)])
        out.append((str(i), held(i), len(tokens), sum(words[w] > 0 for w in tokens), n,
                    sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens), score))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect())


def same(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x[:5] == y[:5]
        assert x[5:] == pytest.approx(y[5:], rel=1e-9)


ROWS = [(i, t) for i, t in enumerate(["the cat sat on the mat", "The cat  ate", "", None, "a mat\na cat\tat bat", "é ü the", "x" * 90,
                                      "the cat sat on the mat", "zzz new words here", "mat sat"] * 3)] + [(None, "null id text"), (5, "the cat")]


@pytest.mark.parametrize("depth", [2, 3, 5])
def test_is_the_exact_mixture(docs, depth):
    same(got(ctw_scores(stage_table(docs(ROWS), "t"), one_in_seven, depth)), brute(ROWS, depth))


@pytest.mark.parametrize(("depth", "share"), [(3, 0.0), (5, 0.0), (5, 0.02), (2, 0.0)])
def test_heavy_buckets_are_dealt_again_and_stay_exact(docs, monkeypatch, depth, share):
    monkeypatch.setattr(ctw, "HEAVY", share)
    same(got(ctw_scores(stage_table(docs(ROWS), "t"), one_in_seven, depth)), brute(ROWS, depth))


def test_split_keeps_what_shares_three_bytes_together():
    rng, depth = np.random.default_rng(3), 5
    gram = rng.integers(0, 2**48, 5000).astype(np.uint64)
    plain = ctw.bucket_of(gram, depth)
    heavy = frozenset(plain[:40].tolist())
    to = ctw.split_bucket(gram, plain, depth, heavy)
    assert (to[~np.isin(plain, list(heavy))] < ctw.BUCKETS).all() and (to[np.isin(plain, list(heavy))] >= 2 * ctw.BUCKETS).all()
    far = gram ^ rng.integers(0, 2**24, 5000).astype(np.uint64)  # other far bytes, other byte
    assert (ctw.split_bucket(far, ctw.bucket_of(far, depth), depth, heavy) == to).all()


def test_empty_untrained_and_clashing(docs):
    assert ctw_scores(stage_table(docs([]), "t"), one_in_seven).count() == 0
    only = [(i, "ab") for i in range(200) if held(i)][:4]
    same(got(ctw_scores(stage_table(docs(only), "t"), one_in_seven)), brute(only, 5))
    clash = stage_table(docs(ROWS).withColumns({"chunk": F.lit("x"), "held_out": F.lit(1), "bucket": F.lit(2)}), "t")
    same(got(ctw_scores(clash, one_in_seven, 2)), brute(ROWS, 2))


def test_probabilities_sum_to_one_and_model_beats_base(table):
    r = ctw_scores(table("documents", "/root/testdata/sf0.01"), one_in_seven).collect()
    assert all(x.score < 0 and x.base_score < 0 for x in r)
    other = [x for x in r if x.held_out]
    assert 1.0 < sum(x.bits_per_byte * x.n_bytes for x in other) / sum(x.n_bytes for x in other) < 4.0


def test_packing_and_log_gamma():
    x = np.unique(np.random.default_rng(1).integers(0, 2**48, 1000).astype(np.uint64))
    assert (unpack(pack(x)) == x).all() and len(unpack(pack(x[:0]))) == 0
    y = np.array([0.5, 1.0, 1.5, 7.25, 1000.5, 1e8])
    assert log_gamma(y) == pytest.approx([math.lgamma(v) for v in y], abs=1e-9, rel=1e-12)


def test_lookup_and_questions_hold_little():
    """Four bytes a slot beside the given arrays, and no counts for n-grams that are only asked for."""
    rng = np.random.RandomState(1)
    keys = ctw.ascending(rng.randint(0, 2**62, 300_000).astype(np.uint64))
    values = rng.rand(len(keys))
    find = ctw.Lookup(keys, values)
    assert find.keys is keys and find.values is values
    assert sum(a.nbytes for a in vars(find).values() if isinstance(a, np.ndarray) and a is not keys and a is not values) <= 16 * len(keys)
    asked = rng.randint(0, len(keys), 50_000)
    assert (find(keys[asked]) == values[asked]).all()
    own, counted = ctw.Chunk(3), ctw.Chunk(3)
    for texts in ([b"one two", b""], [b"two three"]):
        own.see(texts)
        counted.add(texts, np.ones(len(texts), bool))
    assert [p[:2] for p in own.packed()] == [p[:2] for p in counted.packed()]
    assert own.counts is None
