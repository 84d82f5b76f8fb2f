import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulse.llm.recompression import Anchors, Words, levels, repeats, without_repeats


def brute(rows, window):
    docs = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    first = {}
    for i, w in docs:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k:k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k:k + window])] < i:
                    gone[k:k + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def corpus(seed, n=60, words=6):
    """Texts over few words with shared, shifted, nested and periodic passages."""
    rnd = random.Random(seed)
    voc = [f"w{i}" for i in range(words)] + ["é"]
    passages = [[rnd.choice(voc) for _ in range(rnd.randint(5, 60))] for _ in range(6)] + [["a"] * 70, ["a", "b"] * 40]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rnd.randint(0, 4)):
            text += [rnd.choice(voc) + (str(rnd.randint(0, 99)) if rnd.random() < 0.5 else "") for _ in range(rnd.randint(0, 30))]
            p = rnd.choice(passages)
            a = rnd.randint(0, len(p) - 1)
            text += p[a:rnd.randint(a, len(p))]
        rows.append((rnd.randint(0, n), " ".join(text)))
    return rows + [(None, rows[0][1]), (1000, None), (1001, ""), (2000, "x y " * 4000), (2001, "x y " * 3000 + "z"), (2001, "\n".join(passages[0] * 3))]


@pytest.mark.parametrize(("seed", "window"), [(1, 12), (2, 5), (3, 30), (4, 1)])
def test_random_texts(docs, seed, window):
    rows = corpus(seed)
    assert got(repeats(docs(rows), window)) == brute(rows, window)


def test_empty_clashing_and_texts(docs):
    assert repeats(docs([])).count() == 0
    rows = [(i, t) for i, t in {i: t for i, t in corpus(9) if i is not None}.items()]
    clash = docs(rows).withColumns({"name": F.lit(1), "place": F.lit("x"), "decided": F.lit(2), "spans": F.lit(3)})
    assert got(repeats(clash, 10)) == brute(rows, 10)
    out = {r.doc_id: r.text for r in without_repeats(clash, 10).collect()}
    for i, _, gone, digest in brute(rows, 10):
        if gone:
            assert hashlib.sha256(out[i].encode()).hexdigest() == digest
        else:
            assert out[i] == dict(rows)[i]


def test_table(table):
    df = table("documents")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = brute(rows, 50)
    assert got(repeats(df)) == want and any(w[2] for w in want)


def test_symbols_depend_only_on_their_range():
    rnd = random.Random(0)
    base = [str(rnd.randint(0, 3)).encode() for _ in range(400)]
    a = levels(Words([base]).hash, 4)
    for _ in range(30):
        lo = rnd.randint(0, 300)
        hi = lo + rnd.randint(20, 90)
        other = [str(rnd.randint(0, 3)).encode() for _ in range(37)] + base[lo:hi] + [b"1"] * 20
        b = levels(Words([other]).hash, 4)
        shift = 37 - lo
        for (s1, l1, r1), (s2, l2, r2) in zip(a, b, strict=True):
            inside = {(int(s), int(x) + shift, int(y) + shift) for s, x, y in zip(s1, l1, r1, strict=True) if x >= lo + 1 and y <= hi + 1}
            assert inside <= {(int(s), int(x), int(y)) for s, x, y in zip(s2, l2, r2, strict=True)}
            assert (np.diff(l1) >= 0).all() and (np.diff(r1) >= 0).all()


def test_every_window_has_one_anchor():
    rnd = random.Random(1)
    w = Words([[str(rnd.randint(0, 999)).encode() for _ in range(n)] for n in (5000, 3, 49, 50, 51)])
    a = Anchors(w, 50, 3)
    assert (a.hi - a.lo + 1).sum() == 4951 + 1 + 2
    assert len(a.lo) < 4954 / 12
