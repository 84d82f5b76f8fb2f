import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pulse.llm.quality import LABELLERS, Shapes, clean_documents, features, fit, posterior, quality, votes

MID = "/root/testdata/sf0.01"


def test_held_out_labels(table):
    labels = {r.doc_id: r.quality for r in table("labels", MID).collect()}
    rows = {r.doc_id: r for r in quality(table("documents", MID)).collect()}
    kept = {q: np.mean([rows[i].kept for i in labels if labels[i] == q]) for q in (0, 1)}
    assert kept[1] >= 0.99 and kept[0] <= 0.1


def test_em_recovers_the_labellers():
    """Votes drawn from a known model: the posterior agrees with the hidden class."""
    rnd = random.Random(11)
    k = 6
    right = [0.95, 0.9, 0.85, 0.8, 0.9, 0.7]
    hidden, codes = [], []
    for _ in range(6000):
        clean = rnd.random() < 0.75
        code = 0
        for r in right:
            vote = 0 if rnd.random() < 0.3 else (1 if clean else -1) * (1 if rnd.random() < r else -1)
            code = code * 3 + vote + 1
        hidden.append(clean)
        codes.append(code)
    p = posterior(Counter(codes), k)
    said = np.array([p[c] for c in codes])
    assert np.mean((said >= 0.5) == np.array(hidden)) > 0.93
    assert abs(said.mean() - 0.75) < 0.03
    assert posterior({}, k) == {}


def test_fit_separates():
    good, bad = [b"the cat sat on a mat ."], [b"BUY!! NOW!! BUY!! NOW!!"]
    f = [features(t, Shapes()) for t in good * 5 + bad * 5]
    w = fit([a for a, _ in f], [b for _, b in f], np.array([1.0] * 5 + [0.0] * 5))
    z = [w[a] @ b + w[-1] for a, b in f]
    assert min(z[:5]) > 0 > max(z[5:])


JUNK = " ".join(f"word{i % 7}$$$" for i in range(80))
TEXT = "This is a plain text. It has some words, and it ends well. " * 3
CASES = [(i, TEXT + f"Number word{i} follows here.") for i in range(60)] + [(100 + i, JUNK + f" x{i}###") for i in range(20)] + [
    (200, None), (201, ""), (202, " \n "), (203, TEXT * 3000), (None, TEXT), (0, TEXT + "Number word0 follows here."), (204, "One.")]


def test_cases(docs):
    rows = {(r.doc_id, r.n_words): r for r in quality(docs(CASES)).collect()}
    assert quality(docs(CASES)).count() == len(CASES)
    assert all(rows[i, len(t.split())].kept == (i is None or not 100 <= i < 200) for i, t in CASES if t and t.split())
    assert all(not r.kept and r.score == 0 for r in rows.values() if r.n_words == 0)
    clash = docs(CASES).withColumns({"row": F.lit("x"), "score": F.lit(1), "kept": F.lit(False), "n_words": F.lit(3)})
    out = clean_documents(clash)
    assert out.columns == clash.columns and out.count() == 60 + 1 + 1 + 1 + 1


def test_empty_and_wordless_tables(docs):
    assert quality(docs([])).count() == 0
    assert [r.kept for r in quality(docs([(1, ""), (2, None)])).collect()] == [False, False]


def test_patterns_are_votes():
    code, n = votes(JUNK.encode(), Shapes())
    said = [code // 3**(len(LABELLERS) - 1 - k) % 3 - 1 for k in range(len(LABELLERS))]
    assert n == 80 and said[0] == -1 and said[5] == -1
    assert votes(b"", Shapes()) == (sum(3**k for k in range(len(LABELLERS))), 0)
