import hashlib
import re
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from pulse.llm.components import components
from pulse.llm.simhash_bk import BKTree, fingerprint, keep_first_of_groups, near_groups, shards, sub_masks

MASK = 2**64 - 1


def slow_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, radius=2):
    fps = [slow_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    out = []
    for (i, _), f, g in zip(rows, fps, group, strict=True):
        ids = [r[0] for r, h in zip(rows, group, strict=True) if h == g and r[0] is not None]
        out.append((i, f"{f:016x}", min(ids) if ids else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


BASE = " ".join(f"word{i}" for i in range(400))
CASES = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "Two words"), (7, BASE), (8, BASE + " extra"),
         (9, BASE.replace("word399", "x").upper()), (9, BASE), (10, "a b c"), (11, "a  b\tc"), (12, "É é a"),
         (None, BASE), (None, "alone here now"), (14, "z " * 150_000), (15, "z z z z")]


def test_xxhash_is_sparks(spark):
    for s in ("", "a b c", "é x ü", "x" * 100):
        assert spark.range(1).select(F.xxhash64(F.lit(s))).first()[0] & MASK == xxhash.xxh64_intdigest(s.encode(), 42)


def test_cases(docs):
    assert got(near_groups(docs(CASES))) == brute(CASES)
    assert near_groups(docs([])).count() == 0
    clash = docs(CASES).withColumns({"fp": F.lit(1), "component_id": F.lit("x"), "root": F.lit(2)})
    kept = keep_first_of_groups(clash)
    assert kept.columns == clash.columns
    want = {i for i, _, c in brute(CASES) if i == c}
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, want))


def test_rows_without_an_id_and_texts_under_one_id_are_kept(docs):
    text = lambda n: " ".join(f"{n}word{i * n}" for i in range(50))
    rows = [(None, text(n)) for n in range(1, 6)] + [(None, text(3)), (None, text(1).upper()), (7, text(8)), (7, text(9)), (7, text(8)), (8, text(9)),
                                                     (9, text(5)), (None, None), (None, "")]
    assert len({slow_fingerprint(text(n)) for n in range(1, 10)}) == 9
    kept = sorted(((r.doc_id, r.text or "") for r in keep_first_of_groups(docs(rows)).collect()), key=str)
    first = min((text(1), text(1).upper()), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert kept == sorted([(None, first), *((None, text(n)) for n in (2, 3, 4)), (9, text(5)), (7, text(8)), (7, text(9)), (None, "")], key=str)


def test_table(table):
    df = table("documents")
    assert got(near_groups(df)) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_bk_tree():
    import random
    rnd = random.Random(1)
    values = [rnd.getrandbits(8) | rnd.getrandbits(3) << 40 for _ in range(300)]
    tree = BKTree()
    for v in values:
        tree.add(v)
    for v in values[:50]:
        assert sorted(tree.within(v, 2)) == sorted({x for x in values if (x ^ v).bit_count() <= 2})


@pytest.mark.parametrize("most", [2, 16])
def test_large_shards_are_dealt_again_without_losing_links(spark, most):
    import random
    rnd = random.Random(7)
    fps = sorted({sum(1 << b for b in rnd.sample(range(20), 3)) - (2**63 if rnd.random() < 0.5 else 0) for _ in range(400)})
    met = set()
    for r in shards(spark.createDataFrame([(f,) for f in fps], "fp bigint"), 2, most).collect():
        assert all((f & r.mask) == r.key for f in r.fps)
        met |= {p for p in combinations(sorted(r.fps), 2) if ((p[0] ^ p[1]) & MASK).bit_count() <= 2}
    assert met == {p for p in combinations(fps, 2) if ((p[0] ^ p[1]) & MASK).bit_count() <= 2}
    assert len(sub_masks(0, 2)) == 3


def test_components(spark):
    import random
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(500, 501 + i) for i in range(30)]
    group = {}
    for a, b in edges:
        group.setdefault(a, a), group.setdefault(b, b)
    for a, b in edges:
        x, y = group[a], group[b]
        group = {k: min(x, y) if g in (x, y) else g for k, g in group.items()}
    res = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert res == {k: g for k, g in group.items() if any((k in e and e[0] != e[1]) for e in edges)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_long_text_blocks():
    t = " ".join(str(i % 977) for i in range(140_000))
    assert fingerprint(t.encode()) & MASK == slow_fingerprint(t)
