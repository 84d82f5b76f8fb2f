import math
import re
from collections import Counter

from pyspark.sql import functions as F

import pulse.llm.bag_search as bag_search
from pulse.llm.bag_search import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    bags = [(i, Counter(terms(x))) for i, x in docs]
    bags = [(i, c, sum(c.values())) for i, c in bags if c]
    total, length = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, c, _ in bags for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in bags:
            m = 100 - 50 + 50 * n * total // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                    for t in set(terms(text)) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


DOCS = ([(i, "The quick brown fox") for i in range(40)] + [(100 + i, "quick  FOX the-brown!") for i in range(40)]
        + [(3, "The quick brown fox")] * 3 + [(None, "the quick brown fox"), (None, None), (7, ""), (8, "... !!"), (9, "Écolé école 日本 fox\x00fox"),
           (10, "lazy " * 300_000), (11, "common words only"), (12, "naïve_snake case 42"), (13, "zebra " * 3)])
ITEMS = [(0, "quick brown fox fox"), (1, "the"), (2, None), (3, ""), (4, "École école 日本 42"), (None, "lazy zebra naïve"), (5, "absent"),
         (0, "quick brown fox fox"), (6, "zebra " * 5000)]


def test_cases(docs, spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for k in (1, 7, 50):
        assert rows(ranked(docs(DOCS), items, k=k)) == brute(DOCS, ITEMS, k)


def test_blocks_of_items_and_small_batches(docs, spark, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(bag_search, "ENTRIES", 4)
    monkeypatch.setattr(bag_search, "CELLS", 8)
    assert rows(ranked(docs(DOCS), items, k=5)) == brute(DOCS, ITEMS, 5)


def test_whole_tables(table):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        d, b = table("documents", sf), table("benchmark", sf)
        want = brute([(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in b.collect()], 50)
        clash = d.withColumns({c: F.lit(1) for c in ("n", "bag", "class", "item", "score", "rank")})
        assert rows(ranked(clash, b)) == want


def test_empty(docs, spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked(docs([]), items).count() == 0
    assert ranked(docs(DOCS), items.limit(0)).dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
