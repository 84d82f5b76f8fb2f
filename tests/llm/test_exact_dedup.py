import hashlib
import re

from pyspark.sql import functions as F

from pulse.llm.exact_dedup import drop_exact_copies, exact_groups


def brute(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    out = set()
    for i, t in norm:
        ids = [j for j, u in norm if u == t]
        known = [j for j in ids if j is not None]
        keep = min(known) if known else None
        out.add((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return out


CASES = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (9, "a b"), (1, None), (2, ""), (4, " "), (7, "é x"),
         (8, "é x"), (None, "a b"), (None, "only null id"), (11, "x" * 200_000), (12, "x" * 200_000), (13, "A B")]


def rows(df):
    return {tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()}


def test_cases_match_brute_force(docs):
    df = exact_groups(docs(CASES))
    assert rows(df) == brute(CASES) and df.count() == len(brute(CASES))


def test_collisions_are_resolved_by_bytes(docs):
    for weak in (lambda c: F.length(c).cast("string"), lambda c: F.lit("same")):
        assert rows(exact_groups(docs(CASES), content_hash=weak)) == brute(CASES)


def test_empty_table_and_clashing_columns(docs):
    assert exact_groups(docs([])).count() == 0
    extra = docs(CASES).withColumns({"keep_id": F.lit("x"), "h": F.lit(1), "norm": F.lit(2), "kept": F.lit(0)})
    assert rows(exact_groups(extra)) == brute(CASES)
    kept = drop_exact_copies(extra)
    assert kept.columns == extra.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _, _, k, _ in brute(CASES) if k)


def test_table(table):
    df = table("documents")
    assert rows(exact_groups(df)) == brute([(r.doc_id, r.text) for r in df.collect()])
