import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulse.llm.mbs_packing import BLOCK, cut, encoder, fullest, pack_documents, plan_bins, ranked

BPE = P.path("byte_bpe_50k.json")
REFERENCE = Tokenizer.from_file(BPE)
REFERENCE.encode_special_tokens = True


def ids_of(text):
    return REFERENCE.encode(text or "", add_special_tokens=False).ids + [2]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_are_those_of_tokenizers(text):
    assert encoder(BPE)(text).tolist() + [2] == ids_of(text)


@pytest.mark.parametrize("text", ["<|endoftext|> x", "a  b\n\n c\t \x1c d\x0b e f", "I'll they'RE 12 34½ x²", "é" * 3000])
def test_ids_of_special_texts(text):
    assert encoder(BPE)(text).tolist() + [2] == ids_of(text)


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "<|endoftext| > y", "é <|endoftext|>\n", "plain"])
def test_added_tokens_are_the_plain_librarys(file, text):
    plain = Tokenizer.from_file(P.path(file))
    assert encoder(P.path(file), added_tokens=True)(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_packed_ids_hold_added_tokens(docs):
    plain, text = Tokenizer.from_file(BPE), "a <|endoftext|> b"
    row, = pack_documents(docs([(1, text)]), BPE, with_ids=True).collect()
    assert row.ids == [*plain.encode(text, add_special_tokens=False).ids, 2] and 50256 in row.ids


def test_word_tokenizer_file_goes_through_the_library():
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    assert encoder(P.path("word_bpe_49k.json"))("Some Text here").tolist() == t.encode("Some Text here", add_special_tokens=False).ids


def test_cut():
    assert cut(1024, 1024) == [(0, 1024)] and cut(1, 1024) == [(0, 1)]
    assert cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)]


def test_fullest_is_optimal():
    rnd = random.Random(5)
    for _ in range(200):
        counts = {rnd.randint(1, 30): rnd.randint(1, 3) for _ in range(5)}
        room = rnd.randint(0, 60)
        sums = {0}
        for n, c in counts.items():
            sums |= {s + n * k for s in sums for k in range(1, c + 1)}
        got = fullest(sorted(counts, reverse=True), counts, room)
        assert all(c <= counts[n] for n, c in got.items())
        assert sum(n * c for n, c in got.items()) == max(s for s in sums if s <= room)


def test_plan_is_near_the_lower_bound():
    rnd = random.Random(2)
    histogram = {}
    for _ in range(50_000):
        n = min(1024, int(rnd.lognormvariate(5.5, 1)) + 1)
        histogram[n] = histogram.get(n, 0) + 1
    plan, sequences = plan_bins(histogram, 1024)
    assert sequences <= math.ceil(sum(n * c for n, c in histogram.items()) / 1024) * 1.002 + 1
    assert len(plan) < 40_000
    plan10, _ = plan_bins({n: c * 1000 for n, c in histogram.items()}, 1024)
    assert len(plan10) < 40_000


def verify(rows, docs, capacity):
    want = sorted(((i, k, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4"))) for i, t in docs for ids in [ids_of(t)]
                   for k, (s, n) in enumerate(cut(len(ids), capacity))), key=str)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), math.ceil(sum(w[3] for w in want) / capacity)


CASES = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (4, "long " * 9000), (None, "null id"), (5, "long " * 2047),
         *((i, "same text") for i in range(100, 160)), *((i, "w" * (i % 37)) for i in range(200, 260))]


def test_cases(docs):
    rows = pack_documents(docs(CASES), BPE).collect()
    n, least = verify(rows, CASES, 1024)
    assert n <= least + 1
    assert pack_documents(docs([]), BPE).count() == 0
    clash = docs(CASES).withColumns({"length": F.lit("x"), "rank": F.lit(0), "bucket": F.lit(1), "n": F.lit(2)})
    withids = pack_documents(clash, BPE, capacity=64, with_ids=True).collect()
    verify(withids, CASES, 64)
    assert all(zlib.crc32(np.array(r.ids, "<u4")) == r.ids_crc32 for r in withids)


def test_table(table):
    df = table("documents")
    n, least = verify(pack_documents(df, BPE).collect(), [(r.doc_id, r.text) for r in df.collect()], 1024)
    assert n <= least * 1.02 + 1


def test_repeated_rows_are_counted_and_written_out_in_blocks(spark, docs):
    copies = docs([(7, "a row repeated"), (8, "another of it")]).crossJoin(spark.range(2 * BLOCK + 5).select()).repartition(5)
    rows = pack_documents(copies.union(docs(CASES)), BPE)
    n, least = verify(rows.collect(), [(i, t) for i, t in [(7, "a row repeated"), (8, "another of it")] for _ in range(2 * BLOCK + 5)] + CASES, 1024)
    assert n <= least + 1
    assert ranked(spark.createDataFrame([], "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, n bigint")).count() == 0


def test_places_do_not_depend_on_the_layout(docs):
    a, b = (sorted(map(str, pack_documents(docs(CASES, parts), BPE).collect())) for parts in (1, 7))
    assert a == b
