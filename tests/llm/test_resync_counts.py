import duckdb
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulse.llm.queries import QUERIES, WORDS
from pulse.llm.resync_counts import begins_fresh, token_counts, white_space_separates

TEXTS = [
    None, "", "   \n\t ", "Plain words, it's 42's and 'twas; they'll 've 'VE.", "-" * 900, "ab " * 300, "a" * 1500,
    "x<|endoftext|>y<|startoftext|>" * 40, "<|endo" * 100 + "ftext|>" * 100, "café " * 200, "ȩ́" * 400,
    "한" * 300, "日本語。" * 200, "日" * 700, "ﬁ İx Ω " * 150, "'s" * 400, "''s-" * 300,
    "̈́" * 300, "\U0001f469‍\U0001f680 " * 120, "ßẞ 1234567 " * 80, "à" * 250 + "!" * 600 + " end",
]


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda x: len(t.encode(x or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("chunk, overlap", [(64, 24), (200, 64), (1 << 16, 1 << 12)])
def test_equals_the_library(docs, file, chunk, overlap):
    path = P.path(file)
    count = library(path)
    rows = [(i, x) for i, x in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, TEXTS[7])]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit)
                 for r in token_counts(docs(rows), path, limit=300, chunk=chunk, overlap=overlap).collect())
    assert got == sorted((i is None, i or 0, len((x or "").encode()), count(x), count(x) > 300) for i, x in rows)


def test_documents_in_small_chunks(spark):
    path = P.path("word_bpe_49k.json")
    count = library(path)
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in token_counts(table, path, chunk=300, overlap=40).collect()}
    assert got == {r.doc_id: count(r.text) for r in table.collect()}


def test_long_runs(docs):
    path = P.path("word_bpe_49k.json")
    count = library(path)
    rows = list(enumerate(u * (1_000_000 // len(u)) for u in ("-", " ", "a", "_a", "it's ", "日")))
    got = {r.doc_id: r.n_tokens for r in token_counts(docs(rows), path).collect()}
    assert got == {i: count(x) for i, x in rows}


def test_query_and_extra_columns(spark):
    sf = "/root/testdata/sf0.001"
    count = library(WORDS)
    got = QUERIES["op11_token_counts"](spark, sf)
    assert got.dtypes[:4] == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted((i, len(x.encode()), count(x), count(x) > 2048) for i, x in rows)
    clash = spark.read.parquet(f"{sf}/documents.parquet").limit(5).withColumns({"key": F.lit(1), "no": F.lit(2), "n_bytes": F.lit("x")})
    assert token_counts(clash, WORDS, chunk=200, overlap=40).count() == 5
    assert token_counts(clash.limit(0), WORDS).count() == 0


def test_units_only_where_white_space_separates():
    assert white_space_separates(WORDS) and not white_space_separates(P.path("byte_bpe_50k.json"))


def test_boundary_characters():
    assert all(map(begins_fresh, "a -<日é가"))
    assert not any(map(begins_fresh, "́ᅡᆨ̈́া"))


def test_bad_overlap(docs):
    with pytest.raises(ValueError):
        token_counts(docs([(1, "a")]), WORDS, chunk=64, overlap=8)
