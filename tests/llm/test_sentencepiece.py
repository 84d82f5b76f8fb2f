import random
import struct
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece as sp
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers import models as tm

from pulse.llm.sentencepiece_viterbi import Model, decode, digests, encode, model

FILE = P.path("piece_bpe_32k.model")
LIB = sp.SentencePieceProcessor(model_file=FILE)


def ids(m, text):
    return np.frombuffer(m.encode([text])[0], "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text("ab te\n▁ .,inrhs", max_size=60)))
def test_ids_are_those_of_the_library(text):
    if "\x00" not in text:  # the library ends some strings there
        assert ids(model(FILE), text) == LIB.encode(text)


@pytest.mark.parametrize("text", ["", " ", "  ", " " * 77 + "a", "a" + " " * 33 + "\n  b ", "é€😀日本", "x" * 3000, "the " * 5000,
                                  "internationalisation" * 200, "," * 100 + "=" * 50])
def test_special_texts(text):
    assert ids(model(FILE), text) == LIB.encode(text)
    assert model(FILE).decode(np.array(LIB.encode(text), np.int64)) == text


@settings(max_examples=300, deadline=None)
@given(st.text("ab theinrs▁=é€\n", min_size=1, max_size=60))
def test_long_units_take_the_same_path(text):
    m = model(FILE)
    for unit in {u for u in m.unit.findall(m.normalised(text)) if not u.startswith("▁▁")}:
        assert m.search_long(unit) == m.search([unit])[0]


@pytest.mark.parametrize("text", ["x" * 300_000, "".join(random.Random(5).choices("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/", k=300_000)),
                                  "日本語€" * 50_000, "a1" * 150_000, " " * 300_000, "-" * 70_000 + " b" + "=" * 70_000], ids=range(6))
def test_very_long_words(text):
    begin = time.monotonic()
    got = ids(model(FILE), text)
    assert time.monotonic() - begin < 60
    assert got == LIB.encode(text)
    assert all(len(u) <= 256 for u in model(FILE).cache)


def unigram_file(path, pieces):
    """A unigram model file: pieces (text, score), an unknown piece first, no byte pieces."""
    def field(n, payload):
        size, out = len(payload), b""
        while size > 127:
            out += bytes([size & 127 | 128])
            size >>= 7
        return bytes([n << 3 | 2]) + out + bytes([size]) + payload

    def piece(text, score, kind):
        return field(1, field(1, text.encode()) + b"\x15" + struct.pack("<f", score) + bytes([3 << 3, kind]))
    body = piece("<unk>", 0, 2) + b"".join(piece(t, s, 1) for t, s in pieces)
    body += field(2, bytes([3 << 3, 1])) + field(3, bytes([3 << 3, 1, 4 << 3, 0, 5 << 3, 1]))
    path.write_bytes(body)
    return str(path)


def test_unigram_models_maximise_the_sum(tmp_path):
    rnd = random.Random(3)
    texts = {"".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 5))) for _ in range(60)} | set("abcd") | {"▁", "▁a", "▁ab"}
    pieces = [(t, -rnd.uniform(1, 8)) for t in sorted(texts)]
    path = unigram_file(tmp_path / "u.model", pieces)
    m = Model(path)
    pieces = [("<unk>", 0.0)] + [(t, float(m.score[i + 1])) for i, (t, _) in enumerate(pieces)]
    other = Tokenizer(tm.Unigram(pieces, 0, False))
    for _ in range(200):
        text = " ".join("".join(rnd.choice("abcdx") for _ in range(rnd.randint(1, 12))) for _ in range(3))
        want = other.encode("▁" + text.replace(" ", "▁")).ids
        got = ids(m, text)
        cost = {i: s for i, (_, s) in enumerate(pieces)}
        unit = "▁" + text.replace(" ", "▁")
        assert m.search_long(unit) == m.search([unit])[0]
        assert [x for x in got] == want or abs(sum(cost[x] for x in got) - sum(cost[x] for x in want)) < 1e-5


CASES = [(1, None), (2, ""), (3, "Hello  world"), (3, "Hello  world"), (None, "null id"), (4, "long word " * 40_000), (5, "é\n\tx ▁")]


def test_cases(docs):
    rows = {(r.doc_id, tuple(r.ids)) for r in encode(docs(CASES), FILE).collect()}
    assert rows == {(i, tuple(LIB.encode(t or ""))) for i, t in CASES}
    back = sorted((str(r.doc_id), r.text) for r in decode(encode(docs(CASES), FILE), FILE).collect())
    assert back == sorted((str(i), (t or "").replace("▁", " ")) for i, t in CASES)
    assert encode(docs([]), FILE).count() == 0 and decode(encode(docs([]), FILE), FILE).count() == 0
    clash = docs(CASES).withColumns({"ids": F.lit("x"), "n_ids": F.lit(1)})
    assert digests(clash, FILE).count() == len(CASES)


def test_table(table):
    df = table("documents", "/root/testdata/sf0.01")
    text = {r.doc_id: r.text or "" for r in df.collect()}
    for r in digests(df, FILE).collect():
        want = LIB.encode(text[r.doc_id])
        assert (r.n_ids, r.ids_crc32, r.round_trip) == (len(want), zlib.crc32(np.array(want, "<u4")), True)
