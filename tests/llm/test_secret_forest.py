import random
import re

import pytest
from pyspark.sql import functions as F

from pulse.llm.secret_forest import MASK, candidates, dictionary, redact, scan

MID = "/root/testdata/sf0.01"
S = "doc_id bigint, text string, source string"


def brute_candidates(text):
    """(word index, candidate) of a text."""
    out = []
    for i, w in enumerate(re.sub(r"[\t\n\x0b\x0c\r]", " ", text or "").split(" ")):
        out += [(i, c) for c in dict.fromkeys(re.findall(r"[A-Za-z0-9+/_\-]{12,}", w)) if re.search("[0-9]|^[A-Z]{16,}$", c)]
    return out


def make(rnd, n=400):
    """Texts with secrets (in unseen formats, too) and harmless look-alikes, and the truth."""
    words = ["plain", "words", "that", "stand", "between", "things", "everywhere"]
    rows, truth = [], {}
    hexa = lambda k: "".join(rnd.choice("0123456789abcdef") for _ in range(k))
    for i in range(n):
        kind = i % 5
        if kind == 0:
            c, s = "AKIA" + "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), "{}"
        elif kind == 1:
            c, s = hexa(40), 'token = "{}"'
        elif kind == 2:
            c, s = hexa(18), "password={}"
        elif kind == 3:
            c, s = "4" + "".join(rnd.choice("0123456789") for _ in range(15)), "{}"
        else:
            c, s = "everywhere_things_2024", "see {}"
        rows.append((i, " ".join(rnd.choices(words, k=6)) + " " + s.format(c) + " " + " ".join(rnd.choices(words, k=6)) + ".", f"src{i % 3}"))
        truth[i] = (c, kind < 3)
    return rows, truth


def test_held_out_accuracy(spark):
    rows, truth = make(random.Random(1))
    df = spark.createDataFrame(rows, S)
    all_ = candidates(df)
    given = all_.select("doc_id", "word_index", "candidate").collect()
    labels = [(r.doc_id, r.word_index, r.candidate, float(truth[r.doc_id][1])) for r in given if r.doc_id < 200]
    found = scan(df, findings=spark.createDataFrame(labels, "doc_id bigint, word_index int, candidate string, label double")).collect()
    other = [r for r in found if r.doc_id >= 200]
    assert len(other) == 200 and all(r.label is None for r in other)
    assert sum(r.is_secret == truth[r.doc_id][1] for r in other) >= 0.98 * len(other)


def test_rules_and_redaction(spark):
    rows, truth = make(random.Random(2), 200)
    rows += [(900, None, "a"), (901, "", None), (902, "no candidate here", "a"), (None, 'token = "0123abcd0123abcd"', "a"),
             (903, "é " * 30_000 + "password=00ff11aa22bb33cc end", "a"), rows[0]]
    df = spark.createDataFrame(rows, S).withColumns({"path": F.lit("x"), "label": F.lit(1), "word": F.lit("w"), "candidate": F.lit("c")})
    found = scan(df).collect()
    assert sorted((str(r.doc_id), r.word_index, r.candidate) for r in found) == sorted((str(i), k, c) for i, t, _ in rows for k, c in brute_candidates(t))
    out = redact(df)
    assert out.columns == df.columns and out.count() == len(rows)
    for r in out.collect():
        if r.doc_id in truth:
            c, secret = truth[r.doc_id]
            assert (c in r.text) != secret and (MASK in r.text) == secret
        elif r.doc_id in (903, None):
            assert MASK in r.text
    assert scan(spark.createDataFrame([], S)).count() == 0
    assert [r.score for r in scan(spark.createDataFrame([(1, "number 4111111111111111 only", "a")], S)).collect()] == [0.0]


def test_copied_secret_does_not_cover_itself(spark):
    rnd = random.Random(3)
    token = "qWertZuiOpasdFghJklYxcvBnmQwerTzuiop7aSd"  # nearly all of it in letter runs
    rows, _ = make(rnd)
    rows += [(1000 + i, f"Authorization: Bearer {token} number {i}", "a") for i in range(60)]
    rows += [(2000 + i, "seldomword is written in one copied text", "a") for i in range(60)]
    df = spark.createDataFrame(rows, S)
    words = {r.part for r in dictionary(df).collect()}
    assert {"authorization", "everywhere", "number"} <= words and not words & {"seldomword", *re.findall("[a-z]{4,}", token.lower())}
    found = [r for r in scan(df).collect() if r.candidate == token]
    assert len(found) == 60 and all(r.covered == 0 and r.label is None for r in found)
    assert {r.part for r in dictionary(df, share=0.5).collect()} < words


SHORT = [("password=hunter2", "hunter2"), ("pwd: Tr0ub4dor&3", "Tr0ub4dor&3"), ("passwd = 'P@ssw0rd!2024#',", "P@ssw0rd!2024#"),
         ('{"db_password":"x9$\\\\Ek2(m"}', "x9$\\\\Ek2(m"), ("see ftp://joe:s3cr@t@host.org/x", "s3cr@t"),
         ("password=correcthorsebattery", "correcthorsebattery"), ("key qWertZuiOpasdFgh", "qWertZuiOpasdFgh"),
         ("MIIEvgIBADANBgkqhkiG/wBAQEFAASCBKgwggSkAgEAAo".translate({ord(c): None for c in "0123456789"}),) * 2,
         ("key " + "qwertzuiopasdfghjklyxcvbnm", "qwertzuiopasdfghjklyxcvbnm")]


def test_short_values_and_letters_are_candidates(spark):
    rows = [(i, f"some words {t} more words", "a") for i, (t, _) in enumerate(SHORT)]
    rows += [(50, "the password is long: sixteen characters of http://host:80/x and Token: abc", "a")]
    got = {(r.doc_id, r.candidate) for r in candidates(spark.createDataFrame(rows, S)).collect()}
    assert got == {(i, c) for i, (_, c) in enumerate(SHORT)}


def test_short_values_are_masked(spark):
    rows, truth = make(random.Random(5))
    rows += [(1000 + i, f"some words {t} more words hunter2000", "src1") for i, (t, _) in enumerate(SHORT[:6])]
    df = spark.createDataFrame(rows, S)
    out = {r.doc_id: r.text for r in redact(df).collect()}
    for i, (t, c) in enumerate(SHORT[:6]):
        assert out[1000 + i] == f"some words {t} more words hunter2000".replace(c + " ", MASK + " ").replace(t, t.replace(c, MASK))
    assert all((c in out[i]) != secret for i, (c, secret) in truth.items())


def test_table(table):
    df = table("documents", MID)
    rows = {r.doc_id: r.text for r in df.collect()}
    found = scan(df).collect()
    assert sorted((r.doc_id, r.word_index, r.candidate) for r in found) == sorted((i, k, c) for i, t in rows.items() for k, c in brute_candidates(t))
    known = re.compile(r'AKIA[A-Z0-9]{16}|(?<=password=)[0-9a-f]{18}|(?<=token = ")[0-9a-f]{40}')
    planted = {(i, c) for i, t in rows.items() for c in known.findall(t or "")}
    assert {(r.doc_id, r.candidate) for r in found if r.is_secret} == planted and planted
    words = {r.part for r in dictionary(df).collect()}
    assert "license" in words


@pytest.mark.parametrize("query", ["op5_secret_scan"])
def test_plan_has_no_python(spark, query):
    from pulse.llm.queries import QUERIES
    plan = QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
