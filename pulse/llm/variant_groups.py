"""Spelling variants grouped by PartEnum signatures of letter multisets.

A word is the set of its (letter, occurrence) pairs, a binary vector. One edit changes at most two
of its bits, so words one edit apart have a Hamming distance of at most ``DISTANCE``. PartEnum deals
the bits into ``FIRST`` parts, one of which holds at most ``DISTANCE2`` of the differing bits, and
each part into ``SECOND`` smaller ones; a signature is what a word has in all but ``DISTANCE2`` of
the smaller parts. Every choice of them is enumerated, so near words surely share a signature.

Anagrams and words over few letters share signatures without being near, in groups that grow
with the vocabulary. So a signature is joined together with half of the word: an edit leaves the first
or the last half alone, and that too loses no pair. Equal keys are joined, candidates verified by
edit distance, and pairs that several keys gave are counted once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, stage_table, text_slices, texts_of

DISTANCE = 2                             # bits by which near words may differ
FIRST, SECOND = 1, 4
DISTANCE2 = -(-(DISTANCE + 1) // FIRST) - 1
SIFTED = 200                             # letters up to which Spark's own edit distance sifts candidates
HELD = 1 << 17                           # distinct words that a task counts before it passes them on

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _word_counts(shortest: int, rate: int):
    run_of = re.compile("[a-zÀ-ÿ]{%d,}" % shortest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return rows

        for batch in batches:
            for part in text_slices(batch):
                for i, raw in zip(part.column("doc_id").to_pylist(), texts_of(part)):
                    seed = zlib.crc32(b":" if i is None else b"%d:" % i)
                    for word in run_of.findall(raw.translate(LOWER).decode("utf-8", "replace")):
                        h = zlib.crc32(word.encode(), seed)
                        if h % rate == 0:
                            k = h % len(word)
                            word = word[:k] + word[k + 1:]
                            if len(word) < shortest:
                                continue
                        held[word] = held.get(word, 0) + 1
                    if len(held) >= HELD:
                        yield out()
        if held:
            yield out()
    return run


def vocabulary(df: DataFrame, shortest: int = 6, least: int = 5, rate: int = 199,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): lower-cased letter runs of all texts with their counts; a run whose checksum with
    its document's id ``rate`` divides loses one letter. A null id is written as the empty string."""
    counts = documents(df, id_col, text_col).mapInArrow(_word_counts(shortest, rate), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _bit(letter: str, occurrence: int) -> tuple[int, int, int]:
    """(first-level part, second-level part, 64-bit name) of a bit."""
    h = int.from_bytes(blake2b(f"{letter}{occurrence}".encode(), digest_size=16).digest(), "little")
    return (h >> 64) % FIRST, (h >> 96) % SECOND, h & (1 << 63) - 1


def signatures(word: str, bits: dict) -> list[int]:
    """The word's PartEnum signatures: sums of bit names over the parts that a signature keeps, with
    the choice of parts."""
    sums = [[0] * SECOND for _ in range(FIRST)]
    seen: dict[str, int] = {}
    for c in word:
        seen[c] = seen.get(c, 0) + 1
        key = c, seen[c]
        part, piece, name = bits.get(key) or bits.setdefault(key, _bit(*key))
        sums[part][piece] += name
    keep = list(combinations(range(SECOND), SECOND - DISTANCE2))
    return [(sum(sums[part][i] for i in chosen) * 31 + part * len(keep) + k) % (1 << 63)
            for part in range(FIRST) for k, chosen in enumerate(keep)]


def halves(word: str) -> list[str]:
    """First and last letters, as many as a word of this length or one shorter shares with every
    word one edit away."""
    return [side for m in {(len(word) - 1) // 2, (len(word) - 2) // 2}
            for side in (f"<{word[:m]}", f"{word[len(word) - m:]}>")]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits: dict = {}
    for batch in batches:
        words = batch.column("word").to_pylist()
        if len(bits) > HELD:
            bits.clear()
        yield pa.RecordBatch.from_arrays(
            [batch.column("word"), batch.column("n"),
             pa.array([signatures(w, bits) for w in words], pa.list_(pa.int64())),
             pa.array([halves(w) for w in words], pa.list_(pa.string()))], ["word", "n", "signatures", "halves"])


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    low, high = 0, len(a)
    while low < high:                    # the common prefix's length, by whole-slice comparisons
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return a[low + (len(a) == len(b)):] == b[low + 1:]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(list(map(one_edit, batch.column("a").to_pylist(), batch.column("b").to_pylist())), pa.bool_()))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, a_n, b_n): every pair of words a < b that differ by one inserted, deleted or replaced
    code point, once."""
    keys = words.mapInArrow(_keys, "word string, n long, signatures array<long>, halves array<string>")
    keyed = (keys.select("word", "n", "halves", F.explode("signatures").alias("s"))
             .select("word", "n", "s", F.explode("halves").alias("h"))
             .select(F.xxhash64("s", "h").alias("key"), "word", "n"))
    a, b = keyed.toDF("key", "a", "a_n"), keyed.toDF("key", "b", "b_n")
    # Spark's distance sifts pairs inside the join; on long words, where it is slow, only one_edit judges.
    near = (F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1) & (
        F.when(F.length("a") <= SIFTED, F.levenshtein("a", "b", 1) == 1).otherwise(True))
    # Spark sizes the keys by the words' file, not by the rows that explode gives, and would broadcast them.
    return (a.join(b.hint("merge"), "key").filter(near).select("a", "b", "a_n", "b_n").distinct()
            .mapInArrow(_verified, "a string, b string, a_n long, b_n long"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last by doubling. Counts grow along
    forms, so there is no circle."""
    steps = stage_table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = stage_table(steps.join(ahead.hint("merge"), "root", "left")
                            .select("word", F.coalesce("next", "root").alias("root"),
                                    F.col("next").isNotNull().alias("moved")), "roots")
        if steps.filter("moved").isEmpty():
            return steps.select("word", "root")
        steps = steps.select("word", "root")


def variant_groups(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a table of distinct (word, n).

    The form is the near word of largest n (of equal ones the smallest in code-point order) if that
    is at least ``ratio`` times the word's n. Null words are left out; repeated rows of a word are
    added up; words of any length take part; an empty table gives an empty result.
    """
    words = stage_table(words.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")), "words")
    pairs = stage_table(near_pairs(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("other")).alias("best")).unionByName(
        pairs.select(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("less"), F.col("a").alias("other")).alias("best")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("best").alias("best"))
    is_form = -F.col("best.less") >= ratio * F.col("n")
    linked = stage_table(words.join(near.hint("merge"), "word", "left").select(
        "word", F.when(is_form, F.col("best.other")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    roots = last_forms(linked.filter("form IS NOT NULL"))
    return (linked.join(roots.hint("merge"), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def spelling_variants(df: DataFrame, shortest: int = 6, least: int = 5, rate: int = 199, ratio: int = 5,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``variant_groups`` of the ``vocabulary`` of whole texts. Null texts have no words; repeated
    rows count as often as they stand; other columns are not read."""
    return variant_groups(vocabulary(df, shortest, least, rate, id_col, text_col), ratio)
