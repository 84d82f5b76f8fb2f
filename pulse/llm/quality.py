"""Quality classifier from weak labels.

1. Heuristic labellers look at every document and say clean, junk or nothing. What they said is
   counted by pattern over all documents (at most 3^labellers patterns).
2. Expectation-maximisation on the patterns estimates, without any true label, how often each
   labeller says what about clean and about junk documents, and with it the probability that a
   document of a pattern is clean.
3. These posterior labels train a logistic scorer over hashed words, word shapes and repeat
   counts, on at most ``TRAIN_ROWS`` documents (those with the smallest row hash). The scorer
   decides on all documents; it sees what the labellers' thresholds do not.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, stage_table, text_slices, texts_of

TRAIN_ROWS = 4000  # bound of the documents that fit the scorer
PRIOR = (np.array([20.0, 20.0]), np.array([0.5, 49.5]))  # votes (junk, clean) about a junk, a clean document
BITS = 16          # hashed features: 2^BITS
CACHE = 200_000    # shapes that a task keeps
_MASK = (1 << BITS) - 1

_LOWER, _UPPER, _DIGIT = (bytes(range(ord(a), ord(b) + 1)) for a, b in ("az", "AZ", "09"))
_HIGH, _BLANK = bytes(range(128, 256)), b" \t\n\r\x0b\x0c"
_PLAIN = b".,;:!?'\"()-"


def _share(part: int, whole: int) -> float:
    return part / whole if whole else 0.0


# A word's classes: a lower-case (and any non-ASCII) letter, A capital, 0 digit; signs stay.
_CLASSES = bytes(97 if chr(b).islower() or b > 127 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.DOTALL)


class Shapes(dict):
    """Per classes of a word: what the labellers ask about it, as bits, and the slot of its
    shape (runs of a class as one, runs of a sign as two). There are far fewer of them than
    words; bounded all the same."""

    BARE, TAIL, ENDS, SHORT = 1, 2, 4, 8

    def __missing__(self, classes: bytes) -> tuple[int, int]:
        if len(self) >= CACHE:
            self.clear()
        plain = any(c in b"aA0" for c in classes)
        kind = self.BARE * (not plain) | self.SHORT * (plain and len(classes) < 4) | self.ENDS * (classes[-1:] in (b".", b"!", b"?"))
        kind |= self.TAIL * (len(classes) > 2 and classes[-1:] in b"#$%&*!|~^=+<>@" and classes[-1] == classes[-2])
        shape = _RUNS.sub(lambda m: m[1] if m[1] in b"aA0" else m[1] * 2, classes)
        self[classes] = out = kind, _slot(b"s", shape)
        return out


@dataclass(slots=True)
class Stats:
    """Counts of one text: characters, and words by kind."""

    solid: int
    signs: int
    upper: int
    lower: int
    words: int
    distinct: int
    length: int
    stutter: int
    bare: int
    tails: int
    ends: int
    short: int


def repeats_of(words: list[bytes]) -> int:
    return sum(map(bytes.__eq__, words, words[1:]))


def stats_of(text: bytes, n_words: int, distinct: int, stutters: int, classes: Counter, shapes: Shapes) -> Stats:
    solid = text.translate(None, _BLANK)
    tally = [0] * 16
    for c, n in classes.items():
        tally[shapes[c][0]] += n
    of = lambda bit: sum(n for k, n in enumerate(tally) if k & bit)
    return Stats(len(solid), len(solid.translate(None, _LOWER + _UPPER + _DIGIT + _HIGH + _PLAIN)), len(solid) - len(solid.translate(None, _UPPER)),
                 len(solid) - len(solid.translate(None, _LOWER)), n_words, distinct, len(solid), stutters,
                 of(Shapes.BARE), of(Shapes.TAIL), of(Shapes.ENDS), of(Shapes.SHORT))


def symbols(s: Stats) -> int:
    """Share of unusual signs among the characters."""
    x = _share(s.signs, s.solid)
    return -1 if x > 0.08 else 1 if x < 0.03 else 0


def capitals(s: Stats) -> int:
    """Share of capitals among ASCII letters."""
    x = _share(s.upper, s.upper + s.lower)
    return 0 if s.upper + s.lower < 10 else -1 if x > 0.5 else 1 if x < 0.25 else 0


def variety(s: Stats) -> int:
    """Share of distinct words, which falls slowly with length in running text."""
    x = _share(s.distinct, s.words)
    return 0 if s.words < 40 else -1 if x < 0.2 else 1 if x > 0.4 else 0


def stutter(s: Stats) -> int:
    """Share of words that repeat the one before."""
    x = _share(s.stutter, s.words - 1)
    return 0 if s.words < 8 else -1 if x > 0.06 else 1 if x < 0.03 else 0


def separators(s: Stats) -> int:
    """Share of words without any letter or digit."""
    x = _share(s.bare, s.words)
    return -1 if x > 0.12 else 1 if x < 0.03 else 0


def tails(s: Stats) -> int:
    """Share of words that end in the same sign twice."""
    x = _share(s.tails, s.words)
    return -1 if x > 0.15 else 1 if x < 0.03 else 0


def sentences(s: Stats) -> int:
    """Words a sentence."""
    return 0 if s.words < 60 else -1 if s.ends * 80 < s.words else 1 if s.ends * 3 < s.words else 0


def word_length(s: Stats) -> int:
    """Mean length of words."""
    x = _share(s.length, s.words)
    return -1 if x > 20 or x < 1.5 else 1 if 2.5 < x < 12 else 0


def short_words(s: Stats) -> int:
    """Share of words of up to three letters: the function words of running text."""
    x = _share(s.short, s.words)
    return 0 if s.words < 40 else 1 if 0.15 < x < 0.75 else -1 if x < 0.05 else 0


LABELLERS = (symbols, capitals, variety, stutter, separators, tails, sentences, word_length, short_words)


def classes_of(text: bytes) -> Counter:
    """How often each word's classes occur."""
    return Counter(text.translate(_CLASSES).split())


def votes(text: bytes, shapes: Shapes) -> tuple[int, int]:
    """(pattern, words): the labellers' votes as a number in base 3."""
    words = text.split()
    return pattern_of(stats_of(text, len(words), len(set(words)), repeats_of(words), classes_of(text), shapes)), len(words)


def pattern_of(stats: Stats) -> int:
    code = 0
    for labeller in LABELLERS:
        code = code * 3 + (labeller(stats) if stats.words else 0) + 1
    return code


def posterior(patterns: dict[int, int], labellers: int = len(LABELLERS), rounds: int = 200) -> dict[int, float]:
    """Probability of clean for each pattern {code: documents} by expectation-maximisation, with
    the votes independent given the class; a labeller that says nothing tells nothing (most do
    on short texts). It starts from labellers that are mostly right, which fixes the meaning of
    the two classes; ``PRIOR`` documents smooth the counts."""
    if not patterns:
        return {}
    codes = np.array(sorted(patterns))
    n = np.array([patterns[c] for c in codes], float)
    said = np.stack([codes // 3**(labellers - 1 - k) % 3 for k in range(labellers)], 1)  # 0 junk, 1 nothing, 2 clean
    prior, table = 0.8, np.ones((2, labellers, 3))
    table[0][:, (0, 2)], table[1][:, (0, 2)] = (0.5, 0.5), (0.05, 0.95)
    at = np.arange(labellers)
    for _ in range(rounds):
        clean = np.log(prior) + np.log(table[1][at, said]).sum(1)
        junk = np.log(1 - prior) + np.log(table[0][at, said]).sum(1)
        p = 1 / (1 + np.exp(np.clip(junk - clean, -500, 500)))
        prior = (n @ p + 1) / (n.sum() + 2)
        for k in range(labellers):
            for c, weight in ((1, n * p), (0, n * (1 - p))):
                seen = np.bincount(said[:, k], weight, 3)[[0, 2]] + PRIOR[c]
                table[c, k, [0, 2]] = seen / seen.sum()
    return dict(zip(codes.tolist(), p.tolist(), strict=True))


def _slot(kind: bytes, key: bytes) -> int:
    return zlib.crc32(key, zlib.crc32(kind)) & _MASK


_WORD = zlib.crc32(b"w")  # the word itself, in lower case, hashes from here


STUTTER = _slot(b"r", b"")


def repeat_slot(count: int) -> int:
    return _slot(b"c", b"%d" % min(count.bit_length(), 12))


def features(text: bytes, shapes: Shapes) -> tuple[np.ndarray, np.ndarray]:
    """Slots and their shares of a document's words: words, shapes, repeat counts, stutters."""
    words = text.split()
    slots: Counter = Counter({STUTTER: repeats_of(words)})
    for w in text.lower().split():
        slots[zlib.crc32(w, _WORD) & _MASK] += 1
    for c, n in classes_of(text).items():
        slots[shapes[c][1]] += n
    for c in Counter(words).values():
        slots[repeat_slot(c)] += c
    return np.fromiter(slots.keys(), np.int32, len(slots)), np.fromiter(slots.values(), float, len(slots)) / max(1, len(words))


def fit(slots: list[np.ndarray], shares: list[np.ndarray], label: np.ndarray, rounds: int = 120, rate: float = 0.5, l2: float = 1e-5) -> np.ndarray:
    """Weights of the logistic scorer (the last is the intercept) for labels in 0..1, by
    gradient steps scaled per weight."""
    row = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
    slot, share = np.concatenate(slots), np.concatenate(shares)
    w, scale = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-8)
    for _ in range(rounds):
        z = np.bincount(row, share * w[slot], len(slots)) + w[-1]
        error = (1 / (1 + np.exp(-z)) - label) / len(label)
        g = np.append(np.bincount(slot, share * error[row], 1 << BITS), error.sum()) + l2 * w
        scale += g * g
        w -= rate * g / np.sqrt(scale)
    return w


def fit_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> tuple[dict[int, float], np.ndarray]:
    """(posterior by pattern, weights of the scorer) from all documents' votes and at most
    ``train_rows`` documents."""
    d = documents(docs, id_col, text_col)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for whole in batches:
            for batch in text_slices(whole):
                found = [votes(t, shapes) for t in texts_of(batch)]
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([p for p, _ in found], pa.int32()), pa.array([n for _, n in found], pa.int64())],
                                                 ["row", "pattern", "n_words"])

    hashed = d.withColumn("row", F.xxhash64("doc_id", "text"))
    said = stage_table(hashed.select("row", "text").mapInArrow(vote, "row bigint, pattern int, n_words bigint"), "votes").filter("n_words > 0")
    weak = posterior({r["pattern"]: r["count"] for r in said.groupBy("pattern").count().collect()})
    last = said.select("row").orderBy("row").limit(train_rows).agg(F.max("row")).first()[0]

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for whole in batches:
            for batch in text_slices(whole):
                texts = [t for t in texts_of(batch) if t.split()]
                found = [features(t, shapes) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([weak[votes(t, shapes)[0]] for t in texts], pa.float64()), pa.array([s.astype("<i4").tobytes() for s, _ in found], pa.binary()),
                     pa.array([v.astype("<f8").tobytes() for _, v in found], pa.binary())], ["label", "slots", "shares"])

    def train(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["label", "slots"], ignore_index=True)  # the same sum whatever the order of arrival
        w = fit([np.frombuffer(x, "<i4") for x in f["slots"]], [np.frombuffer(x, "<f8") for x in f["shares"]], f["label"].to_numpy())
        return pd.DataFrame({"slot": np.flatnonzero(w), "weight": w[np.flatnonzero(w)]})

    weights = np.zeros((1 << BITS) + 1)
    if last is not None:
        # Rows of one hash are equal, so it does not matter which of them the bound leaves out.
        sample = hashed.filter(F.col("row") <= last).select("text").mapInArrow(prepare, "label double, slots binary, shares binary")
        fitted = (sample.limit(train_rows).groupBy()
                  .applyInPandas(train, "slot int, weight double")).collect()  # at most 2^BITS + 1 rows
        weights[[r.slot for r in fitted]] = [r.weight for r in fitted]

    return weak, weights


class Judge:
    """Scores documents one after the other."""

    def __init__(self, weak: dict[int, float], weights: np.ndarray, threshold: float):
        self.weak, self.threshold, self.shapes, self.weights = weak, threshold, Shapes(), weights.tolist()
        self.repeats = [self.weights[repeat_slot(1 << i >> 1)] for i in range(13)]  # by bit length of the count

    def __call__(self, text: bytes) -> tuple[int, float, float, bool]:
        """(words, weak label, score, kept)"""
        words = text.split()
        if not words:
            return 0, 0.0, 0.0, False
        weight, repeats, shapes, crc = self.weights, self.repeats, self.shapes, zlib.crc32
        counts, classes, stutters = Counter(words), classes_of(text), repeats_of(words)
        total = (weight[STUTTER] * stutters + sum([weight[crc(w, _WORD) & _MASK] for w in text.lower().split()])
                 + sum([weight[shapes[c][1]] * n for c, n in classes.items()])
                 + sum([repeats[min(c.bit_length(), 12)] * c * n for c, n in Counter(counts.values()).items()]))
        p = 1 / (1 + math.exp(-max(-500.0, min(500.0, total / len(words) + weight[-1]))))
        pattern = pattern_of(stats_of(text, len(words), len(counts), stutters, classes, shapes))
        return len(words), self.weak.get(pattern, 0.0), p, p >= self.threshold


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS,
            threshold: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, n_words, weak_label (posterior probability of clean from the
    labellers), score (probability of clean from the scorer), kept (score >= threshold).

    Null text is empty; a text without words teaches nothing and is rejected with weak_label and
    score 0. Repeated rows are counted and judged each, null ids too. With nothing to learn from
    the result is empty or all rejected. Other input columns are ignored.
    """
    weak, weights = fit_quality(docs, id_col, text_col, train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(weak, weights, threshold)
        types = [pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
        for whole in batches:
            for batch in text_slices(whole):
                cols = zip(*map(judge, texts_of(batch)), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, types, strict=True))],
                                                 ["doc_id", "n_words", "weak_label", "score", "kept"])
    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_words bigint, weak_label double, score double, kept boolean")


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS,
                    threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns, in one pass
    without a shuffle."""
    weak, weights = fit_quality(docs, id_col, text_col, train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(weak, weights, threshold)
        for batch in batches:
            yield batch.filter(pa.array([judge(t)[3] for t in texts_of(batch, text_col)], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
