"""Repeated passages by recompression.

Recompression rewrites a word sequence in rounds: first every maximal run of one symbol becomes
a symbol, then every pair whose left symbol falls on the left side and whose right symbol on the
right side of a coin that depends on the symbol alone. A symbol's name is a hash of what it
replaces, so equal pieces carry equal names in all documents without asking anyone; the only
thing that a rewriting can see is its neighbourhood, and every symbol here carries the word range
its existence depends on. Wherever that range lies inside a window, every copy of the window
holds the same symbol at the same place.

1. Every window of ``window`` words is represented by one symbol: of those whose range lies
   inside it the highest level, of these the smallest hash. The choice is a function of the
   window's words alone, so equal windows choose equal symbols, and neighbouring windows mostly
   the same one. What leaves a task is one row per chosen symbol: ``name`` (of the words its range covers)
   and ``place`` (of all the words its windows cover). Level zero, the words, always fits.
2. Names of one document only are dropped: there is no repeat. Where name and place agree, all
   windows of the symbol agree, and the smallest document of the place decides. Only where one
   name has several places (at a repeat's ends) are single windows compared, by 128-bit hashes,
   and of each place only for its smallest document.
3. Documents that have a decision are rewritten; of the others no text is ever shuffled out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, name as column, stage_table, text_slices, texts_of, unused

ROUNDS = 2
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))  # odd: invertible modulo 2^64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Words:
    """The words of some documents one after the other, a unique separator around each."""

    def __init__(self, texts: list[list[bytes]]):
        n = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(n + 1) - n  # place 0 is a separator, then words, separator, ...
        self.ends = self.starts + n
        digest = xxhash.xxh64_intdigest
        self.hash = np.zeros(int(self.ends[-1]) + 1 if len(n) else 1, np.uint64)
        inside = np.ones(len(self.hash), bool)
        inside[0] = False
        inside[self.ends] = False
        self.hash[inside] = np.fromiter(map(digest, chain.from_iterable(texts)), np.uint64, int(n.sum()))
        outside = np.flatnonzero(~inside)
        self.hash[outside] = mix(outside.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
        self.sums = []
        for base, values in zip(BASES, (self.hash, mix(self.hash + np.uint64(1))), strict=True):
            power = np.cumprod(np.full(len(self.hash) + 1, base), dtype=np.uint64)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[:-1], dtype=np.uint64)])
            inverse = np.uint64(pow(int(base), -1, 2**64))
            self.sums.append((total, np.cumprod(np.full(len(self.hash) + 1, inverse), dtype=np.uint64)))

    def of(self, begin: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        """Hash of the words begin..end (a polynomial modulo 2^64, finalised with the length)."""
        total, back = self.sums[which]
        return mix((total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64))


def levels(words: np.ndarray, rounds: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Symbols of each level in text order: (symbol, left, right); the symbol depends on the
    words left..right only. Both bounds never fall from one symbol to the next."""
    at = np.arange(len(words))
    sym, left, right = words, at, at + 1
    out = [(sym, left, right)]
    for r in range(1, rounds + 1):
        # Runs: to be maximal, a run (of one, too) needs both neighbours.
        start = np.flatnonzero(np.concatenate([[True], sym[1:] != sym[:-1]]))
        end = np.append(start[1:], len(sym))
        length = (end - start).astype(np.uint64)
        head = sym[start]
        sym = np.where(length > 1, mix(head * np.uint64(3) + length), head)
        left, right = left[np.maximum(start - 1, 0)], right[np.minimum(end, len(right) - 1)]
        # Pairs: a left-side symbol before a right-side one.
        side = mix(sym ^ np.uint64(r)) >> np.uint64(63)
        first = np.flatnonzero((side[:-1] == 0) & (side[1:] == 1))
        new_sym, new_left, new_right = sym.copy(), left.copy(), right.copy()
        lone = np.ones(len(sym), bool)
        lone[first] = lone[first + 1] = False
        waits = np.flatnonzero(lone & (side == 0))   # would pair with the next
        asked = np.flatnonzero(lone & (side == 1))   # would pair with the one before
        new_right[waits] = right[np.minimum(waits + 1, len(right) - 1)]
        new_left[asked] = left[np.maximum(asked - 1, 0)]
        new_sym[first] = mix(mix(sym[first]) + np.uint64(r) ^ sym[first + 1] * np.uint64(5))
        new_right[first] = right[first + 1]
        keep = np.ones(len(sym), bool)
        keep[first + 1] = False
        sym, left, right = new_sym[keep], new_left[keep], new_right[keep]
        out.append((sym, left, right))
    return out


class Anchors:
    """The chosen symbols of all windows of some documents: document, first and last window
    start (``lo``, ``hi``, places in ``Words``), name and place."""

    def __init__(self, words: Words, window: int, rounds: int):
        n = np.maximum(words.ends - words.starts - window + 1, 0)
        doc = np.repeat(np.arange(len(n)), n)
        begin = np.repeat(words.starts - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        left, right = np.full(len(begin), -1), np.full(len(begin), -1)
        open_ = np.arange(len(begin))
        for sym, l_, r_ in reversed(levels(words.hash, rounds)):
            if not len(open_):
                break
            i = begin[open_]
            a, b = np.searchsorted(l_, i), np.searchsorted(r_, i + window, "right")
            rank = mix(sym)
            some = np.flatnonzero(b > a)
            a, b = a[some], b[some]
            best = a.copy()
            for t in range(1, int((b - a).max(initial=0))):
                more = np.flatnonzero(a + t < b)
                less = more[rank[a[more] + t] < rank[best[more]]]
                best[less] = a[less] + t
            left[open_[some]], right[open_[some]] = l_[best], r_[best]
            open_ = np.delete(open_, some)
        new = np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1]) | (doc[1:] != doc[:-1])]) if len(doc) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(doc))[:len(first)] - 1
        self.doc, self.lo, self.hi = doc[first], begin[first], begin[last]
        self.name = words.of(left[first], right[first], 0).view(np.int64)
        covered = words.of(self.lo, self.hi + window, 1) + (left[first] - self.lo).astype(np.uint64) if len(first) else np.zeros(0, np.uint64)
        self.place = mix(covered).view(np.int64)


def sha(words) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def removed(n_words: int, begins: np.ndarray, window: int) -> np.ndarray:
    """Mask of the words covered by windows that begin at ``begins``."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, begins, 1)
    np.add.at(edge, begins + window, -1)
    return np.cumsum(edge)[:-1] > 0


def _schema(text: str) -> str:
    return " ".join(text.split())


FACTS = _schema("doc_id bigint, name bigint, place bigint, n_words bigint, words_sha256 string")
RESULT = _schema("doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans array<array<bigint>>")


def repeats(docs: DataFrame, window: int = 50, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text",
            with_text: bool = False) -> DataFrame:
    """What stays of each document once every word is removed that is covered by a window of
    ``window`` consecutive words which also starts in a document with a smaller id.

    One row per input row: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one
    space), spans (removed word ranges [first, end)), and, ``with_text``, kept_text: null where
    nothing was removed, so that untouched texts need not be moved.

    Windows are judged on the input, words are case-sensitive runs without ASCII white space.
    Null text has no words. Rows that share an id are judged each, and never against each other.
    A document with a null id neither loses words nor makes others lose any. An empty table gives
    no rows. Other input columns are ignored.
    """
    d = documents(docs, id_col, text_col)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                ids = batch.column("doc_id")
                texts = [t.split() for t in texts_of(batch)]
                found = Anchors(Words([t if i.is_valid else [] for i, t in zip(ids, texts, strict=True)]), window, rounds)
                n, m = len(found.doc), len(texts)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(found.doc)), pa.array(found.name), pa.array(found.place), pa.nulls(n, pa.int64()),
                     pa.nulls(n, pa.string())], ["doc_id", "name", "place", "n_words", "words_sha256"])
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                     pa.array([sha(t) for t in texts])], ["doc_id", "name", "place", "n_words", "words_sha256"])

    facts = stage_table(d.mapInArrow(collect, FACTS), "anchors")
    chosen = facts.filter("name is not null").select("doc_id", "name", "place")
    shared = stage_table(chosen.groupBy("name").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
                         .filter("a < b").select("name"), "shared-names")
    found = stage_table(chosen.join(shared, "name"), "shared-anchors")
    places = stage_table(found.groupBy("name", "place").agg(F.min("doc_id").alias("first_id")), "places")
    # A common name has many places: they are dealt by (name, salt), and so are the names with several.
    salts = max(1, math.isqrt(places.count()))
    salted = places.withColumn("salt", F.pmod(F.xxhash64("place"), F.lit(salts)))
    several = stage_table(salted.groupBy("name", "salt").agg(F.count(F.lit(1)).alias("n"))
                          .groupBy("name").agg(F.sum("n").alias("n"), F.collect_list("salt").alias("salts"))
                          .filter("n > 1").select("name", F.explode("salts").alias("salt"), F.lit(True).alias("several")), "several")
    first = stage_table(salted.join(several, ["name", "salt"], "left")
                        .select("name", "place", "first_id", F.coalesce("several", F.lit(False)).alias("several")), "first-documents")
    # check = 0: a smaller document has all windows of the symbol; 1: compare them one by one.
    decided = (found.join(first, ["name", "place"]).filter("first_id < doc_id or several")
               .select("doc_id", "name", "place", (F.col("first_id") == F.col("doc_id")).cast("long").alias("check")))
    per_doc = stage_table(decided.groupBy("doc_id").agg(F.collect_set(F.array("name", "place", "check")).alias("decided")), "decisions")
    touched = stage_table(d.join(per_doc, "doc_id"), "touched")

    def open_windows(row_text: bytes, decisions) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Words, window starts that are settled, and starts to compare with their two hashes."""
        words = row_text.split()
        w = Words([words])
        anchors = Anchors(w, window, rounds)
        known = {(a, b): c for a, b, c in decisions}
        state = np.array([known.get(x, -1) for x in zip(anchors.name.tolist(), anchors.place.tolist(), strict=True)], np.int64)

        def starts(which: int) -> np.ndarray:
            picked = np.flatnonzero(state == which)
            return np.concatenate([np.arange(a, b + 1) for a, b in zip(anchors.lo[picked], anchors.hi[picked], strict=True)]
                                  or [np.zeros(0, np.int64)])
        settled, compare = starts(0), starts(1)
        hashes = np.stack([w.of(compare, compare + window, k).view(np.int64) for k in (0, 1)], 1)
        return words, settled - 1, compare - 1, hashes  # place 0 is a separator

    def list_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                ids, hashes = [], []
                for i, t, decisions in zip(batch.column("doc_id").to_pylist(), texts_of(batch), batch.column("decided").to_pylist(), strict=True):
                    h = np.unique(open_windows(t, decisions)[3], axis=0)
                    ids.append(np.full(len(h), i, np.int64))
                    hashes.append(h)
                if hashes:
                    h = np.concatenate(hashes)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(h[:, 0]), pa.array(h[:, 1])], ["doc_id", "h1", "h2"])

    undecided = touched.filter(F.exists("decided", lambda x: x[2] == 1))
    windows = stage_table(undecided.mapInArrow(list_windows, "doc_id bigint, h1 bigint, h2 bigint"), "windows")
    owners = stage_table(windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
                         .filter("a < b").select("h1", "h2", F.col("a").alias("first_id")), "window-owners")
    hits = (windows.join(owners, ["h1", "h2"]).filter("first_id < doc_id").groupBy("doc_id")
            .agg(F.collect_set(F.array("h1", "h2")).alias("hits")))

    schema = RESULT + (", kept_text string" if with_text else "")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                rows = []
                for i, t, decisions, hit in zip(batch.column("doc_id").to_pylist(), texts_of(batch), batch.column("decided").to_pylist(),
                                                batch.column("hits").to_pylist(), strict=True):
                    words, settled, compare, hashes = open_windows(t, decisions)
                    hit = {tuple(x) for x in hit or []}
                    matched = np.array([tuple(h) in hit for h in hashes.tolist()], bool)
                    gone = removed(len(words), np.concatenate([settled, compare[matched]]), window)
                    kept = list(compress(words, ~gone))
                    edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                    row = {"doc_id": i, "n_words": len(words), "n_removed": int(gone.sum()), "kept_sha256": sha(kept),
                           "spans": edges.reshape(-1, 2).tolist()}
                    if with_text:
                        row["kept_text"] = b" ".join(kept).decode() if gone.any() else None
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, out_schema)

    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
              ("spans", pa.list_(pa.list_(pa.int64())))]
    out_schema = pa.schema(fields + ([("kept_text", pa.string())] if with_text else []))
    rewritten = touched.join(hits, "doc_id", "left").select("doc_id", "text", "decided", "hits").mapInArrow(rewrite, schema)
    rest = (facts.filter("name is null").join(per_doc.select("doc_id"), "doc_id", "left_anti")
            .select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("words_sha256").alias("kept_sha256"),
                    F.array().cast("array<array<bigint>>").alias("spans")))
    if with_text:
        rest = rest.withColumn("kept_text", F.lit(None).cast("string"))
    return rewritten.unionByName(rest)


def without_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated words taken out of their texts (kept words joined by one
    space); rows that lose nothing keep their text as it is. Ids are taken to be unique."""
    key, text = unused(docs, "repeat_id"), unused(docs, "repeat_text")
    kept = (repeats(docs, window, id_col=id_col, text_col=text_col, with_text=True).filter("n_removed > 0")
            .select(F.col("doc_id").alias(key), F.col("kept_text").alias(text)))
    joined = docs.join(kept, column(id_col).cast("long") == F.col(key), "left")
    return joined.withColumn(text_col, F.coalesce(text, column(text_col))).drop(key, text)
