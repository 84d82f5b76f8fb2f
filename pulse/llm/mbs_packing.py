"""Packing documents into sequences by minimum bin slack.

Only the histogram of piece lengths matters for the choice of bins, and it has at most
``capacity`` entries at any input size. The driver therefore plans on the histogram alone: a bin
takes the longest length left, a bitset subset-sum over the available lengths finds the fullest
combination that fits beside it, and that bin is repeated while its lengths last. Executors
tokenise, rank the pieces of each length and look their place up in the plan. Ranking splits
every length into about sqrt(rows) hash buckets, so a length that a third of all pieces share
is ranked by many tasks; a row that is repeated is counted first and ranked once.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zlib
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import documents, stage_table, text_slices

RUN = 5_000
BLOCK = 4_096  # copies of a repeated piece that one row writes out
SPACE_RUN = re.compile(r"\s{%d}" % (RUN + 1))
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _byte_alphabet() -> dict[str, int]:
    """Characters of byte-level vocabularies: printable Latin-1 stands for itself, every other
    byte for the next code point from 256 on."""
    plain = {b for b in range(256) if b not in range(33) and b not in range(127, 161) and b != 173}
    other = iter(range(256, 512))
    return {chr(b if b in plain else next(other)): b for b in range(256)}


@lru_cache(maxsize=4)
def encoder(path: str, added_tokens: bool = False):
    """A function text -> uint32 ids for a tokenizers file. With ``added_tokens`` the strings of
    the file's added tokens get their own ids, as the library gives them by default; without, the
    special ones among them are ordinary text. A byte-level BPE whose ids follow its merges is run by
    tiktoken, which gives the same ids several times faster; anything else, and with
    ``added_tokens`` a text that holds one of their strings, by the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    added = {t["content"] for t in spec.get("added_tokens", [])}
    merges = [m if isinstance(m, str) else " ".join(m) for m in model.get("merges", [])]
    vocab = {t: i for t, i in model.get("vocab", {}).items() if t not in added}
    if (model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
            and not pre.get("add_prefix_space") and not spec.get("normalizer") and not model.get("ignore_merges")
            and len(vocab) == 256 + len(merges)
            and all(vocab.get(m.replace(" ", "")) == 256 + i for i, m in enumerate(merges))):
        import tiktoken
        alphabet = _byte_alphabet()
        ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items()}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        bpe = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        own = _library(path, added_tokens)
        # tiktoken fails on very long white space and is slow on very long words.
        return lambda text: (own(text) if added_tokens and any(t in text for t in added) or long_run(text)
                             else bpe.encode_to_numpy(text, disallowed_special=()))
    return _library(path, added_tokens)


def long_run(text: str) -> bool:
    """Whether a text holds more than ``RUN`` characters of white space, or of none, in a row."""
    return len(text) > RUN and (max(map(len, text.split()), default=0) > RUN or bool(SPACE_RUN.search(text)))


@lru_cache(maxsize=4)
def _library(path: str, added_tokens: bool):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not added_tokens
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def cut(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces behind a first
    piece of what is left over."""
    first = n_ids % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n_ids, capacity))]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2,
                 id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (of the little-endian unsigned
    32-bit ids) and, with ``with_ids``, the ids. ``tokenizer`` is a file that every executor has;
    the ids are the tokenizers library's, those of the file's added tokens included."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, added_tokens=True)
        for whole in batches:
            for batch in text_slices(whole):
                rows, ids_out = [], []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                    for k, (start, length) in enumerate(cut(len(ids), capacity)):
                        part = ids[start:start + length]
                        rows.append((doc_id, k, start, length, zlib.crc32(part)))
                        if with_ids:
                            ids_out.append(part.astype(np.int32))
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(ids_out, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)
    schema = PIECE + (", ids array<int>" if with_ids else "")
    return documents(docs, id_col, text_col).mapInArrow(run, schema)


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to ``room``: a bitset of
    reachable sums grows length by length, longest first, until ``room`` itself is reached.
    ``lengths`` is in falling order."""
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for length in lengths:
        if length > room:
            continue
        left, part = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= reach << length * part & mask
            left, part = left - part, part * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + part
            total -= length * part
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int) -> tuple[pd.DataFrame, int]:
    """Minimum bin slack over a histogram {length: pieces}. Returns the plan, rows (length,
    first, copies, sequence, offset): from rank ``first`` on, ``copies`` pieces of the length go
    side by side from ``offset`` into each of the sequences from ``sequence`` on; and the number
    of sequences. Every repeated bin uses up one of its lengths for the same choice, so there
    are at most sum(capacity / length) different bins, whatever the number of pieces."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    if any(n < 1 or n > capacity for n in counts):
        raise ValueError("a piece is empty or longer than the capacity")
    used, rows, sequences = dict.fromkeys(counts, 0), [], 0
    lengths = sorted(counts, reverse=True)
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        bin_ = fullest(lengths, counts, capacity - longest)
        counts[longest] += 1
        bin_[longest] = bin_.get(longest, 0) + 1
        times, offset = min(counts[n] // c for n, c in bin_.items()), 0
        for n, c in sorted(bin_.items(), reverse=True):
            rows.append((n, used[n], c, sequences, offset))
            used[n] += c * times
            counts[n] -= c * times
            offset += n * c
        sequences += times
        lengths = [n for n in lengths if counts[n]]
    return pd.DataFrame(rows, columns=["length", "first", "copies", "sequence", "offset"]).sort_values(
        ["length", "first"], ignore_index=True), sequences


def ranked(counted: DataFrame) -> DataFrame:
    """One row per copy with ``rank`` (from 0, gapless) among the pieces of the same length.
    ``counted``: a written table of distinct pieces with the number ``n`` of their copies. A piece
    with many copies is one row until its copies are written out, in blocks dealt over the tasks."""
    buckets = max(1, math.isqrt(counted.count()))
    keyed = counted.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = keyed.groupBy("length", "bucket").agg(F.sum("n").alias("size"))
    so_far = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "bucket", F.coalesce(F.sum("size").over(so_far), F.lit(0)).alias("before"))
    inside = (Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (keyed.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, ["length", "bucket"])
              .withColumn("first", F.col("before") + F.col("inside"))
              .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {BLOCK}")))))
    copies = F.sequence(F.col("block") * BLOCK, F.least(F.col("n"), (F.col("block") + 1) * BLOCK) - 1)
    return (placed.repartition("length", "bucket", "first", "block").withColumn("copy", F.explode(copies))
            .withColumn("rank", F.col("first") + F.col("copy"))
            .drop("bucket", "before", "inside", "first", "block", "copy", "n"))


def pack_pieces(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """``pieces`` (with doc_id, piece, start, length, ids_crc32) and their place: sequence_id and
    offset. Repeated pieces are counted before they are shuffled and written."""
    counted = stage_table(pieces.groupBy(*pieces.columns).agg(F.count(F.lit(1)).alias("n")), "pieces")
    histogram = {r["length"]: r["n"] for r in  # at most ``capacity`` rows
                 counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, _ = plan_bins(histogram, capacity)
    by_length = {n: g.reset_index(drop=True) for n, g in plan.groupby("length")}
    rows = ranked(counted)
    schema = rows.drop("rank").schema.add("sequence_id", LongType()).add("offset", LongType())

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sequence, offset = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
            for n, at in f.groupby("length").indices.items():
                p, rank = by_length[n], f["rank"].to_numpy()[at]
                k = np.searchsorted(p["first"].to_numpy(), rank, "right") - 1
                within, copies = rank - p["first"].to_numpy()[k], p["copies"].to_numpy()[k]
                sequence[at] = p["sequence"].to_numpy()[k] + within // copies
                offset[at] = p["offset"].to_numpy()[k] + within % copies * n
            yield f.drop(columns="rank").assign(sequence_id=sequence, offset=offset)
    return rows.mapInPandas(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece with its sequence_id and offset (gapless from 0 in every sequence).

    Null text is empty and packs its end id alone. Repeated rows are packed each. A null id is
    kept. Ties are broken by doc_id, piece and content. An empty table gives no rows. Other
    input columns are ignored.
    """
    pieces = token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids)
    return pack_pieces(pieces, capacity)
