"""Token counts of whole texts, huge ones by overlapping chunks that are spliced again.

Texts of up to ``chunk`` characters are counted whole; where the tokeniser drops white space between
its pre-tokens, as the sum over white-space separated units, of which a task gives each distinct
one to the library once. Longer ones are cut into chunks that
overlap; every chunk is a row of its own, so one huge document is encoded by many tasks. Of two
neighbouring chunks A and B, A's tokens before a position p and B's tokens from p on are joined.
p is proven to be a boundary of the whole text's encoding if

* a pre-token (or added token) begins at p in A and in B. The pre-tokeniser's expression is
  matched from the end of the last match on, without looking back, so what follows p depends on
  the text from p on only, and A's matches up to p are those of the whole text because p lies
  ``LOOK`` characters before A's end;
* no added token lies across p: the overlap is longer than each of them, so one of A and B sees
  it whole and has no boundary inside it;
* canonical composition cannot join the character at p to what is before it.

Where the overlap holds no such p (one run as long as the overlap), the document goes to a next
round with four times longer chunks and overlaps, in the end as one chunk: exact at any length.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, stage_table, text_slices, texts_of

CHUNK = 1 << 16      # characters of a chunk in the first round
OVERLAP = 1 << 12    # characters that neighbours share
WIDER = 4            # both grow by this factor a round
LOOK = 2             # characters that an expression may look ahead
UNIT, MEMO = 64, 1 << 19   # bytes of a unit, and units, that a task remembers
# Fixed value: an expression none of whose matches holds white space.
SEPARATED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def longest_added(path: str) -> int:
    with open(path, encoding="utf-8") as f:
        return max((len(a["content"]) for a in json.load(f).get("added_tokens") or []), default=0)


@lru_cache(maxsize=1)
def _joins_back() -> frozenset:
    """Code points that canonical composition may join to the character before them."""
    jamo = {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    parts = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    return frozenset(jamo | {int(p[1], 16) for p in parts if len(p) == 2 and p[0][0] != "<"})


@lru_cache(maxsize=1 << 14)
def begins_fresh(c: str) -> bool:
    """Whether text before ``c`` cannot be composed or reordered with it. Characters that came
    after Unicode 3.2 are never used as boundaries: libraries may know different tables."""
    if c < "\x80":
        return True
    if unicodedata.ucd_3_2_0.category(c) == "Cn":
        return False
    first = unicodedata.normalize("NFD", c)[0]
    return not (unicodedata.combining(first) or ord(first) in _joins_back() or ord(c) in _joins_back())


def word_starts(path: str, text: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(tokens, position and token number of every pre-token's first token) of a text."""
    e = tokenizer(path).encode(text, add_special_tokens=False)
    if not len(e):
        return 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
    first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
    begins = np.array(e.offsets, np.int64)[:, 0]
    return len(words), begins[first], first


def white_space_separates(path: str) -> bool:
    """Whether ASCII white space ends every pre-token and is dropped: then a text's count is the
    sum of the counts of its white-space separated units. Read from the file; False if unsure."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    norm = spec.get("normalizer") or {}
    return (steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
            and steps[0].get("pattern") == {"Regex": SEPARATED}
            and steps[1:] == [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
            and [x.get("type") for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and norm["normalizers"][1] == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
            and not any(c.isspace() for a in spec.get("added_tokens") or [] for c in a["content"])
            and not any(a[k] for a in spec.get("added_tokens") or [] for k in ("lstrip", "rstrip", "single_word")))


class _Units:
    """Counts of texts as sums over their units; the library sees each distinct short unit once."""

    def __init__(self, path: str):
        self.path, self.known = path, {}

    def __call__(self, texts: list[bytes]) -> list[int]:
        if len(self.known) > MEMO:
            self.known = {}
        split = [t.split() for t in texts]
        new = list({u for units in split for u in units}.difference(self.known))
        found = tokenizer(self.path).encode_batch_fast([u.decode("utf-8", "replace") for u in new], add_special_tokens=False)
        fresh = dict(zip(new, map(len, found)))
        self.known.update((u, n) for u, n in fresh.items() if len(u) <= UNIT)
        return [sum(self.known[u] if u in self.known else fresh[u] for u in units) for units in split]


def _whole(path: str):
    def run(texts: list[bytes]) -> list[int]:
        found = tokenizer(path).encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [len(e) for e in found]
    return run


def _short_counts(path: str, separate: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _Units(path) if separate else _whole(path)
        for batch in batches:
            for part in text_slices(batch):
                n = count(texts_of(part))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(n, pa.int64())],
                                                 ["doc_id", "n_bytes", "n_tokens"])
    return run


def _chunks(chunk: int, overlap: int):
    """(key, no, begin, last, text): chunk ``no`` ends at (no + 1) * chunk and begins ``overlap``
    before no * chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, raw in zip(batch.column("key").to_pylist(), texts_of(batch)):
                text = raw.decode("utf-8", "replace")
                count = max(1, -(-len(text) // chunk))
                for no in range(count):
                    begin = max(0, no * chunk - overlap)
                    yield pa.RecordBatch.from_pydict({
                        "key": pa.array([key], pa.int64()), "no": pa.array([no], pa.int64()),
                        "begin": pa.array([begin], pa.int64()), "last": [no == count - 1],
                        "text": [text[begin:(no + 1) * chunk]]})
    return run


def _encode_chunks(path: str, chunk: int, overlap: int):
    """(key, no, n, head, tail): tokens of the chunk, and {position: tokens before it} of the
    proven boundaries in the overlaps with the chunk before and the chunk after."""
    kind = pa.map_(pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("key", "no", "begin", "last")]
            for key, no, begin, last, raw in zip(*cols, texts_of(batch)):
                text = raw.decode("utf-8", "replace")
                n, at, before = word_starts(path, text)

                def between(low: int, high: int) -> list[tuple[int, int]]:
                    hit = np.flatnonzero((at + begin >= low) & (at + begin < high))
                    return [(int(at[i]) + begin, int(before[i])) for i in hit if begins_fresh(text[at[i]])]

                end = (no + 1) * chunk
                head = between(begin, no * chunk - LOOK) if no else []
                tail = [] if last else between(end - overlap, end - LOOK)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key], pa.int64()), pa.array([no], pa.int64()), pa.array([n], pa.int64()),
                     pa.array([last]), pa.array([head], kind), pa.array([tail], kind)],
                    ["key", "no", "n", "last", "head", "tail"])
    return run


def spliced(long_docs: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(key, n_tokens, failed) of one round over (key, text); failed: a boundary found no splice."""
    cut = long_docs.select("key", "text").mapInArrow(_chunks(chunk, overlap),
                                                     "key long, no long, begin long, last boolean, text string")
    parts = stage_table(cut.repartition("key", "no").mapInArrow(
        _encode_chunks(path, chunk, overlap),
        "key long, no long, n long, last boolean, head map<long,long>, tail map<long,long>"), "chunks")
    left = parts.select("key", "no", "n", "last", "tail")
    right = parts.filter("no > 0").select("key", (F.col("no") - 1).alias("no"), "head")
    p = F.array_max(F.array_intersect(F.map_keys("tail"), F.map_keys("head")))
    both = (left.join(right, ["key", "no"], "left").withColumn("p", p)
            .withColumn("lost", F.col("n") - F.element_at("tail", F.col("p")) + F.element_at("head", F.col("p"))))
    return both.groupBy("key").agg(
        F.sum(F.col("n") - F.when(F.col("last"), 0).otherwise(F.col("lost"))).alias("n_tokens"),
        F.max(~F.col("last") & F.col("p").isNull()).alias("failed"))


def token_counts(df: DataFrame, path: str, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): UTF-8 bytes and library tokens of every text.

    ``path`` is a ``tokenizers`` file whose pre-tokeniser splits by expressions that do not look back
    and whose normaliser works character by character, canonical composition aside. Strings of
    added tokens inside a text count as the library counts them by default. One row out for
    every row in: repeated rows, null ids and ties stay as they are; null and empty texts have 0
    bytes and 0 tokens; an empty table gives an empty result; other columns are not read. Any
    length is counted whole; bytes that are no UTF-8 are read as replacement characters.
    """
    if overlap < longest_added(path) + 2 * LOOK or chunk < 2 * overlap:
        raise ValueError("the overlap must exceed every added token, and the chunk twice the overlap")
    docs = documents(df, id_col, text_col).select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    counted = docs.filter(F.length("text") <= chunk).mapInArrow(_short_counts(path, white_space_separates(path)), "doc_id long, n_bytes long, n_tokens long")
    # A written key stays the same however often a task is repeated.
    huge = stage_table(docs.filter(F.length("text") > chunk).withColumn("key", F.monotonically_increasing_id()), "huge")
    rest = huge
    while not rest.isEmpty():
        result = stage_table(spliced(rest, path, chunk, overlap), "spliced")
        done = result.filter("NOT failed").select("key", "n_tokens")
        counted = counted.unionByName(huge.select("key", "doc_id", "n_bytes").join(done, "key")
                                      .select("doc_id", "n_bytes", "n_tokens"))
        rest = rest.join(result.filter("failed").select("key"), "key", "left_semi")
        chunk, overlap = chunk * WIDER, overlap * WIDER
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
