"""Context-tree weighting over bytes.

Every byte is eight binary decisions (a node of the byte's bit prefix), each with a tree of its
own whose contexts are the 0..depth preceding bytes. A node estimates its bit by
Krichevsky-Trofimov; a tree mixes the estimates of all depths, each split weighted by one half:
Pw = (Pe + product of the children's Pw) / 2. The model after training is the conditional
probability of that mixture, so a byte costs what all depths together say.

How it runs, with text sent through one shuffle only:

1. One pass over the texts finds, per chunk (input partition), its distinct n-grams (context +
   byte) and words, and how often training documents have them. They are packed by bucket:
   n-grams by their two nearest context bytes, words by hash.
2. A bucket that holds more than ``HEAVY`` of all n-grams is dealt again by its third context
   byte, a rule of shares alone. Buckets are merged over the chunks, ``PART`` chunks a time, level by
   level. Each builds its subtrees in numpy; depths 0 and 1 (at most 256 x 255 nodes) meet on the
   driver, and so does depth 2 of the heavy buckets (at most 1 / HEAVY buckets x 256 x 255 nodes).
3. Each chunk's bucket is answered by the merged bucket: a log-probability per n-gram, for those
   that training never saw as well (the deepest seen node decides), and a count per word. The
   answers keep the order of the questions, so they are numbers only.
4. Each chunk scores its documents with its answers. What a task holds is bounded by its chunk,
   or by ``PART`` chunks' share of a bucket.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, stage_table, text_slices, texts_of

END = b"\xff"  # never part of UTF-8: ends a text, and stands before it as context
LOG2 = np.log(2.0)
FACTS = "chunk int, bucket int, items binary, counts binary"
BUCKETS = 256  # of n-grams, and as many of words
HEAVY = 1 / 64  # share of all n-grams of all chunks from which a bucket is dealt again,
SPLIT = 16      # into so many
SLICE = 1 << 21         # bytes of text whose n-grams a task holds at once
UNMERGED = 2_000_000  # n-grams that a chunk holds in unmerged parts
LOOKUP = 1 << 18  # keys placed at once in a table
PART = 64      # chunks whose shares of a bucket are merged or answered at once


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of all bytes of the texts and their end: depth context bytes, the nearest in the
    highest place, then the byte itself. With them the number of n-grams of each text."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    joined = b"".join([END * 8, *chain.from_iterable((END * depth, t, END) for t in texts)])
    byte = np.frombuffer(joined, np.uint8)[8:]
    # The eight bytes before each place as one little-endian number: the nearest is its highest.
    before = np.ndarray((len(byte),), "<u8", joined, strides=(1,))
    keep = np.ones(len(byte), bool)
    begin = np.cumsum(lengths + depth) - lengths
    for d in range(1, depth + 1):
        keep[begin - d] = False
    return before[keep] >> np.uint64(64 - 8 * depth) << np.uint64(8) | byte[keep], lengths


class Lookup:
    """Values by key in an open-addressed table; every key asked for has to be there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        # The table holds places in the given arrays, four bytes a slot.
        self.keys, self.values = keys, values
        self.owner = np.full(1 << bits, -1, np.int32)
        for begin in range(0, len(keys), LOOKUP):
            todo = np.arange(begin, min(begin + LOOKUP, len(keys)), dtype=np.int32)
            slot = self._slot(keys[todo])
            while len(todo):
                free = self.owner[slot] < 0
                self.owner[slot[free]] = todo[free]
                left = self.owner[slot] != todo
                todo, slot = todo[left], slot[left] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0)
        slot = self._slot(keys)
        at = self.owner[slot]
        todo = np.flatnonzero(self.keys[at] != keys)
        slot = slot[todo]
        while len(todo):
            slot = slot + 1 & self.mask
            at[todo] = self.owner[slot]
            left = self.keys[at[todo]] != keys[todo]
            todo, slot = todo[left], slot[left]
        return self.values[at]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after moving x >= 0.5 up by eight."""
    y = x + 8
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return ((y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3)
            + 1 / (1260 * y**5) - 1 / (1680 * y**7) - shift)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a block of bits."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def up_one(ids: np.ndarray) -> np.ndarray:
    """Nodes (context << 8 | bit prefix) without the farthest context byte."""
    return ids >> np.uint64(16) << np.uint64(8) | ids & np.uint64(255)


class Level:
    """Nodes (context << 8 | bit prefix) of one depth, in order, with their counts of 0 and 1."""

    def __init__(self, ids: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.ids, at = np.unique(ids, return_inverse=True)
        self.zeros = np.bincount(at, zeros, len(self.ids))
        self.ones = np.bincount(at, ones, len(self.ids))
        self.pe = log_kt(self.zeros, self.ones)
        self.pw = self.pe
        self.stop = np.ones(len(self.ids))
        self.to_parent = None

    def parent(self) -> Level:
        """The level with the farthest context byte dropped; its Pw comes from this level's."""
        ids = up_one(self.ids)
        up = Level(ids, self.zeros, self.ones)
        self.to_parent = np.searchsorted(up.ids, ids)
        up.mix(np.bincount(self.to_parent, self.pw, len(up.ids)))
        return up

    def mix(self, children: np.ndarray) -> None:
        self.pw = np.logaddexp(self.pe, children) - LOG2
        self.stop = np.exp(self.pe - LOG2 - self.pw)

    def predict(self, reached: np.ndarray, left: np.ndarray) -> None:
        """Probability of a 1: ``reached`` from the depths above, ``left`` the weight that is
        still to be dealt. ``one`` is the answer where no deeper context was ever seen."""
        kt = (self.ones + 0.5) / (self.zeros + self.ones + 1.0)
        self.reached = reached + left * self.stop * kt
        self.left = left * (1 - self.stop)
        self.one = self.reached + self.left / 2


def subtree(gram: np.ndarray, n: np.ndarray, depth: int, top: int) -> list[Level]:
    """Levels top..depth of the n-grams that share their ``top`` nearest context bytes."""
    byte = (gram & np.uint64(255)).astype(np.int64)
    context = gram >> np.uint64(8) << np.uint64(8)
    ids, zeros, ones = [], [], []
    for b in range(8):
        bit = byte >> 7 - b & 1
        ids.append(context | (1 << b | byte >> 8 - b).astype(np.uint64))
        zeros.append(n * (1 - bit))
        ones.append(n * bit)
    levels = [Level(np.concatenate(ids), np.concatenate(zeros), np.concatenate(ones))]
    for _ in range(depth - top):
        levels.append(levels[-1].parent())
    return levels[::-1]


def probabilities(levels: list[Level], gram: np.ndarray, depth: int, top: int, shallow: np.ndarray) -> np.ndarray:
    """log10 probability of each n-gram's byte; ``shallow`` has P(1) by (nearest byte << 8 | bit
    prefix) for what no deeper node knows."""
    byte = (gram & np.uint64(255)).astype(np.int64)
    total = np.zeros(len(gram))
    for b in range(8):
        node = (1 << b | byte >> 8 - b).astype(np.uint64)
        one = shallow[((gram >> np.uint64(8 * depth)) << np.uint64(8) | node).astype(np.int64)]
        for level, d in zip(levels, range(top, depth + 1), strict=False):
            if not len(level.ids):
                continue
            ids = gram >> np.uint64(8 * (depth - d + 1)) << np.uint64(8) | node
            at = np.minimum(np.searchsorted(level.ids, ids), len(level.ids) - 1)
            one = np.where(level.ids[at] == ids, level.one[at], one)
        total += np.log10(np.where(byte >> 7 - b & 1, one, 1 - one))
    return total


def ascending(keys: np.ndarray) -> np.ndarray:
    """Ascending distinct keys, by sorting (several times as fast as hashing here)."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def bucket_of(gram: np.ndarray, depth: int) -> np.ndarray:
    near = gram >> np.uint64(8 * (depth - 1))
    return ((near * np.uint64(40503) >> np.uint64(8)) % np.uint64(BUCKETS)).astype(np.int64)


def split_bucket(gram: np.ndarray, bucket: np.ndarray, depth: int, heavy: frozenset[int]) -> np.ndarray:
    """``bucket`` with the n-grams of heavy buckets dealt by their third context byte, as buckets from
    2 * BUCKETS on."""
    if not heavy:
        return bucket
    third = (gram >> np.uint64(8 * (depth - 2)) & np.uint64(255)).astype(np.int64)
    return np.where(np.isin(bucket, list(heavy)), 2 * BUCKETS + bucket * SPLIT + third % SPLIT, bucket)


def of_words(bucket: int) -> bool:
    return BUCKETS <= bucket < 2 * BUCKETS


def pack(values: np.ndarray) -> bytes:
    """Ascending integers as differences, one byte plane after the other (compresses well)."""
    steps = np.diff(values, prepend=values.dtype.type(0)) if len(values) else values
    return steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


class Chunk:
    """Distinct n-grams and words of a chunk's documents with their training counts."""

    def __init__(self, depth: int):
        self.depth = depth
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.words: Counter = Counter()

    def settle(self) -> None:
        """Merge the parts: ``grams`` in order and their ``counts``."""
        if len(self.parts) != 1:
            self.parts = [summed(self.parts or [(np.zeros(0, np.uint64), np.zeros(0, np.int64))])]
        self.grams, self.counts = self.parts[0]

    def add(self, texts: list[bytes], held: np.ndarray) -> None:
        key, lengths = grams(texts, self.depth)
        flag = np.repeat(~held, lengths)
        for part, weight in ((key[flag], 1), (key[~flag], 0)):
            u, c = np.unique(part, return_counts=True)
            self._keep(u, c * weight)
        other: set[bytes] = set()
        for t, h in zip(texts, held, strict=True):
            (other if h else self.words).update(t.split())
        self.words[b""] += int((~held).sum())
        for w in other:
            self.words.setdefault(w, 0)

    def see(self, texts: list[bytes]) -> None:
        """Like ``add`` without counts: which n-grams and words there are."""
        u = ascending(grams(texts, self.depth)[0])
        self._keep(u, None)
        words = {b""}
        for t in texts:
            words.update(t.split())
        dict.update(self.words, dict.fromkeys(words, 0))

    def _keep(self, items: np.ndarray, counts: np.ndarray | None) -> None:
        self.parts.append((items, counts))
        if sum(len(u) for u, _ in self.parts) > UNMERGED + 2 * len(self.parts[0][0]):
            self.settle()

    def buckets(self, heavy: frozenset[int]) -> np.ndarray:
        return split_bucket(self.grams, bucket_of(self.grams, self.depth), self.depth, heavy)

    def packed(self, heavy: frozenset[int] = frozenset()) -> Iterator[tuple[int, bytes, bytes]]:
        """(bucket, items, counts): n-grams in buckets 0.., words in buckets ``BUCKETS``.., what heavy
        buckets were dealt into from 2 * ``BUCKETS`` on."""
        self.settle()
        bucket = self.buckets(heavy)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order])) + 1
        for at in np.split(order, edges) if len(order) else []:
            yield int(bucket[at[0]]), pack(self.grams[at]), b"" if self.counts is None else self.counts[at].astype("<i8").tobytes()
        dealt: dict[int, list[bytes]] = {}
        for w in self.words:
            dealt.setdefault(zlib.crc32(w) % BUCKETS, []).append(w)
        for b, words in dealt.items():
            words.sort()
            yield BUCKETS + b, b" ".join(words), np.array([self.words[w] for w in words], "<i8").tobytes()


def summed(parts: list[tuple[np.ndarray, np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray | None]:
    """The items in order with their added counts; without counts (``Chunk.see``) the items alone."""
    if parts[0][1] is None:
        return ascending(np.concatenate([p for p, _ in parts])), None
    items, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    return items, np.bincount(at, np.concatenate([c for _, c in parts]), len(items)).astype(np.int64)


def counts_of(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<i8")


def facts(docs: DataFrame, depth: int) -> DataFrame:
    """What each chunk holds, packed. ``docs``: chunk, text, held_out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Chunk] = {}  # one: the task's own partition
        for whole in batches:
            for batch in text_slices(whole, SLICE):
                chunk = batch.column("chunk")[0].as_py()
                flags = np.array(batch.column("held_out").to_pylist(), bool)
                held.setdefault(chunk, Chunk(depth)).add([t.lower() for t in texts_of(batch)], flags)
        for chunk, c in held.items():
            for bucket, items, counts in c.packed():
                yield pa.RecordBatch.from_pylist([{"chunk": chunk, "bucket": bucket, "items": items, "counts": counts}],
                                                 pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()),
                                                            ("items", pa.binary()), ("counts", pa.binary())]))
    return docs.select("chunk", "text", "held_out").mapInArrow(run, FACTS)


def heavy_buckets(found: DataFrame, depth: int) -> frozenset[int]:
    """Buckets of n-grams with more than ``HEAVY`` of all; with depth 2 there is no third byte."""
    if depth < 3:
        return frozenset()
    size = found.filter(F.col("bucket") < BUCKETS).groupBy("bucket").agg(F.sum(F.length("items")).alias("n")).collect()
    total = sum(r.n for r in size)  # at most BUCKETS rows
    return frozenset(r.bucket for r in size if r.n > HEAVY * total)


def dealt_again(found: DataFrame, depth: int, heavy: frozenset[int]) -> DataFrame:
    """``found`` with the rows of heavy buckets dealt by the third context byte."""
    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for chunk, bucket, items, counts in zip(f["chunk"], f["bucket"], f["items"], f["counts"], strict=True):
                gram, n = unpack(items), counts_of(counts)
                to = split_bucket(gram, np.full(len(gram), bucket), depth, heavy)
                parts = [(int(b), np.flatnonzero(to == b)) for b in np.unique(to)]
                yield pd.DataFrame([(chunk, b, pack(gram[at]), n[at].tobytes()) for b, at in parts],
                                   columns=["chunk", "bucket", "items", "counts"])
    if not heavy:
        return found
    chosen = F.col("bucket").isin(sorted(heavy))
    return found.filter(~chosen).unionByName(found.filter(chosen).mapInPandas(deal, FACTS))


def merged(found: DataFrame) -> DataFrame:
    """One row per bucket: (bucket, items, counts), n-grams and words that training has."""
    def add_up(f: pd.DataFrame) -> pd.DataFrame:
        bucket = int(f["bucket"].iloc[0])
        if not of_words(bucket):
            items, counts = summed([(unpack(i), counts_of(c)) for i, c in zip(f["items"], f["counts"], strict=True)])
            items, counts = pack(items[counts > 0]), counts[counts > 0]
        else:
            total: Counter = Counter()
            for i, c in zip(f["items"], f["counts"], strict=True):
                for w, n in zip(i.split(b" "), counts_of(c).tolist(), strict=True):
                    total[w] += n
            words = sorted(w for w, n in total.items() if n)
            items, counts = b" ".join(words), np.array([total[w] for w in words], np.int64)
        return pd.DataFrame({"chunk": [int(f["chunk"].iloc[0]) // PART], "bucket": [bucket], "items": [items],
                             "counts": [counts.astype("<i8").tobytes()]}) if len(counts) else pd.DataFrame(
            {"chunk": [], "bucket": [], "items": [], "counts": []})

    chunks = found.agg(F.max("chunk")).first()[0] or 0
    while True:
        found = found.groupBy("bucket", F.floor(F.col("chunk") / PART).alias("part")).applyInPandas(add_up, FACTS)
        chunks //= PART
        if not chunks:
            return stage_table(found.select("bucket", "items", "counts"), "merged")


def ctw_scores(docs: DataFrame, held_out: Callable[[Column], Column], depth: int = 5,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all documents under a model of those that ``held_out(id)`` is false for.

    Texts are lower-cased (A-Z). Columns: doc_id, held_out, n_tokens (words and one end),
    n_known (tokens that training has), train_tokens, base_score (add-one unigram, log10),
    score (log10 probability of the text's bytes and its end), n_bytes, bits_per_byte (code
    length over bytes and end).

    Null text is empty (its end is scored). Repeated rows are scored and learnt each. A null
    id or a null ``held_out`` is training. With no training document every bit has probability
    one half. An empty table gives no rows. Other input columns are ignored.

    ``docs`` has to be a table scan: its partitions are the chunks, and they must be the same in
    both passes (answers that do not fit a chunk raise). Give any other frame through
    ``stage_table`` first. ``depth`` is 2 to 6.
    """
    if not 2 <= depth <= 6:
        raise ValueError("depth is 2 to 6")
    d = (documents(docs, id_col, text_col).withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
         .withColumn("chunk", F.spark_partition_id()))
    found = stage_table(facts(d, depth), "facts")
    heavy = heavy_buckets(found, depth)
    found = dealt_again(found, depth, heavy)
    model = merged(found)
    words = F.col("bucket").between(BUCKETS, 2 * BUCKETS - 1)

    def sizes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n = [counts_of(c) for c in f["counts"]]
            yield pd.DataFrame({"tokens": [int(c.sum()) for c in n], "words": [len(c) for c in n]})

    known = (model.filter(words).select("counts").mapInPandas(sizes, "tokens bigint, words bigint")
             .agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first())
    total, distinct = int(known[0]), int(known[1])

    def roots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for bucket, items, counts in zip(f["bucket"], f["items"], f["counts"], strict=True):
                top = 2 if bucket < BUCKETS else 3
                level = subtree(unpack(items), counts_of(counts), depth, top)[0]
                yield pd.DataFrame({"top": top, "node": up_one(level.ids).astype(np.int64),
                                    "zeros": level.zeros, "ones": level.ones, "pw": level.pw})

    sums = [F.sum(c).alias(c) for c in ("zeros", "ones", "pw")]
    # At most 256 contexts x 255 bit prefixes, and as many for each heavy bucket.
    met = (model.filter(~words).mapInPandas(roots, "top int, node bigint, zeros double, ones double, pw double")
           .groupBy("top", "node").agg(*sums).orderBy("node").collect())

    def level_above(top: int, more: Level | None = None) -> Level:
        """The nodes at depth ``top`` - 1 from their children's sums; ``more`` are children themselves."""
        rows = [r for r in met if r.top == top]
        ids, zeros, ones, pw = ([np.array([r[c] for r in rows], t)] for c, t in (("node", np.uint64), ("zeros", float), ("ones", float), ("pw", float)))
        if more is not None:
            for kept, own in zip((ids, zeros, ones, pw), (up_one(more.ids), more.zeros, more.ones, more.pw), strict=True):
                kept.append(own)
        ids = np.concatenate(ids)
        level = Level(ids, np.concatenate(zeros), np.concatenate(ones))
        level.mix(np.bincount(np.searchsorted(level.ids, ids), np.concatenate(pw), len(level.ids)))
        return level

    two = level_above(3)  # of heavy buckets only
    one = level_above(2, two)
    zero = one.parent()
    zero.predict(np.zeros(len(zero.ids)), np.ones(len(zero.ids)))
    one.predict(zero.reached[one.to_parent], zero.left[one.to_parent])
    # Dense by (nearest byte << 8 | bit prefix): P(1) where deeper contexts are new, and the
    # probability reached and the weight left for those that are not.
    shallow, reached, left = np.full(65536, 0.5), np.zeros(65536), np.zeros(65536)
    for c in range(256):
        shallow[(c << 8) + zero.ids.astype(np.int64)] = zero.one
    at = one.ids.astype(np.int64)
    shallow[at], reached[at], left[at] = one.one, one.reached, one.left
    up_two = up_one(two.ids).astype(np.int64)
    two.predict(reached[up_two], left[up_two])

    def answer(asked: pd.DataFrame, has: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame({"chunk": [], "bucket": [], "mark": [], "answers": []})
        if not of_words(bucket := asked["bucket"].iloc[0]):
            items = unpack(has["items"].iloc[0]) if len(has) else np.zeros(0, np.uint64)
            top = 2 if bucket < BUCKETS else 3
            levels = subtree(items, counts_of(has["counts"].iloc[0]) if len(has) else np.zeros(0, np.int64), depth, top)
            if top == 2:
                up = up_one(levels[0].ids).astype(np.int64)
                levels[0].predict(reached[up], left[up])
            else:
                up = np.searchsorted(two.ids, up_one(levels[0].ids))
                levels[0].predict(two.reached[up], two.left[up])
            for above, level in zip(levels, levels[1:], strict=False):
                level.predict(above.reached[level.to_parent], above.left[level.to_parent])
            wanted = [unpack(i) for i in asked["items"]]  # chunks mostly ask for the same n-grams
            every = ascending(np.concatenate(wanted))
            logs = probabilities(levels if top == 2 else [two, *levels], every, depth, 2, shallow)
            out = [logs[np.searchsorted(every, w)] for w in wanted]
        else:
            c = dict(zip(has["items"].iloc[0].split(b" "), counts_of(has["counts"].iloc[0]).tolist(), strict=True)) if len(has) else {}
            out = [np.array([c.get(w, 0) for w in i.split(b" ")], float) for i in asked["items"]]
        return pd.DataFrame({"chunk": asked["chunk"].to_numpy(), "bucket": asked["bucket"].to_numpy(),
                             "mark": [zlib.crc32(i) for i in asked["items"]], "answers": [x.astype("<f8").tobytes() for x in out]})

    part = F.floor(F.col("chunk") / PART).cast("int")
    parts = found.agg(F.max(part)).first()[0] or 0
    dealt = model.withColumn("part", F.explode(F.sequence(F.lit(0).cast("int"), F.lit(parts).cast("int"))))
    answers = (found.withColumn("part", part).groupBy("bucket", "part").cogroup(dealt.groupBy("bucket", "part"))
               .applyInPandas(answer, "chunk int, bucket int, mark bigint, answers binary"))
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64()]

    def finish(texts: pa.Table, answered: pa.Table) -> pa.Table:
        slices = [part for batch in texts.to_batches() for part in text_slices(batch, SLICE)]
        own = Chunk(depth)
        for part in slices:
            own.see([t.lower() for t in texts_of(part)])
        own.settle()
        got = {b: (m, a) for b, m, a in zip(*(answered.column(c).to_pylist() for c in ("bucket", "mark", "answers")), strict=True)}
        logs, worth, seen, unit = np.zeros(len(own.grams)), {}, set(), np.log10(total + distinct + 1.0)
        bucket = own.buckets(heavy)
        for b, items, _ in own.packed(heavy):
            mark, blob = got.get(b, (None, b""))
            if mark != zlib.crc32(items):
                raise RuntimeError("the input's partitions changed between the passes: stage the table first")
            value = np.frombuffer(blob, "<f8")
            if not of_words(b):
                logs[bucket == b] = value
            else:
                words = items.split(b" ")
                worth.update(zip(words, (np.log10(value + 1.0) - unit).tolist(), strict=True))
                seen.update(w for w, c in zip(words, value, strict=True) if c)
        find, out = Lookup(own.grams, logs), []
        for part in slices:
            lowered = [t.lower() for t in texts_of(part)]
            key, lengths = grams(lowered, depth)
            scores = np.add.reduceat(find(key), np.cumsum(lengths) - lengths).tolist()
            for doc_id, held, text, score in zip(part.column("doc_id").to_pylist(), part.column("held_out").to_pylist(), lowered, scores, strict=True):
                tokens = text.split()
                tokens.append(b"")
                n_known = sum([w in seen for w in tokens]) if held else len(tokens)
                out.append((doc_id, held, len(tokens), n_known, total, float(sum([worth[w] for w in tokens])), score,
                            len(text), -score / np.log10(2) / (len(text) + 1)))
        cols = list(zip(*out, strict=True)) or [[]] * len(columns)
        return pa.table({n: pa.array(c, t) for n, c, t in zip(columns, cols, types, strict=True)})

    return d.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        finish, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                "base_score double, score double, n_bytes bigint, bits_per_byte double")


def one_in_seven(doc_id: Column) -> Column:
    """crc32 of the id as text leaves remainder 2 by 7 (a null id: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2
