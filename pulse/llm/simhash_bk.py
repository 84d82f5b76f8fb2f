"""SimHash near-duplicates with BK-trees.

1. Fingerprints: one pass over the whole texts, 64 bits a document.
2. Links: two fingerprints that differ in at most r bits agree on at least one of r + 1 blocks
   of their bits, so distinct fingerprints are dealt into shards by (block, its value) and every
   shard gets a BK-tree of its own: children keyed by their integer Hamming distance to the
   parent, a search follows only the edges within r of its own distance. A shard with more than
   ``SHARD`` fingerprints is dealt again: what its members do not share yet is cut into r + 1
   blocks once more (the same argument holds for the rest of the bits). Each step fixes a third
   of the open bits, so a shard ends up bounded by the fingerprints its open bits can form, and
   nothing is dropped. Trees travel in the shuffle, not by broadcast: their number grows with
   the input.
3. A shard returns a spanning forest of its links; components come from ``components()``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, name, one_per_key, stage_table, text_slices, texts_of, unused
from .components import components

SHARD = 256
BLOCK = 1 << 16  # shingles whose bits are counted at once


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a text as a signed 64-bit integer (see ``fingerprints``)."""
    words = text.lower().split()  # bytes: A-Z only, and exactly the six ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [digest(joined, seed)]
    else:
        starts = [0, *(np.cumsum([len(w) + 1 for w in words])).tolist()]
        hashes = [digest(joined[i:j - 1], seed) for i, j in zip(starts, starts[shingle:], strict=False)]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        block = np.array(hashes[i:i + BLOCK], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp bigint) of every row.

    A-Z is lower-cased, words are runs without ASCII white space, shingles are ``shingle``
    words joined by a space, repeats included; a text with fewer words is one shingle, one
    without words has fingerprint zero. A bit is set when it is set in over half the hashes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                fps = pa.array([fingerprint(t, shingle, seed) for t in texts_of(batch)], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fps], ["doc_id", "fp"])
    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, fp bigint")


class BKTree:
    """Integers under Hamming distance; ``within`` yields the stored values inside a radius."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        new = len(self.values)
        node = 0
        while new:
            d = (self.values[node] ^ value).bit_count()
            if d == 0:
                return
            if (down := self.children[node].get(d)) is None:
                self.children[node][d] = new
                break
            node = down
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> Iterator[int]:
        stack = [0] if self.values else []
        while stack:
            node = stack.pop()
            d = (self.values[node] ^ value).bit_count()
            if d <= radius:
                yield self.values[node]
            stack += [c for e, c in self.children[node].items() if d - radius <= e <= d + radius]


def spanning_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links (earlier, later) that connect everything within ``radius`` in one shard."""
    tree, parent, links = BKTree(), {}, []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    unsigned = [v & (2**64 - 1) for v in values]
    for v in unsigned:
        parent[v] = v
        for near in tree.within(v, radius):
            if (r := root(near)) != root(v):
                parent[r] = root(v)
                links.append((near, v))
        tree.add(v)
    signed = dict(zip(unsigned, values, strict=True))
    return [(signed[x], signed[y]) for x, y in links]


def sub_masks(fixed: int, radius: int) -> list[int]:
    """``fixed`` (bits already shared) with each of radius + 1 blocks of the other bits added;
    with no more than ``radius`` open bits everything links, and there is nothing to cut."""
    open_bits = [i for i in range(64) if not fixed >> i & 1]
    if len(open_bits) <= radius:
        return [fixed]
    return [fixed | sum(1 << int(i) for i in part) for part in np.array_split(open_bits, radius + 1)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def shards(fps: DataFrame, radius: int, most: int = SHARD) -> DataFrame:
    """Distinct ``fp`` dealt into shards: (mask, key, fps array). Any two fingerprints within
    ``radius`` meet in at least one shard; no shard holds more than ``most`` or, once the open
    bits are few, more than those bits can form."""
    def deal(rows: DataFrame, masks) -> DataFrame:
        out = rows.select("fp", F.explode(masks).alias("mask"))
        return out.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))

    level = sub_masks(0, radius)
    rows = deal(fps, F.array(*[F.lit(_signed(m)) for m in level]))
    while any(64 - m.bit_count() > max(radius, most.bit_length() - 1) for m in level):
        large = stage_table(rows.groupBy("mask", "key").count().filter(F.col("count") > most)
                            .withColumnRenamed("count", "n"), "large-shards")
        if large.isEmpty():
            break
        finer = {m: sub_masks(m, radius) for m in level}
        level = sorted({x for xs in finer.values() for x in xs})
        into = F.create_map(*[c for m, xs in finer.items() for c in
                              (F.lit(_signed(m)), F.array(*[F.lit(_signed(x)) for x in xs]))])
        marked = rows.join(large, ["mask", "key"], "left")
        rows = deal(marked, F.when(F.col("n").isNull(), F.array("mask")).otherwise(into[F.col("mask")]))
    return rows.groupBy("mask", "key").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                shingle: int = 3, radius: int = 2, seed: int = 42, shard: int = SHARD) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link when they differ in at most ``radius`` bits; component_id is the smallest
    doc_id reachable over links, the document's own included. Null text is empty; texts without
    words have fingerprint zero and link like any other. Repeated rows stay repeated. A null id
    belongs to its component but never names it unless all its ids are null. An empty table
    gives no rows. Other input columns are ignored.
    """
    seen = stage_table(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    rooted = rooted_fingerprints(seen, F.min("doc_id"), radius, shard)
    smallest = stage_table(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    classes = stage_table(rooted.join(smallest, "root").select("fp", "component_id"), "classes")
    return seen.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def rooted_fingerprints(seen: DataFrame, first: Column, radius: int = 2, shard: int = SHARD) -> DataFrame:
    """(fp, first, root): every distinct ``fp`` of ``seen`` with the aggregate ``first`` of its rows
    and the root fingerprint that names its component."""
    distinct = stage_table(seen.groupBy("fp").agg(first.alias("first")), "distinct-fingerprints")

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            pairs = [p for fps in f["fps"] for p in spanning_links(sorted(int(x) for x in fps), radius)]
            yield pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")

    links = shards(distinct.select("fp"), radius, shard).select("fps").mapInPandas(link, "a bigint, b bigint")
    roots = components(links)
    return stage_table(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                       .select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")


def keep_first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         shingle: int = 3, radius: int = 2, seed: int = 42, shard: int = SHARD) -> DataFrame:
    """One row of ``docs`` per component, all columns kept: the smallest doc_id (null last), of
    texts under one id the one with the smallest md5. Components are told apart by their
    fingerprints, so rows without an id and different texts under one id stay unless they are near
    copies of a kept row; of rows that repeat id and text the one whose other columns come first as
    JSON stays (a null text before an empty one). An empty table gives no rows; columns of any
    name stay as they are."""
    hashed = documents(docs, id_col, text_col).withColumn("hash", F.md5("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                fps = pa.array([fingerprint(t, shingle, seed) for t in texts_of(batch)], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), fps], ["doc_id", "hash", "fp"])

    def key(sha, doc_id):  # one text key for both sides, so that the join's shuffle is the only one
        return F.concat_ws(":", sha, doc_id.cast("string"))

    seen = stage_table(hashed.mapInArrow(run, "doc_id bigint, hash string, fp bigint"), "fingerprints")
    key_col = unused(docs, "keep_key")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash")
    keep = (rooted_fingerprints(seen, F.min(order), radius, shard).groupBy("root").agg(F.min("first").alias("first"))
            .select(key(F.col("first.hash"), F.col("first.doc_id")).alias(key_col)))
    text_hash = F.md5(F.coalesce(name(text_col), F.lit("")))
    kept = docs.withColumn(key_col, key(text_hash, name(id_col).cast("long"))).join(keep, key_col, "left_semi")
    return one_per_key(kept.select(*[name(c) for c in docs.columns], key_col), key_col, text_col)
