"""Ranked lexical search over deduplicated bags of words.

A document's score for an item depends on the frequencies of the items' terms in it and on its
length norm m alone. So documents are restricted to the items' vocabulary, and those with the same
frequency vector and the same m form a class: found by hash, verified by comparing the vectors as
grouping and join keys. A class is scored once for all items. Only an item's best classes (by
score, then smallest document id) can hold its best documents; these are expanded by ascending id.

Items are taken in blocks with a bounded number of (term, item) entries, the only thing that is
sent to every task; each block reads all documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, name, stage_table, text_slices, texts_of

ENTRIES = 1 << 20    # (term, item) entries of a block of items; a single larger item is a block
CELLS = 1 << 18      # scores, and additions to them, that a task holds at once
SALTS = 16           # tasks that look for the members of a class
BAGS = 1 << 21       # bytes of packed bags that a task unpacks at once

# UTF-8 bytes: A-Z to a-z; ASCII other than letters and digits to a space, all else stays.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
LAST = np.iinfo(np.int64).max


def terms(raw: bytes) -> list[bytes]:
    return raw.translate(TERMS).split()


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(set(terms(raw))) for raw in texts_of(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(found, pa.list_(pa.binary()))], ["item", "terms"])


def _bags(numbers: dict[bytes, int]):
    """(doc_id, n, bag): all terms counted, and the packed (term number, frequency) pairs of the
    vocabulary, ascending by number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                n, bags = [], []
                for raw in texts_of(part):
                    words = terms(raw)
                    n.append(len(words))
                    held = sorted((numbers[t], k) for t, k in Counter(words).items() if t in numbers)
                    bags.append(np.array(held, "<u4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(bags, pa.binary())],
                                                 ["doc_id", "n", "bag"])
    return run


def unpacked(bags: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term number, frequency) of every entry of packed bags."""
    pairs = np.frombuffer(b"".join(bags), "<u4").reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(bags)), [len(b) // 8 for b in bags]), pairs[:, 0], pairs[:, 1]


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, BAGS, "bag"):
            number, df = np.unique(unpacked(part.column("bag").to_pylist())[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(df.astype(np.int64))], ["number", "df"])


class _Best:
    """The k best (score, smallest id) classes of every item among those seen."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.ones(items, np.int64)
        self.held = np.zeros((0, 4), np.int64)          # item, score, first id, class

    def add(self, scores: np.ndarray, first: np.ndarray, classes: np.ndarray):
        row, item = np.nonzero(scores >= self.floor)
        rows = np.vstack([self.held, np.stack([item, scores[row, item], first[row], classes[row]], 1)])
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
        begin = np.searchsorted(rows[:, 0], rows[:, 0])
        rank = np.arange(len(rows)) - begin
        self.held = rows[rank < self.k]
        full = rows[rank == self.k - 1]
        self.floor[full[:, 0]] = full[:, 1]


def _best_classes(weight: np.ndarray, start: np.ndarray, items_of: np.ndarray, items: int, k: int):
    """(item, score, first, class): each task's k best classes an item. ``items_of[start[t]:start[t+1]]``
    are the items that hold term t."""
    degree = np.diff(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(items, k)
        for batch in (part for whole in batches for part in text_slices(whole, BAGS, "bag")):
            classes = batch.column("class").to_numpy(zero_copy_only=False)
            first = batch.column("first").fill_null(LAST).to_numpy(zero_copy_only=False)
            m = batch.column("m").to_numpy(zero_copy_only=False)
            bags = batch.column("bag").to_pylist()
            most = max(1, CELLS // items)
            row, term, tf = unpacked(bags)
            steps = np.bincount(row, weights=degree[term], minlength=len(bags))
            at = 0
            while at < len(bags):
                upto = at + max(1, min(most, int(np.searchsorted(np.cumsum(steps[at:at + most]), CELLS, "right"))))
                a, b = np.searchsorted(row, [at, upto])
                t, d = term[a:b], degree[term[a:b]]
                part = weight[t] * (1_000_000_000 * tf[a:b] // (1000 * tf[a:b] + 20 * m[row[a:b]]))
                item = items_of[np.arange(d.sum()) - np.repeat(np.cumsum(d) - d, d) + np.repeat(start[t], d)]
                scores = np.zeros((min(upto, len(bags)) - at, items), np.int64)
                np.add.at(scores, (np.repeat(row[a:b] - at, d), item), np.repeat(part, d))
                best.add(scores, first[at:upto], classes[at:upto])
                at = upto
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(best.held[:, j])) for j in range(4)], ["item", "score", "first", "class"])
    return run


def _blocks(items: DataFrame) -> list[DataFrame]:
    """Items (item, terms) dealt by hash into blocks of at most ``ENTRIES`` entries; more blocks
    until that holds or every block is one item."""
    total = items.agg(F.sum(F.size("terms"))).first()[0] or 0
    count = -(-total // ENTRIES)
    while count:
        block = F.pmod(F.xxhash64("item"), F.lit(count))
        fits = items.groupBy(block.alias("b")).agg(F.sum(F.size("terms")).alias("n"), F.count("*").alias("k")).filter(
            (F.col("n") > ENTRIES) & (F.col("k") > 1)).isEmpty()
        if fits:
            return [items.filter(block == b) for b in range(count)]
        count *= 2
    return []


def _block_ranks(docs: DataFrame, block: DataFrame, k: int) -> DataFrame | None:
    """(item, doc_id, score) of the k best documents of every item of one block."""
    rows = [(r.item, r.terms) for r in block.collect()]
    rows = [(i, list(map(bytes, t))) for i, t in rows if t]
    if not rows:
        return None
    vocabulary = sorted({t for _, held in rows for t in held})
    numbers = {t: i for i, t in enumerate(vocabulary)}
    entries = sorted((numbers[t], j) for j, (_, held) in enumerate(rows) for t in held)
    start = np.searchsorted([t for t, _ in entries], np.arange(len(vocabulary) + 1))
    items_of = np.array([j for _, j in entries], np.int64)

    bags = stage_table(docs.mapInArrow(_bags(numbers), "doc_id long, n long, bag binary"), "bags")
    size = bags.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
    if not size.terms:
        return None
    held = bags.filter(F.octet_length("bag") > 0)
    norm = F.expr(f"100 - 50 + ((50 * n * {size.docs}L) div {size.terms}L)")
    df = held.select("bag").mapInArrow(_document_frequencies, "number long, df long").groupBy("number").agg(F.sum("df").alias("df"))
    weights = df.select("number", F.floor(1000 * F.log((2 * F.lit(float(size.docs)) + 2) / (2 * F.col("df") + 1))).alias("w"))
    weight = np.zeros(len(vocabulary), np.int64)
    for number, w in weights.collect():
        weight[number] = w

    # Hash first: the vectors themselves, compared as keys, decide.
    keyed = held.select("doc_id", F.col("bag"), norm.alias("m")).withColumn("hash", F.xxhash64("bag", "m"))
    classes = stage_table(keyed.groupBy("hash", "bag", "m").agg(F.min("doc_id").alias("first"))
                          .withColumn("class", F.monotonically_increasing_id()), "classes")
    found = classes.select("class", "first", "m", "bag").mapInArrow(
        _best_classes(weight, start, items_of, len(rows), k), "item long, score long, first long, class long")
    by_item = Window.partitionBy("item").orderBy(F.desc("score"), "first", "class")
    best = stage_table(found.withColumn("rank", F.row_number().over(by_item)).filter(F.col("rank") <= k).select("item", "score", "class"), "best")

    # At most k classes an item: repeated for every salt, so that a class of many copies meets many tasks.
    chosen = (classes.join(best.select("class").distinct(), "class").select("class", "hash", "bag", "m")
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    salted = keyed.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    members = salted.join(chosen, ["hash", "bag", "m", "salt"]).select("class", "doc_id")
    by_class = Window.partitionBy("class").orderBy(F.asc_nulls_last("doc_id"))
    members = members.withColumn("rank", F.row_number().over(by_class)).filter(F.col("rank") <= k).drop("rank")
    keys = docs.sparkSession.createDataFrame([(j, i) for j, (i, _) in enumerate(rows)], "item long, key long")
    return best.join(members, "class").join(keys, "item").select(F.col("key").alias("item"), "doc_id", "score")


def ranked(df: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0.

    Every row of ``items`` is an item of its own (repeated rows give repeated ranks) and every row of
    ``df`` a document of its own (repeated rows rank one after the other). Null texts have no terms
    and find and are found by nothing; a null id is kept and comes after all others of a score; an
    empty table gives an empty result. Ties go to the smaller id. Texts of any length are read
    whole; other columns are not read.
    """
    docs = documents(df, id_col, text_col)
    asked = stage_table(items.select(name(item_col).cast("long").alias("item_id"), F.coalesce(name(item_text), F.lit("")).alias("text"))
                        .withColumn("item", F.monotonically_increasing_id()), "items")
    found = stage_table(asked.select("item", "text").mapInArrow(_item_terms, "item long, terms array<binary>"), "item-terms")
    parts = [r for b in _blocks(found) if (r := _block_ranks(docs, b, k)) is not None]
    if not parts:
        return df.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    rows = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return rows.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
