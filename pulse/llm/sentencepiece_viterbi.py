"""SentencePiece encoding and decoding with a batched numpy Viterbi.

Texts are cut into units no piece reaches across (white-space runs with the word behind them).
New units of a batch are encoded together: units of equal length (long ones: of one length
class) form a matrix of code points, and all rows advance one character at a time. For every
possible piece length the hash of the substring (from prefix hashes) is looked up in the sorted
hashes of all pieces, and a vectorised maximum keeps the best predecessor as backpointer.

* Unigram models: the score of a path is the sum of its pieces' scores.
* Merge (BPE) models: their ids are not those of the best sum, so a path scores minus infinity
  unless every two neighbouring pieces are ones that merging would leave apart. Merging gives
  every prefix of a word exactly one such path, so the maximum finds it. Two pieces stay apart
  if, undoing their merges from the latest on, no merge across the border would have come first.

A unit of more than ``LONG`` characters has no row mates worth waiting for: the probes of all its
substrings are made in blocks of places, and one scan over what they found keeps the backpointers,
so its work grows with its length (a word of a million characters takes seconds).

Ids of units are kept for the next texts of the task in a dictionary of bounded size; those of
long units only for their own texts.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, name, text_slices

SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
CACHE = 800_000   # units whose ids a task keeps
ROWS = 20_000     # units that advance together
LONG = 256        # characters from which on a unit is searched alone
BLOCK = 65_536    # places of such a unit whose substrings are probed at once
PAIRS = 500_000   # pairs of pieces whose border a task remembers
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = message[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, message[at:at + size]
        at += size


class Model:
    """Pieces of a SentencePiece model file and what the batched search needs of them."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            top = list(_fields(f.read()))
        pieces = [dict(_fields(v)) for k, v in top if k == 1]
        trainer = dict(_fields(next((v for k, v in top if k == 2), b"")))
        normal = dict(_fields(next((v for k, v in top if k == 3), b"")))
        if normal.get(2):
            raise ValueError("models with a character map are not supported: normalise first")
        self.text = [p[1].decode() for p in pieces]
        self.score = np.array([struct.unpack("<f", p.get(2, bytes(4)))[0] for p in pieces])
        self.kind = np.array([p.get(3, NORMAL) for p in pieces])
        self.merges = trainer.get(3, 1) == 2
        if trainer.get(3, 1) not in (1, 2) or (self.kind == USER).any():
            raise ValueError("only unigram and BPE models without user-defined symbols are supported")
        self.dummy_prefix = bool(normal.get(3, 1))
        self.squeeze = bool(normal.get(4, 1))
        self.unknown = int(np.flatnonzero(self.kind == UNKNOWN)[0])
        self.bytes = {int(t[3:5], 16): i for i, t in enumerate(self.text) if self.kind[i] == BYTE}
        usable = np.flatnonzero(self.kind == NORMAL)
        self.longest = max(len(self.text[i]) for i in usable)
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest + 1, BASE)]), dtype=np.uint64)
        self.length = np.array([len(t) for t in self.text])
        self.hash = np.array([self._hash(t) for t in self.text], np.uint64)
        order = usable[np.argsort(self.hash[usable], kind="stable")]
        self.keys, self.ids = self.hash[order], order
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces share a hash")
        joined = [t for t in (self.text[i] for i in usable) if len(t) > 1]
        # A unit may end before a space that follows something else, and around a line end.
        self.crosses = any(SPACE in t.lstrip(SPACE) for t in joined)
        self.lines = any("\n" in t for t in joined)
        self.unit = re.compile(".+" if self.crosses else f"{SPACE}*[^{SPACE}]+|{SPACE}+" if self.lines
                               else f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n", re.DOTALL)
        self.cache: dict[str, bytes] = {}
        self.borders: dict[tuple[int, int], bool] = {}
        self.surface = [bytes([int(t[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else
                        " ⁇ ".encode() if k == UNKNOWN else t.replace(SPACE, " ").encode()
                        for t, k in zip(self.text, self.kind, strict=True)]
        if self.merges:
            self._order_merges(usable)

    def _hash(self, text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(BASE) + ord(c) + 1) % 2**64
        return h

    def _order_merges(self, usable: np.ndarray) -> None:
        """rank: place of a piece among the merges (-1: a character); first / second: what its
        last merge joins; whole: merging its characters gives the piece."""
        index = {self.text[i]: int(i) for i in usable}
        n = len(self.text)
        self.rank = np.full(n, -1)
        for r, i in enumerate(sorted((i for i in usable if self.length[i] > 1), key=lambda i: (-self.score[i], i))):
            self.rank[i] = r
        self.first, self.second = np.full(n, -1), np.full(n, -1)
        self.whole = np.zeros(n, bool)
        self.runs = {len(t): i for t, i in index.items() if len(t) > 1 and not t.strip(SPACE)}
        # Pieces of spaces only, merged last and from the left, are taken apart from words.
        if self.runs and (len({float(self.score[i]) for i in self.runs.values()}) > 1
                          or any(self.score[i] <= self.score[next(iter(self.runs.values()))] and self.length[i] > 1
                                 for t, i in index.items() if t.strip(SPACE))
                          or self._run(max(self.runs)) != [max(self.runs)]):
            raise ValueError("space pieces are expected to be merged last, at one score")
        for text, i in index.items():
            parts = [index.get(c, -1) for c in text]
            if -1 in parts:
                raise ValueError("a piece holds a character that is no piece")
            while len(parts) > 1:
                found = [(self.score[m], -k, m) for k in range(len(parts) - 1)
                         if (m := index.get(self.text[parts[k]] + self.text[parts[k + 1]], -1)) >= 0]
                if not found:
                    break
                _, k, m = max(found)
                if len(parts) == 2:
                    self.first[i], self.second[i] = parts
                parts[-k:2 - k] = [m]
            self.whole[i] = parts == [i] and (self.length[i] == 1 or not text.strip(SPACE)
                                              or max(self.rank[self.first[i]], self.rank[self.second[i]]) < self.rank[i])

        self.index = index
        self.merge = list(zip(self.rank.tolist(), self.first.tolist(), self.second.tolist(), strict=True))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece with the hash, or -1."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.ids[at], -1)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merging leaves pieces a and b side by side (-1: a word's begin or an unknown
        character, which never merges)."""
        out = np.ones(len(a), bool)
        at = np.flatnonzero((a >= 0) & (b >= 0))
        if not len(at):
            return out
        pairs, back = np.unique(a[at].astype(np.int64) << 32 | b[at], return_inverse=True)
        a, b = pairs >> 32, pairs & 0xFFFFFFFF
        good = np.ones(len(pairs), bool)
        limit = np.full(len(pairs), np.iinfo(np.int64).max)
        live = np.arange(len(pairs))
        while len(live):
            x, y = a[live], b[live]
            size = self.length[y]
            joined = self.find(self.hash[x] * self.powers[np.minimum(size, self.longest)] + self.hash[y])
            across = np.where((joined >= 0) & (self.length[x] + size <= self.longest), self.rank[joined], np.iinfo(np.int64).max)
            good[live[across < limit[live]]] = False
            left = self.rank[x] > self.rank[y]
            limit[live] = np.where(left, self.rank[x], self.rank[y] + 1)
            go = good[live] & (left | (self.rank[y] >= 0))
            a[live] = np.where(left, self.second[x], x)
            b[live] = np.where(left, y, self.first[y])
            live = live[go]
        out[at] = good[back]
        return out

    def apart_one(self, a: int, b: int) -> bool:
        """``apart`` of one pair, remembered."""
        if a < 0 or b < 0:
            return True
        if (known := self.borders.get((a, b))) is not None:
            return known
        x, y, limit, good = a, b, len(self.text), True
        while good:
            joined = self.index.get(self.text[x] + self.text[y])
            good = joined is None or self.merge[joined][0] >= limit
            (rank_x, _, second), (rank_y, first, _) = self.merge[x], self.merge[y]
            if rank_x > rank_y:
                limit, x = rank_x, second
            elif rank_y >= 0:
                limit, y = rank_y + 1, first
            else:
                break
        if len(self.borders) >= PAIRS:
            self.borders.clear()
        self.borders[a, b] = good
        return good

    def search_long(self, unit: str) -> bytes:
        """``search`` for one long unit: the same paths, the same choice among equal sums."""
        code = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        width, worst = len(code), float(self.score[self.keys.size and self.ids].min() - 10)
        cost = self.score.tolist()
        score, piece, step = [-np.inf] * (width + 1), [-1] * (width + 1), [0] * (width + 1)
        score[0] = 0.0
        for begin in range(0, width, BLOCK):
            end = min(width, begin + BLOCK)
            starts, sizes, pieces = [], [], []
            hashes = np.zeros(end - begin, np.uint64)
            for k in range(1, self.longest + 1):
                hashes = hashes[:max(0, width - k + 1 - begin)]  # substrings of k characters from each place
                hashes = hashes * BASE + code[begin + k - 1:begin + k - 1 + len(hashes)] + np.uint64(1)
                found = self.find(hashes)
                at = np.flatnonzero((found >= 0) | (k == 1))
                if self.merges:
                    at = at[(found[at] < 0) | self.whole[found[at]]]
                starts.append(at + begin)
                sizes.append(np.full(len(at), k))
                pieces.append(found[at])
            start = np.concatenate(starts)
            order = np.argsort(start, kind="stable")
            rows = (start, np.concatenate(sizes), np.concatenate(pieces))
            for i, k, p in zip(*(x[order].tolist() for x in rows), strict=True):
                if score[i] == -np.inf or self.merges and not self.apart_one(piece[i], p):
                    continue
                value = score[i] + (0.0 if self.merges else cost[p] if p >= 0 else worst)
                if value >= score[i + k]:  # shorter pieces come later here and win among equals
                    score[i + k], piece[i + k], step[i + k] = value, p, k
        ids, at = [], width
        while at:
            ids.append(piece[at] if piece[at] >= 0 else -1 - int(code[at - 1]))
            at -= step[at]
        flat = np.array(ids[::-1], np.int64)
        return np.array(self._finish(flat) if (flat < 0).any() else flat, "<u4").tobytes()

    def search(self, units: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of some units of about one length."""
        n, width = len(units), max(map(len, units))
        size = np.array([len(u) for u in units])
        code = np.zeros((width, n), np.uint64)
        flat = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(n), size)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        code[col, row] = flat
        prefix = np.zeros((width + 1, n), np.uint64)
        for j in range(width):
            prefix[j + 1] = prefix[j] * BASE + code[j] + np.uint64(1)
        score = np.full((width + 1, n), -np.inf)
        score[0] = 0
        piece = np.full((width + 1, n), -1)
        step = np.zeros((width + 1, n), np.int64)
        worst = self.score[self.keys.size and self.ids].min() - 10
        for j in range(1, width + 1):
            for k in range(1, min(j, self.longest) + 1):
                found = self.find(prefix[j] - prefix[j - k] * self.powers[k])
                at = np.flatnonzero((found >= 0) & (score[j - k] > -np.inf) & (size >= j))
                if self.merges:
                    at = at[self.whole[found[at]]]
                    at = at[self.apart(piece[j - k, at], found[at])]
                value = score[j - k, at] + (0 if self.merges else self.score[found[at]])
                better = value > score[j, at]
                at = at[better]
                score[j, at], piece[j, at], step[j, at] = value[better], found[at], k
                if k == 1:
                    lone = np.flatnonzero((found < 0) & (size >= j))
                    value = score[j - 1, lone] + (0 if self.merges else worst)
                    score[j, lone], piece[j, lone], step[j, lone] = value, -1, 1
        out = np.zeros((width + 1, n), np.int64)
        used = np.zeros((width + 1, n), bool)
        at, rows = size.copy(), np.arange(n)
        while len(rows):
            p = piece[at[rows], rows]
            out[at[rows], rows] = np.where(p >= 0, p, -1 - code[at[rows] - 1, rows].astype(np.int64))
            used[at[rows], rows] = True
            at[rows] -= step[at[rows], rows]
            rows = rows[at[rows] > 0]
        flat, ends = out.T[used.T], np.cumsum(used.sum(0))
        blob = flat.astype("<u4").tobytes()
        cuts = (ends * 4).tolist()
        ids = [blob[i:j] for i, j in zip([0, *cuts], cuts, strict=False)]
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(flat < 0), "right")):
            ids[k] = np.array(self._finish(flat[ends[k - 1] if k else 0:ends[k]]), "<u4").tobytes()
        return ids

    def _run(self, n: int) -> list[int]:
        """Lengths of the pieces of n spaces: equal scores merge from the left."""
        parts = [1] * n
        while (k := next((k for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in self.runs), -1)) >= 0:
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _spaces(self, n: int) -> list[int]:
        """Ids of a run of spaces under merging: the longest piece forms first, on the left."""
        most = max(self.runs, default=1)
        single = int(self.find(np.array([self._hash(SPACE)], np.uint64))[0])
        return [self.runs.get(k, single) for k in [most] * (n // most) + self._run(n % most)]

    def _finish(self, ids: np.ndarray) -> list[int]:
        """Unknown characters (-1 - code point) as bytes, or one unknown id for a run of them."""
        out: list[int] = []
        for x in ids.tolist():
            if x >= 0:
                out.append(x)
            elif self.bytes:
                out += [self.bytes[b] for b in chr(-1 - x).encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def learn(self, units: list[str]) -> None:
        """Put the ids of new units into the cache."""
        if not self.merges:
            self.cache.update(self._all(units))
            return
        # Spaces before a word's own are merged last: they are taken off and put back as ids.
        plain = [u for u in units if u[0] != SPACE or len(u) > 1 and u[1] != SPACE]
        spaced = [u for u in units if u[0] == SPACE and (len(u) == 1 or u[1] == SPACE)]
        words = [w and SPACE + w for w in (u.lstrip(SPACE) for u in spaced)]
        self.cache.update(self._all(plain))
        found = self._all([w for w in set(words) if w])
        single = np.array(self._spaces(1), "<u4").tobytes()
        for u, w in zip(spaced, words, strict=True):
            run, ids = len(u) - len(w) if w else len(u), found.get(w, b"")
            if ids[:4] == single:
                run, ids = run + 1, ids[4:]
            self.cache[u] = np.array(self._spaces(run), "<u4").tobytes() + ids

    def _all(self, units: list[str]) -> dict[str, bytes]:
        """Ids of units by classes of length."""
        units, found, i = sorted(units, key=len), {}, 0
        while i < len(units):
            size = len(units[i])
            if size > LONG:
                found[units[i]] = self.search_long(units[i])
                i += 1
                continue
            most = size if size <= 24 else min(size + size // 4, LONG)
            j = i + 1
            rows = max(1, min(ROWS, 2_000_000 // (most + 1)))
            while j < len(units) and j - i < rows and len(units[j]) <= most:
                j += 1
            found.update(zip(units[i:j], self.search(units[i:j]), strict=True))
            i = j
        return found

    def normalised(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        return (SPACE if self.dummy_prefix and text else "") + text.replace(" ", SPACE)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        units = [self.unit.findall(self.normalised(t)) for t in texts]
        new = {u for us in units for u in us if u not in self.cache}
        if new:
            if len(self.cache) + len(new) > CACHE:
                self.cache.clear()
                new = {u for us in units for u in us}
            self.learn(list(new))
        cache = self.cache
        ids = [b"".join([cache[u] for u in us]) for us in units]
        for u in new:
            if len(u) > LONG:
                del cache[u]
        return ids

    def decode(self, ids: np.ndarray) -> str:
        surface = self.surface
        text = b"".join([surface[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row; ``model_file`` is a file that every executor has.

    The ids are those of the sentencepiece library. Null text is empty and has no ids. Rows are
    encoded each, null ids and repeats included; an empty table gives no rows. Other input
    columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_file)
        for whole in batches:
            for batch in text_slices(whole):
                ids = [np.frombuffer(x, "<i4") for x in m.encode(batch.column("text").to_pylist())]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = np.concatenate([*ids, np.zeros(0, np.int32)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "ids"])
    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from ids; null ids and control ids give nothing, bytes that are no UTF-8
    the replacement character. Ids outside the vocabulary raise."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_file)
        for b in batches:
            texts = [m.decode(np.array(x or [], np.int64)) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])
    rows = encoded.select(name(id_col).cast("long").alias("doc_id"), F.filter(name(ids_col), lambda x: x.isNotNull()).alias("ids"))
    return rows.mapInArrow(run, "doc_id bigint, text string")


def digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids) and whether decoding the ids
    gives the text back (U+2581 in a text comes back as a space)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_file)
        for whole in batches:
            for batch in text_slices(whole):
                texts = batch.column("text").to_pylist()
                ids = m.encode(texts)
                back = [m.decode(np.frombuffer(x, "<u4")) == t for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()),
                     pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(back, pa.bool_())],
                    ["doc_id", "n_ids", "ids_crc32", "round_trip"])
    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_ids bigint, ids_crc32 bigint, round_trip boolean")
