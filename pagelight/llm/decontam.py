"""Benchmark decontamination: SimHash of item-sized windows, looked up in multi-index Hamming blocks,
verified by exact weighted-shingle similarity.

Words are runs of letters and digits, lower-cased. An item of n words is compared with all windows of
n words. A window's 64-bit SimHash over its five-word shingles comes from running bit counts. The
index holds items by four 16-bit blocks: of a fingerprint within ``RADIUS`` of an item, at least one
block is within RADIUS // 4 of the item's. A block has at most 65,536 values, so a look-up compares a block
value with all that the index holds, and keeps the answer; it finds every item within the radius. Candidates are verified by weighted Jaccard (multiset) similarity of shingles.

A window with similarity s has 2s / (1 + s) of its shingles in common with its item, so windows
with fewer shingles known to the benchmark's items of their length are not fingerprinted; this loses nothing.

A text shorter than an item is one window, the whole text.

The items are broadcast; a benchmark of more than ``PART_CHARS`` is dealt into parts by a hash, and each part's index sees all texts. Items and
texts that are null or have no words match nothing; items under five words are one shingle of
their own length; of windows of equal similarity the first is given; repeated rows each get their result (repeated items one); an empty table gives an
empty result; other columns are ignored, and where the id is called item_id the item's column gets another name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelight.llm.common import filtered, materialize, quoted, text_batches, unused

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 19
#: Characters of items that are indexed at a time.
PART_CHARS = 16_000_000
_WORD = re.compile(r"[^\W_]+")
_CHUNK = 1 << 15
#: Item positions kept of block values looked up before, 8 bytes each.
KNOWN = 4_000_000


def word_hashes(text: str) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    known: dict[str, int] = {}
    words = _WORD.findall(text.lower())
    for w in set(words):
        known[w] = h(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A mixed 64-bit hash of every run of size words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _pack(ones: np.ndarray, n: int) -> np.ndarray:
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view(np.uint64)[:, 0]


class Index:
    """The benchmark: item ids, shingles, fingerprints and their blocks."""

    def __init__(self, items: list[tuple], size: int, similarity: float, radius: int) -> None:
        self.size, self.similarity, self.radius = size, similarity, radius
        self.ids, self.lengths, self.shingles, prints = [], [], [], []
        for item_id, text in items:
            words = word_hashes(text or "")
            if item_id is None or not len(words):
                continue
            s = shingle_hashes(words, min(size, len(words)))
            self.ids.append(item_id)
            self.lengths.append(len(words))
            self.shingles.append(Counter(s.tolist()))
            prints.append(_pack(_bits(s).sum(axis=0, dtype=np.int64)[None, :], len(s))[0])
        self.prints = np.array(prints, np.uint64)
        self.by_size = {k: np.unique(np.array([x for c, n in zip(self.shingles, self.lengths) if min(n, size) == k for x in c], np.uint64)) for k in {min(n, size) for n in self.lengths}}
        self.of_length = {n: set(i for i, m in enumerate(self.lengths) if m == n) for n in set(self.lengths)}
        self.of_length_known = {n: np.unique(np.array([x for i in at for x in self.shingles[i]], np.uint64)) for n, at in self.of_length.items()}
        self.blocks, self.known, self.held = [], {}, 0
        for b in range(4):
            values = ((self.prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.uint16)
            order = np.argsort(values, kind="stable")
            keys, starts = np.unique(values[order], return_index=True)
            self.blocks.append((order, keys, np.append(starts, len(order))))

    def within(self, fp: np.uint64) -> np.ndarray:
        """Positions of the items within the radius of fp."""
        found = []
        for b, (order, keys, starts) in enumerate(self.blocks):
            value = (int(fp) >> (16 * b)) & 0xFFFF
            near = self.known.get((b, value))
            if near is None:
                at = np.nonzero(np.bitwise_count(keys ^ np.uint16(value)) <= self.radius // 4)[0]
                near = np.concatenate([order[starts[i] : starts[i + 1]] for i in at.tolist()]) if len(at) else order[:0]
                if self.held + len(near) > KNOWN:
                    self.known.clear()
                    self.held = 0
                self.known[b, value] = near
                self.held += len(near) + 16
            if len(near):
                found.append(near[np.bitwise_count(self.prints[near] ^ fp) <= self.radius])
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)

    def matches(self, text: str) -> dict:
        """{item position: (similarity, first word of the best window)}."""
        best: dict[int, tuple[float, int]] = {}
        words = word_hashes(text)
        for size, known in self.by_size.items():
            s = shingle_hashes(words, size)
            if not len(s):
                continue
            hit = known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s
            if not hit.any():
                continue
            places = np.nonzero(hit)[0]
            for length in [n for n in self.of_length if min(n, self.size) == size and n > len(words)]:
                if len(s) >= self.similarity * (length - size + 1) - 1e-9:
                    self._whole(s, length, size, best)
            for length in [n for n in self.of_length if min(n, self.size) == size and n <= len(words)]:
                n = length - size + 1
                own = self.of_length_known[length]
                hit = np.zeros(len(s), bool)
                hit[places] = own[np.minimum(np.searchsorted(own, s[places]), len(own) - 1)] == s[places]
                hits = np.concatenate(([0], np.cumsum(hit)))
                need = int(np.ceil(n * 2 * self.similarity / (1 + self.similarity) - 1e-9))
                starts = np.nonzero(hits[n:] - hits[:-n] >= need)[0]
                for at in range(0, len(starts), _CHUNK):
                    self._windows(s, starts[at : at + _CHUNK], n, self.of_length[length], best)
        return best

    def _whole(self, s, length, size, best) -> None:
        """A text that is shorter than the items of a length, as one window."""
        own, n = self.of_length_known[length], length - size + 1
        if (own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s).sum() < self.similarity / (1 + self.similarity) * (len(s) + n) - 1e-9:
            return
        text = Counter(s.tolist())
        for x in self.within(_pack(_bits(s).sum(axis=0, dtype=np.int64)[None, :], len(s))[0]).tolist():
            if x in self.of_length[length]:
                common = (text & self.shingles[x]).total()
                sim = common / (len(s) + n - common)
                if sim >= self.similarity - 1e-12 and (x not in best or sim > best[x][0]):
                    best[x] = (sim, 0)

    def _windows(self, s, starts, n, wanted, best) -> None:
        # runs of neighbouring windows share their running bit counts
        for run in np.split(starts, np.nonzero(np.diff(starts) > n)[0] + 1):
            for k in range(0, len(run), 4096):
                part = run[k : k + 4096]
                first = int(part[0])
                sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(_bits(s[first : int(part[-1]) + n]), axis=0, dtype=np.int32)))
                fps, which = np.unique(_pack(sums[part - first + n] - sums[part - first], n), return_inverse=True)
                for i, fp in enumerate(fps):
                    items = [x for x in self.within(fp).tolist() if x in wanted]
                    for start in part[which == i].tolist() if items else ():
                        window = Counter(s[start : start + n].tolist())
                        for x in items:
                            common = (window & self.shingles[x]).total()
                            sim = common / (2 * n - common)
                            if sim >= self.similarity - 1e-12 and (x not in best or (-sim, start) < (-best[x][0], best[x][1])):
                                best[x] = (sim, start)


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, part_chars: int = PART_CHARS) -> Iterator[Index]:
    """The benchmark's index, or its parts one after the other."""
    items = benchmark.select(F.col(quoted(id_col)).alias("item"), F.col(quoted(text_col)).cast("string").alias("t"))
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = -(-chars // part_chars) or 1
    for p in range(parts):
        own = items.where(F.pmod(F.xxhash64("item", "t"), F.lit(parts)) == p)
        yield Index([tuple(r) for r in own.distinct().orderBy("item", "t").collect()], size, similarity, radius)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id_col, item_id, similarity, window_start): the best window of each document and item that reach the similarity."""
    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    whole = benchmark.schema[options.get("id_col", "item_id")].dataType.simpleString() != "string"
    names = [id_col, *unused([id_col], "item_id", "similarity", "window_start")]
    rows = docs.select(F.col(quoted(id_col)), F.col(quoted(text_col)).cast("string").alias("_t" if id_col != "_t" else "_text"))

    def found(index: Index) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches):
            index = shared.value
            for b in batches:
                ids, items, sims, starts = [], [], [], []
                for i, t in enumerate(b.column(1)):
                    for x, (sim, start) in sorted(index.matches(t.as_py() or "").items()):
                        ids.append(i)
                        items.append(index.ids[x])
                        sims.append(sim)
                        starts.append(start)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(items, pa.int64() if whole else pa.string()), pa.array(sims, pa.float64()), pa.array(starts, pa.int64())], names)

        types = [kind, "long" if whole else "string", "double", "long"]
        return rows.mapInArrow(run, ", ".join(f"{quoted(n)} {k}" for n, k in zip(names, types)))

    return reduce(DataFrame.unionByName, map(found, indexes(benchmark, **options)))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs in which no item is found, all columns as they are. Of a benchmark in several parts, what one part leaves is written before
    the next one is asked, so that a worker holds one part."""
    text_batches(docs.sparkSession)
    at, left = docs.columns.index(text_col), None

    def without(docs: DataFrame, index: Index) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches):
            index = shared.value
            for b in batches:
                yield b.filter(pa.array([not index.matches(t.as_py() or "") for t in b.column(at)], pa.bool_()))

        return filtered(docs, run)

    for index in indexes(benchmark, **options):
        left = without(docs if left is None else materialize(left, "leaks"), index)
    return left
