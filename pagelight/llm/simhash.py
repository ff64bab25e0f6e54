"""SimHash near-duplicates, linked exactly through vantage-point trees.

A document's fingerprint has a bit set where over half of its shingle hashes have it. Fingerprints,
not documents, are linked: exact copies share one, so a group of copies of any size is one point.

1. Fingerprints are computed once and written; distinct ones are counted with map-side combining.
2. The top of a vantage-point tree is built on the driver from a sample of distinct fingerprints, ``EACH`` for
   each leaf, so that it splits evenly however deep it is; ``DEPTH`` bounds both (a million fingerprints, 65,536 leaves), and
   beyond four billion fingerprints leaves grow instead. A node holds a vantage point and a radius; a point goes inside or
   outside by its Hamming distance to the vantage point. The sample shapes the tree, not the result.
3. Every fingerprint goes to its home leaf. By the triangle inequality, a pair within ``radius``
   that a node separates has both distances near the node's radius: the inside one of such a pair
   also visits the outside leaves that its ball reaches. So each pair meets in just one leaf.
4. In a leaf, the same splitting recurs in memory down to small blocks that are compared directly.
   A leaf returns a spanning forest of its links, never the pairs.
5. Distributed connected components join the forests.

A leaf holds about ``leaf_size`` fingerprints. Each level of the tree adds visitors (a fifth of the
points near a median of 64-bit distances), the price of the method in this metric.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; a null
doc_id keeps its row and never names a component; repeated rows stay; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelight.llm import bitsets
from pagelight.llm.common import Scratch, materialize, quoted, text_batches, unused
from pagelight.llm.components import connected_components
from pagelight.llm.overlap import near_copies

SEED, SHINGLE, RADIUS = 42, 3, 2
#: Distinct fingerprints that shape the tree (at least, and for each leaf), about how many a leaf holds, and the levels at most.
SAMPLE, EACH, LEAF, DEPTH = 8192, 16, 65536, 16
#: In a leaf, sides up to this size are compared directly.
BLOCK = 384
#: Vantage points tried there for an even cut before a side is compared as it is.
TRIES = 6
_CHUNK = 1 << 16


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """SimHash of ASCII-lower-cased words and space-joined shingles, repeats counted; unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(size, len(words)) - 1 :]
    h64 = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        h = np.array([h64(joined[s:e], SEED) for s, e in zip(starts[at : min(n, at + _CHUNK)].tolist(), last[at : at + _CHUNK].tolist())], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _text_bytes(column) -> Iterator[bytes]:
    for x in column.cast(pa.binary()):
        yield x.as_py() or b""


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, fp): fp is the fingerprint's 64 bits as a signed long."""
    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t, size) for t in _text_bytes(b.column(1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, fp long")


# --- the tree -----------------------------------------------------------------------------------


def _split(points: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[int, int]:
    """A vantage point and radius that split points about evenly with the least mass at the border."""
    best = None
    for v in rng.choice(points, min(24, len(points)), replace=False):
        n = np.bincount(np.bitwise_count(points ^ v), minlength=65)
        inside = np.cumsum(n) / len(points)
        for mu in range(64):
            if 0.3 <= inside[mu] <= 0.7:
                border = n[max(0, mu - radius + 1) : mu + radius + 1].sum() / len(points)
                score = border + 0.2 * abs(inside[mu] - 0.5)
                if best is None or score < best[0]:
                    best = (score, int(v), mu)
    if best is None:  # a lump at one distance: split as near the middle as it goes
        v = points[0]
        d = np.bitwise_count(points ^ v)
        best = (0.0, int(v), int(np.median(d)))
    return best[1], best[2]


def build_tree(sample: np.ndarray, depth: int, radius: int) -> list:
    """Nested [vantage, mu, inside, outside]; a leaf is its number."""
    rng, leaves = np.random.default_rng(7), iter(range(1 << 30))

    def grow(points: np.ndarray, left: int):
        if left == 0 or len(points) < 4:
            return next(leaves)
        v, mu = _split(points, radius, rng)
        near = np.bitwise_count(points ^ np.uint64(v)) <= mu
        return [v, mu, grow(points[near], left - 1), grow(points[~near], left - 1)]

    return grow(sample, depth)


def route(tree, fps: np.ndarray, radius: int) -> Iterator[tuple[int, bool, np.ndarray]]:
    """(leaf, visitor, positions in fps) so that each pair within radius meets once, a visitor with a resident."""

    def go(node, at: np.ndarray, visitor: bool):
        if not len(at):
            return
        if not isinstance(node, list):
            yield node, visitor, at
            return
        v, mu, near, far = node
        d = np.bitwise_count(fps[at] ^ np.uint64(v)).astype(np.int16)
        inside = d <= mu
        if visitor:
            yield from go(near, at[d <= mu + radius], True)
            yield from go(far, at[d > mu - radius], True)
        else:
            yield from go(near, at[inside], False)
            yield from go(far, at[~inside], False)
            yield from go(far, at[inside & (d > mu - radius)], True)

    yield from go(tree, np.arange(len(fps)), False)


# --- within a leaf ------------------------------------------------------------------------------


class _Forest:
    """Union-find whose root is the smallest position."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)


def _settle(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links of one block as a star per component: at most one link a point, whatever the pairs."""
    if len(i) < 64:
        return i, j
    ids, flat = np.unique(np.concatenate((i, j)), return_inverse=True)
    a, b, label = flat[: len(i)], flat[len(i) :], np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return ids, ids[label]
        label = new


def link_leaf(fps: np.ndarray, visitor: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest links (position, root position) among residents, and between visitors and residents."""
    forest = _Forest(len(fps))

    def compare(x: np.ndarray, y: np.ndarray, own: bool) -> None:
        for at in range(0, len(x), BLOCK):
            for to in range(at if own else 0, len(y), BLOCK):
                p, q = x[at : at + BLOCK], y[to : to + BLOCK]
                i, j = np.nonzero(np.bitwise_count(fps[p][:, None] ^ fps[q][None, :]) <= radius)
                i, j = p[i], q[j]
                if own:
                    i, j = i[keep := i != j], j[keep]
                for m, n in zip(*(z.tolist() for z in _settle(i, j))):
                    forest.union(m, n)

    def halves(x: np.ndarray, v: np.uint64, mu: int):
        d = np.bitwise_count(fps[x] ^ v).astype(np.int16)
        near = d <= mu
        return x[near], x[~near], x[near & (d > mu - radius)], x[~near & (d <= mu + radius)]

    def cut(x: np.ndarray) -> tuple[np.uint64, int, float]:
        """A vantage point among x, the radius that halves x most evenly, and the share of its larger side."""
        best = (np.uint64(0), 0, 1.0)
        for k in range(TRIES):
            v = fps[x[(2 * k + 1) * len(x) // (2 * TRIES)]]
            inside = np.cumsum(np.bincount(np.bitwise_count(fps[x] ^ v), minlength=65)) / len(x)
            share = np.maximum(inside, 1 - inside)
            mu = int(np.argmin(share))
            if share[mu] < best[2]:
                best = (v, mu, float(share[mu]))
            if best[2] < 0.7:
                break
        return best

    def within(x: np.ndarray) -> None:
        if len(x) <= BLOCK:
            return compare(x, x, True)
        v, mu, share = cut(x)
        near, far, edge_near, edge_far = halves(x, v, mu)
        if share > 0.95:
            return compare(x, x, True)
        within(near)
        within(far)
        across(edge_near, edge_far)

    def across(x: np.ndarray, y: np.ndarray) -> None:
        if not len(x) or not len(y):
            return
        if len(x) <= BLOCK or len(y) <= BLOCK:
            return compare(x, y, False)
        v, mu, share = cut(y)
        (xn, xf, xen, xef), (yn, yf, yen, yef) = halves(x, v, mu), halves(y, v, mu)
        if share > 0.95 and max(len(xn), len(xf)) > 0.95 * len(x):
            return compare(x, y, False)
        across(xn, yn)
        across(xf, yf)
        across(xen, yef)
        across(xef, yen)

    at = np.arange(len(fps))
    within(at[~visitor])
    across(at[visitor], at[~visitor])
    root = np.array([forest.find(i) for i in range(len(fps))], np.int64)
    linked = np.nonzero(root != at)[0]
    return linked, root[linked]


def link_fingerprints(fps: DataFrame, radius: int = RADIUS, leaf_size: int = LEAF) -> DataFrame:
    """fps(fp), distinct and written, to spanning links (u, v) of all pairs within radius."""
    spark = fps.sparkSession
    n = fps.count()
    depth = min(DEPTH, max(0, int(np.ceil(np.log2(max(n, 1) / leaf_size)))))
    tree = 0
    if depth:
        rows = fps.orderBy(F.xxhash64("fp"), "fp").limit(max(SAMPLE, EACH << depth)).select("fp").toArrow()
        tree = build_tree(rows.column("fp").to_numpy().view(np.uint64), depth, radius)
    shared = spark.sparkContext.broadcast(tree)

    def routed(batches):
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for leaf, visitor, at in route(shared.value, x, radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), leaf, np.int64)), pa.array(np.full(len(at), visitor)), pa.array(x[at].view(np.int64))], ["leaf", "visitor", "fp"])

    def linked(t: pa.Table) -> pa.Table:
        x = t.column("fp").to_numpy().view(np.uint64)
        i, j = link_leaf(x, t.column("visitor").to_numpy(), radius)
        return pa.table({"u": x[i].view(np.int64), "v": x[j].view(np.int64)})

    return fps.select("fp").mapInArrow(routed, "leaf long, visitor boolean, fp long").groupBy("leaf").applyInArrow(linked, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, radius: int = RADIUS, leaf_size: int = LEAF) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over fingerprints within radius."""
    with Scratch(docs.sparkSession, "simhash") as run:
        own = materialize(fingerprints(docs, id_col, text_col, size), "fingerprints")
        groups = run.write(own.groupBy("fp").agg(F.min("id").alias("least")), "groups")
        labels = connected_components(link_fingerprints(groups, radius, leaf_size))
        named = groups.join(labels, groups.fp == labels.node, "left").select("fp", F.coalesce("component", "fp").alias("label"), "least")
        named = run.write(named, "named")
        least = run.write(named.groupBy("label").agg(F.min("least").alias("component")), "least")
        named = materialize(named.join(least, "label").select("fp", "component"), "fingerprint-components")
    return own.join(named, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Of each group of near copies the row of the smallest id (of several texts under it, one of the group's); rows without
    an id pass. Of repeated rows, equal in id and text, one stays. Rows of unrelated texts under one id are groups of their own.

    Groups are linked by shingle similarity (`overlap`), where the vantage-point trees propose and exact comparison decides.
    Texts aren't joined with the decisions. Two bit sets of fixed size settle nearly every row where it is read: a row
    that isn't among those that go stays, and one among them, but not among the kept ones that the first set takes for such, goes. Only
    what both sets name is joined exactly.
    """
    found = near_copies(docs, id_col, text_col, **options)
    names = docs.columns
    (key,) = unused([*names, "id", "n", "kept"], "key")
    decided = found.select(F.col("id").alias(id_col), F.col("key").alias(key), "n", "kept")
    rows = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))))
    sure, asked = bitsets.settle(rows, [id_col, key], decided, F.col("n") > 1)
    every = [F.col(quoted(c)) for c in names]
    return sure.select(*every).unionByName(asked.dropDuplicates([id_col, key]).select(*every))
