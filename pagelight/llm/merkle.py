"""A Merkle manifest of a dataset by incremental witnesses.

A source's rows, in the order of their ids, are the leaves of a tree of arity ``ARITY``: every three consecutive nodes, fewer in the last
run, become their parent until one node is left, the source's subroot. Subroots, in the order of the sources, become the root the
same way. A row's witness holds the siblings on its path, level by level and from left to right within a level; with the row's place and
the number of leaves it leads from the leaf to the root.

Leaves get their places from ranges of (source, id), so a source of any size spreads over tasks. They are then appended in aligned
blocks of ``ARITY ** HEIGHT``, one task a block: `OpenTree` keeps the open subtrees and a partial witness for every leaf
below them, and each sibling that completes extends the witnesses of the others. Block roots are appended to trees of the next
round in the same way, until each source has one node; so are the subroots. Going back, the witness of a block extends
those of its leaves. A round costs one shuffle of digests; texts never move.

Values: a null is ``-``, anything else its length in UTF-8 bytes, ``:`` and the value. Null ids come first; rows of one id
follow by their leaves, so that repeated rows have equal leaves next to each other. A null source is a source of its own, the first. Very
long texts are hashed where they are read; empty texts are values of length 0. An empty table has no root and gives no
row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelight.llm.common import Scratch, materialize, quoted
from pagelight.llm.ordering import numbered

#: Children of a node; levels that a block of leaves has.
ARITY, HEIGHT = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def parent(digests: bytes) -> bytes:
    """The parent of digests of 32 bytes, concatenated: they are hashed as hex text."""
    return hashlib.sha256(digests.hex().encode()).digest()


def depth(n: int) -> int:
    """Levels above n leaves."""
    d = 0
    while n > 1:
        n, d = -(-n // ARITY), d + 1
    return d


class OpenTree:
    """A tree that grows by appending leaves, up to a given number of levels, with the witnesses of all its leaves so far."""

    def __init__(self, leaves: int, levels: int) -> None:
        self.levels, self.count = levels, 0
        self.open: list[list[tuple[bytes, int, int]]] = [[] for _ in range(levels + 1)]  # complete subtrees (digest, leaves from, to) that wait for siblings
        self.held = np.zeros((leaves, (ARITY - 1) * levels, 32), np.uint8)
        self.used = np.zeros(leaves, np.int64)

    def append(self, digest: bytes) -> None:
        self._complete(0, digest, self.count, self.count + 1)
        self.count += 1

    def _complete(self, level: int, digest: bytes, first: int, end: int) -> None:
        self.open[level].append((digest, first, end))
        if level < self.levels and len(self.open[level]) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        """The open run of a level becomes a node of the next; each member's leaves get the others as siblings."""
        run, self.open[level] = self.open[level], []
        for i, (_, first, end) in enumerate(run):
            leaves = np.arange(first, end)
            for j, (digest, _, _) in enumerate(run):
                if i != j:
                    self.held[leaves, self.used[first:end]] = np.frombuffer(digest, np.uint8)
                    self.used[first:end] += 1
        self._complete(level + 1, parent(b"".join(d for d, _, _ in run)), run[0][1], run[-1][2])

    def finish(self) -> bytes:
        """Close what is still open, lowest level first, and return the root."""
        for level in range(self.levels):
            if self.open[level]:
                self._close(level)
        return self.open[self.levels][0][0]

    def witness(self, leaf: int) -> bytes:
        return self.held[leaf, : self.used[leaf]].tobytes()


def folded(digest: bytes, witness: bytes, *trees: tuple[int, int]) -> bytes:
    """The root that a digest leads to through its witness; trees are (place, leaves), lowest first."""
    at = 0
    for pos, n in trees:
        while n > 1:
            i = pos % ARITY
            end = at + 32 * (min(ARITY, n - (pos - i)) - 1)
            cut = at + 32 * i
            digest = parent(witness[at:cut] + digest + witness[cut:end])
            at, pos, n = end, pos // ARITY, -(-n // ARITY)
    return digest


def leaf(values: list[Column]) -> Column:
    """The digest of a row, 32 bytes."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*[part(v) for v in values]), 256))


def _grown(nodes: DataFrame) -> DataFrame:
    """nodes(g, pos, n, h, ...) with block, w (the witness within the block) and top (the block's root)."""
    size = ARITY**HEIGHT

    def build(t: pa.Table) -> pa.Table:
        t = t.take(np.argsort(t.column("pos").to_numpy(), kind="stable"))
        n = t.column("n")[0].as_py()
        tree = OpenTree(t.num_rows, HEIGHT if n > size else depth(n))
        for d in t.column("h").to_pylist():
            tree.append(d)
        top = tree.finish()
        t = t.append_column("w", pa.array([tree.witness(i) for i in range(t.num_rows)], pa.binary()))
        return t.append_column("top", pa.array([top] * t.num_rows, pa.binary()))

    keyed = nodes.withColumn("block", F.floor(F.col("pos") / size))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema)
    return keyed.groupBy("g", "block").applyInArrow(build, fields + ", w binary, top binary")


def _climb(run: Scratch, nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The rounds above nodes(g, pos, n, h, ...), the nodes' own first, and (g, h) of the roots."""
    size, rounds = ARITY**HEIGHT, []
    while not rounds or (nodes.agg(F.max("n")).first()[0] or 0) > 1:
        rounds.append(run.write(_grown(nodes), "round"))
        tops = rounds[-1].where(F.col("pos") % size == 0)
        nodes = tops.select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / size).alias("n"), F.col("top").alias("h"))
    return rounds, nodes.select("g", "h")


def _descend(run: Scratch, rounds: list[DataFrame], above: DataFrame, facts: list[str]) -> DataFrame:
    """The nodes of the first round, each with its whole witness: its own, that of its block, that of its block's block, then `w` of
    above(g, w, *facts)."""
    above = above.select("*", F.lit(0).cast("long").alias("pos"))
    for i, own in reversed(list(enumerate(rounds))):
        up = above.select(F.col("g").alias("_g"), F.col("pos").alias("_pos"), F.col("w").alias("_w"), *facts)
        kept = [c for c in own.columns if c not in ("block", "w", "top")]
        above = own.join(up, (F.col("g") == F.col("_g")) & (F.col("block") == F.col("_pos"))).select(*kept, F.concat("w", "_w").alias("w"), *facts)
        if i:
            above = run.write(above, "extended")
    return above


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source", changed: dict[str, Column] | None = None) -> DataFrame:
    """(id, source, leaf, pos, n, subroot, source_no, sources, root, witness, changed_leaf) of every row, written. Digests are 32 bytes. changed
    gives other values for some fields; changed_leaf is the leaf that a row has with them."""
    with Scratch(docs.sparkSession, "merkle") as run:
        return materialize(_manifest(run, docs, fields, id_col, source_col, changed or {}), "merkle-manifest")


def _manifest(run: Scratch, docs: DataFrame, fields, id_col: str, source_col: str, changed: dict[str, Column]) -> DataFrame:
    own = leaf([F.col(quoted(f)) for f in fields])
    other = leaf([changed.get(f, F.col(quoted(f))) for f in fields]) if changed else own
    source = F.col(quoted(source_col)).cast("string")
    group = F.coalesce(F.concat(F.lit("="), source), F.lit(""))  # never null, in the sources' order
    leaves = run.write(docs.select(group.alias("g"), F.col(quoted(id_col)).alias("id"), own.alias("h"), other.alias("c")), "leaves")
    rounds, subroots = _climb(run, run.write(numbered(run, leaves, "g", ["id", "h"]), "placed"))
    named = run.write(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "h"), "subroots")
    upper, roots = _climb(run, run.write(numbered(run, named, "g", ["name"]), "sources"))
    root = roots.select("g", F.lit(b"").alias("w"), F.col("h").alias("root"))
    tops = _descend(run, upper, root, ["root"]).select(F.col("name").alias("g"), "w", F.col("h").alias("subroot"), F.col("pos").alias("source_no"), F.col("n").alias("sources"), "root")
    found = _descend(run, rounds, run.write(tops, "tops"), ["subroot", "source_no", "sources", "root"])
    named_source = F.when(F.col("g") != "", F.substring("g", 2, 1 << 30))
    return found.select("id", named_source.alias("source"), F.col("h").alias("leaf"), "pos", "n", "subroot", "source_no", "sources", "root", F.col("w").alias("witness"), F.col("c").alias("changed_leaf"))


def checked(manifested: DataFrame, leaf_col: str = "changed_leaf") -> DataFrame:
    """Rows of a manifest with proof_sha256 (of the witness as hex text), folded_root (from leaf_col through the witness) and verified."""
    schema = manifested.schema

    def run(batches):
        for b in batches:
            witness = b.column("witness").to_pylist()
            places = zip(*(b.column(c).to_pylist() for c in ("pos", "n", "source_no", "sources")))
            ends = [folded(d, w, (p, n), (q, m)) for d, w, (p, n, q, m) in zip(b.column(leaf_col).to_pylist(), witness, places)]
            proofs = [hashlib.sha256(w.hex().encode()).hexdigest() for w in witness]
            right = [e == r for e, r in zip(ends, b.column("root").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(proofs, pa.string()), pa.array(ends, pa.binary()), pa.array(right, pa.bool_())], [*b.schema.names, "proof_sha256", "folded_root", "verified"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return manifested.mapInArrow(run, fields + ", proof_sha256 string, folded_root binary, verified boolean")
