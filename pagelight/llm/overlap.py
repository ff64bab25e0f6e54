"""Near copies by shingle similarity: candidates from SimHash fingerprints and from rare shingles, all verified exactly.

Two texts are linked where the Jaccard similarity of their sets of five-word shingles reaches ``SIMILARITY``. A
fingerprint of 64 bits can't tell that without loss, so it only proposes; a prefix-filtered join finds the rest:

1. A text's set is hashed to a node; equal sets are one node.
2. Fingerprints of the sets are linked through the vantage-point trees of `simhash`, and each node is compared with ``CENTRES``
   nodes of each shingle of its prefix (see 3), the smallest and some drawn by a hash of both. Those pairs that are similar are joined to components, so a large group
   of near copies falls together without its pairs.
3. Shingles are put in one order for all texts, common ones last. Sets of n that reach the similarity share a shingle
   among the first n - ceil(s n) + 1 of both, the smaller of the two (of n) even among its first
   n - ceil(2s / (1 + s) n) + 1. Pairs of different components that share such a shingle are compared; nothing is dropped.
   Which shingles count as common comes from a bounded sample (``SAMPLE``, ``COMMON``); it decides about the
   work only, since any order gives the same links.

Before a pair of step 3 is made, the parities of its sets' shingles in ``PARITY`` cells must fit: where they differ, the sets differ in a shingle at least,
and similar sets differ in few. That is part of the join, so texts put together from the same few passages make hardly any
pairs. Before sets are compared, counts of their shingles in ``CELLS`` cells bound what they can have in common; that
spares most pairs the comparison and loses none. Every comparison is of the whole sets. A text under five words is one
shingle of its own length; null and blank texts have the empty set and are linked with each other. Words are those of
the fingerprints (ASCII-lower-cased, by white space).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelight.llm import bitsets
from pagelight.llm.common import Scratch, materialize, quoted, text_batches
from pagelight.llm.components import connected_components

SHINGLE, SIMILARITY, PROPOSE = 5, 0.8, 3
#: Texts that the order of shingles is taken from, how many common ones it has, and in how many texts those are.
SAMPLE, COMMON, OFTEN = 16384, 1 << 18, 3
#: Cells of a set's counts; nodes of each shingle that all its nodes are compared with; cells of a set's parities, 64 in each number.
CELLS, CENTRES, PARITY = 256, 5, 256
_PARITIES = [f"q{i}" for i in range(PARITY // 64)]


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The set of a text's shingle hashes, sorted."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.int64)
    h64 = xxhash.xxh64_intdigest
    found = {h64(b" ".join(words[i : i + size])) for i in range(max(1, len(words) - size + 1))}
    return np.sort(np.fromiter(found, np.uint64, len(found)).view(np.int64))


def _node(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64))


def _fingerprint(s: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(s), 1 << 16):
        ones += np.unpackbits(s[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(s), bitorder="little").view(np.int64)[0])


def _parities(s: np.ndarray) -> list[int]:
    """Whether each cell has an odd number of the shingles, as numbers of 64 bits."""
    odd = np.bincount((s >> 9) & (PARITY - 1), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def _near_parities(similarity: float):
    """Whether a and b can be similar by their parities: sets that reach the similarity differ in so many shingles at most."""
    differ = sum((F.bit_count(F.col(f"a{q}").bitwiseXOR(F.col(f"b{q}"))) for q in _PARITIES), F.lit(0))
    return differ <= (1 - similarity) / (1 + similarity) * (F.col("an") + F.col("bn")) + 1e-9


def _sets(rows: DataFrame, size: int, schema: str, row) -> DataFrame:
    """mapInArrow over rows(id, key, t): row(set) gives a row's values after id and key."""
    fields = [f.split() for f in schema.split(", ")]
    kinds = [{"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}[k] for _, k in fields]

    def run(batches):
        for b in batches:
            made = [row(shingles(t.as_py() or b"", size)) for t in b.column(2).cast(pa.binary())]
            columns = [pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["id", "key", *[n for n, _ in fields]])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, key long, {schema}")


def _common(rows: DataFrame, size: int) -> np.ndarray:
    """Shingles found in several texts of a sample, the most common last."""
    every = max(1, rows.count() // SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64("id", "key"), F.lit(every)) == 0)
    found = _sets(sample, size, "s array<long>", lambda s: (s,)).select(F.explode("s").alias("h")).groupBy("h").count()
    top = found.where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "h").limit(COMMON).select("h").toArrow()
    return top.column("h").to_numpy()[::-1]


def _fits(similarity: float):
    """Whether a and b can be similar by their sizes and places of a shared shingle: of the first shingle
    in common, only what follows it in both can be common too."""
    an, ap, bn, bp = map(F.col, ("an", "ap", "bn", "bp"))
    sizes = F.least(an, bn) >= similarity * F.greatest(an, bn) - 1e-9
    return sizes & (F.least(an - ap, bn - bp) >= similarity / (1 + similarity) * (an + bn) - 1e-9)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(id, key, n, component, kept) of the rows with an id, one for each id and text (key is the text's hash, n the number of
    such rows), written. component is the smallest id reachable over similar texts; kept holds for one id and text of
    each component, the smallest."""
    text_batches(docs.sparkSession)
    with Scratch(docs.sparkSession, "copies") as run:
        return materialize(_linked(run, docs, id_col, text_col, size, similarity), "near-copies")


def _linked(run: Scratch, docs: DataFrame, id_col: str, text_col: str, size: int, similarity: float) -> DataFrame:
    from pagelight.llm.simhash import link_fingerprints

    text = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    rows = docs.where(F.col(quoted(id_col)).isNotNull()).select(F.col(quoted(id_col)).alias("id"), F.xxhash64(text).alias("key"), text.alias("t"))
    common = _common(rows, size)
    shared = docs.sparkSession.sparkContext.broadcast((np.sort(common), np.argsort(common, kind="stable")))

    def prefix(s: np.ndarray) -> tuple:
        names, rank = shared.value
        n = len(s)
        at = np.minimum(np.searchsorted(names, s), max(len(names) - 1, 0))
        often = names[at] == s if len(names) else np.zeros(n, bool)
        order = np.concatenate((s[~often], s[often][np.argsort(rank[at[often]], kind="stable")]))
        cells = np.minimum(np.bincount(s & (CELLS - 1), minlength=CELLS), 255).astype(np.uint8)  # 255: or more
        return _node(s), _fingerprint(s), n, cells.tobytes(), order[: n - int(np.ceil(similarity * n - 1e-9)) + 1], *_parities(s)

    fields = "node long, fp long, n long, cells binary, prefix array<long>" + "".join(f", {q} long" for q in _PARITIES)
    own = run.write(_sets(rows, size, fields, prefix), "sets")
    nodes = own.groupBy("node").agg(F.min(F.struct("id", "key")).alias("top"), F.first("fp").alias("fp"), F.first("n").cast("int").alias("n"), *[F.first(c).alias(c) for c in ("cells", "prefix", *_PARITIES)])
    nodes = run.write(nodes, "nodes")
    tokens = nodes.select("node", "n", F.posexplode("prefix").alias("p", "token"))
    several = run.write(tokens.groupBy("token").count().where("count > 1").select("token"), "shared")
    members = run.write(tokens.join(several, "token").select("token", "node", "n", "p"), "members")

    def similar(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets reach the similarity, as edges (u, v)."""
        x = nodes.select(F.col("node").alias("a"), F.col("cells").alias("x"))
        y = nodes.select(F.col("node").alias("b"), F.col("cells").alias("y"))

        def possible(batches):
            for t in batches:
                p, q = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int64) for c in "xy")
                most = np.minimum(p, q).sum(axis=1)
                keep = (most >= similarity / (1 + similarity) * (p.sum(axis=1) + q.sum(axis=1)) - 1e-9) | (p.max(axis=1) == 255) | (q.max(axis=1) == 255)
                yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], ["a", "b"]).filter(pa.array(keep))

        pairs = run.write(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(possible, "a long, b long"), "possible")
        ends = run.write(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "ends")
        tops = nodes.join(ends, "node").select(F.col("top.id").alias("id"), F.col("top.key").alias("key"))
        at = bitsets.slot(F.col("id"), F.col("key"))
        held = run.write(bitsets.of_slots(tops, at), "wanted")
        # a superset of the texts to compare; the others find no pair
        wanted = bitsets.with_hit(rows, held, at, "hit").where("hit").select("id", "key", "t")
        sets = _sets(wanted, size, "node long, s array<long>", lambda s: (_node(s), s)).select("node", "s")
        sets = run.write(sets.join(ends, "node", "leftsemi").dropDuplicates(["node"]), "compared")

        def compare(batches):
            for t in batches:
                keep = []
                for p, q in zip(t.column("x"), t.column("y")):
                    p, q = p.values.to_numpy(), q.values.to_numpy()
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(both >= similarity * (len(p) + len(q) - both) - 1e-9)
                yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

        x = sets.select(F.col("node").alias("a"), F.col("s").alias("x"))
        y = sets.select(F.col("node").alias("b"), F.col("s").alias("y"))
        links = run.write(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(compare, "u long, v long"), "links")
        run.drop(pairs, sets)
        return links

    # what the fingerprints propose, and each node with a few of each of its shingles
    least = run.write(nodes.groupBy("fp").agg(F.min("node").alias("b")), "fingerprints")
    close = run.write(link_fingerprints(least.select("fp"), PROPOSE), "close")
    ends = least.select(F.col("fp").alias("u"), F.col("b").alias("a")), least.select(F.col("fp").alias("v"), "b")
    proposed = close.join(ends[0], "u").join(ends[1], "v").select("a", "b").unionByName(nodes.join(least, "fp").select(F.col("node").alias("a"), "b").where("a <> b"))
    drawn = [F.lit(0).cast("long"), *(F.xxhash64("token", "node", F.lit(i)) for i in range(1, CENTRES))]  # the first: the smallest node
    centres = members.groupBy("token").agg(F.array(*[F.min(F.struct(h.alias("h"), "node", "n", "p")) for h in drawn]).alias("y"))
    centres = centres.select("token", F.explode(F.array_distinct(F.transform("y", lambda c: F.struct(c["node"].alias("b"), c["n"].alias("bn"), c["p"].alias("bp"))))).alias("y"))
    centres = run.write(centres.select("token", "y.*"), "centres")
    x = members.select("token", F.col("node").alias("a"), F.col("n").alias("an"), F.col("p").alias("ap"))
    star = x.join(centres, "token").where((F.col("a") != F.col("b")) & _fits(similarity)).select("a", "b")
    both = proposed.unionByName(star).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = similar(run.write(both, "proposed"))
    grouped = connected_components(links)
    labelled = members.join(grouped.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    labelled = run.write(labelled.select("token", "node", "n", "p", F.coalesce("component", "node").alias("label")), "labelled")
    # then all pairs between groups
    mixed = labelled.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("token")
    told = nodes.select(F.col("node").alias("_node"), *_PARITIES)
    rest = run.write(labelled.join(mixed, "token").join(told, F.col("node") == F.col("_node")).drop("_node"), "mixed")
    first = F.col("n") - F.col("p") >= 2 * similarity / (1 + similarity) * F.col("n") - 1e-9
    x = rest.where(first).select("token", F.col("node").alias("a"), F.col("n").alias("an"), F.col("p").alias("ap"), F.col("label").alias("al"), *[F.col(q).alias(f"a{q}") for q in _PARITIES])
    y = rest.select("token", F.col("node").alias("b"), F.col("n").alias("bn"), F.col("p").alias("bp"), F.col("label").alias("bl"), *[F.col(q).alias(f"b{q}") for q in _PARITIES])
    smaller = (F.col("an") < F.col("bn")) | ((F.col("an") == F.col("bn")) & (F.col("a") < F.col("b")))
    pairs = x.join(y, "token").where((F.col("al") != F.col("bl")) & smaller & _fits(similarity) & _near_parities(similarity)).select("a", "b").distinct()
    links = links.unionByName(similar(run.write(pairs, "pairs")))
    labels = connected_components(links)

    named = nodes.select("node", "top").join(labels.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("node", "top", F.coalesce("component", "node").alias("label"))
    named = run.write(named, "named")
    first = run.write(named.groupBy("label").agg(F.min("top").alias("first")), "first")
    named = run.write(named.join(first, "label").select("node", "first"), "components")
    each = own.groupBy("id", "key").agg(F.count("*").alias("n"), F.first("node").alias("node"))
    each = each.join(named, "node")
    return each.select("id", "key", "n", F.col("first.id").alias("component"), ((F.col("id") == F.col("first.id")) & (F.col("key") == F.col("first.key"))).alias("kept"))
