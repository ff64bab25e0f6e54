"""Minimal word automata, built in parallel, packed as edges, and walked.

A node is named by a digest of what can follow it, so nodes with equal continuations are one, whoever found them. Words are dealt by their first
``depth`` letters; a task builds the nodes under each such beginning, and the few levels above are aggregates. Packed edges
are numbered by ranges, a node's edges one after the other and the root's first; no step sees all of them.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelight.operators.stages import Stages

#: Letters that a walk goes on between two written tables; edges of a block when nodes are found.
STEPS, BLOCK = 8, 4096
_EDGE = "letter int, word_end boolean, next string"


def _digest(edges: list[tuple[int, bool, str | None]]) -> str:
    return hashlib.md5(";".join(f"{letter}:{int(end)}:{next_ or ''}" for letter, end, next_ in sorted(edges)).encode()).hexdigest()


def _below(words: list[list[int]], depth: int) -> tuple[str, dict[str, list[tuple[int, bool, str | None]]]]:
    """(name of the node that all words share after `depth` letters, edges by node) of words that are longer than that."""
    nodes: list[dict[int, list]] = [{}]  # letter: [ends a word, node]
    for w in words:
        at = 0
        for i, letter in enumerate(w[depth:], depth + 1):
            step = nodes[at].setdefault(letter, [False, None])
            if i == len(w):
                step[0] = True
            elif step[1] is None:
                step[1] = len(nodes)
                nodes.append({})
            at = step[1]
    names, edges = [""] * len(nodes), {}
    for k in range(len(nodes) - 1, -1, -1):  # what follows a node was made after it
        own = [(letter, end, None if to is None else names[to]) for letter, (end, to) in nodes[k].items()]
        names[k] = _digest(own)
        edges[names[k]] = own
    return names[0], edges


def automaton(run: Stages, words: DataFrame, depth: int = 2) -> DataFrame:
    """words(letters array<int>) to (node, letter, word_end, next, root), each edge once: node and next are names, root says that the edge leaves the first node.
    Empty words are left out."""
    words = run.write(words.where("size(letters) > 0").select("letters").distinct(), "words")

    def build(t: pa.Table) -> pa.Table:
        start = t.column("start")[0].as_py()
        name, edges = _below(t.column("letters").to_pylist(), depth)
        rows = [(start, name, None, None, None, None)] + [(None, None, node, *e) for node, own in edges.items() for e in own]
        kinds = [pa.list_(pa.int32()), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.string()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["start", "name", "node", "letter", "word_end", "next"])

    longer = words.where(F.size("letters") > depth).withColumn("start", F.slice("letters", 1, depth))
    made = run.write(longer.groupBy("start").applyInArrow(build, f"start array<int>, name string, node string, {_EDGE}"), "below")
    edges = [made.where("node is not null").select("node", "letter", "word_end", "next").dropDuplicates(["node", "letter"])]
    under = made.where("start is not null").select("start", F.col("name").alias("next"))
    for level in range(depth, 0, -1):
        ends = words.where(F.size("letters") == level).select(F.col("letters").alias("start"), F.lit(True).alias("word_end"))
        each = under.join(ends, "start", "full").select(F.slice("start", 1, level - 1).alias("before"), F.element_at("start", -1).alias("letter"), F.coalesce("word_end", F.lit(False)).alias("word_end"), "next")
        own = each.groupBy("before").agg(F.array_sort(F.collect_list(F.struct("letter", "word_end", "next"))).alias("own"))  # no more than there are letters
        text = F.array_join(F.transform("own", lambda e: F.concat(e["letter"].cast("string"), F.lit(":"), e["word_end"].cast("int").cast("string"), F.lit(":"), F.coalesce(e["next"], F.lit("")))), ";")
        own = run.write(own.select("before", F.md5(text).alias("node"), "own"), "level")
        edges.append(own.select("node", F.explode("own").alias("e")).select("node", "e.letter", "e.word_end", "e.next"))
        under = own.select(F.col("before").alias("start"), F.col("node").alias("next"))
    first = under.select(F.col("next").alias("_root"))  # one row
    every = edges[0]
    for e in edges[1:]:
        every = every.unionByName(e)
    every = run.write(every.dropDuplicates(["node", "letter"]), "edges")
    return every.join(first, F.col("node") == F.col("_root"), "left").select("node", "letter", "word_end", "next", F.col("_root").isNotNull().alias("root"))


def packed(run: Stages, automaton: DataFrame) -> tuple[int, DataFrame]:
    """(bits of a letter, (edge, rec)): an automaton's edges numbered and packed: the letter, the flags (1: the node's last, 4: ends a word), the
    number of the next node's first edge, 0 where there is none."""
    bits = max(1, int(automaton.agg(F.max("letter")).first()[0] or 0).bit_length())
    order = [F.desc("root"), F.asc("node"), F.asc("letter")]
    n = int(automaton.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = automaton.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = run.write(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "ranged")
    parts = ranged.groupBy("_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    parts = run.write(parts.select(F.col("_part").alias("_p"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift")), "parts")
    numbered = ranged.join(parts, F.col("_part") == F.col("_p")).withColumn("edge", F.col("_row") + F.col("_shift"))
    numbered = run.write(numbered.select("edge", "node", "letter", "word_end", "next"), "numbered")
    nodes = run.write(numbered.groupBy("node").agg(F.min("edge").alias("_start"), F.max("edge").alias("_end")), "nodes")
    own = nodes.select(F.col("node").alias("_node"), "_end")
    onward = nodes.select(F.col("node").alias("_next"), "_start")
    e = numbered.join(own, F.col("node") == F.col("_node")).join(onward, F.col("next") == F.col("_next"), "left")
    flags = F.when(F.col("edge") == F.col("_end"), 1).otherwise(0) + F.when(F.col("word_end"), 4).otherwise(0)
    shifted = lambda v, by: F.shiftleft(v.cast("long"), by)
    return bits, e.select("edge", F.col("letter").cast("long").bitwiseOR(shifted(flags, bits)).bitwiseOR(shifted(F.coalesce("_start", F.lit(0)), bits + 3)).alias("rec"))


def nodes_of(edges: DataFrame, last: str = "last") -> DataFrame:
    """edges(edge, last, ...) with node, the first edge of the run that ends with a last one: found within blocks of edges, and carried from block to block."""
    block = F.floor(F.col("edge") / BLOCK)
    begins = F.when(F.coalesce(F.lag(last).over(Window.partitionBy("_b").orderBy("edge")), F.col("_opens")), F.col("edge"))
    ends = edges.withColumn("_b", block)
    tail = ends.groupBy("_b").agg(F.max_by(last, "edge").alias("_closed"), F.max(F.when(F.col(last), F.col("edge"))).alias("_last"), F.max("edge").alias("_top"))
    over = Window.orderBy("_b")  # a row for BLOCK edges
    tail = tail.withColumn("_opens", F.coalesce(F.lag("_closed").over(over), F.lit(True)))
    # the node that is open where a block begins: what follows the last closing edge of the blocks before
    tail = tail.withColumn("_held", F.coalesce(F.max(F.col("_last") + 1).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    e = ends.join(tail.select(F.col("_b").alias("_block"), "_opens", "_held"), F.col("_b") == F.col("_block"))
    node = F.last(begins, True).over(Window.partitionBy("_b").orderBy("edge").rowsBetween(Window.unboundedPreceding, 0))
    return e.withColumn("node", F.coalesce(node, F.col("_held"))).drop("_b", "_block", "_opens", "_held")


def walked(words: DataFrame, edges: DataFrame, prefix: bool = False) -> DataFrame:
    """words(word_id, letters) of any length with found, written: whether they (prefix: their beginnings) are paths of the graph's edges(node, letter, next, word_end,
    free). All words go on a letter at a time by a join with the edges; those that have ended leave."""
    spark = words.sparkSession
    one = edges.where(~F.col("free")).groupBy(F.col("node").alias("_node"), F.col("letter").alias("_letter")).agg(F.max("next").alias("_next"), F.max("word_end").alias("_end"))
    with Stages(spark, "walk") as run:
        one = run.write(one, "edges")
        at = run.write(words.select("word_id", "letters", F.lit(0).alias("place"), F.when(F.size("letters") > 0, F.lit(0).cast("long")).alias("node"), (F.lit(prefix) & (F.size("letters") == 0)).alias("found")), "begin")
        settled = at.where("node is null").select("word_id", "found")
        while True:
            at = at.where("node is not null")
            if at.isEmpty():
                return Stages(spark, "walked").write(settled, "found")
            for _ in range(STEPS):
                step = at.join(one, (F.col("node") == F.col("_node")) & (F.get("letters", F.col("place")) == F.col("_letter")), "left")
                here, ends = F.col("_node").isNotNull(), F.size("letters") == F.col("place") + 1
                found = F.when(F.col("node").isNull(), F.col("found")).otherwise(here & ends & (F.lit(prefix) | F.col("_end")))
                onward = F.when(here & ~ends & (F.col("_next") != 0), F.col("_next"))
                at = step.select("word_id", "letters", (F.col("place") + 1).alias("place"), onward.alias("node"), found.alias("found"))
            at = run.write(at, "step")
            settled = settled.unionByName(at.where("node is null").select("word_id", "found"))
