"""Decoding stage: greedy collapse, beam search, codes to characters, alignment with words, dictionary lookups.

The beam keeps hypotheses from one timestep to the next, so it is a small function over the timesteps of one line.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelight.functions import scalar
from pagelight.operators import word_graphs


def greedy(frames: DataFrame, probs: str = "probs", null_code: int = 0) -> DataFrame:
    """(line_id, t, code, conf): emitted where the best code is not null and differs from the one before."""
    best = frames.select("line_id", "t", scalar.arg_max(F.col(probs)).alias("code"), F.array_max(probs).alias("p"))
    before = F.lag("code").over(Window.partitionBy("line_id").orderBy("t"))
    return best.withColumn("b", before).where((F.col("code") != null_code) & (F.col("b").isNull() | (F.col("b") != F.col("code")))).select("line_id", "t", "code", F.log(F.greatest("p", F.lit(1e-30))).alias("conf"))


def top_n(frames: DataFrame, n: int = 5, probs: str = "probs") -> DataFrame:
    """(line_id, t, rank, code): the n largest of each row, ties to the smaller code; sorted within the row, no shuffle."""
    pairs = F.transform(probs, lambda p, i: F.struct((-p).alias("np"), i.alias("code")))
    return frames.select("line_id", "t", F.posexplode(F.slice(F.array_sort(pairs), 1, n)).alias("rank", "s")).select("line_id", "t", (F.col("rank") + 1).alias("rank"), F.col("s.code").cast("int").alias("code"))


def in_dictionary(tokens: DataFrame, lexicon: DataFrame, column: str = "word") -> DataFrame:
    return tokens.join(lexicon.select(column).distinct(), column, "left_semi")


def in_dictionary_prefix(tokens: DataFrame, lexicon: DataFrame, column: str = "word") -> DataFrame:
    """tokens that a word of the lexicon begins with; the empty token is one. All beginnings of the lexicon's words are
    its size times their length, and the join is an equi-join."""
    word = F.col(column)
    starts = lexicon.select(F.explode(F.transform(F.sequence(F.lit(0), F.length(word)), lambda n: F.substring(word, F.lit(1), n))).alias(column)).distinct()
    return tokens.join(starts, column, "left_semi")


# --- codes and characters ---------------------------------------------------------------------------

#: The id of a code that no character has, and the smallest probability that is told from 0.
INVALID, LEAST = 0xFFFFFFFF, 1e-30


def code_table(recoder: DataFrame) -> DataFrame:
    """recoder(id, codes) to (code, unichar_id) for characters of a single code; of several, the last id."""
    single = recoder.where((F.size("codes") == 1) & (F.col("codes")[0] >= 0))
    return single.select(F.col("codes")[0].alias("code"), F.col("id").cast("long").alias("id")).groupBy("code").agg(F.max("id").alias("unichar_id"))


def largest_code(recoder: DataFrame) -> DataFrame:
    """(code): the largest code of all characters, 0 at least."""
    return recoder.select(F.explode("codes").alias("code")).agg(F.greatest(F.coalesce(F.max("code"), F.lit(0)), F.lit(0)).alias("code"))


def unichar_ids(codes: DataFrame, table: DataFrame | None) -> DataFrame:
    """codes(..., code) with unichar_id: INVALID where the table has none; without a table the code."""
    if table is None:
        return codes.withColumn("unichar_id", F.col("code").cast("long"))
    return codes.join(table, "code", "left").withColumn("unichar_id", F.coalesce("unichar_id", F.lit(INVALID)))


def characters(ids: DataFrame, charset: DataFrame) -> DataFrame:
    """ids(..., unichar_id) with unichar, empty for ids that the character set lacks."""
    known = charset.select(F.col("id").cast("long").alias("unichar_id"), "unichar")
    return ids.join(known, "unichar_id", "left").withColumn("unichar", F.coalesce("unichar", F.lit("")))


def text_of(emitted: DataFrame, charset: DataFrame) -> DataFrame:
    """emitted(line_id, t, unichar_id) to (line_id, text)."""
    found = characters(emitted, charset).groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("t", "unichar"))).alias("c"))
    return found.select("line_id", F.array_join(F.transform("c", lambda x: x["unichar"]), "").alias("text"))


def beam(rows: list[list[float]], null_code: int, width: int = 10, top: int = 5) -> tuple[list[int], float]:
    """The best sequence of codes and its score. Sequences that come out equal are one hypothesis with its best score; ties
    go to the smaller sequence."""
    if not 0 < top <= 64:
        raise ValueError("top must be 1 to 64")
    held = {(): (0.0, -1)}
    for row in rows:
        best = sorted(range(len(row)), key=lambda c: (-row[c], c))[:top]
        steps = [(c, math.log(max(row[c], LEAST))) for c in best]
        new: dict[tuple, tuple[float, int]] = {}
        for codes, (score, last) in held.items():
            for c, gain in steps:
                key = codes if c in (null_code, last) else (*codes, c)
                found = (score + gain, -1 if c == null_code else c)
                if key not in new or found[0] > new[key][0]:
                    new[key] = found
        held = dict(sorted(new.items(), key=lambda x: (-x[1][0], x[0]))[:width])
    codes, (score, _) = next(iter(held.items()))
    return list(codes), score


def beam_search(frames: DataFrame, null_code: int = 0, width: int = 10, top: int = 5, probs: str = "probs") -> DataFrame:
    """frames(line_id, t, probs) to (line_id, codes, score)."""

    def run(t: pa.Table) -> pa.Table:
        order = sorted(range(t.num_rows), key=t.column("t").to_pylist().__getitem__)
        rows = t.column("probs").to_pylist()
        codes, score = beam([rows[i] for i in order], null_code, width, top)
        return pa.table({"line_id": t.column("line_id").slice(0, 1).cast(pa.int64()), "codes": pa.array([codes], pa.list_(pa.int32())), "score": pa.array([score], pa.float64())})

    return frames.select("line_id", "t", F.col(probs).alias("probs")).groupBy("line_id").applyInArrow(run, "line_id long, codes array<int>, score double")


def code_hash(codes: list[int]) -> int:
    """64-bit FNV-1a over the codes' four bytes each, little end first."""
    h = 0xCBF29CE484222325
    for byte in b"".join(c.to_bytes(4, "little") for c in codes):
        h = (h ^ byte) * 0x100000001B3 % 2**64
    return h


def probability(confidences):
    """The mean of logarithms as a probability; 0 without any."""
    total = F.aggregate(confidences, F.lit(0.0), lambda a, c: a + c.cast("double"))
    return F.when(F.size(confidences) > 0, F.exp(total / F.size(confidences))).otherwise(F.lit(0.0)).cast("float")


def aligned(text, confidence, boxes):
    """array<struct<text, confidence, bbox>>, a word for each box: all text for one box, the parts where their number is that of
    the boxes, else all text for the first box and nothing for the others."""
    parts = scalar.split_spaces(text)
    fits = (F.size(boxes) > 1) & (F.size(parts) == F.size(boxes))
    whole = lambda i: F.when(i == 0, text).otherwise(F.lit(""))
    sure = confidence.cast("float")
    none = F.lit(0.0).cast("float")
    return F.transform(boxes, lambda b, i: F.struct(F.when(fits, F.get(parts, i)).otherwise(whole(i)).alias("text"), F.when(fits | (i == 0), sure).otherwise(none).alias("confidence"), b.alias("bbox")))


# --- packed word graphs -------------------------------------------------------------------------------


def graph_edges(records: DataFrame, start_bit: int) -> DataFrame:
    """records(edge, rec) to (edge, node, letter, next, word_end, last, backward, free): a node is named by its first edge."""
    flag = lambda f: scalar.edge_flag(F.col("rec"), start_bit, f)
    e = records.select("edge", "rec", scalar.edge_letter(F.col("rec"), start_bit).alias("letter"), scalar.edge_next(F.col("rec"), start_bit).alias("next"), flag(1).alias("last"), flag(2).alias("backward"), flag(4).alias("word_end"))
    free = F.col("rec") == F.lit(-1 << (start_bit + 3))
    return word_graphs.nodes_of(e).withColumn("free", free).drop("rec")


def forward_edges(edges: DataFrame) -> DataFrame:
    """(node, n): edges of each node from its first, none where that is free or leads backward."""
    first = F.min_by(~F.col("free") & ~F.col("backward"), "edge")
    return edges.groupBy("node").agg(F.when(first, F.count("*")).otherwise(0).alias("n"))


def in_graph(words: DataFrame, edges: DataFrame, prefix: bool = False) -> DataFrame:
    """words(word_id, letters) with found: whether they (prefix: their beginnings) are paths of the graph."""
    return word_graphs.walked(words, edges, prefix)


def page_text(lines: DataFrame) -> DataFrame:
    """(page_id, text): words by spaces, lines by line ends; a page is one row in the result as well."""
    joined = lines.select("page_id", F.struct("line_id", F.array_join("words", " ").alias("t")).alias("l"))
    return joined.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["t"]), "\n").alias("text"))
