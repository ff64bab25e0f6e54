"""Inputs derived from the driver's tables: rasters, glyph boxes, softmax frames, page texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelight.functions import scalar, vectors
from pagelight.operators import layout, pages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Vectors of one page or line: a page is a block of ids, so that no label, however frequent, is one task.
PAGE, LINE = 64, 32


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pixels(page_id, y, x, px, width, height): a page for each block of ids, a row for each vector; no shuffle."""
    e = table(spark, sf_dir, "embeddings").where("vec_id is not null")
    page, y = F.floor(F.col("vec_id") / PAGE).cast("long"), F.pmod("vec_id", F.lit(PAGE)).cast("int")
    rows = e.select(page.alias("page_id"), y.alias("y"), F.size("embedding").alias("width"), F.posexplode("embedding").alias("x", "v"))
    px = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("v").cast("double") + 0.6) * 200))).cast("int")
    return rows.select("page_id", "y", "x", px.alias("px"), "width", F.lit(PAGE).alias("height"))


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages, one row each."""
    return pages.gathered(raster(spark, sf_dir))


#: The height of each character's box by code point, that of all others last, and the characters of few pixels.
_HEIGHTS = np.array([3 if chr(c) in ".," else 6 if chr(c) in "-'\"" else 14 + c % 5 for c in range(128)] + [60], np.int32)
_FAINT = np.array([chr(c) in "#%*" for c in range(128)] + [False])
#: Characters that are boxes at a time, whole pages aside.
CHARACTERS = 1 << 18

GLYPHS = "page_id long, line_id int, seq int, x int, y int, w int, h int, pixel_count int"


def glyphs_of(documents: pa.Table) -> pa.Table:
    """The boxes of documents(page_id, text in UTF-8), those of a line one after the other, also where several documents are one page."""
    texts = [(t or b"").decode("utf-8", "replace") for t in documents.column("text").to_pylist()]
    n = np.array([len(t) for t in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    document, at, first = np.repeat(np.arange(len(n)), n), np.arange(len(code)), np.cumsum(n) - n
    ends = code == 10
    opens = np.append(True, ends[:-1])[: len(code)]
    opens[first[n > 0]] = True
    number = np.cumsum(ends) - ends
    number -= number[first[document]]
    seq = at - np.maximum.accumulate(np.where(opens, at, 0))
    box = np.flatnonzero((code != 32) & ~ends)
    kind, line, seq = np.minimum(code[box], 128), number[box].astype(np.int32), seq[box].astype(np.int32)
    h, w = _HEIGHTS[kind], np.full(len(box), 10, np.int32)
    ids = documents.column("page_id")
    t = pa.table({"page_id": ids.to_numpy()[document[box]], "line_id": line, "seq": seq, "x": seq * 12, "y": line * 40, "w": w, "h": h, "pixel_count": np.where(_FAINT[kind], 5, w * h).astype(np.int32)})
    return t if len(layout.group_starts(documents, ["page_id"])) == len(ids) else t.sort_by([("page_id", "ascending"), ("line_id", "ascending")])


def _glyph_tables(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The boxes of whole pages, of some pages at a time, from their documents in the order of pages."""
    for b in layout.adjacent(batches, ["page_id"], lambda t: t, 1):
        page = layout.group_starts(b, ["page_id"])
        before = np.cumsum(pc.binary_length(b.column("text")).fill_null(0).to_numpy().astype(np.int64))
        share = np.append(0, before)[page] // CHARACTERS
        cuts = page[np.append(True, share[1:] != share[:-1])].tolist()
        for start, end in zip(cuts, [*cuts[1:], b.num_rows]):
            yield glyphs_of(b.slice(start, end - start))


def of_glyphs(spark: SparkSession, sf_dir: str, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """What run makes of the glyphs of whole pages, in the task that has their texts: texts are shuffled, glyphs are neither shuffled nor sorted."""
    d = table(spark, sf_dir, "documents").where("doc_id is not null").select(F.col("doc_id").cast("long").alias("page_id"), F.col("text").cast("binary").alias("text"))
    near = d.repartition("page_id").sortWithinPartitions("page_id")
    return layout.in_tasks(near, lambda batches: map(run, _glyph_tables(batches)), schema)


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """components(page_id, line_id, seq, x, y, w, h, pixel_count): a box for each character of every line."""
    return of_glyphs(spark, sf_dir, lambda t: t, GLYPHS)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, t, logits): the vectors of a block of ids in order; no shuffle."""
    e = table(spark, sf_dir, "embeddings").where("vec_id is not null and embedding is not null")
    line, t = F.floor(F.col("vec_id") / LINE).cast("long"), F.pmod("vec_id", F.lit(LINE)).cast("int")
    return e.select(line.alias("line_id"), t.alias("t"), F.transform("embedding", lambda x: x.cast("double")).alias("logits"))


def softmax_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, t, probs)."""
    return frames(spark, sf_dir).select("line_id", "t", vectors.softmax(F.col("logits")).alias("probs"))


def weight_rows(spark: SparkSession, sf_dir: str, rows: int = 10) -> list[list[float]]:
    """A matrix of 63 weights and a bias in each of a few rows: a model's parameters, not data."""
    e = table(spark, sf_dir, "embeddings").where(F.col("vec_id") < rows).orderBy("vec_id").limit(rows)
    return [[float(x) for x in r["embedding"]] for r in e.collect()]


def page_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, page_width, page_height, blocks): a conversation as a page of one block, its turns as lines, boxes from places and lengths."""
    c = page_words(spark, sf_dir)
    size = lambda x: F.length(x) * 10
    word = lambda w, i: F.struct(w.alias("text"), F.lit(0.75).cast("float").alias("confidence"), scalar.box(i * 100, F.col("line_id").cast("int") * 40, i * 100 + size(w), F.col("line_id").cast("int") * 40 + 20).alias("bbox"))
    y = F.col("line_id").cast("int") * 40
    line = F.struct(scalar.box(F.lit(0), y, F.lit(1000), y + 20).alias("bbox"), F.lit(0.0).cast("float").alias("baseline_slope"), (y + 20).cast("float").alias("baseline_intercept"), F.transform("words", word).alias("words"))
    lines = c.select("page_id", F.struct("line_id", F.array_join("words", " ").alias("key"), line.alias("line")).alias("l"))
    pages_ = lines.groupBy("page_id").agg(F.array_sort(F.collect_list("l")).alias("l"))
    block = F.struct(scalar.box(F.lit(0), F.lit(0), F.lit(1000), F.size("l") * 40).alias("bbox"), F.transform("l", lambda x: x["line"]).alias("lines"))
    return pages_.select("page_id", F.lit(1000).alias("page_width"), (F.size("l") * 40).alias("page_height"), F.array(block).alias("blocks"))


def page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, line_id, words): a conversation's turns as the lines of a page."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("page_id"), F.col("turn").alias("line_id"), scalar.split_spaces(F.col("text")).alias("words"))
