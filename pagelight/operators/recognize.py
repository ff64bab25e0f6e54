"""Line recognition and the page pipeline: rasters in, page results out.

Pages are cut into tiles (`tiles`), a page's layout is DataFrame work, and lines, not pages, are dealt over the tasks for the network, each as its
crop. Every stage that several others read is written once (`stages`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelight.functions import scalar
from pagelight.operators import decode, layout, network, pages, render, tiles
from pagelight.operators.stages import Stages


def code_ids(model) -> dict[int, int] | None:
    """The character of each code that is one by itself; None where codes are characters."""
    return None if model.codes is None else {codes[0]: i for i, _, codes in model.codes if len(codes) == 1 and codes[0] >= 0}


def read_line(model, table: dict[int, int] | None, w: int, h: int, data: bytes, width: int = 10, top: int = 5) -> tuple[str, list[float], list[int]]:
    """(text, confidences, timesteps) of one crop; table is `code_ids` of the model."""
    x = pages.rescaled(np.frombuffer(data, np.uint8).reshape(h, w), model.inputs)
    if not x.size:
        return "", [], []
    out = network.forward(model.network, x[:, :, None])
    codes, score = decode.beam(out.reshape(-1, out.shape[2]).tolist(), model.null_code, width, top)
    if not codes:  # a blank line
        return "", [], []
    ids = codes if table is None else [table.get(c, decode.INVALID) for c in codes]
    names = model.characters
    # the search keeps a score for the whole line only, and no places
    return "".join(names[i][1] for i in ids if i < len(names)), [score / len(codes)] * len(codes), [0] * len(codes)


def recognize_lines(crops: DataFrame, model, width: int = 10, top: int = 5) -> DataFrame:
    """crops(page_id, line_no, width, height, data) to (page_id, line_no, text, confidences, timesteps). The model, bounded in
    size, is broadcast; an empty crop and a blank line give an empty text without confidences."""
    shared = crops.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        table = code_ids(m)
        for b in batches:
            found = [read_line(m, table, w, h, d, width, top) for w, h, d in zip(*(b.column(c).to_pylist() for c in ("width", "height", "data")))]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.list_(pa.float32())), pa.array([f[2] for f in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("line_no"), *columns], ["page_id", "line_no", "text", "confidences", "timesteps"])

    return crops.select("page_id", "line_no", "width", "height", "data").mapInArrow(run, "page_id long, line_no int, text string, confidences array<float>, timesteps array<int>")


def register(spark: SparkSession, model, name: str = "recognize_line") -> None:
    """A table function for SQL: `FROM crops, LATERAL recognize_line(width, height, data)` gives each crop its text, confidences and timesteps."""
    shared = spark.sparkContext.broadcast(model)

    @F.udtf(returnType="text string, confidences array<float>, timesteps array<int>")
    class RecognizeLine:
        def __init__(self) -> None:
            self.model = shared.value
            self.table = code_ids(self.model)

        def eval(self, width: int, height: int, data: bytes):
            yield read_line(self.model, self.table, width, height, data)

    spark.udtf.register(name, RecognizeLine)


def recognize(rasters: DataFrame, model, size: int = tiles.SIZE) -> DataFrame:
    """rasters(page_id, width, height, channels, data) to page results (page_id, page_width, page_height, blocks), written. Crops are taken from
    the gray page as it was; boxes are those of the page turned upright. The rasters are read once."""
    spark = rasters.sparkSession
    with Stages(spark, "pages") as run:
        gray = run.write(tiles.cut(pages.gray_rasters(rasters), size), "gray")
        black = run.write(tiles.binarized(gray, pages.otsu_of(tiles.histogram(gray, size))), "black")
        turns = tiles.skew(black, size).withColumn("degrees", -F.col("degrees"))
        upright = run.write(tiles.rotated(black, turns, size), "upright")
        lined = run.write(layout.detect_lines(layout.text_blobs(run.write(tiles.components(run, upright, size), "components"))), "lined")
        lines = run.write(layout.detect_columns(layout.line_boxes(lined)), "lines")
        boxes = layout.block_boxes(lines).select("page_id", "block_no", F.col("x_min").alias("bx"), F.col("x_max").alias("br"), F.col("y_min").alias("by"), F.col("y_max").alias("bb"))
        lines = run.write(lines.join(boxes, ["page_id", "block_no"]).join(layout.baselines(lined, "line_no"), ["page_id", "line_no"]), "boxes")
        crops = tiles.cropped(gray, lines.select("page_id", "line_no", F.col("bx").alias("x"), F.col("y_min").alias("y"), F.col("br").alias("right"), F.col("y_max").alias("bottom")), size)
        read = recognize_lines(crops, model)
        words = layout.words(lined, "line_no").groupBy("page_id", "line_no").agg(F.array_sort(F.collect_list(F.struct("word_id", scalar.box(F.col("x"), F.col("y"), F.col("right"), F.col("bottom")).alias("b")))).alias("w"))
        words = words.select("page_id", "line_no", F.transform("w", lambda x: x["b"]).alias("boxes"))
        found = lines.join(read, ["page_id", "line_no"]).join(words, ["page_id", "line_no"])
        found = found.select(
            "page_id", "block_no", "line_no", scalar.box(F.col("bx"), F.col("by"), F.col("br"), F.col("bb")).alias("block_box"), scalar.box(F.col("bx"), F.col("y_min"), F.col("br"), F.col("y_max")).alias("bbox"),
            F.col("slope").cast("float").alias("baseline_slope"), F.col("intercept").cast("float").alias("baseline_intercept"), decode.aligned(F.col("text"), decode.probability(F.col("confidences")), F.col("boxes")).alias("words"),
        )
        sizes = tiles.sizes(gray).select("page_id", F.col("width").alias("page_width"), F.col("height").alias("page_height"))
        return Stages(spark, "results").write(render.assembled(found, sizes), "pages")
