"""Page stage: histograms, Otsu's threshold, binarization, projection profiles, skew, rotation and network inputs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelight.functions import scalar


def histogram(pixels: DataFrame) -> DataFrame:
    """(page_id, px, n): counts of gray levels that occur."""
    return pixels.groupBy("page_id", "px").agg(F.count("*").alias("n"))


def otsu(pixels: DataFrame) -> DataFrame:
    """(page_id, threshold): the first level of largest between-class variance, as a whole number; 0 for a uniform page."""
    return otsu_of(histogram(pixels))


def otsu_of(h: DataFrame) -> DataFrame:
    """`otsu` of histograms. They have at most 256 rows a page, so the windows are small."""
    w = Window.partitionBy("page_id")
    run = w.orderBy("px").rowsBetween(Window.unboundedPreceding, 0)
    c = h.select(
        "page_id", "px", F.sum("n").over(run).alias("wb"), F.sum(F.col("n") * F.col("px")).over(run).alias("sb"),
        F.sum("n").over(w).alias("total"), F.sum(F.col("n") * F.col("px")).over(w).alias("sum"),
    )
    exact = lambda x: x.cast("decimal(19,0)")
    between = exact(F.col("sb") * F.col("total") - F.col("sum") * F.col("wb"))
    top, under = between * between, exact(F.col("wb")) * exact(F.col("total") - F.col("wb"))
    c = c.withColumn("v", F.when(F.col("wb") < F.col("total"), (top - top % under) / under))  # a whole number: the remainder goes before the division
    best = F.min_by("px", F.when(F.col("v") > 0, F.struct(-F.col("v"), F.col("px"))))  # levels without a score don't count
    return c.groupBy("page_id").agg(F.coalesce(best, F.lit(0)).cast("int").alias("threshold"))


def binarize(pixels: DataFrame) -> DataFrame:
    return pixels.join(otsu(pixels), "page_id").select("page_id", "y", "x", scalar.binarize(F.col("px"), F.col("threshold")).alias("px"))


def profile(pixels: DataFrame, dark: int = 128) -> DataFrame:
    """(page_id, y, n): dark pixels of every row, rows without any included."""
    return pixels.groupBy("page_id", "y").agg(F.count(F.when(F.col("px") < dark, 1)).alias("n"))


def sharpness(pixels: DataFrame, dark: int = 128) -> DataFrame:
    """(page_id, score): the sum of squared differences of neighbouring rows of the profile."""
    d = F.col("n") - F.lag("n").over(Window.partitionBy("page_id").orderBy("y"))
    return profile(pixels, dark).select("page_id", (d * d).alias("d")).groupBy("page_id").agg(F.coalesce(F.sum("d"), F.lit(0)).alias("score"))


def runs(pixels: DataFrame) -> DataFrame:
    """(page_id, y, x0, x1): maximal horizontal runs of black pixels, by gaps and islands."""
    black = pixels.where("px = 0").withColumn("g", F.col("x") - F.row_number().over(Window.partitionBy("page_id", "y").orderBy("x")))
    return black.groupBy("page_id", "y", "g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("g")


def maxpool(pixels: DataFrame, sx: int, sy: int) -> DataFrame:
    """(page_id, y, x, px): the largest value of each cell; cells at the border may be smaller."""
    return pixels.groupBy("page_id", F.floor(F.col("y") / sy).cast("int").alias("y"), F.floor(F.col("x") / sx).cast("int").alias("x")).agg(F.max("px").alias("px"))


# --- skew -------------------------------------------------------------------------------------------

#: Candidate angles in degrees, lowest first, and the rows at most that a profile has.
ANGLES, PROFILE_ROWS = [k * 0.25 for k in range(-20, 21)], 4096


def angle_table() -> list[tuple[float, float, float]]:
    """(degrees, sine, cosine) of the candidates in single precision."""
    out = []
    for degrees in ANGLES:
        turn = np.float32(degrees) * np.float32(np.pi / 180.0)
        out.append((degrees, float(np.float32(np.sin(float(turn)))), float(np.float32(np.cos(float(turn))))))
    return out


def skew_scores(pixels: DataFrame, dark: int = 128) -> DataFrame:
    """pixels(page_id, y, x, px, width, height) to (page_id, degrees, score): how sharply the profile of dark pixels rises
    and falls between neighbouring rows when the page is turned by each candidate angle.

    Dark pixels are counted by row and angle where they are read, so the shuffle carries rows of profiles, not pixels. Empty
    rows add nothing to the sums of squares and products that the score consists of, so they needn't exist.
    """
    single = lambda x: F.lit(x).cast("float")
    angles = F.array(*[F.struct(F.lit(d).alias("degrees"), single(s).alias("s"), single(c).alias("c")) for d, s, c in angle_table()])
    centre = lambda size: size.cast("float") / single(2.0)
    cx, cy = (centre(F.col(c)).cast("float") for c in ("width", "height"))
    p = pixels.where((F.col("px") < dark) & (F.col("width") >= 10) & (F.col("height") >= 10))
    p = p.select("page_id", "height", (F.col("x").cast("float") - cx).alias("fx"), (F.col("y").cast("float") - cy).alias("fy"), cy.alias("cy"), F.explode(angles).alias("a"))
    turned = (-F.col("a.s") * F.col("fx") + F.col("a.c") * F.col("fy") + F.col("cy")).cast("double")
    row = (F.signum(turned) * F.floor(F.abs(turned) + 0.5)).cast("int")
    rows = F.least("height", F.lit(PROFILE_ROWS))
    counted = p.select("page_id", "a.degrees", row.alias("row"), rows.alias("rows")).where("row >= 0 and row < rows").groupBy("page_id", "degrees", "row").agg(F.count("*").alias("n"), F.first("rows").alias("rows"))
    return profile_scores(counted)


def profile_scores(counted: DataFrame) -> DataFrame:
    """counted(page_id, degrees, row, n, rows), rows that have dark pixels, to (page_id, degrees, score)."""
    w = Window.partitionBy("page_id", "degrees").orderBy("row")
    above = F.when(F.lag("row").over(w) == F.col("row") - 1, F.lag("n").over(w)).otherwise(0)
    n = F.col("n")
    ends = F.when(F.col("row") == 0, 1).otherwise(0) + F.when(F.col("row") == F.col("rows") - 1, 1).otherwise(0)
    part = (F.lit(2) - ends) * n * n - 2 * n * above
    return counted.select("page_id", "degrees", part.alias("part")).groupBy("page_id", "degrees").agg(F.sum("part").alias("score"))


def detect_skew(pixels: DataFrame, dark: int = 128) -> DataFrame:
    """(page_id, degrees): the first angle of the highest score; 0 where no page turns sharper than nothing."""
    return sharpest(pixels.select("page_id").distinct(), skew_scores(pixels, dark))


def sharpest(named: DataFrame, scores: DataFrame) -> DataFrame:
    """(page_id, degrees) of the pages named: the first angle of the highest score."""
    best = scores.where("score > 0").groupBy("page_id").agg(F.min_by("degrees", F.struct(-F.col("score"), F.col("degrees"))).alias("degrees"))
    return named.join(best, "page_id", "left").select("page_id", F.coalesce("degrees", F.lit(0.0)).alias("degrees"))


# --- resampling: a row is a page (page_id, width, height, data), gray, row-major -------------------------


def _bilinear(image: np.ndarray, sx: np.ndarray, sy: np.ndarray, page: tuple[int, int] | None = None, at: tuple[int, int] = (0, 0)) -> np.ndarray:
    """Values between pixels at (sx, sy), which lie within the page, in single precision; the image is the part of a page of that height and width that begins at (y, x)."""
    h, w = page or image.shape
    x0, y0 = np.floor(sx).astype(np.int64), np.floor(sy).astype(np.int64)
    x1, y1 = np.minimum(x0 + 1, w - 1) - at[1], np.minimum(y0 + 1, h - 1) - at[0]
    dx, dy = sx - x0.astype(np.float32), sy - y0.astype(np.float32)
    x0, y0 = x0 - at[1], y0 - at[0]
    p, one = image.astype(np.float32), np.float32(1)
    return p[y0, x0] * (one - dx) * (one - dy) + p[y0, x1] * dx * (one - dy) + p[y1, x0] * (one - dx) * dy + p[y1, x1] * dx * dy


def _sources(w: int, h: int, degrees: float, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) on a page of w x h that the places rows x columns come from when it is turned about its centre."""
    turn = np.float32(degrees) * np.float32(np.pi / 180.0)
    c, s = np.float32(np.cos(float(turn))), np.float32(np.sin(float(turn)))
    cx, cy = np.float32(w) / np.float32(2), np.float32(h) / np.float32(2)
    fy, fx = np.meshgrid(rows.astype(np.float32) - cy, columns.astype(np.float32) - cx, indexing="ij")
    return c * fx + s * fy + cx, -s * fx + c * fy + cy


def source_box(w: int, h: int, degrees: float, y0: int, y1: int, x0: int, x1: int) -> tuple[int, int, int, int]:
    """(y0, y1, x0, x1), inclusive and within the page, that the places of a box come from, with a pixel to spare."""
    sx, sy = _sources(w, h, degrees, np.array([y0, y1]), np.array([x0, x1]))
    inside = lambda v, n: max(0, min(int(v), n - 1))
    return inside(np.floor(sy.min()) - 1, h), inside(np.floor(sy.max()) + 2, h), inside(np.floor(sx.min()) - 1, w), inside(np.floor(sx.max()) + 2, w)


def turned_part(part: np.ndarray, top: int, left: int, w: int, h: int, degrees: float, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The places rows x columns of a turned page, from the part of it at (top, left); white comes in from outside."""
    if not degrees:
        return part[rows[0] - top : rows[-1] - top + 1, columns[0] - left : columns[-1] - left + 1]
    sx, sy = _sources(w, h, degrees, rows, columns)
    out = np.full(sx.shape, 255, np.uint8)
    inside = (sx >= 0) & (sy >= 0) & (sx < w) & (sy < h)
    if inside.any():
        out[inside] = np.floor(np.clip(_bilinear(part, sx[inside], sy[inside], (h, w), (top, left)), 0, 255) + np.float32(0.5)).astype(np.uint8)
    return out


def rotated(image: np.ndarray, degrees: float) -> np.ndarray:
    """The image turned about its centre, of the same size; white comes in from outside."""
    h, w = image.shape
    return turned_part(image, 0, 0, w, h, degrees, np.arange(h), np.arange(w)) if image.size else image


def rescaled(image: np.ndarray, height: int) -> np.ndarray:
    """The image as network input of that height: same proportions, contrast stretched to -1 to 1. Empty if a side is 0."""
    h, w = image.shape
    width = (w * height + h // 2) // h if w and h and height else 0
    if not width:
        return np.zeros((0, 0), np.float32)
    axis = lambda n, m: np.arange(n, dtype=np.float32) * np.float32(m - 1) / np.float32(n - 1) if n > 1 else np.array([(m - 1) * 0.5], np.float32)
    sy, sx = np.meshgrid(axis(height, h), axis(width, w), indexing="ij")
    black, white = np.float32(image.min()), np.float32(image.max())
    contrast = (white - black) / np.float32(2) or np.float32(1)
    return (_bilinear(image, sx, sy) - black) / contrast - np.float32(1)


def rotate(rasters: DataFrame, degrees: str = "degrees") -> DataFrame:
    """rasters(page_id, width, height, data, degrees) to the same, turned; angle 0 leaves a page as it is."""

    def run(batches):
        for b in batches:
            out = []
            for w, h, data, turn in zip(*(b.column(c).to_pylist() for c in ("width", "height", "data", degrees))):
                out.append(data if not turn else rotated(np.frombuffer(data, np.uint8).reshape(h, w), turn).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("width"), b.column("height"), pa.array(out, pa.binary())], ["page_id", "width", "height", "data"])

    return rasters.select("page_id", "width", "height", "data", degrees).mapInArrow(run, "page_id long, width int, height int, data binary")


def deskew(rasters: DataFrame) -> DataFrame:
    """Each gray raster turned back by the skew found in it."""
    found = detect_skew(exploded(rasters))
    return rotate(rasters.join(found, "page_id").withColumn("degrees", -F.col("degrees")))


def prepare(rasters: DataFrame, height: int) -> DataFrame:
    """(page_id, rows, columns, values): network inputs, row-major."""

    def run(batches):
        for b in batches:
            made = [rescaled(np.frombuffer(d, np.uint8).reshape(h, w), height) for w, h, d in zip(*(b.column(c).to_pylist() for c in ("width", "height", "data")))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array([m.shape[0] for m in made], pa.int32()), pa.array([m.shape[1] for m in made], pa.int32()), pa.array([m.ravel() for m in made], pa.list_(pa.float32()))], ["page_id", "rows", "columns", "values"])

    return rasters.select("page_id", "width", "height", "data").mapInArrow(run, "page_id long, rows int, columns int, values array<float>")


def exploded(rasters: DataFrame) -> DataFrame:
    """Gray rasters to pixels(page_id, y, x, px, width, height)."""

    def run(batches):
        for b in batches:
            for i, w, h, data in zip(*(b.column(c).to_pylist() for c in ("page_id", "width", "height", "data"))):
                at, n = np.arange(w * h, dtype=np.int32), w * h
                columns = [np.full(n, i, np.int64), at // max(w, 1), at % max(w, 1), np.frombuffer(data, np.uint8).astype(np.int32), np.full(n, w, np.int32), np.full(n, h, np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["page_id", "y", "x", "px", "width", "height"])

    return rasters.select("page_id", "width", "height", "data").mapInArrow(run, "page_id long, y int, x int, px int, width int, height int")


def gathered(pixels: DataFrame) -> DataFrame:
    """pixels(page_id, y, x, px, width, height), each once, to rasters: one row for each page, missing pixels white."""

    def run(t: pa.Table) -> pa.Table:
        w, h = t.column("width")[0].as_py(), t.column("height")[0].as_py()
        image = np.full((h, w), 255, np.uint8)
        image[t.column("y").to_numpy(), t.column("x").to_numpy()] = t.column("px").to_numpy()
        return pa.table({"page_id": t.column("page_id").slice(0, 1).cast(pa.int64()), "width": pa.array([w], pa.int32()), "height": pa.array([h], pa.int32()), "data": pa.array([image.tobytes()], pa.binary())})

    return pixels.select("page_id", "y", "x", "px", "width", "height").groupBy("page_id").applyInArrow(run, "page_id long, width int, height int, data binary")


def gray_rasters(rasters: DataFrame) -> DataFrame:
    """rasters(page_id, width, height, channels, data) of 1, 3 or 4 channels to one channel; alpha is ignored. Others raise."""

    def run(batches):
        for b in batches:
            out = []
            for w, h, n, data in zip(*(b.column(c).to_pylist() for c in ("width", "height", "channels", "data"))):
                if n == 1:
                    out.append(data)
                    continue
                if n not in (3, 4):
                    raise ValueError(f"{n} channels")
                p = np.frombuffer(data, np.uint8).reshape(-1, n).astype(np.float32)
                luma = np.float32(0.299) * p[:, 0] + np.float32(0.587) * p[:, 1] + np.float32(0.114) * p[:, 2]
                out.append(np.floor(np.clip(luma.astype(np.float64), 0, 255) + 0.5).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("width"), b.column("height"), pa.array(out, pa.binary())], ["page_id", "width", "height", "data"])

    return rasters.select("page_id", "width", "height", "channels", "data").mapInArrow(run, "page_id long, width int, height int, data binary")
