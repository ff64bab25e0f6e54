"""Pages as tiles: tiles(page_id, ty, tx, width, height, data), one row each, gray, row-major. width and height are the page's; a
tile covers ``size`` pixels each way from (tx * size, ty * size) that the page has, and one more pixel to the right and below where there
is any, so that each pair of touching pixels lies in some tile. `size` goes with the table as a parameter.

All of the page stage works on tiles: counts are made in a tile and summed for the page, turning and cutting join each output with
the few tiles under it, and components are labelled in a tile and linked over the shared pixels. No page has to fit a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelight.operators import links, pages
from pagelight.operators.blobs import least_labels
from pagelight.operators.stages import Stages

SIZE = 1024
_FIELDS = "page_id long, ty int, tx int, width int, height int, data binary"
_NAMES = ["page_id", "ty", "tx", "width", "height", "data"]


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)


def _image(ty: int, tx: int, width: int, height: int, data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(min(size + 1, height - ty * size), min(size + 1, width - tx * size))


def _own(image: np.ndarray, size: int) -> np.ndarray:
    """A tile without the pixels that it shares with the next ones."""
    return image[:size, :size]


def cut(rasters: DataFrame, size: int = SIZE) -> DataFrame:
    """Gray rasters (page_id, width, height, data) to tiles. A page without pixels has one, which is empty."""

    def run(batches):
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        for b in batches:
            for i, w, h, data in zip(*(b.column(c).to_pylist() for c in ("page_id", "width", "height", "data"))):
                image = np.frombuffer(data, np.uint8).reshape(h, w)
                rows = [(i, y // size, x // size, w, h, image[y : y + size + 1, x : x + size + 1].tobytes()) for y in range(0, max(h, 1), size) for x in range(0, max(w, 1), size)]
                yield _batch(rows, kinds, _NAMES)

    return rasters.select("page_id", "width", "height", "data").mapInArrow(run, _FIELDS)


def whole(tiles: DataFrame, size: int = SIZE) -> DataFrame:
    """Rasters again, for pages that fit a row."""

    def run(t: pa.Table) -> pa.Table:
        w, h = t.column("width")[0].as_py(), t.column("height")[0].as_py()
        image = np.full((h, w), 255, np.uint8)
        for ty, tx, data in zip(*(t.column(c).to_pylist() for c in ("ty", "tx", "data"))):
            own = _own(_image(ty, tx, w, h, data, size), size)
            image[ty * size : ty * size + own.shape[0], tx * size : tx * size + own.shape[1]] = own
        return pa.table({"page_id": t.column("page_id").slice(0, 1), "width": pa.array([w], pa.int32()), "height": pa.array([h], pa.int32()), "data": pa.array([image.tobytes()], pa.binary())})

    return tiles.select(*_NAMES).groupBy("page_id").applyInArrow(run, "page_id long, width int, height int, data binary")


# --- counts ---------------------------------------------------------------------------------------


def histogram(tiles: DataFrame, size: int = SIZE) -> DataFrame:
    """(page_id, px, n); a tile's own pixels are counted where it is read."""

    def run(batches):
        for b in batches:
            rows = []
            for i, ty, tx, w, h, data in zip(*(b.column(c).to_pylist() for c in _NAMES)):
                n = np.bincount(_own(_image(ty, tx, w, h, data, size), size).ravel(), minlength=256)
                rows += [(i, int(v), int(n[v])) for v in np.flatnonzero(n)]
            yield _batch(rows, [pa.int64(), pa.int32(), pa.int64()], ["page_id", "px", "n"])

    return tiles.select(*_NAMES).mapInArrow(run, "page_id long, px int, n long").groupBy("page_id", "px").agg(F.sum("n").alias("n"))


def binarized(tiles: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Black (0) up to the page's threshold(page_id, threshold), white (255) above."""

    def run(batches):
        for b in batches:
            out = [np.where(np.frombuffer(d, np.uint8) > t, np.uint8(255), np.uint8(0)).tobytes() for d, t in zip(b.column("data").to_pylist(), b.column("threshold").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in _NAMES[:-1]), pa.array(out, pa.binary())], _NAMES)

    return tiles.join(thresholds, "page_id", "left").select(*_NAMES, F.coalesce("threshold", F.lit(0)).alias("threshold")).mapInArrow(run, _FIELDS)


def skew(tiles: DataFrame, size: int = SIZE, dark: int = 128) -> DataFrame:
    """(page_id, degrees), as `pages.detect_skew`: a tile gives its part of the profile for each angle."""
    angles = pages.angle_table()

    def run(batches):
        for b in batches:
            rows = []
            for i, ty, tx, w, h, data in zip(*(b.column(c).to_pylist() for c in _NAMES)):
                if w < 10 or h < 10:
                    continue
                y, x = np.nonzero(_own(_image(ty, tx, w, h, data, size), size) < dark)
                fx = (x + tx * size).astype(np.float32) - np.float32(w) / np.float32(2)
                fy = (y + ty * size).astype(np.float32) - np.float32(h) / np.float32(2)
                for degrees, s, c in angles:
                    turned = (-np.float32(s) * fx + np.float32(c) * fy + np.float32(h) / np.float32(2)).astype(np.float64)
                    row = (np.sign(turned) * np.floor(np.abs(turned) + 0.5)).astype(np.int64)
                    n = np.bincount(row[(row >= 0) & (row < min(h, pages.PROFILE_ROWS))])
                    rows += [(i, degrees, int(r), int(n[r]), min(h, pages.PROFILE_ROWS)) for r in np.flatnonzero(n)]
            yield _batch(rows, [pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int32()], ["page_id", "degrees", "row", "n", "rows"])

    counted = tiles.select(*_NAMES).mapInArrow(run, "page_id long, degrees double, row int, n long, rows int")
    counted = counted.groupBy("page_id", "degrees", "row").agg(F.sum("n").alias("n"), F.first("rows").alias("rows"))
    return pages.sharpest(tiles.select("page_id").distinct(), pages.profile_scores(counted))


# --- turning and cutting ------------------------------------------------------------------------------


def _under(wanted: DataFrame, tiles: DataFrame, size: int) -> DataFrame:
    """wanted(page_id, ..., y0, y1, x0, x1), inclusive and within the page, joined with the tiles whose own pixels these are."""
    span = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / size).cast("int"), F.floor(F.col(high) / size).cast("int")))
    keys = wanted.select("*", span("y0", "y1").alias("ty")).select("*", span("x0", "x1").alias("tx"))
    held = tiles.select("page_id", "ty", "tx", "data", F.col("width").alias("_w"), F.col("height").alias("_h"))
    return keys.join(held, ["page_id", "ty", "tx"])


def _window(t: pa.Table, size: int) -> np.ndarray:
    """The pixels [y0, y1] x [x0, x1] of one group of `_under`."""
    y0, y1, x0, x1, w, h = (t.column(c)[0].as_py() for c in ("y0", "y1", "x0", "x1", "_w", "_h"))
    out = np.full((y1 - y0 + 1, x1 - x0 + 1), 255, np.uint8)
    for ty, tx, data in zip(*(t.column(c).to_pylist() for c in ("ty", "tx", "data"))):
        own = _own(_image(ty, tx, w, h, data, size), size)
        top, left = ty * size, tx * size
        a, b, c, d = max(top, y0), min(top + own.shape[0], y1 + 1), max(left, x0), min(left + own.shape[1], x1 + 1)
        out[a - y0 : b - y0, c - x0 : d - x0] = own[a - top : b - top, c - left : d - left]
    return out


def rotated(tiles: DataFrame, turns: DataFrame, size: int = SIZE) -> DataFrame:
    """Tiles of the pages turned about their centres by turns(page_id, degrees), as `pages.rotated`; pages without a turn stay. Each tile of the
    result is made from the tiles under it."""
    turned = tiles.select("page_id", "ty", "tx", "width", "height").join(turns, "page_id", "left").withColumn("degrees", F.coalesce("degrees", F.lit(0.0)))

    def reach(batches):
        names = ["page_id", "oy", "ox", "width", "height", "degrees", "y0", "y1", "x0", "x1"]
        kinds = [pa.int64(), *[pa.int32()] * 4, pa.float64(), *[pa.int32()] * 4]
        for b in batches:
            rows = []
            for i, ty, tx, w, h, degrees in zip(*(b.column(c).to_pylist() for c in ("page_id", "ty", "tx", "width", "height", "degrees"))):
                if not w * h:
                    continue
                box = pages.source_box(w, h, degrees, ty * size, min((ty + 1) * size, h - 1), tx * size, min((tx + 1) * size, w - 1))
                rows.append((i, ty, tx, w, h, degrees, *(int(v) for v in box)))
            yield _batch(rows, kinds, names)

    wanted = turned.select("page_id", "ty", "tx", "width", "height", "degrees").mapInArrow(reach, "page_id long, oy int, ox int, width int, height int, degrees double, y0 int, y1 int, x0 int, x1 int")

    def make(t: pa.Table) -> pa.Table:
        i, oy, ox, w, h, degrees, y0, x0 = (t.column(c)[0].as_py() for c in ("page_id", "oy", "ox", "width", "height", "degrees", "y0", "x0"))
        rows, columns = np.arange(oy * size, min((oy + 1) * size + 1, h)), np.arange(ox * size, min((ox + 1) * size + 1, w))
        out = pages.turned_part(_window(t, size), y0, x0, w, h, degrees, rows, columns)
        return pa.table({"page_id": pa.array([i], pa.int64()), "ty": pa.array([oy], pa.int32()), "tx": pa.array([ox], pa.int32()), "width": pa.array([w], pa.int32()), "height": pa.array([h], pa.int32()), "data": pa.array([out.tobytes()], pa.binary())})

    return _under(wanted, tiles, size).groupBy("page_id", "oy", "ox").applyInArrow(make, _FIELDS)


def sizes(tiles: DataFrame) -> DataFrame:
    """(page_id, width, height)."""
    return tiles.where("ty = 0 and tx = 0").select("page_id", "width", "height")


def cropped(tiles: DataFrame, lines: DataFrame, size: int = SIZE) -> DataFrame:
    """lines(page_id, line_no, x, y, right, bottom) to crops(page_id, line_no, width, height, data) of one pixel at least, white beyond the page; each from the tiles
    under it."""
    inside = lambda low, most: F.greatest(F.lit(0), F.least(low, most - 1))
    c = F.col
    wide, tall = F.greatest(c("right") - c("x"), F.lit(1)).cast("int"), F.greatest(c("bottom") - c("y"), F.lit(1)).cast("int")
    wanted = lines.join(sizes(tiles), "page_id").select(
        "page_id", "line_no", c("x").cast("int").alias("left"), c("y").cast("int").alias("top"), wide.alias("wide"), tall.alias("tall"), inside(c("y"), c("height")).cast("int").alias("y0"), inside(c("y") + tall - 1, c("height")).cast("int").alias("y1"),
        inside(c("x"), c("width")).cast("int").alias("x0"), inside(c("x") + wide - 1, c("width")).cast("int").alias("x1"),
    )

    def make(t: pa.Table) -> pa.Table:
        i, line, left, top, wide, tall, y0, x0 = (t.column(k)[0].as_py() for k in ("page_id", "line_no", "left", "top", "wide", "tall", "y0", "x0"))
        part, out = _window(t, size), np.full((tall, wide), 255, np.uint8)
        if top <= y0 < top + tall and left <= x0 < left + wide:
            out[y0 - top : y0 - top + part.shape[0], x0 - left : x0 - left + part.shape[1]] = part[: tall - (y0 - top), : wide - (x0 - left)]
        return pa.table({"page_id": pa.array([i], pa.int64()), "line_no": pa.array([line], pa.int32()), "width": pa.array([wide], pa.int32()), "height": pa.array([tall], pa.int32()), "data": pa.array([out.tobytes()], pa.binary())})

    return _under(wanted, tiles, size).groupBy("page_id", "line_no").applyInArrow(make, "page_id long, line_no int, width int, height int, data binary")


# --- components -----------------------------------------------------------------------------------------


def runs_of(black: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, x0, x1) of the maximal runs of an image's rows, in raster order."""
    wide = np.zeros((black.shape[0], black.shape[1] + 2), np.int8)
    wide[:, 1:-1] = black
    step = np.diff(wide, axis=1)
    y, x0 = np.nonzero(step == 1)
    return y, x0, np.nonzero(step == -1)[1] - 1


def touching(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs of neighbouring rows that touch, corners included: those of the next row are next to each other."""
    stride = width + 4
    first = np.searchsorted(y * stride + x1, (y + 1) * stride + x0 - 1, "left")
    end = np.searchsorted(y * stride + x0, (y + 1) * stride + x1 + 1, "right")
    n = np.maximum(end - first, 0)
    a = np.repeat(np.arange(len(y)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _local(image: np.ndarray, top: int, left: int, width: int, size: int) -> tuple[list[tuple], list[tuple]]:
    """(label, first pixel, x0, y0, x1, y1, pixels) of the components of a tile's own pixels, and (label, y, x) of black pixels that several tiles have."""
    y, x0, x1 = runs_of(image == 0)
    if not len(y):
        return [], []
    label = least_labels(len(y), *touching(y, x0, x1, image.shape[1]))
    own = (y < size) & (x0 < size)
    parts: list[tuple] = []
    if own.any():
        cut = np.minimum(x1[own], size - 1)
        at, order = label[own], np.argsort(label[own], kind="stable")
        names, first = np.unique(at[order], return_index=True)
        low = lambda v: np.minimum.reduceat(v[order], first)
        high = lambda v: np.maximum.reduceat(v[order], first)
        ys, xs = y[own], x0[own]
        pixel = (ys + top).astype(np.int64) * width + xs + left
        parts = list(zip(*(v.tolist() for v in (names, low(pixel), low(xs) + left, low(ys) + top, high(cut) + left, high(ys) + top, np.add.reduceat((cut - xs + 1)[order], first)))))
    shared: list[tuple] = []
    for edge in {0, size} & set(range(image.shape[0])):
        for k in np.flatnonzero(y == edge).tolist():
            shared += [(int(label[k]), edge + top, x + left) for x in range(x0[k], x1[k] + 1)]
    for edge in {0, size} & set(range(image.shape[1])):
        for k in np.flatnonzero((x0 <= edge) & (x1 >= edge) & (y != 0) & (y != size)).tolist():
            shared.append((int(label[k]), int(y[k]) + top, edge + left))
    return parts, shared


def components(run: Stages, tiles: DataFrame, size: int = SIZE) -> DataFrame:
    """Black-and-white tiles to (page_id, seq, x, y, w, h, pixel_count), as `blobs.components`: local components, linked where tiles share a
    black pixel, the links followed over any number of tiles."""

    def local(batches):
        for b in batches:
            rows = []
            for i, ty, tx, w, h, data in zip(*(b.column(c).to_pylist() for c in _NAMES)):
                parts, shared = _local(_image(ty, tx, w, h, data, size), ty * size, tx * size, w, size)
                base = (ty * (w // size + 1) + tx) * (size + 1) * (size + 1)  # labels are runs, of which a tile has fewer
                rows += [(i, base + p[0], *p[1:], None, None) for p in parts]
                rows += [(i, base + n, *[None] * 6, y, x) for n, y, x in shared]
            kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.int32(), pa.int32()]
            yield _batch(rows, kinds, ["page_id", "node", "first", "x0", "y0", "x1", "y1", "n", "sy", "sx"])

    found = run.write(tiles.select(*_NAMES).mapInArrow(local, "page_id long, node long, first long, x0 int, y0 int, x1 int, y1 int, n long, sy int, sx int"), "parts")
    met = found.where("sy is not null").groupBy("page_id", "sy", "sx").agg(F.array_sort(F.collect_set("node")).alias("m")).where("size(m) > 1")  # four tiles at most
    roots = links.least_members(run, met.select("page_id", F.col("m")[0].alias("a"), F.explode(F.slice("m", 2, 4)).alias("b")))
    roots = roots.select(F.col("page_id").alias("_page"), F.col("node").alias("_node"), "root")
    parts = found.where("n is not null").join(roots, (F.col("page_id") == F.col("_page")) & (F.col("node") == F.col("_node")), "left")
    box = parts.groupBy("page_id", F.coalesce("root", "node").alias("root")).agg(
        F.min("first").alias("first"), F.min("x0").alias("x"), F.min("y0").alias("y"), (F.max("x1") - F.min("x0") + 1).cast("int").alias("w"), (F.max("y1") - F.min("y0") + 1).cast("int").alias("h"), F.sum("n").alias("pixel_count")
    )
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("y", "x", "first")) - 1
    return box.withColumn("seq", number).select("page_id", "seq", "x", "y", "w", "h", "pixel_count")
