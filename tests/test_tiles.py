"""Pages as tiles against whole pages; lines and columns of many blobs; the page pipeline."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelight.engine import Engine
from pagelight.operators import blobs, layout, links, pages, recognize, tiles
from pagelight.operators.stages import Stages
from tests.test_fixtures import flood, raster_of, small_model

SIZES = (5, 64)


def pictures():
    rng = np.random.default_rng(5)
    snake = np.full((20, 20), 255)
    for y in range(0, 20, 2):
        snake[y] = 0
        snake[y + 1, 19 if y % 4 == 0 else 0] = 0
    some = [np.where(rng.random((17, 23)) < p, 0, 255) for p in (0.1, 0.3, 0.45)]
    return [*some, snake, np.zeros((16, 16)), np.full((8, 8), 255), rng.integers(0, 256, (30, 21)), np.zeros((1, 1))]


@pytest.fixture(scope="module")
def whole(spark):
    return raster_of(spark, *pictures()).drop("channels")


def data(df):
    return {r["page_id"]: (r["width"], r["height"], bytes(r["data"])) for r in df.collect()}


@pytest.mark.parametrize("size", SIZES)
def test_tiles_are_the_page(spark, whole, size):
    cut = tiles.cut(whole, size)
    assert data(tiles.whole(cut, size)) == data(whole)
    counted = {(r["page_id"], r["px"]): r["n"] for r in tiles.histogram(cut, size).collect()}
    assert counted == {(r["page_id"], r["px"]): r["n"] for r in pages.histogram(pages.exploded(whole)).collect()}
    assert {r[0]: r[1] for r in tiles.skew(cut, size).collect()} == {r[0]: r[1] for r in pages.detect_skew(pages.exploded(whole)).collect()}


@pytest.mark.parametrize("size", SIZES)
def test_turned_and_cropped(spark, whole, size):
    cut = tiles.cut(whole, size)
    turns = whole.select("page_id", (F.col("page_id") * 13 - 20).cast("double").alias("degrees")).where("page_id <> 1")
    both = whole.join(turns, "page_id", "left").withColumn("degrees", F.coalesce("degrees", F.lit(0.0)))
    assert data(tiles.whole(tiles.rotated(cut, turns, size), size)) == data(pages.rotate(both))
    boxes = [(0, 0, 0, 0, 23, 17), (0, 1, 3, 2, 9, 14), (0, 2, 20, 15, 30, 25), (3, 0, 5, 5, 5, 5), (6, 0, 0, 28, 21, 30), (6, 1, 6, 6, 8, 8)]
    lines = spark.createDataFrame(boxes, "page_id long, line_no int, x int, y int, right int, bottom int")
    got = {(r["page_id"], r["line_no"]): (r["width"], r["height"], bytes(r["data"])) for r in tiles.cropped(cut, lines, size).collect()}
    for page, line, x, y, right, bottom in boxes:
        want = np.full((max(bottom - y, 1), max(right - x, 1)), 255, np.uint8)
        part = pictures()[page][y : y + want.shape[0], x : x + want.shape[1]]
        want[: part.shape[0], : part.shape[1]] = part
        assert got[page, line] == (want.shape[1], want.shape[0], want.tobytes())


@pytest.mark.parametrize("size", SIZES)
def test_components_across_tiles(spark, whole, size):
    with Stages(spark, "t") as run:
        got = {}
        for r in tiles.components(run, tiles.cut(whole, size), size).orderBy("page_id", "seq").collect():
            got.setdefault(r["page_id"], []).append((r["x"], r["y"], r["w"], r["h"], r["pixel_count"]))
    want = {}
    for r in blobs.components(pages.exploded(whole)).orderBy("page_id", "seq").collect():
        want.setdefault(r["page_id"], []).append((r["x"], r["y"], r["w"], r["h"], r["pixel_count"]))
    assert got == want and sorted(got[3]) == sorted(flood(pictures()[3]))


def test_links_over_long_chains(spark):
    rng = np.random.default_rng(6)
    pairs = [(1, i, i + 1) for i in range(300)] + [(2, int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(3, 5, 5), (1, 1000, 7)]
    with Stages(spark, "t") as run:
        got = {(r["page_id"], r["node"]): r["root"] for r in links.least_members(run, spark.createDataFrame(pairs, "page_id long, a long, b long")).collect()}
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for g, a, b in pairs:
        a, b = sorted((top((g, a)), top((g, b))))
        parent[b] = a
    linked = {(g, x) for g, a, b in pairs if a != b for x in (a, b)}
    assert got == {x: top(x)[1] for x in linked}


def slow_lines(found):
    """The rows of blobs (x, y, w, h), every row looked at."""
    rows, of = [], {}
    for i in sorted(range(len(found)), key=lambda i: (found[i][1] + found[i][3] // 2, found[i][0], i)):
        _, y, _, h = found[i]
        shared = [min(b, y + h) - max(t, y) for t, b in rows]
        best = max(range(len(rows)), key=lambda k: (shared[k], -k), default=-1)
        if best < 0 or shared[best] <= 0:
            best = len(rows)
            rows.append([y, y + h])
        of[i] = best
        rows[best] = [min(rows[best][0], y), max(rows[best][1], y + h)]
    place = {r: k for k, r in enumerate(sorted(range(len(rows)), key=lambda r: rows[r][0]))}
    return [place[of[i]] for i in range(len(found))]


def slow_columns(lines):
    found, of = [], {}
    for i in sorted(range(len(lines)), key=lambda i: (lines[i][2], i)):
        a, b, _ = lines[i]
        best, most = -1, 0.5
        for k, (l, r) in enumerate(found):
            shared = min(b, r) - max(a, l)
            if shared > 0 and shared / min(max(b - a, 1), max(r - l, 1)) > most:
                best, most = k, shared / min(max(b - a, 1), max(r - l, 1))
        if best < 0:
            best = len(found)
            found.append([a, b])
        of[i] = best
        found[best] = [min(found[best][0], a), max(found[best][1], b)]
    place = {c: k for k, c in enumerate(sorted(range(len(found)), key=lambda c: found[c][0] + (found[c][1] - found[c][0]) // 2))}
    return [place[of[i]] for i in range(len(lines))]


def test_rows_and_columns_that_meet(spark):
    rng = np.random.default_rng(7)
    for n, high in ((200, 300), (400, 4000), (300, 60)):
        found = [(int(x), int(y), 10, int(h)) for x, y, h in zip(rng.integers(0, 500, n), rng.integers(0, high, n), rng.integers(0, 60, n))]
        df = spark.createDataFrame([(1, i, *b, 1) for i, b in enumerate(found)], "page_id long, seq int, x int, y int, w int, h int, pixel_count long")
        assert [r["line_no"] for r in layout.detect_lines(df).orderBy("seq").collect()] == slow_lines(found)
        lines = [(int(x), int(x + w), int(y)) for x, w, y in zip(rng.integers(0, 900, n), rng.integers(0, 200, n), rng.integers(0, high, n))]
        df = spark.createDataFrame([(1, i, a, b, y, y + 10) for i, (a, b, y) in enumerate(lines)], "page_id long, line_no int, x_min int, x_max int, y_min int, y_max int")
        assert [r["block_no"] for r in layout.detect_columns(df).orderBy("line_no").collect()] == slow_columns(lines)


def test_many_rows_take_no_square():
    import pyarrow as pa

    i = np.arange(80_000)
    t = pa.table({"y": (i // 20) * 40, "x": (i % 20) * 12, "w": np.full(len(i), 10), "h": 14 + i % 7, "seq": i})
    began = time.time()
    got = layout._grown(t).column("line_no").to_numpy()
    assert (got == i // 20).all() and time.time() - began < 4


def page():
    out = np.full((90, 200), 255)
    for x in (20, 40, 60, 100, 120):
        out[20:40, x : x + 12] = 0
    out[60:62, 150:152] = 0
    return out


def test_page_pipeline_with_blank_lines(spark):
    """A line that the model reads as nothing gives an empty text, whatever the tiles; the rasters are read once."""
    noise = np.full((40, 40), 255)
    noise[10:30, 5:35] = 0
    rasters = raster_of(spark, page(), noise, np.full((5, 5), 255))
    results, reads = [], spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    rasters = rasters.mapInArrow(seen, rasters.schema)
    for size in (16, 1024):
        engine = Engine(spark, small_model())
        engine.model.network.children[-1].matrices[0][0][0] = [0.0, 99.0]  # everything is the empty code
        found = {r["page_id"]: r for r in recognize.recognize(rasters, engine.model, size).collect()}
        assert [w["text"] for w in found[1]["blocks"][0]["lines"][0]["words"]] == [""] and found[1]["blocks"][0]["lines"][0]["words"][0]["confidence"] == 0
        assert found[2]["blocks"] == [] and len(found) == 3
        results.append({k: r["blocks"] for k, r in found.items()})
        results.append({r["page_id"]: r["blocks"] for r in recognize.recognize(rasters, Engine(spark, small_model()).model, size).collect()})
    assert results[0] == results[2] and results[1] == results[3] and reads.value == 4 * 3
    assert results[1][0][0]["lines"][0]["words"][0]["text"] == "aaaaa"


def test_lines_in_sql(spark):
    """The table function gives what the DataFrame form gives."""
    from pagelight.sources import model

    m = model.load(small_model())
    crops = tiles.cropped(tiles.cut(raster_of(spark, page()).drop("channels")), spark.createDataFrame([(0, 0, 20, 20, 132, 40), (0, 1, 100, 20, 132, 40), (0, 2, 0, 0, 10, 10)], "page_id long, line_no int, x int, y int, right int, bottom int"))
    want = sorted(map(tuple, recognize.recognize_lines(crops, m).collect()))
    recognize.register(spark, m)
    crops.createOrReplaceTempView("crops")
    got = spark.sql("SELECT page_id, line_no, r.text, r.confidences, r.timesteps FROM crops, LATERAL recognize_line(width, height, data) r").collect()
    assert sorted(map(tuple, got)) == want
    assert want[0][2].startswith("a") and want[1][2].startswith("a") and len(want) == 3
