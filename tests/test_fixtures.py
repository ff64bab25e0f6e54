"""Hand-made inputs with the results they must have, and small brute-force versions."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelight.engine import Engine, NoImageLoaded
from pagelight.functions import scalar, vectors
from pagelight.operators import blobs, decode, layout, network, pages, render
from pagelight.sources import images, model


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def pixels_of(spark, image, page_id=1):
    h, w = image.shape
    rows = [(page_id, y, x, int(image[y, x]), w, h) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "page_id long, y int, x int, px int, width int, height int")


def raster_of(spark, *pictures):
    return spark.createDataFrame([(i, p.shape[1], p.shape[0], 1, bytearray(p.astype(np.uint8).tobytes())) for i, p in enumerate(pictures)], "page_id long, width int, height int, channels int, data binary")


def blob_rows(spark, found):
    rows = [(1, i, x, y, w, h, n) for i, (x, y, w, h, n) in enumerate(found)]
    return spark.createDataFrame(rows, "page_id long, seq int, x int, y int, w int, h int, pixel_count long")


# --- pixels -----------------------------------------------------------------------------------------


def test_gray(spark):
    rgb = spark.createDataFrame([(255, 0, 0), (0, 255, 0), (0, 0, 255), (128, 128, 128)], "r int, g int, b int")
    assert [r[0] for r in rgb.select(scalar.gray(F.col("r"), F.col("g"), F.col("b"))).collect()] == [76, 150, 29, 128]


def brute_otsu(values):
    best = (0, 0)
    n, total = len(values), sum(values)
    for t in range(256):
        back = [v for v in values if v <= t]
        if not back or len(back) == n:
            continue
        sigma = ((total - sum(back)) * len(back) - sum(back) * (n - len(back))) ** 2 // (len(back) * (n - len(back)))
        if sigma > best[0]:
            best = (sigma, t)
    return best[1]


def test_otsu_takes_whole_scores(spark):
    rng = np.random.default_rng(1)
    cases = [[234, 236, 236, 235, 232], [128] * 100, [50] * 100 + [200] * 100, list(range(256))] + [rng.integers(0, 12, 6).tolist() for _ in range(40)]
    rows = [(i, 0, x, v) for i, c in enumerate(cases) for x, v in enumerate(c)]
    got = {r["page_id"]: r["threshold"] for r in pages.otsu(spark.createDataFrame(rows, "page_id long, y int, x int, px int")).collect()}
    assert got == {i: brute_otsu(c) for i, c in enumerate(cases)} and got[0] == 232


def test_skew(spark):
    straight, turned = np.full((100, 200), 255), np.full((200, 200), 255)
    straight[20:100:20, 10:190] = 0
    for base in (50, 80, 110, 140, 170):
        for x in range(200):
            y = base + round(x * np.tan(np.radians(3)))
            turned[y : y + 2, x] = 0
    both = pixels_of(spark, straight, 1).unionByName(pixels_of(spark, turned, 2)).unionByName(pixels_of(spark, np.zeros((3, 3)), 3))
    got = {r["page_id"]: r["degrees"] for r in pages.detect_skew(both).collect()}
    assert abs(got[1]) <= 0.5 and abs(got[2] - 3) <= 1 and got[3] == 0


def test_rotation_and_inputs(spark):
    image = (np.arange(100) % 256).reshape(10, 10).astype(np.uint8)
    assert np.abs(pages.rotated(image, 0).astype(int) - image).max() <= 1
    dot = np.full((7, 7), 255, np.uint8)
    dot[1, 2] = 0
    turned = pages.rotated(dot, 90)
    assert (turned < 128).any() and turned[1, 2] == 255
    assert pages.rescaled(np.zeros((50, 100), np.uint8), 36).shape == (36, 72) and (pages.rescaled(np.full((8, 8), 128, np.uint8), 8) == -1).all()
    assert pages.rescaled(np.array([[0, 128, 255]], np.uint8), 1).ravel().tolist() == pytest.approx([-1, 0.0039, 1], abs=1e-3)
    assert pages.rescaled(np.zeros((0, 5), np.uint8), 36).size == 0
    got = pages.deskew(raster_of(spark, dot).drop("channels")).first()
    assert bytes(got["data"]) == dot.tobytes()


def flood(image):
    left, out = {(y, x) for y, x in zip(*np.nonzero(image == 0))}, []
    while left:
        todo, seen = [min(left)], set()
        while todo:
            p = todo.pop()
            if p in left:
                left.remove(p)
                seen.add(p)
                todo += [(p[0] + dy, p[1] + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        ys, xs = [p[0] for p in seen], [p[1] for p in seen]
        out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(seen)))
    return sorted(out, key=lambda c: (c[1], c[0]))


def test_components_equal_flood_fill(spark):
    rng = np.random.default_rng(2)
    pictures = [np.where(rng.random((12, 17)) < 0.4, 0, 255) for _ in range(6)] + [np.full((5, 5), 255), np.zeros((5, 5))]
    df = pixels_of(spark, pictures[0], 0)
    for i, p in enumerate(pictures[1:], 1):
        df = df.unionByName(pixels_of(spark, p, i))
    got = {}
    for r in blobs.components(df).orderBy("page_id", "seq").collect():
        got.setdefault(r["page_id"], []).append((r["x"], r["y"], r["w"], r["h"], r["pixel_count"]))
    for i, p in enumerate(pictures):
        assert sorted(got.get(i, [])) == sorted(flood(p))
        assert [c[:2] for c in got.get(i, [])] == [c[:2] for c in flood(p)]


def test_boxes(spark):
    b = scalar.box(F.lit(10), F.lit(20), F.lit(40), F.lit(60))
    at = lambda c: one(spark, c)
    assert (at(scalar.right(b)), at(scalar.bottom(b)), at(scalar.area(b))) == (40, 60, 1200)
    assert at(scalar.contains(b, F.lit(10), F.lit(59))) and not at(scalar.contains(b, F.lit(40), F.lit(30)))


# --- layout -----------------------------------------------------------------------------------------


def kinds(spark, found):
    return [r["blob_type"] for r in layout.classify(blob_rows(spark, found)).orderBy("seq").collect()]


def test_classes(spark):
    assert kinds(spark, [(0, 0, 10, h, 10 * h) for h in (2, 20, 22, 18, 200)]) == ["noise", "text", "text", "text", "large"]
    assert kinds(spark, [(0, 0, 10, 20, 150)] * 4) == ["text"] * 4
    assert kinds(spark, [(0, 0, 10, 20, 150)] * 4 + [(0, 0, 100, 20, 5)])[-1] == "noise"
    assert kinds(spark, [(0, 0, 900, 1, 1)] * 2) == ["text"] * 2


def lines_of(spark, found):
    lined = layout.detect_lines(blob_rows(spark, [(x, y, w, h, w * h) for x, y, w, h in found]))
    return lined, [r["blobs"] for r in layout.line_boxes(lined).orderBy("line_no").collect()]


def test_lines(spark):
    lined, sizes = lines_of(spark, [(x, y, 12, 20) for x, y in zip((10, 30, 50, 70, 90), (100, 102, 98, 101, 99))])
    base = layout.baselines(lined, "line_no").first()
    assert sizes == [5] and abs(base["slope"]) < 0.1
    assert lines_of(spark, [(x, y, 12, 20) for y in (200, 50) for x in (10, 30, 50)])[1] == [3, 3]
    lined, sizes = lines_of(spark, [(x, y, 12, 20) for x, y in zip((10, 30, 50, 70), (100, 110, 120, 130))])
    assert sizes == [4] and 0.3 < layout.baselines(lined, "line_no").first()["slope"] < 0.7
    single = layout.baselines(lines_of(spark, [(50, 100, 12, 20)])[0], "line_no").first()
    assert (single["slope"], single["intercept"]) == (0.0, 120.0)


def words_of(spark, xs, w):
    lined = blob_rows(spark, [(x, 0, w, 20, 20 * w) for x in xs]).withColumn("line_no", F.lit(0))
    return [(r["x"], r["right"] - r["x"], r["n_blobs"]) for r in layout.words(lined, "line_no").orderBy("word_id").collect()]


def test_words(spark):
    assert words_of(spark, (10, 24, 38), 12) == [(10, 40, 3)]
    assert words_of(spark, (10, 24, 38, 80, 94), 12) == [(10, 40, 3), (80, 26, 2)]
    assert [n for _, _, n in words_of(spark, (0, 110, 220, 330), 10)] == [4]
    assert [n for _, _, n in words_of(spark, (0, 7, 62), 5)] == [2, 1]
    assert [(x, n) for x, _, n in words_of(spark, (0, 14, 76, 90, 152, 166), 12)] == [(0, 2), (76, 2), (152, 2)]


def test_columns(spark):
    def blocks(found):
        df = spark.createDataFrame([(1, i, a, b, y, y + 10) for i, (a, b, y) in enumerate(found)], "page_id long, line_no int, x_min int, x_max int, y_min int, y_max int")
        return [r["block_no"] for r in layout.detect_columns(df).orderBy("line_no").collect()]

    assert blocks([(0, 100, 0), (5, 90, 20), (0, 60, 40)]) == [0, 0, 0]
    assert blocks([(200, 300, 0), (0, 100, 0), (205, 280, 20), (0, 90, 20)]) == [1, 0, 1, 0]


# --- vectors and layers --------------------------------------------------------------------------------


def test_vectors(spark):
    assert one(spark, vectors.dot(F.array(*map(F.lit, (1, 2, 3, 4))), F.array(*map(F.lit, (5, 6, 7, 8))))) == 70
    assert one(spark, vectors.dot(F.array().cast("array<int>"), F.array().cast("array<int>"))) == 0
    assert one(spark, vectors.dot_int(F.array(*map(F.lit, (127, 0, -127, 64))), F.array(*map(F.lit, (127, 127, 0, 64))))) == 20225
    rows = vectors.matrix([[1, 2, 3, 4, 1], [0.5, 0.5, 0.5, 0.5, -1], [-1, 1, -1, 1, 0]])
    x = F.array(*[F.lit(float(v)) for v in (1, 2, 3, 4)])
    assert one(spark, vectors.mat_vec(rows, x)) == [31, 4, 2]
    whole = F.transform(vectors.matrix([[2.5, -1, 0.5, 0.3], [1, 1, 1, -0.5]]), vectors.quantized_row)
    assert one(spark, vectors.mat_vec_int(whole, F.array(*[F.lit(float(v)) for v in (1, 2, 3)]))) == pytest.approx([2.3, 5.5], abs=0.15)
    sweep = spark.range(-100, 101).select((F.col("id") / 10.0).alias("x"))
    worst = sweep.select(F.max(F.abs(vectors.sigmoid_fast(F.col("x")) - vectors.sigmoid(F.col("x")))), F.max(F.abs(vectors.tanh_fast(F.col("x")) - F.tanh("x")))).first()
    assert max(worst) < 1e-3
    assert sum(one(spark, vectors.softmax(x))) == pytest.approx(1) and one(spark, vectors.softmax(F.array().cast("array<double>"))) == []


def test_layers(spark):
    grid = np.arange(8, dtype=np.float32).reshape(1, 4, 2) + 1
    out = network.forward(network.Layer("convolve", 2, 6, size=(1, 0)), grid)
    assert out[0, 0].tolist() == [0, 0, 1, 2, 3, 4] and out[0, 3].tolist() == [5, 6, 7, 8, 0, 0]
    pool = network.forward(network.Layer("maxpool", 2, 2, size=(2, 1)), np.array([[[1, 4], [3, 2], [5, 8], [7, 6], [9, 10]]], np.float32))
    assert pool[0].tolist() == [[3, 4], [7, 8], [9, 10]]
    both = network.Layer("parallel", 2, 4, [network.Layer("input", 2, 2), network.Layer("reversed", 2, 2, [network.Layer("input", 2, 2)])])
    assert (network.forward(both, grid) == np.concatenate((grid, grid), axis=2)).all()
    zero = network.Layer("lstm", 2, 2, matrices=[(np.zeros((2, 5), np.float32), None)] * 4)
    assert (network.forward(zero, grid) == 0).all()
    gates = [np.zeros((2, 5), np.float32) for _ in range(4)]
    gates[0][:, :2] = np.eye(2)
    for k, bias in ((1, 10), (2, -10), (3, 10)):
        gates[k][:, 4] = bias
    x = np.array([[[0.5, -0.3]]], np.float32)
    assert network.forward(network.Layer("lstm", 2, 2, matrices=[(g, None) for g in gates]), x)[0, 0] == pytest.approx(np.tanh(np.tanh(x[0, 0])), abs=0.02)


# --- decoding -----------------------------------------------------------------------------------------

FOLD = [[0.1, 0.7, 0.1, 0.1], [0.1, 0.7, 0.1, 0.1], [0.1, 0.1, 0.8, 0.0]]


def frames_of(spark, *lines):
    return spark.createDataFrame([(i, t, row) for i, line in enumerate(lines) for t, row in enumerate(line)], "line_id long, t int, probs array<double>")


def test_greedy_and_beam(spark):
    apart = [[0.1, 0.9], [0.9, 0.1], [0.1, 0.9]]
    df = frames_of(spark, FOLD, apart, [[0.9, 0.1]])
    got = {}
    for r in decode.greedy(df).orderBy("line_id", "t").collect():
        got.setdefault(r["line_id"], []).append((r["code"], r["conf"]))
    assert [c for c, _ in got[0]] == [1, 2] and got[0][0][1] == pytest.approx(np.log(0.7)) and [c for c, _ in got[1]] == [1, 1] and 2 not in got
    assert {r["line_id"]: r["codes"] for r in decode.beam_search(df).collect()} == {0: [1, 2], 1: [1, 1], 2: []}
    assert decode.code_hash([]) == 0xCBF29CE484222325 and decode.code_hash([1, 2]) != decode.code_hash([2, 1])
    with pytest.raises(ValueError):
        decode.beam(FOLD, 0, 10, 65)


def test_codes_to_text(spark):
    recoder = spark.createDataFrame([(3, [2]), (5, [1]), (6, [7, 8]), (4, [1])], "id int, codes array<int>")
    table = decode.code_table(recoder)
    assert {r["code"]: r["unichar_id"] for r in table.collect()} == {1: 5, 2: 3} and decode.largest_code(recoder).first()[0] == 8
    codes = spark.createDataFrame([(0, 0, 1), (0, 1, 9), (0, 2, 2)], "line_id long, t int, code int")
    charset = spark.createDataFrame([(5, "H"), (3, "i")], "id int, unichar string")
    assert [r["unichar_id"] for r in decode.unichar_ids(codes, table).orderBy("t").collect()] == [5, decode.INVALID, 3]
    assert decode.text_of(decode.unichar_ids(codes, table), charset).first()["text"] == "Hi"


def test_alignment(spark):
    def words(text, n):
        boxes = F.array(*[scalar.box(F.lit(i), F.lit(0), F.lit(i + 1), F.lit(1)) for i in range(n)])
        return [w["text"] for w in one(spark, decode.aligned(F.lit(text), F.lit(0.5), boxes))]

    assert words("a b", 1) == ["a b"] and words(" a  b ", 2) == ["a", "b"] and words("a b c", 2) == ["a b c", ""]
    assert one(spark, decode.probability(F.array().cast("array<float>"))) == 0


# --- models -------------------------------------------------------------------------------------------


def container(parts):
    offsets, body = [-1] * 24, b""
    for place in sorted(parts):
        offsets[place] = 196 + len(body)
        body += parts[place]
    return struct.pack("<I24q", 24, *offsets) + body


def string(s):
    return struct.pack("<I", len(s)) + s.encode()


def node(kind, inputs, outputs, body):
    return b"\0" + string(kind) + b"\0\0" + struct.pack("<4i", 0, inputs, outputs, 0) + string(kind) + body


def matrix(rows):
    m = np.array(rows, "<f8")
    return struct.pack("<Biid", 0x80, *m.shape, 0.0) + m.tobytes()


def small_model():
    """A network of 12 inputs that sees each column's mean darkness: dark gives code 1, bright the empty code."""
    size = 12
    pool = node("Maxpool", 1, 1, struct.pack("<2i", 1, size))
    out = node("Softmax", 1, 3, matrix([[8.0, 0.0], [-8.0, 0.0], [-4.0, -9.0]]))
    net = node("Series", size, 3, struct.pack("<I", 3) + node("Input", size, 1, struct.pack("<5i", 1, size, 0, 1, 0)) + pool + out)
    lstm = net + string("spec") + struct.pack("<4i3f", model.RECODED, 0, 0, 0, 0, 0, 0)
    chars = "3\nNULL 0 Common 0\na 3 0,255,0,255 Latin 1 0 1 a\t# letter\nb 3 Latin 2\n".encode()
    codes = struct.pack("<I", 3) + b"".join(struct.pack("<bii", 1, 1, c) for c in (0, 1, 2))
    return container({model.LSTM: lstm, model.CHARSET: chars, model.RECODER: codes})


def test_container(spark):
    data = container({3: b"abc", 7: b"defgh"})
    assert [(i, p) for i, _, p in model.container(data)] == [(3, b"abc"), (7, b"defgh")]
    swapped = struct.pack(">I24q", 24, *struct.unpack("<24q", data[4:196])) + data[196:]
    assert [p for _, _, p in model.container(swapped)] == [b"abc", b"defgh"]
    assert model.entry_table(spark, data).where("idx = 7").first()["size"] == 5
    for bad, name in ((b"x", "FileTooSmall"), (struct.pack("<I", 5) + data[4:], "BadEntryCount"), (data[:4] + struct.pack("<q", 10**6) + data[12:], "OffsetOutOfRange")):
        with pytest.raises(model.ModelError, match=name):
            model.container(bad)


def test_charset(spark):
    rows = model.charset(b"4\nNULL 0 Common 0\na 3 1,2,3 Latin 1 2 3 A\nb\nc 8 Han 2\t# x\n")
    assert rows[0][1] == " " and rows[1][2:] == (3, "Latin", 1, 2, 3, "A") and rows[2][2:] == (0, "", 0, 0, 0, "") and rows[3][2:5] == (8, "Han", 2)
    for bad, name in ((b"", "EmptyData"), (b"x\n", "BadCharCount"), (b"1\na 0\nb 0\n", "TooManyEntries"), (b"2\na 0\n", "TooFewEntries"), (b"1\na zz\n", "BadProperties"), (b"1\na 0 L x\n", "BadIntField")):
        with pytest.raises(model.ModelError, match=name):
            model.charset(bad)
    assert model.charset_table(spark, b"1\na 3\n").select(scalar.has_property(F.col("properties"), scalar.ALPHA)).first()[0]


def graph(words, bits=3):
    """A packed graph of words, a node after the other."""
    nodes, order = {(): {}}, [()]
    for w in words:
        for i, letter in enumerate(w):
            here, there = tuple(w[:i]), tuple(w[: i + 1])
            nodes[here][letter] = nodes[here].get(letter, False) or i + 1 == len(w)
            if i + 1 < len(w) and there not in nodes:
                nodes[there] = {}
                order.append(there)
    starts, n = {}, 0
    for k in order:
        starts[k] = n
        n += len(nodes[k])
    out = []
    for k in order:
        for j, (letter, ends) in enumerate(sorted(nodes[k].items())):
            flags = (j + 1 == len(nodes[k])) + 4 * ends
            out.append(letter | flags << bits | starts.get((*k, letter), 0) << (bits + 3))
    return struct.pack("<hii", 42, 2**bits - 1, len(out)) + struct.pack(f"<{len(out)}q", *out)


def test_word_graphs(spark):
    bits, edges = model.edge_table(spark, graph([(1, 3), (2, 4), (2, 4, 5)]))
    decoded = decode.graph_edges(edges, bits)
    words = spark.createDataFrame([(0, [1, 3]), (1, [2, 4]), (2, [2, 4, 5]), (3, [1]), (4, [1, 4]), (5, []), (6, [2, 4, 5, 1])], "word_id long, letters array<int>")
    assert {r["word_id"] for r in decode.in_graph(words, decoded).where("found").collect()} == {0, 1, 2}
    assert {r["word_id"] for r in decode.in_graph(words, decoded, prefix=True).where("found").collect()} == {0, 1, 2, 3, 5}
    assert {r["node"]: r["n"] for r in decode.forward_edges(decoded).collect()}[0] == 2
    for bad, name in ((b"x", "DataTooSmall"), (struct.pack("<hii", 1, 1, 1), "BadMagicNumber"), (struct.pack("<hii", 42, 0, 1), "BadUnicharsetSize"), (struct.pack("<hii", 42, 1, 0), "BadEdgeCount"), (struct.pack("<hii", 42, 1, 1), "TruncatedEdges")):
        with pytest.raises(model.ModelError, match=name):
            model.word_graph(bad)


def test_model_parts():
    m = model.load(small_model())
    assert (m.inputs, m.classes, m.int_mode, m.null_code, m.spec, m.graphs) == (12, 3, False, 0, "spec", {})
    assert [r[1] for r in model.layer_rows(m.network)] == ["series", "input", "maxpool", "softmax"]
    whole = struct.pack("<Biib", 0x81, 1, 2, 0) + bytes([1, 255]) + struct.pack("<Id", 1, 2.54)
    values, scales = model.weights(model.Reader(whole))
    assert values.tolist() == [[1, -1]] and scales.tolist() == [pytest.approx(0.02)]
    with pytest.raises(model.ModelError, match="UnsupportedOldFormat"):
        model.weights(model.Reader(b"\0"))
    with pytest.raises(model.ModelError, match="UnsupportedNetworkType"):
        model.network(model.Reader(node("Nothing", 1, 1, b"")))
    with pytest.raises(model.ModelError, match="UnexpectedEof"):
        model.Reader(b"\0").values("i")


# --- pages --------------------------------------------------------------------------------------------


def png(image):
    h, w, n = image.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines, above = b"", np.zeros((w, n), int)
    for y, row in enumerate(image.astype(int)):
        left = np.vstack((np.zeros((1, n), int), row[:-1]))
        corner = np.vstack((np.zeros((1, n), int), above[:-1]))
        guess = left + above - corner
        a, b, c = abs(guess - left), abs(guess - above), abs(guess - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
        lines += bytes([y % 5]) + ((row - [0, left, above, (left + above) // 2, paeth][y % 5]) % 256).astype(np.uint8).tobytes()
        above = row
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_image_sources(spark, tmp_path):
    image = np.random.default_rng(3).integers(0, 256, (11, 7, 3)).astype(np.uint8)
    assert (images.decode(png(image)) == image).all() and (images.decode(b"P6\n7 11\n255\n" + image.tobytes()) == image).all()
    (tmp_path / "a.png").write_bytes(png(image))
    (tmp_path / "b.png").write_bytes(b"\0\1\2\3")
    got = {r["path"].rsplit("/", 1)[-1]: r for r in images.from_files(spark, str(tmp_path)).collect()}
    assert bytes(got["a.png"]["data"]) == image.tobytes() and "ImageLoadFailed" in got["b.png"]["_error"]
    bad = spark.createDataFrame([(1, 4, 2, 1, bytearray(3))], images.SCHEMA)
    with pytest.raises(Exception, match="InvalidDimensions"):
        images.from_raw(bad).collect()


def test_engine(spark, tmp_path):
    page = np.full((60, 200), 255)
    for x in (20, 40, 60, 100, 120):
        page[20:40, x : x + 12] = 0
    engine = Engine(spark, small_model())
    with pytest.raises(NoImageLoaded):
        engine.recognize()
    found = engine.set_raw(raster_of(spark, page, np.full((50, 50), 255))).recognize().orderBy("page_id").collect()
    assert [(r["page_width"], r["page_height"]) for r in found] == [(200, 60), (50, 50)] and found[1]["blocks"] == []
    words = found[0]["blocks"][0]["lines"][0]["words"]
    assert [(w["bbox"]["x"], w["bbox"]["width"]) for w in words] == [(20, 52), (100, 32)]
    assert words[0]["text"] == "aaaaa" and words[1]["text"] == "" and 0 < words[0]["confidence"] <= 1
    assert engine.documents("text").orderBy("page_id").first()["document"] == "aaaaa "
    assert "word_1_1_1_2" in engine.documents("hocr").orderBy("page_id").first()["document"]


def test_documents(spark):
    box = scalar.box(F.lit(10), F.lit(20), F.lit(60), F.lit(35))
    word = F.struct(F.lit('a<b>&"c"\x01').alias("text"), F.lit(0.95).cast("float").alias("confidence"), box.alias("bbox"))
    line = F.struct(box.alias("bbox"), F.lit(0.0).cast("float").alias("baseline_slope"), F.lit(35.0).cast("float").alias("baseline_intercept"), F.array(word).alias("words"))
    page = spark.range(1).select(F.col("id").alias("page_id"), F.lit(100).alias("page_width"), F.lit(50).alias("page_height"), F.array(F.struct(box.alias("bbox"), F.array(line).alias("lines"))).alias("blocks"))
    hocr = render.rendered(page, "hocr").first()["document"]
    assert 'id="word_1_1_1_1" title="bbox 10 20 60 35; x_wconf 95">a&lt;b&gt;&amp;&quot;c&quot;' in hocr and "baseline 0.0 35.0" in hocr
    import json

    found = json.loads(render.rendered(page, "json").first()["document"])["page"]
    assert found["blocks"][0]["lines"][0]["words"][0] == {"text": 'a<b>&"c"\x01', "confidence": 0.95, "bbox": {"x": 10, "y": 20, "width": 50, "height": 15}}
    empty = render.assembled(spark.createDataFrame([], "page_id long, block_no int, line_no int, block_box struct<x:int,y:int,width:int,height:int>, bbox struct<x:int,y:int,width:int,height:int>, baseline_slope float, baseline_intercept float, words " + render.WORDS), spark.createDataFrame([(1, 0, 0)], "page_id long, page_width int, page_height int"))
    assert render.rendered(empty, "json").first()["document"] == '{"page":{"width":0,"height":0,"blocks":[]}}'
    assert render.rendered(empty, "text").first()["document"] == ""
