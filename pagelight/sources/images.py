"""Image sources: rasters(page_id, width, height, channels, data), a row for each page, row-major, channels interleaved."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "page_id long, width int, height int, channels int, data binary"


class ImageLoadFailed(ValueError):
    """The bytes aren't an image that can be read."""


class InvalidDimensions(ValueError):
    """Raw pixels don't fill width x height x channels."""


#: Where the passes of an interlaced PNG begin and how far apart their pixels are: x, y, dx, dy (fixed values of the format).
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
#: Samples of a pixel by colour type (fixed values of the format).
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes, each led by its filter, to the bytes; step is the distance of a byte's left neighbour."""
    h, n = raw.shape[0], (raw.shape[1] - 1) // step
    out = np.zeros((h + 1, n + 1, step), np.int64)  # a row and a column of zeros before the first
    for y in range(h):
        line, mode = raw[y, 1:].reshape(n, step).astype(np.int64), raw[y, 0]
        if mode == 0:
            out[y + 1, 1:] = line
        elif mode == 1:
            out[y + 1, 1:] = np.cumsum(line, axis=0) & 255
        elif mode == 2:
            out[y + 1, 1:] = (line + out[y, 1:]) & 255
        elif mode in (3, 4):
            for x in range(n):
                left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
                if mode == 3:
                    guess = (left + up) // 2
                else:
                    d = left + up - corner
                    a, b, c = abs(d - left), abs(d - up), abs(d - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                out[y + 1, x + 1] = (line[x] + guess) & 255
        else:
            raise ImageLoadFailed(f"filter {mode}")
    return out[1:, 1:].astype(np.uint8).reshape(h, n * step)


def _samples(rows: np.ndarray, width: int, n: int, bits: int) -> np.ndarray:
    """Rows of bytes to height x width x n samples of so many bits."""
    if bits == 16:
        return rows.reshape(len(rows), width, n, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)
    if bits == 8:
        return rows.reshape(len(rows), width, n)
    each = np.unpackbits(rows, axis=1).reshape(len(rows), -1, bits) @ (1 << np.arange(bits)[::-1])
    return each[:, : width * n].reshape(len(rows), width, n)


def _png(data: bytes) -> np.ndarray:
    at, packed, header, palette, clear = 8, [], None, None, None
    while at + 8 <= len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        content = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            header = int.from_bytes(content[:4], "big"), int.from_bytes(content[4:8], "big"), content[8], content[9], content[12]
        elif kind == b"PLTE":
            palette = np.frombuffer(content, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = content
        elif kind == b"IDAT":
            packed.append(content)
        at += n + 12
    if not header or header[2] not in (1, 2, 4, 8, 16) or header[3] not in SAMPLES or header[4] > 1 or (header[3] == 3 and palette is None):
        raise ImageLoadFailed("not a PNG image")
    w, h, bits, colour, interlaced = header
    n, raw, at = SAMPLES[colour], np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8), 0
    out = np.zeros((h, w, n), np.uint16 if bits == 16 else np.uint8)
    for x, y, dx, dy in PASSES if interlaced else [(0, 0, 1, 1)]:
        wide, tall = -(-(w - x) // dx), -(-(h - y) // dy)
        if wide > 0 and tall > 0:
            line = 1 + (wide * n * bits + 7) // 8
            rows = _unfiltered(raw[at : at + tall * line].reshape(tall, line), max(1, n * bits // 8))
            out[y::dy, x::dx] = _samples(rows, wide, n, bits)
            at += tall * line
    if colour == 3:
        table = palette
        if clear is not None:
            alpha = np.full((len(palette), 1), 255, np.uint8)
            alpha[: len(clear), 0] = np.frombuffer(clear, np.uint8)[: len(palette)]
            table = np.hstack((palette, alpha))
        return table[out[:, :, 0]]
    opaque = None
    if clear is not None and colour in (0, 2):  # one colour is transparent
        opaque = np.where((out == np.frombuffer(clear, ">u2")[:n]).all(axis=2), 0, 255).astype(np.uint8)[:, :, None]
    shown = (out >> 8).astype(np.uint8) if bits == 16 else out * np.uint8(255 // (2**bits - 1))
    return shown if opaque is None else np.concatenate((shown, opaque), axis=2)


def _bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP images of 8, 24 and 32 bits."""
    start, size = int.from_bytes(data[10:14], "little"), int.from_bytes(data[14:18], "little")
    w, h = (int.from_bytes(data[k : k + 4], "little", signed=True) for k in (18, 22))
    bits, packing = int.from_bytes(data[28:30], "little"), int.from_bytes(data[30:34], "little")
    if size < 40 or bits not in (8, 24, 32) or packing or w < 1 or not h:
        raise ImageLoadFailed("only uncompressed BMP images of 8, 24 and 32 bits are read")
    line = (w * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, abs(h) * line, start).reshape(abs(h), line)[:, : w * bits // 8].reshape(abs(h), w, bits // 8)
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        table = np.frombuffer(data[14 + size : start], np.uint8).reshape(-1, 4)
        rows = table[rows[:, :, 0]]
    return rows[:, :, 2::-1].copy()


def _netpbm(data: bytes) -> np.ndarray:
    fields = b"".join(line.split(b"#")[0] + b" " for line in data[:1024].split(b"\n")[:8]).split()
    kind, w, h, most = fields[0], int(fields[1]), int(fields[2]), int(fields[3])
    n = {b"P5": 1, b"P6": 3}[kind]
    if most != 255 or len(data) < w * h * n:
        raise ImageLoadFailed("only binary PGM and PPM images of 8 bits are read")
    return np.frombuffer(data[len(data) - w * h * n :], np.uint8).reshape(h, w, n)


def decode(data: bytes) -> np.ndarray:
    """Height x width x channels of a PNG, PGM, PPM or BMP image; anything else raises ImageLoadFailed."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
        if data[:2] in (b"P5", b"P6"):
            return _netpbm(data)
        if data[:2] == b"BM":
            return _bmp(data)
    except (ValueError, IndexError, KeyError, zlib.error) as e:
        raise ImageLoadFailed(str(e)) from e
    raise ImageLoadFailed("unknown format")


_KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
_NAMES = ["width", "height", "channels", "data", "_error"]
_FIELDS = "width int, height int, channels int, data binary, _error string"


def _decoded(images: DataFrame, read) -> DataFrame:
    """images with keys, then the column that `read` makes pixels of, to the keys and the decoded image; an image that can't be read has its
    message in _error and no pixels, and the job goes on."""
    keys = images.columns[:-1]

    def run(batches):
        for b in batches:
            rows = []
            for content in b.column(len(keys)).to_pylist():
                try:
                    p = read(content)
                    rows.append((p.shape[1], p.shape[0], p.shape[2], p.tobytes(), None))
                except ImageLoadFailed as e:
                    rows.append((0, 0, 0, b"", f"ImageLoadFailed: {e}"))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)] if rows else [pa.array([], k) for k in _KINDS]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *columns], [*keys, *_NAMES])

    return images.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in images.schema.fields[:-1]) + ", " + _FIELDS)


def from_memory(images: DataFrame, data: str = "data") -> DataFrame:
    """images(page_id, data) decoded, with _error."""
    return _decoded(images.select(F.col("page_id").cast("long"), data), lambda content: decode(content or b""))


#: Endings of files that the JVM decodes, through Spark's image source; all others go to `decode`.
JVM_FORMATS = ("jpg", "jpeg", "gif", "wbmp")


def _from_jvm(image: dict) -> np.ndarray:
    """A row of Spark's image source, whose colours are in the order blue, green, red and, if any, alpha."""
    h, w, n = image["height"], image["width"], image["nChannels"]
    if h < 1 or w < 1 or n not in (1, 3, 4):
        raise ImageLoadFailed("the image can't be decoded")
    p = np.frombuffer(image["data"], np.uint8).reshape(h, w, n)
    return p if n == 1 else np.ascontiguousarray(p[:, :, [2, 1, 0, 3][:n]])


def _path(column):
    return F.regexp_replace(column, "^file:/+", "file:///").alias("path")


def names(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, path) of the files that `from_files` reads; their content is not read."""
    return spark.read.format("binaryFile").load(path).select(_path(F.col("path"))).select(F.xxhash64("path").alias("page_id"), "path")


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, path, width, height, channels, data, _error): images of a folder or a pattern; page_id is a hash of the path. PNG, PGM, PPM
    and BMP files are decoded by `decode`, JPEG and GIF files by the JVM, all of them in the same form."""
    keyed = lambda df, content: df.select(F.xxhash64("path").alias("page_id"), "path", content)
    ending = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    files = spark.read.format("binaryFile").load(path).select(_path(F.col("path")), "content").where(~ending.isin(*JVM_FORMATS))
    glob = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in f) for f in JVM_FORMATS) + "}"
    other = spark.read.format("image").option("dropInvalid", False).option("pathGlobFilter", glob).load(path)
    other = other.select(_path(F.col("image.origin")), F.struct("image.height", "image.width", "image.nChannels", "image.data").alias("image"))
    return _decoded(keyed(files, "content"), lambda content: decode(content or b"")).unionByName(_decoded(keyed(other, "image"), _from_jvm))


def from_raw(pages: DataFrame) -> DataFrame:
    """pages(page_id, width, height, channels, data); data of another length than they say raises when the row is read."""
    size = F.col("width").cast("long") * F.col("height") * F.col("channels")
    checked = F.when(F.length("data") == size, F.col("data")).otherwise(F.raise_error(F.lit("InvalidDimensions")).cast("binary"))
    return pages.select("page_id", "width", "height", "channels", checked.alias("data"))
