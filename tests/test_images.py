"""Image formats: every form of PNG against the samples it was made of, BMP, and what the JVM decodes."""

import struct
import zlib

import numpy as np
import pytest

from pagelight.sources import images

RNG = np.random.default_rng(11)


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(samples, bits):
    """Rows of samples, packed, each with another filter."""
    h, w, n = samples.shape
    step, above, out = max(1, n * bits // 8), None, b""
    for y in range(h):
        flat = samples[y].ravel()
        if bits == 16:
            row = flat.astype(">u2").tobytes()
        elif bits == 8:
            row = flat.astype(np.uint8).tobytes()
        else:
            places = "".join(f"{v:0{bits}b}" for v in flat)
            row = int(places.ljust(-(-len(places) // 8) * 8, "0"), 2).to_bytes(-(-len(places) // 8), "big")
        above = above or bytes(len(row))
        kind, made = y % 5, bytearray()
        for i, v in enumerate(row):
            a, b, c = row[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            paeth = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            made.append((v - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        out += bytes([kind]) + bytes(made)
        above = row
    return out


def png(samples, bits, colour, interlaced=False, palette=None, clear=None):
    h, w, _ = samples.shape
    if interlaced:
        body = b""
        for k in range(7):  # the pixels whose place in the 8 x 8 scheme is this pass
            scheme = np.array([[0, 5, 3, 5, 1, 5, 3, 5], [6] * 8, [4, 5, 4, 5, 4, 5, 4, 5], [6] * 8, [2, 5, 3, 5, 2, 5, 3, 5], [6] * 8, [4, 5, 4, 5, 4, 5, 4, 5], [6] * 8])
            rows = [[samples[y, x] for x in range(w) if scheme[y % 8, x % 8] == k] for y in range(h)]
            rows = [r for r in rows if r]
            body += filtered(np.array(rows), bits) if rows else b""
    else:
        body = filtered(samples, bits)
    packed = zlib.compress(body)
    parts = [chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, colour, 0, 0, interlaced))]
    parts += [chunk(b"PLTE", palette.tobytes())] if palette is not None else []
    parts += [chunk(b"tRNS", clear)] if clear is not None else []
    return b"\x89PNG\r\n\x1a\n" + b"".join([*parts, chunk(b"IDAT", packed[:7]), chunk(b"IDAT", packed[7:]), chunk(b"IEND", b"")])


def made(h, w, n, bits):
    return RNG.integers(0, 2**bits, (h, w, n))


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize("size", [(1, 1), (5, 3), (11, 13), (17, 9)])
def test_png_forms(interlaced, size):
    for bits in (1, 2, 4, 8, 16):
        for colour, n in ((0, 1), (2, 3), (4, 2), (6, 4)):
            if bits < 8 and colour:
                continue
            s = made(*size, n, bits)
            want = s >> 8 if bits == 16 else s * (255 // (2**bits - 1))
            assert (images.decode(png(s, bits, colour, interlaced)) == want).all(), (bits, colour)
        key = made(1, 1, 1, bits)[0, 0]
        s = made(*size, 1, bits)
        got = images.decode(png(s, bits, 0, interlaced, clear=key.astype(">u2").tobytes()))
        assert got.shape[2] == 2 and (got[:, :, 1] == np.where(s[:, :, 0] == key, 0, 255)).all()
        if bits <= 8:
            palette, s = RNG.integers(0, 256, (2**bits, 3)).astype(np.uint8), made(*size, 1, bits)
            assert (images.decode(png(s, bits, 3, interlaced, palette)) == palette[s[:, :, 0]]).all()
            alpha = bytes(range(0, 2**bits, 1))[: 2 ** (bits - 1)]
            got = images.decode(png(s, bits, 3, interlaced, palette, alpha))
            assert (got[:, :, 3] == np.array([*alpha, *[255] * (2**bits - len(alpha))])[s[:, :, 0]]).all()


def test_png_that_is_broken():
    good = png(made(4, 4, 1, 8), 8, 0)
    for bad in (good[:40], good[:8], good.replace(b"IHDR", b"IHDX"), png(made(4, 4, 1, 8), 8, 3), b"\x89PNG\r\n\x1a\n"):
        with pytest.raises(images.ImageLoadFailed):
            images.decode(bad)


def bmp(p, bits=24, upside=False):
    h, w, _ = p.shape
    table = b""
    if bits == 8:
        table = bytes(v for i in range(256) for v in (i, i, i, 0))
        rows = [p[y, :, 0].tobytes() for y in range(h)]
    else:
        rows = [np.dstack((p[y : y + 1, :, ::-1], np.zeros((1, w, 1), np.uint8)))[0][:, : bits // 8].tobytes() for y in range(h)]
    rows = [r + bytes(-len(r) % 4) for r in rows]
    start = 54 + len(table)
    return b"BM" + struct.pack("<IHHI", start + len(rows) * len(rows[0]), 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, -h if upside else h, 1, bits, 0, 0, 0, 0, 0, 0) + table + b"".join(rows if upside else rows[::-1])


def test_bmp():
    p = RNG.integers(0, 256, (7, 5, 3)).astype(np.uint8)
    assert (images.decode(bmp(p)) == p).all() and (images.decode(bmp(p, upside=True)) == p).all() and (images.decode(bmp(p, 32)) == p).all()
    gray = np.repeat(p[:, :, :1], 3, axis=2)
    assert (images.decode(bmp(gray, 8)) == gray).all()
    with pytest.raises(images.ImageLoadFailed):
        images.decode(bmp(p)[:60])


def test_formats_in_one_scan(spark, tmp_path):
    """A gray and a colour JPEG and a GIF written and read by the JVM, beside PNG, BMP and files that are no images."""
    jvm = spark.sparkContext._jvm
    want = {}
    for name, kind, form in (("a.jpg", 5, "jpg"), ("b.JPEG", 10, "jpg"), ("c.gif", 5, "gif")):
        picture = jvm.java.awt.image.BufferedImage(12, 9, kind)
        for y in range(9):
            for x in range(12):
                picture.setRGB(x, y, (x * 20 << 16) + (y * 25 << 8) + 40)
        assert jvm.javax.imageio.ImageIO.write(picture, form, jvm.java.io.File(str(tmp_path / name)))
        read = jvm.javax.imageio.ImageIO.read(jvm.java.io.File(str(tmp_path / name)))
        rgb = np.array([[read.getRGB(x, y) & 0xFFFFFF for x in range(12)] for y in range(9)])
        pixels = np.dstack((rgb >> 16, rgb >> 8 & 255, rgb & 255)).astype(np.uint8)
        if name == "b.JPEG":
            raster = read.getRaster()
            pixels = np.array([[raster.getSample(x, y, 0) for x in range(12)] for y in range(9)], np.uint8)[:, :, None]
        want[name] = pixels
    want["d.png"], want["e.bmp"] = (RNG.integers(0, 256, (9, 12, 3)).astype(np.uint8) for _ in range(2))
    (tmp_path / "d.png").write_bytes(png(want["d.png"], 8, 2))
    (tmp_path / "e.bmp").write_bytes(bmp(want["e.bmp"]))
    for name in ("f.jpg", "g.png", "h", "i.bmp"):
        (tmp_path / name).write_bytes(b"\0\1\2\3")
    got = {r["path"].rsplit("/", 1)[-1]: r for r in images.from_files(spark, str(tmp_path)).collect()}
    assert set(got) == {*want, "f.jpg", "g.png", "h", "i.bmp"} and len({r["page_id"] for r in got.values()}) == 9
    for name, pixels in want.items():
        r = got[name]
        assert (r["height"], r["width"], r["channels"], r["_error"]) == (*pixels.shape, None), name
        assert bytes(r["data"]) == pixels.tobytes(), name
    assert all("ImageLoadFailed" in got[n]["_error"] and got[n]["width"] == 0 for n in ("f.jpg", "g.png", "h", "i.bmp"))
