"""Token ids as length-delimited binary records, with an offset index beside them.

A file is a row of frames: the length of the body (8 bytes), its masked checksum (4), the body, its masked checksum (4), and a line feed. Checksums
are CRC-32C, rotated right by 15 bits plus ``MASK``, so that a checksum of data that holds checksums stays one. All numbers are little-endian. A body is the width
of its ids (1 byte; 2 where the vocabulary has at most 65,536 entries, else 4), the length of the document's id as text (4 bytes; all ones for a null
id), that text, then the ids.

Writing. Documents are dealt by ranges of their ids, sorted within them and framed, a file a range; files are numbered in the order of their
ids. They go through Spark's own writer with its commit, so a lost or repeated task leaves no part of a file, and they reach any store.
The index is made from the written files: (id, file, file_no, offset, length, n_tokens, start); start counts the ids of all documents before it. A loader shuffles the index
and fetches single frames (`fetch`); `read` goes over whole files and verifies every checksum.

Encoding. Texts are cut into pre-tokens as the tokenizer file says; each different one is encoded by the tokenizers library's model
and kept by the worker, up to twice ``CACHE`` of them. A file with another way of cutting is refused.

A null text is empty: it has the end id alone. Null ids come first. Rows of one id follow by a hash of their texts; equal rows are
interchangeable. A very long text is a frame of its own size; files hold about ``FILE_BYTES`` of text besides. An empty table gives no frame and an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelight.llm import bpe
from pagelight.llm.common import Scratch, materialize, quoted, scratch_path, text_batches
from pagelight.llm.ordering import running_start

#: The published mask of checksums and the reflected polynomial of CRC-32C (fixed values).
MASK, POLYNOMIAL = 0xA282EAD8, 0x82F63B78
#: Bytes of text of a file, about; pre-tokens that a worker keeps, and up to which length; the id that ends a document.
FILE_BYTES, CACHE, CACHED_LENGTH, END = 8 << 20, 1 << 18, 40, 0
#: Bytes that a checksum's lanes have.
LANE = 64
NO_ID = 0xFFFFFFFF


# --- checksums ------------------------------------------------------------------------------------


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


_STEP = _table()


def _through(state: np.ndarray, tables: np.ndarray) -> np.ndarray:
    return tables[0][state & 255] ^ tables[1][(state >> 8) & 255] ^ tables[2][(state >> 16) & 255] ^ tables[3][state >> 24]


def _zeros(count: int) -> np.ndarray:
    """What each byte of a state becomes when `count` zeros follow."""
    tables = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(count):
        tables = _STEP[tables & 255] ^ (tables >> 8)
    return tables


#: For the four bytes of a word; for LANE bytes and each doubling of them.
_FOUR, _ZEROS = _zeros(4), [_zeros(LANE)]
for _ in range(40):
    _ZEROS.append(_through(_ZEROS[-1], _ZEROS[-1]))


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each part. Parts are cut into lanes of LANE bytes that advance together; lanes are joined by the shift of what follows them."""
    out = np.zeros(len(parts), np.uint32)
    short = [i for i, p in enumerate(parts) if len(p) < 4]
    for i in short:
        state = 0xFFFFFFFF
        for b in parts[i]:
            state = int(_STEP[(state ^ b) & 255]) ^ (state >> 8)
        out[i] = state ^ 0xFFFFFFFF
    whole = [i for i, p in enumerate(parts) if len(p) >= 4]
    if not whole:
        return out
    sizes = np.array([len(parts[i]) for i in whole])
    lanes = -(-sizes // LANE)
    ends = np.cumsum(lanes)
    data = np.frombuffer(b"".join(x for i in whole for x in (bytes(-len(parts[i]) % LANE), parts[i])), np.uint8).copy()
    first = (ends - lanes) * LANE + lanes * LANE - sizes  # zeros before a part don't count, so the start value goes to its first bytes
    data[first[:, None] + np.arange(4)] ^= 255
    data = data.view("<u4").reshape(-1, LANE // 4)
    state = np.zeros(len(data), np.uint32)
    for k in range(LANE // 4):
        state = _through(state ^ data[:, k], _FOUR)
    follow = np.repeat(ends, lanes) - 1 - np.arange(len(data))
    for bit in range(int(follow.max()).bit_length()):
        at = np.flatnonzero(follow >> bit & 1)
        state[at] = _through(state[at], _ZEROS[bit])
    out[whole] = np.bitwise_xor.reduceat(state, ends - lanes) ^ np.uint32(0xFFFFFFFF)
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)


# --- frames -----------------------------------------------------------------------------------------


def frames(bodies: list[bytes]) -> list[bytes]:
    """Each body with its length and checksums, but for the line feed."""
    lengths = [len(b).to_bytes(8, "little") for b in bodies]
    heads, tails = masked(crc32c(lengths)).astype("<u4"), masked(crc32c(bodies)).astype("<u4")
    return [b"".join((n, h.tobytes(), b, t.tobytes())) for n, h, b, t in zip(lengths, heads, bodies, tails)]


def body(id_text: str | None, ids: bytes, width: int) -> bytes:
    name = b"" if id_text is None else id_text.encode()
    return b"".join((bytes([width]), (NO_ID if id_text is None else len(name)).to_bytes(4, "little"), name, ids))


def unpacked(data: bytes) -> tuple[str | None, np.ndarray]:
    """(id as text, ids) of a body."""
    n = int.from_bytes(data[1:5], "little")
    at = 5 + (0 if n == NO_ID else n)
    return None if n == NO_ID else data[5:at].decode(), np.frombuffer(data, f"<u{data[0]}", offset=at)


def cut(data: bytes, name: str, verify: bool = True) -> tuple[list[tuple[int, int]], list[bytes]]:
    """((offset, length) of each frame, bodies) of a file. Lengths and ends are verified, bodies unless verify is false."""
    places, bodies, lengths, sums, at = [], [], [], [], 0
    view = memoryview(data)
    while at < len(data):
        size = int.from_bytes(view[at : at + 8], "little")
        end = at + 12 + size
        if len(data) < end + 5 or data[end + 4] != 10:
            raise ValueError(f"{name}: the frame at {at} does not end where it should")
        lengths.append(bytes(view[at : at + 8]))
        bodies.append(bytes(view[at + 12 : end]))
        sums.append((int.from_bytes(view[at + 8 : at + 12], "little"), int.from_bytes(view[end : end + 4], "little")))
        places.append((at, end + 5 - at))
        at = end + 5
    if places:
        bad = masked(crc32c(lengths)) != [h for h, _ in sums]
        if verify:
            bad |= masked(crc32c(bodies)) != [t for _, t in sums]
        wrong = np.flatnonzero(bad)
        if len(wrong):
            raise ValueError(f"{name}: the checksum of the frame at {places[wrong[0]][0]} is wrong")
    return places, bodies


def fetch(file: BinaryIO, offset: int, length: int) -> tuple[str | None, np.ndarray]:
    """(id as text, ids) of one frame of an open file, by its entry in the index."""
    file.seek(offset)
    return unpacked(cut(file.read(length), getattr(file, "name", "file"))[1][0])


# --- encoding ---------------------------------------------------------------------------------------


def _latin() -> str:
    """The pre-token pattern for texts of code points under 256, with its classes written out."""
    chosen = lambda kind: "".join(re.escape(chr(c)) for c in range(256) if regex.match(kind, chr(c)))
    letters, numbers, spaces = chosen(r"\p{L}"), chosen(r"\p{N}"), chosen(r"\s")
    pattern = bpe.PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]")
    return pattern.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]")


_latin_pieces, _all_pieces = re.compile(_latin()).findall, regex.compile(bpe.PATTERN).findall


def pieces(text: str) -> list[str]:
    """The pre-tokens of a text without special tokens."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return _all_pieces(text)
    return _latin_pieces(text)


class Encoder(dict):
    """The bytes of the ids of pre-tokens. What is not there yet is encoded by the library's model when it is asked for; of a full table the
    pre-tokens in use move on to the next."""

    def __init__(self, path: str, room: int = CACHE) -> None:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.model, self.room, self.old = library.model, room, {}
        self.width = 2 if library.get_vocab_size() <= 1 << 16 else 4
        self.shown = dict(enumerate(bpe._byte_chars()))
        self.added = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        names = sorted(self.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def packed(self, *ids: int) -> bytes:
        return b"".join([i.to_bytes(self.width, "little") for i in ids])

    def __missing__(self, piece: str) -> bytes:
        found = self.old.pop(piece, None)
        if found is None:
            shown = piece if piece.isascii() and piece.isalnum() else piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.shown)
            found = self.packed(*[t.id for t in self.model.tokenize(shown)])
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= self.room:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        get = self.__getitem__
        if not self.special or not self.special.search(text):
            return b"".join(map(get, pieces(text)))
        parts = self.special.split(text)
        return b"".join(self.packed(self.added[p]) if i % 2 else b"".join(map(get, pieces(p))) for i, p in enumerate(parts))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# --- files ------------------------------------------------------------------------------------------


def write(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES, end: int = END) -> None:
    """Frames of all documents in files under path/records, and path/index."""
    spark = docs.sparkSession
    text_batches(spark)
    tokenizer = tokenizer or bpe.default_path()
    bpe.ByteBpe(tokenizer)  # refuses files with another way of cutting
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // file_bytes))
    rows = rows.withColumn("hash", F.xxhash64("t")).repartitionByRange(n, F.asc_nulls_first("id"), "hash", F.monotonically_increasing_id()).sortWithinPartitions(F.asc_nulls_first("id"), "hash")

    def run(batches):
        e = encoder(tokenizer)
        last = e.packed(end)
        for b in batches:
            bodies = [body(i, e.encode(t.as_py()) + last, e.width) for i, t in zip(b.column(0).to_pylist(), b.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(frames(bodies), pa.binary())], ["value"])

    made = rows.select(F.col("id").cast("string").alias("id"), "t").mapInArrow(run, "value binary")
    made.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/records")
    with Scratch(spark, "records") as scratch:
        _index(scratch, spark, path, docs.schema[id_col].dataType.simpleString()).write.parquet(f"{path}/index")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file, file_no, content)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select(name.alias("file"), F.regexp_extract(name, r"part-(\d+)", 1).cast("long").alias("file_no"), "content")


def _each(files: DataFrame, fields: str, row: Callable[[list[tuple[int, int]], list[bytes]], Iterator[tuple]], verify: bool = True) -> DataFrame:
    """(file, file_no, *fields): row gives the values of every frame of a file."""
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    names = [f.split()[0] for f in fields.split(", ")]
    types = [kinds[f.split()[1]] for f in fields.split(", ")]

    def run(batches):
        for b in batches:
            for file, number, content in zip(*b.columns):
                rows = list(row(*cut(content.as_py(), file.as_py(), verify)))
                if rows:
                    own = [pa.array([file.as_py()] * len(rows), pa.string()), pa.array([number.as_py()] * len(rows), pa.int64())]
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, k) for c, k in zip(zip(*rows), types))], ["file", "file_no", *names])

    return files.mapInArrow(run, f"file string, file_no long, {fields}")


def _index(scratch: Scratch, spark: SparkSession, path: str, kind: str) -> DataFrame:
    def row(places, bodies):
        before = 0
        for (offset, length), b in zip(places, bodies):
            name, ids = unpacked(b)
            yield name, offset, length, len(ids), before
            before += len(ids)

    found = scratch.write(_each(_files(spark, path), "id string, offset long, length long, n_tokens long, before long", row, verify=False), "frames")
    sizes = scratch.write(found.groupBy("file_no").agg(F.sum("n_tokens").alias("size")), "sizes")
    starts = running_start(scratch, sizes, "file_no", "size").select(F.col("file_no").alias("_no"), F.col("start").alias("_start"))
    placed = found.join(starts, F.col("file_no") == F.col("_no"))
    return placed.select(F.col("id").cast(kind).alias("id"), "file", "file_no", "offset", "length", "n_tokens", (F.col("before") + F.col("_start")).alias("start"))


def index(spark: SparkSession, path: str) -> DataFrame:
    """(id, file, file_no, offset, length, n_tokens, start)."""
    return spark.read.parquet(f"{path}/index")


def _with_index(spark: SparkSession, path: str, read: DataFrame, *fields: str) -> DataFrame:
    entries = index(spark, path).select(F.col("file_no").alias("_no"), F.col("offset").alias("_offset"), "id", "start")
    return read.join(entries, (F.col("file_no") == F.col("_no")) & (F.col("offset") == F.col("_offset"))).select("id", "start", *fields)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, ids) of all frames, verified."""
    found = _each(_files(spark, path), "offset long, ids array<int>", lambda places, bodies: ((o, unpacked(b)[1].astype(np.int32)) for (o, _), b in zip(places, bodies)))
    return _with_index(spark, path, found, "ids")


def shuffled(spark: SparkSession, path: str, seed: int, ranges: int | None = None) -> DataFrame:
    """`read`, its rows in an order drawn by the seed: dealt by ranges of a hash of seed and start, sorted within them."""
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = F.xxhash64(F.lit(seed), "start")
    return read(spark, path).withColumn("rank", drawn).repartitionByRange(n, "rank", "start").sortWithinPartitions("rank", "start")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of all frames, verified; the checksum is that of the ids in four bytes each."""

    def row(places, bodies):
        for (offset, _), b in zip(places, bodies):
            ids = unpacked(b)[1]
            yield offset, len(ids), zlib.crc32(ids.astype("<u4").tobytes())

    return _with_index(spark, path, _each(_files(spark, path), "offset long, n_tokens long, ids_crc32 long", row), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """documents written to the shared folder and read back, as `digests`, written."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-records")
    write(docs, path, tokenizer, id_col, text_col)
    return materialize(digests(spark, path), "token-digests")
