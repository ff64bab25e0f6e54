"""Model containers: reading a recognition model's parts from their bytes.

A model is a parameter of bounded size (64 MiB at most), read once on the driver and broadcast. Its tables (entries,
characters, codes, word graphs, layers) are also DataFrames.
"""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from pagelight.operators.network import Layer

ENTRIES, MOST_BYTES = 24, 64 << 20
#: Places of the parts that recognition needs (fixed values of the format).
LSTM, PUNC, SYSTEM, NUMBER, CHARSET, RECODER = 17, 18, 19, 20, 21, 22
#: Training flags: whole-number weights; recoded characters. A layer's flag: learning rates follow its children.
INT_MODE, RECODED, OWN_RATES = 0x01, 0x40, 64
#: What a serialized type name becomes (fixed values of the format).
KINDS = {
    "Input": "input", "Convolve": "convolve", "Maxpool": "maxpool", "Reconfig": "maxpool", "Series": "series", "Parallel": "parallel", "Replicated": "parallel", "DepParUDLSTM": "parallel",
    "ParBidiLSTM": "parallel", "Par2dLSTM": "parallel", "RTLReversed": "reversed", "TTBReversed": "reversed", "XYTranspose": "transposed", "LSTM": "lstm", "SummLSTM": "lstm", "LSTMSoftmax": "lstm_softmax",
    "LSTMBinarySoftmax": "lstm_softmax", "Softmax": "softmax", "SoftmaxNoCTC": "softmax", "Logistic": "sigmoid", "LinLogistic": "sigmoid", "Tanh": "tanh", "LinTanh": "tanh", "Relu": "relu", "Linear": "linear",
}


class ModelError(ValueError):
    """A part that isn't as the format wants; the message begins with the error's name."""


class Reader:
    """Little-endian values from bytes, one after the other."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = memoryview(data), 0

    def remaining(self) -> int:
        return len(self.data) - self.at

    def bytes(self, n: int) -> bytes:
        if n < 0 or n > self.remaining():
            raise ModelError("UnexpectedEof")
        self.at += n
        return bytes(self.data[self.at - n : self.at])

    def skip(self, n: int) -> None:
        self.bytes(n)

    def values(self, kind: str, n: int = 1):
        """n values of a struct kind: b, B, i, I, f, d."""
        found = struct.unpack(f"<{n}{kind}", self.bytes(n * struct.calcsize(f"<{kind}")))
        return found[0] if n == 1 else found

    def string(self) -> str:
        return self.bytes(self.values("I")).decode()


HEAD = 4 + 8 * ENTRIES


def places(head: bytes, size: int) -> list[tuple[int, int, int]]:
    """(place, offset, size) of the entries that are there, from the first bytes of a container and its size; each ends where the next one that is there begins."""
    if size < HEAD or len(head) < HEAD:
        raise ModelError("FileTooSmall")
    order = "<"
    if struct.unpack("<I", head[:4])[0] > 1000:
        order = ">"
    if struct.unpack(order + "I", head[:4])[0] != ENTRIES:
        raise ModelError("BadEntryCount")
    offsets = struct.unpack(f"{order}{ENTRIES}q", head[4:HEAD])
    there = [(i, o) for i, o in enumerate(offsets) if o != -1]
    if any(not 0 <= o < size for _, o in there):
        raise ModelError("OffsetOutOfRange")
    ends = [o for _, o in there[1:]] + [size]
    if any(e < o for (_, o), e in zip(there, ends)):
        raise ModelError("OffsetOutOfRange")
    return [(i, o, e - o) for (i, o), e in zip(there, ends)]


def container(data: bytes) -> list[tuple[int, int, bytes]]:
    """(place, offset, payload) of the entries that are there."""
    return [(i, o, data[o : o + n]) for i, o, n in places(data[:HEAD], len(data))]


def entry_table(spark: SparkSession, data: bytes) -> DataFrame:
    """(idx, offset, size, payload)."""
    rows = [(i, o, len(p), bytearray(p)) for i, o, p in container(data)]
    return spark.createDataFrame(rows, "idx int, offset long, size long, payload binary")


def charset(data: bytes) -> list[tuple]:
    """(id, unichar, properties, script, other_case, direction, mirror, normed) of a character list."""
    if not data:
        raise ModelError("EmptyData")
    head, *lines = data.decode().split("\n")
    if not head.strip().isdigit():
        raise ModelError("BadCharCount")
    count, out = int(head), []
    plain = lambda s: " " if s == "NULL" else s
    for line in filter(None, lines):
        if len(out) >= count:
            raise ModelError("TooManyEntries")
        name, *rest = line.split("\t#")[0].rstrip().split(" ")
        name = plain(name)
        if not rest:
            out.append((len(out), name, 0, "", 0, 0, 0, ""))
            continue
        try:
            properties = int(rest[0], 16)
        except ValueError as e:
            raise ModelError("BadProperties") from e
        if not 0 <= properties < 256:
            raise ModelError("BadProperties")
        more = rest[2:] if len(rest) > 1 and "," in rest[1] else rest[1:]
        numbers = more[1:4]
        if not all(x.isdigit() for x in numbers):
            raise ModelError("BadIntField")
        case, direction, mirror = [int(x) for x in numbers] + [0] * (3 - len(numbers))
        if direction > 255:
            raise ModelError("BadIntField")
        out.append((len(out), name, properties, more[0] if more else "Common", case, direction, mirror, plain(more[4]) if len(more) > 4 else name))
    if len(out) < count:
        raise ModelError("TooFewEntries")
    return out


def charset_table(spark: SparkSession, data: bytes) -> DataFrame:
    return spark.createDataFrame(charset(data), "id int, unichar string, properties int, script string, other_case long, direction int, mirror long, normed string")


def recoder(reader: Reader) -> list[tuple[int, bool, list[int]]]:
    """(id, self_normalized, codes)."""
    out = []
    for i in range(reader.values("I")):
        own, n = reader.values("b"), reader.values("i")
        if not 0 <= n <= 9:
            raise ModelError("InvalidRecoderEntry")
        codes = reader.values("i", n) if n else ()
        out.append((i, own != 0, [codes] if n == 1 else list(codes)))
    return out


def recoder_table(spark: SparkSession, data: bytes) -> DataFrame:
    return spark.createDataFrame(recoder(Reader(data)), "id int, self_normalized boolean, codes array<int>")


def word_graph(data: bytes) -> tuple[int, np.ndarray]:
    """(bits of a letter, packed edges) of a word graph."""
    if len(data) < 10:
        raise ModelError("DataTooSmall")
    magic, letters, edges = struct.unpack("<hii", data[:10])
    for wrong, name in ((magic != 42, "BadMagicNumber"), (letters <= 0, "BadUnicharsetSize"), (edges <= 0, "BadEdgeCount"), (len(data) < 10 + 8 * edges, "TruncatedEdges")):
        if wrong:
            raise ModelError(name)
    return max(1, letters.bit_length()), np.frombuffer(data, "<i8", edges, 10)


def edge_table(spark: SparkSession, data: bytes) -> tuple[int, DataFrame]:
    """(bits of a letter, (edge, rec))."""
    bits, edges = word_graph(data)
    return bits, spark.createDataFrame(list(enumerate(edges.tolist())), "edge long, rec long")


def weights(reader: Reader) -> tuple[np.ndarray, np.ndarray | None]:
    """(matrix, scales): single-precision rows without scales, or whole-number rows with a scale each. The last column is the bias."""
    mode = reader.values("B")
    if not mode & 0x80:
        raise ModelError("UnsupportedOldFormat")
    rows, columns = reader.values("i", 2)
    if rows <= 0 or columns <= 0:
        raise ModelError("InvalidDimensions")
    if not mode & 0x01:
        reader.skip(8)
        return np.frombuffer(reader.bytes(8 * rows * columns), "<f8").reshape(rows, columns).astype(np.float32), None
    reader.skip(1)
    matrix = np.frombuffer(reader.bytes(rows * columns), np.int8).reshape(rows, columns)
    n = reader.values("I")
    given = np.frombuffer(reader.bytes(8 * n), "<f8") / 127.0
    scales = np.ones(rows)
    scales[: min(n, rows)] = given[:rows]
    return matrix, scales


def network(reader: Reader) -> Layer:
    """The layer that begins here, with all that it holds."""
    if reader.values("b") != 0:
        raise ModelError("InvalidTypeName")
    kind = KINDS.get(name := reader.string())
    if kind is None:
        raise ModelError(f"UnsupportedNetworkType: {name}")
    reader.skip(2)
    flags, inputs, outputs, _ = reader.values("i", 4)
    reader.string()
    inputs, outputs = max(inputs, 0), max(outputs, 0)
    if kind == "input":
        reader.skip(20)
        return Layer(kind, inputs, outputs)
    if kind in ("convolve", "maxpool"):
        x, y = reader.values("i", 2)
        if kind == "convolve":
            y = max(y, 0)
            return Layer(kind, inputs, inputs * (2 * x + 1) * (2 * y + 1), size=(x, y))
        return Layer(kind, inputs, inputs, size=(x, y if y > 0 else 1))
    if kind in ("series", "parallel", "reversed", "transposed"):
        children = [network(reader) for _ in range(reader.values("I"))]
        if flags & OWN_RATES:
            reader.skip(4 * reader.values("I"))
        if kind == "parallel":
            return Layer(kind, inputs, sum(c.outputs for c in children), children)
        if kind != "series" and len(children) != 1:
            raise ModelError("InvalidDimensions")
        return Layer(kind, children[0].inputs if children else 0, children[-1].outputs if children else 0, children)
    if kind.startswith("lstm"):
        both = reader.values("i")
        if both <= 0:
            raise ModelError("InvalidDimensions")
        gates = [weights(reader)]
        states = len(gates[0][0])
        if both - (outputs if kind == "lstm_softmax" else 0) == inputs + 2 * states:
            raise ModelError("Unsupported2DLSTM")
        gates += [weights(reader) for _ in range(3)]
        if kind != "lstm":
            raise ModelError(f"UnsupportedNetworkType: {name}")
        return Layer(kind, inputs, states, matrices=gates)
    matrix = weights(reader)
    return Layer(kind, matrix[0].shape[1] - 1, matrix[0].shape[0], matrices=[matrix])


def layer_rows(root: Layer, path: str = "0") -> list[tuple]:
    """(path, kind, inputs, outputs) of a layer and all below it."""
    out = [(path, root.kind, root.inputs, root.outputs)]
    for i, child in enumerate(root.children):
        out += layer_rows(child, f"{path}.{i}")
    return out


def encoded(codes: list[tuple[int, bool, list[int]]], unichar_id: int) -> list[int] | None:
    """The codes of a character; none where the id is beyond the table."""
    return codes[unichar_id][2] if 0 <= unichar_id < len(codes) else None


@dataclass
class Model:
    network: Layer
    characters: list[tuple]
    codes: list[tuple] | None
    spec: str
    flags: int
    null_code: int
    graphs: dict[str, tuple[int, np.ndarray]] = field(default_factory=dict)

    @property
    def classes(self) -> int:
        return self.network.outputs

    @property
    def inputs(self) -> int:
        return self.network.inputs

    @property
    def sizes(self) -> dict[str, int]:
        """Characters, code entries and edges of each word graph."""
        return {"characters": len(self.characters), "codes": len(self.codes or []), **{name: len(edges) for name, (_, edges) in self.graphs.items()}}

    @property
    def int_mode(self) -> bool:
        return bool(self.flags & INT_MODE)


def own_codes(lstm: bytes) -> list[tuple[int, bool, list[int]]]:
    """The code entries that follow a network in its own component, if it says that there are some."""
    reader = Reader(lstm)
    network(reader), reader.string()
    flags = reader.values("i")
    reader.skip(24)
    return recoder(reader) if flags & RECODED else []


def load(data: bytes) -> Model:
    """A whole model. Word graphs that can't be read are left out, everything else must be there."""
    entries = {i: p for i, _, p in container(data)}
    if LSTM not in entries:
        raise ModelError("MissingLSTMComponent")
    reader = Reader(entries[LSTM])
    root, spec = network(reader), reader.string()
    flags, _, _, null_code = reader.values("i", 4)
    reader.skip(12)
    if CHARSET not in entries:
        raise ModelError("MissingUnicharset")
    codes = None
    if flags & RECODED:
        codes = recoder(Reader(entries[RECODER]) if RECODER in entries else reader)
    graphs = {}
    for name, place in (("punctuation", PUNC), ("system", SYSTEM), ("number", NUMBER)):
        try:
            graphs[name] = word_graph(entries[place])
        except (KeyError, ModelError):
            continue
    return Model(root, charset(entries[CHARSET]), codes, spec, flags, null_code, graphs)


def find(explicit: str | None = None, name: str = "eng.traineddata") -> str:
    """The first model file that is there: the one named, here, in $TESSDATA_PREFIX, in the system's folder."""
    places = [explicit] if explicit else [name, os.path.join(os.environ.get("TESSDATA_PREFIX", ""), name), f"/usr/share/tessdata/{name}"]
    for p in places:
        if os.path.isfile(p):
            return p
    raise FileNotFoundError(f"ModelNotFound: {', '.join(places)}")


def read(path: str) -> bytes:
    if os.path.getsize(path) > MOST_BYTES:
        raise ModelError("a model file of over 64 MiB")
    with open(path, "rb") as f:
        return f.read()
