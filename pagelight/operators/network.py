"""Network layers over activations.

Layers without state are DataFrame operations on activations(id, t, vec). A whole network runs on one line at a time (a
line's state goes from step to step), as a small NumPy function in `mapInArrow`, lines dealt over the tasks; the
model is broadcast. A grid of rows x columns is flattened row by row: t = y * columns + x.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelight.functions import vectors

# --- as DataFrame operations ------------------------------------------------------------------------


def fully_connected(activations: DataFrame, rows: list[list[float]], activation: str = "tanh") -> DataFrame:
    """Every step's vector through a matrix (the last column is the bias) and an activation function."""
    each = {"tanh": vectors.tanh_fast, "sigmoid": vectors.sigmoid_fast, "relu": vectors.relu, "linear": lambda x: x}
    out = vectors.mat_vec(vectors.matrix(rows), F.col("vec"))
    out = vectors.softmax(out) if activation == "softmax" else vectors.let(out, lambda v: F.transform(v, each[activation]))
    return activations.withColumn("vec", out)


def convolve(activations: DataFrame, half_x: int, half_y: int, columns: str = "columns", rows: str = "rows") -> DataFrame:
    """Each place's neighbourhood stacked, columns before rows, zeros outside: activations has `rows` and `columns` of its grid.

    A step is sent to the places whose neighbourhood it is in, and each place puts together what came."""
    zero = F.transform("vec", lambda _: F.lit(0.0).cast("double"))
    c, r = F.col(columns), F.col(rows)
    at = activations.select("id", rows, columns, "vec", (F.col("t") % c).alias("x"), F.floor(F.col("t") / c).cast("int").alias("y"))
    moves = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(k).alias("k")) for k, (dx, dy) in enumerate((dx, dy) for dx in range(-half_x, half_x + 1) for dy in range(-half_y, half_y + 1))])
    sent = at.select("id", rows, columns, "x", "y", "vec", F.explode(moves).alias("m")).select("id", rows, columns, (F.col("x") - F.col("m.dx")).alias("x"), (F.col("y") - F.col("m.dy")).alias("y"), "m.k", F.transform("vec", lambda v: v.cast("double")).alias("vec"), zero.alias("zero"))
    sent = sent.where((F.col("x") >= 0) & (F.col("x") < c) & (F.col("y") >= 0) & (F.col("y") < r))
    got = sent.groupBy("id", rows, columns, "x", "y").agg(F.map_from_entries(F.collect_list(F.struct("k", "vec"))).alias("by"), F.first("zero").alias("zero"))
    got = got.where(F.map_contains_key("by", F.lit((2 * half_x + 1) * (2 * half_y + 1) // 2)))  # places that have a step of their own
    patch = F.flatten(F.transform(F.sequence(F.lit(0), F.lit((2 * half_x + 1) * (2 * half_y + 1) - 1)), lambda k: F.coalesce(F.try_element_at("by", k), F.col("zero"))))
    return got.select("id", (F.col("y") * c + F.col("x")).alias("t"), rows, columns, patch.alias("vec"))


def reverse(activations: DataFrame) -> DataFrame:
    """The steps of each id (`rows` x `columns` of them) in reverse order."""
    return activations.withColumn("t", F.col("rows") * F.col("columns") - 1 - F.col("t"))


def transpose(activations: DataFrame) -> DataFrame:
    """The grid with rows and columns changed over."""
    c, r = F.col("columns"), F.col("rows")
    moved = ((F.col("t") % c) * r + F.floor(F.col("t") / c)).cast("int")
    return activations.select("id", moved.alias("t"), c.alias("rows"), r.alias("columns"), "vec")


def parallel(first: DataFrame, second: DataFrame) -> DataFrame:
    """Features of two outputs of the same steps side by side."""
    other = second.select("id", "t", F.col("vec").alias("_more"))
    return first.join(other, ["id", "t"]).withColumn("vec", F.concat("vec", "_more")).drop("_more")


def recurrent(activations: DataFrame, gates: list[list[list[float]]]) -> DataFrame:
    """activations(id, t, vec) through an LSTM layer in the order of t, to (id, t, vec). gates are the rows of the cell, input, forget and output matrices, each row
    over a step, the last output and the bias. A line's steps are one array, and its state goes from one to the next in an aggregate
    over that: no Python, and no task that holds more than a line at a time."""
    states = len(gates[0])
    held = [vectors.matrix(g) for g in gates]
    each = F.sequence(F.lit(0), F.lit(states - 1))
    zeros = F.array(*[F.lit(0.0)] * states)

    def step(state, x):
        joined = F.concat(F.transform(x["vec"], lambda v: v.cast("double")), state["h"])
        through = F.struct(*[vectors.mat_vec(m, joined).alias(n) for m, n in zip(held, ("cell", "gate_in", "forget", "gate_out"))])

        def output(p):
            kept = lambda i: state["c"][i] * vectors.sigmoid_fast(p["forget"][i]) + vectors.tanh_fast(p["cell"][i]) * vectors.sigmoid_fast(p["gate_in"][i])
            cells = F.transform(each, lambda i: F.greatest(F.lit(-100.0), F.least(F.lit(100.0), kept(i))))
            shown = lambda c: F.transform(each, lambda i: vectors.tanh_fast(c[i]) * vectors.sigmoid_fast(p["gate_out"][i]))
            return vectors.let(cells, lambda c: vectors.let(shown(c), lambda h: F.struct(c.alias("c"), h.alias("h"), F.concat(state["out"], F.array(F.struct(x["t"].alias("t"), h.alias("vec")))).alias("out"))))

        return vectors.let(through, output)

    begin = F.struct(zeros.alias("c"), zeros.alias("h"), F.expr("cast(array() as array<struct<t:int,vec:array<double>>>)").alias("out"))
    lines = activations.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("t").cast("int").alias("t"), "vec"))).alias("steps"))
    return lines.select("id", F.explode(F.aggregate("steps", begin, step, lambda s: s["out"])).alias("s")).select("id", "s.t", "s.vec")


# --- a whole network on one grid ----------------------------------------------------------------------


@dataclass
class Layer:
    """A layer: kind, sizes, children, (matrix, scales) pairs, and half widths or scales along x and y."""

    kind: str
    inputs: int
    outputs: int
    children: list[Layer] = field(default_factory=list)
    matrices: list[tuple[np.ndarray, np.ndarray | None]] = field(default_factory=list)
    size: tuple[int, int] = (0, 0)


def _table(values: list[float], reach: float):
    held = np.array(values, np.float32)

    def curve(x: np.ndarray) -> np.ndarray:
        place = np.clip((x + np.float32(reach)) * np.float32((len(held) - 1) / (2 * reach)), 0, len(held) - 1).astype(np.float32)
        low = np.floor(place).astype(np.int64)
        part = place - low.astype(np.float32)
        out = held[low] * (1 - part) + held[np.minimum(low + 1, len(held) - 1)] * part
        return np.where(x <= -reach, np.float32(-1 if held[0] < -0.5 else 0), np.where(x >= reach, np.float32(1), out)).astype(np.float32)

    return curve


_sigmoid, _tanh = _table(vectors.sigmoid_table(), vectors.SIGMOID_RANGE), _table(vectors.tanh_table(), vectors.TANH_RANGE)


def _away(x: np.ndarray) -> np.ndarray:
    return np.clip(np.sign(x) * np.floor(np.abs(x) + 0.5), -127, 127).astype(np.int64)


def product(matrix: np.ndarray, scales: np.ndarray | None, x: np.ndarray) -> np.ndarray:
    """Vectors x (steps x inputs) through a matrix; whole-number matrices take x in 127ths of its largest size (1 at least)."""
    if scales is None:
        return x @ matrix[:, :-1].T + matrix[:, -1]
    unit = np.maximum(1.0, np.abs(x.astype(np.float64)).max(axis=1, initial=0.0))[:, None] / 127.0
    whole = np.concatenate((_away(x / unit), _away(1.0 / unit)), axis=1)
    return ((whole @ matrix.astype(np.int64).T) * scales * unit).astype(np.float32)


def _lstm(layer: Layer, x: np.ndarray) -> np.ndarray:
    """The four matrices are stacked, so that a step is one product and its input is made whole numbers once."""
    state, last, out = np.zeros(layer.outputs, np.float32), np.zeros(layer.outputs, np.float32), []
    matrices, scales = [np.concatenate([m for m, _ in layer.matrices]), [s for _, s in layer.matrices]]
    whole = all(s is not None for s in scales)
    if any(s is not None for s in scales) != whole:  # of both kinds: each on its own
        through = lambda v: np.concatenate([product(m, s, v)[0] for m, s in layer.matrices])
    else:
        stacked = np.concatenate(scales) if whole else None
        through = lambda v: product(matrices, stacked, v)[0]
    for step in x:
        cell, gate_in, forget, gate_out = through(np.concatenate((step, last))[None, :]).reshape(4, -1)
        state = np.clip(state * _sigmoid(forget) + _tanh(cell) * _sigmoid(gate_in), -100, 100).astype(np.float32)
        last = _tanh(state) * _sigmoid(gate_out)
        out.append(last)
    return np.array(out, np.float32).reshape(-1, layer.outputs)


def forward(layer: Layer, x: np.ndarray) -> np.ndarray:
    """x (rows x columns x features) through a layer."""
    h, w, n = x.shape
    flat = x.reshape(-1, n)
    if layer.kind == "series":
        for child in layer.children:
            x = forward(child, x)
        return x
    if layer.kind == "parallel":
        return np.concatenate([forward(c, x) for c in layer.children], axis=2)
    if layer.kind == "reversed":
        out = forward(layer.children[0], flat[::-1].reshape(h, w, n))
        return out.reshape(-1, out.shape[2])[::-1].reshape(out.shape)
    if layer.kind == "transposed":
        return forward(layer.children[0], x.transpose(1, 0, 2)).transpose(1, 0, 2)
    if layer.kind == "convolve":
        a, b = layer.size
        wide = np.pad(x, ((b, b), (a, a), (0, 0)))
        return np.concatenate([wide[dy : dy + h, dx : dx + w] for dx in range(2 * a + 1) for dy in range(2 * b + 1)], axis=2)
    if layer.kind == "maxpool":
        a, b = layer.size
        wide = np.pad(x, ((0, -h % b), (0, -w % a), (0, 0)), constant_values=-np.inf)
        return wide.reshape(wide.shape[0] // b, b, wide.shape[1] // a, a, n).max(axis=(1, 3))
    if layer.kind == "lstm":
        return _lstm(layer, flat).reshape(h, w, -1)
    if layer.kind == "input":
        return x
    y = product(*layer.matrices[0], flat)
    if layer.kind == "softmax":
        e = np.exp(y - y.max(axis=1, keepdims=True))
        y = e / e.sum(axis=1, keepdims=True)
    else:
        y = {"tanh": _tanh, "sigmoid": _sigmoid, "relu": lambda v: np.maximum(v, 0), "linear": lambda v: v}[layer.kind](y)
    return y.astype(np.float32).reshape(h, w, -1)
