"""Vector functions as column expressions over arrays; all stay in the JVM.

What several elements need (a maximum, a sum, a scale) is computed once and bound by `let`, not once for each element.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

#: Entries of the activation tables, and the input ranges they cover.
TABLE, SIGMOID_RANGE, TANH_RANGE = 256, 8.0, 4.0


def let(value, body):
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sigmoid(x):
    return 1 / (1 + F.exp(-F.greatest(F.lit(-88.0), F.least(F.lit(88.0), x))))


def tanh(x):
    return 2 * sigmoid(2 * x) - 1


def relu(x):
    return F.greatest(x, F.lit(0.0))


def _curve(reach: float, f) -> list[float]:
    return [f(i / (TABLE - 1) * 2 * reach - reach) for i in range(TABLE)]


def sigmoid_table() -> list[float]:
    return _curve(SIGMOID_RANGE, lambda x: 1 / (1 + math.exp(-x)))


def tanh_table() -> list[float]:
    return _curve(TANH_RANGE, lambda x: 2 / (1 + math.exp(-2 * x)) - 1)


def _interpolated(x, table: list[float], reach: float, low: float):
    """Between the two nearest entries; beyond the range the limits themselves."""
    held = F.array(*[F.lit(v) for v in table])
    place = (x + reach) * ((TABLE - 1) / (2 * reach))
    at = F.floor(place).cast("int")
    part = place - at
    inside = F.element_at(held, at + 1) * (1 - part) + F.element_at(held, F.least(at + 2, F.lit(TABLE))) * part
    return F.when(x <= -reach, low).when(x >= reach, 1.0).otherwise(inside)


def sigmoid_fast(x):
    return _interpolated(x, sigmoid_table(), SIGMOID_RANGE, 0.0)


def tanh_fast(x):
    return _interpolated(x, tanh_table(), TANH_RANGE, -1.0)


def softmax(v):
    """Of an array, shifted by its maximum; empty stays empty."""
    shifted = let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, y: a + y)
    return let(shifted, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def dot(a, b):
    """Of numbers, in double precision; 0 for empty arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dot_int(a, b):
    """Of whole numbers, exactly."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def _whole(x):
    """Rounded half away from zero, within -127 to 127."""
    return F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.signum(x) * F.floor(F.abs(x) + 0.5))).cast("int")


def quantized_row(v):
    """struct(scale, q): a row of weights, its bias included, as whole numbers of largest size 127."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top > 0, top / 127.0).otherwise(F.lit(1.0))
    return let(scale, lambda s: F.struct(s.alias("scale"), F.transform(v, lambda x: _whole(x.cast("double") / s)).alias("q")))


def quantized_input(v):
    """struct(scale, q): an input with 1.0 appended for the bias; the largest size counts as 1 at least."""
    top = F.greatest(F.lit(1.0), F.coalesce(F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))), F.lit(1.0)))
    whole = F.concat(F.transform(v, lambda x: x.cast("double")), F.array(F.lit(1.0)))
    return let(top / 127.0, lambda s: F.struct(s.alias("scale"), F.transform(whole, lambda x: _whole(x / s)).alias("q")))


def mat_vec(rows, v):
    """Each row (weights, then the bias) with v: weights . v + bias."""
    return F.transform(rows, lambda r: dot(F.slice(r, F.lit(1), F.size(r) - 1), v) + F.element_at(r, -1).cast("double"))


def mat_vec_int(rows, v):
    """The same with quantized rows (struct(scale, q)) and an input quantized here."""
    return let(quantized_input(v), lambda x: F.transform(rows, lambda r: dot_int(r["q"], x["q"]) * r["scale"] * x["scale"]))


def matrix(rows: list[list[float]]):
    """A weight matrix, a parameter of bounded size, as a literal."""
    return F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in rows])


def clamped_int(x):
    """An activation as a whole number of 127ths."""
    return _whole(x.cast("double") * 127.0)


def from_whole(q):
    """A whole number of 127ths as an activation again."""
    return q.cast("double") / 127.0
