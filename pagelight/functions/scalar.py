"""Scalar functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import functions as F


def gray(r, g, b):
    """Luma of an RGB pixel in single precision, rounded half up, 0 to 255."""
    part = lambda weight, c: F.lit(weight).cast("float") * c.cast("float")
    luma = part(0.299, r) + part(0.587, g) + part(0.114, b)
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), luma.cast("double"))) + 0.5).cast("int")


def binarize(px, threshold):
    return F.when(px > threshold, 255).otherwise(0)


def arg_max(v):
    """Position of the first largest value, from 0."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def split_spaces(text):
    return F.filter(F.split(text, " "), lambda w: w != "")


def escape_html(text):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


#: Control characters without a short escape.
_CONTROLS = tuple((chr(i), f"\\u{i:04X}") for i in range(0x20) if chr(i) not in "\n\t\r\b\f")


def escape_json(text):
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r"), ("\b", "\\b"), ("\f", "\\f"), *_CONTROLS):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def format_float(x):
    """Six decimals without trailing zeros, one at least."""
    return F.regexp_replace(F.format_string("%.6f", x.cast("double")), r"(\.\d+?)0+$", "$1")


def has_property(properties, mask: int):
    """Whether a character has a property bit; false for characters that aren't there."""
    return F.coalesce(properties.bitwiseAND(F.lit(mask)) != 0, F.lit(False))


#: Property bits of characters (fixed values of the character-set format).
ALPHA, LOWER, UPPER, DIGIT, PUNCT = 0x01, 0x02, 0x04, 0x08, 0x10


def flag_start_bit(n):
    """Bits that hold numbers up to n, one at least."""
    return F.greatest(F.lit(1), F.length(F.bin(n)))


# --- boxes: struct<x, y, width, height>, right and bottom exclusive ---------------------------------


def box(x, y, right, bottom):
    """A box from its edges; one turned inside out is empty."""
    size = lambda a, b: F.greatest(F.lit(0), b - a).cast("int")
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), size(x, right).alias("width"), size(y, bottom).alias("height"))


def right(b):
    return b["x"] + b["width"]


def bottom(b):
    return b["y"] + b["height"]


def area(b):
    return b["width"].cast("long") * b["height"].cast("long")


def contains(b, x, y):
    return (x >= b["x"]) & (x < right(b)) & (y >= b["y"]) & (y < bottom(b))


def overlaps_vertically(a, b):
    return (a["y"] < bottom(b)) & (b["y"] < bottom(a))


# --- edges of a packed word graph: letter, then three flag bits, then the next node ---------------------


def edge_letter(edge, start_bit: int):
    return edge.bitwiseAND(F.lit((1 << start_bit) - 1)).cast("int")


def edge_next(edge, start_bit: int):
    return F.shiftrightunsigned(edge, start_bit + 3)


def edge_flag(edge, start_bit: int, flag: int):
    """flag 1: the node's last edge; 2: backward; 4: a word may end here."""
    return F.shiftrightunsigned(edge, start_bit).bitwiseAND(F.lit(flag)) != 0
