"""Page results as plain text, hOCR and JSON, as column expressions.

A page result is (page_width, page_height, blocks): blocks of bbox and lines, lines of bbox, baseline_slope, baseline_intercept
and words, words of text, confidence and bbox; boxes are struct<x, y, width, height>.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelight.functions import scalar

WORDS = "array<struct<text:string,confidence:float,bbox:struct<x:int,y:int,width:int,height:int>>>"
#: What comes before the page of an hOCR document (fixed value of the format).
PROLOGUE = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Transitional//EN" "http://www.w3.org/TR/xhtml1/DTD/xhtml1-transitional.dtd">
<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="en" lang="en">
<head>
<meta http-equiv="Content-Type" content="text/html;charset=utf-8"/>
<title>OCR Output</title>
</head>
<body>
"""


def _all(items, each, between: str = ""):
    return F.array_join(F.transform(items, each), between)


def text(blocks):
    """Words by blanks, lines by line ends, blocks by an empty line."""
    line = lambda x: _all(x["words"], lambda w: w["text"], " ")
    return _all(blocks, lambda b: _all(b["lines"], line, "\n"), "\n\n")


def _tenths(x):
    return F.format_string("%.1f", x.cast("double"))


def hocr(width, height, blocks):
    """An hOCR document of one page; numbers in names count from 1."""
    s = lambda x: x.cast("string")
    edges = lambda b: F.concat_ws(" ", b["x"], b["y"], scalar.right(b), scalar.bottom(b))

    def word(w, name):
        sure = s(F.floor(w["confidence"].cast("float") * F.lit(100.0).cast("float") + F.lit(0.5)).cast("long"))
        return F.concat(F.lit('      <span class="ocrx_word" id="word_1_'), name, F.lit('" title="bbox '), edges(w["bbox"]), F.lit("; x_wconf "), sure, F.lit('">'), scalar.escape_html(w["text"]), F.lit("</span>\n"))

    def line(x, name):
        words = _all(x["words"], lambda w, i: word(w, F.concat_ws("_", name, i + 1)))
        level = F.concat(F.lit("; baseline "), _tenths(x["baseline_slope"]), F.lit(" "), _tenths(x["baseline_intercept"]))
        return F.concat(F.lit('    <span class="ocr_line" id="line_1_'), name, F.lit('" title="bbox '), edges(x["bbox"]), level, F.lit('">\n'), words, F.lit("    </span>\n"))

    def block(b, name):
        lines = _all(b["lines"], lambda x, i: line(x, F.concat_ws("_", name, i + 1)))
        return F.concat(F.lit('  <div class="ocr_carea" id="block_1_'), name, F.lit('" title="bbox '), edges(b["bbox"]), F.lit('">\n'), lines, F.lit("  </div>\n"))

    page = F.concat(F.lit('<div class="ocr_page" id="page_1" title="bbox 0 0 '), s(width), F.lit(" "), s(height), F.lit('">\n'))
    return F.concat(F.lit(PROLOGUE), page, _all(blocks, lambda b, i: block(b, s(i + 1))), F.lit("</div>\n</body>\n</html>\n"))


def json(width, height, blocks):
    """A JSON document of one page."""
    s = lambda x: x.cast("string")
    box = lambda b: F.concat(F.lit('{"x":'), s(b["x"]), F.lit(',"y":'), s(b["y"]), F.lit(',"width":'), s(b["width"]), F.lit(',"height":'), s(b["height"]), F.lit("}"))
    number = scalar.format_float
    word = lambda w: F.concat(F.lit('{"text":"'), scalar.escape_json(w["text"]), F.lit('","confidence":'), number(w["confidence"]), F.lit(',"bbox":'), box(w["bbox"]), F.lit("}"))

    def line(x):
        base = F.concat(F.lit(',"baseline":{"slope":'), number(x["baseline_slope"]), F.lit(',"intercept":'), number(x["baseline_intercept"]))
        return F.concat(F.lit('{"bbox":'), box(x["bbox"]), base, F.lit('},"words":['), _all(x["words"], word, ","), F.lit("]}"))

    block = lambda b: F.concat(F.lit('{"bbox":'), box(b["bbox"]), F.lit(',"lines":['), _all(b["lines"], line, ","), F.lit("]}"))
    return F.concat(F.lit('{"page":{"width":'), s(width), F.lit(',"height":'), s(height), F.lit(',"blocks":['), _all(blocks, block, ","), F.lit("]}}"))


def rendered(pages: DataFrame, form: str) -> DataFrame:
    """pages(page_id, page_width, page_height, blocks) to (page_id, document); form is text, hocr or json."""
    if form not in ("text", "hocr", "json"):
        raise ValueError(f"unknown form {form}")
    document = text(F.col("blocks")) if form == "text" else {"hocr": hocr, "json": json}[form](F.col("page_width"), F.col("page_height"), F.col("blocks"))
    return pages.select("page_id", document.alias("document"))


def assembled(lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """lines(page_id, block_no, line_no, block_box, bbox, baseline_slope, baseline_intercept, words) and sizes(page_id, page_width,
    page_height) to page results; a page without lines has no blocks. A page is one row of the result anyway."""
    line = F.struct("line_no", F.struct("bbox", "baseline_slope", "baseline_intercept", "words").alias("line"))
    blocks = lines.groupBy("page_id", "block_no").agg(F.first("block_box").alias("bbox"), F.array_sort(F.collect_list(line)).alias("l"))
    block = F.struct("block_no", F.struct("bbox", F.transform("l", lambda x: x["line"]).alias("lines")).alias("block"))
    pages = blocks.groupBy("page_id").agg(F.array_sort(F.collect_list(block)).alias("b"))
    out = sizes.join(pages, "page_id", "left").withColumn("blocks", F.transform("b", lambda x: x["block"]))
    none = F.expr(f"cast(array() as array<struct<bbox:struct<x:int,y:int,width:int,height:int>,lines:array<struct<bbox:struct<x:int,y:int,width:int,height:int>,baseline_slope:float,baseline_intercept:float,words:{WORDS}>>>>)")
    return out.select("page_id", "page_width", "page_height", F.coalesce("blocks", none).alias("blocks"))
