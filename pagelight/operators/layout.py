"""Layout stage: blob classes, lines, columns, word segmentation, baselines, boxes.

Functions named `*_of` take a table of whole pages, all pages at once where steps don't depend on an order. Lines and columns grow as blobs join them, in
an order that matters; that fold goes page by page. The functions over DataFrames deal rows by page or line and run the same on them; pages that a
task makes from a row (`views.of_glyphs`) go through several of them before rows leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that a task gathers at least before it looks for whole groups among them.
GATHERED = 1 << 16


def group_starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Where rows begin that have other keys than the row before, the first row included."""
    if not t.num_rows:
        return np.zeros(0, np.int64)
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        code = t.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def adjacent(batches: Iterable[pa.RecordBatch], keys: list[str], run: Callable[[pa.Table], pa.Table], gathered: int = GATHERED) -> Iterator[pa.Table]:
    """run on tables of whole groups of rows with equal keys, which come one after the other in the batches. Only the last group waits for more rows."""
    held, rows, wanted = [], 0, gathered
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows < wanted:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        cut = int(group_starts(t, keys)[-1])
        if cut:
            yield run(t.slice(0, cut))
        held, rows = t.slice(cut).to_batches(), t.num_rows - cut
        wanted = max(gathered, 2 * rows)  # a long group isn't copied with every batch
    if rows:
        yield run(pa.Table.from_batches(held).combine_chunks())


def _one_by_one(t: pa.Table, run: Callable[[pa.Table], pa.Table]) -> pa.Table:
    """run on each page of a table of whole pages."""
    starts = group_starts(t, ["page_id"]).tolist() or [0]
    return pa.concat_tables([run(t.slice(a, b - a)) for a, b in zip(starts, [*starts[1:], t.num_rows])])


def in_tasks(rows: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterable[pa.Table]], schema: str) -> DataFrame:
    """The tables that run makes of the batches of each task, with exactly the columns of the schema."""
    arrow = pa.schema([f.with_nullable(True) for f in to_arrow_schema(StructType.fromDDL(schema))])

    def typed(batches):
        for t in run(batches):
            yield from t.select(arrow.names).cast(arrow).to_batches()

    return rows.mapInArrow(typed, schema)


def _by(rows: DataFrame, keys: list[str], run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """run on tables of whole groups of rows with equal keys."""
    near = rows.repartition(*keys).sortWithinPartitions(*keys)
    return in_tasks(near, lambda batches: adjacent(batches, keys, run), schema)


def _with(rows: DataFrame, more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [more])


def _sorted_within(group: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The values of each group in order; group is a number that never falls, v has whole numbers."""
    low = int(v.min(initial=0))
    span = int(v.max(initial=0)) - low + 1
    return np.sort(group * span + (v - low)) - group * span + low


def _medians(n: np.ndarray, group: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The median of each group of n values."""
    v, first = _sorted_within(group, v), np.cumsum(n) - n
    return (v[first + (n - 1) // 2] + v[first + n // 2]) / 2.0


def _whole(t: pa.Table, *columns: str) -> list[np.ndarray]:
    return [t.column(c).to_numpy().astype(np.int64) for c in columns]


def classes_of(t: pa.Table) -> pa.Table:
    """components with blob_type; sizes are judged against the page's median height, pages of under 3 are all text."""
    starts = group_starts(t, ["page_id"])
    n = np.diff(starts, append=t.num_rows)
    page = np.repeat(np.arange(len(n)), n)
    w, h, pixels = _whole(t, "w", "h", "pixel_count")
    m = _medians(n, page, h)[page]
    names = ["text", "noise", "small", "large"]
    is_text = (h <= m * 3.0) & (w <= m * 10.0)
    kind = np.select([n[page] < 3, (pixels < w * h * 0.1) | (h < m * 0.25), h < m * 0.5, is_text], [0, 1, 2, 0], 3)
    return t.append_column("blob_type", pa.array(names).take(pa.array(kind)))


def text_of(t: pa.Table) -> pa.Table:
    found = classes_of(t)
    return t.filter(pc.equal(found.column("blob_type"), "text")).combine_chunks()


def classify(components: DataFrame) -> DataFrame:
    return _by(components, ["page_id"], classes_of, _with(components, "blob_type string"))


def text_blobs(components: DataFrame) -> DataFrame:
    return classify(components).where("blob_type = 'text'").drop("blob_type")


def _grown(t: pa.Table) -> pa.Table:
    """line_no of one page's blobs, from 0 by the top of the line.

    Blobs fall into bands of the page that share no height with each other. Where any two blobs of a band overlap, it is one row. The blobs of other
    bands go one by one, and only rows that a later blob can still reach are looked at: they come by their middles, so none begins more
    than half the greatest height above the middle of this one."""
    y, x, h = (t.column(c).to_numpy().astype(np.int64) for c in ("y", "x", "h"))
    if not len(y):
        return t.append_column("line_no", pa.array([], pa.int32()))
    end, order = y + h, np.lexsort((t.column("seq").to_numpy(), x, y + h // 2))
    rank = np.empty(len(y), np.int64)
    rank[order] = np.arange(len(y))
    by_top = np.argsort(y, kind="stable")
    opens = np.concatenate(([True], y[by_top][1:] >= np.maximum.accumulate(end[by_top])[:-1]))
    band = np.empty(len(y), np.int64)
    band[by_top] = np.cumsum(opens) - 1
    first = np.flatnonzero(opens)
    plain = np.maximum.reduceat(y[by_top], first) < np.minimum.reduceat(end[by_top], first)
    # rows: a band each, then those of the other bands; where they begin, and when they were begun
    top, begun = y[by_top][first].tolist(), np.minimum.reduceat(rank[by_top], first).tolist()
    row_of = band.copy()
    bottom, near, reach = [0] * len(top), [], int(h.max()) // 2
    for i in order[~plain[band[order]]].tolist():
        a, b = int(y[i]), int(end[i])
        best, most = -1, 0
        for row in near:
            shared = min(bottom[row], b) - max(top[row], a)
            if shared > most:
                best, most = row, shared
        if best < 0:
            best = len(top)
            top.append(a)
            bottom.append(b)
            begun.append(int(rank[i]))
            near = [row for row in near if bottom[row] > a + (b - a) // 2 - reach]
            near.append(best)
        row_of[i] = best
        top[best], bottom[best] = min(top[best], a), max(bottom[best], b)
    used = np.unique(row_of)
    place = np.empty(len(top), np.int64)
    place[used[np.lexsort((np.array(begun)[used], np.array(top)[used]))]] = np.arange(len(used))
    return t.append_column("line_no", pa.array(place[row_of].astype(np.int32)))


def lines_of(t: pa.Table) -> pa.Table:
    """blobs of whole pages with line_no: the pages are laid one under the other, where their rows don't meet, and are one fold."""
    starts = group_starts(t, ["page_id"])
    page = np.repeat(np.arange(len(starts)), np.diff(starts, append=t.num_rows))
    y, h = _whole(t, "y", "h")
    y -= y.min(initial=0)
    under = pa.array(y + page * (int((y + h).max(initial=0)) + 1))
    found = _grown(t.set_column(t.column_names.index("y"), "y", under)).column("line_no").to_numpy()
    return t.append_column("line_no", pa.array((found - np.minimum.reduceat(found, starts)[page]).astype(np.int32)))


def detect_lines(blobs: DataFrame) -> DataFrame:
    """blobs with line_no: each blob, by the middle of its height, then x, joins the row that it overlaps most, or begins one."""
    return _by(blobs, ["page_id"], lines_of, _with(blobs, "line_no int"))


def boxes_of(t: pa.Table, line: str | None) -> pa.Table:
    """(page_id, line, x_min, x_max, y_min, y_max, blobs) around the blobs of each line, or of each page."""
    keys = ["page_id", line] if line else ["page_id"]
    if line:
        starts, (number,) = group_starts(t, ["page_id"]), _whole(t, line)
        order = np.lexsort((number, np.repeat(np.arange(len(starts)), np.diff(starts, append=t.num_rows))))
        t = t.select([*keys, "x", "y", "w", "h"]).take(pa.array(order))
    at = group_starts(t, keys)
    x, y, w, h = _whole(t, "x", "y", "w", "h")
    values = {"x_min": np.minimum.reduceat(x, at), "x_max": np.maximum.reduceat(x + w, at), "y_min": np.minimum.reduceat(y, at), "y_max": np.maximum.reduceat(y + h, at)} if len(at) else dict.fromkeys(("x_min", "x_max", "y_min", "y_max"), at)
    return pa.table({k: t.column(k).take(pa.array(at)) for k in keys} | values | {"blobs": np.diff(at, append=t.num_rows)})


def line_boxes(blobs: DataFrame, line: str = "line_no") -> DataFrame:
    """(page_id, line, x_min, x_max, y_min, y_max, blobs)."""
    right, bottom = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    return blobs.groupBy("page_id", line).agg(F.min("x").alias("x_min"), F.max(right).alias("x_max"), F.min("y").alias("y_min"), F.max(bottom).alias("y_max"), F.count("*").alias("blobs"))


def column_span(x_min, x_max):
    return F.greatest(F.lit(0), x_max - x_min)


def column_middle(x_min, x_max):
    return x_min + F.floor(column_span(x_min, x_max) / 2).cast("int")


def _columns(t: pa.Table) -> pa.Table:
    """block_no of one page's lines, from 0 by the middle of the column."""
    x0, x1 = (t.column(c).to_numpy().astype(np.int64) for c in ("x_min", "x_max"))
    left, right, n = np.empty(16, np.int64), np.empty(16, np.int64), 0
    column_of = np.empty(len(x0), np.int64)
    for i in np.lexsort((t.column("line_no").to_numpy(), t.column("y_min").to_numpy())).tolist():
        a, b = int(x0[i]), int(x1[i])
        best = -1
        if n == 1:  # most pages: whole arrays of one column cost more
            l, r = int(left[0]), int(right[0])
            shared = min(b, r) - max(a, l)
            best = 0 if shared > 0 and shared / min(max(b - a, 1), max(r - l, 1)) > 0.5 else -1
        elif n:
            shared = np.minimum(b, right[:n]) - np.maximum(a, left[:n])
            ratio = np.where(shared > 0, shared / np.minimum(max(b - a, 1), np.maximum(right[:n] - left[:n], 1)), 0)
            best = int(np.argmax(ratio))
            best = best if ratio[best] > 0.5 else -1
        if best < 0:
            if n == len(left):
                left, right = np.concatenate((left, left)), np.concatenate((right, right))
            best, left[n], right[n] = n, a, b
            n += 1
        column_of[i] = best
        left[best], right[best] = min(left[best], a), max(right[best], b)
    middle = left[:n] + np.maximum(right[:n] - left[:n], 0) // 2
    place = np.empty(n, np.int64)
    place[np.argsort(middle, kind="stable")] = np.arange(n)
    return t.append_column("block_no", pa.array(place[column_of].astype(np.int32)))


def columns_of(t: pa.Table) -> pa.Table:
    return _one_by_one(t, _columns)


def detect_columns(lines: DataFrame) -> DataFrame:
    """lines(page_id, line_no, x_min, x_max, y_min, y_max, ...) with block_no: each line, from the top, joins the column that it
    shares the largest part over half of the narrower one with, or begins one."""
    return _by(lines, ["page_id"], columns_of, _with(lines, "block_no int"))


def block_boxes(lines: DataFrame) -> DataFrame:
    """(page_id, block_no, x_min, x_max, y_min, y_max, span, middle): columns around their lines."""
    found = lines.groupBy("page_id", "block_no").agg(F.min("x_min").alias("x_min"), F.max("x_max").alias("x_max"), F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max"))
    return found.withColumn("span", column_span(F.col("x_min"), F.col("x_max"))).withColumn("middle", column_middle(F.col("x_min"), F.col("x_max")))


def _thresholds(n: np.ndarray, line: np.ndarray, w: np.ndarray, gap: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The gap that ends a word in each line: n blobs a line, their widths, the gaps after them (none after the last ones, `ends`)."""
    med = _medians(n, line, w)
    thr, many = med * 0.5, n - 1 > 2
    if not many.any():
        return thr
    inside = ~ends & many[line]
    group = line[inside]
    gaps = _sorted_within(group, gap[inside])
    last = np.cumsum(n[many] - 1) - 1
    most = gaps[last]
    jump = np.diff(gaps, prepend=gaps[0])
    jump[np.concatenate(([0], last[:-1] + 1))] = -1  # the smallest gap of a line has none below it
    top = np.maximum.reduceat(jump, np.concatenate(([0], last[:-1] + 1)))
    at = np.flatnonzero(jump == np.repeat(top, n[many] - 1))
    at = at[np.concatenate(([True], group[at][1:] != group[at][:-1]))]
    thr[many] = np.where(top < med[many] * 0.3, most + 1.0, (gaps[at - 1] + gaps[at]) / 2.0)
    return thr


def words_of(t: pa.Table, line_id: str = "line_id") -> pa.Table:
    """The words of a table of whole lines, the blobs of a line one after the other."""
    starts = group_starts(t, ["page_id", line_id])
    line = np.repeat(np.arange(len(starts)), np.diff(starts, append=t.num_rows))
    x, y, w, h, seq = _whole(t, "x", "y", "w", "h", "seq")
    order = np.lexsort((seq, x, line))
    x, y, right, bottom, w = x[order], y[order], (x + w)[order], (y + h)[order], w[order]
    ends = np.append(line[1:] != line[:-1], True)
    gap = np.append(x[1:] - right[:-1], 0)
    thr = _thresholds(np.diff(starts, append=t.num_rows), line, w, gap, ends)
    opens = np.append(False, ~ends[:-1] & (gap[:-1] >= thr[line[:-1]]))
    begins = opens.copy()
    begins[starts] = True
    at = np.flatnonzero(begins)
    number = np.cumsum(opens)
    number = number[at] - number[starts][line[at]]
    keys = {c: t.column(c).take(pa.array(starts[line[at]])) for c in ("page_id", line_id)}
    around = {"x": x[at], "y": np.minimum.reduceat(y, at), "right": np.maximum.reduceat(right, at), "bottom": np.maximum.reduceat(bottom, at)}
    return pa.table(keys | {"word_id": number} | around | {"n_blobs": np.diff(at, append=t.num_rows)})


def words(blobs: DataFrame, line_id: str = "line_id") -> DataFrame:
    """(page_id, line_id, word_id, x, y, right, bottom, n_blobs): the words of a line, from 0 by x. A gap ends a word where it reaches the line's
    threshold, the middle of the largest jump in its sorted gaps. Two gaps or fewer: half the median width. A largest jump under 0.3 of the
    median width: one word."""
    b = blobs.select("page_id", line_id, "seq", "x", "y", "w", "h")
    right, bottom = (F.col("x") + F.col("w")).alias("right"), (F.col("y") + F.col("h")).alias("bottom")
    schema = _with(b.select("page_id", line_id, F.lit(0).alias("word_id"), "x", "y", right, bottom), "n_blobs long")
    return _by(b, ["page_id", line_id], lambda t: words_of(t, line_id), schema)


def _sums(x, y) -> list:
    return [x, y, x * y, x * x]


def sums_of(t: pa.Table, line_id: str = "line_id") -> pa.Table:
    """(page_id, line_id, n, sx, sy, sxy, sxx) of whole lines, the blobs of a line one after the other: what a baseline is fitted from."""
    at = group_starts(t, ["page_id", line_id])
    x, y, w, h = _whole(t, "x", "y", "w", "h")
    sums = [np.add.reduceat(v, at) if len(at) else at for v in _sums(x + w / 2.0, (y + h).astype(np.float64))]
    keys = {c: t.column(c).take(pa.array(at)) for c in ("page_id", line_id)}
    return pa.table(keys | {"n": np.diff(at, append=t.num_rows)} | dict(zip(("sx", "sy", "sxy", "sxx"), sums)))


def baselines(blobs: DataFrame, line_id: str = "line_id") -> DataFrame:
    """(page_id, line_id, slope, intercept): least squares of bottoms on centres; one blob is level."""
    x, y = F.col("x") + F.col("w") / 2.0, (F.col("y") + F.col("h")).cast("double")
    sums = [F.sum(v).alias(n) for n, v in zip(("sx", "sy", "sxy", "sxx"), _sums(x, y))]
    return fitted(blobs.groupBy("page_id", line_id).agg(F.count("*").alias("n"), *sums), line_id)


def fitted(s: DataFrame, line_id: str = "line_id") -> DataFrame:
    """(page_id, line_id, slope, intercept) from the sums of each line."""
    den = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    flat = (F.col("n") < 2) | (F.abs(den) < 1e-9)
    slope = F.when(flat, 0.0).otherwise((F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / den)
    s = s.withColumn("slope", slope)
    return s.select("page_id", line_id, "slope", ((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).alias("intercept"))
