"""Queries on the glyphs of documents: nothing as large as the glyphs is shuffled or sorted, odd documents give what the SQL gives, and pages, lines and
batches may meet anywhere."""

import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pagelight.operators import layout
from pagelight.sources import views

NAMES = ["words", "columns", "text_lines", "blob_classes", "baselines", "block_boxes"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Copies of an id, empty and null texts, blank lines, faint and accented characters, null ids, a page of two blobs."""
    # no word of a page with accents alone is text, so rows of the pages don't meet
    texts = [
        (1, "two words\nand, a   third line\n\n  last.line-here  "), (1, "an other text of the same id\n\nwhich has\nmore\nlines\nthan it"), (2, ""), (3, None), (4, "\n\n \n"), (5, "ab"),
        (6, "#%* marks ### and très café\r\nnaïve \U0001f600 end"), (7, "x" * 40 + " y"), (7, None), (None, "no page"), (8, "a b c d  e   f    g     h"), (-9, "minus  nine\n"), (10, ",.,.,"),
    ]
    at = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars int").repartition(5).write.parquet(f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize("name", NAMES)
def test_odd_documents_equal_sql(spark, odd, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{odd}/documents.parquet/*.parquet' WHERE doc_id IS NOT NULL")
    rel = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, odd)
    names = sorted(got.columns)
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted(repr(tuple(tidy(r[rel.columns.index(c)]) for c in names)) for r in rel.fetchall())
    assert sorted(repr(tuple(tidy(r[c]) for c in names)) for r in got.collect()) == want


def shuffled(spark, df):
    """Records that the plan's exchanges wrote, and bytes that its sorts spilled."""
    rows = df.collect()
    found, todo = {"shuffleRecordsWritten": 0, "spillSize": 0}, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        metrics = node.metrics()
        for m in found:
            if metrics.contains(m):
                found[m] += metrics.apply(m).value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return len(rows), found


@pytest.mark.parametrize("name", NAMES)
def test_glyphs_are_not_shuffled(spark, sf, name):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    most = 3 * documents.count()  # texts, and columns of pages
    assert most < views.glyphs(spark, sf).count() / 20
    rows, found = shuffled(spark, entry.queries()[name](spark, sf))
    assert rows and 0 < found["shuffleRecordsWritten"] <= most and not found["spillSize"]


def test_groups_meet_anywhere():
    keys = np.repeat(np.arange(40), np.arange(40) % 7)
    t = pa.table({"page_id": pa.array([None if k == 5 else int(k) for k in keys]), "v": np.arange(len(keys))})
    for size in (1, 3, 50):
        for gathered in (1, 8, 1000):
            parts = list(layout.adjacent(t.to_batches(max_chunksize=size), ["page_id"], lambda t: t, gathered))
            assert pa.concat_tables(parts).equals(t)
            ids = [set(p.column("page_id").to_pylist()) for p in parts]
            assert sum(map(len, ids)) == len(set().union(*ids))
    assert not list(layout.adjacent([], ["page_id"], lambda t: t))


def test_words_of_random_lines_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for page in range(6):
        for line in range(8):
            n = int(rng.integers(1, 14))
            for seq in range(n):
                rows.append((page, line, seq, int(rng.integers(0, 120)), int(rng.integers(0, 9)), int(rng.integers(1, 15)), int(rng.integers(1, 20))))
    df = spark.createDataFrame(rows, "page_id long, line_id int, seq int, x int, y int, w int, h int")
    want = []
    for key in sorted({r[:2] for r in rows}):
        line = sorted((r for r in rows if r[:2] == key), key=lambda r: (r[3], r[2]))
        gaps = [b[3] - a[3] - a[5] for a, b in zip(line, line[1:])]
        med = float(np.median([r[5] for r in line]))
        thr = med * 0.5
        if len(gaps) > 2:
            s = sorted(gaps)
            jump, low = max((b - a, -b) for a, b in zip(s, s[1:]))
            thr = s[-1] + 1.0 if jump < med * 0.3 else (-low - jump - low) / 2.0
        groups = [[line[0]]]
        for gap, r in zip(gaps, line[1:]):
            groups.append([r]) if gap >= thr else groups[-1].append(r)
        want += [(*key, i, g[0][3], min(r[4] for r in g), max(r[3] + r[5] for r in g), max(r[4] + r[6] for r in g), len(g)) for i, g in enumerate(groups)]
    got = layout.words(df.orderBy(F.rand(3)))
    assert got.columns == ["page_id", "line_id", "word_id", "x", "y", "right", "bottom", "n_blobs"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_glyphs_of_pages_in_pieces(monkeypatch):
    """Wherever the texts are cut, pages stay whole."""
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("ab \n.é"), int(rng.integers(0, 30)))).encode() for _ in range(50)]
    t = pa.table({"page_id": np.sort(rng.integers(0, 30, 50)), "text": pa.array(texts, pa.binary())})
    whole = pa.concat_tables(views._glyph_tables(t.to_batches()))
    monkeypatch.setattr(views, "CHARACTERS", 16)
    parts = list(views._glyph_tables(t.to_batches(max_chunksize=7)))
    ids = [set(p.column("page_id").to_pylist()) for p in parts]
    assert len(parts) > 5 and sum(map(len, ids)) == len(set().union(*ids)) and pa.concat_tables(parts).equals(whole)
    assert whole.num_rows == sum(len(re.sub(r"[ \n]", "", b.decode())) for b in texts)


def test_pages_without_text():
    """A task may have only pages that hold no text."""
    for texts in ([b"", None], [b"", b"###"]):
        glyphs = views.glyphs_of(pa.table({"page_id": [1, 2], "text": pa.array(texts, pa.binary())}))
        none = layout.text_of(glyphs).slice(0, 0)
        assert [t.num_rows for t in (layout.classes_of(glyphs.slice(0, 0)), layout.words_of(none), layout.sums_of(none), layout.boxes_of(none, None), layout.columns_of(layout.boxes_of(layout.lines_of(none), "line_no")))] == [0] * 5


def test_lines_of_many_pages_equal_lines_of_each():
    rng = np.random.default_rng(8)
    n = 900
    page = np.sort(rng.integers(-3, 20, n))
    t = pa.table({"page_id": page, "seq": np.arange(n), "x": rng.integers(0, 300, n), "y": rng.integers(-50, 300, n) * (1 + page % 3), "w": rng.integers(1, 9, n), "h": rng.integers(1, 40, n)})
    each = pa.concat_tables([layout._grown(t.filter(pa.array(page == p))) for p in np.unique(page)])
    assert layout.lines_of(t).equals(each)
