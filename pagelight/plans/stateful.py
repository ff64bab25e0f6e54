"""Registered queries whose results depend on an order of steps: layout folds, resampling, tiles, the recurrence, the beam, word graphs. Their SQL
goes step by step in recursive common table expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelight.functions import scalar
from pagelight.operators import decode, layout, network, pages, tiles, word_graphs
from pagelight.operators.stages import Stages
from pagelight.plans import catalog
from pagelight.plans.catalog import _FRAMES, _OTSU, _RASTER, _RUNS, _SKEW, _fast
from pagelight.sources import views

#: Tiles of the derived pages, which are 64 pixels high: three by three, so that components span some.
TILE = 24


def _gray(spark, sf_dir):
    return tiles.cut(views.rasters(spark, sf_dir), TILE)


def _components(spark, sf_dir):
    run = Stages(spark, "components")
    gray = run.write(_gray(spark, sf_dir), "gray")
    black = tiles.binarized(gray, pages.otsu_of(tiles.histogram(gray, TILE)))
    return run.write(tiles.components(run, black, TILE), "components")


def tiled_components(spark, sf_dir):
    return _components(spark, sf_dir)


def deskewed(spark, sf_dir):
    """Pixels of each page turned upright, from its tiles."""
    run = Stages(spark, "deskewed")
    gray = run.write(_gray(spark, sf_dir), "gray")
    turned = tiles.rotated(gray, tiles.skew(gray, TILE).withColumn("degrees", -F.col("degrees")), TILE)
    return pages.exploded(tiles.whole(turned, TILE)).select("page_id", "y", "x", "px")


def network_inputs(spark, sf_dir):
    inputs = pages.prepare(views.rasters(spark, sf_dir), 36)
    return inputs.select("page_id", "rows", "columns", F.posexplode("values").alias("place", "value")).withColumn("value", F.round(F.col("value").cast("double"), 5))


def meeting_lines(spark, sf_dir):
    """Lines of the components of noisy pages, whose rows overlap."""
    return layout.detect_lines(layout.text_blobs(_components(spark, sf_dir))).select("page_id", "seq", "line_no")


def meeting_columns(spark, sf_dir):
    """Columns of those lines' words."""
    lined = Stages(spark, "lined").write(layout.detect_lines(layout.text_blobs(_components(spark, sf_dir))), "lined")
    boxes = layout.words(lined, "line_no").select("page_id", F.col("line_no").alias("in_line"), "word_id", F.col("x").alias("x_min"), F.col("right").alias("x_max"), F.col("y").alias("y_min"), F.col("bottom").alias("y_max"))
    boxes = boxes.withColumn("line_no", (F.col("in_line") * 1000 + F.col("word_id")).cast("int"))
    return layout.block_boxes(layout.detect_columns(boxes))


def columns(spark, sf_dir):
    schema = catalog.LINES + ", block_no int"
    return layout.block_boxes(views.of_glyphs(spark, sf_dir, lambda t: layout.columns_of(catalog.line_boxes_of(t)), schema))


def beam_codes(spark, sf_dir):
    return decode.beam_search(views.softmax_frames(spark, sf_dir)).withColumn("score", F.round("score", 6))


def lstm_steps(spark, sf_dir):
    """The frames of each line through an LSTM layer of two states, its weights from the first vectors."""
    rows = views.weight_rows(spark, sf_dir)
    gates = [[rows[2 * g + j] + rows[2 * g + j + 1][:3] for j in range(2)] for g in range(4)]
    out = network.recurrent(views.frames(spark, sf_dir).select(F.col("line_id").alias("id"), "t", F.col("logits").alias("vec")), gates)
    return out.select(F.col("id").alias("line_id"), "t", F.posexplode("vec").alias("state", "h")).withColumn("h", F.round("h", 6))


def _letters(word):
    return F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.ascii(c))


def _graph(spark, sf_dir):
    """The words of the benchmark as a minimal automaton of packed edges, decoded again."""
    lexicon = views.table(spark, sf_dir, "benchmark").select(F.explode(scalar.split_spaces(F.lower("text"))).alias("word")).distinct()
    run = Stages(spark, "graph")
    bits, packed = word_graphs.packed(run, word_graphs.automaton(run, lexicon.select(_letters(F.col("word")).alias("letters"))))
    return run.write(decode.graph_edges(packed, bits), "decoded")


def _asked(spark, sf_dir):
    turns = views.table(spark, sf_dir, "conversations").select(F.explode(scalar.split_spaces(F.lower("text"))).alias("word"))
    return turns.distinct().select(F.col("word").alias("word_id"), _letters(F.col("word")).alias("letters"))


def graph_words(spark, sf_dir):
    """Which words of the conversations are words, and which are beginnings of words, of the benchmark's graph."""
    graph, asked = _graph(spark, sf_dir), _asked(spark, sf_dir)
    whole = decode.in_graph(asked, graph).select(F.col("word_id").alias("word"), F.col("found").alias("is_word"))
    begins = decode.in_graph(asked, graph, prefix=True).select(F.col("word_id").alias("word"), F.col("found").alias("is_prefix"))
    return whole.join(begins, "word")


def graph_branches(spark, sf_dir):
    """How many nodes of the graph have so many forward edges."""
    return decode.forward_edges(_graph(spark, sf_dir)).groupBy("n").agg(F.count("*").alias("nodes"))


_ALL = (tiled_components, deskewed, network_inputs, meeting_lines, meeting_columns, columns, beam_codes, lstm_steps, graph_words, graph_branches)
QUERIES = {f.__name__: f for f in _ALL}

# --- SQL ------------------------------------------------------------------------------------------

#: The pages with white pixels where the table has none, as rasters are.
_PADDED = _RASTER.replace("px AS (", "p0 AS (", 1) + """, px AS MATERIALIZED (SELECT page_id, y, x, coalesce(p0.px, 255) AS px FROM (SELECT page_id, unnest(range(64)) AS y FROM (SELECT DISTINCT page_id FROM p0)) CROSS JOIN (SELECT unnest(range(64)) AS x) LEFT JOIN p0 USING (page_id, y, x))"""
_COMPONENTS = f"""{_PADDED}{_OTSU}{_RUNS}, ed AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM rn a JOIN rn b ON a.page_id = b.page_id AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 + 1 AND b.x0 <= a.x1 + 1),
 rc AS (SELECT r AS root, r FROM rn UNION SELECT rc.root, ed.b FROM rc JOIN ed ON rc.r = ed.a), lb AS (SELECT r, min(root) AS root FROM rc GROUP BY 1),
 cc AS (SELECT page_id, root, min(x0) AS x, min(y) AS y, (max(x1) - min(x0) + 1)::INT AS w, (max(y) - min(y) + 1)::INT AS h, sum(x1 - x0 + 1)::BIGINT AS pixel_count FROM rn JOIN lb USING (r) GROUP BY page_id, root),
 co AS MATERIALIZED (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY y, x, root) - 1)::INT AS seq, x, y, w, h, pixel_count FROM cc)"""
_TEXT = """, tb AS MATERIALIZED (SELECT page_id, seq, x, y, w, h, row_number() OVER (PARTITION BY page_id ORDER BY y + h // 2, x, seq) AS k FROM (SELECT *, median(h) OVER (PARTITION BY page_id) AS med, count(*) OVER (PARTITION BY page_id) AS blobs FROM co)
 WHERE blobs < 3 OR NOT (pixel_count < w * h * 0.1::DOUBLE OR h < med * 0.5 OR h > med * 3 OR w > med * 10))"""


def _line_fold(blobs: str) -> str:
    """Rows that grow: each blob, in the order of k, joins the row that it shares most with. `ln`(page_id, seq, line_no)."""
    return f""", gr AS (SELECT DISTINCT page_id, 0::BIGINT AS k, []::STRUCT(t BIGINT, b BIGINT)[] AS st, NULL::INT AS seq, NULL::BIGINT AS ix FROM {blobs}
 UNION ALL SELECT page_id, k, CASE WHEN ix > len(st) THEN list_append(st, {{'t': y, 'b': y + h}}) ELSE list_transform(st, lambda s, i: CASE WHEN i = ix THEN {{'t': least(s.t, y), 'b': greatest(s.b, y + h)}} ELSE s END) END, seq, ix
 FROM (SELECT page_id, b.k, st, b.seq, b.y::BIGINT AS y, b.h::BIGINT AS h, CASE WHEN coalesce(list_max(sh), 0) > 0 THEN list_position(sh, list_max(sh)) ELSE len(st) + 1 END AS ix
  FROM (SELECT gr.page_id, gr.st, b.k, b.seq, b.y, b.h, list_transform(gr.st, lambda s: least(s.b, b.y + b.h) - greatest(s.t, b.y)) AS sh FROM gr JOIN {blobs} AS b ON b.page_id = gr.page_id AND b.k = gr.k + 1) AS b)),
 tops AS (SELECT page_id, ix, (row_number() OVER (PARTITION BY page_id ORDER BY st[ix].t, ix) - 1)::INT AS line_no FROM (SELECT page_id, st, unnest(range(1, len(st) + 1)) AS ix FROM gr QUALIFY k = max(k) OVER (PARTITION BY page_id))),
 ln AS MATERIALIZED (SELECT gr.page_id, seq, line_no FROM gr JOIN tops USING (page_id, ix) WHERE seq IS NOT NULL)"""


def _column_fold(lines: str) -> str:
    """Columns that grow: each of the lines (page_id, k, x0, x1, y0, y1). `bx`: the boxes of the columns."""
    wide = "greatest({} - {}, 1)"
    return f""", gc AS (SELECT DISTINCT page_id, 0::BIGINT AS k, []::STRUCT(l BIGINT, r BIGINT)[] AS st, NULL::BIGINT AS x0, NULL::BIGINT AS x1, NULL::BIGINT AS y0, NULL::BIGINT AS y1, NULL::BIGINT AS ix FROM {lines}
 UNION ALL SELECT page_id, k, CASE WHEN ix > len(st) THEN list_append(st, {{'l': x0, 'r': x1}}) ELSE list_transform(st, lambda s, i: CASE WHEN i = ix THEN {{'l': least(s.l, x0), 'r': greatest(s.r, x1)}} ELSE s END) END, x0, x1, y0, y1, ix
 FROM (SELECT *, CASE WHEN coalesce(list_max(ra), 0) > 0.5 THEN list_position(ra, list_max(ra)) ELSE len(st) + 1 END AS ix
  FROM (SELECT gc.page_id, gc.st, b.k, b.x0::BIGINT AS x0, b.x1::BIGINT AS x1, b.y0::BIGINT AS y0, b.y1::BIGINT AS y1, list_transform(gc.st, lambda s: greatest(0, least(s.r, b.x1) - greatest(s.l, b.x0))::DOUBLE / least({wide.format('b.x1', 'b.x0')}, {wide.format('s.r', 's.l')})) AS ra
   FROM gc JOIN {lines} AS b ON b.page_id = gc.page_id AND b.k = gc.k + 1))),
 fin AS (SELECT page_id, st FROM gc QUALIFY k = max(k) OVER (PARTITION BY page_id)), num AS (SELECT page_id, ix, row_number() OVER (PARTITION BY page_id ORDER BY st[ix].l + (st[ix].r - st[ix].l) // 2, ix) - 1 AS block_no FROM (SELECT page_id, st, unnest(range(1, len(st) + 1)) AS ix FROM fin)),
 bx AS (SELECT page_id, block_no::INT AS block_no, min(x0) AS x_min, max(x1) AS x_max, min(y0) AS y_min, max(y1) AS y_max FROM gc JOIN num USING (page_id, ix) WHERE x0 IS NOT NULL GROUP BY 1, 2)"""


_BOXES = 'SELECT page_id, block_no, x_min, x_max, y_min, y_max, greatest(0, x_max - x_min) AS span, x_min + greatest(0, x_max - x_min) // 2 AS middle FROM bx'


def _bilinear(image: str, width: str, height: str) -> str:
    """Between four pixels of the list `image` at (sx, sy), in single precision."""
    at = lambda x, y: f"{image}[({y}) * {width} + ({x}) + 1]::FLOAT"
    x0, y0 = "floor(sx)::INT", "floor(sy)::INT"
    x1, y1 = f"least({x0} + 1, {width} - 1)", f"least({y0} + 1, {height} - 1)"
    dx, dy = f"(sx - {x0}::FLOAT)", f"(sy - {y0}::FLOAT)"
    return f"{at(x0, y0)} * (1::FLOAT - {dx}) * (1::FLOAT - {dy}) + {at(x1, y0)} * {dx} * (1::FLOAT - {dy}) + {at(x0, y1)} * (1::FLOAT - {dx}) * {dy} + {at(x1, y1)} * {dx} * {dy}"


_IMAGES = "im AS MATERIALIZED (SELECT page_id, list(px ORDER BY y, x) AS im FROM px GROUP BY 1)"
_DESKEWED = f"""WITH {_PADDED}{_SKEW}, tp AS (SELECT page_id, degrees FROM sc WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, degrees) = 1), {_IMAGES},
 tu AS (SELECT im.page_id, im, coalesce(degrees, 0.0::DOUBLE) AS degrees, (-coalesce(degrees, 0.0::DOUBLE))::FLOAT * (pi() / 180)::FLOAT AS turn FROM im LEFT JOIN tp USING (page_id)),
 pl AS (SELECT page_id, im, degrees, y, x, cos(turn::DOUBLE)::FLOAT AS c, sin(turn::DOUBLE)::FLOAT AS s, x::FLOAT - 32::FLOAT AS fx, y::FLOAT - 32::FLOAT AS fy FROM tu CROSS JOIN (SELECT unnest(range(64))::INT AS y) CROSS JOIN (SELECT unnest(range(64))::INT AS x)),
 so AS (SELECT *, c * fx + s * fy + 32::FLOAT AS sx, -s * fx + c * fy + 32::FLOAT AS sy FROM pl)
SELECT page_id, y, x, CASE WHEN degrees = 0 THEN im[y * 64 + x + 1] WHEN sx >= 0 AND sy >= 0 AND sx < 64 AND sy < 64 THEN floor(greatest(0::FLOAT, least(255::FLOAT, {_bilinear('im', '64', '64')})) + 0.5::FLOAT)::INT ELSE 255 END AS px FROM so"""
_INPUTS = f"""WITH {_PADDED}, {_IMAGES}, mm AS (SELECT page_id, im, list_min(im)::FLOAT AS black, list_max(im)::FLOAT AS white FROM im),
 so AS (SELECT page_id, im, black, CASE WHEN white > black THEN (white - black) / 2::FLOAT ELSE 1::FLOAT END AS half, y * 36 + x AS place, x::FLOAT * 63::FLOAT / 35::FLOAT AS sx, y::FLOAT * 63::FLOAT / 35::FLOAT AS sy FROM mm CROSS JOIN (SELECT unnest(range(36))::INT AS y) CROSS JOIN (SELECT unnest(range(36))::INT AS x))
SELECT page_id, 36 AS rows, 36 AS columns, place, round(((({_bilinear('im', '64', '64')}) - black) / half - 1::FLOAT)::DOUBLE, 5) + 0.0 AS value FROM so"""

_BEAM = f"""WITH RECURSIVE {_FRAMES}, so AS (SELECT line_id, t, logits, list_max(logits) AS top FROM fr), pr AS (SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY t) AS k, list_transform(logits, lambda x: exp(x - top)) AS e FROM so),
 st AS MATERIALIZED (SELECT line_id, k, code, gain, rank FROM (SELECT line_id, k, code, ln(greatest(p, 1e-30)) AS gain, row_number() OVER (PARTITION BY line_id, k ORDER BY p DESC, code) AS rank FROM (SELECT line_id, k, unnest(e) / list_sum(e) AS p, generate_subscripts(e, 1) - 1 AS code FROM pr)) WHERE rank <= 5),
 be AS (SELECT DISTINCT line_id, 0::BIGINT AS k, []::INT[] AS codes, 0.0::DOUBLE AS score, -1::BIGINT AS prior, 1::BIGINT AS place FROM fr
 UNION ALL SELECT line_id, k, codes, score, prior, row_number() OVER (PARTITION BY line_id ORDER BY score DESC, codes) AS place FROM (
  SELECT * FROM (SELECT be.line_id, st.k, CASE WHEN st.code = 0 OR st.code = be.prior THEN be.codes ELSE list_append(be.codes, st.code::INT) END AS codes, be.score + st.gain AS score, CASE WHEN st.code = 0 THEN -1 ELSE st.code END AS prior, be.place AS came, st.rank FROM be JOIN st ON st.line_id = be.line_id AND st.k = be.k + 1)
  QUALIFY row_number() OVER (PARTITION BY line_id, codes ORDER BY score DESC, came, rank) = 1) QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY score DESC, codes) <= 10)
SELECT line_id, codes, round(score, 6) + 0.0 AS score FROM be QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY k DESC, place) = 1"""



def _lstm() -> str:
    gate = lambda g: f"list_transform([{2 * g + 1}, {2 * g + 2}], lambda r: list_dot_product(v, wg[r][1:66]) + wg[r][67])"
    kept = f"c[i] * {_fast('sigmoid', 'fo[i]')} + {_fast('tanh', 'ce[i]')} * {_fast('sigmoid', 'gi[i]')}".replace("CASE", "(CASE").replace(" END", " END)")
    shown = f"{_fast('tanh', 'c[i]')} * {_fast('sigmoid', 'go[i]')}".replace("CASE", "(CASE").replace(" END", " END)")
    return f"""WITH RECURSIVE {_FRAMES}, em AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS w FROM embeddings WHERE vec_id < 10),
 wt AS MATERIALIZED (SELECT list(list_concat(a.w, b.w[1:3]) ORDER BY a.vec_id) AS wg FROM em AS a JOIN em AS b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id < 8),
 od AS MATERIALIZED (SELECT line_id, t, logits, row_number() OVER (PARTITION BY line_id ORDER BY t) AS k FROM fr),
 ls AS (SELECT DISTINCT line_id, 0::BIGINT AS k, -1 AS t, [0.0, 0.0]::DOUBLE[] AS c, [0.0, 0.0]::DOUBLE[] AS h FROM fr
 UNION ALL SELECT line_id, k, t, c, list_transform([1, 2], lambda i: {shown}) AS h FROM (SELECT line_id, k, t, go, list_transform([1, 2], lambda i: greatest(-100, least(100, {kept}))) AS c FROM (
  SELECT line_id, k, t, c, {gate(0)} AS ce, {gate(1)} AS gi, {gate(2)} AS fo, {gate(3)} AS go FROM (SELECT od.line_id, od.k, od.t, ls.c, list_concat(od.logits, ls.h) AS v, wg FROM ls JOIN od ON od.line_id = ls.line_id AND od.k = ls.k + 1 CROSS JOIN wt))))
SELECT line_id, t, unnest([0, 1]) AS state, round(unnest(h), 6) + 0.0 AS h FROM ls WHERE k > 0"""


_LINE_WORDS = """, tl AS (SELECT tb.*, line_no FROM tb JOIN ln USING (page_id, seq)), gp AS (SELECT *, lead(x) OVER (PARTITION BY page_id, line_no ORDER BY x, seq) - (x + w) AS gap FROM tl),
 lo AS (SELECT *, CASE WHEN gap IS NOT NULL THEN lag(gap) OVER (PARTITION BY page_id, line_no ORDER BY gap NULLS LAST, x, seq) END AS lower FROM gp),
 li AS (SELECT page_id, line_no, median(w) AS med, count(gap) AS gaps, max(gap) AS most FROM lo GROUP BY 1, 2),
 ju AS (SELECT page_id, line_no, lower, gap, gap - lower AS jump FROM lo WHERE gap - lower IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id, line_no ORDER BY gap - lower DESC, gap) = 1),
 th AS (SELECT li.page_id, li.line_no, CASE WHEN gaps <= 2 THEN med * 0.5 WHEN jump < med * 0.3 THEN most + 1.0 ELSE (lower + gap) / 2.0 END AS thr FROM li LEFT JOIN ju USING (page_id, line_no)),
 op AS (SELECT gp.*, CASE WHEN lag(gap) OVER (PARTITION BY page_id, line_no ORDER BY x, seq) >= thr THEN 1 ELSE 0 END AS o FROM gp JOIN th USING (page_id, line_no)),
 wo AS (SELECT *, sum(o) OVER (PARTITION BY page_id, line_no ORDER BY x, seq ROWS UNBOUNDED PRECEDING) AS word_id FROM op),
 wb AS (SELECT page_id, line_no * 1000 + word_id AS line, min(x) AS x0, max(x + w) AS x1, min(y) AS y0, max(y + h) AS y1 FROM wo GROUP BY page_id, line_no, word_id),
 wk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y0, line) AS k FROM wb)"""


_LEXICON = "lx AS (SELECT DISTINCT unnest(list_filter(string_split(lower(text), ' '), lambda w: w <> '')) AS word FROM benchmark)"
#: Right languages: a node is the set of what can follow a beginning.
_BRANCHES = f"""WITH {_LEXICON}, pf AS (SELECT word[1:k] AS p, word[k + 1:k + 1] AS c, word[k + 1:] AS rest FROM (SELECT word, unnest(range(length(word))) AS k FROM lx)),
 rl AS (SELECT p, md5(string_agg(rest, chr(10) ORDER BY rest)) AS node, count(DISTINCT c) AS n FROM pf GROUP BY p) SELECT n, count(*) AS nodes FROM (SELECT DISTINCT node, n FROM rl) GROUP BY 1"""


ORACLE_SQL = {
    "columns": f"WITH RECURSIVE lk AS MATERIALIZED (SELECT page_id, x_min AS x0, x_max AS x1, y_min AS y0, y_max AS y1, row_number() OVER (PARTITION BY page_id ORDER BY y_min, line_no) AS k FROM ({catalog.ORACLE_SQL['text_lines']})){_column_fold('lk')} {_BOXES}",
    "graph_words": f"WITH {_LEXICON}, sx AS (SELECT DISTINCT word[1:k] AS p FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM lx)), q AS (SELECT DISTINCT unnest(list_filter(string_split(lower(text), ' '), lambda w: w <> '')) AS word FROM conversations) SELECT word, word IN (SELECT word FROM lx) AS is_word, word IN (SELECT p FROM sx) AS is_prefix FROM q",
    "graph_branches": _BRANCHES,
    "tiled_components": f"WITH RECURSIVE {_COMPONENTS} SELECT * FROM co",
    "deskewed": _DESKEWED,
    "network_inputs": _INPUTS,
    "meeting_lines": f"WITH RECURSIVE {_COMPONENTS}{_TEXT}{_line_fold('tb')} SELECT * FROM ln",
    "meeting_columns": f"WITH RECURSIVE {_COMPONENTS}{_TEXT}{_line_fold('tb')}{_LINE_WORDS}{_column_fold('wk')} {_BOXES}",
    "beam_codes": _BEAM,
    "lstm_steps": _lstm(),
}
