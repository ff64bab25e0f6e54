"""Registered queries over the driver's tables, each with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelight.functions import scalar, vectors
from pagelight.operators import blobs, decode, layout, network, pages, render
from pagelight.sources import views

_RASTER = """px AS (SELECT page_id, y, x - 1 AS x, greatest(0, least(255, floor((v::DOUBLE + 0.6) * 200)))::INT AS px FROM (
 SELECT vec_id // 64 AS page_id, (vec_id % 64)::INT AS y, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS x FROM embeddings))"""
_GLYPHS = """ln AS (SELECT doc_id AS page_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_id FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
 ch AS (SELECT page_id, line_id, unnest(c) AS ch, generate_subscripts(c, 1) - 1 AS seq FROM (SELECT page_id, line_id, string_split(line, '') AS c FROM ln)),
 gl AS (SELECT page_id, line_id, seq, seq * 12 AS x, line_id * 40 AS y, 10 AS w,
  CASE WHEN ch IN ('.', ',') THEN 3 WHEN ch IN ('-', '''', '"') THEN 6 WHEN unicode(ch) > 127 THEN 60 ELSE 14 + unicode(ch) % 5 END AS h, ch FROM ch WHERE ch <> '' AND ch <> ' '),
 g AS (SELECT page_id, line_id, seq, x, y, w, h, CASE WHEN ch IN ('#', '%', '*') THEN 5 ELSE w * h END AS pixel_count FROM gl)"""
_BLOBS = _GLYPHS + """, b AS (SELECT g.*, CASE WHEN blobs < 3 THEN 'text' WHEN pixel_count < w * h * 0.1::DOUBLE THEN 'noise' WHEN h < med * 0.25 THEN 'noise' WHEN h < med * 0.5 THEN 'small'
  WHEN h <= med * 3 AND w <= med * 10 THEN 'text' ELSE 'large' END AS blob_type FROM g JOIN (SELECT page_id, median(h) AS med, count(*) AS blobs FROM g GROUP BY 1) USING (page_id)),
 tx AS (SELECT * FROM b WHERE blob_type = 'text')"""
_WORDS = _BLOBS + """, gp AS (SELECT *, lead(x) OVER (PARTITION BY page_id, line_id ORDER BY x, seq) - (x + w) AS gap FROM tx),
 jp AS (SELECT *, lag(gap) OVER (PARTITION BY page_id, line_id ORDER BY gap NULLS LAST, x, seq) AS lower FROM gp),
 rk AS (SELECT *, row_number() OVER (PARTITION BY page_id, line_id ORDER BY gap - lower DESC NULLS LAST, gap) AS r FROM jp),
 pl AS (SELECT page_id, line_id, median(w) AS med, count(gap) AS gaps, max(gap) AS most, max(CASE WHEN r = 1 THEN gap END) AS g1, max(CASE WHEN r = 1 THEN lower END) AS l1 FROM rk GROUP BY 1, 2),
 th AS (SELECT page_id, line_id, CASE WHEN gaps <= 2 THEN med * 0.5 WHEN g1 - l1 < med * 0.3 THEN most + 1.0 ELSE (l1 + g1) / 2.0 END AS thr FROM pl),
 op AS (SELECT gp.*, CASE WHEN lag(gap) OVER (PARTITION BY page_id, line_id ORDER BY x, seq) >= thr THEN 1 ELSE 0 END AS o FROM gp JOIN th USING (page_id, line_id)),
 wd AS (SELECT *, sum(o) OVER (PARTITION BY page_id, line_id ORDER BY x, seq ROWS UNBOUNDED PRECEDING)::INT AS word_id FROM op)"""
_FRAMES = "fr AS (SELECT vec_id // 32 AS line_id, (vec_id % 32)::INT AS t, list_transform(embedding, lambda x: x::DOUBLE) AS logits FROM embeddings)"
_OTSU = """, h AS (SELECT page_id, px, count(*) AS n FROM px GROUP BY 1, 2),
 c AS (SELECT page_id, px, sum(n) OVER r AS wb, sum(n * px) OVER r AS sb, sum(n) OVER w AS total, sum(n * px) OVER w AS s FROM h WINDOW w AS (PARTITION BY page_id), r AS (PARTITION BY page_id ORDER BY px ROWS UNBOUNDED PRECEDING)),
 v AS (SELECT page_id, px, ((s - sb) * wb - sb * (total - wb))::HUGEINT * ((s - sb) * wb - sb * (total - wb))::HUGEINT // (wb * (total - wb))::HUGEINT AS v FROM c WHERE wb < total),
 ot AS (SELECT p.page_id, coalesce(o.px, 0)::INT AS threshold FROM (SELECT DISTINCT page_id FROM h) p LEFT JOIN (SELECT page_id, px FROM v WHERE v > 0 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY v DESC, px) = 1) o USING (page_id))"""
_SKEW = """, an AS (SELECT * FROM (VALUES %s) AS t(degrees, sn, cs)),
 pr AS (SELECT page_id, degrees, (-sn::FLOAT * (x::FLOAT - 32::FLOAT) + cs::FLOAT * (y::FLOAT - 32::FLOAT) + 32::FLOAT)::DOUBLE AS ry FROM px, an WHERE px < 128),
 ro AS (SELECT page_id, degrees, (sign(ry) * floor(abs(ry) + 0.5))::INT AS ro, count(*) AS n FROM pr GROUP BY ALL),
 gr AS (SELECT page_id, degrees, unnest(range(0, 64)) AS ro FROM (SELECT DISTINCT page_id, degrees FROM ro)),
 de AS (SELECT page_id, degrees, ro, coalesce(n, 0) AS n FROM gr LEFT JOIN ro USING (page_id, degrees, ro)),
 di AS (SELECT page_id, degrees, n - lag(n) OVER (PARTITION BY page_id, degrees ORDER BY ro) AS d FROM de),
 sc AS (SELECT page_id, degrees, sum(d * d)::BIGINT AS score FROM di GROUP BY 1, 2)""" % ", ".join(f"({d}::DOUBLE, {s!r}, {c!r})" for d, s, c in pages.angle_table())
_RUNS = """, bk AS (SELECT page_id, y, x, x - row_number() OVER (PARTITION BY page_id, y ORDER BY x) AS g FROM px JOIN ot USING (page_id) WHERE px <= threshold),
 rn AS (SELECT row_number() OVER (ORDER BY page_id, y, min(x)) AS r, page_id, y, min(x) AS x0, max(x) AS x1 FROM bk GROUP BY page_id, y, g)"""


def line_boxes_of(t):
    """The lines of whole pages of glyphs."""
    return layout.boxes_of(layout.lines_of(layout.text_of(t)), "line_no")


LINES = "page_id long, line_no int, x_min int, x_max int, y_min int, y_max int, blobs long"


def _black(spark, sf_dir):
    return pages.binarize(views.raster(spark, sf_dir))


def grayscale(spark, sf_dir):
    """Every three neighbouring components of a vector as a pixel's red, green and blue."""
    e = views.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v.cast("double") + 0.6) * 200)))).alias("p"))
    e = e.select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.size("p") / 3).cast("int") - 1), lambda k: F.slice("p", k * 3 + 1, F.lit(3)))).alias("place", "c"))
    return e.select("vec_id", "place", scalar.gray(F.col("c")[0], F.col("c")[1], F.col("c")[2]).alias("gray"))


def histogram(spark, sf_dir):
    return pages.histogram(views.raster(spark, sf_dir))


def otsu_threshold(spark, sf_dir):
    return pages.otsu(views.raster(spark, sf_dir))


def binarized(spark, sf_dir):
    return pages.binarize(views.raster(spark, sf_dir))


def projection_profile(spark, sf_dir):
    return pages.profile(views.raster(spark, sf_dir))


def sharpness(spark, sf_dir):
    return pages.sharpness(views.raster(spark, sf_dir))


def black_runs(spark, sf_dir):
    return pages.runs(pages.binarize(views.raster(spark, sf_dir)))


def maxpool(spark, sf_dir):
    return pages.maxpool(views.raster(spark, sf_dir), 3, 2)


def blob_classes(spark, sf_dir):
    return views.of_glyphs(spark, sf_dir, layout.classes_of, "page_id long, line_id int, seq int, blob_type string")


def words(spark, sf_dir):
    schema = "page_id long, line_id int, word_id int, x int, y int, right int, bottom int, n_blobs long"
    return views.of_glyphs(spark, sf_dir, lambda t: layout.words_of(layout.text_of(t)), schema)


def baselines(spark, sf_dir):
    schema = "page_id long, line_id int, n long, sx double, sy double, sxy double, sxx double"
    return layout.fitted(views.of_glyphs(spark, sf_dir, lambda t: layout.sums_of(layout.text_of(t)), schema))


def block_boxes(spark, sf_dir):
    found = views.of_glyphs(spark, sf_dir, lambda t: layout.boxes_of(layout.text_of(t), None), "page_id long, x_min int, x_max int, y_min int, y_max int")
    return found.select("page_id", F.col("x_min").alias("x"), F.col("y_min").alias("y"), F.col("x_max").alias("right"), F.col("y_max").alias("bottom"))


def skew_profile(spark, sf_dir):
    return pages.skew_scores(views.raster(spark, sf_dir))


def detect_skew(spark, sf_dir):
    return pages.detect_skew(views.raster(spark, sf_dir))


def contrast(spark, sf_dir):
    found = views.raster(spark, sf_dir).groupBy("page_id").agg(F.min("px").alias("black"), F.max("px").alias("white"))
    return found.select("page_id", "black", F.when(F.col("white") > F.col("black"), (F.col("white") - F.col("black")) / 2.0).otherwise(1.0).alias("contrast"))


def connected_components(spark, sf_dir):
    return blobs.components(_black(spark, sf_dir)).select("page_id", "x", "y", "w", "h", "pixel_count")


def text_lines(spark, sf_dir):
    return views.of_glyphs(spark, sf_dir, line_boxes_of, LINES)


def box_methods(spark, sf_dir):
    b = blobs.boxes(blobs.components(_black(spark, sf_dir)))
    at = F.col("bbox")
    first = scalar.box(F.lit(0), F.lit(0), F.lit(8), F.lit(8))
    return b.select("page_id", "seq", scalar.right(at).alias("right"), scalar.bottom(at).alias("bottom"), scalar.area(at).alias("area"), scalar.contains(at, F.lit(8), F.lit(8)).alias("holds"), scalar.overlaps_vertically(at, first).alias("beside"))


def arg_max(spark, sf_dir):
    return views.frames(spark, sf_dir).select("line_id", "t", scalar.arg_max(F.col("logits")).alias("code"))


def top_classes(spark, sf_dir):
    return decode.top_n(views.frames(spark, sf_dir), 5, "logits")


def greedy_codes(spark, sf_dir):
    return decode.greedy(views.softmax_frames(spark, sf_dir)).select("line_id", "t", "code", F.round("conf", 6).alias("conf"))


def softmax(spark, sf_dir):
    return views.softmax_frames(spark, sf_dir).select("line_id", "t", F.transform("probs", lambda p: F.round(p, 7)).alias("probs"))


def activations(spark, sf_dir):
    each = views.frames(spark, sf_dir).select("line_id", "t", F.posexplode("logits").alias("place", "v")).select("line_id", "t", "place", (F.col("v") * 10).alias("v"))
    curves = {"sigmoid": vectors.sigmoid, "tanh": vectors.tanh, "relu": vectors.relu, "sigmoid_fast": vectors.sigmoid_fast, "tanh_fast": vectors.tanh_fast}
    return each.select("line_id", "t", "place", *[F.round(f(F.col("v")), 6).alias(n) for n, f in curves.items()])


def quantized(spark, sf_dir):
    q = views.frames(spark, sf_dir).select("line_id", "t", vectors.quantized_row(F.col("logits")).alias("q"))
    return q.select("line_id", "t", F.round("q.scale", 9).alias("scale"), "q.q")


def mat_vec(spark, sf_dir):
    rows = views.weight_rows(spark, sf_dir)
    f = views.frames(spark, sf_dir).select("line_id", "t", F.slice("logits", 1, 63).alias("vec"))
    return f.select("line_id", "t", F.posexplode(vectors.mat_vec(vectors.matrix(rows), F.col("vec"))).alias("row", "y")).select("line_id", "t", "row", F.round("y", 6).alias("y"))


def mat_vec_int(spark, sf_dir):
    rows = views.weight_rows(spark, sf_dir)
    f = views.frames(spark, sf_dir).select("line_id", "t", F.slice("logits", 1, 63).alias("vec"))
    whole = F.transform(vectors.matrix(rows), vectors.quantized_row)
    return f.select("line_id", "t", F.posexplode(vectors.mat_vec_int(whole, F.col("vec"))).alias("row", "y")).select("line_id", "t", "row", F.round("y", 6).alias("y"))


def dot_products(spark, sf_dir):
    v = F.col("logits")
    back = F.reverse("logits")
    whole = lambda a: F.transform(a, vectors.clamped_int)
    return views.frames(spark, sf_dir).select("line_id", "t", F.round(vectors.dot(v, back), 6).alias("dot"), vectors.dot_int(whole(v), whole(back)).alias("dot_int"))


def _grid(spark, sf_dir):
    """Lines of 32 steps as grids of 4 x 8, with four features."""
    f = views.frames(spark, sf_dir)
    return f.select(F.col("line_id").alias("id"), "t", F.lit(4).alias("rows"), F.lit(8).alias("columns"), F.slice("logits", 1, 4).alias("vec"))


def fully_connected(spark, sf_dir):
    rows = views.weight_rows(spark, sf_dir)
    f = views.frames(spark, sf_dir).select("line_id", "t", F.slice("logits", 1, 63).alias("vec"))
    out = network.fully_connected(f, rows, "tanh")
    return out.select("line_id", "t", F.posexplode("vec").alias("row", "y")).select("line_id", "t", "row", F.round("y", 6).alias("y"))


def convolved(spark, sf_dir):
    return network.convolve(_grid(spark, sf_dir), 1, 1).select("id", "t", "vec")


def reversed_steps(spark, sf_dir):
    return network.reverse(_grid(spark, sf_dir)).select("id", "t", "vec")


def transposed_steps(spark, sf_dir):
    return network.transpose(_grid(spark, sf_dir)).select("id", "t", "rows", "columns", "vec")


def parallel_features(spark, sf_dir):
    g = _grid(spark, sf_dir)
    return network.parallel(g, network.reverse(g)).select("id", "t", "vec")


def render_text(spark, sf_dir):
    return render.rendered(views.page_results(spark, sf_dir), "text")


def render_hocr(spark, sf_dir):
    return render.rendered(views.page_results(spark, sf_dir), "hocr")


def render_json(spark, sf_dir):
    return render.rendered(views.page_results(spark, sf_dir), "json")


def align_tokens(spark, sf_dir):
    """Turns as recognized texts, aligned with as many boxes as the turn's number gives."""
    c = views.table(spark, sf_dir, "conversations").where("text is not null")
    boxes = F.transform(F.sequence(F.lit(1), (F.col("turn") % 12 + 1).cast("int")), lambda i: scalar.box(i, i, i + 1, i + 1))
    words = decode.aligned(F.col("text"), F.lit(0.5), boxes)
    return c.select("conv_id", "turn", F.posexplode(words).alias("place", "w")).select("conv_id", "turn", "place", "w.text", F.col("w.confidence").cast("double").alias("confidence"))


def dictionary_prefixes(spark, sf_dir):
    lexicon = views.table(spark, sf_dir, "benchmark").select(F.explode(scalar.split_spaces(F.lower("text"))).alias("word"))
    tokens = views.page_words(spark, sf_dir).select(F.explode("words").alias("word")).select(F.lower("word").alias("word"))
    return decode.in_dictionary_prefix(tokens, lexicon).groupBy("word").agg(F.count("*").alias("n"))


def _charset(spark, sf_dir):
    """(id, unichar, properties, codes): the characters of the conversations by code point, each with a code; every seventh has two codes."""
    c = views.table(spark, sf_dir, "conversations").select(F.explode(F.split("text", "")).alias("unichar")).where("unichar <> ''").distinct()
    point = F.ascii("unichar")
    small, large, digit = F.col("unichar").rlike("^[a-z]$"), F.col("unichar").rlike("^[A-Z]$"), F.col("unichar").rlike("^[0-9]$")
    bits = F.when(small, 3).when(large, 5).when(digit, 8).when(point.between(33, 126), 16).otherwise(0)
    codes = F.when(point % 7 == 0, F.array(point, F.lit(0))).otherwise(F.array(point % 90))
    return c.select(point.alias("id"), "unichar", bits.alias("properties"), codes.alias("codes"))


def code_table(spark, sf_dir):
    return decode.code_table(_charset(spark, sf_dir))


def decoded_text(spark, sf_dir):
    """Greedy codes, moved to printable ones, looked up in the code table and written out."""
    known = _charset(spark, sf_dir)
    codes = decode.greedy(views.softmax_frames(spark, sf_dir)).select("line_id", "t", (F.col("code") + 20).alias("code"))
    return decode.text_of(decode.unichar_ids(codes, decode.code_table(known)), known)


def character_kinds(spark, sf_dir):
    has = lambda mask: scalar.has_property(F.col("properties"), mask)
    kinds = {"alpha": scalar.ALPHA, "lower": scalar.LOWER, "upper": scalar.UPPER, "digit": scalar.DIGIT, "punct": scalar.PUNCT}
    return _charset(spark, sf_dir).select("id", *[has(m).alias(n) for n, m in kinds.items()])


def graph_edges(spark, sf_dir):
    """Order keys as packed edges: letters of 7 bits, the flags, the next node."""
    e = views.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 7919).alias("rec"))
    flag = lambda f: scalar.edge_flag(F.col("rec"), 7, f)
    return e.select("o_orderkey", scalar.edge_letter(F.col("rec"), 7).alias("letter"), scalar.edge_next(F.col("rec"), 7).alias("next"), flag(1).alias("last"), flag(2).alias("backward"), flag(4).alias("word_end"))


def float_format(spark, sf_dir):
    return views.table(spark, sf_dir, "supplier").select("s_suppkey", scalar.format_float(F.floor("s_acctbal") / 8).alias("formatted"))


def word_split(spark, sf_dir):
    return views.page_words(spark, sf_dir).select("page_id", "line_id", F.size("words").alias("n_words"))


def page_text(spark, sf_dir):
    return decode.page_text(views.page_words(spark, sf_dir))


def html_escape(spark, sf_dir):
    return views.table(spark, sf_dir, "pages").select("page_id", scalar.escape_html(F.col("html")).alias("escaped"))


def json_escape(spark, sf_dir):
    return views.table(spark, sf_dir, "conversations").select("conv_id", "turn", scalar.escape_json(F.col("text")).alias("escaped"))


def dictionary_words(spark, sf_dir):
    lexicon = views.table(spark, sf_dir, "benchmark").select(F.explode(scalar.split_spaces(F.lower("text"))).alias("word"))
    tokens = views.page_words(spark, sf_dir).select("page_id", "line_id", F.posexplode("words").alias("pos", "word")).withColumn("word", F.lower("word"))
    return decode.in_dictionary(tokens, lexicon).groupBy("word").agg(F.count("*").alias("n"))


def flag_bits(spark, sf_dir):
    return views.table(spark, sf_dir, "part").select("p_partkey", scalar.flag_start_bit(F.col("p_partkey")).alias("bits"))


_ALL = (
    grayscale, histogram, otsu_threshold, binarized, projection_profile, sharpness, black_runs, maxpool, skew_profile, detect_skew, contrast, connected_components,
    blob_classes, words, baselines, block_boxes, text_lines, box_methods, arg_max, top_classes, greedy_codes, softmax, activations, quantized, mat_vec, mat_vec_int, dot_products,
    fully_connected, convolved, reversed_steps, transposed_steps, parallel_features, word_split, page_text, render_text, render_hocr, render_json, align_tokens, html_escape, json_escape, float_format,
    dictionary_words, dictionary_prefixes, code_table, decoded_text, character_kinds, graph_edges, flag_bits,
)
QUERIES = {f.__name__: f for f in _ALL}

_PX = "greatest(0, least(255, floor((embedding[{}]::DOUBLE + 0.6) * 200)))"
_SPLIT = "list_filter(string_split(text, ' '), lambda w: w <> '')"
_TOP = "list_max(list_transform({0}, lambda x: abs(x)))"
_AWAY = "(sign({0}) * least(127, floor(abs({0}) + 0.5::DOUBLE)))::INT"
_WEIGHTS = "wm AS (SELECT vec_id::INT AS r, list_transform(embedding, lambda x: x::DOUBLE) AS w FROM embeddings WHERE vec_id < 10), ve AS (SELECT line_id, t, logits[1:63] AS v FROM fr)"
_DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i] * {1}[i]))"
_REACH = {"sigmoid": (8, 0), "tanh": (4, -1)}


def _fast(name: str, x: str) -> str:
    """Linear interpolation between 256 places of a curve."""
    reach, low = _REACH[name]
    at = f"(({x} + {reach}) * {255 / (2 * reach)!r}::DOUBLE)"

    def height(place: str) -> str:
        v = f"({place} / 255.0::DOUBLE * {2 * reach} - {reach})"
        return f"(1 / (1 + exp(-{v})))" if name == "sigmoid" else f"(2 / (1 + exp(-2 * {v})) - 1)"

    part = f"({at} - floor({at}))"
    inside = f"{height(f'floor({at})')} * (1 - {part}) + {height(f'least(floor({at}) + 1, 255)')} * {part}"
    return f"CASE WHEN {x} <= -{reach} THEN {low} WHEN {x} >= {reach} THEN 1 ELSE {inside} END"


_PAGE_WORDS = f"pw AS (SELECT conv_id AS page_id, turn AS line_id, {_SPLIT} AS words FROM conversations)"
_ESCAPED = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_JSON = r"""replace(replace(replace(replace(replace({}, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(9), '\t'), chr(13), '\r')"""
_ORDER = "ORDER BY line_id, array_to_string(words, ' ')"
_CHARSET = """cs AS (SELECT DISTINCT unicode(c) AS id, c AS unichar FROM (SELECT unnest(string_split(text, '')) AS c FROM conversations) WHERE c <> ''),
 kn AS (SELECT id, unichar, CASE WHEN regexp_matches(unichar, '^[a-z]$') THEN 3 WHEN regexp_matches(unichar, '^[A-Z]$') THEN 5 WHEN regexp_matches(unichar, '^[0-9]$') THEN 8 WHEN id BETWEEN 33 AND 126 THEN 16 ELSE 0 END AS properties FROM cs),
 ct AS (SELECT (id % 90)::INT AS code, max(id)::BIGINT AS unichar_id FROM kn WHERE id % 7 <> 0 GROUP BY 1)"""
ORACLE_SQL = {
    "grayscale": f"WITH p AS (SELECT vec_id, list_transform(embedding, lambda v: greatest(0, least(255, floor((v::DOUBLE + 0.6) * 200)))) AS p FROM embeddings), q AS (SELECT vec_id, p, unnest(range(0, len(p) // 3)) AS place FROM p) SELECT vec_id, place::INT AS place, floor(greatest(0.0::DOUBLE, least(255.0::DOUBLE, (0.299::FLOAT * p[3 * place + 1]::FLOAT + 0.587::FLOAT * p[3 * place + 2]::FLOAT + 0.114::FLOAT * p[3 * place + 3]::FLOAT)::DOUBLE)) + 0.5)::INT AS gray FROM q",
    "skew_profile": f"WITH {_RASTER}{_SKEW} SELECT * FROM sc",
    "detect_skew": f"WITH {_RASTER}{_SKEW}, tp AS (SELECT page_id, degrees FROM sc WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, degrees) = 1) SELECT page_id, coalesce(degrees, 0.0::DOUBLE) AS degrees FROM (SELECT DISTINCT page_id FROM px) LEFT JOIN tp USING (page_id)",
    "contrast": f"WITH {_RASTER} SELECT page_id, min(px) AS black, CASE WHEN max(px) > min(px) THEN (max(px) - min(px)) / 2.0::DOUBLE ELSE 1.0::DOUBLE END AS contrast FROM px GROUP BY 1",
    "connected_components": f"WITH RECURSIVE {_RASTER}{_OTSU}{_RUNS}, ed AS (SELECT a.r AS a, b.r AS b FROM rn a JOIN rn b ON a.page_id = b.page_id AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 + 1 AND b.x0 <= a.x1 + 1), rc AS (SELECT r AS root, r FROM rn UNION SELECT rc.root, ed.b FROM rc JOIN ed ON rc.r = ed.a), lb AS (SELECT r, min(root) AS root FROM rc GROUP BY 1) SELECT page_id, min(x0) AS x, min(y) AS y, (max(x1) - min(x0) + 1)::INT AS w, (max(y) - min(y) + 1)::INT AS h, sum(x1 - x0 + 1)::BIGINT AS pixel_count FROM rn JOIN lb USING (r) GROUP BY page_id, root",
    "text_lines": f"WITH {_BLOBS}, ln2 AS (SELECT page_id, line_id, min(x) AS x_min, max(x + w) AS x_max, min(y) AS y_min, max(y + h) AS y_max, count(*) AS blobs FROM tx GROUP BY 1, 2) SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY y_min) - 1)::INT AS line_no, x_min, x_max, y_min, y_max, blobs FROM ln2",
    "softmax": f"WITH {_FRAMES}, e AS (SELECT line_id, t, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM fr) SELECT line_id, t, list_transform(e, lambda x: round(x / list_sum(e), 7)) AS probs FROM e",
    "activations": f"WITH {_FRAMES}, e AS (SELECT line_id, t, (generate_subscripts(logits, 1) - 1)::INT AS place, unnest(logits) * 10 AS v FROM fr) SELECT line_id, t, place, round(1 / (1 + exp(-greatest(-88, least(88, v)))), 6) AS sigmoid, round(2 / (1 + exp(-greatest(-88, least(88, 2 * v)))) - 1, 6) AS tanh, round(greatest(v, 0), 6) AS relu, round({_fast('sigmoid', 'v')}, 6) AS sigmoid_fast, round({_fast('tanh', 'v')}, 6) AS tanh_fast FROM e",
    "quantized": f"WITH {_FRAMES}, s AS (SELECT *, CASE WHEN {_TOP.format('logits')} > 0 THEN {_TOP.format('logits')} / 127.0::DOUBLE ELSE 1.0::DOUBLE END AS scale FROM fr) SELECT line_id, t, round(scale, 9) AS scale, list_transform(logits, lambda x: {_AWAY.format('(x / scale)')}) AS q FROM s",
    "mat_vec": f"WITH {_FRAMES}, {_WEIGHTS} SELECT line_id, t, r AS row, round({_DOT.format('v', 'w')} + w[64], 6) AS y FROM ve, wm",
    "fully_connected": f"WITH {_FRAMES}, {_WEIGHTS}, mv AS (SELECT line_id, t, r AS row, {_DOT.format('v', 'w')} + w[64] AS y FROM ve, wm) SELECT line_id, t, row, round({_fast('tanh', 'y')}, 6) AS y FROM mv",
    "mat_vec_int": f"WITH {_FRAMES}, {_WEIGHTS}, wq AS (SELECT r, s, list_transform(w, lambda x: {_AWAY.format('(x / s)')}) AS q FROM (SELECT *, CASE WHEN {_TOP.format('w')} > 0 THEN {_TOP.format('w')} / 127.0::DOUBLE ELSE 1.0::DOUBLE END AS s FROM wm)), vq AS (SELECT line_id, t, s, list_append(list_transform(v, lambda x: {_AWAY.format('(x / s)')}), {_AWAY.format('(1.0::DOUBLE / s)')}) AS q FROM (SELECT *, greatest(1.0::DOUBLE, {_TOP.format('v')}) / 127.0::DOUBLE AS s FROM ve)) SELECT line_id, t, r AS row, round({_DOT.format('vq.q', 'wq.q')}::BIGINT * wq.s * vq.s, 6) AS y FROM vq, wq",
    "dot_products": f"WITH {_FRAMES}, b AS (SELECT line_id, t, logits AS v, list_reverse(logits) AS b FROM fr), q AS (SELECT *, list_transform(v, lambda x: {_AWAY.format('(x * 127.0::DOUBLE)')}) AS vq, list_transform(b, lambda x: {_AWAY.format('(x * 127.0::DOUBLE)')}) AS bq FROM b) SELECT line_id, t, round({_DOT.format('v', 'b')}, 6) AS dot, {_DOT.format('vq', 'bq')}::BIGINT AS dot_int FROM q",
    "convolved": f"WITH {_FRAMES}, g AS (SELECT line_id AS id, t, t % 8 AS x, t // 8 AS y, logits[1:4] AS vec FROM fr), o AS (SELECT dx, dy FROM (SELECT unnest(range(-1, 2)) AS dx), (SELECT unnest(range(-1, 2)) AS dy)), n AS (SELECT a.id, a.t, dx, dy, coalesce(b.vec, [0.0, 0.0, 0.0, 0.0]::DOUBLE[]) AS vec FROM g a CROSS JOIN o LEFT JOIN g b ON b.id = a.id AND b.x = a.x + dx AND b.y = a.y + dy) SELECT id, t, flatten(list(vec ORDER BY dx, dy)) AS vec FROM n GROUP BY 1, 2",
    "reversed_steps": f"WITH {_FRAMES} SELECT line_id AS id, 31 - t AS t, logits[1:4] AS vec FROM fr",
    "transposed_steps": f"WITH {_FRAMES} SELECT line_id AS id, ((t % 8) * 4 + t // 8)::INT AS t, 8 AS rows, 4 AS columns, logits[1:4] AS vec FROM fr",
    "parallel_features": f"WITH {_FRAMES} SELECT a.line_id AS id, a.t, list_concat(a.logits[1:4], b.logits[1:4]) AS vec FROM fr a JOIN fr b ON b.line_id = a.line_id AND b.t = 31 - a.t",
    "box_methods": f"WITH RECURSIVE {_RASTER}{_OTSU}{_RUNS}, ed AS (SELECT a.r AS a, b.r AS b FROM rn a JOIN rn b ON a.page_id = b.page_id AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 + 1 AND b.x0 <= a.x1 + 1), rc AS (SELECT r AS root, r FROM rn UNION SELECT rc.root, ed.b FROM rc JOIN ed ON rc.r = ed.a), lb AS (SELECT r, min(root) AS root FROM rc GROUP BY 1), co AS (SELECT page_id, root, min(x0) AS x, min(y) AS y, max(x1) + 1 AS rt, max(y) + 1 AS bt FROM rn JOIN lb USING (r) GROUP BY page_id, root) SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY y, x, root) - 1)::INT AS seq, rt::INT AS \"right\", bt AS bottom, ((rt - x) * (bt - y))::BIGINT AS area, (8 >= x AND 8 < rt AND 8 >= y AND 8 < bt) AS holds, (y < 8 AND 0 < bt) AS beside FROM co",
    "render_text": f"WITH {_PAGE_WORDS} SELECT page_id, string_agg(array_to_string(words, ' '), chr(10) {_ORDER}) AS document FROM pw GROUP BY 1",
    "render_json": f"WITH {_PAGE_WORDS}, w AS (SELECT page_id, line_id, words, array_to_string(list_transform(words, lambda w, i: '{{\"text\":\"' || {_JSON.format('w')} || '\",\"confidence\":0.75,\"bbox\":{{\"x\":' || ((i - 1) * 100) || ',\"y\":' || (line_id * 40) || ',\"width\":' || (len(w) * 10) || ',\"height\":20}}}}'), ',') AS w FROM pw), l AS (SELECT page_id, string_agg('{{\"bbox\":{{\"x\":0,\"y\":' || (line_id * 40) || ',\"width\":1000,\"height\":20}},\"baseline\":{{\"slope\":0.0,\"intercept\":' || (line_id * 40 + 20) || '.0}},\"words\":[' || w || ']}}', ',' {_ORDER}) AS l, count(*) * 40 AS h FROM w GROUP BY 1) SELECT page_id, '{{\"page\":{{\"width\":1000,\"height\":' || h || ',\"blocks\":[{{\"bbox\":{{\"x\":0,\"y\":0,\"width\":1000,\"height\":' || h || '}},\"lines\":[' || l || ']}}]}}}}' AS document FROM l",
    "render_hocr": f"WITH {_PAGE_WORDS}, n AS (SELECT *, row_number() OVER (PARTITION BY page_id {_ORDER}) AS ln FROM pw), w AS (SELECT page_id, line_id, ln, array_to_string(list_transform(words, lambda w, i: '      <span class=\"ocrx_word\" id=\"word_1_1_' || ln || '_' || i || '\" title=\"bbox ' || ((i - 1) * 100) || ' ' || (line_id * 40) || ' ' || ((i - 1) * 100 + len(w) * 10) || ' ' || (line_id * 40 + 20) || '; x_wconf 75\">' || {_ESCAPED.format('w')} || '</span>' || chr(10)), '') AS w FROM n), l AS (SELECT page_id, string_agg('    <span class=\"ocr_line\" id=\"line_1_1_' || ln || '\" title=\"bbox 0 ' || (line_id * 40) || ' 1000 ' || (line_id * 40 + 20) || '; baseline 0.0 ' || (line_id * 40 + 20) || '.0\">' || chr(10) || w || '    </span>' || chr(10), '' ORDER BY ln) AS l, count(*) * 40 AS h FROM w GROUP BY 1) SELECT page_id, '{render.PROLOGUE}' || '<div class=\"ocr_page\" id=\"page_1\" title=\"bbox 0 0 1000 ' || h || '\">' || chr(10) || '  <div class=\"ocr_carea\" id=\"block_1_1\" title=\"bbox 0 0 1000 ' || h || '\">' || chr(10) || l || '  </div>' || chr(10) || '</div>' || chr(10) || '</body>' || chr(10) || '</html>' || chr(10) AS document FROM l",
    "align_tokens": f"WITH p AS (SELECT conv_id, turn, text, {_SPLIT} AS parts, (turn % 12 + 1)::INT AS n FROM conversations WHERE text IS NOT NULL), e AS (SELECT *, unnest(range(0, n)) AS place FROM p) SELECT conv_id, turn, place::INT AS place, CASE WHEN n > 1 AND len(parts) = n THEN parts[place + 1] WHEN place = 0 THEN text ELSE '' END AS text, CASE WHEN place = 0 OR (n > 1 AND len(parts) = n) THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM e",
    "dictionary_prefixes": f"WITH l AS (SELECT DISTINCT unnest(list_filter(string_split(lower(text), ' '), lambda w: w <> '')) AS w FROM benchmark), s AS (SELECT DISTINCT substr(w, 1, n) AS word FROM (SELECT w, unnest(range(0, length(w) + 1)) AS n FROM l)), t AS (SELECT lower(unnest({_SPLIT})) AS word FROM conversations) SELECT word, count(*) AS n FROM t WHERE word IN (SELECT word FROM s) GROUP BY 1",
    "code_table": f"WITH {_CHARSET} SELECT * FROM ct",
    "decoded_text": f"WITH {_FRAMES}, c AS (SELECT line_id, t, (list_position(logits, list_max(logits)) - 1)::INT AS code FROM fr), b AS (SELECT *, lag(code) OVER (PARTITION BY line_id ORDER BY t) AS b FROM c), {_CHARSET}, g AS (SELECT line_id, t, code + 20 AS code FROM b WHERE code <> 0 AND (b IS NULL OR b <> code)) SELECT line_id, string_agg(coalesce(unichar, ''), '' ORDER BY t) AS text FROM g LEFT JOIN ct USING (code) LEFT JOIN kn ON kn.id = ct.unichar_id GROUP BY 1",
    "character_kinds": f"WITH {_CHARSET} SELECT id, properties & 1 <> 0 AS alpha, properties & 2 <> 0 AS lower, properties & 4 <> 0 AS upper, properties & 8 <> 0 AS digit, properties & 16 <> 0 AS punct FROM kn",
    "graph_edges": "WITH e AS (SELECT o_orderkey, o_orderkey * 7919 AS rec FROM orders) SELECT o_orderkey, (rec & 127)::INT AS letter, rec >> 10 AS next, (rec >> 7) & 1 <> 0 AS last, (rec >> 7) & 2 <> 0 AS backward, (rec >> 7) & 4 <> 0 AS word_end FROM e",
    "float_format": "SELECT s_suppkey, regexp_replace(printf('%.6f', floor(s_acctbal) / 8), '(\\.[0-9]+?)0+$', '\\1') AS formatted FROM supplier",
    "histogram": f"WITH {_RASTER} SELECT page_id, px, count(*) AS n FROM px GROUP BY 1, 2",
    "otsu_threshold": f"WITH {_RASTER}{_OTSU} SELECT * FROM ot",
    "binarized": f"WITH {_RASTER}{_OTSU} SELECT page_id, y, x, CASE WHEN px > threshold THEN 255 ELSE 0 END AS px FROM px JOIN ot USING (page_id)",
    "projection_profile": f"WITH {_RASTER} SELECT page_id, y, count(*) FILTER (px < 128) AS n FROM px GROUP BY 1, 2",
    "sharpness": f"WITH {_RASTER}, p AS (SELECT page_id, y, count(*) FILTER (px < 128) AS n FROM px GROUP BY 1, 2), d AS (SELECT page_id, n - lag(n) OVER (PARTITION BY page_id ORDER BY y) AS d FROM p) SELECT page_id, coalesce(sum(d * d), 0)::BIGINT AS score FROM d GROUP BY 1",
    "black_runs": f"WITH {_RASTER}{_OTSU}, k AS (SELECT page_id, y, x, x - row_number() OVER (PARTITION BY page_id, y ORDER BY x) AS g FROM px JOIN ot USING (page_id) WHERE px <= threshold) SELECT page_id, y, min(x) AS x0, max(x) AS x1 FROM k GROUP BY page_id, y, g",
    "maxpool": f"WITH {_RASTER} SELECT page_id, (y // 2)::INT AS y, (x // 3)::INT AS x, max(px) AS px FROM px GROUP BY 1, 2, 3",
    "blob_classes": f"WITH {_BLOBS} SELECT page_id, line_id, seq, blob_type FROM b",
    "words": f"WITH {_WORDS} SELECT page_id, line_id, word_id, min(x) AS x, min(y) AS y, max(x + w) AS \"right\", max(y + h) AS bottom, count(*) AS n_blobs FROM wd GROUP BY 1, 2, 3",
    "baselines": f"WITH {_BLOBS}, p AS (SELECT page_id, line_id, x + w / 2.0::DOUBLE AS cx, (y + h)::DOUBLE AS cy FROM tx), s AS (SELECT page_id, line_id, count(*) AS n, sum(cx) AS sx, sum(cy) AS sy, sum(cx * cy) AS sxy, sum(cx * cx) AS sxx FROM p GROUP BY 1, 2), q AS (SELECT *, CASE WHEN n < 2 OR abs(n * sxx - sx * sx) < 1e-9 THEN 0.0::DOUBLE ELSE (n * sxy - sx * sy) / (n * sxx - sx * sx) END AS slope FROM s) SELECT page_id, line_id, slope, (sy - slope * sx) / n AS intercept FROM q",
    "block_boxes": f"WITH {_BLOBS} SELECT page_id, min(x) AS x, min(y) AS y, max(x + w) AS \"right\", max(y + h) AS bottom FROM tx GROUP BY 1",
    "arg_max": f"WITH {_FRAMES} SELECT line_id, t, (list_position(logits, list_max(logits)) - 1)::INT AS code FROM fr",
    "top_classes": f"WITH {_FRAMES}, e AS (SELECT line_id, t, unnest(logits) AS p, generate_subscripts(logits, 1) - 1 AS code FROM fr), r AS (SELECT *, row_number() OVER (PARTITION BY line_id, t ORDER BY p DESC, code) AS rank FROM e) SELECT line_id, t, rank, code FROM r WHERE rank <= 5",
    "greedy_codes": f"WITH {_FRAMES}, c AS (SELECT line_id, t, (list_position(logits, list_max(logits)) - 1)::INT AS code, round(-ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))), 6) AS conf FROM fr), b AS (SELECT *, lag(code) OVER (PARTITION BY line_id ORDER BY t) AS b FROM c) SELECT line_id, t, code, conf FROM b WHERE code <> 0 AND (b IS NULL OR b <> code)",
    "word_split": f"SELECT conv_id AS page_id, turn AS line_id, len({_SPLIT})::INT AS n_words FROM conversations",
    "page_text": f"SELECT conv_id AS page_id, string_agg(array_to_string({_SPLIT}, ' '), chr(10) ORDER BY turn, array_to_string({_SPLIT}, ' ')) AS text FROM conversations GROUP BY 1",
    "html_escape": """SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM pages""",
    "json_escape": r"""SELECT conv_id, turn, replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(9), '\t'), chr(13), '\r') AS escaped FROM conversations""",
    "dictionary_words": f"WITH l AS (SELECT DISTINCT unnest(list_filter(string_split(lower(text), ' '), lambda w: w <> '')) AS word FROM benchmark), t AS (SELECT lower(unnest({_SPLIT})) AS word FROM conversations) SELECT word, count(*) AS n FROM t WHERE word IN (SELECT word FROM l) GROUP BY 1",
    "flag_bits": "SELECT p_partkey, greatest(1, floor(log2(p_partkey)) + 1)::INT AS bits FROM part",
}
