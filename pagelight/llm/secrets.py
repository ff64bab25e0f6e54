"""Secret scan (DataFrame functions only): fixed patterns and a battery of randomness tests.

Patterns are found with sentinels: a match is wrapped in private characters, the text is split at
them, and running lengths give code-point offsets. (The sentinels' own characters are first
replaced by another one; no pattern has it, and lengths stay.) Pieces are summed in blocks of ``BLOCK``, so a text
with very many matches costs in proportion.

The battery takes every token of 20 or more characters of `A-Za-z0-9+/_=-`. By the encoding inferred (hexadecimal, base32,
base64) it computes a chi-squared statistic of uniform use of the alphabet, in eight cells of nearly one size, a runs test about the
alphabet's middle, and the lag-one serial correlation. Of base64 only the 62 letters and digits count: a key's are as uniform
without the others (+/_-), and names and paths join words by those, which the decoys don't have. The squares of the three (of the first only where use is uneven) add up to
one statistic, whose upper tail under randomness is the token's p-value: near nothing for words and names, anything for a key.

False discoveries are controlled by decoys: the same battery runs on pieces of the texts' own prose, as many as there are
tokens, with the letters and digits between tokens joined, and on ``FIXED`` pieces of joined common words for each class
of length, so that a small table has decoys too. Within a class of length, tokens down to a p-value are discoveries
where the share of decoys that get that far, times the number of tokens, is at most ``FDR`` of the discoveries, and the p-value
isn't under 10^-``REJECT``. Longer tokens tell more, so their classes reach further. Histograms of a bounded number of
bins hold all counts; no list of tokens is sorted or gathered.

A null or empty text has no spans; repeated rows each get theirs; ties go by start, then kind; columns of any name may be
there, but scan's result is the id and `found` only; an empty table gives an empty result.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelight.llm.common import COMMON_WORDS, Scratch, materialize, quoted

KINDS = ("assign", "access", "hex", "random")
FDR, REJECT, BINS, BLOCK, CHUNK, FIXED = 0.01, 3, 240, 256, 4096, 200
_S, _M, _E, _X = "\uE000", "\uE001", "\uE002", "\uE003"
#: Where classes of length begin; a decoy has the length of its class.
_LENGTHS = (20, 24, 32, 40, 48, 64, 96)
_ASSIGN = r"((?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)([A-Za-z0-9+/_.=-]+)"
_TOKEN = "[A-Za-z0-9+/_=-]{20,}"


def _wrapped(pattern: str, to: str):
    return F.split(F.regexp_replace("_clean", pattern, to), _S)


def _let(name: str, value: str, body: str) -> str:
    """An expression with a named part that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _spans(pieces: str, marks: int, least: str) -> str:
    """Spans of the pieces; marks: sentinels within a match; least: condition on p, a piece that begins with a match."""
    length = f"(length(p) - if(instr(p, '{_E}') > 0, {marks}, 0))"
    block = f"slice({pieces}, k * {BLOCK} + 1, {BLOCK})"
    blocks = f"sequence(0, (size({pieces}) - 1) div {BLOCK})"
    sums = f"transform({blocks}, k -> aggregate({block}, 0, (a, p) -> a + {length}))"
    starts = f"aggregate({sums}, array(0), (a, n) -> concat(a, array(element_at(a, -1) + n)))"
    step = f"""(a, p) -> named_struct('pos', a.pos + {length}, 'out', if(instr(p, '{_E}') > 0 and {least},
        concat(a.out, array(named_struct('s', a.pos, 'e', a.pos + instr(p, '{_E}') - {marks}, 'v', substring(p, 1, instr(p, '{_E}') - 1)))), a.out))"""
    out = "cast(array() as array<struct<s:int,e:int,v:string>>)"
    return _let("at", starts, f"flatten(transform({blocks}, k -> aggregate({block}, named_struct('pos', at[k], 'out', {out}), {step}, a -> a.out)))")


def _battery(tok: str) -> str:
    """struct(bin, size, ok) of a token: its p-value's place, its class of length, whether it has enough characters to judge."""
    alpha = f"case when translate({tok}, '-', '') rlike '^([0-9a-f]+|[0-9A-F]+)$' then 16 when {tok} rlike '^[A-Z2-7]+=*$' then 32 else 62 end"
    place = """case when alpha = 16 then instr('0123456789abcdef', lower(c)) - 1 when alpha = 32 then instr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', c) - 1
        else instr('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789', c) - 1 end"""
    n = "size(idx)"
    share = "if(alpha = 62, if(k % 4 = 3, 7, 8) / 62D, 0.125D)"  # of the alphabet in cell k
    chi = f"(aggregate(sequence(0, 7), 0D, (a, k) -> a + pow(size(filter(idx, y -> y * 8 div alpha = k)), 2) / ({share})) / {n} - {n})"
    z_chi = f"((pow(greatest({chi}, 0D) / 7, 1/3D) - (1 - 2 / 63D)) / sqrt(2 / 63D))"
    z_runs = f"((1 + size(filter(sequence(1, {n} - 1), i -> (idx[i] >= alpha / 2) <> (idx[i - 1] >= alpha / 2))) - mr) / sqrt(greatest((mr - 1) * (mr - 2) / ({n} - 1), 0.25D)))"
    z_runs = _let("mr", _let("ups", "size(filter(idx, x -> x >= alpha / 2))", f"2D * ups * ({n} - ups) / {n} + 1"), z_runs)
    cov = f"aggregate(sequence(1, {n} - 1), 0D, (a, i) -> a + (idx[i] - m) * (idx[i - 1] - m)) / greatest(aggregate(idx, 0D, (a, x) -> a + (x - m) * (x - m)), 1D)"
    z_serial = _let("m", f"aggregate(idx, 0D, (a, x) -> a + x) / {n}", f"{cov} * sqrt({n})")
    total = f"(pow(greatest({z_chi}, 0D), 2) + pow({z_runs}, 2) + pow({z_serial}, 2))"
    z = f"least((pow({total} / 3, 1/3D) - (1 - 2 / 27D)) / sqrt(2 / 27D), 20D)"  # normal, for three squares
    tail = _let("z", z, "log10(1 + exp(1.5976 * z + 0.070566 * z * z * z))")  # -log10 of the upper tail
    size_class = "(" + " + ".join(f"if(length({tok}) >= {x}, 1, 0)" for x in _LENGTHS[1:]) + ")"
    judged = f"if({n} < 12, named_struct('bin', {BINS - 1}, 'size', {size_class}, 'ok', false), named_struct('bin', cast(least({BINS - 1}, floor({tail} * 20)) as int), 'size', {size_class}, 'ok', true))"
    return _let("alpha", alpha, _let("idx", f"filter(transform(split(rtrim('=', {tok}), ''), c -> {place}), x -> x >= 0)", judged))


def _scanned(docs: DataFrame, text_col: str, kept: list[str]) -> DataFrame:
    """(_row, _a, _k, _h, _t, _tests, _decoys) of every row; _row holds the columns named."""
    text = F.translate(F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")), _S + _M + _E, _X * 3)
    row = F.struct(*[F.col(quoted(c)) for c in dict.fromkeys(kept)]) if kept else F.lit(None)
    base = docs.select(row.alias("_row"), text.alias("_clean"))
    pieces = base.select(
        "_row", "_clean",
        _wrapped(_ASSIGN, f"{_S}$1{_M}$2{_E}").alias("_pa"), _wrapped("(AKIA[A-Z0-9]{14,})", f"{_S}$1{_E}").alias("_pk"),
        _wrapped("([0-9a-f]{16,})", f"{_S}$1{_E}").alias("_ph"), _wrapped(f"({_TOKEN})", f"{_S}$1{_E}").alias("_pt"),
    )
    # what no token holds, letters and digits only, cut into pieces of one class of length
    prose = F.regexp_replace(F.regexp_replace("_clean", _TOKEN, ""), "[^A-Za-z0-9]+", "")
    lengths = F.array(*map(F.lit, _LENGTHS))
    cut = F.concat(F.lit("(?s).{"), F.element_at(lengths, F.pmod(F.xxhash64("_clean"), F.lit(len(_LENGTHS))).cast("int") + 1).cast("string"), F.lit("}"))
    decoys = F.when(F.size("_pt") > 1, F.slice(F.regexp_extract_all(prose, cut, F.lit(0)), F.lit(1), F.size("_pt") - 1)).otherwise(F.array().cast("array<string>"))
    spans = pieces.select(
        "_row", F.expr(_spans("_pa", 2, f"instr(p, '{_E}') - instr(p, '{_M}') - 1 >= 12")).alias("_a"), F.expr(_spans("_pk", 1, "true")).alias("_k"),
        F.expr(_spans("_ph", 1, "true")).alias("_h"), F.expr(_spans("_pt", 1, "true")).alias("_t"), decoys.alias("_d"),
    )
    bare = lambda c, k: F.expr(f"transform({c}, x -> named_struct('s', x.s, 'k', {k}, 'e', x.e))").alias(c)
    return spans.select("_row", *[bare(c, k) for k, c in enumerate(("_a", "_k", "_h", "_t"))], F.expr(f"transform(_t, x -> {_battery('x.v')})").alias("_tests"), F.expr(f"transform(_d, x -> {_battery('x')})").alias("_decoys"))


def _fixed_decoys(spark: SparkSession) -> DataFrame:
    """(t): the battery's results on pieces of joined common words."""
    rng = random.Random(7)
    pieces = ["".join(rng.choice(COMMON_WORDS).capitalize() if rng.random() < 0.1 else rng.choice(COMMON_WORDS) for _ in range(60))[:n] for n in _LENGTHS for _ in range(FIXED)]
    return spark.range(1).select(F.explode(F.split(F.lit(",".join(pieces)), ",")).alias("x")).select(F.expr(_battery("x")).alias("t"))


def _levels(scanned: DataFrame) -> dict[int, int]:
    """The last bin that counts as a discovery in each class of length."""
    each = scanned.select(F.explode("_tests").alias("t"), F.lit(False).alias("decoy")).unionByName(scanned.select(F.explode("_decoys").alias("t"), F.lit(True).alias("decoy")))
    each = each.unionByName(_fixed_decoys(scanned.sparkSession).select("t", F.lit(True).alias("decoy")))
    rows = each.where("t.ok").groupBy("t.size", "t.bin", "decoy").count().collect()  # at most 2 * 7 * BINS
    counts = {(s, d): [0] * BINS for s in range(len(_LENGTHS)) for d in (False, True)}
    for r in rows:
        counts[r["size"], r["decoy"]][r["bin"]] = r["count"]
    out = {}
    for size in range(len(_LENGTHS)):
        tokens, decoys = counts[size, False], counts[size, True]
        found = false = 0
        for b in range(20 * REJECT):
            found, false = found + tokens[b], false + decoys[b]
            if found and false * sum(tokens) <= FDR * found * sum(decoys):
                out[size] = b
    return out


def _found(scanned: DataFrame, levels: dict[int, int]) -> DataFrame:
    """(_row, _found): all spans by start, then kind."""
    table = "array(" + ", ".join(str(levels.get(i, -1)) for i in range(len(_LENGTHS))) + ")"
    extra = F.expr(f"filter(_t, (x, i) -> _tests[i].ok and _tests[i].bin <= {table}[_tests[i].size])")
    named = "transform(_all, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e, 'kind', element_at(array('assign', 'access', 'hex', 'random'), x.k + 1)))"
    return scanned.select("_row", F.array_sort(F.concat("_a", "_k", "_h", extra)).alias("_all")).select("_row", F.expr(named).alias("_found"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, found array<struct<s,k,e,kind>>): spans by start, then kind; ends are exclusive. Texts are read once;
    their spans, not the texts, are written until the levels are known."""
    held = materialize(_scanned(docs, text_col, [id_col]), "secret-spans")
    return _found(held, _levels(held)).select(F.col("_row")[id_col].alias(id_col), F.col("_found").alias("found"))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    count = lambda k: F.size(F.filter("found", lambda x: x["k"] == k)).cast("long")
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    base = F.filter("found", lambda x: x["k"] < 3)
    return found.select(F.col(quoted(id_col)), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with every found span replaced by mark (overlapping spans by one), and its length column brought up to date. All
    columns stay as they are named. Texts are read twice, for the levels and for the spans, and never written here.

    A text is rewritten in chunks, each with the spans that begin in it, so that many spans cost in proportion."""
    with Scratch(docs.sparkSession, "redact") as run:
        levels = _levels(run.write(_scanned(docs, text_col, []).select("_tests", "_decoys"), "tests"))
    found = _found(_scanned(docs, text_col, docs.columns), levels)
    before = f"coalesce(array_max(transform(filter(_found, x -> x.s < k * {CHUNK}), x -> x.e)), 0) - k * {CHUNK}"
    step = f"""(a, x) -> if(x.s - k * {CHUNK} >= a.to,
        named_struct('to', x.e - k * {CHUNK}, 'out', concat(a.out, substring(c, a.to + 1, x.s - k * {CHUNK} - a.to), '{mark}')), named_struct('to', greatest(a.to, x.e - k * {CHUNK}), 'out', a.out))"""
    chunk = f"aggregate(filter(_found, x -> x.s >= k * {CHUNK} and x.s < (k + 1) * {CHUNK}), named_struct('to', greatest(0, {before}), 'out', ''), {step}, a -> concat(a.out, substring(c, a.to + 1)))"
    text = F.col("_row")[text_col]
    chunks = F.regexp_extract_all(text.cast("string"), F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    none = F.size("_found") == 0
    out = found.select("_row", "_found", F.when(none, F.array().cast("array<string>")).otherwise(chunks).alias("_chunks"))
    new = F.when(none, text.cast("string")).otherwise(F.array_join(F.expr(f"transform(_chunks, (c, k) -> {chunk})"), ""))
    out = out.select("_row", none.alias("_none"), new.alias("_new"))
    fields = []
    for c in docs.columns:
        own, kind = F.col("_row")[c], docs.schema[c].dataType
        if c == text_col:
            own = F.col("_new").cast(kind)
        elif c == length_col:
            own = F.when(F.col("_none"), own).otherwise(F.length("_new").cast(kind))
        fields.append(own.alias(c))
    return out.select(*fields)
