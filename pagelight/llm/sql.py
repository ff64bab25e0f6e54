"""SQL for the queries over shards, manifests and spelling variants."""

from __future__ import annotations

#: Levels of a source's tree and of the tree over sources that the SQL goes up.
_LEVELS, _UPPER = 14, 6

#: CRC-32 by a table of 256 entries; `tb` is its one row, bytes a list of numbers.
_CRC_TABLE = """tbl AS (SELECT list(c ORDER BY i) AS tb FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM range(256) AS r(i)))"""
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes}), lambda s, b: xor(s >> 8, tb[(xor(s, b) & 255) + 1])), 4294967295)"
#: UTF-8 bytes of a text of code points under 0x800.
_BYTES = "flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 + (unicode(c) >> 6))::BIGINT, (128 + (unicode(c) & 63))::BIGINT] END))"


def _tree(name: str, start: str, levels: int) -> list[str]:
    """CTEs {name}0 to {name}N of nodes (g, i, h, n), level by level, and {name}s0.. with what is left and right of a node in its run."""
    out = [f"{name}0 AS MATERIALIZED ({start})"]
    for k in range(levels):
        run = "PARTITION BY g, i // 3 ORDER BY i ROWS BETWEEN"
        out.append(f"{name}s{k} AS MATERIALIZED (SELECT g, i, n, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt FROM {name}{k})")
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT g, i // 3 AS i, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (n + 2) // 3 AS n FROM {name}{k} GROUP BY g, i // 3, n)")
    return out


def _walk(name: str, tree: str, start: str, levels: int) -> list[str]:
    """CTEs {name}0 to {name}N of rows (rid, g, i, proof, f) on their way up."""
    out = [f"{name}0 AS MATERIALIZED ({start})"]
    for k in range(levels):
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT rid, p.g, p.i // 3 AS i, proof || lft || rgt AS proof, CASE WHEN n = 1 THEN f ELSE sha256(lft || f || rgt) END AS f FROM {name}{k} AS p JOIN {tree}s{k} AS s ON p.g = s.g AND p.i = s.i)")
    return out


def merkle() -> str:
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"
    head = " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars"))
    even = f"{_CRC.format(bytes=_BYTES.format(text='doc_id::VARCHAR'))} % 2 = 0"
    leaves = f"""SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS g, sha256({head} || {part("text")}) AS leaf,
  sha256({head} || CASE WHEN doc_id IS NOT NULL AND {even} THEN {part("replace(text, chr(10), '')")} ELSE {part("text")} END) AS bad FROM documents, tbl"""
    placed = "SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM lf"
    ctes = [_CRC_TABLE, f"lf AS ({leaves})", f"pl AS MATERIALIZED ({placed})"]
    ctes += _tree("a", "SELECT g, i, leaf AS h, n FROM pl", _LEVELS)
    ctes += _tree("b", f"SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h, count(*) OVER () AS n, g AS name FROM a{_LEVELS}", _UPPER)
    ctes += _walk("p", "a", "SELECT rid, g, i, '' AS proof, bad AS f FROM pl", _LEVELS)
    ctes += _walk("q", "b", f"SELECT rid, '' AS g, b0.i, proof, f FROM p{_LEVELS} AS p JOIN b0 ON b0.name = p.g", _UPPER)
    return f"""WITH {", ".join(ctes)}
SELECT doc_id, source, pl.i AS pos, leaf, a.h AS subroot, r.h AS root, f AS folded_root, sha256(proof) AS proof_sha256, f = r.h AS verified
FROM pl JOIN q{_UPPER} AS q USING (rid) JOIN a{_LEVELS} AS a ON a.g = pl.g CROSS JOIN b{_UPPER} AS r"""


def variants() -> str:
    h = _CRC.format(bytes=_BYTES.format(text="coalesce(doc_id::VARCHAR, '') || ':' || run"))
    return f"""WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
u AS MATERIALIZED (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 5 GROUP BY ALL),
k AS MATERIALIZED (SELECT run, n, {h} AS h FROM u, tbl),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM k),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
d AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
pairs AS MATERIALIZED (SELECT a.word, b.word AS near, b.n AS near_n FROM d AS a JOIN d AS b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
 UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.cut = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.cut = v.word),
top AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k FROM pairs),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n FROM v LEFT JOIN top ON top.word = v.word AND k = 1),
chain AS (SELECT word, word AS root FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, root FROM f JOIN chain ON chain.word = f.word JOIN f AS g ON g.word = chain.root AND g.form IS NULL"""


def sharding(slots: int, shards: int) -> str:
    """The table is filled anew: in each step the next shard in turn claims the first free slot of its order of preference."""
    number = "('0x' || substr(md5({}), 1, 15))::BIGINT"
    return f"""WITH RECURSIVE sh AS MATERIALIZED (SELECT i, 'shard-' || lpad(i::VARCHAR, 5, '0') AS name FROM range({shards}) AS r(i)),
pr AS MATERIALIZED (SELECT i, name, {number.format("'offset:' || name")} % {slots} AS first, {number.format("'skip:' || name")} % ({slots} - 1) + 1 AS skip FROM sh),
fl AS (SELECT 0 AS k, list_transform(range({slots}), lambda x: -1::BIGINT) AS tb
 UNION ALL SELECT k + 1, list_transform(tb, lambda v, p: CASE WHEN p - 1 = slot THEN i ELSE v END) FROM (
  SELECT k, tb, i, list_filter(list_transform(range({slots}), lambda j: (first + j * skip) % {slots}), lambda x: tb[x + 1] < 0)[1] AS slot FROM fl JOIN pr ON pr.i = k % {shards} WHERE k < {slots})),
full_table AS MATERIALIZED (SELECT tb FROM fl WHERE k = {slots}),
pl AS (SELECT doc_id, ({number.format("coalesce(doc_id::VARCHAR, '')")} % {slots})::INT AS slot FROM documents)
SELECT doc_id, slot, name AS shard FROM pl, full_table JOIN sh ON sh.i = tb[slot + 1]"""
