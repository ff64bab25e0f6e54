"""URL filter: allow and block rules on hosts and paths; block decisions reach aliases.

Redirects (meta refresh) and canonical links of pages are edges between URLs. Distributed connected
components over them make classes of equivalent URLs; a class with a URL that a rule blocks is
blocked, but a URL with an allow rule of its own stays allowed.

Rules are a table of any size. A host's suffixes (itself, without its first label, and so on) are joined with the rules' hosts, once for each
different host and path, and the longest rule whose path fits is taken; no URL is compared with rules of other hosts. Markup is cut out of
the html first, so only URLs, not pages, are moved.

A null URL, or one without ``://``, has an empty host and path and no aliases. Repeated rows get the same verdict. Of rules of equal length
allow comes first. A link in a comment (one without an end reaches to the page's), in a script or in another element read raw is none. Attributes are told
apart by their quotes, the first of a name counts, and character references in targets are written out; ``rel`` and ``http-equiv`` are taken as they are written.
Very long pages are searched whole; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelight.llm.common import ascii_lower, materialize, quoted
from pagelight.llm.components import connected_components

#: (verdict, host, path prefix)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

#: Attributes of a tag, with quoted values that may hold any character. All loops are possessive, so long pages need no stack.
_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
#: What holds no tags: comments and the text of elements that are read raw, up to their end or the page's.
_RAW = rf"""(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|xmp|iframe|noembed|noframes)(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1(?=[\s/>])|\z)"""
_LINKS = rf"(?is)<(?:link|meta|base)(?=[\s/>]){_ATTRIBUTES}>"
_ATTRIBUTE = r"""(?s)([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+))?+"""
_ENTITY = r"(?i)&(?:#[0-9]{1,7}|#x[0-9a-f]{1,6}|amp|lt|gt|quot|apos|colon|sol|quest|num|period|equals);?"
#: Named references that URLs are written with (fixed values).
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "colon": ":", "sol": "/", "quest": "?", "num": "#", "period": ".", "equals": "="}


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """(kind, rule_host, rule_path)."""
    if isinstance(rules, DataFrame):
        return rules.toDF("kind", "rule_host", "rule_path")
    columns = zip(*rules) if rules else ((), (), ())
    return spark.createDataFrame(pa.table({n: pa.array(c, pa.string()) for n, c in zip(("kind", "rule_host", "rule_path"), columns)}))


def longest_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls(host, path) to (host, path, rule, own), once for each host and path that a rule fits."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = urls.where("host <> ''").select("host", "path").distinct().select("host", "path", F.explode(F.array_distinct(suffixes)).alias("rule_host"))
    fits = each.join(rules, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    longest = F.struct(F.length("rule_host") + F.length("rule_path"), F.col("kind") == "allow", F.concat("rule_host", "rule_path"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("kind").alias("own")), longest).alias("r"))
    return best.select("host", "path", "r.rule", "r.own")


def canonical_form(url: Column) -> Column:
    """Without fragment, scheme and host in lower case: the node of a URL."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    head = F.regexp_extract(bare, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.concat(ascii_lower(head), F.substr(bare, F.length(head) + 1))


def _attributes(tag: Column) -> Column:
    """A tag's attributes in order, names in lower case, values without quotes."""
    found = F.regexp_extract_all(F.regexp_replace(tag, r"(?s)^<[a-zA-Z]+|/?>$", " "), F.lit(_ATTRIBUTE), F.lit(0))

    def parts(a: Column) -> Column:
        value = F.regexp_extract(a, _ATTRIBUTE, 2)
        return F.struct(ascii_lower(F.regexp_extract(a, _ATTRIBUTE, 1)).alias("name"), F.when(value.rlike("^[\"']"), F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value).alias("value"))

    return F.transform(found, parts)


def _value(tag: Column, name: str) -> Column:
    """The first attribute of that name, null where there is none."""
    return F.try_element_at(F.filter(tag["attributes"], lambda a: a["name"] == name), F.lit(1))["value"]


def unescaped(text: Column) -> Column:
    """Character references written out, numbers of no character as U+FFFD; names other than those of `_NAMED` stay."""
    names = F.create_map(*[F.lit(x) for pair in _NAMED.items() for x in pair])

    def character(e: Column) -> Column:
        body = ascii_lower(F.regexp_extract(e, "^&([^;]*)", 1))
        code = F.when(body.startswith("#x"), F.conv(F.substr(body, F.lit(3)), 16, 10)).when(body.startswith("#"), F.substr(body, F.lit(2))).cast("long")
        real = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.coalesce(F.when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).when(code.isNotNull(), "\ufffd"), names[body], e)

    between = F.split(text, _ENTITY)
    references = F.transform(F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0)), character)
    paired = F.zip_with(between, F.concat(references, F.array(F.lit(""))), lambda b, r: F.concat(b, r))
    return F.when(text.contains("&"), F.array_join(paired, "")).otherwise(text)


def _without_dots(path: Column) -> Column:
    """A path without . and .. segments."""
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.lit(1), F.size(acc) - 1))
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == ".", acc).when(p == "..", up(acc)).otherwise(F.concat(acc, F.array(p))))
    return F.when(path.contains("/."), F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))).otherwise(path)


def resolved(rows: DataFrame, target: str, url: str, out: str) -> DataFrame:
    """rows with the column `out`: the link in `target` as seen from `url`. Step by step, as each step is used several times."""
    t, root, path, whole = F.col(target), F.col("_root"), F.col("_path"), F.col("_whole")
    rows = rows.withColumn("_root", F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)).withColumn("_path", path_of(F.col(url)))
    rows = rows.withColumn("_folder", F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1)))
    rows = rows.withColumn(
        "_whole",
        F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), t)
        .when(t.startswith("//"), F.concat(F.regexp_extract(root, r"(?s)^(.*?:)//", 1), t))
        .when(t.startswith("/"), F.concat(root, t))
        .when(t.startswith("?"), F.concat(root, F.when(path == "", F.lit("/")).otherwise(path), t))
        .otherwise(F.concat(root, F.col("_folder"), t)),
    )
    rows = rows.withColumn("_head", F.regexp_extract(whole, r"(?s)^(.*?://[^/?#]*)", 1)).withColumn("_own", path_of(whole))
    rest = F.substr(whole, F.length("_head") + F.length("_own") + 1)
    return rows.withColumn(out, F.concat("_head", _without_dots(F.col("_own")), rest)).drop("_root", "_path", "_folder", "_whole", "_head", "_own")


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(u, v): a page's URL and a redirect or canonical target, both in canonical form; a page's base comes before its URL."""
    url, html = F.col(quoted(url_col)), F.col(quoted(html_col)).cast("string")
    tags = F.regexp_extract_all(F.regexp_replace(html, _RAW, " "), F.lit(_LINKS), F.lit(0))
    # tags are cut out before their attributes are looked at, once for each page
    found = pages.where(url.contains("://") & html.rlike(r"(?i)canonical|refresh")).select(url.alias("url"), tags.alias("tags")).where(F.size("tags") > 0)
    found = materialize(found, "url-tags")
    split = F.transform("tags", lambda t: F.struct(ascii_lower(F.regexp_extract(t, r"^<([a-zA-Z]+)", 1)).alias("kind"), _attributes(t).alias("attributes")))
    found = found.select("url", F.explode(F.array(split)).alias("tags"))  # named once, used several times
    has = lambda text, word: F.array_contains(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"\s+"), word)
    base = F.try_element_at(F.filter(F.transform(F.filter("tags", lambda t: t["kind"] == "base"), lambda t: _value(t, "href")), lambda h: h.isNotNull()), F.lit(1))
    canonical = F.transform(F.filter("tags", lambda t: (t["kind"] == "link") & has(_value(t, "rel"), "canonical")), lambda t: _value(t, "href"))
    fresh = F.filter("tags", lambda t: (t["kind"] == "meta") & (F.trim(ascii_lower(_value(t, "http-equiv"))) == "refresh"))
    # a content is written out before its URL is looked for, an href after
    refresh = F.transform(fresh, lambda t: F.regexp_extract(unescaped(_value(t, "content")), r"""(?is)\burl\s*=\s*["']?([^"']*)""", 1))
    every = F.concat(F.transform(canonical, unescaped), refresh)
    found = found.select("url", F.trim(F.coalesce(unescaped(base), F.lit(""))).alias("base"), F.explode(F.array_distinct(F.transform(every, lambda t: F.trim(t)))).alias("target"))
    found = resolved(found.where((F.col("target") != "") & ~F.col("target").startswith("#")), "base", "url", "_based")
    found = found.withColumn("seen", F.when(F.col("base") != "", F.col("_based")).otherwise(F.col("url")))
    found = resolved(found, "target", "seen", "to").select(canonical_form(F.col("url")).alias("u"), canonical_form(F.col("to")).alias("v"))
    # written first: a filter moved below the steps would spell each of them out many times
    return materialize(found.distinct(), "url-edges").where("u <> v and v like '%://%'")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", default: str = "allow") -> DataFrame:
    """(id_col, host, path, rule, verdict, alias_of): alias_of is the smallest URL of the class, null without aliases."""
    rules = rule_table(pages.sparkSession, RULES if rules is None else rules)
    url = F.col(quoted(url_col)).cast("string")
    base = pages.select(F.col(quoted(id_col)).alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical_form(url).alias("_node"))
    own = materialize(longest_rules(base, rules), "url-rules")
    base = base.join(own, ["host", "path"], "left")
    edges = link_edges(pages, url_col, html_col)
    if edges.isEmpty():
        out = base.withColumn("alias_of", F.lit(None).cast("string")).withColumn("_class", F.lit(None).cast("string"))
    else:
        classes = connected_components(edges).withColumn("host", host_of(F.col("node"))).withColumn("path", path_of(F.col("node")))
        judged = classes.join(longest_rules(classes, rules), ["host", "path"], "left")
        bad = materialize(judged.groupBy("component").agg(F.max(F.when(F.col("own") == "block", 1).otherwise(0)).alias("_bad")), "url-bad")
        named = materialize(classes.join(bad, "component").select(F.col("node").alias("_n"), F.col("component").alias("alias_of"), F.when(F.col("_bad") == 1, "block").alias("_class")), "url-named")
        out = base.join(named, base["_node"] == named["_n"], "left")
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("own", "_class", F.lit(default)).alias("verdict"), "alias_of")
