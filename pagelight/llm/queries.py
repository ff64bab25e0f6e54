"""The registered queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelight.llm import ann, bpe, decontam, licenses, merkle, records, secrets, sharding, simhash, sql, toxicity, urls, variants, warc
from pagelight.llm.common import table


def op1_sharding(spark, sf_dir):
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def op2_decontamination(spark, sf_dir):
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_warc(spark, sf_dir):
    found = warc.archived(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_ts")


def op4_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op5_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op7_secrets(spark, sf_dir):
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


def op8_urls(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"))


def op9_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"))


def op10_ann(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, F.col("vec_id") % 100 == 0)


def op11_merkle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = merkle.checked(merkle.manifest(docs, changed={"text": tampered}))
    hexed = [F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root", "folded_root")]
    return found.select(F.col("id").alias("doc_id"), "source", "pos", *hexed, "proof_sha256", "verified")


def op12_variants(spark, sf_dir):
    return variants.variants(table(spark, sf_dir, "documents"))


def op13_records(spark, sf_dir):
    return records.round_trip(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


_ALL = (op1_sharding, op2_decontamination, op3_warc, op4_simhash, op5_licenses, op6_toxicity, op7_secrets, op8_urls, op9_bpe, op10_ann, op11_merkle, op12_variants, op13_records)
QUERIES = {f.__name__: f for f in _ALL}

_WARC_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, sha1(html) AS hexed, max(page_id) OVER (PARTITION BY sha1(html)) AS top FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(hexed, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to,
  array_to_string(list_reverse(string_split(lower(regexp_extract(url, '^[^:]*://([^/?#]*)', 1)), '.')), ',') || ')' || regexp_replace(regexp_replace(url, '#.*$', ''), '^[^:]*://[^/?#]*', '') AS url_key,
  strftime(make_timestamp((1704067200 + page_id % 31536000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS capture_ts
FROM d
"""

_URL_SQL = """
WITH u AS (SELECT page_id, url, coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '') AS h, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
p AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
r AS (SELECT * FROM (VALUES %s) AS t(kind, rh, rp)),
f AS (SELECT p.*, kind, rh || rp AS rule, length(rh || rp) AS n FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC NULLS LAST, kind) AS k FROM f)
SELECT page_id, host, path, rule, coalesce(kind, 'allow') AS verdict, NULL::VARCHAR AS alias_of FROM b WHERE k = 1
""" % ", ".join(f"('{k}', '{h}', '{p}')" for k, h, p in urls.RULES)

#: Searches by exact SQL are given only where the operator's result is exact. op8's SQL has the rules alone: pages hold no redirects
#: or canonical links in these tables; tests compare aliases with brute force.
ORACLE_SQL = {"op1_sharding": sql.sharding(sharding.SLOTS, sharding.SHARDS), "op3_warc": _WARC_SQL, "op8_urls": _URL_SQL, "op11_merkle": sql.merkle(), "op12_variants": sql.variants()}
