"""Web archives: writing and reading records, and a sorted capture index by external merge.

Writing. Records go through Spark's own text writer, so they reach any store: a row is a record's
header and payload, and the line separator is the two line ends that close a record. Of captures
with equal payloads the one with the largest id is stored as a response, the others are revisits
that name it. Payloads are grouped by digest with map-side combining, never gathered or joined. Archives are bounded in
records and in bytes.

Reading. Whole archives are parsed by their Content-Length, so a payload may hold anything.

Index. Each archive is a capture run, sorted by URL key and timestamp where it is read. Runs are cut at common
range boundaries, about ``RANGE_ROWS`` records each, so a range's slices of all runs fit a task; they are merged through a loser tree. Ranges follow
one another, so the result is globally ordered. A URL with very many captures is cut by
timestamp and id, so that no key must fit one task.

A null html is an empty payload, a null URL an empty one (its key is empty). A null id sorts below all others and
is a revisit where another id has that payload. Repeated rows with the largest id are all responses.
A very long html is a record of its own size. Other columns are ignored; an empty table gives no record and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelight.llm import bitsets
from pagelight.llm.common import materialize, scratch_path

#: Records and, about, bytes of an archive at most; what stands for a null id; rows of a range of the index, about.
ROWS_PER_FILE, FILE_BYTES, NO_ID, RANGE_ROWS = 2000, 128 << 20, -(1 << 63), 50_000
_END = "\r\n\r\n"
_FIELDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, capture_ts string, archive string, offset long, length long"


def _base32(hexed):
    """Bare upper-case base32 of a 160-bit hex string, as an expression: five hex digits make four characters."""
    table = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return F.expr(
        f"""array_join(flatten(transform(sequence(0, 7), g -> transform(array(15, 10, 5, 0), b ->
        substring('{table}', cast((shiftright(cast(conv(substring({hexed}, g * 5 + 1, 5), 16, 10) as int), b) & 31) + 1 as int), 1)))), '')"""
    )


def capture_rows(pages: DataFrame, min_payload: int = 0) -> tuple[DataFrame, DataFrame]:
    """(responses, revisits) of pages, as (page_id, url, n, digest, record_type, refers_to, capture_ts, and html of responses).

    Which captures are revisits is decided without payloads, and revisits are written without any. Responses are told from
    revisits by bit sets where they are read (`bitsets`), so payloads aren't joined but for a few that the sets leave open."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    base = base.withColumn("hexed", F.sha1(F.col("html").cast("binary"))).withColumn("n", F.octet_length("html").cast("long"))
    base = base.withColumn("id", F.coalesce(F.col("page_id"), F.lit(NO_ID)))  # a null id is below all others
    known = materialize(base.select("page_id", "id", "url", "hexed", "n"), "warc-known")
    stored = materialize(known.where(F.col("n") >= min_payload).groupBy("hexed").agg(F.max("id").alias("top"), F.count("*").alias("copies")).where("copies > 1").select("hexed", "top"), "warc-stored")
    again = materialize(known.where(F.col("n") >= min_payload).join(stored, "hexed").where("id <> top"), "warc-revisits")
    stays = again.select("hexed", "top").distinct().select(F.col("top").alias("id"), "hexed", F.lit(True).alias("kept"))
    decided = again.select("id", "hexed").distinct().select("id", "hexed", F.lit(False).alias("kept")).unionByName(stays)
    alone = known.join(stored.select("hexed"), "hexed", "left_anti").select("id", "hexed").distinct().select("id", "hexed", F.lit(True).alias("kept"))
    sure, asked = bitsets.settle(base, ["id", "hexed"], decided.unionByName(alone))
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(31_536_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fields = ["page_id", "url", "n", _base32("hexed").alias("digest"), stamp.alias("capture_ts")]
    kept = sure.unionByName(asked).select(*fields, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "html")
    return kept, again.select(*fields, F.lit("revisit").alias("record_type"), F.when(F.col("top") != NO_ID, F.col("top")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, min_payload: int = 0, rows_per_file: int = ROWS_PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """One archive per part file under path; every row a record. An archive has at most rows_per_file records and, but for a record
    that is larger by itself, about file_bytes: larger payloads are written by size, each power of two with fewer to a file."""
    c = F.col
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    safe = F.regexp_replace("url", r"[\r\n]", " ")

    def record(body):
        head = F.concat(
            F.lit("WARC/1.1\r\n"), line("WARC-Type", c("record_type")), F.coalesce(line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), c("page_id").cast("string"), F.lit(">"))), F.lit("")),
            line("WARC-Target-URI", safe), line("WARC-Date", c("capture_ts")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), c("digest"))), line("X-Payload-Length", c("n").cast("string")),
            F.coalesce(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), c("refers_to").cast("string"), F.lit(">"))), F.lit("")),
            F.lit("Content-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"),
        )
        return F.concat(head, body).alias("value")

    def write(rows: DataFrame, name: str, most: int) -> None:
        rows.write.option("lineSep", _END).option("maxRecordsPerFile", most).text(f"{path}/{name}")

    responses, revisits = capture_rows(pages, min_payload)
    small = file_bytes // rows_per_file
    steps = F.greatest(F.lit(0), F.ceil(F.log2(c("n").cast("double") / small))).cast("int")
    sizes = [r["s"] for r in responses.select(F.when(c("n") <= small, 0).otherwise(steps).alias("s")).distinct().collect()]  # 32 at most
    for s in sorted(sizes) or [0]:
        own = (c("n") <= small) if s == 0 else (c("n") > small) & (steps == s)
        write(responses.where(own).select(record(c("html"))), f"responses-{s}", max(1, rows_per_file >> s))
    write(revisits.select(record(F.lit(""))), "revisits", rows_per_file)


def parse(data: bytes, archive: str) -> Iterator[tuple]:
    """The records of one archive as _FIELDS; a response's length and digest are taken from its payload."""
    at, number = 0, re.compile(r"urn:page:(-?\d+)")
    while at < len(data):
        cut = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:cut].decode().split("\r\n")[1:])
        size = int(head["Content-Length"])
        payload = memoryview(data)[cut + 4 : cut + 4 + size]
        end = cut + 4 + size + 4
        if data[end - 4 : end] != b"\r\n\r\n":
            raise ValueError(f"{archive}: a record at {at} does not end where it should")
        digest, n = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
        if head["WARC-Type"] == "response":
            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if (found, size) != (digest, n):
                raise ValueError(f"{archive}: the payload at {at} is not what its header says")
        ids = [int(m[1]) if (m := number.search(head.get(k, ""))) else None for k in ("WARC-Record-ID", "WARC-Refers-To")]
        yield ids[0], head["WARC-Target-URI"], n, digest, head["WARC-Type"], ids[1], head["WARC-Date"], archive, at, end - at
        at = end


def _key_text(url: str) -> str:
    """`url_key` of one URL."""
    bare = url.split("#", 1)[0]
    m = re.match(r"(?s)[^:]*://([^/?#]*)(.*)", bare)
    return ",".join(reversed(m[1].lower().split("."))) + ")" + m[2] if m and m[1] else bare


def _rank(r: tuple) -> tuple:
    return _key_text(r[1]).encode(), r[6], r[0] is not None, r[0] or 0, r[8]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record, with its archive, offset and length; payloads are verified, not returned."""
    names = [f.split()[0] for f in _FIELDS.split(", ")]

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0), b.column(1)):
                rows = sorted(parse(content.as_py(), name.as_py()), key=_rank)  # a run of the index
                if rows:
                    columns = list(zip(*rows))
                    kinds = [pa.int64() if k.endswith("long") else pa.string() for k in _FIELDS.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]*/[^/]*)$", 1).alias("path"), "content").mapInArrow(run, _FIELDS)


# --- the index ----------------------------------------------------------------------------------


def url_key(url):
    """host labels in reverse, then the rest: com,example,www)/path?query."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"(?s)^[^:]*://([^/?#]*)", 1))
    rest = F.regexp_replace(bare, r"(?s)^[^:]*://[^/?#]*", "")
    return F.when(host == "", bare).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


class LoserTree:
    """Merges sorted runs; each step replays one path of matches, log2 of the runs."""

    def __init__(self, runs: list) -> None:
        self.runs = [iter(r) for r in runs]
        self.k = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.loser = [-1] * max(self.k, 1)
        self.best = self._build(1) if self.k else -1

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._less(a, b) else (b, a)
        self.loser[node] = lose
        return win

    def __iter__(self):
        while self.k and (head := self.heads[self.best]) is not None:
            yield head
            at = self.best
            self.heads[at] = next(self.runs[at], None)
            node = (at + self.k) // 2
            while node:
                if self._less(self.loser[node], at):
                    self.loser[node], at = at, self.loser[node]
                node //= 2
            self.best = at


def merged_index(records: DataFrame, partitions: int | None = None) -> DataFrame:
    """records in global order of (url_key, capture_ts, page_id), with url_key and range_no, range by range."""
    spark = records.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-records.count() // RANGE_ROWS))
    keyed = records.withColumn("url_key", url_key(F.col("url")))
    ranged = keyed.repartitionByRange(n, "url_key", "capture_ts", "page_id", "archive", "offset").sortWithinPartitions("archive", "url_key", "capture_ts", F.asc_nulls_first("page_id"), "offset")
    ranged = ranged.withColumn("range_no", F.spark_partition_id())
    keys = [ranged.columns.index(c) for c in ("archive", "url_key", "capture_ts", "page_id", "offset")]

    def run(batches):
        t = pa.Table.from_batches(list(batches))
        if not t.num_rows:
            return
        t = t.combine_chunks()
        archive, key, ts, ids, offset = (t.column(k).to_pylist() for k in keys)
        starts = [i for i in range(len(archive)) if not i or archive[i] != archive[i - 1]] + [len(archive)]
        rank = lambda i: (key[i].encode(), ts[i], ids[i] is not None, ids[i] or 0, archive[i], offset[i], i)
        order = [x[-1] for x in LoserTree([map(rank, range(a, b)) for a, b in zip(starts, starts[1:])])]
        yield from t.take(pa.array(order, pa.int64())).to_batches(10_000)

    return ranged.mapInArrow(run, ranged.schema)


def archived(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """pages written as archives in the shared folder, read back, and indexed in global order."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, min_payload)
    return merged_index(materialize(read_archives(spark, path), "warc-records"))
