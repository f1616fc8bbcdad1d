"""WARC archives: written as records, read as a stream, assembled to one nested row for each capture.

Writing: every page gives a response (or revisit), a request and a metadata record, tied by WARC-Concurrent-To. Of rows with equal
payloads of at least `MIN_SHARED` bytes the one with the smallest page_id is the response, the others are revisits that refer to it. A record
ends with two line breaks, which is the line separator of Spark's text writer: the archives are ordinary gzip files of that writer,
committed and retried like any other output.

Reading: Spark's text reader cuts the archives at the same separator; pieces of one file arrive in order in one task, and
the parser takes header and block by Content-Length from the running bytes, so a payload may hold anything, separators
and whole WARC records included. Memory is bounded by the largest record. Uncompressed archives can be split by the reader and are
put in order by file and offset first.

Assembly: requests and metadata are gathered by the record that they are concurrent to (or that names them), then
joined to responses and revisits, which keep their payload. Revisits meet the response that they refer to.

Edge cases: a null html is an empty payload. A null url gives no WARC-Target-URI, line breaks in one are percent-encoded.
Null page_ids come last and have no page-id field; they read back as null. Rows that share payload and smallest page_id are all responses; repeated
rows give repeated captures. A last record that breaks off in its block is returned with complete = false, one that breaks off in its header is none. Empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from watchfold.llm.common import spread_join
from watchfold.llm.registry import query, table
from watchfold.session import Scratch, scratch_path

MIN_SHARED = 100
DATE = "2024-01-01T00:00:00Z"
BREAK, END = "\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FLUSH_BYTES = 8 << 20


def record_id(*parts: Column) -> Column:
    h = F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]), 256)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">"))


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    """Header lines (a null value leaves its line out), empty line, block; without the closing line breaks."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{name}: "), v, F.lit(BREAK))).otherwise("") for name, v in fields]
    return F.concat(F.lit("WARC/1.1" + BREAK), *lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def write_archives(pages: DataFrame, path: str) -> None:
    """Archives of `pages` (page_id, url, html) below `path`."""
    scratch = Scratch(pages.sparkSession, "warc")
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    uri = F.regexp_replace(F.regexp_replace(F.col("url").cast("string"), "\r", "%0D"), "\n", "%0A")
    rows = pages.select("page_id", uri.alias("uri"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    shared = rows.where(F.octet_length("payload") >= MIN_SHARED).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = scratch.table(shared.select(F.col("digest").alias("__digest"), "first_id"))  # broadcast when its files are below Spark's limit
    met = rows.join(firsts, F.col("digest") == F.col("__digest"), "left")
    revisit = F.coalesce(F.col("__digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False))
    own = record_id(F.col("page_id"), F.col("digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(END))
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    main = _record([("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", own), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", F.col("uri")),
                    ("WARC-Profile", F.when(revisit, PROFILE)), ("WARC-Refers-To", F.when(revisit, record_id(F.col("first_id"), F.col("digest")))),
                    ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http; msgtype=response"))],
                   F.when(revisit, http).otherwise(F.concat(http, "payload")))
    place = F.coalesce(F.nullif(F.regexp_extract("uri", "://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    asked = F.concat(F.lit("GET "), place, F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(F.regexp_extract("uri", "://([^/?#]*)", 1), F.lit("")), F.lit(END))
    request = _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", record_id(F.lit("request"), F.col("page_id"), F.col("digest"))), ("WARC-Date", F.lit(DATE)),
                       ("WARC-Target-URI", F.col("uri")), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http; msgtype=request"))], asked)
    noted = F.concat(F.when(F.col("page_id").isNotNull(), F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(BREAK))).otherwise(""), F.lit("fetched: 1\r\n"))
    metadata = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", record_id(F.lit("metadata"), F.col("page_id"), F.col("digest"))), ("WARC-Date", F.lit(DATE)),
                        ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))], noted)
    met.select(F.concat_ws(END, main, request, metadata).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


RECORD = ("record_type string, record_id string, concurrent_to array<string>, refers_to string, target_uri string, content_type string, fields map<string,string>, "
          "http string, payload binary, payload_bytes long, payload_digest string, complete boolean")
NAMES = [f.split()[0] for f in ("record_type record_id concurrent_to refers_to target_uri content_type fields http payload payload_bytes payload_digest complete").split()]
TYPES = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.binary(),
         pa.int64(), pa.string(), pa.bool_()]


def parse_record(header: bytes, block: bytes, complete: bool) -> list:
    lines = header.decode("utf-8", "replace").split(BREAK)[1:]
    pairs = [(name.strip().lower(), value.strip()) for name, found, value in (line.partition(":") for line in lines) if found]
    fields = dict(pairs)
    http = None
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(END.encode())
        http = head.decode("utf-8", "replace")
    return [fields.get("warc-type"), fields.get("warc-record-id"), [v for n, v in pairs if n == "warc-concurrent-to"], fields.get("warc-refers-to"), fields.get("warc-target-uri"),
            fields.get("content-type"), list(fields.items()), http, payload, len(payload), hashlib.sha256(payload).hexdigest(), complete]


def content_length(header: bytes) -> int | None:
    """The declared length; None if it is absent, no plain number, or declared twice with different numbers."""
    lines = (line.partition(b":") for line in header.split(b"\r\n"))
    found = {value.strip() for name, _, value in lines if name.strip().lower() == b"content-length"}
    return int(next(iter(found))) if len(found) == 1 and next(iter(found)).isdigit() else None


VERSION = b"WARC/1."
MARK = re.compile(rb"\nWARC/1\.")


class RecordStream:
    """Records from the bytes of one file, fed in any cuts. A record without a usable length is incomplete, its payload empty, and
    the stream goes on at the next line that begins a record."""

    def __init__(self):
        self.held, self.size, self.need, self.header, self.lost = [], 0, 0, None, False

    def feed(self, data: bytes):
        self.held.append(data)
        self.size += len(data)
        if self.header is not None and self.size < self.need:
            return
        buffer, at = b"".join(self.held), 0
        while True:
            if self.header is None:
                if self.lost:
                    begun = MARK.search(buffer, at)
                    if begun is None:
                        at = max(at, len(buffer) - len(VERSION) - 1)  # a mark may be cut here
                        break
                    at, self.lost = begun.end() - len(VERSION), False
                while buffer[at:at + 1] in (b"\r", b"\n"):
                    at += 1
                end = buffer.find(END.encode(), at)
                if end < 0:
                    break
                self.header, at = buffer[at:end], end + len(END)
                declared = content_length(self.header)
                if declared is None:
                    yield parse_record(self.header, b"", False)
                    self.header, self.lost, at = None, True, at - 1  # the line end before a mark may be the header's own
                    continue
                self.need = declared
            if len(buffer) - at < self.need:
                break
            yield parse_record(self.header, buffer[at:at + self.need], True)
            self.header, at = None, at + self.need
        self.held, self.size = [buffer[at:]], len(buffer) - at

    def close(self):
        rest = b"".join(self.held)
        if self.header is not None and len(rest.rstrip(b"\r\n")) <= self.need:
            yield parse_record(self.header, rest[:self.need], len(rest) >= self.need)


def _record_batches(batches):
    stream, file, rows, size = None, None, [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], NAMES)

    def taken(found):
        nonlocal rows, size
        for row in found:
            rows.append(row)
            size += row[9]
            if size > FLUSH_BYTES or len(rows) >= 4096:
                yield batch()
                rows, size = [], 0

    for pieces in batches:
        for value, name in zip(pieces.column(0), pieces.column(1).to_pylist()):
            if name != file:
                if stream:
                    yield from taken(stream.close())
                stream, file = RecordStream(), name
            yield from taken(stream.feed(value.as_py() + END.encode()))
    if stream:
        yield from taken(stream.close())
    if rows:
        yield batch()


def read_archives(spark: SparkSession, path: str, compressed: bool = True) -> DataFrame:
    """Records of the archives below `path`. compressed: gzip files, each of which one task reads in order."""
    pieces = spark.read.option("lineSep", END).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
                                                                 F.col("_metadata.file_block_start").alias("at"))
    if not compressed:
        pieces = pieces.withColumn("nth", F.monotonically_increasing_id()).repartition("file").sortWithinPartitions("file", "at", "nth")
    return pieces.select("value", "file").mapInArrow(_record_batches, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One row for each response, revisit and resource: its own columns, `request` (struct) and `metadata` (array of structs).

    A request or metadata record belongs to each record that its concurrent-to identifiers name, to those that name it, and
    a metadata record also to those of the request that it names. Of several requests the smallest record id is shown.
    """
    main = records.where(F.col("record_type").isin("response", "revisit", "resource"))
    part = F.struct("record_id", "target_uri", "fields", "http", "payload")
    side = records.where(F.col("record_type").isin("request", "metadata"))
    named = side.select(F.col("record_type").alias("kind"), "record_id", part.cast("struct<record_id:string,target_uri:string,fields:map<string,string>,http:string,payload:binary>").alias("part"),
                        F.explode("concurrent_to").alias("other"))
    naming = (main.select(F.col("record_id").alias("other"), F.explode("concurrent_to").alias("__id"))
              .join(side.select(F.col("record_type").alias("kind"), F.col("record_id").alias("__id"), part.alias("part")), "__id").select("kind", "part", "other"))
    through = (named.where("kind = 'metadata'").select("kind", "part", F.col("other").alias("__id"))
               .join(named.where("kind = 'request'").select(F.col("record_id").alias("__id"), "other"), "__id").select("kind", "part", "other"))
    flat = lambda p: F.struct(p["record_id"].alias("record_id"), p["target_uri"].alias("target_uri"), F.map_entries(p["fields"]).alias("fields"), p["http"].alias("http"), p["payload"].alias("payload"))
    every = named.select("kind", "part", "other").unionByName(naming).unionByName(through).select("kind", "other", flat(F.col("part")).alias("part"))
    request = F.min(F.when(F.col("kind") == "request", F.col("part")))
    metadata = F.array_sort(F.collect_set(F.when(F.col("kind") == "metadata", F.col("part"))))
    sides = every.groupBy(F.col("other").alias("__main")).agg(request.alias("request"), metadata.alias("metadata"))
    return main.join(sides, F.col("record_id") == F.col("__main"), "left").drop("__main")


def resolved(found: DataFrame) -> DataFrame:
    """`found` (captures) with full_bytes, full_digest and refers_to_page: of revisits those of the response that they refer to.

    A revisit whose response is not in the archives keeps what its own headers say, and refers_to_page is null.
    """
    scratch = Scratch(found.sparkSession, "captures")
    page = F.regexp_extract(F.decode(F.get("metadata", F.lit(0))["payload"], "UTF-8"), "(?m)^page-id: (-?[0-9]+)", 1)
    rows = scratch.table(found.withColumn("page_id", F.nullif(page, F.lit("")).cast("long")))
    refers = F.coalesce((F.col("record_type") == "revisit") & F.col("refers_to").isNotNull(), F.lit(False))
    own = rows.where(~refers).select("*", F.col("payload_bytes").alias("full_bytes"), F.col("payload_digest").alias("full_digest"), F.lit(None).cast("long").alias("refers_to_page"))
    revisits = rows.where(refers)
    counts, (total,) = scratch.table(revisits.groupBy("refers_to").agg(F.count(F.lit(1)).alias("n")), F.sum("n"))
    responses = (rows.where(~refers).groupBy("record_id")
                 .agg(F.first("payload_bytes").alias("r_bytes"), F.first("payload_digest").alias("r_digest"), F.first("page_id").alias("refers_to_page")))
    side = scratch.table(counts.join(responses, F.col("refers_to") == F.col("record_id"), "left").drop("record_id"))
    met = spread_join(revisits, side, "refers_to", "n", total or 0, ["r_bytes", "r_digest", "refers_to_page"])
    said_bytes = F.expr("try_cast(regexp_extract(http, '(?i)content-length: *([0-9]+)', 1) AS long)")
    said_digest = F.regexp_extract(F.element_at("fields", "warc-payload-digest"), "^sha256:([0-9a-f]{64})$", 1)
    filled = met.select(*[F.col(c) for c in rows.columns], F.coalesce("r_bytes", said_bytes, "payload_bytes").alias("full_bytes"),
                        F.coalesce("r_digest", F.nullif(said_digest, F.lit("")), "payload_digest").alias("full_digest"), "refers_to_page")
    return own.unionByName(filled)


@query("op3_warc", f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= {MIN_SHARED} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM f""")
def op3_warc(spark, sf_dir):
    path = scratch_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    records = read_archives(spark, path)
    # the payloads of responses have been measured by the reader and are not needed further on
    light = Scratch(spark, "records").table(records.withColumn("payload", F.when(F.col("record_type").isin("request", "metadata"), F.col("payload"))))
    found = resolved(captures(light))
    return found.select("page_id", F.col("full_bytes").alias("payload_bytes"), F.col("full_digest").alias("payload_digest"), "record_type", F.col("refers_to_page").alias("refers_to"))
