"""WARC archives: writing captures, reading records, and assembling transactions.

A capture is a request, a response (or a revisit of an equal payload) and a metadata record; the request and the
metadata name the response in WARC-Concurrent-To. ``assemble`` joins them by these identifiers into one nested row.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = (
    "record_type string, record_id string, concurrent_to string, target_uri string, warc_date string, content_type string, "
    "payload_digest string, refers_to_uri string, http_header string, payload binary"
)
_NAMES = [c.strip().split(" ")[0] for c in _RECORD.split(",")]
_READ = 1 << 20
_FLUSH = 16 << 20


def with_revisits(pages: DataFrame, *, page_id: str = "page_id", payload: str = "html", url: str = "url", least_bytes: int = 1000) -> DataFrame:
    """page_id, url, body (null: empty), body_bytes, sha1, refers_to, refers_to_uri.

    Of rows with equal bodies of at least ``least_bytes``, that with the largest page_id is the response and the
    others refer to it. Rows that repeat the largest page_id are responses too, as are rows without a page_id.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("body"))
    raw = F.col("body").cast("binary")
    rows = rows.withColumns({"body_bytes": F.octet_length("body").cast("long"), "sha1": F.sha1(raw), "same": F.sha2(raw, 256)})
    shared = (
        rows.where(F.col("body_bytes") >= least_bytes)
        .groupBy("same")
        .agg(F.max("page_id").alias("first_id"), F.max_by("url", "page_id").alias("first_uri"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and first_id is not null")
        .select(F.col("same").alias("same_as"), "first_id", "first_uri")
    )
    joined = rows.join(shared, F.col("same") == F.col("same_as"), "left")
    other = F.col("page_id") < F.col("first_id")
    return joined.select("page_id", "url", "body", "body_bytes", "sha1", F.when(other, F.col("first_id")).alias("refers_to"), F.when(other, _uri(F.col("first_uri"), F.col("first_id"))).alias("refers_to_uri"))


def _uri(url: Column, page_id: Column) -> Column:
    """The url with control characters and blanks escaped, as one header line; a page without one gets a urn."""
    line = F.regexp_replace(url, r"[\x00-\x20\x7f]", "%20")
    return F.when(F.length(line) > 0, line).otherwise(F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none"))))


def _record(kind: str | Column, record_id: Column, uri: Column, date: str, content_type: str, block: Column, *more: Column) -> Column:
    head = [F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind), F.concat(F.lit("WARC-Target-URI: "), uri), F.lit(f"WARC-Date: {date}")]
    head += [F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"Content-Type: {content_type}"), *more, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *head), F.lit("\r\n\r\n"), block)


def write_captures(pages: DataFrame, path: str, *, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 30000) -> None:
    """Write request, response or revisit, and metadata records of rows of ``with_revisits`` as gzipped archives.

    Spark's text writer puts the two line ends that close a record after each, and its commit protocol leaves no
    half-written archive; the folder can be in any store Spark writes to. Rows that repeat get captures of their own.
    """
    number = F.md5(F.concat_ws("|", "page_id", "sha1", F.monotonically_increasing_id().cast("string")).cast("binary"))
    rows = pages.withColumn("capture", number)

    def name(kind: str) -> Column:
        h = F.md5(F.concat(F.lit(kind), F.col("capture")).cast("binary"))
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))

    uri = _uri(F.col("url"), F.col("page_id"))
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), name("response"))
    revisit = F.col("refers_to").isNotNull()
    sent = F.concat(F.lit("GET / HTTP/1.1\r\nX-Target: "), uri, F.lit("\r\n\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("body_bytes").cast("string"), F.lit("\r\n\r\n"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1"))
    refers = F.when(revisit, F.concat(F.lit(f"WARC-Profile: {_REVISIT}\r\nWARC-Refers-To-Target-URI: "), F.col("refers_to_uri"), F.lit(f"\r\nWARC-Refers-To-Date: {date}")))
    fields = F.concat_ws(
        "\r\n",
        F.concat(F.lit("page-id: "), F.col("page_id").cast("string")),
        F.concat(F.lit("payload-bytes: "), F.col("body_bytes").cast("string")),
        F.concat(F.lit("refers-to-page: "), F.col("refers_to").cast("string")),
        F.lit("fetched: complete"),
    )
    records = F.array(
        _record("request", name("request"), uri, date, "application/http; msgtype=request", sent, concurrent),
        _record(F.when(revisit, "revisit").otherwise("response"), name("response"), uri, date, "application/http; msgtype=response", F.when(revisit, http).otherwise(F.concat(http, F.col("body"))), digest, refers),
        _record("metadata", name("metadata"), uri, date, "application/warc-fields", fields, concurrent),
    )
    text = rows.select(F.explode(records).alias("value"))
    text.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _inflated(content: bytes):
    """The archive's bytes in pieces: plain, or gzip of one or many members."""
    if content[:2] != b"\x1f\x8b":
        for low in range(0, len(content), _READ):
            yield content[low : low + _READ]
        return
    view, at = memoryview(content), 0
    while at < len(content):
        member = zlib.decompressobj(wbits=31)
        while at < len(content) and not member.eof:
            piece = view[at : at + _READ]
            out = member.decompress(piece)
            at += len(piece) - len(member.unused_data)
            if out:
                yield out
        if not member.eof:
            raise ValueError("truncated gzip member")


def parse_records(content: bytes, kinds: frozenset[str] | None = None):
    """Tuples in the order of the record columns, for the records of these kinds (all, if none are named)."""
    pieces, held = _inflated(content), bytearray()

    def need(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        while need(2) and held[:2] == b"\r\n":
            del held[:2]
        if not need(5):
            if bytes(held).strip():
                raise ValueError("truncated record")
            return
        if held[:5] != b"WARC/":
            raise ValueError("not a WARC record")
        end, seen = held.find(b"\r\n\r\n"), 0
        while end < 0:
            seen = max(0, len(held) - 3)
            if not need(len(held) + 1):
                raise ValueError("truncated header")
            end = held.find(b"\r\n\r\n", seen)
        head: dict[str, str] = {}
        for line in bytes(held[:end]).decode("utf-8", "replace").split("\r\n")[1:]:
            key, _, value = line.partition(":")
            head.setdefault(key.strip().lower(), value.strip())
        length = int(head["content-length"])
        if not need(end + 4 + length):
            raise ValueError("truncated block")
        kind = head.get("warc-type", "")
        if kinds is None or kind in kinds:
            block = bytes(held[end + 4 : end + 4 + length])
            http = None
            if head.get("content-type", "").startswith("application/http"):
                first, mark, rest = block.partition(b"\r\n\r\n")
                http, block = first.decode("utf-8", "replace"), rest if mark else b""
            yield (kind, *(head.get(k) for k in ("warc-record-id", "warc-concurrent-to", "warc-target-uri", "warc-date", "content-type", "warc-payload-digest", "warc-refers-to-target-uri")), http, block)
        del held[: end + 4 + length]


@F.pandas_udf(T.BinaryType())
def _inflate(packed: pd.Series) -> pd.Series:
    return packed.map(lambda x: None if x is None else zlib.decompress(x))


def read_records(spark: SparkSession, path: str, kinds: tuple[str, ...] = (), *, packed: bool = False) -> DataFrame:
    """One row per record of the archives in a folder; damaged archives raise an error.

    ``packed`` leaves payloads deflated, for a shuffle.
    """
    wanted = frozenset(kinds) or None

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                rows, size = [], 0
                for row in parse_records(content, wanted):
                    row = (*row[:-1], zlib.compress(row[-1], 1)) if packed else row
                    rows.append(row)
                    size += len(row[-1]) + 500
                    if size > _FLUSH:
                        yield pd.DataFrame(rows, columns=_NAMES)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=_NAMES)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, _RECORD)


def assemble(spark: SparkSession, path: str) -> DataFrame:
    """One row per capture: capture_id, response (null if missing), requests and metadata (arrays, by record id)."""
    response = read_records(spark, path, ("response", "revisit"), packed=True).select(F.col("record_id"), F.struct("record_type", "target_uri", "warc_date", "payload_digest", "refers_to_uri", "http_header", "payload").alias("response"))
    side = read_records(spark, path, ("request", "metadata")).groupBy("concurrent_to").agg(F.array_sort(F.collect_list(F.struct("record_id", "record_type", "target_uri", "http_header", F.col("payload").cast("string").alias("fields")))).alias("parts"))
    joined = response.join(side, F.col("record_id") == F.col("concurrent_to"), "full")
    return joined.select(
        F.coalesce("record_id", "concurrent_to").alias("capture_id"),
        F.when(F.col("record_id").isNotNull(), F.col("response").withField("payload", _inflate(F.col("response.payload")))).alias("response"),
        F.filter("parts", lambda x: x["record_type"] == "request").alias("requests"),
        F.filter("parts", lambda x: x["record_type"] == "metadata").alias("metadata"),
    )


def digest(captures: DataFrame) -> DataFrame:
    """The reported columns: sizes and digests of responses from their payload, of revisits from their records."""
    fields = F.element_at("metadata", 1)["fields"]

    def field(name: str) -> Column:
        return F.nullif(F.regexp_extract(fields, rf"(?m)^{name}: (-?\d+)\r?$", 1), F.lit("")).cast("long")

    kind, payload = F.col("response.record_type"), F.col("response.payload")
    revisit = kind == "revisit"
    return captures.select(
        field("page-id").alias("page_id"),
        F.when(revisit, field("payload-bytes")).otherwise(F.octet_length(payload).cast("long")).alias("payload_bytes"),
        F.when(revisit, F.substring_index("response.payload_digest", ":", -1)).otherwise(F.sha1(payload)).alias("payload_digest"),
        kind.alias("record_type"),
        field("refers-to-page").alias("refers_to"),
    )
