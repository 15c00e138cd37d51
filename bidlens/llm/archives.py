"""Web archives: legacy ARC records to WARC records, WARC files written and read by Spark.

ARC headers are one line; the version block at the head of a file says which fields it has:

    version 1:  URL IP date content-type length
    version 2:  URL IP date content-type result-code checksum location offset filename length

The last field is the length of what follows. The converter goes by declared lengths, never by searching for a
separator, so a payload may hold whatever looks like one.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlens.llm.tables import written
from bidlens.session import prepare, scratch

#: Payloads of fewer bytes are stored with each page.
MIN_REVISIT_BYTES = 1000
#: Records in one archive file.
RECORDS_PER_FILE = 1000
#: Larger pages have archives of their own, of so many bytes of pages at most (or one page), as a file is read whole.
LARGE_PAGE, FILE_BYTES = 250_000, 250_000_000
#: Revisits are broadcast up to this many (about 70 bytes each), and joined by a shuffle beyond it.
BROADCAST_REVISITS = 200_000
FETCHED = "20240101000000"
END = "\r\n\r\n"

#: Field names of the two versions of ARC header lines.
ARC_FIELDS = {
    "1": ("url", "ip", "date", "type", "length"),
    "2": ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"),
}


def arc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an ARC file: header fields and body. A file that ends within a record gives what there is of it.

    The first record, ``filedesc://``, tells the version; without one, the number of fields does.
    """
    at, version = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        values = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        names = ARC_FIELDS[version if version and len(values) == len(ARC_FIELDS[version]) else "2" if len(values) == len(ARC_FIELDS["2"]) else "1"]
        if len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"not an ARC header line at byte {at}")
        header = dict(zip(names, values, strict=True))
        body = data[end + 1 : end + 1 + int(header["length"])]
        at = end + 1 + int(header["length"])
        if header["url"].startswith("filedesc://"):
            version = body.split(b" ", 1)[0].decode("ascii", "replace").strip()
            version = version if version in ARC_FIELDS else None
            continue
        yield header, body


def _timestamp(date: str) -> str:
    """14 digits (or 12, or 8) of an ARC date as WARC's form; the epoch if it isn't a date."""
    digits = date[:14].ljust(14, "0") if date[:8].isdigit() else "19700101000000"
    try:
        return datetime.strptime(digits, "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def payload_of(header: dict[str, str], body: bytes) -> tuple[bytes, bytes]:
    """HTTP header block (empty if there is none) and payload."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    head, found, payload = body.partition(b"\r\n\r\n")
    return (head + found, payload) if found else (body, b"")


def record_id(key: str) -> str:
    """A urn:uuid that only depends on ``key``."""
    h = hashlib.sha256(key.encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-8{h[13:16]}-a{h[17:20]}-{h[20:32]}>"


def sha1_label(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(header: dict[str, str], body: bytes, key: str, refers_to: str | None = None) -> bytes:
    """The WARC record of an ARC record, without the end mark.

    An HTTP reply becomes a response, or a revisit with the reply's header alone if ``refers_to`` names the key of the
    record that has the same payload; what isn't an HTTP reply becomes a resource.
    """
    head, payload = payload_of(header, body)
    block = head if refers_to is not None and head else body
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if block is head and refers_to is not None else 'response' if head else 'resource'}",
        f"WARC-Record-ID: {record_id(key)}",
        f"WARC-Date: {_timestamp(header['date'])}",
        f"WARC-Target-URI: {header['url']}",
        f"WARC-IP-Address: {header['ip']}",
        f"WARC-Payload-Digest: {sha1_label(payload)}",
        f"X-Record-Key: {key}",
    ]
    if refers_to is not None and head:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Key: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    kind = "application/http;msgtype=response" if head else header["type"] or "application/octet-stream"
    lines += [f"Content-Type: {kind}", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + END).encode() + block


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a WARC file, gzipped or not: header fields by lower-case name, and block."""
    parts = []
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        parts.append(z.decompress(data) + z.flush())
        data = z.unused_data
    data = b"".join([*parts, data]) if parts else data
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"not a WARC record at byte {at}")
        fields = (x.partition(":") for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])
        header = {k.strip().lower(): v.strip() for k, _, v in fields}
        n = int(header["content-length"])
        yield header, data[end + 4 : end + 4 + n]
        at = end + 4 + n
        while data[at : at + 2] == b"\r\n":
            at += 2


def arc_text(url: Column, body: Column, version: Column) -> Column:
    """A one-record ARC file as text, with its version block: what a legacy crawler would have left of a page."""
    tidy = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\s\p{Cntrl}]", "%20")
    url = F.when(tidy == "", F.lit("about:blank")).otherwise(tidy)
    length = F.octet_length(body).cast("string")
    fields = F.when(version == "1", F.lit("URL IP-address Archive-date Content-type Archive-length")).otherwise(
        F.lit("URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length")
    )
    about = F.concat(version, F.lit(" 0 Legacy\n"), fields, F.lit("\n"))
    size = F.octet_length(about).cast("string")
    start = F.when(version == "1", F.concat(F.lit(f"filedesc://pages.arc 0.0.0.0 {FETCHED} text/plain "), size)).otherwise(
        F.concat(F.lit(f"filedesc://pages.arc 0.0.0.0 {FETCHED} text/plain 200 - - 0 pages.arc "), size)
    )
    line = F.when(version == "1", F.concat(url, F.lit(f" 0.0.0.0 {FETCHED} text/html "), length)).otherwise(
        F.concat(url, F.lit(f" 0.0.0.0 {FETCHED} text/html 200 - - 0 pages.arc "), length)
    )
    return F.concat(start, F.lit("\n"), about, F.lit("\n"), line, F.lit("\n"), body, F.lit("\n"))


def http_reply(html: Column) -> Column:
    """The page as an HTTP reply."""
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit(END), html)


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = zip(*(batch.column(c).to_pylist() for c in ("key", "refers_to", "arc")), strict=True)
        out = [warc_record(h, b, key if not k else f"{key}.{k}", refers_to) for key, refers_to, arc in columns for k, (h, b) in enumerate(arc_records(arc.encode() if isinstance(arc, str) else arc))]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def convert(arcs: DataFrame) -> DataFrame:
    """ARC files (key, refers_to, arc) to WARC records in a column ``value``, as :func:`write` wants them.

    A null ``refers_to`` is a record of its own; a null key is an error, as nothing would name the record. Repeated rows give
    repeated records; an archive is converted within its row, whole, however long. No rows give none.
    """
    prepare(arcs.sparkSession)
    return arcs.select("key", "refers_to", "arc").mapInArrow(_convert, "value binary")


def write(records: DataFrame, path: str, per_file: int = RECORDS_PER_FILE) -> None:
    """Gzipped WARC files below ``path``, of at most ``per_file`` records.

    A cast makes text of the bytes without changing them, whatever their encoding. Records are written as they come, repeated
    ones too; a null record is an empty line. No records give a folder without archives.
    Spark's text writer ends each row with the two line ends that end a WARC record, and commits files whole, so a
    lost executor leaves no half archives.
    """
    records.select(F.col("value").cast("string")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("content").to_pylist():
            rows = []
            for header, block in warc_records(data):
                head, payload = payload_of({}, block)
                length = len(payload)
                if header["warc-type"] == "revisit":
                    length = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                digest = base64.b32decode(header["warc-payload-digest"].partition(":")[2]).hex()
                if header["warc-type"] != "revisit" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"the payload of {header['warc-record-id']} differs from its digest")
                rows.append((header["x-record-key"], header["warc-type"], header["warc-record-id"], header["warc-date"], header["warc-target-uri"], length, digest, header.get("x-refers-to-key"), header.get("warc-refers-to")))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 9
            types = [pa.string()] * 5 + [pa.int64()] + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], READ_COLUMNS)


READ_COLUMNS = ["key", "record_type", "record_id", "date", "url", "payload_bytes", "payload_digest", "refers_to_key", "refers_to_id"]


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the WARC files below ``path``, in any folder; payloads are held against their digests.

    Records of one key come as often as they are written; one without a key or with another payload than its digest says is
    an error. A record is read whole, one at a time. A folder without archives gives no rows.
    """
    prepare(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content")
    schema = ", ".join(f"{c} {'bigint' if c == 'payload_bytes' else 'string'}" for c in READ_COLUMNS)
    return files.mapInArrow(_parse, schema)


def archive_pages(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write a WARC record for each page below ``path``, through legacy ARC records of both versions.

    Of pages with equal payloads of at least ``min_bytes``, the one with the largest id is stored, the others revisit it;
    which one is found from digests alone. Repeated rows give repeated records, and those of the largest id are all
    responses. A null page is an empty payload, a null url ``about:blank``; a null id is written as an empty key and
    never revisits nor is revisited.
    """
    prepare(pages.sparkSession)
    base = pages.select(F.col(page_id).cast("string").alias("id"), F.col(page_id).alias("n"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    size = F.octet_length("html")
    base = base.withColumn("digest", F.when((size >= min_bytes) & F.col("n").isNotNull(), F.sha1(F.encode("html", "UTF-8"))))
    known = written(base.where("digest is not null").select("n", "digest"), "digests")
    groups = known.groupBy("digest").agg(F.max("n").alias("stored"), F.min("n").alias("least")).where("least < stored")
    # by page, not by digest: a page of which there are many copies is no burden, and pages don't move while the revisits are few
    revisits = written(known.join(groups, "digest").where("n <> stored").select(F.col("n").alias("of"), F.col("digest").alias("same"), "stored").distinct(), "revisits")
    few = revisits.count() <= BROADCAST_REVISITS
    both = base.join(F.broadcast(revisits) if few else revisits, (F.col("n") == F.col("of")) & (F.col("digest") == F.col("same")), "left")
    version = F.when(F.crc32(F.coalesce("id", F.lit(""))) % 2 == 0, F.lit("1")).otherwise(F.lit("2"))

    def store(rows: DataFrame, folder: str, per_file: int) -> None:
        arcs = rows.select(F.coalesce("id", F.lit("")).alias("key"), F.col("stored").cast("string").alias("refers_to"), arc_text(F.col("url"), http_reply(F.col("html")), version).alias("arc"))
        write(convert(arcs), folder, per_file)

    largest = base.where(size > LARGE_PAGE).agg(F.max(size)).first()[0]
    store(both.where(size <= LARGE_PAGE), f"{path}/pages", RECORDS_PER_FILE)
    if largest:
        store(both.where(size > LARGE_PAGE), f"{path}/large-pages", max(1, FILE_BYTES // largest))


def op7_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    number = lambda c: F.when(F.col(c) != "", F.col(c)).cast("long")
    return read(spark, path).select(number("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to_key").alias("refers_to"), "record_id", "date")


OP7_SQL = """
WITH base AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
hashed AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM base),
stored AS (SELECT payload_digest, max(page_id) AS stored FROM hashed WHERE payload_bytes >= 1000 GROUP BY 1),
ids AS (SELECT h.*, CASE WHEN stored <> page_id THEN stored END AS refers_to, sha256(page_id::VARCHAR) AS h FROM hashed h LEFT JOIN stored USING (payload_digest))
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       refers_to::BIGINT AS refers_to,
       '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-8' || h[14:16] || '-a' || h[18:20] || '-' || h[21:32] || '>' AS record_id,
       '2024-01-01T00:00:00Z' AS date
FROM ids
"""
