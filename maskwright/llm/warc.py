"""Web archives: revisits resolved by payload digest, deduplicated archives written and read."""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import shared_folder

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINE = "\r\n"


def page_records(pages: DataFrame) -> DataFrame:
    """Records (page_id, url, digest, bytes, payload) of pages; a null html is an empty payload."""
    payload = F.coalesce("html", F.lit(""))
    return pages.select("page_id", "url", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"), payload.alias("payload"))


def _identity(*more: Column) -> Column:
    """A UUID-shaped id of a record's page, address and payload."""
    digest = F.md5(F.to_json(F.struct("page_id", "url", "digest", *more)))
    return F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def resolve_revisits(records: DataFrame, least: int = 100) -> DataFrame:
    """Decide from headers alone which records revisit which.

    records has page_id, url, digest, bytes. Headers are dealt by digest; per payload of at least `least`
    bytes the record with the smallest page_id (nulls last, then the smallest url) is the response, the
    others revisit it; smaller payloads are all responses. Equal headers count once per task before the
    shuffle. Returns one row per distinct header: key, page_id, url, digest, bytes, copies, original_key
    (null unless the payload is shared ground), original_url.
    """
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("bare"), "url", "key")
    headers = records.select(_identity().alias("key"), "page_id", "url", "digest", "bytes").groupBy(
        "key", "page_id", "url", "digest", "bytes").agg(F.count("*").alias("copies"))
    originals = headers.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min(rank).alias("original"))
    return headers.join(originals, "digest", "left").select(
        "key", "page_id", "url", "digest", "bytes", "copies", F.col("original.key").alias("original_key"), F.col("original.url").alias("original_url"))


def _header(name: str, value: Column | str) -> Column:
    """A header line, or nothing for a null; line breaks in a value become spaces."""
    value = F.lit(value) if isinstance(value, str) else F.regexp_replace(value.cast("string"), r"[\r\n]+", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(LINE)), F.lit(""))


def archive_lines(records: DataFrame, date: str, least: int = 100) -> DataFrame:
    """The text of each WARC record, but for its last line break.

    Payloads move once, by record key; only responses carry one. Equal records become one response and
    revisits to it (below `least` bytes: responses all). Headers are written anew.
    """
    decided = resolve_revisits(records, least).select("key", "original_key", "original_url")
    payloads = records.withColumn("key", _identity()).groupBy("key").agg(
        *[F.first(c).alias(c) for c in ("page_id", "url", "digest", "bytes", "payload")], F.count("*").alias("copies"))
    each = payloads.join(decided, "key").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    revisit = F.col("original_key").isNotNull() & ((F.col("original_key") != F.col("key")) | (F.col("copy") > 0))
    each = each.withColumn("revisit", revisit).withColumn(
        "record", F.when(F.col("copy") == 0, F.col("key")).otherwise(_identity(F.col("copy"))))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}"), _header("Content-Length", F.col("bytes")), F.lit(LINE))
    block = F.concat(http, F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload")))
    when = lambda column: F.when(F.col("revisit"), column)
    head = F.concat(
        F.lit(f"WARC/1.1{LINE}"), _header("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), "record", F.lit(">"))), _header("WARC-Date", date),
        _header("WARC-Target-URI", F.col("url")), _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        _header("WARC-Profile", when(F.lit(PROFILE))), _header("WARC-Refers-To", when(F.concat(F.lit("<urn:uuid:"), "original_key", F.lit(">")))),
        _header("WARC-Refers-To-Target-URI", when(F.col("original_url"))), _header("WARC-Refers-To-Date", when(F.lit(date))),
        _header("X-Page-ID", F.col("page_id")), _header("Content-Type", "application/http; msgtype=response"))
    return each.select(F.concat(head, _header("Content-Length", F.octet_length(block)), F.lit(LINE), block, F.lit(LINE)).alias("value"))


def write_archives(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", least: int = 100, per_file: int = 20_000) -> None:
    """Write deduplicated gzipped archives of at most per_file records each into folder."""
    lines = archive_lines(records, date, least)
    lines.write.option("lineSep", LINE).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(folder)


def parse_archive(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("WARC record cut short")
        yield head, block


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Records of the archives: record_id, page_id, url, type, refers_to, header_digest, payload_bytes, digest[, payload].

    Files are streamed record by record. payload_bytes and digest are of the payload that the record itself
    has, so null for revisits.
    """
    fields = ["record_id string", "page_id long", "url string", "record_type string", "refers_to_record string",
              "header_digest string", "payload_bytes long", "payload_digest string", *(["payload binary"] if payloads else [])]
    names = [f.split()[0] for f in fields]
    kinds = [pa.int64() if f.endswith("long") else pa.binary() if f.endswith("binary") else pa.string() for f in fields]

    def bare(urn: str | None) -> str | None:
        return urn.strip("<>").removeprefix("urn:uuid:") if urn else None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for content in batch.column(0):
                stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())), 1 << 16)
                for head, block in parse_archive(stream):
                    page = head.get("x-page-id")
                    own = head["warc-type"] == "response"
                    payload = block[block.index(b"\r\n\r\n") + 4:] if own else b""
                    row = (bare(head["warc-record-id"]), int(page) if page else None, head.get("warc-target-uri"), head["warc-type"],
                           bare(head.get("warc-refers-to")), head.get("warc-payload-digest", "").removeprefix("sha256:"),
                           len(payload) if own else None, hashlib.sha256(payload).hexdigest() if own else None)
                    rows.append((*row, payload) if payloads else row)
                    size += 400 + len(payload) * payloads
                    if size > 1 << 24:
                        yield batch_of(rows)
                        rows, size = [], 0
        if rows:
            yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(folder).select("content")
    return files.mapInArrow(run, ", ".join(fields))


def archived_pages(pages: DataFrame, least: int = 100) -> DataFrame:
    """Write pages into archives in the shared folder and report each from what is read back.

    Returns page_id, payload_bytes, payload_digest (both of the full payload, for revisits the response's),
    record_type, refers_to (the response's page_id). Null html is an empty payload; equal rows get a record
    each; rows with a null page_id or url leave that header out. No rows write an archive without records.
    """
    spark = pages.sparkSession
    folder = shared_folder(spark)
    write_archives(page_records(pages), folder, least=least)
    read = read_archives(spark, folder, payloads=False)
    response = F.col("record_type") == "response"
    originals = read.filter(response).select(
        F.col("record_id").alias("original"), F.col("page_id").alias("original_page"), F.col("payload_bytes").alias("original_bytes"),
        F.col("payload_digest").alias("original_digest"))
    joined = read.join(originals, F.col("refers_to_record") == F.col("original"), "left")
    return joined.select(
        "page_id", F.coalesce("payload_bytes", "original_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "original_digest").alias("payload_digest"),
        "record_type", F.col("original_page").alias("refers_to"))
