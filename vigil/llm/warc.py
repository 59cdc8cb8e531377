"""WARC archives with revisit resolution.

Payload digests are dealt out with the headers only; of records with equal
payloads the smallest page id stays a response, the others become revisit
records that refer to it.  The archives are written by Spark's text writer
(the record separator is its line separator), read back as whole files, and
the revisits are joined to their responses by record id.

Defined cases: a null html is an empty payload; a null url leaves the target
header out; a null page_id never is the original of another row (only where
all ids of a group are null each stays a response); rows that repeat the id
and payload of a response are responses too; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import hashlib
import base64

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import prepare, scratch_path, stage

SEPARATOR = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# The base32 digits, and those that conv() writes.
BASE32, CONV32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: Records of one archive file: bounds what a reading task holds.
RECORDS_PER_FILE = 500
#: Compressed bytes that the reader takes in at once.
INFLATE_STEP = 1 << 20


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, 20 bits (4 digits) at a time."""
    digits = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), CONV32, BASE32)


def _urn(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("none")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws(
        "-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One row per page: page_id, url, payload, payload_digest, payload_bytes,
    response_id (null: the page is a response itself)."""
    prepare(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select("page_id", "url", payload.alias("payload"),
                        F.octet_length(payload).cast("long").alias("payload_bytes"),
                        base32_sha1(payload).alias("payload_digest"))
    originals = stage(base.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes")
                      .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
                      .drop("n"), "warc-originals")
    return (base.join(originals, ["payload_digest", "payload_bytes"], "left")
            .withColumn("response_id", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")))
            .drop("first_id"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, compression: str = "gzip") -> None:
    """Write one record per page below ``path``: gzip-compressed WARC/1.1 files
    of at most RECORDS_PER_FILE records."""
    r = records(pages, min_bytes)
    http_head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                         F.col("payload_bytes").cast("string"), F.lit(SEPARATOR))
    revisit = F.col("response_id").isNotNull()
    block = F.when(revisit, http_head).otherwise(F.concat(http_head, F.col("payload")))

    def field(name: str, value: Column) -> Column:       # null leaves the field out
        return F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit(""))

    head = F.concat(
        F.lit("WARC/1.1"), field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", _urn(F.col("page_id"), F.col("payload_digest"))),
        field("WARC-Date", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        field("WARC-Target-URI", F.regexp_replace("url", r"\p{Cntrl}", "")),
        field("X-Page-ID", F.col("page_id").cast("string")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        field("WARC-Refers-To", F.when(revisit, _urn(F.col("response_id"), F.col("payload_digest")))),
        field("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        F.lit("\r\nContent-Type: application/http; msgtype=response"),
        field("Content-Length", F.octet_length(block).cast("string")), F.lit(SEPARATOR))
    (r.select(F.concat(head, block).alias("value")).write
     .option("lineSep", SEPARATOR).option("compression", compression)
     .option("maxRecordsPerFile", RECORDS_PER_FILE).mode("overwrite").text(path))


def _stream(data: bytes) -> Iterator[bytes]:
    """The inflated bytes of a (multi-member) gzip file; other files as is."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        z = zlib.decompressobj(31)
        for at in range(0, len(data), INFLATE_STEP):
            yield z.decompress(data[at:at + INFLATE_STEP])
            if z.eof:
                data = z.unused_data + data[at + INFLATE_STEP:]
                break
        else:
            return


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of a file."""
    chunks, buf = _stream(data), bytearray()

    def fill(n: int) -> bool:
        while len(buf) < n:
            more = next(chunks, None)
            if more is None:
                return False
            buf.extend(more)
        return True

    while fill(1):
        while (end := buf.find(b"\r\n\r\n")) < 0:
            if not fill(len(buf) + 1):
                return
        lines = bytes(buf[:end]).decode("utf-8").split("\r\n")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        fill(end + 4 + size + 4)
        yield head, bytes(buf[end + 4:end + 4 + size])
        del buf[:end + 4 + size + 4]


def read_archives(spark, path: str, with_payload: bool = False) -> DataFrame:
    """Rows of the archives: record_id, record_type, page_id, url, payload_digest
    (computed from the payload of responses, from the header of revisits),
    payload_bytes (null for revisits), refers_to_record, payload if asked for."""
    files = prepare(spark).read.format("binaryFile").load(path).select("content")
    names = ["record_id", "record_type", "page_id", "url", "payload_digest", "payload_bytes", "refers_to_record"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for data in f["content"]:
                rows = []
                for head, block in parse_records(data):
                    payload = block.partition(b"\r\n\r\n")[2]
                    response = head["warc-type"] == "response"
                    digest = (base64.b32encode(hashlib.sha1(payload).digest()).decode() if response
                              else head["warc-payload-digest"].removeprefix("sha1:"))
                    rows.append((head["warc-record-id"], head["warc-type"], head.get("x-page-id"),
                                 head.get("warc-target-uri"), digest, len(payload) if response else None,
                                 head.get("warc-refers-to"), *([payload if response else None] * with_payload)))
                out = pd.DataFrame(rows, columns=names + ["payload"] * with_payload)
                out["payload_bytes"] = out["payload_bytes"].astype("Int64")
                yield out

    return files.mapInPandas(run, "record_id string, record_type string, page_id string, url string, "
                             "payload_digest string, payload_bytes long, refers_to_record string"
                             + ", payload binary" * with_payload)


def resolve(read: DataFrame) -> DataFrame:
    """Join revisit records to the responses they refer to (headers only):
    page_id, payload_bytes, payload_digest, record_type, refers_to."""
    heads = stage(read.select("record_id", "record_type", F.col("page_id").cast("long").alias("page_id"),
                              "payload_digest", "payload_bytes", "refers_to_record"), "warc-heads")
    responses = stage(heads.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_record"))
                      .agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("full_bytes")),
                      "warc-responses")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    own = heads.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    again = (heads.where("record_type = 'revisit'").drop("payload_bytes")
             .join(responses, "refers_to_record", "left").withColumnRenamed("full_bytes", "payload_bytes"))
    return own.select(columns).unionByName(again.select(columns))


def op8_warc_revisits(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(prepare(spark).read.parquet(f"{sf_dir}/pages.parquet"), path)
    return resolve(read_archives(spark, path))
