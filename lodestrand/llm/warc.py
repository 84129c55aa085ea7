"""Content-addressed WARC archive.

Each payload is stored once under its SHA-256; the payloads themselves are grouped, so that two payloads under one
address would show up as two rows and stop the write.  The exact header block of each record (WARC fields, and the
HTTP head of responses) is kept in a table of its own, and joins on the address give back the original records.
Reading rebuilds the bytes of each record, parses them (fields, lengths, HTTP head, payload), and recomputes every digest
and length from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm.common import Scratch, id_order

CRLF = "\r\n"
#: The digits of base-32 numbers as ``conv`` writes them, and those of RFC 4648.
CONV_DIGITS, BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Bare base32 SHA-1: 160 bits are four 40-bit numbers of eight base-32 digits each."""
    h = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), CONV_DIGITS, BASE32_DIGITS)


def _uuid(page_id: Column, row: Column) -> Column:
    h = F.sha2(F.concat_ws(":", page_id.cast("string"), row.cast("string")), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def _one_line(text: Column) -> Column:
    """A header value holds no line ends or other control characters; these are percent-encoded."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    coded = text
    for c in (*range(32), 127):
        coded = F.replace(coded, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return F.when(text.rlike(r"[\x00-\x1F\x7F]"), coded).otherwise(text)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> None:
    """Writes ``path``/payloads and ``path``/headers.

    Of records with equal payloads of ``least_bytes`` or more, the one with the smallest page id (nulls last, then in
    order of reading) is a response and the others revisit it; smaller payloads are all responses.  Null html is an
    empty payload.  Further columns are ignored.
    """
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))

    stored = rows.select(F.sha2("payload", 256).alias("address"), "payload").groupBy("address", "payload").agg(F.count(F.lit(1)).alias("uses"))
    stored.write.mode("overwrite").parquet(f"{path}/payloads")
    clash = spark.read.parquet(f"{path}/payloads").groupBy("address").count().where("count > 1").limit(1).collect()
    if clash:
        raise ValueError(f"two payloads have the address {clash[0]['address']}")

    keys = rows.withColumn("row", F.monotonically_increasing_id()).select(
        "page_id", "row", "url", F.sha2("payload", 256).alias("address"), F.octet_length("payload").cast("bigint").alias("size"), base32_sha1(F.col("payload")).alias("digest")
    )
    keys.write.mode("overwrite").parquet(f"{path}/keys")
    keys = spark.read.parquet(f"{path}/keys")
    firsts = keys.groupBy("address").agg(F.min(id_order("page_id", "row")).alias("first"))
    records = keys.join(firsts, "address")
    revisit = (F.col("size") >= least_bytes) & (F.col("first.row") != F.col("row"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF * 2))
    block = F.when(revisit, F.octet_length(head)).otherwise(F.octet_length(head) + F.col("size"))
    fields = [
        ("WARC-Type", F.when(revisit, REVISIT).otherwise(RESPONSE)),
        ("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), _uuid(F.col("page_id"), F.col("row")), F.lit(">"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", _one_line(F.col("url"))),
        ("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        ("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:uuid:"), _uuid(F.col("first.id"), F.col("first.row")), F.lit(">")))),
        ("X-Refers-To-Page", F.when(revisit, F.coalesce(F.col("first.id").cast("string"), F.lit("")))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", block.cast("string")),
    ]
    # concat_ws leaves out the fields that are null
    lines = F.concat_ws(CRLF, F.lit("WARC/1.1"), *[F.concat(F.lit(f"{k}: "), v) for k, v in fields])
    records.select("row", "address", F.concat(lines, F.lit(CRLF * 2)).alias("warc_head"), head.alias("http_head")).write.mode("overwrite").parquet(f"{path}/headers")


def _field(name: str, head: str = "warc_head") -> Column:
    found = F.regexp_extract(head, rf"(?:^|\r\n){name}: ([^\r]*)", 1)
    return F.when(F.col(head).contains(f"{CRLF}{name}: "), found)


def _number(text: Column) -> Column:
    return F.when(text != "", text.cast("bigint"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The original records through a join: record (the exact bytes of the WARC record), address, and payload, of
    revisits that of the record that they refer to; null where the archive has lost it."""
    heads = spark.read.parquet(f"{path}/headers")
    whole = heads.join(spark.read.parquet(f"{path}/payloads").select("address", "payload"), "address", "left")
    body = F.when(_field("WARC-Type") == RESPONSE, F.col("payload")).otherwise(F.lit(b""))
    record = F.concat(F.encode("warc_head", "UTF-8"), F.encode("http_head", "UTF-8"), body, F.encode(F.lit(CRLF * 2), "UTF-8"))
    return whole.select(record.alias("record"), "address", "payload")


def parse_records(records: DataFrame) -> DataFrame:
    """``records`` with what the bytes of each say: page, record_type, refers, stated (digest), and body, the payload of
    the HTTP message (empty for revisits); whole: the lengths that the record states are those that it has."""
    end = CRLF * 2
    text = F.col("record").cast("string")
    heads = records.withColumn("warc", F.substring_index(text, end, 1)).withColumn("block", F.expr(f"substring(record, octet_length(warc) + {len(CRLF * 2) + 1}, octet_length(record) - octet_length(warc) - {2 * len(CRLF * 2)})"))
    http = heads.withColumn("http", F.substring_index(F.col("block").cast("string"), end, 1)).withColumn("body", F.expr(f"substring(block, octet_length(http) + {len(CRLF * 2) + 1})"))
    revisit = _field("WARC-Type", "warc") == REVISIT
    lengths = (_field("Content-Length", "warc").cast("bigint") == F.octet_length("block")) & (revisit | (_field("Content-Length", "http").cast("bigint") == F.octet_length("body")))
    fields = (("page", "X-Page-ID"), ("record_type", "WARC-Type"), ("refers", "X-Refers-To-Page"), ("stated", "WARC-Payload-Digest"))
    return http.select("address", "payload", "body", *[_field(name, "warc").alias(c) for c, name in fields], lengths.alias("whole"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, from the rebuilt records alone: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The payload of a response is cut out of its record, that of a revisit is the one it refers to.  A payload that does
    not match its address, or a record whose stated digest or lengths are not those it has, stops the read.
    """
    parsed = parse_records(read_records(spark, path))
    full = parsed.withColumn("full", F.when(F.col("record_type") == RESPONSE, F.col("body")).otherwise(F.col("payload")))
    rows = full.select("page", "record_type", "refers", "stated", "whole", "address", F.octet_length("full").cast("bigint").alias("payload_bytes"), base32_sha1(F.col("full")).alias("payload_digest"), F.sha2("full", 256).alias("found"))
    good = F.coalesce(F.col("whole") & (F.col("found") == F.col("address")) & (F.col("stated") == F.concat(F.lit("sha1:"), F.col("payload_digest"))), F.lit(False))
    return rows.select(
        _number(F.col("page")).alias("page_id"),
        F.when(good, F.col("payload_bytes")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("address"))).cast("bigint")).alias("payload_bytes"),
        "payload_digest",
        "record_type",
        _number(F.col("refers")).alias("refers_to"),
    )


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` into an archive in the shared folder and returns what :func:`read_index` finds there.

    Null ids come back as null, repeated ids and rows each have a record, and no rows give no rows.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    write_archive(pages, scratch.root, least_bytes=least_bytes)
    return read_index(pages.sparkSession, scratch.root)
