"""Content-addressed WARC archive: payload bytes once by digest, exact record headers beside them.

An archive is a folder with two tables. ``payloads`` holds each distinct payload once under its
SHA-256; ``headers`` holds, for every record, the exact bytes that stand before its payload. A
record is its header, its payload where it is a response, and two line ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.llm.rows import stored, table
from reelgrid.session import shared_folder

LEAST_BYTES = 100
SALTS = 256
COPY_ROWS = 10_000
DATE = "1970-01-01T00:00:00Z"
LINE = "\r\n"

# Names and media types of the WARC 1.1 standard.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype=response"


def _line_text(value: Column) -> Column:
    """A value that stays on its line: line ends in it are percent-encoded."""
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _record_id(page_id: Column, row: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
                    F.lit(":"), row.cast("string"), F.lit(">"))


def _header(date: str, media_type: str) -> Column:
    """Bytes before the payload: the record's named fields, then the HTTP response's head."""
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: {media_type}{LINE}Content-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(LINE * 2))
    is_response = F.col("record_type") == "response"
    content = F.octet_length(head) + F.when(is_response, F.col("payload_bytes")).otherwise(0)
    url = F.col("url")
    fields = [
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", F.col("record_id")),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", _line_text(url)),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ("WARC-Profile", F.when(~is_response, F.lit(REVISIT_PROFILE))),
        ("WARC-Refers-To", F.col("refers_to_record")),
        ("Content-Type", F.lit(HTTP_TYPE)),
        ("Content-Length", content.cast("string")),
    ]
    lines = [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(LINE)), F.lit(""))
             for name, value in fields]
    return F.concat(F.lit(VERSION + LINE), *lines, F.lit(LINE), head).cast("binary")


def _parts(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """Pages with their payload, its size and digest; a null text is an empty payload."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    return rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"),
                       F.sha2("payload", 256).alias("digest"))


def _copies(copy_rows: int) -> Column:
    return F.expr(f"(records + {copy_rows - 1}) DIV {copy_rows}").cast("int").alias("copies")


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url",
                  html: str = "html", least_bytes: int = LEAST_BYTES, date: str = DATE,
                  media_type: str = "text/html; charset=utf-8", salts: int = SALTS,
                  copy_rows: int = COPY_ROWS) -> None:
    """Write one WARC record per page to the archive folder ``path``.

    Of records with equal payloads of ``least_bytes`` or more, the one with the smallest page
    id (null last; of repeated rows the first stored) is a response, the others are revisits
    that name it; smaller payloads are all responses. A null html is an empty payload, a null
    url leaves its field out, line ends in a url are percent-encoded. Other columns are not
    archived. ``pages`` is read twice and must give the same rows both times.

    Copies combine before the shuffle, so a payload crosses it once a task at most, whatever
    its share of the rows. Records learn of their group through (digest, salt) pairs. The
    count of records of a payload over ``copy_rows`` says how many copies of it a join deals.
    """
    parts = _parts(pages, page_id, url, html)
    # Equal digests are held against size and a second hash, so a stored payload is everyone's.
    second = F.xxhash64("payload")
    single = parts.groupBy("digest").agg(
        F.first("payload").alias("payload"), F.min("payload_bytes").alias("payload_bytes"),
        F.max("payload_bytes").alias("most"), F.min(second).alias("one"), F.max(second).alias("other"),
        F.count("*").alias("records"))
    same = (F.col("payload_bytes") == F.col("most")) & (F.col("one") == F.col("other"))
    single.select("digest", "payload", F.when(same, F.col("payload_bytes")).otherwise(
        F.raise_error(F.concat(F.lit("two payloads share the digest "), F.col("digest")))
        .cast("long")).alias("payload_bytes"), _copies(copy_rows)).write.parquet(f"{path}/payloads")

    records = stored(parts.select("page_id", "url", "payload_bytes", "digest",
                                  F.monotonically_increasing_id().alias("row")), "warc-records")
    records = records.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    # null page ids come last, so a group's first has an id where any member has one
    first = F.min(F.struct(F.col("page_id").isNull().alias("late"), F.col("page_id"), F.col("row")))
    pairs = records.groupBy("digest", "salt").agg(first.alias("first"), F.count("*").alias("held"))
    facts = pairs.groupBy("digest").agg(F.min("first").alias("first"), F.sum("held").alias("records"))
    known = records.join(pairs.select("digest", "salt").join(facts, "digest"), ["digest", "salt"])
    revisit = (F.col("payload_bytes") >= least_bytes) & (F.col("row") != F.col("first.row"))
    headers = known.select(
        _record_id(F.col("page_id"), F.col("row")).alias("record_id"), "url", "payload_bytes", "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, _record_id(F.col("first.page_id"), F.col("first.row"))).alias("refers_to_record"),
        _copies(copy_rows), "row")
    headers.select("digest", F.pmod(F.xxhash64("row"), F.col("copies")).cast("int").alias("copy"),
                   _header(date, media_type).alias("header")).write.parquet(f"{path}/headers")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Stored payloads, each checked against its digest: a payload that does not have it stops
    the read."""
    rows = spark.read.schema("digest string, payload binary, copies int").parquet(
        f"{path}/payloads")
    found = F.sha2("payload", 256)
    return rows.select(
        F.when(found == F.col("digest"), found).otherwise(F.raise_error(F.concat(
            F.lit("a payload is not that of its digest: "), F.col("digest")))).alias("digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), "payload", "copies")


def _field(name: str) -> Column:
    """Value of a named field of the header; null where it is not there."""
    lines = F.split(F.decode("header", "UTF-8"), LINE + LINE, 2)[0]
    start = LINE + name + ": "
    found = F.substring_index(F.substring_index(F.concat(lines, F.lit(LINE)), start, -1), LINE, 1)
    return F.when(F.contains(lines, F.lit(start)), found)


def _page_of(record_id: Column) -> Column:
    return F.element_at(F.split(record_id, ":"), -2).try_cast("long")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """All records of an archive: page_id, url, record_type, refers_to (page id), payload_bytes,
    payload_digest, header, payload (of revisits too) and record, its bytes in a WARC file.

    Headers meet their payload on the digest; a payload with very many records is dealt in
    copies, each for a part of them. Columns that are not asked for are not shuffled.
    """
    headers = spark.read.schema("digest string, copy int, header binary").parquet(f"{path}/headers")
    dealt = read_payloads(spark, path).withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    whole = headers.join(dealt, ["digest", "copy"], "left")
    is_response = _field("WARC-Type") == "response"
    named = F.replace(_field("WARC-Payload-Digest"), F.lit("sha256:"), F.lit(""))
    found = F.coalesce(F.when(named == F.col("digest"), F.col("payload_bytes")), F.raise_error(
        F.concat(F.lit("no payload for the digest "), F.col("digest"))).cast("long"))
    return whole.select(
        _page_of(_field("WARC-Record-ID")).alias("page_id"),
        _field("WARC-Target-URI").alias("url"), _field("WARC-Type").alias("record_type"),
        _page_of(_field("WARC-Refers-To")).alias("refers_to"), found.alias("payload_bytes"),
        named.alias("payload_digest"), "header", "payload",
        F.concat(F.col("header"), F.when(is_response, F.col("payload")).otherwise(F.lit(b"")),
                 F.lit((LINE * 2).encode())).alias("record"))


def write_warc_files(spark: SparkSession, path: str, target: str) -> None:
    """Plain WARC files with every record of an archive, one file a task. Spark's text writer
    puts the two line ends that close a record."""
    (read_archive(spark, path).select(F.expr(
        f"CAST(substring(record, 1, octet_length(record) - {2 * len(LINE)}) AS STRING)"))
     .write.option("lineSep", LINE * 2).text(target))


def op12_warc(spark, sf_dir: str) -> DataFrame:
    """Every page archived, and what its record says once the archive is read back."""
    path = shared_folder(spark, "llm", f"warc-{uuid.uuid4().hex}")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP12_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id) AS n,
             first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND n > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND n > 1 THEN first END AS refers_to
FROM f"""
