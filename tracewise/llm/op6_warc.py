"""WARC: revisit resolution over page captures.

Headers (page, url, payload size and digest) are shuffled by payload digest and
aggregated to the first page of each digest; joined back to the headers, that
makes each page a response or a revisit of an earlier response.  Payloads stay
where they are read: a bitmap of the repeated digests (``SIEVE_BITS`` places,
8 MB at most, so it is broadcast) tells which payloads may be repeated; all
others are written from where they are.  Of those it marks, the digest's payload
is shuffled once per task that has it, not once per copy, and given to the
responses.  A digest marked by chance takes that way too: the result is exact.

The records are written as WARC/1.1 archives with fresh headers (a record ends
with two CRLFs, which is the line separator of Spark's text writer here), read
back whole file by whole file, cut by Content-Length, and each revisit is joined
to the response its WARC-Refers-To names.

Payloads under ``min_bytes`` are always stored.  Archives hold at most
``records_per_file`` records and are one gzip member each.

Defined results: a null html is an empty payload; a page row that occurs twice
is a response twice when its page_id is the smallest of its payload, a revisit
twice otherwise, and its records share their id; a null page_id never gets to be
the one revisited (it is a response if all rows of the payload have none);
control characters, blanks and percent signs of a url are percent-encoded in the
header and decoded on reading; other columns of pages are left out; an empty
table gives no record; a payload may be as long as one Spark value.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.llm.common import shared_path, ship_by_value, store

MIN_REVISIT_BYTES = 100
RECORDS_PER_FILE = 4000
SIEVE_BITS = 26                # log2 of the places of the bitmap of repeated digests: 8 MB at most
_CRLF = "\r\n"
# ---- fixed values of the WARC 1.1 format ------------------------------------
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# -----------------------------------------------------------------------------


def _captures(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest of ``pages``."""
    page = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"),
                        F.coalesce("html", F.lit("")).alias("payload"))
    return page.withColumns({"payload_bytes": F.octet_length("payload").cast("long"),
                             "payload_digest": F.sha2(F.col("payload").cast("binary"), 256)})


def _firsts(heads: DataFrame, min_bytes: int) -> DataFrame:
    """r_digest, r_page: the first page of each payload that is there twice or more."""
    return (heads.where(F.col("payload_bytes") >= min_bytes)
            .groupBy(F.col("payload_digest").alias("r_digest"))
            .agg(F.min("page_id").alias("r_page"), F.count("*").alias("r_n"))
            .where("r_n > 1 and r_page is not null").select("r_digest", "r_page"))


def resolve(heads: DataFrame, firsts: DataFrame) -> DataFrame:
    """The headers with record_type and refers_to."""
    got = heads.join(firsts, F.col("payload_digest") == F.col("r_digest"), "left")
    revisit = F.col("r_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("r_page"))
    return got.select("page_id", "url", "payload_bytes", "payload_digest",
                      F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                      F.when(revisit, F.col("r_page")).alias("refers_to"))


def _sieved(df: DataFrame, firsts: DataFrame, digest: str = "payload_digest", bits: int = SIEVE_BITS) -> DataFrame:
    """``df`` with ``repeated``: false only where the digest is none of ``firsts``."""
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << bits) - 1))
    maps = firsts.select(place("r_digest").alias("p")).groupBy(F.bitmap_bucket_number("p").alias("s_bucket")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("s_map"))
    at = F.bitmap_bit_position(place(digest))
    byte = F.conv(F.hex(F.substring("s_map", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return (df.join(F.broadcast(maps), F.bitmap_bucket_number(place(digest)) == F.col("s_bucket"), "left")
            .withColumn("repeated", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)))
            .drop("s_bucket", "s_map"))


def resolved_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload (empty for revisits), payload_digest, record_type, refers_to of every page row."""
    page = _captures(pages)
    heads = store(page.drop("payload"), "warc-heads")
    firsts = store(_firsts(heads, min_bytes), "warc-firsts")
    columns = ["page_id", "url", "payload", "payload_digest", "record_type", "refers_to"]
    page = _sieved(page, firsts)
    response = {"record_type": F.lit("response"), "refers_to": F.lit(None).cast(heads.schema["page_id"].dataType)}
    alone = page.where("not repeated").withColumns(response).select(columns)
    # map-side, a task sends each of these payloads once, however many copies it has
    payloads = page.where("repeated").groupBy(F.col("payload_digest").alias("p_digest")).agg(F.first("payload").alias("payload"))
    marked = resolve(_sieved(heads, firsts).where("repeated"), firsts)
    revisits = marked.where("record_type = 'revisit'").withColumn("payload", F.lit("")).select(columns)
    originals = (marked.where("record_type = 'response'")
                 .join(payloads, F.col("payload_digest") == F.col("p_digest")).select(columns))
    return alone.unionByName(originals).unionByName(revisits)


def _record_id(page_id: Column) -> Column:
    """A stable record name of a page: the same page always has the same."""
    h = F.md5(F.concat(F.lit("page "), F.coalesce(page_id.cast("string"), F.lit("null"))))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-"), part(13, 4), F.lit("-"),
                    part(17, 4), F.lit("-"), part(21, 12), F.lit(">"))


def _safe(url: Column) -> Column:
    coded = url
    for code in [0x25, *range(0x00, 0x21), 0x7F]:                      # the percent sign first
        coded = F.replace(coded, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(url.rlike(r"[\x00-\x20%\x7F]"), coded).otherwise(url)


def records(resolved: DataFrame, date: str) -> DataFrame:
    """One column ``value``: the WARC record of each page, without its last two CRLFs."""
    revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    return resolved.select(F.concat(
        F.lit(VERSION + _CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _safe(F.col("url"))),
        F.when(F.col("page_id").isNotNull(), line("X-Page-ID", F.col("page_id").cast("string"))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)),
                                 line("WARC-Refers-To", _record_id(F.col("refers_to"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(_CRLF), block).alias("value"))


def write_archives(pages: DataFrame, path: str, date: str = "2026-01-01T00:00:00Z",
                   min_bytes: int = MIN_REVISIT_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write the deduplicated archives of ``pages`` (page_id, url, html) to ``path``."""
    (records(resolved_records(pages, min_bytes), date).write
     .option("lineSep", _CRLF * 2).option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives: page_id, url, record_id, record_type, refers_to_id,
    payload_digest, block (the stored payload)."""
    ship_by_value()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from _parsed(content.as_py())

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "page_id long, url string, record_id string, record_type string, "
                                 "refers_to_id string, payload_digest string, block binary")


def _parsed(data: bytes, rows: int = 500):
    """Batches of the records in one archive (gzip, or plain), cut by Content-Length."""
    import gzip
    import re
    from urllib.parse import unquote
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = data[at:end].decode().split("\r\n")
        if head[0] != VERSION:
            raise ValueError(f"no record at byte {at}: {head[0][:40]!r}")
        h = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head[1:])
        size = int(h["Content-Length"])
        block = data[end + 4:end + 4 + size]
        at = end + 4 + size
        if len(block) < size or data[at:at + 4] != b"\r\n\r\n":
            raise ValueError(f"record of {size} bytes cut off at byte {at}")
        at += 4
        digest = re.fullmatch(r"sha256:([0-9a-f]{64})", h["WARC-Payload-Digest"])[1]
        page = h.get("X-Page-ID")
        out.append((int(page) if page else None, unquote(h.get("WARC-Target-URI", "")), h["WARC-Record-ID"],
                    h["WARC-Type"], h.get("WARC-Refers-To"), digest, block))
        if len(out) == rows:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def _batch(rows):
    kinds = [pa.int64(), *[pa.string()] * 5, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      names=["page_id", "url", "record_id", "record_type", "refers_to_id",
                                             "payload_digest", "block"])


def resolve_revisits(archive: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Size and digest of a response are taken from its block; a revisit has those
    of the response it refers to.
    """
    heads = archive.select(
        "page_id", "record_id", "record_type", "refers_to_id",
        F.octet_length("block").cast("long").alias("own_bytes"),
        F.when(F.col("record_type") == "response", F.sha2("block", 256)).otherwise(F.col("payload_digest")).alias("digest"))
    originals = (heads.where("record_type = 'response'").groupBy(F.col("record_id").alias("o_id"))
                 .agg(F.min("page_id").alias("o_page"), F.min("own_bytes").alias("o_bytes"), F.min("digest").alias("o_digest")))
    got = heads.where("record_type = 'revisit'").join(originals, F.col("refers_to_id") == F.col("o_id"), "left")
    as_row = lambda df, n, d, r: df.select("page_id", n.alias("payload_bytes"), d.alias("payload_digest"),
                                           "record_type", r.cast("long").alias("refers_to"))
    return as_row(heads.where("record_type = 'response'"), F.col("own_bytes"), F.col("digest"), F.lit(None)).unionByName(
        as_row(got, F.col("o_bytes"), F.col("o_digest"), F.col("o_page")))


def warc_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the archives of ``pages`` and read them back (see ``resolve_revisits``)."""
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    write_archives(pages, path)
    return resolve_revisits(read_archives(spark, path))


# DuckDB: the same decisions straight from the table
SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
           FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first_id IS NOT NULL AND f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id IS NOT NULL AND f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
