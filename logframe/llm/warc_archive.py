"""Content-addressed web archive.

Payload bytes are stored once, under their SHA-256; record headers are kept exactly, in a table of their own, with the
digest of the payload that they belong to. A record's bytes are its header, and for a response the payload behind it,
so records come back through a join on the digest. Of records with equal payloads the one with the smallest page_id is
the response; the others are revisits that name it.

Below ``path``: ``headers`` (record_no, sha256, header) and ``payloads`` (sha256, payload), both Parquet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logframe.llm.common import work_path, written

CRLF = "\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: five hex digits at a time make four digits of 32."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _payload() -> Column:
    return F.coalesce(F.col("html"), F.lit("")).cast("binary")


def _record_id(page_id: Column, record_no: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), record_no.cast("string"), F.lit(">"))


def _http(n: Column) -> Column:
    lines = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8"]
    return F.concat(F.lit(CRLF.join(lines) + CRLF + "Content-Length: "), n.cast("string"), F.lit(CRLF + CRLF))


def _header() -> Column:
    """The WARC header, its blank line and the HTTP header of a record."""

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    revisit, http = F.col("first_no") != F.col("record_no"), _http(F.col("payload_bytes"))
    uri = F.regexp_replace("url", "[\r\n]+", " ")
    block = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    optional = [
        F.when(uri.isNotNull(), line("WARC-Target-URI", uri)),
        F.when(revisit, line("WARC-Profile", F.lit(REVISIT))),
        F.when(revisit, line("WARC-Refers-To", _record_id(F.col("first_page"), F.col("first_no")))),
    ]
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("record_no"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        *(F.coalesce(x, F.lit("")) for x in optional),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block.cast("string")),
        F.lit(CRLF),
        http,
    )


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Archive every row of pages (page_id, url, html). Payloads under least_bytes are all responses.

    Headers come from a written table of digests alone, so no payload is moved for them. Payloads are dealt by digest,
    each task handing on one copy of each, so thousands of copies of one page are no hot key. Copies are verified: a
    digest with two lengths or two SHA-1 sums raises an error.
    """
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), _payload().alias("payload"))
    sha256 = F.sha2("payload", 256).alias("sha256")
    digests = source.select("page_id", "url", sha256, F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    digests = written(digests.withColumn("record_no", F.monotonically_increasing_id()), "warc-digests")

    shared = digests.filter(F.col("payload_bytes") >= least_bytes)
    first = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "record_no"))
    owners = shared.groupBy("sha256").agg(
        first.alias("first"),
        F.min("payload_bytes").alias("n"), F.max("payload_bytes").alias("n2"), F.min("payload_digest").alias("d"), F.max("payload_digest").alias("d2"),
    )
    same = (F.col("n") == F.col("n2")) & (F.col("d") == F.col("d2"))
    owner = F.when(same, F.col("first")).otherwise(F.raise_error(F.lit("two payloads with one SHA-256")))
    owners = owners.select("sha256", owner.alias("first"))
    first_no = F.when(F.col("payload_bytes") >= least_bytes, F.col("first.record_no")).otherwise(F.col("record_no"))
    records = digests.join(owners, "sha256", "left").withColumns({"first_no": first_no, "first_page": F.col("first.page_id")})
    records.select("record_no", "sha256", _header().cast("binary").alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")

    one = F.row_number().over(Window.partitionBy("sha256").orderBy(F.lit(1)))
    once = source.select(sha256, "payload").withColumn("nth", one).filter("nth = 1").drop("nth")
    once.write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("record_no long, sha256 string, header binary").parquet(f"{path}/headers")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Stored payloads; one whose bytes do not have its digest raises an error."""
    stored = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    sound = F.sha2("payload", 256) == F.col("sha256")
    return stored.select(F.when(sound, F.col("sha256")).otherwise(F.raise_error(F.lit("a payload does not have its digest"))).alias("sha256"), "payload")


def _field(name: str) -> Column:
    found = F.regexp_extract(F.col("header").cast("string"), rf"(?m)^{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def _page_of(name: str) -> Column:
    return F.expr(f"try_cast({{}} as bigint)".format(f"regexp_extract(cast(header as string), '(?m)^{name}: <urn:page:(-?[0-9]*):', 1)"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of an archive: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    Bytes and digest are taken from the stored payload; a header with another digest raises an error.
    """
    measured = read_payloads(spark, path).select("sha256", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    told = read_headers(spark, path).select(
        "sha256", _page_of("WARC-Record-ID").alias("page_id"), _field("WARC-Type").alias("record_type"), _page_of("WARC-Refers-To").alias("refers_to"),
        _field("WARC-Target-URI").alias("url"), F.substring(_field("WARC-Payload-Digest"), 6, 32).alias("told"),
    )
    sound = F.col("told") == F.col("payload_digest")
    digest = F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record's payload is not what its header tells")))
    joined = told.join(measured, "sha256", "left")
    return joined.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to", "url")


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """record_no and the exact bytes of every record, as they stand in a WARC file."""
    joined = read_headers(spark, path).join(read_payloads(spark, path), "sha256")
    payload = F.when(_field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.select("record_no", F.concat("header", payload, F.lit((CRLF + CRLF).encode())).alias("record"))


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archive all pages in a new folder below the shared one and read the archive back.

    A null html is an empty payload; a null url has no header line; a null page_id comes last among equal payloads and
    is referred to as null; repeated rows are records each, and all but one of them revisits. An empty table gives an
    empty archive.
    """
    path = work_path(pages.sparkSession, "warc")
    write_archive(pages, path, least_bytes)
    return read_records(pages.sparkSession, path)
