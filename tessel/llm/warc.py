"""WARC archives with Spark's own readers and writers, and the assembly of captures from their records.

Writing: each page gives a request record, a response record (or a revisit of an earlier response with the same payload) and a
metadata record, tied by WARC-Concurrent-To. A record is one value of Spark's text writer, whose line separator ends it, so
executors stream archives to any store that Spark can write to.

Reading: the text reader splits archives at the version line that starts a record, so memory is bounded by the largest record.
The writer sees to it that this line stands nowhere else: a body that holds the version is sent in chunks (HTTP chunked coding)
that part it, and a URI that ends in it gets a blank behind it, which readers of header lines drop. The reader takes chunks apart
by their sizes and checks each record's length.

Assembly: records that name each other as concurrent meet on one key, and each capture is one nested row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, skew_join, table

CRLF = "\r\n"
VERSION = "WARC/1.1"
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
#: Bytes that the head of an HTTP chunk may have, and chunks of a body that are closed into one list at a time.
HEAD, GROUP = 4096, 128
_SEPARATOR = f"{VERSION}{CRLF}"
_HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"


def _id(page: Column, kind: str) -> Column:
    """A record's URN: a UUID of version 8, whose last 16 digits before the kind's are the page's id."""
    digits = F.lpad(F.lower(F.hex(page)), 16, "0")
    part = lambda a, n: F.substring(digits, a, n)
    return F.concat(F.lit("<urn:uuid:0000000" + kind + "-"), part(1, 4), F.lit("-8"), part(5, 3), F.lit("-8"), part(8, 3), F.lit("-"), part(11, 6), F.lit("000000>"))


def page_of(urn: Column) -> Column:
    """The page's id that a record's URN holds; null if it isn't one of ours."""
    m = r"^<urn:uuid:0000000[0-9]-([0-9a-f]{4})-8([0-9a-f]{3})-8([0-9a-f]{3})-([0-9a-f]{6})000000>$"
    digits = F.concat(*[F.regexp_extract(urn, m, i) for i in range(1, 5)])
    high, low = (F.conv(F.substring(digits, a, 8), 16, 10).cast("long") for a in (1, 9))
    # two halves, for ids below 0
    return F.when(F.length(digits) == 16, F.shiftleft(high, 32).bitwiseOR(low))


def _uri(url: Column) -> Column:
    """A URL as it can stand in a line: line ends, and blanks at its ends, are percent-encoded."""
    u = F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    for blank, code in ((" ", "%20"), ("\t", "%09")):
        u = F.regexp_replace(F.regexp_replace(u, f"^{blank}", code), f"{blank}$", code)
    return u


def _record(kind: str, record_id: Column, date: str, block: Column, *more: Column) -> Column:
    """Text of a record without its last line end, which the writer adds."""
    uri = _uri(F.col("url"))
    head = F.concat_ws(
        CRLF,
        F.lit(VERSION), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), uri, F.when(uri.endswith(VERSION), " ").otherwise("")), *more,
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return F.concat(head, F.lit(CRLF * 2), block, F.lit(CRLF))


def archived(pages: DataFrame, date: str) -> DataFrame:
    """pages(page_id, payload, url, refers_to) -> one row for each record, in the column value."""
    page = F.col("page_id")
    response = _id(page, "1")
    length = F.octet_length("payload").cast("string")
    digest = F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"))
    # a body that holds the version, wherever a line end may follow it, is sent in chunks that part it between "WARC" and "/1.1"
    text = F.col("payload")
    pieces = F.split(text, "(?<=WARC)(?=/1\\.1)")
    chunk = lambda x: F.concat(F.lower(F.hex(F.octet_length(x).cast("long"))), F.lit(CRLF), x, F.lit(CRLF))
    chunked = F.concat(F.lit(f"{_HTTP}Transfer-Encoding: chunked{CRLF * 2}"), F.array_join(F.transform(pieces, chunk), ""), F.lit("0" + CRLF * 2))
    plain = F.concat(F.lit(f"{_HTTP}Content-Length: "), length, F.lit(CRLF * 2), text)
    answer = F.when(F.contains(text, F.lit(VERSION)), chunked).otherwise(plain)
    request = F.concat(F.lit("GET "), _uri(F.col("url")), F.lit(f" HTTP/1.1{CRLF * 2}"))
    to = F.concat(F.lit("WARC-Concurrent-To: "), response)
    http = lambda kind: F.lit(f"Content-Type: application/http; msgtype={kind}")
    whole = _record("response", response, date, answer, http("response"), digest)
    again = _record(
        "revisit", response, date, F.lit(_HTTP + CRLF), http("response"), digest,
        F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        F.concat(F.lit("WARC-Refers-To: "), _id(F.col("refers_to"), "1")),
    )
    about = F.concat(F.lit("payload-length: "), length, F.lit(CRLF))
    return pages.select(
        F.explode(
            F.array(
                _record("request", _id(page, "0"), date, request, http("request"), to),
                F.when(F.col("refers_to").isNull(), whole).otherwise(again),
                _record("metadata", _id(page, "2"), date, about, F.lit("Content-Type: application/warc-fields"), to),
            )
        ).alias("value")
    )


def write_warc(pages: DataFrame, path: str, least_revisit: int = LEAST_REVISIT, date: str = "2024-01-01T00:00:00Z") -> None:
    """Archives of pages(page_id, url, html) under path, compressed; pages have no date of capture, so all records get this one.

    Of equal payloads of at least least_revisit bytes, that of the smallest page_id is a response and the others revisit it.
    A null html is an empty payload, a null url an empty URI. page_id must not be null (such rows are left out); rows that share one are
    captures of one page with its least html.
    """
    pages = pages.where(F.col("page_id").isNotNull()).select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    pages = pages.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    big = pages.where(F.octet_length("payload") >= least_revisit).select("page_id", "digest")
    first = big.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first")
    refers = skew_join(big, first, "digest").where("page_id <> first").select(F.col("page_id").alias("_p"), F.col("first").alias("refers_to")).distinct()
    marked = pages.join(refers, pages.page_id == refers["_p"], "left").drop("_p")
    archived(marked, date).write.option("lineSep", CRLF).option("compression", "gzip").text(path)


def _field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)
    return F.when(found != "", found)


def _dechunked(body: Column) -> Column:
    """What a body in HTTP chunked coding holds, by the sizes that its chunks give; null if they don't fit.

    A fold goes from one chunk's head to the next by a running sum of sizes. It holds the body once, reads HEAD bytes at each head and, of
    chunks, only where they lie; GROUP of them at a time are closed into one list, so that a step copies no more than about the
    root of their number. A head longer than HEAD bytes doesn't fit.
    """
    # no body has more chunks than lines that begin with a hexadecimal digit
    most = F.greatest(F.regexp_count(body, F.lit(r"(?m)^[0-9A-Fa-f]")), F.lit(1))
    nothing = F.array().cast("array<binary>")
    start = F.struct(body.cast("binary").alias("body"), F.lit(1).alias("at"), nothing.alias("parts"), F.lit(False).alias("ended"))

    def step(now: Column, _: Column) -> Column:
        head = F.regexp_extract(F.substring(now["body"], now["at"], F.lit(HEAD)).cast("string"), r"^[0-9A-Fa-f]{1,7}[^\r\n]*\r\n", 0)
        size = F.coalesce(F.conv(F.regexp_extract(head, "^[0-9A-Fa-f]+", 0), 16, 10).cast("int"), F.lit(0))
        first = now["at"] + F.octet_length(head)
        whole = (first + size + 1 <= F.octet_length(now["body"]))
        more = F.struct(
            now["body"].alias("body"), (first + size + 2).alias("at"),
            F.concat(now["parts"], F.array(F.substring(now["body"], first, size))).alias("parts"), (size == 0).alias("ended"),
        )
        return F.when(now["ended"] | (head == "") | ((size > 0) & ~whole), now).otherwise(more)

    joined = lambda parts: F.unhex(F.array_join(F.transform(parts, F.hex), ""))

    def group(now: Column, _: Column) -> Column:
        opened = F.struct(now["body"].alias("body"), now["at"].alias("at"), nothing.alias("parts"), now["ended"].alias("ended"))
        inner = F.aggregate(F.sequence(F.lit(1), F.lit(GROUP)), opened, step)
        return F.aggregate(
            F.array(inner), now,
            lambda old, new: F.struct(new["body"].alias("body"), new["at"].alias("at"), F.concat(old["parts"], F.array(joined(new["parts"]))).alias("parts"), new["ended"].alias("ended")),
        )

    done = F.aggregate(F.sequence(F.lit(1), F.ceil(most / GROUP).cast("int")), start, lambda now, i: F.when(now["ended"], now).otherwise(group(now, i)))
    return F.aggregate(F.array(done), F.lit(None).cast("string"), lambda _, d: F.when(d["ended"] & d["body"].isNotNull(), joined(d["parts"]).cast("string")))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record: warc_type, record_id, concurrent_to, refers_to, uri, date, content_type, payload_digest, block, payload, whole.

    payload is a response's body, whole tells whether the block has the length that its header gives. Text before the first
    record is skipped.
    """
    raw = spark.read.option("lineSep", _SEPARATOR).text(path).where(F.col("value") != "")
    at = F.instr("value", CRLF * 2)
    split = raw.where(at > 0).select(F.expr(r"substring(value, 1, instr(value, '\r\n\r\n') - 1)").alias("head"), F.expr(r"substring(value, instr(value, '\r\n\r\n') + 4)").alias("rest"))
    cut = F.when(F.endswith("rest", F.lit(CRLF * 2)), F.expr("substring(rest, 1, length(rest) - 4)")).otherwise(F.col("rest"))
    rows = split.select(
        F.lower(_field(F.col("head"), "WARC-Type")).alias("warc_type"), _field(F.col("head"), "WARC-Record-ID").alias("record_id"),
        _field(F.col("head"), "WARC-Concurrent-To").alias("concurrent_to"), _field(F.col("head"), "WARC-Refers-To").alias("refers_to"),
        _field(F.col("head"), "WARC-Target-URI").alias("uri"), _field(F.col("head"), "WARC-Date").alias("date"),
        _field(F.col("head"), "Content-Type").alias("content_type"), _field(F.col("head"), "WARC-Payload-Digest").alias("payload_digest"),
        _field(F.col("head"), "Content-Length").try_cast("long").alias("length"), cut.alias("block"),
    )
    http = F.expr(r"substring(block, 1, instr(block, '\r\n\r\n'))")
    body = F.expr(r"substring(block, instr(block, '\r\n\r\n') + 4)")
    chunked = http.rlike(r"(?im)^Transfer-Encoding:[ \t]*chunked[ \t]*\r?$")
    payload = F.when(F.col("warc_type") == "response", F.when(chunked, _dechunked(body)).otherwise(body))
    return rows.select("*", payload.alias("payload"), (F.octet_length("block") == F.col("length")).alias("whole")).drop("length")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: capture_id, request, response (a response or revisit), metadata (an array).

    Requests and metadata meet the response that they name as concurrent: a full join of the three kinds on its record id, in
    one shuffle of one scan. A capture without one of the kinds has null there, or an empty array; of several requests or
    responses under one id the least counts. Records without any id are left out.
    """
    named = records.withColumn("capture_id", F.coalesce("concurrent_to", "record_id")).where(F.col("capture_id").isNotNull())
    kind = F.col("warc_type")
    whole = F.struct(*[c for c in records.columns])
    small = F.struct(*[c for c in records.columns if c not in ("payload",)])
    return named.groupBy("capture_id").agg(
        F.min(F.when(kind == "request", small)).alias("request"),
        F.min(F.when(kind.isin("response", "revisit"), whole)).alias("response"),
        F.array_sort(F.collect_list(F.when(kind == "metadata", small))).alias("metadata"),
    )


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """A row for each page; a record that isn't whole, or a capture without a response, is an error rather than a lost page."""
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    records = read_warc(spark, path)
    kind = F.when(F.coalesce(F.col("whole"), F.lit(False)), F.col("warc_type")).otherwise(F.raise_error(F.concat(F.lit("not whole: "), F.coalesce("record_id", F.lit("a record")))))
    # what the digest columns need of a record, so that payloads don't take part in the shuffle
    slim = records.select(
        kind.alias("warc_type"), "record_id", "concurrent_to", "refers_to",
        F.when(F.col("warc_type") == "response", F.octet_length("payload")).otherwise(F.regexp_extract("block", r"payload-length: (\d+)", 1).try_cast("long")).alias("payload_bytes"),
        F.when(F.col("warc_type") == "response", F.sha2(F.col("payload").cast("binary"), 256)).otherwise(F.regexp_replace("payload_digest", "^sha256:", "")).alias("payload_digest"),
    )
    got = F.when(F.col("response.warc_type").isNotNull(), F.col("response.warc_type")).otherwise(F.raise_error(F.concat(F.lit("no response: "), "capture_id")))
    return assemble(slim).select(
        page_of(F.col("capture_id")).alias("page_id"),
        F.when(F.col("response.warc_type") == "response", F.col("response.payload_bytes")).otherwise(F.get("metadata", F.lit(0))["payload_bytes"]).cast("long").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        got.alias("record_type"),
        page_of(F.col("response.refers_to")).alias("refers_to"),
    )


OP3_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), f AS (
  SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest
)
SELECT p.page_id, p.n::BIGINT AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN f.first IS NOT NULL AND f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest AND p.n >= 100
"""
