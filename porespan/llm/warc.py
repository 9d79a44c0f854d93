"""WARC derivatives: metadata and plain-text conversion records from response records (operator 1)."""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE32, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
CRLF = "\r\n"
RESPONSE = "record_id string, target_uri string, warc_date string, http_header string, payload string, payload_digest string, block_digest string, payload_length long"
#: Date of records made from tables that have none, so that reruns agree.
NO_DATE = "1970-01-01T00:00:00Z"


def digest(block: Column) -> Column:
    """``sha1:`` and the base-32 SHA-1 of a string's UTF-8 bytes, as WARC headers have it."""
    hexed = F.sha1(block.cast("binary"))
    # forty bits at a time in Spark's own 32 digits; no lambda, in which the block would be hashed for each part
    parts = [F.lpad(F.conv(F.substring(hexed, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.concat(F.lit("sha1:"), F.translate(F.concat(*parts), DIGITS, BASE32))


def urn(*parts: Column) -> Column:
    """A record id made from the parts, the same on each run."""
    h = F.md5(F.concat_ws("\n", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def responses_from_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Response records of a table of crawled pages. Null urls and pages are taken as empty strings."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return pages.select(
        F.col(page_id),
        urn(F.lit("response"), text(page_id), text(url)).alias("record_id"),
        text(url).alias("target_uri"),
        F.lit(NO_DATE).alias("warc_date"),
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}").alias("http_header"),
        text(html).alias("payload"),
    )


#: Removed or replaced, in this order; patterns are read alike by Java and RE2.
STEPS = (
    (r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>", " "),
    (r"(?i)<(?:br|/p|/div|/li|/ul|/ol|/tr|/table|/h[1-6]|/article|/section|/nav|/header|/footer|/title|/blockquote|/pre)\b[^>]*>", "\n"),
    (r"<[A-Za-z/!?][^>]*>", ""),
)
#: The named character references that are decoded, the ampersand last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))
#: Fixed value: stands for numeric references that name no character.
NO_CHARACTER = "\ufffd"
SPACES = ((r"[ \t\r\x0b\x0c]*\n[ \t\r\n\x0b\x0c]*", "\n"), (r"[ \t\r\x0b\x0c]+", " "))


def numeric_references(text: Column) -> Column:
    """The text with decimal and hexadecimal character references decoded, those that have their semicolon."""

    def decoded(part: Column) -> Column:
        number = F.regexp_extract(part, r"^([0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});", 1)
        value = F.when(F.lower(F.substring(number, 1, 1)) == "x", F.conv(F.substring(number, F.lit(2), F.lit(6)), 16, 10)).otherwise(number).cast("long")
        fits = (value > 0) & (value < 0x110000) & ~value.between(0xD800, 0xDFFF)
        char = F.when(fits, F.decode(F.unhex(F.lpad(F.hex(value), 8, "0")), "UTF-32")).otherwise(F.lit(NO_CHARACTER))
        return F.when(number == "", F.concat(F.lit("&#"), part)).otherwise(F.concat(char, F.substring(part, F.length(number) + 2, F.length(part))))

    parts = F.split(text, "&#")
    return F.when(F.contains(text, F.lit("&#")), F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), decoded), ""))).otherwise(text)


def without_tags(html: Column) -> Column:
    """The first part of ``plain_text``: the page without tags, with its named references but the ampersand's decoded."""
    out = html
    for pattern, by in STEPS:
        out = F.regexp_replace(out, pattern, by)
    for name, char in ENTITIES[:-1]:
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def as_lines(text: Column) -> Column:
    """The second part: the other references decoded, blanks and empty lines collapsed. It reads ``text`` more than once."""
    out = F.replace(numeric_references(text), *map(F.lit, ENTITIES[-1]))
    for pattern, by in SPACES:
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out, F.lit(" \n"))


def plain_text(html: Column) -> Column:
    """The text of a page: comments, scripts and styles go, block ends become line ends, tags go, references are decoded,
    blanks and empty lines collapse. Unclosed tags stay as text."""
    return as_lines(without_tags(html))


def header_value(header: Column, name: str) -> Column:
    """A field of an HTTP header block, without blanks around it; null where there is none. The first one counts."""
    got = F.regexp_extract(header, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(got == "", None).otherwise(got)


def derive(responses: DataFrame) -> DataFrame:
    """Two records for each response: ``metadata`` and, linked to the same source, ``conversion`` to plain text.

    ``responses`` has record_id, target_uri, warc_date, http_header and payload, and may have payload_digest, block_digest and
    payload_length of the source as it was recorded: these are kept as they are, and computed from the payload only where they are null
    or missing. Further columns stay, but those named like an output. Both records refer to the response's identifier, target and date. The metadata block
    (application/warc-fields) keeps the source's headers, digests and length and names the conversion; the conversion
    block is the text, of null or empty payloads the empty one. Output: record_type, record_id, refers_to,
    target_uri, warc_date, content_type, content_length, block_digest, payload_digest (the source's payload), block and
    header. Identifiers derive from the source's, so reruns and repeated rows give equal records.
    """
    made = ["record_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "content_length", "block_digest", "payload_digest", "block", "header"]
    source = ["record_id", "target_uri", "warc_date", "http_header", "payload"]
    own = [c for c in responses.columns if c not in made and c not in source]
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    given = lambda c, kind: F.col(c).cast(kind) if c in responses.columns else F.lit(None).cast(kind)
    recorded = (given("payload_digest", "string").alias("_pd"), given("block_digest", "string").alias("_bd"), given("payload_length", "long").alias("_pl"))
    s = responses.select(*[c for c in own if c != "payload_length"], *[text(c).alias(f"_{c}") for c in source], *recorded)
    own = [c for c in own if c != "payload_length"]
    whole = F.concat("_http_header", F.lit(CRLF), "_payload")
    s = s.select("*", F.coalesce("_pd", digest(F.col("_payload"))).alias("_payload_digest"), F.coalesce("_bd", digest(whole)).alias("_source_digest"), without_tags(F.col("_payload")).alias("_raw"), urn(F.lit("conversion"), F.col("_record_id")).alias("_conversion"))
    s = s.select("*", as_lines(F.col("_raw")).alias("_text")).drop("_raw")
    status = F.regexp_extract("_http_header", r"^HTTP/[0-9.]+ ([0-9]{3})", 1)
    fields = F.concat(
        F.lit("source-record-id: "), "_record_id", F.lit(CRLF + "conversion-record-id: "), "_conversion", F.lit(CRLF + "source-status: "), status,
        F.lit(CRLF + "source-content-type: "), F.coalesce(header_value(F.col("_http_header"), "Content-Type"), F.lit("")),
        F.lit(CRLF + "source-block-digest: "), "_source_digest", F.lit(CRLF + "source-payload-digest: "), "_payload_digest",
        F.lit(CRLF + "source-payload-length: "), F.coalesce("_pl", F.octet_length("_payload")).cast("string"),
        F.lit(CRLF + "source-header: "), F.regexp_replace(F.regexp_replace("_http_header", r"[\r\n]+$", ""), r"\r\n", "\r\n "), F.lit(CRLF),
    )
    records = F.explode(F.array(
        F.struct(F.lit("metadata").alias("t"), urn(F.lit("metadata"), F.col("_record_id")).alias("i"), F.lit("application/warc-fields").alias("c"), fields.alias("b")),
        F.struct(F.lit("conversion").alias("t"), F.col("_conversion").alias("i"), F.lit("text/plain").alias("c"), F.col("_text").alias("b")),
    ))
    r = s.withColumn("_r", records).select(
        *own, F.col("_r.t").alias("record_type"), F.col("_r.i").alias("record_id"), F.col("_record_id").alias("refers_to"), F.col("_target_uri").alias("target_uri"), F.col("_warc_date").alias("warc_date"),
        F.col("_r.c").alias("content_type"), F.octet_length("_r.b").cast("long").alias("content_length"), digest(F.col("_r.b")).alias("block_digest"), F.col("_payload_digest").alias("payload_digest"), F.col("_r.b").alias("block"),
    )
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit(CRLF))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", "record_type"), line("WARC-Record-ID", "record_id"), line("WARC-Refers-To", "refers_to"),
        line("WARC-Refers-To-Target-URI", "target_uri"), line("WARC-Refers-To-Date", "warc_date"), line("WARC-Target-URI", "target_uri"), line("WARC-Date", "warc_date"),
        line("WARC-Block-Digest", "block_digest"), line("Content-Type", "content_type"), line("Content-Length", "content_length"),
    )
    return r.withColumn("header", header).select(*own, *made)


def write_warc(records: DataFrame, path: str) -> None:
    """Write records as gzipped WARC files, one for each partition: header, empty line, block, two line ends."""
    whole = F.concat("header", F.lit(CRLF), "block")
    records.select(whole.alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


def _records(rows: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records (header fields in lower case, block) of a file cut at each ``WARC/1.``: a block that has these signs itself, and so is
    shorter than its length says, goes on in the next rows."""
    fields, block, length = None, b"", 0
    for row in rows:
        if fields is not None and len(block) < length:
            block += b"WARC/1." + row
            continue
        if fields is not None:
            yield fields, block[:length]
        fields = None
        head, mark, rest = row.partition(b"\r\n\r\n")
        if mark and head[:3] in (b"0\r\n", b"1\r\n"):
            pairs = (x.partition(":") for x in head.decode("utf-8", "replace").split(CRLF)[1:])
            fields, block = {name.strip().lower(): value.strip() for name, _, value in pairs}, rest
            length = int(fields.get("content-length") or 0)
    if fields is not None:
        yield fields, block[:length]


def sha1_digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def body_text(http_header: str, body: bytes) -> str:
    """The text of a response's body: chunks joined, content unpacked (gzip, deflate) and decoded by the charset that the header
    or, in the first 2,048 bytes, the page names; UTF-8 else. What can't be undone stays as it is."""
    fields = {n.strip().lower(): v.strip().lower() for n, _, v in (x.partition(":") for x in http_header.split(CRLF)[1:])}
    if "chunked" in fields.get("transfer-encoding", ""):
        parts, at = [], 0
        while (end := body.find(b"\r\n", at)) >= 0 and re.fullmatch(rb"[0-9A-Fa-f]+", size := body[at:end].split(b";")[0].strip()):
            if not int(size, 16):
                body = b"".join(parts)
                break
            parts.append(body[end + 2 : end + 2 + int(size, 16)])
            at = end + 4 + int(size, 16)
    if (coding := fields.get("content-encoding", "")) in ("gzip", "x-gzip", "deflate"):
        for bits in (47, -15) if coding == "deflate" else (47,):
            with contextlib.suppress(zlib.error):
                body = zlib.decompressobj(bits).decompress(body)
                break
    named = re.search(rb"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", fields.get("content-type", "").encode() + b"\n" + body[:2048])
    with contextlib.suppress(LookupError):
        return body.decode(named[1].decode() if named else "utf-8", "replace")
    return body.decode("utf-8", "replace")


def read_warc(spark: SparkSession, path: str, kind: str = "response") -> DataFrame:
    """Response records (or records of another ``kind``, with the block as payload) of plain or gzipped WARC files, with the digests
    that they have; missing ones, and the payload's length, are of the bytes as recorded, ``payload`` is their text.

    Files are read as a stream of records, not as a whole; files that aren't compressed are read in splits."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64()}
        schema = pa.schema([(n, kinds[t]) for n, t in (f.split() for f in RESPONSE.split(", "))])
        rows, size = [], 0
        for f, block in _records(x for b in batches for x in b.column(0).to_pylist()):
            if f.get("warc-type") != kind:
                continue
            head, mark, body = block.partition(b"\r\n\r\n") if kind == "response" else (b"", b"", block)
            header = head.decode("utf-8", "replace") + CRLF * bool(mark)
            text = body_text(header, body) if kind == "response" else body.decode("utf-8", "replace")
            rows.append((f.get("warc-record-id"), f.get("warc-target-uri"), f.get("warc-date"), header, text, f.get("warc-payload-digest") or sha1_digest(body), f.get("warc-block-digest") or sha1_digest(block), len(body)))
            size += len(block)
            if size > 8 << 20:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    cut = spark.read.option("lineSep", "WARC/1.").text(path)
    return cut.select(F.col("value").cast("binary").alias("value")).mapInArrow(parse, RESPONSE)
