"""WARC derivatives: metadata and plain-text conversion records from responses.

``responses`` dresses crawled pages as response records (headers, payload,
digest); ``derive`` turns response records into one ``metadata`` record (format
``application/warc-fields``: title, status, sizes, outlinks) and one
``conversion`` record (the page as plain text) each. Both refer to their source
by WARC-Refers-To and keep its target URI, date, HTTP headers and digest;
record ids are derived from the source's, so a rerun writes the same ones.
``serialized`` gives the bytes of a WARC file's record.

How it scales: column expressions only, one pass, no shuffle; a record is
derived where its response lies.

Cases: a null html or block is an empty one; a null url is left out of the
headers; a null page_id is ``null`` in the id; repeated pages give repeated
records with equal ids; empty tables give empty results; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
# Elements that end a line of text, and named characters (the ampersand last).
BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
NAMED = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
HIDDEN = r"(?is)<(?:!--.*?-->|script\b.*?</script\s*>|style\b.*?</style\s*>|!doctype[^>]*>)"
LINK = r"(?is)<a\s[^>]*?href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
TITLE = r"(?is)<title[^>]*>(.*?)</title"


def record_id(*parts: Column) -> Column:
    """A urn:uuid from the md5 of the parts."""
    text = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    pieces = [F.substring(text, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def unescaped(text: Column) -> Column:
    """Named, decimal and hexadecimal character references as characters; most texts have none."""
    plain = text
    codes = F.array_distinct(F.regexp_extract_all(text, F.lit("&#([0-9]{1,6}|[xX][0-9a-fA-F]{1,5});"), F.lit(1)))
    number = lambda c: F.when(F.lower(F.left(c, F.lit(1))) == "x", F.conv(F.substring(c, 2, 5), 16, 10)).otherwise(c).cast("int")
    valid = F.filter(codes, lambda c: (number(c) < 0xD800) & (number(c) > 0) & (number(c) != 38))
    char = lambda c: F.decode(F.unhex(F.lpad(F.hex(number(c).cast("long")), 8, "0")), "UTF-32")
    text = F.when(F.contains(plain, F.lit("&#")), F.aggregate(valid, text, lambda acc, c: F.replace(acc, F.concat(F.lit("&#"), c, F.lit(";")), char(c)))).otherwise(text)
    for name, value in NAMED:
        text = F.replace(text, F.lit(name), F.lit(value))
    return F.when(F.contains(plain, F.lit("&")), text).otherwise(plain)


def without_tags(html: Column) -> Column:
    """The text of a page without scripts, styles, comments or tags, one line per block."""
    text = F.regexp_replace(html, HIDDEN, " ")
    text = F.regexp_replace(text, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n")
    return F.regexp_replace(text, r"<[/a-zA-Z][^>]*>", "")


def tidy(text: Column) -> Column:
    """Runs of space as one, a single space being left alone; no blank lines, no space at either end."""
    text = F.regexp_replace(text, r"[\t\r\f][ \t\r\f]*| [ \t\r\f]+", " ")
    return F.btrim(F.regexp_replace(text, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of pages: record_id, target_uri, date, http_headers, payload, payload_digest."""
    payload = F.coalesce("html", F.lit(""))
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(CRLF))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), record_id(F.lit("response"), F.col("page_id"), F.col("url")).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit(date).alias("date"), headers.alias("http_headers"), payload.alias("payload"), digest(payload).alias("payload_digest"),
    )


def unquoted(value: Column) -> Column:
    return F.when(F.left(value, F.lit(1)).isin('"', "'"), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def fields(html: Column, headers: Column, text: Column, payload_digest: Column) -> Column:
    """The block of a metadata record, one ``name: value`` a line."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    title = F.regexp_replace(unescaped(F.regexp_extract(html, TITLE, 1)), r"\s+", " ")
    links = F.transform(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)), lambda x: line("outlink", unescaped(unquoted(x))))
    return F.concat(
        line("title", title), line("http-status", F.regexp_extract(headers, r"^HTTP/[0-9.]+ ([0-9]{3})", 1)),
        line("http-content-type", F.regexp_extract(headers, r"(?i)\ncontent-type: ([^\r\n]*)", 1)), line("source-payload-digest", payload_digest),
        line("payload-length", F.octet_length(html).cast("string")), line("text-length", F.length(text).cast("string")), F.array_join(links, ""),
    )


def derive(source: DataFrame) -> DataFrame:
    """Two records per response: metadata and conversion, linked to it.

    page_id, warc_type, record_id, refers_to, target_uri, date, content_type,
    content_length (bytes), block_digest, source_headers, source_digest, block.
    """
    html = F.coalesce("payload", F.lit(""))
    # Columns of their own, since each is used several times: the text is taken out once.
    rows = source.withColumn("payload", html).withColumn("bare", without_tags(F.col("payload"))).withColumn("text", tidy(unescaped(F.col("bare"))))
    block = fields(F.col("payload"), F.coalesce("http_headers", F.lit("")), F.col("text"), F.coalesce("payload_digest", F.lit("")))
    made = lambda kind, mime, body: F.struct(F.lit(kind).alias("warc_type"), F.lit(mime).alias("content_type"), body.alias("block"))
    records = F.array(made("metadata", "application/warc-fields", block), made("conversion", "text/plain", F.col("text")))
    rows = rows.select("page_id", "record_id", "target_uri", "date", "http_headers", "payload_digest", F.inline(records))
    return rows.select(
        "page_id", "warc_type", record_id(F.col("record_id"), F.col("warc_type")).alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri", "date",
        "content_type", F.octet_length("block").cast("long").alias("content_length"), digest(F.col("block")).alias("block_digest"),
        F.col("http_headers").alias("source_headers"), F.col("payload_digest").alias("source_digest"), "block",
    )


def serialized(records: DataFrame) -> DataFrame:
    """(record_id, record): each derived record as it stands in a WARC file."""
    header = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))
    record = F.concat(
        F.lit("WARC/1.0" + CRLF), header("WARC-Type", F.col("warc_type")), header("WARC-Record-ID", F.col("record_id")), header("WARC-Refers-To", F.col("refers_to")),
        header("WARC-Target-URI", F.col("target_uri")), header("WARC-Date", F.col("date")), header("WARC-Block-Digest", F.col("block_digest")),
        header("Content-Type", F.col("content_type")), header("Content-Length", F.col("content_length").cast("string")), F.lit(CRLF), F.col("block"), F.lit(CRLF * 2),
    )
    return records.select("record_id", record.alias("record"))


def _unescaped_sql(text: str) -> str:
    for name, value in NAMED:
        text = f"replace({text}, '{name}', '{value.replace(chr(39), chr(39) * 2)}')"
    return text


def oracle_sql() -> str:
    uuid = lambda parts: f"regexp_replace(md5({parts}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '<urn:uuid:\\1-\\2-\\3-\\4-\\5>')"
    crlf = "chr(13) || chr(10)"
    text = f"regexp_replace(coalesce(html, ''), '{HIDDEN}', ' ', 'g')"
    text = f"regexp_replace({text}, '(?i)</?(?:{BLOCKS})\\b[^>]*>', chr(10), 'g')"
    text = _unescaped_sql(f"regexp_replace({text}, '<[/a-zA-Z][^>]*>', '', 'g')")
    text = f"regexp_replace({text}, '[ \\t\\r\\f]+', ' ', 'g')"
    text = f"regexp_replace(regexp_replace({text}, ' ?\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"
    title = f"regexp_replace({_unescaped_sql(f"regexp_extract(payload, '{TITLE}', 1)")}, '\\s+', ' ', 'g')"
    # Attribute values in double quotes, in single quotes, or bare.
    href = """(?is)<a[[:space:]][^>]*?href[[:space:]]*=[[:space:]]*("[^"]*"|''[^'']*''|[^[:space:]"''>]+)"""
    value = "CASE WHEN left(x, 1) IN (chr(34), chr(39)) THEN substr(x, 2, length(x) - 2) ELSE x END"
    links = f"array_to_string(list_transform(regexp_extract_all(payload, '{href}', 1), lambda x: 'outlink: ' || {_unescaped_sql(value)} || {crlf}), '')"
    return f"""
WITH responses AS (
  SELECT page_id, {uuid("'response|' || coalesce(page_id::VARCHAR, 'null') || '|' || coalesce(url, 'null')")} AS response_id, url AS target_uri,
    coalesce(html, '') AS payload, 'sha256:' || sha256(coalesce(html, '')) AS payload_digest,
    'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || strlen(coalesce(html, '')) || {crlf} AS headers,
    {text} AS text
  FROM pages
), blocks AS (
  SELECT *, 'title: ' || {title} || {crlf} || 'http-status: 200' || {crlf} || 'http-content-type: text/html; charset=utf-8' || {crlf}
    || 'source-payload-digest: ' || payload_digest || {crlf} || 'payload-length: ' || strlen(payload) || {crlf}
    || 'text-length: ' || length(text) || {crlf} || {links} AS fields
  FROM responses
), records AS (
  SELECT *, 'metadata' AS warc_type, 'application/warc-fields' AS content_type, fields AS block FROM blocks
  UNION ALL SELECT *, 'conversion', 'text/plain', text FROM blocks
)
SELECT page_id, warc_type, {uuid("response_id || '|' || warc_type")} AS record_id, response_id AS refers_to, target_uri, '1970-01-01T00:00:00Z' AS date,
  content_type, strlen(block)::BIGINT AS content_length, 'sha256:' || sha256(block) AS block_digest, headers AS source_headers, payload_digest AS source_digest, block
FROM records
"""
