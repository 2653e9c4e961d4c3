"""WARC derivatives: from each response record a linked metadata record and a plain-text conversion record.

Everything is a projection over the responses, so there is no shuffle: one row in, two rows out. Record ids
are derived from the source's id and the record type, so a second run gives the same records. Blocks are
UTF-8 text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is taken out of a page before its text is read, in this order (pattern, replacement).
#: The patterns keep to what Java's and RE2's syntax share.
TEXT_STEPS = (
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<script\b[^>]*>.*?</script\s*>", ""),
    (r"(?is)<style\b[^>]*>.*?</style\s*>", ""),
    (r"(?is)<head\b[^>]*>.*?</head\s*>", ""),
    (r"(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|section|article|nav|header|footer|main|aside|pre|blockquote|form)\b[^>]*>", "\n"),
    (r"<[^>]*>", ""),
    (r"&nbsp;", " "),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&#39;|&apos;", "'"),
    (r"&amp;", "&"),
    (r"[ \t\r\f]+", " "),
    (r" ?\n[ \n]*", "\n"),
    (r"^[ \n]+|[ \n]+$", ""),
)
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
LANG = r"(?i)<html[^>]*\blang=[\"']?([A-Za-z-]+)"
LINK = r"(?i)<a\s[^>]*href="
#: The crawl date of pages that carry none.
DATE = "2024-01-01T00:00:00Z"
_CRLF = "\r\n"


def uuid_of(*parts: Column) -> Column:
    """A urn:uuid from the MD5 of the parts."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("urn:uuid:"), *(
        x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]
    ))


def plain_text(html: Column) -> Column:
    for pattern, by in TEXT_STEPS:
        if re.fullmatch(r"[&;a-z]+", pattern):  # plain characters need no pattern, and no copy of texts without them
            html = F.replace(html, F.lit(pattern), F.lit(by))
            continue
        html = F.regexp_replace(html, F.lit(pattern), F.lit(by.replace("\\", "\\\\").replace("$", "\\$")))
    return html


def responses_from_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = DATE) -> DataFrame:
    """Response records of a table of pages: page_id, record_id, target_uri, date, http_headers, payload, payload_digest.

    A null url or page is an empty one. A record's id follows from page_id, url and payload digest: captures of one url that
    differ have ids of their own, repeated pages give equal records. An empty table gives none.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    digest = F.concat(F.lit("sha256:"), F.sha2(payload, 256))
    uri = F.coalesce(F.col(url), F.lit(""))
    return pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        uuid_of(F.lit("response"), F.coalesce(F.col(page_id).cast("string"), F.lit("")), uri, digest).alias("record_id"),
        uri.alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(
            F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit(_CRLF)
        ).alias("http_headers"),
        payload.alias("payload"),
        digest.alias("payload_digest"),
    )


def derive(responses: DataFrame) -> DataFrame:
    """Two records of each response: ``metadata`` and ``conversion``.

    Columns: those of the response but its payload, record_type, record_id (new), refers_to (the source's
    id), headers (array of "Name: value"), block, block_digest. Source headers, target, date and payload
    digest go on as they are. A page without text gives an empty conversion block.
    """
    kept = [c for c in responses.columns if c not in ("record_id", "payload", "record_type", "refers_to", "block")]
    text = plain_text(F.col("payload"))
    meta = F.concat(
        F.lit("title: "), F.trim(F.regexp_replace(F.regexp_extract("payload", TITLE, 1), r"[ \t\r\n]+", " ")),
        F.lit("\r\nlanguage: "), F.regexp_extract("payload", LANG, 1),
        F.lit("\r\noutlinks: "), F.regexp_count("payload", F.lit(LINK)).cast("string"),
        F.lit("\r\nhttp-headers: "), F.regexp_replace(F.trim(F.regexp_replace("http_headers", r"\r\n", " | ")), r" \|$", ""),
        F.lit(_CRLF),
    )
    both = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), meta.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), text.alias("block")),
    )
    rows = responses.select(*kept, F.col("record_id").alias("refers_to"), F.explode(both).alias("r"))
    rows = rows.select(
        *kept, "refers_to", "r.*", uuid_of(F.col("r.record_type"), F.col("refers_to")).alias("record_id"),
        F.concat(F.lit("sha256:"), F.sha2(F.col("r.block"), 256)).alias("block_digest"),
    )
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c)
    headers = F.array(
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Refers-To", F.concat(F.lit("<"), F.col("refers_to"), F.lit(">"))),
        line("WARC-Refers-To-Target-URI", F.col("target_uri")),
        line("WARC-Refers-To-Date", F.col("date")),
        line("WARC-Source-Payload-Digest", F.col("payload_digest")),
        line("WARC-Block-Digest", F.col("block_digest")),
        line("Content-Type", F.col("content_type")),
        line("Content-Length", F.octet_length("block").cast("string")),
    )
    return rows.withColumn("headers", headers)


def serialise(records: DataFrame) -> DataFrame:
    """One column ``value``: each record in WARC/1.1 form up to the last line end, which the writer adds."""
    return records.select(
        F.concat(F.lit("WARC/1.1\r\n"), F.array_join("headers", _CRLF), F.lit("\r\n\r\n"), F.col("block"), F.lit(_CRLF)).alias("value")
    )


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    serialise(records).write.option("lineSep", _CRLF).option("compression", compression).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files of UTF-8 text: record_type, record_id, refers_to, target_uri, date, headers, block, whole.

    Records are split where one ends and the next begins; ``whole`` tells whether the block has the length
    that its header states.
    """
    raw = spark.read.option("lineSep", "\r\n\r\nWARC/1.1\r\n").text(path)
    body = F.regexp_replace("value", r"^WARC/1\.1\r\n", "")
    parts = raw.select(body.alias("body")).select(
        F.expr("substring(body, 1, instr(body, '\\r\\n\\r\\n') - 1)").alias("head"), F.expr("substring(body, instr(body, '\\r\\n\\r\\n') + 4)").alias("block")
    ).where(F.col("head") != "")
    value = lambda name: F.regexp_extract("head", rf"(?m)^{name}: ([^\r\n]*)", 1)
    size = value("Content-Length").cast("int")
    # the last record of a file still has its closing line ends
    block = F.when(F.octet_length("block") > size, F.regexp_replace("block", r"\r\n\r\n$", "")).otherwise(F.col("block"))
    return parts.select(
        value("WARC-Type").alias("record_type"),
        F.regexp_replace(value("WARC-Record-ID"), "[<>]", "").alias("record_id"),
        F.regexp_replace(value("WARC-Refers-To"), "[<>]", "").alias("refers_to"),
        value("WARC-Target-URI").alias("target_uri"),
        value("WARC-Date").alias("date"),
        F.split("head", _CRLF).alias("headers"),
        block.alias("block"),
        (F.octet_length(block) == size).alias("whole"),
    )
