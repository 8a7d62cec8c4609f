"""WARC derivatives: responses to linked metadata and plain-text conversion records.

A derivative names the response it was made from (WARC-Refers-To), keeps its address, date,
HTTP headers and payload digest, and has digests of its own. All of it is column
expressions within a row, but for character references, which one Arrow pass decodes;
files are written and read with the text source.
"""

from __future__ import annotations

import functools
import html as markup
import re
from html import entities

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"

# Elements without text of their own, elements that break lines.
SILENT = ["script", "style", "noscript", "template"]
BREAKING = "p|div|br|h[1-6]|li|ul|ol|tr|table|article|section|nav|title|head|body|html|header|footer|blockquote|pre"

UNSEEN = "(?is)<!--.*?-->|" + "|".join(rf"<{e}\b.*?</{e}\s*>" for e in SILENT)
BREAKS = rf"(?i)</?(?:{BREAKING})\b[^>]*>"
TAGS = "<[^>]*>"
TITLE = "(?is)<title[^>]*>(.*?)</title>"
LINK = r'(?i)<a\s[^>]*?href="([^"]*)"'


REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
NUMBERS = [*range(160), *range(0xFDD0, 0xFDF0), *[plane << 16 | last for plane in range(17) for last in (0xFFFE, 0xFFFF)]]
"""Code points whose numeric references may stand for another character, or for none."""


@functools.lru_cache(4096)
def _character(reference: str) -> str:
    return markup.unescape(reference).replace("\xa0", " ")


def decoded(text: str) -> str:
    """Named, decimal and hex character references as HTML reads them, each decoded once; a no-break space is a space."""
    return REFERENCE.sub(lambda found: _character(found[0]), text)


def _decode_all(texts: pa.Array) -> pa.Array:
    return pa.array([t and decoded(t) for t in texts.to_pylist()], pa.string())


def plain_text(html: Column) -> Column:
    """The readable text of a page: no comments, scripts, tags or references; one line per block, single spaces."""
    text = F.arrow_udf(_decode_all, "string")(F.regexp_replace(F.regexp_replace(F.regexp_replace(html, UNSEEN, " "), BREAKS, "\n"), TAGS, ""))
    text = F.regexp_replace(text, r"[ \t\r\f]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r" ?\n[ \n]*", "\n"), r"^\n|\n$", ""))


def _uuid(*what: Column) -> Column:
    h = F.md5(F.concat_ws("|", *what))
    cuts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _digest(what: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(what.cast("binary"), 256))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Pages as response records: key, record_id, target_uri, warc_date, http_headers, body.

    A null page is an empty body, a null address an empty one; repeated rows give repeated records.
    """
    body, uri = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    headers = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF)
    )
    key = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").alias("key"), _uuid(F.lit("response"), key, uri).alias("record_id"), uri.alias("target_uri"),
        F.lit(date).alias("warc_date"), headers.alias("http_headers"), body.alias("body"),
    )


def derive(records: DataFrame) -> DataFrame:
    """Two rows per response: its metadata (application/warc-fields) and its conversion (text/plain)."""
    flat = F.regexp_replace(F.trim(F.regexp_extract("body", TITLE, 1)), r"\s+", " ")
    links = F.transform(F.regexp_extract_all("body", F.lit(LINK), F.lit(1)), lambda x: F.concat(F.lit("outlink: "), F.regexp_replace(x, r"\s+", " "), F.lit(CRLF)))
    source = F.transform(F.filter(F.split("http_headers", CRLF), lambda h: h != ""), lambda h: F.concat(F.lit("source-header: "), h, F.lit(CRLF)))
    fields = F.concat(
        F.lit("title: "), flat, F.lit(CRLF), F.lit("source-digest: "), F.col("payload_digest"), F.lit(CRLF),
        F.concat_ws("", source), F.concat_ws("", links),
    )

    def record(kind: str, content: str, block: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("warc_type"),
            _uuid(F.lit(kind), F.col("record_id")).alias("record_id"),
            F.lit(content).alias("content_type"),
            block.alias("block"),
        )

    both = F.array(record("metadata", "application/warc-fields", fields), record("conversion", "text/plain; charset=utf-8", plain_text(F.col("body"))))
    digested = records.withColumn("payload_digest", _digest(F.col("body")))
    made = digested.select("key", "record_id", "target_uri", "warc_date", "http_headers", "payload_digest", F.explode(both).alias("made"))
    return made.select(
        "key", F.col("made.warc_type").alias("warc_type"), F.col("made.record_id").alias("record_id"), F.col("record_id").alias("refers_to"),
        "target_uri", "warc_date", F.col("made.content_type").alias("content_type"), "http_headers", "payload_digest",
        _digest(F.col("made.block")).alias("block_digest"), F.octet_length("made.block").alias("content_length"), F.col("made.block").alias("block"),
    )


def _head() -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Refers-To", F.col("refers_to")), line("WARC-Target-URI", F.col("target_uri")), line("WARC-Date", F.col("warc_date")),
        line("WARC-Block-Digest", F.col("block_digest")), line("WARC-Source-Payload-Digest", F.col("payload_digest")),
        line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")), F.lit(CRLF),
    )


def write(derived: DataFrame, path: str) -> None:
    """One compressed WARC file per task."""
    text = derived.select(F.concat(_head(), F.col("block")).alias("value"))
    text.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: header fields as a map, and the block.

    A file is cut where a record begins; a block may hold blank lines, but not that mark.
    """
    mark = f"{CRLF}{CRLF}WARC/1.1{CRLF}"
    whole = spark.read.option("lineSep", mark).text(path).where("value <> ''")
    text = F.regexp_replace("value", r"^WARC/1\.1\r\n", "")
    head, at = F.substring_index(text, CRLF + CRLF, 1), F.locate(CRLF + CRLF, text)
    fields = F.str_to_map(head, F.lit(CRLF), F.lit(": "))
    rows = whole.select(fields.alias("fields"), F.substr(text, at + 4).alias("rest"))
    size = F.col("fields")["Content-Length"].cast("int")
    return rows.select("fields", F.decode(F.substr(F.encode("rest", "utf-8"), F.lit(1), size), "utf-8").alias("block"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_map(pairs: dict) -> str:
    return f"MAP([{', '.join(map(str, pairs))}], [{', '.join(_sql_text(v) for v in pairs.values())}])"


def _sql_decoded() -> str:
    """SQL for the character that the reference ``t`` stands for: the HTML names, and the numbers by their rule."""
    names = _sql_map({_sql_text(name): chars for name, chars in entities.html5.items()})
    numbers = {n: markup.unescape(f"&#{n};") for n in NUMBERS}
    odd = _sql_map({n: chars for n, chars in numbers.items() if chars != chr(n)})
    return f"""
        decoded AS (
            SELECT t, body, n, CASE
                WHEN t[2] = '#' AND n IS NULL THEN chr(65533)
                WHEN t[2] = '#' AND len(map_extract(odd, n)) > 0 THEN map_extract(odd, n)[1]
                WHEN t[2] = '#' AND (n > 1114111 OR n BETWEEN 55296 AND 57343) THEN chr(65533)
                WHEN t[2] = '#' THEN chr(CAST(n AS INTEGER))
                WHEN len(map_extract(names, body)) > 0 THEN map_extract(names, body)[1]
                WHEN len(short) > 0 THEN map_extract(names, short[1])[1] || body[len(short[1]) + 1:]
                ELSE t END AS found
            FROM (
                SELECT t, t[2:] AS body, names, odd,
                    CASE WHEN lower(t[3]) = 'x' THEN TRY_CAST('0x' || right(ltrim(rtrim(t[4:], ';'), '0'), 12) AS BIGINT) + CASE WHEN len(ltrim(rtrim(t[4:], ';'), '0')) > 12 THEN 1114112 ELSE 0 END
                        WHEN t[2] = '#' THEN TRY_CAST(rtrim(t[3:], ';') AS BIGINT) END AS number,
                    CASE WHEN t[2] = '#' AND lower(t[3]) = 'x' AND ltrim(rtrim(t[4:], ';'), '0') = '' THEN 0 ELSE number END AS n,
                    list_filter(list_transform(range(len(t) - 2, 1, -1), lambda x: t[2:x + 1]), lambda x: len(map_extract(names, x)) > 0) AS short
                FROM (SELECT DISTINCT unnest(tokens) AS t FROM tokens), (SELECT {names} AS names, {odd} AS odd)
                WHERE t[1] = '&' AND t <> '&'
            )
        )"""


def oracle_sql(date: str = DATE) -> str:
    """The derivatives of ``pages`` in plain SQL."""
    uuid = (
        "'<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>'"
    )
    bare = f"regexp_replace(regexp_replace(regexp_replace(body, '{UNSEEN}', ' ', 'g'), '{BREAKS}', chr(10), 'g'), '{TAGS}', '', 'g')"
    text = "regexp_replace(flat, '[ \\t\\r\\f]+', ' ', 'g')"
    text = f"trim(regexp_replace(regexp_replace({text}, ' ?\\n[ \\n]*', chr(10), 'g'), '^\\n|\\n$', '', 'g'))"
    crlf = "chr(13) || chr(10)"
    return f"""
    WITH source AS (
        SELECT row_number() OVER () AS page, page_id AS key, coalesce(url, '') AS target_uri, coalesce(html, '') AS body,
            md5(concat_ws('|', 'response', coalesce(CAST(page_id AS VARCHAR), ''), coalesce(url, ''))) AS h FROM pages
    ), response AS (
        SELECT page, key, target_uri, body, {uuid} AS refers_to, 'sha256:' || sha256(body) AS payload_digest,
            'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || strlen(body) || {crlf} AS http_headers
        FROM source
    ), tokens AS (
        SELECT page, regexp_extract_all({bare}, '{REFERENCE.pattern}|[^&]+|&') AS tokens FROM source
    ), {_sql_decoded()}, flat AS (
        SELECT page, coalesce(string_agg(coalesce(replace(found, chr(160), ' '), token), '' ORDER BY place), '') AS flat
        FROM (SELECT page, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM tokens) LEFT JOIN decoded ON token = t GROUP BY page
    ), made AS (
        SELECT *, 'metadata' AS warc_type, 'application/warc-fields' AS content_type,
            'title: ' || regexp_replace(trim(regexp_extract(body, '{TITLE}', 1)), '\\s+', ' ', 'g') || {crlf} || 'source-digest: ' || payload_digest || {crlf}
            || array_to_string(list_transform(list_filter(string_split(http_headers, {crlf}), lambda x: x <> ''), lambda x: 'source-header: ' || x || {crlf}), '')
            || coalesce(array_to_string(list_transform(regexp_extract_all(body, '{LINK}', 1), lambda x: 'outlink: ' || regexp_replace(x, '\\s+', ' ', 'g') || {crlf}), ''), '') AS block
        FROM response
        UNION ALL
        SELECT response.*, 'conversion', 'text/plain; charset=utf-8', coalesce({text}, '') FROM response LEFT JOIN flat USING (page)
    ), named AS (SELECT *, md5(concat_ws('|', warc_type, refers_to)) AS h FROM made)
    SELECT key AS page_id, warc_type, {uuid} AS record_id, refers_to, target_uri, '{date}' AS warc_date, content_type, http_headers, payload_digest,
        'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS INTEGER) AS content_length, block
    FROM named
    """
