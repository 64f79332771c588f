"""WARC derivatives: responses into linked metadata records and plain-text conversion records.

Every response gives two records that refer to it by its identifier: a metadata record with
its HTTP status, headers, digests, title and links, and a conversion record with its text. Both
name the source's block and payload digest and carry digests of their own. Rows are worked on
where they are read; there is no join and no shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLOCKS = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split()
)
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<hidden>script|style|noscript|template)\b[^>]*>.*?(?:</(?P=hidden)\s*>|\Z)"
    r"""|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?>[^>"']+|"[^"]*"|'[^']*')*+)>"""
    r"|<[/!?a-zA-Z][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
_HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.DOTALL | re.IGNORECASE)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.IGNORECASE)
_BLANKS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r"\s*\n\s*")

RECORD_FIELDS = (
    "record_id string, warc_type string, refers_to string, target_uri string, warc_date string, content_type string, "
    "content_length bigint, block_digest string, source_block_digest string, source_payload_digest string, "
    "source_headers string, block string"
)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def read_page(page: str) -> tuple[str, list[str]]:
    """Text and anchor targets of a page.

    Markup, comments, scripts and styles are gone from the text, and block elements stand on
    lines of their own.
    """
    targets: list[str] = []

    def shown(m: re.Match) -> str:
        name = m["name"]
        if name is None:
            return " "
        name = name.lower()
        if name == "a" and not m["close"]:
            href = _HREF.search(m["attributes"])
            if href:
                targets.append(html.unescape(href[1] or href[2] or href[3] or "").strip())
        return "\n" if name in _BLOCKS else ""

    text = _MARKUP.sub(shown, page)
    text = html.unescape(text).replace("\r", "\n") if "&" in text or "\r" in text else text
    return _LINES.sub("\n", _BLANKS.sub(" ", text)).strip(), targets


def absolute(targets: list[str], base: str | None) -> list[str]:
    """Distinct targets in order, made absolute where possible."""
    found: dict[str, None] = {}
    for target in dict.fromkeys(targets):
        try:
            found[urljoin(base or "", target).replace("\r", "").replace("\n", "")] = None
        except ValueError:
            found[target.replace("\r", "").replace("\n", "")] = None
    return list(found)


def split_response(block: bytes) -> tuple[str, list[str], bytes]:
    """Status line, header lines and body of an HTTP response block."""
    head, gap, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    return (lines[0], [x for x in lines[1:] if x], body) if gap else ("", [], block)


def decoded(body: bytes, headers: list[str]) -> str:
    """The body in the charset that its headers name, UTF-8 else; bad bytes become U+FFFD."""
    kind = next((h for h in headers if h.lower().startswith("content-type:")), "")
    named = _CHARSET.search(kind)
    try:
        return body.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def derivatives(record_id: str | None, uri: str | None, date: str | None, block: bytes | None) -> list[tuple]:
    """The metadata and the conversion record of one response, as rows of ``RECORD_FIELDS``."""
    block = bytes(block or b"")
    record_id = record_id or f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest(block))}>"
    status, headers, body = split_response(block)
    page = decoded(body, headers)
    text, targets = read_page(page)
    sources = (digest(block), digest(body))
    title = _TITLE.search(page)
    fields = [
        f"response: {record_id}",
        f"source-block-digest: {sources[0]}",
        f"source-payload-digest: {sources[1]}",
        f"http-status: {status}",
        *(f"http-header: {h}" for h in headers),
        *([f"title: {' '.join(read_page(title[1])[0].split())}"] if title else []),
        *(f"outlink: {x}" for x in absolute(targets, uri)),
    ]
    made = (
        ("metadata", "application/warc-fields", "".join(f"{x}\r\n" for x in fields)),
        ("conversion", "text/plain; charset=utf-8", text),
    )
    rows = []
    for kind, content_type, content in made:
        data = content.encode("utf-8", "replace")
        own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record_id}#{kind}')}>"
        rows.append((own, kind, record_id, uri, date, content_type, len(data), digest(data), *sources, "\r\n".join(headers), data.decode()))
    return rows


def warc_bytes(record: dict) -> bytes:
    """A record of ``RECORD_FIELDS`` as it stands in a WARC file."""
    named = (
        ("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"),
        ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"),
    )
    head = "".join(f"{name}: {record[key]}\r\n" for name, key in named if record[key] is not None)
    return f"WARC/1.1\r\n{head}\r\n".encode() + record["block"].encode() + b"\r\n\r\n"


def derive_records(responses: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Two rows per response (record_id, target_uri, warc_date, block) with the kept columns as text.

    A null block is an empty one; a null record id is made from the block's digest; null URIs and
    dates stay out of the records. Repeated rows give repeated records with equal identifiers.
    """
    keep = keep or []
    names = [*keep, *(f.split()[0] for f in RECORD_FIELDS.split(", "))]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = zip(*(batch[f"__{k}"] for k in keep)) if keep else (() for _ in range(len(batch)))
            out = [
                (*own, *row)
                for own, r, u, d, b in zip(kept, batch["record_id"], batch["target_uri"], batch["warc_date"], batch["block"])
                for row in derivatives(r, u, d, b)
            ]
            yield pd.DataFrame(out, columns=names)

    picked = responses.select(*(F.col(k).cast("string").alias(f"__{k}") for k in keep), "record_id", "target_uri", "warc_date", "block")
    return picked.mapInPandas(rows, ", ".join([*(f"{k} string" for k in keep), RECORD_FIELDS]))


def responses_of_pages(pages: DataFrame) -> DataFrame:
    """WARC response records of a table of pages: page_id, record_id, target_uri, warc_date, block.

    The identifier comes from page_id and URL; the table has no fetch time, so that the date is
    left out. The HTTP head names the type and length that the page has.
    """
    name = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))))
    dashed = F.concat_ws("-", *(F.substring(name, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    body = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(
        "page_id",
        F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(None).cast("string").alias("warc_date"),
        F.concat(head, body).cast("binary").alias("block"),
    )


def page_derivatives(pages: DataFrame) -> DataFrame:
    """Metadata and conversion record of every page, with its page_id."""
    made = derive_records(responses_of_pages(pages), ["page_id"])
    return made.withColumn("page_id", F.col("page_id").cast(pages.schema["page_id"].dataType))
