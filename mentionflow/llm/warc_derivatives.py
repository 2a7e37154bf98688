"""WARC derivative builder: from response records, linked ``metadata`` records
(title, links, source headers and digests) and plain-text ``conversion``
records. Every derivative refers to the record it was made from."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

CRLF = "\r\n"
SOFTWARE = "mentionflow derivative builder"
SKIPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<head\b[^>]*>.*?(?:</head\s*>|(?=<body\b))",
                     re.S | re.I)
BLOCK_TAG = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|"
                       r"table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>", re.I)
TAG = re.compile(r"<[/!?a-zA-Z][^>]*>")
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
LINK = re.compile(r"<a\b[^>]*?\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
LANGUAGE = re.compile(r"<html\b[^>]*?\slang\s*=\s*[\"']?([\w-]+)", re.I)
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of URLs, RFC 4122


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, source: str) -> str:
    """The same id at every run: derivatives of a retried task don't differ."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{kind} {source}')}>"


def plain_text(markup: str) -> str:
    """Text of a page, a line for each block; no scripts, styles, comments or head."""
    text = TAG.sub("", BLOCK_TAG.sub("\n", SKIPPED.sub(" ", markup)))
    lines = (" ".join(x.split()) for x in html.unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def one_line(text: str) -> str:
    return " ".join(text.split())


def headers_of(block: str) -> tuple[str, list[tuple[str, str]]]:
    """Status line and (lower-case name, value) of an HTTP header block."""
    status, *lines = re.split(r"\r?\n", block.rstrip("\r\n")) if block else [""]
    return status, [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines) if _]


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1" + CRLF + "".join(f"{k}: {one_line(v)}{CRLF}" for k, v in fields if v)
    return head.encode() + CRLF.encode() + block + (CRLF * 2).encode()


def derive(source_id: str, uri: str, date: str, http: str, markup: str) -> list[dict]:
    """The metadata and conversion record of one response."""
    payload = markup.encode("utf-8", "replace")
    status, headers = headers_of(http)
    payload_digest, block_digest = digest(payload), digest(http.encode("utf-8", "replace") + payload)
    title, language = TITLE.search(markup), LANGUAGE.search(markup)
    info = [("sourcePayloadDigest", payload_digest), ("sourceBlockDigest", block_digest), ("sourceStatus", status)]
    info += [("sourceHeader", f"{k}: {v}") for k, v in headers]
    info += [("title", html.unescape(title[1]))] if title else []
    info += [("languages-html", language[1])] if language else []
    links = [html.unescape(next(x for x in m.groups() if x is not None)) for m in LINK.finditer(markup)]
    info += [("outlink", x) for x in dict.fromkeys(map(one_line, links)) if x]
    meta = "".join(f"{k}: {one_line(v)}{CRLF}" for k, v in info if one_line(v)).encode("utf-8", "replace")
    text = plain_text(markup).encode("utf-8", "replace")
    out = []
    meta_id, text_id = record_id("metadata", source_id), record_id("conversion", source_id)
    for kind, own, block, content, more in (
            ("metadata", meta_id, meta, "application/warc-fields", []),
            ("conversion", text_id, text, "text/plain; charset=utf-8",
             [("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Concurrent-To", meta_id)])):
        fields = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", source_id),
                  *more, ("WARC-Block-Digest", digest(block)), ("WARC-Source-Payload-Digest", payload_digest), ("Content-Type", content),
                  ("Content-Length", str(len(block)))]
        out.append({"record_type": kind, "record_id": own, "refers_to": source_id, "target_uri": uri, "date": date, "content_type": content,
                    "content_length": len(block), "source_payload_digest": payload_digest, "source_block_digest": block_digest,
                    "block_digest": digest(block), "n_outlinks": len(info) - sum(k != "outlink" for k, _ in info),
                    "record": record(fields, block)})
    return out


FIELDS = [("record_type", pa.string(), "string"), ("record_id", pa.string(), "string"), ("refers_to", pa.string(), "string"),
          ("target_uri", pa.string(), "string"), ("date", pa.string(), "string"), ("content_type", pa.string(), "string"),
          ("content_length", pa.int64(), "bigint"), ("source_payload_digest", pa.string(), "string"),
          ("source_block_digest", pa.string(), "string"), ("block_digest", pa.string(), "string"), ("n_outlinks", pa.int64(), "bigint"),
          ("record", pa.binary(), "binary")]


def derivatives(responses: DataFrame, key_col="page_id") -> DataFrame:
    """Two rows, metadata and conversion, for each response: ``key_col`` and the
    columns of ``FIELDS``; ``record`` is the whole WARC record.

    ``responses`` has ``key_col``, ``record_id``, ``target_uri``, ``date``, ``http_headers`` and ``payload``.
    NULLs count as empty texts, and an empty header field is left out; a NULL
    ``record_id`` refers to an id made from URI and date. Repeated responses give repeated
    records, of the same ids. Other columns are not read."""
    def run(batches):
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(1, 6)]
            rows, at = [], []
            for i, (rid, uri, date, http, payload) in enumerate(zip(*cols, strict=True)):
                rows += derive(rid or record_id("response", f"{uri or ''} {date or ''}"), uri or "", date or "", http or "", payload or "")
                at += [i, i]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), *(pa.array([r[n] for r in rows], t) for n, t, _ in FIELDS)],
                [b.schema.names[0], *(n for n, _, _ in FIELDS)])

    kind = responses.schema[key_col].dataType.simpleString()
    own = responses.select(key_col, "record_id", "target_uri", "date", "http_headers", "payload")
    return map_arrow(own, run, f"`{key_col}` {kind}, " + ", ".join(f"{n} {t}" for n, _, t in FIELDS))


def responses_of(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of raw pages (page_id, url, html), as a crawler would have stored them."""
    h = F.md5(F.concat_ws(" ", F.lit("response"), F.col("page_id").cast("string"), F.col("url")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                       F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), F.lit(CRLF * 2))
    return pages.select("page_id", F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"),
                        F.col("url").alias("target_uri"), F.lit(date).alias("date"), headers.alias("http_headers"), F.col("html").alias("payload"))


def parse(records: DataFrame, record_col="record") -> DataFrame:
    """(headers map, block) of whole WARC records: reads back what ``derivatives`` made."""
    def run(batches):
        for b in batches:
            heads, blocks = [], []
            for raw in b.column(0).to_pylist():
                head, _, rest = (raw or b"").partition(b"\r\n\r\n")
                fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split(CRLF)[1:] if ": " in x)
                heads.append(list(fields.items()))
                blocks.append(rest[:int(fields.get("Content-Length", 0))])
            yield pa.RecordBatch.from_arrays([pa.array(heads, pa.map_(pa.string(), pa.string())), pa.array(blocks, pa.binary())], ["headers", "block"])
    return map_arrow(records.select(record_col), run, "headers map<string,string>, block binary")
