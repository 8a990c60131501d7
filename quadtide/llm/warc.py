"""Derivatives of WARC responses: linked metadata and plain-text conversion records.

Each response gives a metadata record, whose fields keep the source's HTTP headers and digests, and a
conversion record with its text. Both name the response in WARC-Refers-To and have ids derived from it,
so building them again gives the same records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import sys
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadtide.llm.common import column, small_batches
from quadtide.llm.htmlcut import blocks_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VERSION = "WARC/1.1"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(``page_id``, ``record_id``, ``uri``, ``date``, ``block``): stored pages as response records.

    The pages at hand have no stored answers: status line, the two header fields and ``date`` are made here,
    the same for all. A null page has an empty body, a null url the empty uri, a null id stays null. The id
    follows from page id, url and body, so repeated rows are the same record. Pages are read whole; other
    columns are not looked at; an empty table gives none.
    """
    body = F.coalesce(column(pages, html_col).cast("string").cast("binary"), F.lit(b""))
    length = F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n")).cast("binary")
    uri = F.coalesce(column(pages, url_col).cast("string"), F.lit(""))
    digest = F.sha1(F.concat_ws("\n", F.coalesce(column(pages, id_col).cast("string"), F.lit("")), uri, F.sha1(body)))
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return pages.select(
        column(pages, id_col).cast("long").alias("page_id"), F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"),
        uri.alias("uri"), F.lit(date).alias("date"), F.concat(F.lit(HEAD), length, body).alias("block"),
    )


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in order and body; folded lines continue the header before them."""
    head, _, body = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    headers: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in " \t" and headers:
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            headers.append((name.strip(), value.strip()))
    return status, headers, body


def charset_of(headers: list[tuple[str, str]]) -> str:
    for name, value in headers:
        if name.lower() == "content-type" and "charset=" in value.lower():
            name = value[value.lower().index("charset=") + 8 :].split(";")[0].strip("\"' ")
            try:
                "".encode(name)
                return name
            except (LookupError, UnicodeError):
                return "utf-8"
    return "utf-8"


def plain_text(body: bytes, headers: list[tuple[str, str]]) -> str:
    """The text of every block of an HTML body, one a line; other text as it is; else nothing."""
    kind = next((v.lower() for n, v in headers if n.lower() == "content-type"), "text/html")
    text = body.decode(charset_of(headers), "replace")
    if "html" in kind:
        return "\n".join(b.text for b in blocks_of(text))
    return text if kind.startswith("text/") else ""


def derive(record_id: str, uri: str, date: str, block: bytes) -> list[dict]:
    """The metadata and the conversion record of one response, as headers and content."""
    status, headers, body = split_http(block)
    digest, out = sha1(body), []
    fields = [("refers-to", record_id), ("source-status", status), ("source-block-digest", sha1(block)), ("source-payload-digest", digest)]
    fields += [(f"source-header-{n.lower()}", v) for n, v in headers]
    text = plain_text(body, headers).encode()
    for kind, mime, content in (("metadata", "application/warc-fields", "".join(f"{n}: {v}\r\n" for n, v in fields).encode()), ("conversion", "text/plain; charset=utf-8", text)):
        own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record_id} {kind}')}>"
        out.append({"type": kind, "record_id": own, "refers_to": record_id, "uri": uri, "date": date, "content_type": mime, "block_digest": sha1(content), "source_digest": digest, "content": content})
    return out


FIELDS = ("type", "record_id", "refers_to", "uri", "date", "content_type", "block_digest", "source_digest", "content")


def derivatives(records: DataFrame, key_col: str = "page_id") -> DataFrame:
    """Two rows per response record, ``type`` metadata and conversion, with their header fields and
    ``content``. Null blocks count as empty; repeated responses give equal records again; an empty table
    gives none; other columns are not looked at."""
    schema = f"{key_col} long, " + ", ".join(f"{f} {'binary' if f == 'content' else 'string'}" for f in FIELDS)

    def run(batches):
        for b in batches:
            rows = [(k, r) for k, *args in zip(*(b.column(c).to_pylist() for c in range(5))) for r in derive(args[0], args[1] or "", args[2] or "", args[3] or b"")]
            arrays = [pa.array([k for k, _ in rows], pa.int64())]
            arrays += [pa.array([r[f] for _, r in rows], pa.binary() if f == "content" else pa.string()) for f in FIELDS]
            yield pa.RecordBatch.from_arrays(arrays, [key_col, *FIELDS])

    wanted = small_batches(records, 64).select(column(records, key_col).cast("long"), "record_id", "uri", "date", "block")
    return wanted.mapInArrow(run, schema)


def members(records: DataFrame) -> DataFrame:
    """Each derivative as a ``member``: one gzip member, the bytes of which concatenate to a WARC file.

    ``records`` are rows of ``derivatives``, which holds no nulls in their fields; equal ones give equal
    members, contents of any length are one member, an empty table gives none.
    """

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                head = [("WARC-Type", r["type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Refers-To", r["refers_to"]), ("WARC-Target-URI", r["uri"]), ("WARC-Date", r["date"])]
                head += [("Content-Type", r["content_type"]), ("WARC-Block-Digest", r["block_digest"]), ("Content-Length", str(len(r["content"])))]
                raw = f"{VERSION}\r\n".encode() + "".join(f"{n}: {v}\r\n" for n, v in head).encode() + b"\r\n" + r["content"] + b"\r\n\r\n"
                out.append(gzip.compress(raw, mtime=0))
            yield pa.RecordBatch.from_arrays([b.column("record_id"), pa.array(out, pa.binary())], ["record_id", "member"])

    return small_batches(records, 64).select(*FIELDS).mapInArrow(run, "record_id string, member binary")
