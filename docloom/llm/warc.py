"""WARC: derive metadata and plain-text conversion records from response records, and read and write the files.

Each response becomes two records that refer to it by WARC-Refers-To: a ``metadata`` record (JSON: the source's HTTP
status and headers, its digests, title and links) and a ``conversion`` record (the page's text). Ids are UUIDs made from
the response's id and the kind of record, so a task that runs again writes the same records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import itertools
import json
import re
import zlib
import uuid
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "record_id string, record_type string, target_uri string, warc_date string, refers_to string, content_type string, content_length long, block_digest string, payload_digest string, source_id string, block binary"
RESPONSE = "record_id string, target_uri string, warc_date string, block binary, block_digest string, payload_digest string, source_id string"
_HIDDEN = {"script", "style", "template", "noscript", "head"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "dfn", "em", "font", "i", "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Tags as most are written, which need no further looking at: bare, or with one quoted attribute without references.
_START = re.compile(r"""<([a-zA-Z][a-zA-Z0-9]*)(?: ([a-zA-Z][a-zA-Z-]*)="([^"&]*)")?>""")
_CLOSE = re.compile(r"</([a-zA-Z][a-zA-Z0-9]*)>")
#: What stands in these isn't markup; html.parser sees to them.
_RAW = {"script", "style", "title", "textarea", "iframe", "xmp", "noembed", "noframes", "noscript", "plaintext"}
_JSON = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def digest(data: bytes) -> str:
    """As WARC files label it: sha1 in base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


class _Page(HTMLParser):
    """Title, links and visible text of a page; block elements end a line."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.links, self.out, self.hidden, self.in_title = [], [], [], [], False

    def updatepos(self, i: int, j: int) -> int:
        return j  # nobody asks for lines and columns

    def parse_starttag(self, i: int) -> int:
        m = _START.match(self.rawdata, i)
        if m is None or (tag := m[1].lower()) in _RAW:
            return super().parse_starttag(i)
        self.lasttag = tag
        self.handle_starttag(tag, [(m[2].lower(), m[3])] if m[2] else [])
        return m.end()

    def parse_endtag(self, i: int) -> int:
        if self.cdata_elem is not None or (m := _CLOSE.match(self.rawdata, i)) is None or (tag := m[1].lower()) in _RAW:
            return super().parse_endtag(i)
        self.handle_endtag(tag)
        return m.end()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for name, value in attrs:
            if name in ("href", "src") and value:
                self.links.append({"path": f"{tag}@{name}", "url": value})
        if tag == "title":
            self.in_title = True
        if tag in _HIDDEN and tag not in _VOID:
            self.hidden.append(tag)
        elif tag == "body":
            self.hidden = []
        if tag not in _INLINE:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if tag in self.hidden:
            del self.hidden[self.hidden.index(tag) :]
        if tag not in _INLINE:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        if not self.hidden:
            self.out.append(data)


def page(source: str) -> tuple[str, str, list[dict]]:
    """(title, text, links). Lines are stripped, white space inside them is one space, empty ones go."""
    p = _Page()
    try:
        p.feed(source)
        p.close()
    except (AssertionError, ValueError):  # html.parser gives up on some broken declarations; what it had stays
        p.out.append("\n" + html.unescape(re.sub(r"<[^>]*>?", " ", p.rawdata)))
    squeeze = lambda s: " ".join(s.split())
    lines = (squeeze(x) for x in "".join(p.out).split("\n"))
    return squeeze("".join(p.title)), "\n".join(x for x in lines if x), p.links


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers, payload) of an HTTP response; all payload where there is no head."""
    head, cut, payload = block.partition(b"\r\n\r\n")
    if not cut or not head.startswith(b"HTTP/"):
        return "", [], block
    first, *rest = head.decode("latin-1").split("\r\n")
    return first, [(k.strip(), v.strip()) for k, c, v in (x.partition(":") for x in rest) if c], payload


def _charset(headers: list[tuple[str, str]]) -> str:
    for k, v in headers:
        if k.lower() == "content-type" and (m := re.search(r"charset=[\"']?([\w.:-]+)", v, re.I)):
            try:
                "".encode(m[1])
                return m[1]
            except (LookupError, UnicodeError):
                break
    return "utf-8"


def _responses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        rows = []
        for r in part.itertuples(index=False):
            url = "" if r.url is None else r.url
            body = b"" if r.html is None else r.html.encode("utf-8", "replace")
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
            block = head.encode() + body
            name = digest(block)
            rows.append((_urn(f"response\n{r.page_id}\n{url}\n{name}"), url, r.date, block, name, digest(body), r.page_id))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESPONSE.split(", ")])


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of pages (page_id, url, html). Null html is an empty body, a null url an empty one."""
    rows = pages.select(*[F.col(c).cast("string").alias(c) for c in ("page_id", "url", "html")], F.lit(date).alias("date"))
    return rows.mapInPandas(_responses, RESPONSE)


def _derived(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        rows = []
        for r in part.itertuples(index=False):
            block = bytes(r.block) if r.block is not None else b""
            status, headers, payload = split_http(block)
            title, text, links = page(payload.decode(_charset(headers), "replace"))
            about = {
                "source": {"record-id": r.record_id, "target-uri": r.target_uri, "date": r.warc_date, "block-digest": r.block_digest, "payload-digest": r.payload_digest, "content-length": len(block)},
                "http": {"status": status, "headers": [list(h) for h in headers], "payload-length": len(payload)},
                "page": {"title": title, "links": links, "text-length": len(text)},
            }
            for kind, mime, data in (
                ("metadata", "application/json", _JSON.encode(about).encode("utf-8", "replace")),
                ("conversion", "text/plain", text.encode("utf-8", "replace")),
            ):
                rows.append((_urn(f"{kind}\n{r.record_id}"), kind, r.target_uri, r.warc_date, r.record_id, mime, len(data), digest(data), r.payload_digest, r.source_id, data))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])


def derive(responses: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response row.

    refers_to is the response's id and payload_digest the response's own; block_digest is of the new block. A null or
    headless block is taken as payload alone, an empty one gives an empty text. Responses without record_id refer to
    nothing (null). Repeated responses give repeated records. An empty table gives none.
    """
    return responses.select(*[c.split()[0] for c in RESPONSE.split(", ")]).mapInPandas(_derived, RECORD)


def to_bytes(r) -> bytes:
    """One record as it stands in a file, gzip member by itself."""
    head = ["WARC/1.0", f"WARC-Type: {r.record_type}", f"WARC-Record-ID: {r.record_id}", f"WARC-Date: {r.warc_date}"]
    for name, value in (("WARC-Target-URI", r.target_uri), ("WARC-Refers-To", r.refers_to), ("WARC-Block-Digest", r.block_digest), ("WARC-Payload-Digest", r.payload_digest), ("Content-Type", r.content_type), ("X-Source-ID", r.source_id)):
        if value:
            head.append(f"{name}: {value}")
    block = bytes(r.block) if r.block is not None else b""
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def pack(records: DataFrame, records_per_file: int = 2000) -> DataFrame:
    """(part, warc) of gzipped WARC files of some records_per_file records; write the bytes with any binary sink."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for part in batches:
            for r in part.itertuples(index=False):
                held.append(to_bytes(r))
                if len(held) == records_per_file:
                    yield pd.DataFrame({"n_records": [len(held)], "warc": [b"".join(held)]})
                    held = []
        if held:
            yield pd.DataFrame({"n_records": [len(held)], "warc": [b"".join(held)]})

    return records.mapInPandas(run, "n_records long, warc binary")


class _Inflated(io.RawIOBase):
    """The members of gzipped bytes, end to end; what comes before damage or a cut is there, then they end."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.member = data, 0, None

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while self.member or self.at < len(self.data):
            self.member = self.member or zlib.decompressobj(31)
            piece = self.member.unconsumed_tail
            if not piece:
                piece = self.data[self.at : self.at + (1 << 16)]
                self.at += len(piece)
            try:
                out = self.member.decompress(piece, len(into))
            except zlib.error:
                break
            if self.member.eof:
                self.at, self.member = self.at - len(self.member.unused_data), None
            if out:
                into[: len(out)] = out
                return len(out)
            if not piece:
                break
        self.at, self.member = len(self.data), None
        return 0


def parse(data: bytes) -> Iterator[dict]:
    """Records of a WARC file, gzipped or not, one at a time: headers in lower case, and block.

    A record without a usable Content-Length goes on to the line where the next one begins. A file that is cut short or
    damaged gives the records before the damage, and what there is of the last block.
    """
    stream = io.BufferedReader(_Inflated(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    line = stream.readline()
    while line:
        if not line.startswith(b"WARC/"):
            line = stream.readline()
            continue
        headers, ahead = {}, b""
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers[k.strip().lower()] = v.strip()
        length = headers.get("content-length", "")
        if length.isascii() and length.isdigit():
            block = stream.read(min(int(length), len(data) * 1100))  # gzip packs 1,032 times at most
        else:
            lines = []
            while (ahead := stream.readline()) and not ahead.startswith(b"WARC/"):
                lines.append(ahead)
            block = b"".join(lines).removesuffix(b"\r\n\r\n")
        yield headers | {"block": block}
        line = ahead or stream.readline()


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of the WARC files at path, with the columns of RECORD."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "warc_date": "warc-date", "refers_to": "warc-refers-to", "content_type": "content-type", "block_digest": "warc-block-digest", "payload_digest": "warc-payload-digest", "source_id": "x-source-id"}
        for part in batches:
            for data in part["content"]:
                found = parse(bytes(data))
                while some := list(itertools.islice(found, 256)):
                    rows = [{c: r.get(h) for c, h in names.items()} | {"content_length": len(r["block"]), "block": r["block"]} for r in some]
                    yield pd.DataFrame(rows)[[c.split()[0] for c in RECORD.split(", ")]]

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, RECORD)
