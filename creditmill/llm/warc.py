"""WARC derivatives: metadata and plain-text conversion records of response records.

Both derivatives name their response in ``WARC-Refers-To``, repeat its target and date, and keep its payload digest as
``WARC-Source-Payload-Digest``; their own digests are those of their own blocks. The metadata record lists the source's status, headers, digests and links; the
conversion record holds the page's plain text. Records are bytes in a column of one row
each, so that a file is written by Spark and any part of it can be made again.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditmill.llm.common import prepare

VERSION = "WARC/1.1"
#: The date of records whose source has none.
EPOCH = "1970-01-01T00:00:00Z"
SOFTWARE = "creditmill derivative builder"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public name space of URLs

#: Scripts, styles and comments may run to the end of the page; other elements without an end tag keep what follows.
_DROPPED = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<(noscript|template)\b(?:(?!<\2\b).)*?</\2\s*>", re.DOTALL | re.IGNORECASE
)
#: The head holds these elements only: it ends at its end tag, at <body> or at the first other tag or text.
_HEAD = re.compile(
    r"<head\b[^<>]*>(?:\s+|<title\b[^<>]*>.*?</title\s*>|</?(?:meta|link|base|basefont|bgsound|noscript|template)\b[^<>]*>)*(?:</head\s*>)?", re.DOTALL | re.IGNORECASE
)
_CHARSET = re.compile(rb"<meta\b[^<>]*?\bcharset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.IGNORECASE)
_HEADER_CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([^\s\"';,]+)", re.IGNORECASE)
_TITLE, _TITLE_END = re.compile(r"<title\b[^<>]*>", re.IGNORECASE), re.compile(r"</title\s*>", re.IGNORECASE)
_BREAKS = re.compile(
    r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^<>]*>",
    re.IGNORECASE,
)
_TAGS = re.compile(r"<[!/?a-zA-Z][^<>]*>")
_LINKS = re.compile(r"<a\b[^<>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+))", re.IGNORECASE)
_SPACES = re.compile(r"[ \t\r\f\v\xa0]+")
_LANGUAGE = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", re.IGNORECASE)


def digest(data: bytes) -> str:
    """The digest of a block or payload as records carry it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """A stable id: equal parts give equal ids, so a repeated task writes the same record."""
    return f"<urn:uuid:{uuid.uuid5(_NAMES, chr(0).join(parts))}>"


def plain_text(page: str) -> str:
    """Text of a page: without scripts, styles, comments and tags; entities resolved; a line per block."""
    body = _HEAD.sub(" ", _DROPPED.sub(" ", page), count=1)
    body = _TAGS.sub("", _BREAKS.sub("\n", body))
    lines = (_SPACES.sub(" ", line).strip() for line in entities.unescape(body).split("\n"))
    return "\n".join(line for line in lines if line)


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without its closing blank lines; they separate records in a file."""
    head = [VERSION, f"WARC-Type: {kind}"] + [f"{k}: {_clean(v)}" for k, v in headers]
    head += [f"WARC-Block-Digest: {digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block


def _clean(value: str) -> str:
    """A header value in one line."""
    return " ".join(filter(None, (line.strip() for line in re.split(r"[\r\n]+", value))))


def _title(page: str) -> str | None:
    """What stands between the first title tag and the next end tag; without an end tag there is no title."""
    begin = _TITLE.search(page)
    end = _TITLE_END.search(page, begin.end()) if begin else None
    return page[begin.end() : end.start()] if end else None


def http_message(page: str) -> bytes:
    body = page.encode("utf-8", "replace")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body


def _dechunked(body: bytes) -> bytes:
    """The body of a chunked message; a body that is not chunked after all, as crawlers store it, stays."""
    at, parts = 0, []
    while True:
        end = body.find(b"\r\n", at)
        size = body[at : end if end >= 0 else len(body)].partition(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,16}", size):
            return b"".join(parts) + body[at:]
        if int(size, 16) == 0 or end < 0:
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + int(size, 16)])
        at = end + 2 + int(size, 16)
        if body[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(body):
            return b"".join(parts)


def _inflated(body: bytes, modes: tuple[int, ...]) -> bytes:
    """All members of a compressed body, as far as it goes if it was cut; a body that is none stays."""
    for mode in modes:
        parts, at = [], 0
        try:
            while at < len(body):
                one = zlib.decompressobj(mode)
                while at < len(body) and not one.eof:  # some bytes at a time, so that a small member costs little
                    parts.append(one.decompress(body[at : at + 16384]))
                    at += 16384
                parts.append(one.flush())
                at = min(at, len(body)) - len(one.unused_data)
                if not one.eof:
                    break
        except zlib.error:
            if not any(parts):
                continue
        return b"".join(parts)
    return body


def decoded(body: bytes, named: list[tuple[str, str]]) -> bytes:
    """The body without the transfer and content codings that its headers state, the last one undone first."""
    for header in ("transfer-encoding", "content-encoding"):
        codings = [c.strip().lower() for k, v in named if k == header for c in v.split(",")]
        for coding in reversed(codings):
            if coding == "chunked":
                body = _dechunked(body)
            elif coding in ("gzip", "x-gzip"):
                body = _inflated(body, (31,))
            elif coding == "deflate":
                body = _inflated(body, (15, -15))
    return body


def page_text(body: bytes, named: list[tuple[str, str]]) -> str:
    """The page in the charset of its byte order mark, header or meta element; UTF-8 if none is known."""
    for mark, charset in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if body.startswith(mark):
            return body[len(mark) :].decode(charset, "replace")
    stated = [m.group(1) for k, v in named if k == "content-type" for m in [_HEADER_CHARSET.search(v)] if m]
    meta = _CHARSET.search(body[:4096])
    # A page that can be searched for its meta element is not in UTF-16.
    stated += [re.sub("(?i)^utf-?16.*", "utf-8", meta.group(1).decode("ascii"))] if meta else []
    for charset in stated:
        # As browsers do, Latin-1 and ASCII are read as Windows-1252, and bytes that it lacks as Latin-1.
        if charset.lower() in ("iso-8859-1", "iso8859-1", "latin1", "latin-1", "us-ascii", "ascii", "windows-1252", "cp1252"):
            return "".join(_WINDOWS[b] for b in body)
        try:
            return str(body, charset, "replace")
        except (LookupError, ValueError):
            continue
    return body.decode("utf-8", "replace")


_WINDOWS = [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(256)]


def split_record(data: bytes) -> tuple[str, dict[str, str], bytes]:
    """(version, headers, block) of one record; header names in lower case, continuation lines joined."""
    head, _, block = data.partition(b"\r\n\r\n")
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).decode("utf-8", "replace").split("\r\n")
    headers = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        headers.setdefault(name.strip().lower(), value.strip())
    size = headers.get("content-length", "")
    return lines[0].strip(), headers, block[: int(size)] if size.isdigit() else block


def derive(data: bytes) -> list[tuple[str, str, bytes]]:
    """(type, record id, record) of the two derivatives of a response; none of other records."""
    _, headers, block = split_record(data)
    if headers.get("warc-type", "").lower() != "response":
        return []
    source = headers.get("warc-record-id", "")
    status, _, rest = block.partition(b"\r\n")
    http, _, body = rest.partition(b"\r\n\r\n") if not rest.startswith(b"\r\n") else (b"", b"", rest[2:])
    fields = [line.partition(":") for line in re.sub(r"\r\n[ \t]+", " ", http.decode("utf-8", "replace")).split("\r\n") if ":" in line]
    named = [(k.strip().lower(), v.strip()) for k, _, v in fields]
    page = page_text(decoded(body, named), named)
    payload = headers.get("warc-payload-digest") or digest(body)
    linked = [
        ("WARC-Refers-To", source),
        ("WARC-Refers-To-Target-URI", headers.get("warc-target-uri", "")),
        ("WARC-Refers-To-Date", headers.get("warc-date", EPOCH)),
        ("WARC-Target-URI", headers.get("warc-target-uri", "")),
        ("WARC-Date", headers.get("warc-date", EPOCH)),
        ("WARC-Source-Payload-Digest", payload),
    ]
    title, language = _title(page), _LANGUAGE.search(page)
    facts = [("source-status", status.decode("utf-8", "replace")), ("source-block-digest", headers.get("warc-block-digest") or digest(block)), ("source-payload-digest", payload)]
    facts += [(f"source-header-{k}", v) for k, v in named]
    facts += [("title", _SPACES.sub(" ", entities.unescape(title)))] if title is not None else []
    facts += [("language", language.group(1))] if language else []
    facts += [("outlink", entities.unescape(next(g for g in m.groups() if g is not None))) for m in _LINKS.finditer(page)]
    meta = "".join(f"{k}: {_clean(v)}\r\n" for k, v in facts).encode()
    text = plain_text(page).encode("utf-8", "replace")
    out = []
    for kind, content, block_ in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", text)):
        own = record_id(kind, source)
        out.append((kind, own, record(kind, [("WARC-Record-ID", own), *linked, ("WARC-Payload-Digest", digest(block_)), ("Content-Type", content)], block_)))
    return out


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, record): a response record per crawled page; null urls and pages count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, texts = (batch.column(i).to_pylist() for i in range(3))
            made = []
            for i, u, t in zip(ids, urls, texts):
                message = http_message(t or "")
                body = message.partition(b"\r\n\r\n")[2]
                headers = [
                    ("WARC-Record-ID", record_id("response", str(i), u or "")),
                    ("WARC-Target-URI", u or ""),
                    ("WARC-Date", EPOCH),
                    ("WARC-Payload-Digest", digest(body)),
                    ("Content-Type", "application/http; msgtype=response"),
                ]
                made.append(record("response", headers, message))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["page_id", "record"])

    prepare(pages.sparkSession)
    kind = pages.schema[page_id].dataType.simpleString()
    return pages.select(F.col(page_id).alias("page_id"), url, page).mapInArrow(run, f"page_id {kind}, record binary")


def derivatives(records: DataFrame, key: str = "page_id", column: str = "record") -> DataFrame:
    """(key, warc_type, record_id, refers_to, target_uri, payload_digest, block_digest, n_bytes, record).

    payload_digest is the source's, block_digest the record's own.
    Two rows per response record; records of other types and null records have none. Repeated
    records repeat; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, data in enumerate(batch.column(1).to_pylist()):
                for kind, own, made in derive(data) if data else ():
                    _, headers, block = split_record(made)
                    at.append(i)
                    rows.append(
                        (kind, own, headers["warc-refers-to"], headers["warc-target-uri"], headers["warc-source-payload-digest"],
                         headers["warc-block-digest"], len(block), made)
                    )
            columns = list(zip(*rows)) if rows else [[]] * 8
            kinds = [pa.string()] * 6 + [pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64()))] + [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=[key, *_FIELDS],
            )

    kind = records.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, warc_type string, record_id string, refers_to string, target_uri string, payload_digest string, block_digest string, n_bytes bigint, record binary"
    prepare(records.sparkSession)
    return records.select(key, column).mapInArrow(run, schema)


_FIELDS = ("warc_type", "record_id", "refers_to", "target_uri", "payload_digest", "block_digest", "n_bytes", "record")


def write_warc(records: DataFrame, path: str, column: str = "record", compression: str = "none") -> None:
    """Write records as WARC files, one per partition: the two line breaks that close a record separate the lines.

    With ``gzip`` a file is one member. Spark's own writer commits the files, so a lost executor leaves no partial file.
    """
    records.select(F.col(column).cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option(
        "compression", compression
    ).text(path)


_BREAK = b"\r\n\r\n"


def next_record(data: bytearray) -> tuple[bytes | None, int, int]:
    """(record, bytes used, bytes needed) at the beginning of a stream; what is not a record is passed over up to the next double break."""
    begin = 0
    while data[begin : begin + 2] == b"\r\n":
        begin += 2
    end = data.find(_BREAK, begin)
    if end < 0:
        return None, begin, 0
    if not re.match(rb"WARC/\d", data[begin : begin + 6]):
        return None, end + 4, 0
    size = split_record(bytes(data[begin : end + 4]))[1].get("content-length", "0")
    stop = end + 4 + (int(size) if size.isdigit() else 0)
    if len(data) < stop + 4:  # with its closing breaks, which a reader adds where a file is cut
        return None, 0, stop + 4
    return bytes(data[begin:stop]), stop, 0


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, record) of gzip WARC files, however many members they have: the inverse of ``write_warc``.

    Spark reads the pieces between double line breaks in order, a file in one task, as gzip cannot be split; a record is put together
    again from its stated length, so a task holds one record. A record cut off at the end of its file is left out, and what does not
    begin with a version line is passed over.
    """
    pieces = spark.read.option("lineSep", "\r\n\r\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, need = None, bytearray(), 0
        for batch in batches:
            files, records = [], []
            for file, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if file != now:
                    now, held, need = file, bytearray(), 0
                held += piece + _BREAK
                while held and len(held) >= need:
                    found, used, need = next_record(held)
                    del held[:used]
                    if found is not None:
                        files.append(file)
                        records.append(found)
                    elif not used:
                        break
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(records, pa.binary())], names=["file", "record"])

    prepare(spark)
    return pieces.mapInArrow(run, "file string, record binary")
