"""Derivatives of WARC response records: a metadata and a plain-text conversion record for each.

Records are rows with the bytes of one WARC record in ``record``. A derived record refers to its source by identifier, URI and
date, and keeps the source's payload digest and its HTTP header fields. Everything about a derived record follows from
its source, its identifier too, so a rerun, or a retried task, gives the same bytes.

Each row is worked on by itself: nothing is shuffled, and memory follows the largest record of a batch.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Ends

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
DERIVED = (
    "warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, "
    "payload_digest string, block_digest string, http_status int, http_headers map<string,string>, block string, record binary, error string"
)
NAMES = [part.strip().split(" ")[0] for part in re.sub(r"map<string,string>", "map", DERIVED).split(",")]

HIDING = re.compile(r"<!--|<(script|style|noscript|template|svg|title|head|/head|body)(?=[\s/>])[^>]*>", re.I)
CODE = frozenset(("script", "style"))  # without an end tag all that follows is code, as browsers take it
INLINE = re.compile(
    r"</?(?:a|abbr|acronym|b|bdi|bdo|big|cite|code|data|del|dfn|em|font|i|img|ins|kbd|label|mark|q|ruby|s|samp|small|span|strong|sub|sup|time|tt|u|var|wbr)\b[^>]*>", re.I
)
TAG = re.compile(r"<[!/?a-zA-Z][^>]*>")
TITLE = re.compile(r"<title[^>]*>(.*?)</title\s*>", re.S | re.I)
LINK = re.compile(r"<a\s[^>]*?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
BLANKS = re.compile(r"[^\S\n]+")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def identifier(*parts: str) -> str:
    """A record identifier that follows from ``parts``."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1('\x00'.join(parts).encode('utf-8', 'surrogatepass')).digest()[:16], version=5)}>"


def written(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A whole record; fields without a value are left out."""
    head = [VERSION, *[f"{k}: {' '.join(v.split())}" for k, v in fields if v], f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields_of(head: bytes) -> list[tuple[str, str]]:
    """Header fields in order; folded lines are joined."""
    out: list[tuple[str, str]] = []
    for line in re.split(r"\r?\n", head.decode("utf-8", "replace")):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            k, _, v = line.partition(":")
            out.append((k.strip(), v.strip()))
    return out


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """(fields by lower-case name, block) of a record, gzipped or not."""
    if record[:2] == b"\x1f\x8b":
        record = gzip.decompress(record)
    head, _, rest = record.partition(b"\r\n\r\n")
    first, _, more = head.partition(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v for k, v in fields_of(more)}
    length = int(fields.get("content-length", len(rest)))
    if length < 0:
        raise ValueError("negative length")
    if length > len(rest):
        raise ValueError("record is cut off")
    return fields, rest[:length]


def http(block: bytes) -> tuple[int | None, list[tuple[str, str]], bytes]:
    """(status, header fields, body as stored) of an HTTP response."""
    at = re.search(rb"\r?\n\r?\n", block)
    head, body = (block[: at.start()], block[at.end() :]) if at else (block, b"")
    line, _, more = head.partition(b"\n")
    status = re.match(rb"HTTP/\S+\s+(\d{3})", line)
    return (int(status[1]) if status else None), fields_of(more), body


def by_name(header: list[tuple[str, str]]) -> dict[str, str]:
    """Header fields by lower-case name; repeated ones as one list with commas, cookies with line feeds, as they hold commas."""
    out: dict[str, str] = {}
    for k, v in header:
        k = k.lower()
        out[k] = v if k not in out else ("\n" if k == "set-cookie" else ", ").join((out[k], v))
    return out


def decoded(body: bytes, headers: dict[str, str]) -> str:
    """The body as text: unchunked, unpacked, and read in its character set (UTF-8 if none is known)."""
    if headers.get("transfer-encoding", "").lower() == "chunked":
        whole, rest = b"", body
        while (m := re.match(rb"([0-9a-fA-F]+)[^\r\n]*\r\n", rest)) and (n := int(m[1], 16)):
            whole += rest[m.end() : m.end() + n]
            rest = rest[m.end() + n + 2 :]
        body = whole
    kind = headers.get("content-encoding", "").lower()
    try:
        if kind in ("gzip", "x-gzip", "deflate"):
            body = zlib.decompress(body, 47)
    except zlib.error:
        pass
    named = CHARSET.search(headers.get("content-type", "")) or CHARSET.search(body[:2048].decode("latin-1"))
    try:
        return body.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def shown(page: str) -> str:
    """The page without comments, the elements of HIDING and the titles of its head.

    An element without an end tag loses its tag only, unless it is CODE; a head (whose end tag is optional) ends at the body's tag too.
    """
    ends, out, done, place, head = Ends(page), [], 0, 0, False
    while m := HIDING.search(page, place):
        place, tag = m.end(), (m[1] or "").lower()
        if tag in ("head", "/head", "body"):
            head = tag == "head"
            continue
        if not tag:
            stop = page.find("-->", place) + 3
            stop = stop if stop > 2 else len(page)
        elif (tag == "title" and not head) or (tag == "svg" and m[0].endswith("/>")):
            continue
        else:
            stop = ends.behind(tag, place)
            if stop is None:
                if tag not in CODE:
                    continue
                stop = len(page)
        out.append(page[done : m.start()])
        done = place = stop
    return "".join(out) + page[done:]


def plain(page: str) -> str:
    """All text of a page, a line for each block."""
    text = TAG.sub("\n", INLINE.sub("", shown(page).replace("\r", " ").replace("\n", " ")))
    lines = (BLANKS.sub(" ", x).strip() for x in html.unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def derived(record: bytes | None) -> list[dict]:
    """The two records made of a response; none for other records, one row with ``error`` for unreadable bytes."""
    if record is None:
        return []
    try:
        fields, block = parsed(record)
    except (ValueError, OSError, EOFError, zlib.error) as e:
        return [{"error": str(e)}]
    if fields.get("warc-type") != "response":
        return []
    status, header, body = http(block)
    headers = {k.lower(): v for k, v in header}
    source, uri, date = fields.get("warc-record-id", ""), fields.get("warc-target-uri"), fields.get("warc-date")
    payload = fields.get("warc-payload-digest") or digest(body)
    page = decoded(body, headers)
    title = TITLE.search(page)
    facts = [("http-status", str(status) if status else None), *[(f"http-header-{k.lower()}", v) for k, v in header]]
    facts += [("title", html.unescape(title[1]) if title else None), ("source-block-digest", fields.get("warc-block-digest"))]
    facts += [("outlink", html.unescape(next(x for x in m if x))) for m in LINK.findall(page) if any(m)]
    out = []
    for kind, content_type, text in (
        ("metadata", "application/warc-fields", "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in facts if v)),
        ("conversion", "text/plain; charset=utf-8", plain(page)),
    ):
        raw = text.encode("utf-8", "replace")
        row = {
            "warc_type": kind, "record_id": identifier(kind, source, uri or "", payload), "refers_to": source, "target_uri": uri, "date": date,
            "content_type": content_type, "payload_digest": payload, "block_digest": digest(raw), "http_status": status,
            "http_headers": list(by_name(header).items()), "block": raw.decode(),
        }
        row["record"] = written(
            [
                ("WARC-Type", kind), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", date), ("WARC-Refers-To", source),
                ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Target-URI", uri),
                ("WARC-Payload-Digest", payload), ("WARC-Block-Digest", row["block_digest"]), ("Content-Type", content_type),
            ],
            raw,
        )
        out.append(row)
    return out


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", date: str = DATE) -> DataFrame:
    """(key, record): the response record of every page. A null page has an empty body, a null url no target URI."""

    @F.arrow_udf("binary")
    def record(keys: pa.Array, urls: pa.Array, pages: pa.Array) -> pa.Array:
        out = []
        for k, u, p in zip(keys.to_pylist(), urls.to_pylist(), pages.to_pylist()):
            body = (p or "").encode("utf-8", "replace")
            block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
            payload = digest(body)
            out.append(written(
                [
                    ("WARC-Type", "response"), ("WARC-Record-ID", identifier("response", str(k), u or "", payload)), ("WARC-Date", date),
                    ("WARC-Target-URI", u), ("WARC-Payload-Digest", payload), ("WARC-Block-Digest", digest(block)),
                    ("Content-Type", "application/http; msgtype=response"),
                ],
                block,
            ))
        return pa.array(out, pa.binary())

    return pages.select(F.col(key).alias(key), record(F.col(key), F.col(url), F.col(page)).alias("record"))


def derivatives(records: DataFrame, key: str, record: str = "record") -> DataFrame:
    """(key, DERIVED): the derived records of every response among ``records``, each with its bytes in ``record``.

    Records of another type, and null ones, give nothing; bytes that are no record give a row with only ``error``. Repeated
    rows are derived as often as they stand. Other columns are not looked at.
    """
    key_type = records.schema[key].dataType.simpleString()

    def derive(batches):
        for batch in batches:
            keys, rows = [], []
            for k, r in zip(batch.column("key").to_pylist(), batch.column("record")):
                for row in derived(r.as_py()):
                    keys.append(k)
                    rows.append(row)
            kinds = {"http_status": pa.int32(), "http_headers": pa.map_(pa.string(), pa.string()), "record": pa.binary()}
            arrays = [pa.array([row.get(n) for row in rows], kinds.get(n, pa.string())) for n in NAMES]
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field("key").type), *arrays], names=["key", *NAMES])

    slim = records.select(F.col(key).alias("key"), F.col(record).alias("record"))
    return slim.mapInArrow(derive, f"key {key_type}, {DERIVED}").withColumnRenamed("key", key)


def members(stream):
    """The records of an unpacked WARC stream, one at a time. A file that breaks off gives its whole records and what is left of the last."""
    while True:
        record = b""
        try:
            while line := stream.readline():
                if record or line.strip():
                    record += line
                if record and not line.strip():
                    break
            length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", record)
            # What can be read is kept if the rest can't.
            record += stream.read(int(length[1]) if length else 0)
            record += stream.read(4)
        except (OSError, EOFError, zlib.error):
            if record:
                yield record
            return
        if not record:
            return
        yield record


def read_warc(spark, path: str) -> DataFrame:
    """(path, record): the records of gzipped or plain WARC files.

    A file is one row of Spark's binary source, so its bytes as stored (about 1 GB by convention, at most 2) lie in a task; they are
    unpacked as a stream, a record at a time. Damaged ends give a last record that ``derivatives`` tells as an error.
    """

    def split(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                stored = pa.BufferReader(content.as_buffer())
                packed = stored.read(2) == b"\x1f\x8b"
                stored.seek(0)
                for record in members(gzip.GzipFile(fileobj=stored) if packed else io.BufferedReader(stored)):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([record], pa.binary())], names=["path", "record"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(split, "path string, record binary")
