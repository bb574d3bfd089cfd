"""WARC archives: one gzip member per record, written and read in tasks.

Writing: a record per page, type ``response``, or ``revisit`` if an equal payload is kept by another page (the one with
the largest ``page_id``).  The block is an HTTP head and, for responses, the payload; ``WARC-Payload-Digest`` is
the base32 SHA-1 of the full payload in both.  Each task writes an archive of its own under a new name
and the manifest names the archives of committed tasks.

Reading is sequential: bytes go through an incremental ``zlib`` inflater, a member at a time; the head ends at the
first blank line and ``Content-Length`` frames the block, so memory holds one record.  Digests that a record states are
verified; a record that fails raises ``ValueError`` (or is marked, with ``strict=False``).  Archives of other writers are read too:
any record type (``types`` chooses), any record id, with or without digests and HTTP heads; an archive is one task's work.  A body
in chunks (``Transfer-Encoding: chunked``) is put together first: that is the payload, and a stated payload digest may be of
either form, as writers differ.  A body that claims chunks without having them is taken as it is.

Defined cases: a null html is an empty payload; a null url has no target URI; a null ``page_id`` is written as
``null`` and read back as null.  Pages that tie on the largest ``page_id`` of a payload are all responses; if all ids of a
payload are null, all are.  Repeated rows are a record each; very long payloads are whole; an empty table makes no archive.  Line breaks
in urls are percent-encoded.  Other columns aren't stored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_dir, open_folder

CHUNK = 1 << 16
TYPES = ("response", "revisit")
RECORD = "record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, verified boolean"


def digest_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, page: int | None, url: str | None, payload: bytes, refers: int | None) -> bytes:
    """One record as one gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{'null' if page is None else page}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:x-page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest_of(payload)}", f"WARC-Block-Digest: sha1:{digest_of(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def members(stream) -> Iterator[bytes]:
    """Bytes of each gzip member of ``stream``, inflated in steps."""
    data = b""
    while True:
        data = data or stream.read(CHUNK)
        if not data:
            return
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            parts.append(z.decompress(data))
            data = z.unused_data if z.eof else stream.read(CHUNK)
            if not data and not z.eof:
                raise ValueError("the archive ends inside a record")
        yield b"".join(parts)


def _fields(lines: list[str]) -> dict[str, str]:
    """Names in lower case -> values; a line that begins with white space goes on with the last value."""
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _matches(said: str | None, data: bytes) -> bool | None:
    """Whether ``data`` has the digest that a record states: ``algorithm:value`` in base32 or hex; None if that can't be told."""
    kind, _, value = (said or "").partition(":")
    if kind.lower().replace("-", "") not in ("sha1", "sha256", "md5"):
        return None
    real = hashlib.new(kind.lower().replace("-", ""), data)
    return value.upper().rstrip("=") == base64.b32encode(real.digest()).decode().rstrip("=") or value.lower() == real.hexdigest()


def dechunked(body: bytes) -> bytes | None:
    """A chunked HTTP body put together, trailers left out; None if it isn't one."""
    parts, at = [], 0
    while m := re.compile(rb"[ \t]*([0-9A-Fa-f]+)[ \t]*(?:;[^\r\n]*)?\r\n").match(body, at):
        size, at = int(m[1], 16), m.end()
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            return None
        parts.append(body[at : at + size])
        at += size + 2
    return None


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<?urn:x-page:(-?\d+)>?", urn or "")
    return int(m[1]) if m else None


def parse(raw: bytes) -> dict:
    """Head, block and payload of a record, with the outcome of its digests (None if it states none)."""
    top, blank, rest = raw.partition(b"\r\n\r\n")
    version, *lines = top.decode("utf-8", "surrogateescape").split("\r\n")
    head = _fields(lines)
    length = head.get("content-length", "")
    if not version.startswith("WARC/") or not blank or not length.isdigit():
        raise ValueError("this isn't a WARC record")
    size = int(length)
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record is not framed by its Content-Length")
    kind = head.get("warc-type", "")
    http = head.get("content-type", "").lower().startswith("application/http") or block[:5] == b"HTTP/"
    payload, full = (None if kind == "revisit" else block), size
    body = payload
    if http:
        top, _, body = block.partition(b"\r\n\r\n")
        fields = _fields(top.decode("latin-1").split("\r\n")[1:])
        stated, coded = fields.get("content-length", ""), fields.get("transfer-encoding", "").lower()
        whole = dechunked(body) if coded.endswith("chunked") else None
        payload = None if kind == "revisit" else body if whole is None else whole
        full = len(payload) if payload is not None else int(stated) if stated.isdigit() else None
    said = head.get("warc-payload-digest")
    right = None if payload is None else _matches(said, payload)
    if right is False and payload is not body:
        right = _matches(said, body)  # as it was sent
    known = [_matches(head.get("warc-block-digest"), block), right]
    known = [k for k in known if k is not None]
    digest = said.partition(":")[2] if said else digest_of(payload) if payload is not None else None
    return {
        "record_id": head.get("warc-record-id"), "page_id": _page(head.get("warc-record-id")), "url": head.get("warc-target-uri"), "record_type": kind,
        "refers_to": _page(head.get("warc-refers-to")), "payload_bytes": full, "payload_digest": digest, "payload": payload, "verified": all(known) if known else None,
    }


def _write(out_dir: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, name, records = None, "", 0
        for b in batches:
            for page, url, html, refers, kind in zip(*(c.to_pylist() for c in b.columns)):
                if stream is None:
                    fs, folder = open_folder(out_dir)
                    fs.create_dir(folder, recursive=True)
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    stream = fs.open_output_stream(f"{folder}/{name}", compression=None)
                stream.write(record(kind, page, url, (html or "").encode("utf-8", "surrogatepass"), refers))
                records += 1
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64())], ["file", "records"])

    return run


def write_warc(pages: DataFrame, out_dir: str, least: int = 0) -> DataFrame:
    """Write ``pages(page_id, url, html)``; equal payloads of ``least`` bytes or more are revisits of one response.
    Returns the manifest ``file, records``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    body = F.coalesce("html", F.lit("")).cast("binary")
    mark = lambda df: df.withColumn("mark", F.sha1(body))
    kept = mark(rows.select("page_id", "html")).where(F.octet_length(body) >= least).groupBy("mark").agg(F.max("page_id").alias("keeper"))
    refers = F.when((F.col("page_id") != F.col("keeper")) | (F.col("page_id").isNull() & F.col("keeper").isNotNull()), F.col("keeper"))
    placed = mark(rows).join(kept, "mark", "left").select("page_id", "url", "html", refers.alias("refers"))
    kind = F.when(F.col("refers").isNull(), "response").otherwise("revisit")
    return materialize(placed.select("*", kind.alias("kind")).mapInArrow(_write(out_dir), "file string, records long"), "archives")


def _read(out_dir: str, payloads: bool, strict: bool, types: tuple[str, ...] | None):
    kinds = {"record_id": pa.string(), "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary(), "verified": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_folder(out_dir)
        rows: list[dict] = []
        size = 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in kinds.items()], list(kinds))
        for b in batches:
            for name in b.column(0).to_pylist():
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for raw in members(stream):
                        r = parse(raw)
                        if types is not None and r["record_type"] not in types:
                            continue
                        if strict and r["verified"] is False:
                            raise ValueError(f"{name}: a digest of {r['record_id']} doesn't match")
                        if not payloads:
                            r["payload"] = None
                        rows.append(r)
                        size += len(r["payload"] or b"")
                        if len(rows) >= 1000 or size > 1 << 23:
                            yield flush()
                            rows.clear()
                            size = 0
        if rows:
            yield flush()

    return run


def read_warc(archives: DataFrame, out_dir: str, payloads: bool = True, strict: bool = True, types: tuple[str, ...] | None = TYPES) -> DataFrame:
    """The records of ``archives(file)``, names of files in ``out_dir``, as :data:`RECORD`; ``types`` None reads every record type.
    A task reads the archives of one partition of ``archives``."""
    # The manifest has a file for each task that wrote an archive, and a scan spreads files over all cores: a shuffle would only
    # add Python tasks without an archive.
    return archives.select("file").mapInArrow(_read(out_dir, payloads, strict, types), RECORD)


def round_trip(pages: DataFrame, out_dir: str | None = None) -> DataFrame:
    """Write, then read back without the payloads."""
    out_dir = out_dir or new_dir(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, out_dir), out_dir, payloads=False)
