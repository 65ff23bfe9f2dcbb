"""WARC archives: one gzip member for each record, written by tasks and read back sequentially.

``write`` gives each record of a payload that an earlier page has too the type revisit, and lets every task write archives of about
ARCHIVE_BYTES into a shared folder. A task names its files anew at each attempt and reports them in its output rows, so what a lost
executor or a repeated attempt left behind is never read. ``read`` opens each reported archive as a stream: members are inflated
step by step, a record's length comes from its Content-Length, block and payload digests are recomputed, and a wrong length or digest raises.

Edge cases: a null html is an empty payload; payloads of any size, empty ones too, are compared, from ``min_bytes`` on; a null url leaves its
header out; a null page_id is never the page that others refer to unless no other has the payload, and then its records are all responses;
rows that repeat page_id and payload of the response are responses too; other columns of the input are left out; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvemill.llm.flow import materialize, only, scratch_path

ARCHIVE_BYTES = 64 << 20
STEP = 1 << 16
LEVEL = 5
# a header of the record beyond this is taken for a broken archive
MAX_HEADER = 1 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(page_id) -> str:
    return f"<urn:x-page:{page_id}>"


def record(page_id, url: str | None, payload: bytes, refers_to, level: int = LEVEL) -> bytes:
    """One gzip member. A revisit keeps the HTTP header, which tells the length of the payload, and leaves the payload out."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c not in "\r\n" else f"%{ord(c):02X}" for c in url))
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + deflate.flush()


def members(stream) -> Iterator[Iterator[bytes]]:
    """The inflated bytes of one gzip member after the other, in steps; ``stream`` is read in steps too."""
    left = b""

    def inflate() -> Iterator[bytes]:
        nonlocal left
        z = zlib.decompressobj(31)
        while not z.eof:
            data = z.unconsumed_tail or left or stream.read(STEP)
            left = b""
            if not data:
                raise ValueError("archive ends inside a gzip member")
            yield z.decompress(data, STEP)
        left = z.unused_data

    while left or (left := stream.read(STEP)):
        yield inflate()


def parse(steps: Iterator[bytes]) -> Record:
    """A record from the bytes of its member, framed by Content-Length; the block digest is verified."""
    held = bytearray()
    while (end := held.find(b"\r\n\r\n")) < 0:
        if len(held) > MAX_HEADER:
            raise ValueError("no end of the record header")
        try:
            held += next(steps)
        except StopIteration:
            raise ValueError("member ends inside the record header") from None
    lines = held[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    del held[: end + 4]
    for step in steps:
        held += step
    length = int(headers["Content-Length"])
    if len(held) != length + 4 or held[length:] != b"\r\n\r\n":
        raise ValueError(f"record of {len(held) - 4} bytes, Content-Length {length}")
    block = bytes(memoryview(held)[:length])
    if headers["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"block digest of {headers['WARC-Record-ID']}")
    return Record(headers, block)


def payload_of(rec: Record) -> tuple[bytes | None, int]:
    """The payload (None in a revisit) and the length of the full payload; the payload digest is verified."""
    http, _, payload = rec.block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if rec.headers["WARC-Type"] == "revisit":
        return None, length
    if len(payload) != length or rec.headers["WARC-Payload-Digest"] != f"sha1:{digest(payload)}":
        raise ValueError(f"payload of {rec.headers['WARC-Record-ID']}")
    return payload, length


def _open(uri: str, mode: str):
    from pyarrow import fs
    system, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return system.open_output_stream(path, compression=None) if mode == "w" else system.open_input_stream(path, compression=None)


def _make_folder(uri: str) -> None:
    from pyarrow import fs
    system, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    system.create_dir(path, recursive=True)


def _id(value) -> int | None:
    return None if value is None or pd.isna(value) else int(value)


def write(pages: DataFrame, folder: str, min_bytes: int = 0, level: int = LEVEL, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``page_id, url, html`` as archives below ``folder`` (a URI); returns ``path, records, bytes`` of each."""
    p = only(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    p = p.withColumn("digest", F.sha1(F.encode("html", "utf-8")))
    sized = p.select("page_id", "digest").where(F.octet_length("html") >= min_bytes)
    first = sized.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = sized.join(first, "digest").where("first is not null and (page_id is null or page_id <> first)")
    again = again.select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    named = again.select(F.coalesce("page_id", F.lit(-1)).alias("_k"), F.col("page_id").isNull().alias("_null"), "digest", "refers_to")
    p = p.withColumns({"_k": F.coalesce("page_id", F.lit(-1)), "_null": F.col("page_id").isNull()})
    p = p.join(named, ["_k", "_null", "digest"], "left").select(F.col("page_id").cast("string"), "url", "html", F.col("refers_to").cast("string"))

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, path, n, size = None, "", 0, 0
        try:
            for f in frames:
                for page_id, url, html, refers in zip(f["page_id"], f["url"], f["html"], f["refers_to"]):
                    if out is None:
                        path, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = _open(path, "w")
                    data = record(page_id or "", url, html.encode("utf-8", "replace"), refers, level)
                    out.write(data)
                    n, size = n + 1, size + len(data)
                    if size >= archive_bytes:
                        out.close()
                        out = None
                        yield pd.DataFrame({"path": [path], "records": [n], "bytes": [size]})
            if out is not None:
                out.close()
                out = None
                yield pd.DataFrame({"path": [path], "records": [n], "bytes": [size]})
        finally:
            if out is not None:
                out.close()

    _make_folder(folder)
    return materialize(p.mapInPandas(put, "path string, records long, bytes long"))


def read(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives that ``archives`` lists (``path, records``), checked: a wrong frame, digest or count raises."""
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]

    def get(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, expected in zip(f["path"], f["records"]):
                rows, held, n = [], 0, 0
                with _open(path, "r") as stream:
                    for member in members(stream):
                        rec = parse(member)
                        payload, length = payload_of(rec)
                        h = rec.headers
                        named = [h[k][len("<urn:x-page:"):-1] if k in h else "" for k in ("WARC-Record-ID", "WARC-Refers-To")]
                        row = [int(named[0]) if named[0] else None, h.get("WARC-Target-URI"), length, h["WARC-Payload-Digest"].removeprefix("sha1:"),
                               h["WARC-Type"], int(named[1]) if named[1] else None]
                        rows.append(row + [payload] * with_payload)
                        n, held = n + 1, held + 200 + len(payload or b"") * with_payload
                        if held > 4 << 20:
                            yield _frame(rows, columns)
                            rows, held = [], 0
                if n != expected:
                    raise ValueError(f"{path}: {n} records, {expected} were written")
                if rows:
                    yield _frame(rows, columns)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    n = max(1, min(10_000, archives.count()))
    return archives.repartition(n).mapInPandas(get, schema + ", payload binary" * with_payload)


def _frame(rows: list[list], columns: list[str]) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=columns)
    return f.astype({"page_id": "Int64", "refers_to": "Int64"})


def round_trip(pages: DataFrame, with_payload: bool = False) -> DataFrame:
    folder = scratch_path(pages.sparkSession, "warc")
    return read(write(pages, folder), with_payload)
