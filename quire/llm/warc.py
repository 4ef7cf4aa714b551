"""WARC archives: writer with payload revisits, and a reader that salvages.

The writer makes one record for every page, each a gzip member of its own.
Members are joined until they fill a file, by bytes or by number; Spark's text
writer puts each such piece into a file and ends it with an empty gzip member, so
that every file is a plain sequence of members.

The reader walks through the members (or the records of an uncompressed file).
Where a check fails (member checksum, version line, header, lengths, digests,
record end) it looks for the next gzip member or version line from which a
whole record can be read, goes on there, and logs the bytes in between as a
quarantined gap with the reason.  Inside a member it does the same over the
unpacked bytes; of a cut or damaged member those before the fault are read, and
where the member is damaged a record counts as whole only if a digest proves it.
A file is read in one piece, so the writer bounds a file's bytes (up to its last
record, ``FILE_BYTES``) and records (``FILE_RECORDS``).  Numbers that no record
can have, and headers beyond ``MAX_HEADER`` bytes, are damage like any other.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import batch_rows, record_batches, shared_table
from quire.plans.hot import join_by_weight

FILE_RECORDS = 5_000
FILE_BYTES = 32 << 20
MAX_HEADER = 16 << 20
_LENGTH = re.compile(r"[0-9]{1,18}")
# Formats.
_EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003" "0300000000000000" "0000")
_MEMBER = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_PAGE = "urn:page:"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_FULL_LENGTH = "X-Payload-Length"
_CHUNK = 1 << 14
_END = b"\r\n\r\n"
_CUT, _DAMAGED = "member cut off", "member damaged"


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 SHA-1: ten hexadecimal digits are eight of base 32."""
    hexed = F.sha1(payload)
    digits = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def planned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            revisit_from: int = 0) -> DataFrame:
    """``(id, url, payload, digest, first)``: ``first`` is the id that the page
    revisits, null for a response.

    Of equal payloads of at least ``revisit_from`` bytes the smallest id is the
    response (each row of it, should it repeat); the others revisit it.  Rows
    with a null id revisit an id if there is one, else they are responses.
    A null html is an empty payload.
    """
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                        payload.alias("payload"), payload_digest(payload).alias("digest"))
    small = shared_table(rows.where(F.octet_length("payload") >= revisit_from).select("id", "digest"))
    least = shared_table(small.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    # one row for each page that revisits: written down, its size tells Spark how to join
    revisits = shared_table(join_by_weight(small, least, ["digest"], "n").where(~F.col("id").eqNullSafe(F.col("first")))
                            .select("id", "digest", "first").distinct())
    same = rows["id"].eqNullSafe(revisits["id"]) & (rows["digest"] == revisits["digest"])
    return rows.join(revisits, same, "left").select(rows["id"], "url", "payload", rows["digest"], "first")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None,
           date: str) -> bytes:
    """One WARC record, uncompressed.  A revisit has the HTTP header only."""
    http = _HTTP.format(len(payload)).encode()
    block = http if first is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}",
             f"WARC-Record-ID: <{_PAGE}{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
             f"WARC-Payload-Digest: sha1:{digest}",
             f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if first is not None:
        lines += [f"WARC-Refers-To: <{_PAGE}{first}>", f"WARC-Profile: {_PROFILE}", f"{_FULL_LENGTH}: {len(payload)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + _END + block + _END


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write(plan: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", file_records: int = FILE_RECORDS,
          file_bytes: int = FILE_BYTES) -> None:
    """Write the planned records as archives into the folder ``path``."""
    schema = pa.schema([("members", pa.binary())])

    def files(batches):
        held, size = [], 0
        for row in batch_rows(batches):
            packed = member(record(*row, date))
            if held and (len(held) >= file_records or size + len(packed) > file_bytes):
                yield (b"".join(held),)
                held, size = [], 0
            held.append(packed)
            size += len(packed)
        if held:
            yield (b"".join(held),)

    (plan.select("id", "url", "payload", "digest", "first")
     .mapInArrow(lambda batches: record_batches(files(batches), schema, 1), "members binary")
     .select(F.col("members").cast("string"))
     .write.option("lineSep", _EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1")
     .option("maxRecordsPerFile", 1).text(path))


@dataclass(frozen=True)
class Found:
    """A record (``headers`` set) or a quarantined gap (``reason`` set) of a file.

    Inside a gzip member, start and end are the member's (up to what can be read
    next, if it isn't whole); a gap's reason names the unpacked bytes.
    """

    start: int
    end: int
    headers: dict[str, str] | None = None
    block: bytes = b""
    reason: str | None = None


class _Damage(Exception):
    pass


def _parse(data: memoryview, start: int, limit: int, proof: bool = False) -> tuple[int, dict[str, str], bytes]:
    """A whole record at ``start``: its end, headers and block.  With ``proof``
    it must have a digest."""
    if bytes(data[start:start + len(_VERSION)]) != _VERSION:
        raise _Damage("no version line")
    size = 1024
    while (head := bytes(data[start:min(start + size, limit)])).find(_END) < 0:
        if start + size >= limit or size >= MAX_HEADER:
            raise _Damage("header without end")
        size *= 4
    cut = head.find(_END)
    headers = {}
    for line in head[:cut].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise _Damage("bad header line")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if "content-length" not in headers or "warc-type" not in headers or "warc-record-id" not in headers:
        raise _Damage("header incomplete")
    if not all(_LENGTH.fullmatch(headers.get(n, "0")) for n in ("content-length", _FULL_LENGTH.lower())):
        raise _Damage("header with a bad length")
    begin = start + cut + len(_END)
    stop = begin + int(headers["content-length"])
    if stop + len(_END) > limit:
        raise _Damage("record cut off")
    if bytes(data[stop:stop + len(_END)]) != _END:
        raise _Damage("no record end")
    block = bytes(data[begin:stop])
    proved = _check(headers, "warc-block-digest", block)
    if headers["warc-type"] == "response":
        proved = _check(headers, "warc-payload-digest", payload_of(headers, block)) or proved
    if proof and not proved:
        raise _Damage("no digest to prove the record")
    return stop + len(_END), headers, block


def _check(headers: dict[str, str], name: str, data: bytes) -> bool:
    """Whether there is a digest to check (it is right then)."""
    kind, _, value = headers.get(name, "").partition(":")
    if kind.lower() != "sha1":
        return False
    if value != base64.b32encode(hashlib.sha1(data).digest()).decode():
        raise _Damage(f"wrong {name}")
    return True


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The block without its HTTP header, if it has one."""
    if not headers.get("content-type", "").startswith("application/http"):
        return block
    return block.partition(_END)[2]


def _unpack(data: memoryview, start: int, limit: int) -> tuple[int, bytes, str | None]:
    """The gzip member at ``start``: its end, contents and fault.  A whole member
    (checksum tested) has none; of another one the contents are what unpacks
    before the fault, and the end is where that is."""
    unpacker, parts, at, step = zlib.decompressobj(31), [], start, _CHUNK
    while not unpacker.eof:
        if at >= limit:
            return at, b"".join(parts), _CUT
        before = unpacker.copy()
        try:
            parts.append(unpacker.decompress(data[at:min(at + step, limit)]))
            at = min(at + step, limit)
        except zlib.error:
            if step == 1:
                parts.extend(_last_bytes(before, bytes(data[at:at + 1])))
                return at, b"".join(parts), _DAMAGED
            unpacker, step = before, max(1, step // 16)
    return at - len(unpacker.unused_data), b"".join(parts), None


def _last_bytes(unpacker, data: bytes) -> Iterator[bytes]:
    """What still unpacks before the fault that is in ``data``."""
    try:
        while part := unpacker.decompress(data, 1):
            yield part
            data = unpacker.unconsumed_tail
    except zlib.error:
        return


def _inside(contents: bytes, start: int, end: int, fault: str | None) -> Iterator[Found]:
    """All whole records of a member's contents, and the gaps between them, in
    order; the last gap is the member's fault, if it has one."""
    view, at, size, proof = memoryview(contents), 0, len(contents), fault == _DAMAGED
    while at < size:
        try:
            stop, headers, block = _parse(view, at, size, proof)
            yield Found(start, end, headers, block)
        except _Damage as damage:
            stop = _next_version(contents, view, at + 1, proof)
            if stop == size and fault:
                break
            yield Found(start, end, reason=f"{damage} (unpacked bytes {at} to {stop})")
        at = stop
    if fault:
        yield Found(start, end, reason=f"{fault} (unpacked bytes {at} to {size})" if size else fault)


def _next_version(contents: bytes, view: memoryview, start: int, proof: bool) -> int:
    """The next place of a member's contents from which a whole record can be read, or the end."""
    while (start := contents.find(_VERSION, start)) >= 0:
        try:
            _parse(view, start, len(contents), proof)
            return start
        except _Damage:
            start += 1
    return len(contents)


def salvage(content: bytes) -> Iterator[Found]:
    """All whole records of an archive, and the gaps between them, in order."""
    data, at = memoryview(content), 0
    while at < len(content):
        if bytes(data[at:at + len(_MEMBER)]) == _MEMBER:
            end, contents, fault = _unpack(data, at, len(content))
            if fault:
                stop, end = end, _next(content, data, at + 1)
                if stop > end:  # it ran into what can be read by itself
                    _, contents, fault = _unpack(data, at, end)
            yield from _inside(contents, at, end, fault)
        else:
            try:
                end, headers, block = _parse(data, at, len(content))
                yield Found(at, end, headers, block)
            except _Damage as damage:
                end = _next(content, data, at + 1)
                yield Found(at, end, reason=str(damage))
        at = end


def _readable(data: memoryview, start: int) -> bool:
    """Whether a whole record, or an empty member, can be read at ``start``."""
    if bytes(data[start:start + len(_MEMBER)]) == _MEMBER:
        end, contents, fault = _unpack(data, start, len(data))
        return not (contents or fault) or any(f.headers for f in _inside(contents, start, end, fault))
    try:
        _parse(data, start, len(data))
        return True
    except _Damage:
        return False


def _next(content: bytes, data: memoryview, start: int) -> int:
    """The next place from which something whole can be read, or the end."""
    places = {_MEMBER: -2, _VERSION: -2}
    while True:
        for mark, place in places.items():
            if place != -1 and place < start:
                places[mark] = content.find(mark, start)
        ahead = [p for p in places.values() if p >= 0]
        if not ahead:
            return len(content)
        start = min(ahead)
        if _readable(data, start):
            return start
        start += 1


def read_back(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row for each record and each gap of the archives under ``path``:
    ``(file, start, stop, reason, record_type, page, url, payload_bytes, digest,
    refers_to, payload)``; ``reason`` is null for records, all that follows it
    is null for gaps.  Length and digest are of the full payload, also for
    revisits, whose payload is null."""
    fields = [("file", "string"), ("start", "long"), ("stop", "long"), ("reason", "string"), ("record_type", "string"),
              ("page", "long"), ("url", "string"), ("payload_bytes", "long"), ("digest", "string"),
              ("refers_to", "long"), ("payload", "binary")]
    arrow = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, arrow[t]) for n, t in fields])

    def page(value: str | None) -> int | None:
        number = (value or "").strip("<>").removeprefix(_PAGE)
        found = int(number) if re.fullmatch(r"-?[0-9]{1,19}", number) else None
        return found if found is not None and -(1 << 63) <= found < 1 << 63 else None

    def row(file: str, f: Found) -> tuple:
        if f.headers is None:
            return (file, f.start, f.end, f.reason) + (None,) * 7
        h, body = f.headers, payload_of(f.headers, f.block)
        revisit = h["warc-type"] == "revisit"
        digest = h.get("warc-payload-digest", "").rpartition(":")[2] if revisit else \
            base64.b32encode(hashlib.sha1(body).digest()).decode()
        size = int(h.get(_FULL_LENGTH.lower(), "0")) if revisit else len(body)
        return (file, f.start, f.end, None, h["warc-type"], page(h["warc-record-id"]), h.get("warc-target-uri"),
                size, digest, page(h.get("warc-refers-to")), body if with_payload and not revisit else None)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                file, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                yield from record_batches((row(file, f) for f in salvage(content)), schema, 512)

    return (spark.read.format("binaryFile").load(path).select("path", "content")
            .mapInArrow(run, ", ".join(f"{n} {t}" for n, t in fields)))
