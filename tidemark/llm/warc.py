"""WARC archives: a writer with payload revisits and a reader that salvages damaged files.

The reader checks every record (member check sum, version line, header block,
block length, closing blank lines, payload digest).  After a failed check it
searches for the next member or version line that starts a valid record,
goes on from there, and logs the bytes between as quarantined.  Blocks are
checked as they stream by, and a place that the reader returns to is read
again, so memory follows header blocks, and payloads only where they are asked
for; no length is too long.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import light, new_path, partitions, staged

#: Payloads of fewer bytes are never written as revisits.
LEAST_REVISIT = 100
#: A writer starts a new archive beyond so many compressed bytes.
ARCHIVE_BYTES = 64 << 20

_INTEGER = re.compile(r"-?[0-9]{1,18}")
_MEMBER, _VERSION = b"\x1f\x8b\x08", b"WARC/1."
#: Header names and the revisit profile of the WARC 1.0 format.
_MANDATORY = {"warc-type", "warc-record-id", "warc-date", "content-length"}
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page_of(urn: str | None) -> int | None:
    """The page that a record id of this writer names; None for any other id or for a page without one."""
    if not urn or not urn.startswith("<urn:x-page:"):
        return None
    number = urn.removeprefix("<urn:x-page:").removesuffix(">")
    if number and not _INTEGER.fullmatch(number):
        raise Damaged("record id of no page")
    return int(number) if number else None


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One uncompressed record; a revisit carries the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(url.split()))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Damaged(Exception):
    """A record fails a check."""


def _fields(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a colon")
        out[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    return out


def _length(fields: dict[str, str]) -> int:
    if not _INTEGER.fullmatch(n := fields.get("content-length", "")) or n.startswith("-"):
        raise Damaged("no usable content length")
    return int(n)


class _Record:
    """Checks one record as its bytes come by."""

    def __init__(self, keep: bool):
        self.keep = keep
        self.head, self.fields = bytearray(), None
        self.left = 0  # bytes of the block that are still to come
        self.http, self.payload, self.size, self.digest = bytearray(), None, 0, hashlib.sha256()
        self.tail = bytearray()

    def feed(self, chunk: bytes) -> None:
        if self.fields is None:
            seen = max(0, len(self.head) - 3)
            self.head += chunk
            if not self.head.startswith(_VERSION[: len(self.head)]):
                raise Damaged("no version line")
            end = self.head.find(b"\r\n\r\n", seen)
            if end < 0:
                return
            chunk = bytes(self.head[end + 4 :])
            self.begin(bytes(self.head[:end]))
        block, after = chunk[: self.left], chunk[self.left :]
        self.left -= len(block)
        if self.payload is None:
            seen = max(0, len(self.http) - 3)
            self.http += block
            end = self.http.find(b"\r\n\r\n", seen)
            if end < 0:
                block = b""
            else:
                block, self.payload = bytes(self.http[end + 4 :]), bytearray()
                del self.http[end:]
        self.size += len(block)
        self.digest.update(block)
        if self.keep and block:
            self.payload += block
        self.tail += after
        if len(self.tail) > 4:
            raise Damaged("block length differs")

    def begin(self, head: bytes) -> None:
        self.head.clear()
        self.fields = _fields(head.partition(b"\r\n")[2])
        if missing := _MANDATORY - self.fields.keys():
            raise Damaged(f"no {min(missing)}")
        self.left = _length(self.fields)
        _page_of(self.fields.get("warc-record-id"))
        _page_of(self.fields.get("warc-refers-to"))

    def end(self) -> tuple[dict[str, str], bytes, int, str]:
        """Fields, payload (if kept), full payload length and digest of a whole record, or Damaged."""
        if self.fields is None or self.left or self.tail != b"\r\n\r\n":
            raise Damaged("record cut short" if self.fields is not None else "header block does not end")
        full, told = self.size, self.fields.get("warc-payload-digest", "")
        if self.fields.get("warc-type") == "revisit":
            if self.payload is None or self.size:
                raise Damaged("revisit with a payload")
            full = _length(_fields(bytes(self.http).partition(b"\r\n")[2]))
        elif told.startswith("sha256:") and self.digest.hexdigest() != told[7:]:
            raise Damaged("payload digest differs")
        return self.fields, bytes(self.payload or b""), full, told[7:] if told.startswith("sha256:") else self.digest.hexdigest()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, int, str]:
    """Fields, payload, full payload length and digest of one whole record, or Damaged."""
    record = _Record(True)
    record.feed(raw)
    return record.end()


class _Stream:
    """A file's bytes at any place; only what is being looked at is held."""

    def __init__(self, file: BinaryIO, step: int = 1 << 18):
        self.file, self.step, self.base, self.held = file, step, 0, b""
        self.size = file.seek(0, 2)
        self.blank = (0, -1)  # from the first on, the next blank line is at the second

    def take(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if not self.base <= at or at + n > self.base + len(self.held):
            self.file.seek(at)
            self.base, self.held = at, self.file.read(max(n, self.step))
        return self.held[at - self.base : at - self.base + n]

    def find(self, at: int, *what: bytes) -> int | None:
        """The next place from ``at`` on where any of these bytes begin."""
        reach = max(map(len, what)) - 1
        while at < self.size:
            chunk = self.take(at, self.step)
            hits = [h for h in map(chunk.find, what) if h >= 0]
            if hits:
                return at + min(hits)
            if at + len(chunk) >= self.size:
                return None
            at += len(chunk) - reach
        return None

    def blank_line(self, at: int) -> int | None:
        """The next end of a header block; known ones are not searched again."""
        begin, place = self.blank
        if not begin <= at <= place:
            found = self.find(at, b"\r\n\r\n")
            self.blank = (at, self.size if found is None else found)
        return None if self.blank[1] == self.size else self.blank[1]


def _member(stream: _Stream, at: int, keep: bool) -> tuple[tuple, int]:
    """The record of the gzip member at ``at`` and where the member ends."""
    inflate, record, place = zlib.decompressobj(31), _Record(keep), at
    while not inflate.eof:
        chunk = inflate.unconsumed_tail
        if not chunk:
            chunk = stream.take(place, 1 << 16)
            place += len(chunk)
        try:
            out = inflate.decompress(chunk, 1 << 20)
        except zlib.error as bad:
            raise Damaged(f"member: {bad}") from bad
        if not chunk and not out and not inflate.eof:
            raise Damaged("member cut short")
        record.feed(out)
    return record.end(), place - len(inflate.unused_data)


def _plain(stream: _Stream, at: int, keep: bool) -> tuple[tuple, int]:
    """The uncompressed record at ``at`` and where it ends."""
    head = stream.blank_line(at)
    if head is None:
        raise Damaged("header block does not end")
    record = _Record(keep)
    record.begin(stream.take(at, head - at))
    end = head + 4 + record.left + 4
    if end > stream.size:
        raise Damaged("record cut short")
    for place in range(head + 4, end, 1 << 18):
        record.feed(stream.take(place, min(1 << 18, end - place)))
    return record.end(), end


def salvage(file: BinaryIO, keep: bool = True) -> Iterator[tuple[str, int, int, object]]:
    """``("record", offset, bytes, (fields, payload, full length, digest))`` for valid records, ``("gap", offset, bytes, reason)`` for what was skipped.

    Every byte of a file that can seek lies in exactly one of them; payloads
    are empty unless ``keep``.
    """
    stream, at = _Stream(file), 0
    gap: tuple[int, str] | None = None
    while at < stream.size:
        start = stream.take(at, len(_VERSION))
        try:
            if start.startswith(_MEMBER):
                parsed, end = _member(stream, at, keep)
            elif start == _VERSION:
                parsed, end = _plain(stream, at, keep)
            else:
                raise Damaged("neither a member nor a version line")
        except Damaged as bad:
            gap = gap or (at, str(bad))
            following = stream.find(at + 1, _MEMBER, _VERSION)
            at = stream.size if following is None else following
            continue
        if gap:
            yield "gap", gap[0], at - gap[0], gap[1]
            gap = None
        yield "record", at, end - at, parsed
        at = end
    if gap:
        yield "gap", gap[0], at - gap[0], gap[1]


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that executors share, by its URI."""
    return fs.FileSystem.from_uri("s3://" + folder[6:] if folder.startswith("s3a://") else folder)


_ARCHIVES = "archive string, records long, bytes long"


def _write(batches: Iterator[pa.RecordBatch], folder: str, date: str) -> Iterator[pa.RecordBatch]:
    """Archives of this attempt; only those that a finished task returns are ever read."""
    system, root = _open(folder)
    file = name = None
    records = size = 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "first", "revisit")]
        for page_id, url, digest, first, revisit, html in zip(*columns, batch.column("html").cast(pa.binary()), strict=True):
            payload = html.as_buffer().to_pybytes() if html.is_valid else b""
            raw = record_bytes(page_id, url, payload, digest, first if revisit else None, revisit, date)
            press = zlib.compressobj(4, zlib.DEFLATED, 31)
            member = press.compress(raw) + press.flush()
            if file is None:
                name = f"{uuid.uuid4().hex}.warc.gz"
                file = system.open_output_stream(f"{root}/{name}.part", compression=None)
                records = size = 0
            file.write(member)
            records += 1
            size += len(member)
            if size >= ARCHIVE_BYTES:
                yield _closed(system, root, folder, file, name, records, size)
                file = None
    if file is not None:
        yield _closed(system, root, folder, file, name, records, size)


def _closed(system, root: str, folder: str, file, name: str, records: int, size: int) -> pa.RecordBatch:
    file.close()
    system.move(f"{root}/{name}.part", f"{root}/{name}")
    return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([records]), pa.array([size])], names=["archive", "records", "bytes"])


def write_archives(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes one record per row of ``pages(page_id, url, html)`` and returns the archives ``(archive, records, bytes)``.

    The payload is the html in UTF-8, a null one empty.  Of rows with equal
    payloads of at least 100 bytes that with the smallest page_id is the
    response (a null id comes last) and the others are revisits of it; of rows
    that are equal in both, one is the response.  Shorter payloads are all
    responses.  A null url is left out.  Other columns are ignored; an empty
    table writes nothing.
    """
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).alias("n"))
    each = rows.where(F.col("n") >= LEAST_REVISIT).groupBy("page_id", "digest").agg(F.count("*").alias("rows"))
    firsts = each.groupBy("digest").agg(F.min("page_id").alias("first"), F.sum("rows").alias("all_rows")).where("all_rows > 1")
    known = each.join(firsts, "digest").select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "rows", "first", F.col("page_id").eqNullSafe(F.col("first")).alias("original"))
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest"))
    told = rows.join(known.hint("shuffle_hash"), same, "left").select("page_id", "url", "html", "digest", "first", "original", (F.coalesce("original", F.lit(True)) == F.lit(False)).alias("revisit"), F.coalesce(F.col("original") & (F.col("rows") > 1), F.lit(False)).alias("_repeated"))
    columns = ["page_id", "url", "html", "digest", "first", "revisit"]
    # rows that repeat a first page: counted by url (a copy's html goes along once), so that one copy of one url is the response wherever they stand
    again = known.where("original AND rows > 1")
    n = again.count()
    if n:
        copies = rows.join(light(again.select("_page", "_digest", "first"), n), same)
        copies = copies.groupBy("page_id", "url", "digest", "first").agg(F.first("html").alias("html"), F.count("*").alias("times"))
        rank = F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("url"))
        copies = copies.withColumn("_rank", rank).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
        copies = copies.withColumn("revisit", (F.col("_rank") > 1) | (F.col("_copy") > 1))
        told = told.where("NOT _repeated").select(*columns).unionByName(copies.select(*columns))
    folder = new_path(spark, "warc")
    system, root = _open(folder)
    system.create_dir(root, recursive=True)
    archives = staged(told.select(*columns).mapInArrow(partial(_write, folder=folder, date=date), _ARCHIVES), "archives")
    for left in system.get_file_info(fs.FileSelector(root)):  # of attempts that were lost
        if left.path.endswith(".part"):
            system.delete_file(left.path)
    return archives


_READ = "kind string, archive string, offset long, bytes long, reason string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in _READ.split(", ")])
    rows: list[dict] = []
    for batch in batches:
        for archive in batch.column("archive").to_pylist():
            folder, _, name = archive.rpartition("/")
            system, root = _open(folder)
            with system.open_input_file(f"{root}/{name}") as file:
                for kind, offset, size, what in salvage(file, with_payload):
                    row = {"kind": kind, "archive": archive, "offset": offset, "bytes": size}
                    if kind == "gap":
                        row["reason"] = what
                    else:
                        fields, payload, full, digest = what
                        row |= {
                            "page_id": _page_of(fields.get("warc-record-id")),
                            "url": fields.get("warc-target-uri"),
                            "payload_bytes": full,
                            "payload_digest": digest,
                            "record_type": fields.get("warc-type"),
                            "refers_to": _page_of(fields.get("warc-refers-to")),
                            "payload": payload if with_payload else None,
                        }
                    rows.append(row)
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """Rows of ``kind`` "record" for every valid record and "gap" for every quarantined stretch of ``archives(archive)``.

    An archive is read by one task as a stream; archives are dealt out evenly.
    An empty list, and an empty file, give no rows.
    """
    dealt = archives.select("archive").repartition(partitions(archives.sparkSession))
    return dealt.mapInArrow(partial(_read, with_payload=with_payload), _READ)
