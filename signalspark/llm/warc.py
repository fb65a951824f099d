"""WARC archives: written, normalised to a member a record, and read back by an offset index.

Some crawlers write an archive as one gzip stream, whose records can't be reached but by inflating
all before them. ``normalise`` inflates such a stream once, from its start to its end, a chunk at
a time, and writes every record as a gzip member of its own; a sidecar index beside the archive
says where each member begins and how long it is. ``read_records`` reads members by that index,
in any order and by as many tasks as there is work for.

A payload that several pages have is written once: the page of the smallest page_id has it as a
``response``, the others are a ``revisit`` that refers to it and keeps its digest and length.

Files are written to a folder that all executors share, by any file system that pyarrow knows. Each
attempt of a task writes files with names of its own; an index takes its final name when both it and
its archive are whole, so a lost executor's work is done again and nothing is read that is half.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_folder, checkpointed, join_counted, read_spread

#: A new archive is begun after so many bytes of records, so that one inflating task has an end.
ARCHIVE_BYTES = 256_000_000
#: A reading task gets about so many bytes of members.
READ_BYTES = 32_000_000
CHUNK = 1 << 20
#: Repeated pages beyond this many rows are joined by a shuffle instead of a broadcast (some 60 bytes a row).
BROADCAST_ROWS = 200_000

GZIP = 31  # window bits of zlib for a gzip wrapper
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Pages have no time of their own, and a record must have one.
DATE = "1970-01-01T00:00:00Z"
PAGE_URN = "urn:x-page:"

INDEX_SCHEMA = "archive string, offset long, length long, record_type string, record_id string"
RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, archive string, offset long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _files(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and path of a folder as Spark writes it (``file:/tmp/x`` has one slash)."""
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri)) if ":/" in uri else (pa.fs.LocalFileSystem(), uri)


# writing -----------------------------------------------------------------------------------------


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{name}: {value}\r\n" for name, value in headers)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, html: str | None, revisit: bool, first: int | None) -> bytes:
    """The record of a page: a response with its payload, or a revisit of page ``first``. Control
    characters and spaces of an address are percent-encoded, as they would end its header."""
    payload = (html or "").encode("utf-8", "replace")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{PAGE_URN}{'' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    headers += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}")]
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{PAGE_URN}{first}>")]
    return _record(headers, http if revisit else http + payload)


class _Archive:
    """A file that is one gzip stream of records, under a name of this attempt's own."""

    def __init__(self, folder: str, name: str):
        files, path = _files(folder)
        self.name = f"{name}-{uuid.uuid4().hex}.warc.gz"
        self.out = files.open_output_stream(f"{path}/{self.name}", compression=None)
        self.pack = zlib.compressobj(1, zlib.DEFLATED, GZIP)
        self.bytes = self.records = 0
        self.add(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))

    def add(self, record: bytes) -> None:
        self.out.write(self.pack.compress(record))
        self.bytes += len(record)
        self.records += 1

    def close(self) -> pa.RecordBatch:
        self.out.write(self.pack.flush())
        self.out.close()
        return pa.RecordBatch.from_pydict({"archive": [self.name], "records": [self.records], "bytes": [self.bytes]})


def _with_first(pages: DataFrame, broadcast_rows: int) -> DataFrame:
    """``pages`` with ``revisit`` and ``first``, the smallest page_id with an equal payload."""
    digest = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    keyed = checkpointed(pages.select("page_id", digest.alias("digest")))
    groups = checkpointed(keyed.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    later = join_counted(keyed, groups, ["digest"]).where("not page_id <=> first").distinct()
    later = checkpointed(later.select(F.col("page_id").alias("__id"), "digest", "first"))
    named = pages.select("page_id", "url", "html", digest.alias("__digest"))
    small = F.broadcast(later) if later.count() <= broadcast_rows else later
    joined = named.join(small, (F.col("page_id").eqNullSafe(F.col("__id"))) & (F.col("__digest") == F.col("digest")), "left")
    return joined.select("page_id", "url", "html", F.col("digest").isNotNull().alias("revisit"), "first")


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(archive, records, bytes)`` of the archives in ``folder`` that now hold a record of every
    row of ``pages(page_id, url, html)``, each archive one gzip stream.

    Of rows with equal payloads (html in UTF-8; a null is empty) those with the smallest page_id are
    responses, the others revisits of it; a null page_id is larger than any, and rows that repeat the
    smallest are all responses. No rows write no archives. Other columns are ignored.
    """

    files, path = _files(folder)
    files.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, part = None, TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    archive = archive or _Archive(folder, f"{part:05d}")
                    archive.add(page_record(row["page_id"], row["url"], row["html"], row["revisit"], row["first"]))
                    if archive.bytes >= archive_bytes:
                        yield archive.close()
                        archive = None
        if archive:
            yield archive.close()

    rows = _with_first(pages.select(F.col("page_id").cast("long"), "url", "html"), broadcast_rows)
    return checkpointed(rows.mapInArrow(run, "archive string, records long, bytes long"))


# normalising -------------------------------------------------------------------------------------


class Inflated:
    """Bytes of a file that is plain, or gzip in one member or in many; read once, in order."""

    def __init__(self, source):
        self.source, self.unpack, self.buffer, self.ended = source, None, bytearray(), False
        head = source.read(CHUNK)
        self.plain = head[:2] != b"\x1f\x8b"
        self._take(head)

    def _take(self, data: bytes) -> None:
        if self.plain:
            self.buffer += data
            return
        while data:
            self.unpack = self.unpack or zlib.decompressobj(GZIP)
            self.buffer += self.unpack.decompress(data, CHUNK)
            data = self.unpack.unconsumed_tail
            if self.unpack.eof:
                data, self.unpack = self.unpack.unused_data, None
                if data[:2] != b"\x1f\x8b":  # some writers pad a file with zeros
                    data = b""
            elif data and len(self.buffer) >= 4 * CHUNK:
                self.kept = data
                return
        self.kept = b""

    def more(self) -> bool:
        """Read on; false at the end."""
        if self.ended:
            return False
        data = getattr(self, "kept", b"") or self.source.read(CHUNK)
        if not data:
            if self.unpack is not None:
                raise ValueError("the gzip stream ends before its end mark")
            self.ended = True
            return False
        self._take(bytes(data))
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before ``mark``, which is passed over; None if nothing is left."""
        seen = 0
        while (at := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self.more():
                if self.buffer.strip(b"\r\n"):
                    raise ValueError("the archive ends inside a header")
                return None
        out = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes, in chunks."""
        while n:
            if not self.buffer and not self.more():
                raise ValueError("the archive ends inside a record")
            piece = bytes(self.buffer[:n])
            del self.buffer[: len(piece)]
            n -= len(piece)
            if piece:
                yield piece


def parsed_headers(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the version's line is no field."""
    fields = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in fields}


def records_of(source) -> Iterator[tuple[bytes, dict[str, str], Iterator[bytes]]]:
    """Header, its fields and the block in chunks, of each record; a block must be used up first."""
    data = Inflated(source)
    while (head := data.until(b"\r\n\r\n")) is not None:
        head = head.lstrip(b"\r\n")
        if not head:
            continue
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {head[:20]!r}")
        fields = parsed_headers(head)
        yield head, fields, data.take(int(fields.get("content-length", 0)))


def _normalised(source, out, archive: str) -> Iterator[dict]:
    """Write each record of ``source`` as a member of ``out``; yields their index rows."""
    offset = 0
    for head, fields, block in records_of(source):
        pack, length = zlib.compressobj(6, zlib.DEFLATED, GZIP), 0
        for piece in chain([head + b"\r\n\r\n"], block, [b"\r\n\r\n"]):
            length += out.write(pack.compress(piece))
        length += out.write(pack.flush())
        yield {"archive": archive, "offset": offset, "length": length, "record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id", "").strip("<>")}
        offset += length


def normalise(archives: DataFrame, source: str, target: str) -> DataFrame:
    """``(archive, records, bytes)`` of the archives in ``target/archives``, one for each of
    ``archives(archive)`` in the folder ``source``, with a member a record; their sidecar indexes are JSON lines in
    ``target/index``.

    An archive is plain, or gzip of one member or many, and is read once in chunks, so its size and
    that of a record's block have no bound but the disk's. One that breaks off raises an error. A null name is left out.
    """
    files, path = _files(target)
    for part in ("archives", "index"):
        files.create_dir(f"{path}/{part}", recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (files, path), (sources, source_path) = _files(target), _files(source)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                stem = re.sub(r"\.warc(\.gz)?$", "", name)
                attempt = f"{stem}-{uuid.uuid4().hex[:8]}"
                archive, side = f"{attempt}.warc.gz", f"{path}/index/_{attempt}"
                records = size = 0
                with sources.open_input_stream(f"{source_path}/{name}", compression=None) as data, files.open_output_stream(f"{path}/archives/{archive}", compression=None) as out, files.open_output_stream(side, compression=None) as index:
                    for row in _normalised(data, out, archive):
                        index.write(json.dumps(row).encode() + b"\n")
                        records, size = records + 1, row["offset"] + row["length"]
                files.move(side, f"{path}/index/{stem}.json")  # files that begin with _ are no input of Spark's readers
                yield pa.RecordBatch.from_pydict({"archive": [archive], "records": [records], "bytes": [size]})

    return checkpointed(archives.where("archive is not null").select("archive").mapInArrow(run, "archive string, records long, bytes long"))


# reading -----------------------------------------------------------------------------------------


def _page_id(urn: str | None) -> int | None:
    number = (urn or "").strip("<>").removeprefix(PAGE_URN)
    return int(number) if re.fullmatch(r"-?\d+", number) else None


def parsed_record(member: bytes) -> dict | None:
    """A page's row from one inflated member; None for other kinds of records. The digest and length
    of a response are those of the payload read, of a revisit those that it states."""
    head, _, block = member.partition(b"\r\n\r\n")
    fields = parsed_headers(head)
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block[: int(fields["content-length"])].partition(b"\r\n\r\n")
    whole = kind == "response"
    return {
        "page_id": _page_id(fields.get("warc-record-id")),
        "payload_bytes": len(payload) if whole else int(parsed_headers(http).get("content-length", 0)),
        "payload_digest": base32_sha1(payload) if whole else fields.get("warc-payload-digest", "").removeprefix("sha1:"),
        "record_type": kind,
        "refers_to": None if whole else _page_id(fields.get("warc-refers-to")),
        "target_uri": fields.get("warc-target-uri"),
    }


def read_index(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).json(f"{target}/index")


def read_records(spark: SparkSession, target: str, read_bytes: int = READ_BYTES) -> DataFrame:
    """A row for each response and revisit of the normalised archives of ``target``, read by their
    members' offsets. Work is dealt by archive and offset, some ``read_bytes`` to a task."""
    index = read_index(spark, target).where("record_type in ('response', 'revisit')")
    total = index.agg(F.sum("length")).first()[0] or 0
    parts = max(1, -(-total // read_bytes))
    dealt = index.select("archive", "offset", "length").repartition(parts, "archive", F.floor(F.col("offset") / read_bytes)).sortWithinPartitions("archive", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _files(target)
        name = file = None
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("archive", pa.string()), ("offset", pa.int64())])
        for batch in batches:
            rows = []
            for place in batch.to_pylist():
                if place["archive"] != name:
                    name = place["archive"]
                    file = files.open_input_file(f"{path}/archives/{name}")
                row = parsed_record(zlib.decompress(file.read_at(place["length"], place["offset"]), GZIP))
                if row is not None:
                    rows.append(row | {"archive": name, "offset": place["offset"]})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return dealt.mapInArrow(run, RECORD_SCHEMA)


def archive_pages(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` to monolithic archives in ``folder/whole``, normalise these into ``folder``,
    remove them, and read all records back from what was normalised."""
    written = write_archives(pages, f"{folder}/whole", archive_bytes)
    normalise(written, f"{folder}/whole", folder)
    files, path = _files(folder)
    files.delete_dir(f"{path}/whole")
    return read_records(pages.sparkSession, folder)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives stay in the shared checkpoint folder; the rows are what is read back from them."""
    pages = read_spread(spark, sf_dir, "pages", "page_id")
    found = archive_pages(pages, f"{checkpoint_folder(spark)}/warc-{uuid.uuid4().hex}")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _base32_sql(hex_digits: str) -> str:
    """SQL for the base32 form of 40 hex digits: five of them are four characters."""
    return " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr({hex_digits}, {5 * g + 1}, 5))::BIGINT >> {shift}) & 31)::INTEGER + 1, 1)" for g in range(8) for shift in (15, 10, 5, 0))


OP13_SQL = f"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
), digests AS (
  SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS h, page_id IS DISTINCT FROM first AS again, first FROM payloads
)
SELECT page_id, payload_bytes, {_base32_sql("h")} AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM digests
"""
