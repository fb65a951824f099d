"""Growing files of lines as a stream: what was appended is read, and nothing else.

The offset of a stream is the length of each file that has been read, up to its last line end. A
line that is not yet whole is held back until it is. A file may be large: what is new of it is dealt to
tasks in stretches of ``stretch`` bytes, each from the first line that begins in it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, at long, line string"
CHUNK = 1 << 16


def _files(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri)) if ":/" in uri else (pa.fs.LocalFileSystem(), uri)


def sizes(uri: str) -> dict[str, int]:
    """Bytes of each file of a folder, or of one file; hidden ones are left out."""
    files, path = _files(uri)
    info = files.get_file_info(path)
    found = files.get_file_info(pa.fs.FileSelector(path)) if info.type == pa.fs.FileType.Directory else [info]
    return {f.path: f.size for f in found if f.type == pa.fs.FileType.File and not f.base_name.startswith((".", "_"))}


def whole(uri: str, path: str, known: int, size: int) -> int:
    """The end of the last whole line of a file, of which ``known`` bytes end in one; reads backwards from the end."""
    end = size
    with _files(uri)[0].open_input_file(path) as data:
        while end > known:
            start = max(known, end - CHUNK)
            at = data.read_at(end - start, start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return known


@dataclass
class Stretch(InputPartition):
    """The lines of a file that begin from ``start`` on and before ``end``; none goes on beyond ``limit``."""

    uri: str
    path: str
    start: int
    end: int
    limit: int
    first: bool


def stretches(uri: str, begun: dict[str, int], ended: dict[str, int], most: int) -> list[Stretch]:
    out = []
    for path, limit in sorted(ended.items()):
        start = begun.get(path, 0)
        out += [Stretch(uri, path, a, min(a + most, limit), limit, a == start) for a in range(start, limit, most)]
    return out


def read_stretch(p: Stretch) -> Iterator[pa.RecordBatch]:
    """Batches of whole lines; bytes that are no UTF-8 are replaced."""
    with _files(p.uri)[0].open_input_file(p.path) as data:
        at, rest = p.start, b""
        if not p.first:  # the line that is under way belongs to the stretch before
            at -= 1
            while at < p.limit:
                piece = data.read_at(min(CHUNK, p.limit - at), at)
                cut = piece.find(b"\n")
                at += cut + 1 if cut >= 0 else len(piece)
                if cut >= 0:
                    break
        begins, lines, read = at, [], at
        while begins < p.end and (read < p.limit or rest):
            piece = data.read_at(min(CHUNK, p.limit - read), read)
            read += len(piece)
            *full, rest = (rest + piece).split(b"\n")
            for line in full:
                if begins < p.end:
                    lines.append((begins, line))
                begins += len(line) + 1
            if not piece:
                break
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([p.path] * len(lines)), pa.array([b for b, _ in lines], pa.int64()), pa.array([x.decode("utf-8", "replace") for _, x in lines])], names=["file", "at", "line"])
                lines = []


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.most = options["path"], int(options.get("stretch", 64_000_000))

    def partitions(self) -> list[Stretch]:
        return stretches(self.uri, {}, {f: whole(self.uri, f, 0, n) for f, n in sizes(self.uri).items()}, self.most)

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        yield from read_stretch(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.uri, self.most = options["path"], int(options.get("stretch", 64_000_000))
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": json.dumps({})}

    def latestOffset(self) -> dict:
        now = {}
        for path, size in sizes(self.uri).items():
            known = self.seen.get(path, 0)
            if size < known:
                raise ValueError(f"{path} has been cut from {known} to {size} bytes; a log only grows")
            now[path] = whole(self.uri, path, known, size)
        self.seen |= now
        return {"files": json.dumps(self.seen, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        begun, ended = json.loads(start["files"]), json.loads(end["files"])
        self.seen = {f: max(n, self.seen.get(f, 0)) for f, n in ended.items()} | {f: n for f, n in self.seen.items() if f not in ended}
        return stretches(self.uri, begun, ended, self.most)

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        yield from read_stretch(partition)


class TailSource(DataSource):
    """``spark.readStream.format("tail").load(folder)``: file, place and text of each whole line."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def tail_lines(spark: SparkSession, folder: str, schema: str, stream: bool = True, stretch: int = 64_000_000) -> DataFrame:
    """Rows of the JSON lines in a folder's growing files; what is no JSON object, or doesn't fit the schema, is left out."""
    spark.dataSource.register(TailSource)
    source = spark.readStream if stream else spark.read
    rows = source.format("tail").option("stretch", stretch).load(folder)
    bad = "__broken"
    parsed = F.from_json("line", f"{schema}, {bad} string", {"columnNameOfCorruptRecord": bad})
    return rows.select(parsed.alias("r")).where(F.col("r").isNotNull() & F.col(f"r.{bad}").isNull()).select("r.*").drop(bad)
