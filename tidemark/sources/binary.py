"""Binary formats read in order: COPY streams, log event headers, page logs, documents, and entry names."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SIGNATURE = b"PGCOPY\n\xff\r\n\x00"


def copy_tuples(data: bytes) -> tuple[int, int]:
    """Tuples and columns of a binary COPY stream; field bytes are passed over unread.

    The first tuple fixes the number of columns; a wrong signature, a negative length other than null, a changed number
    of columns or a missing trailer is an error.
    """
    if data[:11] != SIGNATURE:
        raise ValueError("no COPY signature")
    at = 19 + struct.unpack_from(">i", data, 15)[0]
    tuples, columns = 0, -1
    while True:
        if at + 2 > len(data):
            raise ValueError("the stream ends without its trailer")
        (n,) = struct.unpack_from(">h", data, at)
        at += 2
        if n == -1:
            return tuples, max(columns, 0)
        if columns not in (-1, n) or n < 0:
            raise ValueError(f"{n} columns in tuple {tuples}")
        columns = n
        for _ in range(n):
            if at + 4 > len(data):
                raise ValueError("the stream ends within a tuple")
            (size,) = struct.unpack_from(">i", data, at)
            if size < -1:
                raise ValueError(f"a field of {size} bytes")
            at += 4 + max(size, 0)
        if at > len(data):
            raise ValueError("the stream ends within a field")
        tuples += 1


def copy_stream(rows: list[list[bytes | None]]) -> bytes:
    """A binary COPY stream of rows."""
    out = [SIGNATURE, struct.pack(">ii", 0, 0)]
    for row in rows:
        out.append(struct.pack(">h", len(row)))
        out += [struct.pack(">i", -1) if f is None else struct.pack(">i", len(f)) + f for f in row]
    return b"".join([*out, struct.pack(">h", -1)])


def event_header(data: bytes) -> dict[str, int]:
    """The 19 bytes, little-endian, at the head of a binary log event."""
    if len(data) < 19:
        raise ValueError("an event header has 19 bytes")
    at, kind, server, size, following, flags = struct.unpack_from("<IBIIIH", data)
    if size < 19:
        raise ValueError(f"an event of {size} bytes")
    return {"timestamp": at, "type": kind, "server_id": server, "length": size, "next_position": following, "flags": flags}


def page_checksum(data: bytes, big_endian: bool, s0: int = 0, s1: int = 0) -> tuple[int, int]:
    """The two-word running sum of a page log; the length is a multiple of eight bytes."""
    if len(data) % 8:
        raise ValueError("not a multiple of eight bytes")
    words = struct.unpack(f"{'>' if big_endian else '<'}{len(data) // 4}I", data)
    for a, b in zip(words[::2], words[1::2], strict=True):
        s0 = (s0 + a + s1) & 0xFFFFFFFF
        s1 = (s1 + b + s0) & 0xFFFFFFFF
    return s0, s1


def bson_documents(data: bytes) -> Iterator[bytes]:
    """Documents laid end to end, each with its own length in front."""
    at = 0
    while at < len(data):
        if at + 4 > len(data):
            raise ValueError("the archive ends within a length")
        (size,) = struct.unpack_from("<i", data, at)
        if size < 5 or at + size > len(data) or data[at + size - 1] != 0:
            raise ValueError("a document is cut or damaged")
        yield data[at : at + size]
        at += size


def entry_name(text: str) -> str:
    """A name of an archive entry, reversible: bytes that a path must not hold as `%XX`."""
    return "".join(chr(b) if 0x20 < b < 0x7F and b not in b'%/\\:*?"<>|' else f"%{b:02X}" for b in text.encode("utf-8"))


def entry_text(name: str) -> str:
    from urllib.parse import unquote

    return unquote(name, errors="strict")


def _copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            try:
                tuples, columns = copy_tuples(content or b"")
                rows.append((name, tuples, columns, None))
            except (ValueError, struct.error) as e:
                rows.append((name, None, None, str(e)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["path", "tuples", "columns", "problem"])


def copied_tuples(parts: DataFrame) -> DataFrame:
    """path, tuples, columns, problem of binary COPY streams given as (path, content); a damaged one names its problem."""
    return parts.select("path", "content").mapInArrow(_copied, "path string, tuples bigint, columns int, problem string")


class DumpDataSource(DataSource):
    """`format("dump")`: rows per table of the dumps in the folder `path`; one file is one partition."""

    @classmethod
    def name(cls) -> str:
        return "dump"

    def schema(self) -> str:
        return "path string, kind string, schema_name string, table_name string, rows bigint, problem string"

    def reader(self, schema) -> DataSourceReader:
        return DumpReader(self.options["path"])


class DumpReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")
        names = [f.path for f in system.get_file_info(fs.FileSelector(root)) if f.is_file]
        finished = [n for n in sorted(names) if not n.rsplit("/", 1)[-1].startswith(".") and not n.endswith((".part", ".tmp"))]
        return [InputPartition(n) for n in finished]

    def read(self, partition):
        from pyarrow import fs

        from tidemark.sources.dumps import counted

        system, _ = fs.FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")
        with system.open_input_stream(partition.value, compression=None) as stream:
            yield from counted(partition.value, stream)


def event_headers(events: DataFrame, keep: str, content: str = "content") -> DataFrame:
    """keep and the fields of the header of each event given as bytes; a short or wrong header leaves them null."""
    fields = ["timestamp", "type", "server_id", "length", "next_position", "flags"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(1).to_pylist():
                try:
                    rows.append(event_header(data or b""))
                except ValueError:
                    rows.append({})
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r.get(f) for r in rows], pa.int64()) for f in fields]], names=["k", *fields])

    from pyspark.sql import functions as F

    slim = events.select(F.col(keep).alias("k"), F.col(content).alias("c"))
    out = slim.mapInArrow(read, f"k {slim.schema['k'].dataType.simpleString()}, " + ", ".join(f"{f} bigint" for f in fields))
    return out.withColumnRenamed("k", keep)


def archive_documents(archives: DataFrame) -> DataFrame:
    """path, documents, bytes, problem of archives of documents laid end to end, given as (path, content)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                n = size = 0
                problem = None
                try:
                    for doc in bson_documents(data or b""):
                        n, size = n + 1, size + len(doc)
                except ValueError as e:
                    problem = str(e)
                rows.append((path, n, size, problem))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["path", "documents", "bytes", "problem"])

    return archives.select("path", "content").mapInArrow(read, "path string, documents bigint, bytes bigint, problem string")
